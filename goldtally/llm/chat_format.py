"""Operator 11: chat formatting with a grammar round trip.

A template gives each role an opening and a closing control string.  A turn is
rendered as it is, parsed again by a deterministic parser and compared with
its source; where they differ, the control strings in its content are escaped
by one backslash after their first character (one more where there are some
already), and the turn is rendered and parsed anew until both are identical.
Unescaping takes one backslash away, so any text comes back.

The rendered conversation is the concatenation of its turns' segments: a turn
starts and ends the parser in the same state, so turns are rendered and checked
where they are read, whatever the length of their conversation.  A segment
carries its loss mask as a span of code points.  ``read_back`` sorts segments by
conversation and parses, unescapes and hashes them in a stream: a conversation
that holds most rows goes through one task, as its hash runs over it in order,
but never into its memory.

Defined cases: a null text or role is empty; rows are ordered by turn, null
first, ties by role, then by rendered content; repeated rows are turns of their
own; rows with a null conv_id make one conversation; roles that the template
does not name are written out, escaped like texts; extra columns are ignored;
an empty table gives an empty result (the query adds its conversation -1).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


class ParseError(ValueError):
    """The text is no sequence of turns."""


@dataclass(frozen=True)
class Marks:
    """Control strings around a turn's content, and the plain text between them and the content."""

    open: str
    close: str
    lead: str = ""
    tail: str = ""


@dataclass(frozen=True)
class Template:
    """Marks by role, marks for the role and the content of any other turn, and the role that is learnt."""

    roles: dict[str, Marks]
    name: Marks
    other_close: str
    learnt: str = "assistant"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        controls = {*(m.open for m in self.roles.values()), *(m.close for m in self.roles.values()), self.name.open, self.name.close, self.other_close}
        for a in controls:
            if len(a) < 2 or "\\" in a or any(a != b and a in b for b in controls):
                raise ValueError(f"control string {a!r} is too short, holds a backslash or lies in another one")
            if any(a[-k:] == b[:k] for b in controls for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"control string {a!r} ends as another one starts")
        opens = [*(m.open for m in self.roles.values()), self.name.open]
        if len(set(opens)) < len(opens):
            raise ValueError("two roles share an opening control string")
        object.__setattr__(self, "controls", tuple(sorted(controls)))


INSTRUCT = Template(
    {"system": Marks("<<SYS>>", "<</SYS>>", "\n", "\n"), "user": Marks("[INST]", "[/INST]", " ", " "), "assistant": Marks("<s>", "</s>", " ", " ")},
    Marks("[ROLE]", "[/ROLE]"), "[/TURN]")


class Grammar:
    """Renders and parses turns of one template."""

    def __init__(self, template: Template):
        self.template = template
        self.lexer = re.compile("|".join(map(re.escape, template.controls)))
        # a control string with any number of backslashes after its first character
        self.guarded = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in template.controls))
        self.escaped = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in template.controls))
        self.by_open = {m.open: (role, m) for role, m in template.roles.items()}

    def escape(self, text: str) -> str:
        return self.guarded.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[0][0] + m[0][2:], text)

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """One turn without any escaping: segment, and the span of its content there."""
        marks = self.template.roles.get(role)
        if marks:
            head, foot = marks.open + marks.lead, marks.tail + marks.close
        else:
            name = self.template.name
            head, foot = name.open + name.lead + role + name.tail + name.close, self.template.other_close
        return head + text + foot, len(head), len(head) + len(text)

    def parse(self, text: str) -> list[tuple[str, str, int, int]]:
        """The turns of a rendered text: role, content (both unescaped), and the content's span.

        The grammar needs no look-ahead: an opening control string must stand
        where a turn starts, and the next control string must be its closing one.
        """
        tokens = self.lexer.finditer(text)
        at, turns = 0, []

        def inside(start: int, close: str, lead: str, tail: str):
            token = next(tokens, None)
            if token is None or token[0] != close:
                raise ParseError(f"no {close} after character {start}")
            first, last = start + len(lead), token.start() - len(tail)
            if first > last or text[start:first] != lead or text[last:token.start()] != tail:
                raise ParseError(f"no room for content at character {start}")
            return first, last, token.end()

        while at < len(text):
            token = next(tokens, None)
            if token is None or token.start() != at:
                raise ParseError(f"no turn at character {at}")
            if token[0] in self.by_open:
                role, marks = self.by_open[token[0]]
                first, last, at = inside(token.end(), marks.close, marks.lead, marks.tail)
            elif token[0] == self.template.name.open:
                name = self.template.name
                first, last, at = inside(token.end(), name.close, name.lead, name.tail)
                role = self.unescape(text[first:last])
                if role in self.template.roles:
                    raise ParseError(f"role {role} has marks of its own")
                first, last, at = inside(at, self.template.other_close, "", "")
            else:
                raise ParseError(f"{token[0]} at character {at}")
            turns.append((role, self.unescape(text[first:last]), first, last))
        return turns

    def round_trip(self, role: str, text: str) -> tuple[str, int, int, int]:
        """A segment that parses back to just this turn: segment, content span, times its content was escaped."""
        shown_role, shown = role, text
        for times in range(3):
            segment, first, last = self.render(shown_role, shown)
            try:
                if self.parse(segment) == [(role, text, first, last)]:
                    return segment, first, last, times
            except ParseError:
                pass
            shown_role, shown = (role if role in self.template.roles else self.escape(role)), self.escape(text)
        raise ParseError(f"no escaping brings a turn of role {role!r} back")


def formatted(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Each turn's segment: conv_id, turn, role, segment, start and length of its content (code points), loss, escaped.

    The segments of a conversation, in order, are its formatted text; the
    content of rows with ``loss`` is what a model learns.
    """

    def run(batches):
        grammar = Grammar(template)
        for batch in batches:
            roles, out = batch.column("role").to_pylist(), []
            for role, text in zip(roles, batch.column("text").to_pylist()):
                segment, first, last, times = grammar.round_trip(role, text)
                out.append((segment, first, last - first, role == template.learnt, times > 0))
            columns = [pa.array([row[k] for row in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), *columns],
                                             names=["conv_id", "turn", "role", "segment", "start", "length", "loss", "escaped"])

    filled = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return filled.mapInArrow(run, "conv_id long, turn long, role string, segment string, start long, length long, loss boolean, escaped boolean")


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Parse formatted conversations again: one row for each with the digests of its turns and of what its loss mask covers."""

    def run(batches):
        grammar, none = Grammar(template), object()
        now = none
        n = chars = learnt = 0
        turns = loss = None
        for batch in batches:
            out = []
            for conv, segment, start, length, masked in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "start", "length", "loss"))):
                if conv != now:
                    if now is not none:
                        out.append((now, n, turns.hexdigest(), learnt, loss.hexdigest(), chars))
                    now, n, chars, learnt, turns, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text, _, _ in grammar.parse(segment):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                if masked:
                    text = grammar.unescape(segment[start:start + length])
                    learnt += len(text)
                    loss.update(text.encode())
                chars += len(segment)
            yield _rows(out)
        if now is not none:
            yield _rows([(now, n, turns.hexdigest(), learnt, loss.hexdigest(), chars)])

    content = F.substr("segment", F.col("start") + 1, F.col("length"))
    laid = segments.select("conv_id", "turn", "role", "segment", "start", "length", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", content)
    return laid.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], t) for k, t in enumerate(types)],
                                      names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


#: The contract's conversation of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(formatted(rows.unionByName(more)))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
sized AS (
  SELECT *, CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 20 + length(role)
      + len(regexp_extract_all(role, '\[\\*INST\]|\[\\*/INST\]|<\\*s>|<\\*/s>|<\\*<SYS>>|<\\*</SYS>>|\[\\*ROLE\]|\[\\*/ROLE\]|\[\\*/TURN\]')) END
    + length(text) + len(regexp_extract_all(text, '\[\\*INST\]|\[\\*/INST\]|<\\*s>|<\\*/s>|<\\*<SYS>>|<\\*</SYS>>|\[\\*ROLE\]|\[\\*/ROLE\]|\[\\*/TURN\]')) AS size FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
