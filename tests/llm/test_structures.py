"""Chat formatting, prefix trie and Merkle manifest against plain Python, with
nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from goldtally.llm import chat_format, merkle, prefix_trie

_rng = random.Random(7)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat formatting -------------------------------------------------------

CONTROLS = list(chat_format.INSTRUCT.controls)
MESSY = st.lists(st.sampled_from([*CONTROLS, "\\", "[", "]", "<", "</", "s>", "INST]", "[\\INST]", " ", "\n", "ok", "é🙂", "[\\\\/TURN]"]), max_size=12).map("".join)


@given(st.sampled_from(["user", "assistant", "system", "", "tool", "[ROLE]", "a[/ROLE]\\"]), MESSY)
@settings(max_examples=400, deadline=None)
def test_turn_comes_back(role, text):
    grammar = chat_format.Grammar(chat_format.INSTRUCT)
    segment, first, last, times = grammar.round_trip(role, text)
    assert grammar.parse(segment) == [(role, text, first, last)]
    assert grammar.unescape(segment[first:last]) == text and times <= 1
    # texts without control strings, or their escaped forms, stay as they are
    if not grammar.guarded.search(text):
        assert segment[first:last] == text


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x"]), MESSY), max_size=6))
@settings(max_examples=200, deadline=None)
def test_whole_conversation_parses(turns):
    grammar = chat_format.Grammar(chat_format.INSTRUCT)
    whole = "".join(grammar.round_trip(*t)[0] for t in turns)
    assert [(r, t) for r, t, _, _ in grammar.parse(whole)] == turns


def test_parser_refuses_what_is_no_turn():
    grammar = chat_format.Grammar(chat_format.INSTRUCT)
    for text in ("x", "[INST] a", "[INST] a </s>", "[INST][/INST]", "<s> a </s>x", "[ROLE]user[/ROLE]a[/TURN]", "[/INST]", "[INST] [INST] [/INST]"):
        with pytest.raises(chat_format.ParseError):
            grammar.parse(text)


def test_template_must_be_clear():
    marks = chat_format.Marks
    for roles in ({"u": marks("<a>", "<a>b")}, {"u": marks("<ab>", "b>x")}, {"u": marks("<", "</x>")}, {"u": marks("<u>", "</u>"), "v": marks("<u>", "</v>")}):
        with pytest.raises(ValueError):
            chat_format.Template(roles, marks("[ROLE]", "[/ROLE]"), "[/TURN]")


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello [INST] there"), (1, None, "system", "first"), (2, 0, None, None), (2, 1, "assistant", None),
    (3, 5, "user", "same turn"), (3, 5, "user", "same turn"), (3, 5, "assistant", "same turn"), (4, 0, "tool", "x" * 50_000), (None, 0, "user", "no id"),
    (4, 1, "assistant", "</s>" * 2000), (5, 0, "assistant", ""), (5, 1, "assistant", "a"), (5, 2, "user", "b"), (5, 3, "assistant", "c\\"),
]


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(*r, "clash", 3) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, segment string, depth int").repartition(3)


def test_chat_format_against_plain_python(spark, conversations):
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(conversations)).collect()}
    assert len(got) == 6
    for conv, row in got.items():
        rows = sorted((r for r in CONVERSATIONS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        learnt = "".join(r[3] or "" for r in rows if r[2] == "assistant")
        assert row.n_turns == len(rows) and row.turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows))
        assert row.loss_chars == len(learnt) and row.loss_sha256 == sha(learnt)
    shown = "".join(r.segment for r in chat_format.formatted(conversations).filter("conv_id = 1").orderBy("turn").collect())
    assert shown == "<<SYS>>\nfirst\n<</SYS>>[INST] hi [/INST]<s> hello [\\INST] there </s>"
    assert got[1].formatted_chars == len(shown)
    assert chat_format.read_back(chat_format.formatted(conversations.limit(0))).count() == 0


def test_op11_reads_the_table(spark, conversations, tmp_path):
    conversations.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.op11_chat_format(spark, str(tmp_path)).collect()}
    text = chat_format.CONTROL_TEXT
    assert len(got) == 7 and got[-1].n_turns == 2
    assert got[-1].turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n") and got[-1].loss_sha256 == sha(text) and got[-1].loss_chars == len(text)


# --- prefix trie -----------------------------------------------------------

def test_slots_are_minimal_perfect_and_verified():
    keys = np.frombuffer(b"".join(hashlib.sha256(b"%d" % k).digest()[:16] for k in range(5000)), dtype="<u8").reshape(-1, 2)
    made = prefix_trie.SlotTable(keys[:4000])
    assert sorted(made.slots(keys[:4000]).tolist()) == list(range(4000))
    assert (made.slots(keys[4000:]) == -1).all()
    assert prefix_trie.SlotTable(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def trie_by_hand(rows, borrowed, base):
    turns: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    made = {c: tuple(turns.get(base(c), [])[:borrowed(c)] + own[borrowed(c):]) for c, own in turns.items()}
    nodes: dict = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = set()
    kids: dict = {}
    for node in nodes:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    for node, members in nodes.items():
        below = [u for u in nodes if u[:len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in members if made[c] == node)))
        out.add((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(kids.get(node, [])), sum(u not in kids for u in below),
                 sum((len(nodes[u]) - 1) * len(WORDS.findall(u[-1][1])) for u in below if u), sha(ends)))
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _random_conversations(n, longest):
    rows = []
    for c in range(-3, n):
        for t in range(_rng.randint(1, longest)):
            rows.append((c, t if _rng.random() < .9 else None, _rng.choice(["user", "assistant", None]), _rng.choice(["a", "b b", "", None, "c\tc c"])))
    return rows + [(None, 1, "user", "no id"), (n, 1, "user", "z"), (n, 1, "user", "y y")]


@pytest.mark.parametrize("band, shard_rows", [(4096, 200_000), (3, 40), (1, 7)])
def test_trie_against_plain_python(spark, band, shard_rows):
    rows = _random_conversations(60, 7) + [(500, k, "user", "long") for k in range(40)] + [(501, k, "user", "long") for k in range(33)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(4)
    def h(c): return zlib.crc32(str(c).encode()) % 4
    conv = F.col("conv_id")
    made = prefix_trie.rebuilt(frame, F.crc32(conv.cast("string").cast("binary")) % 4, conv - conv % 20)
    got = [tuple(r[c] for c in NODE) for r in prefix_trie.trie(made, band, shard_rows).collect()]
    want = trie_by_hand(rows, h, lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1))
    assert len(got) == len(set(got)) == len(want) and set(got) == want


def test_op12_turnless_and_empty(spark, tmp_path):
    # conversation 22 has fewer turns than it borrows, and nothing to borrow from: it ends in the root
    assert zlib.crc32(b"22") % 4 >= 1
    spark.createDataFrame([(22, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.op12_prefix_trie(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(22, 0, None, 1, 0, 1, 0, sha("22"))]
    (tmp_path / "e").mkdir()
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/e/conversations.parquet")
    assert prefix_trie.op12_prefix_trie(spark, f"{tmp_path}/e").count() == 0


# --- Merkle manifest -------------------------------------------------------

@pytest.mark.parametrize("levels", [1, 2, 3, 6, 7, 14])
def test_addresses_fill_the_tree_and_keep_subtrees_together(levels):
    places = {(d, i): int(p) for d in range(levels) for i, p in enumerate(merkle.address(levels, d, np.arange(1 << d)))}
    assert sorted(places.values()) == list(range((1 << levels) - 1))
    if levels > 1:
        top = levels // 2
        assert sorted(p for (d, _), p in places.items() if d < top) == list(range((1 << top) - 1))
        size = (1 << (levels - top)) - 1
        for k in range(1 << top):
            part = sorted(p for (d, i), p in places.items() if d >= top and i >> (d - top) == k)
            assert part == list(range((1 << top) - 1 + k * size, (1 << top) - 1 + (k + 1) * size))


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def _siblings(levels, i):
    for level in levels[:-1]:
        j = i ^ 1
        yield (level[j] if j < len(level) else None, j < i)
        i >>= 1


def merkle_by_hand(rows):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))
    runs: dict = {}
    for r in rows:
        runs.setdefault(r[2], []).append(r)
    if not rows:
        return
    order = sorted(runs, key=lambda k: (k is not None, (k or "").encode()))
    for k in order:
        runs[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: _tree([leaf(r) for r in runs[k]]) for k in order}
    top = _tree([trees[k][-1][0] for k in order])
    root = top[-1][0]
    for n, k in enumerate(order):
        for i, r in enumerate(runs[k]):
            path = [*_siblings(trees[k], i), *_siblings(top, n)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:4], r[4] + 1)) if hit and r[4] is not None else leaf(r)
            for other, left in path:
                now = sha(now) if other is None else sha(other + now) if left else sha(now + other)
            yield r[0], leaf(r), trees[k][-1][0], root, sha("".join(o for o, _ in path if o)), now, now == root


def _documents():
    langs = ["en"] * 8 + ["fr", "日本", None, "é", "", "-", "=", "zz"]
    rows = [(k if k % 11 else None, _rng.choice(["", None, "text é🙂 " * (k % 5), "x" * 3]), _rng.choice(langs), _rng.choice([None, "s"]), _rng.choice([None, 0, 17, 2**63 - 1])) for k in range(150)]
    return rows + rows[:20] + [(7, "same", "en", "s", 4)] * 5 + [(900, "y" * 30_000, "lone", None, 1)]


@pytest.mark.parametrize("block", [1, 2, 13])
def test_manifest_against_plain_python(spark, block):
    rows = _documents()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, run string").repartition(3)
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    tampered = merkle.leaf_digest(*cols[:3], cols[3].cast("decimal(20,0)") + 1, cols[4])
    made = merkle.manifest(docs, cols[2], cols[0], merkle.leaf_digest(*cols), {"doc_id": cols[0], "claimed": F.when(hit, tampered)}, block)
    got = sorted(map(tuple, merkle.verified(merkle.prove(made, ["doc_id", "claimed"])).collect()), key=repr)
    assert got == sorted(merkle_by_hand(rows), key=repr)


def test_op13_query_and_small_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, path string"
    for name, rows in (("one", [(1, "a", "en", "s", 1)]), ("none", []), ("some", _documents()[:40])):
        spark.createDataFrame([(*r, "clash") for r in rows], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = sorted(map(tuple, merkle.op13_merkle_manifest(spark, f"{tmp_path}/{name}").collect()), key=repr)
        assert got == sorted(merkle_by_hand(rows), key=repr)
