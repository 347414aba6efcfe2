"""Comparison rules: pure ``Column -> Column`` functions.

Every rule returns a boolean Column and contains no action and no UDF, so a
whole scorecard compiles into one whole-stage-codegen projection.  Python's
``str.strip`` removes all whitespace and ``\\w`` is Unicode; the Java regex
forms below use ``(?U)`` to get the same behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- text helpers -----------------------------------------------------------


# The characters Python's str.strip() removes (str.isspace):
# ASCII tab..carriage return, file/group/record/unit separators, space,
# NEL, no-break space, ogham space, en quad..hair space, line and paragraph
# separators, narrow no-break space, medium mathematical space, ideographic
# space.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def trim_ws(c: Column) -> Column:
    """Strip leading/trailing whitespace of any kind (Python ``str.strip``).
    ``btrim`` with an explicit character set stays in generated code; Spark's
    plain ``trim`` would only remove spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def as_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """``str(value)`` for scalar values; strings pass unchanged."""
    if dtype is None or isinstance(dtype, T.StringType):
        return c
    return c.cast("string")


def null_frame(g: Column, p: Column, rule: Column) -> Column:
    """Both null -> true, one null -> false, else the rule."""
    return (F.when(g.isNull() & p.isNull(), F.lit(True))
            .when(g.isNull() | p.isNull(), F.lit(False))
            .otherwise(rule))


# --- scalar rules -----------------------------------------------------------


def exact(g: Column, p: Column) -> Column:
    """Null-safe, type-sensitive equality."""
    return g.eqNullSafe(p)


def text_key(c: Column, dtype: T.DataType | None = None) -> Column:
    """C3 normal form.  Strings: strip, lower, drop punctuation (anything not a
    letter, digit, ``_`` or whitespace), drop U+0020.  Other scalars: their
    text, stripped."""
    if dtype is not None and not isinstance(dtype, T.StringType):
        return trim_ws(c.cast("string"))
    cleaned = F.regexp_replace(F.lower(trim_ws(c)), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.replace(cleaned, F.lit(" "), F.lit(""))


def text_rule(g: Column, p: Column, gtype=None, ptype=None) -> Column:
    return null_frame(g, p, text_key(g, gtype) == text_key(p, ptype))


def enum_key(c: Column, dtype: T.DataType | None = None) -> Column:
    """C4: strip, lower, runs of '-' or whitespace -> '_'."""
    return F.regexp_replace(F.lower(trim_ws(as_text(c, dtype))), r"(?U)[-\s]+", "_")


def enum_rule(g: Column, p: Column, gtype=None, ptype=None) -> Column:
    return null_frame(g, p, enum_key(g, gtype) == enum_key(p, ptype))


def date_text_rule(g: Column, p: Column, gtype=None, ptype=None) -> Column:
    """Dates compared as their text."""
    return null_frame(g, p, as_text(g, gtype) == as_text(p, ptype))


# Numbers in the spelling Python's float() accepts: sign, digits with single
# underscores between them, dot, exponent, surrounding whitespace, and the
# words nan / inf / infinity.  Spark's cast also accepts a trailing 'd'/'f'
# (which Python refuses) and refuses underscores, so texts are screened and
# underscores dropped before the cast.
_DIGITS = r"[0-9](_?[0-9])*"
_NUM_TEXT = rf"^\s*[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?\s*$"


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    if dtype is not None and isinstance(dtype, T.NumericType):
        return c.cast("double")
    text = as_text(c, dtype)
    word = F.lower(trim_ws(text))
    return (F.when(text.rlike(_NUM_TEXT), F.replace(trim_ws(text), F.lit("_"), F.lit("")).try_cast("double"))
            .when(word.isin("nan", "+nan", "-nan"), F.lit(float("nan")))
            .when(word.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
            .when(word.isin("-inf", "-infinity"), F.lit(float("-inf"))))


def number_rule(g: Column, p: Column, gtype=None, ptype=None) -> Column:
    """Both parse as numbers -> numeric equality, else text equality."""
    gn, pn = to_number(g, gtype), to_number(p, ptype)
    numeric = F.when(F.isnan(gn) | F.isnan(pn), F.lit(False)).otherwise(gn == pn)
    both = gn.isNotNull() & pn.isNotNull()
    return null_frame(g, p, F.when(both, numeric)
                      .otherwise(as_text(g, gtype) == as_text(p, ptype)))


def rule_key(rule, c: Column, dtype: T.DataType | None = None) -> Column:
    """The normal form that ``rule`` (text, enum, date or number) compares, null
    for a null value only: made once for a value that meets many others."""
    if rule is number_rule:
        return F.struct(to_number(c, dtype).alias("number"), as_text(c, dtype).cast("string").alias("text"))
    form = {text_rule: text_key, enum_rule: enum_key, date_text_rule: as_text}[rule]
    return form(c, dtype).cast("string")


def keys_equal(rule, g: Column, p: Column) -> Column:
    """What ``rule`` says of two values, given their ``rule_key``."""
    if rule is not number_rule:
        return g.eqNullSafe(p)
    both = g["number"].isNotNull() & p["number"].isNotNull()
    same = F.when(F.isnan(g["number"]) | F.isnan(p["number"]), F.lit(False)).otherwise(g["number"] == p["number"])
    return null_frame(g["text"], p["text"], F.when(both, same).otherwise(g["text"] == p["text"]))


def casefold_rule(g: Column, p: Column, gtype=None, ptype=None) -> Column:
    """Case-insensitive, stripped text."""
    key = lambda c, t: F.lower(trim_ws(as_text(c, t)))
    return null_frame(g, p, key(g, gtype) == key(p, ptype))


# US state codes and names (50 states, no DC), as used by the
# state comparison of the patient task.
US_STATES = [
    ("AL", "Alabama"), ("AK", "Alaska"), ("AZ", "Arizona"), ("AR", "Arkansas"),
    ("CA", "California"), ("CO", "Colorado"), ("CT", "Connecticut"), ("DE", "Delaware"),
    ("FL", "Florida"), ("GA", "Georgia"), ("HI", "Hawaii"), ("ID", "Idaho"),
    ("IL", "Illinois"), ("IN", "Indiana"), ("IA", "Iowa"), ("KS", "Kansas"),
    ("KY", "Kentucky"), ("LA", "Louisiana"), ("ME", "Maine"), ("MD", "Maryland"),
    ("MA", "Massachusetts"), ("MI", "Michigan"), ("MN", "Minnesota"), ("MS", "Mississippi"),
    ("MO", "Missouri"), ("MT", "Montana"), ("NE", "Nebraska"), ("NV", "Nevada"),
    ("NH", "New Hampshire"), ("NJ", "New Jersey"), ("NM", "New Mexico"), ("NY", "New York"),
    ("NC", "North Carolina"), ("ND", "North Dakota"), ("OH", "Ohio"), ("OK", "Oklahoma"),
    ("OR", "Oregon"), ("PA", "Pennsylvania"), ("RI", "Rhode Island"), ("SC", "South Carolina"),
    ("SD", "South Dakota"), ("TN", "Tennessee"), ("TX", "Texas"), ("UT", "Utah"),
    ("VT", "Vermont"), ("VA", "Virginia"), ("WA", "Washington"), ("WV", "West Virginia"),
    ("WI", "Wisconsin"), ("WY", "Wyoming"),
]


def _state_map() -> Column:
    pairs = []
    for code, name in US_STATES:
        pairs += [F.lit(code), F.lit(name.lower())]
    return F.create_map(*pairs)


def state_key(c: Column, dtype: T.DataType | None = None) -> Column:
    """C8 normal form: code -> lower full name, anything else lower text,
    blank -> null.  (A full name maps to itself lower-cased.)"""
    s = trim_ws(as_text(c, dtype))
    return F.when(s == "", F.lit(None).cast("string")).otherwise(
        F.coalesce(F.try_element_at(_state_map(), F.upper(s)), F.lower(s)))


def state_rule(g: Column, p: Column, gtype=None, ptype=None) -> Column:
    return null_frame(g, p, state_key(g, gtype).eqNullSafe(state_key(p, ptype)))


# The date spellings tried in order by the birth-date rule
# (long month name, short month name, month first, day first).
DATE_PATTERNS = ["MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "d/M/yyyy"]


def date_key(c: Column, dtype: T.DataType | None = None) -> Column:
    """C9 normal form: cut at 'T'; ISO-looking text kept; else the first of
    DATE_PATTERNS that parses, as yyyy-MM-dd; else the text; blank -> null."""
    s = trim_ws(as_text(c, dtype))
    head = trim_ws(F.split(s, "T", 2).getItem(0))
    iso_like = (F.length(head) == 10) & head.rlike(r"^[0-9]{4}-[^-]*-[^-]*$")
    collapsed = F.regexp_replace(head, r"(?U)\s+", " ")
    # A pattern is only tried on text of its shape: failed parses are costly,
    # and the shapes are necessary conditions, so results do not change.
    shapes = [r"^\p{L}+ [0-9]+, [0-9]+$", r"^\p{L}+ [0-9]+, [0-9]+$", r"^[0-9]+/[0-9]+/[0-9]+$",
              r"^[0-9]+/[0-9]+/[0-9]+$"]
    parsed = F.coalesce(*[F.when(collapsed.rlike(shape), F.try_to_date(collapsed, fmt))
                          for shape, fmt in zip(shapes, DATE_PATTERNS)])
    return (F.when(s == "", F.lit(None).cast("string"))
            .when(iso_like, head)
            .otherwise(F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), head)))


def birthdate_rule(g: Column, p: Column, gtype=None, ptype=None) -> Column:
    return null_frame(g, p, date_key(g, gtype).eqNullSafe(date_key(p, ptype)))


def date_part(c: Column, dtype: T.DataType | None = None) -> Column:
    """Text before the first 'T', stripped."""
    return trim_ws(F.split(as_text(c, dtype), "T", 2).getItem(0))


def datetime_date_rule(g: Column, p: Column, gtype=None, ptype=None) -> Column:
    return null_frame(g, p, date_part(g, gtype) == date_part(p, ptype))


def list_vs_text_rule(lst: Column, s: Column) -> Column:
    """C11: a one-element list equals a text by C7; other lengths never."""
    key = lambda c: F.lower(trim_ws(c))
    return null_frame(lst, s, F.when(F.size(lst) == 1, key(F.get(lst, 0)) == key(s))
                      .otherwise(F.lit(False)))


def list_rule(g: Column, p: Column, gtype=None, ptype=None) -> Column:
    """Ordered, case-sensitive list equality."""
    return null_frame(g, p, g == p)


def address_line_key(c: Column, dtype: T.DataType | None = None) -> Column:
    """C14: one-element list -> its text, longer list -> skipped (null),
    lower + strip; empty -> skipped."""
    if isinstance(dtype, T.ArrayType):
        v = F.when(F.size(c) == 1, F.lower(trim_ws(F.get(c, 0))))
    else:
        v = F.lower(trim_ws(as_text(c, dtype)))
    return F.when(v != "", v)


def patient_rule_for(field: str, gtype: T.DataType, ptype: T.DataType):
    """C13 for the patient task: rule by field-name fragment, then by types."""
    name = field.lower()
    if "state" in name:
        return state_rule
    if "birthdate" in name:
        return birthdate_rule
    if "encounter_period" in name:
        return datetime_date_rule
    g_list, p_list = isinstance(gtype, T.ArrayType), isinstance(ptype, T.ArrayType)
    if g_list and not p_list:
        return lambda g, p, gt=None, pt=None: list_vs_text_rule(g, as_text(p, pt))
    if p_list and not g_list:
        return lambda g, p, gt=None, pt=None: list_vs_text_rule(p, as_text(g, gt))
    if g_list and p_list:
        return list_rule
    return casefold_rule


# --- collection rules -------------------------------------------------------


def _empty_to_null(c: Column) -> Column:
    """P10: an empty list counts as missing."""
    return F.when(F.size(c) > 0, c)


def set_overlap(g: Column, p: Column) -> Column:
    """L1 -> struct(m, t).  Both empty/null -> (1, 1); else distinct common
    elements over distinct gold elements (nulls count as an element, as in a
    Python set)."""
    g2, p2 = _empty_to_null(g), _empty_to_null(p)
    both_missing = g2.isNull() & p2.isNull()
    empty = F.array().cast("array<string>")
    gd = F.array_distinct(F.coalesce(g2, empty))
    pd_ = F.coalesce(p2, empty)
    m = F.size(F.array_intersect(gd, pd_))
    t = F.size(gd)
    return F.when(both_missing, F.struct(F.lit(1).alias("m"), F.lit(1).alias("t"))) \
        .otherwise(F.struct(m.cast("int").alias("m"), t.cast("int").alias("t")))


def size0(c: Column) -> Column:
    """List length with null counted as 0 (L3)."""
    return F.coalesce(F.size(c), F.lit(0))


def count_rule(g: Column, p: Column) -> Column:
    """L3: list lengths equal, null = 0."""
    return size0(g) == size0(p)


def line_set(items: Column, line_of, dtype: T.DataType | None = None) -> Column:
    """The distinct, sorted set of normalised address lines of a struct list
    (input to L2)."""
    keys = F.transform(items, lambda x: address_line_key(line_of(x), dtype))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))


def set_equal(g_set: Column, p_set: Column) -> Column:
    """L2: two sets (sorted distinct arrays) are equal."""
    return g_set == p_set
