"""Rule case tables (hand-derived from the comparison semantics)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldtally.functions import rules as R


def _eval(spark, rule, cases, gtype="string", ptype="string"):
    df = spark.createDataFrame([(g, p) for g, p, _ in cases], f"g {gtype}, p {ptype}")
    gt, pt = df.schema["g"].dataType, df.schema["p"].dataType
    return [r[0] for r in df.select(rule(F.col("g"), F.col("p"), gt, pt)).collect()]


def test_text_rule(spark):
    cases = [
        ("Hello, World", "hello world", True),
        ("  CLM-001 ", "clm001", True),
        ("Single_Family_Home", "Single Family Home", False),   # '_' survives
        ("Rodríguez", "RODRÍGUEZ!", True),                     # Unicode letters kept
        ("a\tb", "ab", False),                                  # only U+0020 is removed
        (None, None, True),
        ("x", None, False),
    ]
    assert _eval(spark, R.text_rule, cases) == [c[2] for c in cases]


def test_enum_rule(spark):
    cases = [("In-Person", "in person", True), ("rear_end_collision", "Rear_End_Collision", True),
             ("Rear-End  Collision", "rear_end_collision", True), ("Phone", "Email", False), (None, None, True)]
    assert _eval(spark, R.enum_rule, cases) == [c[2] for c in cases]


def test_number_rule(spark):
    cases = [("17", "17.0", True), ("17", " 17 ", True), ("1e3", "1000", True), ("17", "17d", False),
             ("n/a", "n/a", True), ("nan", "nan", False), ("17", None, False)]
    assert _eval(spark, R.number_rule, cases) == [c[2] for c in cases]


def test_number_rule_numeric_types(spark):
    cases = [(15265, 15265.0, True), (1, 2.0, False)]
    assert _eval(spark, R.number_rule, cases, "bigint", "double") == [c[2] for c in cases]


def test_state_rule(spark):
    cases = [("MA", "Massachusetts", True), ("massachusetts ", "ma", True), ("Ontario", "ontario", True),
             ("  ", "", True), ("NY", "NJ", False), (None, None, True), ("MA", None, False)]
    assert _eval(spark, R.state_rule, cases) == [c[2] for c in cases]


def test_birthdate_rule(spark):
    cases = [("1988-11-12", "November 12, 1988", True), ("1988-11-12", "Nov 12, 1988", True),
             ("1988-11-12", "11/12/1988", True), ("1988-12-11", "11/12/1988", False),   # month first wins
             ("1988-11-13", "13/11/1988", True), ("1988-11-12", "November  12,  1988", True),
             ("1988-11-12T00:00:00Z", "1988-11-12", True), ("1988-11-12", "12 Nov 1988", False)]
    assert _eval(spark, R.birthdate_rule, cases) == [c[2] for c in cases]


def test_list_rules(spark):
    df = spark.createDataFrame([(["Main St"], " main st", ["A", "B"], ["A", "B"]),
                                (["a", "b"], "a", ["A"], ["a"])], "l array<string>, s string, x array<string>, y array<string>")
    got = df.select(R.list_vs_text_rule(F.col("l"), F.col("s")), R.list_rule(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False)]


def test_set_overlap_in_row(spark):
    df = spark.createDataFrame([([], None), (None, ["x"]), (["a", "a", "b"], ["a", "c"]), (["a"], [])],
                               "g array<string>, p array<string>")
    got = [tuple(r[0]) for r in df.select(R.set_overlap(F.col("g"), F.col("p"))).collect()]
    assert got == [(1, 1), (0, 0), (1, 2), (0, 1)]


def test_trim_matches_python_strip(spark):
    samples = ["　 x  ", "\x1cy\x85", " z\t\n"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r[0] for r in df.select(R.trim_ws(F.col("s"))).collect()] == [s.strip() for s in samples]


def test_number_rule_python_spellings(spark):
    cases = [("1_000", "1000", True), ("inf", "Infinity", True), ("-inf", "inf", False), ("1__0", "10", False)]
    assert _eval(spark, R.number_rule, cases) == [c[2] for c in cases]
