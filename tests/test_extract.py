"""Extraction job: error rows, fail-fast, retry, fallback, round-robin."""

import pytest
from pyspark.sql import types as T

from goldtally.operators import extract

SCHEMA = T.StructType([T.StructField("n", T.StringType())])


def _docs(spark):
    return spark.createDataFrame([(i, f"text {i}") for i in range(1, 7)], "k long, text string")


def _fns():
    # defined in a function so the workers receive them by value
    def a(text):
        if text.endswith("3"):
            raise ValueError("bad")
        return {"n": "a:" + text}

    def b(text):
        return {"n": "b:" + text}
    return a, b


a, b = _fns()


def test_error_rows_keep_key(spark):
    out = extract.extract_structured(_docs(spark), "text", "k", SCHEMA, a).collect()
    rows = {r["k"]: r for r in out}
    assert rows[3]["result"] is None and rows[3]["error"] == "ValueError: bad"
    assert rows[1]["result"]["n"] == "a:text 1" and rows[1]["fn_index"] == 0


def test_fail_fast(spark):
    with pytest.raises(Exception):
        extract.extract_structured(_docs(spark), "text", "k", SCHEMA, a, on_error="raise").collect()


def test_fallback_and_round_robin(spark):
    fb = {r["k"]: r for r in extract.extract_structured(_docs(spark), "text", "k", SCHEMA, [a, b]).collect()}
    assert fb[3]["result"]["n"] == "b:text 3" and fb[3]["fn_index"] == 1 and fb[2]["fn_index"] == 0
    rr = {r["k"]: r for r in extract.extract_structured(_docs(spark), "text", "k", SCHEMA, [a, b],
                                                          strategy="round_robin").collect()}
    assert rr[2]["result"]["n"] == "a:text 2" and rr[5]["result"]["n"] == "b:text 5"
    assert rr[3]["fn_index"] == 1 and rr[2]["fn_index"] == 0   # chosen by key modulo the count


def test_retry_delays():
    assert list(extract.CONSTANT.delays()) == [200, 200, 200]
    assert list(extract.EXPONENTIAL.delays()) == [300, 450]
    calls, slept = [], []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise TimeoutError("later")
        return {"n": text}

    res, err, idx = extract._run_one([flaky], 1, "t", "fallback", extract.CONSTANT, slept.append, 0)
    assert res == {"n": "t"} and err is None and slept == [0.2, 0.2]


def test_round_robin_takes_text_and_null_keys(spark):
    docs = spark.createDataFrame([("x", "text 1"), ("y", "text 2"), (None, "text 4")], "k string, text string")
    out = extract.extract_structured(docs, "text", "k", SCHEMA, [a, b], strategy="round_robin").collect()
    assert len(out) == 3 and all(r["error"] is None for r in out)
    assert {r["k"]: r["fn_index"] for r in out}[None] == 0


def test_functions_may_take_the_attempt_number(spark):
    def make():
        def shaky(text, attempt=0):
            if attempt < 2:
                raise TimeoutError("busy")
            return {"n": str(attempt)}
        return shaky
    out = extract.extract_structured(_docs(spark), "text", "k", SCHEMA, make(), retry=extract.CONSTANT, sleep=lambda s: None)
    assert {r["result"]["n"] for r in out.collect()} == {"2"}


def test_long_keys_pass_unchanged(spark):
    keys = [2**53 + 1, 2**53 + 3, None]
    df = spark.createDataFrame([(k, "x") for k in keys], "k long, text string")
    out = extract.extract_structured(df, "text", "k", SCHEMA, b).collect()
    assert sorted((r["k"] for r in out), key=str) == sorted(keys, key=str)
    df = spark.createDataFrame([(float("inf"), "x"), (float("nan"), "y"), (None, "z")], "k double, text string")
    out = extract.extract_structured(df, "text", "k", SCHEMA, [a, b], strategy="round_robin").collect()
    assert len(out) == 3 and all(r["error"] is None for r in out)


def _local_attempt():
    def fn(text):
        attempt = text.upper()
        return {"n": attempt}

    def numbered(text, attempt):
        if attempt < 2:
            raise ValueError("again")
        return {"n": str(attempt)}

    def no_dict(text):
        return "text"

    def wrong_type(text):
        return {"n": {"deep": [1]}}
    return fn, numbered, no_dict, wrong_type


def test_attempt_is_a_parameter_not_a_local(spark):
    fn, numbered, no_dict, wrong_type = _local_attempt()
    one = _docs(spark).limit(1)
    assert extract.extract_structured(one, "text", "k", SCHEMA, fn).collect()[0]["result"]["n"].startswith("TEXT")
    retry = extract.Retry(max_retries=2, delay_ms=1)
    assert extract.extract_structured(one, "text", "k", SCHEMA, numbered, retry=retry).collect()[0]["result"]["n"] == "2"
    row = extract.extract_structured(one, "text", "k", SCHEMA, no_dict).collect()[0]
    assert row["result"] is None and row["error"] == "TypeError: extraction returned str, not a dict"
    row = extract.extract_structured(one, "text", "k", SCHEMA, wrong_type).collect()[0]
    assert row["result"] is None and row["error"]
