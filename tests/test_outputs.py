"""Validation by path, indexed assertions, stored keys, gold built once, observed bounds."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldtally.operators import extract, keys, paths, typed, validate
from goldtally.sources import io

SHAPE = "a bigint, b struct<c:string,d:array<bigint>>, e array<struct<f:boolean>>, g date, h double"


def _parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, raw string")
    out = df.select("k", typed.parse_by_path(F.col("raw"), SHAPE).alias("r")).orderBy("k").collect()
    return [(r["r"]["value"], [tuple(x) for x in r["r"]["failures"]]) for r in out]


def test_failures_name_path_expected_and_found(spark):
    got = _parsed(spark, [
        '{"a":1,"b":{"c":"x","d":[1,"2",3.5,null]},"e":[{"f":true},{"f":"no"},7]}',
        '{"a":"1","b":[],"e":{}}', None, "{bad", "{}", "[1]", "",
        '{"a":99999999999999999999}', '{"g":"2020-02-30","h":12.5,"extra":{"a":1}}', '{"g":"2020-02-29","h":1,"e":[]}'])
    assert got[0][1] == [("b.d[1]", "bigint", "STRING"), ("b.d[2]", "bigint", "DECIMAL"),
                         ("e[1].f", "boolean", "STRING"), ("e[2]", "object", "BIGINT")]
    assert got[0][0]["b"]["d"] == [1, None, None, None] and got[0][0]["e"][0]["f"] is True
    assert got[1][1] == [("a", "bigint", "STRING"), ("b", "object", "ARRAY"), ("e", "array", "OBJECT")]
    assert got[2] == (None, []) and got[3] == (None, [("$", "JSON", "malformed")])
    assert got[4][1] == [] and got[5] == (None, [("$", "object", "ARRAY")])
    assert got[6] == (None, [("$", "JSON", "malformed")])
    assert got[7][1] == [("a", "bigint", "DECIMAL")]
    assert got[8][1] == [("g", "date", "STRING")] and got[8][0]["h"] == 12.5
    assert got[9][1] == [] and str(got[9][0]["g"]) == "2020-02-29" and got[9][0]["e"] == [] and got[9][0]["h"] == 1.0


def _expect(value, kind, path):
    """Failures in plain Python, for whole numbers, texts, lists and objects."""
    if value is None:
        return []
    if isinstance(kind, dict):
        if not isinstance(value, dict):
            return [(path or "$", "object")]
        return [f for n, t in kind.items() for f in _expect(value.get(n), t, f"{path}.{n}" if path else n)]
    if isinstance(kind, list):
        if not isinstance(value, list):
            return [(path, "array")]
        return [f for i, v in enumerate(value) for f in _expect(v, kind[0], f"{path}[{i}]")]
    good = isinstance(value, int) and not isinstance(value, bool) if kind == "bigint" else isinstance(value, str)
    return [] if good else [(path, kind)]


def test_against_a_walk_in_python(spark):
    rng = random.Random(5)

    def value(depth):
        pick = rng.randrange(8 if depth else 5)
        if pick < 5:
            return [None, rng.randrange(100), "t\"}", True, "12"][pick]
        if pick == 5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {n: value(depth - 1) for n in "xyz" if rng.random() < .8}

    kind = {"x": "bigint", "y": ["string"], "z": {"x": ["bigint"], "y": [{"x": "string", "z": "bigint"}]}}
    shape = "x bigint, y array<string>, z struct<x:array<bigint>, y:array<struct<x:string,z:bigint>>>"
    records = [value(4) for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "k long, raw string")
    out = df.select("k", typed.parse_by_path(F.col("raw"), shape)["failures"].alias("f")).collect()
    for r in out:
        assert [(f["path"], f["expected"]) for f in r["f"]] == _expect(records[r["k"]], kind, ""), records[r["k"]]


def test_types_that_json_has_not_are_refused():
    with pytest.raises(ValueError):
        typed.parse_by_path(F.lit("{}"), "a binary")


def test_indexed_paths(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, array(named_struct('b', 'x', 'c', array(1, 2)), named_struct('b', NULL, 'c', NULL))),
                      (2, array()), (3, NULL) AS t(k, a)""")
    df = df.withColumn("a", F.col("a").cast("array<struct<b:string,c:array<int>>>"))
    checks = {"first": paths.equals("a[0].b", "x"), "nested": paths.one_of("a[0].c[1]", [2, 3]), "beyond": paths.equals("a[0].c[9]", 1),
              "none": paths.is_none("a[1].b"), "absent_none": paths.is_none("a[7].b"), "absent_element": paths.is_none("a[7]"),
              "two": paths.length_is("a", 2), "whole_none": paths.is_none("a")}
    got = {r["name"]: (r["n_pass"], r["n_fail"]) for r in validate.check_assertions(df, checks).collect()}
    assert got == {"first": (1, 2), "nested": (1, 2), "beyond": (0, 3), "none": (1, 2), "absent_none": (0, 3),
                   "absent_element": (0, 3), "two": (1, 2), "whole_none": (1, 2)}
    for bad in ["", "[0].a", "a[-1]", "a..b", "a[0]b", "a[x]"]:
        with pytest.raises(ValueError):
            paths.at_path(bad)


def _data_files(df):
    return {Path(f).name for f in df.inputFiles()}


def test_slices_and_fetches_read_only_their_files(spark, tmp_path):
    rows = spark.range(1, 1001).select(F.col("id").alias("record_id"), (F.col("id") * 2).alias("v"))
    rows = rows.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS record_id, 0L AS v"))
    path = str(tmp_path / "stored")
    keys.store_by_key(rows.repartition(3), path, num_partitions=10)
    everything = _data_files(spark.read.parquet(path))
    one = keys.read_slice(spark, path, 11, 60)
    assert sorted(r["record_id"] for r in one.collect()) == list(range(11, 61))
    assert len(everything) == 10 and len(_data_files(one)) <= 2
    got = keys.read_records_by_key(spark, path, [5, 999, 4000])
    assert sorted(r["record_id"] for r in got.collect()) == [5, 999] and len(_data_files(got)) <= 2
    assert keys.read_slice(spark, path, 990).count() == 11 and keys.read_slice(spark, path, 2000).count() == 0
    assert keys.read_records_by_key(spark, path, []).count() == 0 and spark.read.parquet(path).count() == 1001


def test_a_hot_key_is_split_over_files(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("record_id"), "id")
    path = str(tmp_path / "stored")
    keys.store_by_key(rows, path, num_partitions=12)
    stored = spark.read.parquet(path).withColumn("f", F.col("_metadata.file_path"))
    assert stored.groupBy("f").count().agg(F.max("count")).first()[0] < 700
    assert keys.read_records_by_key(spark, path, 7).count() == rows.where("record_id = 7").count()


def test_gold_is_whole_or_absent(spark, tmp_path):
    path = tmp_path / "gold"
    broken = spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("half-way")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="half-way"):
        io.materialize_gold(broken, str(path))
    assert not path.exists() and list(tmp_path.iterdir()) == []
    assert io.materialize_gold(spark.range(5), str(path)) is True
    before = {f.name: f.stat().st_mtime_ns for f in path.iterdir()}
    assert io.materialize_gold(spark.range(9), str(path)) is False
    assert {f.name: f.stat().st_mtime_ns for f in path.iterdir()} == before
    with pytest.raises(Exception, match="half-way"):
        io.materialize_gold(broken, str(path), refresh=True)
    assert spark.read.schema("id long").json(str(path)).count() == 5
    assert io.materialize_gold(spark.range(9), str(path), refresh=True, fmt="parquet") is True
    assert spark.read.parquet(str(path)).count() == 9 and [f.name for f in tmp_path.iterdir()] == ["gold"]


def test_gold_without_its_mark_is_replaced(spark, tmp_path):
    path = tmp_path / "gold"
    spark.range(3).write.json(str(path))
    (path / "_SUCCESS").unlink()
    assert io.materialize_gold(spark.range(4), str(path)) is True
    assert spark.read.schema("id long").json(str(path)).count() == 4


def test_calls_in_flight_are_observed(spark):
    import time

    def slow(text):
        time.sleep(.02)
        if text.endswith("7"):
            raise ValueError("no")
        return {"n": text}

    docs = spark.range(60).repartition(3).select("id", F.concat(F.lit("t"), "id").alias("text"))
    for bound in (1, 4):
        seen = Observation()
        out = extract.extract_structured(docs, "text", "id", T.StructType([T.StructField("n", T.StringType())]), slow, concurrency=bound, observe=seen)
        assert out.columns == ["id", "result", "error", "fn_index"] and len(out.collect()) == 60
        got = seen.get
        assert got["n_rows"] == 60 and got["n_errors"] == 6
        assert got["peak_in_task"] == 1 if bound == 1 else 2 <= got["peak_in_task"] <= bound
