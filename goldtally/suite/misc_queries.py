"""Leaderboards (P11, A7-A9), keys (K1-K4, K7), reshaping (P1-P12),
sources (S1-S10) and the display-name rule (F11) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fhir, keys, match, score, shape
from ..session import scratch_path
from ..sources import io, json_array
from . import sqlfrag as S
from .common import table

SQL = {}
METHODS = ["method_a", "method_b", "method_c"]


def _cents_avg(cond):
    """Mean of ``value`` over rows matching ``cond``, from integer cents, so
    both engines divide the same exact integers."""
    cents = F.round(F.col("value") * 100).cast("long")
    return (F.sum(F.when(cond, cents)).cast("double") / F.count(F.when(cond, 1)).cast("double")) / 100.0


def _wide_scores(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    g = F.col("user_id") % 3
    return ev.groupBy(F.col("event_type").alias("dataset"),
                      F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("model")).agg(
        *[_cents_avg(g == i).alias(m) for i, m in enumerate(METHODS)])


_SQL_WIDE = """
wide AS (SELECT event_type AS dataset, 'u' || (user_id % 5)::VARCHAR AS model,
  """ + ",\n  ".join(
    f"(sum(round(value * 100)::BIGINT) FILTER (WHERE user_id % 3 = {i}))::DOUBLE / "
    f"(count(*) FILTER (WHERE user_id % 3 = {i}))::DOUBLE / 100.0 AS {m}"
    for i, m in enumerate(METHODS)) + """
  FROM events GROUP BY ALL)"""


def scores_minmax(spark, sf_dir):
    long = score.scores_long(_wide_scores(spark, sf_dir), ["dataset", "model"], METHODS)
    return score.minmax_per(long, "dataset")


SQL["scores_minmax"] = f"""WITH {_SQL_WIDE},
long AS (UNPIVOT wide ON {', '.join(METHODS)} INTO NAME method VALUE score)
SELECT dataset, min(score) AS min_score, max(score) AS max_score FROM long GROUP BY dataset"""


def best_row(spark, sf_dir):
    return score.best_row(_wide_scores(spark, sf_dir), "dataset", METHODS)


SQL["best_row"] = f"""WITH {_SQL_WIDE}
SELECT dataset, model, {', '.join(METHODS)} FROM wide
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY greatest({', '.join(METHODS)}) DESC NULLS LAST,
                           model DESC, {', '.join(m + ' DESC NULLS LAST' for m in METHODS)}) = 1"""


def methods_pivot(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    method = F.element_at(F.array(*[F.lit(m) for m in METHODS]), (F.col("user_id") % 3 + 1).cast("int"))
    cents = F.round(F.col("value") * 100).cast("long")
    cells = ev.groupBy(F.col("event_type").alias("model"), method.alias("method")).agg(
        ((F.sum(cents).cast("double") / F.count(F.lit(1)).cast("double")) / 100.0).alias("score"),
        F.max((F.col("value") > 300).cast("int")).alias("failed"))
    return score.methods_table(cells, "model", "method", "score", "failed", METHODS)


SQL["methods_pivot"] = """
WITH cells AS (SELECT event_type AS model, user_id % 3 AS g,
                      sum(round(value * 100)::BIGINT)::DOUBLE / count(*)::DOUBLE / 100.0 AS score,
                      max((value > 300)::INT) AS failed
               FROM events GROUP BY ALL)
SELECT model, """ + ",\n       ".join(
    f"max(CASE WHEN g = {i} AND failed = 0 THEN score END) AS {m}, "
    f"max(CASE WHEN g = {i} THEN failed = 1 END) AS {m}_failed" for i, m in enumerate(METHODS)) + """
FROM cells GROUP BY model"""


# --- K1 K2 K3 K4 K7 -------------------------------------------------------------

def record_id_slice(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    indexed = keys.with_record_id(cust, ["c_name", "c_custkey"], name="position")
    gold = keys.default_key(indexed, "position")           # gold has no key of its own
    return keys.slice_records(gold, 11, 60).select("record_id", "c_custkey", "c_name")


SQL["record_id_slice"] = """
SELECT record_id, c_custkey, c_name FROM (
  SELECT row_number() OVER (ORDER BY c_name, c_custkey) AS record_id, c_custkey, c_name FROM customer)
WHERE record_id BETWEEN 11 AND 60"""


def row_index(spark, sf_dir):
    """K1 over all columns of orders: every row with its position."""
    return keys.with_record_id(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"])


SQL["row_index"] = "SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS record_id FROM orders"


# --- P1-P12 -------------------------------------------------------------------------

def reshape(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    item_t = T.StructType([T.StructField("bal", T.DoubleType()), T.StructField("seg", T.StringType())])
    items = F.array(F.struct(F.when(k % 4 != 0, F.col("c_acctbal")).alias("bal"),
                             F.when(k % 4 != 0, F.col("c_mktsegment")).alias("seg")))
    rec = F.struct(F.col("c_name").alias("name"),
                   F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("info"))
    nested_df = cust.select(
        shape.put_key(rec, k).alias("patient"),                                        # P7
        shape.null_if_all_null(items, item_t).alias("items"),                          # P8
        shape.empty_to_null(F.when(k % 3 == 0, F.array().cast("array<string>"))
                            .otherwise(F.array("c_mktsegment"))).alias("tags"),        # P10
        shape.typed_null("bigint").alias("age"))                                       # P12
    flat = shape.flatten_struct(nested_df)                                             # P6
    return flat.select(                                                                # P1 / P5
        "`patient.record_id`", "`patient.name`", "`patient.info.nation`", "`patient.info.segment`",
        F.col("items").isNull().alias("items_is_null"), F.size("tags").alias("tags_size"), "age")


SQL["reshape"] = """
SELECT c_custkey AS "patient.record_id", c_name AS "patient.name", c_nationkey AS "patient.info.nation",
       c_mktsegment AS "patient.info.segment", (c_custkey % 4 = 0) AS items_is_null,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1 END AS tags_size, NULL::BIGINT AS age
FROM customer"""


# --- S8 ----------------------------------------------------------------------------

def py_literal(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("{'k': "), k, F.lit(", 'x': None, 'type': '"), F.col("event_type"), F.lit("'}")))
    parsed = io.parse_py_literal(text, "k BIGINT, x STRING, type STRING")
    return ev.select("event_id", parsed["k"].alias("k"), parsed["x"].alias("x"), parsed["type"].alias("type"))


SQL["py_literal"] = """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS k,
       NULL::VARCHAR AS x, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS type FROM events"""


# --- S1-S7, S9, S10 ----------------------------------------------------------------

def ndjson_roundtrip(spark, sf_dir):
    ev = io.read_records(spark, f"{sf_dir.rstrip('/')}/events.parquet", ["event_id", "event_type", "props"])
    base = scratch_path(spark, "roundtrip")
    schema = "event_id BIGINT, event_type STRING, props STRING"
    io.write_ndjson(ev, f"{base}/ndjson")                                   # S5
    io.materialize_gold(ev, f"{base}/gold", refresh=False)                  # S9 (ignore)
    io.materialize_gold(ev, f"{base}/gold", refresh=True)                   # S9 (overwrite)
    io.write_parquet(ev, f"{base}/parquet")                                 # S7
    io.write_csv(ev, f"{base}/csv")
    parts = {
        "ndjson": io.read_ndjson(spark, f"{base}/ndjson", schema),          # S3
        "gold": io.read_ndjson(spark, f"{base}/gold", schema),
        "parquet": io.read_records(spark, f"{base}/parquet"),               # S1
        "csv": io.read_csv(spark, f"{base}/csv", schema),                   # S4
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.get_json_object("props", "$.k").cast("long")).alias("sum_k"),
                     F.count_distinct("event_type").alias("n_types")).select(F.lit(name).alias("format"), "*")
        out = one if out is None else out.unionByName(one)
    return out


SQL["ndjson_roundtrip"] = " UNION ALL ".join(
    f"SELECT '{f}' AS format, count(*)::BIGINT AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS sum_k, "
    f"count(DISTINCT event_type)::BIGINT AS n_types FROM events" for f in ["ndjson", "gold", "parquet", "csv"])


# --- S3 with K5: the position of a line in its files ------------------------------

def _prediction_files(spark, sf_dir):
    """Three versions of predictions over orders as JSON lines, each key twice in
    a file and in several versions; read back with the place of each line."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").alias("amount"))
    base, paths = scratch_path(spark, "prediction-files"), []
    for version in range(3):
        twice = orders.where(F.col("record_id") % (version + 2) != 0).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
        rows = twice.select("record_id", "amount", F.concat_ws("-", F.lit(version), "copy").alias("note"), "copy")
        paths.append(f"{base}/{version}")
        io.write_ndjson(rows.repartitionByRange("record_id").sortWithinPartitions("copy", "record_id").drop("copy"), paths[-1])
    return io.read_ndjson(spark, paths, "record_id BIGINT, amount DOUBLE, note STRING", position="seq")


def prediction_files(spark, sf_dir):
    return match.prepare_predictions(_prediction_files(spark, sf_dir)).select("record_id", "amount", "note")


SQL["prediction_files"] = """
SELECT o_orderkey AS record_id, any_value(o_totalprice) AS amount, max(v) || '-1' AS note
FROM (SELECT o_orderkey, o_totalprice, unnest([0, 1, 2]) AS v FROM orders) WHERE o_orderkey % (v + 2) <> 0 GROUP BY o_orderkey"""


def line_numbers(spark, sf_dir):
    lines = io.number_lines(_prediction_files(spark, sf_dir))
    version = F.substring("note", 1, 1).cast("int").alias("version")
    # numbers met, exactly, as bits of one word for every 64 numbers: dense numbers give a small map per task
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("line").bitwiseAND(63).cast("int"))
    words = lines.groupBy(version, F.col("seq.file").alias("file"), F.shiftright("line", 6).alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line").alias("first"), F.max("line").alias("last"), F.bit_or(bit).alias("bits"))
    files = words.groupBy("version", "file").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
                                                 F.sum(F.bit_count("bits")).alias("distinct"))
    return files.groupBy("version").agg(F.sum("n").alias("n_lines"), F.max("first").alias("first_line"), F.sum("last").alias("last_lines"),
                                        F.sum("distinct").alias("n_numbers"))


SQL["line_numbers"] = """
SELECT v::INT AS version, 2 * count(*) AS n_lines, 1::BIGINT AS first_line, 2 * count(*) AS last_lines, 2 * count(*) AS n_numbers
FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS v FROM orders) WHERE o_orderkey % (v + 2) <> 0 GROUP BY v"""


# --- S2: JSON array files, read by many tasks --------------------------------------

# braces, brackets, quotes and backslashes inside strings, where an array must not be cut
_NOTE = 'a } b {"c": [1, 2]} \\\\ "}'


def json_array_files(spark, sf_dir):
    """Array files of at most 1,000 orders each, written by Spark, then scanned by blocks."""
    orders = table(spark, sf_dir, "orders")
    record = F.struct(F.col("o_orderkey").alias("record_id"), F.struct(F.col("o_totalprice").alias("amount"), F.concat(F.lit(_NOTE), "o_orderstatus").alias("note")).alias("detail"),
                      F.when(F.col("o_orderkey") % 3 == 0, F.array(F.col("o_custkey"))).alias("keys"))
    arrays = orders.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("part")).agg(F.to_json(F.array_sort(F.collect_list(record))).alias("value"))
    path = scratch_path(spark, "arrays")
    arrays.repartition("part").write.partitionBy("part").text(path)
    read = json_array.scan_json_array(spark, f"{path}/*/", "record_id BIGINT, detail STRUCT<amount: DOUBLE, note: STRING>, keys ARRAY<BIGINT>")
    return read.select("record_id", "detail.amount", "detail.note", F.get("keys", F.lit(0)).alias("first_key"))


SQL["json_array_files"] = f"""
SELECT o_orderkey AS record_id, o_totalprice AS amount, '{_NOTE}' || o_orderstatus AS note, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS first_key FROM orders"""


# --- F11 ------------------------------------------------------------------------

def display_name(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    disp = (F.when(k % 4 == 0, F.concat(F.lit("Dr. "), F.col("p_name")))
            .when(k % 4 == 1, F.col("p_name"))
            .when(k % 4 == 2, F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")))
            .otherwise(F.lit(" ")))
    names = fhir.display_name(disp)
    n = F.get(names, 0)
    return part.select(k, disp.alias("display"), F.get(n["prefix"], 0).alias("prefix"),
                       F.array_join(n["given"], " ").alias("given"), n["family"].alias("family"),
                       F.size(names).alias("n_names"))


SQL["display_name"] = r"""
WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Dr. ' || p_name WHEN 1 THEN p_name
                                 WHEN 2 THEN '  ' || p_brand || ' ' ELSE ' ' END AS display FROM part),
s AS (SELECT *, list_filter(string_split_regex(trim(display), '\s+'), lambda x: x <> '') AS parts FROM t),
r AS (SELECT *, len(parts) > 0 AND suffix(parts[1], '.') AS has_prefix FROM s),
q AS (SELECT *, CASE WHEN has_prefix THEN parts[2:] ELSE parts END AS rest FROM r)
SELECT p_partkey, display, CASE WHEN has_prefix THEN parts[1] END AS prefix,
       CASE WHEN len(parts) = 0 THEN NULL WHEN len(rest) > 1 THEN array_to_string(rest[1:len(rest) - 1], ' ') ELSE '' END AS given,
       CASE WHEN len(rest) > 0 THEN rest[len(rest)] END AS family,
       CASE WHEN len(parts) > 0 THEN 1 ELSE 0 END AS n_names
FROM q"""
