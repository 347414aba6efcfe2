"""Extraction and validation queries (X1-X12, P2, P3) on the driver tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import extract, validate
from .common import table

SQL = {}
CLASSES = extract.PII_PATTERNS


# --- X12, P2, P3 ------------------------------------------------------------------

def extract_patterns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = docs.select(F.col("text"), *extract.pattern_hits(F.col("text"), CLASSES))
    aggs = []
    for name in CLASSES:
        aggs += [F.count(F.when(F.size(name) > 0, 1)).alias(f"{name}_docs"),
                 F.sum(F.size(name)).cast("long").alias(f"{name}_hits"),
                 F.min(F.get(F.col(name), 0)).alias(f"{name}_first")]
    aggs.append(F.count(F.when(F.col("text").rlike(CLASSES["EMAIL"]), 1)).alias("contains_docs"))   # P2, P3
    wide = hits.agg(*aggs)
    rows = [F.struct(F.lit(n).alias("class"), F.col(f"{n}_docs").alias("n_docs"),
                     F.col(f"{n}_hits").alias("n_hits"), F.col(f"{n}_first").alias("first_hit")) for n in CLASSES]
    rows.append(F.struct(F.lit("contains_email").alias("class"), F.col("contains_docs").alias("n_docs"),
                         F.lit(None).cast("long").alias("n_hits"), F.lit(None).cast("string").alias("first_hit")))
    return wide.select(F.inline(F.array(*rows)))


SQL["extract_patterns"] = " UNION ALL ".join(
    f"SELECT '{n}' AS class, count(*) FILTER (WHERE len(regexp_extract_all(text, '{p}')) > 0)::BIGINT AS n_docs, "
    f"sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS n_hits, "
    f"min(regexp_extract_all(text, '{p}')[1]) AS first_hit FROM documents" for n, p in CLASSES.items()) + \
    f" UNION ALL SELECT 'contains_email', count(*) FILTER (WHERE regexp_matches(text, '{CLASSES['EMAIL']}'))::BIGINT, " \
    "NULL::BIGINT, NULL::VARCHAR FROM documents"


# --- X1-X6 ----------------------------------------------------------------------

_EMAIL = re.compile(CLASSES["EMAIL"])
_IPV4 = re.compile(CLASSES["IPV4"])


def _first(rx, text):
    m = rx.search(text)
    return m.group(0) if m else None


def primary_fn(text: str, attempt: int = 0) -> dict:
    """Stand-in model: first e-mail and IPv4; unavailable for texts whose
    length is a multiple of 10; a transient failure on the first attempt for
    lengths divisible by 7 (absorbed by the retry policy)."""
    if len(text) % 10 == 0:
        raise RuntimeError("primary unavailable")
    if len(text) % 7 == 0 and attempt == 0:
        raise TimeoutError("transient")
    return {"EMAIL": _first(_EMAIL, text), "IPV4": _first(_IPV4, text)}


def secondary_fn(text: str) -> dict:
    if len(text) % 20 == 0:
        raise ValueError("secondary unavailable")
    return {"EMAIL": _first(_EMAIL, text), "IPV4": _first(_IPV4, text)}


def extract_structured(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    schema = T.StructType([T.StructField("EMAIL", T.StringType()), T.StructField("IPV4", T.StringType())])
    out = extract.extract_structured(docs, "text", "doc_id", schema, [primary_fn, secondary_fn],
                                     concurrency=4, retry=extract.CONSTANT, strategy="fallback",
                                     sleep=lambda s: None)
    return out.select("doc_id", F.col("result.EMAIL").alias("email"), F.col("result.IPV4").alias("ipv4"),
                      "error", "fn_index")


SQL["extract_structured"] = f"""
SELECT doc_id,
  CASE WHEN length(text) % 20 <> 0 THEN nullif(regexp_extract(text, '{CLASSES['EMAIL']}'), '') END AS email,
  CASE WHEN length(text) % 20 <> 0 THEN nullif(regexp_extract(text, '{CLASSES['IPV4']}'), '') END AS ipv4,
  CASE WHEN length(text) % 20 = 0 THEN 'ValueError: secondary unavailable' END AS error,
  (CASE WHEN length(text) % 20 = 0 THEN NULL WHEN length(text) % 10 = 0 THEN 1 ELSE 0 END)::INT AS fn_index
FROM documents"""


# --- X7 --------------------------------------------------------------------------

INSTRUCTIONS = "Find the personal data named in the schema in the text below and return each value as written."
OUTPUT_FORMAT = "Answer in JSON using this schema: {EMAIL: string or null, IPV4: string or null}"


def prompt_text(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    p = extract.prompt_text(F.col("text"), INSTRUCTIONS, OUTPUT_FORMAT)
    return conv.select("conv_id", "turn", "role", F.length(p).alias("prompt_chars"), F.md5(p).alias("prompt_md5"))


SQL["prompt_text"] = f"""
WITH t AS (SELECT conv_id, turn, role,
                  concat_ws(chr(10) || chr(10), '{INSTRUCTIONS}', '{OUTPUT_FORMAT}', text) AS p FROM conversations)
SELECT conv_id, turn, role, length(p)::INT AS prompt_chars, md5(p) AS prompt_md5 FROM t"""


# --- X8, X9, X10 --------------------------------------------------------------------

ALLOWED_TYPES = ["view", "click", "purchase", "signup"]


def schema_violations(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 50 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    parsed = validate.parse_typed(raw, T.StructType([T.StructField("k", T.StringType())]))
    ev = ev.withColumn("_p", parsed)
    checks = {
        "json_parse": F.col("_p").getField(validate.CORRUPT).isNull(),
        "type_allowed": validate.allowed(F.col("event_type"), ALLOWED_TYPES),
        "value_range": validate.in_range(F.col("value"), 0, 400),
        "user_required": validate.required(F.col("user_id")),
        "type_min_length": validate.min_length(F.col("event_type"), 1),
        "k_integer": validate.is_integer(F.col("_p.k")),
    }
    errors = validate.violations(ev, "event_id", checks).withColumn("severity", F.lit("error"))
    cust = table(spark, sf_dir, "customer")
    warn = validate.violations(cust.withColumnRenamed("c_custkey", "event_id"), "event_id",
                               {"name_pattern": validate.matches(F.col("c_name"), r"^Customer#[0-9]{9}$")}) \
        .withColumn("severity", F.lit("warning"))
    return errors.unionByName(warn).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n_violations"))


SQL["schema_violations"] = r"""
WITH e AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN substr(props, 1, 5) ELSE props END AS raw FROM events),
v AS (
  SELECT 'json_parse' AS rule, 'error' AS severity FROM e WHERE NOT json_valid(raw)
  UNION ALL SELECT 'type_allowed', 'error' FROM e WHERE event_type IS NOT NULL AND event_type NOT IN ('view', 'click', 'purchase', 'signup')
  UNION ALL SELECT 'value_range', 'error' FROM e WHERE value IS NOT NULL AND NOT (value >= 0 AND value <= 400)
  UNION ALL SELECT 'user_required', 'error' FROM e WHERE user_id IS NULL
  UNION ALL SELECT 'type_min_length', 'error' FROM e WHERE event_type IS NOT NULL AND length(event_type) < 1
  UNION ALL SELECT 'k_integer', 'error' FROM e WHERE json_valid(raw) AND json_extract_string(raw, '$.k') IS NOT NULL
                                          AND NOT regexp_full_match(json_extract_string(raw, '$.k'), '\s*[+-]?[0-9]+\s*')
  UNION ALL SELECT 'name_pattern', 'warning' FROM customer WHERE c_name IS NOT NULL AND NOT regexp_full_match(c_name, 'Customer#[0-9]{9}'))
SELECT rule, severity, count(*)::BIGINT AS n_violations FROM v GROUP BY rule, severity"""


# --- X11 ---------------------------------------------------------------------------

ASSERTIONS_SQL = {
    "value_nonneg": "value >= 0",
    "type_known": "event_type IN ('view', 'click', 'purchase', 'signup', 'error')",
    "props_has_k": "json_extract(props, '$.k') IS NOT NULL",
    "user_in_range": "user_id < 100",
    "value_small": "value < 50",
}


def assertions(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    checks = {
        "value_nonneg": F.col("value") >= 0,
        "type_known": F.col("event_type").isin("view", "click", "purchase", "signup", "error"),
        "props_has_k": F.get_json_object("props", "$.k").isNotNull(),
        "user_in_range": F.col("user_id") < 100,
        "value_small": F.col("value") < 50,
    }
    return validate.check_assertions(ev, checks)


SQL["assertions"] = " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) FILTER (WHERE coalesce({c}, false))::BIGINT AS n_pass, "
    f"count(*) FILTER (WHERE NOT coalesce({c}, false))::BIGINT AS n_fail FROM events"
    for n, c in ASSERTIONS_SQL.items())
