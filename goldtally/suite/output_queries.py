"""Model output as it arrives: types by path (X8), the insurance schema
(X9, X10), indexed assertions (X11), bounded extraction (X2, X4, X6), slices
and fetches of stored records (K2, K7, S10), nested counts (L4), and the seven
lists of the financial task (T2)."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import extract, keys, match, paths, score, typed, validate
from ..plans import insurance, patient
from ..plans.schemas import FINANCIAL_FIELDS, INSURANCE_ALLOWED
from ..session import scratch_path
from ..sources import io
from . import claims
from . import sqlfrag as S
from .claim_queries import SQL_CLAIMS
from .claims import LINE_ORDER
from .common import table

SQL = {}


# --- X8: claims as JSON text, some values of another type ---------------------------

ANSWER = ("header struct<claim_id:string, channel:string>, amount bigint, "
          "insured_objects array<struct<object_id:string, year:bigint, estimated_value:double>>")


def _answers(spark, sf_dir):
    """One JSON text an order.  Years are text in fourth lines, values are null or text by part, some objects
    are bare texts; headers are text (``k % 10``), channels numbers (``k % 14``), amounts fractions
    (``k % 13``), lists objects (``k % 16``), and texts cut (``k % 37``) or null (``k % 41``)."""
    k, ln, part = F.col("o_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    oid = quoted(F.concat(F.lit("OBJ-"), part.cast("string")))
    year = (F.lit(2000) + part % 25).cast("string")
    value = F.floor("l_extendedprice").cast("string")
    obj = F.when(part % 29 == 0, oid).otherwise(F.concat(
        F.lit('{"object_id": '), oid, F.lit(', "year": '), F.when(ln % 4 == 1, quoted(year)).otherwise(year), F.lit(', "estimated_value": '),
        F.when(part % 11 == 0, F.lit("null")).when(part % 11 == 1, quoted(value)).otherwise(value), F.lit("}")))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct(*LINE_ORDER, obj.alias("o")))).alias("objs"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").join(lines, "o_orderkey", "left")
    channel = F.when(k % 14 == 0, F.lit("5")).otherwise(quoted(F.col("o_orderpriority")))
    header = F.when(k % 10 == 0, F.lit('"none"')).otherwise(
        F.concat(F.lit('{"claim_id": "CLM-'), k.cast("string"), F.lit('", "channel": '), channel, F.lit("}")))
    amount = F.concat(F.floor("o_totalprice").cast("string"), F.when(k % 13 == 0, F.lit(".5")).otherwise(F.lit("")))
    objs = F.when(k % 16 == 0, F.lit("{}")).otherwise(F.concat(
        F.lit("["), F.array_join(F.transform(F.coalesce("objs", F.array()), lambda x: x["o"]), ", "), F.lit("]")))
    text = F.concat(F.lit('{"header": '), header, F.lit(', "amount": '), amount, F.lit(', "insured_objects": '), objs, F.lit("}"))
    cut = F.when(k % 41 == 0, F.lit(None)).when(k % 37 == 0, F.substring(text, 1, 30)).otherwise(text)
    return orders.select(k.alias("record_id"), cut.alias("raw"))


def claim_type_failures(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    found = answers.select("record_id", F.explode(typed.parse_by_path(F.col("raw"), ANSWER)["failures"]).alias("f"))
    return found.select("record_id", "f.path", "f.expected", "f.found")


_SQL_ANSWERS = f"""
o AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS amount FROM orders WHERE o_orderkey % 41 <> 0 AND o_orderkey % 37 <> 0),
l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS i, l_linenumber AS ln,
             l_partkey AS part, floor(l_extendedprice)::DOUBLE AS v FROM lineitem),
obj AS (SELECT l.* FROM l JOIN o USING (k) WHERE k % 16 <> 0)"""

SQL["claim_type_failures"] = f"""
WITH {_SQL_ANSWERS}
SELECT o_orderkey AS record_id, '$' AS path, 'JSON' AS expected, 'malformed' AS found FROM orders WHERE o_orderkey % 37 = 0 AND o_orderkey % 41 <> 0
UNION ALL SELECT k, 'header', 'object', 'STRING' FROM o WHERE k % 10 = 0
UNION ALL SELECT k, 'header.channel', 'string', 'BIGINT' FROM o WHERE k % 10 <> 0 AND k % 14 = 0
UNION ALL SELECT k, 'amount', 'bigint', 'DECIMAL' FROM o WHERE k % 13 = 0
UNION ALL SELECT k, 'insured_objects', 'array', 'OBJECT' FROM o WHERE k % 16 = 0
UNION ALL SELECT k, 'insured_objects[' || i || ']', 'object', 'STRING' FROM obj WHERE part % 29 = 0
UNION ALL SELECT k, 'insured_objects[' || i || '].year', 'bigint', 'STRING' FROM obj WHERE part % 29 <> 0 AND ln % 4 = 1
UNION ALL SELECT k, 'insured_objects[' || i || '].estimated_value', 'double', 'STRING' FROM obj WHERE part % 29 <> 0 AND part % 11 = 1"""


# --- X11: assertions on indexed paths of the parsed answers ---------------------------

def indexed_assertions(spark, sf_dir):
    parsed = _answers(spark, sf_dir).select(typed.parse_by_path(F.col("raw"), ANSWER)["value"].alias("v"))
    return validate.check_assertions(parsed, {
        "low": paths.equals("v.header.channel", "5-LOW"),
        "first_year": paths.one_of("v.insured_objects[0].year", range(2000, 2010)),
        "second_id": paths.equals("v.insured_objects[1].object_id", "OBJ-100"),
        "third_value_none": paths.is_none("v.insured_objects[2].estimated_value"),
        "first_none": paths.is_none("v.insured_objects[0]"),
        "four": paths.length_is("v.insured_objects", 4),
        "amount_none": paths.is_none("v.amount")})


_ASSERTIONS = {
    "low": "SELECT k FROM o JOIN orders ON o_orderkey = k WHERE k % 10 <> 0 AND k % 14 <> 0 AND o_orderpriority = '5-LOW'",
    "first_year": "SELECT k FROM obj WHERE i = 0 AND part % 29 <> 0 AND ln % 4 <> 1 AND 2000 + part % 25 < 2010",
    "second_id": "SELECT k FROM obj WHERE i = 1 AND part % 29 <> 0 AND part = 100",
    "third_value_none": "SELECT k FROM obj WHERE i = 2 AND part % 29 <> 0 AND part % 11 IN (0, 1)",
    "first_none": "SELECT k FROM obj WHERE i = 0 AND part % 29 = 0",
    "four": "SELECT k FROM obj GROUP BY k HAVING count(*) = 4",
    "amount_none": "SELECT k FROM o WHERE k % 13 = 0"}

SQL["indexed_assertions"] = f"WITH {_SQL_ANSWERS}" + " UNION ALL ".join(
    f"\nSELECT '{name}' AS name, (SELECT count(*) FROM ({passed})) AS n_pass, (SELECT count(*) FROM orders) - (SELECT count(*) FROM ({passed})) AS n_fail"
    for name, passed in _ASSERTIONS.items())


# --- X9, X10: the insurance schema over predicted claims --------------------------------

def claim_violations(spark, sf_dir):
    _, pred = claims.claims(spark, sf_dir)
    df = pred.withColumnRenamed("policy", "policy_details")
    parts = [validate.violations(df, "record_id", checks).withColumn("severity", F.lit(severity))
             for severity, checks in insurance.validation_checks(df).items()]
    return parts[0].unionByName(parts[1]).groupBy("rule", "severity").agg(
        F.count(F.lit(1)).alias("n_violations"), F.min("record_id").alias("first_record"))


def _not_allowed(path: str, x: str) -> str:
    allowed = ", ".join(f"'{v}'" for v in sorted({v.lower().replace("-", "_").replace(" ", "_") for v in INSURANCE_ALLOWED[path]}))
    return f"{x} IS NOT NULL AND {S.enum_key(x)} NOT IN ({allowed})"


def _not_iso(x: str) -> str:
    return f"{x} IS NOT NULL AND NOT (regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST({x} AS DATE) IS NOT NULL)"


_VIOLATED = [
    ("header.required", "error", "sec", "NOT p_h"),
    ("header.channel.allowed", "error", "sec", "p_h AND " + _not_allowed("header.channel", "p_h_channel")),
    ("header.reported_by.min_length", "error", "sec", "p_h AND length(p_h_reported_by) < 1"),
    ("header.report_date.iso", "error", "sec", "p_h AND " + _not_iso("p_h_report_date")),
    ("header.incident_date.iso", "error", "sec", "p_h AND " + _not_iso("p_h_incident_date")),
    ("policy_details.policyholder_name.min_length", "error", "sec", "p_pol AND length(p_pol_policyholder_name) < 1"),
    ("policy_details.coverage_type.allowed", "error", "sec", "p_pol AND " + _not_allowed("policy_details.coverage_type", "p_pol_coverage_type")),
    ("policy_details.effective_date.iso", "error", "sec", "p_pol AND " + _not_iso("p_pol_effective_date")),
    ("policy_details.expiration_date.iso", "error", "sec", "p_pol AND " + _not_iso("p_pol_expiration_date")),
    ("incident_description.incident_type.required", "error", "sec", "p_inc_incident_type IS NULL"),
    ("incident_description.incident_type.allowed", "error", "sec", _not_allowed("incident_description.incident_type", "p_inc_incident_type")),
    ("incident_description.location_type.required", "error", "sec", "p_inc_location_type IS NULL"),
    ("incident_description.location_type.allowed", "error", "sec", _not_allowed("incident_description.location_type", "p_inc_location_type")),
    ("insured_objects.object_type.allowed", "error", "pobj",
     "object_type IS NULL OR " + _not_allowed("insured_objects.object_type", "object_type")),
    ("header.claim_id.pattern", "warning", "sec", "p_h AND NOT regexp_full_match(p_h_claim_id, 'CLM-[0-9]{6}')"),
    ("policy_details.policy_number.pattern", "warning", "sec", "p_pol AND NOT regexp_full_match(p_pol_policy_number, 'POL-[0-9]{9}')"),
    ("insured_objects.object_id.pattern", "warning", "pobj",
     "NOT regexp_full_match(object_id, 'VIN[0-9]{17}|(PROP|LIAB|OBJ)-[0-9]{6}')"),
]

SQL["claim_violations"] = f"WITH RECURSIVE {SQL_CLAIMS}, v AS (" + " UNION ALL ".join(
    f"\nSELECT DISTINCT '{rule}' AS rule, '{severity}' AS severity, record_id FROM {source} WHERE {cond}"
    for rule, severity, source, cond in _VIOLATED) + """)
SELECT rule, severity, count(*) AS n_violations, min(record_id) AS first_record FROM v GROUP BY rule, severity"""


# --- X2, X3, X6: round-robin extraction with an observed bound ---------------------------

THREADS = 4


def even_fn(text: str) -> dict:
    return {"first": text[:8]}


def odd_fn(text: str) -> dict:
    if len(text) % 20 == 1:
        raise ValueError("no answer")
    return {"first": text[:8].upper()}


def extract_round_robin(spark, sf_dir):
    """Whole documents by two functions in turn; the observed metrics of the run stand beside the counts
    made from its stored rows."""
    seen = Observation()
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    out = extract.extract_structured(docs, "text", "doc_id", T.StructType([T.StructField("first", T.StringType())]), [even_fn, odd_fn],
                                     concurrency=THREADS, strategy="round_robin", observe=seen)
    path = scratch_path(spark, "round-robin")
    out.write.parquet(path)
    got = seen.get
    stored = spark.read.schema(out.schema).parquet(path)
    used = F.coalesce(F.col("fn_index").cast("string"), F.lit("none"))
    return stored.groupBy(used.alias("fn")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("error").alias("n_errors"), F.min("result.first").alias("least")).select(
        "*", F.lit(got["n_rows"]).cast("long").alias("observed_rows"), F.lit(got["n_errors"]).cast("long").alias("observed_errors"),
        F.lit(got["peak_in_task"]).between(1, THREADS).alias("within_bound"))


SQL["extract_round_robin"] = f"""
WITH d AS (SELECT doc_id % 2 AS odd, text, doc_id % 2 = 1 AND length(text) % 20 = 1 AS failed FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN failed THEN 'none' ELSE odd::VARCHAR END AS fn, count(*) AS n_rows, count(*) FILTER (WHERE failed) AS n_errors,
       min(CASE WHEN failed THEN NULL WHEN odd = 1 THEN upper(text[1:8]) ELSE text[1:8] END) AS least,
       (SELECT count(*) FROM d) AS observed_rows, (SELECT count(*) FROM d WHERE failed) AS observed_errors, {THREADS} >= 1 AS within_bound
FROM d GROUP BY 1"""


# --- K1, S10, K2, K7, K3: gold stored by its key ------------------------------------------

def stored_records(spark, sf_dir):
    """All orders with their place as key, stored in key ranges; then a slice and a fetch from few files."""
    gold = io.gold_with_key(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    path = scratch_path(spark, "by-key")
    keys.store_by_key(gold, path)
    part = keys.read_slice(spark, path, 101, 400).select(F.lit("slice").alias("asked"), "*")
    picked = keys.read_records_by_key(spark, path, [1, 77, 1200, 10**12]).select(F.lit("fetch").alias("asked"), "*")
    return keys.order_by_key(part.unionByName(picked))


SQL["stored_records"] = """
WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS record_id, o_orderkey, o_totalprice FROM orders)
SELECT 'slice' AS asked, * FROM r WHERE record_id BETWEEN 101 AND 400
UNION ALL SELECT 'fetch', * FROM r WHERE record_id IN (1, 77, 1200)"""


# --- L3, L4: counts of nested lists that hold something -----------------------------------

def nested_counts(spark, sf_dir):
    """Gold substances are an order's lines; the prediction nests them by return flag, without those over 45
    and with none at all (``k % 7``).  Immunizations are the lines of one status."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", F.concat_ws("-", "l_partkey", "l_linenumber").alias("name"))
    subs = lambda cond: F.collect_list(F.when(cond, F.struct("name")))
    kept = F.col("l_quantity") <= 45
    of_flag = lambda f: F.struct(subs(kept & (F.col("l_returnflag") == f)).alias("substance"))
    taken = lambda cond: F.collect_list(F.when(cond, F.struct(F.col("l_linestatus").alias("status"))))
    per = li.groupBy(F.col("l_orderkey").alias("record_id")).agg(
        F.struct(subs(F.lit(True)).alias("substance")).alias("allergy"), F.array(*[of_flag(f) for f in "ANR"]).alias("nested"),
        taken(F.col("l_linestatus") == "O").alias("immunization"), taken((F.col("l_linestatus") == "O") & kept).alias("p_immunization"))
    path = scratch_path(spark, "nested")
    per.write.parquet(path)
    per = spark.read.schema(per.schema).parquet(path)
    gold = per.select("record_id", "allergy", "immunization")
    pred = per.select(F.struct("record_id", F.when(F.col("record_id") % 7 != 0, F.col("nested")).alias("allergy")).alias("patient"),
                      F.col("p_immunization").alias("immunization"))
    matched = match.match_records(gold, patient.prediction_key(pred), gold_seq=None, pred_seq=None)
    checks = patient.list_checks(matched)
    return score.scorecard(score.outcomes(matched, checks), checks)


SQL["nested_counts"] = f"""
WITH per AS (SELECT l_orderkey AS k, count(*) AS g, CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE count(*) FILTER (WHERE l_quantity <= 45) END AS p,
                    count(*) FILTER (WHERE l_linestatus = 'O') AS gi, count(*) FILTER (WHERE l_linestatus = 'O' AND l_quantity <= 45) AS pi
             FROM lineitem GROUP BY l_orderkey),
f AS (SELECT 'allergy.count' AS field, g = p AS ok FROM per UNION ALL SELECT 'immunization.count', gi = pi FROM per)
SELECT field, sum(ok::INT)::BIGINT AS matches, count(*) AS total, {S.pct('sum(ok::INT)', 'count(*)')} AS percentage FROM f GROUP BY field"""


# --- T2: all seven lists ------------------------------------------------------------------

def financial_lists(spark, sf_dir):
    """Each list of the task differs from gold for a remainder of its own; gold has empty (``Person``) and
    null (``Quantity``) lists, the prediction repeated, missing, lower-cased and added elements."""
    k, date = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = lambda c: c.cast("string")
    none, words = F.array().cast("array<string>"), F.split("o_orderpriority", " ")
    company = F.array(F.concat(F.lit("C"), text(F.col("o_custkey"))), F.lit("Acme"))
    money = F.array(text(F.floor("o_totalprice").cast("long")))
    person = F.when(k % 6 == 0, none).otherwise(F.array(F.concat(F.lit("P"), text(k % 100)), F.concat(F.lit("P"), text(k % 10))))
    quantity = F.when(k % 5 != 0, F.array(text(k % 7), text(k % 3)))
    gold = {"Company": company, "Date": F.array(date, text(F.year("o_orderdate"))), "Location": words, "Money": money,
            "Person": person, "Product": F.array("o_orderstatus"), "Quantity": quantity}
    pred = {"Company": F.when(k % 4 == 0, F.reverse(company)).when(k % 4 == 1, F.slice(company, 1, 1)).otherwise(company),
            "Date": F.when(k % 8 == 0, F.lit(None)).otherwise(F.array(date)),
            "Location": F.when(k % 3 == 0, F.split(F.lower("o_orderpriority"), " ")).otherwise(words),
            "Money": F.when(k % 9 == 0, F.concat(money, money, F.array(F.lit("1")))).otherwise(money),
            "Person": F.when(k % 12 == 0, F.array(F.lit("P0"))).otherwise(person),
            "Product": F.when(k % 11 == 0, none).otherwise(F.array("o_orderstatus")),
            "Quantity": F.when(k % 10 == 0, none).otherwise(F.array(text(k % 7)))}
    orders = table(spark, sf_dir, "orders")
    rows = lambda lists: orders.select(k.alias("record_id"), *[lists[f].alias(f) for f in FINANCIAL_FIELDS])
    matched = match.match_records(rows(gold), rows(pred), gold_seq=None, pred_seq=None)
    checks = patient.financial_checks(matched)
    return score.scorecard(score.outcomes(matched, checks), checks)


_FINANCIAL = {
    "Company": ("company", "CASE k % 4 WHEN 0 THEN list_reverse(company) WHEN 1 THEN company[1:1] ELSE company END"),
    "Date": ("[d, d[1:4]]", "CASE WHEN k % 8 = 0 THEN [] ELSE [d] END"),
    "Location": ("string_split(o_orderpriority, ' ')", "string_split(CASE WHEN k % 3 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END, ' ')"),
    "Money": ("[m]", "CASE WHEN k % 9 = 0 THEN [m, m, '1'] ELSE [m] END"),
    "Person": ("person", "CASE WHEN k % 12 = 0 THEN ['P0'] ELSE person END"),
    "Product": ("[o_orderstatus]", "CASE WHEN k % 11 = 0 THEN [] ELSE [o_orderstatus] END"),
    "Quantity": ("CASE WHEN k % 5 = 0 THEN [] ELSE [(k % 7)::VARCHAR, (k % 3)::VARCHAR] END", "CASE WHEN k % 10 = 0 THEN [] ELSE [(k % 7)::VARCHAR] END")}

SQL["financial_lists"] = f"""
WITH b AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, ['C' || o_custkey, 'Acme'] AS company, floor(o_totalprice)::BIGINT::VARCHAR AS m,
                  CASE WHEN o_orderkey % 6 = 0 THEN [] ELSE ['P' || (o_orderkey % 100), 'P' || (o_orderkey % 10)] END AS person, o_orderpriority, o_orderstatus FROM orders),
l AS ({" UNION ALL ".join(f"SELECT '{f}' AS field, {g} AS g, {p} AS p FROM b" for f, (g, p) in _FINANCIAL.items())}),
res AS (SELECT field, len(g) = 0 AND len(p) = 0 AS none, len(list_intersect(list_distinct(g), p)) AS m, len(list_distinct(g)) AS t FROM l),
n AS (SELECT field, CASE WHEN none THEN 1 ELSE m END AS m, CASE WHEN none THEN 1 ELSE t END AS t FROM res)
SELECT field, sum(m)::BIGINT AS matches, sum(t)::BIGINT AS total, {S.pct('sum(m)', 'sum(t)')} AS percentage FROM n GROUP BY field"""
