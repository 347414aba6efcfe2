"""Scorecard queries on the customer stand-in (PII task shape, T4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match, score
from ..plans.comparison import exact_checks
from ..plans.schemas import PII_FIELDS
from .common import SQL_CUSTOMER, customer_gold, customer_pred, sql_pct, table


def _scored(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    matched = match.match_records(customer_gold(cust), customer_pred(cust))
    checks = exact_checks(matched)
    return score.outcomes(matched, checks), checks


def scorecard_exact(spark, sf_dir):
    out, checks = _scored(spark, sf_dir)
    return score.scorecard(out, checks)


def scorecard_overall(spark, sf_dir):
    out, checks = _scored(spark, sf_dir)
    return score.overall(score.scorecard(out, checks))


def match_coverage(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    return match.coverage(customer_gold(cust), customer_pred(cust))


def mismatch_first10(spark, sf_dir):
    out, checks = _scored(spark, sf_dir)
    first = score.first_mismatches(out, checks)
    return first.select("field", F.size("mismatch_ids").alias("n_listed"),
                        F.array_join(F.col("mismatch_ids").cast("array<string>"), ",").alias("mismatch_ids"))


def _category(field):
    return F.when(field.isin("c_name", "c_nationkey"), "identity").otherwise("account")


def category_rollup(spark, sf_dir):
    out, checks = _scored(spark, sf_dir)
    out = score.stored_outcomes(out)
    card = score.scorecard(out, checks)
    mism = score.first_mismatches(out, checks)
    lines = score.report_lines(card, mism)
    rolled = score.category_rollup(card, _category)
    return (rolled.join(lines.select("field", "line"), "field", "left")
            .select("category", "field", "matches", "total", "percentage", "line"))


PII_ROWS_PER_TASK = 20_000


def _pii(spark, sf_dir):
    """T4 with all of its 56 string fields over customers: nulls on either side,
    altered and invented values in every field, missing predictions."""
    k = F.col("c_custkey")
    cust = table(spark, sf_dir, "customer").select(k)
    # a key becomes a row of 56 texts: so few keys a task that these rows fit it, whatever the files are cut like
    cust = cust.repartition(-(-cust.count() // PII_ROWS_PER_TASK) or 1)
    gold = {f: F.when((k + i) % 5 != 0, F.concat(F.lit(f"{f}-"), (k * (i + 1)).cast("string"))) for i, f in enumerate(PII_FIELDS)}
    pred = {f: F.when((k + 3 * i) % 59 == 0, F.lit(None)).when((k + 2 * i) % 61 == 0, F.concat(F.coalesce(gold[f], F.lit("")), F.lit("x"))).otherwise(gold[f])
            for i, f in enumerate(PII_FIELDS)}
    return (cust.select(k.alias("record_id"), k.alias("seq"), *[c.alias(f) for f, c in gold.items()]),
            cust.where(k % 13 != 0).select(k.alias("record_id"), F.lit(1).alias("seq"), *[c.alias(f) for f, c in pred.items()]))


def pii_report(spark, sf_dir):
    """The whole report of T4: a line for each field (A5), then the totals (A6), from one stored outcome table."""
    matched = match.match_records(*_pii(spark, sf_dir))
    checks = exact_checks(matched)
    out = score.stored_outcomes(score.outcomes(matched, checks))
    card = score.scorecard(out, checks)
    lines = score.report_lines(card, score.first_mismatches(out, checks)).select(F.lit("field").alias("kind"), "field", "line")
    totals = score.summary_lines(card).select(F.posexplode("lines").alias("at", "line"))
    return lines.unionByName(totals.select(F.lit("summary").alias("kind"), F.col("at").cast("string").alias("field"), "line"))


SQL = {
    "scorecard_exact": f"""WITH {SQL_CUSTOMER}
SELECT field, matches, total, {sql_pct('matches', 'total')} AS percentage FROM card""",
    "scorecard_overall": f"""WITH {SQL_CUSTOMER}
SELECT sum(matches)::BIGINT AS total_matches, sum(total)::BIGINT AS total_fields,
       {sql_pct('sum(matches)', 'sum(total)')} AS overall_accuracy FROM card""",
    "match_coverage": f"""WITH {SQL_CUSTOMER}
SELECT (SELECT count(*) FROM gold g JOIN pred p ON g.record_id = p.record_id)::BIGINT AS matched,
       (SELECT count(*) FROM gold g WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.record_id = g.record_id))::BIGINT AS missing,
       (SELECT count(*) FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE p.record_id = g.record_id))::BIGINT AS unknown,
       (SELECT count(*) FROM pred_raw WHERE record_id IS NULL)::BIGINT AS keyless""",
}

_MISM = """,
fails AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{f}' AS field, record_id, seq FROM matched WHERE NOT o_{f}"
    for f in ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]) + """),
ranked AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY seq, record_id) AS rn FROM fails
           WHERE record_id IS NOT NULL),
mism AS (SELECT field, count(*)::INT AS n_listed,
                string_agg(record_id::VARCHAR, ',' ORDER BY rn) AS mismatch_ids
         FROM ranked WHERE rn <= 10 GROUP BY field)
"""

SQL["mismatch_first10"] = f"WITH {SQL_CUSTOMER}{_MISM}SELECT field, n_listed, mismatch_ids FROM mism"

SQL["category_rollup"] = f"""WITH {SQL_CUSTOMER}{_MISM},
cat AS (SELECT CASE WHEN field IN ('c_name', 'c_nationkey') THEN 'identity' ELSE 'account' END AS category,
               field, matches, total FROM card),
rolled AS (SELECT category, field, sum(matches)::BIGINT AS matches, sum(total)::BIGINT AS total
           FROM cat GROUP BY ROLLUP (category, field)),
lines AS (SELECT c.field,
                 '  ' || c.field || ' -> ' || c.matches || '/' || c.total || ' ('
                 || printf('%.1f', {sql_pct('c.matches', 'c.total')}) || '%)'
                 || CASE WHEN m.mismatch_ids IS NOT NULL
                         THEN ' [mismatches: [' || replace(m.mismatch_ids, ',', ', ') || ']]' ELSE '' END AS line
          FROM card c LEFT JOIN mism m ON c.field = m.field)
SELECT r.category, r.field, r.matches, r.total, {sql_pct('r.matches', 'r.total')} AS percentage, l.line
FROM rolled r LEFT JOIN lines l ON r.field = l.field"""


SQL["pii_report"] = f"""
WITH names AS (SELECT unnest({PII_FIELDS}) AS field, unnest(range(56)) AS i),
gold AS (SELECT c_custkey AS k, field, i, CASE WHEN (c_custkey + i) % 5 <> 0 THEN field || '-' || (c_custkey * (i + 1)) END AS g FROM customer, names WHERE c_custkey % 13 <> 0),
cells AS (SELECT k, field, g IS NOT DISTINCT FROM CASE WHEN (k + 3 * i) % 59 = 0 THEN NULL WHEN (k + 2 * i) % 61 = 0 THEN coalesce(g, '') || 'x' ELSE g END AS ok FROM gold),
card AS (SELECT field, count(*) FILTER (WHERE ok) AS m, count(*) AS t FROM cells GROUP BY field),
mism AS (SELECT field, string_agg(k::VARCHAR, ', ' ORDER BY k) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY k) AS rn FROM cells WHERE NOT ok) WHERE rn <= 10 GROUP BY field),
tot AS (SELECT sum(m)::BIGINT AS m, sum(t)::BIGINT AS t, count(*) AS n FROM card)
SELECT 'field' AS kind, c.field, '  ' || c.field || ' -> ' || c.m || '/' || c.t || ' (' || printf('%.1f', {sql_pct('c.m', 'c.t')}) || '%)'
  || CASE WHEN ids IS NOT NULL THEN ' [mismatches: [' || ids || ']]' ELSE '' END AS line FROM card c LEFT JOIN mism USING (field)
UNION ALL SELECT 'summary', i::VARCHAR, CASE WHEN n = 0 THEN 'No evaluation results found.' ELSE
  ['=== Overall Statistics ===', 'Total Fields Evaluated: ' || t, 'Total Matches: ' || m, 'Overall Accuracy: ' || printf('%.1f', {sql_pct('m', 't')}) || '%'][i + 1] END
FROM tot, range(4) AS r(i) WHERE n > 0 OR i = 0"""
