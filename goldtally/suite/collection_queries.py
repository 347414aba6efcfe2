"""Set, count and first-element comparisons (L1-L6) on the driver tables.

Records are orders (or conversations); their lists are the line items.
Lists are compared in long form (``operators.sets``) or through partial
aggregates (``min`` of a struct for "first element"), never by collecting a
record's rows into one array."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..operators import match, score, sets
from ..plans import patient
from . import sqlfrag as S
from .common import table

SQL = {}
FLAGS = ["A", "N", "R"]


# --- L1, P10, T2 ----------------------------------------------------------------

def set_overlap(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rec = F.col("l_orderkey").alias("record_id")
    pairs = li.select(rec).distinct().select(
        "record_id", F.explode(F.array(*[F.lit(f) for f in FLAGS])).alias("field"))
    elems = lambda cond: li.where(cond).select(
        rec, F.col("l_returnflag").alias("field"), F.col("l_partkey").cast("string").alias("e"))
    res = sets.set_overlap_long(pairs, elems(F.col("l_quantity") >= 10),
                                elems(F.col("l_quantity") <= 40), ["record_id", "field"], "e")
    return score.scorecard_long(res)


SQL["set_overlap"] = f"""
WITH recs AS (SELECT DISTINCT l_orderkey AS record_id FROM lineitem),
pairs AS (SELECT record_id, f.field FROM recs, (VALUES ('A'), ('N'), ('R')) f(field)),
g AS (SELECT DISTINCT l_orderkey AS record_id, l_returnflag AS field, l_partkey::VARCHAR AS e FROM lineitem WHERE l_quantity >= 10),
p AS (SELECT DISTINCT l_orderkey AS record_id, l_returnflag AS field, l_partkey::VARCHAR AS e FROM lineitem WHERE l_quantity <= 40),
gn AS (SELECT record_id, field, count(*) AS g_n FROM g GROUP BY ALL),
pn AS (SELECT record_id, field, count(*) AS p_n FROM p GROUP BY ALL),
bn AS (SELECT record_id, field, count(*) AS both_n FROM g JOIN p USING (record_id, field, e) GROUP BY ALL),
per AS (SELECT pairs.field, coalesce(g_n, 0) AS g_n, coalesce(p_n, 0) AS p_n, coalesce(both_n, 0) AS both_n
        FROM pairs LEFT JOIN gn USING (record_id, field) LEFT JOIN pn USING (record_id, field)
        LEFT JOIN bn USING (record_id, field)),
res AS (SELECT field, CASE WHEN g_n = 0 AND p_n = 0 THEN 1 ELSE both_n END AS m,
               CASE WHEN g_n = 0 AND p_n = 0 THEN 1 ELSE g_n END AS t FROM per)
SELECT field, sum(m)::BIGINT AS matches, sum(t)::BIGINT AS total, {S.pct('sum(m)', 'sum(t)')} AS percentage
FROM res GROUP BY field"""


# --- T2: the financial task's scorecard, lists held in the row ---------------------------

def financial_scorecard(spark, sf_dir):
    """Gold lists are a part's name words, type words and brand (none for ``k % 6 = 0``); the prediction
    loses all but the first word (``k % 5``), lowers the type (``k % 7``), has no brand (``k % 4``),
    adds one twice (``k % 9``), or is missing (``k % 13``)."""
    part = table(spark, sf_dir, "part")
    k, words, kinds = F.col("p_partkey"), F.split("p_name", " "), F.split("p_type", " ")
    none = F.array().cast("array<string>")
    gold = part.select(k.alias("record_id"), words.alias("company"), kinds.alias("product"),
                       F.when(k % 6 == 0, none).otherwise(F.array("p_brand")).alias("brand"))
    pred = part.where(k % 13 != 0).select(
        k.alias("record_id"), F.when(k % 5 == 0, F.slice(words, 1, 1)).otherwise(words).alias("company"),
        F.when(k % 7 == 0, F.split(F.lower("p_type"), " ")).otherwise(kinds).alias("product"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 9 == 0, F.array("p_brand", "p_brand", F.lit("x")))
        .otherwise(F.array("p_brand")).alias("brand"), F.lit(1).alias("seq"))
    matched = match.match_records(gold, pred, gold_seq=None)
    checks = patient.financial_checks(matched)
    return score.scorecard(score.outcomes(matched, checks), checks)


SQL["financial_scorecard"] = f"""
WITH b AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS words, string_split(p_type, ' ') AS kinds,
                  string_split(lower(p_type), ' ') AS low, p_brand FROM part WHERE p_partkey % 13 <> 0),
l AS (
  SELECT 'company' AS field, words AS g, CASE WHEN k % 5 = 0 THEN words[1:1] ELSE words END AS p FROM b
  UNION ALL SELECT 'product', kinds, CASE WHEN k % 7 = 0 THEN low ELSE kinds END FROM b
  UNION ALL SELECT 'brand', CASE WHEN k % 6 = 0 THEN [] ELSE [p_brand] END,
         CASE WHEN k % 4 = 0 THEN [] WHEN k % 9 = 0 THEN [p_brand, p_brand, 'x'] ELSE [p_brand] END FROM b),
res AS (SELECT field,
               CASE WHEN len(g) = 0 AND len(p) = 0 THEN 1 ELSE len(list_intersect(list_distinct(g), p)) END AS m,
               CASE WHEN len(g) = 0 AND len(p) = 0 THEN 1 ELSE len(list_distinct(g)) END AS t FROM l)
SELECT field, sum(m)::BIGINT AS matches, sum(t)::BIGINT AS total, {S.pct('sum(m)', 'sum(t)')} AS percentage
FROM res GROUP BY field"""


# --- L2 (+ C14) -------------------------------------------------------------

def set_equal(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    k, ln, name = F.col("l_orderkey"), F.col("l_linenumber"), F.col("s_name")
    g_line = F.when(ln % 4 == 0, F.array(name, F.lit("x"))).otherwise(F.array(name))
    p_line = F.when((k + ln) % 6 == 0, F.lit("")).otherwise(F.concat(F.upper(name), F.lit(" ")))
    in_pred = F.col("l_quantity") <= 45
    gold = lines.select(k.alias("record_id"), R.address_line_key(g_line, T.ArrayType(T.StringType())).alias("e"))
    pred = lines.where(in_pred).select(k.alias("record_id"), R.address_line_key(p_line, T.StringType()).alias("e"))
    counts = lines.groupBy(k.alias("record_id")).agg(
        F.count(F.lit(1)).alias("n_gold"), F.count(F.when(in_pred, 1)).alias("n_pred"))
    eq = sets.set_equal_long(gold.where(F.col("e").isNotNull()), pred.where(F.col("e").isNotNull()),
                             ["record_id"], "e")
    j = counts.join(eq, "record_id", "left")
    scored = (F.col("n_gold") > 0) & (F.col("n_pred") > 0)
    return j.select("record_id", "n_gold", "n_pred",
                    F.coalesce(F.col("g_n"), F.lit(0)).alias("g_n"),
                    F.coalesce(F.col("p_n"), F.lit(0)).alias("p_n"),
                    F.when(scored, F.coalesce(F.col("equal"), F.lit(True))).alias("equal"))


SQL["set_equal"] = f"""
WITH lines AS (SELECT l_orderkey, l_linenumber, l_quantity, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
g AS (SELECT DISTINCT l_orderkey AS record_id,
        {S.address_line_key_list("CASE WHEN l_linenumber % 4 = 0 THEN [s_name, 'x'] ELSE [s_name] END")} AS e FROM lines),
p AS (SELECT DISTINCT l_orderkey AS record_id,
        {S.address_line_key_text("CASE WHEN (l_orderkey + l_linenumber) % 6 = 0 THEN '' ELSE upper(s_name) || ' ' END")} AS e
      FROM lines WHERE l_quantity <= 45),
g2 AS (SELECT * FROM g WHERE e IS NOT NULL), p2 AS (SELECT * FROM p WHERE e IS NOT NULL),
gn AS (SELECT record_id, count(*) AS g_n FROM g2 GROUP BY ALL),
pn AS (SELECT record_id, count(*) AS p_n FROM p2 GROUP BY ALL),
bn AS (SELECT record_id, count(*) AS both_n FROM g2 JOIN p2 USING (record_id, e) GROUP BY ALL),
counts AS (SELECT l_orderkey AS record_id, count(*) AS n_gold, count(*) FILTER (WHERE l_quantity <= 45) AS n_pred
           FROM lines GROUP BY ALL)
SELECT c.record_id, c.n_gold::BIGINT AS n_gold, c.n_pred::BIGINT AS n_pred, coalesce(g_n, 0)::BIGINT AS g_n,
       coalesce(p_n, 0)::BIGINT AS p_n,
       CASE WHEN c.n_gold > 0 AND c.n_pred > 0 THEN
         coalesce(g_n, 0) = coalesce(p_n, 0) AND coalesce(both_n, 0) = coalesce(g_n, 0) END AS equal
FROM counts c LEFT JOIN gn USING (record_id) LEFT JOIN pn USING (record_id) LEFT JOIN bn USING (record_id)"""


# --- L3, L4 -----------------------------------------------------------------

def count_match(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    li = table(spark, sf_dir, "lineitem")
    per_order = li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("gold_n"), F.count(F.when(F.col("l_quantity") < 45, 1)).alias("pred_n"))
    o = orders.join(per_order, "id", "left").select(
        F.lit("order").alias("source"), "id",
        F.coalesce(F.col("gold_n"), F.lit(0)).alias("gold_n"),
        F.coalesce(F.col("pred_n"), F.lit(0)).alias("pred_n"))
    conv = table(spark, sf_dir, "conversations")
    # L4: the prediction nests turns in per-role lists; its count is the size
    # of the flattened list, i.e. the turns kept over all roles.
    c = conv.groupBy(F.col("conv_id").alias("id")).agg(
        F.count(F.lit(1)).alias("gold_n"), F.count(F.when(F.col("turn") < 6, 1)).alias("pred_n"))
    c = c.select(F.lit("conversation").alias("source"), "id", "gold_n", "pred_n")
    both = o.unionByName(c)
    return both.withColumn("m_count", F.col("gold_n") == F.col("pred_n"))


SQL["count_match"] = """
WITH o AS (SELECT 'order' AS source, o.o_orderkey AS id, count(l.l_orderkey)::BIGINT AS gold_n,
                  count(l.l_orderkey) FILTER (WHERE l.l_quantity < 45)::BIGINT AS pred_n
           FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey),
c AS (SELECT 'conversation' AS source, conv_id AS id, count(*)::BIGINT AS gold_n,
             count(*) FILTER (WHERE turn < 6)::BIGINT AS pred_n FROM conversations GROUP BY conv_id)
SELECT source, id, gold_n, pred_n, gold_n = pred_n AS m_count FROM (SELECT * FROM o UNION ALL SELECT * FROM c)"""


# --- L5, L6, T1 ---------------------------------------------------------------

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus",
          "l_shipdate", "l_discount", "l_extendedprice", "l_tax"]


def first_element(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k, ln = F.col("l_orderkey"), F.col("l_linenumber")
    pred_li = li.where(F.col("l_quantity") > 5).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(ln % 5 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(k % 3 == 0, F.lower("l_returnflag")).when(k % 3 == 1, F.lit("X"))
        .otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate", "l_discount", "l_extendedprice", "l_tax")
    # "first element" of a list ordered by all columns = min of the row struct:
    # a partial aggregate, one row per order per map task.
    first = lambda df: df.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min(F.struct(*_ORDER)).alias("f"))
    g, p = first(li).withColumnRenamed("f", "g"), first(pred_li).withColumnRenamed("f", "p")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    j = orders.join(g, "o_orderkey", "left").join(p, "o_orderkey", "left")
    iso = lambda s: F.date_format(F.col(f"{s}.l_shipdate"), "yyyy-MM-dd")
    g_ship = F.when(F.col("g.l_discount") > 0.05, F.struct(iso("g").alias("date"), F.col("g.l_linestatus").alias("status")))
    p_ship = F.when(F.col("p.l_discount") > 0.02, F.struct(
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(iso("p"), F.lit("T00:00:00"))).otherwise(iso("p")).alias("date"),
        F.when(F.col("o_orderkey") % 4 == 1, F.lower("p.l_linestatus")).otherwise(F.col("p.l_linestatus")).alias("status")))
    both = F.col("g").isNotNull() & F.col("p").isNotNull()          # L5
    block = both & (g_ship.isNotNull() | p_ship.isNotNull())        # L6
    lng = T.LongType()
    return j.select(
        "o_orderkey",
        F.when(both, R.casefold_rule(F.col("g.l_partkey"), F.col("p.l_partkey"), lng, lng)).alias("m_partkey"),
        F.when(both, R.number_rule(F.col("g.l_quantity"), F.col("p.l_quantity"), T.DoubleType(), T.DoubleType())).alias("m_quantity"),
        F.when(both, R.casefold_rule(F.col("g.l_returnflag"), F.col("p.l_returnflag"))).alias("m_returnflag"),
        F.when(block, R.datetime_date_rule(g_ship["date"], p_ship["date"])).alias("m_ship_date"),
        F.when(block, R.casefold_rule(g_ship["status"], p_ship["status"])).alias("m_ship_status"))


_ORDER_SQL = ", ".join(_ORDER)
SQL["first_element"] = f"""
WITH g AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER_SQL}) = 1),
pl AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CASE WHEN l_linenumber % 5 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
              CASE WHEN l_orderkey % 3 = 0 THEN lower(l_returnflag) WHEN l_orderkey % 3 = 1 THEN 'X' ELSE l_returnflag END AS l_returnflag,
              l_linestatus, l_shipdate, l_discount, l_extendedprice, l_tax FROM lineitem WHERE l_quantity > 5),
p AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER_SQL}) = 1),
j AS (SELECT o.o_orderkey, g.l_partkey AS g_part, p.l_partkey AS p_part, g.l_quantity AS g_qty, p.l_quantity AS p_qty,
             g.l_returnflag AS g_flag, p.l_returnflag AS p_flag,
             g.l_orderkey IS NOT NULL AND p.l_orderkey IS NOT NULL AS both_,
             CASE WHEN g.l_discount > 0.05 THEN strftime(g.l_shipdate, '%Y-%m-%d') END AS g_date,
             CASE WHEN g.l_discount > 0.05 THEN g.l_linestatus END AS g_status,
             coalesce(g.l_discount > 0.05, false) AS g_has,
             CASE WHEN p.l_discount > 0.02 THEN
               CASE WHEN o.o_orderkey % 2 = 0 THEN strftime(p.l_shipdate, '%Y-%m-%d') || 'T00:00:00'
                    ELSE strftime(p.l_shipdate, '%Y-%m-%d') END END AS p_date,
             CASE WHEN p.l_discount > 0.02 THEN
               CASE WHEN o.o_orderkey % 4 = 1 THEN lower(p.l_linestatus) ELSE p.l_linestatus END END AS p_status,
             coalesce(p.l_discount > 0.02, false) AS p_has
      FROM orders o LEFT JOIN g ON g.l_orderkey = o.o_orderkey LEFT JOIN p ON p.l_orderkey = o.o_orderkey)
SELECT o_orderkey,
  CASE WHEN both_ THEN {S.casefold_rule('g_part::VARCHAR', 'p_part::VARCHAR')} END AS m_partkey,
  CASE WHEN both_ THEN {S.number_rule('g_qty', 'p_qty', True, True)} END AS m_quantity,
  CASE WHEN both_ THEN {S.casefold_rule('g_flag', 'p_flag')} END AS m_returnflag,
  CASE WHEN both_ AND (g_has OR p_has) THEN {S.datetime_date_rule('g_date', 'p_date')} END AS m_ship_date,
  CASE WHEN both_ AND (g_has OR p_has) THEN {S.casefold_rule('g_status', 'p_status')} END AS m_ship_status
FROM j"""
