"""Per-record rule queries (C3-C14) on the driver tables.

Each returns one row per input record: the key, the derived prediction and
the boolean outcome of the rule(s) -- a pure projection over the whole
table, no shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..functions.rules import US_STATES
from . import sqlfrag as S
from .common import table

SQL = {}


# --- C3 ---------------------------------------------------------------------

def rule_text(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pred = (F.when(k % 10 == 0, F.lit(None).cast("string"))
            .when(k % 3 == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
            .otherwise(F.concat(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))), F.lit("."))))
    gold_u = F.concat(F.col("p_name"), F.lit(" Rodríguez-"), F.col("p_brand"))
    pred_u = F.concat(F.upper(gold_u), F.lit("!"))
    return part.select(k, pred.alias("pred"), R.text_rule(F.col("p_name"), pred).alias("m_name"),
                       R.text_rule(gold_u, pred_u).alias("m_unicode"))


SQL["rule_text"] = f"""
WITH t AS (SELECT p_partkey, p_name,
  CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_')
       ELSE upper(replace(p_name, ' ', '-')) || '.' END AS pred,
  p_name || ' Rodríguez-' || p_brand AS gold_u FROM part)
SELECT p_partkey, pred, {S.text_rule('p_name', 'pred')} AS m_name,
       {S.text_rule('gold_u', "upper(gold_u) || '!'")} AS m_unicode FROM t"""


# --- C4 + C13: rule table by field path --------------------------------------

ORDER_RULES = {"order.priority": "enum", "order.status": "text", "order.totalprice": "number"}
_RULES = {"enum": R.enum_rule, "text": R.text_rule, "number": R.number_rule,
          "date": R.date_text_rule, "exact": R.text_rule}


def rule_for_path(path: str, table_: dict = ORDER_RULES):
    """Rule by exact field path, default C3."""
    return _RULES[table_.get(path, "text")]


def rule_enum(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    prio = F.col("o_orderpriority")
    p_prio = (F.when(k % 4 == 0, F.lower(F.replace(F.replace(prio, F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))))
              .when(k % 4 == 1, F.concat(F.lit("  "), prio, F.lit(" ")))
              .when(k % 4 == 2, F.replace(prio, F.lit("-"), F.lit("")))
              .otherwise(prio))
    status = F.col("o_orderstatus")
    p_status = (F.when(k % 3 == 0, F.concat(F.lower(status), F.lit(".")))
                .when(k % 3 == 1, status).otherwise(F.lit("Z")))
    price = F.col("o_totalprice")
    p_price = (F.when(k % 4 == 0, F.format_string("%.2f", price))
               .when(k % 4 == 1, F.round(price).cast("long").cast("string"))
               .when(k % 4 == 2, F.lit("n/a")).otherwise(F.lit(None).cast("string")))
    checks = {
        "order.priority": (prio, p_prio, T.StringType()),
        "order.status": (status, p_status, T.StringType()),
        "order.totalprice": (price, p_price, T.DoubleType()),
    }
    outs = [rule_for_path(path)(g, p, gt, T.StringType()).alias("m_" + path.split(".")[1])
            for path, (g, p, gt) in checks.items()]
    return orders.select(k, p_prio.alias("pred_priority"), *outs)


SQL["rule_enum"] = f"""
WITH t AS (SELECT o_orderkey, o_orderpriority AS prio, o_orderstatus AS status, o_totalprice AS price,
  CASE o_orderkey % 4 WHEN 0 THEN lower(replace(replace(o_orderpriority, '-', '_'), ' ', '_'))
       WHEN 1 THEN '  ' || o_orderpriority || ' ' WHEN 2 THEN replace(o_orderpriority, '-', '')
       ELSE o_orderpriority END AS p_prio,
  CASE o_orderkey % 3 WHEN 0 THEN lower(o_orderstatus) || '.' WHEN 1 THEN o_orderstatus ELSE 'Z' END AS p_status,
  CASE o_orderkey % 4 WHEN 0 THEN printf('%.2f', o_totalprice) WHEN 1 THEN round(o_totalprice)::BIGINT::VARCHAR
       WHEN 2 THEN 'n/a' ELSE NULL END AS p_price
  FROM orders)
SELECT o_orderkey, p_prio AS pred_priority, {S.enum_rule('prio', 'p_prio')} AS m_priority,
       {S.text_rule('status', 'p_status')} AS m_status,
       {S.number_rule('price', 'p_price', g_numeric=True)} AS m_totalprice FROM t"""


# --- C6 + C2 ----------------------------------------------------------------

def rule_number(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    sel = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    q = F.col("l_quantity")
    whole = q.cast("long").cast("string")
    pred = (F.when(sel == 0, whole).when(sel == 1, F.format_string("%.1f", q))
            .when(sel == 2, F.lit("n/a")).when(sel == 3, F.lit(None).cast("string"))
            .otherwise(F.concat(whole, F.lit("d"))))
    return li.select("l_orderkey", "l_linenumber", pred.alias("qty_text"),
                     R.number_rule(q, pred, T.DoubleType(), T.StringType()).alias("m_number"))


SQL["rule_number"] = f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity,
  CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN l_quantity::BIGINT::VARCHAR
       WHEN 1 THEN printf('%.1f', l_quantity) WHEN 2 THEN 'n/a' WHEN 3 THEN NULL
       ELSE l_quantity::BIGINT::VARCHAR || 'd' END AS qty_text FROM lineitem)
SELECT l_orderkey, l_linenumber, qty_text, {S.number_rule('l_quantity', 'qty_text', g_numeric=True)} AS m_number FROM t"""


# --- C5, C9, C10 ------------------------------------------------------------

def rule_date(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    gold = F.date_format(d, "yyyy-MM-dd")
    pred = (F.when(k % 5 == 0, gold).when(k % 5 == 1, F.date_format(d, "MMMM d, yyyy"))
            .when(k % 5 == 2, F.date_format(d, "MMM d, yyyy"))
            .when(k % 5 == 3, F.date_format(d, "M/d/yyyy"))
            .otherwise(F.concat(gold, F.lit("T10:00:00Z"))))
    return orders.select(k, pred.alias("pred"), R.date_key(pred).alias("normalized"),
                         R.date_text_rule(gold, pred).alias("m_text"),
                         R.birthdate_rule(gold, pred).alias("m_birthdate"),
                         R.datetime_date_rule(gold, pred).alias("m_datepart"))


SQL["rule_date"] = f"""
WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS gold,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
       WHEN 1 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 2 THEN strftime(o_orderdate, '%b %-d, %Y')
       WHEN 3 THEN strftime(o_orderdate, '%-m/%-d/%Y')
       ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00Z' END AS pred FROM orders)
SELECT o_orderkey, pred, {S.date_key('pred')} AS normalized, {S.null_frame('gold', 'pred', 'gold = pred')} AS m_text,
       {S.birthdate_rule('gold', 'pred')} AS m_birthdate, {S.datetime_date_rule('gold', 'pred')} AS m_datepart
FROM t"""


# --- C8 ---------------------------------------------------------------------

def rule_state(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    idx = (k % 50).cast("int")
    names = F.array(*[F.lit(n) for _, n in US_STATES])
    codes = F.array(*[F.lit(c) for c, _ in US_STATES])
    gold = F.get(names, idx)
    sel = k % 7
    pred = (F.when(sel == 0, F.get(codes, idx)).when(sel == 1, F.upper(gold))
            .when(sel == 2, F.concat(F.lit("  "), F.lower(gold), F.lit(" ")))
            .when(sel == 3, gold).when(sel == 4, F.lit(None).cast("string"))
            .when(sel == 5, F.lit("")).otherwise(F.get(codes, ((idx + 1) % 50).cast("int"))))
    return cust.select(k, pred.alias("pred"), R.state_key(pred).alias("normalized"),
                       R.state_rule(gold, pred).alias("m_state"))


SQL["rule_state"] = f"""
WITH s AS (SELECT * FROM {S.state_values()}),
t AS (SELECT c.c_custkey, g.name AS gold,
  CASE c.c_custkey % 7 WHEN 0 THEN g.code WHEN 1 THEN upper(g.name) WHEN 2 THEN '  ' || lower(g.name) || ' '
       WHEN 3 THEN g.name WHEN 4 THEN NULL WHEN 5 THEN '' ELSE n.code END AS pred
  FROM customer c JOIN s g ON g.idx = c.c_custkey % 50 JOIN s n ON n.idx = (c.c_custkey % 50 + 1) % 50)
SELECT c_custkey, pred, {S.state_key('pred')} AS normalized, {S.state_rule('gold', 'pred')} AS m_state FROM t"""


# --- C7, C11, C12, C14 -------------------------------------------------------

def rule_lists(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    one = F.array(F.col("p_brand"))
    two = F.split(F.col("p_name"), " ")
    text = (F.when(k % 3 == 0, F.concat(F.upper("p_brand"), F.lit(" ")))
            .when(k % 3 == 1, F.col("p_brand")).otherwise(F.col("p_name")))
    lst = F.when(k % 2 == 0, two).otherwise(F.split(F.upper("p_name"), " "))
    typ = F.when(k % 2 == 0, F.concat(F.lower("p_type"), F.lit(" "))).otherwise(F.col("p_brand"))
    arr = T.ArrayType(T.StringType())
    return part.select(
        k, text.alias("pred_text"),
        R.list_vs_text_rule(one, text).alias("m_one"),
        R.list_vs_text_rule(two, text).alias("m_two"),
        R.list_rule(two, lst).alias("m_list"),
        R.casefold_rule(F.col("p_type"), typ).alias("m_casefold"),
        R.address_line_key(one, arr).alias("line_key_list"),
        R.address_line_key(text, T.StringType()).alias("line_key_text"))


SQL["rule_lists"] = f"""
WITH t AS (SELECT p_partkey, p_type, [p_brand] AS one, string_split(p_name, ' ') AS two,
  CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) || ' ' WHEN 1 THEN p_brand ELSE p_name END AS pred_text,
  CASE p_partkey % 2 WHEN 0 THEN string_split(p_name, ' ') ELSE string_split(upper(p_name), ' ') END AS lst,
  CASE p_partkey % 2 WHEN 0 THEN lower(p_type) || ' ' ELSE p_brand END AS typ FROM part)
SELECT p_partkey, pred_text, {S.list_vs_text_rule('one', 'pred_text')} AS m_one,
       {S.list_vs_text_rule('two', 'pred_text')} AS m_two, {S.list_rule('two', 'lst')} AS m_list,
       {S.casefold_rule('p_type', 'typ')} AS m_casefold,
       {S.address_line_key_list('one')} AS line_key_list, {S.address_line_key_text('pred_text')} AS line_key_text
FROM t"""
