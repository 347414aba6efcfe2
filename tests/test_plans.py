"""Plan shapes that matter at scale (checked on the physical plan text)."""

from pyspark.sql import functions as F

from goldtally.operators import keys, match, score
from goldtally.plans.comparison import exact_checks
from goldtally.suite.common import customer_gold, customer_pred, table

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _scored(spark):
    cust = table(spark, SF, "customer")
    m = match.match_records(customer_gold(cust), customer_pred(cust))
    checks = exact_checks(m)
    return score.outcomes(m, checks), checks, cust


def test_mismatch_top10_is_limited_before_the_shuffle(spark):
    out, checks, _ = _scored(spark)
    plan = _plan(score.first_mismatches(out, checks))
    assert "WindowGroupLimit" in plan


def test_scan_reads_only_needed_columns(spark):
    cust = table(spark, SF, "customer")
    df = match.match_records(customer_gold(cust).select("record_id", "seq", "c_name"),
                             customer_pred(cust).select("record_id", "seq", "c_name"))
    plan = _plan(df)
    assert "c_acctbal" not in plan and "c_mktsegment" not in plan


def test_last_wins_aggregates_partially(spark):
    cust = table(spark, SF, "customer")
    plan = _plan(keys.last_wins(customer_pred(cust).where(F.col("record_id").isNotNull())))
    assert "partial_max_by" in plan


def test_coverage_is_one_full_outer_join(spark):
    cust = table(spark, SF, "customer")
    plan = _plan(match.coverage(customer_gold(cust), customer_pred(cust)))
    assert "FullOuter" in plan and "LeftAnti" not in plan


def test_row_index_is_dense_and_right_with_payload(spark):
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    got = keys.with_record_id(orders, ["o_orderdate", "o_orderkey"], num_partitions=16).toPandas()
    want = orders.toPandas().sort_values(["o_orderdate", "o_orderkey"])
    assert got.sort_values("record_id")["o_orderkey"].tolist() == want["o_orderkey"].tolist()
    assert sorted(got["record_id"]) == list(range(1, len(want) + 1))


def test_row_index_without_an_order_keeps_file_order(spark):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    got = keys.with_row_index(orders).toPandas().sort_values("record_id")
    assert got["o_orderkey"].tolist() == orders.toPandas()["o_orderkey"].tolist()


def test_last_wins_with_null_seq(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "b", None), (2, "c", 5)], "record_id long, v string, seq long")
    got = {r.record_id: r.v for r in keys.last_wins(df).collect()}
    assert got == {1: "a", 2: "c"}


def test_objects_are_normalised_once_and_the_matrix_is_stored(spark, tmp_path):
    from goldtally.suite import claim_queries

    plan = _plan(claim_queries.align_pairs(spark, SF))
    # matrix, direct pairing and keys are read from the stored frame, by one scan for each half
    assert "regexp_replace" not in plan and "HashAggregate" not in plan and plan.count("FileScan parquet") == 2
