"""Queries over small tables made here, against their SQL in DuckDB."""

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from goldtally.operators import align, extract, score
from goldtally.plans import insurance
from goldtally.sources import io
from goldtally.suite import bundles, claims, scoring


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


def check(spark, folder, name):
    """The query's rows are those of its SQL; the rows, for more checks."""
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, str(folder))
    assert sorted(got.columns) == sorted(columns)
    rows = _rows(got.columns, [tuple(r) for r in got.collect()])
    assert rows == _rows(columns, want.fetchall())
    return rows


def store(folder, name, sql):
    duckdb.connect().execute(f"COPY ({sql}) TO '{folder}/{name}.parquet'")


PART = """SELECT k::BIGINT AS p_partkey, 'blue ' || (k % 9) || ' red' AS p_name, 'LARGE Tin ' || k AS p_type, 'Brand#' || (k % 5) AS p_brand
          FROM range(1, 61) t(k)"""


@pytest.mark.parametrize("rows", [PART, f"{PART} UNION ALL {PART}"])
def test_financial_scorecard(spark, tmp_path, rows):
    store(tmp_path, "part", rows)
    assert len(check(spark, tmp_path, "financial_scorecard")) == 3


ORDERS = """SELECT k::BIGINT AS o_orderkey, k * 1.5 AS o_totalprice FROM range(1, 1500) t(k)"""
LINES = """SELECT (k // 3)::BIGINT AS l_orderkey, (k % 4)::INT AS l_linenumber, (k % 60 + 1)::BIGINT AS l_partkey, k::BIGINT AS l_suppkey,
                  (k % 50)::DOUBLE AS l_quantity, DATE '1995-01-01' + (k % 700)::INT AS l_shipdate FROM range(1, 400) t(k)"""


def test_line_numbers(spark, tmp_path):
    store(tmp_path, "orders", ORDERS)
    assert len(check(spark, tmp_path, "line_numbers")) == 3


def test_numbered_lines_do_not_move(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(f'{{"v": {i}}}\n' for i in range(50)))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = io.number_lines(io.read_ndjson(spark, str(tmp_path), "v INT", position="seq"))
        assert "SortMergeJoin" not in lines._jdf.queryExecution().executedPlan().toString()
        assert [(r["v"], r["line"]) for r in lines.orderBy("v").collect()] == [(i, i + 1) for i in range(50)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_pii_rows_are_spread(spark, tmp_path):
    """One file of keys in one group of rows becomes wide rows in several tasks."""
    store(tmp_path, "customer", "SELECT k::BIGINT AS c_custkey FROM range(1, 50001) t(k)")
    gold, pred = scoring._pii(spark, str(tmp_path))
    assert gold.rdd.getNumPartitions() >= 3 and pred.rdd.getNumPartitions() >= 3


def test_bundle_lists_join_once(spark, tmp_path):
    store(tmp_path, "part", PART)
    store(tmp_path, "lineitem", LINES)
    assert bundles.list_entries(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    assert len(check(spark, tmp_path, "bundle_lists")) == 2 * 399


def test_claim_lines_move_without_objects(spark):
    plan = claims._objects(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("Aggregate"):]
    assert "OBJ-" in plan and "OBJ-" not in grouped


def test_texts_are_taken_in_small_slices():
    batches = [pa.RecordBatch.from_pydict({"k": list(range(n))}) for n in (450, 0, 3)]
    got = list(extract._slices(batches, 200))
    assert [b.num_rows for b in got] == [200, 200, 50, 3]
    assert [k for b in got for k in b.column(0).to_pylist()] == [*range(450), *range(3)]


def test_patient_outcomes_are_stored(spark, monkeypatch):
    """Card and mismatches come from one stored table of outcomes."""
    stored = []
    monkeypatch.setattr(score, "stored_outcomes", lambda out: stored.append(out) or out)
    bundles.patient_scorecard(spark, "/root/testdata/sf0.001")
    assert len(stored) == 1


CLAIM_TABLES = {
    "customer": "SELECT k::BIGINT AS c_custkey, 'Customer ' || k AS c_name, 'BUILDING' AS c_mktsegment FROM range(0, 20) t(k)",
    "orders": """SELECT k::BIGINT AS o_orderkey, (k % 23)::BIGINT AS o_custkey, TIMESTAMP '1995-01-01' + INTERVAL (k % 900) DAY AS o_orderdate,
                        'OFP'[k % 3 + 1] AS o_orderstatus, '3-MEDIUM' AS o_orderpriority, k * 10.25 AS o_totalprice FROM range(0, 400) t(k)""",
    "lineitem": """SELECT (k % 390)::BIGINT AS l_orderkey, (k % 5)::BIGINT AS l_partkey, (k % 3)::BIGINT AS l_suppkey, (k // 390)::INT AS l_linenumber,
                          (k % 50)::DOUBLE AS l_quantity, 900.5 + k % 4 AS l_extendedprice, 0.1 AS l_discount, 0.0 AS l_tax,
                          'A' AS l_returnflag, 'OF'[k % 2 + 1] AS l_linestatus, TIMESTAMP '1995-02-01' AS l_shipdate FROM range(0, 1500) t(k)"""}


@pytest.fixture
def claims_kept(spark, tmp_path, monkeypatch):
    """Small claim tables, and what a query over them stores."""
    for name, sql in CLAIM_TABLES.items():
        store(tmp_path, name, sql)
    kept = {}
    for module in (align, claims):
        keep = module.store
        monkeypatch.setattr(module, "store", lambda df, name, keep=keep: kept.setdefault(name, keep(df, name)))
    return kept


def _done(kept):
    return kept["pairing"].schema["_done"].dataType.names


def test_error_table_stores_counts_and_sorts_nothing(spark, tmp_path, claims_kept):
    """Of a record without search, numbers and first messages by kind are stored; notes are not sorted by kind or key."""
    assert len(check(spark, tmp_path, "error_table")) == 8
    assert _done(claims_kept) == ["record_id", *insurance.KINDS]
    assert "lines" in claims_kept["claims"].columns and "gold_objects" not in claims_kept["claims"].columns
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        final = entry.queries()["error_table"](spark, str(tmp_path))
        assert "Sort [" not in final._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_error_table_counts_a_repeated_record_once(spark):
    note = lambda kind, message: (kind, message)
    rows = [(1, [note("wrong_value", "b"), note("wrong_value", "a")]), (1, [note("wrong_value", "c"), note("failed", "f")]),
            (2, [note("wrong_value", "d")]), (3, []), (None, [note("failed", "e")])]
    df = spark.createDataFrame(rows, "record_id long, notes array<struct<kind:string,message:string>>")
    noted = df.withColumns({k: insurance.notes_of_kind(df["notes"], k) for k in insurance.KINDS})
    got = {r["kind"]: tuple(r)[1:] for r in insurance.error_table(noted).collect()}
    assert got == {"wrong_value": (4, 2, "a"), "failed": (2, 1, "e")}


def test_invented_list_carries_and_stores_lists_only(spark, tmp_path, claims_kept):
    assert check(spark, tmp_path, "invented_list")
    assert claims_kept["claims"].columns == ["o_orderkey", "lines"]
    assert _done(claims_kept) == ["record_id", "seq", "_dyn"]


def test_align_pairs_carries_lists_and_stores_pairs_only(spark, tmp_path, claims_kept):
    assert len(check(spark, tmp_path, "align_pairs")) == 400
    assert claims_kept["claims"].columns == ["o_orderkey", "lines"]
    assert _done(claims_kept) == ["record_id", "n_gold", "n_pred", "assignment", "n_paired", "object_matches"]


def test_record_accuracy_stores_numbers_only(spark, tmp_path, claims_kept):
    assert len(check(spark, tmp_path, "record_accuracy")) == 400
    assert not {"g", "p", "_a_g", "_a_p"} & set(_done(claims_kept)) and len(_done(claims_kept)) == 9
