"""Places of lines in files: order over files and blocks, dense numbers, last wins."""

import json
import random

import pytest

from goldtally.operators import keys, match
from goldtally.sources import io, json_array


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "2000")
    spark.conf.set(names[1], "1")
    yield spark
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def _files(folder):
    """Two files; keys repeat within and over files, lines are of uneven length, some are blank."""
    want = {}
    for name in ("a.json", "b.json"):
        lines = []
        for k in range(900):
            key = (k * 7) % 250 if name == "a.json" else (k * 3) % 200
            lines.append(json.dumps({"record_id": key, "v": f"{name}-{k}", "pad": "x" * (k % 60)}))
            want[key] = f"{name}-{k}"
            if k % 50 == 0:
                lines.append("")
        (folder / name).write_text("\n".join(lines) + "\n")
    return want


def test_last_line_of_last_file_wins(small_blocks, tmp_path):
    want = _files(tmp_path)
    rows = io.read_ndjson(small_blocks, str(tmp_path), "record_id BIGINT, v STRING", position="seq")
    assert rows.select("seq.file", "seq.block").distinct().count() > 20 and rows.rdd.getNumPartitions() > 4
    got = {r["record_id"]: r["v"] for r in match.prepare_predictions(rows).collect()}
    assert got == want


def test_line_numbers_are_dense_within_a_file(small_blocks, tmp_path):
    _files(tmp_path)
    rows = io.number_lines(io.read_ndjson(small_blocks, str(tmp_path), "v STRING", position="seq")).collect()
    assert len(rows) == 1800
    assert all(r["v"] == f"{r['seq']['file'].rsplit('/', 1)[1]}-{r['line'] - 1}" for r in rows)


def test_missing_seq_is_an_error(spark):
    pred = spark.createDataFrame([(1, "a"), (1, "b")], "record_id long, v string")
    with pytest.raises(ValueError):
        match.prepare_predictions(pred)
    assert match.prepare_predictions(pred, seq=None).count() == 2
    assert keys.last_wins(pred.withColumn("seq", pred.v), seq="seq").collect()[0]["v"] == "b"


def _records(n):
    rng = random.Random(9)
    texts = ["plain", "}", "]}", '"', "\\", '\\"}', "{[", "é}🙂", "a,b", "", "\\\\", "x" * 3000]
    return [{"k": k, "s": rng.choice(texts) + rng.choice(texts), "inner": {"list": [{"a": rng.choice(texts)} for _ in range(rng.randint(0, 3))]}} for k in range(n)]


SCHEMA = "k BIGINT, s STRING, inner STRUCT<list: ARRAY<STRUCT<a: STRING>>>"


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_file_is_read_by_many_tasks(small_blocks, tmp_path, indent):
    records = _records(400) + [{"k": 400, "s": "y}" * 6000, "inner": {"list": []}}] + _records(20)
    (tmp_path / "a.json").write_text(json.dumps(records, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("\ufeff \n[ ]\n", encoding="utf-8")
    (tmp_path / "d.json").write_text(json.dumps(records[:1]))
    frame = json_array.scan_json_array(small_blocks, str(tmp_path), SCHEMA, position="seq")
    assert frame.select("seq.block").distinct().count() > 20
    rows = [r.asDict(recursive=True) for r in frame.orderBy("seq").collect()]
    assert [{c: r[c] for c in ("k", "s", "inner")} for r in rows] == records + records[:1]


def test_states_compose():
    rng = random.Random(2)
    for _ in range(300):
        text = json.dumps(_records(3), indent=rng.choice([None, 1]))
        rows = text.split("}")[:-1]
        cut = rng.randint(0, len(rows))
        state, depth = json_array.OUT, 0
        for row in rows:
            state, change = json_array.step(row, state)
            depth += change
        assert (state, depth) == (json_array.OUT, 1)
        # a block's map, applied to the state before it, gives the state behind it
        parts = [(json_array.OUT, 0), (json_array.IN, 0)]
        for row in rows[cut:]:
            parts = [(s2, d + c) for s, d in parts for s2, c in [json_array.step(row, s)]]
        state, depth = json_array.OUT, 0
        for row in rows[:cut]:
            state, change = json_array.step(row, state)
            depth += change
        assert (parts[state][0], depth + parts[state][1]) == (json_array.OUT, 1)


def test_array_of_numbers_is_an_error(spark, tmp_path):
    (tmp_path / "n.json").write_text('[1, {"k": 2}]')
    with pytest.raises(Exception, match="must be objects"):
        json_array.scan_json_array(spark, str(tmp_path), SCHEMA).collect()
