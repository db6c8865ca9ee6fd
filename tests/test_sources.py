"""Readers, their errors, and the way back."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import records

TASK = """task_id: t1
created_utc: '2026-01-01T00:00:00+00:00'
seed_source: {seed_id: s, module: m, entry: e, content_sha256: x}
domain: cuda
failure_tier: T5
mutation: {cls: accum_dtype, site: here, params: {a: 1}, description: d}
baseline_code: b
mutant_code: m
ground_truth_diff: d
prompt: find it
detect_shapes: [{name: r4_c1, kwargs: {m: 4}}]
"""


def test_tasks(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.yaml").write_text(TASK)
    for name, text in {"b.yml": ": : [", "c.yaml": "- 1", "d.yaml": TASK + "more: 1\n", "e.yaml": TASK.replace("T5", "T9"), "f.yaml": TASK.replace("find it", "see r4_c1"), "g.yaml": TASK.replace("task_id: t1\n", ""), "h.yaml": "", ".i.yaml": "x", "j.txt": "x"}.items():
        (tmp_path / name).write_text(text)
    read = records.read_tasks(spark, str(tmp_path))
    said = {r.path.rsplit("/", 1)[1]: r.error for r in records.bad(read).collect()}
    assert said.pop("b.yml").startswith("not valid YAML")
    assert said == {"c.yaml": "not a mapping", "d.yaml": "unknown field: more", "e.yaml": "unknown tier: T9", "f.yaml": "the prompt names a withheld shape", "g.yaml": "missing field: task_id"}
    kept = records.good(read)
    row = kept.first()
    assert (row.task_id, row.domain, row.detect_shapes[0]["name"], json.loads(row.mutation["params"])) == ("t1", "cuda", "r4_c1", {"a": 1})
    records.write_tasks(kept, str(tmp_path / "out"))
    again = records.decode_tasks(records.texts(spark, str(tmp_path / "out"), "*.txt"), many=True)
    assert records.good(again).drop("path").collect() == kept.drop("path").collect()


def test_verdicts(spark, tmp_path):
    ok = {"task_id": "t", "verdict": "FAIL", "executed": True, "oracle_results": [{"oracle": "O1", "verdict": "FAIL", "reason": "off", "duration_s": 1.5}]}
    mute = {**ok, "oracle_results": [{"oracle": "O1", "verdict": "SKIP", "reason": " "}]}
    for name, text in {"a": json.dumps(ok), "b": "{", "c": json.dumps({**ok, "verdict": "OK"}), "d": json.dumps(mute), "e": json.dumps({**ok, "executed": None}), "f": json.dumps({**ok, "x": 1}), "g": "", "h": json.dumps({**ok, "duration_s": "long"})}.items():
        (tmp_path / f"{name}.json").write_text(text)
    read = records.read_verdicts(spark, str(tmp_path))
    assert {r.path[-6:-5]: r.error for r in records.bad(read).collect()} == {"b": "not a mapping", "c": "unknown verdict: OK", "d": "a result other than PASS has no reason", "e": "missing field: executed", "f": "unknown field: x", "h": "a value is of the wrong type"}
    assert [(r.task_id, r.oracle_results[0]["duration_s"]) for r in records.good(read).collect()] == [("t", 1.5)]


def test_empty_texts_are_errors(spark):
    files = spark.createDataFrame([("a", ""), ("b", None)], "path string, text string")
    for decode in (records.decode_tasks, records.decode_verdicts):
        assert {r.path: r.error for r in records.bad(decode(files)).collect()} == {"a": "not a mapping", "b": "not a mapping"}


def test_ratings(spark):
    files = spark.createDataFrame([("a", "rater,i1,i2,i3\n\nalice,1,2,\nbob,1,NA,5\n"), ("b", "1,2\n3,-\n"), ("c", "1,2\n3\n"), ("d", "1,x\n2,3\n"), ("e", " \n"), ("f", "p,q\n")], "path string, text string")
    rows = records.decode_ratings(files).collect()
    cells = lambda p: [(r.rater, r.unit, r.name, r.value) for r in rows if r.path == p]
    assert cells("a") == [(1, 1, "i1", 1.0), (1, 2, "i2", 2.0), (1, 3, "i3", None), (2, 1, "i1", 1.0), (2, 2, "i2", None), (2, 3, "i3", 5.0)]
    assert cells("b") == [(1, 1, None, 1.0), (1, 2, None, 2.0), (2, 1, None, 3.0), (2, 2, None, None)]
    assert {r.path: r.error for r in rows if r.error} == {"c": "rows of unequal length", "d": "row 1, column 2 is not a number", "e": "no rows", "f": "a header but no ratings"}


def test_ratings_of_many_small_files(spark):
    """One pass over the texts, nothing shuffled, and far fewer Arrow batches than files."""
    text = F.when(F.col("id") % 3 == 0, "who,first\n\nr1,7\nr2,NA\n").when(F.col("id") % 3 == 1, F.concat(F.lit("0x1p3, 1e2\nInfinity,-\n"), F.col("id").cast("string"), F.lit(",nan\n"))).otherwise("r1,2\nr2,3,4\n")
    got = records.decode_ratings(spark.range(60_000).select(F.col("id").cast("string").alias("path"), text.alias("text")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapIn") == 1 and "Exchange" not in plan
    sums = {(r.error, r.rater, r.unit, r.name): (r.n, r.total) for r in got.groupBy("error", "rater", "unit", "name").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    n = 20_000
    assert sums == {
        (None, 1, 1, "first"): (n, 7.0 * n), (None, 2, 1, "first"): (n, None), (None, 1, 1, None): (n, 8.0 * n), (None, 1, 2, None): (n, 100.0 * n),
        (None, 2, 1, None): (n, math.inf), (None, 2, 2, None): (n, None), (None, 3, 1, None): (n, sum(range(1, 60_000, 3))), (None, 3, 2, None): (n, None), ("rows of unequal length", None, None, None): (n, None),
    }


def test_profiles(spark):
    log = '==PROF== x\n"Kernel Name","Metric Name","Metric Unit","Metric Value"\n"k1","dram","byte","1,200"\n"k2","dram","byte","800"\n"k2","dram","byte","n/a"\n"k1"\n'
    row = records.decode_profiles(spark.createDataFrame([("p", log), ("q", "nothing")], "path string, text string")).collect()
    assert [tuple(r) for r in row] == [("p", "dram", "byte", 2, 800.0, 1200.0, 1000.0, 2, 1)]


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(100_000, dtype=np.float32).reshape(2, -1))
    rows = records.read_arrays(spark, str(tmp_path)).orderBy("start").collect()
    assert [r.start for r in rows] == [0, records.CHUNK] and rows[0]["shape"] == [2, 50_000]
    assert np.array_equal(np.concatenate([r["values"] for r in rows]), np.arange(100_000))


def test_attacks_and_side_input(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"attacks": [{"id": "a", "name": "x"}, {"id": "b", "name": "y"}]}')
    (tmp_path / "bad.json").write_text("{nope")
    known = records.read_attacks(spark, str(tmp_path / "ok.json"), "id string, name string")
    new = spark.createDataFrame([("b", "z"), ("c", "w")], "id string, name string")
    assert sorted(map(tuple, records.upsert(known, new).collect())) == [("a", "x"), ("b", "z"), ("c", "w")]
    with pytest.raises(Exception):  # noqa: B017
        records.read_attacks(spark, str(tmp_path / "bad.json"), "id string, name string").collect()
    assert records.side_input(spark, str(tmp_path / "ok.json"))[0]["attacks"][1]["id"] == "b"
    assert records.side_input(spark, str(tmp_path / "none.json")) == (None, f"{tmp_path}/none.json (not found)")
    assert records.side_input(spark, str(tmp_path / "bad.json"))[0] is None


def test_calibration_write_back(spark):
    tasks = spark.createDataFrame([("a", "old"), ("b", None), ("c", "old")], "task_id string, calibration string")
    new = spark.createDataFrame([("a", "new"), ("b", "new")], "task_id string, calibration string")
    assert sorted(map(tuple, records.with_calibration(tasks, new).select(*map(F.col, tasks.columns)).collect())) == [("a", "new"), ("b", "new"), ("c", "old")]
