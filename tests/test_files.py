"""Files as a data source, and sinks that are replaced as a whole."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from plumbline.sources import files, records, versions


@pytest.fixture
def folder(tmp_path):
    """Good, bad, empty, hidden and unreadable files."""
    root = tmp_path / "bank"
    (root / "deep" / ".hidden").mkdir(parents=True)
    verdict = {"task_id": "t", "verdict": "PASS", "executed": True}
    for name, body in {"a.json": json.dumps(verdict).encode(), "b.json": b"{", "deep/c.json": b"", "d.json": b"\xff\xfe", "e.txt": b"x", ".f.json": b"x", "deep/.hidden/g.json": b"x", "_h.json": json.dumps(verdict | {"task_id": "u"}).encode()}.items():
        (root / name).write_bytes(body)
    return root


def test_every_file_is_a_row(spark, folder):
    found = files.read(spark, str(folder), "*.json")
    rows = {os.path.relpath(r.path, folder): (r.size, r.text, r.error) for r in found.collect()}
    assert set(rows) == {"a.json", "b.json", "deep/c.json", "d.json", "_h.json"}
    assert rows["deep/c.json"] == (0, "", None) and rows["b.json"] == (1, "{", None) and rows["d.json"][1] is None and "UnicodeDecodeError" in rows["d.json"][2]
    read = records.read_verdicts(spark, str(folder))  # Spark's own listing, as far as it sees them
    decoded = records.decode_verdicts(found.where("error is null"))
    assert {os.path.relpath(r.path, folder): r.error for r in records.bad(decoded).collect()} == {"b.json": "not a mapping", "deep/c.json": "not a mapping"}
    own = {r.task_id for r in records.good(decoded).collect()}
    assert own == {"t", "u"} and {r.task_id for r in records.good(read).collect()} <= own
    assert [r.error for r in files.read(spark, str(folder / "none"), "*").collect()] == ["there is no such folder"]
    assert files.read(spark, f"file://{folder}/a.json", "*").count() == 1


def test_partitions_and_conditions(spark, folder):
    for k in range(20):
        (folder / f"n{k:02}.yaml").write_text("x" * 100)
    files.register(spark)
    read = lambda n: spark.read.format(files.NAME).option("names", "*.yaml,*.yml").option("partitionBytes", n).load(str(folder))
    assert read(500).rdd.getNumPartitions() == 4 and read(10).rdd.getNumPartitions() == 20 and read(10**6).count() == 20
    some = read(10).where(F.col("path").endswith("n07.yaml") | F.col("path").endswith("n08.yaml"))
    one = read(10).where(F.col("path") == str(folder / "n07.yaml"))
    assert some.count() == 2 and one.count() == 1 and one.rdd.getNumPartitions() == 1 and read(10).where("size > 100").count() == 0


def test_stream_takes_each_file_once(spark, folder, tmp_path):
    def run(name):
        query = files.stream(spark, str(folder), "*.json").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        query.awaitTermination(120)
        return sorted(os.path.basename(r.path) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run("first")
    assert first == ["_h.json", "a.json", "b.json", "c.json", "d.json"]
    (folder / "new.json").write_text("{}")
    os.utime(folder / "new.json", (time.time() + 5, time.time() + 5))
    assert run("second") == sorted([*first, "new.json"])


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path)
    known = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    versions.upsert_into(path, known)
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id long, name string")
    for _ in range(2):  # a second try changes nothing more
        versions.upsert_into(path, new)
        assert sorted(map(tuple, versions.current(spark, path).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    broken = new.repartition(2).withColumn("name", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    before = versions.versions(spark, path)
    with pytest.raises(Exception, match="lost"):
        versions.upsert_into(path, broken)
    assert versions.versions(spark, path) == before and versions.current(spark, path).count() == 3
    assert sorted(os.listdir(path)) == sorted([versions.POINTER, f".{versions.POINTER}.crc", *(v["folder"] for v in before)]) or len([n for n in os.listdir(path) if n.startswith("version-")]) == 2
    with pytest.raises(versions.ChangedMeanwhile):
        versions.publish(known, path, before=[])


def test_write_back_metrics_and_verdicts(spark, tmp_path):
    tasks = spark.createDataFrame([("t", None), ("u", "old")], "task_id string, calibration string")
    versions.publish(tasks, str(tmp_path / "tasks"))
    versions.write_back_calibration(str(tmp_path / "tasks"), spark.createDataFrame([("t", "new")], "task_id string, calibration string"))
    assert sorted(map(tuple, versions.current(spark, str(tmp_path / "tasks")).collect())) == [("t", "new"), ("u", "old")]
    versions.write_metrics({"rate": spark.createDataFrame([(0.5, 4)], "rate double, n long"), "cells": spark.createDataFrame([("T1/cuda", 2), ("T2/jax", 0)], "cell string, n long")}, str(tmp_path / "metrics"))
    got = sorted([(r.metric, json.loads(r.row)) for r in versions.current(spark, str(tmp_path / "metrics")).collect()], key=str)
    assert got == [("cells", {"cell": "T1/cuda", "n": 2}), ("cells", {"cell": "T2/jax", "n": 0}), ("rate", {"rate": 0.5, "n": 4})]
    text = json.dumps({"task_id": "t", "verdict": "FAIL", "executed": True, "oracle_results": [{"oracle": "O1", "verdict": "FAIL", "reason": "off"}]})
    decoded = records.decode_verdicts(spark.createDataFrame([("a", text)], "path string, text string"))
    records.write_verdicts(records.good(decoded), str(tmp_path / "verdicts"))
    line = "".join(p.read_text() for p in (tmp_path / "verdicts").iterdir() if p.suffix == ".json")
    assert {k: v for k, v in json.loads(line).items() if k != "oracle_results"} == {"task_id": "t", "verdict": "FAIL", "executed": True} and json.loads(line)["oracle_results"][0]["reason"] == "off"
