"""Streams give what the batch operators give, whatever the order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.operators import reliability as R
from plumbline.streaming import sequences

SCHEMA = "criterion string, at timestamp, t long, x double, expected double"
END = ("end", 10**9, 0, 0.5, 1.0)


def _stream(spark, rows, folder, parts):
    """rows (criterion, at in seconds from some time on, t, x, expected) as a stream of so many micro-batches, in the order given; then one that ends it."""
    batches = [rows[k * len(rows) // parts : (k + 1) * len(rows) // parts] for k in range(parts)] + [[END]]
    for k, batch in enumerate(batches):
        frame = spark.createDataFrame([(c, 1e6 + at, *more) for c, at, *more in batch], SCHEMA.replace("at timestamp", "at double")).withColumn("at", F.timestamp_seconds("at"))
        frame.coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(str(folder / "in"))


def _result(stream, folder, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return [r for r in stream.sparkSession.table(name).collect() if r.criterion != "end"]


@pytest.mark.parametrize("kind", sorted(R.SEQUENCES))
def test_shuffled_stream_is_batch(spark, sf_dir, tmp_path, kind):
    """Micro-batches of rows in any order: rows wait for the watermark and are taken in event time."""
    some = B.stream(spark, sf_dir).where("criterion in ('G1', 'G7')").select("criterion", F.col("t").cast("long").alias("t"), "x")
    rows = [(r.criterion, r.t // 3, r.t, r.x, None) for r in some.collect()]
    random.Random(kind).shuffle(rows)
    got = _result(sequences.follow(_stream(spark, rows, tmp_path, 3), kind, late="10 hours"), tmp_path, f"seq_{kind}")
    wanted = {(r.criterion, r.t): (r.lo, r.hi) for r in R.SEQUENCES[kind](some).collect()}
    assert len(got) == len(wanted) == len(rows) and all(r.n == r.t for r in got)
    assert all((r.lo, r.hi) == pytest.approx(wanted[r.criterion, r.t], abs=1e-9) for r in got)


def test_rows_behind_the_watermark_and_idle_criteria(spark, tmp_path):
    """a's late row is left out; b begins anew after a pause, a doesn't."""
    rows = [("a", 0, 1, 0.5, None), ("b", 0, 1, 1.0, None), ("a", 200, 2, 0.5, None), ("a", 5, 9, 1.0, None), ("a", 300, 3, 1.0, None), ("b", 400, 2, 0.0, None)]
    got = _result(sequences.follow(_stream(spark, rows, tmp_path, 6), "hoeffding", late="50 seconds", idle_ms=250_000), tmp_path, "idle")
    assert sorted((r.criterion, r.t, r.n) for r in got) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1), ("b", 2, 1)]


def test_expected_disagreement_changes(spark, tmp_path):
    rows = [("a", 5, 5, 0.0, None), ("a", 1, 1, 0.5, None), ("a", 4, 4, None, 0.5), ("a", 2, 2, None, 0.25), ("a", 2, 2, 0.5, None), ("a", 3, 3, 0.25, None)]
    got = _result(sequences.follow_alpha(_stream(spark, rows, tmp_path, 2), 1.0, "hoeffding"), tmp_path, "monitored")
    got.sort(key=lambda r: (r.t, r.n))
    assert [(r.t, r.n, r.expected) for r in got] == [(1, 1, None), (2, 1, 0.25), (2, 2, 0.25), (3, 3, 0.25), (4, 3, 0.5), (5, 4, 0.5)]
    assert [r.t for r in got if r.alpha_lo is not None] == [2, 3, 5]
    last = got[-1]
    assert (last.alpha_lo, last.alpha_hi) == pytest.approx((1 - last.hi * 2, min(1, 1 - last.lo * 2)))


def test_wrong_observations_stop_the_stream(spark, tmp_path):
    stream = _stream(spark, [("a", 1, 1, 1.5, None)], tmp_path, 1)
    with pytest.raises(Exception, match="lie in"):
        _result(sequences.follow(stream), tmp_path, "wrong")
    with pytest.raises(ValueError):
        sequences.follow(stream, "none")
