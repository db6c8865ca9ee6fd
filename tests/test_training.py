"""Steps that stop and go on."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import seeds, training
from plumbline.sources import versions


def _values(state):
    return {(r.name, r.rank * r.per + r.offset): (r.w, r.m, r.v) for r in state.collect()}


def test_trajectory_goes_on_where_it_stopped(spark, tmp_path):
    """A step fails, another run goes on, shards are dealt to other ranks in between: the same numbers as without a break."""
    rows = [(name, i, 1.0 + i, 0.0, 0.0) for name, n in (("a", 7), ("b", 1)) for i in range(n)]
    start = training.shard(spark.createDataFrame(rows, "name string, idx long, w double, m double, v double"), 4).drop("idx")

    def step(fails_at=None):
        def moved(state, number):
            whole = state.withColumn("idx", F.col("rank") * F.col("per") + F.col("offset"))
            after = training.adam_step(whole, whole.select("name", "idx", (F.col("w") - 3).alias("g")), number, rate=0.1)
            out = whole.select("name", "idx", "rank", "per", "offset").join(after, ["name", "idx"]).drop("idx")
            return out.withColumn("w", F.when((F.lit(number) == fails_at) & (F.col("name") == "b"), F.raise_error(F.lit("lost"))).otherwise(F.col("w"))) if fails_at else out

        return moved

    straight = _values(training.resumable(str(tmp_path / "straight"), start, step(), 6))
    path = str(tmp_path / "broken")
    with pytest.raises(Exception, match="lost"):
        training.resumable(path, start, step(3), 6)
    assert versions.versions(spark, path)[-1]["number"] == 2
    half = _values(training.resumable(path, start, step(), 4))
    again = training.reshard_saved(path, 3)
    assert _values(again) == half and again.agg(F.max("rank")).first()[0] == 2 and versions.versions(spark, path)[-1]["number"] == 4
    got = _values(training.resumable(path, start, step(), 6))
    assert set(got) == set(straight) and all(got[k] == pytest.approx(straight[k], abs=1e-12) for k in got)
    assert _values(training.resumable(path, start, step(9), 6)) == got
    with pytest.raises(ValueError):
        training.resumable(path, start, step(), 5)


def test_rows_are_dealt_as_numbers_are(spark):
    """Each row at the places of its number; one row, none, fewer than ranks, the last batches dropped."""
    for n, world, batch, drop in ((29, 3, 4, False), (29, 3, 4, True), (1, 2, 2, False), (2, 5, 2, False), (2, 5, 2, True), (0, 2, 2, False)):
        rows = spark.range(n).select((F.col("id") * 10).alias("key"))
        got = sorted(tuple(r) for r in seeds.deal(rows, ["key"], world, batch, 3, 2, drop).collect())
        wanted = sorted((r.epoch, r.rank, r.batch, r.pos, r.sample * 10) for r in seeds.batch_stream(spark, n, world, batch, 3, 2, drop).collect())
        assert got == wanted
