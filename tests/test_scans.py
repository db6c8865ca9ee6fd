"""Scans over range partitions: a group in many parts, many groups in one, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import sequences
from plumbline.operators import reliability as R
from plumbline.operators import scans


@pytest.fixture
def many_parts(spark):
    """Shuffles of 23 partitions that stay as they are."""
    for key, value in (("spark.sql.shuffle.partitions", "23"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(key, value)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _rows():
    draw = np.random.default_rng(2)
    sizes = {"long": 3000, "short": 7, "one": 1, None: 40, "shift": 600}
    return [(k, t, 0.0 if k == "shift" and t < 300 else 1.0 if k == "shift" else float(draw.random())) for k, n in sizes.items() for t in range(n)]


@pytest.mark.parametrize("kind", sorted(sequences.SEQUENCES))
def test_a_group_in_many_parts(spark, many_parts, kind):
    rows = _rows()
    stream = spark.createDataFrame(rows, "criterion string, t long, x double").repartition(5, "x")
    laid = scans.laid_out(stream, ["criterion"], ["t"])
    assert laid.where("criterion = 'long'").select(scans._PART).distinct().count() > 10
    got = {(r.criterion, r.t): (r.n, r.lo, r.hi, r.failed) for r in R.follow(stream, kind).collect()}
    assert len(got) == len(rows)
    for key in {k for k, _, _ in rows}:
        own = sorted((t, x) for k, t, x in rows if k == key)
        sequence = sequences.SEQUENCES[kind]()
        lo, hi, failed = sequence.step(sequence.zero(), np.array([x for _, x in own]))
        assert [got[key, t][0] for t, _ in own] == list(range(1, len(own) + 1))
        assert np.allclose([got[key, t][1:3] for t, _ in own], np.stack([lo, hi], axis=1), atol=1e-9)
        assert [got[key, t][3] for t, _ in own] == failed.tolist()
    if kind == "betting":  # all candidates rejected: nothing holds any more
        assert got["shift", 599][1:] == (0.0, 1.0, True) and not got["shift", 299][3]
    assert R.follow(stream.where("false"), kind).count() == 0


def test_wrong_observations(spark):
    for x in (1.5, -0.1, float("nan"), None):
        with pytest.raises(Exception, match="lie in"):
            R.follow(spark.createDataFrame([("a", 1, x)], "criterion string, t long, x double"), "hoeffding").collect()


@pytest.mark.parametrize("metric", R.METRICS)
def test_running_alpha_is_alpha_of_every_prefix(spark, many_parts, monkeypatch, metric):
    """By the batch operator on each prefix; ties, values that come late, units with one rating and many, in one part and in many."""
    monkeypatch.setattr(R, "ALPHA_CELLS", 256)
    draw = np.random.default_rng(4)
    rows = [("a", unit, rater, float(draw.integers(0, 3 + unit // 4) / 2)) for unit in range(30) for rater in range(int(draw.integers(1, 5)))]
    rows += [("b", unit, rater, 1.0) for unit in range(4) for rater in range(2)] + [("c", 1, 1, 2.0), ("c", 2, 1, None), ("c", 2, 2, 3.0)]
    ratings = spark.createDataFrame(rows, "criterion string, unit long, rater long, value double")
    got = {(r.criterion, r.unit): (r.ord, r.alpha) for r in R.running_alpha(ratings, metric).collect()}
    prefixes = spark.range(30).withColumnRenamed("id", "upto").join(ratings, F.col("unit") <= F.col("upto")).withColumn("criterion", F.concat_ws(":", "criterion", "upto"))
    wanted = {r.criterion: r.alpha for r in R.alpha(prefixes, metric).collect()}
    units = {"a": sorted({u for k, u, _, _ in rows if k == "a" and sum(r[:2] == ("a", u) for r in rows) > 1}), "b": [0, 1, 2, 3], "c": []}
    assert sorted(got) == [(k, u) for k in "abc" for u in units[k]]
    for (k, u), (place, value) in got.items():
        assert place == units[k].index(u) + 1
        assert value == wanted[f"{k}:{u}"] or math.isclose(value, wanted[f"{k}:{u}"], abs_tol=1e-9)


def test_places_over_partitions(spark, many_parts):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("y")).repartition(6)
    got = scans.numbered(rows, [F.desc("x"), "y"], "place").collect()
    assert sorted(r.place for r in got) == list(range(1, 1001)) and all(r.place == 1000 - r.x for r in got)
    assert scans.numbered(rows.where("false"), ["x"], "place").count() == 0


def test_units_stay_spread_over_tasks(spark, many_parts):
    """Units that all have the same two values: no shuffle brings them together by value or by criterion."""
    ratings = spark.range(40_000).select(F.lit("a").alias("criterion"), (F.col("id") % 20_000).alias("unit"), F.floor(F.col("id") / 20_000).alias("rater"), F.when(F.col("id") % 20_000 == 7, F.col("id") / 20_000).otherwise(1.0).alias("value"))
    for found in (R.disagreement(ratings), R.rater_pairs(ratings), R._monitor(ratings, "ordinal", "eb")[1]):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(criterion#" not in plan or all("unit#" in x.split(")")[0] for x in plan.split("hashpartitioning(criterion#")[1:])
    assert [r.unit for r in R.worst_units(ratings).collect()] == [7]
    last = R.monitor_summary(ratings).first()
    assert (last.units, last.n, last.equal_ratings) == (20_000, 20_000, True)
