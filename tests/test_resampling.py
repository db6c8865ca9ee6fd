"""Hashed draws of the bootstraps: digests against hashlib, sums against a plain loop, and nothing that is made for each unit and draw."""

import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.functions.digests import Endings
from plumbline.operators import resampling as S


def _digits(text: bytes) -> int:
    return int(hashlib.md5(text).hexdigest()[:13], 16)


def test_digests_of_all_lengths():
    texts = [b"", "ä中".encode() * 30, *(b"z" * k for k in range(140)), *(f":{k}:C{k % 4}".encode() for k in range(500))]
    endings = Endings(texts)
    for prefix in (b"", b"a:7", b"a:57", b"a:399", b"q" * 70):
        assert endings.digits(prefix).tolist() == [_digits(prefix + t) for t in texts]


@pytest.mark.parametrize("most", [4096, 3])
def test_weighted_sums_by_a_plain_loop(spark, monkeypatch, most):
    """Null criteria and units, many criteria in one batch, few keys at a time."""
    monkeypatch.setattr(S, "MAX_KEYS", most)
    rows = [(None if k % 7 == 0 else f"c{k % 9}", None if k == 12 else k, [(0, 0.0, float(k)), (4, float(k % 3), 2.0)]) for k in range(60)]
    got = S._weighted_sums(spark.createDataFrame(rows, "criterion string, unit long, entries array<struct<kind int, value double, amount double>>"), 12)
    wanted = defaultdict(float)
    for criterion, unit, entries in rows:
        for r in range(12):
            u = _digits(":".join(["a", str(r), *(str(x) for x in (unit, criterion) if x is not None)]).encode()) / 2**52
            for kind, value, amount in entries:
                wanted[criterion, kind, value, r] += amount * sum(u >= c for c in S.POISSON_ONE)
    assert {(x.criterion, x.kind, x.value, x.replicate): x.amount for x in got.collect()} == {k: pytest.approx(v) for k, v in wanted.items()}


@pytest.mark.parametrize("metric", ["interval", "nominal"])
def test_no_row_for_each_unit_and_draw(spark, metric):
    ratings = spark.range(400).select(F.lit("c").alias("criterion"), (F.col("id") % 200).alias("unit"), F.col("id").alias("rater"), (F.col("id") % 7 % 3).cast("double").alias("value"))
    found = S.bootstrap_alpha(ratings, metric)
    assert "md5" not in found._jdf.queryExecution().executedPlan().toString()
    row = found.first()
    assert row.n_defined == 400 and -1 < row.low < row.high < 1 and not math.isnan(row.low)


def test_draws_come_once_to_a_range(spark):
    """The lists of draws meet their range in one row, not with each of its units."""
    ratings = spark.range(4000).select(F.lit("c").alias("criterion"), (F.col("id") % 2000).alias("unit"), F.col("id").alias("rater"), (F.col("id") % 3).cast("double").alias("value"))
    plan = S.resample_sums(ratings, 50)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan
    assert set(S.resample_sums(ratings, 50).where("a is null").first().sums) == {2000.0}
