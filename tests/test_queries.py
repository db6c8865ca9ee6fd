"""Every measurement query against its SQL, and what SQL can't say against numbers worked out by hand."""

import itertools
import math
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibration, metrics, reliability, resampling, rubrics, seeds
from plumbline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(name, agree):
    agree(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"e04_jeffreys", "e15_resampled_alpha_ordinal", "e15_resampled_alpha_ratio"}  # tested below


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_pass_at_k(spark):
    """All n, c, k up to 12: one minus the share of k-subsets without a success."""
    grid = [(n, c, k) for n in range(1, 13) for c in range(n + 1) for k in range(1, n + 1)]
    rows = spark.createDataFrame(grid, "n long, c long, k long")
    for r in rows.select("n", "c", "k", calibration.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("p")).collect():
        assert r.p == pytest.approx(1 - math.comb(r.n - r.c, r.k) / math.comb(r.n, r.k), abs=1e-12)


def test_pass_at_k_beyond_n(spark):
    strict = calibration.pass_at_k(F.col("n"), F.col("c"), F.col("k"), clamp=False)
    rows = lambda *r: spark.createDataFrame([r], "n long, c long, k long").select(strict).collect()[0][0]
    assert rows(4, 1, 4) == 1.0 and rows(4, 1, 2) == pytest.approx(0.5)
    with pytest.raises(Exception, match="k is beyond n: 5 > 4"):
        rows(4, 1, 5)


def test_stages(spark):
    owners = lambda layers, stages: [r[0] for r in spark.range(layers).orderBy("id").select(seeds.stage_of(F.col("id"), F.lit(layers), F.lit(stages))).collect()]
    assert owners(5, 2) == [0, 0, 0, 1, 1] and owners(4, 4) == [0, 1, 2, 3] and owners(2, 5) == [0, 2]
    assert owners(49, 49) == list(range(49))


def test_rules_worked_by_hand(spark):
    cells = [("T1", "checkpointing", "O1,O3,O4,O5"), ("T2", "data_pipeline", "O1,O3"), ("T4", "data_pipeline", "O1,O2,O3,O4"), ("T5", "cuda", "O1,O3,O4"), ("T6", "jax", "O1,O3,O4,O5"), ("T3", "distributed", "O1,O3,O5")]
    for r in spark.createDataFrame(cells, "tier string, domain string, wanted string").withColumn("got", F.array_join(rubrics.oracles_for(F.col("tier"), F.col("domain")), ",")).collect():
        assert r.got == r.wanted
    shapes = [(1, "a", 1, "detect"), (1, "b", 2, "decoy"), (1, "c", 3, "detect"), (1, "d", 4, "decoy"), (2, "e", 1, "decoy"), (2, "f", 2, "decoy"), (2, "g", 3, "decoy")]
    got = rubrics.performance_shapes(spark.createDataFrame(shapes, "task_id long, name string, ord long, role string"), 2)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 2), (1, "c", 1), (2, "f", 2), (2, "g", 1)]
    equal = spark.createDataFrame([(1, "x", 9, 5, True), (1, "y", 9, 5, True), (1, "z", 10, 9, False)], "task_id long, name string, bytes long, flops long, usable boolean")
    assert rubrics.dearest_shape(equal).first().name == "y"
    texts = spark.createDataFrame([(" a  b\nc ",), ("x" * 240,), ("x" * 241,)], "t string")
    assert [r[0] for r in texts.select(rubrics.truncate(F.col("t"))).collect()] == ["a b c", "x" * 240, "x" * 237 + "..."]
    assert texts.limit(1).select(rubrics.neutral_links(F.lit("see http://a//b"))).first()[0] == "see http:&#47;&#47;a//b"


def _beta_cdf(x, a, b, steps=40_000):
    """By the midpoint rule on x = sin(u)**2, where the density has no poles for a, b >= 1/2."""
    top = math.asin(math.sqrt(x))
    log_c = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    h = top / steps
    return sum(2 * math.exp(log_c + (2 * a - 1) * math.log(math.sin(u)) + (2 * b - 1) * math.log(math.cos(u))) for u in ((k + 0.5) * h for k in range(steps))) * h


@pytest.mark.parametrize("n,c", [(8, 3), (20, 19), (50, 1)])
def test_jeffreys_tails(spark, n, c):
    out = calibration.jeffreys(spark.createDataFrame([(1, n, c)], "item long, n long, c long")).first()
    assert _beta_cdf(out.low, c + 0.5, n - c + 0.5) == pytest.approx(0.025, abs=1e-4)
    assert _beta_cdf(out.high, c + 0.5, n - c + 0.5) == pytest.approx(0.975, abs=1e-4)


def test_probe_walk(spark):
    doc = '{"a": {"b": [1, 2.5, {"c": true}]}, "n": null}'
    ways = [("a.b.0", "1"), ("a.b.-2", "2.5"), ("a.b.2.c", "true"), ("a.x", None), ("a.b.9", None), ("n", None), ("a.b.0.c", None)]
    rows = spark.createDataFrame([(doc, k) for k, _ in ways], "doc string, way string")
    got = [r[0] for r in rows.select(rubrics.walk(F.col("doc"), F.split("way", r"\."))).collect()]
    assert [None if g == "null" else g for g in got] == [w for _, w in ways]


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0, 8.0, 16.0], [1.0, 2.0, 4.0, 8.0], [-1.0, 0.0, 0.0, 3.0, 3.0], [7.0]])
def test_bootstrap_medians_against_all_resamples(spark, values):
    rows = spark.createDataFrame([("s", "x", v) for v in [*values, None, float("nan"), float("inf")]], "shape string, side string, seconds double")
    draws = 8000
    got = Counter(r["median"] for r in resampling.bootstrap_medians(rows, draws).collect())
    all_of_them = Counter(median(c) for c in itertools.product(values, repeat=len(values)))
    assert sum(got.values()) == draws and set(got) <= set(all_of_them)
    for m, k in all_of_them.items():
        assert got[m] / draws == pytest.approx(k / len(values) ** len(values), abs=0.02)
    one = resampling.median_ci(rows, 100).first()
    assert one.n == len(values) and one["median"] == median(values)
    assert resampling.median_ci(rows.limit(0), 100).count() == 0


# The published reliability data: three observers, 15 units, blanks where nobody rated.
_RATED = {"A": [None] * 5 + [3, 4, 1, 2, 1, 1, 3, 3, None, 3], "B": [1, None, 2, 1, 3, 3, 4, 3] + [None] * 7, "C": [None, None, 2, 1, 3, 4, 4, None, 2, 1, 1, 3, 3, None, 4]}


@pytest.mark.parametrize("metric,wanted", [("nominal", 0.691), ("ordinal", 0.807), ("interval", 0.811)])
def test_published_alpha(spark, metric, wanted):
    rows = [("k", u, r, float(v)) for r, values in _RATED.items() for u, v in enumerate(values) if v is not None]
    out = reliability.alpha(spark.createDataFrame(rows, "criterion string, unit long, rater string, value double"), metric).first()
    assert out.alpha == pytest.approx(wanted, abs=1e-3)


@pytest.mark.parametrize("metric", reliability.METRICS)
def test_resampled_alpha_against_all_resamples(spark, monkeypatch, metric):
    """Four units, 256 resamples: shares without variation and quantiles agree; as many draws as units, in one range or in many."""
    rated = {1: [1.0, 2.0], 2: [2.0, 2.0, 4.0], 3: [4.0, 4.0], 4: [2.0, 2.0]}
    rows = [("a", u, i, v) for u, values in rated.items() for i, v in enumerate(values)]
    every = spark.createDataFrame([(f"{n}", f"{k}", i, v) for n, pick in enumerate(itertools.product(rated, repeat=4)) for k, u in enumerate(pick) for i, v in enumerate(rated[u])], "criterion string, unit string, rater long, value double")
    alphas = [r.alpha for r in reliability.alpha(every, metric).collect()]
    defined = sorted(round(a, 9) for a in alphas if a is not None)
    share = 1 - len(defined) / 256
    ratings = spark.createDataFrame(rows, "criterion string, unit long, rater long, value double")
    for units in (2048, 1):
        monkeypatch.setattr(resampling, "RANGE_UNITS", units)
        sums = resampling.resample_sums(ratings, 3000).where("a is null").first().sums
        assert set(sums) == {4.0} and len(sums) == 3000
        got = resampling.resample_alpha(ratings, metric, 3000, 0.7).first()
        assert got.n_defined + got.n_undefined == 3000 and abs(got.n_undefined / 3000 - share) < 4 * math.sqrt(share * (1 - share) / 3000) + 1e-12
        for end, tail in ((got.low, 0.15), (got.high, 0.85)):
            below, upto = (sum(1 for a in defined if c(a)) / len(defined) for c in (lambda a: a < end - 1e-6, lambda a: a <= end + 1e-6))
            assert below - 0.03 <= tail <= upto + 0.03


def test_payloads_worked_by_hand(spark):
    said = ['{"attacks": [{"id": "x", "caught": true}, {"catcher": "O1"}, {"id": "z", "caught_by": ""}, {}, null]}', '{"n_caught": 3, "n_attacks": 4, "uncaught": ["q"]}', '{"caught": 1, "total": 2}', '{"attacks": []}', "3", None, '{"total": 5}']
    rows = metrics.redteam_payloads(spark.createDataFrame(list(enumerate(said)), "k long, payload string")).orderBy("k").collect()
    assert [(r.n_caught, r.n_attacks, r.uncaught, r.catch_rate) for r in rows] == [(2, 4, ["z", "attack_3"], 0.5), (3, 4, ["q"], 0.75), (1, 2, [], 0.5), (0, 0, [], None), (0, 0, [], None), (0, 0, [], None), (0, 0, [], None)]
    times = {'{"sme": {"hours": 1.5, "minutes": 9}, "sme_hours": 4}': 1.5, '{"sme": {"hours": "1"}, "sme_hours": 4}': 4.0, '{"sme_hours": null, "sme_seconds": 7200}': 2.0, '{"sme": 3}': None, '{"sme": {"sme_minutes": 30}}': 0.5, "": None, '{"sme_hours": false}': None}
    for r in spark.createDataFrame([(k,) for k in times], "p string").select("p", metrics.provenance_hours(F.col("p")).alias("h")).collect():
        assert r.h == (None if times[r.p] is None else pytest.approx(times[r.p]))


def test_headline_figures_read_the_universe_once(spark, sf_dir):
    plan = registry.QUERIES["a11_all_metrics"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == plan.count("nation.parquet") == 1
