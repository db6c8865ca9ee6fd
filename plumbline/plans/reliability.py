"""Registered queries of the reliability operators and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.operators import reliability as R

_R = lambda df, *names, to=6: df.withColumns({n: F.round(n, to) for n in names})


def _alpha(metric):
    return lambda s, d: _R(R.alpha(B.ratings(s, d), metric), "d_o", "d_e", "alpha")


def _some_unrated(s, d):
    """ratings, and criteria that were rated once a unit, or always alike, or by two raters each."""
    r = B.ratings(s, d)
    more = lambda name, where, value: r.where(where).select(F.lit(name).alias("criterion"), "unit", "rater", value.alias("value"))
    return r.unionByName(more("D0", "rater = 1", F.lit(2.0))).unionByName(more("D1", "rater <= 2 and unit % 4 = 1", (F.col("unit") % 3 + F.col("rater") % 2).cast("double")))


def _running(metric):
    return lambda s, d: R.running_alpha(B.ratings(s, d), metric).withColumn("alpha", F.round("alpha", 6) + 0.0)


def _criteria(s, d):
    return s.createDataFrame([("C0", False), ("C1", True), ("C8", True), ("C9", False)], "criterion string, machine boolean")


QUERIES = {
    "p08_usable_units": lambda s, d: R.usable(B.ratings(s, d)).groupBy("criterion").agg(F.countDistinct("unit").alias("units"), F.count("*").alias("ratings")),
    "j08_rater_pairs": lambda s, d: R.rater_pairs(B.ratings(s, d), "interval").select("criterion", "unit", F.col("rater_a").cast("long").alias("rater_a"), F.col("rater_b").cast("long").alias("rater_b"), F.round("d2", 6).alias("d2")),
    "j09_differences": lambda s, d: R.differences(R.marginals(R.unit_counts(B.ratings(s, d))), "ordinal").select("criterion", "c", "k", F.round("d2", 6).alias("d2")),
    "w02_marginals": lambda s, d: R.marginals(R.unit_counts(B.ratings(s, d))),
    "a21_coincidences": lambda s, d: _R(R.coincidences(R.unit_counts(B.ratings(s, d))), "o"),
    **{f"e13_alpha_{m}": _alpha(m) for m in R.METRICS},
    "e14_differences_ratio": lambda s, d: R.differences(R.marginals(R.unit_counts(B.ratings(s, d))), "ratio").select("criterion", "c", "k", F.round("d2", 9).alias("d2")),
    "e16_alpha_by_criterion": lambda s, d: R.alpha(B.ratings(s, d)).select("criterion", F.round("alpha", 6).alias("alpha"), "reason"),
    "e17_disagreement": lambda s, d: _R(R.disagreement(B.ratings(s, d)), "x"),
    "t04_worst_units": lambda s, d: R.worst_units(B.ratings(s, d)).select("criterion", "unit", F.round("x", 6).alias("x"), F.col("nth").cast("long").alias("nth")),
    "t08_top_pairs": lambda s, d: R.top_pairs(B.ratings(s, d), "interval"),
    **{f"w03_running_alpha{'' if m == 'nominal' else '_' + m}": _running(m) for m in R.METRICS},
    "w04_hoeffding": lambda s, d: _R(R.hoeffding(B.stream(s, d)), "x", "lo", "hi").withColumn("t", F.col("t").cast("long")),
    "w05_empirical_bernstein": lambda s, d: _R(R.empirical_bernstein(B.stream(s, d)), "x", "lo", "hi").withColumn("t", F.col("t").cast("long")),
    "w06_betting": lambda s, d: _R(R.betting(B.stream(s, d)), "x", "lo", "hi").withColumn("t", F.col("t").cast("long")),
    "w07_alpha_bounds": lambda s, d: R.alpha_bounds(R.hoeffding(B.stream(s, d)), F.lit(1.5)).select("criterion", F.col("t").cast("long").alias("t"), F.round("alpha_lo", 6).alias("alpha_lo"), F.round("alpha_hi", 6).alias("alpha_hi")),
    "w08_first_clearing": lambda s, d: R.first_clearing(R.alpha_bounds(R.hoeffding(B.stream(s, d)), F.lit(0.5)), 0.5).select("criterion", F.col("t").cast("long").alias("t")),
    "e18_monitor": lambda s, d: R.monitor(B.ratings(s, d)).select("criterion", F.col("t").cast("long").alias("t"), F.round("alpha_lo", 5).alias("alpha_lo"), F.round("alpha_hi", 5).alias("alpha_hi")),
    "e18_monitor_summary": lambda s, d: _R(R.monitor_summary(_some_unrated(s, d)).drop("top"), "d_e", "alpha_lo", "alpha_hi", to=5),
    "p20_gate": lambda s, d: R.gate(B.ratings(s, d), _criteria(s, d)).select("criterion", F.round("alpha", 6).alias("alpha"), "action"),
    "j06_unrated_criteria": lambda s, d: R.gate(B.ratings(s, d), _criteria(s, d)).where("alpha is null").select("criterion", "action"),
    "e19_gate_report": lambda s, d: R.gate_report(R.gate(B.ratings(s, d), _criteria(s, d))),
}

_RATED = """rated AS (SELECT criterion, unit, rater, value, count(*) OVER (PARTITION BY criterion, unit) AS m FROM ratings WHERE value IS NOT NULL QUALIFY count(*) OVER (PARTITION BY criterion, unit) >= 2),
pairs AS (SELECT a.criterion, a.unit, a.m, a.rater AS ra, b.rater AS rb, a.value AS c, b.value AS k FROM rated a JOIN rated b ON a.criterion = b.criterion AND a.unit = b.unit AND a.rater <> b.rater),
coin AS (SELECT criterion, c, k, sum(1e0 / (m - 1)) AS o FROM pairs GROUP BY ALL),
marg AS (SELECT criterion, value AS v, CAST(count(*) AS DOUBLE) AS n, sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY criterion ORDER BY value) AS cum FROM rated GROUP BY criterion, value),
total AS (SELECT criterion, sum(n) AS n FROM marg GROUP BY 1)"""
_D2 = {
    "nominal": "CASE WHEN a.v = b.v THEN 0e0 ELSE 1e0 END",
    "interval": "pow(a.v - b.v, 2)",
    "ratio": "CASE WHEN a.v + b.v > 0 THEN pow((a.v - b.v) / (a.v + b.v), 2) ELSE 0e0 END",
    "ordinal": "CASE WHEN a.v = b.v THEN 0e0 ELSE pow(abs(a.cum - b.cum) + CASE WHEN a.v < b.v THEN a.n ELSE b.n END - (a.n + b.n) / 2, 2) END",
}


def _delta(metric):
    return f"delta AS (SELECT a.criterion, a.v AS c, b.v AS k, a.n AS nc, b.n AS nk, {_D2[metric]} AS d2 FROM marg a JOIN marg b ON a.criterion = b.criterion)"


def _with(metric, body):
    return B.sql("ratings", f"WITH {_RATED}, {_delta(metric)} {body}")


_ALPHA = """SELECT criterion, n, o / n AS d_o, e / (n * (n - 1)) AS d_e, CASE WHEN e > 0 THEN 1 - o / n / (e / (n * (n - 1))) END AS alpha, CASE WHEN n IS NULL THEN 'no unit was rated twice' WHEN e <= 0 THEN 'no variation' END AS reason
FROM (SELECT DISTINCT criterion FROM ratings) LEFT JOIN total USING (criterion) LEFT JOIN (SELECT criterion, sum(nc * nk * d2) AS e FROM delta GROUP BY 1) USING (criterion)
LEFT JOIN (SELECT coin.criterion, sum(o * d2) AS o FROM coin JOIN delta ON coin.criterion = delta.criterion AND coin.c = delta.c AND coin.k = delta.k GROUP BY 1) USING (criterion)"""
_ALPHA_OUT = f"SELECT criterion, coalesce(n, 0e0) AS n, round(d_o, 6) AS d_o, round(d_e, 6) AS d_e, round(alpha, 6) AS alpha, reason FROM ({_ALPHA})"
_X = """SELECT p.criterion, p.unit, any_value(m) AS m, CASE WHEN any_value(top) <= 0 THEN 0e0 ELSE least(1e0, avg(d2) / any_value(top)) END AS x FROM pairs p JOIN delta d ON p.criterion = d.criterion AND p.c = d.c AND p.k = d.k
JOIN (SELECT criterion, max(d2) AS top FROM delta GROUP BY 1) t ON t.criterion = p.criterion GROUP BY 1, 2"""
_GAP = {"nominal": "1e0", "interval": "pow(a.value - b.value, 2)", "ratio": _D2["ratio"].replace(".v", ".value"), "ordinal": "pow(a.middle - b.middle, 2)"}


def _running_sql(metric):
    """Alpha of every prefix from its counts of values and coincidences of value pairs, written out for each unit."""
    return B.sql("ratings", f"""WITH {_RATED}, u AS (SELECT criterion, unit, row_number() OVER (PARTITION BY criterion ORDER BY unit) AS ord FROM rated GROUP BY 1, 2),
 cells AS (SELECT criterion, unit, value, count(*) AS k FROM rated GROUP BY ALL),
 vals AS (SELECT DISTINCT criterion, value FROM cells),
 seen AS (SELECT u.criterion, u.unit, u.ord, v.value, CAST(sum(coalesce(cells.k, 0)) OVER (PARTITION BY u.criterion, v.value ORDER BY u.ord) AS DOUBLE) AS n FROM u JOIN vals v ON u.criterion = v.criterion LEFT JOIN cells ON cells.criterion = u.criterion AND cells.unit = u.unit AND cells.value = v.value),
 mid AS (SELECT *, sum(n) OVER (PARTITION BY criterion, ord ORDER BY value) - n / 2 AS middle, sum(n) OVER (PARTITION BY criterion, ord) AS total FROM seen),
 duo AS (SELECT criterion, unit, c, k, sum(1e0 / (m - 1)) AS o FROM pairs WHERE c <> k GROUP BY ALL),
 duos AS (SELECT DISTINCT criterion, c, k FROM duo),
 met AS (SELECT u.criterion, u.ord, v.c, v.k, sum(coalesce(duo.o, 0)) OVER (PARTITION BY u.criterion, v.c, v.k ORDER BY u.ord) AS o FROM u JOIN duos v ON u.criterion = v.criterion LEFT JOIN duo ON duo.criterion = u.criterion AND duo.unit = u.unit AND duo.c = v.c AND duo.k = v.k),
 run AS (SELECT a.criterion, a.unit, a.ord, any_value(a.total) AS n, sum(CASE WHEN a.value <> b.value THEN a.n * b.n * {_GAP[metric]} ELSE 0e0 END) AS e, sum(CASE WHEN met.o IS NULL THEN 0e0 ELSE met.o * {_GAP[metric]} END) AS o
         FROM mid a JOIN mid b ON a.criterion = b.criterion AND a.ord = b.ord LEFT JOIN met ON met.criterion = a.criterion AND met.ord = a.ord AND met.c = a.value AND met.k = b.value GROUP BY 1, 2, 3)
 SELECT criterion, unit, ord, round(CASE WHEN e > 1e-9 THEN 1 - o / n / (e / (n * (n - 1))) END, 6) + 0e0 AS alpha FROM run""")


_HOEFFDING = "SELECT criterion, t, x, greatest(0e0, mean - eps) AS lo, least(1e0, mean + eps) AS hi FROM (SELECT *, sqrt(ln(2e0 * t * (t + 1) / 5e-2) / (2e0 * t)) AS eps, avg(x) OVER (PARTITION BY criterion ORDER BY t) AS mean FROM stream)"


def _plug(source):
    return f"""p1 AS (SELECT *, (5e-1 + coalesce(sum(x) OVER (PARTITION BY criterion ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / t AS mu FROM {source}),
p2 AS (SELECT *, (25e-2 + coalesce(sum(pow(x - mu, 2)) OVER (PARTITION BY criterion ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / t AS var FROM p1)"""


def _bernstein(source):
    return f"""{_plug(source)},
p3 AS (SELECT *, least(sqrt(2 * {math.log(40)!r} / (var * t * ln(t + 1e0))), 5e-1) AS lam FROM p2),
p4 AS (SELECT criterion, t, x, sum(lam * x) OVER w AS lx, sum(lam) OVER w AS l, sum(pow(x - mu, 2) * (-ln(1 - lam) - lam)) OVER w AS v FROM p3 WINDOW w AS (PARTITION BY criterion ORDER BY t)),
eb AS (SELECT criterion, t, x, greatest(0e0, lx / l - (v + {math.log(40)!r}) / l) AS lo, least(1e0, lx / l + (v + {math.log(40)!r}) / l) AS hi FROM p4)"""


def _monitored_sql():
    more = "more AS (SELECT * FROM ratings UNION ALL SELECT 'D0', unit, rater, 2e0 FROM ratings WHERE rater = 1 UNION ALL SELECT 'D1', unit, rater, CAST(unit % 3 + rater % 2 AS DOUBLE) FROM ratings WHERE rater <= 2 AND unit % 4 = 1)"
    rated = _RATED.replace("FROM ratings", "FROM more")
    return B.sql("ratings", f"""WITH {more}, {rated}, {_delta('ordinal')},
 about AS (SELECT criterion, count(DISTINCT unit) AS units, min(m) AS fewest, max(m) AS most FROM rated GROUP BY 1),
 xs AS (SELECT criterion, row_number() OVER (PARTITION BY criterion ORDER BY unit) AS t, x FROM ({_X})),
 scale AS (SELECT d.criterion, max(d2) AS top, sum(nc * nk * d2) / any_value(n * (n - 1)) AS d_e FROM delta d JOIN total ON d.criterion = total.criterion GROUP BY 1),
 str AS (SELECT xs.* FROM xs JOIN scale ON xs.criterion = scale.criterion WHERE d_e > 0), {_bernstein('str')},
 bounds AS (SELECT eb.criterion, t, 1 - hi * top / d_e AS alpha_lo, least(1e0, 1 - lo * top / d_e) AS alpha_hi FROM eb JOIN scale ON eb.criterion = scale.criterion),
 last AS (SELECT criterion, max(t) AS n, arg_max(alpha_lo, t) AS alpha_lo, arg_max(alpha_hi, t) AS alpha_hi, min(t) FILTER (alpha_lo >= 0.67::DOUBLE) AS cleared_at FROM bounds GROUP BY 1)
 SELECT criterion, coalesce(units, 0) AS units, round(d_e, 5) AS d_e, coalesce(fewest = most, true) AS equal_ratings,
        CASE WHEN units IS NULL THEN 'no unit was rated by two or more: there is nothing to monitor' WHEN d_e <= 0 THEN 'no expected disagreement: all ratings that can be paired are equal'
             WHEN fewest <> most THEN 'units have different numbers of ratings: the bounds are for the mean over units, alpha weighs units by their ratings' END AS reason,
        coalesce(last.n, 0) AS n, round(alpha_lo, 5) AS alpha_lo, round(alpha_hi, 5) AS alpha_hi, cleared_at
 FROM (SELECT DISTINCT criterion FROM more) LEFT JOIN about USING (criterion) LEFT JOIN scale USING (criterion) LEFT JOIN last USING (criterion)""")


_BETTING = f"""WITH {_plug('stream')},
g AS (SELECT p2.*, k AS g, k / 400e0 AS m FROM p2, (SELECT unnest(range(0, 401)) AS k)),
l AS (SELECT *, (mu - m) / (var + pow(mu - m, 2)) AS lam FROM g),
b AS (SELECT criterion, t, x, g, m, sum(ln(1 + least(greatest(lam, 0e0), 5e-1 / greatest(m, 1e-4)) * (x - m))) OVER w AS plus, sum(ln(1 - least(greatest(-lam, 0e0), 5e-1 / greatest(1 - m, 1e-4)) * (x - m))) OVER w AS minus FROM l WINDOW w AS (PARTITION BY criterion, g ORDER BY t)),
r AS (SELECT *, max(greatest(plus, minus)) OVER (PARTITION BY criterion, g ORDER BY t) AS most FROM b),
e AS (SELECT criterion, t, any_value(x) AS x, min(m) FILTER (most < {math.log(20)!r}) AS lo, max(m) FILTER (most < {math.log(20)!r}) AS hi FROM r GROUP BY 1, 2),
f AS (SELECT *, bool_or(lo IS NULL) OVER (PARTITION BY criterion ORDER BY t) AS failed FROM e)
SELECT criterion, t, round(x, 6) AS x, round(CASE WHEN failed THEN 0e0 ELSE lo END, 6) AS lo, round(CASE WHEN failed THEN 1e0 ELSE hi END, 6) AS hi, failed FROM f"""
_GATE = f"""gated AS (SELECT coalesce(a.criterion, q.criterion) AS criterion, alpha, CASE WHEN a.criterion IS NULL AND machine THEN 'exempt' WHEN alpha IS NULL THEN 'unmeasured' WHEN alpha >= 0.67::DOUBLE THEN 'keep' ELSE 'rewrite' END AS action
FROM ({_ALPHA}) a FULL JOIN (VALUES ('C0', false), ('C1', true), ('C8', true), ('C9', false)) q(criterion, machine) ON a.criterion = q.criterion)"""

ORACLE_SQL = {
    "p08_usable_units": _with("nominal", "SELECT criterion, count(DISTINCT unit) AS units, count(*) AS ratings FROM rated GROUP BY 1"),
    "j08_rater_pairs": _with("interval", "SELECT p.criterion, unit, ra AS rater_a, rb AS rater_b, round(d2, 6) AS d2 FROM pairs p JOIN delta d ON p.criterion = d.criterion AND p.c = d.c AND p.k = d.k WHERE ra < rb AND d2 > 0"),
    "j09_differences": _with("ordinal", "SELECT criterion, c, k, round(d2, 6) AS d2 FROM delta"),
    "w02_marginals": _with("nominal", "SELECT criterion, v, n, cum FROM marg"),
    "a21_coincidences": _with("nominal", "SELECT criterion, c, k, round(o, 6) AS o FROM coin"),
    **{f"e13_alpha_{m}": _with(m, _ALPHA_OUT) for m in R.METRICS},
    "e14_differences_ratio": _with("ratio", "SELECT criterion, c, k, round(d2, 9) AS d2 FROM delta"),
    "e16_alpha_by_criterion": _with("ordinal", f"SELECT criterion, round(alpha, 6) AS alpha, reason FROM ({_ALPHA})"),
    "e17_disagreement": _with("ordinal", f"SELECT criterion, unit, m, round(x, 6) AS x FROM ({_X})"),
    "t04_worst_units": _with("ordinal", f"SELECT criterion, unit, round(x, 6) AS x, row_number() OVER (PARTITION BY criterion ORDER BY round(x, 9) DESC, unit) AS nth FROM ({_X}) WHERE x > 0 QUALIFY nth <= 10"),
    "t08_top_pairs": _with("interval", "SELECT p.criterion, unit, string_agg(ra || '-' || rb, ',' ORDER BY d2 DESC, ra, rb) AS pairs FROM pairs p JOIN delta d ON p.criterion = d.criterion AND p.c = d.c AND p.k = d.k WHERE ra < rb AND d2 > 0 GROUP BY 1, 2"),
    **{f"w03_running_alpha{'' if m == 'nominal' else '_' + m}": _running_sql(m) for m in R.METRICS},
    "w04_hoeffding": B.sql("stream", f"SELECT criterion, t, round(x, 6) AS x, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ({_HOEFFDING})"),
    "w05_empirical_bernstein": B.sql("stream", f"WITH {_bernstein('stream')} SELECT criterion, t, round(x, 6) AS x, round(lo, 6) AS lo, round(hi, 6) AS hi FROM eb"),
    "w06_betting": B.sql("stream", _BETTING),
    "w07_alpha_bounds": B.sql("stream", f"SELECT criterion, t, round(1 - hi * 15e-1, 6) AS alpha_lo, round(least(1e0, 1 - lo * 15e-1), 6) AS alpha_hi FROM ({_HOEFFDING})"),
    "w08_first_clearing": B.sql("stream", f"SELECT criterion, min(t) FILTER (1 - hi * 5e-1 >= 5e-1) AS t FROM ({_HOEFFDING}) GROUP BY 1"),
    "e18_monitor": _with("ordinal", f""", xs AS (SELECT criterion, row_number() OVER (PARTITION BY criterion ORDER BY unit) AS t, x FROM ({_X})),
 scale AS (SELECT d.criterion, max(d2) / (sum(nc * nk * d2) / any_value(n * (n - 1))) AS scale FROM delta d JOIN total ON d.criterion = total.criterion GROUP BY 1 HAVING sum(nc * nk * d2) > 0),
 str AS (SELECT xs.* FROM xs JOIN scale ON xs.criterion = scale.criterion), {_bernstein('str')}
 SELECT eb.criterion, t, round(1 - hi * scale, 5) AS alpha_lo, round(least(1e0, 1 - lo * scale), 5) AS alpha_hi FROM eb JOIN scale ON eb.criterion = scale.criterion"""),
    "e18_monitor_summary": _monitored_sql(),
    "p20_gate": _with("ordinal", f", {_GATE} SELECT criterion, round(alpha, 6) AS alpha, action FROM gated"),
    "j06_unrated_criteria": _with("ordinal", f", {_GATE} SELECT criterion, action FROM gated WHERE alpha IS NULL"),
    "e19_gate_report": _with("ordinal", f", {_GATE} SELECT " + ", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in ("keep", "rewrite", "unmeasured", "exempt")) + ", count(*) FILTER (action IN ('rewrite', 'unmeasured')) = 0 AS passed FROM gated"),
}
