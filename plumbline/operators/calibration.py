"""Difficulty calibration: pass@k, intervals, routing and contamination flags."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import unit

# Band edges, and thresholds of the contamination heuristic.
GOLD_LO, GOLD_HI, SATURATED_LO = 0.10, 0.70, 0.90
SATURATED_PASS, LONG_TRACE, FEW_BACKTRACKS, LOW_ENTROPY, MIN_SIGNALS = 0.95, 600.0, 1.0, 0.35, 2
ROUTES = ["escalate", "frontier", "gold", "reject"]  # the most cautious first
ALIASES = {
    "mean_tokens": ["mean_tokens", "tokens", "mean_completion_tokens", "token_count"],
    "backtracks": ["backtracks", "mean_backtracks", "backtrack_count", "revisions"],
    "entropy": ["entropy", "entropy_proxy", "mean_entropy", "token_entropy"],
}


def pass_at_k(n: Column, c: Column, k: Column, clamp: bool = True) -> Column:
    """1 - C(n - c, k) / C(n, k), as a product; k is clamped to n, or with clamp=False a k beyond n is an error."""
    draws = F.sequence(F.lit(0), F.least(k, n).cast("int") - 1)
    missed = F.aggregate(draws, F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    value = F.when(c <= 0, 0.0).when(n - c < F.least(k, n), 1.0).otherwise(1 - missed)
    return value if clamp else F.when(k > n, F.raise_error(F.concat(F.lit("k is beyond n: "), k.cast("string"), F.lit(" > "), n.cast("string"))).cast("double")).otherwise(value)


def pass_at_1(n: Column, c: Column) -> Column:
    return F.try_divide(c.cast("double"), n)


def z_value(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 2)


def wilson(n: Column, c: Column, level: float = 0.95) -> tuple[Column, Column]:
    """The Wilson interval of a proportion, within [0, 1]."""
    z = z_value(level)
    p, z2 = c / n, z * z
    middle, spread = p + z2 / (n * 2), z * F.sqrt(p * (1 - p) / n + z2 / (n * n * 4.0))
    low, high = (middle - spread) / (1 + z2 / n), (middle + spread) / (1 + z2 / n)
    return F.when(c <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), low)), F.when(c >= n, 1.0).otherwise(F.least(F.lit(1.0), high))


def _beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction, elementwise."""
    gamma = np.vectorize(math.lgamma)
    flip = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(t) + q * np.log1p(-t))
    tiny = 1e-300
    c, d = np.ones_like(t), 1 - (p + q) * t / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for term in (m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    value = front * h / p
    return np.where(flip, 1 - value, value)


def jeffreys_interval(n: np.ndarray, c: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Equal-tailed interval of Beta(c + 1/2, n - c + 1/2); pinned to 0 without and to 1 with only successes."""
    a, b = np.asarray(c, float) + 0.5, np.asarray(n, float) - np.asarray(c, float) + 0.5

    def quantile(p: float) -> np.ndarray:
        low, high = np.zeros_like(a), np.ones_like(a)
        for _ in range(60):
            middle = (low + high) / 2
            under = _beta_cdf(middle, a, b) < p
            low, high = np.where(under, middle, low), np.where(under, high, middle)
        return (low + high) / 2

    tail = (1 - level) / 2
    return np.where(np.asarray(c) <= 0, 0.0, quantile(tail)), np.where(np.asarray(c) >= np.asarray(n), 1.0, quantile(1 - tail))


def jeffreys(attempts: DataFrame, level: float = 0.95) -> DataFrame:
    """attempts(item, n, c) with the Jeffreys interval (low, high); Spark has no inverse beta function."""

    @F.pandas_udf("low double, high double")
    def both(n: pd.Series, c: pd.Series) -> pd.DataFrame:
        low, high = jeffreys_interval(n.to_numpy(), c.to_numpy(), level)
        return pd.DataFrame({"low": low, "high": high})

    return attempts.withColumn("_both", both("n", "c")).select("item", "n", "c", "_both.low", "_both.high")


def band(p: Column) -> Column:
    return F.when(p < GOLD_LO, "frontier").when(p <= GOLD_HI, "gold").when(p <= SATURATED_LO, "thin").otherwise("saturated")


def band_route(p: Column) -> Column:
    return F.when(band(p).isin("thin", "saturated"), "reject").otherwise(band(p))


def crossed_edges(low: Column, high: Column) -> Column:
    """The band edges e with low < e <= high."""
    return F.filter(F.array(F.lit(GOLD_LO), F.lit(GOLD_HI)), lambda e: (low < e) & (e <= high))


def estimates(attempts: DataFrame, k: int = 8) -> DataFrame:
    """attempts(item, n, c) with pass@1, pass@k (k clamped to n), the Wilson interval and notes."""
    low, high = wilson(F.col("n"), F.col("c"))
    out = attempts.where("n > 0").withColumn("k", F.least(F.lit(k).cast("long"), F.col("n"))).withColumns({"pass_at_1": pass_at_1(F.col("n"), F.col("c")), "pass_at_k": pass_at_k(F.col("n"), F.col("c"), F.lit(k)), "ci_low": low, "ci_high": high})
    notes = F.array_compact(F.array(F.when(F.col("n") < k, "clamped"), F.when(F.col("n") < 8, "small"), F.when(F.col("ci_high") - F.col("ci_low") >= 0.5, "wide")))
    return out.withColumn("notes", F.array_join(notes, ","))


def route(estimated: DataFrame) -> DataFrame:
    """estimated(pass_at_1, pass_at_k, ci_low, ci_high) with band, route and confident.

    Nothing solved: escalate. Otherwise the point and both ends of the interval
    must agree; if they don't, the most cautious of the three. Without an
    interval the point decides, without confidence. pass@k below pass@1 is an error.
    """
    p1, pk, low, high = (F.col(c) for c in ("pass_at_1", "pass_at_k", "ci_low", "ci_high"))
    place = lambda p: F.array_position(F.array(*map(F.lit, ROUTES)), band_route(p))
    cautious = F.element_at(F.array(*map(F.lit, ROUTES)), F.least(place(p1), place(low), place(high)).cast("int"))
    unsolved = pk <= 0
    none = low.isNull() | high.isNull()
    checked = F.when(pk < p1 - 1e-9, F.raise_error(F.lit("pass@k is below pass@1"))).otherwise(F.when(unsolved, "escalate").when(none, band_route(p1)).otherwise(cautious))
    agree = (band_route(p1) == band_route(low)) & (band_route(p1) == band_route(high))
    return estimated.withColumns({"band": band(p1), "route": checked, "confident": unsolved | F.coalesce(agree, F.lit(False)), "crossed": F.coalesce(F.size(crossed_edges(low, high)), F.lit(0))})


def route_counts(routed: DataFrame) -> DataFrame:
    """(route, n, confident) of all four routes, also unused ones."""
    names = routed.sparkSession.createDataFrame([(r,) for r in ROUTES], "route string")
    n = routed.groupBy("route").agg(F.count("*").alias("n"), F.count_if("confident").alias("confident"))
    return names.join(n, "route", "left").select("route", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("confident", F.lit(0)).alias("confident"))


def read_stat(stats: Column, name: str) -> Column:
    """The first alias that the string map has decides, even if it isn't a number: then null, and so is NaN."""
    out = F.lit(None).cast("double")
    for alias in reversed(ALIASES[name]):
        value = F.try_element_at(stats, F.lit(alias)).try_cast("double")
        out = F.when(F.map_contains_key(stats, alias), F.when(~F.isnan(value), value)).otherwise(out)
    return out


def contamination(rows: DataFrame) -> DataFrame:
    """rows(pass_at_1, stats map<string,string>) with flagged, assessed, score and n_signals.

    Flagged: saturated, and at least two of long trace, few backtracks, low
    entropy. With fewer than two of the statistics it is unassessed, not clean.
    """
    s = {name: read_stat(F.col("stats"), name) for name in ALIASES}
    hits = [s["mean_tokens"] >= LONG_TRACE, s["backtracks"] <= FEW_BACKTRACKS, s["entropy"] <= LOW_ENTROPY]
    n_hit = sum((F.when(h, 1).otherwise(0) for h in hits[1:]), F.when(hits[0], 1).otherwise(0))
    n_known = sum((x.isNotNull().cast("int") for x in list(s.values())[1:]), s["mean_tokens"].isNotNull().cast("int"))
    saturated = F.col("pass_at_1") >= SATURATED_PASS
    out = rows.withColumns({"n_signals": F.when(saturated, n_hit).otherwise(0), "n_known": n_known})
    assessed = ~saturated | (F.col("n_known") >= MIN_SIGNALS)
    return out.withColumns({"assessed": assessed, "flagged": saturated & assessed & (F.col("n_signals") >= MIN_SIGNALS), "score": F.when(saturated & assessed, F.col("n_signals") / F.col("n_known")).otherwise(0.0)})


def token_count(text: Column) -> Column:
    """Tokens between white space."""
    return F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda t: t != ""))


def stub_draws(tasks: DataFrame, n: int = 8) -> DataFrame:
    """(task_id, i, correct): n deterministic attempts at each task, its skill hashed from its id."""
    skill, throw = unit(F.lit("skill"), F.col("task_id")), unit(F.lit("draw"), F.col("task_id"), F.col("i"))
    return tasks.select("task_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("task_id", "i", (throw < skill).alias("correct"))


def attempts_of(draws: DataFrame) -> DataFrame:
    """(item, n, c) of draws(task_id, correct)."""
    return draws.groupBy(F.col("task_id").alias("item")).agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))


def embedded_task_id(prompt: Column) -> Column:
    """The id in a prompt's first [task:...] tag; null without one."""
    found = F.regexp_extract(prompt, r"\[task:([^\]]+)\]", 1)
    return F.when(found != "", found)
