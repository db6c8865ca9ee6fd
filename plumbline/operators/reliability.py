"""Inter-rater reliability: Krippendorff's alpha, confidence sequences and gating.

Ratings are long: (criterion, unit, rater, value); a null value or a missing row
is a missing rating. A unit with fewer than two ratings contributes nothing.
Everything is grouped by criterion. Coincidences come from (unit, value) counts,
so the work is linear in the ratings, not in pairs of raters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import sequences
from plumbline.operators import scans
from plumbline.tables import cut

GATE_ALPHA = 0.67
METRICS = ("nominal", "ordinal", "interval", "ratio")
#: Cells of running counts that a task works on at a time.
ALPHA_CELLS = 1 << 21
#: Rows of a table of value pairs or criteria that is sent to every task.
MAX_SENT = 200_000


def usable(ratings: DataFrame) -> DataFrame:
    """Ratings of units with at least two, with m: how many the unit has."""
    rated = ratings.where("value is not null and not isnan(value)")
    m = rated.groupBy("criterion", "unit").agg(F.count("*").alias("m")).where("m >= 2")
    return rated.join(m, ["criterion", "unit"])


def unit_counts(ratings: DataFrame) -> DataFrame:
    """(criterion, unit, value, k, m): how often a usable unit got each value."""
    rated = ratings.where("value is not null and not isnan(value)").groupBy("criterion", "unit", "value").agg(F.count("*").alias("k"))
    m = F.sum("k").over(Window.partitionBy("criterion", "unit"))
    return rated.withColumn("m", m).where("m >= 2")


def coincidences(counts: DataFrame) -> DataFrame:
    """(criterion, c, k, o) of unit_counts: o_ck = sum over units of (n_c n_k - [c = k] n_c) / (m - 1)."""
    a = counts.select("criterion", "unit", F.col("value").alias("c"), F.col("k").alias("nc"), "m")
    b = counts.select("criterion", "unit", F.col("value").alias("k"), F.col("k").alias("nk"))
    same = F.when(F.col("c") == F.col("k"), F.col("nc")).otherwise(0)
    return a.join(b, ["criterion", "unit"]).groupBy("criterion", "c", "k").agg(F.sum((F.col("nc") * F.col("nk") - same) / (F.col("m") - 1)).alias("o")).where("o != 0")


def marginals(counts: DataFrame) -> DataFrame:
    """(criterion, v, n, cum): pairable ratings with each value, and running up to it."""
    w = Window.partitionBy("criterion").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return counts.groupBy("criterion", F.col("value").alias("v")).agg(F.sum("k").cast("double").alias("n")).withColumn("cum", F.sum("n").over(w))


def differences(marginal: DataFrame, metric: str) -> DataFrame:
    """(criterion, c, k, nc, nk, d2) for all value pairs; a criterion's distinct values are few, or this is too much."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    a = marginal.select("criterion", F.col("v").alias("c"), F.col("n").alias("nc"), F.col("cum").alias("cc"))
    b = marginal.select("criterion", F.col("v").alias("k"), F.col("n").alias("nk"), F.col("cum").alias("ck"))
    c, k = F.col("c"), F.col("k")
    if metric == "nominal":
        d2 = F.when(c == k, 0.0).otherwise(1.0)
    elif metric == "interval":
        d2 = F.pow(c - k, F.lit(2))
    elif metric == "ratio":
        bad = F.raise_error(F.lit("the ratio metric is for values of at least 0"))
        d2 = F.when((c < 0) | (k < 0), bad).when(c + k > 0, F.pow((c - k) / (c + k), F.lit(2))).otherwise(0.0)
    else:
        lower = F.when(c < k, F.col("nc")).otherwise(F.col("nk"))
        span = F.abs(F.col("cc") - F.col("ck")) + lower
        d2 = F.when(c == k, 0.0).otherwise(F.pow(span - (F.col("nc") + F.col("nk")) / 2, F.lit(2)))
    return a.join(b, "criterion").select("criterion", "c", "k", "nc", "nk", d2.cast("double").alias("d2"))


def alpha(ratings: DataFrame, metric: str = "ordinal") -> DataFrame:
    """(criterion, n, d_o, d_e, alpha, reason): alpha is null with a reason where it is undefined."""
    counts = unit_counts(ratings)
    observed = coincidences(counts)
    delta = differences(marginals(counts), metric)
    n = counts.groupBy("criterion").agg(F.sum("k").cast("double").alias("n"))
    e = delta.groupBy("criterion").agg(F.sum(F.col("nc") * F.col("nk") * F.col("d2")).alias("e"))
    o = observed.join(delta, ["criterion", "c", "k"]).groupBy("criterion").agg(F.sum(F.col("o") * F.col("d2")).alias("s"))
    every = ratings.select("criterion").distinct()
    joined = every.join(n, "criterion", "left").join(e, "criterion", "left").join(o, "criterion", "left")
    d_o, d_e = F.col("s") / F.col("n"), F.col("e") / (F.col("n") * (F.col("n") - 1))
    value = F.when(d_e > 0, 1 - d_o / d_e)
    reason = F.when(F.col("n").isNull(), "no unit was rated twice").when(d_e <= 0, "no variation")
    return joined.select("criterion", F.coalesce("n", F.lit(0.0)).alias("n"), d_o.alias("d_o"), d_e.alias("d_e"), value.alias("alpha"), reason.alias("reason"))


def _few(df: DataFrame) -> DataFrame:
    """df, a table of values or of criteria, computed once; sent to all tasks if it is small. A shuffle by value or criterion would bring most units into a few tasks."""
    df = cut(df)
    return F.broadcast(df) if df.limit(MAX_SENT + 1).count() <= MAX_SENT else df


def disagreement(ratings: DataFrame, metric: str = "ordinal") -> DataFrame:
    """(criterion, unit, m, x): mean d2 over the unit's rating pairs, over the criterion's largest d2."""
    counts = unit_counts(ratings)
    return _disagreement(counts, _few(differences(marginals(counts), metric)))


def _disagreement(counts: DataFrame, delta: DataFrame) -> DataFrame:
    top = _few(delta.groupBy("criterion").agg(F.max("d2").alias("top")))
    a = counts.select("criterion", "unit", "m", F.col("value").alias("c"), F.col("k").alias("na"))
    b = counts.select("criterion", "unit", F.col("value").alias("k"), F.col("k").alias("nb"))
    met = a.join(b, ["criterion", "unit"]).join(delta.select("criterion", "c", "k", "d2"), ["criterion", "c", "k"])
    raw = F.sum(F.col("na") * F.col("nb") * F.col("d2")) / (F.first("m") * (F.first("m") - 1))
    each = met.groupBy("criterion", "unit").agg(F.first("m").alias("m"), raw.alias("raw")).join(top, "criterion")
    x = F.when(F.col("top") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw") / F.col("top"))))
    return each.select("criterion", "unit", "m", x.alias("x"))


def rater_pairs(ratings: DataFrame, metric: str = "ordinal") -> DataFrame:
    """(criterion, unit, rater_a, rater_b, d2), rater_a < rater_b, d2 > 0: the evidence. Quadratic in a unit's raters by nature."""
    rated = usable(ratings)
    delta = _few(differences(marginals(unit_counts(ratings)), metric))
    a = rated.select("criterion", "unit", F.col("rater").alias("rater_a"), F.col("value").alias("c"))
    b = rated.select("criterion", "unit", F.col("rater").alias("rater_b"), F.col("value").alias("k"))
    pairs = a.join(b, ["criterion", "unit"]).where("rater_a < rater_b and c != k")
    return pairs.join(delta, ["criterion", "c", "k"]).where("d2 > 0").select("criterion", "unit", "rater_a", "rater_b", "d2")


def top_pairs(ratings: DataFrame, metric: str = "ordinal") -> DataFrame:
    """(criterion, unit, pairs): each unit's rater pairs, the most different first."""
    far_first = lambda a, b: F.when(a["d2"] > b["d2"], -1).when(a["d2"] < b["d2"], 1).when(a["rater_a"] < b["rater_a"], -1).when(a["rater_a"] > b["rater_a"], 1).when(a["rater_b"] < b["rater_b"], -1).otherwise(1)
    grouped = rater_pairs(ratings, metric).groupBy("criterion", "unit").agg(F.collect_list(F.struct("d2", "rater_a", "rater_b")).alias("p"))
    return grouped.select("criterion", "unit", F.array_join(F.transform(F.array_sort("p", far_first), lambda x: F.concat_ws("-", x["rater_a"].cast("string"), x["rater_b"].cast("string"))), ",").alias("pairs"))


def worst_units(ratings: DataFrame, metric: str = "ordinal", limit: int = 10) -> DataFrame:
    """Each criterion's units with most disagreement; equal ones by unit."""
    w = Window.partitionBy("criterion").orderBy(F.desc(F.round("x", 9)), "unit")
    return disagreement(ratings, metric).where("x > 0").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)


class _RunningAlpha:
    """Alpha over the units so far: ratings with each value, and coincidences of each pair of different values."""

    levels = 1

    def __init__(self, metric: str):
        self.metric = metric

    def zero(self) -> dict:
        return {"values": np.zeros(0), "n": np.zeros(0), "pairs": np.zeros((0, 2)), "o": np.zeros(0), "units": 0}

    def _met(self, state: dict, rows: pa.RecordBatch) -> tuple:
        """(values, unit and value index and count of all cells; pairs, unit and pair index and coincidences) of rows, over the state's values and pairs too."""
        cells = rows.column("cells")
        size = np.diff(cells.offsets.to_numpy())
        value, k = (cells.flatten().field(i).to_numpy().astype(float) for i in (0, 1))
        unit = np.repeat(np.arange(len(size)), size)
        values, place = np.unique(np.concatenate([state["values"], value]), return_inverse=True)
        at = place[len(state["values"]) :]
        # all pairs of different values within a unit
        first = np.cumsum(size) - size
        left = np.repeat(np.arange(len(value)), size[unit])
        right = np.arange(len(left)) - np.repeat(np.cumsum(size[unit]) - size[unit], size[unit]) + first[unit[left]]
        up = value[left] < value[right]
        left, right = left[up], right[up]
        m = np.bincount(unit, k, len(size))
        o = 2 * k[left] * k[right] / (m[unit[left]] - 1)
        pairs, place = np.unique(np.concatenate([state["pairs"], np.stack([value[left], value[right]], axis=1)]), axis=0, return_inverse=True)
        return values, unit, at, k, pairs, unit[left], place.reshape(-1)[len(state["pairs"]) :], o

    @staticmethod
    def _moved(state: dict, values: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state's counts over values and pairs, which hold its own."""
        n, o = np.zeros(len(values)), np.zeros(len(pairs))
        n[np.searchsorted(values, state["values"])] = state["n"]
        own = {tuple(p): i for i, p in enumerate(pairs.tolist())}
        o[[own[tuple(p)] for p in state["pairs"].tolist()]] = state["o"]
        return n, o

    def advance(self, level: int, state: dict, rows: pa.RecordBatch) -> dict:
        values, _, at, k, pairs, _, place, o = self._met(state, rows)
        n, so_far = self._moved(state, values, pairs)
        return {"values": values, "n": n + np.bincount(at, k, len(values)), "pairs": pairs, "o": so_far + np.bincount(place, o, len(pairs)), "units": state["units"] + rows.num_rows}

    def merge(self, level: int, carry: dict, own: dict) -> dict:
        values, pairs = np.union1d(carry["values"], own["values"]), np.unique(np.concatenate([carry["pairs"], own["pairs"]]), axis=0)
        (n, o), (more_n, more_o) = self._moved(carry, values, pairs), self._moved(own, values, pairs)
        return {"values": values, "n": n + more_n, "pairs": pairs, "o": o + more_o, "units": carry["units"] + own["units"]}

    def emit(self, state: dict, rows: pa.RecordBatch) -> tuple[dict, list]:
        out, at, start = [], 0, state["units"]
        while at < rows.num_rows:
            width = len(state["values"]) + len(state["pairs"]) + 64
            part = rows.slice(at, max(1, ALPHA_CELLS // width))
            state, alpha = self._block(state, part)
            out.append(alpha)
            at += part.num_rows
        return state, [pa.array(start + np.arange(1, rows.num_rows + 1)), pa.array(np.concatenate(out), from_pandas=True)]

    def _block(self, state: dict, rows: pa.RecordBatch) -> tuple[dict, np.ndarray]:
        values, unit, at, k, pairs, pair_unit, place, o = self._met(state, rows)
        n, so_far = self._moved(state, values, pairs)
        seen, met = np.zeros((rows.num_rows, len(values))), np.zeros((rows.num_rows, len(pairs)))
        np.add.at(seen, (unit, at), k)
        np.add.at(met, (pair_unit, place), o)
        seen, met = np.cumsum(seen, axis=0) + n, np.cumsum(met, axis=0) + so_far
        total = seen.sum(axis=1)
        c, d = (np.searchsorted(values, pairs[:, i]) for i in (0, 1))
        if self.metric == "ordinal":  # squared gaps of mid-ranks; their sum over all pairs has a closed form
            middle = np.cumsum(seen, axis=1) - seen / 2
            gap = (middle[:, d] - middle[:, c]) ** 2
            expected = total * (total**3 - (seen**3).sum(axis=1)) / 6
        elif self.metric == "nominal":
            gap, expected = 1.0, total**2 - (seen**2).sum(axis=1)
        elif self.metric == "interval":
            gap, expected = (values[d] - values[c]) ** 2, 2 * (total * (seen @ values**2) - (seen @ values) ** 2)
        else:
            both = values[:, None] + values
            ratio = np.divide(values[:, None] - values, both, out=np.zeros_like(both), where=both > 0) ** 2
            gap, expected = ratio[c, d], (seen @ ratio * seen).sum(axis=1)
        observed = (met * gap).sum(axis=1)
        fine = expected > 1e-9 * total**2
        alpha = np.full(rows.num_rows, np.nan)
        alpha[fine] = 1 - observed[fine] / total[fine] / (expected[fine] / (total[fine] * (total[fine] - 1)))
        return {"values": values, "n": seen[-1], "pairs": pairs, "o": met[-1], "units": state["units"] + rows.num_rows}, alpha


def running_alpha(ratings: DataFrame, metric: str = "ordinal") -> DataFrame:
    """(criterion, unit, ord, alpha): alpha of all units so far, after each unit in their order; null without variation.

    One scan: counts of values and coincidences of value pairs run on, and alpha is worked out from them,
    so a unit costs as much as there are different values and pairs of them, not what came before it.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    counts = unit_counts(ratings)
    if metric == "ratio":
        bad = F.raise_error(F.lit("the ratio metric is for values of at least 0"))
        counts = counts.withColumn("value", F.when(F.col("value") < 0, bad).otherwise(F.col("value")))
    cell = F.struct(F.col("value").cast("double").alias("value"), F.col("k").alias("k"))
    units = counts.groupBy("criterion", "unit").agg(F.collect_list(cell).alias("cells"))  # a unit's different values
    return scans.scan(units, ["criterion"], ["unit"], _RunningAlpha(metric), "ord long, alpha double", ["criterion", "unit"])


class _Sequence:
    """A confidence sequence as a scan of x."""

    def __init__(self, sequence: sequences.Sequence):
        self.sequence, self.levels = sequence, len(sequence.levels)

    def zero(self) -> sequences.State:
        return self.sequence.zero()

    def advance(self, level: int, state: sequences.State, rows: pa.RecordBatch) -> sequences.State:
        self.sequence.levels[level][1](state, self._x(rows))
        return state

    def merge(self, level: int, carry: sequences.State, own: sequences.State) -> sequences.State:
        return self.sequence.merge(level, carry, own)

    def emit(self, state: sequences.State, rows: pa.RecordBatch) -> tuple[sequences.State, list]:
        start = int(state["n"])
        lo, hi, failed = self.sequence.step(state, self._x(rows))
        return state, [start + np.arange(1, rows.num_rows + 1), lo, hi, failed]

    @staticmethod
    def _x(rows: pa.RecordBatch) -> np.ndarray:
        return rows.column("x").to_numpy(zero_copy_only=False).astype(float)


def follow(stream: DataFrame, kind: str = "eb", order: str = "t", **options) -> DataFrame:
    """stream(criterion, order, x in [0, 1]) with n, the rows so far, and the anytime-valid interval (lo, hi, failed) for the mean of x."""
    x = F.col("x").cast("double")
    bad = F.raise_error(F.lit("observations lie in [0, 1]"))
    rows = stream.withColumn("x", F.when(x.between(0, 1), x).otherwise(bad))
    return scans.scan(rows, ["criterion"], [order], _Sequence(sequences.SEQUENCES[kind](**options)), "n long, lo double, hi double, failed boolean")


def hoeffding(stream: DataFrame, level: float = 0.05) -> DataFrame:
    """stream(criterion, t, x in [0, 1]) with the anytime-valid interval (lo, hi) for the running mean."""
    return follow(stream.select("criterion", "t", "x"), "hoeffding", level=level).drop("n", "failed")


def empirical_bernstein(stream: DataFrame, level: float = 0.05, cap: float = 0.5) -> DataFrame:
    """stream with the predictable plug-in empirical-Bernstein interval (lo, hi)."""
    return follow(stream.select("criterion", "t", "x"), "eb", level=level, cap=cap).drop("n", "failed")


def betting(stream: DataFrame, level: float = 0.05, cap: float = 0.5, grid: int = sequences.BETTING_GRID) -> DataFrame:
    """stream with (lo, hi, failed): candidate means, of a fixed grid, that a hedged bettor hasn't ruled out.

    A candidate once rejected stays so; with all rejected the interval is [0, 1]
    and failed is true.
    """
    return follow(stream.select("criterion", "t", "x"), "betting", level=level, cap=cap, grid=grid).drop("n")


#: Confidence sequences by name.
SEQUENCES = {"hoeffding": hoeffding, "eb": empirical_bernstein, "betting": betting}


def alpha_bounds(intervals: DataFrame, scale: Column) -> DataFrame:
    """intervals with alpha_lo and alpha_hi; scale: largest d2 over expected disagreement."""
    return intervals.withColumns({"alpha_hi": F.least(F.lit(1.0), 1 - F.col("lo") * scale), "alpha_lo": 1 - F.col("hi") * scale})


def first_clearing(bounds: DataFrame, gate: float = GATE_ALPHA) -> DataFrame:
    """(criterion, t): when the whole interval first lies at or above the gate; null if never."""
    return bounds.groupBy("criterion").agg(F.min(F.when(F.col("alpha_lo") >= gate, F.col("t"))).alias("t"))


def monitor(ratings: DataFrame, metric: str = "ordinal", kind: str = "eb") -> DataFrame:
    """(criterion, t, unit, x, lo, hi, failed, alpha_lo, alpha_hi): alpha bounds after each unit, for criteria with any expected disagreement."""
    return _monitor(ratings, metric, kind)[1]


def _monitor(ratings: DataFrame, metric: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """What is monitored, by criterion, and monitor()."""
    counts = unit_counts(ratings)
    delta = _few(differences(marginals(counts), metric))
    monitored = cut(_monitored(ratings, counts, delta))
    scale = _few(monitored.where("d_e > 0 and top > 0").select("criterion", (F.col("top") / F.col("d_e")).alias("scale")))
    x = _disagreement(counts, delta).join(scale, "criterion").select("criterion", "unit", "x", "scale")
    return monitored, alpha_bounds(follow(x, kind, "unit"), F.col("scale")).drop("scale").withColumnRenamed("n", "t")


def _monitored(ratings: DataFrame, counts: DataFrame, delta: DataFrame) -> DataFrame:
    """(criterion, units, top, d_e, equal_ratings, reason) of every criterion that was rated at all."""
    e = delta.groupBy("criterion").agg(F.max("d2").alias("top"), F.sum(F.col("nc") * F.col("nk") * F.col("d2")).alias("e"))
    n = counts.groupBy("criterion").agg(F.sum("k").cast("double").alias("n"), F.min("m").alias("fewest"), F.max("m").alias("most"))
    units = counts.select("criterion", "unit").distinct().groupBy("criterion").agg(F.count("*").alias("units"))
    every = ratings.select("criterion").distinct().join(n.join(e, "criterion").join(units, "criterion"), "criterion", "left")
    d_e, equal = F.col("e") / (F.col("n") * (F.col("n") - 1)), F.col("fewest") == F.col("most")
    reason = (
        F.when(F.col("n").isNull(), "no unit was rated by two or more: there is nothing to monitor")
        .when((d_e <= 0) | (F.col("top") <= 0), "no expected disagreement: all ratings that can be paired are equal")
        .when(~equal, "units have different numbers of ratings: the bounds are for the mean over units, alpha weighs units by their ratings")
    )
    return every.select("criterion", F.coalesce("units", F.lit(0)).alias("units"), "top", d_e.alias("d_e"), F.coalesce(equal, F.lit(True)).alias("equal_ratings"), reason.alias("reason"))


def monitor_summary(ratings: DataFrame, metric: str = "ordinal", kind: str = "eb", threshold: float = GATE_ALPHA) -> DataFrame:
    """(criterion, units, top, d_e, equal_ratings, reason, n, alpha_lo, alpha_hi, cleared_at): one row for every criterion, monitored or not.

    reason: why a criterion has no bounds, or in what they fall short (equal_ratings is false). n: units monitored, with the last bounds;
    cleared_at: the first unit, from 1, at which the whole interval is at the gate or above.
    """
    monitored, bounds = _monitor(ratings, metric, kind)
    last = bounds.groupBy("criterion").agg(F.max(F.struct("t", "alpha_lo", "alpha_hi")).alias("last"), F.min(F.when(F.col("alpha_lo") >= threshold, F.col("t"))).alias("cleared_at"))
    joined = monitored.join(last, "criterion", "left")
    return joined.select("criterion", "units", "top", "d_e", "equal_ratings", "reason", F.coalesce("last.t", F.lit(0)).alias("n"), "last.alpha_lo", "last.alpha_hi", "cleared_at")


def gate(ratings: DataFrame, criteria: DataFrame, metric: str = "ordinal", threshold: float = GATE_ALPHA) -> DataFrame:
    """(criterion, alpha, action) for criteria(criterion, machine) and whatever was rated.

    keep or rewrite by alpha; unmeasured where it is undefined or nothing was
    rated; exempt if a machine scores the criterion and nobody rated it.
    """
    measured = alpha(ratings, metric).select("criterion", "alpha", F.lit(True).alias("rated"))
    joined = criteria.join(measured, "criterion", "full_outer")
    action = F.when(F.col("rated").isNull() & F.coalesce("machine", F.lit(False)), "exempt").when(F.col("alpha").isNull(), "unmeasured").when(F.col("alpha") >= threshold, "keep").otherwise("rewrite")
    return joined.select("criterion", "alpha", action.alias("action"))


def gate_report(gated: DataFrame) -> DataFrame:
    """One row: counts of each action, and passed: nothing to rewrite or unmeasured."""
    n = lambda a: F.count_if(F.col("action") == a)
    return gated.agg(*[n(a).alias(a) for a in ("keep", "rewrite", "unmeasured", "exempt")], ((n("rewrite") == 0) & (n("unmeasured") == 0)).alias("passed"))
