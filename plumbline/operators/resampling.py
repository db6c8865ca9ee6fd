"""Bootstrap statistics of repeated timings, and reliability under resampling.

Random numbers are hashed from (seed, replicate, group), so a draw needs no
state, is the same wherever a task runs, and other engines can repeat it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.digests import Endings
from plumbline.functions.hashing import unit
from plumbline.operators.reliability import METRICS, unit_counts
from plumbline.tables import cut

MIN_SLOWDOWN = 1.15
UNLOCKED_PERFORMANCE, UNLOCKED_WITNESS = 2.0, 1.5
#: Draws of a bootstrap of timings.
REPLICATES = 2000
#: Draws of a bootstrap of alpha.
ALPHA_REPLICATES = 400
#: Cumulative probabilities of the Poisson distribution of mean 1.
POISSON_ONE = [math.exp(-1) * math.fsum(1 / math.factorial(j) for j in range(k + 1)) for k in range(16)]
#: Proposals for a gamma number; one of twenty is rejected at worst.
TRIES = 6
#: Bins to a doubling of a time.
BINS = 4096


def _replicates(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _gamma(a: Column, *parts: Column) -> Column:
    """A Gamma(a) number, a >= 1, hashed from parts: the first accepted of TRIES proposals of Marsaglia and Tsang's method (none: d, in one of 10**7 cases at worst)."""
    d = a - 1.0 / 3.0
    proposals = F.transform(
        F.sequence(F.lit(0), F.lit(TRIES - 1)),
        lambda i: F.struct((F.sqrt(-2 * F.log(1 - unit(*parts, F.lit("r"), i))) * F.cos(2 * math.pi * unit(*parts, F.lit("p"), i))).alias("x"), F.log(1 - unit(*parts, F.lit("u"), i)).alias("u")),
    )
    proposals = F.transform(proposals, lambda e: F.struct(e["x"].alias("x"), e["u"].alias("u"), F.pow(1 + e["x"] / F.sqrt(9 * d), F.lit(3)).alias("v")))
    accepted = F.filter(proposals, lambda e: (e["v"] > 0) & (e["u"] < e["x"] * e["x"] / 2 + d - d * e["v"] + d * F.log(e["v"])))
    return F.coalesce(d * F.get(accepted, F.lit(0))["v"], d)


def _middle_ranks(sizes: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(shape, side, n, replicate, r1, r2): the two middle ranks (one, if n is odd) of each resample of ranks 1..n; those of the samples themselves as replicate -1.

    A resample is n uniform numbers, so its middle one is a Beta number, and the
    next one the least of those above it: no resample is written out.
    """
    n = F.col("n")
    lower, upper = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    part = lambda tag: (F.lit(seed), F.col("replicate"), F.col("shape"), F.col("side"), F.lit(tag))
    rank = lambda u: F.least(n, (F.floor(n * u) + 1).cast("long"))
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = sizes.withColumn("replicate", _replicates(replicates)).repartition(tasks, "shape", "side", "replicate").withColumns({"g": _gamma(lower, *part("g")), "h": _gamma(upper, *part("h"))})
    drawn = drawn.withColumn("u", F.col("g") / (F.col("g") + F.col("h")))
    following = F.col("u") + (1 - F.col("u")) * (1 - F.pow(1 - unit(*part("next")), 2.0 / n))
    drawn = drawn.select("shape", "side", "n", "replicate", rank(F.col("u")).alias("r1"), F.when(n % 2 == 1, rank(F.col("u"))).otherwise(rank(following)).alias("r2"))
    return drawn.unionByName(sizes.select("shape", "side", "n", F.lit(-1).alias("replicate"), lower.alias("r1"), upper.alias("r2")))


def _bin(x: Column) -> Column:
    """A step function that never falls: BINS steps to each doubling of |x|."""
    step = F.floor(F.log2(F.abs(x)) * BINS) + BINS * 1100
    return F.when(x > 0, step).when(x < 0, -step).otherwise(F.lit(0)).cast("long")


def _medians(samples: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(shape, side, n, replicate, median) of resamples, and of the samples themselves as replicate -1.

    Ranks are found in two levels: equal values are counted, then bins; running
    totals of the bins (a bounded number) tell which hold a rank that was drawn,
    and only their values are ordered. No task holds all values of a shape.
    """
    group = ["shape", "side"]
    values = samples.where(F.col("seconds").isNotNull() & ~F.isnan("seconds") & (F.abs("seconds") < float("inf")))
    values = values.groupBy(*group, F.col("seconds").cast("double").alias("seconds")).agg(F.count("*").alias("k")).withColumn("bin", _bin(F.col("seconds")))
    bins = values.groupBy(*group, "bin").agg(F.sum("k").alias("k"))
    ranks = _middle_ranks(bins.groupBy(*group).agg(F.sum("k").alias("n")), replicates, seed)
    wanted = ranks.select(*group, "n", "replicate", F.explode(F.array("r1", "r2")).alias("at"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("k").over(earlier(*group).orderBy("bin")), F.lit(0))
    span = wanted.groupBy(*group).agg(F.min("at").alias("least"), F.max("at").alias("most"))
    held = bins.withColumn("start", start).join(span, group).where((F.col("start") < F.col("most")) & (F.col("start") + F.col("k") >= F.col("least"))).select(*group, "bin", "start")
    within = F.coalesce(F.sum("k").over(earlier(*group, "bin").orderBy("seconds")), F.lit(0))
    known = values.join(held, [*group, "bin"]).select(*group, (F.col("start") + within + 1).alias("at"), "seconds")
    upto = Window.partitionBy(*group).orderBy("at", F.col("seconds").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    looked_up = known.unionByName(wanted, allowMissingColumns=True).withColumn("value", F.last("seconds", ignorenulls=True).over(upto)).where("n is not null")
    return looked_up.groupBy(*group, "replicate").agg(F.first("n").alias("n"), F.avg("value").alias("median"))


def bootstrap_medians(samples: DataFrame, replicates: int = REPLICATES, seed: str = "b") -> DataFrame:
    """(shape, side, replicate, median): medians of samples(shape, side, seconds) drawn with replacement.

    Null and infinite times and those that are no number are left out; a side
    without others has no row, nor has an empty table.
    """
    return _medians(samples, replicates, seed).where("replicate >= 0").select("shape", "side", "replicate", "median")


def median_ci(samples: DataFrame, replicates: int = REPLICATES, level: float = 0.95) -> DataFrame:
    """(shape, side, n, median, low, high): percentile interval of the median; with one sample it is that sample."""
    tail = (1 - level) / 2
    drawn = F.when(F.col("replicate") >= 0, F.col("median"))
    return _medians(samples, replicates, "b").groupBy("shape", "side").agg(
        F.first("n").alias("n"), F.max(F.when(F.col("replicate") < 0, F.col("median"))).alias("median"), F.percentile(drawn, F.lit(tail)).alias("low"), F.percentile(drawn, F.lit(1 - tail)).alias("high")
    )


def ratio_ci(samples: DataFrame, numerator: str = "baseline", denominator: str = "candidate", replicates: int = REPLICATES, level: float = 0.95) -> DataFrame:
    """(shape, ratio, low, high, dropped): ratio of two sides' medians, each resampled for itself; draws with a denominator of 0 or less are dropped and counted."""
    tail = (1 - level) / 2
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("median")))
    both = _medians(samples, replicates, "b").groupBy("shape", "replicate").agg(side(numerator).alias("a"), side(denominator).alias("b")).where("a is not null and b is not null")
    ratio = F.when(F.col("b") > 0, F.col("a") / F.col("b"))
    drawn = F.when(F.col("replicate") >= 0, ratio)
    return both.groupBy("shape").agg(
        F.max(F.when(F.col("replicate") < 0, ratio)).alias("ratio"), F.percentile(drawn, F.lit(tail)).alias("low"), F.percentile(drawn, F.lit(1 - tail)).alias("high"), F.count_if((F.col("replicate") >= 0) & (F.col("b") <= 0)).alias("dropped")
    )


def widened(point: Column, end: Column, low: Column, factor: float) -> Column:
    """An interval's end moved away from the point: geometrically, or linearly if the point or the low end isn't positive."""
    if factor <= 1:
        return end
    return F.when((point <= 0) | (low <= 0), point + (end - point) * factor).otherwise(point * F.pow(end / point, F.lit(factor)))


def widen(intervals: DataFrame, factor: float = UNLOCKED_PERFORMANCE) -> DataFrame:
    """intervals(ratio, low, high) widened about the ratio; the raw ends stay in raw_low and raw_high."""
    raw = intervals.withColumns({"raw_low": F.col("low"), "raw_high": F.col("high")})
    return raw.withColumns({"low": widened(F.col("ratio"), F.col("raw_low"), F.col("raw_low"), factor), "high": widened(F.col("ratio"), F.col("raw_high"), F.col("raw_low"), factor)})


def classify(low: Column, high: Column) -> Column:
    return F.when(low > 1, "faster").when(high < 1, "slower").otherwise("inconclusive")


def speedup_gate(low: Column, high: Column, demanded: Column) -> Column:
    """FAIL if the interval lies below what is demanded, SKIP if it reaches below it or is missing, else PASS."""
    return F.when(low.isNull() | high.isNull() | demanded.isNull(), "SKIP").when(high < demanded, "FAIL").when(low < demanded, "SKIP").otherwise("PASS")


def performance_witness(intervals: DataFrame, factor: float = UNLOCKED_WITNESS) -> DataFrame:
    """Shapes whose slowdown is certain: the widened interval's low end reaches MIN_SLOWDOWN."""
    return widen(intervals, factor).where(F.col("low") >= MIN_SLOWDOWN)


def timing_violations(medians: DataFrame, work: DataFrame) -> DataFrame:
    """medians(shape, median) faster than work(shape, bytes, bandwidth) lets them be."""
    floor = F.col("bytes") / F.col("bandwidth")
    return medians.join(work, "shape").withColumn("floor", floor).where(F.col("median") < F.col("floor"))


def roofline(medians: DataFrame, work: DataFrame) -> DataFrame:
    """Achieved bytes a second as a share of the bandwidth; null with a reason without one."""
    joined = medians.join(work, "shape", "left")
    achieved = F.try_divide(F.col("bytes").cast("double"), F.col("median"))
    return joined.select("shape", achieved.alias("achieved"), F.try_divide(achieved, F.col("bandwidth").cast("double")).alias("fraction"), F.when(F.col("bandwidth").isNull(), "no bandwidth known").alias("reason"))


#: Criteria, kinds and values whose sums over all draws a task holds at a time.
MAX_KEYS = 4096


def _poisson_one(digits: np.ndarray) -> np.ndarray:
    """The Poisson numbers of mean 1 at digits / 2**52: how many of POISSON_ONE each reaches."""
    return np.searchsorted([math.ceil(c * (1 << 52)) for c in POISSON_ONE], digits, side="right").astype(float)


def _weighted_sums(units: DataFrame, replicates: int) -> DataFrame:
    """(criterion, kind, value, replicate, amount): sums over units(criterion, unit, entries) of their entries' amounts, times the unit's share in the replicate.

    A batch of units is hashed at once for each replicate and leaves one list of
    sums for each of its criteria, kinds and values: no row is made for a unit's share.
    """
    kind = units.schema["criterion"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from part(batch)

    def part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        entries, criterion = batch.column("entries"), batch.column("criterion")
        unit_at = np.repeat(np.arange(batch.num_rows), np.diff(entries.offsets.to_numpy()))
        what, value, amount = (entries.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
        known = criterion.dictionary_encode()
        code = pc.fill_null(known.indices, len(known.dictionary)).to_numpy(zero_copy_only=False)[unit_at]
        keys, key = np.unique(np.stack([code.astype(float), what.astype(float), value]), axis=1, return_inverse=True)
        if keys.shape[1] > MAX_KEYS and batch.num_rows > 1:
            half = batch.num_rows // 2
            yield from part(batch.slice(0, half))
            yield from part(batch.slice(half))
            return
        key, endings = key.reshape(-1), Endings(batch.column("ending").to_pylist())
        out = np.empty((keys.shape[1], replicates))
        for r in range(replicates):
            out[:, r] = np.bincount(key, amount * _poisson_one(endings.digits(f"a:{r}".encode()))[unit_at], keys.shape[1])
        names = [*known.dictionary, pa.scalar(None, criterion.type)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(keys.shape[1] + 1) * replicates, pa.int32()), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([names[int(k)].as_py() for k in keys[0]], criterion.type), pa.array(keys[1].astype(np.int32)), pa.array(keys[2]), lists], ["criterion", "kind", "value", "sums"])

    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ending = F.concat_ws(":", F.lit(""), F.col("unit").cast("string"), F.col("criterion").cast("string"))
    spread = units.repartition(tasks, "criterion", "unit").select("criterion", ending.cast("binary").alias("ending"), "entries")
    found = spread.mapInArrow(sums, f"criterion {kind}, kind int, value double, sums array<double>")
    return found.select("criterion", "kind", "value", F.posexplode("sums").alias("replicate", "amount")).groupBy("criterion", "kind", "value", "replicate").agg(F.sum("amount").alias("amount"))


def bootstrap_alpha(ratings: DataFrame, metric: str = "interval", replicates: int = ALPHA_REPLICATES, level: float = 0.95) -> DataFrame:
    """(criterion, low, high, n_defined, n_undefined): alpha's interval by resampling units (nominal or interval metric).

    A unit's share in a replicate is a Poisson number of mean 1 hashed from the
    unit, so units need neither numbers nor a join, and sums are made before
    anything is shuffled. Sums over values give observed and expected
    disagreement; draws without variation are dropped and counted.
    """
    if metric not in METRICS or metric not in ("nominal", "interval"):
        raise ValueError("the bootstrap is for the nominal and the interval metric")
    counts = unit_counts(ratings)
    m, s1, s2 = F.col("m").cast("double"), F.col("s1"), F.col("s2")
    entry = lambda kind, amount, value=0.0: F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"), amount.cast("double").alias("amount"))
    if metric == "interval":
        own = counts.groupBy("criterion", "unit", "m").agg(F.sum(F.col("k") * F.col("value")).alias("s1"), F.sum(F.col("k") * F.col("value") * F.col("value")).alias("s2"))
        entries = F.array(entry(0, m), entry(1, 2 * (m * s2 - s1 * s1) / (m - 1)), entry(2, s1), entry(3, s2))
    else:
        own = counts.groupBy("criterion", "unit", "m").agg(F.sum(F.col("k") * F.col("k")).alias("kk"), F.collect_list(F.struct(F.lit(4).alias("kind"), F.col("value").cast("double").alias("value"), F.col("k").cast("double").alias("amount"))).alias("cells"))
        entries = F.concat(F.array(entry(0, m), entry(1, (m * m - F.col("kk")) / (m - 1))), "cells")
    sums = _weighted_sums(own.select("criterion", "unit", entries.alias("entries")), replicates)
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("amount")))
    squares = F.sum(F.when(F.col("kind") == 4, F.col("amount") * F.col("amount")))
    sums = sums.groupBy("criterion", "replicate").agg(total(0).alias("m"), total(1).alias("o"), total(2).alias("s1"), total(3).alias("s2"), squares.alias("sq"))
    e = 2 * (F.col("m") * s2 - s1 * s1) if metric == "interval" else F.col("m") * F.col("m") - F.col("sq")
    value = F.when(e > 1e-9, 1 - F.col("o") / F.col("m") / (e / (F.col("m") * (F.col("m") - 1))))
    tail = (1 - level) / 2
    each = sums.select("criterion", value.alias("alpha"))
    return each.groupBy("criterion").agg(F.percentile("alpha", F.lit(tail)).alias("low"), F.percentile("alpha", F.lit(1 - tail)).alias("high"), F.count("alpha").alias("n_defined"), F.count_if(F.col("alpha").isNull()).alias("n_undefined"))


#: Units of a hash range that deals its draws on its own, and most of such ranges.
RANGE_UNITS, MAX_RANGES = 2048, 4096
#: Values and units of a range whose shares are one matrix; more of them are added up value by value.
MAX_CELLS = 1 << 22


def _generator(*key) -> np.random.Generator:
    """Random numbers that depend on the key alone."""
    return np.random.default_rng(list(hashlib.sha256(repr(key).encode()).digest()))


def dealt_draws(units: DataFrame, replicates: int) -> tuple[DataFrame, DataFrame]:
    """(units(criterion, unit, cells) with their range, (criterion, range, draws): the draws of a range in each replicate, as many in all as the criterion has units).

    A criterion's draws are first dealt to hash ranges by their numbers of units, a multinomial draw over counts only; what happens
    in a range then needs nothing of the others.
    """
    units = cut(units)
    ranges = max(1, min(MAX_RANGES, units.count() // RANGE_UNITS))
    placed = units.withColumn("range", F.pmod(F.xxhash64("criterion", "unit"), F.lit(ranges)).cast("int"))

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by("range")
        n, criterion = table.column("n").to_numpy(), table.column("criterion")[0].as_py()
        draws = np.stack([_generator("ranges", criterion, r).multinomial(n.sum(), n / n.sum()) for r in range(replicates)], axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * replicates, pa.int32()), pa.array(draws.ravel()))
        return pa.table({"criterion": table.column("criterion"), "range": table.column("range"), "draws": lists})

    kind = units.schema["criterion"].dataType.simpleString()
    counts = placed.groupBy("criterion", "range").agg(F.count("*").alias("n"))  # at most MAX_RANGES rows a criterion
    return placed, counts.groupBy("criterion").applyInArrow(deal, f"criterion {kind}, range int, draws array<long>")


def resample_sums(ratings: DataFrame, replicates: int = ALPHA_REPLICATES) -> DataFrame:
    """(criterion, a, b, sums): over the drawn units of each replicate, ratings with value a (b null), and coincidences of a and b, a < b.

    Every replicate draws as many units, with replacement, as the criterion has; with a null too, sums are these numbers of draws.
    """
    cell = F.struct(F.col("value").cast("double").alias("value"), F.col("k").alias("k"))
    units = unit_counts(ratings).groupBy("criterion", "unit").agg(F.collect_list(cell).alias("cells"))  # a unit's different values
    kind = units.schema["criterion"].dataType.simpleString()

    def draw(table: pa.Table, dealt: pa.Table) -> pa.Table:
        """A range's share of the sums."""
        table = table.combine_chunks().sort_by("unit")
        criterion, place = table.column("criterion")[0].as_py(), table.column("range")[0].as_py()
        total, n = dealt.column("draws")[0].as_py(), table.num_rows
        keys: dict[tuple, list[tuple[int, float]]] = {}
        for u, cells in enumerate(table.column("cells").to_pylist()):
            m = sum(c["k"] for c in cells)
            cells.sort(key=lambda c: c["value"])
            for i, c in enumerate(cells):
                keys.setdefault((c["value"], None), []).append((u, c["k"]))
                for d in cells[i + 1 :]:
                    keys.setdefault((c["value"], d["value"]), []).append((u, 2 * c["k"] * d["k"] / (m - 1)))
        at = [np.array([u for u, _ in v]) for v in keys.values()]
        worth = [np.array([w for _, w in v]) for v in keys.values()]
        weight = np.empty((n, replicates))
        for r in range(replicates):
            weight[:, r] = _generator("units", criterion, place, r).multinomial(total[r], np.full(n, 1 / n))
        sums = np.empty((len(keys) + 1, replicates))
        if len(keys) * n <= MAX_CELLS:
            shares = np.zeros((len(keys), n))
            for row, i, w in zip(shares, at, worth, strict=True):
                row[i] = w
            sums[:-1] = shares @ weight
        else:
            for k, (i, w) in enumerate(zip(at, worth, strict=True)):
                sums[k] = w @ weight[i]
        sums[-1] = weight.sum(axis=0)
        return _sums_table(criterion, [*keys, (None, None)], sums)

    def add(table: pa.Table) -> pa.Table:
        """One key's shares, a row for each range at most."""
        shares = np.array(table.column("sums").combine_chunks().flatten()).reshape(table.num_rows, replicates)
        return _sums_table(table.column("criterion")[0].as_py(), [(table.column("a")[0].as_py(), table.column("b")[0].as_py())], shares.sum(axis=0)[None])

    def _sums_table(criterion, keys: list[tuple], sums: np.ndarray) -> pa.Table:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * replicates, pa.int32()), pa.array(sums.ravel()))
        return pa.table({"criterion": pa.array([criterion] * len(keys)), "a": pa.array([k[0] for k in keys], pa.float64()), "b": pa.array([k[1] for k in keys], pa.float64()), "sums": lists})

    schema = f"criterion {kind}, a double, b double, sums array<double>"
    placed, dealt = dealt_draws(units, replicates)  # a range's draws come once, not with each of its units
    shares = placed.groupBy("criterion", "range").cogroup(dealt.groupBy("criterion", "range")).applyInArrow(draw, schema)
    return shares.groupBy("criterion", "a", "b").applyInArrow(add, schema)


def resample_alpha(ratings: DataFrame, metric: str = "ordinal", replicates: int = ALPHA_REPLICATES, level: float = 0.95) -> DataFrame:
    """(criterion, low, high, n_defined, n_undefined): alpha's interval by drawing as many units as there are, with replacement.

    Any metric: each replicate has its own counts of values, and so its own mid-ranks. Replicates without variation are left out and counted.
    A criterion's different values, and pairs of them that a unit has, are few.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    sums = resample_sums(ratings, replicates)
    kind = sums.schema["criterion"].dataType.simpleString()

    def alphas(table: pa.Table) -> pa.Table:
        rows = sorted((r for r in table.to_pylist() if r["a"] is not None), key=lambda r: (r["b"] is not None, r["a"], r["b"] or 0))
        n = np.array([r["sums"] for r in rows if r["b"] is None])
        values = np.array([r["a"] for r in rows if r["b"] is None])
        pairs = [(r["a"], r["b"], np.array(r["sums"])) for r in rows if r["b"] is not None]
        total = n.sum(axis=0)
        place = np.cumsum(n, axis=0) - n / 2 if metric == "ordinal" else np.broadcast_to(values[:, None], n.shape)
        if metric == "ratio" and (values < 0).any():
            raise ValueError("the ratio metric is for values of at least 0")

        def gap(c: np.ndarray, k: np.ndarray) -> np.ndarray:
            if metric == "nominal":
                return np.where(c == k, 0.0, 1.0)
            both = c + k if metric == "ratio" else 1.0
            return np.divide(c - k, both, out=np.zeros(np.broadcast(c, k).shape), where=np.asarray(both) > 0) ** 2

        expected = sum((n[i] * n * gap(place[i], place)).sum(axis=0) for i in range(len(values)))
        at = {v: i for i, v in enumerate(values.tolist())}
        observed = sum((o * gap(place[at[a]], place[at[b]]) for a, b, o in pairs), start=np.zeros(replicates))
        fine = expected > 1e-9 * np.maximum(total, 1) ** 2
        alpha = 1 - observed[fine] / total[fine] / (expected[fine] / (total[fine] * (total[fine] - 1)))
        tail = (1 - level) / 2
        ends = np.quantile(alpha, [tail, 1 - tail]).tolist() if len(alpha) else [None, None]
        return pa.table({"criterion": [table.column("criterion")[0].as_py()], "low": pa.array(ends[:1], pa.float64()), "high": pa.array(ends[1:], pa.float64()), "n_defined": [len(alpha)], "n_undefined": [int((~fine).sum())]})

    return sums.groupBy("criterion").applyInArrow(alphas, f"criterion {kind}, low double, high double, n_defined long, n_undefined long")
