"""Training steps, checkpoints and invariance as relations; multi-step loops run on the driver over cut lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources import versions
from plumbline.tables import cut

FP32_EPS = 2.0**-23


def gradient(x: DataFrame, y: DataFrame, w: DataFrame) -> DataFrame:
    """(k, c, g): mean gradient of softmax cross-entropy over all samples; x(i, k, v), y(i, label), w(k, c, w)."""
    logits = x.join(w, "k").groupBy("i", "c").agg(F.sum(F.col("v") * F.col("w")).alias("z"))
    by = Window.partitionBy("i")
    top = logits.withColumn("e", F.exp(F.col("z") - F.max("z").over(by)))
    p = top.withColumn("p", F.col("e") / F.sum("e").over(by)).join(y, "i").select("i", "c", (F.col("p") - F.when(F.col("c") == F.col("label"), 1.0).otherwise(0.0)).alias("r"))
    n = y.agg(F.count("*").alias("n"))
    sums = x.join(p, "i").groupBy("k", "c").agg(F.sum(F.col("v") * F.col("r")).alias("s"))
    return sums.crossJoin(F.broadcast(n)).select("k", "c", (F.col("s") / F.col("n")).alias("g"))  # one row


def loss(x: DataFrame, y: DataFrame, w: DataFrame) -> DataFrame:
    """(loss): mean softmax cross-entropy."""
    logits = x.join(w, "k").groupBy("i", "c").agg(F.sum(F.col("v") * F.col("w")).alias("z"))
    by = Window.partitionBy("i")
    each = logits.withColumn("m", F.max("z").over(by)).withColumn("l", F.log(F.sum(F.exp(F.col("z") - F.col("m"))).over(by)) + F.col("m")).join(y, "i").where("c = label")
    return each.agg(F.avg(F.col("l") - F.col("z")).alias("loss"))


def sgd_step(x: DataFrame, y: DataFrame, w: DataFrame, rate: float, max_norm: float) -> DataFrame:
    """w after one step with the gradient clipped to a global norm."""
    g = gradient(x, y, w)
    norm = g.agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("norm"))
    clip = F.least(F.lit(1.0), F.lit(max_norm) / F.greatest("norm", F.lit(1e-12)))
    return w.join(g, ["k", "c"], "left").crossJoin(F.broadcast(norm)).select("k", "c", (F.col("w") - F.lit(rate) * clip * F.coalesce("g", F.lit(0.0))).alias("w"))  # one row


def train(x: DataFrame, y: DataFrame, w: DataFrame, steps: int, rate: float = 0.1, max_norm: float = 1.0) -> DataFrame:
    """w after some steps; each is a table of its own, so plans don't grow."""
    for _ in range(steps):
        w = cut(sgd_step(x, y, w, rate, max_norm))
    return w


def adam_step(state: DataFrame, g: DataFrame, step: int, rate: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """state(name, idx, w, m, v) after one step with g(name, idx, g)."""
    grad = F.coalesce("g", F.lit(0.0))
    moved = state.join(g, ["name", "idx"], "left").select("name", "idx", "w", (beta1 * F.col("m") + (1 - beta1) * grad).alias("m"), (beta2 * F.col("v") + (1 - beta2) * grad * grad).alias("v"))
    m, v = F.col("m") / (1 - beta1**step), F.col("v") / (1 - beta2**step)
    return moved.select("name", "idx", (F.col("w") - rate * m / (F.sqrt(v) + eps)).alias("w"), "m", "v")


def adam(state: DataFrame, grad: Callable[[DataFrame], DataFrame], first: int, last: int, **rates: float) -> DataFrame:
    """Steps first .. last (from 1); grad makes (name, idx, g) from the state."""
    for step in range(first, last + 1):
        state = cut(adam_step(state, grad(state), step, **rates))
    return state


def resumable(path: str, start: DataFrame, step: Callable[[DataFrame, int], DataFrame], last: int) -> DataFrame:
    """The state after step last, from whatever step was reached at path before, or from start.

    Each state is published there as a version with its step's number, start as 0: a run that ends anywhere, in the middle
    of a step too, goes on from the last whole one, and a second call changes nothing. step(state, number) makes a state from the one before.
    What was reached beyond last isn't undone: it is an error.
    """
    spark = start.sparkSession
    known = versions.versions(spark, path)
    if not known:
        known = [versions.publish(start, path, before=[])]
    if known[-1]["number"] > last:
        raise ValueError(f"{path} has reached step {known[-1]['number']}, beyond {last}")
    for number in range(known[-1]["number"] + 1, last + 1):
        versions.publish(step(versions.current(spark, path), number), path, before=versions.versions(spark, path))
    return versions.current(spark, path)


def reshard_saved(path: str, ranks: int) -> DataFrame:
    """The sharded state saved at path, dealt to other ranks, as a version of the same step."""
    spark = SparkSession.getActiveSession()
    known = versions.versions(spark, path)
    versions.publish(reshard(versions.current(spark, path), ranks), path, before=known, number=known[-1]["number"])
    return versions.current(spark, path)


def shard(params: DataFrame, ranks: int) -> DataFrame:
    """params(name, idx, ...) with rank and offset: contiguous shards of equal size (the last may be short)."""
    size = params.groupBy("name").agg(F.max("idx").alias("top"))
    per = F.floor((F.col("top") + ranks) / ranks).cast("long")
    return params.join(size, "name").withColumn("per", per).withColumns({"rank": F.floor(F.col("idx") / F.col("per")).cast("long"), "offset": F.col("idx") % F.col("per")}).drop("top")


def reshard(sharded: DataFrame, ranks: int) -> DataFrame:
    """Shards gathered in rank order and dealt anew: rank and offset change, names, indices and values don't."""
    whole = sharded.withColumn("idx", F.col("rank") * F.col("per") + F.col("offset")).drop("rank", "offset", "per")
    return shard(whole, ranks)


def step_deviation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(quantity, step, dev) of two series(quantity, step, value) at the steps that both have."""
    return a.join(b.select("quantity", "step", F.col("value").alias("other")), ["quantity", "step"]).select("quantity", "step", F.abs(F.col("value") - F.col("other")).alias("dev"))


def noise_floor(runs: DataFrame, eps: float = FP32_EPS) -> DataFrame:
    """(quantity, measured, floor) of runs(run, quantity, step, value): the largest gap of any two runs at a step, but at least eps times the scale.

    The largest gap of any pair is the range, so no pairs are made.
    """
    ranges = runs.groupBy("quantity", "step").agg((F.max("value") - F.min("value")).alias("gap"), F.max(F.abs("value")).alias("scale"))
    return ranges.groupBy("quantity").agg(F.max("gap").alias("measured"), F.greatest(F.max("gap"), F.max("scale") * eps).alias("floor"))


def compare_worlds(single: DataFrame, multi: DataFrame, floor: DataFrame, k: float = 4.0) -> DataFrame:
    """(quantity, peak, peak_step, first_bad, ok): deviations held against k times the floor; the first step of equal peaks."""
    dev = step_deviation(single, multi).join(floor.select("quantity", "floor"), "quantity")
    bad = F.col("dev") > F.col("floor") * k
    return dev.groupBy("quantity").agg(F.max("dev").alias("peak"), F.max_by("step", F.struct("dev", -F.col("step"))).alias("peak_step"), F.min(F.when(bad, F.col("step"))).alias("first_bad"), (F.count_if(bad) == 0).alias("ok"))


def l2_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(distance) of vectors (name, idx, w)."""
    return a.join(b.select("name", "idx", F.col("w").alias("o")), ["name", "idx"]).agg(F.sqrt(F.sum(F.pow(F.col("w") - F.col("o"), F.lit(2)))).alias("distance"))


def standardize(values: DataFrame, column: str) -> DataFrame:
    """values with the column at mean 0 and population deviation 1 (unchanged if all are equal)."""
    s = values.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_sd"))
    return values.crossJoin(F.broadcast(s)).withColumn(column, F.when(F.col("_sd") > 0, (F.col(column) - F.col("_mean")) / F.col("_sd")).otherwise(F.col(column))).drop("_mean", "_sd")  # one row


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)) without overflow."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
