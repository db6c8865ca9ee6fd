"""Reference algorithms as relations: attention, layer norm, products, autotuning, sharded streams.

Matrices are long: (i, k, v). Partial sums of blocks and their merge are what
partial and final aggregation do anyway.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import scans

# Tile configurations in their order, and the cost model.
CONFIGS = [(16, 16, 16), (32, 32, 32), (32, 32, 64), (32, 64, 32), (64, 32, 64), (64, 64, 32), (64, 64, 64), (128, 64, 64)]
NS_PER_MAC, NS_PER_BYTE, NS_PER_TILE, NS_PER_K_STEP, ITEM_BYTES = 1 / 512, 1 / 256, 200.0, 60.0, 8


def attention(queries: DataFrame, keys: DataFrame, k_start: int, n_ctx: int, block: int = 16) -> DataFrame:
    """(grp, qi, d, out): softmax(q k / sqrt(dims)) v over keys at positions k_start .. k_start + n_ctx - 1 of the same group.

    queries(grp, qi, vec); keys(grp, pos, vec, value), vectors as arrays. Each
    block of keys yields a maximum, a sum and a weighted sum, which are then
    rescaled to the common maximum. A query without keys in the window gives zeros.
    """
    window = keys.where((F.col("pos") >= k_start) & (F.col("pos") < k_start + n_ctx)).select("grp", "pos", F.col("vec").alias("kv"), "value")
    dot = F.aggregate(F.zip_with("vec", "kv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / F.sqrt(F.size("vec").cast("double"))
    scores = queries.join(window, "grp").select("grp", "qi", "pos", F.floor((F.col("pos") - k_start) / block).alias("block"), dot.alias("s"), "value")
    tops = scores.groupBy("grp", "qi", "block").agg(F.max("s").alias("m"))
    parts = scores.join(tops, ["grp", "qi", "block"]).select("grp", "qi", "block", "m", F.exp(F.col("s") - F.col("m")).alias("e"), F.posexplode("value").alias("d", "v"))
    part = parts.groupBy("grp", "qi", "block", "d").agg(F.first("m").alias("m"), F.sum("e").alias("l"), F.sum(F.col("e") * F.col("v")).alias("acc"))
    whole = Window.partitionBy("grp", "qi", "d")
    scaled = part.withColumn("r", F.exp(F.col("m") - F.max("m").over(whole)))
    merged = scaled.groupBy("grp", "qi", "d").agg((F.sum(F.col("acc") * F.col("r")) / F.sum(F.col("l") * F.col("r"))).alias("out"))
    every = queries.select("grp", "qi", F.posexplode(F.transform("vec", lambda x: F.lit(0.0))).alias("d", "zero"))
    return every.join(merged, ["grp", "qi", "d"], "left").select("grp", "qi", "d", F.coalesce("out", "zero").alias("out"))


def layer_norm(rows: DataFrame, n_valid: int, eps: float = 1e-5) -> DataFrame:
    """(row, pos, out) of rows(row, pos, x, weight, bias) over positions below n_valid; zero beyond. The variance is centred, in two passes."""
    valid = F.col("pos") < n_valid
    w = Window.partitionBy("row")
    centred = rows.withColumn("mean", F.avg(F.when(valid, F.col("x"))).over(w)).withColumn("c", F.col("x") - F.col("mean"))
    scaled = centred.withColumn("var", F.avg(F.when(valid, F.col("c") * F.col("c"))).over(w))
    return scaled.select("row", "pos", F.when(valid, F.col("c") / F.sqrt(F.col("var") + eps) * F.col("weight") + F.col("bias")).otherwise(0.0).alias("out"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of a(i, k, v) and b(k, j, v); what has no partner adds nothing."""
    return a.select("i", "k", F.col("v").alias("x")).join(b.select("k", "j", F.col("v").alias("y")), "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def unpack_nibbles(packed: DataFrame) -> DataFrame:
    """(k, j, q) of packed(k2, j, byte): row 2 k2 is in the low four bits, the next in the high ones."""
    both = F.array(F.col("byte").bitwiseAND(15), F.shiftright("byte", 4).bitwiseAND(15))
    return packed.select("k2", "j", F.posexplode(both).alias("half", "q")).select((F.col("k2") * 2 + F.col("half")).alias("k"), "j", "q")


def dequantize(packed: DataFrame, groups: DataFrame, group_size: int) -> DataFrame:
    """(k, j, v) with v = (q - zero) * scale of the row's group; groups(g, j, scale, zero)."""
    q = unpack_nibbles(packed).withColumn("g", F.floor(F.col("k") / group_size).cast("long"))
    return q.join(groups, ["g", "j"]).select("k", "j", ((F.col("q") - F.col("zero")) * F.col("scale")).alias("v"))


def power_of_two(v: Column) -> Column:
    """The least power of two that is at least v (1 for less)."""
    return F.element_at(F.filter(F.array(*[F.lit(1 << p).cast("long") for p in range(62)]), lambda p: p >= v), 1)


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("long")


def stage_of(layer: Column, layers: Column, stages: Column) -> Column:
    """The pipeline stage that owns a layer when layers are split into contiguous stages; a stage may own none."""
    return F.floor(layer * stages / layers).cast("long")


def tile_cost(m: Column, n: Column, k: Column, bm: Column, bn: Column, bk: Column) -> Column:
    """Modelled nanoseconds of an m n k product in tiles of bm bn bk."""
    tm, tn, tk = ceil_div(m, bm), ceil_div(n, bn), ceil_div(k, bk)
    macs, traffic = tm * bm * tn * bn * tk * bk, tm * tn * tk * (bm * bk + bk * bn) * ITEM_BYTES
    return macs * F.lit(NS_PER_MAC) + traffic * F.lit(NS_PER_BYTE) + tm * tn * F.lit(NS_PER_TILE) + tm * tn * tk * F.lit(NS_PER_K_STEP)


def autotune(problems: DataFrame) -> DataFrame:
    """problems(id, m, n, k) with the class (cm, cn, ck), its best configuration and the problem's own cost under it.

    The search is once for each class, over its eight configurations; the first wins a tie.
    """
    spark = problems.sparkSession
    configs = spark.createDataFrame([(o, *c) for o, c in enumerate(CONFIGS)], "ord int, bm long, bn long, bk long")
    classed = problems.withColumns({f"c{x}": power_of_two(F.col(x)) for x in "mnk"})
    each = classed.select("cm", "cn", "ck").distinct().crossJoin(F.broadcast(configs))  # eight rows
    cost = tile_cost(*[F.col(c) for c in ("cm", "cn", "ck", "bm", "bn", "bk")])
    best = each.groupBy("cm", "cn", "ck").agg(F.min(F.struct(cost.alias("cost"), "ord", "bm", "bn", "bk")).alias("b")).select("cm", "cn", "ck", "b.ord", "b.bm", "b.bn", "b.bk")
    joined = classed.join(best, ["cm", "cn", "ck"])
    return joined.withColumn("cost", tile_cost(*[F.col(c) for c in ("m", "n", "k", "bm", "bn", "bk")]))


def cache_misses(tuned: DataFrame) -> DataFrame:
    """(n, misses): problems, and distinct classes among them."""
    return tuned.agg(F.count("*").alias("n"), F.countDistinct("cm", "cn", "ck").alias("misses"))


#: Steps through the samples; one that doesn't divide their number visits each of them once.
STEPS = [611_953, 700_001, 746_773, 800_011, 867_653, 909_091, 951_161, 999_983]


def walk_of(n: int, seed: int, epoch: int) -> tuple[int, int]:
    """(step, start) of an epoch's walk through n samples: the first prime from the epoch's place in STEPS on that doesn't divide n, and a hashed start."""
    turn = (seed + epoch) % len(STEPS)
    step = next(p for p in STEPS[turn:] + STEPS[:turn] if n % p)
    return step, int(hashlib.md5(f"{seed}:{epoch}".encode()).hexdigest()[:12], 16) % n


def batch_stream(spark: SparkSession, n: int, world: int, batch: int, seed: int = 0, epochs: int = 1, drop_last: bool = False) -> DataFrame:
    """(epoch, rank, batch, pos, sample): a deterministic shuffle of 0..n-1, dealt to ranks and cut into batches.

    All ranks get equally many: the tail is dropped, or the order wraps around to
    fill it. The last batch of a rank is dropped too, or short.
    """
    per = n // world if drop_last else -(-n // world)
    if n <= 0 or per <= 0:
        return spark.createDataFrame([], "epoch long, rank long, batch long, pos long, sample long")
    rules = spark.createDataFrame([(e, *walk_of(n, seed, e)) for e in range(epochs)], "epoch long, step long, start long")
    places = spark.range(per * world).crossJoin(F.broadcast(rules))  # a row an epoch
    pos = F.floor(F.col("id") / world)
    out = places.select("epoch", (F.col("id") % world).alias("rank"), F.floor(pos / batch).alias("batch"), (pos % batch).alias("pos"), ((F.col("start") + F.col("step") * (F.col("id") % n)) % n).alias("sample"))
    return out.where(F.col("batch") < per // batch) if drop_last else out


def deal(rows: DataFrame, order: list[str], world: int, batch: int, seed: int = 0, epochs: int = 1, drop_last: bool = False) -> DataFrame:
    """rows with (epoch, rank, batch, pos): the shuffle of batch_stream over the rows themselves, numbered by order.

    A row's places follow from its number, by the walk backwards, so that nothing is made for places and joined: one pass over the rows. Rows
    that wrap around to fill the ranks come twice in an epoch, and with drop_last those beyond the last full batch not at all.
    """
    spark = rows.sparkSession
    numbered = scans.numbered(rows, order, "_nth")
    n = numbered.count()
    per = n // world if drop_last else -(-n // world)
    empty = n <= 0 or per <= 0
    rules = spark.createDataFrame([(e, *((pow(step, -1, n), start) if n > 1 else (0, 0))) for e in range(epochs) for step, start in [walk_of(max(n, 1), seed, e)]], "epoch long, _back long, _start long")
    wide = "decimal(38,0)" if n * n >= 1 << 62 else "long"  # products of two numbers below n
    first = (F.pmod(F.col("_nth") - 1 - F.col("_start"), F.lit(max(n, 1))).cast(wide) * F.col("_back").cast(wide) % max(n, 1)).cast("long")
    places = F.explode(F.sequence(F.col("_first"), F.lit(max(per * world - 1, 0)).cast("long"), F.lit(max(n, 1)).cast("long")))
    out = numbered.crossJoin(F.broadcast(rules)).withColumn("_first", first).where(F.lit(not empty) & (F.col("_first") < per * world)).withColumn("_place", places)  # a row an epoch
    pos = F.floor(F.col("_place") / world)
    out = out.select("epoch", (F.col("_place") % world).alias("rank"), F.floor(pos / batch).alias("batch"), (pos % batch).alias("pos"), *rows.columns)
    return out.where(F.col("batch") < per // batch) if drop_last else out


def multiplicities(spark: SparkSession, stream: DataFrame, n: int) -> DataFrame:
    """(sample, times) for all of 0..n-1."""
    times = stream.groupBy("sample").agg(F.count("*").alias("times"))
    return spark.range(n).withColumnRenamed("id", "sample").join(times, "sample", "left").select("sample", F.coalesce("times", F.lit(0)).alias("times"))


def prefetch_queue(n: Column, depth: Column, producer: Column, consumer: Column) -> Column:
    """(stalls, stall_ms, finish, idle_ms) of n batches made at most depth ahead of their consumer, in closed form.

    At a depth of 0 or 1 making and using take turns. Deeper, the slower side sets
    the pace: a slow producer never idles and each of its batches is waited for; a
    slow consumer waits for the first batch alone, and the producer is held up by
    as much as its last batch, made when that depth places before was used, is late.
    """
    zero, first = F.lit(0).cast("long"), (producer > 0).cast("long")
    turns = F.struct((n * first).alias("stalls"), (n * producer).alias("stall_ms"), (n * (producer + consumer)).alias("finish"), ((n - 1) * consumer).alias("idle_ms"))
    behind = (n - 1) * (producer > consumer).cast("long")
    slow_producer = F.struct((first + behind).alias("stalls"), (producer + behind * (producer - consumer)).alias("stall_ms"), (n * producer + consumer).alias("finish"), zero.alias("idle_ms"))
    held = F.when(n > depth, F.greatest(zero, (n - depth) * consumer + 2 * producer - n * producer)).otherwise(zero)
    slow_consumer = F.struct(first.alias("stalls"), producer.alias("stall_ms"), (producer + n * consumer).alias("finish"), held.alias("idle_ms"))
    nothing = F.struct(zero.alias("stalls"), zero.alias("stall_ms"), zero.alias("finish"), zero.alias("idle_ms"))
    return F.when(n <= 0, nothing).when(depth <= 1, turns).when(producer >= consumer, slow_producer).otherwise(slow_consumer)


def shard_offsets(shards: DataFrame) -> DataFrame:
    """shards(rank, n) with the offset at which each begins."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


def all_reduce(parts: DataFrame, world: int) -> DataFrame:
    """(key, total) of parts(rank, key, v); a key that isn't there once for each rank is an error."""
    short = F.raise_error(F.lit(f"a key is not there once for each of {world} ranks"))
    sums = parts.groupBy("key").agg(F.sum("v").alias("total"), F.countDistinct("rank").alias("ranks"), F.count("*").alias("n"))
    return sums.select("key", F.when((F.col("ranks") == world) & (F.col("n") == world), F.col("total")).otherwise(short).alias("total"))


def global_norm(parts: DataFrame) -> DataFrame:
    """The norm of a sharded vector (rank, v): one root of all squares' sum, not a sum of roots."""
    return parts.groupBy("rank").agg(F.sum(F.col("v") * F.col("v")).alias("s")).agg(F.sqrt(F.sum("s")).alias("norm"))


def global_mean(parts: DataFrame) -> DataFrame:
    """The mean over all elements of (rank, v), not the mean of the ranks' means."""
    return parts.groupBy("rank").agg(F.sum("v").alias("s"), F.count("v").alias("n")).agg((F.sum("s") / F.sum("n")).alias("mean"))
