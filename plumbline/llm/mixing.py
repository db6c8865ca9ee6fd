"""Mixing sources to target weights by Poisson replication.

A document of a source whose mean repetition rate is r appears k times with k
drawn from a Poisson distribution of mean r: a uniform number hashed from the
document's id and the seed is inverted through the distribution. No document
needs to know another, so the draw is one narrow step; only the counts per
source are aggregated before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import broadcast_if, cut, plain

SEED = 20240601
#: Default weights: a source's number of documents to this power.
TEMPERATURE = 0.5
MAX_BROADCAST_SOURCES = 100_000
#: Numbers in all distributions together, beyond which they aren't broadcast.
MAX_BROADCAST_STEPS = 4_000_000


def _digits(text, n: int):
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, n), 16, 10).cast("long")


def poisson(rate: float) -> tuple[int, np.ndarray]:
    """(least, cdf) of a Poisson distribution: cdf[k] is the probability of at most least + k.

    It spans twelve standard deviations to either side of the mean; what lies
    beyond is far less than the step between uniform numbers. Terms are taken
    relative to the largest, so that none of weight underflows at any rate.
    """
    if rate <= 0:
        return 0, np.ones(1)
    spread = 12 * math.sqrt(rate)
    least = max(0, math.floor(rate - spread) - 30)
    k = np.arange(least, math.ceil(rate + spread) + 31)
    log_p = np.concatenate(([0.0], np.cumsum(np.log(rate / k[1:]))))
    cdf = np.cumsum(np.exp(log_p - log_p.max()))
    return least, cdf / cdf[-1]


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n, rate, least, cdf): cdf[k] is the probability of at most least + k copies. Any rate is fine.

    Target shares are weights, normalised over the sources that docs has (a
    source without a weight gets none), or n ** temperature. total: documents
    wanted in the mix; as many as docs has, if not given.
    """
    counts = cut(docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n")))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    elif weights:
        table = docs.sparkSession.createDataFrame(sorted((str(k), float(v)) for k, v in weights.items()), "source string, weight double")
        counts, weight = counts.join(table, "source", "left"), F.coalesce("weight", F.lit(0.0))
    else:
        weight = F.lit(0.0)
    weighed = counts.select("source", "n", weight.alias("weight"))
    sums = weighed.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    wanted = float(total if total is not None else sums.n or 0)
    rate = F.col("weight") / F.lit(float(sums.weight or 1.0)) * wanted / F.col("n")
    rated = weighed.select("source", "n", rate.alias("rate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [poisson(r) for r in batch.column("rate").to_pylist()]
            least, cdf = pa.array([k for k, _ in found], pa.int64()), pa.array([c for _, c in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source", "n", "rate")), least, cdf], ["source", "n", "rate", "least", "cdf"])

    return rated.mapInArrow(run, "source string, n long, rate double, least long, cdf array<double>")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Every row of docs as often as it is drawn, in random order; all columns, and _pl_copy (from 1) and _pl_order.

    The draw depends on doc_id and seed alone: repeated rows are drawn alike. A
    null doc_id is drawn as 'null', a null source counts as source ''. The order
    is that of a hash of doc_id, copy and seed over the whole mix (one range
    shuffle). Texts play no part: null, empty and very long ones are drawn like
    any other. Older columns named _pl_* are left out. An empty table gives an empty mix.
    """
    docs = plain(docs)
    table = cut(rates(docs, weights, total, temperature).select(F.col("source").alias("_pl_source"), F.col("least").alias("_pl_least"), F.col("cdf").alias("_pl_cdf")))
    if (table.agg(F.sum(F.size("_pl_cdf"))).first()[0] or 0) <= MAX_BROADCAST_STEPS:
        table = broadcast_if(table, MAX_BROADCAST_SOURCES)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    uniform = _digits(F.concat_ws(":", F.lit(str(seed)), name), 13) / F.lit(float(1 << 52))
    joined = docs.join(table, F.coalesce(docs["source"].cast("string"), F.lit("")) == F.col("_pl_source"))
    times = F.col("_pl_least").cast("int") + F.size(F.filter("_pl_cdf", lambda c: c <= F.col("_pl_u")))
    drawn = joined.withColumn("_pl_u", uniform).withColumn("_pl_n", times).where("_pl_n > 0")
    copies = drawn.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_pl_n"))).alias("_pl_copy"))
    order = _digits(F.concat_ws(":", F.lit(str(seed + 1)), name, F.col("_pl_copy").cast("string")), 15)
    return copies.withColumn("_pl_order", order).orderBy("_pl_order", "doc_id", "_pl_copy")
