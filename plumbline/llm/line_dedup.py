"""Cross-site boilerplate removal by the number of distinct sites of each line.

One HyperLogLog sketch of sites per line hash, merged by aggregation, estimates
how many sites carry a line. Lines whose estimate is too near the threshold to
decide are counted exactly. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import broadcast_if, cut, plain

#: A line on at least so many distinct sites is boilerplate.
MIN_SITES = 10
LG_BINS = 12
#: Standard errors of the sketch around the threshold within which lines are counted exactly.
BAND = 6.0
MAX_BROADCAST_LINES = 200_000


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, site, pos, h1, h2) of every line with more than blanks; h1, h2: 96 bits of hash of the trimmed line."""
    each = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.trim("line")
    return each.where(line != "").select("doc_id", "key", "site", "pos", F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_bins: int = LG_BINS) -> DataFrame:
    """(h1, h2) of the lines of docs(doc_id, text, source) on at least min_sites distinct sources."""
    lines = _lines(docs)
    margin = max(1.0, min_sites * BAND * 1.04 / math.sqrt(1 << lg_bins))
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_bins).alias("sites")).select("h1", "h2", F.hll_sketch_estimate("sites").alias("n"))
    spread = cut(sketched.where(F.col("n") >= min_sites - margin))
    near = spread.where(F.col("n") <= min_sites + margin).select("h1", "h2")
    exact = lines.join(broadcast_if(near, MAX_BROADCAST_LINES), ["h1", "h2"]).select("h1", "h2", "site").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites)
    return cut(spread.where(F.col("n") > min_sites + margin).select("h1", "h2").union(exact.select("h1", "h2")))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_bins: int = LG_BINS) -> DataFrame:
    """docs with boilerplate lines taken out of text; added columns: _pl_lines and _pl_removed.

    Lines are what stands between line breaks; lines of blanks alone are never
    counted and stay. Two lines are the same if they are equal after trimming
    blanks. A line on min_sites sources or more goes everywhere but at its first
    place (least doc_id, then position), so that no wording leaves the corpus. A
    null source is one more source; null texts stay null, with no lines. Rows
    equal in doc_id and text are treated alike. All rows and other columns stay,
    but for older columns named _pl_*.
    """
    docs = plain(docs)
    common = broadcast_if(boilerplate(docs, min_sites, lg_bins), MAX_BROADCAST_LINES)
    met = _lines(docs).join(common, ["h1", "h2"]).select("h1", "h2", "doc_id", "key", "pos")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos", "key")
    kept = broadcast_if(cut(met.groupBy("h1", "h2").agg(F.min(place).alias("first"))), MAX_BROADCAST_LINES)
    gone = met.join(kept, ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos")) & (F.col("key") == F.col("first.key"))))
    cuts = gone.groupBy(F.col("doc_id").alias("_pl_id"), F.col("key").alias("_pl_key")).agg(F.collect_set("pos").alias("_pl_cut"))
    joined = docs.join(cuts, docs["doc_id"].eqNullSafe(F.col("_pl_id")) & (F.xxhash64(docs["text"]) == F.col("_pl_key")), "left")
    split = F.split(docs["text"], "\n")
    text = F.when(F.col("_pl_cut").isNull(), docs["text"]).otherwise(F.array_join(F.filter(split, lambda line, k: ~F.array_contains("_pl_cut", k)), "\n"))
    n_lines = F.coalesce(F.size(F.filter(split, lambda line: F.trim(line) != "")), F.lit(0))
    n_lines = F.when(docs["text"].isNull(), 0).otherwise(n_lines)
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], n_lines.cast("long").alias("_pl_lines"), F.coalesce(F.size("_pl_cut"), F.lit(0)).cast("long").alias("_pl_removed"))
