"""Document fingerprints by a homomorphic multiset hash.

A document is the multiset of its paragraphs (lines with a visible character).
Every paragraph is hashed to a wide vector and a document's fingerprint is the
sum of the vectors, lane by lane, modulo powers of two. The order of paragraphs
plays no part; inserting a paragraph adds its vector, deleting one subtracts it.

The vector has two parts. EXACT_LANES 64-bit lanes come from the paragraph's
digest, modulo 2**64: they decide equality. LIKE_LANES lanes, modulo 2**32, are
sums of +1 and -1 hashed from the paragraph's 3-word shingles; being linear too,
the squared length of two documents' difference estimates how many shingles they
don't share.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import CHUNK_BYTES, NOT_SPACE, mix, split_words

EXACT_LANES = 8
LIKE_LANES = 128
SHINGLE_WORDS = 3
#: Text in one range of doc_ids, and the most ranges that are dealt: their bounds are all in each task.
RANGE_BYTES, MAX_RANGES = 64 << 20, 50_000
_SALTS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xABC98388FB8FAC03))
#: Byte to eight byte-wide counters, lowest bit first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_ROWS = 255  # what a byte-wide counter can hold


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of all shingles; none reaches over a line break, a shorter line is one shingle."""
    words = split_words(texts, NOT_SPACE)
    if not len(words.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = words.hashes()
    line = np.searchsorted(np.flatnonzero(words.data == 10), words.start) + words.text_of() * (len(words.data) + 1)
    begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    size = np.diff(np.append(begin, len(line)))
    place = np.arange(len(line)) - np.repeat(begin, size)
    width = np.minimum(np.repeat(size, size), SHINGLE_WORDS)
    at = np.flatnonzero(place + width <= np.repeat(size, size))
    at = at[(width[at] == SHINGLE_WORDS) | (place[at] == 0)]
    out = width[at].astype(np.uint64)
    for k in range(SHINGLE_WORDS):
        more = width[at] > k
        out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[more] + k])
    return out, words.text_of()[at]


def like_lanes(texts: pa.Array) -> np.ndarray:
    """(texts, LIKE_LANES) sums of +1 and -1 as int32."""
    hashes, text = _shingles(texts)
    out = np.zeros((len(texts), LIKE_LANES), dtype=np.int64)
    if not len(hashes):
        return out.astype(np.int32)
    bits = np.stack([mix(hashes ^ s) for s in _SALTS], axis=1).view(np.uint8)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    size = np.diff(first)
    cuts = np.concatenate([np.arange(b, b + n, _ROWS) for b, n in zip(first[:-1].tolist(), size.tolist()) if n])
    owner = text[cuts]
    for k in range(0, len(cuts), 400):
        stop = cuts[k + 400] if k + 400 < len(cuts) else len(hashes)
        sums = np.add.reduceat(_SPREAD[bits[cuts[k] : stop]], cuts[k : k + 400] - cuts[k], axis=0).view(np.uint8)
        np.add.at(out, owner[k : k + 400], sums)
    return (2 * out - size[:, None]).astype(np.int32)


def exact_lanes(text: str) -> np.ndarray:
    """The sum of the digests of the text's paragraphs."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return np.zeros(EXACT_LANES, dtype=np.uint64)
    digest = b"".join(hashlib.blake2b(x.encode("utf-8", "surrogatepass")).digest() for x in lines)
    return np.frombuffer(digest, dtype="<u8").reshape(-1, EXACT_LANES).sum(axis=0, dtype=np.uint64)


def encode(exact: np.ndarray, like: np.ndarray) -> str:
    return base64.b64encode(exact.astype("<u8").tobytes() + like.astype("<i4").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * EXACT_LANES], dtype="<u8"), np.frombuffer(raw[8 * EXACT_LANES :], dtype="<i4")


def fingerprint(text: str | None) -> str:
    return encode(exact_lanes(text or ""), like_lanes(pa.array([text or ""]))[0])


def insert(document: str, paragraphs: str) -> str:
    """The fingerprint of a document with more paragraphs, from the fingerprints of both."""
    (a, b), (c, d) = decode(document), decode(paragraphs)
    return encode(a + c, b + d)


def delete(document: str, paragraphs: str) -> str:
    """The fingerprint of a document without some of its paragraphs."""
    (a, b), (c, d) = decode(document), decode(paragraphs)
    return encode(a - c, b - d)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 (nothing shared) to 1 (the same) of rows of like lanes: 1 - |a - b|^2 / (|a|^2 + |b|^2); of two empty ones 1."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    apart, length = ((a - b) ** 2).sum(axis=1), (a * a + b * b).sum(axis=1)
    return np.clip(np.where(length > 0, 1.0 - apart / np.maximum(length, 1.0), 1.0), 0.0, 1.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of docs(doc_id, text).

    Null counts as empty, whose fingerprint is all zero, as is that of blanks
    alone. Texts are read whole; repeated rows, and rows without a doc_id, each get
    their row; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            prints = [fingerprint(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs(doc_id, text) dealt by ranges of descending doc_id: (_range, _guest, doc_id, text), in order in each range.

    Every range is a partition of its own and ends with the first rows of the
    next one (of the first, behind the last) as guests, so that each row's
    successor is beside it. Only the bounds and the greatest doc_id of every range
    go to the driver. Ranges have about as many rows each; there are as many as
    shuffle partitions, or one for each RANGE_BYTES of text if that is more.
    """
    spark = docs.sparkSession
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_RANGES, -(-size // RANGE_BYTES)))
    share = [k / ranges for k in range(1, ranges)]
    bounds = sorted({float(b) for b in docs.agg(F.percentile_approx("doc_id", share, 10 * ranges)).first()[0] or []}) or [0.0]
    found = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_at", outputCol="_bucket", handleInvalid="keep").transform(docs.withColumn("_at", F.col("doc_id").cast("double")))
    last = len(bounds) + 1  # rows without a doc_id
    dealt = found.withColumn("_range", F.when(F.col("doc_id").isNull(), last).otherwise(len(bounds) - F.col("_bucket")).cast("int"))
    heads = sorted((r["_range"], r.head) for r in dealt.groupBy("_range").agg(F.max("doc_id").alias("head")).collect())
    visits = spark.createDataFrame([(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)], "_head long, _visited int")  # one row a range
    own = F.struct(F.col("_range"), F.lit(False).alias("_guest"))
    visit = F.when(F.col("_visited").isNotNull(), F.struct(F.col("_visited").alias("_range"), F.lit(True).alias("_guest")))
    met = dealt.join(F.broadcast(visits), F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    spread = met.select("doc_id", "text", F.explode(F.filter(F.array(own, visit), lambda x: x.isNotNull())).alias("at")).select("at._range", "at._guest", "doc_id", "text")
    return spread.repartitionById(max(ranges, last + 1), F.col("_range")).sortWithinPartitions("_range", "_guest", F.col("doc_id").desc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_report(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside that of an edited text and that of the next document.

    For docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The next document is the one
    with the next lower doc_id; after the last comes the first; rows of one
    doc_id follow one another by text, null ids come last. A single row is its
    own successor. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row: its successor isn't known yet
        for part in _slices(batches):
            rows = list(zip(*(part.column(c).to_pylist() for c in ("_range", "_guest", "doc_id", "text"))))
            rows = [held, *rows] if held else rows
            held = rows[-1]
            pairs = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
            if not pairs:
                continue
            texts = [r[3] for r in rows]
            changed = [edited(texts[k], texts[k + 1]) for k in pairs]
            like, like_changed = like_lanes(pa.array(texts, pa.string())), like_lanes(pa.array(changed, pa.string()))
            at = np.array(pairs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][2] for k in pairs], pa.int64()),
                    pa.array([len(texts[k]) for k in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]),
                    pa.array([encode(exact_lanes(texts[k]), like[k]) for k in pairs]),
                    pa.array([encode(exact_lanes(x), lanes) for x, lanes in zip(changed, like_changed)]),
                    pa.array(likeness(like[at], like_changed)),
                    pa.array(likeness(like[at], like[at + 1])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    rows = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + CHUNK_BYTES, side="right")))
            yield batch.slice(row, stop - row)
            row = stop
