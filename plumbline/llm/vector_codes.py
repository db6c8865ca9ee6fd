"""Product codes of vectors: exact integer k-means for each part, with pivots to prune evaluations.

Vectors become integers and are cut into equal parts; each part position has a
codebook that a few rounds of k-means improve. Assignments are exact: squared
distances are integer sums, ties go to the lower entry.

Of each part the distances to a few fixed pivots are computed once and kept with
it. A round computes the pivots' distances to the entries only; by the triangle
inequality the largest difference of the two is a lower bound of the distance to
an entry. Entries are taken in the order of their bounds, until no bound is below
the best distance found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import broadcast_if, cut

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 1024, 4, 256, 4, 16
#: Components are kept within this; with it the squared distances of 2**13 dimensions fit 64 bits.
LIMIT = 1 << 24
#: Sums by label are broadcast up to so many labels.
MAX_BROADCAST_LABELS = 200_000
#: Entries (by bound) that are evaluated in each step, for the rows whose next bound is still low enough.
STEPS = (1, 4, 11, 32, 64, 144)
_ROWS = 1024


def integers(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, x) of vectors(vec_id, embedding, label): components as integers floor(1024 * component).

    Left out: null vectors, those with null or non-finite components, and those whose length is no multiple of parts.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    whole = F.transform("x", lambda v: F.floor(F.greatest(F.least(v * F.lit(float(SCALE)), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0)).where(fine).select("vec_id", "label", whole.alias("x"))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0))


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Rows of points, each as far as possible from those before it; the first is the first row."""
    chosen, near = [0], _roots(points, points[:1])[:, 0]
    while len(chosen) < min(n, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _roots(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivot_entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest of entries, squared distance) of every row of x, and how many distances were evaluated.

    to_pivots: the rows' distances to the pivots; pivot_entry: the pivots' distances to the entries.
    """
    index, best, evaluated = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
    for at in range(0, len(x), _ROWS):
        own, far = x[at : at + _ROWS], to_pivots[at : at + _ROWS]
        bound = np.zeros((len(own), len(entries)), dtype=np.float32)
        for p in range(far.shape[1]):
            np.maximum(bound, np.abs(far[:, p : p + 1] - pivot_entry[p]), out=bound)
        bound -= 1e-6 * (far.max(axis=1, keepdims=True) + pivot_entry.max())  # what rounding may have added
        order = np.argsort(bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        low, low_at = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), len(entries))
        start = 0
        for step in STEPS:
            rows = np.flatnonzero(bound[:, start] <= np.sqrt(low.astype(np.float64)) * (1 + 1e-6)) if start < len(entries) else []
            if not len(rows):
                break
            tried = order[rows, start : start + step]
            gap = own[rows][:, None, :] - entries[tried]
            found = np.einsum("ijk,ijk->ij", gap, gap)
            evaluated += found.size
            least = found.min(axis=1)
            first = np.where(found == least[:, None], tried, len(entries)).min(axis=1)
            better = (least < low[rows]) | ((least == low[rows]) & (first < low_at[rows]))
            low[rows[better]], low_at[rows[better]] = least[better], first[better]
            start += step
        index[at : at + _ROWS], best[at : at + _ROWS] = low_at, low
    return index, best, evaluated


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, codes, error) of vectors(vec_id, embedding, label), the final codebooks by part).

    codes: index of the nearest entry of each part; error: the squared distances, summed. Codebooks begin as the
    parts of the vectors with the least vec_ids; a round replaces each entry by the mean of its parts, rounded down.

    Rows whose vector is null or has null or non-finite components are left out, as are those whose length is
    no multiple of parts or isn't that of the least vec_id. Components are taken within -16384 and 16384. Ties of
    vec_id go by vector, a null vec_id comes last; repeated rows each count and get a row; an empty table gives no row and
    no codebooks. Other columns are ignored.

    Only codebooks (parts x entries rows) and their sums pass the driver.
    """
    spark = vectors.sparkSession
    kept = integers(vectors, parts)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("vec_id", "x").limit(entries).collect()
    if not first:
        return kept.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")).limit(0), []
    size = len(first[0].x)
    kept = kept.where(F.size("x") == size)
    least = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect() if any(len(r.x) != size for r in first) else first
    width = size // parts
    books = list(np.array([r.x for r in least], dtype=np.int64).reshape(len(least), parts, width).transpose(1, 0, 2))
    fixed = [far_apart(book, pivots) for book in books]
    counts = [len(p) for p in fixed]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), np.int64)
            far = np.concatenate([_roots(x[:, p * width : (p + 1) * width], fixed[p]) for p in range(parts)], axis=1).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), far.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "far"])

    kind = kept.schema["label"].dataType.simpleString()
    state = cut(kept.mapInArrow(measure, f"vec_id long, label {kind}, x array<int>, far array<float>"))

    def assigned(batch: pa.RecordBatch, now) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        books, between = now.value
        x, far = _matrix(batch.column("x"), np.int64), np.split(_matrix(batch.column("far"), np.float32), np.cumsum(counts)[:-1], axis=1)
        found = [nearest(x[:, p * width : (p + 1) * width], far[p], books[p], between[p]) for p in range(parts)]
        return x, [f[0] for f in found], [f[1] for f in found]

    def codebooks(books: list[np.ndarray]):
        return spark.sparkContext.broadcast((books, [_roots(fixed[p], books[p]).astype(np.float32) for p in range(parts)]))

    for _ in range(rounds):
        now = codebooks(books)

        def total(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            """One row for each entry that got parts in this task."""
            many = [len(b) for b in now.value[0]]
            n, sums = [np.zeros(m, np.int64) for m in many], [np.zeros((m, width), np.int64) for m in many]
            for batch in batches:
                x, index, _ = assigned(batch, now)
                for p in range(parts):
                    n[p] += np.bincount(index[p], minlength=many[p])
                    order = np.argsort(index[p], kind="stable")
                    heads = np.flatnonzero(np.diff(index[p][order], prepend=-1))
                    if len(heads):
                        sums[p][index[p][order][heads]] += np.add.reduceat(x[order, p * width : (p + 1) * width], heads, axis=0)
            part, entry = np.concatenate([np.full(m, p) for p, m in enumerate(many)]), np.concatenate([np.arange(m) for m in many])
            n, sums = np.concatenate(n), np.concatenate(sums)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(part[used], pa.int32()), pa.array(entry[used], pa.int32()), pa.array(n[used]), *(pa.array(sums[used, k]) for k in range(width))], ["part", "entry", "n", *(f"s{k}" for k in range(width))])

        names = [f"s{k}" for k in range(width)]
        summed = state.mapInArrow(total, ", ".join(["part int", "entry int", "n long", *(f"{s} long" for s in names)])).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
        books = [b.copy() for b in books]
        for row in summed.collect():
            books[row.part][row.entry] = np.array(row[3:], dtype=np.int64) // row.n
    now = codebooks(books)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, index, far = assigned(batch, now)
            codes = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(index, axis=1).astype(np.int32).ravel()), parts).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(np.sum(far, axis=0, dtype=np.int64))], ["vec_id", "label", "codes", "error"])

    return state.mapInArrow(final, f"vec_id long, label {kind}, codes array<int>, error long"), books


def with_label_error(encoded: DataFrame) -> DataFrame:
    """encoded(label, error) with label_error: error summed over equal labels, nulls together (null if it is beyond 64 bits).

    Labels are summed before they are joined; repeated rows each count; an empty table stays empty.
    """
    encoded = cut(encoded)
    sums = cut(encoded.groupBy(F.col("label").alias("_pl_label")).agg(F.try_sum("error").alias("label_error")))
    return encoded.join(broadcast_if(sums, MAX_BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("_pl_label"))).drop("_pl_label")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' integers, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
