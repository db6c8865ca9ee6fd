"""Running results over long ordered groups, with a group spread over as many tasks as it needs.

Rows are range-partitioned by (group, order) and written once; a part holds a stretch of the whole order. A scan reads
the parts without any exchange: each gives what its last group adds up to, one row a part, and from these follows
what every part begins with. A state with several levels takes a read for each, and one more for the results. Windows by group
would need one task for each group, however long.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.tables import cut

_PART = "_part"


class Scan(Protocol):
    """What runs over the rows of one group. States can be pickled and stay small."""

    #: How many reads it takes until a state is known.
    levels: int

    def zero(self) -> Any: ...

    def advance(self, level: int, state: Any, rows: pa.RecordBatch) -> Any:
        """state moved on by rows, right in the parts of this level and those before."""

    def merge(self, level: int, carry: Any, own: Any) -> Any:
        """carry with the level's parts of own, of a later stretch, added; its other parts are carry's."""

    def emit(self, state: Any, rows: pa.RecordBatch) -> tuple[Any, list]:
        """state moved on, and the result's columns for rows."""


def laid_out(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows by (group, order) in range partitions, as many as shuffles have, each with its number; written once."""
    by = [*group, *order]
    return cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_PART, F.spark_partition_id()))


def _stretches(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batches cut where the group changes, each with its group."""
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = True
        for name in group:
            code = pc.fill_null(batch.column(name).dictionary_encode().indices, -1).to_numpy()
            change[1:] |= code[1:] != code[:-1]
        first = np.append(np.flatnonzero(change), batch.num_rows)
        for i, j in zip(first[:-1], first[1:], strict=True):
            yield tuple(batch.column(name)[int(i)].as_py() for name in group), batch.slice(i, j - i)


def scan(rows: DataFrame, group: list[str], order: list[str], run: Scan, results: str, keep: list[str] | None = None) -> DataFrame:
    """rows (or their columns keep) with the columns results, a schema, in the order of (group, order) within each group.

    Rows that tie in the whole order stand in any order. The driver holds one state a partition, and only of groups that go on
    in the next.
    """
    keep = keep or rows.columns
    laid = laid_out(rows, group, order)
    carries: dict[int, Any] = {}  # by part: the state of its first group at its start
    shared = laid.sparkSession.sparkContext.broadcast(carries)

    def begin(batch: pa.RecordBatch, known: dict[int, Any]) -> Any:
        part = batch.column(_PART)[0].as_py()
        return pickle.loads(known[part]) if part in known else run.zero()

    for level in range(run.levels):

        def total(batches: Iterator[pa.RecordBatch], level: int = level, known=shared) -> Iterator[pa.RecordBatch]:
            first = last = state = part = None
            for key, stretch in _stretches(batches, group):
                if part is None:
                    first, part, state = key, stretch.column(_PART)[0].as_py(), begin(stretch, known.value)
                elif key != last:
                    state = run.zero()
                last, state = key, run.advance(level, state, stretch)
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([pickle.dumps(x)], pa.binary()) for x in (first, last, state))], ["part", "first", "last", "state"])

        found = sorted(laid.mapInArrow(total, "part int, first binary, last binary, state binary").collect(), key=lambda r: r.part)
        before, so_far, after = None, None, {}  # the group before, its state up to here in this level
        for row in found:
            first, last, own = (pickle.loads(x) for x in row[1:])
            goes_on = before is not None and first == before
            if goes_on:
                after[row.part] = pickle.dumps(run.merge(level, pickle.loads(carries[row.part]) if row.part in carries else run.zero(), so_far))
            so_far = run.merge(level, so_far, own) if goes_on and first == last else own
            before = last
        carries = after
        shared = laid.sparkSession.sparkContext.broadcast(carries)

    def emit(batches: Iterator[pa.RecordBatch], known=shared) -> Iterator[pa.RecordBatch]:
        last = state = None
        for n, (key, stretch) in enumerate(_stretches(batches, group)):
            if n == 0:
                state = begin(stretch, known.value)
            elif key != last:
                state = run.zero()
            last = key
            state, columns = run.emit(state, stretch)
            yield pa.RecordBatch.from_arrays([*(stretch.column(c) for c in keep), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], [*keep, *names])

    names = [c.split()[0] for c in results.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.select(*[F.col(f"`{c}`") for c in keep]).schema)
    return laid.mapInArrow(emit, f"{schema}, {results}")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place, from 1, in order (of columns): places within range partitions, moved on by the counts of those before."""
    laid = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({_PART: F.spark_partition_id(), "_within": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = {r[_PART]: r["n"] for r in laid.groupBy(_PART).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    parts = sorted(counts)
    before = np.cumsum([0, *(counts[p] for p in parts)])[:-1].tolist()
    offsets = laid.sparkSession.createDataFrame(list(zip(parts, before, strict=True)), f"{_PART} int, _before long")
    return laid.join(F.broadcast(offsets), _PART).withColumn(name, F.col("_before") + F.col("_within") + 1).drop(_PART, "_before", "_within")
