"""Confidence sequences of operators.reliability over streams, in event time.

Rows wait in a buffer of their criterion until the watermark has passed them, and are then taken in
the order of (at, t): whatever the order of arrival within the delay, and however micro-batches are
cut, the bounds are those of the batch operator. What is kept of a criterion are the sums of its sequence and
the rows within the delay. Rows that come behind the watermark are left out, as by other operators with one.
An observation outside [0, 1], or a missing one, stops the stream.

The state store must be RocksDB's: set spark.sql.streaming.stateStore.providerClass to STATE_STORE.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.functions.sequences import SEQUENCES, Sequence

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "criterion string, at timestamp, t long, n long, x double, lo double, hi double, failed boolean, expected double"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


class InOrder(StatefulProcessor):
    """Takes each criterion's rows in event time; begins anew after a pause of so many milliseconds of event time."""

    def __init__(self, sequence: Sequence, idle_ms: int | None):
        self.sequence, self.idle_ms = sequence, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, t long, x double, expected double")
        #: Sequence state, the expected disagreement, the latest event time taken.
        self.reached = handle.getValueState("reached", "state binary, expected double, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows), ignore_index=True)
        at = came["at"].to_numpy().astype("datetime64[ms]").astype(np.int64)
        came, at = came[at > timerValues.getCurrentWatermarkInMs()], at[at > timerValues.getCurrentWatermarkInMs()]
        if not len(at):
            return iter(())
        self.waiting.appendList([(int(a), int(t), *(None if pd.isna(v) else float(v) for v in more)) for a, t, *more in zip(at, came["t"], came["x"], came["expected"], strict=True)])
        self.handle.registerTimer(int(at.min()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        last = self.reached.get()[2] if self.reached.exists() else None
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[0] for r in rest))
        elif waiting:
            self.waiting.clear()
        if ready:
            for rows in self._runs(sorted(r[0] for r in ready), ready, last):
                yield self._taken(key[0], rows)
            last = max(r[0] for r in ready)
            if self.idle_ms is not None:
                self.handle.registerTimer(last + self.idle_ms)
        elif self.idle_ms is not None and not waiting and last is not None and last + self.idle_ms <= now:
            self.reached.clear()

    def _runs(self, times: list[int], rows: list[tuple], last: int | None) -> Iterator[list[tuple]]:
        """rows without a pause of idle_ms between them; before one that follows a pause the state goes."""
        cuts = [b for a, b in zip([times[0] if last is None else last, *times], times) if self.idle_ms is not None and b - a >= self.idle_ms]
        for low, high in zip([-math.inf, *cuts], [*cuts, math.inf], strict=True):
            if low in cuts and self.reached.exists():
                self.reached.clear()
            if own := [r for r in rows if low <= r[0] < high]:
                yield own

    def _taken(self, criterion: str, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["at", "t", "x", "expected"]).astype({"x": float, "expected": float})
        out = out.sort_values(["at", "t", "x"], na_position="first", kind="stable", ignore_index=True)
        packed, expected, _ = self.reached.get() if self.reached.exists() else (None, math.nan, 0)
        state = pickle.loads(bytes(packed)) if packed else self.sequence.zero()
        seen = out["x"].notna().to_numpy()
        out["n"], out["lo"], out["hi"], out["failed"] = int(state["n"]) + np.cumsum(seen), np.nan, np.nan, False
        if seen.any():
            lo, hi, failed = self.sequence.step(state, out["x"].to_numpy()[seen])
            out.loc[seen, "lo"], out.loc[seen, "hi"], out.loc[seen, "failed"] = lo, hi, failed
        known = pd.concat([pd.Series([math.nan if expected is None else expected]), out["expected"]]).ffill().to_numpy()
        out["expected"] = known[1:]
        self.reached.update((pickle.dumps(state), None if math.isnan(known[-1]) else float(known[-1]), int(out["at"].iloc[-1])))
        out["criterion"], out["at"] = criterion, pd.to_datetime(out["at"], unit="ms")
        return out[_COLUMNS]


def _run(events: DataFrame, kind: str, late: str, idle_ms: int | None, options: dict) -> DataFrame:
    """events(criterion, at, t, x, expected) with bounds; rows without x only set what is expected."""
    if kind not in SEQUENCES:
        raise ValueError(f"unknown sequence {kind!r}; there are {sorted(SEQUENCES)}")
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = events.withWatermark("at", late).groupBy("criterion")
    return rows.transformWithStateInPandas(InOrder(SEQUENCES[kind](**options), idle_ms), _OUT, "Append", "EventTime")


def _checked(wrong, x):
    return F.when(wrong, F.raise_error(F.lit("observations lie in [0, 1], expected disagreement is positive"))).otherwise(x).cast("double")


def _named(events: DataFrame, x, expected) -> DataFrame:
    return events.select(F.col("criterion").cast("string").alias("criterion"), F.col("at").cast("timestamp").alias("at"), F.col("t").cast("long").alias("t"), x.alias("x"), expected.alias("expected"))


def follow(events: DataFrame, kind: str = "eb", late: str = "10 minutes", idle_ms: int | None = None, **options) -> DataFrame:
    """(criterion, at, t, n, x, lo, hi, failed) of a stream events(criterion, at, t, x): the anytime-valid interval after each observation.

    at is the event time (in milliseconds), t tells rows of one time apart. Rows come out once the watermark, late behind the
    latest, has passed them. With idle_ms a criterion begins anew after a pause of so long, and nothing is kept of it meanwhile.
    """
    x = F.col("x")
    return _run(_named(events, _checked(x.isNull() | ~x.between(0, 1), x), F.lit(None).cast("double")), kind, late, idle_ms, options).drop("expected")


def follow_alpha(events: DataFrame, top: float, kind: str = "eb", late: str = "10 minutes", idle_ms: int | None = None, **options) -> DataFrame:
    """(criterion, at, t, n, x, lo, hi, failed, expected, alpha_lo, alpha_hi) of a stream events(criterion, at, t, x, expected).

    top is the largest squared difference. A row without x sets the expected
    disagreement from there on, before observations of the same (at, t); such rows
    come out too, without bounds, and so are its history. Before the first one
    the bounds of alpha are null.
    """
    if not (math.isfinite(top) and top > 0):
        raise ValueError("top must be positive and finite")
    x, e = F.col("x"), F.col("expected")
    wrong = F.coalesce(~x.between(0, 1), F.lit(False)) | (x.isNull() & e.isNull()) | F.coalesce(~((e > 0) & (e < float("inf"))), F.lit(False))
    scale = F.lit(float(top)) / F.col("expected")
    return _run(_named(events, _checked(wrong, x), e.cast("double")), kind, late, idle_ms, options).withColumns({"alpha_lo": 1 - F.col("hi") * scale, "alpha_hi": F.when(F.col("lo").isNotNull() & F.col("expected").isNotNull(), F.least(F.lit(1.0), 1 - F.col("lo") * scale))})
