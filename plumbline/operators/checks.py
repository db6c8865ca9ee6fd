"""User checks: a registry of column expressions, and their verdicts for every task."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a check may say.
VERDICTS = ("PASS", "FAIL", "SKIP", "ERROR")

Options = Mapping[str, object]


@dataclass(frozen=True)
class Check:
    """verdict, reason and applies take the options and give an expression over a task's columns; needs names capabilities.

    An expression that can fail should do so by null (try_divide, try_cast): null
    makes one task's verdict ERROR, where an exception would stop them all.
    """

    id: str
    verdict: Callable[[Options], Column]
    reason: Callable[[Options], Column] = field(default=lambda options: F.lit(None).cast("string"))
    applies: Callable[[Options], Column] = field(default=lambda options: F.lit(True))
    needs: tuple[str, ...] = ()


class Checks:
    """Checks by id."""

    def __init__(self, *checks: Check) -> None:
        self.known: dict[str, Check] = {}
        for check in checks:
            self.register(check)

    def register(self, check: Check) -> Check:
        """Adds a check; another one of the same id is replaced, with a warning."""
        if not check.id:
            raise ValueError("a check needs an id")
        if self.known.get(check.id, check) is not check:
            warnings.warn(f"check {check.id} is replaced", stacklevel=2)
        self.known[check.id] = check
        return check

    def run(self, tasks: DataFrame, capabilities: Collection[str] = (), options: Options | None = None, ids: Collection[str] | None = None) -> DataFrame:
        """tasks with (ord, check, verdict, reason), a row for each check that applies.

        Asked for are ids, or else what the array column checks of tasks names, or
        else (null, empty or no such column) all known ones. Unknown: ERROR. A
        capability is missing: SKIP. Applicability null, a verdict that is none,
        or one other than PASS without a reason: ERROR.
        """
        options = options or {}
        everything = F.array(*map(F.lit, sorted(self.known))).cast("array<string>")
        if ids is not None:
            asked = F.array(*map(F.lit, ids)).cast("array<string>")
        elif "checks" in tasks.columns:
            asked = F.when(F.size("checks") > 0, F.col("checks")).otherwise(everything)
        else:
            asked = everything
        rows = tasks.select("*", F.posexplode(asked).alias("ord", "check"))
        applies, verdict, reason = F.lit(True), F.lit("ERROR"), F.concat(F.lit("check "), "check", F.lit(f" is not registered; there are {', '.join(sorted(self.known))}"))
        for id, check in self.known.items():
            own = F.col("check") == id
            can = check.applies(options)
            lacking = [c for c in check.needs if c not in capabilities]
            if lacking:
                said, why = F.lit("SKIP"), F.lit(f"requires {', '.join(check.needs)}; missing {', '.join(lacking)}")
            else:
                said, why = check.verdict(options), check.reason(options)
                mute = F.trim(F.coalesce(why, F.lit(""))) == ""
                none = said.isNull() | ~said.isin(*VERDICTS)
                why = F.when(none, F.concat(F.lit("no verdict: "), F.coalesce(said, F.lit("null")))).when((said != "PASS") & mute, F.concat(F.lit("no reason for "), said)).when(said != "PASS", why)
                said = F.when(none | ((said != "PASS") & mute), "ERROR").otherwise(said)
            applies = F.when(own, F.coalesce(can, F.lit(True))).otherwise(applies)
            verdict = F.when(own, F.when(can.isNull(), "ERROR").otherwise(said)).otherwise(verdict)
            reason = F.when(own, F.when(can.isNull(), "it is not known whether the check applies").otherwise(why)).otherwise(reason)
        return rows.where(applies).withColumns({"verdict": verdict, "reason": reason})


def grade(completions: DataFrame, verify: Column) -> DataFrame:
    """(task_id, n, c): completions and those that verify holds for; null counts as wrong."""
    return completions.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(verify, F.lit(False))).alias("c"))


def selected(rows: DataFrame, column: str, wanted: str | Collection[str]) -> DataFrame:
    """rows whose column is among wanted (a collection, or a text parted by commas); "all" means everything."""
    names = [n.strip() for n in wanted.split(",") if n.strip()] if isinstance(wanted, str) else list(wanted)
    return rows if names == ["all"] else rows.where(F.col(column).isin(names))
