"""Unified diffs of two text columns: shortest line edits, their text, and strict application.

Only the search for the shortest edit is Python, over Arrow batches; writing,
reading and applying a diff are column expressions. A line ends at a newline and
nowhere else, and a text's last newline may be missing. The empty text has no line.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unchanged lines around a change.
CONTEXT = 3

HUNK = "struct<old_start:bigint,old_count:bigint,new_start:bigint,new_count:bigint,lines:array<string>>"

_HEAD = r"^@@ -(\d+)(,\d+)? \+(\d+)(,\d+)? @@"


def _split(text: str) -> list[str]:
    lines = text.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def _middle(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """(x, y, u, v): a run of equal lines from (x, y) to (u, v), maybe empty, halfway along a shortest edit of a into b."""
    n, m = len(a), len(b)
    delta = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        low, high = 2 * max(0, d - m) - d, d - 2 * max(0, d - n)
        for forward in (True, False):
            own, other = (ahead, back) if forward else (back, ahead)
            for k in range(low, high + 1, 2):
                right, down = own.get(k - 1, -1) + 1, own.get(k + 1, -1)
                x = down if k == -d or (k != d and right <= down) else right
                y = x - k
                x0, y0 = x, y
                if forward:
                    while x < n and y < m and a[x] == b[y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                        x, y = x + 1, y + 1
                own[k] = x
                if (delta % 2 == 1) == forward and x + other.get(delta - k, -n - m) >= n:
                    return (x0, y0, x, y) if forward else (n - x, m - y, n - x0, m - y0)
    raise AssertionError("the two searches have to meet")


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence of lines, rising.

    The search runs from both ends to a middle run, and once more on either side
    of it, so memory grows with the lines and time with lines times changes.
    Lines that only one side has can't be common and are left out of it.
    """
    number: dict[str, int] = {}
    left, right = ([number.setdefault(line, len(number)) for line in side] for side in (a, b))
    shared = set(left) & set(right)
    rows, columns = ([i for i, x in enumerate(side) if x in shared] for side in (left, right))
    found = []
    boxes = [(0, len(rows), 0, len(columns))]
    while boxes:
        i, i_end, j, j_end = boxes.pop()
        while i < i_end and j < j_end and left[rows[i]] == right[columns[j]]:
            found.append((rows[i], columns[j]))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and left[rows[i_end - 1]] == right[columns[j_end - 1]]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((rows[i_end], columns[j_end]))
        if i < i_end and j < j_end:
            x, y, u, v = _middle([left[r] for r in rows[i:i_end]], [right[c] for c in columns[j:j_end]])
            found += [(rows[i + x + s], columns[j + y + s]) for s in range(u - x)]
            boxes += [(i, i + x, j, j + y), (i + u, i_end, j + v, j_end)]
    return sorted(found)


def _hunks(a: list[str], b: list[str], context: int) -> list[dict]:
    changes = []
    i = j = 0
    for p, q in [*common_lines(a, b), (len(a), len(b))]:
        if p > i or q > j:
            changes.append((i, p, j, q))
        i, j = p + 1, q + 1
    hunks, group = [], []
    for n, change in enumerate(changes):
        group.append(change)
        if n + 1 < len(changes) and changes[n + 1][0] - change[1] <= 2 * context:
            continue
        before = min(context, group[0][0])
        after = min(context, len(a) - change[1])
        start, end = group[0][0] - before, change[1] + after
        new_start, new_end = group[0][2] - before, change[3] + after
        lines, at = [], start
        for lo, hi, new_lo, new_hi in group:
            lines += [" " + x for x in a[at:lo]] + ["-" + x for x in a[lo:hi]] + ["+" + x for x in b[new_lo:new_hi]]
            at = hi
        lines += [" " + x for x in a[at:end]]
        # A side without lines names the line before it.
        hunks.append({"old_start": start + (end > start), "old_count": end - start, "new_start": new_start + (new_end > new_start), "new_count": new_end - new_start, "lines": lines})
        group = []
    return hunks


def hunks(old: Column, new: Column, context: int = CONTEXT) -> Column:
    """Hunks of a shortest edit of old into new, in order; none for equal lines, null if a side is null."""

    @F.pandas_udf(f"array<{HUNK}>")
    def find(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _hunks(_split(x), _split(y), context) for x, y in zip(left, right)], dtype=object)

    return find(old, new)


def _head(hunk: Column) -> Column:
    span = lambda start, count: F.when(count == 1, start.cast("string")).otherwise(F.concat_ws(",", start, count))
    return F.concat(F.lit("@@ -"), span(hunk["old_start"], hunk["old_count"]), F.lit(" +"), span(hunk["new_start"], hunk["new_count"]), F.lit(" @@"))


def as_text(found: Column, old_name: Column, new_name: Column) -> Column:
    """The hunks as a unified diff; an empty text without hunks."""
    one = lambda h: F.concat(_head(h), F.lit("\n"), F.array_join(h["lines"], "\n"), F.lit("\n"))
    body = F.array_join(F.transform(found, one), "")
    return F.when(F.size(found) == 0, "").when(found.isNotNull(), F.concat(F.lit("--- "), old_name, F.lit("\n+++ "), new_name, F.lit("\n"), body))


def read(diff: Column) -> Column:
    """Hunks of a unified diff's text; lines that are none of a hunk's, such as the names and notes on a missing newline, are passed over."""

    def one(chunk: Column) -> Column:
        number = lambda k: F.regexp_extract(chunk, _HEAD, k)
        count = lambda k: F.when(number(k) == "", 1).otherwise(F.substring(number(k), 2, 20).cast("long")).cast("long")
        lines = F.filter(F.split(chunk, "\n"), lambda line, i: (i > 0) & line.rlike("^[ +-]"))
        return F.struct(number(1).cast("long").alias("old_start"), count(2).alias("old_count"), number(3).cast("long").alias("new_start"), count(4).alias("new_count"), lines.alias("lines"))

    return F.transform(F.filter(F.split(diff, r"\n(?=@@ -\d)"), lambda chunk: chunk.rlike(_HEAD)), one)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of value, which is computed once however often then names it; what calls Python has to be the outermost."""
    return F.transform(F.array(value), then)[0]


def _lines(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def apply(source: Column, found: Column) -> Column:
    """(text, error): source with hunks applied, its lines all ended; text is null where there is an error, both where an input is null.

    Strict: every line that a hunk keeps or removes must stand in the source at the
    very place it names, hunks must come in order, and counts must fit their lines.
    """

    def result(src: Column, hs: Column) -> Column:
        start = lambda h: h["old_start"] - F.when(h["old_count"] == 0, 0).otherwise(1)
        end = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(_with(F.try_element_at(hs, i), lambda h: start(h) + h["old_count"]))
        body = lambda h, tags: F.transform(F.filter(h["lines"], lambda x: F.substring(x, 1, 1).isin(*tags)), lambda x: F.substring(x, 2, 2**31 - 1))
        part = lambda low, n: F.slice(src, (low + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))

        def fault(h: Column, i: Column) -> Column:
            where = F.concat(F.lit("hunk "), (i + 1).cast("string"))
            counts = (F.size(body(h, " -")) == h["old_count"]) & (F.size(body(h, " +")) == h["new_count"])
            return (
                F.when(~counts, F.concat(where, F.lit(": counts don't fit its lines")))
                .when((start(h) < end(i)) | (start(h) < 0), F.concat(where, F.lit(": out of order")))
                .when((start(h) + h["old_count"] > F.size(src)) | (part(start(h), h["old_count"]) != body(h, " -")), F.concat(where, F.lit(": the source has other lines")))
            )

        faults = F.filter(F.transform(hs, fault), lambda x: x.isNotNull())
        pieces = F.transform(hs, lambda h, i: F.concat(part(end(i), start(h) - end(i)), body(h, " +")))
        last = end(F.size(hs))
        whole = F.concat(F.flatten(pieces), part(last, F.size(src) - last))
        text = F.when(F.size(whole) == 0, "").otherwise(F.concat(F.array_join(whole, "\n"), F.lit("\n")))
        return _with(F.try_element_at(faults, F.lit(1)), lambda e: F.struct(F.when(e.isNull(), text).alias("text"), e.alias("error")))

    return F.when(source.isNotNull() & found.isNotNull(), _with(found, lambda hs: _with(_lines(source), lambda src: result(src, hs))))


def apply_text(source: Column, diff: Column) -> Column:
    """As apply, of a unified diff's text; a text that isn't blank and has no hunk is an error."""
    none = (F.size(read(diff)) == 0) & (F.trim(F.regexp_replace(diff, r"\s", "")) != "")
    return F.when(none & source.isNotNull(), F.struct(F.lit(None).cast("string").alias("text"), F.lit("no hunks").alias("error"))).otherwise(apply(source, read(diff)))


def leaked_parts(prompt: Column, mutant: Column, found: Column, shortest: int = 8) -> Column:
    """What prompt gives away of hunks: their @@ heads, and added lines of at least shortest characters that it has and the mutant lacks.

    Lines are compared trimmed. Heads come first, then lines, each in order and once.
    """
    trimmed = lambda text: F.transform(_lines(text), lambda x: F.trim(x))

    def parts(hs: Column, said: Column, kept: Column) -> Column:
        heads = F.filter(F.transform(hs, _head), lambda h: F.contains(prompt, h))
        added = F.flatten(F.transform(hs, lambda h: F.filter(h["lines"], lambda x: F.substring(x, 1, 1) == "+")))
        own = F.filter(F.transform(added, lambda x: F.trim(F.substring(x, 2, 2**31 - 1))), lambda x: F.length(x) >= shortest)
        return F.array_distinct(F.concat(heads, F.array_intersect(F.array_except(own, kept), said)))

    return _with(found, lambda hs: _with(trimmed(prompt), lambda said: _with(trimmed(mutant), lambda kept: parts(hs, said, kept))))
