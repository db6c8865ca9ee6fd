"""Diffs: shortest edits against dynamic programming, round trips, and every way in which application is refused."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import patches as P


def _longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def _pairs(n, letters, seed, most=14):
    rng = random.Random(seed)
    return [tuple([rng.choice(letters) for _ in range(rng.randrange(most))] for _ in range(2)) for _ in range(n)]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_common_lines_are_longest(letters):
    for a, b in [*_pairs(1500, letters, 7), *_pairs(40, letters, 8, 90)]:
        found = P.common_lines(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p < r and q < t for (p, q), (r, t) in zip(found, found[1:]))
        assert len(found) == _longest(a, b)


def test_long_texts_with_few_changes():
    a = [str(k % 977) for k in range(60_000)]
    b = a[:100] + ["1", "new", "2"] + a[101:40_000] + a[40_007:]
    assert len(P.common_lines(a, b)) == 60_000 - 8


def test_round_trip(spark):
    """Written, read and applied, an edit gives the new text; a second application gives it only where no hunk has to be there."""
    texts = [("\n".join(a), "\n".join(b)) for a, b in _pairs(400, ["a", "b", "c", "", "- x", "@@ -1 +1 @@", "++"], 5, 30)]
    texts += [("", ""), ("", "a"), ("a", ""), ("\n", ""), ("a\n", "a"), ("a\r\nb", "a\nb"), ("é ü", "é u")]
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "id long, a string, b string").withColumn("h", P.hunks(F.col("a"), F.col("b")))
    rows = rows.withColumn("diff", P.as_text(F.col("h"), F.lit("old"), F.lit("new")))
    out = rows.select("*", (P.read(F.col("diff")) == F.col("h")).alias("same"), P.apply(F.col("a"), F.col("h")).alias("x"), P.apply_text(F.col("a"), F.col("diff")).alias("y")).collect()
    assert len(out) == len(texts)
    for r in out:
        ended = r.b if r.b == "" or r.b.endswith("\n") else r.b + "\n"
        assert r.same and r.x == r.y and r.x.error is None and r.x.text == ended, r
        old, new = (sum(1 for h in r.h for x in h.lines if x[0] == t) for t in "-+")
        a, b = P._split(r.a), P._split(r.b)
        assert len(a) - old == len(b) - new == _longest(a, b)


def test_refused(spark):
    good = "--- a\n+++ b\n@@ -2,2 +2,2 @@\n two\n-three\n+3\n"
    second = "@@ -1 +1 @@\n-one\n+1\n"
    source = "one\ntwo\nthree\n"
    cases = [
        (source, good, "one\ntwo\n3\n", None),
        ("one\ntwo\nthree", good, "one\ntwo\n3\n", None),
        ("zero\n" + source, good, None, "hunk 1: the source has other lines"),  # a line further down
        ("one\ntwo\n", good, None, "hunk 1: the source has other lines"),  # ends too early
        (source, good + second, None, "hunk 2: out of order"),
        (source, second + good.split("\n", 2)[2], "1\ntwo\n3\n", None),
        (source, good.replace("2,2 @@", "2,3 @@"), None, "hunk 1: counts don't fit its lines"),
        (source, "@@ -0,0 +1 @@\n+zero\n", "zero\none\ntwo\nthree\n", None),
        (source, "@@ -3,0 +4 @@\n+four\n\\ No newline at end of file\n", "one\ntwo\nthree\nfour\n", None),
        (source, "@@ -4,0 +5 @@\n+five\n", None, "hunk 1: the source has other lines"),  # behind the end
        (source, "@@ -0 +1 @@\n-one\n+1\n", None, "hunk 1: out of order"),  # there is no line 0
        (source, "nothing", None, "no hunks"),
        (source, " \n", source, None),
        (source, "", source, None),
        ("", "", "", None),
    ]
    rows = spark.createDataFrame([(k, c[0], c[1]) for k, c in enumerate(cases)], "k long, s string, d string").select("k", P.apply_text(F.col("s"), F.col("d")).alias("x"))
    got = {r.k: r.x for r in rows.collect()}
    for k, (_, _, text, error) in enumerate(cases):
        assert (got[k].text, got[k].error) == (text, error), k
    empty = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "s string, d string")
    for r in empty.select(P.apply_text(F.col("s"), F.col("d")).alias("x"), P.hunks(F.col("s"), F.col("d")).alias("h"), P.as_text(P.hunks(F.col("s"), F.col("d")), F.lit("a"), F.lit("b")).alias("t")).collect():
        assert r.h is None and r.t is None and (r.x is None or r.x.text is None)


def test_written_as_others_write_it(spark):
    """One line that changes in twenty, two changes six lines apart in one hunk, seven apart in two."""
    base = [str(k) for k in range(1, 21)]
    change = lambda *at: "\n".join("x" if k in at else line for k, line in enumerate(base))
    rows = spark.createDataFrame([("\n".join(base), change(9)), ("\n".join(base), change(2, 9)), ("\n".join(base), change(2, 10))], "a string, b string")
    one, two, three = (r[0] for r in rows.select(P.as_text(P.hunks(F.col("a"), F.col("b")), F.lit("a"), F.lit("b"))).collect())
    assert one == "--- a\n+++ b\n@@ -7,7 +7,7 @@\n 7\n 8\n 9\n-10\n+x\n 11\n 12\n 13\n"
    assert two.count("@@ -") == 1 and three.count("@@ -") == 2


def test_leaked_parts(spark):
    old, new = "total = 0\nfor x in items:\n    total -= x\n", "total = 0\nfor x in items:\n    total += x\n"
    prompts = ["mend it", "  total += x  ", "see @@ -1,3 +1,3 @@ there", "total -= x", "@@ -1,3 +1,3 @@\ntotal += x"]
    rows = spark.createDataFrame([(k, p, old, new) for k, p in enumerate(prompts)], "k long, p string, a string, b string")
    got = {r.k: r.l for r in rows.select("k", P.leaked_parts(F.col("p"), F.col("a"), P.hunks(F.col("a"), F.col("b"))).alias("l")).collect()}
    assert got == {0: [], 1: ["total += x"], 2: ["@@ -1,3 +1,3 @@"], 3: [], 4: ["@@ -1,3 +1,3 @@", "total += x"]}
