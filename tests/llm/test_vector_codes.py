"""Product codes against SQL, a brute-force version in Python integers, and odd tables."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import queries, vector_codes


def brute(rows, parts=4, entries=256, rounds=4):
    """{row number: (codes, error)} and the codebooks, of [(vec_id, vector)] with whole vectors of one length."""
    kept = [(k, [math.floor(v * 1024) for v in x], i) for i, (k, x) in enumerate(rows)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    width = len(kept[0][1]) // parts
    cut = [slice(p * width, (p + 1) * width) for p in range(parts)]
    books = [[x[c] for _, x, _ in first] for c in cut]

    def near(part, book):
        return min((sum((u - v) ** 2 for u, v in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, c in enumerate(cut):
            own = defaultdict(list)
            for _, x, _ in kept:
                own[near(x[c], books[p])[1]].append(x[c])
            for k, members in own.items():
                books[p][k] = [sum(v) // len(members) for v in zip(*members)]
    found = {i: [near(x[c], books[p]) for p, c in enumerate(cut)] for _, x, i in kept}
    return {i: ([k for _, k in f], sum(d for d, _ in f)) for i, f in found.items()}, books


def test_query_agrees_with_sql(agree):
    agree(queries.QUERIES["op11_vector_codes"], queries.ORACLE_SQL["op11_vector_codes"])


def test_brute_force_with_ties_and_copies(spark):
    draw = random.Random(3)
    rows = [(k, [draw.choice([-0.5, -0.001, 0.0, 0.25, 0.7]) for _ in range(8)]) for k in range(300)] + [(301, [0.25] * 8)] * 5
    wanted, books = brute(rows, entries=12)
    frame = spark.createDataFrame([(k, x, i) for i, (k, x) in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    wanted = brute([(r.vec_id, r.embedding) for r in frame.orderBy("label").collect()], entries=12)[0]
    got, own = vector_codes.encode(frame, entries=12)
    assert {r.label: (r.codes, r.error) for r in got.collect()} == wanted
    assert [b.tolist() for b in own] == books


def test_pruning_is_exact():
    """Few pivots, many, and rows that are entries: the nearest entry is that of all distances, with fewer evaluated."""
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.integers(-300, 300, (2000, 16)), np.repeat(draw.integers(-5, 5, (20, 16)), 5, axis=0)])
    book = np.concatenate([x[:200], x[:20], draw.integers(-300, 300, (36, 16))])
    every = ((x[:, None, :] - book[None]) ** 2).sum(2)
    for n in (1, 8, 64):
        pivots = vector_codes.far_apart(book, n)
        index, best, evaluated = vector_codes.nearest(x, vector_codes._roots(x, pivots).astype(np.float32), book, vector_codes._roots(pivots, book).astype(np.float32))
        assert (index == every.argmin(1)).all() and (best == every.min(1)).all()
        assert evaluated < every.size


NAN, INF = float("nan"), float("inf")
ODD = [(0, None, 1), (1, [0.1, None, 0.2, 0.3], 1), (2, [NAN, 0.0, 0.0, 0.0], 1), (3, [INF, 0.0, 0.0, 0.0], None), (4, [], 1), (5, [0.5, -0.5, 0.25, 0.125], 1), (5, [0.5, -0.5, 0.25, 0.125], 1), (None, [0.5, 0.5, 0.5, 0.5], None), (7, [1.0] * 8, 2), (8, [1.0] * 3, 2), (9, [-0.0001, 0.0, 3e38, -3e38], None)]


def test_odd_tables(spark):
    """Null, short, long and non-finite vectors go; repeated ids, null ids, null labels and huge components stay."""
    odd = spark.createDataFrame([(*r, "x", 3) for r in ODD], "vec_id long, embedding array<float>, label int, error string, far int")
    encoded, books = vector_codes.encode(odd)
    got = sorted(((r.vec_id, r.label, r.codes, r.error, r.label_error) for r in vector_codes.with_label_error(encoded).collect()), key=repr)
    assert [r[:2] for r in got] == sorted([(5, 1), (5, 1), (None, None), (9, None)], key=repr)
    assert all(r[3] == 0 == r[4] for r in got)  # four entries for four vectors
    assert [b.shape for b in books] == [(4, 1)] * 4 and books[0][:, 0].tolist() == [512, 512, -1, 512] and books[2][2, 0] == vector_codes.LIMIT
    for empty in (odd.where("false"), odd.where("vec_id < 5")):
        encoded, books = vector_codes.encode(empty)
        assert books == [] and vector_codes.with_label_error(encoded).count() == 0


@pytest.mark.parametrize("most", [0, 5])
def test_label_errors_by_join_and_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(vector_codes, "MAX_BROADCAST_LABELS", most)
    rows = spark.createDataFrame([(1, 5), (1, 7), (None, 2), (None, 3), (2, 2**62), (2, 2**62)], "label int, error long")
    assert {r.label: r.label_error for r in vector_codes.with_label_error(rows).collect()} == {1: 12, None: 5, 2: None}
