"""Near duplicates among vectors against all pairs."""

import numpy as np
import pytest

from plumbline.llm import queries, vector_dedup


def brute(rows, least=0.9):
    """{(place, vec_id): (n_links, component_id, kept)} of [(vec_id, vector)], by all pairs."""
    unit = {}
    for i, (k, x) in enumerate(rows):
        if k is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            v = np.array(x, dtype=np.float64)
            v = v / np.abs(v).max()
            unit[i] = v / np.sqrt((v * v).sum())
    names = {i: k for i, (k, _) in enumerate(rows)}
    count, label = dict.fromkeys(range(len(rows)), 0), {i: i for i in unit}

    def root(i):
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    by_length = {}
    for i, v in unit.items():
        by_length.setdefault(len(v), []).append(i)
    for own in by_length.values():
        u = np.stack([unit[i] for i in own])
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= least, 1)), strict=True):
            count[own[a]] += 1
            count[own[b]] += 1
            label[root(own[a])] = root(own[b])
    low = {}
    for i in unit:
        low[root(i)] = min(low.get(root(i), names[i]), names[i])
    return [(k, count[i], low[root(i)] if i in unit else k, k is None or k == (low[root(i)] if i in unit else k)) for i, (k, _) in enumerate(rows)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows_of(queries.op13_embedding_dedup(spark, sf_dir)) == sorted(brute(rows), key=repr)


def near(draw, x, cosine):
    """A vector whose cosine with x is the one given."""
    x = x / np.linalg.norm(x)
    y = draw.standard_normal(len(x))
    y -= (y @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def planted(draw, n=1500, size=64):
    """Loose vectors, pairs close to the limit on either side, a tight group, a wide one and equal vectors."""
    base = draw.standard_normal((n, size))
    pairs = [near(draw, base[k], c) for k, c in enumerate(draw.uniform(0.9, 0.95, 300))]
    apart = [near(draw, base[300 + k], c) for k, c in enumerate(draw.uniform(0.85, 0.9, 300))]
    tight = [near(draw, base[700], c) for c in draw.uniform(0.99, 1, 200)]
    wide = [near(draw, base[700], c) for c in draw.uniform(0.85, 0.99, 200)] + [near(draw, base[701], 0.95) for _ in range(60)]
    same = [base[702]] * 40 + [base[702] * 3.0] * 3
    rows = [x.tolist() for x in [*base, *pairs, *apart, *tight, *wide, *same]]
    order = draw.permutation(len(rows))
    return [(int(k), rows[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("shard", [8192, 100])
def test_planted_links(spark, monkeypatch, shard):
    """No link below the limit, at least 0.99 of those above it; in one shard and in many under several salts."""
    monkeypatch.setattr(vector_dedup, "SHARD_ROWS", shard)
    monkeypatch.setattr(vector_dedup, "LOOKING_ROWS", 4 * shard)
    rows = planted(np.random.default_rng(11))
    wanted = {r[0]: r for r in brute(rows)}
    got = {r[0]: r for r in rows_of(vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))}
    assert all(got[k][1] <= wanted[k][1] for k in wanted) and len(got) == len(wanted)
    links = [sum(r[1] for r in found.values()) for found in (wanted, got)]
    assert links[1] >= 0.99 * links[0] > 10_000
    pairs = [k for k in wanted if wanted[k][1] == 1]
    assert sum(got[k][1] for k in pairs) >= 0.99 * len(pairs) > 300
    assert all(got[k][2] >= wanted[k][2] for k in wanted)
    assert sum(got[k][2] == wanted[k][2] for k in wanted) >= 0.99 * len(wanted)


ODD = [
    (1, None), (2, []), (3, [0.0, 0.0, 0.0, 0.0]), (4, [1.0, None, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0, 0.0]), (6, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]),
    (8, [1.0, 0.0, 0.0, 0.0]), (9, [1.0, 0.0]), (10, [2.0, 0.0]), (11, [1.0, 0.1, 0.0, 0.0]), (11, [-1.0, 0.0, 0.0, 0.0]), (11, [-1.0, 0.0, 0.0, 0.0]), (12, [1e308, 1e308, 0.0, 0.0]), (7, [1e-308, 1e-308, 0.0, -0.0]), (13, [-5.0, -0.0, 0.1, 0.0]), (14, [3.0]), (15, [4.0]), (15, [-4.0]),
]


def test_odd_tables(spark):
    """Vectors that can't be compared link with nothing; lengths keep apart; repeated and null ids each get their row."""
    schema = "vec_id long, embedding array<double>, n int, key string, x int, least int, links int"
    odd = spark.createDataFrame([(*r, 1, "k", 2, 3, 4) for r in ODD], schema)
    assert rows_of(vector_dedup.near_duplicates(odd)) == sorted(brute(ODD), key=repr)
    assert vector_dedup.near_duplicates(odd.where("false")).count() == 0
    assert rows_of(vector_dedup.near_duplicates(odd.where("vec_id < 4"))) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
