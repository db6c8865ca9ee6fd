"""Registered queries of the calibration operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.functions.hashing import sha256_text, unit, unit_sql
from plumbline.operators import calibration as C

_R = lambda df, *names: df.withColumns({n: F.round(n, 9) for n in names})


def _estimates(s, d):
    return C.estimates(B.attempts(s, d))


def _stats(s, d):
    """(task_id, pass_at_1, stats) from events by user, with differing names of the statistics."""
    e = B.attempts(s, d)
    k = F.col("item")
    tokens = F.struct(F.element_at(F.array(*map(F.lit, C.ALIASES["mean_tokens"])), (k % 4 + 1).cast("int")).alias("key"), F.when(k % 7 == 3, "many").otherwise((k * 37 % 1200).cast("string")).alias("value"))
    backs = F.struct(F.element_at(F.array(*map(F.lit, C.ALIASES["backtracks"])), (k % 3 + 1).cast("int")).alias("key"), (k % 3).cast("string").alias("value"))
    entropy = F.struct(F.lit("entropy_proxy").alias("key"), (k % 10 / F.lit(10.0)).cast("string").alias("value"))
    parts = F.array_compact(F.array(tokens, F.when(k % 5 != 2, backs), F.when(k % 2 == 0, entropy)))
    return e.select(k.alias("task_id"), F.when(k % 3 == 0, 0.97).otherwise(F.col("c") / F.col("n")).alias("pass_at_1"), F.map_from_entries(parts).alias("stats"))


QUERIES = {
    "e01_pass_at_k": lambda s, d: B.attempts(s, d).select("item", "n", "c", *[F.round(C.pass_at_k(F.col("n"), F.col("c"), F.lit(k)), 9).alias(f"pass_at_{k}") for k in (2, 4, 8, 16)]),
    "e02_pass_at_1": lambda s, d: B.attempts(s, d).select("item", F.round(C.pass_at_1(F.col("n"), F.col("c")), 9).alias("pass_at_1")),
    "e03_wilson": lambda s, d: B.attempts(s, d).select("item", *[F.round(x, 9).alias(n) for x, n in zip(C.wilson(F.col("n"), F.col("c")), ("low", "high"))]),
    "e04_jeffreys": lambda s, d: _R(C.jeffreys(B.attempts(s, d)), "low", "high"),
    "e05_estimates": lambda s, d: _R(_estimates(s, d), "pass_at_1", "pass_at_k", "ci_low", "ci_high"),
    "e06_route": lambda s, d: C.route(_estimates(s, d)).select("item", "band", "route", "confident", F.col("crossed").cast("long").alias("crossed")),
    "e07_calibrate_bank": lambda s, d: C.route(C.estimates(C.attempts_of(C.stub_draws(B.tasks(s, d))))).groupBy("band", "route", "confident").agg(F.count("*").alias("n")),
    "e08_stub_draws": lambda s, d: C.stub_draws(B.tasks(s, d)).select("task_id", F.col("i").cast("long").alias("i"), "correct"),
    "a16_route_counts": lambda s, d: C.route_counts(C.route(_estimates(s, d))),
    "p05_band": lambda s, d: _estimates(s, d).select("item", C.band(F.col("pass_at_1")).alias("band")),
    "p19_contamination": lambda s, d: C.contamination(_stats(s, d)).select("task_id", "flagged", "assessed", F.round("score", 9).alias("score"), F.col("n_signals").cast("long").alias("n_signals")),
    "f02_sha256": lambda s, d: B.table(s, d, "documents").select("doc_id", sha256_text(F.col("text")).alias("digest")),
    "f03_unit_hash": lambda s, d: B.table(s, d, "documents").select("doc_id", F.round(unit(F.lit("u"), F.col("doc_id")), 12).alias("u")),
    "f26_crossed_edges": lambda s, d: _estimates(s, d).select("item", F.array_join(F.transform(C.crossed_edges(F.col("ci_low"), F.col("ci_high")), lambda e: F.format_number(e, 2)), ",").alias("edges")),
    "f27_read_stat": lambda s, d: _stats(s, d).select("task_id", *[C.read_stat(F.col("stats"), n).alias(n) for n in C.ALIASES]),
    "f28_token_count": lambda s, d: B.table(s, d, "documents").select("doc_id", C.token_count(F.col("text")).cast("long").alias("n_tokens")),
    "f29_task_tag": lambda s, d: B.table(s, d, "documents").select("doc_id", C.embedded_task_id(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("do [task:T"), F.col("doc_id").cast("string"), F.lit("] now"))).otherwise("none")).alias("task_id")),
}

_Z = repr(C.z_value(0.95))
_PASS = "CASE WHEN c <= 0 THEN 0e0 WHEN n - c < least({0}, n) THEN 1e0 ELSE 1 - list_product([CAST(n - c - i AS DOUBLE) / (n - i) FOR i IN range(0, least({0}, n))]) END"
_LOW = f"CASE WHEN c <= 0 THEN 0e0 ELSE greatest(0e0, (c / n + {_Z} * {_Z} / (n * 2) - {_Z} * sqrt(c / n * (1 - c / n) / n + {_Z} * {_Z} / (n * n * 4e0))) / (1 + {_Z} * {_Z} / n)) END"
_HIGH = f"CASE WHEN c >= n THEN 1e0 ELSE least(1e0, (c / n + {_Z} * {_Z} / (n * 2) + {_Z} * sqrt(c / n * (1 - c / n) / n + {_Z} * {_Z} / (n * n * 4e0))) / (1 + {_Z} * {_Z} / n)) END"
_EST = f"est AS (SELECT item, n, c, least(8, n) AS k, c / n AS pass_at_1, {_PASS.format(8)} AS pass_at_k, {_LOW} AS ci_low, {_HIGH} AS ci_high FROM {{0}} WHERE n > 0)"
_BAND = "CASE WHEN {0} < 0.1::DOUBLE THEN 'frontier' WHEN {0} <= 0.7::DOUBLE THEN 'gold' WHEN {0} <= 0.9::DOUBLE THEN 'thin' ELSE 'saturated' END"
_RANK = "CASE WHEN {0} < 0.1::DOUBLE THEN 2 WHEN {0} <= 0.7::DOUBLE THEN 3 ELSE 4 END"
_ROUTED = f"""routed AS (SELECT *, {_BAND.format('pass_at_1')} AS band, CASE WHEN pass_at_k <= 0 THEN 'escalate' ELSE ['escalate', 'frontier', 'gold', 'reject'][least(a, b, h)] END AS route, pass_at_k <= 0 OR (a = b AND a = h) AS confident
 FROM (SELECT *, {_RANK.format('pass_at_1')} AS a, {_RANK.format('ci_low')} AS b, {_RANK.format('ci_high')} AS h FROM est))"""
_EDGES = "list_filter([0.1::DOUBLE, 0.7::DOUBLE], lambda e: ci_low < e AND e <= ci_high)"
_DRAWS = f"SELECT task_id, i, {unit_sql(repr('draw'), 'task_id', 'i')} < {unit_sql(repr('skill'), 'task_id')} AS correct FROM tasks, (SELECT unnest(range(0, 8)) AS i)"
_STATS = """stats AS (SELECT item AS task_id, CASE WHEN item % 3 = 0 THEN 0.97::DOUBLE ELSE c / n END AS pass_at_1, CASE WHEN item % 7 = 3 THEN NULL ELSE CAST(item * 37 % 1200 AS DOUBLE) END AS mean_tokens,
 CASE WHEN item % 5 <> 2 THEN CAST(item % 3 AS DOUBLE) END AS backtracks, CASE WHEN item % 2 = 0 THEN item % 10 / 10e0 END AS entropy FROM attempts)"""

ORACLE_SQL = {
    "e01_pass_at_k": B.sql("attempts", "SELECT item, n, c, " + ", ".join(f"round({_PASS.format(k)}, 9) AS pass_at_{k}" for k in (2, 4, 8, 16)) + " FROM attempts"),
    "e02_pass_at_1": B.sql("attempts", "SELECT item, round(c / n, 9) AS pass_at_1 FROM attempts"),
    "e03_wilson": B.sql("attempts", f"SELECT item, round({_LOW}, 9) AS low, round({_HIGH}, 9) AS high FROM attempts"),
    "e05_estimates": B.sql("attempts", f"WITH {_EST.format('attempts')} SELECT item, n, c, k, round(pass_at_1, 9) AS pass_at_1, round(pass_at_k, 9) AS pass_at_k, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, array_to_string(list_filter([CASE WHEN n < 8 THEN 'clamped' END, CASE WHEN n < 8 THEN 'small' END, CASE WHEN ci_high - ci_low >= 0.5 THEN 'wide' END], lambda x: x IS NOT NULL), ',') AS notes FROM est"),
    "e06_route": B.sql("attempts", f"WITH {_EST.format('attempts')}, {_ROUTED} SELECT item, band, route, confident, len({_EDGES}) AS crossed FROM routed"),
    "e07_calibrate_bank": B.sql("tasks", f"WITH draws AS ({_DRAWS}), tries AS (SELECT task_id AS item, count(*) AS n, count(*) FILTER (correct) AS c FROM draws GROUP BY 1), {_EST.format('tries')}, {_ROUTED} SELECT band, route, confident, count(*) AS n FROM routed GROUP BY ALL"),
    "e08_stub_draws": B.sql("tasks", _DRAWS),
    "a16_route_counts": B.sql("attempts", f"WITH {_EST.format('attempts')}, {_ROUTED} SELECT r.route, count(item) AS n, count(item) FILTER (confident) AS confident FROM (SELECT unnest(['escalate', 'frontier', 'gold', 'reject']) AS route) r LEFT JOIN routed USING (route) GROUP BY 1"),
    "p05_band": B.sql("attempts", f"SELECT item, {_BAND.format('c / n')} AS band FROM attempts"),
    "p19_contamination": B.sql("attempts", f"WITH {_STATS}, m AS (SELECT *, (mean_tokens IS NOT NULL)::INT + (backtracks IS NOT NULL)::INT + (entropy IS NOT NULL)::INT AS known, coalesce(mean_tokens >= 600, false)::INT + coalesce(backtracks <= 1, false)::INT + coalesce(entropy <= 0.35::DOUBLE, false)::INT AS hit, pass_at_1 >= 0.95::DOUBLE AS sat FROM stats) SELECT task_id, sat AND known >= 2 AND hit >= 2 AS flagged, NOT sat OR known >= 2 AS assessed, round(CASE WHEN sat AND known >= 2 THEN hit / known ELSE 0e0 END, 9) AS score, CAST(CASE WHEN sat THEN hit ELSE 0 END AS BIGINT) AS n_signals FROM m"),
    "f02_sha256": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "f03_unit_hash": f"SELECT doc_id, round({unit_sql(repr('u'), 'doc_id')}, 12) AS u FROM documents",
    "f26_crossed_edges": B.sql("attempts", f"WITH {_EST.format('attempts')} SELECT item, array_to_string([format('{{:.2f}}', e) FOR e IN {_EDGES}], ',') AS edges FROM est"),
    "f27_read_stat": B.sql("attempts", f"WITH {_STATS} SELECT task_id, mean_tokens, backtracks, entropy FROM stats"),
    "f28_token_count": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')) AS n_tokens FROM documents",
    "f29_task_tag": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'T' || doc_id END AS task_id FROM documents",
}
