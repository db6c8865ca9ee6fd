"""Registered queries of rubrics and red-team bookkeeping, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.operators import rubrics as R

_R = lambda df, *names, to=9: df.withColumns({n: F.round(n, to) + 0.0 for n in names})


def _criteria(s, d):
    """Criteria of rubrics: parts as criteria of their brand's rubric."""
    k = F.col("p_partkey")
    probe = F.element_at(F.array(*map(F.lit, ["oracle.O1.max_err", "oracle.O2.ci", "oracle.O9.x", "oracle.O3", "oracle.O4.a.b", "oracle.O5.list.1"])), (k % 6 + 1).cast("int"))
    band = lambda b, sc: F.struct(F.lit(b).cast("double").alias("bound"), sc.cast("int").alias("score"))
    rising = F.array(band(0.2, F.lit(1)), band(0.6, F.lit(3)), band(9.0, F.when(k % 8 == 5, 4).otherwise(5)))
    falling = F.array(band(0.2, F.lit(5)), band(0.6, F.lit(3)), band(9.0, F.lit(1)))
    bands = F.when(k % 9 == 7, F.array().cast("array<struct<bound:double,score:int>>")).when(k % 2 == 0, rising).otherwise(falling)
    return B.table(s, d, "part").select(
        F.col("p_brand").alias("rubric"),
        k.alias("ord"),
        F.concat(F.lit("c"), (k % 97).cast("string")).alias("id"),
        (F.col("p_size") / 50).alias("weight"),
        (k % 3 != 0).alias("machine_probed"),
        F.when(k % 5 != 4, probe).alias("auto_probe"),
        F.array(F.lit(1), F.lit(3), F.lit(5)).alias("anchors"),
        bands.alias("thresholds"),
    )


def _rubric(s, d):
    """One rubric for all tasks."""
    band = lambda b, sc: F.struct(F.lit(b).cast("double").alias("bound"), F.lit(sc).alias("score"))
    up, down = F.array(band(0.2, 1), band(0.6, 3), band(9.0, 5)), F.array(band(0.2, 5), band(0.6, 3), band(9.0, 1))
    rows = [(1, "c1", 3.0, True, "oracle.O1.err"), (2, "c2", 2.0, True, "oracle.O2.ci"), (3, "c3", 1.0, True, "oracle.O3.list.-1"), (4, "c4", 1.5, True, "oracle.O4.deep.flag"), (5, "c5", 1.0, True, "oracle.O9.x"), (6, "c6", 0.5, False, None), (7, "c7", 1.0, True, "oracle.O1.nothing")]
    table = s.createDataFrame(rows, "ord int, id string, weight double, machine_probed boolean, auto_probe string")
    return table.withColumn("thresholds", F.when(F.col("ord") % 2 == 0, up).otherwise(down))


def _evidence(s, d):
    o = B.oracle_results(s, d)
    k = (F.col("task_id") % 10).cast("string")
    text = F.when(F.col("ord") == 1, F.concat(F.lit('{"err": 0.'), k, F.lit("}"))).when(F.col("ord") == 2, F.concat(F.lit('{"ci": [0.'), k, F.lit(", 0.95]}"))).when(F.col("ord") == 3, F.concat(F.lit('{"list": [7, 8, 0.'), k, F.lit("]}"))).when(F.col("ord") == 4, F.when(F.col("task_id") % 2 == 0, '{"deep": {"flag": true}}').otherwise('{"deep": {"flag": false}}')).otherwise("{}")
    return o.select("task_id", "oracle", "verdict", text.alias("evidence"))


def _checks(s, d):
    return B.oracle_results(s, d).withColumn("check", F.concat(F.lit("k"), (F.col("task_id") % 3).cast("string")))


def _outcomes(s, d):
    p = B.table(s, d, "part")
    return p.select((F.col("p_partkey") % 40).alias("task_id"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("long").alias("bytes"), (F.col("p_partkey") % 17).alias("flops"), (F.col("p_partkey") % 5 != 0).alias("usable"), (F.col("p_partkey") % 3 == 0).alias("differs"))


def _facts(s, d):
    n = B.table(s, d, "nation")
    return n.select(F.col("n_name").alias("seed"), F.create_map(F.lit("gpu"), F.col("n_nationkey") % 2 == 0, F.lit("ranks"), F.col("n_nationkey") % 3 == 0, F.lit("dtype"), F.lit(True)).alias("facts"))


def _attacks(s, d):
    names = F.array(F.lit("dtype"), F.lit("gpu"), F.lit("ranks"), F.lit("timing"))
    return B.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.slice(names, 1, (F.col("s_suppkey") % 5).cast("int")).alias("requires"))


def _prompts(s, d):
    """(task_id, prompt, baseline, mutant): text of documents, with a line changed in the mutant."""
    t = B.table(s, d, "documents")
    return t.select(F.col("doc_id").alias("task_id"), F.when(F.col("doc_id") % 3 == 0, F.substring_index("text", "\n", 2)).otherwise("fix it").alias("prompt"), F.col("text").alias("baseline"), F.regexp_replace("text", r"^[^\n]*", "changed").alias("mutant"))


_MARKERS = ["out of memory", "license", "token", "the "]
_WITH_DYNAMIC = lambda s, d, shift: B.table(s, d, "events").select(F.concat(F.when(F.col("user_id") % 2 == 0, "dynamic_").otherwise("static_"), "event_type").alias("kind"), ((F.col("user_id") + shift) % 40).cast("string").alias("detail"))

QUERIES = {
    "f21_f23_resolve": lambda s, d: R.resolve(_rubric(s, d), _evidence(s, d)).select("task_id", "id", "value", F.col("score").cast("long").alias("score"), "error"),
    "f22_probe_parts": lambda s, d: _criteria(s, d).select("ord", R.probe_parts(F.col("auto_probe"))["oracle"].alias("oracle"), F.array_join(R.probe_parts(F.col("auto_probe"))["keys"], ".").alias("keys")),
    "f24_direction": lambda s, d: _criteria(s, d).select("ord", R.direction(F.col("thresholds")).alias("direction"), R.cautious_end(F.col("thresholds")).alias("prefers")),
    "f25_band_score": lambda s, d: _criteria(s, d).select("ord", F.coalesce(R.band_score(F.col("weight"), F.col("thresholds")), F.lit(-1)).cast("long").alias("score")),
    "a18_rubric_scores": lambda s, d: _R(R.rubric_scores(R.resolve(_rubric(s, d), _evidence(s, d))), "score", "coverage"),
    "a19_normalize_weights": lambda s, d: _R(R.normalize_weights(_criteria(s, d)), "weight").select("rubric", "ord", "weight"),
    "a20_weight_shares": lambda s, d: _R(R.weight_shares(_criteria(s, d)), "total", "machine_share", "human_share", to=6),
    "p07_split_criteria": lambda s, d: R.split_criteria(_criteria(s, d)),
    "p10_capabilities": lambda s, d: B.table(s, d, "nation").select("n_name", F.array_join(R.missing_capabilities(F.slice(F.array(*map(F.lit, ["torch", "cuda", "jax", "triton"])), 1, F.col("n_nationkey") % 5), F.array(F.lit("torch"), F.when(F.col("n_nationkey") % 2 == 0, "jax").otherwise("cuda")), ["torch", "cuda", "jax", "triton"]), ",").alias("missing")),
    "p11_why_not": lambda s, d: R.attack_matrix(_facts(s, d), _attacks(s, d)).select("seed", "id", "why_not"),
    "p12_oracles_for": lambda s, d: B.tasks(s, d).select("task_id", F.array_join(R.oracles_for(F.col("tier"), F.col("domain")), ",").alias("oracles")),
    "p13_refine_tier": lambda s, d: B.tasks(s, d).select("task_id", R.refine_tier(F.col("tier"), F.element_at(F.array(*map(F.lit, ["numeric", "exception", "shape", "hang", "loss_curve", "performance"])), (F.col("task_id") % 6 + 1).cast("int"))).alias("tier")),
    "p14_problems": lambda s, d: R.problems(_criteria(s, d), ["O1", "O2", "O4"], ["c3", "c6", "c9"], ["c10", "c11"]),
    "p15_leaked_lines": lambda s, d: R.leaked_lines(_prompts(s, d)),
    "p16_leaked_names": lambda s, d: B.table(s, d, "documents").select("doc_id", F.array_join(R.leaked_names(F.col("text"), F.array(F.lit("the"), F.lit("tion"), F.lit("License"))), ",").alias("names")),
    "p17_first_marker": lambda s, d: B.table(s, d, "documents").select("doc_id", R.first_marker(F.col("text"), _MARKERS).alias("marker")),
    "p18_all_markers": lambda s, d: B.table(s, d, "pages").select("page_id", F.array_join(R.all_markers(F.col("html"), ["<script", "http://", "@import", "<link"]), ",").alias("markers")),
    "a25_anti_cheat_verdict": lambda s, d: R.anti_cheat_verdict(_checks(s, d)),
    "a29_catchers": lambda s, d: R.catchers(_checks(s, d)),
    "a30_suite": lambda s, d: _R(R.suite(B.table(s, d, "part").select((F.col("p_partkey") % 5 != 0).alias("applies"), (F.col("p_partkey") % 11 == 0).alias("control"), F.lit("O3/a").alias("expected"), F.when(F.col("p_partkey") % 4 != 0, F.when(F.col("p_partkey") % 6 == 1, "O1/b").otherwise("O3/a")).alias("catcher"))), "catch_rate"),
    "a31_s07_profiler_stats": lambda s, d: _R(R.profiler_stats(B.table(s, d, "orders").select(F.col("o_orderpriority").alias("metric"), F.when(F.col("o_orderkey") % 10 == 3, "n/a").otherwise(F.format_number("o_totalprice", 2)).alias("value"))), "mean", to=4),
    "j05_criteria_alphas": lambda s, d: R.criteria_with_alphas(_criteria(s, d), B.table(s, d, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("criterion"), F.round(F.col("s_suppkey") % 10 / F.lit(10.0), 3).alias("alpha"))),
    "j07_probe_matches": lambda s, d: R.resolve(_rubric(s, d), _evidence(s, d)).groupBy("id", "error").agg(F.count("*").alias("n")),
    "j14_attack_matrix": lambda s, d: R.attack_matrix(_facts(s, d), _attacks(s, d)).groupBy("id").agg(F.count_if("applies").alias("applies"), F.count("*").alias("n")),
    "j18_new_findings": lambda s, d: R.new_findings(_WITH_DYNAMIC(s, d, 0), _WITH_DYNAMIC(s, d, 1)).groupBy("kind", "detail").agg(F.count("*").alias("n")),
    "u02_overlay": lambda s, d: R.overlay(B.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), B.table(s, d, "region").select((F.col("r_regionkey") * 7).alias("id"), F.col("r_name").alias("name"))),
    "u04_world_sizes": lambda s, d: R.world_sizes(B.table(s, d, "part").select((F.col("p_size") % 12).alias("size")), 8),
    "w10_partition_shapes": lambda s, d: R.partition_shapes(_outcomes(s, d)).withColumn("ord", F.col("ord").cast("long")),
    "w11_witnesses": lambda s, d: R.witnesses(R.partition_shapes(_outcomes(s, d))),
    "t09_dearest_shape": lambda s, d: R.dearest_shape(_outcomes(s, d)),
    "t10_performance_shapes": lambda s, d: R.performance_shapes(R.partition_shapes(_outcomes(s, d))).withColumn("nth", F.col("nth").cast("long")),
    "f10_truncate": lambda s, d: B.table(s, d, "documents").select("doc_id", R.truncate(F.col("text")).alias("short")),
    "f11_neutral_links": lambda s, d: B.table(s, d, "pages").select("page_id", R.neutral_links(F.col("url")).alias("url")),
}

_TASKS5 = "ev AS (SELECT DISTINCT task_id FROM oracle_results)"
_D = "(task_id % 10) / 10e0"
_UP = "CASE WHEN {0} <= 2e-1 THEN 1 WHEN {0} <= 6e-1 THEN 3 ELSE 5 END"
_DOWN = "CASE WHEN {0} <= 2e-1 THEN 5 WHEN {0} <= 6e-1 THEN 3 ELSE 1 END"
_RES = f"""{_TASKS5}, rs AS (SELECT task_id, 'c1' AS id, {_D} AS value, {_DOWN.format(_D)} AS score, NULL AS error, 3e0 AS weight FROM ev
 UNION ALL SELECT task_id, 'c2', {_D}, {_UP.format(_D)}, NULL, 2e0 FROM ev
 UNION ALL SELECT task_id, 'c3', {_D}, {_DOWN.format(_D)}, NULL, 1e0 FROM ev
 UNION ALL SELECT task_id, 'c4', CASE WHEN task_id % 2 = 0 THEN 1e0 ELSE 0e0 END, CASE WHEN task_id % 2 = 0 THEN 5 ELSE 1 END, NULL, 15e-1 FROM ev
 UNION ALL SELECT task_id, 'c5', NULL, NULL, 'oracle did not run', 1e0 FROM ev UNION ALL SELECT task_id, 'c6', NULL, NULL, 'for human raters', 5e-1 FROM ev
 UNION ALL SELECT task_id, 'c7', NULL, NULL, 'no number at this path', 1e0 FROM ev)"""
_CRIT = """cr AS (SELECT p_brand AS rubric, p_partkey AS ord, 'c' || (p_partkey % 97) AS id, p_size / 50 AS weight, p_partkey % 3 <> 0 AS machine, CASE WHEN p_partkey % 5 <> 4 THEN ['oracle.O1.max_err', 'oracle.O2.ci', 'oracle.O9.x', 'oracle.O3', 'oracle.O4.a.b', 'oracle.O5.list.1'][p_partkey % 6 + 1] END AS probe,
 CASE WHEN p_partkey % 9 = 7 THEN 'none' WHEN p_partkey % 2 = 0 THEN 'up' ELSE 'down' END AS band, CASE WHEN p_partkey % 8 = 5 THEN 4 ELSE 5 END AS top FROM part)"""
_CHECKS = "ck AS (SELECT *, 'k' || (task_id % 3) AS chk FROM oracle_results)"
_OUT = "oc AS (SELECT p_partkey % 40 AS task_id, 's' || p_partkey AS name, CAST(p_size AS BIGINT) AS bytes, p_partkey % 17 AS flops, p_partkey % 5 <> 0 AS usable, p_partkey % 3 = 0 AS differs FROM part), pl AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY bytes, flops, name) AS ord FROM oc), pt AS (SELECT task_id, name, ord, CASE WHEN differs THEN 'detect' ELSE 'decoy' END AS role FROM pl WHERE ord <= 24 AND usable)"
_MATRIX = "mx AS (SELECT n_name AS seed, s_suppkey AS id, list_filter(['dtype', 'gpu', 'ranks', 'timing'][1:s_suppkey % 5], lambda p: NOT (p = 'dtype' OR (p = 'gpu' AND n_nationkey % 2 = 0) OR (p = 'ranks' AND n_nationkey % 3 = 0)))[1] AS why_not FROM nation, supplier)"
_PROBLEMS = """SELECT rubric, id, unnest(list_filter([CASE WHEN id IN ('c3', 'c6', 'c9') AND NOT machine THEN 'an oracle measures it, but people rate it' END, CASE WHEN probe IS NOT NULL AND NOT machine THEN 'its probe is not used' END, CASE WHEN id IN ('c10', 'c11') AND machine THEN 'no oracle can measure it' END, CASE WHEN machine AND band = 'none' THEN 'no thresholds' END,
 CASE WHEN machine AND (probe IS NULL OR probe = 'oracle.O3') THEN 'malformed probe' END, CASE WHEN machine AND split_part(probe, '.', 2) IN ('O9', 'O5') THEN 'its oracle does not run' END, CASE WHEN machine AND band = 'up' AND top = 4 THEN 'a score has no anchor' END], lambda x: x IS NOT NULL)) AS problem FROM cr
 UNION ALL SELECT rubric, id, 'id is not unique' FROM cr GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT rubric, NULL, CASE WHEN sum(weight) <= 0 THEN 'no positive weight' ELSE 'weights do not sum to 1' END FROM cr GROUP BY 1 HAVING abs(sum(weight) - 1) > 1e-9"""
_FIND = "SELECT CASE WHEN user_id % 2 = 0 THEN 'dynamic_' ELSE 'static_' END || event_type AS kind, CAST((user_id + {0}) % 40 AS VARCHAR) AS detail FROM events"

ORACLE_SQL = {
    "f21_f23_resolve": B.sql("oracle_results", f"WITH {_RES} SELECT task_id, id, value, CAST(score AS BIGINT) AS score, error FROM rs"),
    "f22_probe_parts": f"WITH {_CRIT} SELECT ord, CASE WHEN probe <> 'oracle.O3' THEN split_part(probe, '.', 2) END AS oracle, CASE WHEN probe <> 'oracle.O3' THEN regexp_replace(probe, '^oracle\\.[^.]*\\.', '') END AS keys FROM cr",
    "f24_direction": f"WITH {_CRIT} SELECT ord, CASE band WHEN 'none' THEN 'mixed' WHEN 'up' THEN 'higher_is_better' ELSE 'lower_is_better' END AS direction, CASE band WHEN 'up' THEN 'lo' WHEN 'down' THEN 'hi' END AS prefers FROM cr",
    "f25_band_score": f"WITH {_CRIT} SELECT ord, CAST(CASE band WHEN 'none' THEN -1 WHEN 'up' THEN CASE WHEN weight <= 2e-1 THEN 1 WHEN weight <= 6e-1 THEN 3 ELSE top END ELSE {_DOWN.format('weight')} END AS BIGINT) AS score FROM cr",
    "a18_rubric_scores": B.sql("oracle_results", f"WITH {_RES} SELECT task_id, round(sum(weight * score) / sum(weight) FILTER (score IS NOT NULL), 9) + 0e0 AS score, round(sum(weight) FILTER (score IS NOT NULL) / sum(weight), 9) + 0e0 AS coverage, count(score) AS n_scored, count(*) - count(score) AS n_unscored FROM rs GROUP BY 1"),
    "a19_normalize_weights": f"WITH {_CRIT} SELECT rubric, ord, round(weight / sum(weight) OVER (PARTITION BY rubric), 9) + 0e0 AS weight FROM cr",
    "a20_weight_shares": f"WITH {_CRIT} SELECT rubric, round(sum(weight), 6) + 0e0 AS total, round(avg(machine::INT), 6) + 0e0 AS machine_share, round(coalesce(sum(weight) FILTER (NOT machine), 0) / sum(weight), 6) + 0e0 AS human_share FROM cr GROUP BY 1",
    "p07_split_criteria": f"WITH {_CRIT} SELECT rubric, coalesce(string_agg(id, ',' ORDER BY ord) FILTER (machine), '') AS machine, coalesce(string_agg(id, ',' ORDER BY ord) FILTER (NOT machine), '') AS human FROM cr GROUP BY 1",
    "p10_capabilities": "SELECT n_name, array_to_string(list_sort(list_filter(['torch', 'cuda', 'jax', 'triton'][1:n_nationkey % 5], lambda c: c <> 'torch' AND c <> CASE WHEN n_nationkey % 2 = 0 THEN 'jax' ELSE 'cuda' END)), ',') AS missing FROM nation",
    "p11_why_not": f"WITH {_MATRIX} SELECT seed, id, why_not FROM mx",
    "p12_oracles_for": B.sql("tasks", "SELECT task_id, array_to_string(list_filter(['O1', CASE WHEN tier = 'T4' THEN 'O2' END, 'O3', CASE WHEN domain IN ('triton', 'pallas', 'cuda', 'jax', 'pytorch') OR tier IN ('T1', 'T4') THEN 'O4' END, CASE WHEN domain IN ('distributed', 'checkpointing') OR tier = 'T6' THEN 'O5' END], lambda x: x IS NOT NULL), ',') AS oracles FROM tasks"),
    "p13_refine_tier": B.sql("tasks", "SELECT task_id, CASE task_id % 6 WHEN 1 THEN 'T2' WHEN 3 THEN 'T2' WHEN 2 THEN 'T3' WHEN 4 THEN 'T6' ELSE tier END AS tier FROM tasks"),
    "p14_problems": f"WITH {_CRIT} {_PROBLEMS}",
    "p15_leaked_lines": "WITH b AS (SELECT DISTINCT doc_id, doc_id % 3 AS r, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), m AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '^[^\\n]*', 'changed'), chr(10)))) AS line FROM documents), p AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10))[1:2])) AS line FROM documents WHERE doc_id % 3 = 0) SELECT b.doc_id AS task_id, b.line FROM b JOIN p ON b.doc_id = p.doc_id AND b.line = p.line WHERE length(b.line) >= 8 AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = b.doc_id AND m.line = b.line)",
    "p16_leaked_names": "SELECT doc_id, array_to_string(list_filter(['tion', 'License'], lambda n: contains(text, n)), ',') AS names FROM documents",
    "p17_first_marker": f"SELECT doc_id, list_filter({_MARKERS}, lambda m: contains(lower(text), m))[1] AS marker FROM documents",
    "p18_all_markers": "SELECT page_id, array_to_string(list_filter(['<script', 'http://', '@import', '<link'], lambda m: contains(lower(html), m)), ',') AS markers FROM pages",
    "a25_anti_cheat_verdict": B.sql("oracle_results", "SELECT task_id, CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'ERROR') THEN 'ERROR' WHEN NOT bool_or(verdict = 'PASS') THEN 'SKIP' ELSE 'PASS' END AS verdict FROM oracle_results GROUP BY 1"),
    "a29_catchers": B.sql("oracle_results", f"WITH {_CHECKS}, f AS (SELECT task_id, oracle || '/' || chk AS name, min(ord) AS ord FROM ck WHERE verdict = 'FAIL' GROUP BY 1, 2) SELECT task_id, string_agg(name, ',' ORDER BY ord, name) AS catchers FROM f GROUP BY 1"),
    "a30_suite": "SELECT count(*) FILTER (a AND c) AS caught, count(*) FILTER (a AND NOT c) AS missed, count(*) FILTER (a AND c AND p_partkey % 6 = 1) AS mismatched, count(*) FILTER (p_partkey % 11 = 0 AND c) AS false_positives, round(count(*) FILTER (a AND c) / count(*) FILTER (a), 9) + 0e0 AS catch_rate, count(*) FILTER (a AND NOT c) = 0 AND count(*) FILTER (p_partkey % 11 = 0 AND c) = 0 AS ok FROM (SELECT *, p_partkey % 5 <> 0 AND p_partkey % 11 <> 0 AS a, p_partkey % 4 <> 0 AS c FROM part)",
    "a31_s07_profiler_stats": "SELECT o_orderpriority AS metric, count(*) AS n, min(round(o_totalprice, 2)) AS low, max(round(o_totalprice, 2)) AS high, round(avg(round(o_totalprice, 2)), 4) + 0e0 AS mean FROM orders WHERE o_orderkey % 10 <> 3 GROUP BY 1",
    "j05_criteria_alphas": f"WITH {_CRIT}, c AS (SELECT id AS criterion, bool_or(machine) AS machine, count(*) AS n_rubrics FROM cr GROUP BY 1), a AS (SELECT 'c' || s_suppkey AS criterion, round(s_suppkey % 10 / 10e0, 3) AS alpha FROM supplier) SELECT coalesce(c.criterion, a.criterion) AS criterion, machine, n_rubrics, alpha FROM c FULL JOIN a ON c.criterion = a.criterion",
    "j07_probe_matches": B.sql("oracle_results", f"WITH {_RES} SELECT id, error, count(*) AS n FROM rs GROUP BY 1, 2"),
    "j14_attack_matrix": f"WITH {_MATRIX} SELECT id, count(*) FILTER (why_not IS NULL) AS applies, count(*) AS n FROM mx GROUP BY 1",
    "j18_new_findings": f"WITH m AS ({_FIND.format(0)}), b AS (SELECT DISTINCT * FROM ({_FIND.format(1)}) WHERE starts_with(kind, 'dynamic_')) SELECT kind, detail, count(*) AS n FROM m WHERE (kind, detail) NOT IN (SELECT (kind, detail) FROM b) GROUP BY 1, 2",
    "u02_overlay": "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey * 7 FROM region) UNION ALL SELECT r_regionkey * 7, r_name FROM region",
    "u04_world_sizes": "SELECT DISTINCT p_size % 12 AS size, CASE WHEN p_size % 12 < 1 THEN 'not positive' WHEN p_size % 12 = 1 THEN 'nothing to compare' WHEN p_size % 12 > 8 THEN 'more than there are' END AS reason FROM part",
    "w10_partition_shapes": f"WITH {_OUT} SELECT * FROM pt",
    "w11_witnesses": f"WITH {_OUT} SELECT task_id, arg_min(name, ord) AS witness FROM pt WHERE role = 'detect' GROUP BY 1",
    "t09_dearest_shape": f"WITH {_OUT} SELECT task_id, name FROM oc WHERE usable QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY bytes DESC, flops DESC, name DESC) = 1",
    "t10_performance_shapes": f"WITH {_OUT} SELECT task_id, name, row_number() OVER (PARTITION BY task_id ORDER BY ord DESC) AS nth FROM (SELECT *, bool_or(role = 'detect') OVER (PARTITION BY task_id) AS seen FROM pt) WHERE role = 'detect' OR NOT seen QUALIFY nth <= 3",
    "f10_truncate": "SELECT doc_id, CASE WHEN length(t) > 240 THEN substr(t, 1, 237) || '...' ELSE t END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)",
    "f11_neutral_links": "SELECT page_id, replace(url, '://', ':&#47;&#47;') AS url FROM pages",
}
