"""Registered queries of the bank metrics and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.functions.taxonomy import DOMAINS
from plumbline.operators import metrics as M


def _universe(spark, d):
    return M.universe(B.tasks(spark, d), M.last_by_path(B.verdict_files(spark, d)))


def _calibrated(spark, d):
    return B.attempts(spark, d).select(F.col("item").alias("task_id"), F.when(F.col("item") % 9 != 0, F.col("c") / F.col("n")).alias("pass_at_1"))


def _alphas(spark, d):
    t = B.table(spark, d, "nation")
    return t.select(F.col("n_name").alias("criterion"), F.when(F.col("n_nationkey") % 6 == 5, F.lit(float("nan"))).when(F.col("n_nationkey") % 6 == 4, F.lit(None)).otherwise(F.col("n_nationkey") * 7 % 25 / F.lit(24.0)).alias("alpha"))


def _attacks(spark, d):
    t = B.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return t.select(k.alias("id"), F.when(k % 4 != 0, k % 7 != 2).alias("caught"), F.when(k % 3 == 0, F.lit("O3/static")).alias("catcher"))


def _provenance(s, d):
    """Each document's provenance: expert time under one of nine names, as a number, a text or not at all."""
    n, k = F.col("n_chars").cast("string"), F.col("doc_id") % 9
    text = F.concat
    forms = [text(F.lit('{"sme": {"hours": '), n, F.lit("}}")), text(F.lit('{"sme_minutes": '), n, F.lit("}")), text(F.lit('{"sme": {"sme_seconds": '), n, F.lit("}}")), text(F.lit('{"sme_hours_total": '), n, F.lit(".5, \"sme_minutes\": 1}")), text(F.lit('{"sme": {"minutes": '), n, F.lit('}, "sme_hours": 7}')), text(F.lit('{"sme_hours": "'), n, F.lit('", "sme_seconds": 36}')), F.lit('{"sme_hours": true}'), F.lit('{"by": "hand"}'), F.lit("[1")]
    chosen = F.coalesce(*[F.when(k == i, form) for i, form in enumerate(forms)])
    return B.table(s, d, "documents").select(F.col("doc_id").alias("task_id"), chosen.alias("provenance"))


def _payloads(s, d):
    """A red-team report for each supplier, in one of the two shapes or in none."""
    k = F.col("s_suppkey")
    one = lambda i: F.struct(F.concat(F.lit("a"), F.lit(str(i))).alias("id"), F.when(k % 3 == i, k % 2 == 0).alias("caught"), F.when((k + i) % 4 == 0, "O1").alias("catcher"))
    listed = F.to_json(F.struct(F.array(*[one(i) for i in range(3)]).alias("attacks")))
    counted = F.to_json(F.struct((k % 7).alias("n_caught"), (k % 7 + k % 3).alias("n_attacks"), F.array(F.concat(F.lit("u"), k.cast("string"))).alias("uncaught")))
    short = F.to_json(F.struct((k % 2).alias("caught"), F.lit(4).alias("total")))
    return B.table(s, d, "supplier").select(k.alias("id"), F.when(k % 5 < 2, listed).when(k % 5 == 2, counted).when(k % 5 == 3, short).otherwise("[]").alias("payload"))


_CALIBRATED = "SELECT item AS task_id, CASE WHEN item % 9 <> 0 THEN c / n END AS pass_at_1 FROM attempts"
_ALPHAS = "SELECT n_name AS criterion, CASE n_nationkey % 6 WHEN 5 THEN 'nan'::DOUBLE WHEN 4 THEN NULL ELSE n_nationkey * 7 % 25 / 24e0 END AS alpha FROM nation"
_ATTACKS = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 7 <> 2 END AS caught, CASE WHEN s_suppkey % 3 = 0 THEN 'O3/static' END AS catcher FROM supplier"
_ACCEPTED = "coalesce(verdict = 'PASS' AND executed, false)"


def _metric(name, rows, value, numerator, denominator, op=">="):
    target = repr(M.TARGETS[name]) + "::DOUBLE"
    return f"SELECT '{name}' AS metric, round(v, 9) AS value, round(CAST(a AS DOUBLE), 6) AS numerator, CAST(b AS BIGINT) AS denominator, {target} AS target, v {op} {target} AS met FROM (SELECT {value} AS v, {numerator} AS a, {denominator} AS b FROM {rows})"


def _share(name, rows, hit):
    n = f"count(*) FILTER (coalesce({hit}, false))"
    return _metric(name, rows, f"CASE WHEN count(*) > 0 THEN {n} / count(*) END", n, "count(*)")


_COVERAGE = f"""(SELECT t.tier || '/' || d.domain AS cell, t.tier, d.domain, t.value_rank, t.value_rank >= 5 AS silent, coalesce(n, 0) AS n, greatest(0, 5 - coalesce(n, 0)) AS shortfall,
 least(1e0, coalesce(n, 0) / 5e0) AS fill, t.value_rank * (1 - least(1e0, coalesce(n, 0) / 5e0)) AS priority
 FROM (SELECT 'T' || k AS tier, CAST(k AS INT) AS value_rank FROM (SELECT unnest(range(1, 7)) AS k)) t
 CROSS JOIN (SELECT unnest({[*DOMAINS]}) AS domain) d
 LEFT JOIN (SELECT tier, domain, count(*) AS n FROM TASKS GROUP BY ALL) c ON c.tier = t.tier AND c.domain = d.domain)"""


def _cov(tasks="tasks", target=5):
    return _COVERAGE.replace("TASKS", tasks).replace("greatest(0, 5 ", f"greatest(0, {target} ").replace("/ 5e0", f"/ {target}e0")


_M = {
    "headline": _share("headline", "universe", _ACCEPTED),
    "gold": _share("gold_band", f"(SELECT * FROM ({_CALIBRATED}) WHERE pass_at_1 IS NOT NULL)", "pass_at_1 BETWEEN 0.1::DOUBLE AND 0.7::DOUBLE"),
    "alpha": _share("alpha_share", f"(SELECT * FROM ({_ALPHAS}) WHERE alpha IS NOT NULL AND NOT isnan(alpha))", "alpha >= 0.7::DOUBLE"),
    "redteam": _share("redteam_catch", f"({_ATTACKS})", "coalesce(caught, catcher IS NOT NULL)"),
    "coverage": _share("coverage_fill", _cov(), "n >= 5"),
    "silent": _share("silent_share", "tasks", "tier IN ('T5', 'T6')"),
    "sme": _metric("sme_hours", f"(SELECT sme_minutes / 60 AS h FROM universe WHERE {_ACCEPTED} AND sme_minutes IS NOT NULL)", "avg(h)", "coalesce(sum(h), 0)", "count(*)", "<="),
}

QUERIES = {
    "a01_verdict_lattice": lambda s, d: M.combine(B.oracle_results(s, d)),
    "a02_bank_verdict": lambda s, d: M.bank_verdict(_universe(s, d)),
    "a03_verdict_counts": lambda s, d: M.verdict_counts(_universe(s, d)),
    "a04_headline": lambda s, d: M.headline(_universe(s, d)),
    "a05_gold_band": lambda s, d: M.gold_band(_calibrated(s, d)),
    "a06_alpha_share": lambda s, d: M.alpha_share(_alphas(s, d)),
    "a07_redteam_catch": lambda s, d: M.redteam_catch(_attacks(s, d)),
    "a08_coverage_fill": lambda s, d: M.coverage_fill(B.tasks(s, d)),
    "a09_silent_share": lambda s, d: M.silent_share(B.tasks(s, d)),
    "a10_sme_hours": lambda s, d: M.sme_hours(_universe(s, d)),
    "a07_redteam_payloads": lambda s, d: M.redteam_payloads(_payloads(s, d)).select("id", "n_caught", "n_attacks", F.array_join("uncaught", ",").alias("uncaught"), F.round("catch_rate", 9).alias("catch_rate")),
    "a10_provenance_hours": lambda s, d: _provenance(s, d).select("task_id", F.round(M.provenance_hours(F.col("provenance")), 9).alias("hours")),
    "a11_all_metrics": lambda s, d: M.all_metrics(B.tasks(s, d), _universe(s, d), _calibrated(s, d), _alphas(s, d), _attacks(s, d)),
    "a12_skip_breakdown": lambda s, d: M.skip_breakdown(B.oracle_results(s, d)),
    "a13_cell_counts": lambda s, d: M.cell_counts(B.tasks(s, d)),
    "a14_rollups": lambda s, d: M.rollups(B.tasks(s, d)),
    "a15_heatmap": lambda s, d: M.heatmap(B.tasks(s, d)),
    "a17_discard_reasons": lambda s, d: M.discard_reasons(B.oracle_results(s, d)),
    "p01_accepted": lambda s, d: _universe(s, d).where(M.accepted(F.col("verdict"), F.col("executed"))).select("task_id"),
    "p02_executed": lambda s, d: M.executed(B.oracle_results(s, d)),
    "p03_failures_skips": lambda s, d: M.failures_and_skips(B.oracle_results(s, d)),
    "p04_gold_rows": lambda s, d: _calibrated(s, d).where(F.col("pass_at_1").between(M.GOLD_LO, M.GOLD_HI)).select("task_id", F.round("pass_at_1", 9).alias("pass_at_1")),
    "p06_fill_class": lambda s, d: M.coverage(B.tasks(s, d), 60).select("cell", "n", M.fill_class(F.col("fill")).alias("fill_class")),
    "p09_gaps": lambda s, d: M.coverage(B.tasks(s, d), 60).where("shortfall > 0").select("cell", "shortfall"),
    "j01_task_verdict": lambda s, d: M.tasks_with_verdict(B.tasks(s, d), M.last_by_path(B.verdict_files(s, d))).select("task_id", "verdict", "executed"),
    "j02_universe": lambda s, d: _universe(s, d).select("task_id", "has_task", "verdict", "executed"),
    "j03_stray_verdicts": lambda s, d: M.stray_verdicts(B.tasks(s, d), M.last_by_path(B.verdict_files(s, d))).select("task_id", "verdict"),
    "j04_grid": lambda s, d: M.coverage(B.tasks(s, d)).select("cell", "n", "silent", F.round("fill", 9).alias("fill")),
    "w01_last_by_path": lambda s, d: M.last_by_path(B.verdict_files(s, d)),
    "t01_gaps_ranked": lambda s, d: M.gaps_ranked(B.tasks(s, d), 10, target=60).select("cell", "value_rank", "n", F.round("priority", 9).alias("priority")),
    "t02_grid_gaps": lambda s, d: M.grid_gaps(B.tasks(s, d), target=60),
    "t05_failing_alphas": lambda s, d: M.failing_alphas(_alphas(s, d)).select("criterion", F.round("alpha", 9).alias("alpha")),
    "t06_task_table": lambda s, d: M.task_table(_universe(s, d)),
    "t07_skip_rows": lambda s, d: M.skip_breakdown(B.oracle_results(s, d), ("SKIP",)).drop("first_tasks"),
    "u01_first_seen": lambda s, d: M.first_seen(B.tasks(s, d).withColumn("ord", F.col("task_id")), B.verdict_files(s, d).withColumn("ord", F.col("task_id")), "task_id").select("task_id", "part"),
}

_ORD = "CASE verdict WHEN 'ERROR' THEN 0 WHEN 'FAIL' THEN 1 WHEN 'SKIP' THEN 2 ELSE 3 END"
_NAME = "['ERROR', 'FAIL', 'SKIP', 'PASS']"
_SKIPS = """SELECT oracle, verdict, reason, count(*) AS n{0} FROM oracle_results WHERE verdict IN ({1}) GROUP BY oracle, verdict, reason"""

ORACLE_SQL = {
    "a01_verdict_lattice": B.sql("oracle_results", f"SELECT task_id, {_NAME}[min({_ORD}) + 1] AS verdict FROM oracle_results GROUP BY task_id"),
    "a02_bank_verdict": B.sql("universe", f"SELECT {_NAME}[min({_ORD.replace('CASE verdict', chr(67) + 'ASE coalesce(verdict, ' + repr('SKIP') + ')')}) + 1] AS verdict FROM universe"),
    "a03_verdict_counts": B.sql("universe", "SELECT b.verdict, count(u.task_id) AS n FROM (SELECT unnest(['PASS', 'FAIL', 'ERROR', 'SKIP', 'UNVERIFIED']) AS verdict) b LEFT JOIN universe u ON coalesce(u.verdict, 'UNVERIFIED') = b.verdict GROUP BY 1"),
    "a04_headline": B.sql("universe", _M["headline"]),
    "a05_gold_band": B.sql("attempts", _M["gold"]),
    "a06_alpha_share": _M["alpha"],
    "a07_redteam_catch": _M["redteam"],
    "a08_coverage_fill": B.sql("tasks", _M["coverage"]),
    "a09_silent_share": B.sql("tasks", _M["silent"]),
    "a10_sme_hours": B.sql("universe", _M["sme"]),
    "a07_redteam_payloads": """WITH each AS (SELECT s_suppkey AS k, i, coalesce(CASE WHEN s_suppkey % 3 = i THEN s_suppkey % 2 = 0 END, (s_suppkey + i) % 4 = 0) AS hit FROM supplier, (SELECT unnest(range(0, 3)) AS i)),
        listed AS (SELECT k, count(*) FILTER (hit) AS c, count(*) AS n, coalesce(string_agg('a' || i, ',' ORDER BY i) FILTER (NOT hit), '') AS open FROM each GROUP BY k),
        rows AS (SELECT k, CASE WHEN k % 5 < 2 THEN c WHEN k % 5 = 2 THEN k % 7 WHEN k % 5 = 3 THEN k % 2 ELSE 0 END AS c, CASE WHEN k % 5 < 2 THEN n WHEN k % 5 = 2 THEN k % 7 + k % 3 WHEN k % 5 = 3 THEN 4 ELSE 0 END AS n, CASE WHEN k % 5 < 2 THEN open WHEN k % 5 = 2 THEN 'u' || k ELSE '' END AS open FROM listed)
        SELECT k AS id, CAST(c AS BIGINT) AS n_caught, CAST(n AS BIGINT) AS n_attacks, open AS uncaught, CASE WHEN n > 0 THEN round(c / n, 9) END AS catch_rate FROM rows""",
    "a10_provenance_hours": "SELECT doc_id AS task_id, round(CASE doc_id % 9 WHEN 0 THEN n_chars * 1e0 WHEN 1 THEN n_chars / 60 WHEN 2 THEN n_chars / 3600 WHEN 3 THEN n_chars + 5e-1 WHEN 4 THEN n_chars / 60 WHEN 5 THEN 1e-2 END, 9) AS hours FROM documents",
    "a11_all_metrics": B.sql("universe attempts", " UNION ALL ".join(f"SELECT *, {k} AS ord FROM ({q})" for k, q in enumerate(_M.values(), 1))),
    "a12_skip_breakdown": B.sql("oracle_results", _SKIPS.format(", array_to_string(list_sort(list(task_id))[1:5], ',') AS first_tasks", "'SKIP', 'ERROR', 'FAIL'")),
    "a13_cell_counts": B.sql("tasks", "SELECT tier, domain, count(*) AS n FROM tasks GROUP BY tier, domain"),
    "a14_rollups": B.sql("tasks", "SELECT tier, domain, count(*) AS n FROM tasks GROUP BY GROUPING SETS ((tier, domain), (tier), (domain), ())"),
    "a15_heatmap": B.sql("tasks", "SELECT 'T' || k AS tier, " + ", ".join(f"count(domain) FILTER (domain = '{x}') AS {x}" for x in DOMAINS) + ", count(domain) AS total FROM (SELECT unnest(range(1, 7)) AS k) LEFT JOIN tasks ON tier = 'T' || k GROUP BY 1"),
    "a17_discard_reasons": B.sql("oracle_results", "SELECT split_part(reason, ':', 1) AS kind, count(*) AS n FROM oracle_results WHERE reason IS NOT NULL GROUP BY 1"),
    "p01_accepted": B.sql("universe", f"SELECT task_id FROM universe WHERE {_ACCEPTED}"),
    "p02_executed": B.sql("oracle_results", "SELECT task_id, bool_or(verdict IN ('PASS', 'FAIL')) AS executed FROM oracle_results GROUP BY task_id"),
    "p03_failures_skips": B.sql("oracle_results", "SELECT task_id, coalesce(string_agg(oracle, ',' ORDER BY ord) FILTER (verdict = 'FAIL'), '') AS failures, coalesce(string_agg(oracle, ',' ORDER BY ord) FILTER (verdict = 'SKIP'), '') AS skips FROM oracle_results GROUP BY task_id"),
    "p04_gold_rows": B.sql("attempts", f"SELECT task_id, round(pass_at_1, 9) AS pass_at_1 FROM ({_CALIBRATED}) WHERE pass_at_1 BETWEEN 0.1::DOUBLE AND 0.7::DOUBLE"),
    "p06_fill_class": B.sql("tasks", f"SELECT cell, n, CASE WHEN n = 0 THEN 'f0' WHEN n / 60e0 < 0.25 THEN 'f1' WHEN n / 60e0 < 0.5 THEN 'f2' WHEN n < 60 THEN 'f3' ELSE 'f4' END AS fill_class FROM {_cov()}"),
    "p09_gaps": B.sql("tasks", f"SELECT cell, 60 - n AS shortfall FROM {_cov()} WHERE n < 60"),
    "j01_task_verdict": B.sql("tasks verdicts", "SELECT t.task_id, coalesce(verdict, 'UNVERIFIED') AS verdict, executed FROM tasks t LEFT JOIN verdicts v ON t.task_id = v.task_id"),
    "j02_universe": B.sql("universe", "SELECT task_id, has_task, verdict, executed FROM universe"),
    "j03_stray_verdicts": B.sql("tasks verdicts", "SELECT task_id, verdict FROM verdicts WHERE task_id NOT IN (SELECT task_id FROM tasks)"),
    "j04_grid": B.sql("tasks", f"SELECT cell, n, silent, round(fill, 9) AS fill FROM {_cov()}"),
    "w01_last_by_path": B.sql("verdict_files", "SELECT * FROM verdict_files QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY path DESC) = 1"),
    "t01_gaps_ranked": B.sql("tasks", f"SELECT cell, value_rank, n, round(priority, 9) AS priority FROM {_cov(target=60)} WHERE shortfall > 0 ORDER BY priority DESC, value_rank DESC, cell LIMIT 10"),
    "t02_grid_gaps": B.sql("tasks", f"SELECT cell, shortfall FROM {_cov(target=60)} WHERE shortfall > 0"),
    "t05_failing_alphas": f"SELECT criterion, round(alpha, 9) AS alpha FROM ({_ALPHAS}) WHERE alpha < 0.7::DOUBLE AND NOT isnan(alpha) ORDER BY alpha, criterion LIMIT 4",
    "t06_task_table": B.sql("universe", "SELECT task_id, has_task, coalesce(verdict, 'UNVERIFIED') AS verdict, CAST(list_position(['ERROR', 'FAIL', 'SKIP', 'UNVERIFIED', 'PASS'], coalesce(verdict, 'UNVERIFIED')) AS INT) AS place FROM universe"),
    "t07_skip_rows": B.sql("oracle_results", _SKIPS.format("", "'SKIP'")),
    "u01_first_seen": B.sql("tasks verdict_files", "SELECT task_id, CAST(min(p) AS INT) AS part FROM (SELECT task_id, 0 AS p FROM tasks UNION ALL SELECT task_id, 1 FROM verdict_files) GROUP BY task_id"),
}
