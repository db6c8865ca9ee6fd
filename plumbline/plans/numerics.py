"""Registered queries of resampling and tensor comparison, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.functions.hashing import unit_sql
from plumbline.operators import resampling as S
from plumbline.operators import tensors as T

_R = lambda df, *names, to=9: df.withColumns({n: F.round(n, to) for n in names})


def _ratios(s, d):
    return S.ratio_ci(B.timings(s, d))


def _work(s, d):
    return s.createDataFrame([(f"s{k}", 1000 * (k + 1), 20000.0 if k != 3 else None) for k in range(6)], "shape string, bytes long, bandwidth double")


def _medians(s, d):
    return B.timings(s, d).where("side = 'candidate'").groupBy("shape").agg(F.percentile("seconds", F.lit(0.5)).alias("median"))


def _dtypes(s, d):
    p = B.table(s, d, "part")
    names = ["float32", "torch.float16", "bf16", "FP64", "tf32", "half", "float8"]
    scale = F.when(F.col("p_partkey") % 9 == 0, F.lit(None)).when(F.col("p_partkey") % 9 == 1, 0.0).otherwise(F.col("p_retailprice"))
    return p.select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 7 + 1).cast("int")).alias("dtype"), (F.col("p_size") - 1).alias("depth"), scale.alias("scale"))


def _shapes(s, d, verdicts=True):
    o = B.oracle_results(s, d)
    return o.select("task_id", "ord", F.col("oracle").alias("name"), F.when(F.col("verdict") == "ERROR", "SKIP").otherwise(F.col("verdict")).alias("verdict"))


def _list(s, d, where, ord):
    return B.table(s, d, "part").where(where).select(F.col("p_partkey").alias("ord"), F.concat_ws("x", F.col("p_size").cast("string"), F.col("p_brand")).alias("key"), F.concat(F.lit(ord), F.col("p_partkey").cast("string")).alias("name"))


def _outputs(s, d):
    return B.tensors(s, d).select(F.col("name").alias("shape"), (F.col("idx") % 2).alias("seed"), F.round(F.abs("ref"), 1).cast("string").alias("digest"))


QUERIES = {
    "e15_bootstrap_alpha": lambda s, d: _R(S.bootstrap_alpha(B.ratings(s, d)), "low", "high", to=6),
    "e15_bootstrap_alpha_nominal": lambda s, d: _R(S.bootstrap_alpha(B.ratings(s, d), "nominal"), "low", "high", to=6),
    "e15_resampled_draws": lambda s, d: S.resample_sums(B.ratings(s, d)).where("a is null").select("criterion", F.posexplode("sums").alias("replicate", "n")).select("criterion", F.col("replicate").cast("long").alias("replicate"), F.col("n").cast("long").alias("n")),
    **{f"e15_resampled_alpha_{m}": (lambda m: lambda s, d: _R(S.resample_alpha(B.ratings(s, d), m), "low", "high", to=6))(m) for m in ("ordinal", "ratio")},
    "e20_median_ci": lambda s, d: _R(S.median_ci(B.timings(s, d)), "median", "low", "high"),
    "e21_ratio_ci": lambda s, d: _R(_ratios(s, d), "ratio", "low", "high"),
    "e22_widen": lambda s, d: _R(S.widen(_ratios(s, d)), "ratio", "low", "high", "raw_low", "raw_high", to=7).drop("dropped"),
    "e23_classify": lambda s, d: _ratios(s, d).select("shape", S.classify(F.col("low"), F.col("high")).alias("class")),
    "e24_speedup_gate": lambda s, d: _ratios(s, d).select("shape", S.speedup_gate(F.col("low"), F.col("high"), F.when(F.col("shape") != "s5", 1.2)).alias("verdict")),
    "e25_performance_witness": lambda s, d: S.performance_witness(_ratios(s, d)).select("shape", F.round("low", 7).alias("low")),
    "e26_timing_floor": lambda s, d: _R(S.timing_violations(_medians(s, d), _work(s, d)), "median", "floor").drop("bandwidth", "bytes"),
    "f32_roofline": lambda s, d: _R(S.roofline(_medians(s, d), _work(s, d)), "achieved", "fraction", to=4),
    "f12_f14_tolerance": lambda s, d: T.tolerances(_dtypes(s, d)).select("id", F.round(F.log2("rel"), 6).alias("log2_rel"), F.round("abs", 6).alias("abs"), "usable_scale", "formula"),
    "f13_growth_linear": lambda s, d: T.tolerances(_dtypes(s, d), "linear").select("id", F.round(F.log2("rel"), 6).alias("log2_rel"), "formula"),
    "f15_fixed_tolerance": lambda s, d: T.fixed_tolerance(B.table(s, d, "part").select("p_partkey"), 2e-4, 1e-6),
    "a22_n09_compare": lambda s, d: _R(T.compare(B.tensors(s, d), F.lit(2.0**-12), F.lit(1e-5)), "max_abs", "max_rel").withColumn("first_bad", F.coalesce("first_bad", F.lit(-1))),
    "n10_compare_fixed": lambda s, d: T.compare(B.tensors(s, d), F.lit(2e-5), F.lit(0.0)).select("name", "n_bad", "ok"),
    "n10_compare_exact": lambda s, d: T.compare(B.tensors(s, d), F.lit(0.0), F.lit(0.0)).select("name", "n_bad", "first_bad"),
    "a23_magnitude": lambda s, d: _R(T.magnitudes(B.tensors(s, d)), "magnitude"),
    "a24_oracle_verdict": lambda s, d: T.oracle_verdict(_shapes(s, d)),
    "j11_aligned": lambda s, d: T.shape_mismatches(T.aligned(B.tensors(s, d).select("name", "idx", F.col("ref").alias("value")), B.tensors(s, d).where("cand is not null").select("name", "idx", F.col("cand").alias("value")))),
    "j15_first_of_each": lambda s, d: T.first_of_each(_list(s, d, "p_size <= 20", "a"), _list(s, d, "p_size > 10", "b"), _list(s, d, "true", "c")),
    "n11_insensitive": lambda s, d: T.insensitive(B.tensors(s, d).select("name", "idx", F.round("ref", 2).alias("value")), B.tensors(s, d).select("name", "idx", F.round(F.when((F.col("idx") == 5) & F.col("name").endswith("7"), F.col("ref") + 1).otherwise(F.col("ref")), 2).alias("value"))),
    "n12_discriminating": lambda s, d: T.discriminating(_outputs(s, d)),
    "a28_combined_checksum": lambda s, d: T.combined_checksum(B.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").cast("string").alias("part"), F.md5(F.col("o_orderpriority").cast("binary")).alias("hash"))),
}


def _hashed(*tags):
    return unit_sql(repr("b"), "b", "shape", "side", *tags)


_BOOT = f"""n AS (SELECT shape, side, count(*) AS n FROM timings GROUP BY 1, 2),
tries AS (SELECT shape, side, n, b, tag, i, CASE tag WHEN 'g' THEN (n + 1) // 2 ELSE n // 2 + 1 END - 1e0 / 3e0 AS d FROM n, (SELECT unnest(range(0, {S.REPLICATES})) AS b), (SELECT unnest(['g', 'h']) AS tag), (SELECT unnest(range(0, {S.TRIES})) AS i)),
proposed AS (SELECT *, sqrt(-2e0 * ln(1e0 - {_hashed('tag', repr('r'), 'i')})) * cos(2e0 * pi() * {_hashed('tag', repr('p'), 'i')}) AS x, ln(1e0 - {_hashed('tag', repr('u'), 'i')}) AS u FROM tries),
cubed AS (SELECT *, pow(1e0 + x / sqrt(9e0 * d), 3e0) AS v FROM proposed),
gammas AS (SELECT shape, side, n, b, tag, coalesce(arg_min(d * v, i) FILTER (v > 0 AND u < x * x / 2e0 + d - d * v + d * ln(CASE WHEN v > 0 THEN v ELSE 1e0 END)), any_value(d)) AS g FROM cubed GROUP BY 1, 2, 3, 4, 5),
middle AS (SELECT shape, side, n, b, max(g) FILTER (tag = 'g') / (max(g) FILTER (tag = 'g') + max(g) FILTER (tag = 'h')) AS u FROM gammas GROUP BY 1, 2, 3, 4),
ranks AS (SELECT *, least(n, CAST(floor(n * u) AS BIGINT) + 1) AS r1, CASE WHEN n % 2 = 1 THEN least(n, CAST(floor(n * u) AS BIGINT) + 1) ELSE least(n, CAST(floor(n * (u + (1e0 - u) * (1e0 - pow(1e0 - {_hashed(repr('next'))}, 2e0 / n)))) AS BIGINT) + 1) END AS r2 FROM middle),
sorted AS (SELECT shape, side, seconds, row_number() OVER (PARTITION BY shape, side ORDER BY seconds) AS r FROM timings),
med AS (SELECT ranks.shape, ranks.side, b, (x.seconds + y.seconds) / 2e0 AS median FROM ranks JOIN sorted x ON ranks.shape = x.shape AND ranks.side = x.side AND r1 = x.r JOIN sorted y ON ranks.shape = y.shape AND ranks.side = y.side AND r2 = y.r),
point AS (SELECT shape, side, count(*) AS n, quantile_cont(seconds, 5e-1) AS median FROM timings GROUP BY 1, 2)"""
_LOW, _HIGH = "25e-3", repr(1 - (1 - 0.95) / 2) + "::DOUBLE"
_RATIO = f"""{_BOOT}, rep AS (SELECT a.shape, CASE WHEN b.median > 0 THEN a.median / b.median END AS r, b.median <= 0 AS gone FROM med a JOIN med b ON a.shape = b.shape AND a.b = b.b AND a.side = 'baseline' AND b.side = 'candidate'),
ci AS (SELECT rep.shape, any_value(pa.median / pb.median) AS ratio, quantile_cont(r, (1 - 95e-2) / 2) AS low, quantile_cont(r, 1 - (1 - 95e-2) / 2) AS high, count(*) FILTER (gone) AS dropped FROM rep
 JOIN point pa ON pa.shape = rep.shape AND pa.side = 'baseline' JOIN point pb ON pb.shape = rep.shape AND pb.side = 'candidate' GROUP BY 1)"""
_WORK = "(SELECT 's' || k AS shape, 1000 * (k + 1) AS bytes, CASE WHEN k <> 3 THEN 20000e0 END AS bandwidth FROM (SELECT unnest(range(0, 6)) AS k))"
_MED = "(SELECT shape, quantile_cont(seconds, 5e-1) AS median FROM timings WHERE side = 'candidate' GROUP BY 1)"
_EPS = "pow(2e0, -CAST([24, 11, 8, 53, 11, 11, 4][p_partkey % 7 + 1] AS DOUBLE))"
_NAME = "['fp32', 'fp16', 'bf16', 'fp64', 'tf32', 'fp16', 'fp8'][p_partkey % 7 + 1]"
_MISS = "(ref IS NULL OR cand IS NULL)"
_FIN = "(isfinite(ref) AND isfinite(cand))"
_ODD = f"(NOT {_MISS} AND NOT {_FIN} AND NOT ((isnan(ref) AND isnan(cand)) OR (NOT isnan(ref) AND NOT isnan(cand) AND ref = cand)))"


def _bad(rel, absolute):
    return f"({_MISS} OR {_ODD} OR ({_FIN} AND abs(cand - ref) > {absolute} + {rel} * abs(ref)))"


_UNITS = f"""cells AS (SELECT criterion, unit, value, count(*) AS k, sum(count(*)) OVER (PARTITION BY criterion, unit) AS m FROM ratings WHERE value IS NOT NULL GROUP BY criterion, unit, value QUALIFY sum(count(*)) OVER (PARTITION BY criterion, unit) >= 2),
drawn AS (SELECT criterion, unit, b, {unit_sql(repr('a'), 'b', 'unit', 'criterion')} AS u FROM (SELECT DISTINCT criterion, unit FROM cells), (SELECT unnest(range(0, {S.ALPHA_REPLICATES})) AS b)),
w AS (SELECT criterion, unit, b, {' + '.join(f'CASE WHEN u >= {c!r}e0 THEN 1 ELSE 0 END' for c in S.POISSON_ONE)} AS w FROM drawn),
mg AS (SELECT w.criterion, b, value, CAST(sum(w * k) AS DOUBLE) AS n FROM w JOIN cells ON w.criterion = cells.criterion AND w.unit = cells.unit GROUP BY ALL)"""


def _alpha_boot(d2):
    return B.sql("ratings", f"""WITH {_UNITS},
 e AS (SELECT x.criterion, x.b, sum(x.n * y.n * {d2}) AS e FROM mg x JOIN mg y ON x.criterion = y.criterion AND x.b = y.b GROUP BY 1, 2),
 t AS (SELECT criterion, b, sum(n) AS n FROM mg GROUP BY 1, 2),
 own AS (SELECT x.criterion, x.unit, sum(x.k * y.k * {d2} / (x.m - 1)) AS o FROM cells x JOIN cells y ON x.criterion = y.criterion AND x.unit = y.unit GROUP BY 1, 2),
 o AS (SELECT w.criterion, w.b, sum(w * o) AS o FROM w JOIN own ON w.criterion = own.criterion AND w.unit = own.unit GROUP BY 1, 2),
 a AS (SELECT e.criterion, CASE WHEN e > 1e-9 THEN 1 - o / n / (e / (n * (n - 1))) END AS alpha FROM e JOIN t ON e.criterion = t.criterion AND e.b = t.b JOIN o ON e.criterion = o.criterion AND e.b = o.b)
 SELECT criterion, round(quantile_cont(alpha, (1 - 95e-2) / 2), 6) AS low, round(quantile_cont(alpha, 1 - (1 - 95e-2) / 2), 6) AS high, count(alpha) AS n_defined, count(*) FILTER (alpha IS NULL) AS n_undefined FROM a GROUP BY 1""")


ORACLE_SQL = {
    "e15_resampled_draws": B.sql("ratings", """SELECT criterion, replicate, count(*) AS n FROM (SELECT criterion, unit FROM ratings WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2), (SELECT unnest(range(0, 400)) AS replicate) GROUP BY 1, 2"""),
    "e15_bootstrap_alpha": _alpha_boot("pow(x.value - y.value, 2)"),
    "e15_bootstrap_alpha_nominal": _alpha_boot("CASE WHEN x.value = y.value THEN 0e0 ELSE 1e0 END"),
    "e20_median_ci": B.sql("timings", f"WITH {_BOOT} SELECT shape, side, any_value(n) AS n, round(any_value(p), 9) AS median, round(quantile_cont(median, (1 - 95e-2) / 2), 9) AS low, round(quantile_cont(median, 1 - (1 - 95e-2) / 2), 9) AS high FROM (SELECT med.*, point.n, point.median AS p FROM med JOIN point ON med.shape = point.shape AND med.side = point.side) GROUP BY 1, 2"),
    "e21_ratio_ci": B.sql("timings", f"WITH {_RATIO} SELECT shape, round(ratio, 9) AS ratio, round(low, 9) AS low, round(high, 9) AS high, dropped FROM ci"),
    "e22_widen": B.sql("timings", f"WITH {_RATIO} SELECT shape, round(ratio, 7) AS ratio, round(low, 7) AS raw_low, round(high, 7) AS raw_high, round(ratio * pow(low / ratio, 2), 7) AS low, round(ratio * pow(high / ratio, 2), 7) AS high FROM ci"),
    "e23_classify": B.sql("timings", f"WITH {_RATIO} SELECT shape, CASE WHEN low > 1 THEN 'faster' WHEN high < 1 THEN 'slower' ELSE 'inconclusive' END AS class FROM ci"),
    "e24_speedup_gate": B.sql("timings", f"WITH {_RATIO} SELECT shape, CASE WHEN shape = 's5' THEN 'SKIP' WHEN high < 12e-1 THEN 'FAIL' WHEN low < 12e-1 THEN 'SKIP' ELSE 'PASS' END AS verdict FROM ci"),
    "e25_performance_witness": B.sql("timings", f"WITH {_RATIO} SELECT shape, round(ratio * pow(low / ratio, 15e-1), 7) AS low FROM ci WHERE ratio * pow(low / ratio, 15e-1) >= 115e-2"),
    "e26_timing_floor": B.sql("timings", f"SELECT shape, round(median, 9) AS median, round(bytes / bandwidth, 9) AS floor FROM {_MED} JOIN {_WORK} USING (shape) WHERE median < bytes / bandwidth"),
    "f32_roofline": B.sql("timings", f"SELECT shape, round(bytes / median, 4) AS achieved, round(bytes / median / bandwidth, 4) AS fraction, CASE WHEN bandwidth IS NULL THEN 'no bandwidth known' END AS reason FROM {_MED} LEFT JOIN {_WORK} USING (shape)"),
    "f12_f14_tolerance": f"SELECT p_partkey AS id, round(log2(rel), 6) AS log2_rel, round(rel * CASE WHEN ok THEN p_retailprice ELSE 1e0 END, 6) AS abs, ok AS usable_scale, '4 * sqrt(' || greatest(p_size - 1, 1) || ') * eps(' || {_NAME} || ')' AS formula FROM (SELECT *, 4 * sqrt(greatest(p_size - 1, 1)) * {_EPS} AS rel, p_partkey % 9 NOT IN (0, 1) AND p_retailprice > 0 AS ok FROM part)",
    "f13_growth_linear": f"SELECT p_partkey AS id, round(log2(4 * greatest(p_size - 1, 1) * {_EPS}), 6) AS log2_rel, '4 * lin(' || greatest(p_size - 1, 1) || ') * eps(' || {_NAME} || ')' AS formula FROM part",
    "f15_fixed_tolerance": "SELECT p_partkey, 2e-4 AS rel, 1e-6 AS abs, false AS derived FROM part",
    "a22_n09_compare": B.sql("tensors", f"SELECT name, count(*) AS n, round(coalesce(max(abs(cand - ref)) FILTER ({_FIN}), 0e0), 9) AS max_abs, round(max(abs(cand - ref) / abs(ref)) FILTER ({_FIN} AND ref <> 0), 9) AS max_rel, count(*) FILTER ({_bad('pow(2e0, -12)', '1e-5')}) AS n_bad, coalesce(min(idx) FILTER ({_bad('pow(2e0, -12)', '1e-5')}), -1) AS first_bad, count(*) FILTER ({_ODD}) AS n_nonfinite, count(*) FILTER ({_FIN} AND ref = 0) AS n_zero_ref, count(*) FILTER ({_bad('pow(2e0, -12)', '1e-5')}) = 0 AS ok FROM tensors GROUP BY 1"),
    "n10_compare_fixed": B.sql("tensors", f"SELECT name, count(*) FILTER ({_bad('2e-5', '0e0')}) AS n_bad, count(*) FILTER ({_bad('2e-5', '0e0')}) = 0 AS ok FROM tensors GROUP BY 1"),
    "n10_compare_exact": B.sql("tensors", f"SELECT name, count(*) FILTER ({_bad('0e0', '0e0')}) AS n_bad, min(idx) FILTER ({_bad('0e0', '0e0')}) AS first_bad FROM tensors GROUP BY 1"),
    "a23_magnitude": B.sql("tensors", "SELECT name, round(coalesce(max(abs(ref)) FILTER (isfinite(ref)), 0e0), 9) AS magnitude FROM tensors GROUP BY 1"),
    "a24_oracle_verdict": B.sql("oracle_results", "SELECT task_id, CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict IN ('SKIP', 'ERROR')) THEN 'SKIP' ELSE 'PASS' END AS verdict, arg_min(oracle, ord) FILTER (verdict = 'FAIL') AS first_break FROM oracle_results GROUP BY 1"),
    "j11_aligned": B.sql("tensors", "SELECT name, count(*) AS n_missing FROM tensors WHERE cand IS NULL GROUP BY 1"),
    "j15_first_of_each": "SELECT key, name, part FROM (SELECT p_size || 'x' || p_brand AS key, c || p_partkey AS name, CAST(ascii(c) - 97 AS INT) AS part, p_partkey FROM part, (SELECT unnest(['a', 'b', 'c']) AS c) WHERE c = 'c' OR (c = 'a' AND p_size <= 20) OR (c = 'b' AND p_size > 10)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY part, p_partkey) = 1",
    "n11_insensitive": B.sql("tensors", "SELECT DISTINCT name FROM tensors WHERE NOT ends_with(name, '7')"),
    "n12_discriminating": B.sql("tensors", "SELECT name AS shape, count(DISTINCT round(abs(ref), 1)) AS n FROM tensors GROUP BY 1 HAVING count(DISTINCT round(abs(ref), 1)) > 1"),
    "a28_combined_checksum": "SELECT CAST(o_custkey AS VARCHAR) AS name, sha256(string_agg(o_orderkey || '=' || md5(o_orderpriority), ';' ORDER BY o_orderkey || '=' || md5(o_orderpriority))) AS checksum FROM orders GROUP BY o_custkey",
}
