"""Registered queries of diffs, template attacks and seed descriptions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.operators import descriptions as D
from plumbline.operators import patches as P
from plumbline.operators import templates as T


def _edited(s, d):
    """(doc_id, old, new): documents, and a copy with lines dropped and lines marked."""
    t = B.table(s, d, "documents").select("doc_id", F.col("text").alias("old"))
    lines = F.split(F.regexp_replace("old", r"\n\z", ""), "\n")
    mark = F.transform(lines, lambda x, i: F.when((F.col("doc_id") + i) % 5 == 1, F.concat(x, F.lit(" ["), F.col("doc_id").cast("string"), F.lit("."), i.cast("string"), F.lit("]"))).when((F.col("doc_id") + i) % 7 != 3, x))
    kept = F.filter(mark, lambda x: x.isNotNull())
    return t.withColumn("new", F.when(F.size(kept) == 0, "").otherwise(F.concat(F.array_join(kept, "\n"), F.lit("\n"))))


def _patched(s, d):
    t = _edited(s, d).withColumn("hunks", P.hunks(F.col("old"), F.col("new")))
    t = t.withColumn("diff", P.as_text(F.col("hunks"), F.lit("old"), F.lit("new")))
    t = t.withColumn("got", P.apply_text(F.col("old"), F.col("diff")))
    count = lambda tag: F.size(F.filter(F.flatten(F.transform("hunks", lambda h: h["lines"])), lambda x: F.substring(x, 1, 1) == tag)).cast("long")
    return t.select("doc_id", count("-").alias("removed"), count("+").alias("added"), F.col("got.error").alias("error"), F.sha2(F.col("got.text").cast("binary"), 256).alias("text_sha256"))


def _leaks(s, d):
    first = F.substring_index("text", "\n", 1)
    t = B.table(s, d, "documents").select("doc_id", "text", F.concat(F.lit("changed"), F.expr("substr(text, length(substring_index(text, '\\n', 1)) + 1)")).alias("mutant"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("see\n  "), first)).otherwise("fix it").alias("prompt"))
    t = t.withColumn("hunks", P.hunks(F.col("mutant"), F.col("text")))
    return t.select("doc_id", F.array_join(P.leaked_parts(F.col("prompt"), F.col("mutant"), F.col("hunks")), "\n").alias("leaked"))


def _instantiated(s, d):
    """A bank of a template for each region, over all documents as baselines."""
    k, name = F.col("r_regionkey"), F.col("r_name")
    body = F.concat(F.lit("\n$$"), name, F.lit(" of ${entry}: $lang"), F.when(k == 3, F.lit(" $$${entry}x $5\n")).otherwise(""))
    rows = B.table(s, d, "region").select(name.alias("id"), F.lit("O3").alias("oracle"), F.lit("denylist").alias("check"), body.alias("template"), F.when(k % 2 == 0, F.array(F.lit("english"))).alias("requires"))
    t = B.table(s, d, "documents")
    entry = F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string"))
    baseline = F.concat(F.when(F.col("doc_id") % 11 == 2, "def g(): 0\n").otherwise(F.concat(F.lit("def "), entry, F.lit("(): 0\n"))), F.regexp_replace("text", "f[0-4]", "f"))
    got = T.instantiate(t, T.bank(rows), {"entry": entry, "lang": F.when(F.col("doc_id") % 13 != 4, F.col("lang"))}, {"english": F.col("lang") == "en"}, baseline, entry)
    return got.select("doc_id", "attack", "why_not", F.sha2(F.col("attack_text").cast("binary"), 256).alias("text_sha256"))


_IDS = ["attention.blocked_fwd", "matmul.tiled", "quant.int4_dequant_matmul", "reduction.blocked_layernorm", "dataloader.sharded_batch_stream", "collectives.ddp_train_step", "checkpointing.save_and_resume", "autotune.cached_gemm", "none.such"]
_DTYPES = ["float32", "bfloat16", "float16", "int8"]

# Dimensions of a shape, over p_partkey p and p_size z.
_DIMS = {
    "batch": "z % 4 + 1", "heads": "z % 3 + 1", "head_dim": "16 * (z % 5 + 1)", "q_len": "p % 1000", "n_ctx": "p % 777", "m": "p % 64 + 1, z", "n": "z + 1, p % 9 + 1", "k": "p % 33 + 1, z % 7 + 1",
    "k_valid": "p % 129", "k_pad": "p % 129 + z", "group_size": "32", "rows": "z", "n_valid": "p % 200", "n_pad": "256", "n_samples": "p % 5000", "world_size": "z % 8 + 1", "batch_size": "z % 5 + 1",
    "drop_last": "z % 2", "epochs": "z % 3 + 1", "shard_sizes": "z, z + 3, p % 11", "d": "z + 1", "h": "8",
}


def _shapes(s, d):
    """A shape for each part, one in thirteen without dimensions, one in nine of an unknown seed."""
    p = B.table(s, d, "part").selectExpr("p_partkey AS p", "CAST(p_size AS BIGINT) AS z")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("p") % n + 1).cast("int"))
    dims = F.create_map(*[x for name, e in _DIMS.items() for x in (F.lit(name), F.expr(f"CAST(array({e}) AS array<bigint>)"))])
    dtype = F.when(F.col("p") % 5 != 4, F.element_at(F.array(*map(F.lit, _DTYPES)), (F.col("z") % 4 + 1).cast("int")))
    return p.select("p", pick(_IDS, 9).alias("seed"), F.when(F.col("p") % 13 != 5, dims).otherwise(F.map_filter(dims, lambda k, v: F.lit(False))).alias("dims"), dtype.alias("dtype"))


def _compared(s, d):
    e = F.regexp_extract("name", r"\d+", 0).cast("long")
    cells = B.tensors(s, d).withColumn("seed", F.element_at(F.array(*map(F.lit, _IDS)), (e % 9 + 1).cast("int")))
    return D.builtin().compare(cells, F.lit(1e-3), F.lit(1e-6)).select("seed", "name", "n", "n_bad", "ok")


QUERIES = {
    "f30_patched": _patched,
    "p15_leaked_hunks": _leaks,
    "d06_instantiated": _instantiated,
    "f31_counters": lambda s, d: D.builtin().counters(_shapes(s, d)).select("p", "seed", "depth", "moved", "flops", "error"),
    "d02_compare": _compared,
}

_SPLIT = "string_split(regexp_replace(text, '\\n\\z', ''), chr(10))"
_ITEM = "CASE coalesce(dtype, 'float32') WHEN 'float32' THEN 4 WHEN 'bfloat16' THEN 2 WHEN 'float16' THEN 2 END"
_NO_DIMS = ["batch", "m", "m", "rows", "n_samples", "shard_sizes", "n", "m"]
_DEPTH = ["greatest(1, n_ctx)", "greatest(1, k_valid)", "greatest(1, k_valid)", "greatest(1, n_valid)", "1", "8 * (greatest(z, z + 3, p % 11) + 3 + d * k + 2)", "18 * (n + 1)", "greatest(k, k2)"]
_MOVED = [
    "item * batch * heads * head_dim * (2 * q_len + 2 * n_ctx)",
    "item * (m * k_valid + k_valid * n + m * n)",
    "item * (m * k_valid + m * n) + k_valid * n // 2 + 4 * (greatest(1, (k_pad + 31) // 32) * n + greatest(1, (k_pad + 31) // 32))",
    "item * (3 * rows * n_valid + rows * n_pad + 2 * n_valid)",
    "CASE WHEN drop_last = 1 THEN (n_samples // world_size) // batch_size * batch_size ELSE (n_samples + world_size - 1) // world_size END * world_size * epochs * 8 * 2",
    "8 * ((z + z + 3 + p % 11) * d + (z + z + 3 + p % 11) + 3 * d * k) * 4",
    "18 * (n * d + 7 * (d * h + h * k)) * 8 + 3 * (d * h + h * k) * 8 * 4",
    "(m * k + k * n + m2 * k2 + k2 * n2) * CASE WHEN coalesce(dtype, 'float32') = 'float32' THEN 4 ELSE 8 END + (m * n + m2 * n2) * 8",
]
_FLOPS = [
    "4 * batch * heads * q_len * n_ctx * head_dim", "2 * m * n * k_valid", "2 * m * n * k_valid + 2 * n * k_valid", "8 * rows * n_valid", "3 * n_samples * epochs",
    "8 * (4 * (z + z + 3 + p % 11) * d * k + 6 * (z + z + 3 + p % 11) * k)", "18 * (6 * n * d * h + 6 * n * h * k + 10 * (d * h + h * k))", "2 * m * n * k + 2 * m2 * n2 * k2",
]
_case = lambda branches: "CASE p % 9 " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(branches)) + " END"
_pair = lambda name: ", ".join(f"{e} AS {name}{'' if i == 0 else i + 1}" for i, e in enumerate(_DIMS[name].split(", ")))
_FIXED = {0: ("1e-3", "1e-6"), **{i: tuple(map(repr, D.FIXED_TOLERANCES[x])) for i, x in enumerate(_IDS) if x in D.FIXED_TOLERANCES}}
_tolerance = lambda k: "CASE CAST(substr(name, 2) AS BIGINT) % 9 " + " ".join(f"WHEN {i} THEN {float(t[k]):e}" for i, t in _FIXED.items()) + f" ELSE {float(_FIXED[0][k]):e} END"

ORACLE_SQL = {
    "f30_patched": f"""WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE {_SPLIT} END AS l, {_SPLIT} AS e FROM documents), i AS (SELECT doc_id, len(l) AS n, list_transform(range(1, len(e) + 1), lambda i: {{'x': e[i], 'i': i - 1}}) AS e FROM l),
        m AS (SELECT doc_id, n, list_transform(list_filter(e, lambda r: (doc_id + r.i) % 5 = 1 OR (doc_id + r.i) % 7 <> 3), lambda r: CASE WHEN (doc_id + r.i) % 5 = 1 THEN r.x || ' [' || doc_id || '.' || r.i || ']' ELSE r.x END) AS new,
        len(list_filter(e, lambda r: (doc_id + r.i) % 5 = 1)) AS added, len(list_filter(e, lambda r: (doc_id + r.i) % 5 <> 1 AND (doc_id + r.i) % 7 = 3)) AS dropped FROM i)
        SELECT doc_id, CASE WHEN n > 0 THEN added + dropped ELSE 0 END AS removed, CASE WHEN n > 0 OR len(new) = 0 THEN added ELSE 1 END AS added, CAST(NULL AS VARCHAR) AS error,
        sha256(array_to_string(list_transform(new, lambda x: x || chr(10)), '')) AS text_sha256 FROM m""",
    "p15_leaked_hunks": f"""SELECT doc_id, CASE WHEN text IS NOT NULL THEN CASE WHEN doc_id % 3 = 0 AND length(trim(l[1])) >= 8 AND l[1] <> 'changed' AND NOT list_contains(list_transform(l[2:], lambda x: trim(x)), trim(l[1])) THEN trim(l[1]) ELSE '' END END AS leaked
        FROM (SELECT *, {_SPLIT} AS l FROM documents)""",
    "d06_instantiated": """WITH t AS (SELECT d.*, r_name AS attack, r_regionkey AS k, 'f' || doc_id % 5 AS entry, CASE WHEN doc_id % 13 <> 4 THEN lang END AS said FROM documents d, region),
        b AS (SELECT *, CASE WHEN doc_id % 11 = 2 THEN 'def g(): 0' ELSE 'def ' || entry || '(): 0' END || chr(10) || regexp_replace(text, 'f[0-4]', 'f', 'g') AS base,
        '$' || attack || ' of ' || entry || ': ' || said || CASE WHEN k = 3 THEN ' $' || entry || 'x $5' ELSE '' END AS body FROM t),
        w AS (SELECT *, CASE WHEN k % 2 = 0 AND coalesce(lang, '') <> 'en' THEN 'not english' WHEN said IS NULL THEN 'no value for lang' WHEN base IS NULL THEN 'no baseline' WHEN NOT contains(base, entry) THEN 'the baseline has no ' || entry END AS why_not FROM b)
        SELECT doc_id, attack, why_not, CASE WHEN why_not IS NULL THEN sha256('# attack: ' || attack || chr(10) || '# ' || chr(10) || '# to be caught by: O3/denylist' || chr(10) || chr(10)
        || base || CASE WHEN base LIKE '%' || chr(10) THEN '' ELSE chr(10) END || chr(10) || '_HONEST = ' || entry || chr(10) || chr(10) || body || chr(10)) END AS text_sha256 FROM w""",
    "f31_counters": f"""WITH p AS (SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS z FROM part), v AS (SELECT p, z, CASE WHEN p % 5 <> 4 THEN ['float32', 'bfloat16', 'float16', 'int8'][z % 4 + 1] END AS dtype, {", ".join(_pair(n) for n in _DIMS)} FROM p),
        i AS (SELECT *, {_ITEM} AS item, {_IDS}[p % 9 + 1] AS seed FROM v), e AS (SELECT *, CASE WHEN p % 9 = 8 THEN 'unknown seed: none.such' WHEN p % 13 = 5 THEN 'no dimension ' || {_case([repr(x) for x in _NO_DIMS])} WHEN p % 9 < 4 AND item IS NULL THEN 'unknown dtype: ' || dtype END AS error FROM i)
        SELECT p, seed, error, {", ".join(f"CAST(CASE WHEN error IS NULL THEN {_case(c)} END AS BIGINT) AS {n}" for n, c in (("depth", _DEPTH), ("moved", _MOVED), ("flops", _FLOPS)))} FROM e""",
    "d02_compare": B.sql(
        "tensors",
        f"""SELECT {_IDS}[CAST(substr(name, 2) AS BIGINT) % 9 + 1] AS seed, name, count(*) AS n, count(*) FILTER (bad) AS n_bad, count(*) FILTER (bad) = 0 AS ok
        FROM (SELECT name, cand IS NULL OR isnan(cand) OR abs(cand - ref) > {_tolerance(1)} + {_tolerance(0)} * abs(ref) AS bad FROM tensors) GROUP BY name""",
    ),
}
