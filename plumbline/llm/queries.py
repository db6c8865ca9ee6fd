"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, html_text, language_id, lattice_lm, licenses, line_dedup, mixing, multiset_hash, simhash, token_alignment, token_counts, vector_codes, vector_dedup
from plumbline.llm.shared import crc_fold, documents


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    return found.withColumn("families", F.array_join("families", ","))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(documents(spark, sf_dir))
    return cleaned.select("doc_id", F.col("_pl_lines").alias("n_lines"), F.col("_pl_removed").alias("n_removed"), "text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", F.col("_pl_copy").cast("long").alias("copy_no"), F.col("_pl_order").alias("shuffle_key"), "text")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edit_report(documents(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x["start"], F.lit("-"), x["end"])), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", F.col("longest").cast("long").alias("longest"), F.col("longest_start").cast("long").alias("longest_start"), spans.alias("spans"))


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(documents(spark, sf_dir), crc_fold(F.col("doc_id"), 7) == 2, group=F.col("lang"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(documents(spark, sf_dir), crc_fold(F.col("doc_id"), 4) == 2)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", lambda x: F.concat(x["lang"], F.lit(":"), x["start"], F.lit("-"), x["end"])), ",").alias("spans"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, books = vector_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.lower(F.array_join(F.transform("codes", lambda k: F.lpad(F.hex(k), 2, "0")), ""))
    return vector_codes.with_label_error(encoded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(documents(spark, sf_dir))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_html_text": op5_html_text,
    "op6_multiset_hash": op6_multiset_hash,
    "op7_decontaminate": op7_decontaminate,
    "op8_lattice_lm": op8_lattice_lm,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_alignment": op12_token_alignment,
    "op13_embedding_dedup": op13_embedding_dedup,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _codes_sql() -> str:
    """op11 in SQL: integers as doubles, which hold them exactly; one pair of tables for each round."""
    rounds = []
    for k in range(5):
        rounds.append(f"""
a{k} AS MATERIALIZED (SELECT vec_id, label, part, any_value(x) AS x, min(d) AS d, arg_min(entry, (d, entry)) AS entry
       FROM (SELECT vec_id, label, p.part, x, entry, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM p JOIN c{k} c ON p.part = c.part)
       GROUP BY vec_id, label, part)""")
        if k < 4:
            rounds.append(f"""
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.c, c.c) AS c FROM c{k} c LEFT JOIN (
         SELECT part, entry, list(floor(s / n) ORDER BY pos) AS c FROM (
           SELECT part, entry, pos, sum(v) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{k}) GROUP BY ALL)
         GROUP BY part, entry) n ON n.part = c.part AND n.entry = c.entry)""")
    return f"""
WITH v AS (SELECT vec_id, label, [floor(CAST(y AS DOUBLE) * 1024) for y in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([1 for y in embedding if y IS NULL OR NOT isfinite(y)]) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] AS x FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)),{",".join(rounds)},
r AS (SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id, label),
b AS (SELECT sha256(string_agg(array_to_string([CAST(y AS BIGINT) for y in c], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, b"""


_HEX = "CAST('0x' || substr(md5({0}), 1, {1}) AS BIGINT)"

ORACLE_SQL = {
    "op11_vector_codes": _codes_sql(),
    "op3_line_dedup": """
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
           FROM documents),
b AS (SELECT trim(line) AS ln, min({'d': doc_id, 'p': pos}) AS first_at FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 10),
m AS (SELECT l.doc_id, l.pos, l.line, b.ln IS NOT NULL AND NOT (l.doc_id = b.first_at.d AND l.pos = b.first_at.p) AS gone
      FROM l LEFT JOIN b ON trim(l.line) = b.ln)
SELECT d.doc_id, CAST(coalesce(count(m.pos) FILTER (trim(m.line) <> ''), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(count(m.pos) FILTER (m.gone), 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (NOT m.gone), '') END AS text
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id, d.text""",
    "op4_mixing": f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
p AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate)) + 31 AS BIGINT))) AS k FROM r)),
f AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM p),
d AS (SELECT doc_id, d.source, text, count(*) AS times FROM documents d JOIN f ON f.source = d.source
      WHERE f.f <= {_HEX.format("'20240601:' || doc_id", 13)} / 4503599627370496e0 GROUP BY ALL)
SELECT doc_id, source, copy_no, {_HEX.format("'20240602:' || doc_id || ':' || copy_no", 15)} AS shuffle_key, text
FROM (SELECT doc_id, source, text, unnest(range(1, times + 1)) AS copy_no FROM d)""",
    "op7_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item, i AS j, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bp),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bp.item, bp.j FROM dw JOIN bp ON dw.win = bp.win AND dw.n = bp.n),
hits AS (SELECT DISTINCT doc_id, i, n, item FROM met),
hit_words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits),
words AS (SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY doc_id),
spans AS (SELECT doc_id, string_agg((low - 1) || '-' || high, ',' ORDER BY low) AS spans
          FROM (SELECT doc_id, min(p) AS low, max(p) AS high FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit_words) GROUP BY doc_id, run) GROUP BY doc_id),
matches AS (SELECT doc_id, min(i) AS i, count(*) + max(n) - 1 AS length
            FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, n, i - j ORDER BY i) AS run FROM met) GROUP BY doc_id, item, n, i - j, run),
best AS (SELECT doc_id, max(length) AS longest, arg_min(i, (-length, i)) - 1 AS longest_start FROM matches GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(longest AS BIGINT) AS longest, CAST(longest_start AS BIGINT) AS longest_start, coalesce(spans, '') AS spans
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN best USING (doc_id)""",
}
