"""From raw documents to a training mix, in five stages.

Every stage reads what the one before has kept, as a table with the columns of
documents, and its decisions take effect. The operators are those of
plumbline.llm. Columns beyond those of documents are carried along, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import decontaminate as suffixes
from plumbline.llm import language_id, line_dedup, mixing, simhash
from plumbline.llm.shared import written

#: Least share of a text's letters in its main language.
MIN_SHARE = 0.4


#: What the stages look at; all else travels in one struct.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _packed(docs: DataFrame) -> DataFrame:
    """docs with all columns that no stage looks at in one struct, so that no name of theirs can clash."""
    rest = [c for c in docs.columns if c not in KNOWN]
    return docs.select(*[c for c in KNOWN if c in docs.columns], *([F.struct(*[f"`{c}`" for c in rest]).alias("rest")] if rest else []))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return packed.select(*[F.col(c) if c in KNOWN else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, or without a main language.

    Learns from all rows with a language. Null and empty texts have no letters
    and go; with no row to learn from, all go. Very long texts are read whole.
    Kept rows, repeated ones too, are unchanged.
    """
    rows = _packed(docs)
    labelled = language_id.label(rows, language_id.fit(rows))
    return _unpacked(labelled.where((F.col("_pl_lang") != language_id.UNKNOWN) & (F.col("_pl_score") >= MIN_SHARE)), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out of the texts; n_chars follows.

    A document of which nothing is left goes: each of its lines stands elsewhere,
    at its first place. Documents that lose no line are unchanged, null and empty
    ones too; a null source is one more source.
    """
    cleaned = line_dedup.remove_boilerplate(_packed(docs)).where((F.col("_pl_removed") == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col("_pl_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _unpacked(cleaned.withColumn("n_chars", n_chars), docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of every group of near duplicates.

    Near duplicates share 0.8 or more of their five-word shingles. Null, empty
    and wordless texts are one group. Of rows with one doc_id the first by text
    stays. Rows without a doc_id are in no group and stay.
    """
    rows = _packed(docs)
    found = simhash.similar_documents(rows.where(F.col("doc_id").isNotNull()))
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    first = rows.join(kept, "doc_id", "left_semi").withColumn("_pl_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return _unpacked(first.where("_pl_nth = 1"), docs).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a ten-word window of a benchmark item (or with all words of a shorter one).

    Null, empty and wordless texts have no window and stay; very long ones are
    read whole; repeated rows are judged alike.
    """
    return suffixes.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: documents by source weight, repeated and shuffled, with copy_no and shuffle_key.

    Older columns of those two names are replaced. A null source is a source of
    its own, null and empty texts are drawn like any other, repeated rows alike.
    """
    docs = docs.drop("copy_no", "shuffle_key")
    mixed = mixing.mix(_packed(docs))
    own = [F.col(c) if c in KNOWN else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return mixed.select(*own, F.col("_pl_copy").cast("long").alias("copy_no"), F.col("_pl_order").alias("shuffle_key"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
]

#: SimHash fingerprints are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the table documents of sf_dir.

    What a stage kept is written to the shared folder before the next one reads
    it, so that no stage is computed again for the jobs of those behind it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
