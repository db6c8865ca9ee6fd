"""Helpers that several of the corpus operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A_TO_Z, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    A local master without that setting, as in tests, gets a temporary folder; a
    cluster without it is an error, since a folder of one machine would be lost with it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="plumbline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df written to the reliable checkpoint folder: computed once, and safe when executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and read by column from then on.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain(docs: DataFrame) -> DataFrame:
    """docs without the columns whose names begin with _pl_: those names are the operators' own."""
    return docs.drop(*[c for c in docs.columns if c.startswith("_pl_")])


def broadcast_if(small: DataFrame, max_rows: int) -> DataFrame:
    """small with a broadcast hint if it is proven to have at most max_rows rows.

    small must be cheap to read again (cut() or a written table). Beyond the
    bound it comes back unchanged, and the join is a shuffled one.
    """
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_fold(doc_id, modulus: int):
    """crc32 of doc_id as text, modulo modulus."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
