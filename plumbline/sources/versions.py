"""Sinks that are replaced as a whole: a new version is written beside the old one, and a pointer is moved to it.

A version is a folder that Spark's own committer fills, so that lost executors and second tries of tasks leave no half or double rows. The
pointer is a small file, moved over the old one in one step once the version is complete. A write that fails leaves the pointer, and what it
points to, as they were; readers that began with the old version may finish, since it stays for KEEP versions.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.records import upsert, with_calibration

POINTER, KEEP = "_CURRENT", 2


class ChangedMeanwhile(RuntimeError):
    """Another writer has moved the pointer since the version that was read."""


def _store(spark: SparkSession, path: str):
    """(Hadoop's file system of path, its class of paths)."""
    places = spark._jvm.org.apache.hadoop.fs.Path
    return places(path).getFileSystem(spark._jsc.hadoopConfiguration()), places


def versions(spark: SparkSession, path: str) -> list[dict]:
    """The versions that the pointer names, the current one last; none where nothing was published."""
    store, places = _store(spark, path)
    at = places(f"{path}/{POINTER}")
    if not store.exists(at):
        return []
    stream = store.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _moved(spark: SparkSession, path: str, before: list[dict], new: dict) -> None:
    """Points to new, if the pointer is still what it was."""
    store, places = _store(spark, path)
    if versions(spark, path) != before:
        raise ChangedMeanwhile(path)
    draft, at = places(f"{path}/.{uuid.uuid4().hex}"), places(f"{path}/{POINTER}")
    out = store.create(draft)
    out.write(bytearray(json.dumps([*before, new][-KEEP:]).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, at, overwrite)
    for old in [*before, new][:-KEEP]:
        store.delete(places(f"{path}/{old['folder']}"), True)


def publish(table: DataFrame, path: str, format: str = "parquet", before: list[dict] | None = None, number: int | None = None) -> dict:
    """Writes table as the new version of path, numbered one on unless it has a number of its own.

    before: the versions that it was made from; if others are there now, ChangedMeanwhile.
    """
    spark = table.sparkSession
    before = versions(spark, path) if before is None else before
    number = (before[-1]["number"] + 1 if before else 0) if number is None else number
    new = {"folder": f"version-{number}-{uuid.uuid4().hex[:8]}", "number": number, "format": format, "schema": table.schema.json()}
    try:
        table.write.format(format).mode("errorifexists").save(f"{path}/{new['folder']}")
        _moved(spark, path, before, new)
    except BaseException:
        store, places = _store(spark, path)
        store.delete(places(f"{path}/{new['folder']}"), True)
        raise
    return new


def current(spark: SparkSession, path: str) -> DataFrame:
    """The published table; an error where there is none."""
    from pyspark.sql.types import StructType

    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"nothing was published at {path}")
    last = known[-1]
    return spark.read.schema(StructType.fromJson(json.loads(last["schema"]))).format(last["format"]).load(f"{path}/{last['folder']}")


def upsert_into(path: str, new: DataFrame, key: str = "id") -> dict:
    """Publishes the table with the rows of new, which replace those of the same key; a second try changes nothing more."""
    spark = new.sparkSession
    before = versions(spark, path)
    return publish(upsert(current(spark, path), new, key) if before else new, path, before[-1]["format"] if before else "parquet", before)


def write_back_calibration(path: str, calibrated: DataFrame) -> dict:
    """Publishes the tasks with the calibration of calibrated(task_id, calibration) where there is one."""
    spark = calibrated.sparkSession
    before = versions(spark, path)
    return publish(with_calibration(current(spark, path), calibrated), path, before[-1]["format"], before)


def write_metrics(metrics: dict[str, DataFrame], path: str) -> dict:
    """Publishes metric tables as one version of JSON lines: (metric, row), each row as a JSON object."""
    from pyspark.sql import functions as F

    rows = None
    for name, table in metrics.items():
        own = table.select(F.lit(name).alias("metric"), F.to_json(F.struct(*table.columns)).alias("row"))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise ValueError("there are no metrics to write")
    return publish(rows, path, "json")
