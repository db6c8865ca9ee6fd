"""Task, verdict, rating, profile and array files as DataFrames, and the way back.

Readers take a path or a folder, looked through to the bottom; files whose name
starts with a dot or an underscore are skipped, as everywhere in Spark. A file
that can't be read as what it should be is a row with an error, never dropped:
`good` and `bad` part the two. Only files of no bytes are unseen: Spark's file
listing leaves them out. (An empty text given to a decoder is an error.) Each decode_* works on (path, text) rows of any
origin, so files and tables of texts go the same way.
"""

from __future__ import annotations

import csv
import io
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.taxonomy import DOMAINS

#: The states of a verdict, and what a CSV cell says when there is no rating.
VERDICTS = ("PASS", "FAIL", "SKIP", "ERROR")
MISSING = ("", "NA", "NAN", "NONE", "-")
#: Characters of which every number consists that a cast can read, hexadecimal, infinite and padded ones too.
NUMERIC = r"^[\x00-\x20-+.0-9a-fA-FxXpPnNiItTyY]+$"
#: Array values in one row; longer arrays are many rows.
CHUNK = 65_536
#: Characters of parsed files that a Python worker holds at a time, beyond one file.
HELD = 1 << 22

_SHAPES = "array<struct<name string, kwargs string>>"
TASK = f"""task_id string, schema_version string, created_utc string, seed_source struct<seed_id string, module string, entry string, content_sha256 string>,
domain string, failure_tier string, mutation struct<cls string, site string, params string, description string>,
baseline_code string, mutant_code string, ground_truth_diff string, prompt string,
witness struct<shape struct<name string, kwargs string>, max_abs_err double, max_rel_err double, tolerance double, baseline_checksum string, mutant_checksum string, kind string, detail string>,
detect_shapes {_SHAPES}, decoy_shapes {_SHAPES}, oracles array<string>,
rubric struct<criteria array<struct<id string, weight double, anchors map<string, string>, auto_probe string, probe_thresholds array<array<double>>, machine_probed boolean>>, version string>,
calibration struct<model string, k long, n_samples long, n_correct long, pass_at_1 double, pass_at_k double, route string, rationale string, trace_stats string>, provenance string"""
VERDICT = """task_id string, verdict string, executed boolean,
oracle_results array<struct<oracle string, verdict string, reason string, evidence string, duration_s double, capabilities_used array<string>>>,
environment struct<caps string, python string, torch string, host string, utc string>, duration_s double, candidate_sha256 string"""
_TASK_NEEDS = ("task_id", "created_utc", "seed_source", "domain", "failure_tier", "mutation", "baseline_code", "mutant_code", "ground_truth_diff")


def texts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, text): whole files below path whose names match."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _first_error(*checks: tuple[Column, Column | str]) -> Column:
    said = [F.when(wrong, F.lit(why) if isinstance(why, str) else why) for wrong, why in checks]
    return F.coalesce(*said)


def _decoded(bodies: DataFrame, schema: str, needs: tuple[str, ...], *checks: tuple[Column, Column | str]) -> DataFrame:
    """(path, error, fields of schema) of (path, body, said): body is JSON, said an error known before."""
    names = StructType.fromDDL(schema).names
    parsed = bodies.withColumn("r", F.from_json("body", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})).withColumn("keys", F.json_object_keys("body"))
    extra = F.array_except("keys", F.array(*map(F.lit, names)))
    lacking = F.filter(F.array(*[F.when(F.col(f"r.{n}").isNull(), F.lit(n)) for n in needs]), lambda n: n.isNotNull())
    error = _first_error(
        (F.col("said").isNotNull(), F.col("said")),
        (F.col("keys").isNull(), "not a mapping"),
        (F.col("r._corrupt").isNotNull(), "a value is of the wrong type"),
        (F.size(extra) > 0, F.concat(F.lit("unknown field: "), F.array_join(extra, ", "))),
        (F.size(lacking) > 0, F.concat(F.lit("missing field: "), F.array_join(lacking, ", "))),
        *checks,
    )
    return parsed.select("path", error.alias("error"), *[F.col(f"r.{n}").alias(n) for n in names])


def _yaml_bodies(many: bool):
    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    documents = list(yaml.load_all(text or "", loader)) if many else [yaml.load(text or "", loader)]
                    out += [(path, json.dumps(d, default=str), None) for d in documents if d is not None or not many]
                except (yaml.YAMLError, ValueError, TypeError) as error:
                    out.append((path, None, f"not valid YAML: {error}"))
            yield pd.DataFrame(out, columns=["path", "body", "said"], dtype=object)

    return bodies


def decode_tasks(files: DataFrame, many: bool = False) -> DataFrame:
    """(path, error, task fields) of files(path, text): YAML, one task a file; with many, any number.

    An error: not YAML, no mapping, a field too many or too few, an unknown domain
    or tier, or a prompt that names a withheld shape (names of four letters or more).
    """
    bodies = files.select("path", "text").mapInPandas(_yaml_bodies(many), "path string, body string, said string")
    leaked = F.exists("r.detect_shapes", lambda s: (F.length(s["name"]) >= 4) & F.contains(F.col("r.prompt"), s["name"]))
    return _decoded(
        bodies,
        TASK,
        _TASK_NEEDS,
        (~F.col("r.domain").isin(*DOMAINS), F.concat(F.lit("unknown domain: "), F.col("r.domain"))),
        (~F.col("r.failure_tier").rlike("^T[1-6]$"), F.concat(F.lit("unknown tier: "), F.col("r.failure_tier"))),
        (leaked, "the prompt names a withheld shape"),
    )


def decode_verdicts(files: DataFrame) -> DataFrame:
    """(path, error, verdict fields) of files(path, text): one JSON object each.

    An error: no JSON object, a field too many or too few, an unknown verdict, or
    an oracle's result other than PASS without a reason.
    """
    bodies = files.select("path", F.col("text").alias("body"), F.lit(None).cast("string").alias("said"))
    mute = F.exists("r.oracle_results", lambda o: (o["verdict"] != "PASS") & (F.trim(F.coalesce(o["reason"], F.lit(""))) == ""))
    return _decoded(
        bodies,
        VERDICT,
        ("task_id", "verdict", "executed"),
        (~F.col("r.verdict").isin(*VERDICTS), F.concat(F.lit("unknown verdict: "), F.col("r.verdict"))),
        (mute, "a result other than PASS has no reason"),
    )


def read_tasks(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """decode_tasks of the .yaml and .yml files below path."""
    return decode_tasks(texts(spark, path, "*.{yaml,yml}"), many)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """decode_verdicts of the .json files below path."""
    return decode_verdicts(texts(spark, path, "*.json"))


def good(records: DataFrame) -> DataFrame:
    """What was read without error."""
    return records.where("error is null").drop("error")


def bad(records: DataFrame) -> DataFrame:
    """(path, error) of what wasn't."""
    return records.where("error is not null").select("path", "error")


def decode_ratings(files: DataFrame) -> DataFrame:
    """(path, error, rater, unit, name, value): a row for each cell of a CSV matrix of raters by units.

    Raters and units count from 1; name is the unit's heading, if any. Blank lines
    go, as do a heading and a first column in which nothing is a number. Missing
    ratings are null. One row with an error stands for a file that is no matrix.
    """

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist(), strict=True):
                try:
                    out.append((path, None, list(csv.reader(io.StringIO(text or "", newline="")))))
                except csv.Error as error:
                    out.append((path, str(error), []))
                held += len(text or "")
                if held >= HELD:
                    yield parsed(out)
                    out, held = [], 0
            yield parsed(out)

    def parsed(files: list[tuple]) -> pa.RecordBatch:
        path, broken, rows = zip(*files, strict=True) if files else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(broken, pa.string()), pa.array(rows, pa.list_(pa.list_(pa.string())))], ["path", "broken", "rows"])

    none = F.lit(None)
    # a cast that fails is dear, so that words are told by their letters first
    number = lambda c: F.when(c.rlike(NUMERIC), c.try_cast("double"))
    missing = lambda c: F.upper(c).isin(*MISSING)
    tail = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    # a file stays one row, as its text is, until its cells come out: no shuffle, and one pass over the texts
    files = files.select(F.col("path").cast("string").alias("path"), "text").mapInArrow(raw, "path string, broken string, rows array<array<string>>")
    files = files.withColumn("rows", F.transform(F.filter("rows", lambda r: F.exists(r, lambda c: F.trim(c) != "")), lambda r: F.transform(r, lambda c: F.trim(c))))
    files = files.withColumn("rows", F.transform("rows", lambda r: F.struct(r.alias("cells"), F.transform(r, lambda c: missing(c) | number(c).isNotNull()).alias("rated"))))
    top = F.get("rows", F.lit(0))
    files = files.withColumns({"top": top["cells"], "headed": F.coalesce(~F.exists(top["rated"], lambda x: x), F.lit(False))})
    files = files.withColumn("rows", F.when(F.col("headed"), tail(F.col("rows"))).otherwise(F.col("rows")))
    files = files.withColumns({"named": F.forall("rows", lambda r: ~F.element_at(r["rated"], 1)), "sizes": F.transform("rows", lambda r: F.size(r["cells"]))})
    wrong = F.transform("rows", lambda r: F.array_position(F.when(F.col("named"), tail(r["rated"])).otherwise(r["rated"]), F.lit(False)))
    files = files.withColumn("wrong", wrong).withColumn("line", F.array_position(F.transform("wrong", lambda w: w > 0), F.lit(True)))
    error = F.coalesce(
        "broken",
        F.when(F.col("top").isNull(), "no rows").when(F.size("rows") == 0, "a header but no ratings"),
        F.when(F.col("line") > 0, F.concat(F.lit("row "), F.col("line"), F.lit(", column "), F.get("wrong", (F.col("line") - 1).cast("int")), F.lit(" is not a number"))),
        F.when(F.array_min("sizes") < F.array_max("sizes"), "rows of unequal length"),
    )
    files = files.withColumns({"error": error, "names": F.when(F.col("headed") & F.col("named"), tail(F.col("top"))).when(F.col("headed"), F.col("top"))})

    def cell(c: Column, rater: Column, unit: Column) -> Column:
        value = F.nanvl(F.when(~missing(c), number(c)), none.cast("double"))
        return F.struct((rater + 1).cast("long").alias("rater"), (unit + 1).cast("long").alias("unit"), F.get("names", unit).alias("name"), value.alias("value"))

    body = F.transform("rows", lambda r, i: F.transform(F.when(F.col("named"), tail(r["cells"])).otherwise(r["cells"]), lambda c, j: cell(c, i, j)))
    nothing = F.array(F.struct(none.cast("long").alias("rater"), none.cast("long").alias("unit"), none.cast("string").alias("name"), none.cast("double").alias("value")))
    return files.select("path", "error", F.inline(F.when(F.col("error").isNull(), F.flatten(body)).otherwise(nothing)))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """decode_ratings of the .csv files below path."""
    return decode_ratings(texts(spark, path, "*.csv"))


def decode_profiles(files: DataFrame) -> DataFrame:
    """(path, metric, unit, n_kernels, min, max, mean, kernels, unparsed) of profiler CSV logs(path, text).

    Lines above the heading (the first row with Metric Name and Metric Value) and
    rows shorter than it are passed over; a log without one gives no rows. Numbers
    may have commas for thousands; what is no number is counted as unparsed.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                header = None
                for row in csv.reader(io.StringIO(text or "", newline="")):
                    if header is None:
                        header = row if "Metric Name" in row and "Metric Value" in row else None
                    elif len(row) >= len(header):
                        cell = dict(zip(header, (c.strip() for c in row), strict=False))
                        out.append((path, cell["Metric Name"], cell.get("Metric Unit", ""), cell.get("Kernel Name", ""), cell["Metric Value"]))
            yield pd.DataFrame(out, columns=["path", "metric", "unit", "kernel", "raw"], dtype=object)

    found = files.select("path", "text").mapInPandas(rows, "path string, metric string, unit string, kernel string, raw string").where("metric != ''")
    value = F.expr("try_cast(replace(raw, ',', '') as double)")
    return (
        found.withColumn("value", value)
        .groupBy("path", "metric")
        .agg(
            F.min("unit").alias("unit"),
            F.count("value").alias("n_kernels"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("mean"),
            F.count_distinct(F.when(F.col("value").isNotNull(), F.col("kernel"))).alias("kernels"),
            F.count_if(F.col("value").isNull()).alias("unparsed"),
        )
    )


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """decode_profiles of the .csv files below path."""
    return decode_profiles(texts(spark, path, "*.csv"))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, start, values) of the .npy files below path: doubles in C order, CHUNK to a row. Pickled ones are refused."""

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                flat = array.ravel()
                for start in range(0, max(len(flat), 1), CHUNK):
                    yield pd.DataFrame({"path": [path], "shape": [list(array.shape)], "start": [start], "values": [flat[start : start + CHUNK].astype(float)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInPandas(chunks, "path string, shape array<long>, start long, values array<double>")


def read_attacks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of attack files, {"attacks": [...]} each, as rows of schema. Unlike other readers this one fails on a malformed file: an attack must not vanish."""
    read = spark.read.option("multiLine", "true").option("mode", "FAILFAST").option("recursiveFileLookup", "true")
    return read.schema(f"attacks array<struct<{schema}>>").json(path).select(F.inline("attacks"))


def side_input(spark: SparkSession, path: str | None) -> tuple[object, str]:
    """(payload, path) of one optional JSON file, or (None, why there is none). For small files: the payload comes to the driver."""
    if path is None:
        return None, ""
    try:
        first = spark.read.text(path, wholetext=True).first()
        return (None, f"{path} (empty)") if first is None else (json.loads(first.value), path)
    except AnalysisException:
        return None, f"{path} (not found)"
    except json.JSONDecodeError as error:
        return None, f"{path} ({error})"


def upsert(known: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """known with the rows of new, which replace those of the same key."""
    return known.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def with_calibration(tasks: DataFrame, calibrated: DataFrame) -> DataFrame:
    """tasks with the calibration of calibrated(task_id, calibration) where there is one."""
    new = calibrated.select("task_id", F.col("calibration").alias("_new"))
    return tasks.join(new, "task_id", "left").withColumn("calibration", F.coalesce("_new", "calibration")).drop("_new").select(*tasks.columns)


def write_tasks(tasks: DataFrame, path: str) -> None:
    """Writes tasks as YAML files of many documents each, for read_tasks(many=True). Free-form fields hold JSON texts and are written as what they say."""
    fields = [c for c in tasks.columns if c not in ("path", "error")]

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": [yaml.safe_dump(_free(json.loads(b)), sort_keys=False, allow_unicode=True, width=100_000) for b in batch["body"]]})

    tasks.select(F.to_json(F.struct(*fields)).alias("body")).mapInPandas(documents, "value string").write.option("lineSep", "---\n").option("compression", "none").mode("errorifexists").text(path)


def _free(value: object, name: str = "") -> object:
    """Opens the JSON texts of params, kwargs, provenance and trace_stats."""
    if isinstance(value, dict):
        return {k: _free(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [_free(v) for v in value]
    return json.loads(value) if name in ("params", "kwargs", "provenance", "trace_stats") and isinstance(value, str) else value


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """Writes verdicts as JSON lines."""
    verdicts.drop("path", "error").write.mode("errorifexists").json(path)
