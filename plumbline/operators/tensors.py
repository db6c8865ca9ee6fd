"""Comparison of numeric outputs within tolerances that follow from precision and depth.

Outputs are long: (name, idx, ref, cand), one row an element; a missing side is
null. Elements are never gathered: every figure is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rounding units of the number formats, and other names for them.
EPS = {"fp64": 2.0**-53, "fp32": 2.0**-24, "tf32": 2.0**-11, "bf16": 2.0**-8, "fp16": 2.0**-11, "fp8": 2.0**-4}
NAMES = {"float64": "fp64", "double": "fp64", "float32": "fp32", "float": "fp32", "tensorfloat32": "tf32", "bfloat16": "bf16", "float16": "fp16", "half": "fp16", "float8": "fp8"}
SAFETY = 4.0


def normalize_dtype(dtype: Column) -> Column:
    """The short name of a number format; an unknown one is an error."""
    name = F.lower(F.trim(dtype))
    known = F.create_map(*[F.lit(x) for pair in {**NAMES, **{k: k for k in EPS}}.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_replace(name, r"^.*\.", "")), F.raise_error(F.concat(F.lit("unknown number format: "), name)))


def eps(dtype: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in EPS.items() for x in pair]), normalize_dtype(dtype))


def growth(depth: Column, mode: str = "sqrt") -> Column:
    """How rounding errors add up over depth steps: sqrt (random) or linear (worst)."""
    k = F.greatest(depth.cast("double"), F.lit(1.0))
    if mode not in ("sqrt", "linear"):
        raise ValueError(f"mode must be sqrt or linear, got {mode!r}")
    return F.sqrt(k) if mode == "sqrt" else k


def tolerances(rows: DataFrame, mode: str = "sqrt", safety: float = SAFETY) -> DataFrame:
    """rows(dtype, depth, scale) with rel, abs, usable_scale and the formula as text; an unusable scale counts as 1 and says so."""
    usable = F.coalesce((F.col("scale") > 0) & ~F.isnan("scale") & (F.col("scale") < F.lit(float("inf"))), F.lit(False))
    rel = F.lit(safety) * growth(F.col("depth"), mode) * eps(F.col("dtype"))
    text = F.format_string(f"{safety:g} * {'sqrt' if mode == 'sqrt' else 'lin'}(%d) * eps(%s)", F.greatest(F.col("depth"), F.lit(1)).cast("long"), normalize_dtype(F.col("dtype")))
    return rows.withColumns({"usable_scale": usable, "rel": rel, "abs": rel * F.when(usable, F.col("scale")).otherwise(1.0), "formula": text})


def fixed_tolerance(rows: DataFrame, rel: float, absolute: float) -> DataFrame:
    """rows with a given tolerance, marked as not derived; it is never rescaled."""
    return rows.withColumns({"rel": F.lit(rel), "abs": F.lit(absolute), "derived": F.lit(False)})


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def magnitudes(cells: DataFrame) -> DataFrame:
    """(name, magnitude): the largest finite absolute reference value, 0 without one."""
    return cells.groupBy("name").agg(F.coalesce(F.max(F.when(finite(F.col("ref")), F.abs("ref"))), F.lit(0.0)).alias("magnitude"))


def aligned(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Elements of both by (name, idx); where one has none its side is null."""
    return reference.select("name", "idx", F.col("value").alias("ref")).join(candidate.select("name", "idx", F.col("value").alias("cand")), ["name", "idx"], "full_outer")


def shape_mismatches(cells: DataFrame) -> DataFrame:
    """(name, n_missing): outputs with elements on one side only."""
    return cells.where("ref is null or cand is null").groupBy("name").agg(F.count("*").alias("n_missing"))


def compare(cells: DataFrame, rel: Column, absolute: Column) -> DataFrame:
    """One row a name: n, max_abs, max_rel, n_bad, first_bad, n_nonfinite, n_zero_ref, ok.

    An element agrees if |cand - ref| <= abs + rel |ref|; NaN agrees with NaN and
    an infinity with the same one, nothing else with them at any tolerance. A
    zero reference has no relative error. A missing side is bad.
    """
    ref, cand = F.col("ref"), F.col("cand")
    missing = ref.isNull() | cand.isNull()
    both = ~missing & finite(ref) & finite(cand)
    gap = F.when(both, F.abs(cand - ref))
    odd = ~missing & ~both & ~((F.isnan(ref) & F.isnan(cand)) | (~F.isnan(ref) & ~F.isnan(cand) & (ref == cand)))
    bad = missing | odd | F.coalesce(gap > absolute + rel * F.abs(ref), F.lit(False))
    return cells.groupBy("name").agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_abs"),
        F.max(F.when(F.abs(ref) > 0, gap / F.abs(ref))).alias("max_rel"),
        F.count_if(bad).alias("n_bad"),
        F.min(F.when(bad, F.col("idx"))).alias("first_bad"),
        F.count_if(odd).alias("n_nonfinite"),
        F.count_if(both & (ref == 0)).alias("n_zero_ref"),
        (F.count_if(bad) == 0).alias("ok"),
    )


def oracle_verdict(shapes: DataFrame) -> DataFrame:
    """(task_id, verdict, first_break) of shapes(task_id, ord, name, verdict): a failure over a skip over passes; none is a skip."""
    v = F.col("verdict")
    verdict = F.when(F.bool_or(v == "FAIL"), "FAIL").when(F.bool_or(v == "SKIP"), "SKIP").otherwise("PASS")
    return shapes.groupBy("task_id").agg(verdict.alias("verdict"), F.min(F.when(v == "FAIL", F.struct("ord", "name")))["name"].alias("first_break"))


def first_of_each(sweep: DataFrame, detect: DataFrame, decoy: DataFrame) -> DataFrame:
    """Shapes (key, name, part) of three lists in this order, each key where it stands first."""
    parts = [x.select(F.lit(k).alias("part"), "ord", "key", "name") for k, x in enumerate((sweep, detect, decoy))]
    w = Window.partitionBy("key").orderBy("part", "ord")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("nth", F.row_number().over(w)).where("nth = 1").select("key", "name", "part")


def row_hashes(cells: DataFrame, column: str) -> DataFrame:
    """(name, digest): an order-free digest of an output's elements."""
    return cells.groupBy("name").agg(F.sum(F.xxhash64("idx", column).cast("decimal(38,0)")).alias("digest"))


def insensitive(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names whose output is the same before and after inputs were perturbed: it doesn't depend on them."""
    a, b = row_hashes(before, "value"), row_hashes(after, "value").withColumnRenamed("digest", "digest_after")
    return a.join(b, "name").where("digest = digest_after").select("name")


def discriminating(outputs: DataFrame) -> DataFrame:
    """Shapes of outputs(shape, seed, digest) whose reference output varies with the seed."""
    return outputs.groupBy("shape").agg(F.countDistinct("digest").alias("n")).where("n > 1").select("shape", "n")


def combined_checksum(hashes: DataFrame) -> DataFrame:
    """(name, checksum): SHA-256 of the sorted part=hash list of each name."""
    return hashes.groupBy("name").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "part", "hash"))), ";").cast("binary"), 256).alias("checksum"))
