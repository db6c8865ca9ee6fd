"""The grid of failure tiers and domains, as constants, columns and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tiers by rising value, domains, verdicts by falling severity.
TIERS = ["T1", "T2", "T3", "T4", "T5", "T6"]
DOMAINS = ["triton", "pallas", "cuda", "jax", "pytorch", "distributed", "data_pipeline", "checkpointing"]
VERDICTS = ["ERROR", "FAIL", "SKIP", "PASS"]
SILENT_FROM = 5
TARGET_PER_CELL = 5


def cells(spark: SparkSession) -> DataFrame:
    """(tier, domain, cell, value_rank, silent), all 48."""
    rows = [(t, d, f"{t}/{d}", k + 1, k + 1 >= SILENT_FROM) for k, t in enumerate(TIERS) for d in DOMAINS]
    return spark.createDataFrame(rows, "tier string, domain string, cell string, value_rank int, silent boolean")


def cell_id(tier: Column, domain: Column) -> Column:
    """'T5/cuda'; an unknown tier or domain is an error."""
    known = tier.isin(TIERS) & domain.isin(DOMAINS)
    return F.when(known, F.concat_ws("/", tier, domain)).otherwise(F.raise_error(F.concat(F.lit("no such cell: "), F.coalesce(tier, F.lit("null")), F.lit("/"), F.coalesce(domain, F.lit("null")))))


def parse_cell(cell: Column) -> Column:
    """(tier, domain) of a cell id."""
    parts = F.split(cell, "/")
    return F.struct(parts[0].alias("tier"), parts[1].alias("domain"))


def severity(verdict: Column) -> Column:
    """0 for ERROR to 3 for PASS; null for anything else."""
    place = F.array_position(F.array(*map(F.lit, VERDICTS)), verdict)
    return F.when(place > 0, place.cast("int") - 1)


def worst(verdict: Column) -> Column:
    """Aggregate: the most severe verdict of a group; SKIP for an empty one."""
    return F.coalesce(F.element_at(F.array(*map(F.lit, VERDICTS)), F.min(severity(verdict)) + 1), F.lit("SKIP"))
