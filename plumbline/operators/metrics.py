"""Bank metrics: verdicts, coverage and the seven headline figures.

Two rules hold throughout: what wasn't measured is null with a reason, never
zero; and a skip is never a pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.taxonomy import DOMAINS, SILENT_FROM, TARGET_PER_CELL, TIERS, VERDICTS, cell_id, cells, worst

# Policy targets of the headline figures.
TARGETS = {"headline": 1.0, "gold_band": 0.6, "alpha_share": 1.0, "redteam_catch": 1.0, "coverage_fill": 1.0, "silent_share": 0.35, "sme_hours": 2.0}
GOLD_LO, GOLD_HI = 0.10, 0.70
ALPHA_THRESHOLD = 0.70
BUCKETS = ["PASS", "FAIL", "ERROR", "SKIP", "UNVERIFIED"]
TABLE_ORDER = ["ERROR", "FAIL", "SKIP", "UNVERIFIED", "PASS"]


def accepted(verdict: Column, executed: Column) -> Column:
    """Passed, and really executed."""
    return F.coalesce((verdict == "PASS") & executed, F.lit(False))


def executed(results: DataFrame) -> DataFrame:
    """(task_id, executed) of results(task_id, verdict): whether some oracle passed or failed."""
    return results.groupBy("task_id").agg(F.bool_or(F.col("verdict").isin("PASS", "FAIL")).alias("executed"))


def failures_and_skips(results: DataFrame) -> DataFrame:
    """(task_id, failures, skips): oracles of results(task_id, ord, oracle, verdict) that failed or skipped, in order."""
    picked = lambda v: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.struct("ord", "oracle")))), lambda x: x["oracle"]), ",")
    return results.groupBy("task_id").agg(picked("FAIL").alias("failures"), picked("SKIP").alias("skips"))


def last_by_path(verdicts: DataFrame) -> DataFrame:
    """The last row by path of every task of verdicts(path, task_id, ...)."""
    order = Window.partitionBy("task_id").orderBy(F.col("path").desc())
    return verdicts.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def universe(tasks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every task or verdict once: tasks' columns, has_task, verdict and executed (null without a verdict)."""
    v = verdicts.select(F.col("task_id").alias("_v"), "verdict", "executed")
    joined = tasks.join(v, tasks["task_id"] == v["_v"], "full_outer")
    others = [c for c in tasks.columns if c != "task_id"]
    return joined.select(F.coalesce("task_id", "_v").alias("task_id"), tasks["task_id"].isNotNull().alias("has_task"), *others, "verdict", "executed")


def stray_verdicts(tasks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts of tasks that aren't in the bank."""
    return verdicts.join(tasks.select("task_id"), "task_id", "left_anti")


def tasks_with_verdict(tasks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each task with its verdict, UNVERIFIED without one."""
    v = verdicts.select("task_id", "verdict", "executed")
    return tasks.join(v, "task_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNVERIFIED")))


def combine(results: DataFrame) -> DataFrame:
    """(task_id, verdict): ERROR over FAIL over SKIP over PASS."""
    return results.groupBy("task_id").agg(worst(F.col("verdict")).alias("verdict"))


def bank_verdict(everything: DataFrame) -> DataFrame:
    """One verdict for a universe; what has none counts as a skip."""
    return everything.agg(worst(F.coalesce("verdict", F.lit("SKIP"))).alias("verdict"))


def verdict_counts(everything: DataFrame) -> DataFrame:
    """(verdict, n): all five buckets, also empty ones."""
    spark = everything.sparkSession
    counts = everything.groupBy(F.coalesce("verdict", F.lit("UNVERIFIED")).alias("verdict")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(b,) for b in BUCKETS], "verdict string")
    return names.join(counts, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))


def metric(rows: DataFrame, name: str, value: Column, numerator: Column, denominator: Column, lower_is_better: bool = False) -> DataFrame:
    """One row (metric, value, numerator, denominator, target, met); value and met are null over nothing."""
    target = F.lit(TARGETS[name])
    one = rows.agg(value.alias("value"), numerator.cast("double").alias("numerator"), denominator.cast("long").alias("denominator"))
    met = F.col("value") <= target if lower_is_better else F.col("value") >= target
    return one.select(F.lit(name).alias("metric"), F.round("value", 9).alias("value"), F.round("numerator", 6).alias("numerator"), "denominator", target.alias("target"), met.alias("met"))


def share(name: str, rows: DataFrame, hit: Column) -> DataFrame:
    """The share of rows with hit, as a metric."""
    n = F.count_if(F.coalesce(hit, F.lit(False)))
    return metric(rows, name, F.try_divide(n.cast("double"), F.count(F.lit(1))), n, F.count(F.lit(1)))


def headline(everything: DataFrame) -> DataFrame:
    """Accepted tasks of all; unverified, skipped and unexecuted ones count against it."""
    return share("headline", everything, accepted(F.col("verdict"), F.col("executed")))


def gold_band(calibrated: DataFrame) -> DataFrame:
    """Tasks with pass_at_1 in the gold band, of those that have one."""
    return share("gold_band", calibrated.where("pass_at_1 is not null"), F.col("pass_at_1").between(GOLD_LO, GOLD_HI))


def alpha_share(alphas: DataFrame) -> DataFrame:
    """Criteria with alpha of at least the threshold, of those with one (NaN counts as none)."""
    return share("alpha_share", alphas.where("alpha is not null and not isnan(alpha)"), F.col("alpha") >= ALPHA_THRESHOLD)


def failing_alphas(alphas: DataFrame, limit: int = 4) -> DataFrame:
    """The criteria furthest below the threshold."""
    return alphas.where((F.col("alpha") < ALPHA_THRESHOLD) & ~F.isnan("alpha")).orderBy("alpha", "criterion").limit(limit)


def redteam_catch(attacks: DataFrame) -> DataFrame:
    """Caught attacks of attacks(id, caught, catcher); caught falls back to whether there is a catcher."""
    return share("redteam_catch", attacks, F.coalesce("caught", F.col("catcher").isNotNull()))


def cell_counts(tasks: DataFrame) -> DataFrame:
    """(tier, domain, n) of cells with a task; an unknown tier or domain is an error."""
    return tasks.groupBy("tier", "domain").agg(F.count("*").alias("n")).where(cell_id(F.col("tier"), F.col("domain")).isNotNull())


def coverage(tasks: DataFrame, target: int = TARGET_PER_CELL) -> DataFrame:
    """All 48 cells with n, shortfall, fill (to 1) and priority (rank times what is missing)."""
    grid = cells(tasks.sparkSession).join(F.broadcast(cell_counts(tasks)), ["tier", "domain"], "left")  # 48 rows at most
    n = F.coalesce("n", F.lit(0)).cast("long")
    fill = F.least(F.lit(1.0), n / F.lit(float(target))) if target > 0 else F.lit(1.0)
    return grid.select("cell", "tier", "domain", "value_rank", "silent", n.alias("n"), F.greatest(F.lit(0), F.lit(target) - n).cast("long").alias("shortfall"), fill.alias("fill"), (F.col("value_rank") * (1 - fill)).alias("priority"))


def fill_class(fill: Column) -> Column:
    """f0 (empty) to f4 (full) at 0, 1/4, 1/2 and 1."""
    return F.when(fill <= 0, "f0").when(fill < 0.25, "f1").when(fill < 0.5, "f2").when(fill < 1, "f3").otherwise("f4")


def coverage_fill(tasks: DataFrame, target: int = TARGET_PER_CELL) -> DataFrame:
    """Cells at target, of all 48."""
    return share("coverage_fill", coverage(tasks, target), F.col("n") >= target)


def silent_share(tasks: DataFrame) -> DataFrame:
    """Tasks of the silent tiers."""
    return share("silent_share", tasks, F.substring("tier", 2, 1).cast("int") >= SILENT_FROM)


def sme_hours(everything: DataFrame) -> DataFrame:
    """Mean expert hours of accepted tasks that record them; minutes in sme_minutes."""
    kept = everything.where(accepted(F.col("verdict"), F.col("executed")) & F.col("sme_minutes").isNotNull())
    hours = F.col("sme_minutes") / 60
    return metric(kept, "sme_hours", F.avg(hours), F.coalesce(F.sum(hours), F.lit(0.0)), F.count("*"), lower_is_better=True)


def all_metrics(tasks: DataFrame, everything: DataFrame, calibrated: DataFrame, alphas: DataFrame, attacks: DataFrame) -> DataFrame:
    """The seven headline figures with their place; everything, the universe of tasks, is read once for four of them."""
    bank = F.coalesce("has_task", F.lit(False))
    done = accepted(F.col("verdict"), F.col("executed"))
    hours = F.when(done, F.col("sme_minutes") / 60)
    known = F.when(bank, cell_id(F.col("tier"), F.col("domain")).isNotNull())  # an unknown tier or domain is an error
    by_cell = everything.groupBy("tier", "domain").agg(F.count_if(known).alias("n"), F.count("*").alias("rows"), F.count_if(done).alias("done"), F.sum(hours).alias("hours"), F.count(hours).alias("timed"))
    silent = F.substring("tier", 2, 1).cast("int") >= SILENT_FROM
    one = by_cell.agg(F.sum("rows").alias("rows"), F.sum("done").alias("done"), F.count_if(F.col("n") >= TARGET_PER_CELL).alias("full"), F.sum("n").alias("n"), F.sum(F.when(silent, F.col("n")).otherwise(0)).alias("silent"), F.sum("hours").alias("hours"), F.sum("timed").alias("timed"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    figures = [("headline", 1, zero("done"), zero("rows")), ("coverage_fill", 5, F.col("full"), F.lit(len(TIERS) * len(DOMAINS))), ("silent_share", 6, zero("silent"), zero("n")), ("sme_hours", 7, zero("hours"), zero("timed"))]
    out = one.select(F.inline(F.array(*[_figure(*f) for f in figures])))
    for k, part in ((2, gold_band(calibrated)), (3, alpha_share(alphas)), (4, redteam_catch(attacks))):
        out = out.unionByName(part.withColumn("ord", F.lit(k)))
    return out


def _figure(name: str, ord: int, numerator: Column, denominator: Column) -> Column:
    """A metric and its place as a struct."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    met = value <= TARGETS[name] if name == "sme_hours" else value >= TARGETS[name]
    return F.struct(F.lit(name).alias("metric"), F.round(value, 9).alias("value"), F.round(numerator.cast("double"), 6).alias("numerator"), denominator.cast("long").alias("denominator"), F.lit(TARGETS[name]).alias("target"), met.alias("met"), F.lit(ord).alias("ord"))


# What expert time is called, with its share of an hour.
SME_NESTED = {"hours": 1.0, "minutes": 1 / 60, "seconds": 1 / 3600}
SME_KEYS = {"sme_hours": 1.0, "sme_hours_total": 1.0, "sme_minutes": 1 / 60, "sme_seconds": 1 / 3600}


def provenance_hours(provenance: Column) -> Column:
    """Expert hours of a provenance (JSON text): {"sme": {"hours": ...}} first, then the longer names at the top, then those within sme.

    Numbers only: a text or a truth value is no time. Null where nothing is recorded, which isn't zero.
    """
    whole = F.try_parse_json(provenance)

    def number(path: str) -> Column:
        at = F.try_variant_get(whole, path, "variant")
        return F.when(F.schema_of_variant(at).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.try_variant_get(whole, path, "double"))

    found = [number(f"$.sme.{k}") * share for k, share in SME_NESTED.items()]
    return F.coalesce(*found, *[number(f"{at}.{k}") * share for at in ("$", "$.sme") for k, share in SME_KEYS.items()])


def redteam_payloads(payloads: DataFrame) -> DataFrame:
    """payloads(payload, a JSON text) with n_caught, n_attacks and uncaught, the ids of what wasn't, and catch_rate (null over nothing).

    {"attacks": [{"id", "caught"}]}, where without caught a catcher or caught_by counts; or the counts alone, as n_caught and n_attacks or
    caught and total, with uncaught. Anything else counts nothing.
    """
    attack = "struct<id: string, caught: boolean, catcher: string, caught_by: string>"
    read = F.from_json("payload", f"struct<attacks: array<{attack}>, n_attacks: double, total: double, n_caught: double, caught: double, uncaught: array<string>>")
    hit = lambda a: F.coalesce(a["caught"], F.coalesce(F.when(a["catcher"] != "", True), F.when(a["caught_by"] != "", True), F.lit(False)))
    listed = F.filter("r.attacks", lambda a: a.isNotNull())
    names = F.transform("r.attacks", lambda a, k: F.struct(F.coalesce(F.when(a["id"] != "", a["id"]), F.concat(F.lit("attack_"), k.cast("string"))).alias("id"), (a.isNotNull() & ~hit(a)).alias("open")))
    total, caught = F.coalesce("r.n_attacks", "r.total"), F.coalesce("r.n_caught", "r.caught")
    counted = total.isNotNull() & caught.isNotNull()
    pick = lambda a, b, none: F.when(F.col("r.attacks").isNotNull(), a).when(counted, b).otherwise(none)
    rows = payloads.withColumn("r", read)
    out = rows.withColumns({
        "n_caught": pick(F.size(F.filter(listed, hit)).cast("long"), caught.cast("long"), F.lit(0)),
        "n_attacks": pick(F.size(listed).cast("long"), total.cast("long"), F.lit(0)),
        "uncaught": pick(F.transform(F.filter(names, lambda a: a["open"]), lambda a: a["id"]), F.coalesce("r.uncaught", F.array().cast("array<string>")), F.array().cast("array<string>")),
    })
    return out.withColumn("catch_rate", F.when(F.col("n_attacks") > 0, F.col("n_caught") / F.col("n_attacks"))).drop("r")


def skip_breakdown(results: DataFrame, kinds: Iterable[str] = ("SKIP", "ERROR", "FAIL"), sample: int = 5) -> DataFrame:
    """(oracle, verdict, reason, n, first_tasks) by falling n; first_tasks: the lowest task ids, comma-joined.

    The ids are found by rank within a task's group, so that no group is gathered whole.
    """
    rows = results.where(F.col("verdict").isin(*kinds))
    key = ["oracle", "verdict", "reason"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    salted = rows.select(*key, "task_id", F.pmod(F.hash("task_id"), F.lit(64)).alias("salt"))
    nearest = salted.withColumn("k", F.row_number().over(Window.partitionBy(*key, "salt").orderBy("task_id"))).where(F.col("k") <= sample)
    ids = nearest.groupBy(*key).agg(F.array_join(F.slice(F.array_sort(F.collect_list("task_id")), 1, sample), ",").alias("first_tasks"))
    joined = counts.alias("a").join(ids.alias("b"), F.expr("a.oracle = b.oracle and a.verdict = b.verdict and a.reason <=> b.reason"))
    return joined.select("a.oracle", "a.verdict", "a.reason", "a.n", "b.first_tasks").orderBy(F.desc("n"), "oracle", "verdict", "reason")


def rollups(tasks: DataFrame) -> DataFrame:
    """(tier, domain, n) by cell, by tier, by domain and in all, in one pass; null where rolled up."""
    return tasks.groupingSets([[F.col("tier"), F.col("domain")], [F.col("tier")], [F.col("domain")], []], "tier", "domain").agg(F.count("*").alias("n"))


def heatmap(tasks: DataFrame) -> DataFrame:
    """One row a tier, one column a domain, and the total."""
    spark = tasks.sparkSession
    wide = tasks.groupBy("tier").pivot("domain", DOMAINS).count()
    rows = spark.createDataFrame([(t,) for t in TIERS], "tier string").join(wide, "tier", "left").na.fill(0)
    total = sum((F.col(d) for d in DOMAINS[1:]), F.col(DOMAINS[0]))
    return rows.withColumn("total", total)


def gaps_ranked(tasks: DataFrame, limit: int | None = None, target: int = TARGET_PER_CELL) -> DataFrame:
    """Cells below target, the most valuable and emptiest first."""
    ranked = coverage(tasks, target).where("shortfall > 0").orderBy(F.desc("priority"), F.desc("value_rank"), "cell")
    return ranked.limit(limit) if limit is not None else ranked


def grid_gaps(tasks: DataFrame, target: int = TARGET_PER_CELL) -> DataFrame:
    """(cell, shortfall) of cells below target, the worst first."""
    return coverage(tasks, target).where("shortfall > 0").orderBy(F.desc("shortfall"), "cell").select("cell", "shortfall")


def task_table(everything: DataFrame) -> DataFrame:
    """A universe in the order of the report: errors first, passes last."""
    verdict = F.coalesce("verdict", F.lit("UNVERIFIED"))
    place = F.array_position(F.array(*map(F.lit, TABLE_ORDER)), verdict)
    return everything.select("task_id", "has_task", verdict.alias("verdict"), place.cast("int").alias("place")).orderBy("place", "task_id")


def discard_reasons(reasons: DataFrame) -> DataFrame:
    """(kind, n): reasons by what stands before the first colon."""
    return reasons.where("reason is not null").groupBy(F.substring_index("reason", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def first_seen(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """Distinct values of two columns (value, ord), those of the first before the second's, each where it was seen first."""
    both = first.select(F.lit(0).alias("part"), "ord", F.col(column)).unionByName(second.select(F.lit(1).alias("part"), "ord", F.col(column)))
    return both.groupBy(column).agg(F.min(F.struct("part", "ord")).alias("at")).select(column, F.col("at.part").alias("part"), F.col("at.ord").alias("ord"))


def unknown_verdicts(results: DataFrame) -> DataFrame:
    """Rows whose verdict is none of the four."""
    return results.where(~F.col("verdict").isin(VERDICTS) | F.col("verdict").isNull())
