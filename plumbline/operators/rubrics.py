"""Rubrics: probes into evidence, scores, weights, validation, and red-team bookkeeping.

Criteria are rows: (rubric, ord, id, weight, machine_probed, auto_probe,
anchors array<int>, thresholds array<struct<bound,score>>). What can't be scored
carries an error and is left out of the score; it never becomes a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHT_TOLERANCE = 1e-9
#: Attacks that are broadcast; a larger bank meets the seeds by partitions.
MAX_BANK = 10_000
VERDICT_ORDER = ["FAIL", "ERROR", "SKIP", "PASS"]


def probe_parts(path: Column) -> Column:
    """(oracle, keys) of 'oracle.<ID>.<key>...'; null for anything else."""
    parts = F.filter(F.split(path, r"\."), lambda p: p != "")
    good = (F.size(parts) >= 3) & (parts[0] == "oracle")
    return F.when(good, F.struct(parts[1].alias("oracle"), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))).alias("keys")))


def json_path(keys: Column) -> Column:
    """A JSON path of keys; whole numbers index arrays."""
    return F.concat(F.lit("$"), F.array_join(F.transform(keys, lambda k: F.when(k.rlike("^[0-9]+$"), F.concat(F.lit("["), k, F.lit("]"))).otherwise(F.concat(F.lit("."), k))), ""))


def walk(evidence: Column, keys: Column) -> Column:
    """What stands in JSON text at the end of the keys, as text; null if the way ends before.

    A negative index counts from the end of an array.
    """

    def step(now: Column, key: Column) -> Column:
        items = F.from_json(now, "array<variant>")
        place = F.when(key.rlike("^-?[0-9]+$"), key.cast("int"))
        found = F.try_element_at(items, F.when(place < 0, place).otherwise(place + 1))
        of_array = F.when(place.isNotNull() & (F.substring(F.trim(now), 1, 1) == "["), F.to_json(found))
        member = F.try_element_at(F.from_json(now, "map<string,variant>"), key)
        of_object = F.when(F.substring(F.trim(now), 1, 1) == "{", F.to_json(member))
        return F.coalesce(of_array, of_object)

    return F.aggregate(keys, evidence, step)


def scalar(raw: Column, end: Column) -> Column:
    """A number from JSON text: true and false are 1 and 0, a two-number array its low or high end; else null."""
    pair = F.from_json(raw, "array<double>")
    number = F.when(raw == "true", 1.0).when(raw == "false", 0.0).when(F.size(pair) == 2, F.when(end == "lo", F.array_min(pair)).when(end == "hi", F.array_max(pair))).otherwise(raw.try_cast("double"))
    return F.when(~F.isnan(number), number)


def direction(thresholds: Column) -> Column:
    """higher_is_better or lower_is_better if scores rise or fall with their bounds; mixed otherwise, or of a single band."""
    scores = F.transform(thresholds, lambda t: t["score"])
    steps = F.zip_with(scores, F.slice(scores, 2, F.greatest(F.size(scores) - 1, F.lit(0))), lambda a, b: b - a)
    known = F.filter(steps, lambda s: s.isNotNull())
    return F.when(F.size(scores) < 2, "mixed").when(F.forall(known, lambda s: s >= 0), "higher_is_better").when(F.forall(known, lambda s: s <= 0), "lower_is_better").otherwise("mixed")


def cautious_end(thresholds: Column) -> Column:
    return F.when(direction(thresholds) == "higher_is_better", "lo").when(direction(thresholds) == "lower_is_better", "hi")


def band_score(value: Column, thresholds: Column) -> Column:
    """The score of the first band whose bound reaches value; of the last one beyond all. Null without bands or value."""
    fits = F.filter(thresholds, lambda t: value <= t["bound"])
    score = F.when(F.size(fits) > 0, fits[0]["score"]).otherwise(F.try_element_at(thresholds, F.lit(-1))["score"])
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.size(thresholds) > 0), score)


def resolve(criteria: DataFrame, results: DataFrame) -> DataFrame:
    """criteria with value, score and error, from results(task_id, oracle, verdict, evidence as JSON text).

    A probe needs exactly one result of its oracle, and a number at its path.
    """
    probed = criteria.withColumn("_p", probe_parts(F.col("auto_probe"))).withColumn("_oracle", F.col("_p.oracle"))
    met = results.groupBy("task_id", F.col("oracle").alias("_oracle")).agg(F.count("*").alias("_n"), F.min("evidence").alias("_evidence"))
    tasks = results.select("task_id").distinct()
    joined = tasks.join(F.broadcast(probed)) if "task_id" not in criteria.columns else probed  # a rubric is a few rows
    joined = joined.join(met, ["task_id", "_oracle"], "left")
    value = scalar(walk(F.col("_evidence"), F.col("_p.keys")), cautious_end(F.col("thresholds")))
    out = joined.withColumn("value", F.when(F.col("_n") == 1, value))
    error = F.when(~F.col("machine_probed"), "for human raters").when(F.col("_p").isNull(), "malformed probe").when(F.col("_n").isNull(), "oracle did not run").when(F.col("_n") > 1, "oracle ran more than once").when(F.col("value").isNull(), "no number at this path")
    return out.withColumns({"score": band_score(F.col("value"), F.col("thresholds")), "error": error}).drop("_p", "_oracle", "_n", "_evidence")


def rubric_scores(scored: DataFrame) -> DataFrame:
    """(task_id, score, coverage, n_scored, n_unscored): weighted mean over what was scored, and its share of the weight."""
    done = F.col("score").isNotNull()
    weight = F.sum(F.when(done, F.col("weight")))
    return scored.groupBy("task_id").agg(F.try_divide(F.sum(F.when(done, F.col("weight") * F.col("score"))), weight).alias("score"), F.coalesce(F.try_divide(weight, F.sum("weight")), F.lit(0.0)).alias("coverage"), F.count_if(done).alias("n_scored"), F.count_if(~done).alias("n_unscored"))


def normalize_weights(criteria: DataFrame) -> DataFrame:
    """criteria with weights that sum to 1 in each rubric: the first heaviest takes what division leaves over."""
    whole = Window.partitionBy("rubric")
    total = F.sum("weight").over(whole)
    scaled = criteria.withColumn("_w", F.when(total > 0, F.col("weight") / total).otherwise(F.raise_error(F.lit("weights sum to zero or less"))))
    placed = scaled.withColumn("_nth", F.row_number().over(whole.orderBy(F.desc("_w"), "ord")))
    rest = F.sum(F.when(F.col("_nth") > 1, F.col("_w"))).over(whole)
    return placed.withColumn("weight", F.when(F.col("_nth") == 1, 1 - F.coalesce(rest, F.lit(0.0))).otherwise(F.col("_w"))).drop("_w", "_nth")


def weight_shares(criteria: DataFrame) -> DataFrame:
    """(rubric, total, machine_share of criteria, human_share of weight)."""
    human = F.sum(F.when(~F.col("machine_probed"), F.col("weight")).otherwise(0.0))
    return criteria.groupBy("rubric").agg(F.sum("weight").alias("total"), F.avg(F.col("machine_probed").cast("int")).alias("machine_share"), F.coalesce(F.try_divide(human, F.sum("weight")), F.lit(0.0)).alias("human_share"))


def split_criteria(criteria: DataFrame) -> DataFrame:
    """(rubric, machine, human): ids by who scores them, in order."""
    ids = lambda keep: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("ord", "id", "machine_probed"))), keep), lambda c: c["id"]), ",")
    return criteria.groupBy("rubric").agg(ids(lambda c: c["machine_probed"]).alias("machine"), ids(lambda c: ~c["machine_probed"]).alias("human"))


def problems(criteria: DataFrame, oracles: list[str], probeable: list[str], human_only: list[str]) -> DataFrame:
    """(rubric, id, problem): every fault of every rubric, not only the first."""
    parts = probe_parts(F.col("auto_probe"))
    c = criteria.withColumns({"_oracle": parts["oracle"], "_bad": parts.isNull()})
    machine = F.col("machine_probed")
    finite = lambda b: ~F.isnan(b) & (F.abs(b) < F.lit(float("inf")))
    found = F.array_compact(
        F.array(
            F.when(F.col("id").isin(probeable) & ~machine, "an oracle measures it, but people rate it"),
            F.when(F.col("auto_probe").isNotNull() & ~machine, "its probe is not used"),
            F.when(F.col("id").isin(human_only) & machine, "no oracle can measure it"),
            F.when(machine & (F.size("thresholds") == 0), "no thresholds"),
            F.when(machine & F.col("_bad"), "malformed probe"),
            F.when(machine & ~F.col("_bad") & ~F.col("_oracle").isin(oracles), "its oracle does not run"),
            F.when(machine & F.exists("thresholds", lambda t: ~finite(t["bound"])), "a bound is not finite"),
            F.when(machine & F.exists("thresholds", lambda t: ~F.array_contains("anchors", t["score"])), "a score has no anchor"),
        )
    )
    each = c.select("rubric", "id", F.explode(found).alias("problem"))
    twice = criteria.groupBy("rubric", "id").count().where("count > 1").select("rubric", "id", F.lit("id is not unique").alias("problem"))
    total = criteria.groupBy("rubric").agg(F.sum("weight").alias("w"))
    weights = total.where((F.col("w") <= 0) | (F.abs(F.col("w") - 1) > WEIGHT_TOLERANCE)).select("rubric", F.lit(None).cast("string").alias("id"), F.when(F.col("w") <= 0, "no positive weight").otherwise("weights do not sum to 1").alias("problem"))
    return each.unionByName(twice).unionByName(weights)


def missing_capabilities(required: Column, available: Column, known: list[str]) -> Column:
    """Required names that aren't available, sorted; a name that nobody knows is an error."""
    unknown = F.array_except(required, F.array(*map(F.lit, known)))
    return F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown capability: "), F.array_join(unknown, ",")))).otherwise(F.array_sort(F.array_except(required, available)))


def first_unmet(requires: Column, facts: Column) -> Column:
    """The first of the required predicates that facts (map of booleans) doesn't hold; null if it applies."""
    return F.try_element_at(F.filter(requires, lambda p: ~F.coalesce(F.try_element_at(facts, p), F.lit(False))), F.lit(1))


def oracles_for(tier: Column, domain: Column) -> Column:
    """Oracles that a task of this tier and domain runs, sorted."""
    rank = F.substring(tier, 2, 1).cast("int")
    wanted = [(F.lit(True), "O1"), (F.lit(True), "O3"), (rank == 4, "O2"), (domain.isin("triton", "pallas", "cuda", "jax", "pytorch") | rank.isin(1, 4), "O4"), (domain.isin("distributed", "checkpointing") | (rank == 6), "O5")]
    return F.array_sort(F.array_compact(F.array(*[F.when(when, name) for when, name in wanted])))


def refine_tier(tier: Column, kind: Column) -> Column:
    """A class's tier, corrected by how the fault showed; numeric and performance faults keep it."""
    return F.when(kind.isin("exception", "hang"), "T2").when(kind == "shape", "T3").when(kind == "loss_curve", "T6").otherwise(tier)


def first_marker(text: Column, markers: list[str]) -> Column:
    """The first of the markers that the lower-cased text contains; null without one."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(text), m)), F.lit(1))


def all_markers(text: Column, markers: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(text), m))


def leaked_lines(tasks: DataFrame) -> DataFrame:
    """(task_id, line): lines of at least 8 characters that the prompt shares with the baseline and that the mutant lacks.

    tasks(task_id, prompt, baseline, mutant).
    """
    lines = lambda c: tasks.select("task_id", F.explode(F.transform(F.split(c, "\n"), lambda x: F.trim(x))).alias("line")).where(F.length("line") >= 8).distinct()
    gone = lines("baseline").join(lines("mutant"), ["task_id", "line"], "left_anti")
    return gone.join(lines("prompt"), ["task_id", "line"])


def leaked_names(prompt: Column, names: Column) -> Column:
    """Names of at least 4 characters that the prompt contains."""
    return F.filter(names, lambda n: (F.length(n) >= 4) & F.contains(prompt, n))


def anti_cheat_verdict(checks: DataFrame) -> DataFrame:
    """(task_id, verdict): FAIL over ERROR; without a pass SKIP; a pass beside skips is a PASS."""
    v = F.col("verdict")
    return checks.groupBy("task_id").agg(F.when(F.bool_or(v == "FAIL"), "FAIL").when(F.bool_or(v == "ERROR"), "ERROR").when(~F.bool_or(v == "PASS"), "SKIP").otherwise("PASS").alias("verdict"))


def catchers(checks: DataFrame) -> DataFrame:
    """(task_id, catchers): distinct oracle/check names that failed, in the order in which they did."""
    first = checks.where("verdict = 'FAIL'").groupBy("task_id", F.concat_ws("/", "oracle", "check").alias("name")).agg(F.min("ord").alias("ord"))
    return first.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ",").alias("catchers"))


def suite(outcomes: DataFrame) -> DataFrame:
    """One row over outcomes(applies, expected, catcher, control): caught, missed, mismatched, false_positives, catch_rate, ok.

    A control is clean code: catching it is a false positive. Without attacks the rate is null.
    """
    attack = F.col("applies") & ~F.col("control")
    caught = F.col("catcher").isNotNull()
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return outcomes.agg(
        n(attack & caught).alias("caught"),
        n(attack & ~caught).alias("missed"),
        n(attack & caught & (F.col("catcher") != F.col("expected"))).alias("mismatched"),
        n(F.col("control") & caught).alias("false_positives"),
        F.try_divide(n(attack & caught).cast("double"), n(attack)).alias("catch_rate"),
        ((n(attack & ~caught) == 0) & (n(F.col("control") & caught) == 0)).alias("ok"),
    )


def attack_matrix(seeds: DataFrame, attacks: DataFrame) -> DataFrame:
    """Every attack on every seed: seeds(seed, facts map), attacks(id, requires array), with applies and why_not. A designed table of all pairs."""
    small = attacks.limit(MAX_BANK + 1).count() <= MAX_BANK
    each = seeds.join(F.broadcast(attacks) if small else attacks)
    return each.withColumn("why_not", first_unmet(F.col("requires"), F.col("facts"))).select("seed", "id", F.col("why_not").isNull().alias("applies"), "why_not")


def overlay(builtin: DataFrame, bank: DataFrame) -> DataFrame:
    """Bank rows over builtin rows of the same id."""
    return builtin.join(bank.select("id"), "id", "left_anti").unionByName(bank)


def new_findings(mutant: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings of (kind, detail), without dynamic_* ones that the baseline has too."""
    known = baseline.select("kind", "detail").distinct().where(F.col("kind").startswith("dynamic_"))
    return mutant.join(known, ["kind", "detail"], "left_anti")


def criteria_with_alphas(criteria: DataFrame, alphas: DataFrame) -> DataFrame:
    """Rubric criteria and measured alphas by id, both sides whole."""
    c = criteria.groupBy(F.col("id").alias("criterion")).agg(F.bool_or("machine_probed").alias("machine"), F.count("*").alias("n_rubrics"))
    return c.join(alphas.select("criterion", "alpha"), "criterion", "full_outer")


def profiler_stats(samples: DataFrame) -> DataFrame:
    """(metric, n, low, high, mean) of samples(metric, value as text); commas group thousands; what isn't a number is left out."""
    value = F.regexp_replace("value", ",", "").try_cast("double")
    return samples.select("metric", value.alias("v")).where("v is not null").groupBy("metric").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))


def partition_shapes(outcomes: DataFrame, limit: int = 24) -> DataFrame:
    """(task_id, name, ord, role) of outcomes(task_id, name, bytes, flops, usable, differs): cheapest first, at most limit a task; detect where the outputs differ, decoy where not."""
    w = Window.partitionBy("task_id").orderBy("bytes", "flops", "name")
    placed = outcomes.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= limit)
    return placed.where("usable").select("task_id", "name", "ord", F.when(F.col("differs"), "detect").otherwise("decoy").alias("role"))


def witnesses(partitioned: DataFrame) -> DataFrame:
    """(task_id, witness): the first shape that detects."""
    return partitioned.where("role = 'detect'").groupBy("task_id").agg(F.min_by("name", "ord").alias("witness"))


def dearest_shape(outcomes: DataFrame) -> DataFrame:
    """(task_id, name): the usable shape with most bytes, then flops; of equal ones the last by name."""
    w = Window.partitionBy("task_id").orderBy(F.desc("bytes"), F.desc("flops"), F.desc("name"))
    return outcomes.where("usable").withColumn("nth", F.row_number().over(w)).where("nth = 1").select("task_id", "name")


def performance_shapes(partitioned: DataFrame, k: int = 3) -> DataFrame:
    """The last k of each task's shapes that detect, or of all its shapes if none does; nth counts from the last."""
    detects = F.col("role") == "detect"
    pool = partitioned.withColumn("any", F.max(detects).over(Window.partitionBy("task_id"))).where(detects | ~F.col("any"))
    return pool.withColumn("nth", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("ord")))).where(F.col("nth") <= k).select("task_id", "name", "nth")


def truncate(text: Column, limit: int = 240) -> Column:
    """White space collapsed; text of more than limit characters is cut so that it has limit of them with three dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def neutral_links(text: Column) -> Column:
    """Both slashes behind a scheme as character references, so that no text reads as a link."""
    return F.replace(text, F.lit("://"), F.lit(":&#47;&#47;"))


def world_sizes(requested: DataFrame, available: int) -> DataFrame:
    """(size, reason): distinct requested sizes, with why one can't be run (null: it can)."""
    return requested.select("size").distinct().withColumn("reason", F.when(F.col("size") < 1, "not positive").when(F.col("size") == 1, "nothing to compare").when(F.col("size") > available, "more than there are"))
