"""Two-parameter item response models over (respondent, item, successes, trials)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import unit
from plumbline.operators import scans
from plumbline.operators.training import sigmoid, softplus
from plumbline.tables import cut

# Standard deviations of the priors, and bounds of the parameters.
SD_LOG_A, SD_B, SD_THETA = 0.7, 2.0, 1.0
MAX_LOG_A, MAX_B, MAX_THETA = 4.0, 8.0, 8.0


def icc(a: Column, b: Column, theta: Column) -> Column:
    """Probability of success: 1 / (1 + exp(-a (theta - b)))."""
    return sigmoid(a * (theta - b))


def information_peak(a: Column) -> Column:
    return a * a / 4


def seen(responses: DataFrame) -> DataFrame:
    """Responses with trials; a cell without is missing, not failed."""
    return responses.where("trials > 0 and successes is not null and not isnan(cast(successes as double))")


def terms(responses: DataFrame, items: DataFrame, people: DataFrame) -> DataFrame:
    """Responses with z = a (theta - b), the residual trials * p - successes and the likelihood term."""
    z = F.exp("log_a") * (F.col("theta") - F.col("b"))
    joined = seen(responses).join(items, "item").join(people, "respondent").withColumn("z", z)
    return joined.withColumns({"r": F.col("trials") * sigmoid(F.col("z")) - F.col("successes"), "nll": F.col("trials") * softplus(F.col("z")) - F.col("successes") * F.col("z")})


def neg_log_posterior(responses: DataFrame, items: DataFrame, people: DataFrame) -> DataFrame:
    """(value): negative log posterior, without constants, at items(item, log_a, b) and people(respondent, theta)."""
    half = lambda c, sd: F.sum(F.pow(F.col(c) / sd, F.lit(2))) / 2
    parts = terms(responses, items, people).agg(F.sum("nll").alias("v")).unionByName(items.agg((half("log_a", SD_LOG_A) + half("b", SD_B)).alias("v"))).unionByName(people.agg(half("theta", SD_THETA).alias("v")))
    return parts.agg(F.sum("v").alias("value"))


def gradients(responses: DataFrame, items: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, g_log_a, g_b) and (respondent, g_theta), with diagonal curvatures h_*, priors included."""
    t = terms(responses, items, people)
    a, p = F.exp("log_a"), sigmoid(F.col("z"))
    w = F.col("trials") * p * (1 - p)
    of_item = t.groupBy("item").agg(F.sum(F.col("r") * F.col("z")).alias("ga"), F.sum(-F.col("r") * a).alias("gb"), F.sum(w * F.col("z") * F.col("z")).alias("ha"), F.sum(w * a * a).alias("hb"))
    of_person = t.groupBy("respondent").agg(F.sum(F.col("r") * a).alias("gt"), F.sum(w * a * a).alias("ht"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    gi = items.join(of_item, "item", "left").select("item", "log_a", "b", (zero("ga") + F.col("log_a") / SD_LOG_A**2).alias("g_log_a"), (zero("gb") + F.col("b") / SD_B**2).alias("g_b"), (zero("ha") + 1 / SD_LOG_A**2).alias("h_log_a"), (zero("hb") + 1 / SD_B**2).alias("h_b"))
    gp = people.join(of_person, "respondent", "left").select("respondent", "theta", (zero("gt") + F.col("theta") / SD_THETA**2).alias("g_theta"), (zero("ht") + 1 / SD_THETA**2).alias("h_theta"))
    return gi, gp


def start(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First parameters from clipped logits of the success shares."""
    logit = lambda: (lambda p: F.log(p / (1 - p)))(F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.sum("successes") / F.sum("trials"))))
    rows = seen(responses)
    items = rows.groupBy("item").agg(F.lit(0.0).alias("log_a"), (-logit()).alias("b"))
    return items, rows.groupBy("respondent").agg(logit().alias("theta"))


class Fit(NamedTuple):
    """items(item, log_a, b) and people(respondent, theta) at the posterior mode, and how it was reached."""

    items: DataFrame
    people: DataFrame
    value: float
    steps: int
    evaluations: int
    converged: bool


#: Items and respondents whose numbers the driver holds.
MAX_ON_DRIVER = 50_000
#: Cells of respondents and items that the driver holds.
MAX_CELLS = 1_000_000
#: Parameters that are broadcast to the responses; more of them meet in a join.
MAX_BROADCAST = 200_000
_PAIR = ("1", "2")


def _variables(items: DataFrame, people: DataFrame) -> DataFrame:
    """One row for each item (kind 0: log_a, b) and respondent (kind 1: theta, nothing)."""
    return items.select(F.lit(0).alias("kind"), F.col("item").alias("id"), F.col("log_a").alias("x1"), F.col("b").alias("x2")).unionByName(people.select(F.lit(1).alias("kind"), F.col("respondent").alias("id"), F.col("theta").alias("x1"), F.lit(0.0).alias("x2")))


def _tables(at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items(item, log_a, b) and people(respondent, theta) of such rows."""
    return at.where("kind = 0").select(F.col("id").alias("item"), F.col("x1").alias("log_a"), F.col("x2").alias("b")), at.where("kind = 1").select(F.col("id").alias("respondent"), F.col("x1").alias("theta"))


def _evaluated(responses: DataFrame, at: DataFrame, few: tuple[bool, bool]) -> DataFrame:
    """at(kind, id, x1, x2, ...) with its gradient f1, f2, curvatures h1, h2 and its part v of the negative log posterior."""
    items, people = _tables(at)
    t = terms(responses, F.broadcast(items) if few[0] else items, F.broadcast(people) if few[1] else people)
    a, p = F.exp("log_a"), sigmoid(F.col("z"))
    w = F.col("trials") * p * (1 - p)
    sums = lambda key, kind, *c: t.groupBy(key).agg(*[F.sum(x).alias(n) for n, x in zip(("r1", "r2", "w1", "w2", "nll"), c, strict=True)]).withColumnRenamed(key, "id").withColumn("kind", F.lit(kind))
    none = F.lit(0.0)
    both = sums("item", 0, F.col("r") * F.col("z"), -F.col("r") * a, w * F.col("z") * F.col("z"), w * a * a, none).unionByName(sums("respondent", 1, F.col("r") * a, none, w * a * a, none, F.col("nll")))
    sd = {"1": F.when(F.col("kind") == 0, SD_LOG_A).otherwise(SD_THETA), "2": F.lit(SD_B)}
    zero = lambda c: F.coalesce(c, none)
    out = at.join(both, ["kind", "id"], "left")
    prior = sum((F.pow(F.col(f"x{k}") / sd[k], F.lit(2)) / 2 for k in _PAIR), start=none)
    return out.withColumns({"v": zero("nll") + prior, **{f"f{k}": zero(f"r{k}") + F.col(f"x{k}") / sd[k] ** 2 for k in _PAIR}, **{f"h{k}": zero(f"w{k}") + 1 / sd[k] ** 2 for k in _PAIR}}).drop("r1", "r2", "w1", "w2", "nll")


def _most(k: str) -> str:
    return f"if(kind = 0, {MAX_LOG_A if k == '1' else MAX_B}D, {MAX_THETA}D)"


def _pushed(k: str) -> str:
    """The gradient in scaled variables, nothing where it only pushes against a bound."""
    return f"if((x{k} <= -{_most(k)} and g{k} > 0) or (x{k} >= {_most(k)} and g{k} < 0), 0D, g{k} * c{k})"


def _downhill(dots: dict[tuple[int, int], float], kept: list[int], n: int) -> dict[int, float]:
    """Weights of moves, changes of the gradient (behind n) and the gradient (2 n) in the quasi-Newton direction, by the two-loop recursion on their products."""
    dot = lambda i, j: dots[min(i, j), max(i, j)]
    weight, alpha = {2 * n: -1.0}, {}
    for i in reversed(kept):
        alpha[i] = sum(w * dot(j, i) for j, w in weight.items()) / dot(i, n + i)
        weight[n + i] = weight.get(n + i, 0.0) - alpha[i]
    if kept:
        scale = dot(kept[-1], n + kept[-1]) / dot(n + kept[-1], n + kept[-1])
        weight = {j: w * scale for j, w in weight.items()}
    for i in kept:
        beta = sum(w * dot(j, n + i) for j, w in weight.items()) / dot(i, n + i)
        weight[i] = weight.get(i, 0.0) + alpha[i] - beta
    return weight


def _priors(n_items: int, n_people: int) -> tuple[np.ndarray, np.ndarray]:
    """(deviations of the priors, bounds) of all log_a, all b and all theta."""
    sizes = (n_items, n_items, n_people)
    return np.repeat([SD_LOG_A, SD_B, SD_THETA], sizes), np.repeat([MAX_LOG_A, MAX_B, MAX_THETA], sizes)


def _sums(x: np.ndarray, n: int, i: np.ndarray, p: np.ndarray, hit: np.ndarray, trials: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """What cells of items i (n in all) and respondents p add to the negative log posterior, its gradient and its curvatures at x."""
    g, h = np.zeros(len(x)), np.zeros(len(x))
    a = np.exp(x[i])
    z = a * (x[2 * n + p] - x[n + i])
    r, w = trials / (1 + np.exp(-z)) - hit, trials / (2 + np.exp(z) + np.exp(-z))
    for at, first, second in ((i, r * z, w * z * z), (n + i, -r * a, w * a * a), (2 * n + p, r * a, w * a * a)):
        g += np.bincount(at, first, len(x))
        h += np.bincount(at, second, len(x))
    return float((trials * np.logaddexp(0, z) - hit * z).sum()), g, h


def _evaluator(responses: DataFrame, item: list[Row], person: list[Row], max_cells: int = 0) -> Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]:
    """The negative log posterior, its gradient and its curvatures at numbers of the driver: one aggregation over the responses for each
    call, or, where respondents and items have at most max_cells cells, over cells that were summed up once."""
    spark = responses.sparkSession
    n, sizes = len(item), 2 * len(item) + len(person)
    code = lambda rows, key, name: F.broadcast(spark.createDataFrame([(r[key], k) for k, r in enumerate(rows)], f"{key} string, {name} int"))
    coded = responses.join(code(item, "item", "i"), "item").join(code(person, "respondent", "p"), "respondent").select("i", "p", F.col("successes").cast("double").alias("hit"), F.col("trials").cast("double").alias("n"))
    sd, _ = _priors(n, len(person))
    prior = lambda x: (float((x * x / sd**2).sum() / 2), x / sd**2, 1 / sd**2)
    if max_cells:
        cells = cut(coded.groupBy("i", "p").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")))
        if cells.limit(max_cells + 1).count() <= max_cells:
            i, p, hit, trials = (np.asarray(c) for c in zip(*cells.orderBy("i", "p").collect(), strict=True))
            return lambda x: tuple(mine + more for mine, more in zip(prior(x), _sums(x, n, i, p, hit, trials), strict=True))
        coded = cells
    else:
        coded = cut(coded)

    def evaluated(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast(x)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, g, h, value = shared.value, np.zeros(sizes), np.zeros(sizes), 0.0
            for batch in batches:
                more, more_g, more_h = _sums(x, n, *(c.to_numpy() for c in batch.columns))
                value, g, h = value + more, g + more_g, h + more_h
            used = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(g[used], value)), pa.array(np.append(h[used], 0.0))], ["k", "g", "h"])

        value, g, h = prior(x)
        for k, more_g, more_h in coded.mapInArrow(part, "k int, g double, h double").groupBy("k").agg(F.sum("g"), F.sum("h")).collect():
            if k < 0:
                value += more_g
            else:
                g[k] += more_g
                h[k] += more_h
        shared.unpersist()
        return value, g, h

    return evaluated


def _from_driver(spark: SparkSession, x: np.ndarray, item: list[Row], person: list[Row]) -> tuple[DataFrame, DataFrame]:
    n = len(item)
    found = spark.createDataFrame([(r.item, float(x[k]), float(x[n + k])) for k, r in enumerate(item)], "item string, log_a double, b double")
    return found, spark.createDataFrame([(r.respondent, float(x[2 * n + k])) for k, r in enumerate(person)], "respondent string, theta double")


def _fit_few(responses: DataFrame, items: DataFrame, people: DataFrame, steps: int, memory: int, tolerance: float) -> tuple[DataFrame, DataFrame, float, int, int, bool]:
    """The same steps with the variables, few enough, on the driver; each evaluation is one aggregation over the responses."""
    item, person = items.orderBy("item").collect(), people.orderBy("respondent").collect()
    evaluated, most = _evaluator(responses, item, person), _priors(len(item), len(person))[1]
    x = np.array([r.log_a for r in item] + [r.b for r in item] + [r.theta for r in person])
    value, g, h = evaluated(x)
    scale, evaluations, taken, converged = 1 / np.sqrt(h), 1, 0, False
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    while taken < steps and not converged:
        free = ~(((x <= -most) & (g > 0)) | ((x >= most) & (g < 0)))
        vectors = [s for s, _ in moves] + [y for _, y in moves] + [g * scale * free]
        table = np.array(vectors) @ np.array(vectors).T
        weight = _downhill({(i, j): table[i, j] for i in range(len(vectors)) for j in range(i, len(vectors))}, list(range(len(moves))), len(moves))
        direction = sum(w * vectors[j] for j, w in weight.items()) * scale * free
        direction = direction if direction @ g < 0 else -g * scale**2 * free
        length = 1.0
        while True:
            to = np.clip(x + length * direction, -most, most)
            found, at, _ = evaluated(to)
            evaluations += 1
            if found <= value + 1e-4 * (g @ (to - x)) or length < 1e-6:
                break
            length /= 2
        converged = value - found <= tolerance * max(1.0, abs(value))
        if found <= value:
            s, y = (to - x) / scale, (at - g) * scale
            moves = (moves + [(s, y)] * bool(s @ y > 0))[-memory:]
            x, g, value, taken = to, at, found, taken + 1
    return *_from_driver(responses.sparkSession, x, item, person), value, taken, evaluations, converged


def fit(responses: DataFrame, steps: int = 200, memory: int = 8, tolerance: float = 1e-11, max_on_driver: int = MAX_ON_DRIVER) -> Fit:
    """The posterior mode within the bounds, abilities standardised, by limited-memory quasi-Newton steps.

    Variables are scaled by the curvature at the start; those at a bound that the gradient pushes outwards rest.
    Cells without trials are missing; converged: the posterior gained no more than tolerance of itself. Items and respondents up to
    max_on_driver keep their numbers on the driver; more of them are a table.
    """
    return _standardised(responses, max_on_driver, _fit_few, _fit_many, steps, memory, tolerance)


def newton_rounds(responses: DataFrame, rounds: int = 5000, damping: float = 0.6, max_on_driver: int = MAX_ON_DRIVER, max_cells: int = MAX_CELLS) -> Fit:
    """Where so many damped Newton rounds with diagonal curvatures come to, abilities standardised.

    All numbers move at once, by damping times their Newton step (at most one) and within the bounds. That nears the posterior mode slowly,
    fit() gets there sooner; but a given round is a result that any engine can repeat. Cells as in fit(); converged: the last round moved
    no number by more than 1e-9. A round is a pass over the responses only where they have more than max_cells cells.
    """
    return _standardised(responses, max_on_driver, _rounds_few, _rounds_many, rounds, damping, max_cells)


def _rounds_few(responses: DataFrame, items: DataFrame, people: DataFrame, rounds: int, damping: float, max_cells: int) -> tuple[DataFrame, DataFrame, float, int, int, bool]:
    item, person = items.orderBy("item").collect(), people.orderBy("respondent").collect()
    evaluated, most = _evaluator(responses, item, person, max_cells), _priors(len(item), len(person))[1]
    x, moved = np.array([r.log_a for r in item] + [r.b for r in item] + [r.theta for r in person]), math.inf
    value, g, h = evaluated(x)
    for _ in range(rounds):
        to = np.clip(x - damping * np.clip(g / h, -1, 1), -most, most)
        x, moved = to, float(np.abs(to - x).max())
        value, g, h = evaluated(x)
    return *_from_driver(responses.sparkSession, x, item, person), value, rounds, rounds + 1, moved <= 1e-9


def _rounds_many(responses: DataFrame, items: DataFrame, people: DataFrame, rounds: int, damping: float, max_cells: int) -> tuple[DataFrame, DataFrame, float, int, int, bool]:
    """The same rounds with all variables in a table, one pass over the responses for each."""
    state = cut(_variables(items, people))
    counts = {r.kind: r["count"] for r in state.groupBy("kind").count().collect()}
    few, moved = (counts[0] <= MAX_BROADCAST, counts[1] <= MAX_BROADCAST), math.inf
    moves = [f"greatest(-{_most(k)}, least({_most(k)}, x{k} - {damping}D * greatest(-1D, least(1D, f{k} / h{k})))) as x{k}" for k in _PAIR]
    for _ in range(rounds):
        last, state = state, cut(_evaluated(responses, state, few).selectExpr("kind", "id", *moves))
    if rounds:
        both = state.join(last.select("kind", "id", *[F.col(f"x{k}").alias(f"o{k}") for k in _PAIR]), ["kind", "id"])
        moved = both.agg(F.max(F.greatest(*[F.abs(F.col(f"x{k}") - F.col(f"o{k}")) for k in _PAIR]))).first()[0]
    value = _evaluated(responses, state, few).agg(F.sum("v")).first()[0]
    return *_tables(state), value, rounds, rounds + 1, moved <= 1e-9


def _standardised(responses: DataFrame, max_on_driver: int, on_driver: Callable, in_table: Callable, *how) -> Fit:
    """The fit by one of two ways, depending on how many items and respondents there are, with abilities of mean 0 and deviation 1."""
    kinds = {c: responses.schema[c].dataType for c in ("item", "respondent")}
    responses = cut(seen(responses).withColumns({c: F.col(c).cast("string") for c in kinds}).repartition("respondent"))
    items, people = (cut(x) for x in start(responses))
    if not items.limit(1).count():
        raise ValueError("there are no responses to fit")
    few = items.limit(max_on_driver + 1).count() + people.limit(max_on_driver + 1).count() <= max_on_driver
    items, people, *reached = (on_driver if few else in_table)(responses, items, people, *how)
    items, people = (x.withColumn(c, F.col(c).cast(kinds[c])) for x, c in ((items, "item"), (people, "respondent")))
    s = people.agg(F.avg("theta").alias("m"), F.stddev_pop("theta").alias("s")).first()
    spread = s.s if s.s and s.s >= 1e-6 else 1.0
    items = items.select("item", (F.col("log_a") + math.log(spread)).alias("log_a"), ((F.col("b") - s.m) / spread).alias("b"))
    return Fit(items, people.select("respondent", ((F.col("theta") - s.m) / spread).alias("theta")), *reached)


def _fit_many(responses: DataFrame, items: DataFrame, people: DataFrame, steps: int, memory: int, tolerance: float) -> tuple[DataFrame, DataFrame, float, int, int, bool]:
    """Steps with all variables in a table.

    Gradient and the last few moves with their changes of the gradient are its columns; a step takes all their
    products in one aggregation, finds its direction from these numbers, and evaluates the posterior in one pass over the responses for
    each trial length.
    """
    spark = responses.sparkSession
    first = cut(_variables(items, people))
    counts = {r.kind: r["count"] for r in first.groupBy("kind").count().collect()}
    few = (counts[0] <= MAX_BROADCAST, counts[1] <= MAX_BROADCAST)
    places = range(memory)
    vectors = {k: [*(f"{name}{k}[{i}]" for name in ("s", "y") for i in places), f"p{k}"] for k in _PAIR}  # SQL is built faster than columns are
    with_pushed = lambda state: state.selectExpr("*", *[f"{_pushed(k)} as p{k}" for k in _PAIR])

    def measured(state: DataFrame) -> Row:
        """The posterior, what a straight line would have changed it by, and all products of moves, changes and gradient."""
        both = list(zip(*vectors.values(), strict=True))
        dots = [f"sum({a[0]} * {b[0]} + {a[1]} * {b[1]}) as d{i}_{j}" for i, a in enumerate(both) for j, b in enumerate(both) if i <= j]
        return with_pushed(state).agg(*map(F.expr, ["sum(v) as value", "sum(slope) as slope", *dots])).first()

    def columns(state: DataFrame, *more: Column) -> DataFrame:
        return cut(state.select("kind", "id", "x1", "x2", F.col("f1").alias("g1"), F.col("f2").alias("g2"), "v", *more))

    none = F.array(*[F.lit(0.0)] * memory)
    state = columns(_evaluated(responses, first, few), *[(1 / F.sqrt(f"h{k}")).alias(f"c{k}") for k in _PAIR], *[none.alias(f"{name}{k}") for name in ("s", "y") for k in _PAIR], F.lit(0.0).alias("slope"))
    now, evaluations, converged, taken = measured(state), 1, False, 0
    while taken < steps and not converged:
        dots = {tuple(map(int, name[1:].split("_"))): now[name] for name in now.asDict() if name[0] == "d"}
        kept = [i for i in places if dots[i, memory + i] > 0]
        weight = _downhill(dots, kept, memory)
        if sum(w * dots[j, 2 * memory] for j, w in weight.items()) >= 0:
            weight = {2 * memory: -1.0}
        length = 1.0
        while True:
            # numbers that change come from a table of one row, so that each step's plan is the same and compiled once
            row = spark.createDataFrame([([weight.get(j, 0.0) for j in range(2 * memory + 1)], length)], "w array<double>, length double")
            moves = [f"greatest(-{_most(k)}, least({_most(k)}, x{k} + length * c{k} * if(p{k} = 0, 0D, {' + '.join(f'w[{j}] * {v}' for j, v in enumerate(vectors[k]))}))) as x{k}" for k in _PAIR]
            trial = with_pushed(state).crossJoin(F.broadcast(row)).selectExpr("kind", "id", "c1", "c2", "s1", "s2", "y1", "y2", "g1", "g2", "x1 as o1", "x2 as o2", *moves)  # one row
            last = lambda c, more: F.slice(F.concat(F.col(c), F.array(more)), 2, memory).alias(c)
            history = [x for k in _PAIR for x in (last(f"s{k}", (F.col(f"x{k}") - F.col(f"o{k}")) / F.col(f"c{k}")), last(f"y{k}", (F.col(f"f{k}") - F.col(f"g{k}")) * F.col(f"c{k}")))]
            slope = sum((F.col(f"g{k}") * (F.col(f"x{k}") - F.col(f"o{k}")) for k in _PAIR), start=F.lit(0.0)).alias("slope")
            after = columns(_evaluated(responses, trial, few), "c1", "c2", *history, slope)
            found = measured(after)
            evaluations += 1
            if found.value <= now.value + 1e-4 * found.slope or length < 1e-6:
                break
            length /= 2
        converged = now.value - found.value <= tolerance * max(1.0, abs(now.value))
        if found.value <= now.value:
            state, now, taken = after, found, taken + 1
    return *_tables(state), now.value, taken, evaluations, converged


def simulate(items: DataFrame, people: DataFrame, trials: int, seed: str = "irt") -> DataFrame:
    """Responses of every respondent to every item: a designed table of all pairs, with hashed draws."""
    p = icc(F.exp("log_a"), F.col("b"), F.col("theta"))
    throws = F.sequence(F.lit(1), F.lit(trials))
    hits = F.size(F.filter(throws, lambda k: unit(F.lit(seed), F.col("respondent"), F.col("item"), k) < p))
    return people.crossJoin(items).select("respondent", "item", hits.cast("long").alias("successes"), F.lit(trials).cast("long").alias("trials"))


def item_stats(items: DataFrame) -> DataFrame:
    """items with discrimination a, information peak and place by falling a, then item."""
    out = items.withColumn("a", F.exp("log_a"))
    return scans.numbered(out.withColumn("peak", information_peak(F.col("a"))), [F.desc("a"), "item"], "place")


def response_curve(items: DataFrame, points: int = 81, low: float = -4.0, high: float = 4.0) -> DataFrame:
    """(item, theta, p) on a grid of abilities."""
    step = (high - low) / (points - 1)
    grid = items.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("theta", low + F.col("g") * step)
    return grid.select("item", F.col("g").alias("point"), "theta", icc(F.exp("log_a"), F.col("b"), F.col("theta")).alias("p"))
