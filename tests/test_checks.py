"""The registry of user checks, and the fit of item response."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks, irt
from plumbline.plans import seeds


def test_registry():
    known = checks.Checks(checks.Check("a", lambda o: F.lit("PASS")))
    with pytest.warns(UserWarning, match="replaced"):
        known.register(checks.Check("a", lambda o: F.lit("FAIL")))
    with pytest.raises(ValueError):
        known.register(checks.Check("", lambda o: F.lit("PASS")))


def test_verdicts(spark):
    tasks = spark.createDataFrame([(1, 4.0), (2, None), (3, 0.0)], "task_id long, x double")
    known = checks.Checks(
        checks.Check("half", lambda o: F.when(F.try_divide(F.lit(o["top"]), F.col("x")) > 1, "PASS").when(F.col("x").isNotNull(), "ODD"), applies=lambda o: F.col("x").isNull() | (F.col("x") < 4)),
        checks.Check("maybe", lambda o: F.lit("PASS"), applies=lambda o: F.col("x") > 0),
        checks.Check("mute", lambda o: F.lit("FAIL")),
    )
    got = sorted(map(tuple, known.run(tasks, options={"top": 8}).select("task_id", "check", "verdict", "reason").collect()))
    assert got == [
        (1, "maybe", "PASS", None),
        (1, "mute", "ERROR", "no reason for FAIL"),
        (2, "half", "ERROR", "no verdict: null"),
        (2, "maybe", "ERROR", "it is not known whether the check applies"),
        (2, "mute", "ERROR", "no reason for FAIL"),
        (3, "half", "ERROR", "no verdict: ODD"),
        (3, "mute", "ERROR", "no reason for FAIL"),
    ]
    asked = known.run(tasks.withColumn("checks", F.array(F.lit("none"))), options={"top": 8}, ids=["half"])
    assert {r.check for r in asked.collect()} == {"half"}
    assert checks.selected(tasks, "task_id", "all").count() == 3 and checks.selected(tasks, "task_id", "1, 3").count() == 2


def _newton(responses, rounds):
    """(negative log posterior, items, people) by damped diagonal Newton rounds in numpy."""
    i, item = np.unique(responses["item"], return_inverse=True)
    p, person = np.unique(responses["respondent"], return_inverse=True)
    hit, n = responses["successes"].to_numpy(float), responses["trials"].to_numpy(float)
    log_a, b, theta = np.zeros(len(i)), np.zeros(len(i)), np.zeros(len(p))
    for k in range(rounds + 1):
        a = np.exp(log_a)[item]
        z = a * (theta[person] - b[item])
        value = (n * np.logaddexp(0, z) - hit * z).sum() + (log_a**2).sum() / 2 / 0.7**2 + (b**2).sum() / 8 + (theta**2).sum() / 2
        r, w = n / (1 + np.exp(-z)) - hit, n / (2 + np.exp(z) + np.exp(-z))
        if k < rounds:
            total = lambda x, of, m: np.bincount(of, x, m)
            steps = [(total(r * z, item, len(i)) + log_a / 0.49) / (total(w * z * z, item, len(i)) + 1 / 0.49), (total(-r * a, item, len(i)) + b / 4) / (total(w * a * a, item, len(i)) + 0.25), (total(r * a, person, len(p)) + theta) / (total(w * a * a, person, len(p)) + 1)]
            log_a, b, theta = (x - 0.6 * np.clip(s, -1, 1) for x, s in zip((log_a, b, theta), steps))
    return value, dict(zip(i, log_a + np.log(theta.std()))), dict(zip(p, (theta - theta.mean()) / theta.std()))


def test_fit_finds_what_was_drawn(spark):
    """Parameters of a drawn table come back, people keep their order, and the posterior is that of many Newton rounds after few steps."""
    items = spark.createDataFrame([(f"i{k}", [-0.4, 0.0, 0.5][k % 3], -1.5 + 0.3 * k) for k in range(11)], "item string, log_a double, b double")
    people = spark.createDataFrame([(f"p{k}", -2.0 + 4.0 * k / 39) for k in range(40)], "respondent string, theta double")
    responses = irt.simulate(items, people, 20).checkpoint()
    found = irt.fit(responses)
    both = items.alias("t").join(found.items.alias("f"), "item").select("t.b", "f.b", "t.log_a", "f.log_a").toPandas().to_numpy()
    ability = people.alias("t").join(found.people.alias("f"), "respondent").select("t.theta", "f.theta").toPandas().to_numpy()
    assert np.corrcoef(both[:, 0], both[:, 1])[0, 1] > 0.97 and np.corrcoef(both[:, 2], both[:, 3])[0, 1] > 0.7
    assert np.corrcoef(ability[:, 0], ability[:, 1])[0, 1] > 0.97
    assert abs(ability[:, 1].mean()) < 1e-6 and abs(ability[:, 1].std() - 1) < 1e-6
    best = _newton(responses.toPandas(), 6000)[0]
    assert found.converged and found.value == pytest.approx(best, abs=1e-4) and found.evaluations < 90
    # the same steps with the variables in a table
    few, many = irt.fit(responses, steps=2), irt.fit(responses, steps=2, max_on_driver=0)
    assert (many.steps, many.evaluations) == (few.steps, few.evaluations) and many.value == pytest.approx(few.value, abs=1e-6)
    own = {r.item: r.b for r in few.items.collect()}
    assert {r.item: r.b for r in many.items.collect()} == pytest.approx(own, abs=1e-6)


def test_fit_query_over_many_events(spark, sf_dir, duck, tmp_path):
    """Over tables on which 5,000 rounds end short of the mode, the query still gives what its SQL gives."""
    n, users = duck.execute("SELECT max(event_id) + 1, max(user_id) + 1 FROM events").fetchone()
    shifted = f"SELECT * REPLACE (CAST(event_id + k * {n} AS BIGINT) AS event_id, CAST(user_id + k * {users} AS BIGINT) AS user_id) FROM events, (SELECT unnest(range(0, 200)) AS k)"
    duck.execute(f"COPY ({shifted}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    wanted = duck.execute(seeds.ORACLE_SQL["e09_fit"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).fetchall()
    got = seeds.QUERIES["e09_fit"](spark, str(tmp_path)).select("kind", "id", "first", "second").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_newton_rounds(spark):
    """Cells or numbers on the driver or in a table: a round is the same, and many end where numpy's do; several rows of a cell count together."""
    rows = [(f"p{p}", f"i{i}", (p * 7 + i * 3 + half) % 4, 4) for p in range(12) for i in range(5) for half in range(2) if (p + i) % 6]
    responses = spark.createDataFrame([*rows, ("p0", "i1", 0, 0)], "respondent string, item string, successes long, trials long").checkpoint()
    numbers = lambda found: (found.value, {r[0]: r[1] for r in found.items.collect()}, {r[0]: r[1] for r in found.people.collect()})
    value, log_a, theta = numbers(irt.newton_rounds(responses, 3))
    for how in ({"max_cells": 0}, {"max_cells": 3}, {"max_on_driver": 0}):
        found = irt.newton_rounds(responses, 3, **how)
        assert (found.steps, found.converged) == (3, False)
        assert numbers(found) == (pytest.approx(value, abs=1e-9), pytest.approx(log_a, abs=1e-9), pytest.approx(theta, abs=1e-9))
    found, (value, log_a, theta) = irt.newton_rounds(responses, 3000), _newton(responses.where("trials > 0").toPandas(), 3000)
    assert found.converged and numbers(found) == (pytest.approx(value, abs=1e-9), pytest.approx(log_a, abs=1e-7), pytest.approx(theta, abs=1e-7))
