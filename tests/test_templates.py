"""Templates and seed descriptions: escapes, what is refused before rows are read, and counters by hand."""

import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import descriptions as D
from plumbline.operators import templates as T


@given(st.text(alphabet="$${}a1_ é\n", max_size=14))
@settings(max_examples=800, deadline=None)
def test_parts_as_the_library_substitutes(text):
    """Against string.Template with values for some names and with none."""
    for values in ({"a": "<A>", "a1": "<A1>", "_": "<_>"}, {}):
        got = "".join(values.get(name, written) if name else written for name, written in T.parts(text))
        assert got == string.Template(text).safe_substitute(values)


def test_fill(spark):
    row = spark.createDataFrame([("f", None, 3)], "entry string, gone string, n int")
    values = {"entry": F.col("entry"), "gone": F.col("gone"), "n": F.col("n")}
    text = lambda t, **k: row.select(T.fill(t, values, **k)).first()[0]
    assert text("$entry() $$n ${n}x $5 ${ $") == "f() $n 3x $5 ${ $"
    assert text("") == "" and text("a $gone") is None
    assert text("$what ${who} $entry", strict=False) == "$what ${who} f"
    with pytest.raises(ValueError, match="unknown names what, who"):
        T.fill("$what ${who} $entry $what", values)


def test_instantiate(spark):
    rows = [(1, "def run(): 1", "run", True), (2, "def g(): 1\n", "run", True), (3, "def run(): 1", "run", None), (4, " \n", "run", True), (5, None, "run", True), (6, "def run(): 1", None, True)]
    targets = spark.createDataFrame(rows, "id long, base string, entry string, gpu boolean")
    bank = [T.Attack("a", "O1", "x", "  $entry()\n", ("gpu",), "two\nlines"), T.Attack("b", "O3", "y", "pass")]
    got = {(r.id, r.attack): r for r in T.instantiate(targets, bank, {"entry": F.col("entry")}, {"gpu": F.col("gpu")}, F.col("base"), F.col("entry")).collect()}
    assert len(got) == 12
    assert got[1, "a"].attack_text == "# attack: a\n# two lines\n# to be caught by: O1/x\n\ndef run(): 1\n\n_HONEST = run\n\nrun()\n"
    assert got[3, "a"].why_not == "not gpu" and got[3, "b"].why_not is None
    assert [got[k, "b"].why_not for k in (2, 4, 5, 6)] == ["the baseline has no run", "no baseline", "no baseline", "no entry"]
    assert got[6, "a"].why_not == "no value for entry"
    assert all((r.attack_text is None) == (r.why_not is not None) for r in got.values())
    assert T.instantiate(targets, [], {}, {}, F.col("base"), F.col("entry")).count() == 0
    for bad, why in ((T.Attack("c", "O1", "x", "p", ("tpu",)), "requires tpu"), (T.Attack("c", "O1", "x", "$q"), "attack c: unknown names q")):
        with pytest.raises(ValueError, match=why):
            T.instantiate(targets, [*bank, bad], {"entry": F.col("entry")}, {"gpu": F.col("gpu")}, F.col("base"), F.col("entry"))


def test_a_baseline_is_worked_out_once(spark):
    """However many attacks there are, the plan has the baseline's expression once."""
    targets = spark.createDataFrame([(1, "def f(): 0"), (2, " \n"), (3, None), (4, "g = 0\n")], "id long, text string")
    attacks = [T.Attack(f"a{k}", "O1", "c", "x") for k in range(5)]
    got = T.instantiate(targets, attacks, {}, {}, F.regexp_replace("text", "0", "1"), F.lit("f"))
    assert got._jdf.queryExecution().executedPlan().toString().count("regexp_replace(text") == 1
    rows = {(r.id, r.attack): (r.attack_text, r.why_not) for r in got.collect()}
    assert rows[1, "a4"] == ("# attack: a4\n# \n# to be caught by: O1/c\n\ndef f(): 1\n\n_HONEST = f\n\nx\n", None)
    assert [rows[k, "a0"][1] for k in (2, 3, 4)] == ["no baseline", "no baseline", "the baseline has no f"] and len(rows) == 20


def test_bank(spark):
    rows = spark.createDataFrame([("b", "O1", "x", "t", ["gpu"], 1), ("a", "O1", "x", "t", None, 2)], "id string, oracle string, check string, template string, requires array<string>, more int")
    assert [(a.id, a.requires, a.origin) for a in T.bank(rows)] == [("a", (), "bank"), ("b", ("gpu",), "bank")]
    with pytest.raises(ValueError, match="two attacks"):
        T.bank(rows.unionByName(rows))
    with pytest.raises(ValueError, match="no template"):
        T.bank(rows.withColumn("template", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="at most"):
        T.bank(spark.range(T.MAX_BANK + 1).select(F.col("id").cast("string").alias("id"), F.lit("o").alias("oracle"), F.lit("c").alias("check"), F.lit("t").alias("template")))
    with pytest.raises(ValueError, match="no check"):
        T.Attack("a", "O1", "", "t")


def test_counters_by_hand(spark):
    dims = lambda **k: {n: v if isinstance(v, list) else [v] for n, v in k.items()}
    rows = [
        ("reduction.blocked_layernorm", dims(rows=2, n_valid=1023, n_pad=1024), "bfloat16", (1023, 2 * (6 * 1023 + 2048 + 2046), 16 * 1023), None),
        ("reduction.blocked_layernorm", dims(rows=2, n_valid=0, n_pad=4), None, (1, 32, 0), None),
        ("quant.int4_dequant_matmul", dims(m=2, n=3, k_valid=5, k_pad=8, group_size=4), "float16", (5, 2 * (10 + 6) + 7 + 4 * (2 * 3 + 2), 60 + 30), None),
        ("dataloader.sharded_batch_stream", dims(n_samples=10, world_size=3, batch_size=2), None, (1, 4 * 3 * 16, 30), None),
        ("dataloader.sharded_batch_stream", dims(n_samples=10, world_size=3, batch_size=2, drop_last=1, epochs=2), None, (1, 2 * 3 * 2 * 16, 60), None),
        ("dataloader.sharded_batch_stream", dims(n_samples=0, world_size=3, batch_size=2), "odd", (1, 0, 0), None),
        ("collectives.ddp_train_step", dims(shard_sizes=[4, 0, 1], d=2, k=3, steps=2), None, (2 * (4 + 3 + 6 + 2), 2 * (10 + 5 + 18) * 4, 2 * (120 + 90)), None),
        ("checkpointing.save_and_resume", dims(n=2, d=3, h=4, k=1, resume_at=1, post_steps=1), None, (6, 2 * (6 + 112) * 8 + 16 * 96, 2 * (144 + 48 + 160)), None),
        ("autotune.cached_gemm", dims(m=[1, 2], n=[3, 4], k=[5, 6]), "float64", (6, (5 + 15 + 12 + 24) * 8 + (3 + 8) * 8, 2 * (15 + 48)), None),
        ("autotune.cached_gemm", dims(m=[1], n=[3]), None, None, "no dimension k"),
        ("matmul.tiled", dims(m=1, n=1, k_valid=1), "int8", None, "unknown dtype: int8"),
        ("nowhere", dims(m=1), None, None, "unknown seed: nowhere"),
        (None, None, None, None, "unknown seed: null"),
        ("matmul.tiled", None, None, None, "no dimension m"),
    ]
    shapes = spark.createDataFrame([(i, s, m, t) for i, (s, m, t, _, _) in enumerate(rows)], "i long, seed string, dims map<string,array<bigint>>, dtype string")
    for r in D.builtin().counters(shapes).collect():
        *_, wanted, error = rows[r.i]
        assert r.error == error, r
        assert (r.depth, r.moved, r.flops) == (wanted or (None, None, None)), r


def test_descriptions_are_checked(spark):
    one = lambda **k: D.Seed(**{"id": "s", "domain": "jax", "tiers": ("T1",), "entry": "f", "source": "def f(): 0", "dims": ("m",), "depth": lambda s: s.one("m"), "moved": lambda s: s.one("m"), "flops": lambda s: s.one("m"), **k})
    for wrong, why in (({"id": ""}, "needs an id"), ({"domain": "x"}, "unknown domain"), ({"tiers": ()}, "one tier"), ({"tiers": ("T9",)}, "unknown tiers"), ({"entry": "g"}, "has no g"), ({"entry": ""}, "needs an entry"), ({"tolerance": (-1.0, 0.0)}, "0 or more")):
        with pytest.raises(ValueError, match=why):
            one(**wrong)
    seeds = D.Seeds(one())
    with pytest.raises(ValueError, match="already"):
        seeds.register(one())
    with pytest.raises(ValueError, match="no dimension z"):
        seeds.register(one(id="t", flops=lambda s: s.one("z")))


def test_tolerances_are_picked_by_seed(spark):
    cells = spark.createDataFrame([(s, "y", 0, 1.0, 1.0 + 1e-6) for s in ("collectives.ddp_train_step", "checkpointing.save_and_resume", "dataloader.sharded_batch_stream", "matmul.tiled")], "seed string, name string, idx long, ref double, cand double")
    got = {r.seed: r.ok for r in D.builtin().compare(cells, F.lit(1e-5), F.lit(0.0)).collect()}
    assert got == {"collectives.ddp_train_step": True, "checkpointing.save_and_resume": False, "dataloader.sharded_batch_stream": False, "matmul.tiled": True}
