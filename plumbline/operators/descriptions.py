"""Descriptions of seeds: what a shape costs, as column expressions, and how outputs are compared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.taxonomy import DOMAINS, TIERS
from plumbline.operators import tensors
from plumbline.operators.seeds import ceil_div

# Bytes of an element by dtype.
ITEM_BYTES = {"float32": 4, "bfloat16": 2, "float16": 2}

# Relative and absolute tolerance of seeds that don't derive theirs.
FIXED_TOLERANCES = {
    "collectives.ddp_train_step": (2e-4, 2e-5),
    "checkpointing.save_and_resume": (1e-8, 1e-12),
    "dataloader.sharded_batch_stream": (0.0, 0.0),
    "autotune.cached_gemm": (1e-10, 1e-12),
}


@dataclass(frozen=True)
class Shape:
    """Dimensions of a shape row: dims is a map from a name to whole numbers, dtype a text."""

    seed: str
    known: tuple[str, ...]
    defaults: dict[str, int]

    def every(self, name: str) -> Column:
        """All numbers of a dimension."""
        if name not in self.known and name not in self.defaults:
            raise ValueError(f"seed {self.seed} has no dimension {name}; there are {', '.join([*self.known, *self.defaults])}")
        got = F.try_element_at("dims", F.lit(name))
        return F.coalesce(got, F.array(F.lit(self.defaults[name]).cast("long"))) if name in self.defaults else got

    def one(self, name: str) -> Column:
        """The first number of a dimension."""
        return F.try_element_at(self.every(name), F.lit(1))

    def total(self, name: str) -> Column:
        return F.aggregate(self.every(name), F.lit(0).cast("long"), lambda a, x: a + x)

    def item_bytes(self) -> Column:
        """Of dtype, float32 where it is null; null if it is unknown."""
        sizes = F.create_map(*[F.lit(v) for pair in ITEM_BYTES.items() for v in pair])
        return F.try_element_at(sizes, F.coalesce("dtype", F.lit("float32"))).cast("long")


Count = Callable[[Shape], Column]


@dataclass(frozen=True)
class Seed:
    """A seed: depth, moved and flops take a Shape and give whole numbers; tolerance is (relative, absolute), or None if derived."""

    id: str
    domain: str
    tiers: tuple[str, ...]
    entry: str
    source: str
    dims: tuple[str, ...]
    depth: Count
    moved: Count
    flops: Count
    defaults: tuple[tuple[str, int], ...] = ()
    tolerance: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        faults = {
            "a seed needs an id": not self.id,
            f"unknown domain {self.domain}": self.domain not in DOMAINS,
            "it needs one tier or more": not self.tiers,
            f"unknown tiers {[t for t in self.tiers if t not in TIERS]}": any(t not in TIERS for t in self.tiers),
            "it needs an entry": not self.entry,
            f"its source has no {self.entry}": bool(self.entry) and self.entry not in self.source,
            "tolerances are 0 or more": self.tolerance is not None and not all(t >= 0 for t in self.tolerance),
        }
        wrong = [text for text, is_so in faults.items() if is_so]
        if wrong:
            raise ValueError(f"seed {self.id or '?'}: {'; '.join(wrong)}")

    def shape(self) -> Shape:
        return Shape(self.id, self.dims, dict(self.defaults))


class Seeds:
    """Seeds by id; unlike a check, a second one of the same id is an error."""

    def __init__(self, *seeds: Seed) -> None:
        self.known: dict[str, Seed] = {}
        for seed in seeds:
            self.register(seed)

    def register(self, seed: Seed) -> Seed:
        """Adds a seed whose counters are expressions over its own dimensions; needs a Spark session."""
        if self.known.get(seed.id, seed) is not seed:
            raise ValueError(f"there is a seed {seed.id} already")
        for count in (seed.depth, seed.moved, seed.flops):
            count(seed.shape())
        self.known[seed.id] = seed
        return seed

    def _of(self, value: Callable[[Seed], Column], otherwise: Column) -> Column:
        for seed in self.known.values():
            otherwise = F.when(F.col("seed") == seed.id, value(seed)).otherwise(otherwise)
        return otherwise

    def counters(self, shapes: DataFrame) -> DataFrame:
        """shapes(seed, dims, dtype, ...) with depth, moved, flops and error, which names an unknown seed, the first dimension that is missing, or a dtype unknown to a seed that asks for its size.

        Rows with an error have no counters.
        """

        def fault(seed: Seed) -> Column:
            lacking = [F.when(F.coalesce(F.size(seed.shape().every(d)), F.lit(0)) == 0, d) for d in seed.dims]
            no_dtype = F.when(seed.moved(seed.shape()).isNull(), F.concat(F.lit("unknown dtype: "), F.coalesce("dtype", F.lit("null"))))
            return F.coalesce(F.concat(F.lit("no dimension "), F.coalesce(*lacking, F.lit(None))), no_dtype)

        nowhere = F.concat(F.lit("unknown seed: "), F.coalesce("seed", F.lit("null")))
        out = shapes.withColumn("error", self._of(fault, nowhere))
        count = lambda get: F.when(F.col("error").isNull(), self._of(lambda s: get(s)(s.shape()), F.lit(None).cast("long")).cast("long"))
        return out.withColumns({"depth": count(lambda s: s.depth), "moved": count(lambda s: s.moved), "flops": count(lambda s: s.flops)})

    def compare(self, cells: DataFrame, rel: Column, absolute: Column) -> DataFrame:
        """tensors.compare of cells(seed, name, idx, ref, cand) by (seed, name): a seed's own tolerances, or else rel and absolute, which are over cells."""
        own = lambda k: self._of(lambda s: F.lit(None if s.tolerance is None else s.tolerance[k]).cast("double"), F.lit(None).cast("double"))
        named = cells.withColumn("name", F.struct("seed", "name"))
        out = tensors.compare(named, F.coalesce(own(0), rel), F.coalesce(own(1), absolute))
        return out.select(F.col("name.seed").alias("seed"), F.col("name.name").alias("name"), *[c for c in out.columns if c != "name"])


def _product(shape: Shape, *names: str) -> Column:
    first, *rest = (shape.one(n) for n in names)
    for x in rest:
        first = first * x
    return first


def _at_least_one(name: str) -> Count:
    return lambda s: F.greatest(F.lit(1), s.one(name))


def _attention_moved(s: Shape) -> Column:
    return s.item_bytes() * _product(s, "batch", "heads", "head_dim") * 2 * (s.one("q_len") + s.one("n_ctx"))


def _matmul_moved(s: Shape) -> Column:
    return s.item_bytes() * (_product(s, "m", "k_valid") + _product(s, "k_valid", "n") + _product(s, "m", "n"))


def _quant_moved(s: Shape) -> Column:
    groups = F.greatest(F.lit(1), ceil_div(s.one("k_pad"), s.one("group_size")))
    weights = F.floor(_product(s, "k_valid", "n") / 2)  # two to a byte
    return s.item_bytes() * s.one("m") * (s.one("k_valid") + s.one("n")) + weights + 4 * groups * (s.one("n") + 1)


def _reduction_moved(s: Shape) -> Column:
    return s.item_bytes() * (s.one("rows") * (3 * s.one("n_valid") + s.one("n_pad")) + 2 * s.one("n_valid"))


def _stream_moved(s: Shape) -> Column:
    n, ranks, batch = s.one("n_samples"), s.one("world_size"), s.one("batch_size")
    whole = F.floor(F.floor(n / ranks) / batch) * batch
    return F.when(s.one("drop_last") != 0, whole).otherwise(ceil_div(n, ranks)) * ranks * s.one("epochs") * 16


def _ddp_depth(s: Shape) -> Column:
    return s.one("steps") * (F.array_max(s.every("shard_sizes")) + F.size(s.every("shard_sizes")) + _product(s, "d", "k") + s.one("n_param_shards"))


def _ddp_moved(s: Shape) -> Column:
    n = s.total("shard_sizes")
    return s.one("steps") * 4 * (n * s.one("d") + n + 3 * _product(s, "d", "k"))


def _ddp_flops(s: Shape) -> Column:
    return s.one("steps") * s.total("shard_sizes") * (4 * _product(s, "d", "k") + 6 * s.one("k"))


def _adam_steps(s: Shape) -> Column:
    return s.one("resume_at") + s.one("post_steps")


def _adam_parameters(s: Shape) -> Column:
    return s.one("h") * (s.one("d") + s.one("k"))


def _adam_moved(s: Shape) -> Column:
    p = _adam_parameters(s)
    return _adam_steps(s) * 8 * (_product(s, "n", "d") + 7 * p) + 96 * p


def _adam_flops(s: Shape) -> Column:
    p = _adam_parameters(s)
    return _adam_steps(s) * (6 * s.one("n") * p + 10 * p)


def _over_products(s: Shape, term: Callable[[Column, Column, Column], Column]) -> Column:
    """Sum over the products m n k, which stand at the same place of three dimensions."""
    each = F.transform(F.arrays_zip(s.every("m").alias("m"), s.every("n").alias("n"), s.every("k").alias("k")), lambda x: term(x["m"], x["n"], x["k"]))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def _tuned_moved(s: Shape) -> Column:
    item = F.when(F.coalesce("dtype", F.lit("float32")) == "float32", 4).otherwise(8)
    return _over_products(s, lambda m, n, k: (m * k + k * n) * item + m * n * 8)


def builtin(sources: dict[str, str] | None = None) -> Seeds:
    """The eight seeds; sources by id, or else a line that names the entry."""

    def seed(id: str, domain: str, tiers: str, entry: str, dims: str, depth: Count, moved: Count, flops: Count, **defaults: int) -> Seed:
        source = (sources or {}).get(id, f"def {entry}(): ...\n")
        return Seed(id, domain, tuple(tiers.split()), entry, source, tuple(dims.split()), depth, moved, flops, tuple(defaults.items()), FIXED_TOLERANCES.get(id))

    return Seeds(
        seed("attention.blocked_fwd", "triton", "T2 T3 T4 T5", "blocked_attention_fwd", "batch heads head_dim q_len n_ctx", _at_least_one("n_ctx"), _attention_moved, lambda s: 4 * _product(s, "batch", "heads", "q_len", "n_ctx", "head_dim")),
        seed("matmul.tiled", "cuda", "T2 T3 T4 T5", "tiled_matmul", "m n k_valid", _at_least_one("k_valid"), _matmul_moved, lambda s: 2 * _product(s, "m", "n", "k_valid")),
        seed("quant.int4_dequant_matmul", "cuda", "T2 T3 T4 T5", "int4_dequant_matmul", "m n k_valid k_pad group_size", _at_least_one("k_valid"), _quant_moved, lambda s: 2 * _product(s, "n", "k_valid") * (s.one("m") + 1)),
        seed("reduction.blocked_layernorm", "triton", "T2 T3 T4 T5", "blocked_layernorm_fwd", "rows n_valid n_pad", _at_least_one("n_valid"), _reduction_moved, lambda s: 8 * _product(s, "rows", "n_valid")),
        seed("dataloader.sharded_batch_stream", "data_pipeline", "T2 T3 T4", "batch_stream", "n_samples world_size batch_size", lambda s: F.lit(1), _stream_moved, lambda s: 3 * _product(s, "n_samples", "epochs"), epochs=1, drop_last=0),
        seed("collectives.ddp_train_step", "distributed", "T2 T3 T6", "train_step", "shard_sizes d k", _ddp_depth, _ddp_moved, _ddp_flops, steps=8, n_param_shards=2),
        seed("checkpointing.save_and_resume", "checkpointing", "T4 T5 T6", "save_and_resume", "n d h k", lambda s: _adam_steps(s) * (s.one("n") + 1), _adam_moved, _adam_flops, resume_at=6, post_steps=12),
        seed("autotune.cached_gemm", "pytorch", "T4 T5", "autotuned_gemm", "m n k", lambda s: F.greatest(F.lit(1), F.array_max(s.every("k"))), _tuned_moved, lambda s: _over_products(s, lambda m, n, k: 2 * m * n * k)),
    )
