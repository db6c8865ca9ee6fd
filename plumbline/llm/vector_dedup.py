"""Near duplicates among vectors: links by cosine, through inverted lists and product-quantised residuals.

Equal vectors are one entry with a weight. Lists stand around vectors that are
drawn by hash, about 4 * sqrt(rows) of them and none within BALL of another. An entry is in
the list of its nearest centre; its residual is coded by the nearest codeword in
each subspace, and the exact length of what the code leaves over is kept.

A vector looks into its own list and into those beyond whose border it may have a
link: a link's length is LIMIT at most, and in a random direction its share across
the border is normal with a deviation of LIMIT / sqrt(d), so that all lists within MARGIN such
deviations are probed. d is the number of dimensions that the sample really uses.
Each pair of lists is probed from one side only, so that no pair is met twice.

In a list, the distance of a vector to every decoded entry is summed from a table of
its products with the codewords. With what the codes leave over, distances are
bounded on both sides: pairs beyond the limit go, the rest are computed exactly.

Of a list of many close vectors those within BALL of the centre are all linked with
each other. They are a ball: a vector near enough to the centre is linked
with all of them, one far enough with none, and only those between meet the members. So a group of
near copies that holds a third of all rows costs no more than its number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.shared import cut

MIN_COSINE = 0.9
#: Lists are LISTS * sqrt(rows); rows, expected, that the codewords and the dimensions are fitted on.
LISTS, FIT_ROWS = 4, 16_384
SUBSPACES, CODEWORDS, FIT_ROUNDS = 8, 256, 6
#: Deviations across a border within which lists are probed.
MARGIN = 3.0
#: Members from which the inner part of a list is a ball.
BALL_ROWS = 32
#: Entries and looking vectors that meet in one task.
SHARD_ROWS, LOOKING_ROWS = 8192, 8192
_CELLS = 1 << 20
#: What single precision may add to a distance, and double precision.
_SINGLE, _DOUBLE = 1e-3, 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _padded(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows filled up with zeros to size, their lengths)."""
    length = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), size))
    out[np.arange(size) < length[:, None]] = column.flatten().to_numpy()
    return out, length


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def _bytes(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


def _from_bytes(column: pa.Array, kind) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1 if rows else 0)


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


class Index:
    """Centres, codewords and the probing rule; small: centres grow with the root of the rows."""

    def __init__(self, centres: np.ndarray, sample: np.ndarray, limit: float):
        self.limit, self.ball = limit, limit / 2
        self.centres = self._thinned(centres)
        spread = np.linalg.eigvalsh(np.atleast_2d(np.cov(sample.T))) if len(sample) > 1 else np.ones(1)
        used = spread.sum() ** 2 / (spread**2).sum() if (spread**2).sum() > 0 else 1.0
        self.slack = MARGIN * limit / math.sqrt(max(1.0, used))
        rest = sample - self.centres[self.nearest(sample)[0]]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.words = [self._fitted(rest[:, c]) for c in self.cuts]

    def _thinned(self, centres: np.ndarray) -> np.ndarray:
        """The centres without those within BALL of an earlier one, neighbours behind one another."""
        kept = np.zeros((0, centres.shape[1]))
        for at in range(0, len(centres), 1024):
            new = centres[at : at + 1024]
            if len(kept):
                new = new[_squares(new, kept).min(axis=1) > self.ball**2]
            own, chosen = _squares(new, new) <= self.ball**2, []
            for k in range(len(new)):
                if not own[k, chosen].any():
                    chosen.append(k)
            kept = np.concatenate([kept, new[chosen]])
        heads = kept[:: max(1, int(math.sqrt(len(kept))))]
        return kept[np.argsort(_squares(kept, heads).argmin(axis=1), kind="stable")]

    @staticmethod
    def _fitted(rest: np.ndarray) -> np.ndarray:
        words = rest[:CODEWORDS].copy()
        for _ in range(FIT_ROUNDS):
            near = _squares(rest, words).argmin(axis=1)
            n = np.bincount(near, minlength=len(words))
            sums = np.stack([np.bincount(near, rest[:, k], len(words)) for k in range(rest.shape[1])], axis=1)
            words[n > 0] = sums[n > 0] / n[n > 0, None]
        return words

    def step(self) -> int:
        """Rows whose distances to all centres are taken at a time."""
        return max(16, _CELLS // len(self.centres))

    def nearest(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, distance to its centre) of every row."""
        step = self.step()
        found = [(d.argmin(axis=1), np.sqrt(d.min(axis=1))) for d in (_squares(unit[k : k + step], self.centres) for k in range(0, len(unit), step))]
        return np.concatenate([f[0] for f in found] or [np.zeros(0, int)]), np.concatenate([f[1] for f in found] or [np.zeros(0)])

    def code(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the residuals, length of what the codes leave over)."""
        rest = unit - self.centres[own]
        codes = np.stack([_squares(rest[:, c], w).argmin(axis=1) for c, w in zip(self.cuts, self.words)], axis=1).astype(np.uint8)
        left = rest - np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], axis=1)
        return codes, np.sqrt((left * left).sum(axis=1))

    def constants(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """|r|^2 + 2 c.r of decoded residuals r in lists around c: with it |y - c - r|^2 needs y's products with codewords only."""
        rest = np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], axis=1)
        return (rest * (rest + 2 * self.centres[own])).sum(axis=1)

    def table(self, unit: np.ndarray) -> np.ndarray:
        """The products of each row with all codewords, by subspace."""
        return np.stack([unit[:, c] @ np.concatenate([w, np.zeros((CODEWORDS - len(w), w.shape[1]))]).T for c, w in zip(self.cuts, self.words)], axis=1).astype(np.float32)


def _groups(chosen: np.ndarray) -> np.ndarray:
    """For a matrix of links between rows and columns: the least row or column (rows first) that each is connected with."""
    rows, columns = np.arange(chosen.shape[0]), np.arange(chosen.shape[1]) + chosen.shape[0]
    r, c = np.nonzero(chosen)
    while True:
        was = rows.copy(), columns.copy()
        np.minimum.at(columns, c, rows[r])
        np.minimum.at(rows, r, columns[c])
        if (rows == was[0]).all() and (columns == was[1]).all():
            return np.concatenate([rows, columns])


class _Meeting:
    """Looking vectors against the entries of some lists: weights of the links of both, and what connects them."""

    def __init__(self, index: Index, looking: dict[str, np.ndarray], entries: dict[str, np.ndarray], least: float):
        self.index, self.looking, self.entries, self.least = index, looking, entries, least
        self.table = index.table(looking["unit"])
        self.constant = index.constants(entries["codes"], entries["list"]).astype(np.float32)
        self.more_looking, self.more_entries = np.zeros(len(looking["key"]), np.int64), np.zeros(len(entries["key"]), np.int64)
        self.ends: list[np.ndarray] = []

    def meet(self, who: np.ndarray, there: np.ndarray, centre: int) -> None:
        """Rows who of the looking vectors against the entries there, all in the list of centre."""
        step = max(1, _CELLS // max(1, len(there)))
        for at in range(0, len(who), step):
            self._block(who[at : at + step], there, centre)

    def _block(self, who: np.ndarray, there: np.ndarray, centre: int) -> None:
        looking, entries, limit = self.looking, self.entries, self.index.limit
        to_centre = _squares(looking["unit"][who], self.index.centres[centre : centre + 1]).astype(np.float32)
        square = to_centre + self.constant[there]
        table, codes = self.table[who], entries["codes"][there]
        for k in range(codes.shape[1]):
            square -= 2 * np.take(table[:, k], codes[:, k], axis=1)
        left = entries["left"][there].astype(np.float32)
        near = np.sqrt(np.maximum(square, 0)) - left <= limit + _SINGLE
        r, c = np.nonzero(near)
        fine = (looking["key"][who[r]] != entries["key"][there[c]]) & (looking["length"][who[r]] == entries["length"][there[c]])
        r, c = r[fine], c[fine]
        if not len(r):
            return
        for k in range(0, len(r), 1 << 14):  # the exact cosines
            a, b = r[k : k + (1 << 14)], c[k : k + (1 << 14)]
            fine[k : k + len(a)] = np.einsum("ij,ij->i", looking["unit"][who[a]], entries["unit"][there[b]]) >= self.least
        r, c = r[fine[: len(r)]], c[fine[: len(r)]]
        if not len(r):
            return
        rows, columns = who[r], there[c]
        self.more_looking += np.bincount(rows, entries["n"][columns], len(self.more_looking)).astype(np.int64)
        other = looking["list"][rows] != centre  # within a list both look at each other, but for members of a ball
        other |= entries["inner"][columns]
        self.more_entries += np.bincount(columns[other], looking["n"][rows[other]], len(self.more_entries)).astype(np.int64)
        chosen = np.zeros((len(who), len(there)), dtype=bool)
        chosen[r, c] = True
        label, keys = _groups(chosen), np.concatenate([looking["key"][who], entries["key"][there]])
        met = np.flatnonzero(np.concatenate([chosen.any(axis=1), chosen.any(axis=0)]))
        self.ends.append(np.stack([keys[met], keys[label[met]]], axis=1))

    def result(self) -> pa.RecordBatch:
        """(key, links, other): weights to add, and links that connect what is connected."""
        ends = np.unique(np.concatenate([*self.ends, np.zeros((0, 2), np.int64)]), axis=0)
        ends = ends[ends[:, 0] != ends[:, 1]]
        key = np.concatenate([self.looking["key"], self.entries["key"]])
        more = np.concatenate([self.more_looking, self.more_entries])
        used = np.flatnonzero(more)
        other = pa.array([None] * len(used) + ends[:, 1].tolist(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[used], ends[:, 0]])), pa.array(np.concatenate([more[used], np.zeros(len(ends), np.int64)])), other], ["key", "links", "other"])


_FOUND = "key long, links long, other long"


def links(entries: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(key, links, other) of entries(key, n, x): different non-zero finite vectors x with weights n.

    links of a key, summed, are the weights of the other vectors with a cosine of min_cosine or
    more; where other isn't null it is connected with key, and these links connect all that is connected.
    """
    spark = entries.sparkSession
    n, size = entries.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return entries.select("key", F.col("n").alias("links"), F.col("key").alias("other")).limit(0)
    limit = math.sqrt(2 - 2 * min_cosine)
    hashed, every = F.pmod(F.xxhash64("x"), F.lit(1 << 40)), 1 << 40

    def drawn(rows: float) -> np.ndarray:
        """Vectors whose hash is low enough for so many of them; at least one."""
        low = entries.where(hashed < int(min(1.0, rows / n) * every)).select("x").toArrow().column("x").combine_chunks()
        low = low if len(low) else entries.select("x").limit(1).toArrow().column("x").combine_chunks()
        return _unit(_padded(low, size)[0])

    index = Index(drawn(LISTS * math.sqrt(n)), drawn(FIT_ROWS), limit)
    shared = spark.sparkContext.broadcast(index)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            x, length = _padded(batch.column("x"), size)
            unit = _unit(x)
            own, far = shared.value.nearest(unit)
            codes, left = shared.value.code(unit, own)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), _bytes(unit), pa.array(length, pa.int32()), pa.array(own, pa.int32()), pa.array(far), _bytes(codes), pa.array(left)], ["key", "n", "unit", "length", "list", "far", "codes", "left"])

    coded = cut(entries.select("key", "n", "x").mapInArrow(code, "key long, n long, unit binary, length int, list int, far double, codes binary, left double"))
    # an inner part is a ball only of vectors of one length
    inner = (F.col("far") <= index.ball - _DOUBLE) & (F.col("length") == size)
    sizes = coded.groupBy("list").agg(F.count(F.when(inner, 1)).alias("inside"), F.sum(F.when(inner, F.col("n"))).alias("weight"), F.min(F.when(inner, F.col("key"))).alias("leader"), F.count("*").alias("rows")).collect()
    k = len(index.centres)
    weight, leader = np.zeros(k, np.int64), np.zeros(k, np.int64)  # of the balls
    outer, inside = np.zeros(k, np.int64), np.zeros(k, np.int64)  # rows of the lists without and in the balls
    for row in sizes:
        ball = row.inside >= BALL_ROWS
        outer[row.list], inside[row.list] = row.rows - row.inside * ball, row.inside * ball
        if ball:
            weight[row.list], leader[row.list] = row.weight, row.leader
    # shards: lists one behind the other up to SHARD_ROWS; longer lists and balls in blocks of their own
    first, blocks, shards, fill = np.zeros(2 * k, np.int64), np.ones(2 * k, np.int64), 0, SHARD_ROWS
    for group, rows in enumerate([*outer.tolist(), *inside.tolist()]):
        if rows > SHARD_ROWS or fill + rows > SHARD_ROWS:
            first[group], blocks[group] = shards, max(1, -(-rows // SHARD_ROWS))
            shards, fill = shards + blocks[group], rows if rows <= SHARD_ROWS else SHARD_ROWS
        else:
            first[group], fill = shards - 1, fill + rows
    plan = spark.sparkContext.broadcast((weight, leader, outer, first, blocks))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        weight, leader, outer, first, blocks = plan.value
        k, limit = len(index.centres), index.limit
        balls, step = weight > 0, index.step()
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            unit, own = _from_bytes(batch.column("unit"), np.float64), batch.column("list").to_numpy()
            n, key, far = (batch.column(c).to_numpy() for c in ("n", "key", "far"))
            full = batch.column("length").to_numpy() == unit.shape[1]
            square = _squares(unit, index.centres)
            distance = np.sqrt(square)
            member = balls[own] & full & (far <= index.ball - _DOUBLE)
            lower = np.arange(k) < own[:, None]
            mine = np.arange(k) == own[:, None]
            loose = lower & (square - far[:, None] ** 2 <= 2 * np.sqrt(_squares(index.centres[own], index.centres)) * index.slack) & (outer > 0)
            loose |= mine & ~member[:, None]
            visited = (lower | (mine & ~member[:, None])) & balls & full[:, None]
            all_of = visited & (distance <= limit - index.ball - _DOUBLE)
            some_of = visited & ~all_of & (distance <= limit + index.ball + _DOUBLE)
            all_of |= mine & member[:, None]
            links = (all_of * weight).sum(axis=1) - member * n
            # whom to tell: the visited balls' members, and the leaders
            row, ball = np.nonzero(all_of)
            visit = pa.StructArray.from_arrays([pa.array(ball, pa.int32()), pa.array(leader[ball]), pa.array(n[row] * ~(member[row] & (own[row] == ball)))], ["ball", "leader", "n"])
            # which shards to go to: of each looked-at group all blocks
            row, group = np.nonzero(np.concatenate([loose, some_of], axis=1))
            times = blocks[group]
            at = np.repeat(np.arange(len(row)), times)
            block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            go = pa.StructArray.from_arrays([pa.array(first[group[at]] + block), pa.array(group[at], pa.int32())], ["shard", "group"])
            columns = [batch.column(c) for c in ("key", "n", "unit", "length", "list", "codes", "left")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(member), pa.array(links), pa.ListArray.from_arrays(_offsets(all_of.sum(axis=1)), visit), pa.ListArray.from_arrays(_offsets(np.bincount(row[at], minlength=len(key))), go)],
                ["key", "n", "unit", "length", "list", "codes", "left", "inner", "links", "visits", "going"],
            )

    kind = "key long, n long, unit binary, length int, list int, codes binary, left double, inner boolean, links long, visits array<struct<ball: int, leader: long, n: long>>, going array<struct<shard: long, group: int>>"
    probed = cut(coded.mapInArrow(probe, kind))
    visitors = probed.select(F.inline("visits")).where("n > 0").groupBy("ball").agg(F.sum("n").alias("visitors"))  # a row for each ball at most
    by_ball = probed.where("inner").join(F.broadcast(visitors), F.col("list") == F.col("ball")).select("key", F.col("visitors").alias("links"), F.lit(None).cast("long").alias("other"))
    certain = probed.where("links > 0").select("key", "links", F.lit(None).cast("long").alias("other"))
    led = probed.select("key", F.inline("visits")).where("key != leader").select("key", F.lit(0).cast("long").alias("links"), F.col("leader").alias("other"))

    loads = {row.shard: row["count"] for row in probed.select(F.explode(F.array_distinct("going.shard")).alias("shard")).groupBy("shard").count().collect()}
    salts = np.ones(max(1, shards), np.int64)
    for shard, rows in loads.items():
        salts[shard] = max(1, -(-rows // LOOKING_ROWS))
    many = spark.sparkContext.broadcast(salts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row as an entry to its own shard, under every salt of it; and as a looking vector once to each shard it goes to."""
        _, _, _, first, blocks = plan.value
        salts, k = many.value, len(shared.value.centres)
        for batch in (b for b in batches if b.num_rows):
            key, own, inner = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "list", "inner"))
            spread = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            group = own + k * inner
            home = first[group] + (spread % blocks[group].astype(np.uint64)).astype(np.int64)
            rows = np.repeat(np.arange(len(key)), salts[home])
            salt = np.arange(len(rows)) - np.repeat(np.cumsum(salts[home]) - salts[home], salts[home])
            picked = batch.select(["key", "n", "unit", "length", "list", "codes", "left", "inner"]).take(pa.array(rows))
            none = _lists(np.zeros(0, np.int32), np.zeros(len(rows), np.int64), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(home[rows]), pa.array(salt), pa.array(np.zeros(len(rows), bool)), none, *picked.columns], names)
            going = batch.column("going")
            row = np.repeat(np.arange(len(key)), np.diff(going.offsets.to_numpy()))
            shard, group = (going.flatten().field(k).to_numpy() for k in (0, 1))
            order = np.lexsort((group, shard, row))
            row, shard, group = row[order], shard[order], group[order]
            head = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(shard, prepend=-1))
            picked = batch.select(["key", "n", "unit", "length", "list", "codes", "left", "inner"]).take(pa.array(row[head]))
            salt = (spread[row[head]] // np.uint64(7) % salts[shard[head]].astype(np.uint64)).astype(np.int64)
            targets = _lists(group, np.diff(np.append(head, len(row))), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(shard[head]), pa.array(salt), pa.array(np.ones(len(head), bool)), targets, *picked.columns], names)

    names = ["shard", "salt", "looks", "groups", "key", "n", "unit", "length", "list", "codes", "left", "inner"]
    dealt = probed.mapInArrow(deal, "shard long, salt long, looks boolean, groups array<int>, key long, n long, unit binary, length int, list int, codes binary, left double, inner boolean")

    def meet(table: pa.Table) -> pa.Table:
        """One shard under one salt: at most SHARD_ROWS entries and about LOOKING_ROWS looking vectors."""
        index, batch = shared.value, table.combine_chunks()
        k = len(index.centres)

        def side(rows: pa.Table) -> dict[str, np.ndarray]:
            own = {c: rows.column(c).to_numpy() for c in ("key", "n", "length", "list", "left", "inner")}
            return own | {"unit": _from_bytes(rows.column("unit"), np.float64), "codes": _from_bytes(rows.column("codes"), np.uint8)}

        looks = batch.column("looks").to_numpy()
        came, there = batch.filter(pa.array(looks)), batch.filter(pa.array(~looks))
        if not came.num_rows or not there.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        entries, groups = side(there), came.column("groups").combine_chunks()
        meeting = _Meeting(index, side(came), entries, min_cosine)
        who, group = np.repeat(np.arange(came.num_rows), np.diff(groups.offsets.to_numpy())), groups.flatten().to_numpy()
        held = entries["list"] + k * entries["inner"]
        for g in np.unique(held):
            meeting.meet(who[group == g], np.flatnonzero(held == g), int(g % k))
        return pa.Table.from_batches([meeting.result()])

    return dealt.groupBy("shard", "salt").applyInArrow(meet, _FOUND).unionByName(certain).unionByName(by_ball).unionByName(led)


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding).

    n_links: other rows with a cosine of min_cosine or more, in double precision; component_id: the least
    vec_id that links lead to, itself included; kept: whether that is its own.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do rows
    without a vec_id, whose component is null and which are kept. Vectors of different lengths don't
    link. Rows that repeat a vec_id are compared like any others. Equal vectors are one entry, however many
    there are. Other columns are ignored; an empty table gives no rows.
    """
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fine = F.col("vec_id").isNotNull() & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("x", F.when(fine, F.col("x")))
    distinct = cut(rows.where("x is not null").groupBy("x").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("key", F.monotonically_increasing_id()))
    found = cut(links(distinct.select("key", "n", "x"), min_cosine))
    more = found.groupBy("key").agg(F.sum("links").alias("links"))
    group = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    labelled = distinct.join(group.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    entries = labelled.join(named, "component").join(more, "key", "left").select("x", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(entries, "x", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
