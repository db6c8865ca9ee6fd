"""Near-duplicates by SimHash fingerprints and multi-index hashing.

Two 64-bit fingerprints at most `radius` = 3 bits apart have a 32-bit half with
at most one differing bit. So every distinct fingerprint is filed under both its
halves, and asks in each table for all values of a Hamming ball of radius one
around its own half (33 keys); what it meets is verified by the full distance.
Exact copies share one fingerprint and are only one row in this search.

similar_documents() finds texts of a given Jaccard similarity of five-word
shingles. Three of 64 bits is far too near for that, so it indexes a wide
fingerprint: SEGMENTS segments, each under its own value and under those with one
of its WEAK least certain bits flipped (the bits whose votes are nearest to a
tie, which an edit turns first). Both sides file under their balls, so segments
meet at up to two flips. What meets is verified by the distance of another 64
bits and then by the exact Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.shared import cut
from plumbline.llm.words import NOT_SPACE, chunks, mix, split_words

RADIUS = 3
SHINGLE_WORDS = 3
XXH_SEED = 42
#: Shingles whose bits are added up at once.
BLOCK = 1 << 15

SIMILAR_WORDS, SIMILARITY = 5, 0.8
SEGMENTS, SEGMENT_BITS, WEAK = 14, 28, 5
#: Of 64 bits, how many may differ before the exact check: at a similarity of 0.8 ten do, with a deviation of three.
CHECK_RADIUS = 20
#: Shingle sets of at most so many bytes in all are sent to every executor; larger ones meet their pairs by a shuffle.
SENT_BYTES = 32 << 20
#: Members of a bucket that may all be compared with one another.
SMALL = 16
#: Members of a bucket, chosen by hash, that those of other components are held against.
HUBS = 16
#: Members of a larger bucket that one task holds of either side, and how many of them it compares at once with all of the other.
BLOCK_MEMBERS, BLOCK_ROWS = 8192, 64
#: Keys of a block by which pairs are left to another bucket of theirs.
BLOCK_KEYS = 256
#: Byte to eight byte-wide counters, lowest bit first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_ROWS = 255  # what a byte-wide counter can hold


def simhash(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text: bit i is set if it is in over half of the shingles' hashes."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle_words, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), BLOCK):
        hashes = np.array([digest(line[s:e], XXH_SEED) for s, e in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): fp is the unsigned fingerprint's bits as a signed bigint.

    Null and wordless texts have fingerprint zero; texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle_words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints (column fp) at most radius bits apart."""
    if not 0 <= radius <= 3:
        raise ValueError("two halves with balls of radius one find distances of 0 to 3 only")
    high, low = F.shiftright("fp", 32).cast("int"), F.col("fp").bitwiseAND(0xFFFFFFFF).cast("long")
    low = F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")
    halves = prints.select("fp", F.posexplode(F.array(high, low)).alias("half", "part"))
    flips = [0, *(1 << i for i in range(31)), -(1 << 31)]
    ball = F.transform(F.array(*[F.lit(x).cast("int") for x in flips]), lambda x: F.col("part").bitwiseXOR(x))
    asked = halves.select(F.col("fp").alias("a"), "half", F.explode(ball).alias("part"))
    table = halves.select(F.col("fp").alias("b"), "half", "part")
    met = asked.join(table, ["half", "part"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return met.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    fingerprint: 16 lowercase hex digits. component_id: the least doc_id that
    links of at most radius bits reach, the document itself included. Null,
    empty and wordless texts have fingerprint zero and link like any others.
    Rows with a null doc_id keep their row and take part by fingerprint; a
    repeated doc_id is in one row for each of its rows. Other columns of docs
    are ignored. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, shingle_words))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(classes, radius))
    member = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    merged = member.groupBy("component").agg(F.min("least").alias("component_id"))
    component = member.join(merged, "component").select("fp", "component_id")
    return prints.join(component, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, index of the text) of all runs of width words; a shorter text is one run, a wordless one has none."""
    words = split_words(texts, NOT_SPACE)
    size, hashes = np.diff(words.first), words.hashes()
    runs = np.minimum(size, np.maximum(1, size - width + 1))
    text = np.repeat(np.arange(len(size)), runs)
    at = words.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    out = np.minimum(size, width)[text].astype(np.uint64)
    for k in range(width):
        more = np.flatnonzero(size[text] > k)
        out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[more] + k])
    return out, text


def _votes(hashes: np.ndarray, first: np.ndarray, words: int) -> np.ndarray:
    """(texts, 64 * words): by how many of a text's shingles each bit is set more often than not."""
    n, size = len(first) - 1, np.diff(first)
    out = np.zeros((n, 64 * words), dtype=np.int64)
    cuts = np.concatenate([np.zeros(0, np.int64), *(np.arange(b, b + m, _ROWS) for b, m in zip(first[:-1].tolist(), size.tolist()) if m)])
    owner = np.repeat(np.arange(n), -(-size // _ROWS))
    for k in range(0, len(cuts), 200):
        begin, stop = cuts[k], cuts[k + 200] if k + 200 < len(cuts) else len(hashes)
        bits = np.stack([mix(hashes[begin:stop] + np.uint64(0x9E3779B97F4A7C15 * w % (1 << 64))) for w in range(words)], axis=1).view(np.uint8)
        np.add.at(out, owner[k : k + 200], np.add.reduceat(_SPREAD[bits], cuts[k : k + 200] - begin, axis=0).view(np.uint8))
    return 2 * out - size[:, None]


def _filed(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of 64 bits, keys (texts, SEGMENTS * (WEAK + 1))): a key is a segment's number and bits."""
    fp = np.packbits(votes[:, :64] > 0, axis=1, bitorder="little").view("<i8").ravel()
    segment = votes[:, 64 : 64 + 32 * SEGMENTS].reshape(len(votes), SEGMENTS, 32)[:, :, :SEGMENT_BITS]
    weak = np.argsort(np.abs(segment), axis=2, kind="stable")[:, :, :WEAK]
    own = ((segment > 0).astype(np.int64) << np.arange(SEGMENT_BITS)).sum(axis=2) | np.arange(SEGMENTS) << SEGMENT_BITS
    keys = np.concatenate([own[:, :, None], own[:, :, None] ^ (1 << weak)], axis=2)
    return fp, keys.reshape(len(votes), -1).astype(np.uint32).view(np.int32)


def _wide_prints(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, fp, keys) of every row of docs(doc_id, text)."""
    n_keys = SEGMENTS * (WEAK + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            hashes, text = _shingle_hashes(part.column("text"), shingle_words)
            fp, keys = _filed(_votes(hashes, np.searchsorted(text, np.arange(part.num_rows + 1)), 1 + (SEGMENTS + 1) // 2))
            ends = pa.array(np.arange(0, len(fp) * n_keys + 1, n_keys, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], ["doc_id", "fp", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, keys array<int>")


def _shingle_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, fp, shingles) of every row of docs(doc_id, text): distinct shingles as 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            hashes, text = _shingle_hashes(part.column("text"), shingle_words)
            first = np.searchsorted(text, np.arange(part.num_rows + 1))
            fp = _filed(_votes(hashes, first, 1 + (SEGMENTS + 1) // 2))[0]
            both = np.unique(text.astype(np.uint64) << np.uint64(32) | hashes >> np.uint64(32))
            ends = pa.array(np.searchsorted(both >> np.uint64(32), np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp), pa.ListArray.from_arrays(ends, pa.array(both.astype(np.uint32).view(np.int32)))], ["doc_id", "fp", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, shingles array<int>")


class _Verifier:
    """Exact similarity of the first texts of two classes; what shingles a class has is looked up once."""

    def __init__(self, docs: DataFrame, classes: DataFrame, shingle_words: int, similarity: float):
        self.docs, self.classes, self.shingle_words, self.similarity = docs, classes, shingle_words, similarity
        self.sets: DataFrame | None = None

    def _look_up(self, pairs: DataFrame) -> None:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        ends = cut((ends.join(self.sets, "fp", "left_anti") if self.sets else ends).join(self.classes, "fp").withColumnRenamed("least", "doc_id"))
        if self.sets and ends.isEmpty():
            return
        sets = _shingle_sets(self.docs.join(ends.select("doc_id").distinct(), "doc_id", "left_semi"), self.shingle_words)
        sets = cut(sets.join(ends, ["doc_id", "fp"], "left_semi").select("fp", "shingles"))
        self.sets = self.sets.union(sets) if self.sets else sets

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the fingerprint pairs (a, b) that are similar enough."""
        self._look_up(pairs)
        bytes_ = self.sets.agg(F.sum(4 * F.size("shingles") + 32)).first()[0] or 0
        side = F.broadcast if bytes_ <= SENT_BYTES else (lambda df: df)
        right = pairs.join(side(self.sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))), "b")
        both = right.join(side(self.sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))), "a")
        shared = F.size(F.array_intersect("x", "y"))
        return cut(both.where(shared >= F.lit(self.similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b"))


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= CHECK_RADIUS


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _met_in_block(key: int, sides: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of an asker and a member of another label whose fingerprints are near; a pair with a lesser common key may be left to that one."""
    fp, label = ([t.column(name).to_numpy() for t in sides] for name in ("fp", "label"))
    main = sides[1].column("main").to_numpy()
    flat = [t.column("keys").combine_chunks() for t in sides]
    of = [np.repeat(np.arange(len(k)), k.value_lengths().to_numpy(zero_copy_only=False)) for k in flat]
    flat = [k.flatten().to_numpy() for k in flat]
    found, often = np.unique(flat[1][flat[1] < key], return_counts=True)
    found = np.sort(found[np.argsort(-often, kind="stable")[:BLOCK_KEYS]])
    has = [np.zeros((len(f), len(found)), dtype=np.float32) for f in fp]
    for h, rows, keys in zip(has, of, flat, strict=True):
        if len(found):
            at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
            hit = found[at] == keys
            h[rows[hit], at[hit]] = 1
    for k in range(0, len(fp[0]), BLOCK_ROWS):
        x = fp[0][k : k + BLOCK_ROWS, None]
        # of two askers the lesser one asks
        wanted = (np.bitwise_count((x ^ fp[1]).view(np.uint64)) <= CHECK_RADIUS) & (label[0][k : k + BLOCK_ROWS, None] != label[1]) & ((label[1] == main) | (x < fp[1]))
        if len(found) and wanted.any():
            wanted &= has[0][k : k + BLOCK_ROWS] @ has[1].T == 0
        i, j = np.nonzero(wanted)
        if len(i):
            x, y = fp[0][k + i], fp[1][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _met_in_large(labelled: DataFrame, small: int) -> DataFrame:
    """All pairs (a, b) of different labels that share a bucket of more than small members, by labelled(key, fp, label), and are near.

    Those of a bucket's most frequent label are only asked; the others ask all. Both sides are cut into blocks, of which
    every pair is a group of its own, so that no task holds more than two blocks.
    """
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key")
    bucket = sizes.agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("main")).where((F.col("n") > small) & (F.col("most") < F.col("n")))
    rows = labelled.select("key", "fp", "label").join(bucket, "key")
    rows = rows.join(rows.groupBy("fp").agg(F.collect_list("key").alias("keys")), "fp")
    blocks = lambda n: F.ceil(n / BLOCK_MEMBERS)
    asking, asked = blocks(F.col("n") - F.col("most")), blocks(F.col("n"))
    place = lambda n: F.pmod(F.xxhash64("fp", "key"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = ["key", "fp", "label", "main", "keys"]
    askers = rows.where("label != main").select(F.lit(0).alias("side"), *own, place(asking).alias("i"), each(asked).alias("j"))
    targets = rows.select(F.lit(1).alias("side"), *own, each(asking).alias("i"), place(asked).alias("j"))

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(list(batches))
        sides = [block.filter(pc.equal(block.column("side"), k)) for k in (0, 1)]
        yield from _met_in_block(group[0].as_py(), sides)

    return askers.union(targets).groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SIMILAR_WORDS) -> DataFrame:
    """(doc_id, component_id) for every row of docs(doc_id, text), by the Jaccard similarity of word shingles.

    component_id: the least doc_id that links of at least the given similarity
    reach, the document itself included. Texts with fewer words are one shingle;
    null and wordless texts are all alike and similar to nothing else. Texts that
    share a 64-bit fingerprint are one class, for which that of the least doc_id
    stands: two texts of similarity 0.79 are with probability 2e-5. Pairs that no
    segment brings together are missed; the README has the recall. Rows with a
    null doc_id keep their row and take part by fingerprint; a repeated doc_id has
    one row for each of its rows. Other columns are ignored.

    No large bucket emits all its pairs. First every member is held against the
    bucket's least; when what is similar has been merged, against HUBS members
    chosen by a hash of text and bucket, those that are of a larger component (of
    equal ones, of that with the greater label). Both are aggregations and joins by
    key, with at most HUBS pairs for each row of a bucket, and none for the bulk of
    a group that is one component already. What is of different components then is compared
    throughout: in buckets of at most SMALL members by a join, in larger ones block by block,
    where all that aren't of the bucket's most frequent component meet all its members. So no pair that shares a bucket is lost, at
    a cost that grows with the product of both numbers. A text is in SEGMENTS * (WEAK + 1) buckets, each with its own hubs.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    prints = cut(_wide_prints(docs, shingle_words))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # copies file under the keys of one of them; two texts of one class may differ in their keys, and a null id stands for none
    filed = prints.join(classes, (prints["fp"] == classes["fp"]) & prints["doc_id"].eqNullSafe(classes["least"])).select(prints["fp"], F.explode("keys").alias("key"))
    least = filed.groupBy("key").agg(F.min("fp").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = cut(filed.join(least, "key"))
    star = cut(_ordered(met.where((F.col("fp") != F.col("first")) & _near("fp", "first")), "fp", "first"))
    check = _Verifier(docs, classes, shingle_words, similarity)
    first = check.verified(star)
    merged = cut(components(first))
    size = merged.groupBy("component").agg(F.count("*").alias("size"))
    label = merged.join(size, "component").select(F.col("node").alias("fp"), "component", "size")
    crowd = met.where("n > 2").select("key", "fp", "n").join(label, "fp", "left")
    labelled = cut(crowd.select("key", "fp", "n", F.coalesce("component", "fp").alias("label"), F.coalesce("size", F.lit(1).cast("long")).alias("size")))
    member = F.struct("fp", "size", "label")
    hubs = F.array_distinct(F.array(*[F.min_by(member, F.xxhash64("key", "fp", F.lit(k))) for k in range(HUBS)]))
    mixed = labelled.groupBy(F.col("key").alias("_key")).agg(hubs.alias("hubs"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    # of two components the smaller one asks
    larger = lambda h: (h["size"] > F.col("size")) | ((h["size"] == F.col("size")) & (h["label"] > F.col("label")))
    foreign = F.filter("hubs", lambda h: larger(h) & (F.bit_count(h["fp"].bitwiseXOR(F.col("fp"))) <= CHECK_RADIUS))
    other = labelled.join(mixed, (F.col("key") == F.col("_key")) & (F.size(foreign) > 0))
    tried = cut(_ordered(other.select("fp", F.explode(foreign["fp"]).alias("hub")), "fp", "hub").join(star, ["a", "b"], "left_anti"))
    links = cut(first.union(check.verified(tried)))
    # what is still apart is compared throughout
    label = components(links).select(F.col("node").alias("fp"), "component")
    left = cut(labelled.join(mixed.select(F.col("_key").alias("key")), "key", "left_semi").select("key", "fp", "n").join(label, "fp", "left").select("key", "fp", "n", F.coalesce("component", "fp").alias("label")))
    few = left.where(F.col("n") <= SMALL)
    pairs = few.select("key", F.col("fp").alias("x"), F.col("label").alias("lx")).join(few.select("key", F.col("fp").alias("y"), F.col("label").alias("ly")), "key")
    rest = _ordered(pairs.where((F.col("x") < F.col("y")) & (F.col("lx") != F.col("ly")) & _near("x", "y")), "x", "y")
    rest = rest.union(_met_in_large(left.where(F.col("n") > SMALL), SMALL)).distinct()
    rest = cut(rest.join(star.union(tried), ["a", "b"], "left_anti"))
    second = check.verified(rest)
    linked = components(links.union(second))
    member = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = member.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "fp").join(member.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "component_id")
