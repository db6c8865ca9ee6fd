"""Benchmark decontamination with suffix arrays of the training documents.

Each task turns its documents into shards, a few MB of text each, and builds a
word-level suffix array of every shard. All suffixes of the benchmark items are
looked up in it by binary search; the interval that shares a whole window gives
every place where the window occurs, and following the words behind it gives the
longest verbatim match. Only the benchmark travels, in blocks of a fixed number
of words; documents are never shuffled.

A shard's array leaves out suffixes that no benchmark suffix can match: those
whose first words (three, or fewer if an item is shorter) stand nowhere in the
block. They could never be in an interval that is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.words import ALNUM, mix, pieces, split_words

WINDOW = 10
#: Words of benchmark text that are broadcast at once; more are searched for block by block.
BLOCK_WORDS = 2_000_000
PREFIX = 3
_FACTOR = np.uint64(0xA24BAED4963EE407)
_ITEM_END, _DOC_END = np.uint64(1), np.uint64(2)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n values from every position on; the last n - 1 positions are left out."""
    out = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = mix(out * _FACTOR + hashes[k : k + len(out)])
    return out


class Block:
    """Benchmark items made ready for the search: distinct suffixes that begin with a whole window."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.names = [name for name, _ in items]
        end = np.array([_ITEM_END], dtype=np.uint64)
        self.words = np.concatenate([x for _, h in items for x in (h, end)] + [np.full(window, _ITEM_END)])
        start, width, owner, suffix = [], [], [], []
        at = 0
        for k, (_, h) in enumerate(items):
            n, w = len(h), min(window, len(h))
            tail, tails = 0, []
            for x in h[::-1].tolist():
                tail = hash((x, tail))
                tails.append(tail)
            many = n - w + 1
            start += range(at, at + many)
            width += [w] * many
            owner += [k] * many
            suffix += [(x, w) for x in tails[::-1][:many]]
            at += n + 1
        first: dict[tuple[int, int], int] = {}
        of = [first.setdefault(x, len(first)) for x in suffix]
        keep = np.unique(of, return_index=True)[1]
        self.start, self.width = np.array(start, dtype=np.int64)[keep], np.array(width, dtype=np.int64)[keep]
        pairs = np.unique(np.stack([np.array(of), np.array(owner)], axis=1), axis=0) if of else np.zeros((0, 2), int)
        self.owner, self.first_owner = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(keep) + 1))
        self.depth = int(self.width.max(initial=0))
        self.prefix = int(min(PREFIX, self.width.min(initial=PREFIX)))
        self.prefixes = np.unique(_grams(self.words, self.prefix)[self.start]) if len(self.start) else np.zeros(0, np.uint64)
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[(self.prefixes >> np.uint64(42)).astype(np.int64)] = True


def suffix_array(words: np.ndarray, block: Block) -> np.ndarray:
    """Positions of a shard's suffixes that can match, in the order of their first block.depth words."""
    grams = _grams(words, block.prefix)
    at = np.flatnonzero(block.sieve[(grams >> np.uint64(42)).astype(np.int64)])
    if not len(at) or not len(block.prefixes):
        return np.zeros(0, dtype=np.int64)
    near = np.minimum(np.searchsorted(block.prefixes, grams[at]), len(block.prefixes) - 1)
    at = at[block.prefixes[near] == grams[at]]
    return at[np.lexsort([words[at + d] for d in range(block.depth - 1, -1, -1)])] if len(at) else at


def _bisect(words, array, lo, hi, depth, wanted, right):
    """Where wanted goes in words[array[lo:hi] + depth], for every interval at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        there = words[array[mid] + depth]
        up = there <= wanted[open_] if right else there < wanted[open_]
        lo[open_[up]] = mid[up] + 1
        hi[open_[~up]] = mid[~up]
    return lo


def occurrences(words: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix number, position, match length) of every place that shares a suffix's whole window."""
    array = suffix_array(words, block)
    live = np.arange(len(block.start))
    lo, hi = np.zeros(len(live), dtype=np.int64), np.full(len(live), len(array), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for depth in range(block.depth):
        if not len(live):
            break
        wanted = block.words[block.start[live] + depth]
        lo, hi = _bisect(words, array, lo, hi, depth, wanted, False), _bisect(words, array, lo, hi, depth, wanted, True)
        some = lo < hi
        live, lo, hi = live[some], lo[some], hi[some]
        done = block.width[live] == depth + 1
        found.append((live[done], lo[done], hi[done]))
        live, lo, hi = live[~done], lo[~done], hi[~done]
    live, lo, hi = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, dtype=np.int64) for k in range(3))
    many = hi - lo
    suffix = np.repeat(live, many)
    place = array[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    length = block.width[suffix].copy()
    grow = np.arange(len(suffix))
    while len(grow):
        i, j = block.start[suffix[grow]] + length[grow], place[grow] + length[grow]
        fits = (i < len(block.words)) & (j < len(words))
        grow, i, j = grow[fits], i[fits], j[fits]
        grow = grow[(block.words[i] == words[j]) & (block.words[i] > _DOC_END)]
        length[grow] += 1
    return suffix, place, length


def _shard(texts: pa.Array, pad: int):
    """(words with an end mark behind every document, text of every word, index of every word's mark-free position, word counts)."""
    found = split_words(texts, ALNUM)
    hashes = found.hashes()
    hashes[hashes <= _DOC_END] += np.uint64(3)
    text = found.text_of()
    words = np.full(len(hashes) + len(texts) + pad, _DOC_END, dtype=np.uint64)
    words[np.arange(len(hashes)) + text] = hashes
    return words, text, found.first


def item_words(text: str | None) -> np.ndarray:
    words = split_words(pa.array([text], pa.string()), ALNUM).hashes()
    words[words <= _DOC_END] += np.uint64(3)
    return words


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks that are small enough to broadcast; items without words are left out."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string"))
    held, size = [], 0
    for name, text in rows.toLocalIterator():
        words = item_words(text)
        if len(words):
            if held and size + len(words) > block_words:
                yield Block(held, window)
                held, size = [], 0
            held.append((name, words))
            size += len(words)
    if held:
        yield Block(held, window)


_FOUND = "array<struct<start:int,end:int>>"
_MARKS = f"_pl_words long, _pl_spans {_FOUND}, _pl_items array<string>, _pl_best struct<length:int,start:int,item:string>"


def _search(block) -> object:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    best_type = pa.struct([("length", pa.int32()), ("start", pa.int32()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        for part, texts in pieces(batches, "_pl_row", "text", 4 << 20):
            n = part.num_rows
            words, text, first = _shard(texts, b.depth)
            hit = np.zeros(len(text), dtype=bool)
            items: list[set] = [set(x or ()) for x in part.column("_pl_items").to_pylist()]
            best = part.column("_pl_best").to_pylist()
            for row, spans in enumerate(part.column("_pl_spans").to_pylist()):
                for x in spans or ():
                    hit[first[row] + x["start"] : first[row] + x["end"]] = True
            suffix, place, length = occurrences(words, b)
            if len(suffix):
                row = np.searchsorted(first + np.arange(n + 1), place, side="right") - 1
                word = place - row
                cover = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(cover, word, 1)
                np.add.at(cover, word + b.width[suffix], -1)
                hit |= np.cumsum(cover[:-1]) > 0
                for r, s in np.unique(np.stack([row, suffix], axis=1), axis=0).tolist():
                    items[r].update(b.names[o] for o in b.owner[b.first_owner[s] : b.first_owner[s + 1]])
                order = np.lexsort([suffix, word, -length, row])
                for k in order[np.unique(row[order], return_index=True)[1]]:
                    r = row[k]
                    if not best[r] or best[r]["length"] < length[k]:
                        best[r] = {"length": int(length[k]), "start": int(word[k] - first[r]), "item": b.names[b.owner[b.first_owner[suffix[k]]]]}
            edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
            spans = [[] for _ in range(n)]
            for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                while s < e:  # a run that goes on into the next text is cut
                    r = int(text[s])
                    stop = min(e, int(first[r + 1]))
                    spans[r].append({"start": s - int(first[r]), "end": stop - int(first[r])})
                    s = stop
            marks = [pa.array(np.diff(first)), pa.array(spans, span), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(best, best_type)]
            yield pa.RecordBatch.from_arrays([part.column("_pl_row"), *marks], ["_pl_row", "_pl_words", "_pl_spans", "_pl_items", "_pl_best"])

    return run


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of docs as one struct column _pl_row, with _pl_words, _pl_spans, _pl_items and _pl_best.

    _pl_spans: runs of hit words [start, end); _pl_items: ids of the items with
    a window in the text; _pl_best: the longest verbatim match, where it starts
    and in which item (the first of them). A benchmark without words marks nothing.
    """
    spark = docs.sparkSession
    empty = {"_pl_words": "cast(0 as bigint)", "_pl_spans": f"cast(array() as {_FOUND})", "_pl_items": "cast(array() as array<string>)", "_pl_best": "cast(null as struct<length:int,start:int,item:string>)"}
    row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_pl_row"))
    out = row.select("_pl_row", *[F.expr(v).alias(k) for k, v in empty.items()])
    shape = StructType([*row.schema.fields, *StructType.fromDDL(_MARKS).fields])
    some = False
    for block in blocks(benchmark, window, block_words):
        out, some = out.mapInArrow(_search(spark.sparkContext.broadcast(block)), shape), True
    if not some:
        out = out.mapInArrow(_search(spark.sparkContext.broadcast(Block([], window))), shape)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document of docs(doc_id, text): what of it stands in benchmark(item_id, text).

    Words are runs of ASCII letters and digits and of anything beyond ASCII,
    lower-cased in A-Z. A window is `window` consecutive words of an item, or
    all words of a shorter item. Columns: doc_id, n_words, n_hit (words inside
    an occurrence), n_items, items (sorted ids), contaminated, spans, and
    longest, longest_start, longest_item (null without a match). Null and empty
    texts have no words; items without words are left out; an item without an
    id counts as ''. Rows are never dropped or merged.
    """
    out = marked(docs.select("doc_id", "text"), benchmark, window, block_words)
    hit = F.aggregate("_pl_spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return out.select("_pl_row.doc_id", F.col("_pl_words").alias("n_words"), hit.alias("n_hit"), F.size("_pl_items").cast("long").alias("n_items"), F.col("_pl_items").alias("items"), (F.size("_pl_spans") > 0).alias("contaminated"), F.col("_pl_spans").alias("spans"), F.col("_pl_best.length").alias("longest"), F.col("_pl_best.start").alias("longest_start"), F.col("_pl_best.item").alias("longest_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs whose text has no window of the benchmark; all columns, whatever their names and types.

    Null, empty and wordless texts have none and stay, and so do repeated rows.
    """
    return marked(docs, benchmark, window, block_words).where(F.size("_pl_spans") == 0).select("_pl_row.*")


def item_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
