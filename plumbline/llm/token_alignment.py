"""Alignment of two tokenizers over a corpus, by the byte ranges of their tokens.

A is a byte-level BPE whose ids are in the order of its merges, B a sentencepiece BPE. Where tokens of both end at one
byte, the text is cut into groups; every A token is linked with every B token of
its group, and an id pair's count is the number of documents that hold it linked.

Most groups are one A token over one B token of the same bytes. An array from
each A id to the B id of its bytes tells these apart: they are counted in a
vector as long as A's vocabulary, one for each task. Only other pairs enter the
shuffle by pair.

Both tokenizers end a token wherever a blank or a line break follows a character
that isn't white space (checked against B's pieces when it is loaded; A splits
there before any merge). Between such places lie the units, mostly words: each
distinct unit of a chunk of text is encoded and aligned once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import cut, written
from plumbline.llm.words import chunks

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"

#: Pair counts are broadcast up to so many rows (17 bytes each); beyond them links meet their counts in a join.
MAX_BROADCAST_PAIRS = 2_000_000
#: Units whose alignment a task keeps at a time, and pairs that it sums before it sends them on.
KEPT_UNITS, KEPT_PAIRS = 250_000, 400_000
#: Bytes of text that are split at a time, and new units that are encoded together.
CHUNK, LEARN = 1 << 20, 10_000

#: From white space, or the text's start, up to the next blank or line break behind another character.
_UNITS = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_MARK = "▁"
#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones themselves, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Units met so far, with counts, links and group strings; texts are rows of unit indexes."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            model = json.load(file)
        alphabet, names = _byte_alphabet(), model["model"]["vocab"]
        special = {x["content"]: x["id"] for x in model["added_tokens"] if x["special"]}
        merges = ["".join(x.split(" ") if isinstance(x, str) else x) for x in model["model"]["merges"]]
        ranks = {bytes(alphabet[c] for c in name): k for name, k in names.items() if name not in special}
        if [names[x] for x in merges] != sorted(names[x] for x in merges) or len(ranks) != len(merges) + 256:
            raise ValueError("the merges of this vocabulary aren't in the order of its ids")
        #: The file's vocabulary and merges; special tokens' names are ordinary text.
        self.a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (1 + max([*names.values(), *special.values()]))
        for own in (ranks, {name.encode(): k for name, k in special.items()}):
            for x, k in own.items():
                self.bytes_a[k] = x
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace(_MARK, " ").encode() for k, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(_MARK)
        #: Without this no text is cut into units.
        self.cuts = not any(re.search(rf"[^\s{_MARK}][{_MARK} \n]", p) for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in own], dtype=np.int64) for own in (self.bytes_a, self.bytes_b))
        self.n_b = len(pieces)
        self.key_type = np.dtype(np.int32 if len(self.bytes_a) * self.n_b < 1 << 31 else np.int64)
        #: Each id within a group and at its end, for A and B.
        self.shown_a, self.shown_b = ([x for k in range(len(own)) for x in (b"%d," % k, b"%d%c" % (k, end))] for own, end in ((self.bytes_a, b"|"), (self.bytes_b, b";")))
        whole = {x: k for k, x in reversed(list(enumerate(self.bytes_b))) if not (self.b.is_control(k) or self.b.is_unknown(k))}
        #: The B id with the bytes of each A id, -1 where there is none.
        self.same = np.array([whole.get(x, -1) if x else -1 for x in self.bytes_a], dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []  # each group of a unit as 'a1,a2|b1;'
        self.stats = np.zeros((0, 5), dtype=np.int64)  # n_a, n_b, n_groups, n_links, 1 if the bytes differ
        self.first, self.pair, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(unit indexes of all texts behind a blank, where each text's begin); texts without characters have none."""
        rows = [(_UNITS.findall(" " + t) if self.cuts else [" " + t]) if t else [] for t in texts]
        flat = list(chain.from_iterable(rows))
        if len(self.known) > KEPT_UNITS:
            self.clear()
        new = list(set(flat) - self.known.keys())
        ended = [u for u in new if not u[-1].isspace()]
        for own in (ended, [u for u in new if u[-1].isspace()]):
            for k in range(0, len(own), LEARN):
                self._learn(own[k : k + LEARN])
        return np.array(list(map(self.known.__getitem__, flat)), dtype=np.int64), np.cumsum([0, *map(len, rows)])

    def _learn(self, units: list[str]) -> None:
        n, raw = len(units), [u.encode() for u in units]
        flat_a, count_a, flat_b, count_b, good = self._encoded_together(units, raw) or self._encoded_singly(units, raw)
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        unit_a = np.repeat(np.arange(n), count_a)
        unit_of = np.zeros(len(ends), dtype=np.int64)
        unit_of[group_a] = unit_a
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))

        # each group's distinct ids with their times; all pairs of these are its links
        (ga, a, ta), (gb, b, tb) = (self._distinct(g, ids, top) for g, ids, top in ((group_a, flat_a, len(self.bytes_a)), (group_b, flat_b, self.n_b)))
        from_b = np.searchsorted(gb, np.arange(len(ends) + 1))
        width = np.diff(from_b)[ga]
        left = np.repeat(np.arange(len(ga)), width)
        right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + from_b[ga][left]
        key, times, unit = a[left] * self.n_b + b[right], ta[left] * tb[right], unit_of[ga][left]
        order = np.lexsort((key, unit))
        key, times, unit = key[order], times[order], unit[order]
        head = np.flatnonzero(np.diff(unit, prepend=-1) | np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, head) if len(key) else times
        key, unit = key[head], unit[head]

        stats = np.zeros((n, 5), dtype=np.int64)
        stats[:, 0], stats[:, 1], stats[:, 2] = count_a, count_b, np.bincount(unit_of, minlength=n)
        np.add.at(stats[:, 3], unit_of, in_a * in_b)
        stats[:, 4] = ~good
        # all tokens by group, A's before B's, each with the mark behind it
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
        shown = [*map(self.shown_a.__getitem__, (2 * flat_a + last_a).tolist()), *map(self.shown_b.__getitem__, (2 * flat_b + last_b).tolist())]
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable").tolist()
        shown = list(map(shown.__getitem__, order))
        ends = np.cumsum(count_a + count_b)
        self.known.update(zip(units, range(len(self.groups), len(self.groups) + n), strict=True))
        self.groups += [b"".join(shown[i:j]) for i, j in zip((ends - count_a - count_b).tolist(), ends.tolist(), strict=True)]
        self.stats = np.concatenate([self.stats, stats])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(unit, minlength=n))])
        self.pair, self.times = np.concatenate([self.pair, key]), np.concatenate([self.times, times])

    def _encoded_together(self, units: list[str], raw: list[bytes]) -> tuple | None:
        """(A's ids, how many each unit has, the same of B, whether bytes come back) of units that end a token in one long text; None if there are others."""
        if any(u[-1].isspace() for u in units):
            return None
        text, ends = "".join(units), np.cumsum(list(map(len, raw)))
        out, whole = [], b"".join(raw)
        for ids, own, size in ((self._ids_a(text), self.bytes_a, self.size_a), (self._ids_b(text), self.bytes_b, self.size_b)):
            flat = np.array(ids, dtype=np.int64)
            at = np.cumsum(size[flat])
            cut_at = np.searchsorted(at, ends)
            if b"".join(map(own.__getitem__, ids)) != whole or not np.array_equal(at[np.minimum(cut_at, len(at) - 1)], ends):
                return None
            out += [flat, np.diff(cut_at, prepend=-1)]
        return *out, np.ones(len(units), dtype=bool)

    def _encoded_singly(self, units: list[str], raw: list[bytes]) -> tuple:
        """As above, unit by unit; those whose bytes don't come back have no ids."""
        both, good = [], np.zeros(len(units), dtype=bool)
        for k, (u, r) in enumerate(zip(units, raw, strict=True)):
            x, y = self._ids_a(u), self._ids_b(u)
            good[k] = b"".join(map(self.bytes_a.__getitem__, x)) == r == b"".join(map(self.bytes_b.__getitem__, y))
            both.append((x, y) if good[k] else ([], []))
        return *(np.array(z, dtype=np.int64) for i in (0, 1) for z in (list(chain.from_iterable(x[i] for x in both)), [len(x[i]) for x in both])), good

    def _ids_a(self, text: str) -> list[int]:
        return self.a.encode_ordinary(text)

    def _ids_b(self, text: str) -> list[int]:
        """B adds a blank before what it encodes: it takes the place of the text's own first blank, or goes again."""
        if text == " ":
            return [self.mark]
        return self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]

    @staticmethod
    def _distinct(group: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both, times = np.unique(group * top + ids, return_counts=True)
        return both // top, both % top, times

    def links(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in pair of all the units' links, how many links each unit has)."""
        n = self.first[units + 1] - self.first[units]
        return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[units], n), n

    def differ(self, units: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which texts have bytes that a tokenizer doesn't give back."""
        return _sums(self.stats[units, 4], first) > 0

    def held(self, units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of all pairs linked in each text, by text and pair."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        text, units = (x[~self.differ(units, first)[text]] for x in (text, units))
        n = max(1, len(self.groups))
        both, often = np.unique(text * n + units, return_counts=True)
        at, width = self.links(both % n)
        keys, code = np.unique(self.pair[at], return_inverse=True)
        m = max(1, len(keys))
        once, place = np.unique(np.repeat(both // n, width) * m + code, return_inverse=True)
        times = np.bincount(place, np.repeat(often, width) * self.times[at], len(once)).astype(np.int64)
        return once // m, keys[once % m] if len(keys) else once, times


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]], also of empty ranges."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


_DOCS = "is_doc boolean, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs binary, times binary, counts array<struct<a: int, b: int, n: long>>"


def _aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, with_groups: bool) -> DataFrame:
    """The alignment of each document with its distinct pairs and their times; and, in rows of their own, each task's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizer_a, tokenizer_b)
        schema = pa.schema([("is_doc", pa.bool_()), *((c, pa.int64()) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("counts", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])))])
        same = np.zeros(len(aligner.same), dtype=np.int64)  # documents with each A id over the B id of its bytes
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            values = pa.StructArray.from_arrays([pa.array(key // aligner.n_b, pa.int32()), pa.array(key % aligner.n_b, pa.int32()), pa.array(n)], ["a", "b", "n"])
            row = [pa.array([False]), *(pa.nulls(1, f.type) for f in list(schema)[1:-1]), pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), values)]
            return pa.RecordBatch.from_arrays(row, schema=schema)

        for part in chunks(batches, "text", CHUNK):
            units, first = aligner.split(part.column("text").to_pylist())
            text, key, times = aligner.held(units, first)
            found, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, minlength=len(found))
            regular = aligner.same[found // aligner.n_b] == found % aligner.n_b
            same[found[regular] // aligner.n_b] += n[regular]
            keys, at = np.unique(np.concatenate([keys, found[~regular]]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n[~regular]]), len(keys)).astype(np.int64)
            if len(keys) > KEPT_PAIRS:
                yield told(keys, counts)
                keys, counts = keys[:0], counts[:0]

            fine = ~aligner.differ(units, first)
            shown = [b"".join(map(aligner.groups.__getitem__, units[i:j].tolist()))[:-1] if ok else b"" for i, j, ok in zip(first[:-1].tolist(), first[1:].tolist(), fine.tolist(), strict=True)]
            digest = [hashlib.sha256(x).hexdigest() if x else "" for x in shown]
            ends = np.searchsorted(text, np.arange(part.num_rows + 1)).tolist()
            packed = [[x[i:j].tobytes() for i, j in pairwise(ends)] for x in (key.astype(aligner.key_type), times.astype(np.int32))]
            columns = [pa.array(np.ones(part.num_rows, bool)), part.column("row"), part.column("doc_id"), *(pa.array(_sums(aligner.stats[units, k], first) * fine) for k in range(4))]
            columns += [pa.array([x.decode() for x in shown], pa.string()) if with_groups else pa.nulls(part.num_rows, pa.string()), pa.array(digest, pa.string()), *(pa.array(x, pa.binary()) for x in packed), pa.nulls(part.num_rows, schema.field("counts").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        yield told(keys, counts)
        met = np.flatnonzero(same)
        yield told(met * aligner.n_b + aligner.same[met], same[met])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, _DOCS)


def _counted(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents the ids are linked, and whether no other b has more with this a."""
    pairs = cut(aligned.where("not is_doc").select(F.inline("counts")).groupBy("a", "b").agg(F.sum("n").alias("n")))
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return cut(pairs.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))


def pair_counts(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """(a, b, n, best) of docs(doc_id, text): in how many documents the ids are linked, and whether no other b has more with this a.

    Rows are documents, repeated ones too. Null and empty texts, and those whose bytes a tokenizer
    changes, hold no pair; texts of any length are read whole; an empty table has no pairs.
    """
    return _counted(_aligned(docs, tokenizer_a, tokenizer_b, False))


def align(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, max_broadcast_pairs: int = MAX_BROADCAST_PAIRS, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs(doc_id, text).

    groups_sha256: of the ids of each group, 'a1,a2|b1;a3|b2'; with_groups adds that string as groups.
    n_links: token pairs within groups; n_best: those whose count is the highest of their A id, ties
    included; count_sum: the counts of all links.

    A is run on a blank and the text, B on the text (it adds the blank). Texts that are null or empty, or
    whose bytes a tokenizer changes, have no tokens: all zero, and '' for groups. Special tokens' names in
    texts are ordinary text. Repeated rows each count as a document and get a row; rows without a doc_id
    too; other columns, whatever their names, are ignored; texts of any length are taken whole; an empty
    table gives no rows.

    Texts are encoded once; each document's distinct pairs are written to the shared folder and meet their counts from there.
    """
    spark = docs.sparkSession
    aligned = written(_aligned(docs, tokenizer_a, tokenizer_b, with_groups))
    pairs, rows = _counted(aligned), aligned.where("is_doc")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *["groups"] * with_groups, "groups_sha256"]
    if pairs.limit(max_broadcast_pairs + 1).count() > max_broadcast_pairs:
        return _met_by_join(rows, pairs, tokenizer_a, tokenizer_b).select(*columns)
    table = pairs.toArrow()
    a, b, n, best = (table.column(c).to_numpy() for c in ("a", "b", "n", "best"))
    size = Aligner(tokenizer_a, tokenizer_b)
    key = a.astype(np.int64) * size.n_b + b
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order].astype(size.key_type), n[order].astype(np.int64), best[order].astype(bool)))
    own = [c for c in columns if c not in ("n_best", "count_sum")]

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs").to_pylist(), batch.column("times").to_pylist()
            first = np.cumsum([0, *(len(x) // keys.itemsize for x in pairs)])
            at = np.searchsorted(keys, np.frombuffer(b"".join(pairs), keys.dtype))
            often = np.frombuffer(b"".join(times), np.int32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(_sums(often * x[at], first)) for x in (best, n))], [*own, "n_best", "count_sum"])

    kinds = ["doc_id long", "n_a long", "n_b long", "n_groups long", "n_links long", *["groups string"] * with_groups, "groups_sha256 string", "n_best long", "count_sum long"]
    return rows.select(*own, "pairs", "times").mapInArrow(worth, ", ".join(kinds)).select(*columns)


def _met_by_join(rows: DataFrame, pairs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """rows with n_best and count_sum, for more pairs than may be broadcast: each document's distinct pairs meet their counts in a join."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = Aligner(tokenizer_a, tokenizer_b)
        for batch in batches:
            pairs = batch.column("pairs").to_pylist()
            row = np.repeat(batch.column("row").to_numpy(), [len(x) // size.key_type.itemsize for x in pairs])
            key = np.frombuffer(b"".join(pairs), size.key_type).astype(np.int64)
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(key // size.n_b, pa.int32()), pa.array(key % size.n_b, pa.int32()), pa.array(times)], ["row", "a", "b", "times"])

    met = rows.select("row", "pairs", "times").mapInArrow(unpacked, "row long, a int, b int, times int").join(pairs, ["a", "b"])
    worth = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.join(worth, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
