"""Language-model scores from a lattice of subword pieces.

The pieces are those of an existing vocabulary; a piece's first weight comes
from its place in the vocabulary (its score), the final weight from training
words by expectation maximisation, with the first weights as prior. A word's
probability is the sum over all its segmentations into pieces, found by the
forward recursion in log space.

A word that training has seen gets one more arc over its whole length, weighted
by its count (Witten-Bell); so the lattice's pieces carry what is new. Within a
text, words that occurred already become likelier (a Dirichlet prior of strength
`adapt` around that distribution, then conditioning on the words so far). All
this is learned for each group of training texts (their language); a text's
probability is the mixture over groups, its own group is never looked at.
Every part is proper: at each step all words and the end sum to 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import cut
from plumbline.llm.words import NOT_SPACE, chunks, split_words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ADAPT = 3000.0
EM_ROUNDS = 3
#: Pseudo-counts that the vocabulary's own weights have in each round.
PRIOR = 1000.0
#: Words at least this share of all training tokens are broadcast: at most 1 / HEAVY_SHARE words, whatever the corpus.
HEAVY_SHARE = 2e-6
#: Groups of training texts that have a model of their own; all texts of the others are the training of one more model.
MAX_GROUPS = 16
#: Distinct words that a task holds before it hands counts on.
FLUSH = 300_000
#: Distinct words that go through the lattice together: numpy's work on words of one length needs many of them.
TOGETHER = 50_000
#: Rank offset of the vocabulary's first weights: 1 / (offset + rank).
RANK_OFFSET = 30.0
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LN10 = float(np.log(10.0))


class Pieces:
    """The vocabulary as byte strings (word start: one blank) with log weights, and a lookup by rolling hash."""

    def __init__(self, pieces: list[bytes], log_weight: np.ndarray):
        at = {_rolling(p): k for k, p in enumerate(pieces)}
        self.hash = np.array(sorted(at), dtype=np.uint64)
        order = np.array([at[h] for h in self.hash.tolist()])
        self.pieces, self.log_weight = [pieces[k] for k in order], log_weight[order]
        self.longest = max(map(len, pieces))
        # one byte a slot: 1 some piece begins so, 2 it may be a piece
        self.sieve = np.zeros(1 << 21, dtype=np.uint8)
        begins = np.array(sorted({_rolling(p[:k]) for p in pieces for k in range(1, len(p))}), dtype=np.uint64)
        self.sieve[self._slot(begins)] |= 1
        self.sieve[self._slot(self.hash)] |= 3

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * _SPREAD >> np.uint64(43)).astype(np.int64)

    def weighted(self, log_weight: np.ndarray) -> Pieces:
        out = object.__new__(Pieces)
        out.__dict__.update(self.__dict__, log_weight=log_weight)
        return out

    def find(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows and hashes that may begin a piece; the rows that are one, and its number)."""
        kind = self.sieve[self._slot(hashes)]
        going = kind > 0
        rows, hashes, kind = rows[going], hashes[going], kind[going]
        whole = np.flatnonzero(kind > 1)
        at = np.minimum(np.searchsorted(self.hash, hashes[whole]), len(self.hash) - 1)
        real = self.hash[at] == hashes[whole]
        return rows, hashes, rows[whole[real]], at[real]


def _rolling(piece: bytes) -> int:
    value = 0
    for byte in piece:
        value = (value * int(_STEP) + byte + 1) % (1 << 64)
    return value


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """A sentencepiece model's pieces; single bytes are always among them, so that every word has a segmentation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k):
            continue
        piece = model.id_to_piece(k).replace("▁", " ").encode().lower()
        if b" " in piece[1:] or piece == b"":
            continue
        weight[piece] = weight.get(piece, 0.0) + 1.0 / (RANK_OFFSET - min(0.0, model.get_score(k)))
    last = min(weight.values())
    for byte in range(256):
        for piece in (bytes([byte]), b" " + bytes([byte])):
            weight.setdefault(piece, last / 10)
    names = sorted(weight)
    log_weight = np.log(np.array([weight[p] for p in names]))
    return Pieces(names, log_weight - np.log(np.exp(log_weight).sum()))


def lattice(words: list[bytes], pieces: Pieces, weights: np.ndarray, expect: np.ndarray | None = None) -> np.ndarray:
    """(words, groups): natural-log marginal probability of every word over all segmentations.

    weights: log weights (pieces, groups). With expect, for one group, the
    expected number of uses of every piece is added to it.
    """
    out = np.zeros((len(words), weights.shape[1]))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, 400_000 // (int(size) + 1) // weights.shape[1])
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            text = np.frombuffer(b"".join(b" " + words[r] for r in some), dtype=np.uint8).reshape(len(some), size + 1)
            out[some] = _same_length(text, pieces, weights, expect)
    return out


def _same_length(text: np.ndarray, pieces: Pieces, weights: np.ndarray, expect: np.ndarray | None) -> np.ndarray:
    count, size = text.shape
    value = np.ascontiguousarray(text.T).astype(np.uint64) + np.uint64(1)
    forward = np.full((size + 1, count, weights.shape[1]), -np.inf)
    forward[0] = 0.0
    arcs = []
    for i in range(size):
        rows, here = np.arange(count), np.zeros(count, dtype=np.uint64)
        for j in range(i + 1, min(size, i + pieces.longest) + 1):  # rows: words whose bytes i:j begin some piece
            here = here * _STEP + value[j - 1][rows]
            rows, here, some, piece = pieces.find(rows, here)
            if not len(rows):
                break
            if len(some):
                weight = weights[piece]
                forward[j, some] = np.logaddexp(forward[j, some], forward[i, some] + weight)
                if expect is not None:
                    arcs.append((i, j, some, piece, weight[:, 0]))
    whole = forward[size]
    if expect is not None:
        forward, backward = forward[:, :, 0], np.full((size + 1, count), -np.inf)
        backward[size] = 0.0
        for i, j, some, piece, weight in reversed(arcs):
            behind = weight + backward[j, some]
            backward[i, some] = np.logaddexp(backward[i, some], behind)
        for i, j, some, piece, weight in arcs:
            uses = np.exp(forward[i, some] + weight + backward[j, some] - forward[size, some])
            expect += np.bincount(piece, uses, len(expect))
    return whole


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batches joined to ones of about so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _counts(groups: int) -> list[str]:
    return [f"c{k}" for k in range(groups)]


def word_counts(docs: DataFrame, groups: int) -> DataFrame:
    """(h, word, c0, c1, ...) of every distinct word of docs(text, grp): ck counts it in rows with grp = k (null: in none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            h, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            names = [w for x in held for w in x[2]]
            unique, first, back = np.unique(h, return_index=True, return_inverse=True)
            total = [pa.array(np.bincount(back, c[:, k], len(unique)).astype(np.int64)) for k in range(groups)]
            return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array([names[k] for k in first.tolist()], pa.binary()), *total], ["h", "word", *_counts(groups)])

        for part in chunks(batches, "text", 4 << 20):
            words = split_words(part.column("text"), NOT_SPACE)
            if not len(words.start):
                continue
            group = np.asarray(part.column("grp").fill_null(groups))[words.text_of()]  # the last one isn't learned from
            unique, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
            count = np.bincount(back * (groups + 1) + group, minlength=len(unique) * (groups + 1)).reshape(-1, groups + 1)[:, :groups]
            data, start, end = words.data.tobytes(), words.start[first].tolist(), words.end[first].tolist()
            held.append((unique, count, [data[s:e] for s, e in zip(start, end)]))
            size += len(unique)
            if size > FLUSH:
                batch = merged()
                held, size = [], 0
                yield batch
        if held:
            yield merged()

    parts = docs.select("text", "grp").mapInArrow(run, "h long, word binary, " + ", ".join(f"{c} long" for c in _counts(groups)))
    return parts.groupBy("h").agg(F.min("word").alias("word"), *[F.sum(c).alias(c) for c in _counts(groups)])


def fit_pieces(words: DataFrame, pieces: Pieces, groups: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log weights (pieces, groups) by EM over each group's distinct words (ck > 0), each once: the pieces are there to make new words."""
    spark = words.sparkSession
    first = np.exp(pieces.log_weight)
    weights = np.repeat(pieces.log_weight[:, None], groups, axis=1)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, now = shared.value
            expect = np.zeros((groups, len(known.hash)))
            for batch in _gathered(batches):
                spelt = batch.column("word")
                for k in range(groups):
                    own = spelt.filter(pa.array(np.asarray(batch.column(f"c{k}")) > 0)).to_pylist()
                    lattice(own, known, now[:, k : k + 1], expect[k])
            group, used = np.nonzero(expect)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(used), pa.array(expect[group, used])], ["grp", "piece", "uses"])

        uses = words.select("word", *_counts(groups)).mapInArrow(run, "grp long, piece long, uses double").groupBy("grp", "piece").agg(F.sum("uses").alias("uses"))
        total = np.repeat(PRIOR * first[:, None], groups, axis=1)
        got = uses.toPandas()  # as many rows as the vocabulary for each group at most
        total[got.piece.to_numpy(), got.grp.to_numpy()] += got.uses.to_numpy()
        weights = np.log(total / total.sum(axis=0))
    return weights


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 8: Stirling's series."""
    y = 1.0 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def log_rising(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log(x (x + 1) ... (x + n - 1)) for x > 0 and whole n >= 0."""
    out = np.zeros(len(x))
    for k in range(8):
        out += np.where(n > k, np.log(x + k), 0.0)
    far = n > 8
    out[far] += _log_gamma(x[far] + n[far]) - _log_gamma(x[far] + 8)
    return out


def score(docs: DataFrame, held_out, group=None, vocabulary: str = VOCABULARY, adapt: float = ADAPT, rounds: int = EM_ROUNDS, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Scores of every row of docs(doc_id, text), learning from those where held_out isn't true.

    Tokens: runs without blanks (A-Z lower-cased), then one end. Columns:
    doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens,
    base_score (add-one word unigram), score (the model) and lattice_score, in
    log10. lattice_score is the lattice alone: each word's marginal probability
    under the vocabulary's own scores, times that of going on, and the end's. group:
    a column that tells training rows apart (null is one more group); all are one
    group without it. The MAX_GROUPS - 1 groups with most rows have a model each,
    all others together one more; no row is left out. Null and empty texts have the
    end alone; texts of any length are scored whole; other columns are ignored.
    Repeated rows each get their row; an empty table gives an empty result. Without
    training rows the vocabulary's own weights score alone.
    """
    spark = docs.sparkSession
    named = F.lit("") if group is None else F.coalesce(group.cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), named.alias("name"))
    largest = rows.where("not held_out").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(MAX_GROUPS - 1).collect()
    n_train = rows.where("not held_out").count()
    names = [r.name for r in largest]
    in_group = [r.n for r in largest]
    if n_train > sum(in_group) or not names:
        names, in_group = [*names, None], [*in_group, n_train - sum(in_group)]
    groups = len(names)
    number = F.coalesce(*[F.when(F.col("name") == n, k) for k, n in enumerate(names) if n is not None], F.lit(groups - 1)).cast("long")
    rows = rows.select("doc_id", "text", "held_out", F.when(~F.col("held_out"), number).alias("grp"))
    counted = cut(word_counts(rows, groups))
    cs, ls = _counts(groups), [f"l{k}" for k in range(groups)]
    c_all = sum((F.col(c) for c in cs[1:]), F.col(cs[0]))
    seen = counted.agg(F.count_if(c_all > 0).alias("types"), F.coalesce(F.sum(c_all), F.lit(0)).alias("tokens"), *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in cs], *[F.coalesce(F.sum(c), F.lit(0)).alias(f"s_{c}") for c in cs]).first()
    tokens, types = seen.tokens + n_train, seen.types + bool(n_train)
    pieces = load_pieces(vocabulary)
    spelling = spark.sparkContext.broadcast((pieces, np.column_stack([fit_pieces(counted, pieces, groups, rounds), pieces.log_weight])))
    ls = [*ls, "lv"]  # the last one: under the vocabulary's own weights

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            marginal = lattice(batch.column("word").to_pylist(), *spelling.value)
            yield pa.RecordBatch.from_arrays([batch.column("h"), *(batch.column(c) for c in cs), *(pa.array(marginal[:, k].copy()) for k in range(groups + 1))], ["h", *cs, *ls])

    table = cut(counted.mapInArrow(spell, "h long, " + ", ".join([f"{c} long" for c in cs] + [f"{x} double" for x in ls])))
    new = np.array([max(seen[f"t_{c}"] + (n > 0), 1) for c, n in zip(cs, in_group)], dtype=np.float64)
    model_all = np.array([seen[f"s_{c}"] + n for c, n in zip(cs, in_group)]) + new
    base_all = float(tokens + types + 1)
    heavy = table.where(c_all >= F.lit(max(1.0, heavy_share * tokens))).toPandas().sort_values("h")
    shared = spark.sparkContext.broadcast((heavy["h"].to_numpy(), heavy[cs].to_numpy(), heavy[ls].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, spelt = shared.value
        for part in chunks(batches, "text", 4 << 20):
            n = part.num_rows
            words = split_words(part.column("text"), NOT_SPACE)
            text, h = words.text_of(), words.hashes().view(np.int64)
            order = np.lexsort([h, text])
            text, h = text[order], h[order]
            fresh = np.ones(len(h), dtype=bool)
            fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(fresh)
            times, text, h = np.diff(np.append(at, len(h))), text[at], h[at]
            where = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            common = known[where] == h if len(known) else np.zeros(len(h), dtype=bool)
            place, owner, often = where[common], text[common], times[common]
            total = count[place].sum(axis=1)
            base = np.bincount(owner, often * np.log((total + 1) / base_all), n).astype(np.float64)  # whole numbers if there is nothing to count
            model = np.empty((n, groups))
            for k in range(groups):
                static = (count[place, k] + new[k] * np.exp(spelt[place, k])) / model_all[k]
                model[:, k] = np.bincount(owner, log_rising(adapt * np.maximum(static, 1e-300), often), n)
            plain = np.bincount(owner, often * spelt[place, groups], n).astype(np.float64)
            n_known = np.bincount(owner, often, n).astype(np.int64)
            bounds = pa.array(np.searchsorted(text[~common], np.arange(n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (h[~common], times[~common].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), part.column("held_out"), pa.array(np.diff(words.first)), pa.array(n_known), pa.array(base), pa.array(plain), *(pa.array(model[:, k].copy()) for k in range(groups)), *lists], ["doc_id", "key", "held_out", "n_words", "n_known", "base", "plain", *ms, "h", "times"])

    ms = [f"m{k}" for k in range(groups)]
    first = cut(rows.select("doc_id", F.xxhash64("text").alias("key"), "held_out", "text").mapInArrow(run, "doc_id long, key long, held_out boolean, n_words long, n_known long, base double, plain double, " + ", ".join(f"{m} double" for m in ms) + ", h array<long>, times array<int>"))

    def again(k: int):
        x = F.lit(adapt) * F.greatest((F.col(cs[k]) + F.lit(float(new[k])) * F.exp(ls[k])) / F.lit(float(model_all[k])), F.lit(1e-300))
        return F.when(F.col("times") == 1, F.log(x)).otherwise(F.aggregate(F.sequence(F.lit(0), F.col("times") - 1), F.lit(0.0), lambda a, i: a + F.log(x + i)))

    rare = first.select("doc_id", "key", F.inline(F.arrays_zip("h", "times"))).join(table, "h")
    zero = F.lit(0).cast("long")
    rest = rare.select("doc_id", "key", F.lit(None).cast("boolean").alias("held_out"), zero.alias("rows"), zero.alias("n_words"), F.when(c_all > 0, F.col("times")).otherwise(0).cast("long").alias("n_known"), (F.col("times") * F.log((c_all + 1) / F.lit(base_all))).alias("base"), (F.col("times") * F.col("lv")).alias("plain"), *[again(k).alias(m) for k, m in enumerate(ms)])
    own = first.select("doc_id", "key", "held_out", F.lit(1).cast("long").alias("rows"), "n_words", "n_known", "base", "plain", *ms)
    # rows that are equal throughout add up to a multiple of one of them
    sums = ["n_words", "n_known", "base", "plain", *ms]
    both = own.unionByName(rest).groupBy("doc_id", "key").agg(F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ["rows", *sums]])
    both = both.withColumns({c: F.col(c) / F.col("rows") for c in sums})
    log_gamma = lambda v: (v - 0.5) * F.log(v) - v + F.lit(0.9189385332046727) + F.lit(1.0) / (v * 12) - F.lit(1.0) / (v * v * v * 360)
    gone = log_gamma(F.col("n_words") + F.lit(adapt + 1.0)) - log_gamma(F.lit(adapt))  # log((adapt) ... (adapt + n_words))
    parts = [F.col(m) + F.lit(float(np.log(max(in_group[k], 1e-9) / max(n_train, 1e-9)) + np.log(adapt * (in_group[k] / model_all[k] if n_train else 1.0)))) for k, m in enumerate(ms) if in_group[k] or not n_train]
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    mixed = top + F.log(sum((F.exp(x - top) for x in parts[1:]), F.exp(parts[0] - top)))
    stop = n_train / tokens if tokens > n_train else 0.5  # how likely a text ends at a token
    out = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).cast("long").alias("n_tokens"),
        (F.col("n_known") + int(bool(n_train))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        ((F.col("base") + F.log(F.lit((n_train + 1) / base_all))) / LN10).alias("base_score"),
        ((mixed - gone) / LN10).alias("score"),
        ((F.col("plain") + F.col("n_words") * float(np.log1p(-stop)) + float(np.log(stop))) / LN10).alias("lattice_score"),
    )
