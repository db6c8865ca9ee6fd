"""Language identification of mixed-language text.

The script of a word's first letter narrows the candidates to languages that
training texts write in it. Every word gets a score for each of them: naive
Bayes over its byte n-grams and the word itself, hashed to a table of fixed
size. A Viterbi pass over a text's words, with a penalty for each change of
language, then labels spans; the text's language is the one with the most
letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.shared import plain
from plumbline.llm.words import Words, chunks, mix, split_words

#: Hashed features; with one 4-byte number for each language that is what is broadcast.
BUCKETS = 1 << 16
MAX_LANGUAGES = 256
LONGEST_GRAM = 4
#: Distinct words whose features are held at once.
BLOCK = 20_000
SWITCH_PENALTY = 6.0
#: A word speaks for or against a language by this much (natural log) at most.
WORD_LIMIT = 8.0
#: A language counts as written in a script if so large a share of its training words is.
SCRIPT_SHARE = 0.02
UNKNOWN = "und"

#: a-z and everything beyond ASCII
LETTERS = np.zeros(256, dtype=bool)
LETTERS[97:123] = LETTERS[128:] = True

# First code points of Unicode blocks, and the script from there on.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"),
    (0x1780, "Khmer"), (0x1800, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([x for x, _ in SCRIPT_STARTS])
_SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])


def scripts(words: Words, rows: np.ndarray) -> np.ndarray:
    """The number of the script that each of the words begins in."""
    at = words.start[rows]
    last = len(words.data) - 1
    byte = [words.data[np.minimum(at + k, last)].astype(np.int64) for k in range(4)]
    code = np.where(byte[0] < 0x80, byte[0], 0)
    code = np.where((byte[0] >= 0xC0) & (byte[0] < 0xE0), (byte[0] & 31) << 6 | byte[1] & 63, code)
    code = np.where((byte[0] >= 0xE0) & (byte[0] < 0xF0), (byte[0] & 15) << 12 | (byte[1] & 63) << 6 | byte[2] & 63, code)
    code = np.where(byte[0] >= 0xF0, (byte[0] & 7) << 18 | (byte[1] & 63) << 12 | (byte[2] & 63) << 6 | byte[3] & 63, code)
    return _SCRIPT_OF[np.searchsorted(_STARTS, code, side="right") - 1]


def features(words: Words, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, index into rows of the word it is of), by word.

    Features: the word, and every run of 2 to LONGEST_GRAM bytes of it with a
    blank on both sides.
    """
    size = words.end[rows] - words.start[rows] + 2
    first = np.concatenate(([0], np.cumsum(size)))
    word = np.repeat(np.arange(len(rows)), size)
    place = np.arange(first[-1]) - first[word]
    source = words.start[rows][word] + place - 1
    text = np.where((place == 0) | (place == size[word] - 1), 32, words.data[np.clip(source, 0, len(words.data) - 1)]).astype(np.uint64)
    buckets, of = [(hashes % np.uint64(BUCKETS)).astype(np.int64)], [np.arange(len(rows))]
    gram = text + np.uint64(1)
    for n in range(2, LONGEST_GRAM + 1):
        gram = gram[:-1] << np.uint64(9) | text[n - 1 :] + np.uint64(1)
        whole = np.flatnonzero(place[: len(gram)] + n <= size[word[: len(gram)]])
        buckets.append((mix(gram[whole]) % np.uint64(BUCKETS)).astype(np.int64))
        of.append(word[whole])
    bucket, of = np.concatenate(buckets), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return bucket[order], of[order]


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # (BUCKETS, languages), float32
    allowed: np.ndarray  # (scripts, languages): which languages are written in a script


def _lower(texts: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(texts)


def _uses(texts: pa.Array, language: np.ndarray, n_languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (language, bucket) and (language, script) over a chunk."""
    words = split_words(_lower(texts), LETTERS)
    if not len(words.start):
        return np.zeros((n_languages, BUCKETS)), np.zeros((n_languages, len(SCRIPTS)))
    hashes, text = words.hashes(), words.text_of()
    _, rows, times = np.unique(hashes + language[text].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
    grams, script = np.zeros((n_languages, BUCKETS)), np.zeros((n_languages, len(SCRIPTS)))
    for k in range(0, len(rows), BLOCK):
        some, often = rows[k : k + BLOCK], times[k : k + BLOCK]
        lang = language[text[some]]
        bucket, of = features(words, some, hashes[some])
        np.add.at(grams, (lang[of], bucket), often[of])
        np.add.at(script, (lang, scripts(words, some)), often)
    return grams, script


def fit(docs: DataFrame) -> Model:
    """Counts over all rows of docs(text, lang) with a language; one pass, then sums by language and feature.

    The counts come to the driver: BUCKETS + scripts for each language, however
    large docs is. Over MAX_LANGUAGES languages are an error.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    names = sorted(r.lang for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, script = np.zeros((len(names), BUCKETS)), np.zeros((len(names), len(SCRIPTS)))
        number = {name: k for k, name in enumerate(names)}
        for part in chunks(batches, "text", 4 << 20):
            more = _uses(part.column("text"), np.array([number[x] for x in part.column("lang").to_pylist()]), len(names))
            grams += more[0]
            script += more[1]
        all_ = np.concatenate([grams, script], axis=1)
        lang, slot = np.nonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(slot), pa.array(all_[lang, slot])], ["lang", "slot", "n"])

    total = known.mapInArrow(run, "lang long, slot long, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    grams = np.zeros((len(names), BUCKETS + len(SCRIPTS)))
    if names:
        got = total.toPandas()
        grams[got.lang.to_numpy(), got.slot.to_numpy()] = got.n.to_numpy()
    script, grams = grams[:, BUCKETS:], grams[:, :BUCKETS]
    log_prob = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    share = script / np.maximum(script.sum(axis=1, keepdims=True), 1)
    allowed = (share >= SCRIPT_SHARE).T
    allowed[~allowed.any(axis=1)] = True  # nobody's script: all stay candidates
    return Model(names, np.ascontiguousarray(log_prob.T.astype(np.float32)), allowed)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """(words, languages): log score of each word, at most 0, at least -WORD_LIMIT; out of script: -2 * WORD_LIMIT."""
    hashes = words.hashes()
    _, rows, back = np.unique(hashes, return_index=True, return_inverse=True)
    out = np.zeros((len(rows), len(model.languages)), dtype=np.float32)
    for k in range(0, len(rows), BLOCK):
        some = rows[k : k + BLOCK]
        bucket, of = features(words, some, hashes[some])
        begin = np.searchsorted(of, np.arange(len(some)))
        out[k : k + len(some)] = np.add.reduceat(model.log_prob[bucket], begin, axis=0)
    out -= out.max(axis=1, keepdims=True)
    np.maximum(out, -WORD_LIMIT, out=out)
    out[~model.allowed[scripts(words, rows)]] = -2 * WORD_LIMIT
    return out[back]


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language number of every word; text i has the words first[i]:first[i + 1]. All texts go in step."""
    sizes = np.diff(first)
    label = score.argmax(axis=1).astype(np.int16)
    # texts whose words all have the same best language are labelled already
    odd = np.zeros(len(label) + 1, dtype=np.int64)
    np.cumsum(label != np.repeat(label[np.minimum(first[:-1], max(len(label) - 1, 0))], sizes), out=odd[1:])
    todo = np.flatnonzero(odd[first[1:]] > odd[first[:-1]])
    todo = todo[np.argsort(-sizes[todo], kind="stable")]
    if not len(todo):
        return label
    begin, size = first[todo], sizes[todo]
    going = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts with more than t words
    best = score[begin].astype(np.float64)
    came = []
    for t in range(1, int(size[0])):
        n = going[t]
        now = best[:n]
        top = now.argmax(axis=1)
        switch = now[np.arange(n), top] - penalty
        stay = now >= switch[:, None]
        came.append(np.where(stay, np.arange(now.shape[1], dtype=np.int16), top[:, None].astype(np.int16)))
        best[:n] = np.where(stay, now, switch[:, None]) + score[begin[:n] + t]
    state = best.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        n = going[t]
        label[begin[:n] + t] = state[:n]
        if t:
            state[:n] = came[t - 1][np.arange(n), state[:n]]
    return label


_SPANS = "array<struct<lang:string,start:int,end:int>>"


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def label(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """docs with the columns _pl_lang, _pl_score and _pl_spans; all rows stay, and all columns but older ones named _pl_*.

    _pl_lang: the language with the most letters (bytes); the first by name of
    equal ones. _pl_score: its share of the letters, 0 to 1. _pl_spans: runs of
    words in one language. A text that is null or has no letter is `und`, score 0,
    and so is every text if no language was learned.
    """
    docs, shared = plain(docs), docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in chunks(batches, "_pl_text", 4 << 20):
            texts = part.column("_pl_text")
            n = part.num_rows
            words = split_words(_lower(texts), LETTERS)
            lang, share, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            if len(words.start) and m.languages:
                best = viterbi(word_scores(words, m), words.first, penalty)
                size = words.end - words.start
                votes = np.bincount(words.text_of() * len(m.languages) + best, size, n * len(m.languages)).reshape(n, -1)
                total = votes.sum(axis=1)
                ascii_letter = np.bincount(words.text_of(), words.data[words.start] < 128, n) > 0
                top = votes.argmax(axis=1)
                for r in np.flatnonzero(total > 0).tolist():
                    if ascii_letter[r] or _has_letter(texts[r].as_py()):
                        lang[r], share[r] = m.languages[top[r]], votes[r, top[r]] / total[r]
                edge = np.flatnonzero(np.concatenate(([True], (np.diff(best) != 0) | (np.diff(words.text_of()) != 0))))
                text = words.text_of()
                for s, e in zip(edge.tolist(), np.append(edge[1:], len(best)).tolist()):
                    r = int(text[s])
                    if lang[r] != UNKNOWN:
                        spans[r].append({"lang": m.languages[best[s]], "start": s - int(words.first[r]), "end": e - int(words.first[r])})
            kept = [c for c in part.schema.names if c != "_pl_text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(lang), pa.array(share), pa.array(spans, span_type)], [*kept, "_pl_lang", "_pl_score", "_pl_spans"])

    shape = StructType([*docs.schema.fields, *StructType.fromDDL(f"_pl_lang string, _pl_score double, _pl_spans {_SPANS}").fields])
    return docs.withColumn("_pl_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, shape)


def identify(docs: DataFrame, held_out, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) of every row of docs(doc_id, text, lang).

    Learns from rows with a language where held_out isn't true; see label() for
    the results. Repeated rows each get their row; an empty table gives none.
    """
    rows = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    out = label(rows.drop("lang"), fit(rows.where("not held_out")), penalty)
    return out.select("doc_id", "held_out", F.col("_pl_lang").alias("lang_pred"), F.col("_pl_score").alias("score"), F.col("_pl_spans").alias("spans"))
