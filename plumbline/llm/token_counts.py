"""Word-piece token counts by a linear longest-match automaton.

Greedy longest-match-first splitting of a word needs no pieces to be built to be
counted: a trie of the vocabulary gets failure links, and for every link the
number of tokens that following it completes. A word's count is then one walk
over its bytes. All distinct words of a chunk of text walk in step, one byte at
a time, as numpy arrays of states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import NOT_SPACE, chunks, split_words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def load_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """(word-initial pieces, continuation pieces) of a sentencepiece model: those with and without its word mark.

    The bare mark is the empty word-initial piece; byte pieces are continuation pieces of one byte.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k))]
    names = [model.id_to_piece(k) for k in ids if not model.is_byte(k)]
    single = {bytes([int(model.id_to_piece(k)[3:-1], 16)]) for k in ids if model.is_byte(k)}  # named <0x00> to <0xFF>
    first = sorted({n[1:].encode() for n in names if n[0] == "▁" and "▁" not in n[1:]})
    return first, sorted({n.encode() for n in names if "▁" not in n} | single)


class Automaton:
    """Trie over bytes with two roots: 0 for the word's start, 1 for what follows a piece.

    With an empty piece in first, a word that no other of them begins takes it and goes on at root 1.
    """

    def __init__(self, first: list[bytes], rest: list[bytes]):
        edges: list[dict[int, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for byte in piece:
                    if byte not in edges[node]:
                        edges[node][byte] = len(edges)
                        edges.append({})
                        whole.append(False)
                    node = edges[node][byte]
                whole[node] = node != root
        n = len(edges)
        #: Where to go on when no edge fits (-1: the word can't be split), and how many tokens that completes.
        self.link, self.popped = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32)
        if b"" in first:
            self.link[0], self.popped[0] = 1, 1
        queue = [0, 1]
        for node in queue:
            for byte, child in edges[node].items():
                if whole[child]:
                    self.link[child], self.popped[child] = 1, 1
                else:
                    back, count = int(self.link[node]), int(self.popped[node])
                    while back >= 0 and byte not in edges[back]:
                        back, count = int(self.link[back]), count + int(self.popped[back])
                    if back >= 0:
                        self.link[child], self.popped[child] = edges[back][byte], count
                queue.append(child)
        flat = sorted((node << 8 | byte, child) for node in range(n) for byte, child in edges[node].items())
        self.edge = np.array([x for x, _ in flat], dtype=np.int64)
        self.child = np.array([x for _, x in flat], dtype=np.int32)
        small = 1 << int(np.ceil(np.log2(max(2, 4 * len(self.edge)))))
        self.mask, self.slot = small - 1, np.full(small, -1, dtype=np.int32)
        left = np.arange(len(self.edge))
        self.probes = 0
        while len(left):  # open addressing, all edges of a round at once
            place = (self._spread(self.edge[left]) + self.probes) & self.mask
            free = self.slot[place] < 0
            self.slot[place[free]] = left[free]
            left = left[self.slot[place] != left]
            self.probes += 1

    @staticmethod
    def _spread(key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(32)).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child by each byte, -1 where there is none."""
        key = state.astype(np.int64) << 8 | byte
        out = np.full(len(key), -1, dtype=np.int32)
        home, left = self._spread(key), np.arange(len(key))
        for k in range(self.probes):
            if not len(left):
                break
            at = self.slot[(home[left] + k) & self.mask]
            hit = (at >= 0) & (self.edge[at] == key[left])
            out[left[hit]] = self.child[at[hit]]
            left = left[(at >= 0) & ~hit]
        return out

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of every word data[start:end]; 0 for a word that can't be split into pieces."""
        order = np.argsort(start - end, kind="stable")  # the longest first, so that those still walking are in front
        begin, size = start[order], (end - start)[order]
        n, state = len(order), np.zeros(len(order), dtype=np.int32)
        tokens = np.zeros(n, dtype=np.int64)
        going = np.searchsorted(-size, -np.arange(int(size[0]) + 1 if n else 1), side="left")
        for t in range(int(size[0]) if n else 0):
            rows = np.arange(going[t])
            byte = data[begin[: going[t]] + t].astype(np.int64)
            while len(rows := rows[state[rows] >= 0]):
                to = self.step(state[rows], byte[rows])
                state[rows[to >= 0]] = to[to >= 0]
                rows = rows[to < 0]
                tokens[rows] += self.popped[state[rows]]
                state[rows] = self.link[state[rows]]
        rows = np.arange(n)  # what is left over must come out as whole pieces, down to the second root
        while len(rows := rows[(state[rows] != 1) & (state[rows] >= 0)]):
            tokens[rows] += self.popped[state[rows]]
            state[rows] = self.link[state[rows]]
        out = np.empty(n, dtype=np.int64)
        out[order] = np.where(state == 1, tokens, 0)
        return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row of docs(doc_id, text).

    Words are runs without blanks, A-Z lower-cased. n_tokens: pieces that greedy
    longest-match-first splitting gives. The bare word mark is a piece, and
    characters beyond the vocabulary are one token a byte; only with a vocabulary
    that lacks these can there be words that can't be split: each is one token
    and counted in n_unknown. Null and empty texts have none. Repeated rows each
    get their row; other columns are ignored; words may be of any length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(*load_vocabulary(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for part in chunks(batches, "text", 4 << 20):
            words = split_words(part.column("text"), NOT_SPACE)
            _, row, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
            tokens = automaton.count(words.data, words.start[row], words.end[row])[back]
            text, n = words.text_of(), part.num_rows
            unknown = np.bincount(text, tokens == 0, n).astype(np.int64)
            total = np.bincount(text, np.maximum(tokens, 1), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(words.first)), pa.array(total), pa.array(unknown)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
