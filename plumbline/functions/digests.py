"""MD5 of many short texts at once, for numbers that are hashed from (seed, replicate, unit)."""

from __future__ import annotations

import math

import numpy as np

_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(4, 4, 4).reshape(-1).tolist()
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _block(state: list, words: list, room: np.ndarray) -> list:
    """The state after one block of 16 words; a word is an array, or one number for all texts."""
    a, b, c, d = (x.copy() for x in state)
    f, t = room
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        word = words[_WORD[i]]
        if isinstance(word, int):
            np.add(a, np.uint32((word + _ADDED[i]) & 0xFFFFFFFF), out=a)
        else:
            np.add(a, word, out=a)
            np.add(a, np.uint32(_ADDED[i]), out=a)
        turn = _TURNS[i]
        np.left_shift(a, np.uint32(turn), out=t)
        np.right_shift(a, np.uint32(32 - turn), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


class Endings:
    """Texts that stand behind prefixes: what a prefix doesn't change of their blocks is laid out once for each of its lengths."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.laid = texts, {}

    def _layout(self, length: int) -> list[tuple[np.ndarray, list]]:
        """For texts of each number of blocks: (their indexes, the blocks' words)."""
        size = np.array([len(t) for t in self.texts], dtype=np.int64) + length
        blocks = (size + 8) // 64 + 1
        out = []
        for n in np.unique(blocks).tolist():
            at = np.flatnonzero(blocks == n)
            own = b"".join((b"\0" * length + self.texts[i] + b"\x80").ljust(64 * n, b"\0") for i in at.tolist())
            words = np.frombuffer(own, "<u4").reshape(len(at), 16 * n).T.copy()
            bits = size[at] * 8
            words[16 * n - 2], words[16 * n - 1] = bits & 0xFFFFFFFF, bits >> 32
            same = (words == words[:, :1]).all(axis=1)
            out.append((at, [int(w[0]) if s else w for w, s in zip(words, same.tolist(), strict=True)]))
        return out

    def digits(self, prefix: bytes) -> np.ndarray:
        """The first 13 hex digits of each MD5 of prefix and text, as integers."""
        if len(prefix) not in self.laid:
            self.laid[len(prefix)] = self._layout(len(prefix))
        first = np.frombuffer(prefix.ljust(-(-len(prefix) // 4) * 4, b"\0"), "<u4").tolist()
        out = np.empty(len(self.texts), dtype=np.int64)
        for at, words in self.laid[len(prefix)]:
            words = [w | p if isinstance(w, int) else w | np.uint32(p) for w, p in zip(words, first, strict=False)] + words[len(first) :]
            state, room = [np.full(len(at), x, dtype=np.uint32) for x in _START], np.empty((2, len(at)), dtype=np.uint32)
            for k in range(0, len(words), 16):
                state = _block(state, words[k : k + 16], room)
            high, low = (x.byteswap().astype(np.int64) for x in state[:2])
            out[at] = high << 20 | low >> 12
        return out
