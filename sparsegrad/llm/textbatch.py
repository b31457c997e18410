"""Words, shingles and hashes of batches of texts, vectorised with numpy.

Runs inside tasks (``mapInArrow``). Texts are processed whole, some at a time:
``pieces`` cuts a batch into runs of texts of about ``PIECE_CHARS`` characters,
so memory follows one piece (or one very long text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_CHARS = 1 << 19
U64 = np.uint64
#: Odd multipliers of the word and shingle hashes.
CHAR_MULT, STEP = U64(0xD6E8FEB86659FD93), U64(0x9E3779B97F4A7C15)
SEQ_MULT = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
                     0x1D8E4E27C47D124F], dtype=U64)

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP^i and its inverse modulo 2^64 for i < n, grown on demand."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", int(STEP)), ("down", pow(int(STEP), -1, 1 << 64))):
            factors = np.full(size, base, U64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors)
    return _powers["up"][:n], _powers["down"][:n]


def pieces(texts: pa.Array, limit: int = PIECE_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) runs of about ``limit`` characters of an Arrow column;
    null counts as empty. Only the texts of one run are Python strings."""
    chars = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start, done = 0, 0
    while start < len(texts):
        stop = min(len(texts), int(np.searchsorted(chars, done + limit)) + 1)
        yield start, stop, [x or "" for x in texts.slice(start, stop - start).to_pylist()]
        start, done = stop, chars[stop - 1]


class Codes:
    """Code points of some texts in one array, a line break after each text."""

    def __init__(self, texts: list[str]):
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(lengths)])       # start of each text
        self.c = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)


def not_break(c: np.ndarray) -> np.ndarray:
    """True for characters of a word: all but space and \\x09-\\x0D."""
    return ~((c == 32) | ((c - np.uint32(9)) <= 4))


class Words:
    """Word spans of ``codes`` with a 64-bit hash each.

    ``hash`` follows the characters only. ``first[d]:first[d+1]`` are the words
    of text ``d``. ``prefix_hash(n)`` hashes the first ``n`` characters."""

    def __init__(self, codes: Codes, is_word=not_break):
        inside = is_word(codes.c)
        edge = np.flatnonzero(np.diff(inside, prepend=False))     # every text ends with a break
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, codes.at)
        self.count = np.diff(self.first)
        up, self._down = powers(len(codes.c) + 1)
        term = (codes.c.astype(U64) + U64(1)) * CHAR_MULT
        term ^= term >> U64(32)
        term *= up[:-1]
        self._sum = np.concatenate([np.zeros(1, U64), np.cumsum(term)])
        self.hash = self._between(self.start, self.end)

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self._sum[b] - self._sum[a]) * self._down[a])

    def prefix_hash(self, n: int, which: np.ndarray) -> np.ndarray:
        return self._between(self.start[which], self.start[which] + n)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def sequence_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items that begin at each position (positions whose run
    leaves the array are dropped)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out += h[j:j + n] * SEQ_MULT[j]
    return mix(out)


def shingles(words: Words, k: int = 5, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the k-word shingles of each text in order, text ``d`` at
    ``first[d]:first[d+1]``. A text of 1 to k-1 words is one shingle if
    ``whole_short``, else it has none."""
    runs = sequence_hash(words.hash, k)
    n = np.maximum(words.count - (k - 1), 0)
    short = np.flatnonzero((words.count > 0) & (words.count < k)) if whole_short else np.zeros(0, np.int64)
    total = n.copy()
    total[short] = 1
    first = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(first[-1], U64)
    long_ = np.flatnonzero(n)
    if len(long_):
        shift = np.repeat(words.first[long_] - first[long_], n[long_])
        place = np.arange(n.sum()) if not len(short) else np.concatenate(
            [np.arange(first[d], first[d + 1]) for d in long_])
        out[place] = runs[place + shift]
    for d in short:
        h = words.hash[words.first[d]:words.first[d + 1]]
        out[first[d]] = mix(np.array([(h * SEQ_MULT[:len(h)]).sum() + U64(len(h))], U64))[0]
    return out, first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each run."""
    sets = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:])]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), at
