"""Words and word n-grams of whole Arrow batches of text, as numpy arrays.

Texts stay the UTF-8 bytes that Arrow holds. A class table says which bytes belong to words; every byte of a
character outside ASCII has the same class, so words in terms of bytes are words in terms of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of words in `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of text worked on at a time; a longer text is worked on alone.
BLOCK = 1 << 21

U = np.uint64
#: Seeds of the two families of hashes, and what joins two of them; the factors are 1 modulo 4.
_SEEDS = (U(0x2545F4914F6CDD1D), U(0xC2B2AE3D27D4EB4F))
_JOINS = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
#: By how many bytes are left, those of the next eight that count.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Bytes of a word after which the rest is hashed alone.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A number of 64 bits for the bytes of each span, eight of them mixed in at a time.

    No step is linear in the bytes, so no pattern of letters cancels out, as it does in a polynomial modulo a power
    of two.
    """
    seed = _SEEDS[second]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    length = ends - starts
    out = mix(length.astype(U) + seed)
    out = mix(out ^ (eight[starts] & _LEFT[np.minimum(length, 8)]))
    at, k = np.flatnonzero(length > 8), 8
    while len(at):
        if k >= LONG_WORD:
            raw = memoryview(padded)
            rest = [xxhash.xxh3_64_intdigest(raw[i:j], int(seed)) for i, j in zip((starts[at] + k).tolist(), ends[at].tolist())]
            out[at] = mix(out[at] ^ np.array(rest, U))
            break
        out[at] = mix(out[at] ^ (eight[starts[at] + k] & _LEFT[np.minimum(length[at] - k, 8)]))
        k += 8
        at = at[length[at] > k]
    return out


class Block:
    """Some consecutive texts of a batch and their words.

    rows: the first and last row (exclusive) in the batch; starts, ends: of words, in data; first: of each text's
    words, in starts, with one more entry for the end.
    """

    def __init__(self, rows: tuple[int, int], data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets
        inside = is_word[data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        if len(data):
            edge = offsets[:-1][offsets[:-1] < len(data)]
            starts[edge] = inside[edge]
            edge = offsets[1:][offsets[1:] > 0] - 1
            ends[edge] = inside[edge]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return self.rows[1] - self.rows[0]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, second: bool = False) -> np.ndarray:
        """A number of 64 bits for each word; the second kind is independent of the first."""
        return span_hashes(self.data, self.starts, self.ends, second)

    def words_left(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def text_of(self, i: int, j: int) -> bytes:
        """Words i to j (exclusive), joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j]))


def grams(hashes: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """A number for each run of n words; runs over the edge of a text must be left out by the caller.

    Runs of 1, 2, 4, ... words are joined from two halves, and what n is made of is joined from left to right.
    """
    m, join = len(hashes) - n + 1, _JOINS[second]
    if m <= 0:
        return np.zeros(0, U)
    out, covered, half, width = None, 0, hashes, 1
    while True:
        if n & width:
            own = half[covered : covered + m]
            out = own if out is None else mix(out * join + own)
            covered += width
        if covered == n:
            return mix(out + U(n))
        half = mix(half[:-width] * join + half[width:])
        width *= 2


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's begin, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, is_word: np.ndarray, lower: bool = False) -> Iterator[Block]:
    """Blocks of about BLOCK bytes that together hold every row of a string column."""
    data, offsets = text_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        own = data[offsets[i] : offsets[j]]
        yield Block((i, j), LOWER[own] if lower else own, offsets[i : j + 1] - offsets[i], is_word)
        i = j


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
