"""Token ids of whole texts, by the tokenizers library, each distinct piece of text encoded once a task.

A byte-level BPE encoding with this vocabulary's pattern never crosses the place before a space that is followed by
anything but white space, nor either end of other white space before a word, nor the place between an ASCII letter and
a mark. Texts are cut there; the distinct pieces are encoded by the library, kept while the task runs, and put together
by look-up. Texts with white space outside ASCII, where that rule has exceptions, go to the library whole. So do all
texts where the vocabulary has another pattern than the one that the rule was made for, see CUTS_HOLD.

A piece is looked up by a hash, and its bytes are then compared with those that were encoded; a text with a piece whose
bytes differ goes to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

from sluice.llm import words as W

#: Distinct pieces that a task keeps before it starts anew.
KEEP = 600_000
#: How texts are split by the vocabularies for which the cuts were worked out; there must be no normaliser either.
CUTS_HOLD = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Bytes of texts that the library is given at a time.
TOGETHER = 1 << 20


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a vocabulary of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _odd(data: np.ndarray) -> np.ndarray:
    """Where white space outside ASCII or a separator control begins."""
    lead = np.flatnonzero(_LEAD[data])
    a = data[lead]
    b, c = (data[np.minimum(lead + k, len(data) - 1)] for k in (1, 2))
    wide = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    wide |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    wide |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    wide |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    wide |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    return lead[wide | (a < 0x20)]


_LEAD = np.zeros(256, bool)
_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


_ASCII_LETTER, _ASCII_MARK = np.zeros(256, bool), np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: But for the apostrophe, which may begin a contraction.
_ASCII_MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


@lru_cache(maxsize=1)
def loaded(path: str) -> tuple:
    """The library's tokenizer, whether the cuts hold for it, and of each id whether it begins with a space and how many
    bytes of text it stands for.

    It is loaded once a worker, not once a task: what the library keeps of the texts that a tokenizer has encoded,
    about 5 MB, it does not free with that tokenizer, so a worker would grow with every task it runs.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True  # their names in a text are ordinary text
    # The parts' own settings: the whole tokenizer as JSON has the vocabulary and all merges in it.
    split = json.loads(library.pre_tokenizer.__getstate__()) if library.pre_tokenizer else {}
    cuts_hold = library.normalizer is None and type(library.model).__name__ == "BPE" and all(split.get(k) == v for k, v in CUTS_HOLD.items())
    names = library.get_vocab(with_added_tokens=False)
    spaced = np.zeros(max(names.values()) + 1, bool)
    spaced[[i for name, i in names.items() if name.startswith("\u0120")]] = True  # how the library writes a space
    sizes = np.zeros(len(spaced), np.int64)
    sizes[list(names.values())] = [len(name) for name in names]  # names have one character a byte
    return library, cuts_hold, spaced, sizes


class Encoder:
    """Encodes blocks of texts; one for each task."""

    def __init__(self, path: str, keep: int = KEEP):
        self.library, self.cuts_hold, self.spaced, self.sizes = loaded(path)
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        self.known, self.slot = np.zeros(0, W.U), np.zeros(0, np.int64)  # hashes, ascending, and the place of each
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # the pieces' own bytes

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def spans(self, b: W.Block, whole: bool = False) -> Iterator[np.ndarray]:
        """For each text of a block the characters where its tokens begin and end.

        The vocabulary's tokens stand for fixed runs of bytes, so the ids tell their places. With whole, or where the
        cuts don't hold, every text is encoded by itself, and the places are those that the library gives.
        """
        if whole or not self.cuts_hold:
            yield from self._library_spans(b)
            return
        ids, counts = self.encode(b)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if (ends[-1] if len(ends) else 0) != len(b.data):
            raise ValueError("the tokens' bytes do not add up to the text")
        char = np.cumsum((b.data & 0xC0) != 0x80)  # characters up to and with each byte
        till = np.cumsum(counts)
        for i, j, at in zip((till - counts).tolist(), till.tolist(), b.offsets[:-1].tolist()):
            base = int(char[at - 1]) if at else 0
            yield np.column_stack([char[ends[i:j] - sizes[i:j]] - 1, char[ends[i:j] - 1]]) - base

    def _library_spans(self, b: W.Block) -> Iterator[np.ndarray]:
        raw, held, size = b.data.tobytes(), [], 0
        for row, (i, j) in enumerate(zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist())):
            held.append(raw[i:j].decode())
            size += j - i
            if size >= TOGETHER or row + 1 == len(b):
                for e in self.library.encode_batch(held, add_special_tokens=False):
                    yield np.array(e.offsets, np.int64).reshape(-1, 2)
                held, size = [], 0

    def encode(self, b: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, one after another, and how many each has."""
        starts, ends = _cuts(b) if self.cuts_hold else (np.zeros(0, np.int64),) * 2
        owner = np.searchsorted(b.offsets, starts, "right") - 1
        ids, lengths, differ = self._looked_up(b.data, starts, ends)
        odd = np.unique(np.concatenate([np.searchsorted(b.offsets, _odd(b.data), "right") - 1, owner[differ]])) if self.cuts_hold else np.arange(len(b))
        counts = np.bincount(owner, lengths, len(b)).astype(np.int64)
        if not len(odd):
            return ids, counts
        raw = b.data.tobytes()
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for row, own in zip(odd.tolist(), self.whole([raw[b.offsets[i] : b.offsets[i + 1]].decode() for i in odd.tolist()])):
            parts[row], counts[row] = own, len(own)
        return np.concatenate(parts), counts

    def _looked_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all pieces, how many each has, and which pieces are not those that the ids were made of."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = self._hashes(data, starts, ends)
        distinct, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.keep:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            self._learn(data, starts[where[new]], ends[where[new]], distinct[new])
            at = np.searchsorted(self.known, distinct)
        slots = self.slot[at][inverse]
        lengths = self.at[slots + 1] - self.at[slots]
        first = np.cumsum(lengths) - lengths
        ids = self.flat[np.repeat(self.at[slots] - first, lengths) + np.arange(int(lengths.sum()))]
        return ids, lengths, self._differing(data, starts, ends, slots)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return W.span_hashes(data, starts, ends)

    def _differing(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Which pieces have other bytes than the ones in their slots."""
        size, begin = ends - starts, self.text_at[slots]
        wrong = size != self.text_at[slots + 1] - begin
        size = np.where(wrong, 0, size)
        till = np.cumsum(size)
        k = np.arange(int(till[-1])) - np.repeat(till - size, size)
        bad = np.flatnonzero(self.text[np.repeat(begin, size) + k] != data[np.repeat(starts, size) + k])
        wrong[np.searchsorted(till, bad, "right")] = True
        return np.flatnonzero(wrong)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encodes pieces. Those that are a space and a word are encoded in one text: each begins with the one id
        that has a space in front, and no other id in it has one."""
        raw = data.tobytes()
        word = (data[starts] == 0x20) & (ends - starts > 1)
        word &= W.NOT_SPACE[data[np.minimum(starts + 1, len(data) - 1)]]
        order = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
        pieces = [raw[i:j] for i, j in zip(starts[order].tolist(), ends[order].tolist())]
        n = int(word.sum())
        together = self.library.encode_batch_fast([b"".join(pieces[k : min(k + 4096, n)]).decode() for k in range(0, n, 4096)], add_special_tokens=False)
        alone = [e.ids for e in self.library.encode_batch_fast([x.decode() for x in pieces[n:]], add_special_tokens=False)]
        ids = np.array(list(chain.from_iterable([*(e.ids for e in together), *alone])), np.uint32)
        m = sum(map(len, alone))
        heads = np.flatnonzero(self.spaced[ids[: len(ids) - m]])
        if len(heads) != n:
            raise ValueError("the vocabulary does not keep spaces in front of words")
        lengths = np.concatenate([np.diff(np.append(heads, len(ids) - m)), np.array([len(x) for x in alone], np.int64)])
        slots = len(self.at) - 1 + np.arange(len(order))
        self.flat = np.concatenate([self.flat, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(pieces), np.uint8)])
        self.text_at = np.concatenate([self.text_at, self.text_at[-1] + np.cumsum([len(x) for x in pieces])])
        known, slot = np.concatenate([self.known, hashes[order]]), np.concatenate([self.slot, slots])
        by = np.argsort(known, kind="stable")
        self.known, self.slot = known[by], slot[by]


def _cuts(b: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of a block's texts begin and end; together they are the texts."""
    data, s, e = b.data, b.starts, b.ends
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = _ASCII_LETTER[data[:-1]] & _ASCII_MARK[data[1:]]
    cut[b.offsets] = True
    if len(s):
        some = b.counts > 0
        before = np.empty(len(s), np.int64)  # where the white space before a word begins
        before[1:] = e[:-1]
        before[b.first[:-1][some]] = b.offsets[:-1][some]
        gap = s - before
        space = (gap > 0) & (data[s - 1] == 0x20)
        # A last space goes to the word, and what is before it is one piece. Without, the last character is a piece.
        cut[s - space] = True
        cut[before] = True
        cut[s[(gap > 1) & ~space] - 1] = True
        cut[e[b.first[1:][some] - 1]] = True
    starts = np.flatnonzero(cut[:-1])
    return starts, np.append(starts[1:], len(data)) if len(starts) else starts
