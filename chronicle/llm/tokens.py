"""Token ids of whole texts with the `tokenizers` library, a batch of texts at a time.

Byte-level BPE first cuts a text into pretokens. A batch is cut, with numpy, only where a pretoken surely ends: before white
space that follows another character, around a single newline, and between a letter and a punctuation mark. The parts repeat:
each is known by two 64-bit polynomial hashes and its length, tokenised once and remembered by the Python worker (up to `PARTS`; the rest are
tokenised again in each batch) until a task of another operator runs there. The ids equal those of `encode(text, add_special_tokens=False)` on the whole text.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import regex

from chronicle.llm.frames import resident

PARTS = 1_000_000  # remembered parts of a Python worker, about 40 bytes each
BATCH_BYTES = 1 << 19  # texts are taken together up to this many bytes; a longer text is a batch of its own

# How the vocabulary file's pre-tokeniser cuts text (fixed value of the byte-level format).
_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The byte alphabet of byte-level BPE files (fixed values): printable bytes stand for themselves, the rest follow from 256.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def _byte_letters() -> dict[int, str]:
    others = [b for b in range(256) if b not in set(_PLAIN)]
    return {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(others)}


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes lie in one of the ranges, ends included."""
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


_SEEN = _table((0x21, 0x7E))  # visible ASCII
_LETTER = _table((0x41, 0x5A), (0x61, 0x7A))
_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_HIGH = _table((0x80, 0xFF))
_SPACE_END = np.isin(np.arange(256), [0xC2, 0x9A, 0x80, 0x81])  # byte before the last of white space beyond ASCII
_SPACE_START = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_LATIN_END = _table((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))  # after 0xC3: letters of Latin-1


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending positions at which parts begin: the starts of texts, and ends of pretokens inside them."""
    one, two = np.zeros_like(data), np.zeros_like(data)  # the bytes one and two places before
    one[1:], two[2:] = data[:-1], data[:-2]
    solid = _SEEN[one] | (_HIGH[one] & ~_SPACE_END[two])  # what stands before is surely not white space
    cut = solid & ((data == 0x20) | (data == 0x0A))
    word = _LETTER[one] | ((two == 0xC3) & _LATIN_END[one])
    cut |= word & _MARK[data]
    lone = np.zeros_like(cut)  # a newline after a solid character
    lone[1:] = cut[:-1] & (one[1:] == 0x0A)
    cut |= lone & (_SEEN[data] | (_HIGH[data] & ~_SPACE_START[data]))
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2^64, and of its inverse; kept for batches of ordinary size."""
    return _made_powers(which, BATCH_BYTES) if size <= BATCH_BYTES else _made_powers.__wrapped__(which, size)


@lru_cache(maxsize=2)
def _made_powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (int(_ODD[which]), pow(int(_ODD[which]), -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def part_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hash of each part, from one running sum over the batch."""
    power, inverse = _powers(which, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[which][data] * power[: len(data)], out=total[1:])
    return (total[end] - total[begin]) * inverse[begin]


class Tokens:
    """Ids of texts; `pool` holds the ids of remembered parts, found by their sorted first hash."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.split = regex.compile(_PRETOKENS).findall
        self.first = np.zeros(0, np.uint64)
        self.second = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def _part(self, part: bytes) -> list[int]:
        letters = part[1:] if part[:1] == b" " else part
        if letters.isalpha():
            return [t.id for t in self.model.tokenize(part.decode("latin-1").translate(self.letters))]
        text = part.decode()
        if "<|" in text:  # perhaps a special token
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return [
            t.id
            for piece in self.split(text)
            for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        ]

    def _make(self, raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new parts, end to end, and how many each has."""
        ids, counts = array("I"), []
        for a, b in zip(begin.tolist(), end.tolist()):
            made = self._part(raw[a:b])
            ids.extend(made)
            counts.append(len(made))
        return np.frombuffer(ids, np.uint32).astype(self.pool.dtype), np.array(counts, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's ids begin, with the end of the last)."""
        raw = b"".join(texts)
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=starts[1:])
        if not raw:
            return np.zeros(0, self.pool.dtype), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(raw, np.uint8)
        begin = cuts(data, starts)
        end = np.append(begin[1:], len(data))
        one, two = part_hashes(data, begin, end, 0), part_hashes(data, begin, end, 1)
        two = two * np.uint64(31) + (end - begin).astype(np.uint64)
        order = np.argsort(one)
        sorted_one, sorted_two = one[order], two[order]
        new = np.ones(len(order), bool)  # equal first hashes with other second ones are other parts
        new[1:] = sorted_one[1:] != sorted_one[:-1]
        # Two parts under one first hash: give each a place of its own in this batch.
        clash = np.zeros(len(order), bool)
        clash[1:] = ~new[1:] & (sorted_two[1:] != sorted_two[:-1])
        new |= clash
        heads = np.flatnonzero(new)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        key, check, sample = sorted_one[heads], sorted_two[heads], order[heads]
        place = np.searchsorted(self.first, key)
        place[place == len(self.first)] = 0
        known = (
            (self.first[place] == key) & (self.second[place] == check) if len(self.first) else np.zeros(len(key), bool)
        )
        fresh = np.flatnonzero(~known)
        ids, counts = self._make(raw, begin[sample[fresh]], end[sample[fresh]])
        pool = np.concatenate([self.pool, ids])
        at, count = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        at[known], count[known] = self.at[place[known]], self.count[place[known]]
        at[fresh], count[fresh] = len(self.pool) + np.cumsum(counts) - counts, counts
        if len(self.first) < PARTS and len(fresh):
            self._remember(key[fresh], check[fresh], at[fresh], counts, pool)
        lengths = count[which]
        done = np.zeros(len(which) + 1, np.int64)
        np.cumsum(lengths, out=done[1:])
        out = pool[np.repeat(at[which] - done[:-1], lengths) + np.arange(done[-1])]
        return out, done[np.searchsorted(begin, starts)]

    def _remember(self, key, check, at, count, pool) -> None:
        once = np.ones(len(key), bool)
        once[1:] = key[1:] != key[:-1]
        key, check, at, count = key[once], check[once], at[once], count[once]
        place = np.searchsorted(self.first, key)
        other = place < len(self.first)
        other[other] = self.first[place[other]] == key[other]  # the hash of another remembered part: leave it
        if other.any():
            key, check, at, count, place = (x[~other] for x in (key, check, at, count, place))
        self.first = np.insert(self.first, place, key)
        self.second = np.insert(self.second, place, check)
        self.at = np.insert(self.at, place, at)
        self.count = np.insert(self.count, place, count)
        self.pool = pool


def tokens(path: str) -> Tokens:
    """The one table of a Python worker for this vocabulary file."""
    return resident(("tokens", path), lambda: Tokens(path))


def batches(texts: list[bytes]):
    """(first, last) places of texts that are tokenised together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BATCH_BYTES:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
