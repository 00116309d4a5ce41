"""Static range asymmetric numeral system for token ids, vectorised over lanes, blocks and checkpoints.

A block's ids are dealt in rows to `LANES` lanes, each with a 64-bit state of its own that gives and takes 32-bit words;
all lanes share one stream of words, in the order in which a decoder asks for them. Every `EVERY` rows a checkpoint holds the lanes'
states and the place in the words, so a block can be decoded from any checkpoint, and all stretches at once. The last row is
filled up with the block's last id. A block carries checksums of its ids and of its bytes.

Bytes of a block, little-endian: magic, ids, lanes, rows between checkpoints, words; crc32 of the ids as unsigned 32-bit
integers; for each checkpoint the number of words before it, and the states; the words; crc32 of all before.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20  # frequencies add up to 2^SCALE
LANES, EVERY = 64, 128
MAGIC = b"TRA1"
_HEAD = struct.Struct("<4sIIIII")
_LOW = np.uint64(1 << 31)  # states stay in [2^31, 2^63)
_SHIFT, _MASK, _WORD = np.uint64(SCALE), np.uint64((1 << SCALE) - 1), np.uint64(32)


class Table:
    """Frequencies of ids, scaled to 2^SCALE; every id that occurs has at least 1."""

    def __init__(self, frequencies: np.ndarray):
        self.frequency = frequencies.astype(np.uint64)
        self.before = np.cumsum(self.frequency) - self.frequency
        kind = np.uint16 if len(frequencies) <= 1 << 16 else np.uint32
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=kind), frequencies.astype(np.int64))

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        return cls(scaled(counts))


def scaled(counts: np.ndarray) -> np.ndarray:
    total, size = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > size:
        raise ValueError(f"more than {size} different ids")
    out = np.where(counts > 0, np.maximum(1, np.floor(counts / total * size)), 0).astype(np.int64)
    # What is missing or too much goes to the most frequent ids, which it changes least.
    order = np.argsort(-counts, kind="stable")
    gap = size - int(out.sum())
    if gap > 0:
        out[order[0]] += gap
    place = 0
    while gap < 0:
        take = min(-gap, int(out[order[place]]) // 2)
        out[order[place]] -= take
        gap += take
        place = place + 1 if out[order[place]] > 1 else 0
    return out


def encode(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """Bytes of each block of ids (at least one id each)."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    rows = np.array([-(-len(blocks[i]) // LANES) for i in order], np.int64)
    most = int(rows[0])
    ids = np.empty((most, len(order), LANES), table.symbol.dtype)
    for n, i in enumerate(order):
        padded = np.full(int(rows[n]) * LANES, blocks[i][-1], table.symbol.dtype)
        padded[: len(blocks[i])] = blocks[i]
        ids[: rows[n], n] = padded.reshape(-1, LANES)
    words = np.empty(ids.shape, np.uint32)
    given = np.zeros(ids.shape, bool)
    state = np.full((len(order), LANES), _LOW, np.uint64)
    held: dict[int, np.ndarray] = {}
    active = np.searchsorted(-rows, -np.arange(most), side="left")
    for row in range(most - 1, -1, -1):
        n = int(active[row])
        x, symbols = state[:n], ids[row, :n]
        frequency = table.frequency[symbols]
        full = x >= frequency << np.uint64(63 - SCALE)
        given[row, :n] = full
        words[row, :n] = x & np.uint64(0xFFFFFFFF)
        x = np.where(full, x >> _WORD, x)
        high = x // frequency
        state[:n] = (high << _SHIFT) + (x - high * frequency) + table.before[symbols]
        if row % EVERY == 0:
            held[row] = state[:n].copy()
    out: list[bytes] = [b""] * len(blocks)
    for n, i in enumerate(order):
        own = given[: rows[n], n]
        stream = words[: rows[n], n][own]
        marks = range(0, int(rows[n]), EVERY)
        count = np.concatenate([[0], np.cumsum(own.sum(axis=1))])
        checks = b"".join(
            np.uint32(count[r]).tobytes() + held[r][n].astype("<u8").tobytes() for r in marks
        )
        crc = zlib.crc32(blocks[i].astype("<u4").tobytes())
        body = _HEAD.pack(MAGIC, len(blocks[i]), LANES, EVERY, len(stream), crc) + checks + stream.astype("<u4").tobytes()
        out[i] = body + struct.pack("<I", zlib.crc32(body))
    return out


def decode(blocks: list[bytes], table: Table) -> list[np.ndarray]:
    """The ids of each block. All stretches between checkpoints advance together."""
    streams, offset, parts = [], 0, []  # parts: (block, first row, rows, place in all words, states)
    sizes = []
    for i, block in enumerate(blocks):
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("a block's bytes differ from its checksum")
        magic, n, lanes, every, count, _ = _HEAD.unpack_from(block)
        if magic != MAGIC or lanes != LANES:
            raise ValueError("not a block of this format")
        rows = -(-n // LANES)
        sizes.append(n)
        place, step = _HEAD.size, 4 + 8 * LANES
        for first in range(0, rows, every):
            before = struct.unpack_from("<I", block, place)[0]
            states = np.frombuffer(block, "<u8", LANES, place + 4)
            parts.append((i, first, min(every, rows - first), offset + before, states))
            place += step
        streams.append(np.frombuffer(block, "<u4", count, place))
        offset += count
    if not blocks:
        return []
    parts.sort(key=lambda p: -p[2])
    stream = np.concatenate([*streams, np.zeros(LANES, "<u4")])
    state = np.stack([p[4] for p in parts]).astype(np.uint64)
    place = np.array([p[3] for p in parts], np.int64)
    length = np.array([p[2] for p in parts], np.int64)
    ids = np.empty((int(length[0]), len(parts), LANES), table.symbol.dtype)
    active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    for row in range(int(length[0])):
        n = int(active[row])
        x = state[:n]
        slot = x & _MASK
        symbols = table.symbol[slot]
        ids[row, :n] = symbols
        x = table.frequency[symbols] * (x >> _SHIFT) + slot - table.before[symbols]
        short = x < _LOW
        rank = np.cumsum(short, axis=1)
        taken = stream[np.minimum(place[:n, None] + rank - 1, len(stream) - 1)]
        state[:n] = np.where(short, (x << _WORD) | taken, x)
        place[:n] += rank[:, -1]
    out = [np.empty(-(-n // LANES) * LANES, table.symbol.dtype) for n in sizes]
    for n, (i, first, rows, _, _) in enumerate(parts):
        out[i][first * LANES : (first + rows) * LANES] = ids[:rows, n].ravel()
    found = [o[:n] for o, n in zip(out, sizes)]
    for block, own in zip(blocks, found):
        if zlib.crc32(own.astype("<u4").tobytes()) != _HEAD.unpack_from(block)[5]:
            raise ValueError("decoded ids differ from their checksum")
    return found
