"""URL filters: all glob rules run at once over each canonical URL as one bit-parallel Shift-And automaton.

The canonical form of a URL is its host, read from the first `://` up to `/`, `?`, `#` or the end with A-Z lower-cased, one
boundary symbol that no text contains, and its path, read up to `?`, `#` or the end. A rule is a glob over the host and one
over the path: `*` stands for any run of symbols (never across the boundary, which only the boundary matches), `?` for one.
Every position of every rule is one bit; the bits of all rules are packed into 64-bit words, word after word. A batch of URLs
advances together, one symbol at a time: shift, and with the symbol's mask, or with the bits that a `*` holds.

Defined results: a null URL, or one without `://`, has empty host and path and fits no rule; of several rules that fit, the
longest (host and path together) wins, then the longer host, then the one listed first. Long URLs only make their own batch
slower. Repeated rows are judged alike, an empty table gives an empty table, and no column but key and URL is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicle.llm.frames import as_bytes, keyed

_BOUNDARY, _ANY, _STAR = 256, 257, 258
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@dataclass(frozen=True)
class Rule:
    """`host` and all hosts below it, paths that begin with `path`; `host_glob` and `path_glob` override these readings."""

    host: str
    path: str
    verdict: str
    host_glob: str | None = None
    path_glob: str | None = None

    @property
    def name(self) -> str:
        return self.host + self.path

    def symbols(self) -> list[list[int]]:
        """The globs that stand for this rule, as symbols."""
        hosts = [_glob(self.host_glob)] if self.host_glob is not None else [
            _plain(self.host),
            [_STAR, *_plain("." + self.host)],
        ]
        path = _glob(self.path_glob) if self.path_glob is not None else [*_plain(self.path), _STAR]
        return [[*host, _BOUNDARY, *path] for host in hosts]


# The rules of the registered query (fixed values).
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def _plain(text: str) -> list[int]:
    return list(text.encode())


def _glob(text: str) -> list[int]:
    return [_STAR if b == 0x2A else _ANY if b == 0x3F else b for b in text.encode()]


class Automaton:
    """Masks of all globs: bit i of a rule is on when its first i symbols (stars aside) have been read."""

    def __init__(self, rules: tuple[Rule, ...]):
        globs = [(n, glob) for n, rule in enumerate(rules) for glob in rule.symbols()]
        width = sum(1 + sum(s != _STAR for s in glob) for _, glob in globs)
        self.words = max(1, -(-width // 64))
        bits = np.zeros((257, self.words * 64), bool)
        start, hold = np.zeros(self.words * 64, bool), np.zeros((2, self.words * 64), bool)
        self.ends: list[tuple[int, int]] = []  # (rule, bit)
        bit = 0
        for n, glob in globs:
            start[bit] = True
            for symbol in glob:
                if symbol == _STAR:
                    hold[0, bit] = True  # any symbol but the boundary
                    continue
                bit += 1
                if symbol == _ANY:
                    bits[:256, bit] = True
                else:
                    bits[symbol, bit] = True
            self.ends.append((n, bit))
            bit += 1
        # A start bit has no mask of its own, so the bit before it never flows into it.
        self.masks, self.start, self.hold = _packed(bits), _packed(start[None])[0], _packed(hold)

    def run(self, urls: list[tuple[bytes, bytes]], rules: int) -> np.ndarray:
        """(URL, rule): whether the rule fits."""
        order = np.array(sorted(range(len(urls)), key=lambda i: -len(urls[i][0]) - len(urls[i][1])), np.int64)
        lengths = np.array([len(urls[i][0]) + len(urls[i][1]) + 1 for i in order], np.int64)
        fits = np.zeros((len(urls), rules), bool)
        if not len(urls):
            return fits
        at = np.cumsum(lengths) - lengths
        symbols = np.empty(int(lengths.sum()), np.int16)
        for place, i in zip(at.tolist(), order.tolist()):
            host, path = urls[i]
            symbols[place : place + len(host)] = np.frombuffer(host, np.uint8)
            symbols[place + len(host)] = _BOUNDARY
            symbols[place + len(host) + 1 : place + len(host) + 1 + len(path)] = np.frombuffer(path, np.uint8)
        state = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")  # URLs longer than the step
        for step in range(int(lengths[0])):
            n = int(active[step])
            now, symbol = state[:n], symbols[at[:n] + step]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            stay = now & np.where((symbol == _BOUNDARY)[:, None], self.hold[1], self.hold[0])
            state[:n] = (moved & self.masks[symbol]) | stay
        for rule, bit in self.ends:
            fits[order, rule] |= (state[:, bit // 64] >> np.uint64(bit % 64)) & one == one
        return fits


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, the lowest bit first."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def split(url: bytes | None) -> tuple[bytes, bytes]:
    """(host, path)."""
    _, found, rest = (url or b"").partition(b"://")
    if not found:
        return b"", b""
    ends = [rest.find(mark) for mark in (b"/", b"?", b"#")]
    cut = min((e for e in ends if e >= 0), default=len(rest))
    path = rest[cut:]
    stop = min((e for e in (path.find(b"?"), path.find(b"#")) if e >= 0), default=len(path))
    return rest[:cut].translate(_LOWER), path[:stop]


def judge(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", key: str = "page_id", url: str = "url"
) -> DataFrame:
    """(key, host, path, rule, verdict) of each URL."""
    best = sorted(range(len(rules)), key=lambda n: (-len(rules[n].name), -len(rules[n].host), n))
    names = [rules[n].name for n in best] + [None]
    verdicts = [rules[n].verdict for n in best] + [default]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Automaton(rules)
        for batch in batches:
            urls = as_bytes(batch.column(1))
            parts = [split(u) for u in urls]
            fits = found.run(parts, len(rules))[:, best]
            fits[[b"://" not in (u or b"") for u in urls]] = False
            which = np.where(fits.any(axis=1), fits.argmax(axis=1), len(best)).tolist() if best else [0] * len(urls)
            columns = [
                batch.column(0),
                pa.array([p[0].decode() for p in parts], pa.string()),
                pa.array([p[1].decode() for p in parts], pa.string()),
                pa.array([names[w] for w in which], pa.string()),
                pa.array([verdicts[w] for w in which], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "host", "path", "rule", "verdict"])

    source = keyed(pages, key, _url=url)
    kind = source.schema["_key"].dataType.simpleString()
    out = source.mapInArrow(judged, f"_key {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("_key", key)
