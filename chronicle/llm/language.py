"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled sample text is built. A text is parsed greedily into phrases, each the longest
match with the language's sample; the number of phrases, times the bits that name a place in the sample, per symbol, estimates the cross
entropy, and the language with the least wins. Texts are lower-cased and reduced to letters, with one separator for each run of
anything else.

A whole text is one parse. To advance thousands of symbols at a time it is cut into pieces of `PIECE` symbols that are first parsed on their
own; then each piece is entered with the state its predecessor ended in and parsed again up to where both parses meet (from equal states they go on
alike), until no piece ends otherwise than its successor was told. All automata are one packed table of transitions, in which the rows of
states interlock; a worker reads it from the broadcast and keeps nothing of its own.

Every label is learned. The sample is bounded for each: `rows` rows in the order of a hash of the key, and from each at most `width` characters from a
place that the hash chooses. Only the sample, one automaton for each label (some 3 MB) and small counts reach the driver.

Defined results: `und` and score 0 for null text, text without a letter, or when nothing was learned. The score is the share by
which the runner-up's entropy exceeds the best (1 with a single language). Ties go to the language that sorts first. Repeated rows
are judged alike, rows without a key share one draw, an empty table gives an empty table. A prediction reads only the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronicle.llm.frames import as_bytes, keyed, released, small_batches

ROWS, WIDTH = 32, 1500
PIECE = 256  # symbols parsed on their own at first
BATCH = 400_000  # characters of texts taken together, or one longer text; symbols parsed together
SLICE = 512  # rows taken together at most
UNKNOWN = "und"
FEW = 200  # lanes below which they are parsed one by one
_LOW = (1 << 32) - 1
_OPEN = -1  # a code point that no table entry has been made for


class Alphabet:
    """Code points as symbols: 0 for what is no letter, then the sample's letters, then any other letter."""

    def __init__(self, letters: str):
        self.size = len(letters) + 2
        self.table = np.full(0x110000, _OPEN, np.int32)
        self.table[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        found = self.table[codes]
        if (unknown := found == _OPEN).any():
            for code in np.unique(codes[unknown]).tolist():
                self.table[code] = self.size - 1 if chr(code).isalpha() else 0
            found = self.table[codes]
        return found

    def normalised(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts end to end, where each text's begin, with the end of the last)."""
        lowered = [t.lower() for t in texts]
        ends = np.cumsum([len(t) for t in lowered])
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = self.symbols(codes)
        starts = np.concatenate([[0], ends]).astype(np.int64)
        before = np.zeros_like(symbols)
        before[1:] = symbols[:-1]
        begin = starts[:-1]
        before[begin[begin < len(symbols)]] = 0
        keep = (symbols != 0) | (before != 0)
        kept = np.zeros(len(symbols) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        return symbols[keep], kept[starts]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions symbol -> state of each state of the suffix automaton; state 0 is its root."""
    follow, link, length, last = [{}], [-1], [0], 0
    for symbol in symbols:
        made = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and symbol not in follow[state]:
            follow[state][symbol] = made
            state = link[state]
        if state >= 0:
            target = follow[state][symbol]
            if length[target] == length[state] + 1:
                link[made] = target
            else:
                copy = len(follow)
                follow.append(dict(follow[target]))
                length.append(length[state] + 1)
                link.append(link[target])
                link[target] = link[made] = copy
                while state >= 0 and follow[state].get(symbol) == target:
                    follow[state][symbol] = copy
                    state = link[state]
        last = made
    return follow


class Automaton(NamedTuple):
    """A packed automaton. A state is known by its base; its transition by a symbol is in slot base + symbol, if the upper half there is the base."""

    slots: np.ndarray  # (base of the owner << 32) + base of the target, or -1
    root: int
    size: int  # symbols of the sample


_WINDOW = 4096  # places tried at a time


def packed(symbols: np.ndarray, alphabet: int) -> Automaton:
    """The suffix automaton of a sample, its rows laid into one another where they leave gaps."""
    follow = suffix_automaton(symbols.tolist())
    room = 4 * sum(map(len, follow)) + 2 * len(follow) + 4 * alphabet + 2 * _WINDOW
    free, open_ = np.ones(room, bool), np.ones(room, bool)  # slots without a transition; bases without a state
    base = np.zeros(len(follow), np.int64)
    mark, degree = 0, 0
    for state in sorted((s for s in range(len(follow)) if len(follow[s]) > 1), key=lambda s: -len(follow[s])):
        row = np.array(sorted(follow[state]))
        if len(row) != degree:
            mark, degree = 0, len(row)
        while True:
            fits = open_[mark : mark + _WINDOW].copy()
            for symbol in row.tolist():
                fits &= free[mark + symbol : mark + symbol + _WINDOW]
            place = int(fits.argmax())
            if fits[place]:
                break
            mark += _WINDOW // 2
        base[state] = mark + place
        free[base[state] + row] = False
        open_[base[state]] = False
    single: dict[int, list[int]] = {}
    for state, row in enumerate(follow):
        if len(row) == 1:
            single.setdefault(next(iter(row)), []).append(state)
    for symbol, states in single.items():
        found = np.flatnonzero(free[symbol:] & open_[: room - symbol])[: len(states)]
        base[states] = found
        free[found + symbol] = open_[found] = False
    ends = [s for s in range(len(follow)) if not follow[s]]
    base[ends] = np.flatnonzero(open_)[: len(ends)]
    slots = np.full(int(base.max()) + alphabet, -1, np.int64)
    for state, row in enumerate(follow):
        for symbol, to in row.items():
            slots[base[state] + symbol] = (int(base[state]) << 32) + int(base[to])
    return Automaton(slots, int(base[0]), len(symbols))


class Model(NamedTuple):
    """What is learned: the alphabet's letters, and each language's packed automaton."""

    letters: str
    languages: list[str]
    automata: list[Automaton]


class Parser:
    """All languages' automata end to end, as one table."""

    def __init__(self, model: Model):
        self.languages, self.alphabet = model.languages, Alphabet(model.letters)
        first = np.cumsum([0, *(len(a.slots) for a in model.automata)]).tolist()
        parts = [np.where(a.slots < 0, -1, a.slots + ((begin << 32) + begin)) for a, begin in zip(model.automata, first)]
        self.slots = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.roots = np.array([a.root + begin for a, begin in zip(model.automata, first)], np.int64)
        self.bits = [float(np.log2(max(2, a.size))) for a in model.automata]
        # From a root by each symbol: where a phrase that could not go on begins anew.
        there = self.slots[self.roots[:, None] + np.arange(self.alphabet.size)] if parts else np.zeros((0, self.alphabet.size), np.int64)
        self.anew = np.where(there >> 32 == self.roots[:, None], there & _LOW, self.roots[:, None])

    def _moved(self, which: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, where a phrase has ended) of lanes of the languages `which`."""
        moved = self.slots[state + symbol]
        ended = moved >> 32 != state
        return np.where(ended, self.anew[which, symbol], moved & _LOW), ended

    def phrases(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(text, language): phrases of the whole parse of each text."""
        sizes, most = np.diff(at), max(PIECE, BATCH * 4 // max(4, len(self.roots)))
        out = np.zeros((len(sizes), len(self.roots)), np.int64)
        first = 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
            if last > first + 1 or sizes[first] <= most:
                out[first:last] = self._ended(symbols, at[first : last + 1], self.roots)[0]
            else:  # a long text, some of its symbols at a time
                state = self.roots
                for begin in range(at[first], at[first + 1], most):
                    some = np.array([begin, min(begin + most, at[first + 1])])
                    ended, state = self._ended(symbols, some, state)
                    out[first] += ended[0]
            first = last
        return out + (sizes > 0)[:, None]

    def _ended(self, symbols: np.ndarray, at: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((text, language): phrases that end in each text, states at the end of the last), entered with the states `entry`."""
        sizes, n = np.diff(at), len(self.roots)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = at[owner] + nth * PIECE
        length = np.minimum(PIECE, at[owner + 1] - start)
        order = np.argsort(-length, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        follows = np.full(len(order), -1, np.int64)  # the lane of the piece before, among the ordered ones
        later = np.flatnonzero(nth[order] > 0)
        follows[later] = place[order[later] - 1]
        behind = np.full(len(order) + 1, -1, np.int64)
        behind[follows[later]] = later
        start, length, owner = start[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(PIECE), side="left")
        which = np.arange(n)[:, None]
        count = np.zeros((n, len(order)), np.int32)
        state = np.repeat(entry[:, None], len(order), axis=1)
        steps = int(length[0]) if len(length) else 0
        states = np.zeros((steps, n, len(order)), np.int64)  # after each step
        ends = np.zeros((steps, n, len(order)), bool)
        for step in range(steps):
            lanes = int(active[step])
            moved, ended = self._moved(which, state[:, :lanes], symbols[start[:lanes] + step][None, :])
            state[:, :lanes] = states[step, :, :lanes] = moved
            ends[step, :, :lanes] = ended
            count[:, :lanes] += ended
        # Enter each piece with the state its predecessor ended in, up to where the parses meet.
        told = np.repeat(entry[:, None], len(order), axis=1)
        while True:
            right = np.where(follows >= 0, state[:, follows], entry[:, None])
            language, lane = np.nonzero(right != told)
            if not len(lane):
                break
            if len(lane) < FEW:  # long repeats, in which parses hardly meet: piece after piece
                self._go_on(nth[order[lane]].argsort(), language, lane, follows, behind, told, state, states, ends, count, symbols, start, length)
                break
            told[language, lane] = now = right[language, lane]
            for step in range(steps):
                going = step < length[lane]
                language, lane, now = language[going], lane[going], now[going]
                now, ended = self._moved(language, now, symbols[start[lane] + step])
                apart = now != states[step, language, lane]
                count[language, lane] += ended.astype(np.int32) - ends[step, language, lane]
                states[step, language, lane], ends[step, language, lane] = now, ended
                last = length[lane] == step + 1
                state[language[last], lane[last]] = now[last]
                language, lane, now = language[apart], lane[apart], now[apart]
                if not len(lane):
                    break
        out = np.zeros((len(sizes), n), np.int64)
        for i in range(n):
            out[:, i] = np.bincount(owner, count[i], len(sizes))
        return out, state[:, place[-1]] if len(place) else entry

    def _go_on(self, by, language, lane, follows, behind, told, state, states, ends, count, symbols, start, length) -> None:
        """Parses pieces that are entered otherwise than told, each on into its successors until the parses meet."""
        slots = memoryview(self.slots)
        for i, j in zip(language[by].tolist(), lane[by].tolist()):
            anew, now = self.anew[i].tolist(), int(state[i, follows[j]])
            while j >= 0 and told[i, j] != now:
                told[i, j], met, size = now, False, int(length[j])
                some, seen, ended = symbols[start[j] : start[j] + size].tolist(), states[:size, i, j].tolist(), 0
                for step in range(size):
                    moved = slots[now + some[step]]
                    if moved >> 32 == now:
                        now = moved & _LOW
                    else:
                        now, ended = anew[some[step]], ended + 1
                    if now == seen[step]:
                        met = True
                        break
                count[i, j] += ended - int(ends[: step + 1, i, j].sum())
                if met:
                    break
                state[i, j], j = now, int(behind[j])

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits per symbol of each text in each language, which texts have a letter)."""
        symbols, at = self.alphabet.normalised(texts)
        sizes = np.diff(at)
        return self.phrases(symbols, at) * np.array(self.bits) / np.maximum(sizes, 1)[:, None], sizes > 0

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return found
        entropies, lettered = self.entropies([t or "" for t in texts])
        best = entropies.argmin(axis=1)
        for i in np.flatnonzero(lettered).tolist():
            low = entropies[i, best[i]]
            rest = np.delete(entropies[i], best[i])
            second = rest.min() if len(rest) else np.inf
            found[i] = (self.languages[best[i]], float(min(1.0, 1 - low / second)) if second > 0 else 0.0)
        return found


Sample = tuple[tuple[str, tuple[str, ...]], ...]


def sample_of(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS, width: int = WIDTH
) -> Sample:
    """The training sample, bounded for each label: ((language, texts), ...), sorted by language."""
    source = keyed(labelled, key, _text=text, _lang=lang).filter("_text IS NOT NULL AND _lang IS NOT NULL")
    counts = source.groupBy("_lang").agg(F.count("*").alias("_n"))
    # Few rows besides the wanted ones pass the hash test, so the ranking never holds a language's rows in one task.
    draw = F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64("_key", F.lit(1)), F.greatest(F.lit(1), F.length("_text") - width + 1)) + 1
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_draw", "_key", "_text"))
    drawn = (
        source.withColumn("_draw", draw)
        .join(F.broadcast(counts), "_lang")  # one row for each label
        .filter(F.col("_draw") * F.col("_n") < 8 * rows)
        .withColumn("_text", F.col("_text").substr(place.cast("int"), F.lit(width)))
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= rows)
        .select("_lang", "_rank", "_text")
        .collect()
    )
    texts: dict[str, list[str]] = {}
    for language, _, words in sorted(drawn):
        texts.setdefault(language, []).append(words)
    return tuple((language, tuple(found)) for language, found in sorted(texts.items()))


def learned(sample: Sample) -> Model:
    """The automata of a sample."""
    letters = "".join(sorted({c for _, texts in sample for c in "".join(texts).lower() if c.isalpha()}))
    alphabet = Alphabet(letters)
    automata = [packed(alphabet.normalised([" ".join(texts)])[0], alphabet.size) for _, texts in sample]
    return Model(letters, [language for language, _ in sample], automata)


def _found(parser: Parser, column: pa.Array) -> list[tuple[str, float]]:
    """Predictions for a column of texts, `BATCH` characters at a time."""
    texts, out, first, size = [None if t is None else t.decode() for t in as_bytes(column)], [], 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (size and size + len(texts[i] or "") > BATCH):
            out += parser.predict(texts[first:i])
            first, size = i, 0
        if i < len(texts):
            size += len(texts[i] or "")
    return out


def identify(docs: DataFrame, sample: Sample, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of each row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(sample))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        parser = Parser(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                rows = _found(parser, part.column(1))
                columns = [part.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "lang_pred", "score"])

    source = keyed(docs, key, _text=text)
    kind = source.schema["_key"].dataType.simpleString()
    out = source.mapInArrow(predicted, f"_key: {kind}, lang_pred: string, score: double")
    return out.withColumnRenamed("_key", key)


def held_out(key: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns: learned from the rows that are not held out, predicted for all."""
    sample = sample_of(docs.filter(~held_out()))
    return identify(docs, sample).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame) -> DataFrame:
    """Documents in which a language is found, with all their columns. A rejected text's copies are rejected with it."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(sample_of(docs.filter(~held_out()))))
    place = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        parser = Parser(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                yield part.filter(pa.array([language != UNKNOWN for language, _ in _found(parser, part.column(place))]))

    return docs.mapInArrow(spoken, docs.schema)
