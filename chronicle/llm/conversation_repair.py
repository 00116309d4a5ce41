"""Repair of conversations by weighted CYK interval parsing.

A repaired conversation is one whose role initials match `(s?(ua)+)?`. The grammar is in Chomsky normal form with a non-terminal for each
pair of states of that pattern: X[p,q] derives a span of turns whose repaired form leads from p to q, by X[p,q] -> X[p,r] X[r,q] and, for one turn,
by an edit (keep, re-role, delete) closed under insertions on both sides. A cell holds the least (cost, audit) of its non-terminal, the
audit being the initials of the edits. A span's cells are the same for every place where it is split (a derivation of the whole passes some state
at each place), so the chart needs one split of each span: it is filled bottom-up by span length, 1, 2, 4 and so on, in time linear in the turns.

Turns are numbered by one range sort and cut into stretches of at most `STRETCH` turns, parsed independently; a conversation's stretches are then
chained over the four states. For the chain a stretch is 16 costs and ranks of its audits, no texts, so a conversation of any length passes
through a task in small memory. Least (cost, audit) composes: of two audits of equal cost for the same turns none is a prefix of the other, since
a longer one has more insertions.

Faults of a turn, the first that holds: blank (nothing but ASCII white space), duplicate (role and text stand earlier in the conversation), truncated (the last
visible character is none of `.!?`). Costs: keep 0, re-role to user or assistant 2, delete 3 (a must for blank and duplicate turns), insert an
empty user or assistant turn 2; a truncated turn that stays adds 1.

Defined results: turns are taken by turn number (nulls first), then role, then the md5 of the text; null roles and texts are read as one space; a null key is a
conversation; turns with equal numbers stay turns of their own; a conversation without turns has zeros, an empty audit and the hash of the empty text; an
empty table gives an empty table. Other columns are not read. One conversation's hash is made by one task, which streams its texts; so is its audit, one letter
for each edit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicle.llm.frames import keyed, kept

STRETCH = 2048
_WHITE = " \t\n\x0b\f\r"  # fixed values: ASCII white space
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the last repaired role
ENDS = (START, ASSISTANT)
STATES = range(4)
# From a state by a role's initial to a state.
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_INSERTED = re.compile(f"{INSERT}*")
ROLES = {"u": "user", "a": "assistant"}  # those an edit may give
_LEGAL = {"su", "ua", "au"}

Cell = tuple[int, str] | None
Cells = tuple[Cell, ...]  # by 4 * from + to


def _least(cells: Iterator[Cell]) -> Cell:
    return min((c for c in cells if c is not None), default=None)


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of a span from those of its two parts: X[p,q] -> X[p,r] X[r,q]."""
    out: list[Cell] = []
    for p in STATES:
        for q in STATES:
            best = None
            for r in STATES:
                a, b = left[4 * p + r], right[4 * r + q]
                if a is not None and b is not None:
                    made = (a[0] + b[0], a[1] + b[1])
                    if best is None or made < best:
                        best = made
            out.append(best)
    return tuple(out)


def _closure() -> Cells:
    """Insertions alone: the least way from each state to each."""
    cells: list[Cell] = [(0, "") if p == q else None for p in STATES for q in STATES]
    step = [
        (COSTS[INSERT], INSERT) if any(MOVES.get((p, i)) == q for i in ROLES) else None for p in STATES for q in STATES
    ]
    for _ in STATES:
        longer = combined(tuple(cells), tuple(step))
        cells = [_least(iter((a, b))) for a, b in zip(cells, longer)]
    return tuple(cells)


CLOSURE = _closure()


@lru_cache(maxsize=4096)
def leaf(initial: str, must_go: bool, truncated: bool) -> Cells:
    """Cells of one turn."""
    cells: list[Cell] = [None] * 16
    stay = int(truncated)
    for p in STATES:
        ways = [(4 * p + p, (COSTS[DELETE], DELETE))]
        if not must_go:
            if (p, initial) in MOVES:
                ways.append((4 * p + MOVES[p, initial], (COSTS[KEEP] + stay, KEEP)))
            ways += [(4 * p + MOVES[p, i], (COSTS[REROLE] + stay, REROLE)) for i in ROLES if i != initial and (p, i) in MOVES]
        for place, way in ways:
            cells[place] = _least(iter((cells[place], way)))
    return combined(combined(CLOSURE, tuple(cells)), CLOSURE)


Turn = tuple[str, bool, bool]  # role initial, must go, truncated


def chart(turns: tuple[Turn, ...]) -> Cells:
    """Cells of the whole span, bottom-up by span length."""
    spans = [leaf(*turn) for turn in turns]
    while len(spans) > 1:
        pairs = [combined(spans[i], spans[i + 1]) for i in range(0, len(spans) - 1, 2)]
        spans = pairs + spans[2 * len(pairs) :]
    return spans[0] if spans else CLOSURE


@lru_cache(maxsize=5000)
def _short(turns: tuple[Turn, ...]) -> Cells:
    return chart(turns)


def summary(cells: Cells) -> tuple[list[int | None], list[int], list[int]]:
    """(costs, ranks, trailing insertions) of a stretch, all that the chain needs of its audits.

    An audit is a stem that ends with an edit of a turn, and insertions behind it. `ranks` has, for 0 to 2 insertions put before, the place
    of each cell's stem among all of them.
    """
    stems = ["" if c is None else c[1].rstrip(INSERT) for c in cells]
    trailing = [0 if c is None else len(c[1]) - len(s) for c, s in zip(cells, stems)]
    front = [INSERT * k + s for k in range(3) for s in stems]
    place = {s: i for i, s in enumerate(sorted(set(front)))}
    return [None if c is None else c[0] for c in cells], [place[s] for s in front], trailing


class Chain:
    """The least way through a conversation's stretches, one stretch at a time; 4 bytes are kept of each."""

    def __init__(self):
        # By state: (cost, rank of the stem, insertions behind it).
        self.best: list[tuple[int, int, int] | None] = [(0, 0, 0), None, None, None]
        self.back = bytearray()

    def add(self, costs: list[int | None], ranks: list[int], trailing: list[int]) -> None:
        ways: list[tuple | None] = []
        for q in STATES:
            some = [
                (self.best[p][0] + costs[4 * p + q], self.best[p][1], ranks[16 * self.best[p][2] + 4 * p + q], trailing[4 * p + q], p)
                for p in STATES
                if self.best[p] is not None and costs[4 * p + q] is not None
            ]
            ways.append(min(some, default=None))
        place = {s: i for i, s in enumerate(sorted({w[1:3] for w in ways if w is not None}))}
        self.best = [None if w is None else (w[0], place[w[1:3]], w[3]) for w in ways]
        self.back += bytes(0 if w is None else w[4] for w in ways)

    def solved(self) -> tuple[int, list[int]]:
        """(cost, states at the borders of the stretches, start and end included)."""
        cost, *_, state = min((*self.best[s], s) for s in ENDS if self.best[s] is not None)
        states = [state]
        for i in range(len(self.back) // 4 - 1, -1, -1):
            state = self.back[4 * i + state]
            states.append(state)
        return cost, states[::-1]


def edits(audit: str, state: int, initials: list[str]) -> list[tuple[int, str, str]]:
    """(turn or -1, edit, repaired initial or '') for each letter of an audit that starts in a state."""
    out, turn = [], 0
    for letter in audit:
        if letter == DELETE:
            out.append((turn, letter, ""))
        else:
            initial = initials[turn] if letter == KEEP else next(
                i for i in ROLES if (state, i) in MOVES and (letter == INSERT or i != initials[turn])
            )
            out.append((-1 if letter == INSERT else turn, letter, initial))
            state = MOVES[state, initial]
        turn += letter != INSERT
    return out


def numbered(turns: DataFrame, key: str, turn: str, role: str, text: str, gone: str | None = None) -> DataFrame:
    """(_key, _turn, _role, _text, _gone, _id): turns in order, written once; `gone` marks rows that only name their conversation."""
    rows = turns.select(
        F.col(key).alias("_key"),
        F.col(turn).cast("long").alias("_turn"),
        F.coalesce(role, F.lit(" ")).alias("_role"),
        F.coalesce(text, F.lit(" ")).alias("_text"),
        (F.col(gone) if gone else F.lit(False)).alias("_gone"),
    )
    rows = rows.withColumn("_digest", F.md5("_text")).withColumn("_tie", F.monotonically_increasing_id())
    order = ["_key", "_turn", "_role", "_digest", "_tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    return kept(ranged.withColumn("_id", F.monotonically_increasing_id()), "turns")[0]


def faulty(rows: DataFrame) -> DataFrame:
    """Adds `_fault` (blank, duplicate, truncated or null) without the texts: (_key, _turn, _role, _gone, _id, _fault)."""
    last = F.right(F.rtrim("_text", F.lit(_WHITE)), F.lit(1))
    light = rows.select(
        "_key", "_turn", "_role", "_gone", "_id", "_digest",
        F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").alias("_own"),
    )
    # Only texts that stand twice in a conversation are joined; counting combines before the shuffle.
    again = (
        light.filter(~F.col("_gone")).groupBy("_key", "_role", "_digest")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
        .select(F.col("_key").alias("_k"), F.col("_role").alias("_r"), F.col("_digest").alias("_d"), "_first")
    )
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_role") == F.col("_r")) & (F.col("_digest") == F.col("_d"))
    later = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))
    fault = F.when(F.col("_own") == "blank", "blank").when(later, "duplicate").otherwise(F.col("_own"))
    return light.join(again, same, "left").select("_key", "_turn", "_role", "_gone", "_id", F.when(~F.col("_gone"), fault).alias("_fault"))


def _groups(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first `wide` columns, as tuples."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:wide] != now:
                yield now, held
                held = []
            now = row[:wide]
            held.append(row)
    if held:
        yield now, held


_FACTS = "blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, low: bigint, high: bigint, turns: bigint, first: string, last: string"


def charts(light: DataFrame, stretch: int) -> DataFrame:
    """One row for each stretch of a conversation: its summary, audits and counts."""
    kind = light.schema["_key"].dataType.simpleString()
    rows = light.withColumn("_stretch", F.floor(F.col("_id") / stretch))
    rows = rows.repartition("_key", "_stretch").sortWithinPartitions("_key", "_stretch", "_id")
    rows = rows.select("_key", "_stretch", "_turn", F.substring("_role", 1, 1).alias("_initial"), "_gone", "_fault")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, out = None, []

        def told() -> pa.RecordBatch:
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(columns, names)

        def typed(batches):
            nonlocal key_type
            for batch in batches:
                key_type = batch.column(0).type
                yield batch

        names = ["_key", "_stretch", "costs", "ranks", "trailing", "audits", *(c.split(":")[0] for c in _FACTS.split(", "))]
        types: list = []
        for (key, number), group in _groups(typed(batches), 2):
            types = [key_type, pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), *[pa.int64()] * 7, pa.string(), pa.string()]
            here = [(r[2], r[3], r[5]) for r in group if not r[4]]
            turns = tuple((i, f in ("blank", "duplicate"), f == "truncated") for _, i, f in here)
            cells = _short(turns) if len(turns) <= 32 else chart(turns)
            if turns:
                costs, ranks, trailing = summary(cells)
                audits = [None if c is None else c[1] for c in cells]
            else:
                costs = ranks = trailing = audits = None
            faults, numbers = [f for *_, f in here], [t for t, *_ in here if t is not None]
            facts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
            facts.append(sum(a[1] + b[1] not in _LEGAL for a, b in zip(here, here[1:])))
            facts += [min(numbers, default=None), max(numbers, default=None), len(set(numbers))]
            facts += [here[0][1] if here else None, here[-1][1] if here else None]
            out.append((key, number, costs, ranks, trailing, audits, *facts))
            if len(out) >= 500:
                yield told()
                out.clear()
        if out:
            yield told()

    columns = "costs: array<bigint>, ranks: array<bigint>, trailing: array<bigint>, audits: array<string>"
    return rows.mapInArrow(parsed, f"_key: {kind}, _stretch: bigint, {columns}, {_FACTS}")


class Facts:
    """A conversation's counts, from those of its stretches in order."""

    def __init__(self):
        self.counts, self.low, self.high, self.turns, self.last = [0, 0, 0, 0], None, None, 0, None

    def add(self, counts: list[int], low, high, turns: int, first: str | None, last: str | None) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        if self.last is not None and first is not None:
            self.counts[3] += self.last + first not in _LEGAL
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low = low if self.low is None else self.low
            self.high = high
        self.last = last if last is not None else self.last

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_PLAN = "_entry: int, _exit: int, _final: boolean, cost: bigint, gaps: bigint, blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint"


def chained(stretches: DataFrame) -> DataFrame:
    """One row for each stretch: the states between which its audit leads; the last one has the conversation's counts."""
    kind = stretches.schema["_key"].dataType.simpleString()
    names = ["_key", "_stretch", *(c.split(":")[0] for c in _PLAN.split(", "))]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def finished() -> Iterator[pa.RecordBatch]:
            cost, states = state["chain"].solved()
            found, size = state["facts"], len(state["numbers"])
            for first in range(0, size, 10_000):
                some = range(first, min(first + 10_000, size))
                ends = [i == size - 1 for i in some]
                total = [cost, found.gaps(), *found.counts]
                columns = [pa.array([state["key"]] * len(some), state["type"]), pa.array([state["numbers"][i] for i in some], pa.int64())]
                columns += [pa.array([states[i + j] for i in some], pa.int32()) for j in (0, 1)] + [pa.array(ends)]
                columns += [pa.array([x if e else None for e in ends], pa.int64()) for x in total]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for row in batch.to_pylist():
                if state and row["_key"] != state["key"]:
                    yield from finished()
                    state = {}
                if not state:
                    state = {"key": row["_key"], "type": batch.column(0).type, "chain": Chain(), "facts": Facts(), "numbers": []}
                state["numbers"].append(row["_stretch"])
                if row["costs"] is None:  # no turn: states stay, and so do the insertions behind the last one
                    state["chain"].back += bytes(STATES)
                else:
                    state["chain"].add(row["costs"], row["ranks"], row["trailing"])
                counts = [row[c] for c in ("blank", "duplicate", "truncated", "illegal")]
                state["facts"].add(counts, row["low"], row["high"], row["turns"], row["first"], row["last"])
        if state:
            yield from finished()

    small = stretches.drop("audits").repartition("_key").sortWithinPartitions("_key", "_stretch")
    return small.mapInArrow(solved, f"_key: {kind}, _stretch: bigint, {_PLAN}")


def repaired(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    gone: str | None = None, stretch: int = STRETCH,
) -> tuple[DataFrame, DataFrame]:
    """(edits, plans).

    Edits: (key, _id, _nth, turn, role, text, edit, fault), one row for each edit in the order of (_id, _nth); an inserted turn has no turn
    number, a deleted one keeps its role and text. Plans: one row for each stretch of a conversation, with the counts in the last one.
    """
    rows = numbered(turns, key, turn, role, text, gone)
    light, _ = kept(faulty(rows), "faults")
    stretches, _ = kept(charts(light, stretch), "charts")
    plans = chained(stretches).withColumnRenamed("_key", "_k").withColumnRenamed("_stretch", "_s")
    audit = F.get("audits", F.col("_entry") * 4 + F.col("_exit"))
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_stretch") == F.col("_s"))
    found = stretches.select("_key", "_stretch", "audits").join(plans, same).drop("_k", "_s")
    found, _ = kept(found.select("*", F.coalesce(audit, F.lit("")).alias("_audit")).drop("audits"), "plans")
    shown = rows.filter(~F.col("_gone")).select(
        "_key", F.floor(F.col("_id") / stretch).alias("_stretch"), F.lit(1).alias("_kind"), "_id", "_turn", "_role", "_text"
    )
    both = shown.unionByName(found.select("_key", "_stretch", F.lit(0).alias("_kind"), "_audit", "_entry"), allowMissingColumns=True)
    together = both.repartition("_key", "_stretch").sortWithinPartitions("_key", "_stretch", "_kind", "_id")
    kind = rows.schema["_key"].dataType.simpleString()
    names = ["_key", "_id", "_nth", "_turn", "_role", "_text", "edit"]

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        audit, state, place, last = "", START, 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part, out = batch.slice(start, 1024), []
                for row in part.select(["_kind", "_id", "_turn", "_role", "_text", "_audit", "_entry", "_key"]).to_pylist():
                    if not row["_kind"]:
                        audit, state, place = row["_audit"], row["_entry"], 0
                        continue
                    # The insertions before this turn, its edit, and those behind the stretch's last turn.
                    end = place + len(_INSERTED.match(audit, place)[0]) + 1
                    if _INSERTED.fullmatch(audit, end):
                        end = len(audit)
                    initials = [row["_role"][:1]]
                    for nth, (which, letter, initial) in enumerate(edits(audit[place:end], state, initials)):
                        kept_here = which == 0
                        name = row["_role"] if letter in (KEEP, DELETE) else ROLES[initial]
                        words = row["_text"] if kept_here else ""
                        out.append((row["_key"], row["_id"], nth, row["_turn"] if kept_here else None, name, words, letter))
                        state = MOVES[state, initial] if initial else state
                    place = end
                columns = [pa.array([o[0] for o in out], part.schema.field("_key").type)]
                columns += [pa.array([o[i + 1] for o in out], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, names)

    columns = f"_key: {kind}, _id: bigint, _nth: bigint, _turn: bigint, _role: string, _text: string, edit: string"
    made = together.mapInArrow(edited, columns)
    return made, found


def digest(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    gone: str | None = None, stretch: int = STRETCH,
) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation."""
    made, plans = repaired(turns, key, turn, role, text, gone, stretch)
    kind = made.schema["_key"].dataType.simpleString()
    lines = made.filter(F.col("edit") != DELETE).select(
        "_key", F.lit(1).alias("_kind"), "_id", "_nth", F.concat_ws(":", "_role", "_text").alias("_line")
    )
    ends = plans.filter("_final").select("_key", F.lit(0).alias("_kind"))
    streamed = ends.unionByName(lines, allowMissingColumns=True).repartition("_key").sortWithinPartitions("_key", "_kind", "_id", "_nth")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, first = None, None, True
        for batch in batches:
            done = []
            for name, which, line in zip(*(batch.column(c).to_pylist() for c in ("_key", "_kind", "_line"))):
                if not which:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state, first = name, hashlib.sha256(), True
                else:
                    state.update((line if first else "\n" + line).encode())
                    first = False
            key_type = batch.schema.field("_key").type
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((key_type, pa.string()))], ["_k", "_sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], key_type), pa.array([state.hexdigest()])], ["_k", "_sha"])

    hashes = streamed.select("_key", "_kind", "_line").mapInArrow(hashed, f"_k: {kind}, _sha: string")
    parts = F.sort_array(F.collect_list(F.struct("_stretch", "_audit")))
    totals = [F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    whole = plans.groupBy("_key").agg(*totals, F.concat_ws("", F.transform(parts, lambda x: x["_audit"])).alias("audit"))
    joined = whole.join(hashes, F.col("_key").eqNullSafe(F.col("_k")))
    return joined.select(F.col("_key").alias(key), *("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), F.col("_sha").alias("repaired_sha256"))


def damaged(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): turns damaged by a hash of key and turn; a dropped turn's row stays, marked."""
    source = keyed(turns, key, _turn=turn, _role=role, _text=text)
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("_key", "_turn")))
    rows = source.select(
        F.col("_key").alias("conv_id"), F.col("_turn").alias("turn"),
        *(F.coalesce(c, F.lit(" ")).alias(n) for c, n in (("_role", "role"), ("_text", "text"))),
        (F.crc32(name) % 20).alias("damage"),
    )
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("damage") == 3, 1).otherwise(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("damage") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")
