"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, and ends with the assistant. A dynamic program over
this automaton's states goes through the turns and chooses for each the cheapest of: keep it; merge it into the turn before; give it
another role; with empty turns inserted before it where the automaton asks for them. The repaired sequence is rendered between
markers; a turn's part of the rendering is its `fragment`, and the fragments of a conversation in order are its whole text, so no task
ever holds the texts of one conversation together.

Long conversations are split: rows are sorted by range, in the stated order, written, and numbered by range and place; a stretch is the
rows of a conversation among `STRETCH` numbers, so neither repeated or null turn numbers nor rows without a conversation id make it
longer. Each stretch gives the least costs from any state to any other (a 4 x 4 table), the tables of a conversation are chained, and
each stretch then repairs its turns between the two states the chain has chosen. Only roles are shuffled for that, one byte a turn goes
with a conversation's tables; texts move twice, into their range and with their stretch, and are rendered as they stream by.

Costs: merge 1, insertion 2, another role 3 (merging under another role: both). Ties: merge before a new turn, then the state that
comes first in (start, system, user, assistant).

Defined results: roles are compared in lower case without spaces around them; an unknown or null role always costs a relabel; null text
is empty; turns are ordered by turn (null first), then role, then a hash of the text, so equal turn numbers and repeated rows have a
place each; rows without a conversation id are one conversation; an empty table gives an empty table. Markers inside a text are broken by a space.
Only the four columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicle.llm.frames import kept

STRETCH = 4096
SLICE = 512  # rows that are Python objects at a time
MERGE, INSERT, RELABEL = 1, 2, 3
STATES = ("", "system", "user", "assistant")  # the role of the last turn; "" before the first
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
LAST = 3
_FAR = 1 << 40


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns that lead from one state to another."""
    found = {(s, s): () for s in NEXT}
    for start in NEXT:
        edge = [start]
        while edge:
            state = edge.pop(0)
            for after in NEXT[state]:
                if (start, after) not in found:
                    found[start, after] = (*found[start, state], after)
                    edge.append(after)
    return found


_WAYS = _insertions()


@lru_cache(maxsize=None)
def choice(role: int, before: int, after: int) -> tuple[int, bool, tuple[int, ...]] | None:
    """(cost, whether the turn is merged, inserted turns) of the cheapest way from state to state over a turn of this role."""
    wrong = 0 if role == after else RELABEL
    options = [(MERGE + wrong, True, ())] if before == after != 0 else []
    for state in NEXT:
        if after in NEXT[state] and (before, state) in _WAYS:
            options.append((INSERT * len(_WAYS[before, state]) + wrong, False, _WAYS[before, state]))
    return min(options, key=lambda o: (o[0], not o[1], o[2])) if options else None


def _forward(roles: tuple[int, ...], entry: int) -> tuple[list[int], list[int], list[tuple[int, ...]]]:
    """(cost, turns made) to each state after all roles, from `entry`, and each step's predecessors."""
    cost, made = [_FAR] * 4, [0] * 4
    cost[entry] = 0
    steps = []
    for role in roles:
        now, turns, from_ = [_FAR] * 4, [0] * 4, [0] * 4
        for after in range(4):
            for before in range(4):
                way = choice(role, before, after)
                if way and cost[before] + way[0] < now[after]:
                    now[after] = cost[before] + way[0]
                    turns[after] = made[before] + len(way[2]) + (not way[1])
                    from_[after] = before
        cost, made = now, turns
        steps.append(tuple(from_))
    return cost, made, steps


@lru_cache(maxsize=20_000)
def _short_table(roles: tuple[int, ...]):
    return _table(roles)


def _table(roles: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """Costs and made turns from each state to each other, row by row."""
    found = [_forward(roles, entry) for entry in range(4)]
    return [c for f in found for c in f[0]], [t for f in found for t in f[1]]


def repaired(roles: tuple[int, ...], entry: int, exit_: int) -> list[tuple[int, int]]:
    """(state before, state after) of each turn on the cheapest way between two states."""
    steps = _forward(roles, entry)[2]
    out, state = [], exit_
    for from_ in reversed(steps):
        out.append((from_[state], state))
        state = from_[state]
    return out[::-1]


def closing(state: int) -> tuple[int, ...]:
    return _WAYS[state, LAST]


def chain(tables: list[tuple[list[int], list[int]]]) -> list[tuple[int, int, int]]:
    """(entry, exit, turns made before) of each stretch on the cheapest way from start to a legal end."""
    cost, steps = [0, _FAR, _FAR, _FAR], []
    for costs, _ in tables:
        now, from_ = [_FAR] * 4, [0] * 4
        for after in range(4):
            for before in range(4):
                total = cost[before] + costs[4 * before + after]
                if total < now[after]:
                    now[after], from_[after] = total, before
        cost = now
        steps.append(from_)
    state = min(range(1, 4), key=lambda s: (cost[s] + INSERT * len(closing(s)), s))
    out = []
    for from_ in reversed(steps):
        out.append((from_[state], state))
        state = from_[state]
    made, found = 0, []
    for (entry, exit_), (_, turns) in zip(out[::-1], tables):
        found.append((entry, exit_, made))
        made += turns[4 * entry + exit_]
    return found


def _opened(state: int) -> str:
    return f"<|im_start|>{STATES[state]}\n"


_CLOSED = "<|im_end|>\n"


def fragment(text: str, first: bool, merged: bool, inserted: tuple[int, ...], state: int, end: tuple[int, ...] | None) -> str:
    """A turn's part of the rendering; `end` are the turns inserted after the last one (None before it)."""
    safe = text.replace("<|im_", "< |im_")
    if merged:
        out = "\n\n" + safe
    else:
        out = "" if first else _CLOSED
        out += "".join(_opened(s) + _CLOSED for s in inserted) + _opened(state) + safe
    if end is not None:
        out += _CLOSED + "".join(_opened(s) + _CLOSED for s in end)
    return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Table]]:
    """Consecutive rows with equal first two columns."""
    now, held = None, []
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        first = 0
        for i in range(len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                if first < i:
                    if held and now != keys[first]:
                        yield now, pa.Table.from_batches(held)
                        held = []
                    now = keys[first]
                    held.append(batch.slice(first, i - first))
                first = i
    if held:
        yield now, pa.Table.from_batches(held)


_OUT = "turn: bigint, role: string, action: string, role_out: string, out_turn: bigint, inserted: string, fragment: string"


def formatted(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stretch: int = STRETCH
) -> DataFrame:
    """One row for each turn: (key, turn, role, action, role_out, out_turn, inserted, fragment)."""
    kind = turns.schema[key].dataType.simpleString()
    code = F.coalesce(F.array_position(F.array(*map(F.lit, STATES[1:])), F.lower(F.trim(role))), F.lit(0)).cast("int")
    rows = turns.select(
        F.col(key).alias("_key"),
        F.col(turn).cast("long").alias("_turn"),
        F.coalesce(code, F.lit(0)).alias("_code"),
        F.col(role).alias("_role"),
        F.xxhash64(text).alias("_hash"),
        F.col(text).alias("_text"),
    )
    # The last column parts equal rows, any of which may come first; what is written fixes their order.
    order = ["_key", "_turn", "_role", "_hash", "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered, _ = kept(ranged.drop("_hash", "_tie").withColumn("_id", F.monotonically_increasing_id()), "turns")
    rows = numbered.withColumn("_stretch", F.floor(F.col("_id") / stretch))

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conversation, number), table in _stretches(batches):
            roles = tuple(table.column(2).to_pylist())
            costs, made = _short_table(roles) if len(roles) <= 64 else _table(roles)
            columns = [table.column(0).chunk(0).slice(0, 1), pa.array([number], pa.int64())]
            columns += [pa.array([x], pa.list_(pa.int64())) for x in (costs, made)] + [pa.array([bytes(roles)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_stretch", "costs", "made", "_codes"])

    plain = rows.select("_key", "_stretch", "_id", "_code")
    tables = (
        plain.repartition("_key", "_stretch").sortWithinPartitions("_key", "_stretch", "_id").select("_key", "_stretch", "_code")
        .mapInArrow(tabled, f"_key: {kind}, _stretch: bigint, costs: array<bigint>, made: array<bigint>, _codes: binary")
    )

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def solved() -> pa.RecordBatch:
            found = chain([(r["costs"], r["made"]) for r in held])
            last = [i == len(held) - 1 for i in range(len(held))]
            columns = [pa.array([r["_key"] for r in held], key_type[0]), pa.array([r["_stretch"] for r in held], pa.int64())]
            columns += [pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)]
            columns += [pa.array([f[2] for f in found], pa.int64()), pa.array(last), pa.array([r["_codes"] for r in held], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["_key", "_stretch", "_entry", "_exit", "_made", "_last", "_codes"])

        key_type: list = [None]
        for batch in batches:
            key_type[0] = batch.column(0).type
            for row in batch.to_pylist():
                if held and row["_key"] != now:
                    yield solved()
                    held = []
                now = row["_key"]
                held.append(row)
        if held:
            yield solved()

    plans = (
        tables.repartition("_key").sortWithinPartitions("_key", "_stretch")
        .mapInArrow(chained, f"_key: {kind}, _stretch: bigint, _entry: int, _exit: int, _made: bigint, _last: boolean, _codes: binary")
    )
    plans, _ = kept(plans, "plans")
    # A stretch's plan comes before its turns in one stream of rows.
    both = rows.withColumn("_kind", F.lit(1)).unionByName(plans.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    names = ["_key", "turn", "role", "action", "role_out", "out_turn", "inserted", "fragment"]

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        plan, ways, number = None, iter(()), 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part, which, out = batch.slice(start, SLICE), [], []
                for place, line in enumerate(part.to_pylist()):
                    if not line["_kind"]:
                        plan, number, left = line, line["_made"], len(line["_codes"])
                        ways = iter(repaired(tuple(line["_codes"]), line["_entry"], line["_exit"]))
                        continue
                    before, after = next(ways)
                    left -= 1
                    _, merged, inserted = choice(line["_code"], before, after)
                    number += len(inserted) + (not merged)
                    end = closing(after) if plan["_last"] and not left else None
                    action = ("merge" if merged else "keep") if line["_code"] == after else "merge_relabel" if merged else "relabel"
                    names_in = [STATES[s] for s in inserted] + [f"{STATES[s]} after" for s in end or ()]
                    made = fragment(line["_text"] or "", before == 0, merged, inserted, after, end)
                    which.append(place)
                    out.append((line["_turn"], line["_role"], action, STATES[after], number - 1, ",".join(names_in), made))
                columns = [part.column(0).take(pa.array(which, pa.int64()))]
                columns += [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, names)

    together = both.repartition("_key", "_stretch").sortWithinPartitions("_key", "_stretch", "_kind", "_id")
    return together.mapInArrow(rendered, f"_key: {kind}, {_OUT}").withColumnRenamed("_key", key)
