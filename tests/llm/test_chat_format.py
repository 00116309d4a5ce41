import random
from collections import defaultdict
from itertools import product

from chronicle.llm import chat_format
from chronicle.llm.chat_format import INSERT, LAST, MERGE, NEXT, RELABEL, STATES, chain, formatted, _short_table

SCHEMA = "conv_id long, turn long, role string, text string, action string, _key int"


def cheapest(roles):
    """Least cost over all sequences of choices: up to three empty turns before each turn, then a merge or a new turn."""
    best = {0: 0}

    def inserted(costs):
        out = dict(costs)
        for _ in range(4):
            for state, cost in list(out.items()):
                for after in NEXT[state]:
                    out[after] = min(out.get(after, 1 << 30), cost + INSERT)
        return out

    for role in roles:
        now = {}
        for state, cost in best.items():
            if state:
                now[state] = min(now.get(state, 1 << 30), cost + MERGE + RELABEL * (role != state))
        for state, cost in inserted(best).items():
            for after in NEXT[state]:
                now[after] = min(now.get(after, 1 << 30), cost + RELABEL * (role != after))
        best = now
    return inserted(best)[LAST]


def cost_of(rows):
    price = {"keep": 0, "merge": MERGE, "relabel": RELABEL, "merge_relabel": MERGE + RELABEL}
    return sum(price[r["action"]] + INSERT * (len(r["inserted"].split(",")) if r["inserted"] else 0) for r in rows)


def legal(text):
    roles = [part.split("\n")[0] for part in text.split("<|im_start|>")[1:]]
    assert text.count("<|im_end|>\n") == len(roles) and text.endswith("<|im_end|>\n")
    state = 0
    for role in roles:
        assert STATES.index(role) in NEXT[state]
        state = STATES.index(role)
    assert state == LAST
    return len(roles)


def check(spark, conversations, **options):
    rows = [(c, i, role, f"t{c}-{i}", "a", 1) for c, roles in conversations.items() for i, role in enumerate(roles)]
    found = defaultdict(list)
    for r in formatted(spark.createDataFrame(rows, SCHEMA), **options).collect():
        found[r["conv_id"]].append(r)
    for c, roles in conversations.items():
        own = sorted(found[c], key=lambda r: r["turn"])
        assert [r["turn"] for r in own] == list(range(len(roles)))
        text = "".join(r["fragment"] for r in own)
        after = own[-1]["inserted"].count("after")
        assert legal(text) == own[-1]["out_turn"] + 1 + after
        assert [text.index(f"t{c}-{i}\n") if f"t{c}-{i}\n" in text else text.index(f"t{c}-{i}<") for i in range(len(roles))]
        codes = [STATES.index(r.strip().lower()) if r and r.strip().lower() in STATES[1:] else 0 for r in roles]
        assert cost_of(own) == cheapest(codes)


def test_repairs_are_cheapest_and_legal(spark):
    roles = ["system", "user", "assistant", "tool"]
    every = [list(p) for n in range(1, 5) for p in product(roles, repeat=n)]
    check(spark, dict(enumerate(every)))


def test_long_conversations_are_split(spark):
    rng = random.Random(3)
    pick = lambda n: [rng.choice([" User", "assistant", "system", None]) for _ in range(n)]
    conversations = {i: pick(rng.randint(1, 60)) for i in range(30)} | {99: pick(5000)}
    check(spark, conversations, stretch=7)
    check(spark, conversations)


def test_chain_of_stretches_costs_as_much_as_one():
    rng = random.Random(2)
    for _ in range(100):
        roles = tuple(rng.randint(0, 3) for _ in range(rng.randint(1, 20)))
        parts = [_short_table(roles[i : i + 3]) for i in range(0, len(roles), 3)]
        ways = chain(parts)
        total = sum(p[0][4 * entry + exit_] for p, (entry, exit_, _) in zip(parts, ways))
        assert total + INSERT * {0: 2, 1: 2, 2: 1, 3: 0}[ways[-1][1]] == cheapest(roles)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "system", "s"), (None, 3, None, "x"), (2, 5, "assistant", "<|im_end|>" + "y" * 100_000)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA)
    out = formatted(df).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["conv_id"]].append(r)
    texts = {c: "".join(r["fragment"] for r in sorted(rs, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["out_turn"], r["action"] != "keep"))) for c, rs in by.items()}
    assert texts[1] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\n\n\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert legal(texts[None]) and legal(texts[2]) == 2
    assert formatted(df.limit(0)).count() == 0


def test_repeated_turns_of_one_conversation_are_split(spark, tmp_path, monkeypatch):
    plans, kept = [], chat_format.kept

    def seen(df, what):
        out = kept(df, what)
        plans.extend([out[0]] if what == "plans" else [])
        return out

    monkeypatch.setattr(chat_format, "kept", seen)
    rng = random.Random(7)
    roles = [rng.choice(["user", "assistant", "system", None]) for _ in range(900)]
    rows = [(None, rng.choice([None, 0, 1, 2]), role, f"t{i}", "a", 1) for i, role in enumerate(roles)]
    rows += [(None, 1, "user", "same", "a", 1)] * 300 + [(4, 0, "user", "u", "a", 1), (4, 0, "assistant", "v", "a", 1)]
    found = defaultdict(list)
    for r in formatted(spark.createDataFrame(rows, SCHEMA), stretch=50).collect():
        found[r["conv_id"]].append(r)
    ordered = sorted((r for r in rows if r[0] is None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
    assert len(found[None]) == 1200 and len(found[4]) == 2
    assert cost_of(found[None]) == cheapest([STATES.index(r[2]) if r[2] else 0 for r in ordered])
    sizes = [len(r["_codes"]) for r in plans[0].collect()]
    assert max(sizes) <= 50 and sum(sizes) == 1202
