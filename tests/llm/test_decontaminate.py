import hashlib
import random
import re

from chronicle.llm.decontaminate import contamination, digest, without_contaminated

SCHEMA = "doc_id long, text string, n_words string, _text int"
ITEMS = "item_id long, text string"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    out = []
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        for item, benchmark in items:
            theirs = words(benchmark)
            size = min(10, len(theirs))
            grams = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
            for i in range(len(own) - size + 1) if size else ():
                if tuple(own[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    if item is not None:
                        found.add(str(item))
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(own), len(hit), len(found), ids, bool(hit)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(8)
    pick = lambda n: " ".join(rng.choice(["a", "B", "ç", "d9", "E,f"]) for _ in range(n))
    items = [(i, pick(rng.randint(0, 25))) for i in range(25)] + [(7, None), (None, "a ç d9 B"), (3, pick(12)), (3, pick(12))]
    docs = [(i, pick(rng.randint(0, 80))) for i in range(60)]
    docs += [(90, None), (91, ""), (None, items[0][1]), (5, docs[5][1]), (92, pick(30000)), (93, "-".join(["a"] * 12))]
    docs += [(94, f"É{items[2][1]}"), (95, "x " + (items[1][1] or "") + ".")]
    return docs, items


def test_matches_brute_force_in_one_pass_and_in_many(spark):
    docs, items = cases()
    left = spark.createDataFrame([(*d, "n", 1) for d in docs], SCHEMA)
    right = spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert sorted(map(tuple, digest(left, right).collect()), key=repr) == want
    one = sorted(map(tuple, contamination(left, right).collect()), key=repr)
    assert sorted(map(tuple, contamination(left, right, automaton_bytes=150).collect()), key=repr) == one
    kept = without_contaminated(left, right)
    assert kept.columns == left.columns
    hit = {r[0] for r in want if r[5]}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, _ in docs if k not in hit)


def test_places_in_the_text_and_empty_tables(spark):
    text = "Well: é, THE quick--brown fox jumps over the lazy dog, again and so on."
    docs = spark.createDataFrame([(1, text, "n", 1)], SCHEMA)
    items = spark.createDataFrame([(4, "the quick brown fox jumps over the lazy dog again and")], ITEMS)
    (row,) = contamination(docs, items).collect()
    (run,) = row["runs"]
    assert text.encode()[run["begin"] : run["end"]] == b"THE quick--brown fox jumps over the lazy dog, again and"
    assert row["item_ids"] == ["4"] and row["n_hit"] == 11
    assert digest(docs, items.limit(0)).first()["n_hit"] == 0
    assert digest(docs.limit(0), items).count() == 0
