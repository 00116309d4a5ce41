import random
from fnmatch import fnmatchcase

from chronicle.llm.url_rules import RULES, Automaton, Rule, judge, split


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (len(r.name), len(r.host), -rules.index(r)))
    return host, path, best.name, best.verdict


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/",
    "http://a.www.example.com/en/b", "http://example.com/EN/", "http://notexample.com/en/", "http://x.net/es/", "http://net/fr/a#b",
    "http://foo.org/x.example.com/en/", "http://é.net/fr/ü", "x://y://net/es/", "http://example.com?/en/", "http://a.net/es" + "/b" * 5000,
]


def test_registered_rules(spark):
    rows = [(i, u, "t") for i, u in enumerate(URLS)] + [(None, URLS[6], None), (6, URLS[6], "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(map(tuple, judge(df).collect()), key=repr)
    assert got == sorted(((k, *brute(u, list(RULES))) for k, u, _ in rows), key=repr)
    assert judge(df.limit(0)).count() == 0
    assert judge(df, rules=()).filter("rule IS NOT NULL").count() == 0


def test_many_rules_over_several_words():
    rng = random.Random(9)
    name = lambda: ".".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, 3)))
    rules = [Rule(name(), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 3))), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = [f"http://{name()}/{''.join(rng.choice('ab/') for _ in range(rng.randint(0, 5)))}" for _ in range(300)]
    parts = [split(u.encode()) for u in urls]
    fits = Automaton(tuple(rules)).run(parts, len(rules))
    for (host, path), row in zip(parts, fits):
        host, path = host.decode(), path.decode()
        want = [(host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) for r in rules]
        assert row.tolist() == want


def test_globs():
    rng = random.Random(4)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    rules = tuple(Rule("", "", "block", host_glob="h*", path_glob=g) for g in globs)
    paths = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(200)]
    fits = Automaton(rules).run([(b"host", p.encode()) for p in paths], len(rules))
    assert fits.tolist() == [[fnmatchcase(p, g) for g in globs] for p in paths]
