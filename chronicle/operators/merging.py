"""The ordered merge of one connected part in which some merges are refused."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable


class _Clusters:
    """Disjoint sets with the phones each holds per source, and the sides of rejections it holds."""

    def __init__(self, phones: dict[str, dict[str, str]], rejected: Iterable[tuple[str, str, str]]) -> None:
        self.parent = {member: member for member in phones}
        self.size = dict.fromkeys(phones, 1)
        self.phones = {m: {s: {p} for s, p in held.items() if p} for m, held in phones.items()}
        self.sides: dict[str, dict[str, set[str]]] = {}
        for member, ruling, side in rejected:
            if member in phones:
                self.sides.setdefault(member, {}).setdefault(ruling, set()).add(side)

    def find(self, member: str) -> str:
        root = member
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[member] != root:
            self.parent[member], member = root, self.parent[member]
        return root

    def refuses(self, a: str, b: str) -> bool:
        held, other = self.phones[a], self.phones[b]
        if len(other) < len(held):
            held, other = other, held
        if any(len(held[s] | other[s]) > 1 for s in held if s in other):
            return True
        few, many = sorted((self.sides.get(a, {}), self.sides.get(b, {})), key=len)
        return any(len(few[r] | many[r]) > 1 for r in few if r in many)

    def unite(self, a: str, b: str) -> None:
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.parent[b] = a
        self.size[a] += self.size[b]
        for source, held in self.phones.pop(b).items():
            self.phones[a].setdefault(source, set()).update(held)
        for ruling, sides in self.sides.pop(b, {}).items():
            self.sides.setdefault(a, {}).setdefault(ruling, set()).update(sides)


def merge_component(facts: list[tuple[str, str, str, str | None]]) -> dict[str, str]:
    """identity -> smallest identity of its cluster.

    Facts are ("group", identity, group, spelling), ("source", identity, source, phone),
    ("merge", a, b, None) and ("reject", identity, ruling, side). Confirmed merges come first and are never
    refused. Then pairs of equal spelling or phone are tried, then pairs of equal words, both by
    (a, b). Once a pair is refused, everybody in its two clusters stays apart, so a group only
    keeps one list of members that are still outside, and never all of its pairs.
    """
    phones: dict[str, dict[str, str]] = defaultdict(dict)
    exact, loose = defaultdict(set), defaultdict(set)
    confirmed, rejected = [], []
    for what, a, b, c in facts:
        if what == "source":
            phones[a][b] = c
        elif what == "group":
            exact[b, c].add(a)
            if b.startswith("name:"):
                loose[b].add(a)
        elif what == "merge":
            confirmed.append((a, b))
        else:
            rejected.append((a, b, c))
    clusters = _Clusters(phones, rejected)
    for a, b in sorted(confirmed):
        if a in phones and b in phones and clusters.find(a) != clusters.find(b):
            clusters.unite(clusters.find(a), clusters.find(b))
    for groups in (exact, loose):
        _merge_level(clusters, groups)
    smallest: dict[str, str] = {}
    for member in sorted(phones):
        smallest.setdefault(clusters.find(member), member)
    return {member: smallest[clusters.find(member)] for member in phones}


def _merge_level(clusters: _Clusters, groups: dict) -> None:
    """Try the pairs of one score, by (a, b)."""
    outside = {name: sorted(members) for name, members in groups.items() if len(members) > 1}
    mine = defaultdict(list)
    for name, members in outside.items():
        for member in members:
            mine[member].append(name)
    for a in sorted(mine):
        partners = sorted({b for name in mine[a] for b in outside[name] if b > a})
        for b in partners:
            x, y = clusters.find(a), clusters.find(b)
            if x != y and not clusters.refuses(x, y):
                clusters.unite(x, y)
        root = clusters.find(a)
        for name in mine[a]:
            # Whoever is with a now needs no further pair in this group; the rest was refused.
            left = [b for b in outside[name] if b > a and clusters.find(b) != root]
            outside[name] = [] if _all_apart(clusters, left) else left


def _all_apart(clusters: _Clusters, members: list[str]) -> bool:
    """No two of these clusters can merge: they hold different phones of a common source."""
    roots = {clusters.find(member) for member in members}
    if len(roots) < 2:
        return True
    common = set.intersection(*(set(clusters.phones[root]) for root in roots))
    for source in common:
        held = [clusters.phones[root][source] for root in roots]
        if sum(map(len, held)) == len(set().union(*held)):
            return True
    return False
