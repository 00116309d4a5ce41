"""Pairs of alike names without comparing all names of a block.

Names meet through a shared rare token. How many names a token has does not bound the work at it; these do:

- A name whose words are part of another's meets it at the rarest of its own tokens only.
- Names of one number meet by the number.
- Names that differ by few letters reach a `difflib` ratio of .85 only if their letters, as bags, differ in at most 15% of the joint
  length. The shared token is in both bags, so this holds for the rests as well. A token with more than `BLOCK` names lists
  them by both lengths and by a few letters that the rests must share: of bags with many letters in common, in one fixed order,
  the first of these stand early in both (a prefix filter with several elements). A name's lists depend on its length, not
  on the number of names; a list holds names that share up to `CHOSEN` of their rarer letters. Names of more than `LONG`
  letters may differ in so many that choices of letters tell little; they are listed by both lengths only.

Candidates are checked by edit distance in the JVM before the ratio of two names is asked for.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronicle.session import staged

FUZZY = 0.85
BLOCK = 256
CHOSEN, CHOICES, LONG = 6, 220, 28
_SLACK = 1e-9
# Any fixed order gives the same pairs; letters that are frequent in names come last.
_ORDER = {letter: rank for rank, letter in enumerate("qxwjyzkfvhgbpudmtclsrnoiea ")}


def bound(joint: int) -> int:
    """Letters by which two names of this joint length may differ."""
    return floor(joint * (1 - FUZZY) + _SLACK)


def _partners(length: int) -> list[int]:
    """Lengths of the names that may be alike to one of this length."""
    found = [length]
    while found[-1] + 1 - length <= bound(length + found[-1] + 1):
        found.append(found[-1] + 1)
    shorter = length - 1
    while shorter > 0 and length - shorter <= bound(length + shorter):
        found.append(shorter)
        shorter -= 1
    return found


def _in_order(rest: str) -> list[str]:
    """Its letters and blanks, repeats numbered, those first that are rare in names."""
    seen: dict[str, int] = {}
    numbered = []
    for letter in sorted(rest, key=lambda c: (_ORDER.get(c, -1), c)):
        seen[letter] = seen.get(letter, 0) + 1
        numbered.append(letter * seen[letter])
    return numbered


def signatures(rest: str, length: int) -> list[str]:
    """Lists of a name of this length whose letters and blanks beside the shared token are `rest`.

    For each length of a partner the two rests share at least `common` letters, so of these the first
    `chosen` stand early in both, and each choice of so many early letters is a list.
    """
    found, letters = set(), _in_order(rest)
    for other in _partners(length):
        size = other - length + len(letters)
        common = max(-(-(len(letters) + size - bound(length + other)) // 2), 0)
        spare = max(len(letters), size) - common
        most = min(common, CHOSEN) if max(length, other) <= LONG else 0
        chosen = next(k for k in range(most, -1, -1) if k < 2 or comb(spare + k, k) <= CHOICES)
        early = letters[: len(letters) - common + chosen]
        pair = f"{length}-{other}:"
        found.update(pair + ",".join(kept) for kept in combinations(early, chosen))
    return sorted(found)


def _signatures():
    @F.pandas_udf("array<string>")
    def of(rest: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([signatures(r, n) for r, n in zip(rest, length)], dtype=object)

    return of


def _side(rows: DataFrame, suffix: str, *keys: str) -> DataFrame:
    return rows.select(*keys, *(F.col(c).alias(f"{c}_{suffix}") for c in rows.columns if c not in keys))


def _with_rare(names: DataFrame, rare: DataFrame) -> DataFrame:
    """Names (normal, tokens, name_phone) that have a token of `rare` (token, identities), with all they have."""
    keyed = names.withColumn("token", F.explode("tokens")).join(rare.select("token", "identities"), "token")
    by_name = keyed.groupBy("normal", "tokens", "name_phone").agg(
        # Tokens of one name, the rarest first.
        F.array_sort(F.collect_list(F.struct("identities", "token"))).alias("rare")
    )
    return staged(by_name.withColumn("rare", F.col("rare.token")).withColumn("text", F.array_join("tokens", " ")))


def _same_number(rows: DataFrame) -> DataFrame:
    numbered = rows.filter("name_phone IS NOT NULL").drop("tokens")
    same = _side(numbered, "a", "name_phone").join(_side(numbered, "b", "name_phone"), "name_phone")
    return _pairs(same.filter((F.col("normal_a") < F.col("normal_b")) & F.arrays_overlap("rare_a", "rare_b")), "phone")


def same_numbers(names: DataFrame, rare: DataFrame) -> DataFrame:
    """Those of the candidates that are one number in two spellings."""
    return _same_number(_with_rare(names, rare))


def candidates(names: DataFrame, rare: DataFrame, block: int = BLOCK) -> DataFrame:
    """(name_a, name_b, text_a, text_b, kind): pairs name_a < name_b by number ("phone"), by words ("subset") or by letters ("near").

    `names` are (normal, tokens, name_phone), `rare` are (token, identities).
    """
    rows = _with_rare(names, rare)
    plain = rows.filter("name_phone IS NULL").drop("name_phone")
    return _same_number(rows).unionByName(_pairs(_subsets(plain), "subset")).unionByName(_pairs(_near(plain, block), "near"))


def _pairs(pairs: DataFrame, kind: str) -> DataFrame:
    return pairs.select(
        F.col("normal_a").alias("name_a"), F.col("normal_b").alias("name_b"), "text_a", "text_b", F.lit(kind).alias("kind")
    )


def _subsets(plain: DataFrame) -> DataFrame:
    """Names whose tokens are a proper part of another's."""
    small = plain.withColumn("token", F.element_at("rare", 1))
    large = plain.withColumn("token", F.explode("rare"))
    met = _side(small, "s", "token").join(_side(large, "l", "token"), "token").filter(
        (F.size("tokens_s") < F.size("tokens_l")) & (F.size(F.array_except("tokens_s", "tokens_l")) == 0)
    )
    first = F.col("normal_s") < F.col("normal_l")

    def ordered(column: str, smaller: str, larger: str) -> list[Column]:
        one, two = F.col(f"{column}_{smaller}"), F.col(f"{column}_{larger}")
        return [F.when(first, one).otherwise(two).alias(f"{column}_a"), F.when(first, two).otherwise(one).alias(f"{column}_b")]

    return met.select(*ordered("normal", "s", "l"), *ordered("text", "s", "l"))


def _near(plain: DataFrame, block: int) -> DataFrame:
    """Names that differ in both directions and by few edits."""
    spread = plain.withColumn("token", F.explode("rare"))
    sizes = spread.groupBy("token").agg(F.count("*").alias("names")).filter("names > 1")
    spread = staged(spread.join(sizes, "token"))
    few = spread.filter(F.col("names") <= block).withColumn("sign", F.lit(""))
    many = spread.filter(F.col("names") > block)
    rest = F.array_join(F.transform(F.array_remove("tokens", F.col("token")), lambda other: F.concat(other, F.lit(" "))), "")
    many = many.withColumn("sign", F.explode(_signatures()(rest, F.length("text"))))
    listed = few.unionByName(many).drop("names")
    joint = F.length("text_a") + F.length("text_b")
    edits = F.floor(joint * (1 - FUZZY) + _SLACK).cast("int")
    # A list names its own length first and then the partner's.
    turned = listed.withColumn("sign", F.regexp_replace("sign", r"^(\d+)-(\d+):", "$2-$1:"))
    met = _side(listed, "a", "token", "sign").join(_side(turned, "b", "token", "sign"), ["token", "sign"]).filter(
        (F.col("normal_a") < F.col("normal_b"))
        & (F.abs(F.length("text_a") - F.length("text_b")) <= edits)
        & (F.element_at(F.array_intersect("rare_a", "rare_b"), 1) == F.col("token"))
        & (F.size(F.array_except("tokens_a", "tokens_b")) > 0) & (F.size(F.array_except("tokens_b", "tokens_a")) > 0)
        & (F.levenshtein("text_a", "text_b") <= edits)
    )
    return met.select("normal_a", "normal_b", "text_a", "text_b").distinct()
