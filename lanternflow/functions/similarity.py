"""Similarities of strings and token sets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity; equal strings, empty ones too, are 1 and a single empty one is 0.

    Each letter of a takes the first free equal letter of b within the window; the state holds b's taken places."""
    n, m = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))
    empty = F.struct(F.array().cast("array<int>").alias("mine"), F.array().cast("array<int>").alias("theirs"))

    def take(state: Column, i: Column) -> Column:
        places = F.sequence(F.greatest(i - reach, F.lit(1)), F.least(i + reach, m))
        free = F.filter(places, lambda j: (F.substring(b, j, F.lit(1)) == F.substring(a, i, F.lit(1))) & ~F.array_contains(state["theirs"], j))
        open_ = F.greatest(i - reach, F.lit(1)) <= F.least(i + reach, m)
        j = F.when(open_, F.try_element_at(free, F.lit(1)))
        return F.when(j.isNull(), state).otherwise(F.struct(F.concat(state["mine"], F.array(i)).alias("mine"), F.concat(state["theirs"], F.array(j)).alias("theirs")))

    def total(state: Column) -> Column:
        hits = F.size(state["mine"])
        pairs = F.zip_with(state["mine"], F.array_sort(state["theirs"]), lambda i, j: F.when(F.substring(a, i, F.lit(1)) != F.substring(b, j, F.lit(1)), 1).otherwise(0))
        swaps = F.floor(F.aggregate(pairs, F.lit(0), lambda x, y: x + y) / 2)
        return F.when(hits == 0, F.lit(0.0)).otherwise((hits / n + hits / m + (hits - swaps) / hits) / 3)

    steps = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(a == b, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(F.aggregate(steps, empty, take, total))


def common_prefix(a: Column, b: Column, most: int = 4) -> Column:
    out = F.lit(0)
    for k in range(1, most + 1):
        same = (F.substring(a, 1, k) == F.substring(b, 1, k)) & (F.least(F.length(a), F.length(b)) >= k)
        out = F.when(same, k).otherwise(out)
    return out


def winkler(similarity: Column, a: Column, b: Column, weight: float = 0.1) -> Column:
    """A Jaro similarity of at least 0.7, raised by a common prefix. similarity should be a column, as it is used thrice."""
    return F.when(similarity >= 0.7, similarity + common_prefix(a, b) * weight * (1 - similarity)).otherwise(similarity)


def jaro_winkler(a: Column, b: Column) -> Column:
    return F.element_at(F.transform(F.array(jaro(a, b)), lambda s: winkler(s, a, b)), 1)


def token_jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def token_containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def birth_date_agreement(a: Column, b: Column) -> Column:
    """Of normalised dates: 0 if one is missing, -1 if they differ where both are published, else more for more parts."""
    x, y = F.split(a, "-"), F.split(b, "-")
    n = F.least(F.size(x), F.size(y))
    grade = F.when(n == 1, 0.4).when(n == 2, 0.8).otherwise(1.0)
    return F.when((a == "") | (b == ""), 0.0).when(F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n), grade).otherwise(-1.0)
