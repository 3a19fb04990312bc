"""A keyed permutation of 0 .. n - 1 as a column expression: a Feistel network with cycle walking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of rounds, and steps of the cycle walk.
ROUND_PAIRS, WALK = 4, 64


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def permuted(x: Column, n: Column, key: Column) -> Column:
    """The place of x (0 .. n - 1) in a reproducible shuffle that n and key fix.

    The network works on pairs (left, right) of a grid of a x b places, a = ceil(sqrt(n)), b = ceil(n / a): each round
    adds a hash of one half to the other, modulo its side, so it is a bijection of the grid. Places from n on (fewer
    than a) are walked on until one below n comes. For n up to 4,096 at most a - 1 < WALK steps are needed; beyond, more
    than WALK steps have a chance below 1e-115, and raise an error instead of giving a wrong place.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    a = F.greatest(a, _long(1))
    b = div(n + a - 1, a)

    def step(y: Column) -> Column:
        return F.aggregate(
            F.array(*(F.lit(i) for i in range(ROUND_PAIRS))),
            F.struct(div(y, b).alias("l"), (y % b).alias("r")),
            lambda s, k: _pair(s, k),
            lambda s: s["l"] * b + s["r"],
        )

    def _pair(s: Column, k: Column) -> Column:
        left = (s["l"] + F.pmod(F.xxhash64(s["r"], k, key), a)) % a
        return F.struct(left.alias("l"), ((s["r"] + F.pmod(F.xxhash64(left, k + 1000, key), b)) % b).alias("r"))

    first = step(x)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        first,
        lambda y, _: F.when(y < n, y).otherwise(step(y)),
        lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")),
    )
    return F.when(first < n, first).otherwise(walked)
