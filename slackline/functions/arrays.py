"""Column functions. Work functions are arrays of BIGINT, one value for each configuration; points count from 0."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed multiplier of the portable hash (the golden ratio in 32 bits).
GOLDEN = 2654435761
MODULUS = 1 << 32


def portable_hash(value: Column, seed: int = 0) -> Column:
    """A hash that any engine with BIGINT arithmetic gives alike; in [0, 2^32)."""
    mixed = F.pmod(value, F.lit(MODULUS)) + F.lit(seed)
    first = F.pmod(F.pmod(mixed, F.lit(65_536)) * GOLDEN + F.floor(mixed / 65_536) * 40_503, F.lit(MODULUS))
    return F.pmod(F.pmod(first, F.lit(65_536)) * GOLDEN + F.floor(first / 65_536), F.lit(MODULUS))


def portable_hash_sql(value: str, seed: int = 0) -> str:
    """The same in DuckDB SQL."""
    mixed = f"((({value}) % {MODULUS} + {MODULUS}) % {MODULUS} + {seed})"
    first = f"((({mixed} % 65536) * {GOLDEN} + ({mixed} // 65536) * 40503) % {MODULUS})"
    return f"(({first} % 65536) * {GOLDEN} + ({first} // 65536)) % {MODULUS}"


def circle_distance(a: Column, b: Column, m: int | Column) -> Column:
    """Shortest way on a cycle of m points."""
    around = m if isinstance(m, Column) else F.lit(m)
    d = F.abs(a - b)
    return F.least(d, around - d)


def circle_distance_continuous(a: Column, b: Column, m: float) -> Column:
    """On a circle of length m; points are taken modulo m, negative ones too."""
    wrap = lambda x: F.pmod(x.cast("double"), F.lit(float(m)))
    d = F.abs(wrap(a) - wrap(b))
    return F.least(d, F.lit(float(m)) - d)


def antipode(x: Column, m: int) -> Column:
    return F.pmod(x + F.lit(m // 2), F.lit(m))


def set_distance(a: Column, b: Column, k: int, distance) -> Column:
    """The cheapest matching of two arrays of k points: the least over all k! assignments. For small k."""
    costs = [reduce(lambda x, y: x + y, (distance(a[i], b[p[i]]) for i in range(k))) for p in permutations(range(k))]
    return F.least(*costs) if len(costs) > 1 else costs[0]


def clique_cost(cfg: Column, k: int, distance) -> Column:
    """The sum of distances of all pairs in an array of k points."""
    pairs = [distance(cfg[i], cfg[j]) for i in range(k) for j in range(i + 1, k)]
    return reduce(lambda x, y: x + y, pairs, F.lit(0).cast("long"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: in a lambda, Catalyst would compute it again for every element."""
    return F.transform(F.array(value), body)[0]


def normalized(wf: Column) -> Column:
    return let(wf, lambda w: let(F.array_min(w), lambda low: F.transform(w, lambda x: x - low)))


def shifted(wf: Column, by: Column) -> Column:
    """Every value plus ``by``, which is computed once. No lambda stands in another: Python functions can't take those."""
    return F.zip_with(wf, F.array_repeat(by, F.size(wf)), lambda x, d: x + d)


def growth(before: Column, after: Column) -> Column:
    """The largest increase of any value (``ext``)."""
    return F.array_max(F.zip_with(before, after, lambda u, v: v - u))


def total(wf: Column) -> Column:
    return F.aggregate(wf, F.lit(0).cast("long"), lambda s, x: s + x)


def joined(values: Column) -> Column:
    """An array as text, for reports that engines compare."""
    return F.array_join(values.cast("array<string>"), ",")


def norms(coefs: Column) -> tuple[Column, Column]:
    """How many entries are not zero, and the sum of absolute values."""
    return F.size(F.filter(coefs, lambda c: c != 0)).cast("long"), F.aggregate(coefs, F.lit(0).cast("long"), lambda s, c: s + F.abs(c))
