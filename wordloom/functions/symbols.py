"""Column expressions and constants of symbolisation: PAA, breakpoints, symbols, words, codes, Fourier rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this standard deviation a window has no shape.
FLAT = 1e-8


def breakpoints(alphabet: int) -> list[float]:
    """Edges that cut the standard normal in ``alphabet`` equally likely parts."""
    return [NormalDist().inv_cdf(i / alphabet) for i in range(1, alphabet)]


def paa_weights(length: int, segments: int) -> list[list[tuple[int, float]]]:
    """For each segment the points it averages with their weights; a point on an edge counts in part for both."""
    out = []
    for j in range(segments):
        lo, hi = j * length / segments, (j + 1) * length / segments
        share = [(i, (min(i + 1, hi) - max(i, lo)) * segments / length) for i in range(int(lo), min(length, math.ceil(hi)))]
        out.append([(i, w) for i, w in share if w > 1e-12])
    return out


def symbol(value: Column, edges: Sequence[float | Column]) -> Column:
    """How many edges are at or below the value; a value on an edge goes up."""
    total = F.lit(0)
    for e in edges:
        total = total + F.when(value >= e, 1).otherwise(0)
    return total


def word(symbols: Sequence[Column]) -> Column:
    """Letters from 'a', one a symbol."""
    return F.concat(*[F.char(s + 97) for s in symbols])


def code(symbols: Sequence[Column], alphabet: int) -> Column:
    """The symbols as digits of one whole number, the first the most significant."""
    total = F.lit(0).cast("long")
    for s in symbols:
        total = total * alphabet + s
    return total


def fourier_rows(length: int, n: int, drop_dc: bool = True) -> list[list[float]]:
    """Rows whose products with a window are real and imaginary parts of its discrete Fourier transform, in turn; zero rows if there are too few."""
    out: list[list[float]] = []
    k = 1 if drop_dc else 0
    while len(out) < n and k <= length // 2:
        out.append([math.cos(2 * math.pi * k * i / length) for i in range(length)])
        out.append([-math.sin(2 * math.pi * k * i / length) for i in range(length)])
        k += 1
    out += [[0.0] * length] * (n - len(out))
    return out[:n]


def entropy(counts: Sequence[Column]) -> Column:
    """Entropy in bits of class counts; a class of no rows adds nothing."""
    total = sum(counts[1:], counts[0])
    terms = [F.when((c > 0) & (total > 0), -(c / total) * F.log2(c / total)).otherwise(F.lit(0.0)) for c in counts]
    return sum(terms[1:], terms[0])


def mindist_cell(a: Column, b: Column, alphabet: int) -> Column:
    """Distance of two SAX symbols: 0 if they are the same or neighbours, else the gap between their edges."""
    edges = F.array(*[F.lit(x) for x in breakpoints(alphabet)])
    return F.when(F.abs(a - b) <= 1, F.lit(0.0)).otherwise(F.get(edges, (F.greatest(a, b) - 1).cast("int")) - F.get(edges, F.least(a, b).cast("int")))


def hash_order(key: Column | str, seed: int = 0) -> Column:
    """A whole number drawn from a long key, the same in any engine: a linear congruential step."""
    key = F.col(key) if isinstance(key, str) else key
    return (key * F.lit(1103515245) + F.lit(12345 + seed)) % F.lit(2147483648)
