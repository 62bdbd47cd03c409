"""Column functions on numeric vectors (pixel grids, embeddings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, let


def vector_dhash(c: Column | str, width: int | None = None) -> Column:
    """One bit per neighbouring pair: is the right one larger? ``width`` reads the vector as a grid with
    that many columns, so that no pair crosses a row."""
    v = as_col(c)
    at = F.sequence(F.lit(1), F.size(v) - 1)
    if width:
        at = F.filter(at, lambda i: i % width != 0)
    bits = F.transform(at, lambda i: F.when(F.get(v, i) > F.get(v, i - 1), "1").otherwise("0"))
    return F.concat(F.lit("i|"), F.array_join(bits, ""))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def vectors_equal(a: Column | str, b: Column | str, eps: float = 1.5) -> Column:
    """Same length and a mean absolute difference below ``eps``."""
    a, b = as_col(a), as_col(b)
    gap = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.when(F.size(a) != F.size(b), F.lit(False)).otherwise(_total(gap) / F.size(a) < eps)


def vectors_relate(a: Column | str, b: Column | str) -> Column:
    """Mean-centred normalised inner product; 0 where either side has no contrast."""
    a, b = as_col(a), as_col(b)

    def products(mean: Column) -> Column:
        def add(acc: Column, z: Column) -> Column:
            x, y = z["x"] - mean["a"], z["y"] - mean["b"]
            return F.struct((acc["xy"] + x * y).alias("xy"), (acc["xx"] + x * x).alias("xx"), (acc["yy"] + y * y).alias("yy"))

        both = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
        zero = F.struct(*[F.lit(0.0).alias(n) for n in ("xy", "xx", "yy")])
        return F.aggregate(both, zero, add, lambda s: F.struct(
            s["xy"].alias("xy"), (F.sqrt(s["xx"]) * F.sqrt(s["yy"])).alias("norm")))

    means = F.struct((_total(a) / F.size(a)).alias("a"), (_total(b) / F.size(b)).alias("b"))
    ratio = let(let(means, products), lambda p: F.when(p["norm"] > 1e-6, p["xy"] / p["norm"]).otherwise(0.0))
    return F.when(F.size(a) == F.size(b), ratio).otherwise(0.0)
