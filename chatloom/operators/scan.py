"""Ordered scans that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(chat)`` sends a whole chat to one task. Here each key is cut into slices
of its order (``seq`` or ``screen_idx`` divided by a width, or a span of time), the window runs inside
a slice, and what earlier slices leave behind travels in a table with one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

ROWS_PER_SLICE = 65536
SCREENS_PER_SLICE = 1024


def slice_of(position: Column | str, width: int) -> Column:
    c = F.col(position) if isinstance(position, str) else position
    return F.floor(c / F.lit(width)).cast("long")


def with_halo(df: DataFrame, position: str, width: int, back: int) -> DataFrame:
    """Cut into slices and copy the last ``back`` positions of each slice into the next one, so that a
    look-back of at most ``back`` positions never leaves a slice. Copies carry ``_ghost = true``."""
    own = F.struct(slice_of(position, width).alias("s"), F.lit(False).alias("g"))
    copy = F.struct((slice_of(position, width) + 1).alias("s"), F.lit(True).alias("g"))
    homes = F.when(F.pmod(F.col(position), F.lit(width)) >= width - back,
                   F.array(own, copy)).otherwise(F.array(own))
    return (df.withColumn("_home", F.explode(homes))
              .withColumn("_slice", F.col("_home.s")).withColumn("_ghost", F.col("_home.g"))
              .drop("_home"))


def carry_scan(df: DataFrame, keys: list[str], piece: Column, order: list[Column],
               last: dict[str, Column] | None = None, total: dict[str, Column] | None = None,
               before: bool = False) -> DataFrame:
    """Per ``keys`` in ``order``: the last non-null value of each ``last`` expression and the running sum
    of each ``total`` expression, up to and including the row (``before``: excluding it).

    ``piece`` must never decrease along ``order``; it names the slice a row belongs to.
    """
    last, total = last or {}, total or {}
    cut = df.withColumn("_slice", piece)
    names = [*last, *total]
    inside = (Window.partitionBy(*keys, "_slice").orderBy("_turn", *order)
              .rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow))
    position = F.struct(*order)
    ends = cut.groupBy(*keys, "_slice").agg(
        *[F.max_by(e, F.when(e.isNotNull(), position)).alias(n) for n, e in last.items()],
        *[F.sum(e).alias(n) for n, e in total.items()])
    earlier = (Window.partitionBy(*keys).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(
        *keys, "_slice",
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in last],
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in total])
    # what a slice receives joins it as a first row of its own: no join, and rows with a NULL key meet too
    received = carry.select(*keys, "_slice", F.lit(0).alias("_turn"), *[F.col(f"_carry_{n}").alias(f"_in_{n}") for n in names])
    rows = cut.select("*", F.lit(1).alias("_turn"), *[e.alias(f"_in_{n}") for n, e in {**last, **total}.items()])
    out = rows.unionByName(received, allowMissingColumns=True).select(
        "*", *[F.last(f"_in_{n}", ignorenulls=True).over(inside).alias(f"_out_{n}") for n in last],
        *[F.coalesce(F.sum(f"_in_{n}").over(inside), F.lit(0)).alias(f"_out_{n}") for n in total])
    out = out.filter("_turn = 1").drop(*[n for n in names if n in out.columns])
    return (out.select("*", *[F.col(f"_out_{n}").alias(n) for n in names])
            .drop("_slice", "_turn", *[f"_in_{n}" for n in names], *[f"_out_{n}" for n in names]))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the keys come once, from the left."""
    other = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & left[k].eqNullSafe(other[f"_r{i}"])
    return left.join(other, same, how).drop(*[f"_r{i}" for i in range(len(keys))])


def number_rows(df: DataFrame, keys: list[str], piece: Column, order: list[Column],
                name: str = "seq") -> DataFrame:
    """1-based dense position per key, without sending a key to one task."""
    return (carry_scan(df, keys, piece, order, total={name: F.lit(1)})
            .withColumn(name, F.col(name).cast("long")))


def number_by_ranges(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based dense position per key in any order, for keys and orders that offer no slices of their own.

    The ranges come from the data: Spark samples (keys, order) and deals rows out so that each range holds about as many, whether
    a key is large, undated or crowded into an hour. The ranges are written once, because a second sample would cut elsewhere;
    then counts per range are added up and rows numbered inside. ``order`` must tell the rows of a key apart, or many equal
    rows share a range."""
    cut = settle(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    return number_rows(cut, keys, F.col("_range"), order, name).drop("_range")


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], make, schema: str) -> DataFrame:
    """Walk each key's rows in order with a small Python fold.

    Rows arrive as sorted Arrow batches, so memory does not depend on the size of a key. ``make()`` gives a
    fold for the next key. It takes rows one by one, ``row(values) -> rows``, or the rows of a batch at
    once, ``run(columns) -> columns``; ``end() -> rows`` closes the key. A fold marked ``keyed`` is made with its key. Values are the columns after the
    keys. Use it on keys that hold a bounded run (a slice) or on carry tables. Whole numbers among the keys
    travel as text: beside a NULL pandas would turn them into floats.
    """
    cols = [*keys, *[c for c in df.columns if c not in keys]]
    n = len(keys)
    fields = _split_fields(schema)
    out_names = [f.split()[0] for f in fields]
    whole = {k: t for k, t in df.dtypes if k in keys and t in ("tinyint", "smallint", "int", "bigint")}
    fields = [f"{name} string" if name in whole else f for name, f in zip(out_names, fields)]

    def run(batches):
        import numpy as np
        import pandas as pd

        def frame(pieces):
            """Output pieces (key, columns) as one frame."""
            pieces = [(k, c) for k, c in pieces if len(c[0])]
            if not pieces:
                return pd.DataFrame(columns=out_names)
            sizes = [len(c[0]) for _, c in pieces]
            out = {}
            for i, name in enumerate(out_names):
                if i < n:
                    each = pd.Series([k[i] for k, _ in pieces])
                    out[name] = each.repeat(sizes).to_numpy()
                elif isinstance(pieces[0][1][i - n], np.ndarray):
                    out[name] = np.concatenate([c[i - n] for _, c in pieces])
                else:
                    out[name] = pd.Series([v for _, c in pieces for v in c[i - n]], dtype=object)
            return pd.DataFrame(out)

        def rows(key, found):
            return (key, [list(c) for c in zip(*found)]) if found else (key, [[]])

        fold, current = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            by, values = [pdf[k].to_numpy() for k in cols[:n]], [pdf[c].to_numpy() for c in cols[n:]]
            change = np.zeros(len(pdf), dtype=bool)
            change[0] = True
            for k in by:
                blank = pd.isna(k)
                change[1:] |= (k[1:] != k[:-1]) & ~(blank[1:] & blank[:-1])
            starts = np.flatnonzero(change)
            pieces = []
            for s, e in zip(starts, [*starts[1:], len(pdf)]):
                key = tuple(None if pd.isna(k[s]) else k[s] for k in by)
                if fold is None or key != current:
                    if fold is not None:
                        pieces.append(rows(current, fold.end()))
                    fold, current = make(key) if getattr(make, "keyed", False) else make(), key
                here = [v[s:e] for v in values]
                if hasattr(fold, "run"):
                    pieces.append((key, fold.run(here) or [[]]))
                else:
                    pieces.append(rows(key, [r for v in zip(*[h.tolist() for h in here]) for r in fold.row(v)]))
            yield frame(pieces)
        if fold is not None:
            yield frame([rows(current, fold.end())])

    sorted_rows = df.select(*cols).repartition(*keys).sortWithinPartitions(*keys, *order)
    as_text = sorted_rows.select(*[F.col(c).cast("string").alias(c) if c in whole else c for c in cols])
    return as_text.mapInPandas(run, ", ".join(fields)).select(*[F.col(c).cast(whole[c]).alias(c) if c in whole else c for c in out_names])


def _split_fields(schema: str) -> list[str]:
    """Top-level fields of a DDL schema."""
    depth, field, out = 0, "", []
    for ch in schema + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(field.strip())
            field = ""
        else:
            field += ch
    return out


def key_ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
