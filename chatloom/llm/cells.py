"""Vectors of integers and their few-bit cells: the approximation files of operators 11 and 12."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import settle

#: Integers are held within these bounds, so that sums of products fit 64 bits. A component of an embedding is far below.
LARGEST = 1 << 24
#: Vectors from which the borders of cells are fitted. Any borders give the same results.
FITTED = 4096


def finite(vector: Column) -> Column:
    """A vector that is there, with no component null, NaN or infinite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(good, F.lit(False))


def integer_vectors(vectors: DataFrame, scale: int, dims: int, id_col: str, vector_col: str, carry: list[str]) -> DataFrame:
    """(no, id, v) and ``row`` if columns are carried, written to the shared folder: ``v`` holds floor(scale * x) of ``dims`` components as 32-bit integers, shorter
    vectors are filled up with 0. ``no`` numbers the rows. Expects finite vectors."""
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    d = vectors.select(F.monotonically_increasing_id().alias("no"), F.col(id_col).cast("long").alias("id"), *row, F.col(f"`{vector_col}`").alias("x"))
    pad = F.transform(F.sequence(F.lit(1), F.lit(dims) - F.size("x") + 1), lambda i: F.lit(0.0))
    d = d.withColumn("x", F.slice(F.concat(F.col("x").cast("array<double>"), pad), 1, dims))
    schema = d.drop("x").withColumn("v", F.lit(b"")).schema

    def floors(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)
            whole = np.clip(np.floor(scale * x), -LARGEST, LARGEST).astype("<i4")
            keep = [c for c in b.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([r.tobytes() for r in whole], pa.binary())], [*keep, "v"])

    return settle(d.mapInArrow(floors, schema), "vectors")


def table_of(packed, dims: int) -> np.ndarray:
    """Packed vectors as rows of 64-bit integers."""
    return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), dims).astype(np.int64)


class Cells:
    """Each dimension cut into at most 2 ** bits cells. ``low`` and ``high`` are the least and largest integer that a cell can
    hold, by dimension and cell."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int):
        self.bits, self.dims = bits, len(least)
        n = 1 << bits
        self.cuts = [np.unique(np.quantile(sample[:, d], np.arange(1, n) / n, method="nearest")) for d in range(self.dims)]
        self.low, self.high = (np.zeros((self.dims, n), np.int64) for _ in range(2))
        for d, cuts in enumerate(self.cuts):
            self.low[d, :len(cuts) + 1] = np.concatenate([[least[d]], cuts])
            self.high[d, :len(cuts) + 1] = np.concatenate([cuts - 1, [most[d]]])

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, d], side="right") for d, c in enumerate(self.cuts)], 1).astype(np.uint8)

    def packed(self, codes: np.ndarray) -> list[bytes]:
        single = (codes[:, :, None] >> np.arange(self.bits, dtype=np.uint8)) & 1
        return [r.tobytes() for r in np.packbits(single.reshape(len(codes), -1), axis=1)]

    def unpacked(self, column) -> np.ndarray:
        whole = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
        single = np.unpackbits(whole, axis=1, count=self.dims * self.bits).reshape(len(column), self.dims, self.bits)
        return single @ (1 << np.arange(self.bits))

    def bounds(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest value of each component."""
        d = np.arange(self.dims)
        return self.low[d, codes], self.high[d, codes]


def fit_cells(full: DataFrame, dims: int, bits: int, fitted: int = FITTED) -> Cells:
    """Borders from ``fitted`` vectors (those with the least hash of their number), extremes from all. ``full`` has rows and
    (no, v) columns. What comes back is bounded by ``fitted`` and by the number of dimensions."""
    def extremes(frames):
        import pandas as pd

        least = most = None
        for f in frames:
            if len(f):
                x = table_of(f["v"], dims)
                least = x.min(0) if least is None else np.minimum(least, x.min(0))
                most = x.max(0) if most is None else np.maximum(most, x.max(0))
        if least is not None:
            yield pd.DataFrame({"d": np.arange(dims), "least": least, "most": most})

    ends = (full.select("v").mapInPandas(extremes, "d int, least long, most long").groupBy("d")
            .agg(F.min("least").alias("least"), F.max("most").alias("most")).orderBy("d").collect())
    some = full.select("v", F.xxhash64("no").alias("h")).orderBy("h").limit(fitted).collect()
    sample = table_of([bytes(r["v"]) for r in some], dims)
    return Cells(sample, np.array([r["least"] for r in ends]), np.array([r["most"] for r in ends]), bits)
