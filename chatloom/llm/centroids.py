"""Centroid clustering over few-bit cells: whole vectors are fetched only where distance intervals overlap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.cells import Cells, finite, fit_cells, integer_vectors, table_of
from chatloom.llm.common import settle

STATE = "no long, codes binary, cluster int"
SUMS = "cluster int, n long, sums array<long>"


class Lookup:
    """What each cell adds to the distance from each centroid, less that from the mean of the centroids. The part that all centroids
    share is left out, so an interval is only as wide as the centroid is far from the mean. Of equal centroids the first stands
    for all: the others can't win."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        _, first = np.unique(centroids, axis=0, return_index=True)
        self.cells, self.numbers = cells, np.sort(first)
        self.c = centroids[self.numbers]
        mean = self.c.sum(0) // len(self.c)
        step, middle = (self.c - mean).T[:, None, :], (self.c + mean).T[:, None, :]
        ends = [step * (middle - 2 * e[:, :, None]) for e in (cells.low, cells.high)]      # dimension, cell, centroid
        self.least, self.most = np.minimum(*ends), np.maximum(*ends)

    def possible(self, codes: np.ndarray) -> np.ndarray:
        """Which centroids may be the nearest, one row per vector."""
        least, most = (np.zeros((len(codes), len(self.c)), np.int64) for _ in range(2))
        for d in range(self.cells.dims):
            least += self.least[d][codes[:, d]]
            most += self.most[d][codes[:, d]]
        return least <= most.min(1, keepdims=True)

    def nearest(self, x: np.ndarray, possible: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and exact squared distance of the nearest possible centroid, the smaller number in ties."""
        best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        for j, c in enumerate(self.c):
            rows = np.flatnonzero(possible[:, j])
            gap = x[rows] - c
            d = np.einsum("nd,nd->n", gap, gap)
            closer = d < best[rows]
            best[rows[closer]], at[rows[closer]] = d[closer], j
        return self.numbers[at], best


class _Moves:
    """Sums by cluster of the vectors that a task has moved."""

    def __init__(self, k: int, dims: int):
        self.n, self.sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)

    def add(self, clusters: np.ndarray, x: np.ndarray, sign: int) -> None:
        held = clusters >= 0
        np.add.at(self.n, clusters[held], sign)
        order = np.argsort(clusters[held], kind="stable")
        there, starts = np.unique(clusters[held][order], return_index=True)
        if len(there):
            self.sums[there] += sign * np.add.reduceat(x[held][order], starts, axis=0)

    def rows(self):
        import pandas as pd

        hit = np.flatnonzero((self.n != 0) | self.sums.any(1))
        if len(hit):
            yield pd.DataFrame({"no": pd.array([None] * len(hit), "Int64"), "codes": [b""] * len(hit), "cluster": hit, "n": self.n[hit], "sums": list(self.sums[hit])})


def _first_round(full: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """Cells and cluster of every vector, and their sums: each is read once, whole."""
    def run(frames):
        import pandas as pd

        look, moves = Lookup(cells, centroids), _Moves(len(centroids), cells.dims)
        for f in frames:
            if len(f):
                x = table_of(f["v"], cells.dims)
                codes = cells.codes(x)
                cluster, _ = look.nearest(x, look.possible(codes))
                moves.add(cluster, x, 1)
                yield pd.DataFrame({"no": f["no"].astype("Int64"), "codes": cells.packed(codes), "cluster": cluster, "n": 0, "sums": None})
        yield from moves.rows()

    return settle(full.select("no", "v").mapInPandas(run, f"{STATE}, n long, sums array<long>"), "round")


def _look(state: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """Who stays by its cells alone (``cluster`` = ``last``); who moves or is in doubt, with what is ``possible``."""
    def run(frames):
        import pandas as pd

        look = Lookup(cells, centroids)
        for f in frames:
            if len(f):
                possible = look.possible(cells.unpacked(f["codes"]))
                sure = np.where(possible.sum(1) == 1, look.numbers[possible.argmax(1)], -1)
                yield pd.DataFrame({"no": f["no"], "codes": f["codes"], "last": f["cluster"], "cluster": sure,
                                    "possible": [r.tobytes() for r in np.packbits(possible, axis=1)]})

    return settle(state.mapInPandas(run, "no long, codes binary, last int, cluster int, possible binary"), "looked")


def _decide(fetched: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """Exact nearest centroid of the vectors that were fetched, and what their moves add to and take from the sums."""
    def run(frames):
        import pandas as pd

        look, moves = Lookup(cells, centroids), _Moves(len(centroids), cells.dims)
        for f in frames:
            if len(f):
                x, last = table_of(f["v"], cells.dims), f["last"].to_numpy()
                bits = np.frombuffer(b"".join(f["possible"]), np.uint8).reshape(len(f), -1)
                cluster, _ = look.nearest(x, np.unpackbits(bits, axis=1, count=len(look.c)).astype(bool))
                moved = cluster != last
                moves.add(cluster[moved], x[moved], 1)
                moves.add(last[moved], x[moved], -1)
                yield pd.DataFrame({"no": f["no"].astype("Int64"), "codes": f["codes"], "cluster": cluster, "n": 0, "sums": None})
        yield from moves.rows()

    return settle(fetched.mapInPandas(run, f"{STATE}, n long, sums array<long>"), "round")


def _last_round(full: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """Cluster and exact distance of every vector. The distance is part of the result, so every vector is read."""
    row = full.schema["row"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        look = Lookup(cells, centroids)
        for b in batches:
            x = table_of(b.column("v").to_pylist(), cells.dims)
            cluster, distance = look.nearest(x, look.possible(cells.codes(x)))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["row", "cluster", "distance"])

    return settle(full.select("row", "v").mapInArrow(run, f"row {row}, cluster int, distance long"), "clustered")


def _add_up(sums: np.ndarray, counts: np.ndarray, round_: DataFrame) -> None:
    """Add what the tasks' moves come to: arrays are added up as arrays, in parts first, and a row per cluster comes back."""
    zero = F.array_repeat(F.lit(0).cast("long"), sums.shape[1])
    added = F.aggregate(F.collect_list("sums"), zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias("sums")
    moves = round_.filter("no is null")
    for by in (["cluster", F.pmod(F.xxhash64("sums"), F.lit(32))], ["cluster"]):
        moves = moves.groupBy(*by).agg(F.sum("n").alias("n"), added)
    for r in moves.select("cluster", "n", "sums").collect():
        counts[r["cluster"]] += r["n"]
        sums[r["cluster"]] += r["sums"]


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, bits: int = 6,
                    id_col: str = "vec_id", vector_col: str = "embedding", carry: list[str] | None = None) -> DataFrame:
    """Rounds of nearest centroid and new mean over floor(``scale`` * x) of all vectors with exactly ``dims`` finite components: ``row``
    (``carry``, by default all columns but the vector), cluster, squared ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid``.

    The first round writes a few-bit cell per component. Later rounds read cells only and look up distance intervals; a whole vector is
    joined in only if more than one centroid is possible or its cluster changes, and only moves are added to the sums. The last round
    reads all vectors again, because it returns distances. To the driver come sums by cluster and dimension.

    Null vectors, other lengths and vectors with null, NaN or infinite components are left out. A null id counts as the empty text where
    the first centroids are chosen; equal ids go by the vector's bytes. With fewer than ``k`` vectors each is a centroid. Ties go to the
    smaller number, centroids without vectors stay, repeated rows count as often as they come, no rows give none. Integers are held
    within 2 ** 24. Columns carried stay inside ``row`` and clash with nothing."""
    carry = [c for c in vectors.columns if c != vector_col] if carry is None else carry
    kept = vectors.filter((F.size(vector_col) == dims) & finite(F.col(vector_col)))
    full = integer_vectors(kept, scale, dims, id_col, vector_col, carry)
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = full.select("v", by_hash.alias("h")).orderBy("h", "v").limit(k).collect()
    if not first:
        none = full.select("row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.withColumns({"cluster_inertia": F.col("distance"), "inertia": F.col("distance"), "centroid": F.array().cast("array<long>")})
    cells = fit_cells(full, dims, bits)
    centroids = table_of([bytes(r["v"]) for r in first], dims)
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    whole = full.select("no", "v")
    state = None
    for _ in range(rounds):
        if state is None:
            moved = _first_round(full, cells, centroids)
            state = moved.filter("no is not null").select("no", "codes", "cluster")
        else:
            looked = _look(state, cells, centroids)
            moved = _decide(looked.filter("cluster <> last").join(whole, "no"), cells, centroids)
            stay = looked.filter("cluster = last").select("no", "codes", "cluster")
            state = stay.unionAll(moved.filter("no is not null").select("no", "codes", "cluster"))
        _add_up(sums, counts, moved)
        held = counts > 0
        centroids = centroids.copy()
        centroids[held] = sums[held] // counts[held][:, None]
    out = _last_round(full, cells, centroids)
    totals = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [(i, totals[i], sum(totals.values()), c.tolist()) for i, c in enumerate(centroids) if i in totals]
    facts = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(facts), "cluster").select("row", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid):
    """Lowercase hex sha256 of the components in decimal, joined by commas, as a column."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)
