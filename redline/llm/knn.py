"""Exact top-k by inner product as a Voronoi kNN join.

With M the largest squared norm, an extra component sqrt(M - |x|^2) for data and
0 for queries makes the largest inner product the smallest distance. Pivots cut
the data into cells; each cell's summary (count, least and greatest distance to
the pivot, the k + 1 least distances) bounds how far a query's k-th neighbour
can be. A group of queries then needs of a cell only a ring of distances, or
nothing where the hyperplane between pivots is too far; the data in its rings
are replicated to it and solved in slices, and the slices' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from redline.llm.common import checkpointed

#: Most pivots (their vectors and summaries are broadcast), queries of a group, rows of a slice.
PIVOTS, GROUP, SLICE = 256, 1024, 20_000
SLACK = 1e-3


def integers(df: DataFrame, key: str, vector: str, factor: int) -> DataFrame:
    """Columns key and v (little-endian int64 components floor(factor * x)).

    Rows whose key or vector is null or empty, with a null or non-finite
    component, or of another length than the most common one (of equals the
    longest) are left out. A component beyond 2**52 is an error.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.col(f"`{key}`").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(good & finite).select(F.col(f"`{key}`").cast("long").alias("key"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (common["d"] if common else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = len(batch)
            x = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * factor).reshape(n, -1)
            if np.abs(x).max(initial=0) > 2.0**52:
                raise OverflowError("a component is too large to be an exact integer")
            packed = [row.tobytes() for row in x.astype("<i8")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["key", "v"])

    return rows.mapInArrow(run, "key long, v binary")


def unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floats where they are exact, else by 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("a score would not fit 64 bits")
    return a @ b.T


class Space:
    """Pivots, and the summaries of their cells; at most PIVOTS rows."""

    def __init__(self, pivots: np.ndarray, limit: float):
        self.limit = limit
        self.pivots = self.lift(pivots)

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x.astype(float)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.limit - (x * x).sum(1), 0))
        return np.column_stack([x, extra])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        squares = (lifted**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def summarise(self, rows: list, k: int) -> None:
        """From (cell, low, high, nearest): the bounds of each cell; an empty one is never needed."""
        n = len(self.pivots)
        self.low, self.high = np.full(n, np.inf), np.full(n, -np.inf)
        self.near = np.full((n, k + 1), np.inf)
        for cell, low, high, nearest in rows:
            self.low[cell], self.high[cell] = low, high
            self.near[cell, : len(nearest)] = nearest[: k + 1]
        self.between = self.distances(self.pivots)

    def rings(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and cell the least and greatest distance to the pivot that matters (least > greatest: none)."""
        d = self.distances(self.lift(queries, query=True))
        k = self.near.shape[1] - 1
        reach = np.stack([np.partition((row[:, None] + self.near).ravel(), k)[k] for row in d])[:, None] + SLACK
        own = d.argmin(1)
        apart = np.maximum(self.between[own], SLACK)
        plane = (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * apart)
        low, high = np.maximum(d - reach, self.low), np.minimum(d + reach, self.high)
        low[(plane > reach) & (np.arange(d.shape[1]) != own[:, None])] = np.inf
        return own, low - SLACK, high + SLACK


def top_k(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", factor: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k best other rows by exact integer inner product.

    Ties go to the smaller key. ``is_query`` is a condition on the column
    ``key``. See ``integers`` for rows that take no part; rows of one key are
    one row if their vectors are equal, and none is a candidate of its own key.
    """
    spark = df.sparkSession
    rows = checkpointed(integers(df, key, vector, factor).distinct())
    nearest = Window.partitionBy("v").orderBy("key")
    # of equal vectors a query can need the k smallest keys besides its own
    data = rows.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1).drop("nth")
    asked = rows.withColumnRenamed("key", key).where(is_query).withColumnRenamed(key, "key")
    queries = asked.select("v").distinct()
    n = data.count()
    n_queries = queries.count()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    wanted = max(1, min(PIVOTS, int(n**0.5)))
    share = min(1.0, 4 * wanted / n)
    sample = data.where(F.xxhash64(F.lit(3), "v").bitwiseAND(F.lit((1 << 53) - 1)) < F.lit(int(share * (1 << 53)))).select("v").distinct()
    pivots = unpack(pa.array([bytes(r["v"]) for r in sample.orderBy(F.xxhash64("v"), "v").limit(wanted).collect()] or [bytes(data.first()["v"])]))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array([float((unpack(batch.column(0)).astype(float) ** 2).sum(1).max())])], names=["m"])

    space = Space(pivots, data.select("v").mapInArrow(squares, "m double").agg(F.max("m")).first()[0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = space.distances(space.lift(unpack(batch.column(1))))
                cell = d.argmin(1)
                at = [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *at], names=["key", "v", "cell", "d"])

    placed = checkpointed(data.select("key", "v").mapInArrow(place, "key long, v binary, cell int, d double"))
    # each task sends its nearest k + 1 of a cell, then a cell's are merged
    first = Window.partitionBy("cell").orderBy("d")
    near = placed.select("cell", "d").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    near = near.groupBy("cell").agg(F.sort_array(F.collect_list("d")).alias("near"))
    ends = placed.groupBy("cell").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    space.summarise([tuple(r) for r in ends.join(near, "cell").collect()], k)

    counts = np.zeros(len(pivots), int)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = space.distances(space.lift(unpack(batch.column(0)), query=True)).argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32))], names=["v", "cell"])

    homes = checkpointed(queries.mapInArrow(home, "v binary, cell int"))
    for r in homes.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    # neighbouring pivots share a group until it is full; a fuller cell is cut into several
    start, parts, group, filled = np.zeros(len(pivots), int), np.ones(len(pivots), int), 0, 0
    for cell in np.argsort(space.between[0], kind="stable"):
        if filled and filled + counts[cell] > GROUP:
            group, filled = group + 1, 0
        parts[cell] = max(1, -(-int(counts[cell]) // GROUP))
        start[cell] = group
        filled += counts[cell]
        if parts[cell] > 1:
            group, filled = group + int(parts[cell]), 0
    named = F.array(*[F.lit(int(x)) for x in start]), F.array(*[F.lit(int(x)) for x in parts])
    at = F.get(named[0], F.col("cell")) + F.pmod(F.xxhash64("v"), F.get(named[1], F.col("cell"))).cast("int")
    grouped = homes.withColumn("grp", at)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            _, lo, hi = space.rings(unpack(batch.column(0)))
            none = lo > hi
            lo[none], hi[none] = np.inf, -np.inf
            of = batch.column(1).to_numpy()
            for g in np.unique(of).tolist():
                mine = of == g
                low[g] = np.minimum(low.get(g, np.inf), lo[mine].min(0))
                high[g] = np.maximum(high.get(g, -np.inf), hi[mine].max(0))
        for g in low:
            cells = np.flatnonzero(low[g] <= high[g])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells), g, np.int32)), pa.array(cells.astype(np.int32)), pa.array(low[g][cells]), pa.array(high[g][cells])],
                names=["grp", "cell", "low", "high"],
            )

    rings = grouped.select("v", "grp").mapInArrow(bound, "grp int, cell int, low double, high double")
    rings = rings.groupBy("grp", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    slices = max(1, -(-n // SLICE))
    needed = placed.join(rings, "cell").where("d between low and high")
    needed = needed.select("grp", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int").alias("slice"), "key", "v")
    asking = grouped.select("grp", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "v")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"v": [], "key": [], "score": []}
        if len(left) and len(right):
            q_rows = left["v"].combine_chunks()
            q = unpack(q_rows)
            keys, x = right["key"].to_numpy(), unpack(right["v"].combine_chunks())
            best_q, best_key, best_score = [np.zeros(0, np.int64) for _ in range(3)]
            for a in range(0, len(x), 4096):
                s = products(q, x[a : a + 4096])
                if s.shape[1] > k + 1:
                    least = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
                    at_q, at_x = np.nonzero(s >= least[:, None])
                else:
                    at_q, at_x = np.nonzero(np.ones(s.shape, bool))
                best_q = np.concatenate([best_q, at_q])
                best_key = np.concatenate([best_key, keys[a + at_x]])
                best_score = np.concatenate([best_score, s[at_q, at_x]])
                order = np.lexsort((best_key, -best_score, best_q))
                best_q, best_key, best_score = best_q[order], best_key[order], best_score[order]
                begin = np.searchsorted(best_q, best_q)
                keep = np.arange(len(best_q)) - begin <= k
                best_q, best_key, best_score = best_q[keep], best_key[keep], best_score[keep]
            out = {"v": q_rows.take(pa.array(best_q)), "key": best_key, "score": best_score}
        return pa.table({"v": pa.array(out["v"], pa.binary()), "key": pa.array(out["key"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    both = asking.groupBy("grp", "slice").cogroup(needed.groupBy("grp", "slice"))
    found = both.applyInArrow(solve, "v binary, key long, score long")
    order = [F.desc("score"), F.col("key")]
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy(*order))).where(F.col("nth") <= k + 1)
    mine = asked.select(F.col("key").alias("query_id"), "v").join(best, "v").where("query_id <> key")
    rank = F.row_number().over(Window.partitionBy("query_id", "v").orderBy(*order)).cast("int")
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias("vec_id"), "score")
