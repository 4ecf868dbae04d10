"""Exact top-k by inner product over a vector-approximation file.

Every vector is stored as one byte per component, the number of the cell it
falls in. From the cells alone a query's score is known within bounds. A first
scan of the cells finds for each query a score that k vectors certainly reach;
a second one takes the vectors whose upper bound is not below it, reads their
exact components best bound first, and stops when the k-th score found is above
every bound left.
"""

from __future__ import annotations

import bisect
import math
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import bounded_batches, col
from quayside.session import materialize, new_path

K = 10
SCALE = 1024
CELLS = 256
#: Queries that go out with one scan of the file.
QUERY_BLOCK = 2048
#: Squared length, after scaling, below which an inner product always fits a long.
#: Longer vectors are kept apart and multiplied as integers of any size.
LONGEST = 2.0**62
#: Queries that go out with one scan for longer vectors.
WIDE_BLOCK = 256
_ROWS = 512


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """The components as whole numbers; null if the vector takes no part or is longer than that."""
    length = _length(vector, scale)
    return F.when(F.coalesce(length < F.lit(LONGEST), F.lit(False)), F.transform(vector, lambda x: F.floor(_times(x, scale))))


def _times(x: Column, scale: int) -> Column:
    return x.cast("double") * F.lit(float(scale))


def _length(vector: Column, scale: int) -> Column:
    # A null component makes the length null, one that is not finite makes it no less than any bound.
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + _times(x, scale) * _times(x, scale))


def _wide(vector: Column, scale: int = SCALE) -> Column:
    """A long vector's components before they are made whole; null for the others.

    One whose product with the scale is infinite has no whole number and is
    treated as not finite.
    """
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(_times(x, scale)) < F.lit(float("inf")), F.lit(False)))
    long = F.coalesce(_length(vector, scale) >= F.lit(LONGEST), F.lit(False))
    return F.when(finite & long, F.transform(vector, lambda x: _times(x, scale)))


class _Cells:
    """The grid of one number of dimensions: the low edge and cell width of each."""

    def __init__(self, low: list[int], high: list[int]):
        self.low = np.array(low, np.int64)
        span = np.array(high, np.int64) - self.low + 1
        self.width = np.maximum(-(-span // CELLS), 1)

    def place(self, exact: np.ndarray) -> np.ndarray:
        return ((exact - self.low) // self.width).astype(np.uint8)

    def bounds(self, queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the cells' centres, and how far a score can be off, with rounding."""
        centres = self.low + cells.astype(np.float64) * self.width + (self.width - 1) / 2
        q = queries.astype(np.float64)
        reach = np.abs(q) @ ((self.width - 1) / 2)
        largest = np.maximum(np.abs(self.low), np.abs(self.low + self.width * CELLS)).astype(np.float64)
        slack = (np.abs(q) @ largest) * (len(self.low) + 2) * 2.0**-50
        return q @ centres.T, (reach + slack)[:, None]


class VectorFile:
    """The approximations and exact vectors of a table, written out."""

    def __init__(self, rows: DataFrame, grids: dict[int, _Cells], wide: DataFrame | None = None):
        """``wide`` has the long vectors: id, dims and the whole numbers as text."""
        self.rows, self.grids, self.wide = rows, grids, wide

    @classmethod
    def build(cls, vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> VectorFile:
        """Vectors and ids that are null, and vectors that hold a null or a value
        that is not finite, are left out. Repeated rows count once. Vectors of
        different lengths are kept apart, and so are those too long for an inner
        product of machine words.
        """
        spark = vectors.sparkSession
        bounded_batches(spark)
        usable = (
            vectors.select(col(vec_id).cast("bigint").alias("id"), scaled(col(vector), scale).alias("v"))
            .where("id IS NOT NULL AND v IS NOT NULL")
            .dropDuplicates(["id", "v"])
        )
        held = materialize(usable.withColumn("dims", F.size("v")), "va-exact")
        edges = (
            held.select("dims", F.posexplode("v").alias("at", "x"))
            .groupBy("dims", "at")
            .agg(F.min("x").alias("low"), F.max("x").alias("high"))
            .collect()
        )
        grids: dict[int, _Cells] = {}
        for d in {e.dims for e in edges}:
            own = sorted((e for e in edges if e.dims == d), key=lambda e: e.at)
            grids[d] = _Cells([e.low for e in own], [e.high for e in own])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, dims, lists = batch.columns
                size = dims.to_numpy()
                flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(size)))
                cells, exact = [], []
                for i, d in enumerate(size):
                    x = flat[at[i] : at[i + 1]]
                    cells.append(grids[d].place(x).tobytes() if d else b"")
                    exact.append(x.astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids, dims, pa.array(cells, pa.binary()), pa.array(exact, pa.binary())], ["id", "dims", "cells", "exact"]
                )

        made = held.select("id", "dims", "v").mapInArrow(place, "id bigint, dims int, cells binary, exact binary")
        long = vectors.select(col(vec_id).cast("bigint").alias("id"), _wide(col(vector), scale).alias("v"))
        long = long.where("id IS NOT NULL AND v IS NOT NULL")

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [[math.floor(x) for x in v] for v in batch.column("v").to_pylist()]
                text = [",".join(map(str, v)) for v in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(v) for v in rows], pa.int32()), pa.array(text, pa.string())], ["id", "dims", "exact"]
                )

        written = materialize(long.mapInArrow(whole, "id bigint, dims int, exact string").distinct(), "va-wide")
        return cls(materialize(made, "va-file"), grids, None if written.isEmpty() else written)

    def search(self, queries: DataFrame, k: int = K, block: int = QUERY_BLOCK) -> DataFrame:
        """The k best of all other ids for every row of ``queries`` (id, dims, exact).

        Columns query_id, rank, vec_id, score; ties go to the smaller id, and a
        query with fewer than k vectors of its length gets them all. The query
        set goes out in blocks of bounded size, each with two scans; no task
        holds more than k rows for each query of a block.
        """
        def asked(own: DataFrame) -> list[tuple[int, int, bytes]]:
            return sorted((r.dims, r.id, bytes(r.exact)) for r in own.collect())

        def answer(own: DataFrame) -> DataFrame:
            rows = asked(own)
            found = self._block(rows, k)
            if self.wide is None:
                return found
            more = self._plainly([(d, i, np.frombuffer(x, "<i8").tolist()) for d, i, x in rows], self.wide, k)
            return _best(found.unionByName(more), k)

        return self._in_blocks(queries, block, answer)

    def search_wide(self, queries: DataFrame, k: int = K, block: int = WIDE_BLOCK) -> DataFrame:
        """As :meth:`search` for rows of ``wide``, multiplied as integers of any size."""
        def answer(own: DataFrame) -> DataFrame:
            rows = sorted((r.dims, r.id, list(map(int, r.exact.split(",")))) for r in own.collect())
            found = self._plainly(rows, self.rows.select("id", "dims", "exact"), k)
            return _best(found.unionByName(self._plainly(rows, self.wide, k)), k)

        return self._in_blocks(queries, block, answer)

    def _in_blocks(self, queries: DataFrame, block: int, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
        parts = -(-queries.count() // block)
        if parts <= 1:
            return answer(queries).select(*_FOUND)
        spark = queries.sparkSession
        numbered, found = materialize(queries, "va-queries"), new_path(spark, "va-found")
        for part in range(parts):
            # Written block by block, so the driver holds one of them.
            own = numbered.where(F.pmod(F.xxhash64("id", "exact"), F.lit(parts)) == part)
            answer(own).select(*_FOUND).write.mode("append").parquet(found)
        return spark.read.schema("query_id bigint, rank int, vec_id bigint, score bigint").parquet(found)

    def _plainly(self, asked: list[tuple[int, int, list[int]]], rows: DataFrame, k: int) -> DataFrame:
        """The k best of ``rows`` for each query, without bounds and in whole numbers of any size.

        A score among the k best of a task that no long can hold is an error.
        """
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops: list[list[tuple[int, int]]] = [[] for _ in asked]
            for batch in batches:
                for i, d, x in zip(*(batch.column(c).to_pylist() for c in ("id", "dims", "exact")), strict=True):
                    v = np.frombuffer(x, "<i8").tolist() if isinstance(x, bytes) else list(map(int, x.split(",")))
                    for top, (dims, own, q) in zip(tops, asked, strict=True):
                        if dims == d and own != i:
                            bisect.insort(top, (-sum(map(operator.mul, q, v)), i))
                            del top[k:]
            out = [(asked[q][1], q, i, -x) for q, top in enumerate(tops) for x, i in top]
            if any(not -(1 << 63) <= r[3] < 1 << 63 for r in out):
                raise OverflowError("an inner product does not fit a long")
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "q", "vec_id", "score"])

        made = rows.mapInArrow(search, "query_id bigint, q bigint, vec_id bigint, score bigint")
        return _best(made, k)

    def _block(self, asked: list[tuple[int, int, bytes]], k: int) -> DataFrame:
        grids = self.grids
        ids = np.array([a[1] for a in asked], np.int64)
        places = {d: np.array([i for i, a in enumerate(asked) if a[0] == d]) for d in {a[0] for a in asked}}
        values = {d: np.array([np.frombuffer(asked[i][2], "<i8") for i in at]).reshape(len(at), d) for d, at in places.items()}

        def slices(batch: pa.RecordBatch) -> Iterator[tuple]:
            """Runs of rows of one length: its queries, row ids, bounds, the rows."""
            dims = batch.column("dims").to_numpy()
            row_ids = batch.column("id").to_numpy()
            cells = batch.column("cells")
            for d in np.unique(dims):
                if d not in places:
                    continue
                rows = np.flatnonzero(dims == d)
                for s in range(0, len(rows), _ROWS):
                    some = rows[s : s + _ROWS]
                    if d:
                        grid = np.frombuffer(b"".join(cells.take(pa.array(some)).to_pylist()), np.uint8).reshape(len(some), d)
                        middle, off = grids[d].bounds(values[d], grid)
                    else:
                        middle, off = np.zeros((len(places[d]), len(some))), np.zeros((len(places[d]), 1))
                    middle[ids[places[d]][:, None] == row_ids[some][None, :]] = -np.inf
                    yield d, some, row_ids[some], middle, off

        def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full((len(asked), k), -np.inf)
            for batch in batches:
                for d, _, _, middle, off in slices(batch):
                    both = np.concatenate([best[places[d]], middle - off], axis=1)
                    best[places[d]] = -np.partition(-both, k - 1, axis=1)[:, :k]
            q, _ = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[best > -np.inf])], ["q", "low"])

        order = Window.partitionBy("q").orderBy(F.desc("low"))
        reached = (
            self.rows.select("id", "dims", "cells")
            .mapInArrow(certain, "q bigint, low double")
            .withColumn("n", F.row_number().over(order))
            .where(F.col("n") <= k)
            .groupBy("q")
            .agg(F.min("low").alias("low"), F.count("*").alias("n"))
            .where(F.col("n") == k)
            .collect()
        )
        floor = np.full(len(asked), -np.inf)
        for r in reached:
            floor[r.q] = r.low

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops: list[list[tuple[int, int]]] = [[] for _ in asked]
            for batch in batches:
                full = batch.column("exact")
                for d, some, row_ids, middle, off in slices(batch):
                    high = middle + off
                    at = places[d]
                    hit = (high >= floor[at][:, None]) & (high > -np.inf)
                    needed = np.flatnonzero(hit.any(axis=0))
                    if not len(needed):
                        continue
                    taken = full.take(pa.array(some[needed])).to_pylist()
                    vectors = np.frombuffer(b"".join(taken), "<i8").reshape(len(needed), d)
                    where = np.full(len(some), -1)
                    where[needed] = np.arange(len(needed))
                    for j in np.flatnonzero(hit.any(axis=1)):
                        q = int(at[j])
                        near = np.flatnonzero(hit[j])
                        near = near[np.argsort(-high[j, near], kind="stable")]
                        top = tops[q]
                        for s in range(0, len(near), 32):
                            if len(top) >= k and high[j, near[s]] < top[-1][0] * -1:
                                break
                            part = near[s : s + 32]
                            scores = vectors[where[part]] @ values[d][j]
                            top += [(-int(x), int(i)) for x, i in zip(scores, row_ids[part], strict=True)]
                            top.sort()
                            del top[k:]
            rows = [(int(ids[q]), q, i, -x) for q, top in enumerate(tops) for x, i in top]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "q", "vec_id", "score"])

        return _best(self.rows.mapInArrow(exact, "query_id bigint, q bigint, vec_id bigint, score bigint"), k)


_FOUND = ["query_id", "rank", "vec_id", "score"]


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best for each query ``q`` of a block, with their rank."""
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows = found.select("query_id", "q", "vec_id", "score").withColumn("rank", F.row_number().over(ranked).cast("int"))
    return rows.where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 100, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Top k for the rows whose id is divisible by ``every``, against all rows.

    Null ids and vectors, and vectors that hold a null or a value that is not
    finite, take no part; repeated rows count once, ties go to the smaller id,
    and an empty table gives no rows. Other columns are not looked at.
    """
    index = VectorFile.build(vectors, vec_id, vector)
    wanted = F.col("id") % every == 0
    found = index.search(index.rows.where(wanted).select("id", "dims", "exact"), k)
    if index.wide is None:
        return found
    return found.unionByName(index.search_wide(index.wide.where(wanted), k))
