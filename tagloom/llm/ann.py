"""Nearest neighbours by inner product over shifted space-filling curves.

Method: vectors are projected to a few dimensions (with one more coordinate that
turns the largest inner product into the smallest distance), and several shifted
Hilbert curves order them. Spark range-partitions each curve by key; every query
meets the ``window`` rows on both sides of it, reranked by exact scores, and the
curves' lists are merged. Rows at both sides of a border between two partitions meet
once more, so a window does not end there. Where neighbours are not spread over all
dimensions this finds nearly all of them.

Completion: on vectors without such structure no window of a fixed size reaches a
recall of 0.9, so a search with ``complete`` goes on to all rows, in blocks: the
queries of a block, with the scores that their lists already reach, are broadcast
(at most about ``block`` queries, one block at a time, its result written out), and
tiles of rows, compact since they follow the first curve, are skipped for queries
that no vector within the tile's ball can serve better. What is found is exact.

Of equal vectors only the k + 1 smallest ids can be in any result, so a vector
that many rows share counts as k + 1 rows from the start.

Defined cases: vectors that are null, zero or hold null or non-finite components
take no part; vectors of different dimensions have no inner product, so those of each
dimension are searched among their own kind; a vec_id that repeats, with equal or with
different vectors, is one query and one candidate, and its best score counts; ties go
to the smaller vec_id; fewer candidates than k give all of them; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_arrow, shared_folder

DIMS, KEY_BITS = 7, 8
FOUND = "query_id long, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points with ``bits``-bit coordinates (n x dims)."""
    x = [c.astype(np.int64) for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level
        p = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ t) >> bit) & 1)
    return key


class Curves:
    """Keys of vectors on each of several curves; the same seed gives the same curves on all tasks."""

    def __init__(self, dim: int, scale: float, norm: float, count: int, seed: int = 0):
        """scale: the largest component of all vectors; norm: the largest norm, as a multiple of it."""
        rng = np.random.default_rng(seed)
        self.scale, self.norm, self.count = scale, norm, count
        self.axes = rng.standard_normal((count, dim + 1, DIMS)) / np.sqrt(dim + 1)
        self.shifts = rng.uniform(0, 0.5, (count, DIMS))

    def keys(self, vectors: np.ndarray, queries: bool) -> list[np.ndarray]:
        if queries:
            unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            more = np.zeros(len(vectors))
        else:
            unit = vectors / self.scale / self.norm
            more = np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1)))
        full = np.column_stack([unit, more])
        out = []
        for axes, shift in zip(self.axes, self.shifts, strict=True):
            spread = 1 / (1 + np.exp(-1.7 * np.sqrt(full.shape[1]) * (full @ axes)))
            out.append(hilbert_keys(((spread + shift) / 1.5 * (1 << KEY_BITS)).astype(np.int64), KEY_BITS))
        return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total = total + a[:, i] * b[:, i]
    return total


def _vectors(column: pa.Array, dtype: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1).astype(float) if rows else np.zeros((0, 1))


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best ids, best first, ties to smaller ids; of an id that repeats the best score."""
    order = np.lexsort((-scores, ids, query))
    q, i = query[order], ids[order]
    if len(order):
        order = order[np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])])]
    order = order[np.lexsort((ids[order], -scores[order], query[order]))]
    q = query[order]
    begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    return order[rank < k]


def _table(query, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(query, np.int64)), pa.array(np.asarray(ids, np.int64)), pa.array(np.asarray(scores, float))], ["query_id", "vec_id", "score"])


class Search:
    """The rows of a table, ready to be searched."""

    def __init__(self, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, curves: int = 3, window: int = 64):
        self.spark = table.sparkSession
        v = F.col("v")
        rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull())
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = rows.where(~bad & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))
        most = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
        norm = F.col("most") * F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most"))))
        found = rows.withColumn("most", most).groupBy("dim").agg(F.max("most").alias("scale"), F.max(norm).alias("norm")).collect()  # a row for each dimension that occurs
        dtype = "<f4" if table.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
        self.kinds = [_Kind(rows.where(F.col("dim") == r["dim"]).select("vec_id", "v"), r["dim"], r["scale"], r["norm"], dtype, k, curves, window) for r in sorted(found)]

    def nearest(self, is_query: Column, complete: bool = True, block: int = 16_384) -> DataFrame:
        """(query_id, rank, vec_id, score) for the rows where is_query (a condition on vec_id) holds."""
        if not self.kinds:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        found = [kind.nearest(is_query, complete, block) for kind in self.kinds]
        if len(found) > 1:  # an id may have vectors of several dimensions
            return _top(reduce(DataFrame.unionByName, [f.select("query_id", "vec_id", "score") for f in found]), self.kinds[0].k)
        return found[0]


def _top(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Kind:
    """The vectors of one dimension."""

    def __init__(self, rows: DataFrame, dim: int, scale: float, norm: float, dtype: str, k: int, curves: int, window: int):
        self.k, self.window, self.count, self.dtype, self.spark = k, window, curves, dtype, rows.sparkSession
        self.curves = Curves(dim, scale, norm / scale if np.isfinite(norm) else np.sqrt(dim), curves)

        def packed(batches):
            for batch in batches:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(dtype)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in v], pa.binary())], ["vec_id", "v"])

        self.rows = map_arrow(rows, packed, "vec_id long, v binary")
        self.candidates = self._candidates()

    def _candidates(self) -> DataFrame:
        """(vec_id, v): all rows, or the k + 1 smallest ids of a vector that more rows share.

        The limit on the rank takes effect before the shuffle too, so a hot vector is k + 1 ids a task.
        """
        def combined(batches):
            for batch in batches:  # repeated rows
                first = {(v, i): None for v, i in zip(batch.column("v").to_pylist(), batch.column("vec_id").to_pylist(), strict=True)}
                yield pa.RecordBatch.from_arrays([pa.array([i for _, i in first], pa.int64()), pa.array([v for v, _ in first], pa.binary())], ["vec_id", "v"])

        order = Window.partitionBy("v").orderBy("vec_id")
        ranked = map_arrow(self.rows, combined, "vec_id long, v binary").withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= self.k + 1)
        repeat = F.lag("vec_id").over(order).eqNullSafe(F.col("vec_id"))
        return ranked.withColumn("repeat", repeat).where(~F.col("repeat")).select("vec_id", "v")

    def _keyed(self, rows: DataFrame, queries: bool, count: int) -> DataFrame:
        dtype, curves = self.dtype, self.curves

        def task(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                for t, keys in enumerate(curves.keys(_vectors(batch.column("v"), dtype), queries)[:count]):
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(keys), pa.array(np.full(n, queries)), batch.column("vec_id"), batch.column("v")], ["curve", "key", "is_query", "vec_id", "v"])

        return map_arrow(rows, task, "curve int, key long, is_query boolean, vec_id long, v binary")

    def near_keys(self, queries: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): each query's k best within the windows, all curves merged."""
        keyed = self._keyed(self.candidates, False, self.count).unionByName(self._keyed(queries, True, self.count))
        order = ["curve", "key", "is_query", "vec_id"]
        first = durable(self._windows(keyed.repartitionByRange("curve", "key").sortWithinPartitions(*order)))
        # the rows at both sides of a border, with its number
        borders = first.where("border IS NOT NULL").select("border", "curve", "key", "is_query", F.col("query_id").alias("vec_id"), "v")
        second = self._windows(borders.repartition("border").sortWithinPartitions("border", *order))
        found = [f.where("border IS NULL").select("query_id", "vec_id", "score") for f in (first, second)]
        return _top(found[0].unionByName(found[1]), self.k)

    def _windows(self, dealt: DataFrame) -> DataFrame:
        """Rows (query_id, vec_id, score): the k best around each query; and, unless rows have a border, rows with one: the first and last of each task."""
        dtype, k, w, again = self.dtype, self.k, self.window, "border" in dealt.columns
        names = ["border", "curve", "is_query", "vec_id"]

        def edge(parts, keys, at, border):
            curve, is_query, ids, _ = (p[at] for p in parts)
            vectors = [x.astype(dtype).tobytes() for x in parts[3][at]]
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.array(np.full(n, border)), pa.array(curve), pa.array(keys[at]), pa.array(is_query), pa.array(vectors, pa.binary())], fields)

        fields = ["query_id", "vec_id", "score", "border", "curve", "key", "is_query", "v"]
        schema = "query_id long, vec_id long, score double, border long, curve int, key long, is_query boolean, v binary"

        def search(parts, group, low, high):
            curve, is_query, ids, v = parts
            at = low + np.flatnonzero(is_query[low:high])
            for part in np.split(at, range(256, len(at), 256)):
                near = part[:, None] + np.arange(-w, w + 1)
                inside = (near >= 0) & (near < len(ids))
                near = np.clip(near, 0, len(ids) - 1)
                ok = inside & ~is_query[near] & (curve[near] == curve[part][:, None]) & (group[near] == group[part][:, None]) & (ids[near] != ids[part][:, None])
                q, c = np.nonzero(ok)
                c = near[q, c]
                scores = products(v[part[q]], v[c])
                best = _best(part[q], ids[c], scores, k)
                n = len(best)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part[q[best]]]), pa.array(ids[c[best]]), pa.array(scores[best]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())], fields)

        def task(batches):
            number = TaskContext.get().partitionId()
            held: list[np.ndarray] = []
            low, started = 0, False
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = [batch.column(c).to_numpy(zero_copy_only=False) for c in names[1:]] + [_vectors(batch.column("v"), dtype), batch.column("key").to_numpy()]
                own.append(batch.column("border").to_numpy() if again else np.zeros(batch.num_rows, np.int64))
                held = [np.concatenate(x) for x in zip(held, own, strict=True)] if held else own
                if not again and not started and len(held[0]) >= w:
                    started = True
                    yield edge(held[:4], held[4], slice(0, w), number - 1)
                high = len(held[0]) - w
                if high - low >= 2048:
                    yield from search(held[:4], held[5], low, high)
                    drop = high - w
                    held, low = [x[drop:] for x in held], w
            if held:
                yield from search(held[:4], held[5], low, len(held[0]))
                if not again:
                    if not started:
                        yield edge(held[:4], held[4], slice(0, w), number - 1)
                    yield edge(held[:4], held[4], slice(max(len(held[0]) - w, 0), None), number)

        return map_arrow(dealt, task, schema)

    def _completed(self, queries: DataFrame, found: DataFrame, block: int) -> DataFrame:
        dtype, k, curves = self.dtype, self.k, self.curves
        along = self._keyed(self.candidates, False, 1).repartitionByRange("key").sortWithinPartitions("key", "vec_id").select("vec_id", "v")
        along = durable(along)
        reached = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        asked = durable(queries.join(reached, queries["vec_id"] == reached["query_id"], "left").select("vec_id", "v", F.when(F.col("n") == k, F.col("least")).alias("least")))
        blocks = -(-asked.count() // block)
        asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        folder = shared_folder(self.spark)
        for b in range(blocks):
            rows = asked.where(F.col("block") == b).select("vec_id", "v", "least").collect()  # about block rows
            if not rows:
                continue
            ids = np.array([r["vec_id"] for r in rows])
            vectors = np.frombuffer(b"".join(r["v"] for r in rows), dtype).reshape(len(rows), -1).astype(float)
            least = np.array([-np.inf if r["least"] is None else r["least"] for r in rows])
            size = np.abs(vectors).max(axis=1, keepdims=True, initial=0)
            shared = self.spark.sparkContext.broadcast((ids, vectors, size[:, 0] * np.linalg.norm(vectors / np.where(size > 0, size, 1), axis=1), least))

            def tiles(batches, shared=shared):
                ids, vectors, norms, least = shared.value
                least = least.copy()
                slack = 1e-9 * norms * curves.norm * curves.scale
                best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                for batch in batches:
                    for start in range(0, batch.num_rows, 1024):
                        part = batch.slice(start, 1024)
                        own, x = part.column("vec_id").to_numpy(), _vectors(part.column("v"), dtype)
                        center = x.mean(axis=0)
                        radius = np.sqrt(((x - center) ** 2).sum(axis=1).max())
                        asked = np.flatnonzero(~(vectors @ center + norms * radius + slack < least))  # what overflows is not skipped
                        for some in np.split(asked, range(2048, len(asked), 2048)):
                            q, c = np.nonzero(~(vectors[some] @ x.T < (least - slack)[some, None]))
                            q = some[q]
                            other = ids[q] != own[c]
                            q, c = q[other], c[other]
                            scores = products(vectors[q], x[c])
                            best = [np.concatenate(pair) for pair in zip(best, (q, own[c], scores), strict=True)]
                        keep = _best(*best, k)
                        best = [a[keep] for a in best]
                        full = np.flatnonzero(np.bincount(best[0], minlength=len(ids)) >= k)
                        lowest = np.full(len(ids), np.inf)
                        np.minimum.at(lowest, best[0], best[2])
                        least[full] = np.maximum(least[full], lowest[full])
                yield _table(ids[best[0]], best[1], best[2])

            map_arrow(along, tiles, FOUND).write.mode("append").parquet(folder)
            shared.destroy()
        scanned = self.spark.read.schema(FOUND).parquet(folder) if blocks else found
        return _top(found.select("query_id", "vec_id", "score").unionByName(scanned.select("query_id", "vec_id", "score")), self.k)

    def nearest(self, is_query: Column, complete: bool, block: int) -> DataFrame:
        queries = self.rows.where(is_query).distinct()
        found = self.near_keys(queries)
        return self._completed(queries, durable(found), block) if complete else found
