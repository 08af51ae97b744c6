"""Exact top-k search by inner product: a three-phase uniform threshold.

The components of a vector fall into ``SLABS`` slabs; a slab's partial products are one score list
of each query, and a score is the sum of its partials. Phase 1: every task gathers, per query, the
best entries of one local list, that of the slab in which the queries are largest, and resolves
those alone; the k-th best (score, id) over all tasks is a safe cutoff. Phase 2: with the cutoffs
broadcast, every task goes through the lists and collects sufficient entries: an entry stays open
while its partials so far and the norms of the slabs to come can reach the cutoff together, and
one that is open to the end must have a partial of at least cutoff / SLABS in some list. As soon
as few are open, no further list is made. Phase 3 resolves what the collected entries lack, keeps
those at or above the cutoff, and merges the tasks' best.

Queries are taken in blocks of a checked size (``block_bytes``); each block is broadcast and passes
twice over all vectors, and its answers are written before the next one starts, so memory, broadcasts
and the plan are bounded whatever the number of queries.

Arithmetic: a component is floor(1024 * x) with x as double. Sums that fit 53 bits are computed in
doubles exactly, larger ones in Python integers, held within the range of long.

Edge cases: vectors that are null or hold null or non-finite components, and null ids, take no
part; a shorter vector counts as padded with zeros; rows that repeat an id are candidates of
their own, but never of a query of the same id, and the answers to repeated query rows are
merged; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terselake.llm import common

SLABS = 8
SCALE = 1024
#: Queries and vectors multiplied at once.
_QUERIES, _VECTORS = 512, 2048
#: Entries of a local list resolved in phase 1, as a multiple of k + 1: the more, the closer the cutoff.
_GATHERED = 6
#: Open entries are resolved one by one once they are at most this share of all.
_FEW = 0.15
_LONG = (1 << 63) - 1


@dataclass
class Block:
    """Some of the queries; cutoffs are there in phases 2 and 3."""

    ids: np.ndarray
    grid: np.ndarray  # queries x components, whole numbers in doubles
    cut_score: np.ndarray | None = None
    cut_id: np.ndarray | None = None


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def grid_of(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of whole numbers, padded with zeros or cut to width."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = np.floor(SCALE * lists.values.to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat[offsets[0]:offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    for k, (at, n) in enumerate(zip(offsets[:-1], np.minimum(sizes, width), strict=True)):
        out[k, :n] = flat[at:at + n]
    return out


def _slabs(width: int) -> list[slice]:
    edges = np.linspace(0, width, SLABS + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _fits(q: np.ndarray, c: np.ndarray) -> bool:
    return np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1) < 2**53


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def _order(grid: np.ndarray) -> list[slice]:
    """The slabs, those in which the queries are largest first."""
    return sorted(_slabs(grid.shape[1]), key=lambda s: -float((grid[:, s] ** 2).sum()))


def _pairs(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray, slabs: list[slice]) -> np.ndarray:
    """The products of some pairs over some slabs."""
    out = np.zeros(len(qi))
    for s in slabs:
        for k in range(0, len(qi), 50_000):
            out[k:k + 50_000] += np.einsum("ij,ij->i", q[qi[k:k + 50_000], s], c[ci[k:k + 50_000], s])
    return out


class _Best:
    """The k best (score, id) of each query so far: score descending, id ascending."""

    def __init__(self, queries: int, k: int):
        self.k, self.found = k, [[] for _ in range(queries)]

    def add(self, query: np.ndarray, score, ids: np.ndarray) -> None:
        if not len(query):
            return
        order = np.argsort(query, kind="stable")
        query, ids = query[order], ids[order]
        score = [score[o] for o in order.tolist()] if isinstance(score, list) else score[order]
        bounds = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1], [True]]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            mine = self.found[query[a]]
            mine += [(-int(s), int(i)) for s, i in zip(score[a:b], ids[a:b], strict=True)]
            mine.sort()
            del mine[self.k:]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for q, mine in enumerate(self.found):
            for s, i in mine:
                yield q, max(-_LONG - 1, min(_LONG, -s)), i


def _every(block: Block, best: _Best, ids: np.ndarray, vectors: np.ndarray) -> int:
    """All scores, for numbers that a double can't hold: Python integers."""
    q, c = _whole(block.grid), _whole(vectors)
    for k in range(len(q)):
        v = np.flatnonzero(block.ids[k] != ids)
        score = [int(x) for x in (c[v] @ q[k])] if len(v) else []
        best.add(np.full(len(v), k), score, ids[v])
    return q.shape[0] * c.shape[0] * q.shape[1]


def _gather(block: Block, best: _Best, ids: np.ndarray, vectors: np.ndarray, k: int) -> int:
    """Phase 1: the best of one local list, with their whole scores. Returns the number of products."""
    if not _fits(block.grid, vectors):
        return _every(block, best, ids, vectors)
    order, done, n = _order(block.grid), 0, min(_GATHERED * (k + 1), len(ids))
    for a in range(0, len(block.ids), _QUERIES):
        grid = block.grid[a:a + _QUERIES]
        listed = grid[:, order[0]] @ vectors[:, order[0]].T
        top = np.argpartition(-listed, n - 1, axis=1)[:, :n]
        q, v = np.repeat(np.arange(len(grid)), n), top.ravel()
        other = block.ids[a + q] != ids[v]
        q, v = q[other], v[other]
        best.add(q + a, listed[q, v] + _pairs(grid, vectors, q, v, order[1:]), ids[v])
        done += listed.size * (order[0].stop - order[0].start) + len(q) * sum(s.stop - s.start for s in order[1:])
    return done


def _norms(x: np.ndarray, order: list[slice]) -> np.ndarray:
    """rows x slabs: the norm of all slabs after each one."""
    squares = np.column_stack([(x[:, s] ** 2).sum(axis=1) for s in order])
    return np.sqrt(np.maximum(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1] - squares, 0))


def _collect(block: Block, best: _Best, ids: np.ndarray, vectors: np.ndarray) -> int:
    """Phases 2 and 3: sufficient entries from the lists, then what their scores lack. Returns the number of products."""
    if not _fits(block.grid, vectors):
        return _every(block, best, ids, vectors)
    order, done = _order(block.grid), 0
    reach_v = _norms(vectors, order)
    for a in range(0, len(block.ids), _QUERIES):
        grid, cut, cut_id = (x[a:a + _QUERIES] for x in (block.grid, block.cut_score, block.cut_id))
        reach_q = _norms(grid, order)
        is_open = block.ids[a:a + _QUERIES, None] != ids[None]
        seen, listed = np.zeros(is_open.shape), np.zeros(is_open.shape, bool)
        left = order
        for k, s in enumerate(order):
            if k and is_open.mean() <= _FEW:
                break
            part = grid[:, s] @ vectors[:, s].T
            seen += part
            listed |= part >= (cut / SLABS)[:, None]
            left = order[k + 1:]
            done += part.size * (s.stop - s.start)
            # Cauchy-Schwarz on the slabs to come; the margins absorb rounding
            is_open &= seen + reach_q[:, k, None] * reach_v[None, :, k] * (1 + 1e-9) + 1e-3 >= cut[:, None]
        if not left:
            is_open &= listed | (cut[:, None] <= 0)
        q, v = np.nonzero(is_open)
        score = seen[q, v] + _pairs(grid, vectors, q, v, left)
        done += len(q) * sum(s.stop - s.start for s in left)
        keep = (score > cut[q]) | ((score == cut[q]) & (ids[v] <= cut_id[q]))
        q, v, score = q[keep], v[keep], score[keep]
        if len(q) > 4 * best.k * len(cut):  # many ties at once: the best of each query suffice
            at = np.lexsort((ids[v], -score, q))
            q, v, score = q[at], v[at], score[at]
            first = np.arange(len(q)) - np.searchsorted(q, q) < best.k
            q, v, score = q[first], v[first], score[first]
        best.add(q + a, score, ids[v])
    return done


def _pass(vectors: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """One pass of a block over all vectors: ``q, score, vec_id``, at most k of a query from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        best = _Best(len(b.ids), k)
        for batch in batches:
            ids, grid = batch.column(0).to_numpy(), grid_of(batch.column(1), b.grid.shape[1])
            for at in range(0, len(ids), _VECTORS):
                part = ids[at:at + _VECTORS], grid[at:at + _VECTORS]
                if b.cut_score is None:
                    _gather(b, best, *part, k)
                else:
                    _collect(b, best, *part)
        rows = list(best.rows())
        for at in range(0, len(rows), 50_000):
            q, s, i = zip(*rows[at:at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s, pa.int64()), pa.array(i, pa.int64())], ["q", "score", "vec_id"])

    return common.map_arrow(vectors, run, "q int, score long, vec_id long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


_QUERY = "vec_id long, vector array<double>"
_ANSWER = "query_id long, rank int, vec_id long, score long"


def query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[Block]:
    """The queries in blocks of about block_bytes; they are written once, a folder for each block."""
    spark = queries.sparkSession
    path = common.shared_dir(spark, "topk-queries")
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).head()
    if not n:
        return
    blocks = max(1, -(-n * max(width, 1) * 8 // block_bytes))
    if blocks > 1:
        queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).write.partitionBy("block").parquet(path)
    for b in range(blocks):
        part = spark.read.schema(_QUERY + ", block long").parquet(path).where(F.col("block") == b).drop("block") if blocks > 1 else queries
        rows = part.toArrow()
        if rows.num_rows:
            yield Block(rows.column(0).to_numpy(), grid_of(rows.column(1)))
    if blocks > 1:
        common.remove_path(spark, path)


def search(vectors: DataFrame, is_query: Column, k: int = 10, block_bytes: int = 8 << 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query row's k best."""
    spark = vectors.sparkSession
    usable_rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = usable_rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    queries = usable_rows.where(is_query).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    path = common.shared_dir(spark, "topk")
    spark.createDataFrame([], _ANSWER).write.parquet(path)
    for block in query_blocks(queries, block_bytes):
        sent = spark.sparkContext.broadcast(block)  # at most block_bytes
        last = _ranked(_pass(rows, sent, k), k).where(F.col("rank") == k).select("q", "score", "vec_id").toArrow()  # one row for each query of the block
        sent.destroy()
        cut, cut_id = np.full(len(block.ids), -np.inf), np.full(len(block.ids), _LONG)
        at = last.column("q").to_numpy()
        cut[at], cut_id[at] = np.nextafter(last.column("score").to_numpy().astype(np.float64), -np.inf), last.column("vec_id").to_numpy()
        exact = np.abs(last.column("score").to_numpy()) < 2**53
        cut[at[exact]] = last.column("score").to_numpy()[exact]
        sent = spark.sparkContext.broadcast(Block(block.ids, block.grid, cut, cut_id))
        found = _pass(rows, sent, k)
        names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(block.ids)), pa.int32()), "query_id": pa.array(block.ids)}))
        one = found.join(F.broadcast(names), "q")  # the ids of one block
        # all rows of a query id are in one block, so its answers are whole here
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = one.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(_ANSWER).parquet(path)
