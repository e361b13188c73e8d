"""Exact top-k search by MaxScore over shards of integer vectors.

A dimension is a term, a component other than zero a posting, and the score of a vector is the inner
product with the query. A shard puts like vectors into blocks (it is halved at the median of its
widest dimension until blocks are small); each block holds its posting lists and the least and
greatest value of each.

A query visits blocks by descending bound and stops at the first that cannot reach its k-th best score.
In a block its dimensions are ordered by the query's weights; those that
together cannot lift a vector past the k-th best score are non-essential: only the
postings of the others are traversed, and the rest are probed in growing steps, largest weight first, for the
vectors that stay competitive. What dimensions can add together is bounded by the sum of the most that each can
add, and by the lengths of the rest of the query and of the vector. The shards' best k are merged by a window on the query.

Every query is first searched in one shard; its k-th best score there is its threshold in all others.

Defined results: vectors that are null or hold null or non-finite components, and rows without an
id, take no part; shorter vectors count as zero in the missing components; ties go to the smaller id; rows with equal ids and
vectors are candidates each; a query is never its own candidate (by id); fewer than k candidates
give all; empty tables give no rows; other columns are ignored. Products beyond 2^53, which doubles do not hold, are
taken with Python integers; a component or score beyond 64 bits raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import staged

#: Queries in a block, vectors in a shard, and vectors whose bounds are taken together.
QUERY_BLOCK, SHARD_ROWS, ROW_BLOCK = 4096, 16384, 4096
#: Integers below this are exact as doubles.
EXACT = float(1 << 53)


def quantized(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, x as double; null for vectors that take no part."""
    x = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == F.lit(float("inf"))))
    scaled = lambda v: F.floor(F.lit(float(scale)) * x(v)).cast("long")
    far = lambda v: F.abs(F.lit(float(scale)) * x(v)) >= F.lit(float(1 << 63))
    whole = lambda v: F.when(far(v), F.raise_error(F.lit("a component has more than 64 bits"))).otherwise(scaled(v))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, whole))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column of integers, zero where they are short."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    offsets = flat.offsets.to_numpy()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


class Block:
    """The posting lists of a few like vectors: for each dimension that is not zero in all, the values by row."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.dims = np.flatnonzero(vectors.any(axis=0))
        self.postings = np.ascontiguousarray(vectors[order][:, self.dims].T)
        self.lengths = (self.postings * self.postings).sum(axis=0)
        self.high, self.low = vectors.max(axis=0), vectors.min(axis=0)
        self.norm = float(np.sqrt(self.lengths.max(initial=0)))


class Shard:
    """Blocks of like vectors, and the exact search in them. ``read`` counts the postings that searches looked at."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = ROW_BLOCK):
        self.read, self.width = 0, vectors.shape[1]
        self.largest = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.ids, self.vectors = ids, vectors
        self.blocks: list[Block] = []
        if self.largest**2 * self.width >= EXACT or not len(ids):
            return
        floats = vectors.astype(np.float64)
        todo = [np.arange(len(ids))]
        while todo:
            rows = todo.pop()
            if len(rows) <= block:
                self.blocks.append(Block(ids[rows], floats[rows]))
                continue
            own = floats[rows, int(floats[rows].var(axis=0).argmax())]
            order, half = np.argpartition(own, len(rows) // 2), len(rows) // 2
            todo += [rows[order[:half]], rows[order[half:]]]
        self.high, self.low = (np.array([getattr(b, x) for b in self.blocks]) for x in ("high", "low"))
        self.norms = np.array([b.norm for b in self.blocks])

    def best(self, query_id: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k best vectors of at least the score ``floor``, best first, ties to smaller ids."""
        if float(np.abs(query.astype(np.float64)).max(initial=0)) * self.largest * self.width >= EXACT or not self.blocks:
            return self._plain(query_id, query, k, floor)
        query = query.astype(np.float64)
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        up, down, norm = np.maximum(query, 0), np.minimum(query, 0), float(np.sqrt(query @ query))
        bounds = np.minimum(self.high @ up + self.low @ down, np.ceil(self.norms * norm * (1 + 1e-9)))
        for number in np.argsort(-bounds, kind="stable").tolist():
            if bounds[number] < floor:
                break
            own, part = self._competitive(self.blocks[number], query, floor)
            keep = own != query_id
            ids, scores = np.concatenate([ids, own[keep]]), np.concatenate([scores, part[keep]])
            if len(ids) > k:
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
            if len(ids) == k:
                floor = max(floor, scores.min())
        top = np.lexsort((ids, -scores))[:k]
        return ids[top], scores[top].astype(np.int64)

    def _competitive(self, block: Block, query: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of a block's vectors that reach ``floor``."""
        q = query[block.dims]
        order = np.argsort(-np.abs(q), kind="stable")
        q, postings = q[order], block.postings
        most = np.maximum(q * block.high[block.dims][order], q * block.low[block.dims][order])
        rest = np.concatenate([np.cumsum(most[::-1])[::-1], [0.0]])  # the most that the dimensions from each on can add
        length = np.sqrt(np.concatenate([np.cumsum((q * q)[::-1])[::-1], [0.0]])) * (1 + 1e-9)
        reach = np.minimum(rest, length * block.norm)
        # non-essential: the longest tail that cannot reach the k-th best score on its own
        at = int(np.argmax(reach < floor)) if reach[-1] < floor else len(order)
        taken = postings[order[:at]]
        part = q[:at] @ taken
        rows, left, step = np.arange(len(block.ids)), None, 16
        self.read += at * len(rows)
        while at < len(order):
            live = np.flatnonzero(part >= floor - reach[at])
            rows, part = rows[live], part[live]
            if left is None:  # what is left of the lengths of the vectors that still compete
                taken = taken[:, live]
                left = block.lengths[rows] - np.einsum("ij,ij->j", taken, taken)
            else:
                left = left[live]
            live = np.flatnonzero(part + length[at] * np.sqrt(left) >= floor)
            rows, part, left = rows[live], part[live], left[live]
            if not len(rows):
                break
            more = postings[np.ix_(order[at : at + step], rows)]
            part, left = part + q[at : at + step] @ more, left - np.einsum("ij,ij->j", more, more)
            self.read += more.size
            at, step = at + step, 2 * step
        keep = part >= floor
        return block.ids[rows[keep]], part[keep]

    def _plain(self, query_id: int, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """By Python integers, for numbers that doubles do not hold."""
        ids = self.ids[self.ids != query_id]
        scores = self.vectors[self.ids != query_id].astype(object) @ query.astype(object) if len(ids) else np.zeros(0, object)
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
        if any(not -(1 << 63) <= scores[i] < 1 << 63 for i in order):
            raise OverflowError("a score has more than 64 bits")
        found = [i for i in order if scores[i] >= floor]
        return ids[found], np.array([scores[i] for i in found], np.int64)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best ``vectors`` (vec_id, v) for each query (vec_id, v)."""
    queries, vectors = (df.filter("vec_id is not null and v is not null") for df in (queries, vectors))
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    n_queries = queries.count()
    dims, shards = sizes["dims"] or 0, max(1, -(-sizes["n"] // SHARD_ROWS))
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # rows that share an id are dealt by their vectors, so they are no large shard
    held = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"))
    own = F.pmod(F.xxhash64(F.col("vec_id") + 1), F.lit(shards)).cast("int")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"), deal(blocks).alias("block"), own.alias("own"))

    def search(qs: pa.Table, vs: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if qs.num_rows and vs.num_rows:
            width = max(dims, int(max(len(x) for x in qs["query"])))
            shard = Shard(vs["vec_id"].to_numpy(), _matrix(vs["v"], width))
            floors = qs["floor"].fill_null(-(1 << 63)).to_numpy()
            for q, row, floor in zip(qs["query_id"].to_numpy(), _matrix(qs["query"], width), floors, strict=True):
                ids, scores = shard.best(q, row, k, float(floor) if abs(int(floor)) < EXACT else -np.inf)
                out[0].append(np.full(len(ids), q))
                out[1].append(ids)
                out[2].append(scores)
        cols = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, cols), strict=True)))

    def run(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(search, "query_id long, vec_id long, score long")

    right = held.select("vec_id", "v", "shard", spread(blocks).alias("block"))
    first = asked.select("query_id", "query", F.lit(None).cast("long").alias("floor"), "block", F.col("own").alias("shard"))
    near = staged(run(first, right), "first-shard")
    full = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k)
    known = asked.join(full.select("query_id", "floor"), "query_id", "left")
    left = known.withColumn("shard", spread(shards)).filter("shard <> own").select("query_id", "query", "floor", "block", "shard")
    found = near.unionByName(run(left, right))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
