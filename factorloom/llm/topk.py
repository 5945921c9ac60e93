"""Exact top-k by inner product without random access, over sorted component lists.

Vectors are floor(64 * x) of each component. Queries and candidates are dealt into blocks of
bounded size, and every query block meets every candidate block. In a block each dimension is a
list sorted by component, read from the top for positive query components and from the bottom for
negative ones. Reading all lists to a depth gives each candidate a lower and an upper bound:
components not read yet lie between the list's end and the value last read. A candidate whose
upper bound is below the k-th best lower bound cannot qualify. Once few candidates are left, their
remaining components are read and their scores are final; else the lists are read deeper, at last
to their ends. Blocks keep k rows a query, and those are ranked once more.

Vectors that are null or hold null or non-finite components take no part; vectors meet vectors
of their own length. Repeated rows count once; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.session import materialize
from factorloom.llm.common import table

K = 20
SCALE = 64
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
QUERIES_AT_ONCE = 256
# Depths as shares of the lists; the lists end after the last.
DEPTHS = (1 / 2, 7 / 8)
# Share of a block's candidates whose scores are resolved rather than read on.
RESOLVED = 1 / 4


def _exact_type(candidates: np.ndarray, queries: np.ndarray) -> type:
    """The narrowest number in which every sum of products is exact."""
    top = [float(np.abs(x).max(initial=0)) + 1 for x in (candidates, queries)]
    bound = 2 * top[0] * top[1] * max(candidates.shape[1], 1)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


class SortedLists:
    """The candidates of a block as one sorted list for each dimension."""

    def __init__(self, candidates: np.ndarray, kind: type):
        self.values = candidates.astype(kind)
        self.count = len(candidates)
        order = np.argsort(-candidates, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, order, axis=0)
        self.rank = np.empty(candidates.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(self.count, dtype=np.int32)[:, None], axis=0)

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries, candidates) after reading every list to the depth."""
        above, below = np.maximum(queries, 0), np.minimum(queries, 0)
        out = []
        for high, low in ((self.sorted[-1], self.sorted[0]), (self.sorted[depth - 1], self.sorted[-depth])):
            # high, low: what stands for components not read from the top and from the bottom.
            top = np.where(self.rank < depth, self.values - high, 0)
            bottom = np.where(self.rank >= self.count - depth, self.values - low, 0)
            base = above @ high + below @ low
            out.append(above @ top.T + below @ bottom.T + base[:, None])
        return out[0], out[1]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids; a score of the least value is none."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        picked = np.flatnonzero(scores >= edge)
    else:
        picked = np.arange(len(scores))
    return picked[np.lexsort((ids[picked], -scores[picked]))][:k]


def nra_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k best candidates of each query in the block."""
    kind = _exact_type(candidates, queries)
    lists = SortedLists(candidates, kind)
    queries = queries.astype(kind)
    depths = sorted({max(1, int(lists.count * share)) for share in DEPTHS})
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(query: int, places: np.ndarray, scores: np.ndarray) -> None:
        other = ids[places] != query_ids[query]
        places, scores = places[other], scores[other]
        best = _best(scores, ids[places], k)
        own = np.full(len(best), query_ids[query])
        found.append((own, ids[places[best]], scores[best].astype(np.int64)))

    for start in range(0, len(queries), QUERIES_AT_ONCE):
        open_ = np.arange(start, min(start + QUERIES_AT_ONCE, len(queries)))
        for depth in depths:
            # One more than k: the query itself may be among the best.
            if not len(open_) or lists.count <= k + 1:
                break
            lower, upper = lists.bounds(queries[open_], depth)
            edge = np.partition(lower, lists.count - k - 1, axis=1)[:, lists.count - k - 1]
            qualify = upper >= edge[:, None]
            done = qualify.sum(axis=1) <= lists.count * RESOLVED
            for row in np.flatnonzero(done):
                places = np.flatnonzero(qualify[row])
                keep(open_[row], places, lists.values[places] @ queries[open_[row]])
            open_ = open_[~done]
        if len(open_):
            scores = queries[open_] @ lists.values.T
            for row, query in enumerate(open_):
                keep(query, np.arange(lists.count), scores[row])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(map(np.concatenate, zip(*found)))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // rows if rows else 0)


def _block_top(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = not left.num_rows or not right.num_rows
        parts = (np.zeros(0, np.int64),) * 3 if empty else nra_block(
            left["vec_id"].to_numpy(),
            _matrix(left["vector"], left.num_rows),
            right["vec_id"].to_numpy(),
            _matrix(right["vector"], right.num_rows),
            k,
        )
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, parts))))

    return run


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector of longs, width) of the vectors that take part; repeated rows once."""
    sound = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
        .select("vec_id", vector.alias("vector"))
        .distinct()
        .withColumn("width", F.size("vector"))
    )


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates but itself.

    Both tables have vec_id, vector and width. Blocks have an expected size whatever the data;
    a query row is sent once for each candidate block and the other way round.
    """
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    candidate_blocks = max(1, -(-candidates.count() // CANDIDATE_BLOCK))

    def dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")
        every = F.sequence(F.lit(0), F.lit(others - 1))
        return rows.select(
            "vec_id", "vector", "width", mine.alias(own), F.explode(every).alias(other)
        )

    keys = ("width", "query_block", "candidate_block")
    left = dealt(queries, "query_block", query_blocks, "candidate_block", candidate_blocks)
    right = dealt(candidates, "candidate_block", candidate_blocks, "query_block", query_blocks)
    best = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(_block_top(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op6_topk(spark, sf_dir: str) -> DataFrame:
    vectors = materialize(quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors.filter(F.col("vec_id") % 20 == 0), vectors)


OP6_SQL = """
WITH vectors AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vector, c.vector)::BIGINT AS score
    FROM vectors q JOIN vectors c
        ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
