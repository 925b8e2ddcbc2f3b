"""Exact top-k search by inner product with MaxScore.

A term is a dimension together with a sign; the postings of a term list the vectors whose component has that
sign. A query weights the terms of its own signs, which raise a score, and those of the opposite signs, which
lower it; a term's bound is its weight times the largest component of its postings, and zero for lowering
terms. In a shard of vectors, terms are sorted by bound. The terms whose bounds together cannot reach the
threshold are non-essential: only vectors found in the postings of essential terms become candidates. The
others are then probed from the largest bound down, and candidates that cannot reach the threshold any more
are dropped. The threshold is the k-th best score of the shard so far, over blocks of vectors.

Vectors lie in shards by the hash of their id; a block of queries meets every shard, each shard keeps k
results per query, and the shards' results are merged. Scores are whole numbers, so nothing is rounded.

Cases: vectors that are null or hold null or non-finite components take no part; ties go to the smaller id;
vectors of different length match on their common components; components are limited to 2**26 in size, so
that sums of products stay within 64 bits; repeated ids are different rows, a query's own id is never its
result; rows without an id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

TOP = 10
#: Vectors per shard and queries per block, on average.
SHARD_ROWS = 16_384
QUERY_ROWS = 512
BLOCK = 2048
#: Largest square of a component times the number of components: sums of products and of bounds then fit into 64 bits.
LIMIT = 2.0**60


def whole(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) per component; null if the vector takes no part. A vector whose scores could pass 64 bits ends the job."""
    sound = vector.isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    largest = F.coalesce(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double") * scale))), F.lit(0.0))
    wide = largest * largest * F.size(vector) > LIMIT
    return F.when(sound & wide, F.raise_error(F.lit("scores of such large components do not fit into 64 bits"))).when(
        sound, scaled.cast("array<bigint>")
    )


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


class Shard:
    """Postings of some vectors: per block of vectors, the rows of each term (dimension and sign)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.blocks = []
        for start in range(0, len(self.ids), BLOCK):
            part = self.vectors[start:start + BLOCK]
            postings = [(np.flatnonzero(part[:, j] > 0), np.flatnonzero(part[:, j] < 0)) for j in range(part.shape[1])]
            self.blocks.append((start, np.ascontiguousarray(part.T), postings, np.maximum(part.max(axis=0), 0), np.maximum(-part.min(axis=0), 0)))

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), best first, smaller ids first on ties."""
        best: list[tuple[int, int]] = []
        for start, columns, postings, highest, lowest in self.blocks:
            bounds = np.abs(query) * np.where(query > 0, highest, lowest)
            order = np.argsort(bounds, kind="stable")
            sums = np.cumsum(bounds[order])
            threshold = -best[-1][0] if len(best) >= k else None
            # Equal scores of later ids can still win only if their id is smaller, which block order rules out for most.
            split = 0 if threshold is None else int(np.searchsorted(sums, threshold, "left"))
            if threshold is not None and threshold > sums[-1]:
                continue
            if threshold is None or threshold <= 0:
                rows = np.arange(columns.shape[1])
            else:
                marked = np.zeros(columns.shape[1], bool)
                for j in order[split:][::-1]:
                    marked[postings[j][0 if query[j] > 0 else 1]] = True
                    if marked.all():
                        break
                rows = np.flatnonzero(marked)
            partial = np.zeros(len(rows), np.int64)
            for step, j in enumerate(order[::-1]):
                if query[j]:
                    partial += query[j] * columns[j, rows]
                left = sums[len(order) - 2 - step] if step < len(order) - 1 else 0
                if threshold is not None and step % 8 == 7:
                    alive = partial + left >= threshold
                    if not alive.all():
                        rows, partial = rows[alive], partial[alive]
            ids = self.ids[start + rows]
            other = ids != query_id
            ids, partial = ids[other], partial[other]
            if len(ids) > k:
                limit = np.partition(partial, len(partial) - k)[len(partial) - k]
                ids, partial = ids[partial >= limit], partial[partial >= limit]
            best = sorted([*best, *((-int(s), int(i)) for s, i in zip(partial, ids, strict=True))])[:k]
        return [(-s, i) for s, i in best]


def _serve(k: int):
    def answer(queries: list, vectors: list) -> list[tuple[int, int, int]]:
        width = max(len(v) for _, v in [*queries, *vectors])
        shard = Shard(np.array([i for i, _ in vectors]), _matrix([v for _, v in vectors], width))
        weights = _matrix([v for _, v in queries], width)
        return [(q, i, s) for (q, _), w in zip(queries, weights, strict=True) for s, i in shard.search(q, w, k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queries, vectors = None, [], []

        def emit():
            found = answer(queries, vectors) if queries and vectors else []
            return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            role, ids, values = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            for i, key in enumerate(keys):
                if key != group:
                    if group is not None:
                        yield emit()
                    group, queries, vectors = key, [], []
                (vectors if role[i] else queries).append((ids[i], values[i].values.to_numpy(zero_copy_only=False)))
        if group is not None:
            yield emit()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k best vectors; both tables hold (vec_id, vector)."""
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    shard = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(block.alias("block"), every(shards).alias("shard"), F.lit(0).alias("role"), "vec_id", "vector")
    held = vectors.select(every(blocks).alias("block"), shard.alias("shard"), F.lit(1).alias("role"), "vec_id", "vector")
    met = asked.unionByName(held).repartition("block", "shard").sortWithinPartitions("block", "shard", "role", "vec_id")
    found = met.mapInArrow(_serve(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best vectors of every hundredth vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", whole(F.col("embedding")).alias("vector"))
    rows = rows.where("vec_id is not null and vector is not null")
    return search(rows, rows.where("vec_id % 100 = 0"))


OP3_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS w FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
