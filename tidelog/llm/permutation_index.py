"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order; its place in a pivot's inverted file is its
rank there. A query ranks rows by the footrule distance between its pivot order and theirs, read off the
inverted files of its own pivots, and the ``RERANK_SHARE`` of rows nearest by footrule (at least
``LEAST_RERANKED`` times ``k``; of rows with one id the best counts; and all that tie with the last) is ranked again by the exact inner product. Every row is indexed. Pivots are chosen on the driver from a sample of
``PIVOT_SAMPLE`` rows at most (by hash), far from one another, so that a large group of copies does
not take them all. Rows of unequal length get one more coordinate that makes the order by inner product
the order by angle.

The index is cut into shards of about ``SHARD_ROWS`` rows, each with its own inverted files, written to the
shared folder; queries go in blocks of ``BLOCK_QUERIES``. Every block meets every shard (queries are a
stated set, not all rows), a shard returns its best ``k`` for each query, and those are merged. Work for a
pair is bounded, whatever the corpus holds; the share, not a number, is ranked again, so recall does not
fall as the corpus grows. Against exact search of 64 numbers a row, a query meets 16 postings a row (64 files that hold a quarter of the
rows each) and multiplies the 10 numbers a row that its 15 % come to.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do
those of another length than most have; a repeated vec_id counts once, with its best score as a candidate
and its smallest vector as a query; ties go to the smaller vec_id; null ids take no part; an
empty table gives an empty result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidelog.llm.common import drop_written, ready_for_python, written

PIVOTS, NEAREST = 256, 64  # NEAREST must fit in a byte
PIVOT_SAMPLE = 4096
RERANK_SHARE, LEAST_RERANKED = 0.15, 10
SHARD_ROWS, BLOCK_QUERIES = 4096, 512


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def choose_pivots(sample: np.ndarray, many: int) -> np.ndarray:
    """Unit vectors of the sample, each next one farthest from those before (the first row starts)."""
    unit = np.unique(sample / np.linalg.norm(sample, axis=1, keepdims=True), axis=0)
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(many, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that gives all of them the length ``longest``."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0.0))
    return np.hstack((vectors, rest[:, None]))


def pivot_order(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first, ties to the smaller number."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int16)


class Shard:
    """The rows of a shard and their inverted files: for each pivot a posting per row, ``nearest`` less its rank (0: not posted)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, pivots: int):
        self.ids, self.vectors, self.nearest = ids, vectors, order.shape[1]
        self.posted = np.zeros((pivots, len(ids)), dtype=np.uint8)
        rank = np.arange(self.nearest, 0, -1, dtype=np.uint8)
        self.posted[order.ravel(), np.repeat(np.arange(len(ids)), self.nearest)] = np.tile(rank, len(ids))
        self.rank = rank[:, None]
        distinct, self.number = np.unique(ids, return_inverse=True)
        self.distinct = len(distinct)

    def overlap(self, order: np.ndarray) -> np.ndarray:
        """Twice this less than a constant is the footrule distance, pivots beyond the nearest counting as ranked next."""
        return np.minimum(self.posted[order], self.rank).sum(axis=0, dtype=np.int32)

    def search(self, query_id: int, query: np.ndarray, order: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        others = self.ids != query_id
        total = np.where(others, self.overlap(order), -1)
        # Ids count once in the share, by their best row.
        of_ids = total
        if self.distinct < len(self.ids):
            of_ids = np.full(self.distinct, -1, dtype=total.dtype)
            np.maximum.at(of_ids, self.number, total)
        many = min(self.distinct, max(LEAST_RERANKED * k, int(np.ceil(share * self.distinct))))
        # With all that tie with the last one: a cut among equals would drop ids by chance.
        found = np.flatnonzero(others & (total >= np.partition(of_ids, self.distinct - many)[self.distinct - many]))
        scores = (self.vectors[found] * query).sum(axis=1)
        best = np.lexsort((self.ids[found], -scores))
        _, first = np.unique(self.ids[found[best]], return_index=True)
        best = best[np.sort(first)[:k]]
        return self.ids[found[best]], scores[best]


def _packed(rows: DataFrame, parts: int, pivots: np.ndarray, longest: float, nearest: int, as_query: bool) -> DataFrame:
    """Rows (vec_id, v) dealt evenly into ``parts`` packed blocks with their pivot orders."""

    def pack(batches):
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy())
                vectors.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        if ids:
            i, v = np.concatenate(ids), np.concatenate(vectors)
            long = np.hstack((v, np.zeros((len(v), 1)))) if as_query else lengthened(v, longest)
            order = pivot_order(long, pivots, nearest)
            block = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_pydict({"block": block, "ids": [i.tobytes()], "vectors": [v.tobytes()], "pivots": [order.tobytes()]})

    return rows.repartition(parts).mapInArrow(pack, "block int, ids binary, vectors binary, pivots binary")


def nearest_neighbours(vectors: DataFrame, k: int = 20, query_every: int = 20, pivots: int = PIVOTS, nearest: int = NEAREST, share: float = RERANK_SHARE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest rows found for every row whose id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    ready_for_python(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    usable = _usable(vectors, vec_id, embedding)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = usable.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(length).alias("longest")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    size, n, longest = sizes[0].size, sizes[0].n, sizes[0].longest
    rows = usable.where(F.size("v") == size)
    sample = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(PIVOT_SAMPLE).collect()
    chosen = choose_pivots(lengthened(np.array([r.v for r in sample]), longest), pivots)
    width, count = min(nearest, len(chosen)), len(chosen)

    shards = max(1, -(-n // SHARD_ROWS))
    index = written(_packed(rows, shards, chosen, longest, width, as_query=False), "permutations")
    asked = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = written(_packed(asked, max(1, -(-n // query_every // BLOCK_QUERIES)), chosen, longest, width, as_query=True), "questions")
    # Each block of queries goes to each shard: a row for every pair of blocks, not of vectors.
    copies = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("pivots").alias("q_pivots"))
    pairs = copies.join(index, "block").select("q_ids", "q_vectors", "q_pivots", "ids", "vectors", "pivots")

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_vectors, q_order, ids, values, order = (np.frombuffer(c[i].as_py(), dtype=d) for c, d in zip(batch.columns, 2 * (np.int64, np.float64, np.int16), strict=True))
                shard = Shard(ids, values.reshape(len(ids), -1), order.reshape(len(ids), -1), count)
                asked_ids, found, scores = [], [], []
                for q, v, o in zip(q_ids, q_vectors.reshape(len(q_ids), -1), q_order.reshape(len(q_ids), -1), strict=True):
                    own, score = shard.search(q, v, o, k, share)
                    asked_ids.append(np.full(len(own), q))
                    found.append(own)
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (asked_ids, found, scores)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = written(best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")
    drop_written(index)
    drop_written(blocks)
    return out
