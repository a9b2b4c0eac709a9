"""Nearest neighbours by largest inner product, with a permutation index.

A bounded sample of vectors serves as pivots. Every vector is represented by the ordered
list of the pivots nearest to it; the lists are posted in inverted files, one for each
pivot, with the pivot's place. A query adds up, from the files of its own pivots, the
footrule distance between its list and those of all vectors of a block (a pivot that one
list lacks counts as if at its end), and the vectors of smallest distance, with all that
tie at the cut, are reranked by the exact inner product in double precision. Equal vectors
of a block take one place among them and all come back.

The share of a block that is reranked begins as a parameter. In each task a hashed part of
the queries is compared with the whole block; while the index finds less of their true
nearest than the audit asks for, the share is doubled.

Work is dealt in pairs of a block of rows and a block of queries, both bounded, so no
hot value makes a hot task. Defined results: null, empty, zero vectors and vectors with
null or non-finite components are neither queries nor candidates; ties go to the smaller
id; a query with fewer candidates than asked for gets them all. Vectors of another length
than the query's are no candidates (each length has an index of its own); repeated ids stand
for rows of their own, but a query never returns its own id; a null id takes no part; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stage
from .vectors import clean, ints, matrix

PIVOTS, PREFIX = 512, 64
#: Rows of a block, queries of a block; the share of a block's rows, and the least number, that are reranked.
BLOCK, QUERIES = 16_384, 4096
SHARE, LEAST = 0.08, 256
#: Queries audited in a task at least (and one in so many), share of their true nearest that must be found.
AUDIT, ONE_IN, PASS = 16, 64, 0.97


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each row the pivots of largest inner product, nearest first (ties to the smaller number)."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


class InvertedFiles:
    """The postings of a block: for each pivot the rows whose list has it, and its place there."""

    def __init__(self, lists: np.ndarray, pivots: int):
        n, self.prefix = lists.shape
        flat = lists.ravel()
        order = np.argsort(flat, kind="stable")
        ends = np.cumsum(np.bincount(flat, minlength=pivots))[:-1]
        self.rows = np.split((order // self.prefix).astype(np.int32), ends)
        self.places = np.split((order % self.prefix).astype(np.int32), ends)
        self.n = n

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """The footrule distance of a query's list to all lists of the block."""
        k = self.prefix
        at = np.concatenate([self.rows[pivot] for pivot in query])
        # a shared pivot counts |difference| instead of (k - place) + (k - its place)
        gain = np.concatenate([k - np.maximum(place, self.places[pivot]) for place, pivot in enumerate(query)])
        return k * (k + 1) - 2 * np.bincount(at, gain, self.n).astype(np.int32)


def _classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each class of equal vectors, and each row's class."""
    number: dict[bytes, int] = {}
    kind = np.array([number.setdefault(v.tobytes(), len(number)) for v in x + 0.0], np.int64)
    return np.unique(kind, return_index=True)[1], kind


def _search(rows: pa.Table, queries: pa.Table, k: int, pivots: int, share: float, least: int) -> dict:
    x, ids = matrix(rows["vector"]), ints(rows["id"])
    order = np.argsort(ids, kind="stable")  # so that ties in rank go to the smaller id
    x, ids = x[order], ids[order]
    # equal vectors are one class, so that copies neither compete for places nor lose any
    first, kind = _classes(x)
    unlike = x[first]
    files = InvertedFiles(matrix(rows["pivots"])[order][first].astype(np.int64), pivots)
    q, lists, qids = matrix(queries["vector"]), matrix(queries["pivots"]).astype(np.int64), ints(queries["id"])

    def nearest(i: int, take: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of a query's nearest among the classes of smallest distance, or among all."""
        score = np.full(len(first), -np.inf)
        if take is None or take >= len(first):
            score = unlike @ q[i]
        else:
            near = files.footrule(lists[i])
            chosen = np.flatnonzero(near <= np.partition(near, take - 1)[take - 1])  # with all that tie at the cut
            score[chosen] = unlike[chosen] @ q[i]
        at = np.flatnonzero((score > -np.inf)[kind] & (ids != qids[i]))
        scores = score[kind[at]]
        if len(at) > k:
            some = scores >= np.partition(scores, len(at) - k)[len(at) - k]
            at, scores = at[some], scores[some]
        best = np.lexsort((ids[at], -scores))[:k]
        return at[best], scores[best]

    take = min(len(first), max(least, k + 1, int(share * len(first))))
    audit = np.argsort((qids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), kind="stable")[: max(AUDIT, len(q) // ONE_IN)]
    truth = {i: nearest(i, None)[0] for i in audit.tolist()}
    while take < len(first):
        found = sum(len(np.intersect1d(t, nearest(i, take)[0])) for i, t in truth.items())
        if found >= PASS * sum(map(len, truth.values())):
            break
        take *= 2
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    for i, qid in enumerate(qids):
        best, scores = nearest(i, take)
        out["query_id"].append(np.full(len(best), qid))
        out["vec_id"].append(ids[best])
        out["score"].append(scores)
    return {c: np.concatenate(v) if v else np.empty(0) for c, v in out.items()}


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query(id) holds its k nearest other rows.

    is_query is an expression over a column named ``id``.
    """
    spark = df.sparkSession
    rows = stage(clean(df, id_col, vector_col).withColumn("size", F.size("vector")), "vectors")
    sizes = rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if(is_query).alias("m")).where("m > 0").collect()
    shape = "query_id long, vec_id long, score double"
    found = spark.createDataFrame([], shape)
    for r in sizes:  # an index for each length of vectors
        found = found.unionByName(_of_one_length(rows.where(F.col("size") == r["size"]), r["n"], r["m"], is_query, k, pivots, prefix, share, least))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_one_length(rows: DataFrame, n: int, m: int, is_query: Column, k: int, pivots: int, prefix: int, share: float, least: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each query in each block of rows."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vector").collect()
    shared = spark.sparkContext.broadcast(np.array([r["vector"] for r in sample]))
    prefix, count = min(prefix, len(sample)), len(sample)

    def post(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lists = permutations(matrix(batch.column("vector")), shared.value, prefix)
            yield {"id": batch.column("id"), "vector": batch.column("vector"), "pivots": list(lists)}

    index = stage(map_arrow(rows.select("id", "vector"), post, "id long, vector array<double>, pivots array<smallint>"), "permutation-index")
    blocks, query_blocks = -(-n // BLOCK), -(-m // QUERIES)
    spread = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = index.withColumn("block", spread(blocks)).withColumn("qblock", every(query_blocks))
    right = index.where(is_query).withColumn("qblock", spread(query_blocks)).withColumn("block", every(blocks))

    def run(a, b):
        got = _search(a, b, k, count, share, least) if a.num_rows and b.num_rows else {"query_id": [], "vec_id": [], "score": []}
        return pa.table({"query_id": pa.array(got["query_id"], pa.int64()), "vec_id": pa.array(got["vec_id"], pa.int64()), "score": pa.array(got["score"], pa.float64())})

    return left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInArrow(run, "query_id long, vec_id long, score double")
