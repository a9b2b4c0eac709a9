"""Shared plumbing of the training-data operators: Arrow maps, words, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import discard, scratch_root, stage

__all__ = ["WORD", "discard", "fold_of", "join_frequent", "least_count", "map_arrow", "read", "scratch_root", "stage", "stretches", "words_in", "words_of"]

#: A word is a maximal run of anything but ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict | pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over fn, which may yield dicts of columns; they are cast to the declared schema."""
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                cols = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, struct)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased (and nothing else), as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The words of texts as ``words_of`` has them: how many each text has, all of them in order, and each text's joined by spaces."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    joined, words = pc.binary_join(lists, " "), lists.flatten()
    # a text without words is split into one that is empty
    sizes = np.where(pc.equal(pc.binary_length(joined), 0), 0, pc.list_value_length(lists)).astype(np.int64)
    return sizes, words if sizes.sum() == len(words) else words.filter(pc.greater(pc.binary_length(words), 0)), joined


def stretches(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in stretches of rows whose texts in a column have about size bytes, a single text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def fold_of(id_col: str, modulus: int):
    """crc32 of the id written as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def join_frequent(many: DataFrame, one: DataFrame, key: str, tie: str, counts: DataFrame | None = None, how: str = "inner", least: int = 256, parts: int = 2000) -> DataFrame:
    """many joined with one, which has a key once at most, where a key of many may be frequent.

    Rows of many whose key has more than a ``parts``-th of all (and more than least) are dealt by
    a hash of the column tie to as many tasks as it takes, and its row of one is sent to all of
    them. Such keys are no more than ``parts``, so they are collected and broadcast. many must be
    cheap to read twice; counts, (key, n), spares that.
    """
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    cap = max(least, (counts.agg(F.sum("n")).first()[0] or 0) // parts)
    found = counts.where(F.col("n") > cap).select(F.col(key), F.ceil(F.col("n") / cap).cast("int").alias("__parts")).collect()
    if not found:
        return many.join(one, key, how)
    hot = F.broadcast(many.sparkSession.createDataFrame(found, f"`{key}` {dict(many.dtypes)[key]}, __parts int"))
    dealt = many.join(hot, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(tie), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    sent = one.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(sent, [key, "__part"], how).drop("__part")


def least_count(counted: DataFrame, heavy: int) -> int:
    """The least count that at most ``heavy`` rows reach (to an eighth of its logarithm)."""
    step = F.floor(F.log2(F.greatest("c", F.lit(1))) * 8)
    room, cut = heavy, 1 << 62
    for r in counted.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("s")).collect():
        room -= r["n"]
        if room < 0:
            break
        cut = r["c"]
    return cut


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
