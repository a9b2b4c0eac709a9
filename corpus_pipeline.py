"""A corpus pipeline of four stages, each over all that its predecessor kept.

Language identification drops the documents that the classifier rejects; near-duplicate
detection keeps the smallest id of each group of documents linked at similarity 0.8 on
five-word shingles; the source mix repeats or drops whole documents to bring sources to
their target weights; the last stage encodes what is left into SentencePiece ids.
Each stage handles empty input, null texts and repeated ids, whose rows are documents of
their own (see its operator).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.llm import lang_centroid, odd_sketch, piece_bpe, pivotal_mix
from proofgrid.llm.common import fold_of, read, stage
from proofgrid.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a centroid of some language; texts without letters and outliers go."""
    model = lang_centroid.fit(docs, fold_of("doc_id", 3) != 1)
    return lang_centroid.identify(docs, model).where(~F.col("rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near-duplicates."""
    return odd_sketch.drop_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times."""
    return pivotal_mix.repeat(docs, weights=(3, 1, 2), share=1.5, ceiling=2.0)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with a check that decoding them gives the text back."""
    coded = piece_bpe.encode(docs, vocabulary("piece_bpe_32k.model"), decoded=True)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return coded.select("doc_id", "source", "n_tokens", F.base64("ids").alias("ids_base64"), same.alias("round_trip"))


STAGES = [("language ID", identify_language), ("near-duplicates", drop_near_duplicates), ("source mix", mix_sources), ("piece encoding", encode_pieces)]

#: The stages' models, hashes and tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
