"""The corpus pipeline: repetition rules, language, near copies, repeated passages, packing.

Each stage takes what the one before kept, as Parquet read again, and returns the columns of
documents; the last returns the pieces' places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import langid, minhash, packing, repetition, suffix_dedup
from tidewell.llm.common import stored, table
from tidewell.llm.queries import tokenizer_path


#: Of the encoder in the last stage, whose executors have grown in the stages before.
PACKING_CACHE_BYTES = 10 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.passing(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know; lang stays as it was."""
    return langid.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return minhash.without_near_duplicates(docs, shingle_words=5)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that stand earlier; n_chars is what is left."""
    kept = suffix_dedup.remaining_texts(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return packing.packed(docs, tokenizer_path(), cache_bytes=PACKING_CACHE_BYTES)


STAGES = [("quality_rules", quality_rules), ("language", language), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", packing_stage)]

#: Sketches, models and token ids have no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
