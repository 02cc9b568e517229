"""A corpus pipeline of five stages; each writes Parquet that the next one rereads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlore.llm import bpe, exact_dedup, mixing, quality, simhash
from gridlore.llm.common import drop_scratch, read_table, scratch_path
from gridlore.llm.registry import mixture, tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It rejects what it holds for bad rather than for doubtful."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"), threshold=QUALITY_THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the target weights give their leaf budget."""
    return mixing.mixed_documents(docs, **mixture())


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts. Workers keep few pre-tokens, as earlier stages hold memory too."""
    return bpe.encode_decode(docs, tokenizer("word_bpe_49k.json"), known_words=KNOWN_WORDS)


#: A document goes if its calibrated probability of good quality is below this.
QUALITY_THRESHOLD = 0.5
#: Pre-tokens that a worker of the encoding stage keeps.
KNOWN_WORDS = 60_000

STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("bpe encoding and decoding", encoding_stage),
]

#: SQL cannot express the classifier and the encoder; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_scratch(spark, after=path)  # the stage's own tables; stages' outputs stay
        docs = spark.read.parquet(path)
    return docs
