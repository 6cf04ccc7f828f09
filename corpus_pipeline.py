"""The corpus pipeline: five stages, each all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from learnmill.llm import bpe, compression_rules, decontaminate, language_id, simhash
from learnmill.llm.common import remove_folder, shared_folder


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; those without letters, or nearer to none than
    chance would be, go. Profiles are learned from the documents' own ``lang``; null and empty texts go."""
    return language_id.keep_identified(docs, language_id.train_language_profiles(docs), min_score=0.2)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose ratios, whole and by chunk, lie in the bands of their
    length. Null, empty and short texts go; equal rows share their fate."""
    return compression_rules.apply_quality_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group linked by a similarity of 0.8 or more of five-word
    shingles. Texts without words are alike; of rows equal in id and text one stays."""
    return simhash.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark's items. Null and empty texts have no window and
    stay; so does everything where the benchmark is empty."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the two digests, and the ids themselves. Null and empty texts have
    no ids; rows that repeat are each encoded."""
    return bpe.encode_documents(docs, ["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("language_id", identify_languages),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", remove_benchmark),
    ("encode", encode),
]

#: Fingerprints, compression ratios and token ids are not to be had in SQL; tests compare each stage
#: with plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result but the last is written to the shared folder and
    read again. A stage's folder is removed once the next one is written, so only the last remains.
    Extra columns are carried along; an empty table gives an empty table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
