"""A training-data pipeline: five stages from raw documents to packed sequences.

Each stage takes all documents that its predecessor kept, with their changed texts, and
is written as Parquet before the next one reads it. All stages but the last return the columns of
documents: doc_id, text, lang, source, n_chars.

Edge cases: null and empty texts fail the first stage, and texts that a stage empties go with it;
rows with a null id pass all stages (a near-duplicate without an id stays, but its repeated
passages go); repeated rows of one id stay together until the substring stage, which empties
all but the first; empty tables give empty results; columns besides those of documents
are dropped by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import decontaminate
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack, tokenizer_path
from tessera.llm.quality_rules import quality_rules
from tessera.llm.substrings import substring_dedup
from tessera.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, with ``text`` as the text; texts without a visible character go."""
    df = df.withColumn("text", F.col(text)).where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return _documents(quality_rules(docs).where("kept"), "cleaned_text")


def stage_minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id. Rows without an id stay."""
    return docs.join(near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def stage_suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that occurred earlier in the corpus."""
    return _documents(substring_dedup(docs.select(*COLUMNS), as_text=True), "kept_text")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that mostly consist of them go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(decontaminate(docs.select(*COLUMNS), benchmark).where("kept"), "cleaned_text")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stage_quality_rules),
    ("minhash_near_dedup", stage_minhash),
    ("suffix_array_dedup", stage_suffix_array),
    ("benchmark_decontamination", stage_decontaminate),
    ("packing", stage_packing),
]

#: Suffix arrays over bytes and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
