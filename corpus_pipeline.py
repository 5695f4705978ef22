"""Corpus cleaning in five stages: quality, shared lines, near-duplicates, benchmark leaks, source mix.

Each stage reads what its predecessor kept, as a Parquet table, and its decisions take effect: rows go, or lines of
their text go.  Only the last returns other columns: one row for each document that the mix takes, with the number of
times it is taken (texts stay in the table before, under the same doc_id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, line_dedup, minhash, mixing, quality_crf


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores under 0.3 go. It is fitted on this stage's own input."""
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share are cut out; a changed text gets its new n_chars. Every document stays.

    Copies stay whole: the next stage keeps one of each group.
    """
    out = line_dedup.line_dedup(docs, spare_copies=True)
    n = F.when(F.col("_ld_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id stays (similarity 0.85 on 5-word shingles)."""
    return minhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: doc_id, source, size, source_size, target, copies, taken."""
    return mixing.mix_sources(docs).where("copies > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", mix),
]

#: A fitted classifier and balanced sampling decide the rows: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again.

    What a stage stored on its way, and the table before it, go once its own table is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage{k}", before)
    return docs
