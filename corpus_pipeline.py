"""From raw documents to a training mix: stages of the operators in ``scorewright.llm``, each over the last one's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.kn_quality import drop_rejected
from scorewright.llm.latent_search import drop_leaks
from scorewright.llm.line_runs import drop_repeated_runs
from scorewright.llm.mixing import mix_texts
from scorewright.llm.parity_join import drop_near_duplicates
from scorewright.llm.store import frugal, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    with frugal(spark):
        return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of runs of lines are cut from the texts; documents of which no line is left go."""
    with frugal(spark):
        cut = drop_repeated_runs(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates the smallest id stays."""
    with frugal(spark):
        return drop_near_duplicates(docs, n=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    with frugal(spark):
        return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: the slots of the mix, each with its text and the documents it comes from."""
    with frugal(spark):
        return mix_texts(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("source_mix", mixed),
]

#: No SQL: the models and draws of three stages are beyond it. Each stage is tested against a brute-force version over a
#: small fixture (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
