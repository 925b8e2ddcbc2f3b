"""Corpus preparation in five stages; each stage works on all rows that its predecessor kept.

language: texts without a letter, or far from every learned language, go. near_duplicates: one document of
each group of similar documents (five-word shingles, similarity 0.8 or more) stays. decontamination: documents that hold a passage of the benchmark go.
secrets: secrets in the remaining texts are replaced by a mark. tokens: the last stage returns the number of
byte-level BPE tokens of each document and digests of its ids and of the bytes decoded from them.

All stages but the last return the columns of ``documents``; null texts fall at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import bytebpe, decontaminate, language, secrets, setjoin, textkit
from faultline.sources.storage import materialized

#: Model fitting and 64-bit shingle comparison have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None
#: Words of a shingle and least similarity of near duplicates; op10 has its own.
SHINGLE = 5
PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows whose language is recognised; the model learns from the training fold of the same rows."""
    model = language.fit(docs.where(language.training_fold(spark)).select("text", "lang"))
    kept = language.predict(textkit.shielded(docs), model, "in_text").where(~F.col("rejected"))
    return textkit.restored(kept, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of the smallest id of each component; texts without words are never duplicates."""
    return setjoin.one_of_each(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that hold no window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; no row goes."""
    found = secrets.scan(textkit.shielded(docs), "in_text")
    hit = F.size("spans") > 0
    found = found.withColumn("in_text", secrets.redacted(F.col("in_text"), F.col("spans")))
    found = found.withColumn("in_n_chars", F.when(hit, F.length("in_text").cast("long")).otherwise(F.col("in_n_chars")))
    return textkit.restored(found, docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    return bytebpe.round_trip(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", redact_secrets),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage returns is written and read again as the next one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir))
    return docs
