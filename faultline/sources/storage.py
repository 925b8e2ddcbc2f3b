"""Prediction sink, prediction history and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K

HISTORY_SCHEMA = (
    "prediction_id long, asset_id string, predicted_at timestamp, horizon int, "
    "probability double, risk string, model_version string"
)


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local one only in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialized(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """Write the table to the shared folder and read it back, to compute it once.

    For results used several times in one plan; lost executors reread the files. The path goes
    to ``scratch``, for :func:`discard` once the last reader is done.
    """
    path = f"{shared_folder(df.sparkSession)}/faultline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Delete the tables that :func:`materialized` noted; nothing may read them any more."""
    while scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_predictions(df: DataFrame, path: str, run_date: str, fmt: str = "parquet") -> None:
    """Append one scoring run, partitioned by run date; ``csv`` or ``parquet``."""
    writer = df.withColumn("run_date", F.lit(run_date)).write.mode("append").partitionBy("run_date")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)


def append_history(predictions: DataFrame, path: str) -> None:
    """Append predictions to the history table; earlier files are never rewritten."""
    columns = [c.split()[0] for c in HISTORY_SCHEMA.split(", ")]
    predictions.select(*columns).write.mode("append").partitionBy("horizon").parquet(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def write_json_history(history: DataFrame, path: str) -> None:
    """Predictions and their outcomes as JSON documents under the names of the source files, one a line."""
    texts = {"data_predicao", "data_resultado"}
    fields = [
        (F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if n in texts else F.col(c)).alias(n)
        for n, c in K.HISTORY_FIELDS.items() if c in history.columns
    ]
    history.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def read_json_history(spark: SparkSession, path: str, listed: bool = False) -> DataFrame:
    """The prediction history of JSON files with one document a line, or with one list of documents each (``listed``).

    Missing fields are null, unknown fields are left out. Dates are ISO text with or without a time, and null if they
    are anything else. The outcome may be a number or a truth value.
    """
    kinds = {"horizonte": "int", "probabilidade": "double"}
    schema = ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in K.HISTORY_FIELDS)
    rows = spark.read.schema(schema).option("multiLine", listed).json(path)
    kept = rows.select(*[F.col(n).alias(c) for n, c in K.HISTORY_FIELDS.items()])
    known = F.lower("outcome")
    return kept.withColumns({
        "predicted_at": F.col("predicted_at").try_cast("timestamp"), "occurred_at": F.col("occurred_at").try_cast("timestamp"),
        "outcome": F.when(known == "true", 1).when(known == "false", 0).otherwise(F.col("outcome").try_cast("double").cast("int")),
    })


def save_bucketed(log: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store a log as a table bucketed by asset, and read it back.

    All per-asset windows and aggregations over the table then start without a shuffle.
    """
    order = [c for c in ("asset_id", "ts", "event_id") if c in log.columns]
    writer = log.write.mode("overwrite").bucketBy(buckets, "asset_id").sortBy(*order)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return log.sparkSession.table(name)
