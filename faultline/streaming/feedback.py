"""Outcome feedback for predictions and outcomes that keep arriving."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.feedback import match_outcomes

#: Matches before the first batch.
MATCHES_SCHEMA = "prediction_id long, failed int, occurred_at timestamp, registered_seq long"


def matched_stream(
    predictions: DataFrame, outcomes: DataFrame, max_horizon: int, lateness: str = "1 day"
) -> DataFrame:
    """Stream of predictions with every outcome inside their horizon (left outer).

    Watermarks on both sides let old rows leave the state: a prediction without outcome is
    emitted with nulls once the watermark passes its horizon, an outcome later than that is
    dropped. Apply :func:`first_registered` to the collected output. A prediction meets each
    of its outcomes here; for assets with very many of both use :func:`run_feed`. The state
    is kept for ``max_horizon`` days, so a prediction with a longer horizon ends the stream with
    an error instead of losing its matches.
    """
    too_long = F.raise_error(F.concat(F.lit("horizon above max_horizon: "), F.col("horizon").cast("string"))).cast("int")
    predictions = predictions.withColumn(
        "horizon", F.when(F.col("horizon") > max_horizon, too_long).otherwise(F.col("horizon"))
    )
    p = predictions.withWatermark("predicted_at", lateness).alias("p")
    o = outcomes.withWatermark("occurred_at", lateness).select(
        F.col("asset_id").alias("o_asset"), "occurred_at", "failed", "registered_seq"
    )
    own = F.col("predicted_at") + F.make_dt_interval(F.col("horizon") + 1)
    limit = F.col("predicted_at") + F.expr(f"INTERVAL {max_horizon + 1} DAYS")
    inside = (
        (F.col("asset_id") == F.col("o_asset"))
        & (F.col("occurred_at") >= F.col("predicted_at"))
        & (F.col("occurred_at") < limit)
        & (F.col("occurred_at") < own)
    )
    return p.join(o, inside, "left_outer").drop("o_asset")


def first_registered(matches: DataFrame, keys: tuple[str, ...] = ("prediction_id",)) -> DataFrame:
    """One row per prediction: the outcome registered first, or null."""
    return matches.groupBy(*keys).agg(
        F.min_by("failed", "registered_seq").alias("outcome"),
        F.min_by("occurred_at", "registered_seq").alias("occurred_at"),
    )


def run_feed(
    spark: SparkSession, outcomes: DataFrame, history_path: str, matches_path: str, checkpoint: str,
    max_horizon: int | None = None,
) -> StreamingQuery:
    """Match each micro-batch of outcomes against the stored history with the batch operator.

    Its cost is linear in rows also for a busy asset. The matches of a batch go to their own
    folder, so a repeated batch replaces its output; predictions outside the batch's time
    range are pruned by the scan. The longest horizon is that of the history; ``max_horizon``
    can only widen it. Read the result with :func:`read_feed`.
    """

    def handle(batch: DataFrame, number: int) -> None:
        span = batch.agg(F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi")).first()
        if span["lo"] is None:
            return
        history = spark.read.parquet(history_path)
        longest = max(history.agg(F.max("horizon")).first()[0] or 0, max_horizon or 0)
        start = F.lit(span["lo"]) - F.expr(f"INTERVAL {longest + 1} DAYS")
        open_ = history.where(F.col("predicted_at").between(start, F.lit(span["hi"])))
        found = match_outcomes(open_, batch, with_seq=True).where(F.col("outcome").isNotNull())
        rows = found.select(
            "prediction_id", F.col("outcome").alias("failed"), "occurred_at", "registered_seq"
        )
        rows.write.mode("overwrite").parquet(f"{matches_path}/batch={number}")

    return (
        outcomes.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_feed(spark: SparkSession, history_path: str, matches_path: str) -> DataFrame:
    """History with the first registered outcome over all batches; before the first match all are open."""
    try:
        matches = spark.read.parquet(matches_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        matches = spark.createDataFrame([], MATCHES_SCHEMA)
    first = first_registered(matches)
    return spark.read.parquet(history_path).join(first, "prediction_id", "left")
