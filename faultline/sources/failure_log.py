"""Failure log: header normalisation, required columns, cleaning, asset key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import FAILURE_HEADERS, FAILURE_REQUIRED, SOURCE_NAMES
from ..functions.text import normalized_headers, renamed, trimmed

#: Tried in this order after ISO text; the day comes before the month.
DATE_FORMATS = (
    "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy", "d-M-yyyy H:mm:ss", "d-M-yyyy H:mm", "d-M-yyyy",
    "d.M.yyyy H:mm:ss", "d.M.yyyy H:mm", "d.M.yyyy", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d",
)
ASSET_PARTS = ("installation", "module", "equipment")
EMPTY_LOG = (
    "asset_id string, ts timestamp, region string, installation string, "
    "module string, equipment string"
)


def failure_log(raw: DataFrame, date_format: str | None = None) -> DataFrame:
    """Clean log from a raw table; an empty log if a required column is absent.

    Rows without date, equipment, installation or module are dropped; the region may
    be null. Columns the log does not know are kept. Date text is read with ``date_format``
    if given, else as ISO or in the first of ``DATE_FORMATS`` that fits; :func:`unread_dates`
    counts what none of them reads.
    """
    df = renamed(normalized_headers(raw), FAILURE_HEADERS)
    if any(c not in df.columns for c in FAILURE_REQUIRED):
        return raw.sparkSession.createDataFrame([], EMPTY_LOG)
    df = renamed(df, {v: k for k, v in SOURCE_NAMES.items()})
    clean = {"ts": read_date(df, "ts", date_format), **{name: trimmed(name) for name in ("region", *ASSET_PARTS)}}
    df = df.dropna(subset=list(ASSET_PARTS)).withColumns(clean).where(F.col("ts").isNotNull())
    return df.withColumn("asset_id", F.concat_ws(" - ", *ASSET_PARTS))


def read_date(df: DataFrame, name: str, date_format: str | None = None) -> Column:
    if df.schema[name].dataType.typeName() != "string":
        return F.col(name).cast("timestamp")
    if date_format:
        return F.try_to_timestamp(name, F.lit(date_format))
    text = F.trim(name)
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def unread_dates(raw: DataFrame, date_format: str | None = None) -> DataFrame:
    """One row: number of rows whose date is given but not read, and one such text."""
    df = renamed(renamed(normalized_headers(raw), FAILURE_HEADERS), {v: k for k, v in SOURCE_NAMES.items()})
    if "ts" not in df.columns:
        return raw.sparkSession.createDataFrame([(0, None)], "n_unread long, example string")
    text = F.trim(F.col("ts").cast("string"))
    unread = (text != "") & read_date(df, "ts", date_format).isNull()
    return df.agg(F.count(F.when(unread, 1)).alias("n_unread"), F.min(F.when(unread, text)).alias("example"))


def read_failure_log(
    spark: SparkSession, path: str, fmt: str = "csv", date_format: str | None = None, **options
) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True)
    return failure_log(reader.load(path), date_format)
