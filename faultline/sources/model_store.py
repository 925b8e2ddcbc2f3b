"""Versioned models and their metadata table."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.stacking import StackedModel

log = logging.getLogger(__name__)
METADATA_SCHEMA = (
    "version string, created_at timestamp, horizon int, model_name string, threshold double, "
    "features array<string>, bases array<string>, "
    "metrics_val map<string,double>, metrics_test map<string,double>"
)


def _folder(root: str, version: str, horizon: int, part: str) -> str:
    return f"{root}/models/{version}/h{horizon}/{part}"


def save_models(
    spark: SparkSession, results: dict[int, dict], features: Sequence[str], root: str, version: str | None = None
) -> str:
    """Write the model of every horizon, then one metadata row per horizon; returns the version.

    The metadata rows are written last, so a version is visible only when its models are
    complete.
    """
    now = datetime.now(timezone.utc)
    version = version or now.strftime("v%Y%m%d_%H%M%S_%f")
    rows = []
    for h, r in results.items():
        model, bases = r["model"], []
        if isinstance(model, StackedModel):
            bases = list(model.bases)
            for name, base in model.bases.items():
                base.write().overwrite().save(_folder(root, version, h, f"base_{name}"))
            model = model.meta
        model.write().overwrite().save(_folder(root, version, h, "model"))
        rows.append((
            version, now, h, r.get("model_name", "Unknown"), float(r.get("threshold", 0.5)), list(features),
            bases, _numbers(r.get("metrics_val")), _numbers(r.get("metrics_test")),
        ))
    spark.createDataFrame(rows, METADATA_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/metadata")
    return version


def _numbers(metrics: dict | None) -> dict[str, float]:
    return {k: float(v) for k, v in (metrics or {}).items() if v is not None}


def metadata(spark: SparkSession, root: str, version: str = "latest") -> DataFrame:
    """Metadata rows of a version; ``latest`` is the version written last."""
    table = spark.read.schema(METADATA_SCHEMA).parquet(f"{root}/metadata")
    if version == "latest":
        newest = table.agg(F.max_by("version", "created_at").alias("version")).first()
        version = newest["version"]
    return table.where(F.col("version") == version)


#: One metadata document of a version; further fields are left out.
DOCUMENT_SCHEMA = (
    "version string, timestamp string, features array<string>, n_features int, models_by_horizon map<string, struct<"
    "model_name: string, best_threshold: double, metrics_val: map<string,double>, metrics_test: map<string,double>>>"
)


def metadata_documents(rows: DataFrame) -> DataFrame:
    """``value``: one JSON document per version of metadata ``rows``, its horizons as a map."""
    of_horizon = F.struct("model_name", F.col("threshold").alias("best_threshold"), "metrics_val", "metrics_test")
    # a version has one row per horizon
    versions = rows.groupBy("version").agg(
        F.max("created_at").alias("at"), F.max_by("features", "created_at").alias("features"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("horizon").cast("string"), F.to_json(of_horizon))))).alias("m"),
    )
    typed = F.transform_values("m", lambda _, v: F.from_json(
        v, "model_name string, best_threshold double, metrics_val map<string,double>, metrics_test map<string,double>"
    ))
    return versions.select(F.to_json(F.struct(
        "version", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "features",
        F.size("features").alias("n_features"), typed.alias("models_by_horizon"),
    )).alias("value"))


def write_metadata_json(rows: DataFrame, path: str) -> None:
    metadata_documents(rows).write.mode("append").text(path)


def read_metadata_json(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One row per version and horizon of metadata documents, one a line, or one a file over several lines (``whole_files``).

    Unknown fields are left out. A missing model name is ``Unknown``, a missing threshold 0.5, missing metrics are an
    empty map; a horizon that is no number, and a document that is no JSON, give no row.
    """
    documents = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", whole_files).json(path)
    each = documents.select("version", "timestamp", "features", F.explode("models_by_horizon").alias("h", "m"))
    empty = F.create_map().cast("map<string,double>")
    return each.select(
        "version", F.col("timestamp").try_cast("timestamp").alias("created_at"), F.col("h").try_cast("int").alias("horizon"),
        F.coalesce("m.model_name", F.lit("Unknown")).alias("model_name"),
        F.coalesce("m.best_threshold", F.lit(0.5)).alias("threshold"), "features",
        F.coalesce("m.metrics_val", empty).alias("metrics_val"), F.coalesce("m.metrics_test", empty).alias("metrics_test"),
    ).where(F.col("horizon").isNotNull())


def load_models(
    spark: SparkSession, root: str, version: str = "latest", horizons: Sequence[int] | None = None
) -> dict[int, dict]:
    """``{horizon: {model, model_name, threshold, features, ...}}``; unreadable models are skipped."""
    rows = metadata(spark, root, version)
    if horizons is not None:
        rows = rows.where(F.col("horizon").isin(*horizons))
    found = rows.orderBy("horizon").collect()  # one row per horizon
    if not found:
        raise FileNotFoundError(f"no models of version {version} under {root}")
    out = {}
    for r in found:
        try:
            model = PipelineModel.load(_folder(root, r["version"], r["horizon"], "model"))
            if r["bases"]:
                model = StackedModel(
                    {b: PipelineModel.load(_folder(root, r["version"], r["horizon"], f"base_{b}")) for b in r["bases"]},
                    model,
                )
        except Exception as error:  # a horizon without a readable model is left out
            log.warning("model for %s days skipped: %s", r["horizon"], error)
            continue
        out[r["horizon"]] = {**r.asDict(), "model": model}
    return out
