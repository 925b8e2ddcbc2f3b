"""The three end-to-end jobs: train, score, explain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import HORIZONS, ROLLING_WINDOWS
from ..operators.features import asset_features, asset_series, feature_names
from ..operators.rootcause import cause_report
from ..operators.scoring import score_assets
from ..operators.survival import weibull_fit
from ..operators.targets import horizon_targets, temporal_split
from ..operators.training import candidates, train_horizons
from ..sources.model_store import load_models, save_models
from ..sources.storage import materialized


@dataclass
class Settings:
    """Choices of a training or scoring run."""

    windows: Sequence[int] = ROLLING_WINDOWS
    seasonal: bool = True
    interactions: bool = True
    horizons: Sequence[int] = HORIZONS
    train_share: float = 0.6
    val_share: float = 0.2
    purge_days: int = 0
    calibration: str = "sigmoid"
    stack: bool = True
    search: dict | None = None
    models: dict = field(default_factory=candidates)

    def feature_names(self) -> list[str]:
        return feature_names(self.windows, self.seasonal, self.interactions)


def feature_table(log: DataFrame, settings: Settings, weibull: DataFrame | None = None) -> DataFrame:
    """Features of the whole log; the Weibull parameters come from its gaps above zero."""
    if weibull is None:
        weibull = weibull_fit(asset_series(log))
    return asset_features(log, settings.windows, settings.seasonal, settings.interactions, weibull)


def train(spark: SparkSession, log: DataFrame, root: str, settings: Settings | None = None) -> tuple[str, dict]:
    """Log -> features -> targets -> split -> champions -> model store. Returns version and results."""
    settings = settings or Settings()
    labelled = horizon_targets(feature_table(log, settings), settings.horizons)
    table = temporal_split(materialized(labelled), settings.train_share, settings.val_share, purge_days=settings.purge_days)
    results = train_horizons(
        table, settings.feature_names(), settings.horizons, settings.models, settings.calibration,
        settings.stack, search=settings.search,
    )
    return save_models(spark, results, settings.feature_names(), root), results


def score(spark: SparkSession, log: DataFrame, root: str, version: str = "latest", settings: Settings | None = None) -> DataFrame:
    """Log -> features -> newest row per asset -> scores of every stored horizon (long form)."""
    return score_assets(feature_table(log, settings or Settings()), load_models(spark, root, version))


def explain(log: DataFrame, features: Sequence[str], window_days: int = 7) -> DataFrame:
    """Cause report of every failure of the log over the given features."""
    table = asset_features(log, fill=True)
    return cause_report(table.select("asset_id", "ts", "event_id", *features), features, window_days)


def repeat_rates(log: DataFrame) -> DataFrame:
    """Failures, mean TBF and share repeated within 30 days, per region."""
    rows = horizon_targets(asset_series(log), [30])
    return rows.groupBy("region").agg(
        F.count(F.lit(1)).alias("failures"),
        F.round(F.avg("tbf"), 6).alias("mean_tbf"),
        F.round(F.avg("fails_within_30d"), 6).alias("repeat_rate_30d"),
    )
