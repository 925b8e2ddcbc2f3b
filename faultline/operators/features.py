"""Time-between-failure features per asset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import EPS, NOT_FEATURES, ROLLING_WINDOWS
from ..functions.days import DAY_US, floor_days, micros
from .ordered import HOT_ROWS, block_window, core_rows, ordered_blocks
from .quantiles import grouped_median

KEYS = ["asset_id"]
ORDER = ["ts", "event_id"]
ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def require(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def calendar_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Month, weekday (Monday = 0), year and quarter of the failure."""
    return df.withColumns({
        "month": F.month(ts), "weekday": F.weekday(ts), "year": F.year(ts), "quarter": F.quarter(ts),
    })


def cyclic_parts(df: DataFrame) -> DataFrame:
    """Sine and cosine of the month (period 12) and the quarter (period 4)."""
    month = F.col("month") * (2 * F.pi() / 12)
    quarter = F.col("quarter") * (2 * F.pi() / 4)
    return df.withColumns({
        "month_sin": F.sin(month), "month_cos": F.cos(month),
        "quarter_sin": F.sin(quarter), "quarter_cos": F.cos(quarter),
    })


def _trend_columns(w) -> dict[str, Column]:
    tbf = F.col("tbf")
    previous = F.lag("tbf").over(w)
    recent = w.rowsBetween(-2, 0)
    return {
        "tbf_pct_change": F.try_divide(tbf - previous, previous),
        "tbf_volatility_3": F.stddev_samp("tbf").over(recent) / (F.avg("tbf").over(recent) + EPS),
    }


def interaction_columns(windows: Sequence[int]) -> dict[str, Column]:
    """Ratios, distances and z-score of the TBF against its rolling statistics."""
    tbf, out = F.col("tbf"), {}
    for n in (3, 6):
        if n in windows:
            out[f"ratio_vs_mean_{n}"] = tbf / (F.col(f"tbf_mean_{n}") + EPS)
    if 6 in windows:
        out["dist_from_min_6"] = tbf - F.col("tbf_min_6")
        out["dist_from_max_6"] = F.col("tbf_max_6") - tbf
        out["tbf_zscore_6"] = (tbf - F.col("tbf_mean_6")) / (F.col("tbf_std_6") + EPS)
    return out


def base_series(log: DataFrame, before: int, after: int = 0, hot_rows: int = HOT_ROWS):
    """Log in blocks with TBF, plus the expressions for failure count and asset age.

    Returns ``(blocks, extra, hot)``; ``hot`` tells whether an asset was cut.
    """
    require(log, [*KEYS, *ORDER])
    blocks, hot = ordered_blocks(log, KEYS, ORDER, before, after, hot_rows)
    w = block_window(KEYS).orderBy(*ORDER)
    blocks = blocks.select("*", floor_days(F.col("ts"), F.lag("ts").over(w)).alias("tbf"))
    start = F.coalesce("_start", micros(F.first("ts").over(w)))
    extra = {
        "cumulative_failures": F.coalesce("_rank", F.row_number().over(w)).cast("long"),
        "asset_age_days": F.floor((micros("ts") - start) / F.lit(DAY_US)).cast("long"),
    }
    return blocks, extra, hot


def asset_series(log: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """TBF (null on the first failure), running failure count and asset age in days."""
    blocks, extra, _ = base_series(log, 1, hot_rows=hot_rows)
    return core_rows(blocks.withColumns(extra))


def asset_features(
    log: DataFrame,
    windows: Sequence[int] = ROLLING_WINDOWS,
    seasonal: bool = True,
    interactions: bool = True,
    weibull: DataFrame | None = None,
    fill: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Feature table: the log plus temporal, rolling, trend, seasonal and interaction columns.

    ``weibull`` (one row: ``shape, scale``) adds ``survival_30d``; without it the
    column is the neutral 0.5. All windows share one partitioning and one sort.
    With ``fill`` a missing TBF becomes the median of its asset and every other missing
    number becomes 0, after the derived columns were computed on the unfilled TBF.
    """
    blocks, extra, hot = base_series(log, max([3, *windows]), hot_rows=hot_rows)
    w = block_window(KEYS).orderBy(*ORDER)
    rolling = {
        f"tbf_{name}_{n}": fn("tbf").over(w.rowsBetween(-(n - 1), 0))
        for n in windows
        for name, fn in ROLLING.items()
    }
    middle = {"_median": F.median("tbf").over(block_window(KEYS))} if fill else {}
    df = blocks.withColumns({**extra, **rolling, **_trend_columns(w), **middle}).where("_core")
    if fill and hot:
        whole = grouped_median(blocks.where("_hot and _core"), KEYS, "tbf", "_hot_median")
        # one row per hot asset, whose number was checked when they were listed
        df = df.join(F.broadcast(whole), KEYS, "left").withColumn(
            "_median", F.when(F.col("_hot"), F.col("_hot_median")).otherwise(F.col("_median"))
        )
    df = calendar_parts(df)
    if seasonal:
        df = cyclic_parts(df)
    if interactions:
        df = df.withColumns(interaction_columns(windows))
    df = with_survival(df, weibull)
    names = feature_names(windows, seasonal, interactions)
    filled = {c: F.col(c) for c in names}
    if fill:
        filled = {c: F.coalesce(c, F.lit(0)).alias(c) for c in names}
        filled["tbf"] = F.coalesce(F.col("tbf").cast("double"), "_median", F.lit(0.0)).alias("tbf")
    return df.select(*[c for c in log.columns if c not in filled], *filled.values())


def with_survival(df: DataFrame, weibull: DataFrame | None, days: int = 30) -> DataFrame:
    """Chance to outlast ``days`` more, given the current TBF (null TBF counts as 0)."""
    if weibull is None:
        return df.withColumn("survival_30d", F.lit(0.5))
    one = F.broadcast(weibull.select(F.col("shape").alias("_k"), F.col("scale").alias("_s")).limit(1))
    t = F.coalesce(F.col("tbf").cast("double"), F.lit(0.0))

    def alive(x: Column) -> Column:
        return F.exp(-F.pow(x / F.col("_s"), F.col("_k")))

    value = alive(t + days) / (alive(t) + EPS)
    return (
        df.join(one, how="left")
        .withColumn("survival_30d", F.coalesce(value, F.lit(0.5)))
        .drop("_k", "_s")
    )


def feature_names(
    windows: Sequence[int] = ROLLING_WINDOWS, seasonal: bool = True, interactions: bool = True
) -> list[str]:
    """Explicit list of the generated feature columns."""
    names = ["tbf", "cumulative_failures", "asset_age_days", "month", "weekday", "year", "quarter"]
    names += [f"tbf_{s}_{n}" for n in windows for s in ROLLING]
    names += ["tbf_pct_change", "tbf_volatility_3"]
    if seasonal:
        names += ["month_sin", "month_cos", "quarter_sin", "quarter_cos"]
    if interactions:
        names += list(interaction_columns(windows))
    return [*names, "survival_30d"]


def numeric_feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither metadata nor targets (reads the schema only)."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name not in NOT_FEATURES
        and not f.name.startswith(("fails_within_", "falha_em_"))
    ]


def feature_sequences(
    features: DataFrame, columns: Sequence[str], steps: int = 5, padded: bool = False,
    label: str | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The last ``steps`` feature rows of each asset as ``array<array<double>>``.

    Unpadded: only rows with a full history, label of the last step. Padded: one
    sequence per row, the earliest step repeated on the left.
    """
    blocks, _ = ordered_blocks(features, KEYS, ORDER, steps - 1, hot_rows=hot_rows)
    w = block_window(KEYS).orderBy(*ORDER).rowsBetween(-(steps - 1), 0)
    step = F.array(*[F.col(c).cast("double") for c in columns])
    seq = blocks.withColumn("_step", step).withColumn("sequence", F.collect_list("_step").over(w))
    out = core_rows(seq).drop("_step")
    if padded:
        lead = F.array_repeat(F.col("sequence")[0], F.lit(steps) - F.size("sequence"))
        out = out.withColumn("sequence", F.concat(lead, F.col("sequence")))
    else:
        out = out.where(F.size("sequence") == steps)
    keep = [*KEYS, *ORDER, "sequence"] + ([label] if label else [])
    return out.select(*keep)
