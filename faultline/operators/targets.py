"""Multi-horizon targets, time splits, class balance and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..constants import HORIZONS
from ..functions.days import DAY_US, floor_days, micros
from .features import KEYS, ORDER, require
from .ordered import HOT_ROWS, block_window, core_rows, ordered_blocks, ranked
from .quantiles import exact_quantiles


def horizon_targets(
    df: DataFrame, horizons: Sequence[int] = HORIZONS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``fails_within_{h}d``: 1 if the asset fails again within h whole days.

    The last failure of an asset is labelled 0 and marked ``is_censored``.
    """
    require(df, [*KEYS, *ORDER])
    blocks, _ = ordered_blocks(df, KEYS, ORDER, before=0, after=1, hot_rows=hot_rows)
    w = block_window(KEYS).orderBy(*ORDER)
    out = blocks.withColumn("_next", F.lead("ts").over(w))
    gap = floor_days(F.col("_next"), F.col("ts"))
    out = out.withColumns({
        "is_censored": F.col("_next").isNull(),
        **{f"fails_within_{h}d": F.when(gap <= h, 1).otherwise(0) for h in horizons},
    })
    return core_rows(out).drop("_next")


def temporal_split(
    df: DataFrame, train: float = 0.6, val: float = 0.2, ts: str = "ts",
    purge_days: int = 0,
) -> DataFrame:
    """Add ``split`` = train / val / test by exact quantiles of the date.

    With ``purge_days`` the rows of a split whose label window reaches past its end
    are dropped from train and val.
    """
    at = exact_quantiles(df.select(micros(ts).alias("at")), ["at"], [train, train + val])["at"]
    q1, q2 = F.lit(at[0]), F.lit(at[1])
    t = micros(ts)
    out = df.withColumn("split", F.when(t <= q1, "train").when(t <= q2, "val").otherwise("test"))
    if purge_days:
        end = F.when(F.col("split") == "train", q1).when(F.col("split") == "val", q2)
        out = out.where((F.col("split") == "test") | (t + purge_days * DAY_US <= end))
    return out


def class_balance(df: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Rows, positives and positive share per split and horizon, in one pass."""
    sums = [F.sum(f"fails_within_{h}d").alias(f"_{h}") for h in horizons]
    wide = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    each = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"_{h}").alias("positives")) for h in horizons
    ])).alias("e")
    return wide.select("split", "n_rows", each).select(
        "split", "e.horizon", "n_rows", "e.positives",
        (F.col("e.positives") / F.col("n_rows")).alias("positive_rate"),
    )


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` per class."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n_class"))
    total = counts.agg(F.sum("n_class").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return counts.join(F.broadcast(total)).select(
        y, "n_class", (F.col("_n") / (F.col("_k") * F.col("n_class"))).alias("weight")
    )


def with_class_weight(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (binary target: two weights); none without a label."""
    return df.join(F.broadcast(class_weights(df, y).select(y, F.col("weight").alias(out))), y, "left")


def _shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Pseudo-random position of each row, and its cell among 65,536."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    return df.withColumn("_h", h).withColumn("_cell", F.shiftright("_h", 48))


def undersample(df: DataFrame, y: str, key: str, seed: int = 42) -> DataFrame:
    """Random rows of every class down to the size of the smallest class.

    The choice is by hash order, so it repeats. Counts per cell tell which cells can hold
    kept rows; only the rows of those cells are shuffled and ranked inside their cell. Rows
    without a label belong to no class and are not drawn.
    """
    cells = _shuffled(df.where(F.col(y).isNotNull()), key, seed)
    counts = cells.groupBy(y, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(y).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(y, "_cell", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    least = counts.groupBy(y).agg(F.sum("_n").alias("_all")).agg(F.min("_all").alias("_least"))
    # at most classes x 65,536 rows
    limits = F.broadcast(sums.join(F.broadcast(least)).where("_before < _least"))
    place = F.row_number().over(Window.partitionBy(y, "_cell").orderBy("_h", key))
    kept = cells.join(limits, [y, "_cell"]).withColumn("_at", place).where("_before + _at <= _least")
    return kept.select(*df.columns)


def stratified_folds(df: DataFrame, y: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` in [0, folds): classes dealt evenly in hash order; rows without a label count as one class."""
    out = ranked(_shuffled(df, key, seed), [y], ["_cell"], ["_h", key], "_at")
    return out.withColumn("fold", ((F.col("_at") - 1) % folds).cast("int")).drop("_at", "_cell", "_h")
