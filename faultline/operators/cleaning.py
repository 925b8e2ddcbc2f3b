"""Filters, imputation, outliers, duplicates, encoding, scaling, aggregation by asset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.storage import materialized
from .ordered import HOT_ROWS, UNBOUNDED, block_window, ordered_blocks, ranked, same_keys_join, split_cells
from .quantiles import exact_quantiles, grouped_median


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def date_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows between two dates, both ends included, either end optional."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end))
    return df


def column_stats(df: DataFrame, columns: Sequence[str], **fns) -> dict[str, dict[str, float]]:
    """One pass over the table: every function of every column, on the driver as scalars."""
    row = df.agg(*[fn(c).alias(f"{name}:{c}") for c in columns for name, fn in fns.items()]).first()
    return {c: {name: row[f"{name}:{c}"] for name in fns} for c in columns}


def fill_missing(df: DataFrame, strategy: str = "zero", columns: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls with zero, the mean or the exact median; an unknown strategy means zero.

    For forward fill see :func:`forward_fill`, which needs a key and an order.
    """
    columns = [c for c in (columns or numeric_columns(df)) if c in df.columns]
    if strategy == "mean":
        values = {c: s["avg"] for c, s in column_stats(df, columns, avg=F.avg).items()}
    elif strategy == "median":
        values = {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}
    else:
        return df.fillna(0, subset=columns)
    fills = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")) for c, v in values.items()
    }
    return df.withColumns(fills)


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Last known value of the same key in the given order.

    Hot keys are filled inside blocks first, then from the last known value of the earlier
    blocks (at most rows / hot_rows of them).
    """
    blocks, hot = ordered_blocks(df, keys, order, 0, hot_rows=hot_rows)
    w = block_window(keys).orderBy(*order).rowsBetween(UNBOUNDED, 0)
    filled = blocks.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    if not hot:
        return filled.select(*df.columns)
    part, at = [*keys, "_block"], F.struct(*order)
    known = blocks.where("_hot").groupBy(*part).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns]
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(UNBOUNDED, -1)
    carry = known.select(
        *part, F.lit(True).alias("_hot"), *[F.last(c, ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in columns]
    )
    return same_keys_join(filled, carry, [*part, "_hot"], "left").select(*[
        F.coalesce(c, f"_c_{c}").alias(c) if c in columns else F.col(c) for c in df.columns
    ])


def drop_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "zscore", threshold: float = 3.0
) -> DataFrame:
    """Keep the rows inside the limits of every column; a null value fails its limit."""
    columns = list(columns or numeric_columns(df))
    keep = F.lit(True)
    if method == "zscore":
        stats = column_stats(df, columns, mean=F.avg, sd=F.stddev_samp)
        for c, s in stats.items():
            z = F.abs((F.col(c) - F.lit(s["mean"])) / (F.lit(s["sd"]) + F.lit(1e-10)))
            keep = keep & (z <= threshold)
    elif method == "iqr":
        for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75]).items():
            if q1 is None:
                return df.where(F.lit(False))
            reach = threshold * (q3 - q1)
            keep = keep & F.col(c).between(F.lit(q1 - reach), F.lit(q3 + reach))
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.where(keep)


def drop_duplicates(
    df: DataFrame, subset: Sequence[str] | None, order: Sequence[str], keep: str | bool = "first"
) -> DataFrame:
    """One row per distinct subset: the first or last in ``order``, or only the unrepeated ones.

    Aggregates on the map side, so many copies of one row do not meet in one task.
    """
    subset = list(subset or df.columns)
    row, at = F.struct(*[F.col(c) for c in df.columns]), F.struct(*order)
    pick = F.max_by(row, at) if keep == "last" else F.min_by(row, at)
    one = df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(subset)]).agg(
        pick.alias("_row"), F.count(F.lit(1)).alias("_n")
    )
    if keep in (False, "none"):
        one = one.where("_n = 1")
    return one.select("_row.*")


def one_hot(df: DataFrame, columns: Sequence[str], max_categories: int = 1000) -> DataFrame:
    """0/1 column per category except the first in sort order; a null row is all zero.

    The categories become columns, so more than ``max_categories`` is an error.
    """
    out, seen = [c for c in df.columns if c not in columns], {}
    for c in columns:
        rows = df.where(F.col(c).isNotNull()).select(c).distinct().limit(max_categories + 1).collect()
        if len(rows) > max_categories:
            raise ValueError(f"{c} has more than {max_categories} categories")
        seen[c] = sorted(r[0] for r in rows)
    dummies = [
        F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c in columns
        for v in seen[c][1:]
    ]
    return df.select(*out, *dummies)


def category_ranks(df: DataFrame, column: str) -> DataFrame:
    """``column``, ``_rank``: the distinct values, numbered from 0 in sort order, however many there are.

    The values are dealt to ranges; a range numbers its own and adds the sizes of the ranges before it.
    """
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    dealt = materialized(values.repartitionByRange(column).select(column, F.spark_partition_id().alias("_part")))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return dealt.withColumn("_inside", inside).join(F.broadcast(starts), "_part").select(
        column, (F.col("_start") + F.col("_inside")).alias("_rank")
    )


def one_hot_sparse(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """:func:`one_hot` for any number of categories: adds ``<out>_index`` and the sparse vector ``<out>``.

    The vector has a place for every category but the first in sort order; a null, or the first category, has no
    place: its index is null and its vector is all zero. No list of categories is held anywhere.
    """
    name = out or f"{column}_hot"
    ranks = materialized(category_ranks(df, column))
    size = ranks.count()
    index = F.when(F.col("_rank") > 0, F.col("_rank") - 1)
    placed = df.join(ranks, column, "left").select(*df.columns, index.alias(f"{name}_index"))
    # the encoder's last place is the one that has no column
    last = max(size - 1, 1)
    numbered = placed.withColumn("_place", F.coalesce(f"{name}_index", F.lit(last)).cast("double"))
    encoder = OneHotEncoder(inputCol="_place", outputCol=name, dropLast=True)
    model = encoder.fit(df.sparkSession.range(1).select(F.lit(float(last)).alias("_place")))
    return model.transform(numbered).drop("_place")


def label_encode(df: DataFrame, column: str, order: str, out: str | None = None) -> DataFrame:
    """Codes 0, 1, ... by first appearance in the numeric column ``order``; null is -1."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_at"))
    # the categories count as one key, cut into cells along their first appearance
    split, cells = split_cells(firsts.withColumn("_one", F.lit(0)), ["_one"], ["_at"], HOT_ROWS)
    codes = ranked(split, ["_one"], cells, ["_at", column], "_code").select(column, (F.col("_code") - 1).alias("_code"))
    name = out or column
    rest = [c for c in df.columns if c != name]
    return df.join(codes, column, "left").select(*rest, F.coalesce("_code", F.lit(-1)).alias(name))


class FittedScaler:
    """Offsets and widths learned by :func:`scale`; ``transform`` applies them elsewhere."""

    def __init__(self, method: str, offsets: dict[str, float], widths: dict[str, float]):
        self.method, self.offsets, self.widths = method, offsets, widths

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(self.offsets[c])) / F.lit(self.widths[c]) for c in self.offsets
        })


def scale(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "standard"
) -> tuple[DataFrame, FittedScaler]:
    """Standard (population sd), robust (median and IQR) or min-max scaling; a constant divides by 1."""
    columns = list(columns or numeric_columns(df))
    if method == "robust":
        q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        offsets = {c: v[1] for c, v in q.items()}
        widths = {c: v[2] - v[0] for c, v in q.items()}
    elif method == "standard":
        s = column_stats(df, columns, mean=F.avg, sd=F.stddev_pop)
        offsets, widths = {c: s[c]["mean"] for c in columns}, {c: s[c]["sd"] for c in columns}
    else:
        s = column_stats(df, columns, lo=F.min, hi=F.max)
        offsets = {c: s[c]["lo"] for c in columns}
        widths = {c: s[c]["hi"] - s[c]["lo"] for c in columns}
    scaler = FittedScaler(method, offsets, {c: float(w) or 1.0 for c, w in widths.items()})
    return scaler.transform(df), scaler


# "first" and "last" follow the order given to aggregate_by_asset.
AGGREGATES = {
    "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count,
    "nunique": F.countDistinct,
}


def aggregate_by_asset(
    df: DataFrame, spec: dict[str, str | Sequence[str]], order: Sequence[str] = ("ts", "event_id"),
    key: str = "asset_id",
) -> DataFrame:
    """One row per asset, columns ``<column>_<function>``.

    All functions but the median combine on the map side. The median comes from
    value counts and is joined on the (one row per asset) result.
    """
    pairs = [(c, f) for c, fs in spec.items() for f in ([fs] if isinstance(fs, str) else fs)]
    at = F.struct(*order)

    def column(c: str, f: str) -> Column:
        known = F.when(F.col(c).isNotNull(), at)
        if f in ("first", "last"):
            return (F.min_by if f == "first" else F.max_by)(c, known).alias(f"{c}_{f}")
        return AGGREGATES[f](c).alias(f"{c}_{f}")

    plain = [column(c, f) for c, f in pairs if f != "median"]
    out = df.groupBy(key).agg(*plain) if plain else df.select(key).distinct()
    for c, f in pairs:
        if f == "median":
            out = out.join(grouped_median(df, [key], c, f"{c}_median"), key, "left")
    return out.select(key, *[f"{c}_{f}" for c, f in pairs])


def failures_per_asset(df: DataFrame, top: int = 10, key: str = "asset_id") -> DataFrame:
    """The assets with most failures (ties by asset)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("failures"))
    return counts.orderBy(F.desc("failures"), key).limit(top)


def distinct_assets(df: DataFrame, key: str = "asset_id") -> DataFrame:
    return df.agg(F.countDistinct(key).alias("assets"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins over the positive values; the maximum falls in the last bin."""
    positive = df.where(F.col(column) > 0)
    span = positive.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = float(span["lo"] or 0), float(span["hi"] or 0)
    width = (hi - lo) / bins or 1.0
    number = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (
        positive.groupBy(number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_from"), "n")
    )
