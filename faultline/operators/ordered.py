"""Ordered computations per key that stay balanced when one key is huge.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. The helpers
below keep that plan for ordinary keys and cut the *hot* ones (more than ``hot_rows``
rows) into cells along their order (:func:`split_cells`). On top of the cells:

* :func:`ordered_blocks` - equal-sized blocks by rank, each with the few neighbouring
  rows that ``lag``/``lead``/``rowsBetween`` frames look at;
* :func:`state_before` - running totals by position: totals inside a cell plus a carry
  from the compacted table of earlier cells.

Hot groups are found first by a count per key over the key and order columns alone, so
the common case (none) plans as one shuffle and one sort. A table of N rows has at most
N / hot_rows hot groups. Up to LISTED of them are listed and broadcast; more stay a table that
meets the rows by a shuffle, so the driver's memory does not depend on their number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.days import micros
from ..sources.storage import materialized

HOT_ROWS = 2_000_000
#: Buckets of one cut at most, and at least in the first cut.
BUCKETS, LEAST_BUCKETS = 4096, 16
#: Groups of one round of cutting that the driver lists at most; more of them stay a table.
LISTED = 10_000
UNBOUNDED = Window.unboundedPreceding


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows as a local table, or None if there are none."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = counted.where(F.col("_n") > hot_rows).drop("_n")
    rows = found.collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, found.schema)) if rows else None


def _numbers(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """The leading order columns that can be cut by value."""
    out = []
    for name in order:
        kind = df.schema[name].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            out.append(micros(name))
        elif isinstance(kind, T.NumericType):
            out.append(F.col(name))
        else:
            break
    return out


def same_keys_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys of the left side stay."""
    other = right.select(*[F.col(c).alias(f"_same_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(other, same, how).drop(*[f"_same_{k}" for k in keys])


def _kind(n: Column) -> Column:
    """Null, -infinity, finite, infinity and NaN, numbered as they sort."""
    d = n.cast("double")
    return (
        F.when(n.isNull(), 0).when(F.isnan(d), 4).when(d == math.inf, 3).when(d == -math.inf, 1).otherwise(2)
    )


def split_cells(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int
) -> tuple[DataFrame, list[str]]:
    """Cut hot keys into cells of at most ``hot_rows`` rows; ``(df, cell columns)``.

    Each round takes the groups that are still too large and cuts each into equal-width
    buckets of the first order column that varies inside it, so the cell columns sort like
    the order. The first round makes a few times as many buckets as the rows of the group need, so evenly
    spread rows do not end in cells of a handful; what is too large after that is cut as finely as allowed. Without a hot key the table comes back unchanged and the list is empty, else
    it also has ``_hot`` and ``_start``, the first order value of a hot key. Only rows that
    agree in every numeric order column stay together. A null key is a key like others; null,
    infinite and NaN order values get cells of their own, so every round divides its groups.
    """
    numbers, cells, many = _numbers(df, order), [], False
    while numbers:
        part = [*keys, *cells]
        spans = [
            f(v).alias(f"{c}{i}") for i, n in enumerate(numbers) for v, low, high in (
                (F.when(_kind(n) == 2, n), "_lo", "_hi"), (_kind(n), "_first", "_last"),
            ) for f, c in ((F.min, low), (F.max, high))
        ]
        divides = [
            (F.col(f"_first{i}") < F.col(f"_last{i}")) | F.coalesce(F.col(f"_lo{i}") < F.col(f"_hi{i}"), F.lit(False))
            for i in range(len(numbers))
        ]
        varies = F.lit(False)
        for d in divides:
            varies = varies | d
        counted = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), *spans)
        needed = F.least(F.lit(BUCKETS), F.greatest(F.lit(LEAST_BUCKETS), 4 * F.ceil(F.col("_n") / hot_rows)))
        wanted = (F.lit(BUCKETS) if cells else needed).cast("long").alias("_buckets")
        big = counted.where((F.col("_n") > hot_rows) & varies).select("*", wanted).drop("_n")
        if many:
            big = materialized(big)
        rows = big.limit(LISTED + 1).collect()
        if not rows:
            break
        if len(rows) <= LISTED:
            table = F.broadcast(df.sparkSession.createDataFrame(rows, big.schema))
        else:
            table, many = (big if many else materialized(big)).hint("merge"), True
        bucket = F.when(F.lit(False), F.lit(0).cast("long"))
        for i, n in enumerate(numbers):
            lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
            width = (hi - lo).cast("double")
            share = F.when(width == math.inf, (n / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise(
                (n - lo).cast("double") / width
            )
            place = F.least(F.floor(share * F.col("_buckets")), F.col("_buckets") - 1).cast("long")
            ends = F.when(_kind(n) == 2, F.when(lo < hi, place).otherwise(0)).when(
                _kind(n) < 2, _kind(n) - 2
            ).otherwise(_kind(n) + BUCKETS - 3)
            bucket = bucket.when(divides[i], ends.cast("long"))
        name = f"_c{len(cells)}"
        added = [F.coalesce(bucket, F.lit(0).cast("long")).alias(name)]
        if not cells:
            added += [F.col("_first0").isNotNull().alias("_hot"), F.col("_lo0").alias("_start")]
        df = same_keys_join(df, table, part, "left").select(*df.columns, *added)
        cells.append(name)
    return df, cells


def ranked(
    df: DataFrame, keys: Sequence[str], cells: Sequence[str], order: Sequence[Column | str], out: str
) -> DataFrame:
    """1-based rank per key: position inside (key, cells) plus the rows of earlier cells.

    The cell columns must sort like the order. No task sorts more than one cell of a key.
    """
    part = [*keys, *cells]
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy(*cells).rowsBetween(UNBOUNDED, -1)
    offsets = sizes.select(*part, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*part).orderBy(*order)
    placed = df.select("*", F.row_number().over(inside).alias("_pos"))
    return same_keys_join(placed, offsets, part).select(*df.columns, (F.col("_offset") + F.col("_pos")).alias(out))


def blocks_around(rank: Column, size: int, before: int, after: int) -> tuple[Column, Column]:
    """Own block of a rank, and all blocks that need the row (own and neighbours)."""
    home = F.floor((rank - 1) / F.lit(size)).cast("long")
    place = (rank - 1) % F.lit(size)
    return home, F.array_compact(F.array(
        home,
        F.when(place >= size - before, home + 1),
        F.when((place < after) & (home > 0), home - 1),
    ))


def ordered_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int = 0, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, bool]:
    """Add ``_hot, _block, _core, _rank, _start``; see :func:`block_window`.

    Rows of ordinary keys get block 0. A hot key is ranked and cut every ``hot_rows`` rows;
    the last ``before`` rows of a block are repeated at the head of the next one and the
    first ``after`` rows at the tail of the previous one, with ``_core`` false, to be dropped
    after the windows are computed. The second value tells whether there is a hot key.
    """
    if before >= hot_rows or after >= hot_rows:
        raise ValueError("hot_rows must exceed the frame length")
    split, cells = split_cells(df, keys, order, hot_rows)
    plain = (split.where(~F.col("_hot")) if cells else df).select(
        *df.columns,
        F.lit(False).alias("_hot"),
        F.lit(0).cast("long").alias("_block"),
        F.lit(True).alias("_core"),
        F.lit(None).cast("long").alias("_rank"),
        F.lit(None).cast("long").alias("_start"),
    )
    if not cells:
        return plain, False
    cut = ranked(split.where("_hot"), keys, cells, order, "_rank")
    home, every = blocks_around(F.col("_rank"), hot_rows, before, after)
    cut = cut.select(*df.columns, "_hot", F.explode(every).alias("_block"), "_rank", F.col("_start").cast("long"))
    return plain.unionByName(cut.withColumn("_core", F.col("_block") == home)), True


def block_window(keys: Sequence[str]):
    """Partition spec for rows that went through :func:`ordered_blocks`."""
    return Window.partitionBy(*keys, "_hot", "_block")


def core_rows(df: DataFrame) -> DataFrame:
    """Drop the repeated neighbour rows and the helper columns."""
    return df.where("_core").drop("_hot", "_block", "_core", "_rank", "_start")


def state_before(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    sums: Sequence[str],
    last: str | None = None,
    first: str | None = None,
    least: str | None = None,
    hot_rows: int = HOT_ROWS,
    inclusive: bool = False,
) -> DataFrame:
    """Running state of each key at every row, by the number ``pos``.

    Adds ``<sum>_before`` for each column of ``sums`` over rows with a smaller ``pos`` (or
    equal, if ``inclusive``; otherwise ``pos`` is an integer), ``<last>_before`` = largest
    value of the struct ``last`` over the same rows, ``<least>_before`` = smallest value of
    ``least`` over them, and ``<first>_from`` = smallest value of the struct ``first`` over
    rows at or after ``pos``. Null measures are ignored, so a row that only asks (a probe)
    carries nulls. Callers reduce their rows to one per key and position first.
    """
    columns = df.columns
    if not keys:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    cut, cells = split_cells(df, keys, [pos], hot_rows)
    part = [*keys, *cells]
    ahead = Window.partitionBy(*part).orderBy(pos).rangeBetween(UNBOUNDED, 0 if inclusive else -1)
    back = Window.partitionBy(*part).orderBy(F.col(pos).desc()).rangeBetween(UNBOUNDED, 0)
    inside = [F.sum(name).over(ahead).alias(f"_i_{name}") for name in sums]
    inside += [F.max(last).over(ahead).alias("_i_last")] if last else []
    inside += [F.min(least).over(ahead).alias("_i_least")] if least else []
    inside += [F.min(first).over(back).alias("_i_first")] if first else []
    out = cut.select("*", *inside)

    if cells:
        aggs = [F.sum(name).alias(name) for name in sums]
        aggs += [F.max(last).alias("_last")] if last else []
        aggs += [F.min(least).alias("_least")] if least else []
        aggs += [F.min(first).alias("_first")] if first else []
        compact = cut.where("_hot").groupBy(*part).agg(*aggs)
        earlier = Window.partitionBy(*keys).orderBy(*cells).rowsBetween(UNBOUNDED, -1)
        later = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in cells]).rowsBetween(UNBOUNDED, -1)
        carry = [F.sum(name).over(earlier).alias(f"_c_{name}") for name in sums]
        carry += [F.max("_last").over(earlier).alias("_c_last")] if last else []
        carry += [F.min("_least").over(earlier).alias("_c_least")] if least else []
        carry += [F.min("_first").over(later).alias("_c_first")] if first else []
        out = out.join(compact.select(*part, *carry), part, "left")

    def total(name: str) -> Column:
        value = F.coalesce(F.col(f"_i_{name}"), F.lit(0))
        if cells:
            value = value + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        return value.cast(running_type(df.schema[name].dataType)).alias(f"{name}_before")

    def pick(kind: str, fn=F.coalesce) -> Column:
        return fn(f"_i_{kind}", f"_c_{kind}") if cells else F.col(f"_i_{kind}")

    tail = [total(name) for name in sums]
    tail += [pick("last").alias(f"{last}_before")] if last else []
    tail += [pick("least", F.least).alias(f"{least}_before")] if least else []
    tail += [pick("first", F.least).alias(f"{first}_from")] if first else []
    return out.select(*columns, *tail)


def running_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(38, kind.scale)
    return T.DoubleType() if isinstance(kind, (T.DoubleType, T.FloatType)) else T.LongType()
