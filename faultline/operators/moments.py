"""Mergeable centred moments: count, mean, sum of squared deviations, smallest and largest value.

Two disjoint groups of values are merged from their moments alone, with errors relative to the spread of the values,
whatever their size. Moments cannot be taken apart again, so ranges are put together from parts that lie inside them.
Smallest and largest value tell constant groups, whose spread is exactly 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

FIELDS = ("n", "mean", "m2", "lo", "hi")


def moments(x: Column, frame: WindowSpec | None = None) -> Column:
    """Moments of the values that are not null, as an aggregate or over a window frame."""
    over = (lambda c: c) if frame is None else (lambda c: c.over(frame))
    n = over(F.count(x))
    return F.struct(
        n.alias("n"), F.coalesce(over(F.avg(x)), F.lit(0.0)).alias("mean"),
        F.coalesce(over(F.var_pop(x)) * n, F.lit(0.0)).alias("m2"), over(F.min(x)).alias("lo"), over(F.max(x)).alias("hi"),
    )


def none() -> Column:
    """Moments of no value."""
    nothing = F.lit(None).cast("double")
    return F.struct(
        F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), nothing.alias("lo"), nothing.alias("hi")
    )


def merged(a: Column, b: Column) -> Column:
    """Moments of both groups together."""
    n = a["n"] + b["n"]
    apart, share = b["mean"] - a["mean"], F.try_divide(b["n"].cast("double"), n.cast("double"))
    both = F.struct(
        n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * share * a["n"]).alias("m2"),
        F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"),
    )
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def mean(m: Column) -> Column:
    return F.when(m["n"] > 0, F.when(m["lo"] == m["hi"], m["lo"]).otherwise(m["mean"]))


def spread(m: Column) -> Column:
    """Sample standard deviation; null below two values."""
    return F.when(m["n"] > 1, F.when(m["lo"] == m["hi"], 0.0).otherwise(F.sqrt(m["m2"] / (m["n"] - 1))))


def merged_before(
    parts: DataFrame, keys: Sequence[str], order: Sequence[str], states: Sequence[str], backwards: bool = False
) -> DataFrame:
    """For each row of ``parts`` the moments of all rows of its key that come before it (after it, if ``backwards``).

    A key's rows are merged in one pass over an array, so ``parts`` is a compacted table of few rows per key.
    """
    row = F.struct(*order, *states)
    rows = F.sort_array(F.collect_list(row), asc=not backwards)
    zero = F.struct(*[none().alias(s) for s in states])

    def step(acc: Column, e: Column) -> Column:
        so_far = acc["so_far"]
        done = F.struct(*[e[c].alias(c) for c in order], *[so_far[s].alias(f"{s}_before") for s in states])
        return F.struct(
            F.struct(*[merged(so_far[s], e[s]).alias(s) for s in states]).alias("so_far"),
            F.concat(acc["done"], F.array(done)).alias("done"),
        )

    kind = ", ".join(
        [*(f"`{c}`: {parts.schema[c].dataType.simpleString()}" for c in order),
         *(f"`{s}_before`: struct<n: bigint, mean: double, m2: double, lo: double, hi: double>" for s in states)]
    )
    start = F.struct(zero.alias("so_far"), F.array().cast(f"array<struct<{kind}>>").alias("done"))
    merged_rows = F.aggregate("_rows", start, step)["done"]
    return parts.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.inline(merged_rows))
