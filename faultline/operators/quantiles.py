"""Exact quantiles without gathering the values of a column in one place."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import HOT_ROWS, hot_keys, same_keys_join

BUCKETS = 4096
INFINITE = math.inf


def share_between(x: Column, lo: Column, hi: Column) -> Column:
    """Place of a finite ``x`` in [lo, hi] as a share of its width, also where the width is no finite double."""
    halves = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.when(hi - lo == INFINITE, halves).otherwise((x - lo) / (hi - lo))


def _between(x0: float, x1: float, share: float) -> float:
    if x0 == x1 or share == 0:
        return x0
    if math.isinf(x1 - x0):
        return x0 * (1 - share) + x1 * share
    return x0 + (x1 - x0) * share


def _find(counts: list[tuple], ranks: Sequence[int]) -> dict[int, tuple[tuple, int]]:
    """For each rank: the entry (ordered by its first field) that holds it, and the rank inside."""
    out, upto, wanted = {}, 0, sorted(ranks)
    for entry in sorted(counts):
        start, upto = upto, upto + entry[1]
        while wanted and wanted[0] <= upto:
            rank = wanted.pop(0)
            out[rank] = (entry, rank - start)
    return out


def quantiles_of(long: DataFrame, probs: Sequence[float]) -> dict[str, list[float]]:
    """Linear-interpolation quantiles of ``x`` per ``name`` (eager, like ``approxQuantile``).

    Radix descent: the ranks wanted are looked up in counts per bucket over the full
    range, then per bucket inside the bucket that holds each rank, and so on until the
    bucket holds one value. Every pass counts before it shuffles; the driver sees at most
    ``BUCKETS`` counts per open bucket, and no step sorts the values. Infinite values are
    the outermost ranks and are counted, not descended into.
    """
    spark = long.sparkSession
    long = long.where(F.col("x").isNotNull() & ~F.isnan("x"))
    span = {
        r["name"]: r
        for r in long.groupBy("name").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("x") == -INFINITE, 1)).alias("below"),
            F.count(F.when(F.col("x") == INFINITE, 1)).alias("above"),
            *[f(F.when(F.abs("x") < INFINITE, F.col("x"))).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))],
        ).collect()
    }
    open_: dict[tuple, list[tuple[int, int]]] = {}  # (name, lo, hi) -> [(rank, rank inside)]
    value: dict[tuple[str, int], float] = {}
    for name, r in span.items():
        ranks = {f(p * (r["n"] - 1)) + 1 for p in probs for f in (math.floor, math.ceil)}
        value.update({(name, k): -math.inf for k in ranks if k <= r["below"]})
        value.update({(name, k): math.inf for k in ranks if k > r["n"] - r["above"]})
        finite = [(k, k - r["below"]) for k in ranks if (name, k) not in value]
        if finite:
            open_[(name, r["lo"], r["hi"])] = finite
    while open_:
        todo, open_ = open_, {}
        buckets = max(64, BUCKETS // len(todo))
        # one row per name and wanted rank
        parts = F.broadcast(spark.createDataFrame(
            [(i, *part) for i, part in enumerate(todo)], "part int, name string, lo double, hi double"
        ))
        # monotone in x, so bucket order is value order
        share = F.when(F.col("hi") > F.col("lo"), share_between(F.col("x"), F.col("lo"), F.col("hi"))).otherwise(0.0)
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
        inside = long.join(parts, "name").where(F.col("x").between(F.col("lo"), F.col("hi")))
        rows = inside.groupBy("part", bucket.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
        ).collect()
        by_part: dict[int, list[tuple]] = {}
        for r in rows:
            by_part.setdefault(r["part"], []).append((r["b"], r["n"], r["lo"], r["hi"]))
        for i, ((name, _, _), ranks) in enumerate(todo.items()):
            found = _find(by_part[i], [rest for _, rest in ranks])
            for rank, within in ranks:
                (_, _, lo, hi), rest = found[within]
                if lo == hi:
                    value[(name, rank)] = lo
                else:
                    open_.setdefault((name, lo, hi), []).append((rank, rest))
    out = {}
    for name, r in span.items():
        picks = []
        for p in probs:
            at = p * (r["n"] - 1)
            x0, x1 = value[(name, math.floor(at) + 1)], value[(name, math.ceil(at) + 1)]
            picks.append(_between(x0, x1, at - math.floor(at)))
        out[name] = picks
    return out


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """:func:`quantiles_of` whole numeric columns; a column without values gives None."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns
    ])).alias("p")).select("p.name", "p.x")
    found = quantiles_of(long, probs)
    return {c: found.get(c, [None] * len(probs)) for c in columns}


def grouped_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "median", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact median per key from value counts, so repeated values shrink before the shuffle.

    A key with more than ``hot_rows`` different values takes :func:`quantiles_of` instead,
    which does not bring them together.
    """
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(counts, keys, hot_rows)
    if hot is not None:
        counts = same_keys_join(counts, hot, keys, "left_anti").select(*keys, value, "_n")
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.select("*", F.sum("_n").over(w).alias("_upto"), F.sum("_n").over(whole).alias("_all"))
    low = F.floor((F.col("_all") - 1) / 2) + 1
    high = F.floor(F.col("_all") / 2) + 1
    start = F.col("_upto") - F.col("_n")
    medians = (
        cum.groupBy(*keys)
        .agg(
            F.max(F.when((low > start) & (low <= F.col("_upto")), F.col(value))).alias("_lo"),
            F.max(F.when((high > start) & (high <= F.col("_upto")), F.col(value))).alias("_hi"),
        )
        .select(*keys, ((F.col("_lo") + F.col("_hi")) / 2.0).alias(out))
    )
    if hot is None:
        return medians
    name = F.to_json(F.struct(*keys)).alias("name")
    found = quantiles_of(same_keys_join(known, hot, keys, "left_semi").select(name, F.col(value).cast("double").alias("x")), [0.5])
    few = df.sparkSession.createDataFrame([(k, v[0]) for k, v in found.items()], f"name string, `{out}` double")
    busy = hot.select(*keys, name).join(few, "name").select(*keys, out)
    return medians.unionByName(busy)
