"""Synthetic minority rows between near neighbours (SMOTE)."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.storage import materialized
from .ordered import blocks_around, ranked, split_cells

NEIGHBOURS, BLOCK = 5, 100_000
#: Pivots of the neighbour search at most, and places of one cell of a ring.
PIVOTS, RING = 128, 1000


def _distance(a: Column, b: Column, length: int | None = None) -> Column:
    """Sum of squared gaps. With the length of all vectors it is plain arithmetic, which Spark compiles; the sum is the same."""
    if length:
        gaps = [F.get(a, F.lit(i)) - F.get(b, F.lit(i)) for i in range(length)]
        return functools.reduce(lambda acc, gap: acc + gap * gap, gaps, F.lit(0.0))
    gaps = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v)


def _along(rows: DataFrame, keys: list[str], by: str, k: int) -> DataFrame:
    """``rows`` (with a vector ``_x``) plus ``_met``: the vectors of the k rows before and after along ``by``, and ``_at``: the rank."""
    split, cells = split_cells(rows, keys, [by], BLOCK)
    at = ranked(split, keys, cells, [by, "_x"], "_at")
    home, every = blocks_around(F.col("_at"), BLOCK, k, k)
    around = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(-k, k)
    out = at.withColumn("_home", home).withColumn("_block", F.explode(every)).withColumn("_met", F.collect_list("_x").over(around))
    return out.where("_block = _home").select(*rows.columns, "_at", "_met")


def near_neighbours(points: DataFrame, k: int = NEIGHBOURS, pivots: int = PIVOTS) -> DataFrame:
    """``_key, _x`` -> the same plus ``near``: the k closest other rows (``d``, ``key``, ``x``), ties to the smaller key. Exact.

    Rows of one place are first reduced to their k + 1 smallest keys; they are each other's closest rows, so a place only looks
    for what it lacks of k. The places are dealt to the nearest of a few pivots and
    ordered by their distance to it. The k places on either side in that order give an upper bound of the k-th distance. By the
    triangle inequality a closer place of another pivot lies in a ring around that pivot no wider than the bound on either
    side; rings are cut into cells of equal size, and only the cells that the ring touches are visited.
    """
    order = Window.partitionBy("_x").orderBy("_key")
    few = points.select("_key", "_x", F.row_number().over(order).alias("_n")).where(F.col("_n") <= k + 1)
    grouped = few.groupBy("_x").agg(F.sort_array(F.collect_list("_key")).alias("_keys"), F.count(F.lit(1)).alias("_rows"))
    # a row without a key, or with a key that comes twice, finds fewer others in its place than the place has rows
    lacks = F.when(F.size(F.array_distinct("_keys")) == F.col("_rows"), F.lit(k + 1) - F.col("_rows")).otherwise(k)
    places = materialized(grouped.select("_x", "_keys", lacks.cast("int").alias("_lacks"), F.monotonically_increasing_id().alias("_id")))
    found = places.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("_x")).alias("least"), F.max(F.size("_x")).alias("most")).first()
    total, length = found["n"], found["most"] if found["least"] == found["most"] else None
    wanted = max(1, min(pivots, total // (10 * k)))
    chosen = [r["_x"] for r in places.select("_x").orderBy(F.xxhash64("_x"), "_x").limit(wanted).collect()]
    if not chosen:
        near = f"array<struct<d:double,key:{points.schema['_key'].dataType.simpleString()},x:array<double>>>"
        return points.select("_key", "_x", F.array().cast(near).alias("near"))
    # one row with all pivots, and one row each: as literals they would stand in every plan of every step that measures distances
    spark, pivot_rows = points.sparkSession, [(i, list(x)) for i, x in enumerate(chosen)]
    all_pivots = F.broadcast(spark.createDataFrame([(pivot_rows,)], "_pivots array<struct<p:int,x:array<double>>>"))
    each_pivot = F.broadcast(spark.createDataFrame(pivot_rows, "_to_p int, _to_x array<double>"))
    to_pivots = F.transform("_pivots", lambda c: F.struct(F.sqrt(_distance(F.col("_x"), c["x"], length)).alias("r"), c["p"].alias("p")))
    # Distances cost time, not bytes: the few bytes of places and questions would be left to a few tasks.
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(most, -(-total // RING)))
    dealt = places.repartition(tasks).crossJoin(all_pivots).withColumn("_near", F.array_min(to_pivots)).select("_x", "_keys", "_lacks", "_id", F.col("_near.p").alias("_p"), F.col("_near.r").alias("_r"))
    met = _along(dealt, ["_p"], "_r", k)
    others = F.filter("_met", lambda x: x != F.col("_x"))
    sized = F.array_sort(F.transform(others, lambda x: F.sqrt(_distance(x, F.col("_x"), length))))
    bound = F.coalesce(F.get(sized, F.col("_lacks") - 1), F.lit(math.inf)) * (1 + 1e-9) + 1e-12
    rows = materialized(met.select(
        "_x", "_keys", "_lacks", "_id", "_p", "_r", F.floor((F.col("_at") - 1) / F.lit(RING)).cast("long").alias("_cell"), bound.alias("_bound")
    ))
    # one row per RING places
    cells = rows.groupBy("_p", "_cell").agg(F.min("_r").alias("_low"), F.max("_r").alias("_high"))
    asked = rows.where("_lacks > 0").repartition(tasks).crossJoin(each_pivot).select(
        F.col("_id").alias("_from"), F.col("_x").alias("_from_x"), "_bound", F.col("_to_p").alias("_p"), F.sqrt(_distance(F.col("_x"), F.col("_to_x"), length)).alias("_to")
    )
    # The estimate of the questions misses that each meets all pivots; they must not be taken for a small side
    # and gathered by the driver. Cells are few, and the places meet them by a shuffle.
    touched = asked.join(F.broadcast(cells), "_p").where(
        (F.col("_low") <= F.col("_to") + F.col("_bound")) & (F.col("_high") >= F.col("_to") - F.col("_bound"))
    ).select("_from", "_from_x", "_bound", "_to", "_p", "_cell").repartition(tasks, "_p", "_cell")
    pairs = touched.join(rows.select("_x", "_keys", "_id", "_p", "_r", "_cell").hint("merge"), ["_p", "_cell"]).where(
        (F.abs(F.col("_r") - F.col("_to")) <= F.col("_bound")) & (F.col("_id") != F.col("_from"))
    ).withColumn("_d", F.sqrt(_distance(F.col("_x"), F.col("_from_x"), length))).where(F.col("_d") <= F.col("_bound"))
    each = pairs.select("_from", "_d", "_x", F.explode(F.slice("_keys", 1, k)).alias("_other"))
    closest = Window.partitionBy("_from").orderBy("_d", "_other")
    kept = each.select("*", F.row_number().over(closest).alias("_n")).where(F.col("_n") <= k)
    entry = F.struct(F.col("_d").alias("d"), F.col("_other").alias("key"), F.col("_x").alias("x"))
    lists = kept.groupBy(F.col("_from").alias("_id")).agg(F.collect_list(entry).alias("_others"))
    joined = points.join(places, "_x").join(lists, "_id", "left")
    same = F.transform(F.filter("_keys", lambda o: o != F.col("_key")), lambda o: F.struct(
        F.lit(0.0).alias("d"), o.alias("key"), F.col("_x").alias("x")
    ))
    every = F.concat(same, F.coalesce("_others", F.filter(same, lambda o: F.lit(False))))
    return joined.select("_key", "_x", F.slice(F.array_sort(every), 1, k).alias("near"))


def smote(
    df: DataFrame, features: Sequence[str], y: str, key: str, k: int = NEIGHBOURS, seed: int = 42
) -> DataFrame:
    """Rows of a binary table plus synthetic minority rows until both classes are equal.

    A synthetic row lies at a random place between a minority row and one of its near
    neighbours; which one and where come from hashes, so the result repeats.
    Returns ``key, features, y, synthetic``; synthetic rows have a null key.
    """
    values = [F.col(c).cast("double").alias(c) for c in features]
    # read for the counts, the result and twice for the neighbours
    df = materialized(df.select(key, *values, y))
    counts = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    real = df.select("*", F.lit(False).alias("synthetic"))
    if len(counts) != 2 or len(set(counts.values())) == 1:
        return real
    small = min(counts, key=counts.get)
    missing, n_small = sum(counts.values()) - 2 * counts[small], counts[small]
    points = df.where(F.col(y) == F.lit(small)).select(F.col(key).alias("_key"), F.array(*features).alias("_x"))
    near = materialized(near_neighbours(points, k))
    cell = F.shiftright(F.xxhash64(F.lit(seed), F.col("_key")), 48)
    turn = ranked(near.withColumns({"_one": F.lit(0), "_cell": cell}), ["_one"], ["_cell"], ["_cell", "_key"], "_turn")
    copies = F.lit(missing // n_small) + (F.col("_turn") <= missing % n_small).cast("int")
    made = turn.where((copies > 0) & (F.size("near") > 0)).select(
        "_key", "_x", "near", F.explode(F.sequence(F.lit(1), copies)).alias("_i")
    )
    pick = F.pmod(F.xxhash64(F.lit(seed + 1), "_key", "_i"), F.size("near").cast("long")).cast("int")
    gap = F.pmod(F.xxhash64(F.lit(seed + 2), "_key", "_i"), F.lit(1_000_003).cast("long")) / F.lit(1_000_003.0)
    made = made.withColumns({"_z": F.get("near", pick)["x"], "_u": gap})
    new = [
        (F.col("_x")[i] + F.col("_u") * (F.col("_z")[i] - F.col("_x")[i])).alias(c) for i, c in enumerate(features)
    ]
    kind = real.schema[key].dataType
    return real.unionByName(made.select(
        F.lit(None).cast(kind).alias(key), *new, F.lit(small).cast(real.schema[y].dataType).alias(y),
        F.lit(True).alias("synthetic"),
    ))
