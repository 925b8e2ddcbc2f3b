"""Prediction history against observed outcomes: matching, rolling quality, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.days import DAY_US, micros
from ..functions.risk import is_flagged
from ..sources.storage import materialized
from .metrics import classification_metrics, ratio
from .ordered import HOT_ROWS, state_before

# Windows and limits of the drift check and of the rolling metrics.
ROLLING_DAYS, ROLLING_MIN = 30, 5
BASELINE_DAYS, CURRENT_DAYS, MAX_DROP = 90, 30, 0.05
DRIFT_MIN_ROWS, DRIFT_MIN_WINDOW = 20, 5


def match_outcomes(
    predictions: DataFrame, outcomes: DataFrame, with_seq: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Predictions with ``outcome, occurred_at`` of the first registered matching outcome.

    An outcome matches if it is of the same asset and ``0 <= floor_days(event - prediction)
    <= horizon``; without a match both are null. ``predictions`` needs ``prediction_id,
    asset_id, predicted_at, horizon``; ``outcomes`` needs ``asset_id, occurred_at, failed,
    registered_seq``.

    The range [prediction, prediction + horizon + 1 days) is cut at day borders: the rest of
    its first day and the start of its last day are read from running minima inside that
    day (cut further where one asset has very many in a day), the days between
    from one minimum per asset and day, over a frame of at most ``horizon`` days. No prediction is paired with single outcomes, so a
    busy asset costs no more per row than a quiet one.
    """
    key = ["asset_id", "day"]
    day = F.floor(F.col("pos") / DAY_US).cast("long").alias("day")
    best = F.struct(
        F.col("registered_seq").alias("seq"), F.col("failed").alias("outcome"), F.col("occurred_at").alias("when")
    )
    # one row per asset and instant
    known = outcomes.groupBy("asset_id", micros("occurred_at").alias("pos")).agg(F.min(best).alias("best")).select("*", day)
    kind = known.schema["best"].dataType
    span = ["asset_id", "start", "horizon"]
    asked = predictions.select("asset_id", micros("predicted_at").alias("start"), "horizon").distinct()
    length = (F.col("horizon") + 1) * F.lit(DAY_US)
    ends = F.explode(F.array(
        F.struct(F.lit("from").alias("side"), F.col("start").alias("pos")),
        F.struct(F.lit("until").alias("side"), (F.col("start") + length).alias("pos")),
    )).alias("e")
    probes = asked.select(*span, ends).select(*span, "e.side", "e.pos", F.lit(None).cast(kind).alias("best")).select("*", day)
    points = probes.unionByName(known, allowMissingColumns=True)
    state = state_before(points, key, "pos", [], first="best", least="best", hot_rows=hot_rows)
    edge = F.when(F.col("side") == "from", F.col("best_from")).otherwise(F.col("best_before"))
    per_day = known.groupBy(*key).agg(F.min("best").alias("best"))
    # whole days: at most one row per asset and day on either side of the union
    horizons = [r["horizon"] for r in asked.select("horizon").distinct().collect() if r["horizon"] > 0]
    days = asked.select("asset_id", F.floor(F.col("start") / DAY_US).cast("long").alias("day")).distinct()
    calendar = per_day.select("*", F.lit(False).alias("asks")).unionByName(
        days.select("*", F.lit(None).cast(kind).alias("best"), F.lit(True).alias("asks"))
    )
    by_day = Window.partitionBy("asset_id").orderBy("day")
    ahead = [F.min("best").over(by_day.rangeBetween(1, h)).alias(f"_{h}") for h in horizons]
    whole = calendar.select("asset_id", "day", "asks", *ahead).where("asks").select(
        "asset_id", "day", F.lit("from").alias("side"), *[f"_{h}" for h in horizons]
    )
    between = F.when(F.lit(False), F.lit(None).cast(kind))
    for h in horizons:
        between = between.when(F.col("horizon") == h, F.col(f"_{h}"))
    edges = state.where(F.col("side").isNotNull()).select(*span, "side", "day", edge.alias("best"))
    found = (
        edges.join(whole, ["asset_id", "day", "side"], "left")
        .groupBy(*span)
        .agg(F.min(F.least("best", between)).alias("best"))
        .where(F.col("best").isNotNull())
    )
    return predictions.withColumn("start", micros("predicted_at")).join(found, span, "left").select(
        *predictions.columns,
        F.col("best.outcome").alias("outcome"),
        F.col("best.when").alias("occurred_at"),
        *([F.col("best.seq").alias("registered_seq")] if with_seq else []),
    )


def match_logged_outcomes(
    predictions: DataFrame, outcomes: DataFrame, with_seq: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """:func:`match_outcomes` where an outcome only reaches predictions that were already logged.

    ``predictions`` also needs ``logged_seq``; an outcome matches if its ``registered_seq`` is larger. Of the matches
    the first registered one counts. A prediction with a null ``logged_seq`` matches nothing.

    Both conditions bound the search, one in time and one in the order of the log. The instants at which an asset
    has outcomes are numbered; a level holds the outcomes of blocks of 1, 2, 4, ... neighbouring instants. A prediction's range of
    numbers is put together from at most two blocks per level, and in each it looks up the first outcome registered
    after it, in the order of the log. So a row per outcome and level, and a few per prediction, replace all pairs.
    Levels end at the longest range of the asset, so a log of dates needs no more of them than a range has days; hot
    assets and hot blocks are cut into cells.
    """
    best = F.struct(
        F.col("registered_seq").alias("seq"), F.col("failed").alias("outcome"), F.col("occurred_at").alias("when")
    )
    known = outcomes.where(F.col("occurred_at").isNotNull() & F.col("registered_seq").isNotNull()).select(
        "asset_id", micros("occurred_at").alias("pos"), best.alias("best")
    )
    span = ["asset_id", "start", "horizon", "logged_seq"]
    asked = predictions.where("logged_seq IS NOT NULL").select("asset_id", micros("predicted_at").alias("start"), "horizon", "logged_seq")
    asked = asked.withColumn("until", F.col("start") + (F.col("horizon") + 1) * F.lit(DAY_US))
    # the number of an instant: instants with outcomes of the asset before it; a range of time is a range of numbers
    ends = asked.select("asset_id", F.explode(F.array("start", "until")).alias("pos"), F.lit(None).cast("long").alias("one"))
    instants = known.select("asset_id", "pos", F.lit(1).cast("long").alias("one")).unionByName(ends).groupBy("asset_id", "pos").agg(
        F.max("one").alias("one")
    )
    numbered = materialized(state_before(instants, ["asset_id"], "pos", ["one"], hot_rows=hot_rows))

    def at(name: str, number: str) -> DataFrame:
        return numbered.select("asset_id", F.col("pos").alias(name), F.col("one_before").alias(number))

    ranges = materialized(
        asked.join(at("start", "low"), ["asset_id", "start"]).join(at("until", "high"), ["asset_id", "until"])
        .where("low < high").select(*span, "low", "high").distinct()
    )
    top = ranges.groupBy("asset_id").agg(F.floor(F.log2(F.max(F.col("high") - F.col("low")).cast("double"))).cast("int").alias("top"))
    each_level = F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level")
    size = lambda level: F.pow(F.lit(2.0), level).cast("long")
    placed = known.join(at("pos", "number"), ["asset_id", "pos"]).select("asset_id", "best", "number").join(top, "asset_id").select(
        "asset_id", "best", "number", each_level
    )
    blocks = placed.select(
        "asset_id", "level", F.floor(F.col("number") / size(F.col("level"))).cast("long").alias("block"),
        F.col("best.seq").cast("long").alias("pos"), "best",
    )

    # the blocks of one level that a range needs: one at either end, if the next level cannot hold it; rows instead of
    # functions over arrays, which are not compiled
    levels = F.sequence(F.lit(0), F.floor(F.log2((F.col("high") - F.col("low")).cast("double"))).cast("int"))
    sides = ranges.select(*span, "low", "high", F.explode(levels).alias("level")).select(
        *span, "level", F.ceil(F.col("low") / size(F.col("level"))).cast("long").alias("low"),
        F.floor(F.col("high") / size(F.col("level"))).cast("long").alias("high"),
    ).where("low < high")
    either = F.explode(F.array(F.when(F.col("low") % 2 == 1, F.col("low")), F.when(F.col("high") % 2 == 1, F.col("high") - 1)))
    parts = sides.select(*span, "level", either.alias("block")).where("block IS NOT NULL").select(
        *span, "level", "block", (F.col("logged_seq") + 1).cast("long").alias("pos"),
        F.lit(None).cast(known.schema["best"].dataType).alias("best"),
    )
    points = parts.unionByName(blocks, allowMissingColumns=True)
    state = state_before(points, ["asset_id", "level", "block"], "pos", [], first="best", hot_rows=hot_rows)
    found = state.where(F.col("start").isNotNull()).groupBy(*span).agg(F.min("best_from").alias("best")).where(F.col("best").isNotNull())
    return predictions.withColumn("start", micros("predicted_at")).join(found, span, "left").select(
        *predictions.columns,
        F.col("best.outcome").alias("outcome"),
        F.col("best.when").alias("occurred_at"),
        *([F.col("best.seq").alias("registered_seq")] if with_seq else []),
    )


def feedback_summary(history: DataFrame) -> DataFrame:
    """Predictions in total, with an outcome, and waiting for one."""
    return history.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count("outcome").alias("with_feedback"),
        (F.count(F.lit(1)) - F.count("outcome")).alias("pending_feedback"),
    )


def evaluated(history: DataFrame, horizon: int | None = None) -> DataFrame:
    """Rows with an outcome, as label ``y`` and prediction ``pred`` (high or medium class)."""
    known = history.where(F.col("outcome").isNotNull())
    if horizon is not None:
        known = known.where(F.col("horizon") == horizon)
    return known.withColumns({"y": F.col("outcome").cast("int"), "pred": is_flagged(F.col("risk"))})


def feedback_metrics(history: DataFrame, horizon: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    return classification_metrics(evaluated(history, horizon), by=by)


def metrics_over_time(
    history: DataFrame, horizon: int | None = None, days: int = ROLLING_DAYS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """For each evaluated prediction the quality over the ``days`` up to it, same instant included.

    Counts come from running totals at the prediction and ``days`` before it, on rows already
    counted per instant and cut where there are very many instants. Rows with fewer than five samples are left out.
    """
    rows = evaluated(history, horizon)
    y, pred = F.col("y") == 1, F.col("pred") == 1
    counts = rows.groupBy(micros("predicted_at").alias("pos")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y & pred).alias("tp"),
        F.count_if(~y & pred).alias("fp"), F.count_if(y & ~pred).alias("fn"),
    )
    sums = ["n", "tp", "fp", "fn"]
    # every instant twice: totals up to it, minus totals before its window
    end = F.struct(F.lit(1).alias("sign"), F.col("pos"), *sums)
    start = F.struct(
        F.lit(-1).alias("sign"), (F.col("pos") - days * DAY_US - 1).alias("pos"),
        *[F.lit(None).cast("long").alias(c) for c in sums],
    )
    points = counts.select(F.col("pos").alias("at"), F.explode(F.array(end, start)).alias("e")).select("at", "e.*")
    state = state_before(points, [], "pos", sums, hot_rows=hot_rows, inclusive=True)
    window = state.groupBy("at").agg(*[F.sum(F.col("sign") * F.col(f"{c}_before")).alias(c) for c in sums])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    quality = window.where(F.col("n") >= ROLLING_MIN).select(
        F.col("at"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), F.lit(0.0).alias("auc"), F.col("n").alias("n_samples"),
    )
    return rows.select("prediction_id", "predicted_at", micros("predicted_at").alias("at")).join(
        quality, "at"
    ).drop("at")


def detect_drift(
    history: DataFrame, baseline_days: int = BASELINE_DAYS, current_days: int = CURRENT_DAYS,
    max_drop: float = MAX_DROP,
) -> DataFrame:
    """One row per horizon: F1 of the last ``current_days`` against the ``baseline_days`` before.

    Both windows end at the newest evaluated prediction of the horizon; the baseline excludes
    its end. ``status`` says whether there was enough data.
    """
    rows = evaluated(history).withColumn("at", micros("predicted_at"))
    # one row per horizon
    last = F.broadcast(rows.groupBy("horizon").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("n_rows")))
    start = F.col("last") - current_days * DAY_US
    part = F.when(F.col("at") >= start, "current").when(F.col("at") >= start - baseline_days * DAY_US, "baseline")
    y, pred = F.col("y") == 1, F.col("pred") == 1

    def counts(name: str) -> list[Column]:
        inside = F.col("part") == name
        return [
            F.count_if(inside).alias(f"{name}_samples"), F.count_if(inside & y & pred).alias(f"{name}_tp"),
            F.count_if(inside & (y != pred)).alias(f"{name}_miss"),
        ]

    def f1(name: str) -> Column:
        tp = F.col(f"{name}_tp")
        return ratio(2 * tp, 2 * tp + F.col(f"{name}_miss"))

    sums = rows.join(last, "horizon").withColumn("part", part).groupBy("horizon", "n_rows").agg(
        *counts("baseline"), *counts("current")
    )
    status = (
        F.when(F.col("n_rows") < DRIFT_MIN_ROWS, "too few rows")
        .when(F.least("baseline_samples", "current_samples") < DRIFT_MIN_WINDOW, "too few rows in a window")
        .otherwise("ok")
    )
    scored = sums.select(
        "horizon", "n_rows", "baseline_samples", "current_samples", status.alias("status"),
        f1("baseline").alias("f1_baseline"), f1("current").alias("f1_current"),
    )
    enough = F.col("status") == "ok"
    drop = F.col("f1_baseline") - F.col("f1_current")
    return scored.select(
        "horizon", "n_rows", "baseline_samples", "current_samples", "status",
        F.when(enough, F.col("f1_baseline")).alias("f1_baseline"),
        F.when(enough, F.col("f1_current")).alias("f1_current"),
        F.when(enough, drop).alias("f1_drop"),
        (enough & (drop > max_drop)).alias("drift_detected"),
    )
