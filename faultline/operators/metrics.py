"""Classification metrics, thresholds, costs and model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import HOT_ROWS, state_before

# Unit costs of the cost metrics and the threshold grid (i / 20 for i = 1..19).
COSTS = {"fp": 100.0, "fn": 1000.0, "tp": 50.0, "tn_revenue": 0.0}
THRESHOLD_STEPS = 19


def ratio(num: Column, den: Column) -> Column:
    """Quotient, 0 where it is undefined."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def confusion_counts(y: str, pred: str) -> list[Column]:
    yes, no = F.col(y) == 1, F.col(y) == 0
    hit, miss = F.col(pred) == 1, F.col(pred) == 0
    return [
        F.count_if(no & miss).alias("tn"), F.count_if(no & hit).alias("fp"),
        F.count_if(yes & miss).alias("fn"), F.count_if(yes & hit).alias("tp"),
    ]


def rates() -> dict[str, Column]:
    """Metrics as expressions over the columns tn, fp, fn, tp."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": ratio(tn, tn + fp),
    }


def classification_metrics(
    df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and rates per group, in one aggregation; an empty input gives zeros."""
    counts = df.groupBy(*by).agg(*confusion_counts(y, pred))
    return counts.withColumns(rates())


def at_threshold(df: DataFrame, p: str = "p", threshold: float = 0.5, out: str = "pred") -> DataFrame:
    return df.withColumn(out, (F.col(p) >= threshold).cast("int"))


def ranking_metrics(
    df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``auc_roc`` (Mann-Whitney, ties half) and ``auc_pr`` (average precision, step sum).

    Both null when a group has one class; rows without a score have no rank and are left out. Works on counts per distinct score with running
    totals from the highest score down, cut into cells where a group has very many scores.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(*by, (-F.col(p)).alias("_pos")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    table = state_before(counts, list(by), "_pos", ["pos", "neg"], hot_rows=hot_rows, inclusive=True)
    hits, seen = F.col("pos_before"), F.col("pos_before") + F.col("neg_before")
    out = table.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("neg") * (hits - F.col("pos") / 2.0)).alias("_pairs"),
        F.sum(F.col("pos") * F.try_divide(hits, seen)).alias("_ap"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(
        *by, "n_pos", "n_neg",
        F.when(both, F.try_divide(F.col("_pairs"), F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc_roc"),
        F.when(both, F.try_divide(F.col("_ap"), F.col("n_pos"))).alias("auc_pr"),
    )


def cost_metrics(counts: DataFrame, costs: dict[str, float] = COSTS) -> DataFrame:
    """Costs, net result and return per row of confusion counts."""
    out = counts.withColumns({
        "cost_fp": F.col("fp") * costs["fp"],
        "cost_fn": F.col("fn") * costs["fn"],
        "cost_tp": F.col("tp") * costs["tp"],
        "revenue_tn": F.col("tn") * costs["tn_revenue"],
    })
    out = out.withColumn("total_cost", F.col("cost_fp") + F.col("cost_fn") + F.col("cost_tp"))
    net = F.col("revenue_tn") - F.col("total_cost")
    return out.withColumns({
        "net_result": net,
        "roi_pct": F.when(F.col("total_cost") > 0, net / F.col("total_cost") * 100).otherwise(0.0),
    })


def class_report(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, with ``macro`` and ``weighted`` rows; per group of ``by``."""
    # one row per group and (label, prediction) pair from here on
    pairs = df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hits"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("hits"), F.col("n").alias("predicted")),
    )).alias("s")
    each = pairs.select(*by, sides).groupBy(*by, F.col("s.class").alias("class")).agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("support", "hits", "predicted")]
    ).where("class IS NOT NULL")
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    each = each.select(
        *by, F.col("class").cast("string").alias("class"), precision.alias("precision"), recall.alias("recall"),
        ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"), "support",
    )
    names = ("precision", "recall", "f1")
    weight = F.col("support")
    sums = each.groupBy(*by).agg(
        *[F.avg(n).alias(f"m_{n}") for n in names],
        *[(F.sum(F.col(n) * weight) / F.sum(weight)).alias(f"w_{n}") for n in names],
        F.sum(weight).alias("support"),
    )
    both = F.array(*[
        F.struct(F.lit(label).alias("class"), *[F.col(f"{k}_{n}").alias(n) for n in names], F.col("support"))
        for label, k in (("macro", "m"), ("weighted", "w"))
    ])
    return each.unionByName(sums.select(*by, F.inline(both)))


def compare_models(metrics: DataFrame, sort_by: str = "f1") -> DataFrame:
    """Long table (model, metric, value) as one row per model, best first."""
    wide = metrics.groupBy("model").pivot("metric").agg(F.first("value"))
    return wide.orderBy(F.desc(sort_by), "model") if sort_by in wide.columns else wide


def threshold_table(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Metrics at the thresholds 0.05, 0.10 ... 0.95, from one count per step and class."""
    passed = F.lit(0)
    for i in range(1, THRESHOLD_STEPS + 1):
        passed = passed + (F.col(p) >= F.lit(i / 20.0)).cast("int")
    steps = df.groupBy(*by, passed.alias("_step")).agg(
        F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg")
    )
    # at most 20 rows per group from here on
    spread = F.explode(F.sequence(F.lit(1), F.lit(THRESHOLD_STEPS))).alias("_i")
    over = F.col("_step") >= F.col("_i")
    counts = steps.select("*", spread).groupBy(*by, "_i").agg(
        F.sum(F.when(~over, F.col("_neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(over, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~over, F.col("_pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(over, F.col("_pos")).otherwise(0)).alias("tp"),
    )
    table = counts.withColumns({**rates(), "threshold": F.col("_i") / F.lit(20.0)}).drop("_i")
    one_class = (F.col("tp") + F.col("fn") == 0) | (F.col("tn") + F.col("fp") == 0)
    return table.withColumn("f1", F.when(one_class, 0.0).otherwise(F.col("f1")))


def best_threshold(
    df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), metric: str = "f1"
) -> DataFrame:
    """Threshold with the highest ``f1``, ``precision`` or ``recall``; the lowest wins ties."""
    if metric not in ("f1", "precision", "recall"):
        raise ValueError(f"unknown metric {metric!r}")
    table = threshold_table(df, y, p, by)
    best = F.max_by("threshold", F.struct(F.col(metric), -F.col("threshold")))
    return table.groupBy(*by).agg(best.alias("threshold"), F.max(metric).alias("score"))


def champions(results: DataFrame, score: str = "f1", rank: str = "model_rank") -> DataFrame:
    """Best model per horizon; the earlier candidate wins ties."""
    w = Window.partitionBy("horizon").orderBy(F.desc(score), rank)
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
