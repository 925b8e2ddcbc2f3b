"""Kaplan-Meier, Weibull and survival curves over whole-day durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

NEWTON_STEPS = 40


def duration_counts(
    df: DataFrame, time: str = "tbf", event: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Failures and censored rows per whole-day duration.

    Days are whole, so a group has at most as many rows here as its longest gap has days,
    however many failures stand behind them. Without an event flag every row is a failure.
    """
    seen = F.lit(1) if event is None else F.coalesce(F.col(event).cast("int"), F.lit(1))
    return df.where(F.col(time).isNotNull()).groupBy(*by, F.floor(time).alias("t")).agg(
        F.count_if(seen == 1).alias("deaths"), F.count_if(seen == 0).alias("censored")
    )


def kaplan_meier(
    df: DataFrame, time: str = "tbf", event: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """``t, deaths, censored, at_risk, survival`` per distinct duration; the curve starts at t = 0."""
    counts = duration_counts(df, time, event, by)
    # the shortest duration of a group also brings the point t = 0, unless it is 0 itself
    zero = F.lit(0).cast("long")
    own = F.struct("t", "deaths", "censored")
    start = F.struct(zero.alias("t"), zero.alias("deaths"), zero.alias("censored"))
    lowest = F.min("t").over(Window.partitionBy(*by)).alias("_lowest")
    points = F.array_compact(F.array(own, F.when((F.col("t") == F.col("_lowest")) & (F.col("t") > 0), start)))
    counts = counts.select("*", lowest).select(*by, F.explode(points).alias("p")).select(*by, "p.*")
    later = Window.partitionBy(*by).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    risk = counts.withColumn("at_risk", F.sum(F.col("deaths") + F.col("censored")).over(later))
    dies_out = F.max((F.col("deaths") == F.col("at_risk")).cast("int")).over(upto)
    step = F.when(F.col("deaths") < F.col("at_risk"), F.log(1.0 - F.col("deaths") / F.col("at_risk")))
    survival = F.when(dies_out == 1, 0.0).otherwise(F.exp(F.sum(step).over(upto)))
    return risk.select(*by, "t", "deaths", "censored", "at_risk", survival.alias("survival"))


def weibull_fit(
    df: DataFrame, time: str = "tbf", event: str | None = None, by: Sequence[str] = (), steps: int = NEWTON_STEPS
) -> DataFrame:
    """Maximum-likelihood ``shape, scale`` per group over durations above zero.

    The rows are first reduced to counts per whole day; the Newton steps on the profile
    likelihood of the shape then run on that short array inside the plan. Durations are
    divided by the longest one, which keeps the powers finite. A group with one distinct
    failure time has no finite shape and gives nulls.
    """
    counts = duration_counts(df, time, event, by).where("t > 0")
    point = F.struct(
        F.col("t").cast("double").alias("t"),
        F.col("deaths").cast("double").alias("d"),
        (F.col("deaths") + F.col("censored")).cast("double").alias("n"),
    )
    packed = counts.groupBy(*by).agg(
        F.collect_list(point).alias("pts"),
        F.max("t").cast("double").alias("top"),
        F.sum("deaths").cast("double").alias("d"),
        F.countDistinct(F.when(F.col("deaths") > 0, F.col("t"))).alias("kinds"),
    ).withColumn(
        "pts",
        F.transform("pts", lambda e: F.struct(
            F.log(e["t"] / F.col("top")).alias("l"), e["d"].alias("d"), e["n"].alias("n")
        )),
    ).withColumn("mean_log", F.aggregate("pts", F.lit(0.0), lambda a, e: a + e["d"] * e["l"]) / F.col("d"))

    zero = F.struct(F.lit(0.0).alias("s0"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))

    def moments(k: Column) -> Column:
        def add(a: Column, e: Column) -> Column:
            m = e["n"] * F.exp(k * e["l"])
            return F.struct(
                (a["s0"] + m).alias("s0"), (a["s1"] + m * e["l"]).alias("s1"),
                (a["s2"] + m * e["l"] * e["l"]).alias("s2"),
            )
        return F.aggregate("pts", zero, add)

    def newton(k: Column, _: Column) -> Column:
        def move(s: Column) -> Column:
            mean = s["s1"] / s["s0"]
            g = mean - 1.0 / k - F.col("mean_log")
            slope = s["s2"] / s["s0"] - mean * mean + 1.0 / (k * k)
            return F.least(F.greatest(k - g / slope, k / 4.0), k * 4.0)
        return F.transform(F.array(moments(k)), move)[0]

    shape = F.when(
        F.col("kinds") > 1, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(1.0), newton)
    )
    fitted = packed.select(*by, "pts", "top", "d", shape.alias("shape"))
    s0 = F.aggregate("pts", F.lit(0.0), lambda a, e: a + e["n"] * F.exp(F.col("shape") * e["l"]))
    return fitted.select(
        *by, "shape", (F.col("top") * F.pow(s0 / F.col("d"), 1.0 / F.col("shape"))).alias("scale")
    )


def gamma(x: Column) -> Column:
    """Gamma function for x > 0: Stirling series at x + 8, stepped back by the recurrence."""
    z = x + 8.0
    inv = 1.0 / z
    series = inv / 12.0 - F.pow(inv, 3) / 360.0 + F.pow(inv, 5) / 1260.0 - F.pow(inv, 7) / 1680.0
    log_gamma = (z - 0.5) * F.log(z) - z + 0.5 * F.log(2 * F.pi()) + series
    product = F.lit(1.0)
    for i in range(8):
        product = product * (x + float(i))
    return F.exp(log_gamma) / product


def weibull_summary(params: DataFrame) -> DataFrame:
    """Shape, scale, median and mean life of each fitted row."""
    return params.withColumns({
        "median_life": F.col("scale") * F.pow(F.log(F.lit(2.0)), 1.0 / F.col("shape")),
        "mean_life": F.col("scale") * gamma(1.0 + 1.0 / F.col("shape")),
    })


def weibull_survival(t: Column, shape: Column, scale: Column) -> Column:
    return F.exp(-F.pow(t / scale, shape))


def survival_at(times: DataFrame, curve: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Survival at each ``t`` of ``times``: Weibull if parameters are given, else nearest curve point.

    The curve has one row per whole day; the earlier point wins ties.
    """
    if params is not None:
        one = F.broadcast(params.select("shape", "scale").limit(1))
        return times.join(one).select(
            *times.columns, weibull_survival(F.col("t"), F.col("shape"), F.col("scale")).alias("survival")
        )
    points = F.broadcast(curve.agg(
        F.array_sort(F.collect_list(F.struct("t", "survival"))).alias("_pts")
    ))
    nearest = F.array_min(F.transform(
        "_pts",
        lambda e: F.struct(F.abs(e["t"] - F.col("t")).alias("gap"), e["t"].alias("at"), e["survival"].alias("s")),
    ))
    return times.join(points).select(*times.columns, nearest["s"].alias("survival"))


def survival_curve(
    df: DataFrame, params: DataFrame, time: str = "tbf", event: str | None = None, points: int = 100
) -> DataFrame:
    """``curve, t, survival``: the Kaplan-Meier points and the Weibull at even steps up to the longest gap."""
    km = kaplan_meier(df, time, event).select(
        F.lit("kaplan_meier").alias("curve"), F.col("t").cast("double").alias("t"), "survival"
    )
    top = df.agg(F.max(F.floor(time)).cast("double").alias("top"))
    one = params.select("shape", "scale").limit(1)
    t = F.col("top") * F.col("i") / float(points - 1)
    fitted = top.join(F.broadcast(one)).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    ).select(
        F.lit("weibull").alias("curve"), t.alias("t"),
        weibull_survival(t, F.col("shape"), F.col("scale")).alias("survival"),
    )
    return km.unionByName(fitted)
