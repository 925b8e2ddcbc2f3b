"""Cut groups give the same rows as whole ones, and plans stay as intended."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import make_log
from faultline.operators import cleaning, features, feedback, metrics, ordered, quantiles, rootcause, scoring, targets
from faultline.plans import catalog


@pytest.fixture(scope="module")
def skewed(spark):
    """One asset holds half of the rows; several failures share an instant."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        asset = "hot" if i % 2 else f"a{i % 23}"
        at = start + timedelta(hours=rng.choice([0, 1, 5, 24]) + 6 * (i // 2))
        rows.append((asset, at.isoformat(), i))
    return make_log(spark, rows)


def table_of(df, key="event_id"):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: str(r[key]))


def close(a, b):
    """Equal up to rounding, at any depth of lists and structs."""
    if isinstance(a, list):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            close(x, y)
    elif isinstance(a, dict):
        assert a.keys() == b.keys()
        for k in a:
            close(a[k], b[k])
    else:
        assert a == b or a == pytest.approx(b, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("size", [13, 50])
def test_features_in_blocks(skewed, size):
    close(table_of(features.asset_features(skewed)), table_of(features.asset_features(skewed, hot_rows=size)))


def test_series_targets_and_sequences_in_blocks(skewed):
    close(table_of(features.asset_series(skewed)), table_of(features.asset_series(skewed, hot_rows=9)))
    close(table_of(targets.horizon_targets(skewed)), table_of(targets.horizon_targets(skewed, hot_rows=9)))
    s = features.asset_series(skewed).fillna(0)
    for padded in (False, True):
        whole = features.feature_sequences(s, ["tbf"], 5, padded=padded)
        close(table_of(whole), table_of(features.feature_sequences(s, ["tbf"], 5, padded=padded, hot_rows=9)))


def test_forward_fill_in_cells(skewed):
    df = skewed.withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("event_id")))
    fill = lambda n: table_of(cleaning.forward_fill(df, ["asset_id"], ["ts", "event_id"], ["v"], n))
    assert fill(10**6) == fill(10)


def test_causes_in_cells(skewed):
    h = features.asset_series(skewed).fillna(0).select(
        "asset_id", "ts", "event_id", "tbf", F.pmod(F.col("event_id") * 31, F.lit(17)).cast("double").alias("x"),
        F.pow("event_id", F.lit(4)).cast("double").alias("growing"), "cumulative_failures",
    )
    names = ["tbf", "x", "growing", "cumulative_failures"]
    whole = table_of(rootcause.cause_report(h, names, window_days=3))
    close(whole, table_of(rootcause.cause_report(h, names, window_days=3, hot_rows=10)))
    assert any(r["n_similar"] for r in whole)


def test_outcomes_in_cells(spark, skewed):
    p = skewed.select(
        F.col("event_id").alias("prediction_id"), "asset_id", F.col("ts").alias("predicted_at"),
        (F.col("event_id") % 4).cast("int").alias("horizon"),
    )
    o = skewed.where("event_id % 3 = 0").select(
        "asset_id", (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("occurred_at"),
        (F.col("event_id") % 2).cast("int").alias("failed"), F.pmod(F.col("event_id") * 7919, F.lit(1009)).alias("registered_seq"),
    )
    got = {r["prediction_id"]: r["outcome"] for r in feedback.match_outcomes(p, o, hot_rows=2).collect()}
    outs = o.collect()
    for r in p.collect():
        limit = r["predicted_at"] + timedelta(days=r["horizon"] + 1)
        hits = [x for x in outs if x["asset_id"] == r["asset_id"] and r["predicted_at"] <= x["occurred_at"] < limit]
        want = min(hits, key=lambda x: x["registered_seq"])["failed"] if hits else None
        assert got[r["prediction_id"]] == want


def test_one_instant_is_cut_by_event(spark):
    """All failures of an asset at one instant: only the event number can cut them."""
    log = make_log(spark, [("a", "2024-01-01T00:00:00", i) for i in range(200)] + [("b", "2024-01-02T00:00:00", 900)])
    split, cells = ordered.split_cells(log, ["asset_id"], ["ts", "event_id"], 20)
    assert cells and split.groupBy("asset_id", *cells).count().agg(F.max("count")).first()[0] <= 20
    got = features.asset_series(log, hot_rows=20).orderBy("event_id").collect()
    assert [r["cumulative_failures"] for r in got[:200]] == list(range(1, 201))


def test_ranking_metrics_in_cells(spark):
    df = spark.range(3000).select(
        (F.col("id") % 3 == 0).cast("int").alias("y"), (F.pmod(F.col("id") * 7919, F.lit(1013)) / F.lit(1e6)).alias("p"),
        (F.col("id") % 2).alias("g"),
    )
    for by in ([], ["g"]):
        whole = metrics.ranking_metrics(df, by=by).collect()
        cut = metrics.ranking_metrics(df, by=by, hot_rows=40).collect()
        for a, b in zip(sorted(whole), sorted(cut)):
            assert tuple(a) == pytest.approx(tuple(b), rel=1e-12)


def test_medians(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", rng.choice([rng.random(), 0.5])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.expr("percentile(v, 0.5)").alias("m")).collect()}
    for hot_rows in (10**6, 20):
        got = {r["k"]: r["median"] for r in quantiles.grouped_median(df, ["k"], "v", hot_rows=hot_rows).collect()}
        assert got == pytest.approx(want)


def test_exact_quantiles(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1e9, 1e-9, 1.0]) * rng.random(), float(rng.randrange(3)), None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, ["a", "b", "c"], probs)
    for c in ("a", "b"):
        want = df.agg(F.percentile(c, F.array(*[F.lit(p) for p in probs]))).first()[0]
        assert got[c] == pytest.approx(want, rel=1e-12)
    assert got["c"] == [None] * len(probs)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_and_targets_share_one_shuffle(skewed):
    df = targets.horizon_targets(features.asset_features(skewed))
    plan = plan_of(df)
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("+- Sort [") == 1
    assert "Python" not in plan


def test_latest_rows_are_limited_before_the_shuffle(skewed):
    assert plan_of(scoring.latest_rows(skewed)).count("WindowGroupLimit") == 2


def test_scan_is_pruned_and_filtered(spark, small):
    plan = plan_of(catalog.QUERIES["p2_date_range"](spark, small))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "o_orderdate" in line)
    assert "GreaterThanOrEqual" in plan and "o_totalprice" not in scan


def test_no_query_needs_python_workers(spark, small):
    for name in ("w9_feature_table", "c1_c2_anomalies", "j1_match_outcomes", "a8_a9_ranking_metrics", "r1_kaplan_meier"):
        plan = plan_of(catalog.QUERIES[name](spark, small))
        assert "Python" not in plan and "CartesianProduct" not in plan


def test_first_cut_makes_no_cells_of_a_handful(spark):
    """An evenly spread group a little above the limit is cut into few cells, each below the limit."""
    df = spark.range(1000).select(F.lit("A").alias("k"), F.col("id").alias("x"))
    out, cells = ordered.split_cells(df, ["k"], ["x"], 500)
    sizes = [r["count"] for r in out.groupBy(*cells).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 500 and len(sizes) <= 16
