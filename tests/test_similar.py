"""Similar failures: pairs of sets against all pairs, wide masks, several tasks, and the report on top of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import rootcause


def random_sets(rng, n, features, most):
    """Distinct sets over features of very different frequency."""
    out = set()
    while len(out) < n:
        size = rng.randrange(1, most)
        out.add(frozenset(int(features * rng.random() ** 2) for _ in range(size)))
    return sorted(out, key=sorted)


def tables(spark, now, past, features):
    order = [f"f{i:03}" for i in range(features)]
    name = lambda s: [order[i] for i in sorted(s)]
    left = spark.createDataFrame([(a, name(s)) for a, s in now], "asset_id string, names array<string>")
    right = spark.createDataFrame([(a, name(s)) for a, s in past], "asset_id string, names array<string>")
    return (
        left.select("asset_id", rootcause._mask("names", order).alias("now_mask"), F.size("names").alias("n_now"), "names"),
        right.select("asset_id", rootcause._mask("names", order).alias("past_mask")), order,
    )


@pytest.mark.parametrize("features, least", [(20, 0.3), (130, 0.3), (20, 1.0), (20, 0.01), (1, 0.3)])
def test_pairs_against_all_pairs(spark, features, least):
    rng = random.Random(features)
    n = 1 if features == 1 else 90
    past = [(a, s) for a in "AB" for s in random_sets(rng, n, features, 8)]
    now = [("A", s) for s in random_sets(rng, n, features, 12)]
    left, right, order = tables(spark, now, past, features)
    got = sorted((tuple(r["now_mask"]), tuple(r["past_mask"]), r["shared"]) for r in rootcause.similar_sets(left.drop("names"), right, least).collect())

    def mask(s):
        words = [0] * math.ceil(features / rootcause.WORD_BITS)
        for i in s:
            words[i // rootcause.WORD_BITS] |= 1 << (i % rootcause.WORD_BITS)
        return tuple(words)

    want = sorted((mask(s), mask(p), len(s & p)) for _, s in now for a, p in past if a == "A" and len(s & p) and len(s & p) / len(s) >= least)
    assert got == want and want


def test_many_sets_of_one_asset_are_spread_and_few_are_met(spark):
    rng = random.Random(3)
    sets = random_sets(rng, 1500, 20, 7)
    left, right, _ = tables(spark, [("A", s) for s in sets], [("A", s) for s in sets], 20)
    plain = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        pairs = rootcause.similar_sets(left.drop("names"), right, 0.75)
        per_task = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
        want = sum(len(s & p) / len(s) >= 0.75 for s in sets for p in sets)
        assert sum(r["count"] for r in per_task) == want < len(sets) ** 2 / 5
        assert len(per_task) > 2
    finally:
        for k in plain:
            spark.conf.unset(k)


def test_no_anomaly_at_all(spark):
    h = spark.createDataFrame([("A", f"2024-01-0{i}", i, 1.0) for i in range(1, 6)], "asset_id string, ts string, event_id long, x double")
    now = rootcause.detect_anomalies(rootcause.window_statistics(h.withColumn("ts", F.col("ts").cast("timestamp")), ["x"], 1))
    out = rootcause.similar_failures(now, now)
    assert [len(r["similar"]) for r in out.collect()] == [0] * 5
    assert "common_anomalies:array<string>" in out.schema["similar"].dataType.simpleString()


def test_features_unknown_to_the_past_count_in_the_share(spark):
    """Four current features, one of them shared: a quarter, below the least share; one of three is enough."""
    found = "anomalies array<struct<feature:string,z_score:double>>"
    rows = spark.createDataFrame([
        ("A", "2024-01-05", [("a", 3.0), ("b", 3.0), ("c", 3.0), ("d", 3.0)]), ("A", "2024-01-06", [("a", 3.0), ("b", 3.0), ("c", 3.0)]),
    ], f"asset_id string, ts string, {found}").withColumn("ts", F.col("ts").cast("timestamp"))
    past = spark.createDataFrame([("A", "2024-01-01", [("a", 3.0)])], f"asset_id string, ts string, {found}").withColumn("ts", F.col("ts").cast("timestamp"))
    out = {str(r["ts"])[:10]: r["similar"] for r in rootcause.similar_failures(rows, past).collect()}
    assert out["2024-01-05"] == []
    assert [(round(s["similarity_score"], 6), s["common_anomalies"], s["days_ago"]) for s in out["2024-01-06"]] == [(0.333333, ["a"], 5)]
