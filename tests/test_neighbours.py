"""Nearest rows against all pairs: clusters, repeated places, one or many pivots, fewer rows than neighbours."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from faultline.operators import sampling


def plain(rows, k):
    out = {}
    for key, x in rows:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), other) for other, y in rows if other != key)
        out[key] = near[:k]
    return out


def rows_of(kind, n):
    rng = random.Random(n)
    if kind == "clusters":
        centres = [[rng.uniform(-50, 50) for _ in range(3)] for _ in range(4)]
        return [(i, [c + rng.gauss(0, 1) for c in centres[i % 4]]) for i in range(n)]
    if kind == "repeated":
        return [(i, [float(rng.randrange(3)), float(rng.randrange(3))] if i % 3 else [1.0, 1.0]) for i in range(n)]
    return [(i, [float(2 ** rng.randrange(12)), rng.random(), 0.0]) for i in range(n)]


@pytest.mark.parametrize("kind, n, pivots, ring", [
    ("clusters", 260, 16, 11), ("clusters", 120, 1, 7), ("repeated", 150, 8, 5), ("scales", 200, 128, 1000), ("clusters", 4, 8, 3), ("clusters", 1, 8, 3),
])
def test_against_all_pairs(spark, monkeypatch, kind, n, pivots, ring):
    monkeypatch.setattr(sampling, "RING", ring)
    rows = rows_of(kind, n)
    points = spark.createDataFrame(rows, "_key long, _x array<double>")
    got = {r["_key"]: [(e["d"], e["key"]) for e in r["near"]] for r in sampling.near_neighbours(points, 5, pivots).collect()}
    want = plain(rows, 5)
    assert got.keys() == want.keys()
    for key, near in want.items():
        assert [o for _, o in got[key]] == [o for _, o in near]
        assert [d for d, _ in got[key]] == pytest.approx([d for d, _ in near])


def test_empty_table(spark):
    out = sampling.near_neighbours(spark.createDataFrame([], "_key long, _x array<double>"))
    assert out.collect() == [] and out.columns == ["_key", "_x", "near"]


def test_plan_does_not_grow_with_the_pivots_or_broadcast_the_questions(spark):
    points = spark.createDataFrame(rows_of("clusters", 900), "_key long, _x array<double>")
    plans = [sampling.near_neighbours(points, 5, n)._jdf.queryExecution().toString() for n in (1, 16)]
    assert abs(len(plans[1]) - len(plans[0])) < 1000
    assert re.search(r"SortMergeJoin.* \[_p#\w+, _cell#\w+\]", plans[1].split("== Physical Plan ==")[1])


def test_keys_that_are_null_or_come_twice(spark):
    rng = random.Random(3)
    rows = [(None if i % 9 == 0 else i // 2 if i % 5 == 0 else i, [float(rng.randrange(9)), float(rng.randrange(6))]) for i in range(90)]
    points = spark.createDataFrame(rows, "_key long, _x array<double>")
    got = sorted((r["_key"] is None, r["_key"] or 0, r["_x"], [(e["d"], e["key"]) for e in r["near"]]) for r in sampling.near_neighbours(points, 5, 6).collect())
    want = []
    for key, x in rows:
        # in its own place a row without a key meets no other
        others = [(math.dist(x, y), o) for o, y in rows if o is not None and (y != x or key is not None and o != key)]
        want.append((key is None, key or 0, x, sorted(others)[:5]))
    for mine, theirs in zip(got, sorted(want), strict=True):
        assert mine[:3] == theirs[:3] and [o for _, o in mine[3]] == [o for _, o in theirs[3]]
        assert [d for d, _ in mine[3]] == pytest.approx([d for d, _ in theirs[3]])


def test_oversampling_computes_its_input_once(spark):
    """Neither the table nor the neighbours are worked out again by the steps that read them."""
    made = spark.range(40).select(F.posexplode(F.sequence(F.lit(1), F.lit(5))), "id").select(
        (F.col("id") * 5 + F.col("pos")).alias("key"), F.col("id").cast("double").alias("a"), F.col("pos").cast("double").alias("b"),
        (F.col("id") % 4 == 0).cast("int").alias("y"),
    )
    out = sampling.smote(made, ["a", "b"], "y", "key")
    assert {(r["y"], r["synthetic"]): r["count"] for r in out.groupBy("y", "synthetic").count().collect()} == {(0, False): 150, (1, False): 50, (1, True): 100}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "_pivots" not in plan and "_bound" not in plan
