"""Mergeable moments and the window statistics built on them: any scale, constants, nulls, hot assets."""

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.operators import moments, rootcause


def as_dict(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return df.agg(moments.moments(F.col("x")).alias("m"))


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e14])
def test_merged_moments_equal_those_of_all_values(spark, scale):
    rng = random.Random(7)
    groups = [[rng.gauss(50, 1) * scale for _ in range(n)] for n in (5, 1, 0, 17)]
    parts = None
    for i, g in enumerate(groups):
        part = as_dict(spark, g).withColumn("i", F.lit(i))
        parts = part if parts is None else parts.unionByName(part)
    parts = parts.withColumn("k", F.lit(1))
    for backwards in (False, True):
        out = {r["i"]: r["m_before"] for r in moments.merged_before(parts, ["k"], ["i"], ["m"], backwards).collect()}
        for i, m in out.items():
            earlier = groups[i + 1:] if backwards else groups[:i]
            values = [v for g in earlier for v in g]
            assert m["n"] == len(values)
            if len(values) > 1:
                assert m["mean"] == pytest.approx(statistics.mean(values), rel=1e-12)
                assert math.sqrt(m["m2"] / (m["n"] - 1)) == pytest.approx(statistics.stdev(values), rel=1e-9)
                assert (m["lo"], m["hi"]) == (min(values), max(values))


def log_of(spark, rows, names):
    start = datetime(2024, 1, 1)
    data = [(a, start + timedelta(hours=h), i, *map(float_or_none, v)) for i, (a, h, *v) in enumerate(rows)]
    return spark.createDataFrame(data, "asset_id string, ts timestamp, event_id long, " + ", ".join(f"{n} double" for n in names))


def float_or_none(v):
    return None if v is None else float(v)


def plain(rows, n_features, days):
    """(asset, hour) -> per feature (window n, mean, sd, first, last, baseline n, mean, sd) by looking at all rows."""
    out = {}
    for a, h, *_ in rows:
        window = [r for r in sorted(rows, key=lambda r: r[1]) if r[0] == a and h - 24 * days <= r[1] < h]
        base = [r for r in rows if r[0] == a and r[1] < h - 24 * days]
        stats = []
        for k in range(2, 2 + n_features):
            w, b = [r[k] for r in window if r[k] is not None], [r[k] for r in base if r[k] is not None]
            some = lambda f, v, least: f(v) if len(v) >= least else None
            stats.append((
                some(statistics.mean, w, 1), some(statistics.stdev, w, 2), window[0][k] if window else None,
                window[-1][k] if window else None, some(statistics.mean, b, 1), some(statistics.stdev, b, 2),
            ))
        out[a, h] = (len(window), len(base), stats)
    return out


@pytest.mark.parametrize("scale", [1e-7, 1.0, 1.8e12])
@pytest.mark.parametrize("hot_rows", [10_000, 12])
def test_window_statistics_against_all_rows(spark, scale, hot_rows):
    rng = random.Random(2)
    hours = rng.sample(range(0, 24 * 60), 150)
    rows = [("A", h, rng.gauss(10, 3) * scale, 0.1 * scale, rng.choice([None, 1.0, 2.0])) for h in hours[:110]]
    rows += [("B", h, rng.gauss(-4, 1) * scale, None, 5.0) for h in hours[110:]]
    names = ["x", "flat", "gaps"]
    got = rootcause.window_statistics(log_of(spark, rows, names), names, 5, hot_rows).collect()
    want = plain(rows, 3, 5)
    assert len(got) == len(want)
    start = datetime(2024, 1, 1)
    for r in got:
        n, base, stats = want[r["asset_id"], round((r["ts"] - start).total_seconds() / 3600)]
        assert (r["n_window"], r["n_baseline"]) == (n, base)
        for s, e in zip(r["s"], stats):
            mine = [s[c] for c in ("window_mean", "window_sd", "first", "last", "base_mean", "base_sd")]
            for a, b in zip(mine, e):
                assert (a is None) == (b is None)
                if b is not None:
                    assert a == pytest.approx(b, rel=1e-9, abs=1e-12 * scale)
        flat = r["s"][1]
        assert flat["base_sd"] in (None, 0.0) and flat["window_sd"] in (None, 0.0)


def test_anomalies_do_not_depend_on_the_unit(spark):
    rng = random.Random(6)
    rows = [("A", 6 * i, rng.gauss(100, 2) + (30 if i % 40 > 36 else 0)) for i in range(200)]
    found = []
    for scale in (1e-12, 1e-7, 1.0, 1e9, 1e30):
        h = log_of(spark, [(a, t, v * scale) for a, t, v in rows], ["x"])
        hits = rootcause.anomaly_rows(rootcause.detect_anomalies(rootcause.window_statistics(h, ["x"], 2)))
        found.append([(r["ts"], r["severity"], round(r["z_score"], 6)) for r in hits.orderBy("ts").collect()])
    assert len(found[0]) > 5
    assert all(f == found[0] for f in found)


def test_many_failures_at_one_instant(spark):
    rows = [("A", 24 * (i // 50), float(i % 7)) for i in range(400)]
    got = rootcause.window_statistics(log_of(spark, rows, ["x"]), ["x"], 2, hot_rows=60).orderBy("ts").collect()
    assert [(r["n_window"], r["n_baseline"]) for r in got] == [(min(i, 2) * 50, max(i - 2, 0) * 50) for i in range(8)]
