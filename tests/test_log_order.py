"""Outcomes matched in the order of the log, against a loop over all pairs."""

import random
from datetime import datetime, timedelta

import pytest

from faultline.operators import feedback

START = datetime(2024, 1, 1)


def tables(spark, predictions, outcomes):
    p = [(i, a, START + timedelta(hours=h), horizon, seq) for i, (a, h, horizon, seq) in enumerate(predictions)]
    o = [(a, None if h is None else START + timedelta(hours=h), f, seq) for a, h, f, seq in outcomes]
    return (
        spark.createDataFrame(p, "prediction_id long, asset_id string, predicted_at timestamp, horizon int, logged_seq long"),
        spark.createDataFrame(o, "asset_id string, occurred_at timestamp, failed int, registered_seq long"),
    )


def plain(predictions, outcomes):
    out = {}
    for i, (a, h, horizon, seq) in enumerate(predictions):
        met = [
            (r, f, t) for b, t, f, r in outcomes
            if a == b and a is not None and seq is not None and t is not None and r is not None and r > seq and 0 <= (t - h) // 24 <= horizon
        ]
        out[i] = min(met)[:2] if met else (None, None)
    return out


@pytest.mark.parametrize("hot_rows", [10_000, 7])
def test_against_all_pairs(spark, hot_rows):
    rng = random.Random(hot_rows)
    assets = ["A"] * 6 + ["B", "C"]
    predictions = [(rng.choice(assets), rng.randrange(0, 2400), rng.choice([0, 1, 7, 30, 200]), rng.randrange(400)) for _ in range(250)]
    outcomes = [(rng.choice(assets), rng.randrange(0, 2400), rng.randrange(2), r) for r in rng.sample(range(500), 220)]
    predictions += [("A", 100, 7, None), (None, 5, 7, 1), ("Z", 5, 7, 1), ("A", 100, 7, 5), ("A", 100, 7, 5)]
    outcomes += [("A", None, 1, 600), (None, 6, 1, 601), ("A", 101, 1, None), ("Y", 5, 1, 602)]
    out = feedback.match_logged_outcomes(*tables(spark, predictions, outcomes), with_seq=True, hot_rows=hot_rows)
    assert out.columns == ["prediction_id", "asset_id", "predicted_at", "horizon", "logged_seq", "outcome", "occurred_at", "registered_seq"]
    got = {r["prediction_id"]: (r["registered_seq"], r["outcome"]) for r in out.collect()}
    want = plain(predictions, outcomes)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 100


def test_borders_and_order(spark):
    """Outcome at the instant, at the end of the horizon, before the prediction; registered before, with and after it."""
    predictions = [("A", 24, 2, 10), ("A", 24, 2, 11), ("A", 24, 2, 12), ("B", 0, 0, 0)]
    outcomes = [("A", 24, 1, 11), ("A", 95, 0, 12), ("A", 96, 1, 13), ("A", 23, 1, 14), ("B", 23, 1, 1), ("B", 24, 0, 2)]
    out = feedback.match_logged_outcomes(*tables(spark, predictions, outcomes), with_seq=True).collect()
    assert {r["prediction_id"]: r["registered_seq"] for r in out} == {0: 11, 1: 12, 2: None, 3: 1}


def test_empty_tables(spark):
    p, o = tables(spark, [("A", 1, 7, 1)], [("A", 2, 1, 2)])
    assert [r["outcome"] for r in feedback.match_logged_outcomes(p, o.where("false")).collect()] == [None]
    assert feedback.match_logged_outcomes(p.where("false"), o).count() == 0


def test_levels_of_a_log_of_dates(spark, monkeypatch):
    """Many outcomes of one date are one number: levels follow the dates of a range, not its outcomes."""
    rng, seen, plainly = random.Random(3), [], feedback.state_before
    monkeypatch.setattr(feedback, "state_before", lambda df, *a, **k: (seen.append(df), plainly(df, *a, **k))[1])
    predictions = [("A", 24 * rng.randrange(8), rng.choice([1, 3]), rng.randrange(300)) for _ in range(40)]
    outcomes = [("A", 24 * rng.randrange(8), rng.randrange(2), r) for r in range(300)]
    out = feedback.match_logged_outcomes(*tables(spark, predictions, outcomes), with_seq=True, hot_rows=20)
    assert {r["prediction_id"]: (r["registered_seq"], r["outcome"]) for r in out.collect()} == plain(predictions, outcomes)
    points = next(df for df in seen if "level" in df.columns)
    assert points.agg({"level": "max"}).first()[0] <= 2  # four dates at most
    assert points.where("start IS NULL").count() <= 3 * len(outcomes)
