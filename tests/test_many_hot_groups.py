"""More hot groups than the driver lists: they stay a table, and the results are the same."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import cleaning, ordered


@pytest.mark.parametrize("listed", [3, 10_000])
def test_the_driver_lists_a_bounded_number_of_groups(spark, monkeypatch, listed):
    monkeypatch.setattr(ordered, "LISTED", listed)
    frame, sizes = type(spark.range(0)), []
    plain = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: sizes.append(rows := plain(self)) or rows)
    at = F.col("id")
    rows = spark.range(900).select(
        F.when(at % 31 > 0, at % 31).alias("k"), F.when(at % 5 > 0, (at * 7919) % 97).cast("double").alias("x"), at.alias("n"),
        F.when(at % 4 == 0, at).alias("q"),
    )
    out = cleaning.forward_fill(rows, ["k"], ["x", "n"], ["q"], hot_rows=6)
    assert max(len(found) for found in sizes) == min(31, listed + 1)
    monkeypatch.undo()
    whole = cleaning.forward_fill(rows, ["k"], ["x", "n"], ["q"])
    assert out.exceptAll(whole).isEmpty() and whole.exceptAll(out).isEmpty() and out.count() == 900
