"""Values at the edges: infinite numbers, null keys, feeds without a match, long horizons."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline.functions.text import header_name, normalized_text
from faultline.operators import cleaning, targets
from faultline.operators.ordered import split_cells
from faultline.operators.quantiles import exact_quantiles
from faultline.sources.failure_log import failure_log, unread_dates
from faultline.streaming.feedback import read_feed


@pytest.mark.parametrize(("values", "median"), [
    ([1.0, 2.0, math.inf], 2.0),
    ([-math.inf, -math.inf, 5.0, math.inf], -math.inf),
    ([math.inf, math.inf], math.inf),
    ([-1.7e308, 0.5, 1.7e308], 0.5),
    ([5e-324, 1e-323, 1.5e-323], 1e-323),
    ([1.0, math.inf], math.inf),
])
def test_quantiles_of_extreme_values(spark, values, median):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [median]


def test_quantile_between_both_infinities_is_undefined(spark):
    df = spark.createDataFrame([(-math.inf,), (math.inf,)], "x double")
    assert math.isnan(exact_quantiles(df, ["x"], [0.5])["x"][0])


def test_cells_of_extreme_order_values(spark):
    values = [None, -math.inf, -1.7e308, 1.0, 2.0, 1.7e308, math.inf, math.nan]
    df = spark.createDataFrame([(None, v) for v in values for _ in range(3)], "k int, x double")
    out, cells = split_cells(df, ["k"], ["x"], 3)
    rows = out.groupBy("k", *cells).agg(F.count("*").alias("n"), F.first("x").alias("x")).orderBy(*cells).collect()
    assert [r["n"] for r in rows] == [3] * len(values)
    assert str([r["x"] for r in rows]) == str(values)


def test_null_key_is_filled_like_other_keys(spark):
    rows = [(None, i, float(i) if i % 7 == 0 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, at long, x double")
    cut = cleaning.forward_fill(df, ["k"], ["at"], ["x"], hot_rows=10)
    assert {r["at"]: r["x"] for r in cut.collect()} == {i: float(i - i % 7) for i in range(40)}


def test_rows_without_label_stay(spark):
    df = spark.createDataFrame([(i, None if i < 10 else i % 2) for i in range(30)], "id long, y int")
    folds = targets.stratified_folds(df, "y", "id").groupBy("fold").count().collect()
    assert sum(r["count"] for r in folds) == 30 and len(folds) == 5
    weights = targets.with_class_weight(df, "y").collect()
    assert len(weights) == 30 and sum(r["weight"] is None for r in weights) == 10
    assert targets.undersample(df, "y", "id").where("y is null").count() == 0


def test_dates_in_other_formats(spark):
    texts = ["15/01/2024 10:00", "01/02/2024", "2024-03-04 05:06:07", "5-6-2024", "soon", None]
    raw = spark.createDataFrame(
        [(i, t, "R", "I", "M", "E") for i, t in enumerate(texts)],
        "n int, `Data e Hora de Início` string, Regional string, `Instalação` string, `Módulo Envolvido` string, "
        "`Equipamento/Componente Envolvido` string",
    )
    log = failure_log(raw)
    assert {r["ts"] for r in log.collect()} == {
        datetime(2024, 1, 15, 10), datetime(2024, 2, 1), datetime(2024, 3, 4, 5, 6, 7), datetime(2024, 6, 5),
    }
    assert tuple(unread_dates(raw).first()) == (1, "soon")


def test_values_and_headers_lose_accents_alike(spark):
    text = "Kelvin Ångström"
    out = spark.createDataFrame([(text,)], "t string").select(normalized_text("t")).first()[0]
    assert out == header_name(text) == "kelvin_angstrom"


def test_feed_before_the_first_match(spark, tmp_path):
    history = spark.createDataFrame([(1, "a", datetime(2024, 1, 1), 30)], "prediction_id long, asset_id string, predicted_at timestamp, horizon int")
    history.write.parquet(f"{tmp_path}/h")
    assert [r["outcome"] for r in read_feed(spark, f"{tmp_path}/h", f"{tmp_path}/m").collect()] == [None]
