"""JSON history, encodings per file, sparse one-hot, scores with gaps, assets that lack a feature."""

import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from faultline.constants import FAILED_SCORE
from faultline.operators import cleaning, metrics, scoring
from faultline.sources import delimited, storage


def test_json_lists_with_missing_and_added_fields(spark, tmp_path):
    documents = [
        {"ativo_unico": "A", "data_predicao": "2024-01-01", "horizonte": 30, "probabilidade": 0.75, "classe_predita": "Alto Risco",
         "modelo_versao": "v1", "resultado_real": 1, "data_resultado": "2024-01-15T10:00:00", "novo_campo": [1, 2]},
        {"ativo_unico": "B", "data_predicao": "x", "horizonte": 7, "probabilidade": 0.35, "resultado_real": None},
        {"ativo_unico": "C", "resultado_real": True}, {"ativo_unico": "D", "resultado_real": False},
    ]
    (tmp_path / "listed.json").write_text(json.dumps(documents, indent=1), encoding="utf-8")
    rows = {r["asset_id"]: r for r in storage.read_json_history(spark, str(tmp_path / "listed.json"), listed=True).collect()}
    assert sorted(rows) == ["A", "B", "C", "D"]
    a, b = rows["A"], rows["B"]
    assert (a["horizon"], a["probability"], a["risk"], a["outcome"], str(a["occurred_at"])) == (30, 0.75, "Alto Risco", 1, "2024-01-15 10:00:00")
    assert (b["predicted_at"], b["risk"], b["outcome"], b["occurred_at"]) == (None, None, None, None)
    assert (rows["C"]["outcome"], rows["D"]["outcome"]) == (1, 0)


def test_json_round_trip_without_outcomes(spark, tmp_path):
    rows = spark.createDataFrame([("A", "2024-01-01 01:02:03.000004", 7, 0.5)], "asset_id string, predicted_at string, horizon int, probability double")
    rows = rows.withColumn("predicted_at", F.col("predicted_at").cast("timestamp"))
    storage.write_json_history(rows, f"{tmp_path}/h")
    back = storage.read_json_history(spark, f"{tmp_path}/h").collect()
    assert [(r["asset_id"], str(r["predicted_at"]), r["horizon"], r["probability"], r["outcome"]) for r in back] == [("A", "2024-01-01 01:02:03.000004", 7, 0.5, None)]


def test_encoding_is_chosen_per_file(spark, tmp_path):
    folder = tmp_path / "a b%c"
    folder.mkdir()
    (folder / "one é.csv").write_bytes("k,texto\n1,ação\n".encode())
    (folder / "two.csv").write_bytes("k,texto\n2,região\n".encode("latin-1"))
    (folder / "three.csv").write_bytes("texto,k\nplain,3\n".encode())
    rows = {r["k"]: r["texto"] for r in delimited.read_csv(spark, str(folder)).collect()}
    assert rows["1"] == "ação" and rows["2"] == "região"
    assert delimited.read_csv(spark, str(folder / "two.csv")).count() == 1


def test_sparse_one_hot(spark):
    df = spark.createDataFrame([(i, f"v{i % 300:03}" if i % 10 else None, 7) for i in range(900)], "k int, c string, _n int")
    out = cleaning.one_hot_sparse(df, "c").collect()
    seen = sorted({r["c"] for r in out if r["c"]})
    assert len(out) == 900
    for r in out:
        place = seen.index(r["c"]) - 1 if r["c"] and r["c"] != seen[0] else None
        assert r["c_hot_index"] == place
        assert r["c_hot"].size == len(seen) - 1 and r["c_hot"].numNonzeros() == (place is not None)
        if place is not None:
            assert list(r["c_hot"].indices) == [place]


@pytest.mark.parametrize("values", [[None, None], ["a", "a"], ["a", None]])
def test_sparse_one_hot_of_at_most_one_category(spark, values):
    out = cleaning.one_hot_sparse(spark.createDataFrame([(v,) for v in values], "c string"), "c").collect()
    assert [r["c_hot_index"] for r in out] == [None, None] and all(r["c_hot"].numNonzeros() == 0 for r in out)


def test_missing_scores_have_no_rank(spark):
    rows = [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9), (0, None), (1, None)]
    r = metrics.ranking_metrics(spark.createDataFrame(rows, "y int, p double")).first()
    assert (r["auc_roc"], r["auc_pr"], r["n_pos"], r["n_neg"]) == (1.0, 1.0, 2, 2)


def test_assets_that_lack_a_feature_fail_alone(spark):
    rows = [("A", 1.0, 1), ("B", None, 2), ("C", float("nan"), 3), ("D", 0.0, None)]
    df = spark.createDataFrame(rows, "asset_id string, x double, z int").withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "event_id": F.lit(1)})
    model = lambda f: PipelineModel([SQLTransformer(statement=f"SELECT *, assert_true(x IS NOT NULL) AS _a, {f} AS calibrated FROM __THIS__")])
    models = {7: {"model": model("0.9D"), "features": ["x"]}, 30: {"model": model("0.1D"), "features": ["x", "z"]}}
    got = {(r["asset_id"], r["horizon"]): (r["probability"], r["risk"]) for r in scoring.score_assets(df, models).collect()}
    assert len(got) == 8
    for (asset, horizon), (p, risk) in got.items():
        fails = asset in "BC" or (asset == "D" and horizon == 30)
        assert (p is None) == fails and (risk == FAILED_SCORE) == fails
