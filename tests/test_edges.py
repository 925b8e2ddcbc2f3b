"""Hand-computed micro tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import make_log
from faultline import constants as K
from faultline.functions.text import fixed, header_name, to_source_names
from faultline.operators import cleaning, features, feedback, metrics, rootcause, scoring, survival, targets, validation
from faultline.operators.sampling import smote


def by_event(df, *cols):
    return {r["event_id"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_daily_log(daily_log):
    raw = by_event(features.asset_series(daily_log), "tbf")
    assert raw[0] is None and set(list(raw.values())[1:]) == {1}
    filled = features.asset_features(daily_log, windows=[3], interactions=False)
    assert filled.count() == 100
    assert set(by_event(filled, "tbf").values()) == {1.0}
    y = by_event(targets.horizon_targets(daily_log, [3]), "fails_within_3d")
    assert y.pop(99) == 0 and set(y.values()) == {1}


def test_weekly_log(weekly_log):
    df = targets.horizon_targets(features.asset_series(weekly_log), [3, 7])
    rows = df.collect()
    assert {r["tbf"] for r in rows if r["cumulative_failures"] > 1} == {7}
    assert all(r["fails_within_3d"] == 0 for r in rows)
    assert all(r["fails_within_7d"] == (0 if r["is_censored"] else 1) for r in rows)


def test_single_event_asset_and_same_day_failures(spark):
    log = make_log(spark, [
        ("one", "2024-01-01T00:00:00", 1),
        ("two", "2024-01-01T10:00:00", 2), ("two", "2024-01-01T10:00:00", 3), ("two", "2024-01-01T20:00:00", 4),
        ("two", "2024-01-04T19:59:59", 5),
    ])
    df = features.asset_features(log)
    assert by_event(df, "tbf")[1] == 0.0
    assert by_event(features.asset_series(log), "tbf", "cumulative_failures") == {
        1: (None, 1), 2: (None, 1), 3: (0, 2), 4: (0, 3), 5: (2, 4)
    }
    assert by_event(df, "tbf_pct_change")[5] == 0.0  # change from zero is undefined, then filled


def test_horizon_border(spark):
    log = make_log(spark, [
        ("in", "2024-01-01T00:00:00", 1), ("in", "2024-01-08T23:59:59", 2),
        ("out", "2024-01-01T00:00:00", 3), ("out", "2024-01-09T00:00:01", 4),
    ])
    y = by_event(targets.horizon_targets(log, [7]), "fails_within_7d")
    assert (y[1], y[3]) == (1, 0)


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError):
        features.asset_features(spark.range(1))


def test_duplicates_keep_modes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, at int")
    keep = lambda how: sorted(r["at"] for r in cleaning.drop_duplicates(df, ["k"], ["at"], how).collect())
    assert (keep("first"), keep("last"), keep(False)) == ([1, 3], [2, 3], [3])


def test_ranking_with_ties_and_one_class(spark):
    rows = [("t", 1, 0.9), ("t", 0, 0.5), ("t", 1, 0.5), ("t", 0, 0.1), ("o", 1, 0.3), ("o", 1, 0.4)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    out = {r["g"]: r for r in metrics.ranking_metrics(df, by=["g"]).collect()}
    assert out["t"]["auc_roc"] == pytest.approx(0.875)
    assert out["t"]["auc_pr"] == pytest.approx(0.5 * 1.0 + 0.5 * 2 / 3)
    assert out["o"]["auc_roc"] is None and out["o"]["auc_pr"] is None


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "y int, pred int")
    row = metrics.classification_metrics(empty).first()
    assert (row["tp"], row["f1"], row["accuracy"]) == (0, 0.0, 0.0)


def test_threshold_ties_take_the_lowest(spark):
    df = spark.createDataFrame([(1, 0.95), (0, 0.01)], "y int, p double")
    assert metrics.best_threshold(df).first()["threshold"] == pytest.approx(0.05)
    with pytest.raises(ValueError):
        metrics.best_threshold(df, metric="auc")


def test_outcome_rules(spark):
    t = datetime.fromisoformat
    p = spark.createDataFrame(
        [(i, "a", t("2024-01-10T12:00:00"), 3) for i in (1,)] + [(2, "b", t("2024-01-10T12:00:00"), 3), (3, "c", t("2024-01-10T12:00:00"), 3)],
        "prediction_id long, asset_id string, predicted_at timestamp, horizon int",
    )
    o = spark.createDataFrame(
        [
            ("a", t("2024-01-13T00:00:00"), 1, 2), ("a", t("2024-01-11T00:00:00"), 0, 5),  # first registered wins
            ("b", t("2024-01-10T11:59:59"), 1, 1),  # before the prediction
            ("b", t("2024-01-14T12:00:00"), 1, 3),  # day horizon + 1
            ("c", t("2024-01-14T11:59:59"), 1, 4),  # still day horizon
        ],
        "asset_id string, occurred_at timestamp, failed int, registered_seq long",
    )
    out = {r["prediction_id"]: r["outcome"] for r in feedback.match_outcomes(p, o).collect()}
    assert out == {1: 1, 2: None, 3: 1}
    summary = feedback.feedback_summary(feedback.match_outcomes(p, o)).first()
    assert tuple(summary) == (3, 2, 1)


def test_logged_predictions_with_outcome(spark):
    t = datetime.fromisoformat
    p = spark.createDataFrame(
        [(1, "a", t("2024-01-01"), 30, K.HIGH_RISK), (2, "a", t("2024-01-05"), 30, K.MEDIUM_RISK)],
        "prediction_id long, asset_id string, predicted_at timestamp, horizon int, risk string",
    )
    o = spark.createDataFrame([("a", t("2024-01-15"), 1, 1)], "asset_id string, occurred_at timestamp, failed int, registered_seq long")
    history = feedback.match_outcomes(p, o)
    assert tuple(feedback.feedback_summary(history).first()) == (2, 2, 0)
    assert feedback.feedback_metrics(history).first()["f1"] == 1.0
    drift = feedback.detect_drift(history).first()
    assert drift["status"] == "too few rows" and drift["drift_detected"] is False


def test_cause_windows(spark):
    """Empty window, empty baseline, constant baseline and a real anomaly."""
    t = datetime.fromisoformat
    days = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-20", "2024-01-21", "2024-02-20"]
    x = [1.0, 2.0, 3.0, 50.0, 60.0, 2.0]
    rows = [("a", t(d), i, v, 5.0) for i, (d, v) in enumerate(zip(days, x))]
    h = spark.createDataFrame(rows, "asset_id string, ts timestamp, event_id long, x double, flat double")
    report = {r["event_id"]: r for r in rootcause.cause_report(h, ["x", "flat"]).collect()}
    assert report[0]["status"] == "no rows in window" and report[0]["confidence_score"] == 0.0
    assert report[1]["status"] == "ok" and report[1]["n_anomalies"] == 0  # empty baseline
    assert report[5]["status"] == "no rows in window"
    assert report[4]["n_anomalies"] == 1
    top = report[4]["top_causes"][0]
    assert top["cause_feature"] == "x" and top["z_score"] == pytest.approx(48.0) and top["severity"] == "CRÍTICA"
    assert top["description"] == "X: aumento de 2400.0% em relação ao baseline"
    assert [r["priority"] for r in report[4]["recommendations"]] == [1, 99]


def test_recommendation_rules():
    first = [k for k, _ in K.ACTION_RULES][0]
    assert first == "tbf"  # tested first, so it answers for every tbf_* feature


def test_weibull_recovers_parameters(spark):
    df = spark.range(20000).select(
        F.floor(100.0 * F.pow(-F.log(1 - (F.col("id") + 0.5) / 20000.0), F.lit(1 / 1.5)) + 0.5).alias("tbf")
    )
    row = survival.weibull_summary(survival.weibull_fit(df)).first()
    assert row["shape"] == pytest.approx(1.5, rel=0.02) and row["scale"] == pytest.approx(100, rel=0.02)
    assert row["mean_life"] == pytest.approx(100 * 0.9027452929, rel=0.02)


def test_gamma(spark):
    xs = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (5.0,)], "x double")
    got = [r[0] for r in xs.select(survival.gamma(F.col("x"))).collect()]
    assert got == pytest.approx([1.7724538509, 1.0, 0.8862269255, 24.0], rel=1e-9)


def test_kaplan_meier_hand_values(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1)], "tbf int, event int")
    got = [(r["t"], r["at_risk"], r["survival"]) for r in survival.kaplan_meier(df, event="event").orderBy("t").collect()]
    assert [g[:2] for g in got] == [(0, 4), (1, 4), (2, 3), (3, 1)]
    assert [g[2] for g in got] == pytest.approx([1.0, 0.75, 0.5, 0.0])
    near = survival.survival_at(spark.createDataFrame([(0.2,), (9.0,)], "t double"), survival.kaplan_meier(df, event="event"))
    assert [r["survival"] for r in near.orderBy("t").collect()] == pytest.approx([1.0, 0.0])


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    for method in ("standard", "robust", "minmax"):
        out, _ = cleaning.scale(df, ["x"], method)
        assert [r["x"] for r in out.collect()] == [0.0, 0.0]


def test_too_many_categories_raise(spark):
    with pytest.raises(ValueError):
        cleaning.one_hot(spark.range(20), ["id"], max_categories=10)


def test_unknown_strategy_means_zero(spark):
    df = spark.createDataFrame([(None,), (2.0,)], "x double")
    assert sorted(r["x"] for r in cleaning.fill_missing(df, "other").collect()) == [0.0, 2.0]


def test_fixed_text_rounds_the_binary_value(spark):
    values = [0.075, 0.125, 0.285, 6.25, 2.675, 1.005, 99.995, 0.0, 12.345678]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(fixed(F.col("x"), 2)).collect()] == [f"{v:.2f}" for v in values]
    assert [r[0] for r in df.select(fixed(F.col("x"), 1)).collect()] == [f"{v:.1f}" for v in values]


def test_header_names():
    assert header_name("  Equipamento/Componente Envolvido ") == "equipamentocomponente_envolvido"
    assert header_name("Data e Hora de Início") == "data_e_hora_de_inicio"
    assert header_name("% concluída") == "_concluida"
    assert header_name(None) == ""


def test_source_names(daily_log):
    df = to_source_names(targets.horizon_targets(features.asset_features(daily_log), [7]))
    assert {"ativo_unico", "data", "tbf_mean_3eventos", "falha_em_7d", "mes_sin", "prob_sobrevivencia_30d"} <= set(df.columns)


def test_validation(daily_log):
    ok, table, errors = validation.validate_failures(daily_log.withColumns({"maintenance_type": F.lit("x"), "description": F.lit("y")}))
    assert ok and table is not None and errors == []
    with pytest.raises(ValueError):
        validation.validate_failures(daily_log.withColumn("module", F.lit(None).cast("string")), strict=True)
    good, report = validation.validate_features(features.asset_features(daily_log), ["tbf", "nothing"])
    assert not good and list(report) == ["missing_features"]
    assert validation.validate_features(features.asset_features(daily_log), features.feature_names())[0]
    few = daily_log.limit(5).select(F.lit(1.0).alias("x"), F.lit(1).alias("y"))
    assert validation.training_input_report(few, ["x"], "y").first()["verdict"] == "too few rows"


def test_smote_balances_between_neighbours(spark):
    rows = [(i, float(i), float(i % 7), 0) for i in range(60)] + [(100 + i, 10.0 + i, 3.0, 1) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = smote(df, ["a", "b"], "y", "id").collect()
    assert sum(r["y"] == 1 for r in out) == sum(r["y"] == 0 for r in out) == 60
    new = [r for r in out if r["synthetic"]]
    assert len(new) == 51 and all(10.0 <= r["a"] <= 18.0 and r["b"] == 3.0 for r in new)


def test_undersample_and_folds(spark):
    df = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    kept = targets.undersample(df, "y", "event_id").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in kept} == {0: 100, 1: 100}
    folds = targets.stratified_folds(df, "y", "event_id", 3).groupBy("y", "fold").count().collect()
    assert sorted(r["count"] for r in folds) == [33, 33, 34, 300, 300, 300]


def test_wide_scores_and_failed_horizon(spark):
    long = spark.createDataFrame(
        [("a", 7, None, 0.5, "m7"), ("a", 30, 0.8, 0.5, "m30")],
        "asset_id string, horizon int, probability double, threshold double, model_name string",
    )
    row = scoring.wide_scores(scoring.described(long), [7, 30]).first()
    assert row["risk_7d"] == "Erro" and row["p_7d"] is None and row["interval_7d"] == "N/A"
    assert row["risk_30d"] == K.HIGH_RISK and row["interval_30d"] == "0.75 - 0.85" and row["model_name"] == "m30"
