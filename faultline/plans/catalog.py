"""Every operator as a query over the given tables: ``name -> f(spark, folder)``."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions.days import micros
from ..functions.risk import action_for, interval_bounds, interval_text, risk_class
from ..functions.text import normalized_text
from ..operators import attribution, cleaning, features, feedback, isotonic, metrics, quantiles, rootcause
from ..operators import sampling, scoring, survival, targets, training, validation
from ..operators.stacking import base_probabilities, with_probability
from ..sources import delimited, model_store, star_schema, storage, work_orders as orders_source
from ..sources.failure_log import failure_log, unread_dates
from ..streaming import feedback as stream
from . import maintenance

table = star_schema.table
log_a, log_b = star_schema.order_log, star_schema.error_log
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    """Rounded for comparison; adding zero removes the sign of a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def us(name: str = "ts") -> Column:
    return micros(name).alias(f"{name}_us")


def scratch(spark: SparkSession, part: str) -> str:
    import uuid

    return f"{storage.shared_folder(spark)}/{part}-{uuid.uuid4().hex}"


def lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag",
        "l_linestatus", "l_shipdate",
    )


def gappy(spark, d) -> DataFrame:
    """Line items with a null quantity in every fifth order."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")).alias("q"),
    )


# ---------------------------------------------------------------- sources and sinks
@query
def repeat_rates_by_region(spark, d):
    return maintenance.repeat_rates(log_a(spark, d))


def dirty_orders(spark, d) -> DataFrame:
    """Raw failure table with bad dates, blanks around names and missing parts."""
    raw = star_schema.raw_order_log(spark, d)
    key = F.col("ID Evento")
    day = F.date_format("Data e Hora de Início", "yyyy-MM-dd HH:mm:ss")
    return raw.withColumns({
        "Data e Hora de Início": F.when(key % 7 == 0, "sem data").otherwise(day),
        "Equipamento/Componente Envolvido": F.concat(
            F.lit("  "), F.col("Equipamento/Componente Envolvido"), F.lit(" ")
        ),
        "Módulo Envolvido": F.when(key % 11 != 0, F.col("Módulo Envolvido")),
        "Regional": F.when(key % 3 != 0, F.col("Regional")),
    })


@query
def io1_failure_log(spark, d):
    return failure_log(dirty_orders(spark, d)).select(
        "event_id", us(), "region", "installation", "module", "equipment", "asset_id", "maintenance_type"
    )


@query
def io1_date_formats(spark, d):
    raw, name = star_schema.raw_order_log(spark, d), "Data e Hora de Início"
    way = F.col("ID Evento") % 5
    text = F.when(way == 0, "sem data")
    for i, pattern in enumerate(("dd/MM/yyyy HH:mm", "d-M-yyyy", "yyyy-MM-dd HH:mm:ss", "d.M.yyyy H:mm:ss"), 1):
        text = text.when(way == i, F.date_format(name, pattern))
    raw = raw.withColumn(name, text)
    return failure_log(raw).select("event_id", us(), "asset_id").join(unread_dates(raw).select("n_unread"))


@query
def io2_work_orders(spark, d):
    out = orders_source.work_orders(star_schema.raw_work_orders(spark, d))
    return out.select("asset_id", us("opened_at"), "maintenance_type", "description")


@query
def io2_work_orders_by_position(spark, d):
    base = table(spark, d, "lineitem")
    named = {
        1: F.col("l_shipdate").alias("Data Abertura"), 2: F.lit("texto").alias("Descrição"),
        18: F.col("l_linestatus").alias("Local"), 19: F.col("l_returnflag").alias("Planta"),
        20: F.col("l_suppkey").cast("string").alias("Grupo"),
        29: F.col("l_partkey").cast("string").alias("Nome do Item"),
    }
    raw = base.select(*[named.get(i, F.lit(None).cast("string").alias(f"Vazio {i}")) for i in range(31)])
    out = orders_source.work_orders(raw)
    return out.select("asset_id", us("opened_at"), "maintenance_type", "description")


@query
def io3_csv_encoding_fallback(spark, d):
    path = scratch(spark, "latin1")
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Região é "), "c_mktsegment").alias("text"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return delimited.read_csv(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "text")


@query
def io3_mixed_encodings(spark, d):
    """One folder with files of both encodings; each is read in its own."""
    path = scratch(spark, "mixed")
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Região é "), "c_mktsegment").alias("text"))
    for i, encoding in enumerate(("UTF-8", "ISO-8859-1")):
        rows.where(F.col("c_custkey") % 2 == i).write.mode("append").option("header", True).option("encoding", encoding).csv(path)
    return delimited.read_csv(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "text")


@query
def io4_mapped_table(spark, d):
    path = scratch(spark, "tasks")
    first = spark.range(K.CAUSE_TASKS["skip"]).select((F.col("id") - 9).alias("at"), F.lit("Relatório").alias("value"))
    header = spark.range(1).select(F.lit(-1).cast("long").alias("at"), F.lit("% concluída,Atribuída a,Nome").alias("value"))
    body = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("at"),
        F.concat_ws(",", (F.col("o_orderkey") % 101).cast("string"), "o_orderpriority", "o_orderkey").alias("value"),
    )
    every = first.unionByName(header).unionByName(body)
    every.repartitionByRange(8, "at").sortWithinPartitions("at").select("value").write.text(path)
    return delimited.read_mapped(spark, path, K.CAUSE_TASKS)


@query
def io4_action_plans(spark, d):
    """Quoted line breaks and quotes, in files of two encodings."""
    base = scratch(spark, "plans")
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("Ação \n"), F.lit('"'), F.col("o_orderstatus"), F.lit('", ok')).alias("Status da Ação"),
        F.concat(F.lit("José "), F.col("o_orderkey").cast("string")).alias("Responsável pela Execução"),
        F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Término planejado"),
        F.col("o_orderkey").alias("k"),
    )
    plain = {"quoteAll": "true", "escape": '"', "compression": "none"}
    for name, encoding, part in (("a", "UTF-8", F.col("k") % 2 == 0), ("b", "ISO-8859-1", F.col("k") % 2 == 1)):
        writer = rows.where(part).drop("k").repartition(3).write.options(**plain).option("encoding", encoding)
        writer.csv(f"{base}/{name}", header=False)
    header = ",".join(rows.drop("k").columns)
    spark.range(1).select(F.lit(header).alias("value")).coalesce(1).write.text(f"{base}/0")
    return delimited.read_mapped(spark, f"{base}/{{0,a,b}}", K.ACTION_PLANS)


@query
def io7_model_metadata(spark, d):
    """Metadata documents of one version per order date, with missing and added fields."""
    path = scratch(spark, "metadata")
    per = table(spark, d, "orders").groupBy("o_orderdate", F.dayofweek("o_orderdate").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f")
    )
    name, share = F.date_format("o_orderdate", "'v'yyyyMMdd"), F.col("f") / F.col("n")
    rows = per.select(
        name.alias("version"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.explode(F.array(F.lit(3), F.lit(30))).alias("horizon"),
        F.when(F.col("w") != 1, F.lit("RandomForest")).alias("model_name"),
        F.when(F.col("w") != 2, F.lit(0.25)).alias("threshold"), F.array(F.lit("tbf"), F.lit("month")).alias("features"),
        F.create_map(F.lit("f1"), share, F.lit("rows"), F.col("n").cast("double")).alias("metrics_val"),
        F.when(F.col("w") != 3, F.create_map(F.lit("f1"), share)).alias("metrics_test"),
    )
    model_store.write_metadata_json(rows, path)
    # documents of another tool: one more field, one horizon that is no number
    other = per.select(F.to_json(F.struct(
        F.concat(name, F.lit("x")).alias("version"), F.lit("1.2").alias("tool"),
        F.create_map(F.lit("7"), F.struct(F.col("n").alias("size")), F.lit("all"), F.struct(F.col("n").alias("size"))).alias("models_by_horizon"),
    )).alias("value"))
    other.write.mode("append").text(path)
    return model_store.read_metadata_json(spark, path).select(
        "version", us("created_at"), "horizon", "model_name", "threshold", F.size("features").alias("n_features"),
        r6(F.col("metrics_val")["f1"]).alias("f1_val"), F.col("metrics_val")["rows"].alias("rows_val"),
        r6(F.col("metrics_test")["f1"]).alias("f1_test"),
    )


def demo_scores(spark, d) -> DataFrame:
    """Deterministic 30-day scores of the newest row of every asset."""
    p = F.pmod(F.col("event_id") * 7919, F.lit(1000)) / F.lit(1000.0)
    latest = scoring.latest_rows(log_a(spark, d))
    return scoring.described(latest.select(
        "asset_id", "ts", F.lit(30).alias("horizon"), p.alias("probability"), F.lit(0.5).alias("threshold"),
        F.lit("RandomForest").alias("model_name"),
    ))


@query
def io5_prediction_sink(spark, d):
    path = scratch(spark, "predictions")
    scores = demo_scores(spark, d).select("asset_id", "horizon", "probability", "risk")
    storage.write_predictions(scores, path, "2024-01-01")
    return storage.read_predictions(spark, path).select(
        "asset_id", "horizon", "probability", "risk", F.col("run_date").cast("string").alias("run_date")
    )


@query
def io8_prediction_history(spark, d):
    path = scratch(spark, "history")
    history = star_schema.prediction_history(spark, d)
    for half in (0, 1):
        storage.append_history(history.where(F.col("prediction_id") % 2 == half), path)
    return storage.load_history(spark, path).select(
        "prediction_id", "asset_id", us("predicted_at"), "horizon", "probability", "risk", "model_version"
    )


@query
def io8_json_history(spark, d):
    """Predictions and outcomes written as JSON documents and read again."""
    path = scratch(spark, "json")
    storage.write_json_history(history(spark, d), path)
    return storage.read_json_history(spark, path).select(
        "asset_id", us("predicted_at"), "horizon", "probability", "risk", "model_version", "outcome", us("occurred_at")
    )


@query
def io9_report_counts(spark, d):
    return scoring.risk_counts(demo_scores(spark, d))


@query
def io9_report_top_assets(spark, d):
    return scoring.critical_assets(demo_scores(spark, d))


# ---------------------------------------------------------------- projections and cleaning
@query
def p1_normalized_names(spark, d):
    name = F.concat(F.lit("  Ação/Nº_"), "c_name", F.lit(" - É "), "c_mktsegment", F.lit("  %"))
    return table(spark, d, "customer").select("c_custkey", normalized_text(name).alias("name"))


@query
def p1_normalized_texts(spark, d):
    name = normalized_text("text")
    return table(spark, d, "documents").select("doc_id", F.md5(name).alias("name_md5"), F.length(name).alias("n"))


@query
def p2_date_range(spark, d):
    return cleaning.date_range(log_a(spark, d), "ts", "1996-01-01", "1997-12-31").select("event_id", us())


@query
def p3_fill_zero(spark, d):
    return cleaning.fill_missing(gappy(spark, d), "zero", ["q"]).drop("l_shipdate")


@query
def p3_fill_mean(spark, d):
    return rounded(cleaning.fill_missing(gappy(spark, d), "mean", ["q"]).drop("l_shipdate"), "q")


@query
def p3_fill_median(spark, d):
    return cleaning.fill_missing(gappy(spark, d), "median", ["q"]).drop("l_shipdate")


@query
def p3_fill_median_infinite(spark, d):
    q = F.when(F.col("l_orderkey") % 7 == 0, float("inf")).when(F.col("l_orderkey") % 11 == 0, float("-inf")).otherwise(F.col("q"))
    out = cleaning.fill_missing(gappy(spark, d).withColumn("q", q.cast("double")), "median", ["q"])
    return out.where(F.abs("q") < float("inf")).drop("l_shipdate")


@query
def p3_forward_fill_null_key_cut(spark, d):
    keyed = gappy(spark, d).withColumn("l_partkey", F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")))
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    out = cleaning.forward_fill(keyed, ["l_partkey"], order, ["q"], hot_rows=500)
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.sum("q").alias("q"), F.count(F.lit(1)).alias("n"))


@query
def p3_forward_fill(spark, d):
    out = cleaning.forward_fill(gappy(spark, d), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], ["q"])
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.sum("q").alias("q"), F.count(F.lit(1)).alias("n"))


@query
def p4_outliers_zscore(spark, d):
    return cleaning.drop_outliers(lines(spark, d), ["l_extendedprice", "l_quantity"], "zscore", 1.5).drop("l_shipdate")


@query
def p5_outliers_iqr(spark, d):
    return cleaning.drop_outliers(lines(spark, d), ["l_extendedprice", "l_quantity"], "iqr", 0.3).drop("l_shipdate")


DUP_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]


def _deduplicated(spark, d, keep):
    out = cleaning.drop_duplicates(lines(spark, d), ["l_partkey", "l_linenumber"], DUP_ORDER, keep)
    return out.select("l_partkey", "l_linenumber", "l_orderkey", us("l_shipdate"), "l_extendedprice")


@query
def p6_first_of_duplicates(spark, d):
    return _deduplicated(spark, d, "first")


@query
def p6_last_of_duplicates(spark, d):
    return _deduplicated(spark, d, "last")


@query
def p6_unrepeated_rows(spark, d):
    return _deduplicated(spark, d, False)


@query
def p7_one_hot(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    some = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("prio")
    return cleaning.one_hot(rows.select("o_orderkey", some), ["prio"])


@query
def p7_one_hot_sparse(spark, d):
    """Every customer name as a category; whole texts, no cap."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("who"))
    hot = cleaning.one_hot_sparse(cleaning.one_hot_sparse(rows, "who"), "c_mktsegment", "segment")
    filled = F.size(F.filter(vector_to_array("segment"), lambda v: v == 1.0))
    return hot.select("c_custkey", "who_hot_index", "segment_index", filled.alias("segment_ones"))


@query
def p8_label_encoding(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("who")
    )
    return cleaning.label_encode(rows, "who", "o_orderkey", "code").select("o_orderkey", "who", "code")


def _scaled(spark, d, method):
    out, _ = cleaning.scale(lines(spark, d), ["l_extendedprice", "l_quantity"], method)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r6("l_extendedprice").alias("price"), r6("l_quantity").alias("quantity"))


@query
def p9_scale_standard(spark, d):
    return _scaled(spark, d, "standard")


@query
def p9_scale_robust(spark, d):
    return _scaled(spark, d, "robust")


@query
def p9_scale_minmax(spark, d):
    return _scaled(spark, d, "minmax")


@query
def p10_failure_schema(spark, d):
    key = F.col("event_id")
    log = log_a(spark, d).withColumns({
        "module": F.when(key % 13 != 0, F.col("module")),
        "ts": F.when(key % 17 == 0, F.lit("sem data")).otherwise(F.col("ts").cast("string")),
        "maintenance_type": F.lit("Corretiva"),
        "event_id": key.cast("string"),
    })
    return validation.failure_violations(log)


@query
def p11_feature_checks(spark, d):
    rows = lines(spark, d).select(
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")).alias("a"),
        F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("b"),
        F.when(F.col("l_partkey") % 10 == 0, F.lit(1e11)).otherwise(F.col("l_quantity")).alias("c"),
    )
    return validation.feature_violations(rows, ["a", "b", "c", "absent"])


@query
def p12_training_input(spark, d):
    rows = lines(spark, d).select("l_quantity", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return validation.training_input_report(rows, ["l_quantity", "l_extendedprice"], "y")


def demo_probability(spark, d) -> DataFrame:
    p = F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) / F.lit(1000.0)
    return table(spark, d, "orders").select("o_orderkey", p.alias("p"))


@query
def p13_risk_class(spark, d):
    return demo_probability(spark, d).select("o_orderkey", risk_class(F.col("p")).alias("risk"))


@query
def p14_interval(spark, d):
    low, high = interval_bounds(F.col("p"))
    return demo_probability(spark, d).select(
        "o_orderkey", r6(low).alias("lower"), r6(high).alias("upper"), interval_text(F.col("p")).alias("text")
    )


@query
def p15_riskiest_assets(spark, d):
    top = scoring.riskiest(demo_scores(spark, d), [K.HIGH_RISK, K.MEDIUM_RISK], 20)
    return top.select("asset_id", "probability", "risk")


@query
def p16_action_by_risk(spark, d):
    risk = risk_class(F.col("p"))
    return demo_probability(spark, d).groupBy(risk.alias("risk"), action_for(risk).alias("action")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def p17_feature_columns(spark, d):
    """Numeric feature columns found in the schema, each with its null count and mean."""
    df = features.asset_features(log_a(spark, d))
    names = features.numeric_feature_columns(df)
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("m")).alias(c) for c in names])
    items = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}.n").alias("n"), r6(F.col(f"{c}.m")).alias("mean")) for c in names
    ])
    return row.select(F.inline(items))


@query
def p18_calendar_parts(spark, d):
    return features.calendar_parts(log_b(spark, d)).select("event_id", "month", "weekday", "year", "quarter")


@query
def p19_cyclic_parts(spark, d):
    parts = features.cyclic_parts(features.calendar_parts(log_a(spark, d)))
    names = ["month_sin", "month_cos", "quarter_sin", "quarter_cos"]
    return rounded(parts, *names).select("event_id", *names)


# ---------------------------------------------------------------- windows
@query
def w1_w3_series(spark, d):
    return features.asset_series(log_a(spark, d)).select("event_id", "asset_id", "tbf", "cumulative_failures", "asset_age_days")


@query
def w1_w3_series_same_day(spark, d):
    return features.asset_series(log_b(spark, d)).select("event_id", "asset_id", "tbf", "cumulative_failures", "asset_age_days")


UNFILLED = [
    *[f"tbf_{s}_{n}" for n in K.ROLLING_WINDOWS for s in features.ROLLING],
    "tbf_pct_change", "tbf_volatility_3", "ratio_vs_mean_3", "ratio_vs_mean_6", "dist_from_min_6", "dist_from_max_6",
    "tbf_zscore_6",
]


def _derived(log: DataFrame, fill: bool, names: list[str]) -> DataFrame:
    df = features.asset_features(log, fill=fill)
    return df.select("event_id", *[r6(F.col(c).cast("double")).alias(c) for c in names])


@query
def w4_rolling_statistics(spark, d):
    return _derived(log_a(spark, d), False, UNFILLED[:12])


@query
def w5_w6_trends(spark, d):
    return _derived(log_a(spark, d), False, UNFILLED[12:14])


@query
def w7_w8_interactions(spark, d):
    return _derived(log_a(spark, d), False, UNFILLED[14:])


@query
def w9_feature_table(spark, d):
    return _derived(log_a(spark, d), True, ["tbf", *UNFILLED])


@query
def w9_feature_table_same_day(spark, d):
    return _derived(log_b(spark, d), True, ["tbf", *UNFILLED[:14], "ratio_vs_mean_3", "dist_from_min_6"])


HORIZON_COLUMNS = [f"fails_within_{h}d" for h in K.HORIZONS]


@query
def w10_horizon_targets(spark, d):
    return targets.horizon_targets(log_a(spark, d)).select("event_id", "is_censored", *HORIZON_COLUMNS)


@query
def w10_horizon_targets_same_day(spark, d):
    return targets.horizon_targets(log_b(spark, d)).select("event_id", "is_censored", *HORIZON_COLUMNS)


def _series_for_sequences(spark, d):
    return features.asset_series(log_a(spark, d)).fillna(0, subset=["tbf"]).withColumn("y", F.col("event_id") % 2)


@query
def w13_sequences(spark, d):
    out = features.feature_sequences(_series_for_sequences(spark, d), ["tbf", "cumulative_failures"], 5, label="y")
    return _flat_sequence(out, "y")


@query
def w14_padded_sequences(spark, d):
    out = features.feature_sequences(_series_for_sequences(spark, d), ["tbf", "cumulative_failures"], 5, padded=True)
    return _flat_sequence(out)


def _flat_sequence(df, *extra):
    steps = [F.col("sequence")[i][j].alias(f"s{i}_{j}") for i in range(5) for j in range(2)]
    return df.select("event_id", *extra, *steps)


@query
def t1_canonical_order(spark, d):
    """Position of every failure in its asset, also among failures of one instant."""
    rows = features.asset_series(table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("asset_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("event_id")
    ))
    return rows.select("event_id", "asset_id", F.col("cumulative_failures").alias("place"))


# The same operators with a low limit for hot groups, so that assets and days are cut.
@query
def w9_feature_table_cut(spark, d):
    df = features.asset_features(log_a(spark, d), hot_rows=14)
    return df.select("event_id", *[r6(F.col(c).cast("double")).alias(c) for c in ["tbf", *UNFILLED]])


@query
def w10_horizon_targets_cut(spark, d):
    return targets.horizon_targets(log_b(spark, d), hot_rows=10).select("event_id", "is_censored", *HORIZON_COLUMNS)


@query
def w14_padded_sequences_cut(spark, d):
    rows = _series_for_sequences(spark, d)
    return _flat_sequence(features.feature_sequences(rows, ["tbf", "cumulative_failures"], 5, padded=True, hot_rows=9))


@query
def p3_forward_fill_cut(spark, d):
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    out = cleaning.forward_fill(gappy(spark, d), ["l_partkey"], order, ["q"], hot_rows=20)
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.sum("q").alias("q"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- splits, balance, sampling
def labelled(spark, d):
    return targets.horizon_targets(log_a(spark, d))


@query
def t2_temporal_split(spark, d):
    return targets.temporal_split(labelled(spark, d)).select("event_id", "split")


@query
def t2_purged_split(spark, d):
    return targets.temporal_split(labelled(spark, d), purge_days=30).select("event_id", "split")


@query
def a5_class_balance(spark, d):
    return rounded(targets.class_balance(targets.temporal_split(labelled(spark, d))), "positive_rate")


@query
def a6_class_weights(spark, d):
    out = targets.class_weights(labelled(spark, d), "fails_within_30d")
    return rounded(out, "weight")


@query
def t4_undersample(spark, d):
    out = targets.undersample(labelled(spark, d), "fails_within_30d", "event_id")
    return out.groupBy("fails_within_30d").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_distinct"))


@query
def t5_neighbours(spark, d):
    """The five nearest customers of every customer by balance, nation and a class."""
    points = table(spark, d, "customer").select(
        F.col("c_custkey").alias("_key"),
        F.array(F.round(F.col("c_acctbal") / 100, 1), F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 3).cast("double")).alias("_x"),
    )
    rows = sampling.near_neighbours(points).select("_key", F.posexplode("near").alias("pos", "near"))
    return rows.select(F.col("_key").alias("customer"), (F.col("pos") + 1).alias("place"), F.col("near.key").alias("neighbour"), r6("near.d").alias("distance"))


@query
def t5_smote(spark, d):
    log = stored_log(spark, d)
    table_ = features.asset_features(log).select("event_id", "tbf", "tbf_mean_3", "asset_age_days")
    both = targets.horizon_targets(log).select("event_id", F.col("fails_within_30d").alias("y"))
    return sampling.smote(table_.join(both, "event_id"), ["tbf", "tbf_mean_3", "asset_age_days"], "y", "event_id")


@query
def t5_smote_counts(spark, d):
    return t5_smote(spark, d).groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query
def t6_stratified_folds(spark, d):
    out = targets.stratified_folds(labelled(spark, d), "fails_within_30d", "event_id")
    sizes = out.groupBy("fails_within_30d", "fold").agg(F.count(F.lit(1)).alias("n"))
    return sizes


@query
def t6_folds_null_label(spark, d):
    rows = labelled(spark, d).withColumn("y", F.when(F.col("event_id") % 5 != 0, F.col("fails_within_30d")))
    out = targets.stratified_folds(targets.with_class_weight(rows, "y"), "y", "event_id")
    return out.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"), F.count("weight").alias("n_weighted"))


# ---------------------------------------------------------------- aggregations and metrics
@query
def a1_aggregate_by_asset(spark, d):
    series = features.asset_series(log_a(spark, d))
    spec = {
        "tbf": ["mean", "std", "min", "max", "sum", "count", "median", "first", "last"],
        "cumulative_failures": "max",
    }
    return rounded(cleaning.aggregate_by_asset(series, spec), "tbf_mean", "tbf_std")


@query
def a2_failures_per_asset(spark, d):
    return cleaning.failures_per_asset(log_a(spark, d))


@query
def a3_distinct_assets(spark, d):
    return cleaning.distinct_assets(log_a(spark, d))


@query
def a4_tbf_histogram(spark, d):
    return rounded(cleaning.histogram(features.asset_series(log_a(spark, d)), "tbf"), "bin_from")


def scored(spark, d):
    return star_schema.scored_orders(spark, d)


RATES = ("accuracy", "precision", "recall", "f1", "specificity")


@query
def a7_confusion_metrics(spark, d):
    out = metrics.classification_metrics(metrics.at_threshold(scored(spark, d)), by=["model", "split"])
    return rounded(out, *RATES)


@query
def a8_a9_ranking_metrics(spark, d):
    return rounded(metrics.ranking_metrics(scored(spark, d), by=["model", "split"]), "auc_roc", "auc_pr")


@query
def a8_a9_ranking_metrics_cut(spark, d):
    out = metrics.ranking_metrics(scored(spark, d), by=["model", "split"], hot_rows=100)
    return rounded(out, "auc_roc", "auc_pr")


@query
def a8_null_scores(spark, d):
    """Scores with gaps: a row without a score has no rank."""
    rows = star_schema.scored_orders(spark, d).withColumn("p", F.when(F.col("event_id") % 7 != 0, F.col("p")))
    return rounded(metrics.ranking_metrics(rows, by=["model", "split"]), "auc_roc", "auc_pr")


@query
def a10_cost_metrics(spark, d):
    counts = metrics.classification_metrics(metrics.at_threshold(scored(spark, d)), by=["model"])
    return rounded(metrics.cost_metrics(counts).drop(*RATES), "roi_pct")


@query
def a11_class_report(spark, d):
    rows = metrics.at_threshold(scored(spark, d))
    return rounded(metrics.class_report(rows, by=["model"]), "precision", "recall", "f1")


@query
def a12_model_comparison(spark, d):
    by_model = metrics.classification_metrics(metrics.at_threshold(scored(spark, d)), by=["model"])
    long = by_model.unpivot("model", ["accuracy", "f1", "recall"], "metric", "value")
    return rounded(metrics.compare_models(long), "accuracy", "f1", "recall")


@query
def a13_threshold_table(spark, d):
    out = metrics.threshold_table(scored(spark, d), by=["model"])
    return rounded(out.select("model", "threshold", "tn", "fp", "fn", "tp", "precision", "recall", "f1"), "threshold", "precision", "recall", "f1")


@query
def a13_best_threshold(spark, d):
    return rounded(metrics.best_threshold(scored(spark, d), by=["model", "split"]), "threshold", "score")


@query
def a14_champions(spark, d):
    rows = metrics.at_threshold(scored(spark, d).where("split = 'val'"))
    f1 = metrics.classification_metrics(
        rows.withColumn("horizon", F.when(F.col("event_id") % 2 == 0, 15).otherwise(30)), by=["horizon", "model"]
    ).withColumn("model_rank", F.when(F.col("model") == "a", 0).otherwise(1))
    return rounded(metrics.champions(f1).select("horizon", "model", "f1"), "f1")


# ---------------------------------------------------------------- survival
def gaps(spark, d):
    return features.asset_series(log_a(spark, d)).withColumn("event", (F.col("event_id") % 4 != 0).cast("int"))


@query
def r1_kaplan_meier(spark, d):
    return rounded(survival.kaplan_meier(gaps(spark, d)), "survival")


@query
def r1_kaplan_meier_censored(spark, d):
    return rounded(survival.kaplan_meier(gaps(spark, d), event="event", by=["region"]), "survival")


@query
def r2_weibull_fit(spark, d):
    return _parameters(survival.weibull_fit(gaps(spark, d), event="event"))


@query
def r2_weibull_by_region(spark, d):
    return _parameters(survival.weibull_fit(gaps(spark, d), by=["region"]))


def _parameters(fit):
    return fit.withColumns({"shape": F.round("shape", 5), "scale": F.round("scale", 4)})


@query
def r3_weibull_summary(spark, d):
    out = survival.weibull_summary(survival.weibull_fit(gaps(spark, d), by=["region"]))
    return out.select("region", F.round("median_life", 4).alias("median_life"), F.round("mean_life", 4).alias("mean_life"))


def probe_times(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_quantity") * 7.3).alias("t")).distinct()


@query
def r4_survival_nearest(spark, d):
    out = survival.survival_at(probe_times(spark, d), survival.kaplan_meier(gaps(spark, d)))
    return rounded(out, "t", "survival")


def fixed_weibull(spark):
    return spark.range(1).select(F.lit(1.02).alias("shape"), F.lit(215.4).alias("scale"))


@query
def r4_survival_weibull(spark, d):
    out = survival.survival_at(probe_times(spark, d), None, fixed_weibull(spark))
    return rounded(out, "t", "survival")


@query
def r5_conditional_survival(spark, d):
    out = features.with_survival(features.asset_series(log_a(spark, d)), fixed_weibull(spark))
    return out.select("event_id", r6("survival_30d").alias("survival_30d"))


@query
def r6_survival_curve(spark, d):
    out = survival.survival_curve(gaps(spark, d), fixed_weibull(spark))
    return rounded(out, "t", "survival")


# ---------------------------------------------------------------- root causes
CAUSE_FEATURES = ["value", "tbf", "cumulative_failures"]


def cause_history(spark, d):
    return features.asset_series(log_b(spark, d)).fillna(0, subset=["tbf"]).select("asset_id", "ts", "event_id", *CAUSE_FEATURES)


def anomalies(h):
    return rootcause.detect_anomalies(rootcause.window_statistics(h, CAUSE_FEATURES))


def found(spark, d):
    """Anomalies and similar failures of every single failure."""
    h = cause_history(spark, d)
    now = storage.materialized(anomalies(h))
    return rootcause.per_failure(h, rootcause.similar_failures(now, now))


@query
def w12_window_statistics(spark, d):
    h = cause_history(spark, d)
    stats = rootcause.per_failure(h, rootcause.window_statistics(h, CAUSE_FEATURES))
    rows = stats.select("event_id", "n_window", "n_baseline", F.inline("s"))
    return rounded(rows, "window_mean", "window_sd", "first", "last", "base_mean", "base_sd")


@query
def w12_scaled_values(spark, d):
    """The measured value in units of very different size: statistics in the first unit, and the same anomalies."""
    factors = {"small": 1e-7, "plain": 1.0, "large": 1e9}
    h = cause_history(spark, d).select("asset_id", "ts", "event_id", *[(F.col("value") * f).alias(c) for c, f in factors.items()])
    stats = storage.materialized(rootcause.window_statistics(h, list(factors)))
    rows = rootcause.per_failure(h, stats).select("event_id", "n_window", "n_baseline", F.inline("s"))
    hits = rootcause.per_failure(h, rootcause.anomaly_rows(rootcause.detect_anomalies(stats)))
    factor = F.element_at(F.create_map(*[F.lit(v) for pair in factors.items() for v in pair]), F.col("feature"))
    return rows.join(hits.select("event_id", "feature", "z_score", "severity"), ["event_id", "feature"], "left").select(
        "event_id", "feature", "n_window", "n_baseline", r6(F.col("window_mean") / factor).alias("window_mean"),
        r6(F.col("base_sd") / factor).alias("base_sd"), r6("z_score").alias("z_score"), "severity",
    )


@query
def c1_c2_anomalies(spark, d):
    h = cause_history(spark, d)
    rows = rootcause.per_failure(h, rootcause.anomaly_rows(anomalies(h))).drop("asset_id", "ts")
    return rounded(rows, "z_score", "window_mean", "baseline_mean", "deviation_pct", "volatility")


@query
def c3_similar_failures(spark, d):
    rows = found(spark, d).select("event_id", F.inline("similar"))
    return rows.select(
        "event_id", F.unix_micros("date").alias("date_us"), r6("similarity_score").alias("similarity_score"),
        F.size("common_anomalies").alias("n_common"), F.array_join("common_anomalies", ",").alias("common"), "days_ago",
    )


@query
def c3_similar_failures_wide(spark, d):
    """Similar failures over seven features, so that the sets of an asset differ."""
    value, tbf = F.col("value"), F.col("tbf")
    h = cause_history(spark, d).select(
        "asset_id", "ts", "event_id", "value", "tbf", "cumulative_failures", (value * value).alias("square"),
        (value / (tbf + 1)).alias("rate"), F.hour("ts").cast("double").alias("hour"), (value * F.hour("ts")).alias("late"),
    )
    names = ["value", "tbf", "cumulative_failures", "square", "rate", "hour", "late"]
    now = storage.materialized(rootcause.detect_anomalies(rootcause.window_statistics(h, names)))
    rows = rootcause.per_failure(h, rootcause.similar_failures(now, now)).select("event_id", F.inline("similar"))
    return rows.select(
        "event_id", F.unix_micros("date").alias("date_us"), r6("similarity_score").alias("similarity_score"),
        F.array_join("common_anomalies", ",").alias("common"), "days_ago",
    )


@query
def c4_c6_causes(spark, d):
    rows = rootcause.rank_causes(found(spark, d)).select("event_id", F.posexplode("causes"))
    return rows.select(
        "event_id", "pos", "col.cause_feature", r6("col.probability_score").alias("probability_score"),
        "col.confidence", "col.historical_recurrence", "col.severity", "col.description",
    )


@query
def c5_confidence(spark, d):
    return found(spark, d).select("event_id", r6(rootcause.analysis_confidence()).alias("confidence_score"))


@query
def c7_recommendations(spark, d):
    rows = rootcause.recommend(rootcause.rank_causes(found(spark, d)))
    return rows.select("event_id", F.inline("recommendations"))


@query
def c8_cause_report(spark, d):
    out = rootcause.cause_report(cause_history(spark, d), CAUSE_FEATURES)
    return out.select(
        "event_id", "status", "window_days", "n_anomalies", "n_similar",
        F.get("top_causes", F.lit(0))["cause_feature"].alias("top_cause"), F.size("recommendations").alias("n_recommendations"),
        r6("confidence_score").alias("confidence_score"),
    )


@query
def c8_cause_report_cut(spark, d):
    out = rootcause.cause_report(cause_history(spark, d), CAUSE_FEATURES, hot_rows=25)
    return out.select(
        "event_id", "status", "window_days", "n_anomalies", "n_similar",
        F.get("top_causes", F.lit(0))["cause_feature"].alias("top_cause"), F.size("recommendations").alias("n_recommendations"),
        r6("confidence_score").alias("confidence_score"),
    )


@query
def c8_cause_report_longer_window(spark, d):
    out = rootcause.cause_report(cause_history(spark, d), CAUSE_FEATURES, window_days=10)
    return out.select("event_id", "status", "n_anomalies", "n_similar", r6("confidence_score").alias("confidence_score"))


# ---------------------------------------------------------------- feedback
def history(spark, d):
    return feedback.match_outcomes(star_schema.prediction_history(spark, d), star_schema.outcomes(spark, d))


@query
def j1_match_outcomes(spark, d):
    return history(spark, d).select("prediction_id", "outcome", us("occurred_at"))


def logged_predictions(spark, d):
    """Predictions with a place in the log; about half of the outcomes are registered before a given one."""
    seq = F.pmod(F.col("prediction_id") * 104729, F.lit(1_000_003))
    return star_schema.prediction_history(spark, d).withColumn("logged_seq", seq)


@query
def j1_logged_order(spark, d):
    out = feedback.match_logged_outcomes(logged_predictions(spark, d), star_schema.outcomes(spark, d))
    return out.select("prediction_id", "outcome", us("occurred_at"))


@query
def j1_logged_order_cut(spark, d):
    """Outcomes matched per region instead of customer: long ranges, and assets and blocks cut into cells."""
    by_region = lambda df: df.withColumn("asset_id", F.pmod(F.col("asset_id").cast("long"), F.lit(3)).cast("string"))
    out = feedback.match_logged_outcomes(by_region(logged_predictions(spark, d)), by_region(star_schema.outcomes(spark, d)), hot_rows=500)
    return out.select("prediction_id", "outcome", us("occurred_at"))


@query
def j1_match_outcomes_cut(spark, d):
    """Outcomes matched per region instead of customer: many per asset and day, cut further."""
    p = star_schema.prediction_history(spark, d).withColumn("asset_id", F.pmod(F.col("asset_id").cast("long"), F.lit(3)).cast("string"))
    o = star_schema.outcomes(spark, d).withColumns({
        "asset_id": F.pmod(F.col("asset_id").cast("long"), F.lit(3)).cast("string"),
        "occurred_at": F.col("occurred_at") + F.make_dt_interval(mins=F.pmod(F.col("registered_seq"), F.lit(600)).cast("int")),
    })
    out = feedback.match_outcomes(p, o, hot_rows=3)
    return out.select("prediction_id", "outcome", us("occurred_at"))


@query
def w11_metrics_over_time_cut(spark, d):
    out = feedback.metrics_over_time(storage.materialized(history(spark, d)), 30, hot_rows=300).drop("predicted_at")
    return rounded(out, "f1", "precision", "recall", "auc")


@query
def a15_feedback_summary(spark, d):
    return feedback.feedback_summary(history(spark, d))


@query
def a16_feedback_metrics(spark, d):
    return rounded(feedback.feedback_metrics(history(spark, d), by=["horizon"]), *RATES)


def _replayed(spark, df, path) -> DataFrame:
    """The rows of a table as a stream of files."""
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query
def st1_outcome_feed(spark, d):
    """Outcomes arriving as a stream, matched per micro-batch against the stored history."""
    base = scratch(spark, "feed")
    star_schema.prediction_history(spark, d).write.parquet(f"{base}/history")
    arriving = _replayed(spark, star_schema.outcomes(spark, d), f"{base}/outcomes")
    stream.run_feed(spark, arriving, f"{base}/history", f"{base}/matches", f"{base}/state", 30).awaitTermination()
    out = stream.read_feed(spark, f"{base}/history", f"{base}/matches")
    return out.select("prediction_id", "outcome", us("occurred_at"))


@query
def st1_stream_join(spark, d):
    """Both sides as streams; the predictions that found an outcome."""
    base = scratch(spark, "join")
    predictions = _replayed(spark, star_schema.prediction_history(spark, d), f"{base}/history")
    arriving = _replayed(spark, star_schema.outcomes(spark, d), f"{base}/outcomes")
    joined = stream.matched_stream(predictions, arriving, 30)
    sink = joined.writeStream.format("parquet").option("path", f"{base}/matches").option("checkpointLocation", f"{base}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    out = stream.first_registered(spark.read.schema(joined.schema).parquet(f"{base}/matches"))
    return out.where(F.col("outcome").isNotNull()).select("prediction_id", "outcome", us("occurred_at"))


@query
def w11_metrics_over_time(spark, d):
    out = feedback.metrics_over_time(storage.materialized(history(spark, d)), 30).drop("predicted_at")
    return rounded(out, "f1", "precision", "recall", "auc")


@query
def a17_drift(spark, d):
    return rounded(feedback.detect_drift(storage.materialized(history(spark, d))), "f1_baseline", "f1_current", "f1_drop")


# ---------------------------------------------------------------- scoring and attribution
@query
def j3_latest_rows(spark, d):
    return scoring.latest_rows(log_a(spark, d)).select("asset_id", "event_id", us())


LINEAR = {"tbf": -0.01, "cumulative_failures": 0.05, "asset_age_days": 0.001, "month": 0.02}


def attributed(spark, d):
    df = features.asset_features(log_a(spark, d))
    return attribution.linear_attribution(df, LINEAR, attribution.background_means(df, list(LINEAR)))


@query
def x1_linear_attribution(spark, d):
    return attributed(spark, d).select("event_id", F.inline("phi")).withColumn("phi", r6("phi"))


@query
def a18_global_importance(spark, d):
    return rounded(attribution.global_importance(attributed(spark, d)), "importance", "importance_pct")


@query
def x3_top_drivers(spark, d):
    rows = attribution.top_drivers(attributed(spark, d), 2, ["event_id"]).select("event_id", F.posexplode("drivers"))
    return rows.select("event_id", "pos", "col.feature", r6("col.phi").alias("phi"))


@query
def j4_planning_rows(spark, d):
    newest = scoring.latest_rows(attributed(spark, d))
    drivers = attribution.top_drivers(newest, 3)
    out = scoring.planning_rows(demo_scores(spark, d), log_a(spark, d), drivers)
    names = F.transform("drivers", lambda e: e["feature"])
    return out.select("asset_id", "region", "equipment", "probability", "risk", F.array_join(names, ",").alias("drivers"))


@query
def j6_global_statistics(spark, d):
    """Mean, deviation and quartiles of one column put next to every row."""
    rows = lines(spark, d)
    stats = cleaning.column_stats(rows, ["l_quantity"], mean=F.avg, sd=F.stddev_samp)["l_quantity"]
    q1, q3 = quantiles.exact_quantiles(rows, ["l_quantity"], [0.25, 0.75])["l_quantity"]
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        r6((F.col("l_quantity") - F.lit(stats["mean"])) / F.lit(stats["sd"])).alias("z"),
        r6(F.col("l_quantity") - F.lit(q1)).alias("over_q1"), r6(F.lit(q3) - F.col("l_quantity")).alias("under_q3"),
    )


@query
def u1_high_and_medium(spark, d):
    return scoring.critical_assets(demo_scores(spark, d), 25)


# ---------------------------------------------------------------- trained models (checked by rows)
MODEL_FEATURES = ["tbf", "cumulative_failures", "asset_age_days", "tbf_mean_3", "tbf_std_3", "month"]


def stored_log(spark, d) -> DataFrame:
    """Log A without its names, written once for all steps that count, order and read it."""
    return storage.materialized(log_a(spark, d).select("asset_id", "ts", "event_id"))


def training_table(spark, d) -> DataFrame:
    df = targets.horizon_targets(features.asset_features(stored_log(spark, d)), [30])
    df = df.select("asset_id", "ts", "event_id", *MODEL_FEATURES, "fails_within_30d", F.col("fails_within_30d").cast("double").alias("y"))
    return targets.temporal_split(storage.materialized(df))


def full_training_table(spark, d) -> tuple[DataFrame, list[str]]:
    """All features and horizons of the log with its split, and the names of the features."""
    df = targets.horizon_targets(features.asset_features(stored_log(spark, d)))
    names = features.feature_names()
    marks = [f"fails_within_{h}d" for h in K.HORIZONS]
    return targets.temporal_split(storage.materialized(df.select("asset_id", "ts", "event_id", *names, *marks))), names


def with_label(table: DataFrame, horizon: int = 30) -> DataFrame:
    return table.withColumn("y", F.col(f"fails_within_{horizon}d").cast("double"))


def small_candidates() -> dict:
    pool = training.candidates(trees=10, rounds=4)
    return {n: pool[n] for n in ("RandomForest", "LogisticRegression")}


@query
def m1_m5_m8_training(spark, d):
    """Four candidates and the stack at full settings for every horizon: counts and bounds of each split."""
    table, names = full_training_table(spark, d)
    results = training.train_horizons(table, names, K.HORIZONS)
    best = spark.createDataFrame([(h, r["model_name"]) for h, r in results.items()], "horizon int, best string")
    long = training.results_table(spark, results)
    value = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    wide = long.groupBy("horizon", "model", "split").agg(*[value(c).alias(c) for c in ("tn", "fp", "fn", "tp", "f1", "auc_roc")])
    top = wide.where("split = 'val'").groupBy("horizon").agg(F.max("f1").alias("top"))
    # one row per horizon
    chosen = wide.where("split = 'val'").join(F.broadcast(best), "horizon").where("model = best").select("horizon", F.col("f1").alias("best_f1"))
    out = wide.join(F.broadcast(top), "horizon").join(F.broadcast(chosen), "horizon")
    count = lambda c: c.cast("long")
    return out.select(
        "horizon", "model", "split", count(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_rows"),
        count(F.col("tp") + F.col("fn")).alias("positives"), (F.col("top") == F.col("best_f1")).alias("best_by_f1"),
        F.coalesce(F.col("auc_roc").between(0, 1), F.lit(True)).alias("bounded"),
    )


@query
def m2_boosting_isotonic(spark, d):
    """Both boosting candidates with isotonic calibration; probabilities of the test rows."""
    table, names = full_training_table(spark, d)
    rows = with_label(table)
    pool = training.candidates()
    out = training.train_candidates(rows, names, {n: pool[n] for n in ("GradientBoosting", "GradientBoostingDeep")}, "isotonic")
    scored = base_probabilities(rows.where("split = 'test'"), {n: r["model"] for n, r in out.items()})
    return scored.select("event_id", "y", *[F.col(f"p_{n}").between(0, 1).alias(f"{n}_bounded") for n in out])


def score_counts(spark, d) -> DataFrame:
    """Weight and positives of every distinct score of the two scored models."""
    return star_schema.scored_orders(spark, d).groupBy("model", F.col("p").alias("s")).agg(
        F.count(F.lit(1)).alias("w"), F.sum("y").alias("p")
    )


@query
def m4_isotonic(spark, d):
    out = isotonic.isotonic_blocks(score_counts(spark, d), ["model"])
    return rounded(out, "first", "last", "weight", "value")


@query
def m4_isotonic_cut(spark, d):
    """The same from many small ranges of scores, merged three at a time."""
    out = isotonic.isotonic_blocks(score_counts(spark, d), ["model"], size=40, merged=3)
    return rounded(out, "first", "last", "weight", "value")


@query
def m6_grid_search(spark, d):
    model, best = training.grid_search(training_table(spark, d), MODEL_FEATURES, trees=[5], depths=[3, 5], min_rows=[1], folds=3)
    return model.transform(training_table(spark, d).where("split = 'test'")).select("event_id", "y", "prediction")


@query
def m7_stacking(spark, d):
    """The stack of all candidates at full settings; probabilities of the test rows."""
    table, names = full_training_table(spark, d)
    rows = with_label(table)
    stack = training.train_stack(rows, names, training.train_candidates(rows, names, training.candidates()))
    out = with_probability(stack["model"], rows.where("split = 'test'"))
    return out.select("event_id", "y", F.lit(len(stack["model"].bases)).alias("bases"), F.col("p").between(0, 1).alias("bounded"))


@query
def j5_base_probabilities(spark, d):
    """A column per candidate, and 0.5 for a model that cannot be applied."""
    table, names = full_training_table(spark, d)
    rows = with_label(table)
    results = training.train_candidates(rows, names, training.candidates())
    scored = base_probabilities(rows.where("split = 'test'"), {n: r["model"] for n, r in results.items()} | {"broken": None})
    return scored.select("event_id", *[F.col(f"p_{n}").between(0, 1).alias(f"{n}_bounded") for n in results], "p_broken")


@query
def m9_io6_io7_batch_scoring(spark, d):
    t = training_table(spark, d)
    root = scratch(spark, "models")
    logistic = {"LogisticRegression": training.candidates()["LogisticRegression"]}
    results = training.train_horizons(t, MODEL_FEATURES, [30], logistic)
    model_store.save_models(spark, results, MODEL_FEATURES, root)
    scores = scoring.score_assets(t, model_store.load_models(spark, root))
    return scoring.wide_scores(scores, [30])


@query
def m9_missing_features(spark, d):
    """All horizons, with a missing feature in every eleventh newest row: those assets fail, the others are scored."""
    horizons = [3, 7, 15, 30]
    df = targets.horizon_targets(features.asset_features(log_a(spark, d)), horizons)
    t = targets.temporal_split(storage.materialized(df.select("asset_id", "ts", "event_id", *MODEL_FEATURES, *[f"fails_within_{h}d" for h in horizons])))
    logistic = {"LogisticRegression": training.candidates()["LogisticRegression"]}
    results = training.train_horizons(t, MODEL_FEATURES, horizons, logistic)
    models = {h: {"model": r["model"], "features": MODEL_FEATURES, "threshold": r["threshold"], "model_name": r["model_name"]} for h, r in results.items()}
    gappy_rows = t.withColumn("tbf_mean_3", F.when(F.col("event_id") % 11 != 0, F.col("tbf_mean_3")))
    scores = scoring.score_assets(gappy_rows, models)
    p, failed = F.col("probability"), F.col("risk") == K.FAILED_SCORE
    return scores.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("assets"), F.count_if(failed).alias("failed"), F.count_if(failed & p.isNull()).alias("without_score"),
        F.count_if(~failed & p.between(0, 1) & (F.col("lower") <= p) & (p <= F.col("upper"))).alias("scored"),
    )


@query
def x2_sampled_attribution(spark, d):
    t = training_table(spark, d)
    model, _ = training.grid_search(t, MODEL_FEATURES, trees=[5], depths=[4], min_rows=[1], folds=2)
    newest = scoring.latest_rows(t)
    score = attribution.probability_scorer(model)
    return attribution.sampled_attribution(newest, MODEL_FEATURES, score, t, permutations=4).select("event_id", F.inline("phi"))


@query
def x2_coalitions_of_linear_model(spark, d):
    """On a linear model, with the mean row as background, coalitions give what the coefficients give."""
    df = features.asset_features(log_a(spark, d)).select("event_id", *[F.col(c).cast("double").alias(c) for c in LINEAR])
    means = df.agg(*[F.avg(c).alias(c) for c in LINEAR])

    def score(rows: DataFrame, out: str) -> DataFrame:
        return rows.withColumn(out, sum((F.lit(w) * F.col(c) for c, w in LINEAR.items()), F.lit(0.0)))

    out = attribution.coalition_attribution(df, list(LINEAR), score, means, coalitions=96)
    return out.select("event_id", F.inline("phi")).withColumn("phi", r6("phi"))


@query
def x2_coalitions_add_up(spark, d):
    """Contributions to the scores of a trained forest: one per feature, together the score less the mean score."""
    t = training_table(spark, d)
    forest = {"RandomForest": training.candidates()["RandomForest"]}
    model = training.train_candidates(t, MODEL_FEATURES, forest)["RandomForest"]["model"]
    out = attribution.coalition_attribution(
        scoring.latest_rows(t), MODEL_FEATURES, attribution.probability_scorer(model), t
    )
    total = F.aggregate("phi", F.lit(0.0), lambda a, e: a + e["phi"])
    return out.select(
        "event_id", F.size("phi").cast("long").alias("features"),
        (F.abs(total - (F.col("score") - F.col("base"))) < 1e-9).alias("adds_up"),
        F.forall("phi", lambda e: F.abs(e["phi"]) <= 1).alias("bounded"),
    )
