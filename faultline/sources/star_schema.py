"""Failure logs, work orders and prediction history built from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.days import micros
from ..functions.risk import risk_class


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_order_log(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a raw failure table: one failure per order, one asset per customer."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    # nation and region are fixed-size dimensions (25 and 5 rows)
    nation = F.broadcast(table(spark, folder, "nation"))
    region = F.broadcast(table(spark, folder, "region"))
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == region.r_regionkey)
        .select(
            F.col("o_orderkey").alias("ID Evento"),
            F.col("o_orderdate").alias("Data e Hora de Início"),
            F.col("r_name").alias("Regional"),
            F.col("n_name").alias("Instalação/Localização"),
            F.col("c_mktsegment").alias("Módulo Envolvido"),
            F.col("c_name").alias("Equipamento/Componente Envolvido"),
            F.col("o_orderpriority").alias("Tipo de Ocorrência"),
        )
    )


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    """Log A: the cleaned failure log of :func:`raw_order_log`."""
    from .failure_log import failure_log

    return failure_log(raw_order_log(spark, folder)).select(
        "event_id", "ts", "region", "installation", "module", "equipment", "asset_id"
    )


def error_log(spark: SparkSession, folder: str) -> DataFrame:
    """Log B: error events, one asset per user; carries the measured ``value``."""
    user = F.col("user_id")
    return (
        table(spark, folder, "events")
        .where(F.col("event_type") == "error")
        .select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            F.lit("R").alias("region"),
            (user % 5).cast("string").alias("installation"),
            (user % 3).cast("string").alias("module"),
            user.cast("string").alias("equipment"),
            "value",
        )
        .withColumn("asset_id", F.concat_ws(" - ", "installation", "module", "equipment"))
    )


def raw_work_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as a named work-order table."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("Sistema"),
        F.col("l_partkey").cast("string").alias("Descrição do Equipamento"),
        F.col("l_shipdate").alias("Data da Solicitação"),
        F.col("l_returnflag").alias("Tipo"),
    )


def order_score(key: str = "event_id"):
    """Deterministic score in [0, 1) with ties, from the row key."""
    return ((F.col(key) * 7919) % 1000) / F.lit(1000.0)


def scored_orders(spark: SparkSession, folder: str, cuts: int = 1000) -> DataFrame:
    """Two scored models per order: label = urgent order, score from the key."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("y"),
        F.when(F.year("o_orderdate") < 1998, "val").otherwise("test").alias("split"),
    )
    steps = F.lit(float(cuts))
    a = (F.pmod(F.col("event_id") * 7919, F.lit(cuts)) / steps * 0.8 + F.col("y") * 0.2)
    b = F.pmod(F.col("event_id") * 104729, F.lit(cuts)) / steps
    return orders.select(
        "event_id", "y", "split",
        F.explode(F.array(
            F.struct(F.lit("a").alias("model"), a.alias("p")),
            F.struct(F.lit("b").alias("model"), b.alias("p")),
        )).alias("m"),
    ).select("event_id", "y", "split", "m.model", "m.p")


def prediction_history(spark: SparkSession, folder: str) -> DataFrame:
    """One logged prediction per order and horizon (15 and 30 days)."""
    orders = table(spark, folder, "orders")
    horizon = F.explode(F.array(F.lit(15), F.lit(30))).alias("horizon")
    p = F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) / F.lit(1000.0)
    return (
        orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("predicted_at"), horizon)
        .select(
            (F.col("o_orderkey") * 100 + F.col("horizon")).alias("prediction_id"),
            F.col("o_custkey").cast("string").alias("asset_id"),
            "predicted_at",
            "horizon",
            p.alias("probability"),
            risk_class(p).alias("risk"),
            F.lit("v1").alias("model_version"),
        )
    )


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Three quarters of the orders as outcomes; registration order differs from time order."""
    orders = table(spark, folder, "orders").where("o_orderkey % 4 <> 0")
    return orders.select(
        F.col("o_custkey").cast("string").alias("asset_id"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 HOURS")).cast("timestamp").alias("occurred_at"),
        (F.col("o_orderkey") % 3 != 0).cast("int").alias("failed"),
        F.pmod(F.col("o_orderkey") * 7919, F.lit(1_000_003)).alias("registered_seq"),
    )
