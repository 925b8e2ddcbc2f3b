"""Work-order table with positional or named headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import (
    WORK_ORDER_DEFAULT_TEXT, WORK_ORDER_DEFAULT_TYPE, WORK_ORDER_HEADERS, WORK_ORDER_POSITIONS,
)
from ..functions.text import normalized_headers, renamed

WIDE_FROM = 30
KEY_CHOICES = (
    ("instalacao", "sistema", "descricao_do_equipamento"),
    ("sistema", "descricao_do_equipamento"),
    ("instalacao", "modulo_envolvido", "ativo"),
)


def work_orders(raw: DataFrame) -> DataFrame:
    """``asset_id, opened_at, maintenance_type, description``; rows without a date are dropped.

    Tables of 30 or more columns are mapped by position, narrower ones by name. The
    asset key uses the first combination of columns that is present. Null parts stay
    null and give a null key part less (``concat_ws`` skips them).
    """
    df = normalized_headers(raw)
    if len(df.columns) >= WIDE_FROM:
        df = renamed(df, {df.columns[i]: name for i, name in WORK_ORDER_POSITIONS.items()})
    df = renamed(df, WORK_ORDER_HEADERS)
    parts = next((p for p in KEY_CHOICES if all(c in df.columns for c in p)), None)
    if parts is None:
        raise ValueError(f"no column combination for the asset key in {df.columns}")
    dates = [c for c in df.columns if "data" in c]

    def as_date(name: str):
        if df.schema[name].dataType.typeName() == "string":
            return F.try_to_timestamp(name)
        return F.col(name).cast("timestamp")

    if "data_de_abertura" in dates:
        opened = as_date("data_de_abertura")
    else:
        opened = as_date(dates[0]) if dates else F.lit(None).cast("timestamp")
    kind = F.col("tipo_manutencao") if "tipo_manutencao" in df.columns else F.lit(WORK_ORDER_DEFAULT_TYPE)
    text = F.col("descricao") if "descricao" in df.columns else F.lit(WORK_ORDER_DEFAULT_TEXT)
    return df.select(
        F.concat_ws(" - ", *parts).alias("asset_id"),
        opened.alias("opened_at"),
        kind.alias("maintenance_type"),
        text.alias("description"),
    ).where(F.col("opened_at").isNotNull())
