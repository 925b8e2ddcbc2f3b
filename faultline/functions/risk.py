"""Row-level risk expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import (
    ACTION_BY_RISK, HIGH_RISK, HIGH_RISK_FROM, INTERVAL_HALF_WIDTH, LOW_RISK,
    MEDIUM_RISK, MEDIUM_RISK_FROM,
)
from .text import fixed


def risk_class(p: Column, high: float = HIGH_RISK_FROM, medium: float = MEDIUM_RISK_FROM) -> Column:
    return F.when(p >= high, HIGH_RISK).when(p >= medium, MEDIUM_RISK).when(p.isNotNull(), LOW_RISK)


def interval_bounds(p: Column, half: float = INTERVAL_HALF_WIDTH) -> tuple[Column, Column]:
    return F.greatest(p - half, F.lit(0.0)), F.least(p + half, F.lit(1.0))


def interval_text(p: Column, half: float = INTERVAL_HALF_WIDTH) -> Column:
    low, high = interval_bounds(p, half)
    return F.when(p.isNotNull(), F.concat(fixed(low, 2), F.lit(" - "), fixed(high, 2)))


def action_for(risk: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, action in ACTION_BY_RISK.items():
        out = out.when(risk == name, action)
    return out


def is_flagged(risk: Column) -> Column:
    """Predicted positive = high or medium class."""
    return risk.isin(HIGH_RISK, MEDIUM_RISK).cast("int")
