"""Checks of the failure log, the feature table and the training input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Column -> (type, may be null).
FAILURE_SCHEMA = {
    "asset_id": ("string", False),
    "ts": ("timestamp", False),
    "installation": ("string", False),
    "module": ("string", False),
    "equipment": ("string", False),
    "region": ("string", True),
    "maintenance_type": ("string", True),
    "description": ("string", True),
    "event_id": ("string", True),
}
LIMIT = 1e10


def failure_violations(df: DataFrame, key: str = "event_id") -> DataFrame:
    """All violations of the failure schema: ``column, check, n_failures, sample_key``.

    Extra columns are allowed. A value that cannot be cast to the declared type fails
    ``type``; an absent column fails ``present``. One pass over the data.
    """
    total = F.count(F.lit(1))
    checks = []
    for name, (kind, nullable) in FAILURE_SCHEMA.items():
        if name not in df.columns:
            checks.append((name, "present", F.lit(True), F.lit(None).cast("string")))
            continue
        value = F.col(name)
        if df.schema[name].dataType.typeName() != kind:
            bad = value.isNotNull() & value.try_cast(kind).isNull()
            checks.append((name, "type", bad, F.col(key).cast("string")))
        if not nullable:
            checks.append((name, "not_null", value.isNull(), F.col(key).cast("string")))
    aggs = []
    for i, (_, check, bad, sample) in enumerate(checks):
        n = F.lit(1).cast("long") if check == "present" else F.count_if(bad)
        aggs.append(F.struct(n.alias("n"), F.min(F.when(bad, sample)).alias("k")).alias(f"c{i}"))
    row = df.agg(*aggs)
    report = F.array(*[
        F.struct(
            F.lit(name).alias("column"), F.lit(check).alias("check"),
            F.col(f"c{i}.n").alias("n_failures"), F.col(f"c{i}.k").alias("sample_key"),
        )
        for i, (name, check, _, _) in enumerate(checks)
    ])
    return row.select(F.inline(report)).where("n_failures > 0")


def validate_failures(df: DataFrame, strict: bool = False) -> tuple[bool, DataFrame | None, list[dict]]:
    """``(is_valid, table, violations)``; with ``strict`` a violation raises."""
    errors = [r.asDict() for r in failure_violations(df).collect()]  # at most one row per check
    if errors and strict:
        raise ValueError(f"failure log is not valid: {errors}")
    return (not errors), (None if errors else df), errors


def feature_violations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per feature: ``missing``, ``null``, ``infinite`` and ``out_of_range`` counts, in one pass."""
    present = [n for n in names if n in df.columns]
    parts = []
    for n in present:
        x = F.col(n).cast("double")
        infinite = F.abs(x) == F.lit(float("inf"))
        parts += [
            F.count_if(x.isNull() | F.isnan(x)).alias(f"{n}:null"),
            F.count_if(infinite).alias(f"{n}:infinite"),
            F.count_if((F.abs(x) > LIMIT) & ~infinite & ~F.isnan(x)).alias(f"{n}:out_of_range"),
        ]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *parts)
    zero = F.lit(0).cast("long")
    items = [
        F.struct(
            F.lit(n).alias("feature"),
            F.lit(n not in present).alias("missing"),
            *[
                (F.col(f"`{n}:{c}`") if n in present else zero).alias(f"n_{c}")
                for c in ("null", "infinite", "out_of_range")
            ],
        )
        for n in names
    ]
    return row.select(F.inline(F.array(*items)))


def validate_features(df: DataFrame, names: Sequence[str], strict: bool = False) -> tuple[bool, dict]:
    """First kind of problem found, in the order missing, null, infinite, out of range."""
    rows = feature_violations(df, names).collect()  # one row per feature name
    for kind, bad in (
        ("missing_features", {r["feature"]: 1 for r in rows if r["missing"]}),
        ("features_with_nulls", {r["feature"]: r["n_null"] for r in rows if r["n_null"]}),
        ("features_with_inf", {r["feature"]: r["n_infinite"] for r in rows if r["n_infinite"]}),
        ("features_out_of_range", {r["feature"]: r["n_out_of_range"] for r in rows if r["n_out_of_range"]}),
    ):
        if bad:
            if strict:
                raise ValueError(f"{kind}: {bad}")
            return False, {kind: bad}
    return True, {}


def training_input_report(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """One row: rows, features, rows with a null feature, null targets, classes, verdict.

    The verdict names the first rule that fails: 10 rows, 1 feature, no null feature,
    no null target, 2 classes.
    """
    null_row = F.lit(False)
    for c in features:
        null_row = null_row | F.col(c).isNull()
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(features)).alias("n_features"),
        F.count_if(null_row).alias("rows_with_null"),
        F.count_if(F.col(y).isNull()).alias("null_targets"),
        F.countDistinct(y).alias("n_classes"),
    )
    verdict = (
        F.when(F.col("n_rows") < 10, "too few rows")
        .when(F.col("n_features") == 0, "no features")
        .when(F.col("rows_with_null") > 0, "null features")
        .when(F.col("null_targets") > 0, "null targets")
        .when(F.col("n_classes") < 2, "one class")
        .otherwise("ok")
    )
    return row.withColumn("verdict", verdict)
