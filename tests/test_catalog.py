"""The catalog: every helper under its own name, splits and folds on a small log."""

import ast
import inspect
from collections import Counter
from datetime import date

from faultline.plans import catalog


def star(spark, folder):
    """Twenty orders, one a day, of two customers, the second one without a failure for long."""
    orders = [(i, 1 + i // 10, date(1997, 1, 1 + i) if i < 10 else date(1998, i - 9, 1), "1-URGENT") for i in range(20)]
    names = "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string"
    customers = [(i, f"C{i}", "M", 0) for i in (1, 2)]
    spark.createDataFrame(orders, names).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_mktsegment string, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")
    return folder


def test_every_name_is_defined_once():
    names = [n.name for n in ast.parse(inspect.getsource(catalog)).body if isinstance(n, ast.FunctionDef)]
    assert [n for n, c in Counter(names).items() if c > 1] == []


def test_splits_and_samples_of_a_log(spark, tmp_path):
    folder = star(spark, str(tmp_path))
    splits = Counter(r["split"] for r in catalog.t2_temporal_split(spark, folder).collect())
    assert splits["train"] == 12 and sum(splits.values()) == 20
    drawn = {r["fails_within_30d"]: (r["n"], r["n_distinct"]) for r in catalog.t4_undersample(spark, folder).collect()}
    assert len(drawn) == 2 and len(set(drawn.values())) == 1
    assert sum(r["n"] for r in catalog.t6_stratified_folds(spark, folder).collect()) == 20
    assert {r["split"] for r in catalog.a5_class_balance(spark, folder).collect()} == set(splits)
    assert catalog.a6_class_weights(spark, folder).count() == 2
