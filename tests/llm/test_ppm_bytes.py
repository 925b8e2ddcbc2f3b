"""Contexts are bytes: digits, and letters of two bytes, are told apart below the longest context too."""

import pytest

from faultline.llm import ppm
from test_ppm import is_held


@pytest.mark.parametrize("one, two", [("1", "2"), ("é", "щ"), ("-", "/")])
def test_short_contexts_are_told_apart(spark, tmp_path, one, two):
    learn = [i for i in range(100) if not is_held(i)][:40]
    held = [i for i in range(100, 200) if is_held(i)][:2]
    rows = [(i, f"k{one}a" if n % 2 else f"k{two}b") for n, i in enumerate(learn)]
    rows += [(held[0], f"zz{one}a"), (held[1], f"zz{two}a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    got = {r.doc_id: r.score for r in ppm.score(spark.read.parquet(f"{tmp_path}/docs")).collect()}
    assert got[held[0]] > got[held[1]] + 0.5
