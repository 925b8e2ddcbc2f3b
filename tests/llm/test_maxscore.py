import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.llm import maxscore


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_against_all_products(spark, monkeypatch):
    """Several shards and blocks, ties, negative scores, vectors of other lengths and too few candidates."""
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 60)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 7)
    monkeypatch.setattr(maxscore, "BLOCK", 16)
    rng = random.Random(1)
    for spread, n in ((3, 200), (1000, 200), (50, 6)):
        rows = [(i, [rng.randrange(-spread, spread + 1) for _ in range(rng.choice([8, 8, 8, 5]))]) for i in range(n)]
        rows += [(n + i, rows[i % 3][1]) for i in range(30 if n > 10 else 0)]
        d = spark.createDataFrame(rows, "vec_id long, vector array<bigint>")
        asked = [r for r in rows if r[0] % 10 == 0]
        got = maxscore.search(d, d.where("vec_id % 10 = 0"), 10).collect()
        assert sorted(map(tuple, got)) == brute(rows, asked, 10)


def test_unsound_vectors_take_no_part(spark):
    rows = [(1, [0.5, -0.0001]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.v for r in d.select("vec_id", maxscore.whole(F.col("embedding")).alias("v")).collect()}
    assert got == {1: [512, -1], 2: None, 3: None, 4: None, 5: None, 6: []}
    empty = d.limit(0).select("vec_id", maxscore.whole(F.col("embedding")).alias("vector"))
    assert maxscore.search(empty, empty).count() == 0


def test_large_components_are_exact_or_end_the_job(spark):
    rows = [(100, [70_000.0, -70_000.0, 0.25]), (1, [70_000.0, 0.0, 1.0]), (2, [-65_536.5, 3.0, 0.0]), (3, [1e-9, 0.0, -1e-9])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", maxscore.whole(F.col("embedding")).alias("vector"))
    vectors = [(r.vec_id, r.vector) for r in d.collect()]
    assert vectors == [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    got = maxscore.search(d, d.where("vec_id = 100"), 10).collect()
    assert sorted(map(tuple, got)) == brute(vectors, vectors[:1], 10)
    with pytest.raises(Exception, match="64 bits"):
        spark.createDataFrame([([1e12, 0.0],)], "e array<double>").select(maxscore.whole(F.col("e"))).collect()
