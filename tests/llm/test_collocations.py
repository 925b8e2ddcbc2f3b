"""Phrase mining: plain counts, odd rows, groups across batches and chunks, exact scores."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, longest=3, least=10, covered=50, top=2000):
    """Rows of the result from whole counts of all phrases."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        found, candidates = [], [p for p, n in f.items() if len(p) > 1 and n >= least]
        inside = Counter()
        for p in candidates:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], f[p])
        for p in candidates:
            a = f[p]
            if 100 * inside[p] >= covered * a and inside[p]:
                continue
            score, k = min((1000000 * a * a // (f[p[:j]] * f[p[j:]]), j) for j in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


SCHEMA = "lang string, text string"


def rows(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    words = ["new", "york", "city", "Élan", "the", "THE", "of", "x-y", "naïve", "漢字", "a\x0bb", "q"]
    docs = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " new york city "]) for _ in range(rng.randrange(0, 30)))
        docs.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return docs + [("en", None), (None, ""), ("fr", " .,; "), ("de", "lonely"), ("en", "new york " * 20_000)] + docs[:50]


def test_all_phrases_against_plain_counts(spark):
    docs = corpus()
    found = rows(collocations.collocations(spark.createDataFrame(docs, SCHEMA).repartition(7)))
    assert found == plain(docs)
    assert {r[0] for r in found} == {"en", "de", "und"}


@pytest.mark.parametrize("longest, least, covered, top", [(2, 3, 50, 5), (4, 5, 80, 2000), (5, 2, 1, 30)])
def test_other_lengths_and_limits(spark, longest, least, covered, top):
    docs = corpus(2, 120)[:-55]
    found = collocations.collocations(spark.createDataFrame(docs, SCHEMA).repartition(3), longest, least, covered, top)
    assert rows(found) == plain(docs, longest, least, covered, top)


def test_small_chunks_and_batches_give_the_same(spark, monkeypatch):
    docs = corpus(3, 200)
    monkeypatch.setattr(collocations.word_chunks, "__defaults__", (300,))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        chunked = spark.createDataFrame(docs, SCHEMA).repartition(3)
        assert rows(collocations.collocations(chunked)) == plain(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("held", [1, 3, 1000])
def test_groups_that_cross_batches_pass_once_and_keep_their_id(spark, held):
    parts = [("aab", [1, 2, 4]), ("", []), ("bc", [1, 9]), ("c", [1]), ("cde", [1, 4, 5]), ("ef", [2, 1])]

    def run(_):
        numbers = iter(range(100))
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array([i % 2 for i, _ in enumerate(k)], pa.int64()), pa.array([next(numbers) for _ in k], pa.int32()), pa.array(list(k), pa.string()), pa.array(n, pa.int64())],
                ["chunk", "code", "k", "n"],
            ) for k, n in parts
        ]
        for batch in collocations.frequent_groups(["k"], 5, held)(iter(batches)):
            out = []
            for r in batch.to_pylist():
                if r["id"] is not None:
                    out.append((r["k"], r["id"], r["n"], -1, -1))
                    continue
                codes, ids = (collocations.unpacked(r[c], r["n"], kind) for c, kind in (("codes", "i4"), ("ids", "i8")))
                out += [(None, int(i), 0, r["chunk"], int(c)) for c, i in zip(codes, ids)]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate([pa.string(), *[pa.int64()] * 4])], ["k", "id", "n", "chunk", "code"])

    out = spark.range(1).repartition(1).mapInArrow(run, "k string, id long, n long, chunk long, code long").collect()
    names = {r["id"]: r["k"] for r in out if r["k"]}
    assert {r["k"]: r["n"] for r in out if r["k"]} == {"b": 5, "c": 11, "e": 7} and len(names) == 3
    assert sorted((names[r["id"]], r["code"]) for r in out if not r["k"]) == [("b", 2), ("b", 3), ("c", 4), ("c", 5), ("c", 6), ("e", 8), ("e", 9)]


def test_places_leave_one_out_between_pieces():
    import numpy as np

    data = [b"a b. c", b"", b"d", b" e,f  g", "é h".encode()]
    offsets = np.cumsum([0, *map(len, data)])
    places, words = collocations.occurrences(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert [w.decode() for w in words.to_pylist()] == ["a", "b", "c", "d", "e", "f", "g", "é", "h"]
    near = {(i, i + 1) for i in range(len(places) - 1) if places[i + 1] == places[i] + 1}
    assert near == {(0, 1), (5, 6), (7, 8)}


def test_scores_beyond_64_bits_are_exact(spark):
    f = 3_000_000_017
    expr = "(cast(a AS decimal(16,0)) * cast(a AS decimal(16,0)) * 1000000) div (cast(l AS decimal(16,0)) * cast(r AS decimal(16,0)))"
    for a, left, right in ((f, f + 1, f + 5), (10**15 + 7, 10**15 + 9, 10**15 + 11), (10, 10, 10)):
        df = spark.range(1).select(F.lit(a).cast("long").alias("a"), F.lit(left).cast("long").alias("l"), F.lit(right).cast("long").alias("r"))
        assert df.select(F.expr(expr)).first()[0] == 1000000 * a * a // (left * right)


def test_query_with_clashing_columns_and_empty_tables(spark, tmp_path):
    docs = corpus(4, 60)
    table = spark.createDataFrame(docs, SCHEMA).withColumns({"chunk": F.lit("c"), "n": F.lit(1), "id": F.lit(0), "doc_id": F.lit(7)})
    table.write.parquet(f"{tmp_path}/some/documents.parquet")
    table.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert rows(collocations.op13_setm_phrases(spark, f"{tmp_path}/some")) == plain(docs)
    assert rows(collocations.op13_setm_phrases(spark, f"{tmp_path}/none")) == []
