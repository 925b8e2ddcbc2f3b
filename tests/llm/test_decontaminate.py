import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    """(doc_id, n_words, n_hit, item ids) by trying every window at every place."""
    out = []
    for doc_id, text in docs:
        mine, hit, met = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            n = min(window, len(w))
            grams = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(mine) - n + 1 if n else 0):
                if tuple(mine[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    met.add(str(item_id))
        out.append((doc_id, len(mine), len(hit), sorted(met)))
    return sorted(out, key=repr)


@pytest.fixture
def tables(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("ab cde fé g1 h i".split()) for _ in range(rng.choice([1, 3, 9, 10, 14, 40]))) for _ in range(12)]
    items = [(i, t) for i, t in enumerate(base)] + [(50, None), (51, ""), (3, base[3]), (52, base[0].upper())]
    docs = [(None, base[5]), (900, None), (901, ""), (902, "!!")]
    for i in range(60):
        parts = [rng.choice(base)[rng.randrange(6):] if rng.random() < 0.6 else "zz, yy" for _ in range(rng.randrange(1, 5))]
        docs.append((i, ", ".join(parts)))
    docs += docs[10:14]
    return docs, items


@pytest.mark.parametrize("rows", [100_000, 4])
def test_against_every_window(spark, tables, monkeypatch, rows):
    """One block and several blocks give what trying every window gives; columns of other tables do not matter."""
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", rows)
    docs, items = tables
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = decontaminate.contamination(d, b).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == brute(docs, items)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], d.schema)
    assert decontaminate.contamination(one, b).first().n_hit == 0


def test_query_over_the_whole_table(spark, small):
    got = decontaminate.op5_winnowing(spark, small).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    want = [(i, n, h, len(m), hashlib.sha256(",".join(m).encode()).hexdigest(), h > 0) for i, n, h, m in brute(docs, items)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(r.contaminated for r in got)


def test_filter_sends_a_batch_in_slices(spark, monkeypatch):
    """The rows of a large batch leave as several batches: all but those with a window of the benchmark, in order."""
    item = " ".join(f"i{j}" for j in range(12))
    texts = [f"{' '.join(f't{i}x{j}' for j in range(40))} {item if i % 7 == 0 else ''}" for i in range(50)] + [None, ""]
    benchmark = spark.createDataFrame([("a", item)], "item_id string, text string")
    (block,) = decontaminate.blocks(benchmark, decontaminate.WINDOW, decontaminate.GRAM)
    monkeypatch.setattr(decontaminate, "KEPT_BYTES", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(texts)], ["doc_id", "text"])
    out = list(decontaminate._without(type("Shared", (), {"value": block}), 1)(iter([batch])))
    assert len(out) > 10
    assert [k for b in out for k in b.column(0).to_pylist()] == [i for i in range(len(texts)) if i >= 50 or i % 7]
