import random

import corpus_pipeline
from faultline.llm import secrets
from test_decontaminate import brute as hits
from test_secrets import brute as spans
from test_setjoin import brute as groups, near_copies


def stage(spark, name, docs, sf_dir):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)


def odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, and columns named like the ones the stages add."""
    texts = near_copies(1, 30, 60, 4) + [None, "", "12 34", "password: hunter2hunter2", "é" * 50, "a b"]
    rows = [(i, t, "en" if i % 3 else None, None if i == 2 else "s", None if t is None else len(t), 1, "x") for i, t in enumerate(texts)]
    rows += rows[:3] + [(None, "one two three four five", "en", "s", 3, 1, "x")] * 2
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, set_key int, spans string"
    )


def test_stages_on_odd_rows(spark, small):
    docs = odd_rows(spark)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, name, docs, small)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
    kept = sorted((r.doc_id for r in stage(spark, "near_duplicates", docs, small).collect()), key=repr)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {(d, c) for d, _, c in groups(rows, corpus_pipeline.PERCENT, corpus_pipeline.SHINGLE)}
    no_words = [d for d, t in rows if not (t or "").split()]
    assert kept == sorted([d for d, c in want if d == c and d not in no_words] + no_words, key=repr)
    assert stage(spark, "secrets", docs, small).count() == docs.count()


def test_stages_on_an_empty_table(spark, small):
    docs = odd_rows(spark).limit(0)
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, name, docs, small).count() == 0


def test_pipeline_against_plain_stages(spark, small):
    """Every stage on the output of the one before, against a plain version of the stage."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r.doc_id: r.text for r in stage(spark, "language", docs, small).collect()}
    assert len(kept) >= 0.97 * docs.count()
    docs = docs.where(docs.doc_id.isin(list(kept)))
    want = {d for d, _, c in groups(list(kept.items()), corpus_pipeline.PERCENT, corpus_pipeline.SHINGLE) if d == c}
    docs = stage(spark, "near_duplicates", docs, small)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == want
    docs = stage(spark, "decontamination", docs, small)
    want = {d for d, _, n, _ in hits(list(kept.items()), items) if not n}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == want
    docs = stage(spark, "secrets", docs, small)
    for r in docs.collect():
        found = spans(kept[r.doc_id])[1]
        assert (r.text != kept[r.doc_id]) == bool(found) and r.text.count(secrets.MARK) <= len(found)
        assert r.n_chars == len(r.text)
    final = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in final} == set(kept)
