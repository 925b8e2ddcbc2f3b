"""Quality scores: held-out accuracy, a plain version of statistics and sums, odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import quality


def plain_shape(text):
    """The statistics of one text with plain Python on its bytes."""
    b = (text or "").encode()
    n = len(b)
    share = lambda k, whole: k / max(whole, 1)
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    space = lambda c: c == 32 or 9 <= c <= 13
    stops, commas = b".!?", b",;:'\"-()"
    symbol = lambda c: not (letter(c) or 48 <= c <= 57 or c in stops or c in commas or space(c))
    words = [w for w in re.split(rb"[ \t-\r]+", b) if w]
    lines = [x for x in b.split(b"\n") if x]
    lengths = [len(w) for w in words]
    mean = share(sum(lengths), len(words))
    spread = math.sqrt(max(share(sum(k * k for k in lengths), len(words)) - mean * mean, 0))
    in_words = lambda f: share(sum(1 for w in words if f(w)), len(words))
    n_stop = sum(c in stops for c in b)
    upper = lambda w: sum(65 <= c <= 90 for c in w)
    letters = lambda w: sum(letter(c) for c in w)
    return [
        math.log1p(n), share(upper(b), letters(b)), share(sum(48 <= c <= 57 for c in b), n), share(n_stop, n),
        share(sum(c in commas for c in b), n), share(sum(map(symbol, b)), n), share(sum(map(space, b)), n),
        share(sum(c >= 128 for c in b), n), -sum(k / n * math.log2(k / n) for k in Counter(b).values()), mean, spread,
        in_words(lambda w: len(w) <= 3), in_words(lambda w: letters(w) == 0),
        in_words(lambda w: letters(w) > 1 and upper(w) == letters(w)), in_words(lambda w: symbol(w[-1])),
        share(len(set(words)), len(words)), share(max(Counter(words).values(), default=0), len(words)),
        share(sum(x == y for x, y in zip(words, words[1:])), len(words)), math.log1p(share(len(words), len(lines))),
        1 - share(len(set(lines)), len(lines)) if lines else 1.0, math.log1p(share(len(words), n_stop)),
        math.log1p(max(lengths, default=0)),
    ]


def plain_score(model, text):
    x = plain_shape(text)
    place = lambda edges, v: sum(1 for e in edges if e <= v)
    total = model.start + sum(t[place(e, v)] for t, e, v in zip(model.tables, model.edges, x))
    for (a, b), t in zip(model.pairs, model.pair_tables):
        total += t[place(model.coarse[a], x[a]), place(model.coarse[b], x[b])]
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    out = quality.op11_additive_pairs(spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == tables[0].count()
    held = out.where("held_out").join(tables[1], "doc_id").select("predicted", "quality").collect()
    assert len(held) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.97


def test_scores_equal_the_plain_sums(tables):
    docs = tables[0].where("length(text) < 4000")
    model = quality.fit(*quality.sample(*tables))
    assert len(model.tables) == len(quality.FEATURES)
    rows = quality.score(docs, model).select("text", "score").collect()
    assert len(rows) > 500
    for r in rows:
        assert r["score"] == pytest.approx(plain_score(model, r["text"]), abs=1e-9)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(5)
    x = rng.random((4000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert model.pairs[0] == (1, 3)
    assert np.mean((model.margin(x[3000:]) > 0) == y[3000:]) > 0.9
    alone = quality.Model(model.start, model.edges, model.tables, model.coarse, [], [])
    assert np.mean((alone.margin(x[3000:]) > 0) == y[3000:]) < 0.7
    i = 3000
    total = model.start + sum(t[sum(e <= v for e in c)] for t, c, v in zip(model.tables, model.edges, x[i]))
    for (a, b), t in zip(model.pairs, model.pair_tables):
        total += t[sum(e <= x[i, a] for e in model.coarse[a]), sum(e <= x[i, b] for e in model.coarse[b])]
    assert model.margin(x[i:i + 1])[0] == pytest.approx(total)


def test_statistics_of_odd_texts():
    texts = ["", " \n\t ", "a", "A a A a", "x\nx\nx\n", "!!! ??? $$$", "é" * 5, "word " * 30_000, "no stop"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got = quality.shape(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert np.allclose(got, [plain_shape(t) for t in texts])


def test_odd_rows(spark, tmp_path):
    docs = [(i, "good words in a row. " * (i % 7 + 1) if i % 2 else "BAD!! $$$ " * (i % 7 + 1), "en") for i in range(120)]
    docs += [(1000, None, None), (1001, "", "en"), (None, "good words", "en"), (3, docs[3][1], "en"), (1002, "long text. " * 60_000, "en")]
    labels = [(i, i % 2, 0) for i in range(120)] + [(1, 1, 1), (2, None, 0), (None, 1, 0), (5000, 0, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = quality.op11_additive_pairs(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (1000, 1001)}) == 1
    known = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 120]
    assert all(r["predicted"] == r["doc_id"] % 2 for r in known)


def test_no_labels_one_class_and_clashing_columns(tables):
    docs, labels = tables
    x, y = quality.sample(docs, labels.where("false"))
    assert quality.fit(x, y) is None
    assert {r["score"] for r in quality.score(docs, None).select("score").distinct().collect()} == {0.5}
    ones = quality.fit(*quality.sample(docs, labels.where("quality = 1")))
    assert quality.score(docs, ones).agg(F.min("score")).first()[0] > 0.9
    clash = docs.limit(4).withColumns({"score": F.lit("s"), "predicted": F.lit(True), "x": F.lit(1), "in_text": F.lit("t")})
    out = quality.score(clash, ones)
    assert out.columns == [*docs.columns, "x", "in_text", "score", "predicted"] and out.count() == 4
    assert quality.score(docs.where("false"), ones).count() == 0


def test_the_sample_is_bounded_and_repeats(tables):
    docs, labels = tables
    x, y = quality.sample(docs, labels, 50)
    assert x.shape == (50, len(quality.FEATURES))
    again, _ = quality.sample(docs.union(docs), labels.union(labels).repartition(5), 50)
    assert np.array_equal(x, again)
