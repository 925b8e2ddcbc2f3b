import random
import re

import pyarrow as pa
import pytest

from faultline.llm import setjoin, textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, percent=85, shingle=4):
    """(doc_id, n, component) by comparing all pairs."""
    sets = []
    for _, text in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    group = list(range(len(docs)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * len(sets[i] | sets[j]):
                    group[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d[0], len(sets[i]), least.get(find(i))) for i, d in enumerate(docs)), key=repr)


def near_copies(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
        out.append(" ".join(copy[rng.randrange(3):]))
    return out


@pytest.mark.parametrize("block", [500, 7])
def test_against_all_pairs(spark, monkeypatch, block):
    """Near copies around the limit, tiny sets, nulls, repeated rows and an extra column named like a result."""
    monkeypatch.setattr(setjoin, "BLOCK", block)
    texts = near_copies(1, 60, 120, 9) + near_copies(2, 40, 30, 3) + near_copies(3, 30, 9, 2) + near_copies(4, 20, 500, 40)
    texts += ["a", "A", "a b", "A  B", "a b c d", "a b c d e", "", "  ", "é é é é", "a b c d"] * 2
    docs = list(enumerate(texts)) + [(None, texts[3]), (None, None), (700, None), (5, texts[5])]
    random.Random(5).shuffle(docs)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, set_key int")
    got = setjoin.grouped(d).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(docs)


def test_signatures_meet_for_similar_sets():
    """Any two sets at the limit share a signature, over many sizes."""
    import numpy as np

    rng = np.random.default_rng(1)
    for size in [1, 2, 3, 5, 6, 7, 8, 11, 13, 20, 40, 77, 200, 500]:
        for _ in range(40):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            drop, add = rng.integers(0, max(1, size // 6) + 1), rng.integers(0, max(1, size // 6) + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= 85 * (len(a) + len(b) - both):
                assert np.intersect1d(setjoin.signatures(np.unique(a), 85), setjoin.signatures(b, 85)).size


def test_empty_table(spark):
    assert setjoin.grouped(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_over_the_whole_table(spark, small):
    got = setjoin.op10_partenum(spark, small).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=repr) == brute(docs)


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_rule_out_no_similar_sets(percent):
    import numpy as np

    rng = np.random.default_rng(percent)
    ruled_out = 0
    for size in [1, 2, 4, 5, 8, 9, 10, 13, 36, 45, 90, 200, 450, 3000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            gone = rng.integers(0, len(a) // 5 + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, rng.integers(0, len(a) // 9 + 2)).astype(np.uint64)]))
            c = np.unique(np.concatenate([a[:len(a) // 3], rng.integers(0, 2**63, size).astype(np.uint64)]))

            def node(e):
                own = setjoin.band(len(e), percent)
                return len(e), own, setjoin.sketch(e, own, percent), setjoin.sketch(e, own - 1, percent) if own else None

            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert not setjoin._unlike(node(a), node(b), percent) and not setjoin._unlike(node(b), node(a), percent)
            ruled_out += size >= 36 and setjoin._unlike(node(a), node(c), percent)
    assert ruled_out > 160


def test_other_limits_and_copies_of_a_common_passage(spark, monkeypatch):
    """Unlike sets that share a long passage fall to the sketches; groups of near copies stay whole."""
    monkeypatch.setattr(setjoin, "BLOCK", 9)
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 200))) for _ in range(120)]
    texts += near_copies(9, 50, 90, 12) + near_copies(10, 50, 300, 30) + [f"{t} tail" for t in texts[:30]]
    docs = list(enumerate(texts))
    got = setjoin.grouped(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(docs, 80, 5)


def test_marks_lose_no_hash(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "MARK_ROWS", 64)
    rows = spark.range(20_000).selectExpr("id", "xxhash64(id) AS hash")
    marked = setjoin.with_mark(rows, rows.where("id < 300").select("hash")).where("marked")
    assert marked.where("id < 300").count() == 300 and marked.count() < 3_000
    assert marked.columns == ["id", "hash", "marked"]


@pytest.mark.parametrize("mark_rows", [1, 1 << 18])
def test_one_row_of_each_group_stays(spark, monkeypatch, mark_rows):
    """Also where every row is marked. Rows that stay anyway do not go through Python or a shuffle again."""
    monkeypatch.setattr(setjoin, "MARK_ROWS", mark_rows)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "own") for i, t in enumerate(texts)]
    rows += [(100, texts[3], "copy"), (101, texts[3] + " more", "near"), (5, texts[5], "repeated"), (None, texts[6], "null id")]
    rows += [(102, "", "empty"), (102, None, "empty"), (7, texts[7].upper(), "same id and set")]
    rows += [(None, "x " + texts[0][::-1], "alone"), (None, "", "empty")]
    out = setjoin.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert out.columns == ["doc_id", "text", "lang"]
    assert sorted(r["doc_id"] for r in got if r["lang"] not in ("empty", "alone")) == list(range(40))
    assert sorted(r["lang"] for r in got if r["lang"] in ("empty", "alone", "copy", "near", "null id")) == ["alone", "empty", "empty", "empty"]


def test_tasks_send_sets_in_small_runs(monkeypatch):
    """A batch of many texts leaves as several batches, however many rows it has; texts are hashed in small slices."""
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, texts[0], None, "a b"])], ["text"])
    whole = {setjoin.set_key(e): e.view("int64").tolist() for _, e in setjoin.sets_of(batch.column(0), 4) if len(e)}
    sizes, seen = [], textkit.slices
    monkeypatch.setattr(setjoin, "ROWS", 100)
    monkeypatch.setattr(setjoin, "SLICE_BYTES", 2000)
    monkeypatch.setattr(textkit, "slices", lambda *a: ((sizes.append(len(v)), (r, v, o))[1] for r, v, o in seen(*a)))
    out = list(setjoin._whole_sets(4)(iter([batch])))
    assert len(out) > 10 and max(len(b.column(1).flatten()) for b in out) < 200
    assert {k: e for b in out for k, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)} == whole
    assert max(sizes) <= 2000
