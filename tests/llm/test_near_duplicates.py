"""The near-duplicate stage: its own limits, and survivors by component."""

import corpus_pipeline
from faultline.llm import setjoin

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(name, n):
    return [f"{name}{i}" for i in range(n)]


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)


def similarity(a, b, n):
    x, y = ({tuple(t[i:i + n]) for i in range(len(t) - n + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_pairs_between_the_limits_of_op10_and_of_the_stage(spark):
    """Rewritten ends of 9 % to 11 % and scattered edits: similar at 5 words and 0.8, not at 4 words and 0.85."""
    rows, left = [], []
    for k, (n, changed) in enumerate([(200, 18), (200, 20), (204, 22), (1000, 100)]):
        a = words(f"e{k}x", n)
        b = a[:n - changed] + words(f"f{k}x", changed)
        assert similarity(a, b, 5) >= 0.8 and similarity(a, b, 4) < 0.85
        rows += [(10 * k, " ".join(a)), (10 * k + 1, " ".join(b))]
        left.append(10 * k)
    a = words("s", 470)
    b = [f"t{i}" if i % 47 == 20 else w for i, w in enumerate(a)]
    assert similarity(a, b, 5) >= 0.8 and similarity(a, b, 4) < 0.85
    # Rewritten by more than a ninth: both stay.
    c = words("g", 200)
    d = c[:176] + words("h", 24)
    assert similarity(c, d, 5) < 0.8
    rows += [(100, " ".join(a)), (101, " ".join(b)), (110, " ".join(c)), (111, " ".join(d))]
    assert [i for i, _ in kept(spark, rows)] == sorted([*left, 100, 110, 111], key=repr)


def test_signatures_meet_at_the_limit_of_the_stage():
    import numpy as np

    rng = np.random.default_rng(2)
    for size in [1, 4, 5, 8, 9, 10, 13, 36, 45, 90, 200, 450]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            gone = rng.integers(0, len(a) // 5 + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, rng.integers(0, len(a) // 9 + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                assert np.intersect1d(setjoin.signatures(a, 80), setjoin.signatures(b, 80)).size
