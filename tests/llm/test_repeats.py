import hashlib
import random
from collections import Counter

import pytest

from faultline.llm import repeats


def brute(docs, length):
    """Every string of the length, counted over all starts."""
    texts = [(d, (t or "").encode()) for d, t in docs]
    counts = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                hit[i:i + length] = b"\x01" * length
        spans = sum(hit[i] and not (i and hit[i - 1]) for i in range(len(t)))
        kept = bytes(b for b, h in zip(t, hit, strict=True) if not h)
        out.append((d, len(t), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [50_000, 3])
def test_against_all_strings(spark, monkeypatch, group):
    """Copies, near copies, shifted passages, periodic texts, nulls, repeated rows; also with spread anchors."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [word(rng.randrange(30, 160)) for _ in range(8)]
    docs = [(i, "".join(rng.choice([*passages, word(rng.randrange(1, 40))]) for _ in range(rng.randrange(7)))) for i in range(80)]
    base = word(400)
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(400)] = rng.choice("XYZ")
        docs.append((100 + i, "".join(copy)[rng.randrange(30):]))
    docs += [(200, "ab" * 150), (201, "abc" * 80), (202, None), (203, ""), (None, base), (204, "z" * 70), (5, docs[5][1]), *docs[7:9]]
    d = spark.createDataFrame([(*r, b"x") for r in docs], "doc_id long, text string, key binary")
    got = repeats.without_repeats(d, 60, 8).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, 60)


def test_stack_scan_gives_all_intervals():
    rng = random.Random(2)
    for _ in range(200):
        lcp = [rng.randrange(5) for _ in range(rng.randrange(1, 12))]
        want = set()
        for i in range(len(lcp)):
            for j in range(i, len(lcp)):
                m = min(lcp[i:j + 1])
                if m >= 2 and (i == 0 or lcp[i - 1] < m) and (j == len(lcp) - 1 or lcp[j + 1] < m):
                    want.add((m, i, j + 1))
        import numpy as np

        assert set(repeats.intervals(np.array(lcp), 2)) == want


def test_repeats_come_with_all_occurrences():
    """Groups against a plain search over (left, right) extensions; covered() is the union of the groups."""
    import numpy as np

    rng = random.Random(3)
    length, gram = 12, 4
    for _ in range(100):
        n = rng.randrange(3, 9)
        before = ["".join(rng.choice("ab") for _ in range(8)).encode()[:rng.choice([8, 8, 3])] for _ in range(n)]
        after = [b"abab" + "".join(rng.choice("ab") for _ in range(8)).encode()[:rng.choice([8, 8, 2])] for _ in range(n)]
        union = np.zeros((n, length - gram + 1), bool)
        for left, right, members in repeats.maximal_repeats(before, after, length, gram):
            assert left + right >= length and len(members) > 1
            assert len({(before[i][:left], after[i][:right]) for i in members}) == 1
            same = [i for i in range(n) if (before[i][:left], after[i][:right]) == (before[members[0]][:left], after[members[0]][:right])]
            assert sorted(members.tolist()) == [i for i in same if len(before[i]) >= left and len(after[i]) >= right]
            union[members, length - right:left + 1] = True
        assert (union == repeats.covered(before, after, length, gram)).all()


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_over_the_whole_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = repeats.op1_suffix_repeats(spark, small).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, 200)
    assert sum(r.n_removed for r in got) > 0
