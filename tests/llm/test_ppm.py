import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultline.llm import ppm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def plain_model(texts):
    """Log10 probability of a text, from dictionaries of counts, symbol by symbol."""
    counts = [defaultdict(Counter) for _ in range(4)]
    deep = defaultdict(Counter)

    def steps(text):
        data = list(lowered(text).encode()) + [ppm.END]
        kinds = [ppm.BOUNDARY] * 3 + [int(ppm.CLASSES[b]) for b in data]
        before = [ppm.END] * 4 + data
        for i, b in enumerate(data):
            yield tuple(before[i:i + 4]), tuple(kinds[i:i + 3]), b

    for text in texts:
        for last, context, b in steps(text):
            deep[last][b] += 1
            for k in range(4):
                counts[k][context[3 - k:]][b] += 1

    def classed(context, b):
        gone, p = set(), 1.0
        for k in (3, 2, 1, 0):
            seen = {s: n for s, n in counts[k][context[3 - k:]].items() if s not in gone}
            n, q = sum(seen.values()), len(seen)
            if b in seen:
                return p * seen[b] / (n + q)
            if q:
                p *= q / (n + q)
                gone |= set(seen)
        return p / (256 - len(gone))

    def score(text):
        total = 0.0
        for last, context, b in steps(text):
            seen = deep.get(last, {})
            n, q = sum(seen.values()), len(seen)
            if b in seen:
                p = seen[b] / (n + q)
            elif q:
                p = q / (n + q) * classed(context, b) / sum(classed(context, s) for s in range(256) if s not in seen)
            else:
                p = classed(context, b)
            total += math.log10(p)
        return total

    return score


def brute(docs):
    learn = [t for d, t in docs if not is_held(d)]
    words = Counter(w for t in learn for w in [*WORD.findall(lowered(t)), None])
    n, v = sum(words.values()), len(words)
    model = plain_model(learn)
    out = []
    for d, t in docs:
        tokens = [*WORD.findall(lowered(t)), None]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((d, is_held(d), len(tokens), sum(words[w] > 0 for w in tokens), n, base, model(t)))
    return out


def same(got, want):
    key = lambda r: repr(r[:4]) + f"{r[5]:.4f}"
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-5)


def test_against_plain_counts(spark):
    """Small chunks, nulls, empty texts, repeated rows, and columns named like the results."""
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("the cat éa 12 x, A\n. 漢").strip() or "zz" for _ in range(rng.randrange(40)))) for i in range(120)]
    docs += [(None, "the cat"), (200, None), (201, ""), *docs[:5]]
    d = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, score double")
    d.write.mode("overwrite").parquet(path := spark.conf.get("spark.checkpoint.dir") + "/ppm-input")
    same(ppm.score(spark.read.parquet(path), 300).collect(), brute(docs))


def test_probabilities_add_up_to_one(spark):
    docs = spark.createDataFrame([("abracadabra é",), ("abc",), (None,)], "text string")
    assert np.allclose((10 ** ppm.train(docs).logs.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_empty_table(spark):
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_over_the_whole_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = ppm.op6_ppm(spark, small).collect()
    same(got, brute(docs))
    held = [r for r in got if r.held_out]
    print("held out", sum(r.score for r in held), sum(r.base_score for r in held))
