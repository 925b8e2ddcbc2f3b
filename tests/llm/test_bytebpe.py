import base64
import hashlib
import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from faultline.llm import bytebpe, textkit

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def coder():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    pool = ["'", "s", "re", "ll", "ve", "d", "t", "m", " ", "  ", "\n", "\t", "é", "漢", "𝒳", "12", "²", "!", "'s", " 's", "　", "\x85", "\x1c", "A"]
    out = [None, "", " ", "'", "'s", "x's'll", " 's", "\n're", "'stand", "a  b", "a \n b ", "<|endoftext|>", "ab" * 3000, "!" * 500]
    return out + ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(3000)]


def test_pretokens_are_those_of_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    all_texts = texts()
    for row, values, offsets in textkit.slices(pa.array(all_texts), 3000):
        starts = bytebpe.pretoken_starts(values, offsets)
        for i in range(len(offsets) - 1):
            mine = starts[(starts >= offsets[i]) & (starts < offsets[i + 1])]
            got = [bytes(values[a:b]) for a, b in zip(mine, [*mine[1:], offsets[i + 1]][:len(mine)], strict=True)]
            assert got == [m.encode() for m in pattern.findall(all_texts[row + i] or "")], all_texts[row + i]


def test_ids_and_bytes_against_the_library(spark):
    """Small chunks, nulls, repeated rows and an extra column named like a result."""
    rows = [(i % 900 or None, t, "x") for i, t in enumerate(texts() + texts()[:20])]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    d.write.mode("overwrite").parquet(path := spark.conf.get("spark.checkpoint.dir") + "/bpe-input")
    d = spark.read.parquet(path)
    out = bytebpe.decode(bytebpe.encode(d, PATH, 2000, 5), PATH).collect()
    enc = coder()
    want = sorted((r[0] or -1, enc.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows)
    assert sorted((r.doc_id or -1, np.frombuffer(r["ids"], "<u4").tolist(), bytes(r.decoded)) for r in out) == want
    assert all(r.n_tokens * 4 == len(r["ids"]) for r in out)


def test_long_text_and_forgotten_words(spark, monkeypatch):
    monkeypatch.setattr(bytebpe._encode_words, "__defaults__", (3,))
    rows = [(1, "word after word, " * 80_000), (2, "some other words"), (3, "é" * 300_000)]
    path = spark.conf.get("spark.checkpoint.dir") + "/bpe-long"
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(path)
    out = bytebpe.decode(bytebpe.encode(spark.read.parquet(path), PATH, 5000, 2), PATH).collect()
    enc = coder()
    assert {r.doc_id: np.frombuffer(r["ids"], "<u4").tolist() for r in out} == {i: enc.encode_ordinary(t) for i, t in rows}
    assert {r.doc_id: bytes(r.decoded) for r in out} == {i: t.encode() for i, t in rows}


def test_input_that_changes_between_two_reads_ends_the_job(spark):
    def texts(batches):
        for batch in batches:
            words = [str(time.time_ns()) for _ in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words)], ["doc_id", "text"])

    with pytest.raises(Exception, match="changed between two reads"):
        bytebpe.encode(spark.range(1).mapInArrow(texts, "doc_id long, text string"), PATH).collect()


def test_empty_table(spark):
    assert bytebpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_over_the_whole_table(spark, small):
    enc = coder()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in bytebpe.op9_byte_bpe(spark, small).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = enc.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_classes_take_little_memory():
    """A list of all code points as characters once took more than 100 MB in every worker."""
    tracemalloc.start()
    try:
        table = bytebpe.classes.__wrapped__()
        assert tracemalloc.get_traced_memory()[1] < 30 << 20
    finally:
        tracemalloc.stop()
    assert [table[ord(c)] for c in "é1\x85!"] == [bytebpe.LETTERS, bytebpe.NUMBERS, bytebpe.SPACES, bytebpe.OTHER]
    assert not table[0xD800:0xE000].any()


def test_round_trip_decodes_where_it_assembles(spark, capsys):
    """A task that chains two steps in Python keeps two workers, and these stay."""
    path = spark.conf.get("spark.checkpoint.dir") + "/bpe-fused"
    rows = [(i or None, t) for i, t in enumerate(texts()[:400])]
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(path)
    d = spark.read.parquet(path)
    bytebpe.round_trip(d).explain()
    steps = [line.split("- ")[-1].split("(")[0] for line in capsys.readouterr().out.splitlines()]
    steps = [s for s in steps if not s.lstrip("*(0123456789) ").startswith(("Project", "ColumnarToRow"))]
    assert sum("MapInArrow" in s for s in steps) == 4
    assert not any("MapInArrow" in a and "MapInArrow" in b for a, b in zip(steps, steps[1:]))
    key = lambda r: (r.doc_id or -1, bytes(r.ids))
    both = [sorted(out.collect(), key=key) for out in (bytebpe.encoded_and_decoded(d, PATH, 2000, 3), bytebpe.decode(bytebpe.encode(d, PATH), PATH))]
    assert both[0] == both[1] and len(both[0]) == len(rows)
