"""Document scores by prediction by partial matching, beside an add-one unigram base.

The model predicts each byte of the lowered text, and an end symbol, from the bytes before it. Contexts are the
last four to no bytes themselves. The tables of four and three bytes grow with the corpus and stay distributed:
pairs of context and symbol are dealt by the last three bytes of the context, so a task has both tables of its
contexts. The counts of two to no bytes (at most 65,793 contexts) are broadcast. Symbols are all 256 byte values.
A symbol that a context has not seen is escaped to the next shorter one, with the escape estimate q / (n + q)
(q distinct symbols in n). From three bytes down, symbols excluded by longer contexts are left out of the counts;
from four bytes to three, what the shorter contexts give to symbols already seen goes to the others in
proportion. Below the empty context stands the uniform distribution. Counts come from all training rows.

Neighbouring whole texts form chunks. A chunk sends each of its distinct words and each of its distinct pairs of
context and symbol once, with its training count; counts are added up before and after the shuffle, a context
(at most 256 symbols) becomes log probabilities, and these return to the chunks, where they are put to the
positions again and summed by document.

Cases: null and empty texts hold only the end; a null id counts as empty text for the fold; repeated rows are
scored alike; without training rows every symbol is equally likely. Words are compared by 64-bit hashes, contexts
by their bytes. Chunks are cut twice, so the input has to be a table or files.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultline.llm import textkit
from faultline.sources.storage import materialized

CHUNK_BYTES = 4 << 20
#: Bytes of the longest contexts whose counts are broadcast, and of the longest contexts.
ORDER = 2
DEEP = 4
#: First place of the deep codes of a chunk, behind its words.
DEEP_PLACE = 1 << 30
#: Contexts whose distributions over all symbols are held at once.
DENSE = 1024
END = 0xFF
#: A byte stands for itself in every context; before a text stand end symbols.
CLASSES = np.arange(256, dtype=np.uint32)
BOUNDARY = END


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _laid_out(values: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowered texts, each after ``order`` and before one more boundary symbols, and the places to predict."""
    sizes = np.diff(offsets)
    texts = len(sizes)
    gap = order + 1
    padded = np.full(len(values) + gap * texts, END, np.uint8)
    shift = gap * np.arange(texts) + order
    padded[np.arange(len(values)) + np.repeat(shift, sizes)] = textkit.LOWER[values]
    predicted = np.ones(len(padded), bool)
    for j in range(1, order + 1):
        predicted[offsets[:-1] + shift - j] = False
    return padded, np.flatnonzero(predicted)


def codes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Short context and symbol of every byte and end, as one number each, and the first of each text."""
    padded, at = _laid_out(values, offsets, ORDER)
    kinds = CLASSES[padded]
    context = np.zeros(len(at), np.uint32)
    for j in range(ORDER, 0, -1):
        context = context << np.uint32(8) | kinds[at - j]
    return context << np.uint32(8) | padded[at], offsets + np.arange(len(offsets))


def deep_codes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes of the longest context and the symbol of every byte and end, as one number each."""
    padded, at = _laid_out(values, offsets, DEEP)
    size = max(0, len(padded) - DEEP)
    code = np.zeros(size, np.int64)
    for j in range(DEEP + 1):
        code = code << 8 | padded[j:j + size]
    return code[at - DEEP]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of every value among them, by hashing instead of sorting all of them."""
    found, known = pd.factorize(values)
    order = np.argsort(known)
    place = np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    return known[order], place[found]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, sums = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for batch in batches:
        for _, values, offsets in textkit.slices(batch.column(0)):
            new, n = np.unique(codes(values, offsets)[0], return_counts=True)
            known, back = np.unique(np.concatenate([known, new]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([sums, n])).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int64)), pa.array(sums)], ["code", "n"])


class Trie:
    """Counts of the short contexts, and log10 probabilities by exclusion down to shorter contexts."""

    def __init__(self, known: np.ndarray, counts: np.ndarray) -> None:
        symbols, contexts = known & 0xFF, known >> 8
        self.tables, self.places = [], []
        for order in range(ORDER + 1):
            seen, back = np.unique(contexts & ((1 << 8 * order) - 1), return_inverse=True)
            self.tables.append(np.bincount(back * 256 + symbols, counts, minlength=256 * len(seen)).reshape(len(seen), 256))
            place = np.full(1 << 8 * order, -1, np.int32)
            place[seen] = np.arange(len(seen))
            self.places.append(place)

    @property
    def logs(self) -> np.ndarray:
        """Log10 probabilities of all symbols in the longest of the short contexts seen."""
        seen = np.flatnonzero(self.places[ORDER] >= 0)
        return np.concatenate([np.zeros((0, 256)), *(self.below(seen[i:i + DENSE], None) for i in range(0, len(seen), DENSE))])

    def below(self, contexts: np.ndarray, longer: np.ndarray | None) -> np.ndarray:
        """Log10 probabilities of all symbols after contexts; ``longer`` has the counts of contexts one byte longer."""
        left = np.ones((len(contexts), 1))
        excluded = np.zeros((len(contexts), 256), bool)
        out = np.zeros((len(contexts), 256))
        for k in range(ORDER + (longer is not None), -1, -1):
            if k > ORDER:
                counts = longer
            else:
                place = self.places[k][contexts & ((1 << 8 * k) - 1)]
                counts = np.where((place >= 0)[:, None], self.tables[k][np.maximum(place, 0)] if len(self.tables[k]) else 0, 0) * ~excluded
            n, q = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
            total = np.maximum(n + q, 1)
            out += left * counts / total
            excluded |= counts > 0
            left = np.where(q > 0, left * q / total, left)
        free = ~excluded
        out += left * free / np.maximum(free.sum(axis=1, keepdims=True), 1)
        return np.log10(np.maximum(out, 1e-300))

    def deep_logs(self, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log10 probabilities for deep codes with their training counts.

        They are sorted by the last three bytes of the context, then by code; all symbols of these are here.
        """
        out = np.zeros(len(code))
        middle = code >> 8 & 0xFFFFFF
        start = np.flatnonzero(np.append(True, middle[1:] != middle[:-1])) if len(code) else np.zeros(0, np.int64)
        ends = np.append(start, len(code))
        for i in range(0, len(start), DENSE):
            part = slice(ends[i], ends[min(i + DENSE, len(start))])
            sizes = np.diff(ends[i:i + DENSE + 1])
            out[part] = self._deep_part(code[part], n[part], middle[start[i:i + DENSE]], np.repeat(np.arange(len(sizes)), sizes))
        return out

    def _deep_part(self, code: np.ndarray, n: np.ndarray, middle: np.ndarray, row: np.ndarray) -> np.ndarray:
        context, symbol, seen = code >> 8, code & 0xFF, n > 0
        longer = np.bincount(row * 256 + symbol, n, minlength=256 * len(middle)).reshape(len(middle), 256)
        logs = self.below(middle, longer)
        start = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(code))))
        total, kinds = np.add.reduceat(n, start)[group], np.add.reduceat(seen.astype(np.int64), start)[group]
        out = logs[row, symbol]
        escaped = ~seen & (kinds > 0)
        # What the distribution below leaves for symbols that the context has not seen.
        wanted, rest = np.unique(group[escaped]), np.ones(len(start))
        at, inside = np.full(len(start), -1), np.flatnonzero(seen)
        for i in range(0, len(wanted), DENSE):
            part = wanted[i:i + DENSE]
            at[part] = np.arange(len(part))
            left = 10.0 ** logs[row[start[part]]]
            own = inside[at[group[inside]] >= 0]
            left[at[group[own]], symbol[own]] = 0
            rest[part] = left.sum(axis=1)
            at[part] = -1
        out[escaped] += np.log10(kinds[escaped] / (total[escaped] + kinds[escaped]) / rest[group[escaped]])
        out[seen] = np.log10(n[seen] / (total[seen] + kinds[seen]))
        return out


def train(docs: DataFrame) -> Trie:
    """Counts of all training texts, added up by context and symbol before and after the shuffle."""
    rows = docs.select("text").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    return Trie(rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def _chunked(batches: Iterator[pa.RecordBatch], limit: int):
    """Chunk number and (rows, bytes, offsets) of its slices, about ``limit`` bytes together."""
    batches, base = textkit.numbered(batches)
    held, size, number = [], 0, base
    for batch in batches:
        for row, values, offsets in textkit.slices(batch.column(1)):
            held.append((batch.slice(row, len(offsets) - 1), values, offsets))
            size += len(values)
            if size >= limit:
                yield number, held
                held, size, number = [], 0, number + 1
    if held:
        yield number, held


def _words_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the slices of a chunk, and words per text."""
    out = [textkit.words(values, offsets, textkit.SPACED) for values, offsets in parts]
    return np.concatenate([h for h, _ in out]).view(np.int64), np.concatenate([np.diff(first) for _, first in out])


def _deep_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Deep codes of the slices of a chunk, and codes per text."""
    return np.concatenate([deep_codes(v, o) for v, o in parts]), np.concatenate([np.diff(o) + 1 for _, o in parts])


def _pieces(limit: int, of, place: int):
    """Distinct words or deep codes of every chunk with their counts in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _chunked(batches, limit):
            every, counts = of([part[1:] for part in held])
            learn = ~np.concatenate([np.asarray(b.column(3).to_numpy(zero_copy_only=False), bool) for b, _, _ in held])
            known, back = distinct(every)
            n = np.bincount(back, np.repeat(learn, counts), minlength=len(known)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(known), number)), pa.array(np.arange(place, place + len(known), dtype=np.int32)), pa.array(known), pa.array(n),
            ], ["chunk", "place", "code", "n"])

    return run


def _valued(shared):
    """Log probabilities of deep codes; rows are sorted, all codes of the last three bytes of a context come together."""

    def made(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(shared.value.deep_logs(*rows))], ["code", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)
        for batch in batches:
            held = np.hstack([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)])])
            if held.shape[1]:
                middle = held[0] >> 8 & 0xFFFFFF
                cut = int(np.searchsorted(middle, middle[-1]))
                yield made(held[:, :cut])
                held = held[:, cut:]
        yield made(held)

    return run


def _heads(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _chunked(batches, limit):
            text = np.concatenate([v for _, v, _ in held])
            head = {
                "doc_ids": pa.chunked_array([b.column(0) for b, _, _ in held]).to_pylist(),
                "held": pa.chunked_array([b.column(3) for b, _, _ in held]).to_pylist(),
                "sizes": np.concatenate([np.diff(o) for _, _, o in held]), "bytes": len(text), "text": pa.compress(text, "zstd", asbytes=True),
            }
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([-1], pa.int32()), pa.array([0.0]), pa.array([pickle.dumps(head)], pa.binary())],
                ["chunk", "place", "value", "head"],
            )

    return run


def _sums(id_type: pa.DataType):
    def scored(head: dict, parts: list[np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate(parts) if parts else np.zeros(0)
        raw = pa.decompress(head["text"], head["bytes"], "zstd")
        offsets = np.append(0, np.cumsum(head["sizes"]))
        column = pa.Array.from_buffers(pa.large_binary(), len(head["sizes"]), [None, pa.py_buffer(offsets), raw])
        slices = [(v, o) for _, v, o in textkit.slices(column)]
        (hashes, words), (deep, sizes) = _words_of(slices), _deep_of(slices)
        known, back = distinct(hashes)
        places, at = distinct(deep)
        if len(found) != len(known) + len(places):
            raise RuntimeError("the symbols of a chunk do not fit its texts: the input changed between two reads")
        counts, logs = found[:len(known)], found[len(known):]
        ends = np.append(0, np.cumsum(words))
        base = np.append(0.0, np.cumsum(np.log10(counts + 1.0)[back]))[ends]
        seen = np.append(0, np.cumsum((counts > 0)[back]))[ends]
        score = np.add.reduceat(logs[at], np.append(0, np.cumsum(sizes))[:-1])
        return pa.RecordBatch.from_arrays([
            pa.array(head["doc_ids"], id_type), pa.array(head["held"], pa.bool_()), pa.array(words.astype(np.int64)),
            pa.array(np.diff(seen).astype(np.int64)), pa.array(np.diff(base)), pa.array(score),
        ], ["doc_id", "held_out", "words", "known_words", "logs", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts = None, []
        for batch in batches:
            places = batch.column("place").to_numpy(zero_copy_only=False)
            values = batch.column("value").to_numpy(zero_copy_only=False)
            at = 0
            for i in [*np.flatnonzero(places < 0), len(places)]:
                if i > at:
                    parts.append(values[at:i].copy())
                at = i + 1
                if i < len(places):
                    if head:
                        yield scored(head, parts)
                    head, parts = pickle.loads(batch.column("head")[int(i)].as_py()), []
        if head:
            yield scored(head, parts)

    return run


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", "text", F.spark_partition_id().alias("part"), held_out().alias("held"))
    kind = docs.schema["doc_id"].dataType
    learning = docs.where("not held")
    trie = docs.sparkSession.sparkContext.broadcast(train(learning))
    cut = "chunk long, place int, code long, n long"
    by_word = Window.partitionBy("code")
    counted = materialized(docs.mapInArrow(_pieces(chunk_bytes, _words_of, 0), cut).select(
        "chunk", "place", F.sum("n").over(by_word).alias("c"),
        (F.row_number().over(by_word.orderBy("chunk")) == 1).alias("first"),
    ))
    deep = materialized(docs.mapInArrow(_pieces(chunk_bytes, _deep_of, DEEP_PLACE), cut))
    totals = deep.groupBy("code").agg(F.sum("n").alias("n"))
    middle = F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFFFF))
    valued = totals.repartition(middle).sortWithinPartitions(middle, "code").mapInArrow(
        _valued(trie), "code long, value double"
    )
    ends = learning.count()
    row = counted.where("first and c > 0").agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    kinds, total = row[0] + (ends > 0), row[1] + ends
    heads = docs.mapInArrow(_heads(chunk_bytes), "chunk long, place int, value double, head binary")
    back = deep.join(valued, "code").select("chunk", "place", "value").unionByName(
        counted.select("chunk", "place", F.col("c").cast("double").alias("value"))
    )
    back = back.withColumn("head", F.lit(None).cast("binary")).unionByName(heads)
    out = back.repartition("chunk").sortWithinPartitions("chunk", "place").mapInArrow(
        _sums(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, held_out boolean, words long, known_words long, logs double, score double"
    )
    below = math.log10(total + kinds + 1)
    return out.select(
        "doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"), (F.col("known_words") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(ends + 1) - (F.col("words") + 1) * below).alias("base_score"), "score",
    )


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
