"""Benchmark decontamination by winnowing.

Texts become words. Every sliding window of k-word hashes gives its minimum (the last one on ties) as a
fingerprint, so two texts that share ``window`` words in a row always share a fingerprint at the same place of
that span. Fingerprints of the documents are looked up among those of the benchmark, and every meeting is
extended word by word in both directions; spans of at least ``window`` words are hits. Items of fewer words
count as one window of their own length and are found by the hash of the whole item.

The benchmark is taken in blocks of bounded size; each block is broadcast and all documents pass it once, so
a benchmark of any size works, and the usual small one needs one pass. Spans found for a document in several
blocks are united by document.

Cases: null and empty texts have no words and no hits; repeated rows and items get the same result each; an
empty benchmark hits nothing. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import textkit

WINDOW = 10
GRAM = 5
#: Bytes of benchmark text (and rows) that one broadcast block may hold.
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 100_000
#: Bytes of texts that the filter hashes and sends at once.
KEPT_BYTES = 1 << 18
PAD = np.uint64(0x0123456789ABCDEF)


def window_minima(g: np.ndarray, width: int) -> np.ndarray:
    """Places of the minimum of every window of ``width`` neighbours, the last one on ties; sorted, each once."""
    if len(g) < width:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(g, width)
    best = views[:, width - 1].copy()
    at = np.full(len(views), width - 1)
    for j in range(width - 2, -1, -1):
        lower = views[:, j] < best
        best[lower], at[lower] = views[lower, j], j
    return np.unique(at + np.arange(len(views)))


def fingerprints(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word number of the fingerprints of all texts; none of them spans two texts."""
    spaced, place = spread(hashes, first, window)
    g = textkit.grams(spaced, gram)
    at = window_minima(g, window - gram + 1)
    text = np.searchsorted(first, place[at], side="right")
    end = place[np.minimum(at + gram - 1, len(place) - 1)]
    inside = (place[at] >= 0) & (end >= 0)
    inside[inside] = text[inside] == np.searchsorted(first, end[inside], side="right")
    return g[at[inside]], place[at[inside]]


def spread(hashes: np.ndarray, first: np.ndarray, gap: int, side: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The words with ``gap`` distinct pads between texts, and the word number at each place (-1 for pads).

    Pads of different sides differ, so that they never match.
    """
    sizes = np.diff(first)
    total = len(hashes) + gap * (len(sizes) + 1)
    shift = np.repeat(gap * (1 + np.arange(len(sizes))), sizes)
    at = np.arange(len(hashes)) + shift
    out = textkit.mix(PAD + np.arange(side << 40, (side << 40) + total, dtype=np.uint64))
    place = np.full(total, -1)
    out[at], place[at] = hashes, np.arange(len(hashes))
    return out, place


class Block:
    """Lookup tables of some benchmark items."""

    def __init__(self, ids: list, texts: list, window: int, gram: int) -> None:
        hashes, first = textkit.words(*textkit.buffers(pa.array(texts, pa.string())), textkit.ALPHANUMERIC)
        self.ids = [None if i is None else str(i) for i in ids]
        self.window, self.gram = window, gram
        sizes = np.diff(first)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, window):
            rows = np.flatnonzero(sizes == n)
            if len(rows):
                keys = textkit.grams(hashes, n)[first[rows]]
                order = np.argsort(keys, kind="stable")
                self.short[n] = keys[order], rows[order]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.hashes, place = spread(hashes, first, window, 1)
        self.owner = np.where(place >= 0, owner[np.maximum(place, 0)], -1) if len(owner) else np.full(len(place), -1)
        back = np.zeros(len(hashes), np.int64)
        back[place[place >= 0]] = np.flatnonzero(place >= 0)
        keys, at = fingerprints(hashes, first, window, gram)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], back[at[order]]

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start word, end word (exclusive) and item row of every hit span."""
        found = [(np.zeros(0, np.int64),) * 3]
        spaced, place = spread(hashes, first, self.window)
        back = np.zeros(len(hashes), np.int64)
        back[place[place >= 0]] = np.flatnonzero(place >= 0)
        keys, at = fingerprints(hashes, first, self.window, self.gram)
        left, right = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        met = right > left
        at, left, many = back[at[met]], left[met], (right - left)[met]
        # Meetings are extended in portions, so that a passage of many items needs no large arrays.
        stops = np.searchsorted(np.cumsum(many), np.arange(100_000, many.sum() + 100_000, 100_000)) + 1 if len(many) else []
        begin = 0
        for stop in np.unique(np.minimum(stops, len(many))) if len(many) else []:
            n = many[begin:stop]
            here = np.repeat(at[begin:stop], n)
            other = self.at[np.repeat(left[begin:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            begin = stop
            reach = self.window - self.gram
            same = np.stack([spaced[here + j] == self.hashes[other + j] for j in range(-reach, self.window)])
            run = np.cumsum(np.vstack([np.zeros((1, len(here)), np.int64), same]), axis=0)
            full = run[self.window:] - run[:-self.window] == self.window
            for j in range(len(full)):
                ok = full[j]
                begins = place[here[ok] + j - reach]
                found.append((begins, begins + self.window, self.owner[other[ok]]))
        for n, (keys, rows) in self.short.items():
            g = textkit.grams(hashes, n)
            starts = np.arange(len(g))
            starts = starts[np.searchsorted(first, starts, "right") == np.searchsorted(first, starts + n - 1, "right")]
            left, right = np.searchsorted(keys, g[starts], "left"), np.searchsorted(keys, g[starts], "right")
            many = right - left
            begins = np.repeat(starts, many)
            found.append((begins, begins + n, rows[np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def blocks(benchmark: DataFrame, window: int, gram: int) -> Iterator[Block]:
    """The items in blocks of bounded size, read one after the other."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1]) * 2
        if size >= BLOCK_BYTES or len(ids) >= BLOCK_ROWS:
            yield Block(ids, texts, window, gram)
            ids, texts, size = [], [], 0
    yield Block(ids, texts, window, gram)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover the given ones; touching spans become one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1]) if len(starts) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:] - 1, len(starts) - 1)] if len(at) else reach[:0]


def scan(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, text_hash, n_words, starts, ends, items) of every document against one block."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            for row, values, offsets in textkit.slices(batch.column(2)):
                hashes, first = textkit.words(values, offsets, textkit.ALPHANUMERIC)
                starts, ends, rows = b.hits(hashes, first)
                text = np.searchsorted(first, starts, "right") - 1
                order = np.argsort(text, kind="stable")
                cut = np.searchsorted(text[order], np.arange(len(first)))
                spans, items = [], []
                for i in range(len(first) - 1):
                    mine = order[cut[i]:cut[i + 1]]
                    s, e = merged(starts[mine], ends[mine])
                    spans.append(((s - first[i]).tolist(), (e - first[i]).tolist()))
                    items.append(sorted({b.ids[k] for k in np.unique(rows[mine])} - {None}))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(row, len(first) - 1) for c in (0, 1)), pa.array(np.diff(first)),
                    pa.array([s for s, _ in spans], pa.list_(pa.int64())), pa.array([e for _, e in spans], pa.list_(pa.int64())),
                    pa.array(items, pa.list_(pa.string())),
                ], ["doc_id", "text_hash", "n_words", "starts", "ends", "items"])

    return docs.mapInArrow(run, f"doc_id {id_type}, text_hash long, n_words long, starts array<long>, ends array<long>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, items (sorted ids), contaminated.

    One block: one pass without a shuffle. More blocks: one pass each, then one row per document by its id
    and text, so that repeated rows stay apart from different texts of the same id.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    parts = [scan(keyed, block) for block in blocks(benchmark, window, gram)]
    parts = [p.withColumn("spans", F.arrays_zip("starts", "ends")).drop("starts", "ends") for p in parts]
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.groupBy("doc_id", "text_hash").agg(
            (F.count("*") / len(parts)).cast("int").alias("copies"), F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"),
        ).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    # In order of their starts, spans add what they reach beyond the earlier ones.
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["ends"] - F.greatest(x["starts"], a["to"]))).alias("n"),
            F.greatest(a["to"], x["ends"]).alias("to"),
        ),
    )["n"]
    items = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", covered.alias("n_hit"), items.alias("items"), (covered > 0).alias("contaminated"))


def _without(shared, at: int):
    """The rows without a hit. A slice of rows at a time, so that neither the task nor the reader of its rows holds a
    second whole batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values, offsets in textkit.slices(batch.column(at), KEPT_BYTES):
                hashes, first = textkit.words(values, offsets, textkit.ALPHANUMERIC)
                keep = np.ones(len(first) - 1, bool)
                keep[np.searchsorted(first, shared.value.hits(hashes, first)[0], "right") - 1] = False
                yield batch.slice(row, len(keep)).filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` without a hit; every block of the benchmark filters what the earlier ones left."""
    at = docs.columns.index("text")
    for block in blocks(benchmark, window, gram):
        docs = docs.mapInArrow(_without(docs.sparkSession.sparkContext.broadcast(block), at), docs.schema)
    return docs


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a passage of a benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
