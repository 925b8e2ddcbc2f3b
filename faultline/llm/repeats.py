"""Exact substring repeats from the common-prefix intervals of enhanced suffix arrays.

A suffix array of the corpus is built in parts. Anchors are chosen from the text alone: the smallest hash of a
32-byte gram in every window of 169 grams, so each 200-byte string holds an anchor, and equal strings hold it
at the same place. Anchors are shuffled by their hash; those that occur once are done with. For the others the
text around the anchor (168 bytes before, 200 from it on) is shuffled by the hash, so all suffixes that begin
with one gram meet: together they are one interval of the suffix array. It is sorted, common prefixes of
neighbours are measured, and a stack scan yields the tree of common-prefix intervals. Within an interval the
occurrences are sorted by what stands before them; where this left extension is not the same for all, the
interval is split by it in the same way. A (left, right) extension of at least 200 bytes together is a repeat
with all its occurrences, and each occurrence is covered by every such repeat that it is part of.

Texts that occur more than once are repeats as a whole and are known from a count per text; among the
contexts of one anchor equal contexts are one entry, and their occurrences are handed on at once. An anchor of
very many occurrences is split: strings that begin near it are grouped by the 116 bytes from it on, the others
by the 85 bytes before it with its gram, so only contexts that share such a long part meet in a task.

Cases: null and empty texts have nothing removed; texts under 200 bytes neither; repeated rows repeat each
other. Texts are told apart by a 64-bit hash; all other comparisons are on bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import textkit
from faultline.llm.decontaminate import merged
from faultline.sources.storage import materialized

LENGTH = 200
GRAM = 32
#: Occurrences of one anchor that may meet in a task; anchors with more are split by longer parts.
GROUP = 50_000
#: Contexts that a task hands on at once.
PORTION = 10_000


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place; ``size`` is a power of two."""
    h = textkit.BYTE_KEYS[values]
    step = 1
    while step < size:
        h = textkit.mix(h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]) if len(h) > step else h[:0]
        step *= 2
    return h


def anchors(values: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of one text; every ``length`` bytes hold one (the first of the smallest)."""
    width = length - gram + 1
    h = gram_hashes(values, gram)
    if len(h) < width:
        return np.zeros(0, np.int64), h[:0]
    # Minimum of (hash, place) over every window, by doubling.
    places = np.arange(len(h))
    best, at, size = h, places, 1
    while size < width:
        step = min(size, width - size)
        n = len(best) - step
        later = best[step:] < best[:n]
        best, at = np.where(later, best[step:], best[:n]), np.where(later, at[step:], at[:n])
        size += step
    at = np.unique(at)
    return at, h[at]


def _anchor_rows(length: int, gram: int):
    return lambda batches: (_anchors_of(batch, length, gram) for batch in batches)


def _anchors_of(batch: pa.RecordBatch, length: int, gram: int) -> pa.RecordBatch:
    values, offsets = textkit.buffers(batch.column(1))
    hashes, places, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
    for i in range(len(offsets) - 1):
        at, h = anchors(values[offsets[i]:offsets[i + 1]], length, gram)
        hashes.append(h)
        places.append(at)
        counts.append(len(at))
    keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts).astype(np.int64)))
    return pa.RecordBatch.from_arrays(
        [pa.array(textkit.signed(np.concatenate(hashes))), keys, pa.array(np.concatenate(places).astype(np.int32))], ["anchor", "key", "at"]
    )


def _context_rows(length: int, gram: int):
    """Contexts of the repeated anchors of each text: before and from the anchor on, cut at the ends of the text."""
    reach = length - gram
    half = reach // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: list[tuple] = []
            for key, text, wanted, hot in zip(*(batch.column(c) for c in range(4)), strict=True):
                key, wanted = key.as_py(), wanted.values
                if key == last or wanted is None or not len(wanted):
                    continue
                last = key
                if len(out) >= PORTION:
                    yield _context_batch(out)
                    out = []
                values = np.frombuffer(memoryview(text.as_buffer()), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                at, h = anchors(values, length, gram)
                h = textkit.signed(h)
                keep = np.isin(h, wanted.to_numpy(zero_copy_only=False))
                spread = np.isin(h, hot.values.to_numpy(zero_copy_only=False)) if hot.is_valid and len(hot.values) else np.zeros(len(h), bool)
                raw = values.tobytes()
                for a, x, s in zip(at[keep].tolist(), h[keep].tolist(), spread[keep].tolist(), strict=True):
                    if not s:
                        out.append((x, key, a, raw[max(0, a - reach):a][::-1], raw[a:a + length]))
                        continue
                    # Strings that begin up to half the reach before the anchor share a long right part, the others a
                    # long left part; each part is a group of its own.
                    if len(raw) - a >= length - half:
                        core = b"R" + raw[a:a + length - half]
                        out.append((part_hash(core), key, a, raw[max(0, a - half):a][::-1], raw[a:a + length]))
                    if a > half:
                        core = b"L" + raw[a - half - 1:a + gram]
                        out.append((part_hash(core), key, a, raw[max(0, a - reach):a][::-1], raw[a:a + length - half - 1]))
            yield _context_batch(out)

    return run


def part_hash(core: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True)


def _context_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], ["anchor", "key", "at", "before", "after"]
    )


def common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common prefix length of neighbouring rows of a padded byte matrix."""
    different = rows[1:] != rows[:-1]
    first = np.where(different.any(axis=1), different.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


def shared_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of a sorted list by a stack scan; only of ``least`` or more."""
    out, stack = [], []
    for i, value in enumerate([*lcp.tolist(), -1]):
        left = i
        while stack and stack[-1][0] > value:
            size, left = stack.pop()
            out.append((size, left, i))
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, left))
    return out


def matrix(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(c) for c in column])
    return np.frombuffer(b"".join(c.ljust(width, b"\0") for c in column), np.uint8).reshape(len(column), width), sizes


def right_intervals(before: list[bytes], after: list[bytes], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(common length, members, their common left lengths) of the intervals around one anchor.

    Members are sorted by what stands before them (``before`` is reversed), so their left lengths are those of
    neighbours.
    """
    reach = length - gram
    right, right_sizes = matrix(after, length)
    left, left_sizes = matrix(before, reach)
    order = np.array(sorted(range(len(after)), key=after.__getitem__))
    rank = np.empty(len(before), np.int64)
    rank[sorted(range(len(before)), key=before.__getitem__)] = np.arange(len(before))
    for size, first, last in intervals(common(right[order], right_sizes[order]), max(gram, length - reach)):
        members = order[first:last + 1]
        members = members[np.argsort(rank[members])]
        yield size, members, common(left[members], left_sizes[members])


def maximal_repeats(before: list[bytes], after: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left, right, members) of the repeats around one anchor, each with all its occurrences.

    Each right interval is split by its left extensions: if they are the same for all members, that is one
    repeat; otherwise every left interval is one.
    """
    for size, members, shared in right_intervals(before, after, length, gram):
        for left, a, b in intervals(shared, max(0, length - size)):
            yield left, size, members[a:b + 1]


def covered(before: list[bytes], after: list[bytes], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each context and each distance before the anchor: whether the string from there on is a repeat.

    Of the repeats in one right interval that hold an occurrence, the one with the longest left extension
    covers the others, and its length is the larger one of the two neighbours' common lengths.
    """
    out = np.zeros((len(before), length - gram + 2), np.int32)
    for size, members, shared in right_intervals(before, after, length, gram):
        longest = np.maximum(np.append(shared, 0), np.append(0, shared))
        wide = longest >= length - size
        out[members[wide], length - size] += 1
        out[members[wide], longest[wide] + 1] -= 1
    return np.cumsum(out, axis=1)[:, :-1] > 0


def _repeat_ranges(length: int, gram: int):
    """(key, first window, last window) of every occurrence of a repeat."""

    def close(contexts: list, owners: list) -> list[tuple[int, int, int]]:
        if len(contexts) < 2:
            return []
        if len(contexts) > 2:
            marked = covered([c[0] for c in contexts], [c[1] for c in contexts], length, gram)
        else:
            marked = np.zeros((2, length - gram + 1), bool)
            left, right = (shared_length(contexts[0][c], contexts[1][c]) for c in (0, 1))
            if right >= gram:
                marked[:, length - right:left + 1] = True
        out = []
        for owner, row in zip(owners, marked, strict=True):
            if owner:
                edges = np.flatnonzero(np.diff(row.astype(np.int8), prepend=0, append=0)).tolist()
                out += [(owner[0], owner[1] - far + 1, owner[1] - near) for near, far in zip(edges[::2], edges[1::2], strict=True)]
        return out

    def whole(key: int, at: int, before: bytes, after: bytes) -> tuple[int, int, int]:
        return key, at - len(before), at + len(after) - length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A context that occurs again is a repeat as a whole; its occurrences are handed on at once and not held.
        group, contexts, owners, last = None, [], [], None
        for batch in batches:
            made = []
            for anchor, key, at, before, after in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if anchor != group:
                    made += close(contexts, owners)
                    group, contexts, owners, last = anchor, [], [], None
                if contexts and contexts[-1] == (before, after):
                    if (key, at) != last:
                        if owners[-1]:
                            made.append(whole(*owners[-1], before, after))
                            owners[-1] = None
                        made.append(whole(key, at, before, after))
                else:
                    contexts.append((before, after))
                    owners.append((key, at))
                last = (key, at)
            yield _range_batch([m for m in made if m[1] <= m[2]])
        yield _range_batch(close(contexts, owners))

    return run


def _range_batch(made: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()),
    ], ["key", "first", "last"])


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, ends, copies in zip(batch.column(1), *(batch.column(c) for c in (2, 3, 4)), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                size = len(raw)
                if copies.as_py() and size >= length:
                    spans = [(0, size)]
                elif starts.is_valid:
                    first = np.array(starts.values.to_numpy(zero_copy_only=False))
                    last = np.array(ends.values.to_numpy(zero_copy_only=False)) + length
                    spans = list(zip(*(x.tolist() for x in merged(first, last)), strict=True))
                else:
                    spans = []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((size, size - len(left), len(spans), hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(3)), pa.array([r[3] for r in rows], pa.string()),
            ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, first, last): runs of starts of strings of ``length`` that also start elsewhere; docs holds key and text."""
    rows = docs.select("key", "text").mapInArrow(_anchor_rows(length, gram), "anchor long, key long, at int")
    again = materialized(
        rows.repartition("anchor").sortWithinPartitions("anchor", "key", "at")
        .mapInArrow(textkit.repeated_runs(["anchor", "key", "at"]), "anchor long, key long, at long").select("anchor", "key")
    )
    many = again.groupBy("anchor").count().where(F.col("count") > GROUP).select("anchor", F.lit(True).alias("many"))
    wanted = again.join(many, "anchor", "left").groupBy("key").agg(
        F.collect_set("anchor").alias("wanted"), F.collect_set(F.when(F.col("many"), F.col("anchor"))).alias("hot")
    )
    contexts = docs.join(wanted, "key", "left").select("key", "text", "wanted", "hot").mapInArrow(
        _context_rows(length, gram), "anchor long, key long, at long, before binary, after binary"
    )
    return contexts.repartition("anchor").sortWithinPartitions("anchor", "after", "before", "key", "at").mapInArrow(
        _repeat_ranges(length, gram), "key long, first long, last long"
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    ranges = repeated_ranges(docs, length, gram).groupBy("key").agg(
        F.collect_set(F.struct("first", "last")).alias("found")
    ).select("key", F.col("found.first").alias("first"), F.col("found.last").alias("last"))
    copies = docs.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("copies"))
    joined = docs.join(ranges, "key", "left").join(copies, "key", "left")
    return joined.select("doc_id", "text", "first", "last", "copies").mapInArrow(
        _removed(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
