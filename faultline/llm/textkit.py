"""Vectorised reading of Arrow text columns: bytes, word bounds and 64-bit hashes.

Everything here works on slices of about a megabyte of whole texts, so that the arrays of a task stay
small whatever the size of a batch; one text is never split.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(int(_rng.integers(1, 2**62)) * 4 + 3)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: Bytes that belong to a word, for the two word definitions in use.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return values[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, bytes, offsets) of runs of rows with about ``limit`` bytes together."""
    values, offsets = buffers(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, max(first + 1, last))
        part = offsets[first:last + 1]
        yield first, values[part[0]:part[-1]], part - part[0]
        first = last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        steps = np.full(size, BASE, np.uint64)
        steps[0] = 1
        back = np.full(size, INVERSE, np.uint64)
        back[0] = 1
        _powers.clear()
        _powers[size] = np.cumprod(steps), np.cumprod(back)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(values: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the joined bytes, and the first word number of each text (one more at the end)."""
    flags = np.zeros(len(values) + 2, np.int8)
    flags[1:-1] = inside[values]
    edge = flags[1:] != flags[:-1]
    # A text that ends inside a word and one that begins inside a word touch each other.
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(values))])
    cuts = cuts[(flags[cuts] == 1) & (flags[cuts + 1] == 1)]
    places = np.flatnonzero(edge)
    starts, ends = places[0::2], places[1::2]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    forward, back = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[values] * forward[:len(values)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * back[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(values: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words after lowering A-Z, and the first word number of each text."""
    lowered = LOWER[values]
    starts, ends, first = word_bounds(lowered, offsets, inside)
    return hash_spans(lowered, starts, ends), first


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of n consecutive words at each place of the joined word list (shorter by n - 1)."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, np.uint64(0x9E3779B97F4A7C15 + 2 * int(seed)), np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[j:j + size])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def repeated_runs(names: list[str]):
    """Task over sorted whole-number rows: the rows whose first column is shared by a different row, each once."""

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, c].copy()) for c in range(len(names))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_run = np.zeros((0, len(names)), np.int64), None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(len(names))], axis=1)
            rows = np.vstack([held, rows])
            if not len(rows):
                continue
            rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]
            same = np.append(False, rows[1:, 0] == rows[:-1, 0])
            same[0] = len(held) > 0 and open_run == rows[0, 0]
            keep = same | np.append(same[1:], False)
            if len(rows) > 1:
                yield batch_of(rows[:-1][keep[:-1]])
            held = rows[-1:]
            open_run = rows[-1, 0] if same[-1] else None
        if open_run is not None:
            yield batch_of(held)

    return run


def numbered(batches: Iterator[pa.RecordBatch]) -> tuple[Iterator[pa.RecordBatch], int]:
    """The batches, and a base for chunk numbers from the partition number in their third column."""
    first = next((b for b in batches if b.num_rows), None)
    return (chain([first], batches), first.column(2)[0].as_py() << 32) if first else (iter(()), 0)


def shielded(docs: DataFrame) -> DataFrame:
    """``docs`` with a prefix before every column name, so that no column clashes with an added one."""
    return docs.toDF(*[f"in_{c}" for c in docs.columns])


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the shielded table under their own names."""
    return rows.select(*[F.col(f"in_{c}").alias(c) for c in columns])
