"""Text quality by a generalised additive model with pairwise interactions.

Every whole text becomes a vector of shape statistics (lengths, character classes, repeated words and lines). A
feature is cut into bins at quantiles of the sample and owns a lookup table with one addition per bin. The tables
are learned by cyclic boosting: the features take turns, each fits a shallow tree over its bins to the current
gradients of the logistic loss and adds a small part of it to its table. The pairs of features whose joint trees
then promise the largest gain get tables over two coarser sets of bins, learned in the same way. A score is the
logistic function of one sum of table entries, looked up for a whole slice of texts at once.

Labels are learned from a bounded sample: at most ``SAMPLE`` labelled ids, those of the smallest hashes; statistics
of all rows are computed and every row is scored. Language, source and id are never inputs.

Cases: a null text is an empty one, and an empty text has a score like any other; an id with several labels counts
with their mean, an id with several texts with the one of the least vector; labels without a text, and rows with a
null label or id, are not learned from; a row with a null id is scored and not held out. Without any label the score
is 0.5, and with labels of one class it is near that class. Repeated rows get equal scores, further columns are untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.llm import textkit

#: Labelled ids learned from, at most.
SAMPLE = 20_000
BINS, PAIR_BINS = 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 160, 60, 10
RATE, RIDGE, LEAST_WEIGHT, DEPTH = 0.12, 1.0, 0.5, 2

FEATURES = (
    "log_bytes", "upper", "digits", "stops", "commas", "symbols", "spaces", "high_bytes", "entropy", "word_bytes",
    "word_spread", "short_words", "bare_words", "upper_words", "symbol_ends", "distinct_words", "top_word",
    "repeated_next", "words_a_line", "repeated_lines", "words_a_stop", "longest_word",
)


def _class(*codes: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


UPPER, DIGIT, HIGH = _class(*range(65, 91)), _class(*range(48, 58)), _class(*range(128, 256))
LETTER = UPPER | _class(*range(97, 123)) | HIGH
STOP, COMMA = _class(*b".!?"), _class(*b",;:'\"-()")
SPACE = ~textkit.SPACED
SYMBOL = ~(LETTER | DIGIT | STOP | COMMA | SPACE)
NO_BREAK = ~_class(0x0A)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _inside(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set flags between neighbouring bounds."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeats(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct hashes, and occurrences of the most frequent one."""
    distinct, top = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    if len(hashes):
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
        runs = np.diff(np.append(begin, len(h)))
        np.add.at(distinct, o[begin], 1)
        np.maximum.at(top, o[begin], runs)
    return distinct, top


def shape(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a slice of joined bytes."""
    texts, size = len(offsets) - 1, np.diff(offsets)
    count = {name: _inside(table[values], offsets) for name, table in (
        ("upper", UPPER), ("letter", LETTER), ("digit", DIGIT), ("stop", STOP), ("comma", COMMA), ("symbol", SYMBOL),
        ("space", SPACE), ("high", HIGH),
    )}
    owner = np.repeat(np.arange(texts), size)
    bytes_of = np.bincount(owner * 256 + values, minlength=texts * 256).reshape(texts, 256)
    p = bytes_of / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)

    starts, ends, first = textkit.word_bounds(values, offsets, textkit.SPACED)
    n, length = np.diff(first), ends - starts
    word_owner = np.repeat(np.arange(texts), n)
    hashes = textkit.hash_spans(values, starts, ends)
    distinct, top = _repeats(hashes, word_owner, texts)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, word_owner, length)
    next_same = np.append(False, (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1]))[:len(hashes)]

    def per_word(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.int64)
        np.cumsum(table[values], out=sums[1:])
        return sums[ends] - sums[starts]

    letters, uppers = per_word(LETTER), per_word(UPPER)
    mean = _share(np.bincount(word_owner, length, texts), n)
    square = _share(np.bincount(word_owner, length.astype(float) ** 2, texts), n)

    line_from, line_to, line_first = textkit.word_bounds(values, offsets, NO_BREAK)
    lines = np.diff(line_first)
    distinct_lines, _ = _repeats(textkit.hash_spans(values, line_from, line_to), np.repeat(np.arange(texts), lines), texts)

    def words_where(flags: np.ndarray) -> np.ndarray:
        return _share(np.bincount(word_owner, flags, texts), n)

    return np.stack([
        np.log1p(size), _share(count["upper"], count["letter"]), _share(count["digit"], size), _share(count["stop"], size),
        _share(count["comma"], size), _share(count["symbol"], size), _share(count["space"], size), _share(count["high"], size),
        entropy, mean, np.sqrt(np.maximum(square - mean * mean, 0)), words_where(length <= 3), words_where(letters == 0),
        words_where((uppers == letters) & (letters > 1)), words_where(SYMBOL[values[ends - 1]] if len(ends) else np.zeros(0)),
        _share(distinct, n), _share(top, n), words_where(next_same), np.log1p(_share(n, lines)),
        1 - _share(distinct_lines, np.maximum(lines, 1)) * (lines > 0), np.log1p(_share(n, count["stop"])), np.log1p(longest),
    ], axis=1)


@dataclass
class Model:
    """Additions of the features and of the pairs, per bin; ``edges`` cut a feature, ``coarse`` a feature of a pair."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: one lookup and addition per table."""
        total = np.full(len(x), self.start)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return total


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts at quantiles, halfway between neighbouring distinct values, so that equal values share a bin."""
    distinct = np.unique(values)
    cuts = distinct[1:] if len(distinct) <= bins else np.unique(np.quantile(values, np.arange(1, bins) / bins))
    below = distinct[np.maximum(np.searchsorted(distinct, cuts) - 1, 0)]
    return np.unique((cuts + below) / 2)


def _worth(g, h):
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """(gain, axis, place) of the best cut of a table of gradients and weights along one axis."""
    best = (1e-9, -1, 0)
    whole_g, whole_h = g.sum(), h.sum()
    for axis in range(g.ndim):
        rest = tuple(a for a in range(g.ndim) if a != axis)
        left_g, left_h = np.cumsum(g.sum(axis=rest))[:-1], np.cumsum(h.sum(axis=rest))[:-1]
        if len(left_g):
            gain = _worth(left_g, left_h) + _worth(whole_g - left_g, whole_h - left_h) - _worth(whole_g, whole_h)
            gain = np.where(np.minimum(left_h, whole_h - left_h) >= LEAST_WEIGHT, gain, 0)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), axis, at + 1)
    return best


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, float]:
    """Leaf values spread over the bins, and the gain of the tree; one axis for a feature, two for a pair."""
    gain, axis, at = _best_cut(g, h) if depth else (0.0, -1, 0)
    if axis < 0:
        return np.full(g.shape, -g.sum() / (h.sum() + RIDGE)), 0.0
    sides = [np.split(m, [at], axis=axis) for m in (g, h)]
    (left, more), (right, other) = (_shallow_tree(sides[0][i], sides[1][i], depth - 1) for i in (0, 1))
    return np.concatenate([left, right], axis=axis), gain + more + other


def _boost(bins: list[np.ndarray], shapes: list[tuple[int, ...]], y: np.ndarray, margin: np.ndarray, rounds: int) -> list[np.ndarray]:
    """Tables learned in turn; ``bins`` holds the flat bin of every row for each table. Adds to ``margin``."""
    tables = [np.zeros(s) for s in shapes]
    for _ in range(rounds):
        for k, (at, form) in enumerate(zip(bins, shapes, strict=True)):
            p = _sigmoid(margin)
            size = int(np.prod(form))
            g = np.bincount(at, p - y, size).reshape(form)
            h = np.bincount(at, p * (1 - p), size).reshape(form)
            step = RATE * _shallow_tree(g, h)[0]
            tables[k] += step
            margin += step.ravel()[at]
    return tables


def fit(x: np.ndarray, y: np.ndarray) -> Model | None:
    """Fit to the vectors ``x`` and targets ``y`` in [0, 1] of the sample."""
    if not len(y):
        return None
    n, width = x.shape
    rate = (y.sum() + 0.5) / (n + 1)
    start = math.log(rate / (1 - rate))
    edges = [_edges(x[:, f], BINS) for f in range(width)]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(width)]
    fine_at = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(width)]
    margin = np.full(n, start)
    tables = _boost(fine_at, [(len(e) + 1,) for e in edges], y, margin, ROUNDS)
    at = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(width)]
    sizes = [len(c) + 1 for c in coarse]
    p = _sigmoid(margin)
    promise = []
    for a in range(width):
        for b in range(a + 1, width):
            flat, form = at[a] * sizes[b] + at[b], (sizes[a], sizes[b])
            g = np.bincount(flat, p - y, form[0] * form[1]).reshape(form)
            h = np.bincount(flat, p * (1 - p), form[0] * form[1]).reshape(form)
            promise.append((-_shallow_tree(g, h)[1], a, b))
    pairs = [(a, b) for gain, a, b in sorted(promise)[:PAIRS] if gain < 0]
    flats = [at[a] * sizes[b] + at[b] for a, b in pairs]
    pair_tables = _boost(flats, [(sizes[a], sizes[b]) for a, b in pairs], y, margin, PAIR_ROUNDS)
    return Model(start, edges, tables, coarse, pairs, pair_tables)


def training_fold(key: str = "doc_id") -> Column:
    """The rows to learn from: checksum of the id modulo 3 is not 1; a null id is in neither fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [shape(values, offsets) for _, values, offsets in textkit.slices(batch.column("text"))]
        x = np.vstack(rows) if rows else np.zeros((0, len(FEATURES)))
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), vectors], ["doc_id", "x"])


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and mean labels of at most ``size`` labelled ids of the training fold, by the smallest hashes."""
    known = labels.where(training_fold() & F.col("quality").isNotNull()).select(
        "doc_id", F.xxhash64("doc_id").alias("draw"), F.col("quality").cast("double").alias("quality")
    )
    total = known.select("doc_id").distinct().count()
    if not total:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    # Somewhat more ids than wanted lie below the bound.
    share = min(1.0, (size + 8 * math.sqrt(size)) / total)
    bound = 2**63 - 1 if share >= 1 else int(-(2**63) + share * 2**64)
    drawn = known.where(F.col("draw") <= bound).groupBy("doc_id", "draw").agg(F.avg("quality").alias("y"))
    ids = drawn.orderBy("draw", "doc_id").limit(size).drop("draw")  # at most ``size`` rows of two numbers
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>"
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    vectors = chosen.mapInArrow(_shapes, kind).groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = vectors.join(F.broadcast(ids), "doc_id").orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return x, np.clip(rows.column("y").to_numpy(), 0, 1)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted; every row, whole texts. Columns of these names are replaced."""
    added = ("score", "predicted")
    kept = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(kept.index(text))
            scores = np.full(len(column), 0.5)
            if m is not None:
                for first, values, offsets in textkit.slices(column):
                    scores[first:first + len(offsets) - 1] = _sigmoid(m.margin(shape(values, offsets)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*kept, *added]
            )

    fields = (f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*kept).mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def op11_additive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of the training fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(*sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(~training_fold(), F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", "text", held_out), model).select("doc_id", "held_out", "score", "predicted")
