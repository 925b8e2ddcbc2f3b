"""Language identification by nearest centroids of normalised TF-IDF vectors.

A text becomes the damped counts of the hashed byte 1-, 2- and 3-grams of its letters (lower case), weighted by
inverse document frequency and scaled to length one. Every language has a few centroids, found by spherical k-means over a
bounded sample of labelled texts; the prediction is the language of the centroid with the largest cosine.
A text whose cosine lies below the cut of that language is rejected. The cut lies halfway between what nearly all
sample texts of the language reach (each measured without its own share in the centroids) and what nearly no
sample text of any other language does; where the two overlap, nearly all texts of the language stay. A cluster
of hardly any texts, such as a single text in another language, is not a centroid.

Cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; rows with a null language
are never learned from; without any labelled text everything is ``und``. Repeated rows are predicted alike,
further columns are kept out of the model and untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from faultline.llm import textkit

UNKNOWN = "und"
#: Size of the hashed vectors.
DIMENSIONS = 1 << 13
#: Distinct labelled texts learned from, over all languages, and at most per language; the sample is bounded, the
#: prediction covers every row.
SAMPLE = 8000
SAMPLE_PER_LANGUAGE = 500
CENTROIDS = 3
#: Share of a language's sample that may lie below the upper end of its cut, of another's above the lower end, and
#: that a cluster has to exceed, with two texts at least, to be a centroid.
TAIL = 0.01
#: A letter is a code point of a category L; in Python ``str.isalpha`` tells them.
HAS_LETTER = r"\p{L}"
HASH = np.uint32(0x9E3779B1)
SPACE = np.full(1, 0x20, np.uint8)
SPACES = np.arange(256, dtype=np.uint8)
SPACES[:0x61] = SPACES[0x7B:0x80] = 0x20


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray


def gram_counts(text: bytes) -> np.ndarray:
    """Damped counts of the hashed 1-, 2- and 3-grams of the bytes; runs of ASCII that is no letter are one space."""
    b = SPACES[np.frombuffer(text, np.uint8)]
    b = np.concatenate([SPACE, b[(b != 0x20) | (np.append(0x20, b[:-1]) != 0x20)], SPACE]).astype(np.uint32)
    codes = [b + np.uint32(1 << 24)]
    if len(b) > 1:
        codes.append((b[:-1] << np.uint32(8) | b[1:]) + np.uint32(2 << 24))
    if len(b) > 2:
        codes.append(b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:])
    hashed = (np.concatenate(codes) * HASH) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
    return np.sqrt(np.bincount(hashed, minlength=DIMENSIONS), dtype=np.float32)


def training_fold(spark: SparkSession) -> Column:
    """The rows to learn from: checksum of the id modulo 5 is not 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def sample_rows(labelled: DataFrame) -> DataFrame:
    """(lang, draw, at, counts): at most SAMPLE_PER_LANGUAGE distinct texts per language, those of the smallest hashes.

    A text counts once however often it occurs; texts without a letter take no part.
    """
    labelled = labelled.where(F.col("text").rlike(HAS_LETTER)).withColumn("draw", F.xxhash64("text"))
    counts = labelled.select("lang", "draw").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    rows = counts.orderBy("lang").collect()
    each = max(2, min(SAMPLE_PER_LANGUAGE, SAMPLE // max(1, len(rows))))
    # Somewhat more than wanted lie below the bound, so that the window sees few rows and finds enough.
    more = each + 8 * int(each**0.5) + 20
    bounds = F.create_map(*[c for r in rows for c in (F.lit(r["lang"]), F.lit(_bound(more, r["n"])))]) if rows else None
    drawn = labelled.where(F.col("draw") <= bounds[F.col("lang")]) if rows else labelled.limit(0)
    known = drawn.select("lang", "text", "draw").mapInArrow(_sparse, "lang string, draw long, at binary, counts binary").dropDuplicates(["lang", "draw"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    return known.withColumn("place", place).where(F.col("place") <= each).drop("place")


def _bound(wanted: int, n: int) -> int:
    share = min(1.0, wanted / n)
    return 2**63 - 1 if share >= 1 else int(-(2**63) + share * 2**64)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Damped counts of the texts; copies within a task come once."""
    seen = set()
    for batch in batches:
        rows = []
        for lang, text, draw in zip(batch.column("lang").to_pylist(), batch.column("text"), batch.column("draw").to_pylist(), strict=True):
            if (lang, draw) in seen:
                continue
            seen.add((lang, draw))
            counts = gram_counts(text.as_py().lower().encode())
            at = np.flatnonzero(counts)
            rows.append((lang, draw, at.astype(np.int32).tobytes(), counts[at].tobytes()))
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["lang", "draw", "at", "counts"]
        )


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=-1, keepdims=True)), 1e-9)


def _dense(vectors: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    dense = np.zeros((len(vectors), DIMENSIONS), np.float32)
    for i, (at, counts) in enumerate(vectors):
        dense[i, at] = counts * weights[at]
    return _unit(dense)


def _cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from vectors far from each other."""
    centres = _unit(vectors.mean(axis=0, keepdims=True))
    while len(centres) < min(k, len(vectors)):
        far = int((vectors @ centres.T).max(axis=1).argmin())
        centres = np.vstack([centres, vectors[far:far + 1]])
    for _ in range(10):
        nearest = (vectors @ centres.T).argmax(axis=1)
        centres = np.vstack([
            _unit(vectors[nearest == j].sum(axis=0, keepdims=True)) if (nearest == j).any() else centres[j:j + 1]
            for j in range(len(centres))
        ])
    return centres


def _centroids(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of a language, and the best cosine of each of its vectors when it takes no part in them."""
    centres = _cluster(vectors, CENTROIDS)
    sizes = np.bincount((vectors @ centres.T).argmax(axis=1), minlength=len(centres))
    enough = sizes >= max(2, TAIL * len(vectors))
    centres = centres[enough] if enough.any() else centres
    cosine = vectors @ centres.T
    nearest = cosine.argmax(axis=1)
    sums = np.vstack([vectors[nearest == j].sum(axis=0) for j in range(len(centres))])
    own = (sums[nearest] * vectors).sum(axis=1)
    rest = np.sqrt(np.maximum((sums * sums).sum(axis=1)[nearest] - 2 * own + 1, 1e-9))
    cosine[np.arange(len(vectors)), nearest] = (own - 1) / rest
    return centres, cosine.max(axis=1)


def _cut(inside: np.ndarray, others: list[np.ndarray]) -> float:
    """The cosine below which a text is rejected, from those of the language's own texts and of the other languages'."""
    outside = max((float(np.quantile(o, 1 - TAIL)) for o in others), default=None)
    if len(inside) < 2:
        return outside or 0.0
    reached = float(np.quantile(inside, TAIL))
    return reached if outside is None else min(reached, (reached + outside) / 2)


def fit(labelled: DataFrame) -> Model | None:
    """Fit on a bounded sample of ``text`` and ``lang``; the driver holds the sample as sparse counts only."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    rows = sample_rows(labelled).collect()
    by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["at"], r["counts"])):
        by_lang.setdefault(r["lang"], []).append((np.frombuffer(r["at"], np.int32), np.frombuffer(r["counts"], np.float32)))
    if not by_lang:
        return None
    seen = np.zeros(DIMENSIONS)
    for vectors in by_lang.values():
        for at, _ in vectors:
            seen[at] += 1
    weights = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + np.float32(0.05)
    found = [_centroids(_dense(vectors, weights)) for vectors in by_lang.values()]
    owner = np.repeat(np.arange(len(found)), [len(centres) for centres, _ in found])
    centroids = np.vstack([centres for centres, _ in found])
    # Best cosine of every sample text to the centroids of every language.
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    best = [np.maximum.reduceat(_dense(vectors, weights) @ centroids.T, starts, axis=1) for vectors in by_lang.values()]
    cuts = np.array([_cut(inside, [b[:, i] for j, b in enumerate(best) if j != i]) for i, (_, inside) in enumerate(found)])
    return Model(list(by_lang), weights, centroids.astype(np.float32), owner, cuts[owner])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (cosine of the best centroid) and rejected; every row, whole texts."""
    added = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(kept.index(text))
            size = len(column)
            langs, scores, bad = [UNKNOWN] * size, np.zeros(size), np.ones(size, bool)
            for i in range(size):
                value = column[i].as_py()
                if m is None or value is None or not any(map(str.isalpha, value)):
                    continue
                vector = gram_counts(value.lower().encode()) * m.weights
                cosine = m.centroids @ vector / max(float(np.sqrt(vector @ vector)), 1e-9)
                best = int(cosine.argmax())
                langs[i] = m.languages[m.owner[best]]
                scores[i] = min(1.0, max(0.0, float(cosine[best])))
                bad[i] = scores[i] < m.floor[best]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(bad)], [*kept, *added]
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), "lang_pred string", "score double", "rejected boolean"])
    return docs.select(*kept).mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from the training fold only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(training_fold(spark)).select("text", "lang"))
    out = predict(docs.select("doc_id", "text", (~training_fold(spark)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
