"""Phrase collocations by set-oriented mining over sorted occurrence relations (SETM).

The occurrence relation of length k lists the places of the frequent phrases of k words, sorted. Words of one piece
of text have consecutive places, and between two pieces a place is left out, so a phrase and its right neighbour lie
in one piece exactly if their places differ by one. The relation is stored in chunks of whole documents of one
language (packed places and phrase numbers), written as a table. One level is extended to the next in three steps:
the relation is merge-joined with itself at neighbouring places, which gives the occurrences of k + 1 words whose
first k and last k words are frequent; each chunk counts them, and the counts are grouped by phrase over all chunks;
the occurrences are semi-joined with the frequent groups before the next extension.

Grouping is one shuffle: a chunk sends a phrase once, with its count. A pass over the sorted rows sends a group's rows
on as soon as it has reached the least count and holds fewer rows than that count before, so neither a hot phrase nor a
hot language gathers in memory; a phrase has one row per chunk at most, and goes back packed with others of its chunk. Phrases are told apart by ids given to the frequent groups, never by hashes.
A phrase keeps the frequencies of its beginnings and ends, which are frequent too, so all cuts are scored without
another look at the texts. All scores use exact decimals.

Cases: a null text is empty, a null language is ``und``; texts without words count nothing; a text longer than a
chunk is a chunk of its own; repeated rows count as often as they occur; further columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from faultline.llm import textkit
from faultline.sources.storage import materialized

UNKNOWN = "und"
#: Bytes of text in a chunk, and phrases that a task sends at once.
CHUNK = 8 << 20
ROWS = 1 << 16
#: Rows of frequent groups that a task packs at once.
HELD = 1 << 18
#: Words of a phrase, least frequency, share of a longer phrase that drops a shorter one (percent), phrases per language.
LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2000

BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~BREAKS
INSIDE[[0x20, 0x09]] = False


def packed(numbers: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(numbers), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd"), kind)


def occurrences(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Places and words of the joined texts, in order."""
    lowered = textkit.LOWER[values]
    starts, ends, first = textkit.word_bounds(lowered, offsets, INSIDE)
    breaks = np.zeros(len(lowered) + 1, np.int32)
    np.cumsum(BREAKS[lowered], out=breaks[1:])
    cut = np.zeros(len(starts) + 1, bool)
    cut[1:-1] = breaks[starts[1:]] > breaks[ends[:-1]]
    cut[first[1:-1]] = True  # the first word of a document
    cut[0] = False
    places = np.arange(len(starts)) + np.cumsum(cut[:len(starts)])
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    inside = lowered[INSIDE[lowered]]
    return places, pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(inside)])


CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("places", pa.binary()), ("codes", pa.binary()),
    ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
])
CHUNK_KIND = "chunk long, lang string, n long, places binary, codes binary, words array<string>, counts array<long>"


def word_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The relation of single words from rows of (lang, text), in chunks of about ``limit`` bytes of one language."""
    serial = TaskContext.get().partitionId() << 32
    waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[str, int] = {}

    def chunk(lang: str) -> pa.RecordBatch:
        nonlocal serial
        parts, _ = waiting.pop(lang), sizes.pop(lang)
        lengths = np.concatenate([np.diff(o) for _, o in parts])
        offsets = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        places, words = occurrences(np.concatenate([v for v, _ in parts]), offsets)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        counts = np.bincount(codes, minlength=len(coded.dictionary))
        serial += 1
        row = [serial - 1, lang, len(codes), packed(np.diff(places, prepend=0).astype(np.int32)), packed(codes)]
        lists = [pa.array([0, len(counts)], pa.int32())]
        return pa.RecordBatch.from_arrays([
            *[pa.array([v], f.type) for v, f in zip(row, CHUNKS, strict=False)],
            pa.ListArray.from_arrays(lists[0], coded.dictionary.cast(pa.binary()).cast(pa.string())),
            pa.ListArray.from_arrays(lists[0], pa.array(counts, pa.int64())),
        ], schema=CHUNKS)

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column("text").filter(pc.equal(langs.indices, code))
            for _, values, offsets in textkit.slices(texts, limit):
                waiting.setdefault(lang, []).append((values, offsets))
                sizes[lang] = sizes.get(lang, 0) + len(values)
                while sum(sizes.values()) >= limit:
                    yield chunk(max(sizes, key=sizes.get))
    for lang in list(waiting):
        yield chunk(lang)


def frequent_groups(keys: list[str], least: int, held_rows: int = HELD):
    """Task over rows (chunk, code, keys, n) sorted by ``keys``: the groups whose counts ``n`` reach ``least``.

    A frequent group gets an id and is one row (id, keys, n). Its rows go on as lists of codes and ids per
    chunk, packed whenever ``held_rows`` have come together. Before the last group of a batch has reached the count, only its fewer than
    ``least`` rows are held.
    """

    def changes(rows: pa.Table) -> np.ndarray:
        out = np.ones(rows.num_rows, bool)
        if rows.num_rows > 1:
            out[1:] = False
            for k in keys:
                column = rows.column(k).combine_chunks()
                out[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 36
        held, open_group, waiting, kinds = None, None, [], None

        def names() -> list[str]:
            return ["chunk", "id", *keys, "n", "codes", "ids"]

        def groups(columns: list[pa.Array], ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            nothing = pa.nulls(len(ids), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(ids), pa.int64()), pa.array(ids, pa.int64()), *columns, pa.array(n, pa.int64()), nothing, nothing], names()
            )

        def lists() -> pa.RecordBatch:
            chunk, code, ids = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            order = np.argsort(chunk, kind="stable")
            chunk, code, ids = chunk[order], code[order].astype(np.int32), ids[order]
            begin = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            end = np.append(begin[1:], len(chunk))
            bounds = list(zip(begin, end, strict=True))
            return pa.RecordBatch.from_arrays([
                pa.array(chunk[begin]), pa.nulls(len(begin), pa.int64()), *[pa.nulls(len(begin), kind) for kind in kinds], pa.array(end - begin),
                pa.array([packed(code[x:y]) for x, y in bounds], pa.binary()), pa.array([packed(ids[x:y]) for x, y in bounds], pa.binary()),
            ], names())

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            held = None
            if not rows.num_rows:
                continue
            kinds = [rows.schema.field(k).type for k in keys]
            begins = np.flatnonzero(changes(rows))
            of_group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, rows.num_rows)))
            sums = np.add.reduceat(rows.column("n").to_numpy(), begins)
            heads = [rows.column(k).combine_chunks().take(pa.array(begins)) for k in keys]
            ids = np.zeros(len(begins), np.int64)
            enough = sums >= least
            goes_on = open_group is not None and tuple(h[0].as_py() for h in heads) == open_group[0]
            if open_group is not None and not goes_on:
                yield groups([pa.array([v], kind) for v, kind in zip(open_group[0], kinds, strict=True)], np.array([open_group[1]]), np.array([open_group[2]]))
            if goes_on:
                enough[0], sums[0] = True, sums[0] + open_group[2]
            new = enough.copy()
            new[0] &= not goes_on
            ids[new] = next_id + np.arange(new.sum())
            next_id += int(new.sum())
            if goes_on:
                ids[0] = open_group[1]
            # the last group may go on in the next batch: its sum, or its rows, wait
            if enough[-1]:
                open_group = (tuple(h[-1].as_py() for h in heads), int(ids[-1]), int(sums[-1]))
            else:
                held, open_group = rows.slice(int(begins[-1])), None
            done = enough.copy()
            done[-1] = False
            if done.any():
                yield groups([h.filter(pa.array(done)) for h in heads], ids[done], sums[done])
            keep = enough[of_group]
            waiting.append((rows.column("chunk").to_numpy()[keep], rows.column("code").to_numpy()[keep], ids[of_group[keep]]))
            if sum(len(w[0]) for w in waiting) >= held_rows:
                yield lists()
        if open_group is not None:
            yield groups([pa.array([v], kind) for v, kind in zip(open_group[0], kinds, strict=True)], np.array([open_group[1]]), np.array([open_group[2]]))
        if any(len(w[0]) for w in waiting):
            yield lists()

    return run


RELATION = pa.schema([
    ("chunk", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("places", pa.binary()), ("codes", pa.binary()), ("ids", pa.binary()),
])
RELATION_KIND = "chunk long, n long, m long, places binary, codes binary, ids binary"


def _relation(chunk: int, places: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> pa.Table:
    row = [chunk, len(codes), len(ids), packed(np.diff(places, prepend=0).astype(np.int32)), packed(codes.astype(np.int32)), packed(ids)]
    return pa.table([pa.array([v], f.type) for v, f in zip(row, RELATION, strict=True)], schema=RELATION)


def _semi_join(chunk: int, places: np.ndarray, codes: np.ndarray, size: int, kept: pa.Table) -> pa.Table:
    """Occurrences whose code is kept, numbered anew in the order of the ids."""
    lists = kept.to_pylist()
    at = np.concatenate([unpacked(r["codes"], r["n"], np.int32) for r in lists])
    ids = np.concatenate([unpacked(r["ids"], r["n"], np.int64) for r in lists])
    order = np.argsort(ids)
    number = np.full(size, -1, np.int64)
    number[at[order]] = np.arange(len(at))
    codes = number[codes]
    stay = codes >= 0
    return _relation(chunk, places[stay], codes[stay], ids[order])


def _frequent_words(chunks: pa.Table, kept: pa.Table) -> pa.Table:
    if not chunks.num_rows or not kept.num_rows:
        return RELATION.empty_table()
    row = chunks.to_pylist()[0]
    places = np.cumsum(unpacked(row["places"], row["n"], np.int32), dtype=np.int64)
    return _semi_join(row["chunk"], places, unpacked(row["codes"], row["n"], np.int32), row["distinct"], kept)


def neighbours(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of a relation with itself at neighbouring places: places, numbers of the longer phrases, and their
    first and last parts as codes."""
    places = np.cumsum(unpacked(row["places"], row["n"], np.int32), dtype=np.int64)
    codes = unpacked(row["codes"], row["n"], np.int32).astype(np.int64)
    # both sides are sorted and places are distinct, so the partner of a row is the next one or missing
    at = np.flatnonzero(places[1:] == places[:-1] + 1)
    joined, number = np.unique(codes[at] * row["m"] + codes[at + 1], return_inverse=True)
    return places[at], number, joined // max(row["m"], 1), joined % max(row["m"], 1)


EXTENDED = pa.schema([("chunk", pa.int64()), ("code", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
EXTENDED_KIND = "chunk long, code int, a long, b long, n long"


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of one more word of each chunk, counted: (chunk, code, ids of the first and last part, n)."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpacked(row["ids"], row["m"], np.int64)
            _, number, first, last = neighbours(row)
            n = np.bincount(number, minlength=len(first))
            for i in range(0, len(first), ROWS):
                part = slice(i, i + ROWS)
                columns = [np.full(len(first[part]), row["chunk"]), np.arange(i, i + len(first[part])), ids[first[part]], ids[last[part]], n[part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, EXTENDED, strict=True)], schema=EXTENDED)


def _frequent_phrases(relation: pa.Table, kept: pa.Table) -> pa.Table:
    if not relation.num_rows or not kept.num_rows:
        return RELATION.empty_table()
    row = relation.to_pylist()[0]
    places, number, first, _ = neighbours(row)
    return _semi_join(row["chunk"], places, number, len(first), kept)


def _kept(rows: DataFrame, keys: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """(frequent groups: id, keys, f; their rows as lists per chunk) of counted rows, written as a table."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    found = materialized(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        frequent_groups(keys, least), f"chunk long, id long, {kinds}, n long, codes binary, ids binary"
    ))
    return found.where("id IS NOT NULL").select("id", *keys, F.col("n").alias("f")), found.where("id IS NULL").select("chunk", "n", "codes", "ids")


def _joined(relation: DataFrame, kept: DataFrame, task) -> DataFrame:
    """The relation with only the occurrences of frequent groups, chunk by chunk."""
    return materialized(relation.groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInArrow(task, RELATION_KIND))


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, for each length from 1 to ``longest``, the frequent phrases of ``docs`` (lang, text).

    Phrases have ``id, lang, phrase, last`` (their last word), ``f``, the ids ``a`` and ``b`` of their first and last
    words but one, and ``heads`` and ``tails``: the frequencies of their beginnings and ends of 1, 2, ... words.
    """
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    chunks = materialized(rows.mapInArrow(word_chunks, CHUNK_KIND))
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")
    counted = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).select(
        "chunk", "code", "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n")
    )
    groups, kept = _kept(counted, ["lang", "word"], least)
    levels = [materialized(groups.select(
        "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f",
        F.array("f").alias("heads"), F.array("f").alias("tails"),
    ))]
    packed_rows = chunks.select("chunk", "n", "places", "codes", F.size("words").alias("distinct"))
    relation = _joined(packed_rows, kept, _frequent_words) if longest > 1 else None
    for k in range(2, longest + 1):
        extended = relation.mapInArrow(_extended, EXTENDED_KIND)
        if k < longest:
            groups, kept = _kept(extended, ["a", "b"], least)
            relation = _joined(relation, kept, _frequent_phrases)
        else:
            groups = extended.groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("id", F.lit(None).cast("long"))
        first = levels[-1].select(F.col("id").alias("a"), "lang", F.col("phrase").alias("first_words"), F.col("heads").alias("h"))
        last = levels[-1].select(F.col("id").alias("b"), "last", F.col("tails").alias("t"))
        levels.append(materialized(groups.join(first, "a").join(last, "b").select(
            "id", "lang", F.concat_ws(" ", "first_words", "last").alias("phrase"), "last", "f", "a", "b",
            F.concat("h", F.array("f")).alias("heads"), F.concat("t", F.array("f")).alias("tails"),
        )))
    return totals, levels


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP
) -> DataFrame:
    """The ``top`` phrases per language: lang, rank, phrase, a, l, r, n, score."""
    totals, levels = frequent(docs, longest, least)
    found = None
    for k in range(2, longest + 1):
        own = levels[k - 1]
        if k < longest:
            # a longer candidate holds the phrase only if the one with one more word does, and that is as frequent
            longer = levels[k].select(F.explode(F.array("a", "b")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            own = own.join(longer, "id", "left").where(f"longer IS NULL OR 100 * longer < {covered} * f")
        # the cut after j words has beginnings of j and ends of k - j words
        cuts = F.expr(f"""array_min(transform(sequence(1, {k - 1}), j -> struct(
            (cast(f AS decimal(16,0)) * cast(f AS decimal(16,0)) * 1000000)
              div (cast(heads[j - 1] AS decimal(16,0)) * cast(tails[{k - 1} - j] AS decimal(16,0))) AS score,
            j, heads[j - 1] AS l, tails[{k - 1} - j] AS r)))""")
        scored = own.select("lang", "phrase", F.col("f").alias("a"), cuts.alias("cut"))
        found = scored if found is None else found.unionByName(scored)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score")
    )


def op13_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of two and three words in all documents, per language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in SQL over lists of words.
OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), f1 AS (SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(w) AS w1 FROM lists) GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY ALL
), f2 AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM lists) GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM lists)
  GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.f AS a, x.f AS l, y.f AS r FROM f2 c
  JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  LEFT JOIN longer g ON g.lang = c.lang AND g.w1 = c.w1 AND g.w2 = c.w2 WHERE g.f IS NULL OR 100 * g.f < 50 * c.f
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.f, x.f, y.f FROM f3 c
  JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.f, x.f, y.f FROM f3 c
  JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3
), scored AS (
  SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
