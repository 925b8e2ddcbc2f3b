"""Jaccard self-join of word n-gram sets with PartEnum signatures.

Two sets are similar when 100 * |A and B| >= percent * |A or B|. Sizes are cut into bands so that similar sets
lie in one band or in neighbouring ones. Within a band and its upper neighbour similar sets differ in at most
k elements; when the domain of elements is divided (by hash) into more than k partitions, some partition
holds the same elements in both. Partitions go in groups of two; of the subsets of one that are enumerated in
each group, at least one agrees in some group. A set emits one signature per partition that is not empty. With
k + 1 + spare partitions, partitions that are empty in both sets can be left out as long as a set has at most
``spare`` of them; a set with more also emits the signatures of the next of several divisions, so the
guarantee holds without the empty partitions on which unrelated sets would meet.

Equal sets are one node. The best connected node of a signature is its pivot. A node carries a sketch, one byte for each
of many partitions; sets whose sketches differ in more bytes than similar sets differ in elements are ruled out, so
only the sets of likely pairs are read and sent. Nodes are compared with the best of
their possible pivots, then with other pivots whose component differs, not with each other. Nodes that the links found so far leave outside the component of their
pivot are then compared with all nodes of that pivot in blocks of bounded size, so no link between different
components is lost, no pair of rows is made, and no group has to fit into a task. Links inside a component
that is already connected need no test. All tests are on the sets themselves. Before texts or sketches are shuffled to a
list of hashes, a broadcast table of marks leaves out nearly all that are not on the list.

Cases: a text without words has an empty set (0 shingles) and links with nothing; null ids take part and get
the smallest id of their group; rows that share a text or a set always share a component; a set of fewer
words than n has the whole sequence as its one element. Elements and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import textkit
from faultline.llm.components import components, extended
from faultline.sources.storage import discard, materialized

SHINGLE = 4
PERCENT = 85
DIVISIONS = 8
#: Signatures, or elements of whole sets, that a task sends at once.
ROWS = 1 << 17
#: Bytes of texts that a task hashes at once; its arrays take many times that.
SLICE_BYTES = 1 << 18
#: Sets of one block in the comparison of nodes outside their pivot's component.
BLOCK = 500
#: Rows of 64 marks each that a broadcast of marked hashes has at most.
MARK_ROWS = 1 << 18


@lru_cache(maxsize=None)
def band(size: int, percent: int) -> int:
    """Number of the size band; similar sets are in one band or in neighbouring ones."""
    number, start = 0, 1
    while (following := start * 100 // percent + 1) <= size:
        number, start = number + 1, following
    return number


@lru_cache(maxsize=None)
def sizes(number: int, percent: int) -> tuple[int, int]:
    """Smallest and largest set of a band."""
    start = 1
    for _ in range(number):
        start = start * 100 // percent + 1
    return start, start * 100 // percent


def allowed(total, percent: int):
    """Elements in which two similar sets of ``total`` elements together may differ; numbers or arrays."""
    return total - 2 * -(-percent * total // (100 + percent))


@lru_cache(maxsize=None)
def differing(number: int, percent: int) -> int:
    """The same for all pairs whose smaller set lies in this band."""
    _, largest = sizes(number, percent)
    most = largest + largest * 100 // percent
    return max(allowed(s, percent) for s in range(max(2, most - 8), most + 1))


@lru_cache(maxsize=None)
def partitions(number: int, percent: int) -> tuple[int, int]:
    """Partitions and spare ones for pairs whose smaller set lies in this band.

    Spare are as many as the smallest set of the band leaves empty as a rule: two deviations above the expected number.
    """
    differ = differing(number, percent)
    if differ == 0:
        return 1, 0
    smallest, spare = sizes(number, percent)[0], 1
    for _ in range(20):
        total = differ + 1 + spare
        empty = total * math.exp(-smallest / total)
        spare = max(1, math.ceil(empty + 2 * math.sqrt(empty)))
    total = differ + 1 + spare
    return total + total % 2, spare + total % 2


def sketch(elements: np.ndarray, number: int, percent: int) -> bytes:
    """One byte for each of twice as many partitions as similar sets of the band may differ in.

    An element that is in only one of two sets changes one byte at most, so similar sets differ in no more bytes
    than elements; unlike sets differ in nearly all bytes.
    """
    keyed = textkit.mix(elements ^ np.uint64(0xA0761D6478BD642F))
    part = (keyed >> np.uint64(20)) % np.uint64(2 * differing(number, percent) + 8)
    sums = np.bincount(part.astype(np.int64), (keyed & np.uint64(0xFF)).astype(float), 2 * differing(number, percent) + 8)
    return (sums.astype(np.int64) & 0xFF).astype(np.uint8).tobytes()


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one set (distinct 64-bit elements)."""
    out = []
    own = band(len(elements), percent)
    for instance in (own, own - 1):
        if instance < 0:
            continue
        total, spare = partitions(instance, percent)
        for division in range(DIVISIONS):
            keyed = textkit.mix(elements + np.uint64(division * 0x9E3779B97F4A7C15 % 2**64))
            part = (keyed >> np.uint64(33)) % np.uint64(total)
            order = np.argsort(part, kind="stable")
            part, keyed = part[order], keyed[order]
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            sums, part = np.add.reduceat(keyed, at), part[at]
            tag = np.uint64((instance * DIVISIONS + division) << 32)
            last = division == DIVISIONS - 1
            if last and total - len(at) > spare:
                missing = np.setdiff1d(np.arange(total, dtype=np.uint64), part)
                sums, part = np.append(sums, np.zeros(len(missing), np.uint64)), np.append(part, missing)
            out.append(textkit.mix(sums * np.uint64(0xD6E8FEB86659FD93) + tag + part))
            if total - len(at) <= spare:
                break
    return np.concatenate(out)


def sets_of(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct elements) of every text, in order."""
    for row, values, offsets in textkit.slices(column, SLICE_BYTES):
        hashes, first = textkit.words(values, offsets, textkit.SPACED)
        full = textkit.grams(hashes, shingle)
        for i in range(len(first) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= shingle:
                yield row + i, np.unique(full[a:b - shingle + 1])
            elif b > a:
                yield row + i, textkit.grams(hashes[a:b], b - a, seed=b - a)
            else:
                yield row + i, hashes[:0]


def set_key(elements: np.ndarray) -> int:
    """64-bit hash of a whole set."""
    total = np.add.reduce(textkit.mix(elements)) if len(elements) else np.uint64(0)
    return int(textkit.mix(np.array([total + np.uint64(len(elements))], np.uint64)).view(np.int64)[0])


def with_mark(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """``rows`` (with a 64-bit ``hash``) and ``marked``: true for all hashes of the one column of ``hashes``, and for few others.

    The marks are broadcast. Their number is fixed, so with very many hashes more of the others are marked, none less.
    """
    at = F.col("hash").bitwiseAND(F.lit(MARK_ROWS - 1))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(hash, 58) as int))")
    marks = hashes.toDF("hash").groupBy(at.alias("mark_at")).agg(F.bit_or(bit).alias("marks"))
    joined = rows.join(F.broadcast(marks), at == F.col("mark_at"), "left")
    return joined.withColumn("marked", F.coalesce(F.col("marks").bitwiseAND(bit) != 0, F.lit(False))).drop("mark_at", "marks")


def _emit(shingle: int, percent: int):
    """Rows (sig, node) of the distinct sets of a batch, in runs of about ROWS signatures."""

    def rows(sigs: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(textkit.signed(np.concatenate(sigs))), pa.array(np.repeat(np.array(keys), [len(s) for s in sigs]))], ["sig", "node"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, keys, sigs, size = set(), [], [], 0
            for _, elements in sets_of(batch.column(0), shingle):
                key = set_key(elements) if len(elements) else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                sigs.append(signatures(elements, percent))
                keys.append(key)
                size += len(sigs[-1])
                if size >= ROWS:
                    yield rows(sigs, keys)
                    keys, sigs, size = [], [], 0
            if keys:
                yield rows(sigs, keys)

    return run


def _whole_sets(shingle: int):
    """Rows (node, elements) of the distinct sets of a batch, in runs of about ROWS elements."""

    def rows(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        offsets = pa.array(np.append(0, np.cumsum([len(e) for e in sets])), pa.int32())
        elements = pa.ListArray.from_arrays(offsets, pa.array(textkit.signed(np.concatenate(sets))))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), elements], ["node", "elements"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys, sets, size = [], [], 0
            for _, elements in sets_of(batch.column(0), shingle):
                key = set_key(elements)
                if not len(elements) or key in seen:
                    continue
                seen.add(key)
                keys.append(key)
                sets.append(elements)
                size += len(elements)
                if size >= ROWS:
                    yield rows(keys, sets)
                    keys, sets, size = [], [], 0
            if keys:
                yield rows(keys, sets)

    return run


def _keyed(shingle: int, percent: int, kept: list[str]):
    """Rows with the key and the sketches of the set of their text: one for its own band, one for the band below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, elements in sets_of(batch.column(kept.index("text")), shingle):
                if not len(elements):
                    rows.append((0, None, None, None, None))
                    continue
                own = band(len(elements), percent)
                below = sketch(elements, own - 1, percent) if own else None
                rows.append((len(elements), set_key(elements), own, sketch(elements, own, percent), below))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(kept.index(c)) for c in ("doc_id", "text_hash")], *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]],
                ["doc_id", "text_hash", "n_shingles", "set_key", "band", "own", "below"],
            )

    return run


def _unlike(a: tuple[int, int, bytes, bytes | None], b: tuple[int, int, bytes, bytes | None], percent: int) -> bool:
    """Whether two nodes (size, band, own and lower sketch) are proven not to be similar."""
    if abs(a[1] - b[1]) > 1:
        return True
    if a[1] != b[1]:
        x, y = (a[2], b[3]) if a[1] < b[1] else (a[3], b[2])
    else:
        x, y = a[2], b[2]
    unequal = np.count_nonzero(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8))
    return bool(unequal > allowed(a[0] + b[0], percent))


SKETCH = ("n", "band", "own", "below")


def _possible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (list(zip(*[batch.column(f"{side}{c}").to_pylist() for c in SKETCH], strict=True)) for side in ("", "pivot_"))
            stay = pa.array([not _unlike(a, b, percent) for a, b in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(stay) for c in ("pivot", "node")], ["pivot", "node"])

    return run


def candidates(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those (pivot, node) pairs that sizes and sketches do not rule out; no similar pair is lost."""
    pivots = nodes.select(F.col("node").alias("pivot"), *[F.col(c).alias(f"pivot_{c}") for c in SKETCH])
    met = pairs.where("node <> pivot").join(nodes.select("node", *SKETCH), "node").join(pivots, "pivot")
    met = met.where(100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n"))
    return met.mapInArrow(_possible(percent), "pivot long, node long")


def _set_tests(percent: int):
    """Task over rows sorted by pivot: its set comes first, then those of the nodes that it is compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, np.zeros(0, np.int64)
        for batch in batches:
            made = []
            elements = batch.column("elements")
            for i, (key, role, node) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("pivot", "role", "node")], strict=True)):
                here = elements[i].values.to_numpy(zero_copy_only=False)
                if role == 0:
                    pivot, own = key, here
                elif key == pivot:
                    both = len(np.intersect1d(own, here, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(here) - both):
                        made.append((key, node))
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (pivot, node) pairs, as (a, b), whose sets are similar. A set travels once to each of its pivots; a pivot
    of many nodes is compared with them in blocks."""
    blocks = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    spread = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    members = pairs.join(blocks, "pivot").select("pivot", spread, F.lit(1).alias("role"), "node")
    heads = blocks.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("pivot").alias("node"))
    rows = members.unionByName(heads).join(sets, "node").select("pivot", "block", "role", "node", "elements")
    return rows.repartition("pivot", "block").sortWithinPartitions("pivot", "block", "role").mapInArrow(_set_tests(percent), "a long, b long")


def _block_candidates(percent: int):
    """Rows of a block pair that sketches do not rule out with some row of the other side."""
    names = ["pivot", "i", "j", "role", "node"]

    def partners(outer: list, inner: list) -> list[tuple]:
        by_band: dict[int, list[int]] = {}
        for k, (_, theirs) in enumerate(inner):
            by_band.setdefault(theirs[1], []).append(k)
        stacked = {}
        for number, at in by_band.items():
            own, below = ([np.frombuffer(inner[k][1][c], np.uint8) for k in at] if number or c == 2 else None for c in (2, 3))
            ids, sizes_of = (np.array([inner[k][i][c] for k in at]) for i, c in ((0, 4), (1, 0)))
            stacked[number] = (np.array(at), ids, sizes_of, np.stack(own), None if below is None else np.stack(below))
        out, used = [], set()
        for row, (n, number, own, below) in outer:
            some = False
            for other, mine, column in ((number, own, 3), (number + 1, own, 4), (number - 1, below, 3)):
                if other in stacked:
                    at, ids, sizes_of, *tables = stacked[other]
                    unequal = np.count_nonzero(tables[column - 3] != np.frombuffer(mine, np.uint8), axis=1)
                    near = at[(unequal <= allowed(sizes_of + n, percent)) & (ids != row[4])]
                    used.update(near.tolist())
                    some = some or len(near) > 0
            if some:
                out.append(row)
        return out + [inner[k][0] for k in sorted(used)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, outer, inner = None, [], []

        def flushed() -> pa.RecordBatch:
            made = partners(outer, inner) if outer and inner else []
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in names], strict=True)
            sketches = zip(*[batch.column(c).to_pylist() for c in SKETCH], strict=True)
            for row, own in zip(rows, sketches, strict=True):
                if row[:3] != group:
                    yield flushed()
                    group, outer, inner = row[:3], [], []
                (inner if row[3] else outer).append((row, own))
        yield flushed()

    return run


def _block_links(percent: int):
    """Links between the outer nodes and all nodes of each block pair; only those that connect something new."""

    def links(outer: list, inner: list) -> list[tuple[int, int]]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sizes = np.array([len(e) for _, e in inner])
        ids, place = np.unique(np.concatenate([e for _, e in inner]), return_inverse=True)
        starts = np.append(0, np.cumsum(sizes)[:-1])
        flags, out = np.zeros(len(ids) + 1, np.int32), []
        for node, elements in outer:
            at = np.searchsorted(ids, elements)
            at = at[np.append(ids, elements[:1])[at] == elements]
            flags[at] = 1
            both = np.add.reduceat(flags[place], starts)
            flags[at] = 0
            for j in np.flatnonzero(100 * both >= percent * (sizes + len(elements) - both)):
                a, b = find(node), find(inner[j][0])
                if a != b:
                    parent[a] = b
                    out.append((node, inner[j][0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, outer, inner = None, [], []
        for batch in batches:
            made = []
            columns = [batch.column(c).to_pylist() for c in range(5)]
            elements = batch.column(5)
            for i, key in enumerate(zip(*columns[:3], strict=True)):
                if key != group:
                    made += links(outer, inner) if outer and inner else []
                    group, outer, inner = key, [], []
                (inner if columns[3][i] else outer).append((columns[4][i], elements[i].values.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)], ["a", "b"])
        made = links(outer, inner) if outer and inner else []
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def set_links(docs: DataFrame, keyed: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Components (node, root) of the set keys that are linked; nodes without a link are absent.

    docs: text, text_hash; keyed: text_hash, set_key, n_shingles and sketches of every row.
    """
    spark, scratch = docs.sparkSession, []
    sigs = docs.select("text").mapInArrow(_emit(shingle, percent), "sig long, node long")
    met = materialized(
        sigs.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(
            textkit.repeated_runs(["sig", "node"]), "sig long, node long"
        ), scratch,
    )
    counts = met.groupBy("sig").agg(F.count("*").alias("n"))
    degree = materialized(met.join(counts, "sig").groupBy("node").agg(F.sum("n").alias("degree")), scratch)
    pivots = met.join(degree, "node").groupBy("sig").agg(F.max(F.struct("degree", "node"))["node"].alias("pivot"))
    groups = materialized(met.join(pivots, "sig").select("pivot", "node").distinct(), scratch)
    any_of = [F.any_value(c).alias(c) for c in ("band", "own", "below")]
    members = groups.select("node").distinct()
    likely = with_mark(keyed.withColumn("hash", F.col("set_key")), members).where("marked").drop("hash", "marked")
    nodes = materialized(
        likely.withColumnRenamed("set_key", "node").join(members, "node", "left_semi")
        .groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.any_value("n_shingles").alias("n"), *any_of), scratch,
    )
    possible = materialized(candidates(groups, nodes, percent), scratch)

    def whole_sets(wanted: DataFrame) -> DataFrame:
        """The sets of the wanted nodes, one row each. Only texts that the marks let through are sent, and copies of a text
        once per task."""
        texts = nodes.join(wanted.distinct(), "node", "left_semi").select("text_hash")
        likely = with_mark(docs.withColumn("hash", F.col("text_hash")), texts).where("marked")
        once = likely.groupBy("text_hash").agg(F.any_value("text").alias("text"))
        # the list of texts grows with the input, so it is never broadcast whole, whatever its size
        found = once.join(texts.hint("merge"), "text_hash", "left_semi").select("text")
        return materialized(found.mapInArrow(_whole_sets(shingle), "node long, elements array<bigint>"), scratch)

    sets = whole_sets(possible.select(F.explode(F.array("pivot", "node")).alias("node")))
    # Every node first meets only the best of its possible pivots; most groups are one component after that.
    best = possible.join(degree.select(F.col("node").alias("pivot"), "degree"), "pivot").groupBy("node").agg(
        F.max(F.struct("degree", "pivot"))["pivot"].alias("pivot")
    )
    best = materialized(best.select("pivot", "node"), scratch)
    roots = materialized(components(materialized(linked(best, sets, percent), scratch), scratch), scratch)
    apart = possible.join(roots, "node", "left").join(
        roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root")), "pivot", "left"
    ).where(F.coalesce("root", "node") != F.coalesce("pivot_root", "pivot"))
    apart = materialized(apart.select("pivot", "node").join(best, ["pivot", "node"], "left_anti"), scratch)
    roots = materialized(extended(roots, materialized(linked(apart, sets, percent), scratch), scratch), scratch)
    own = groups.join(roots, "node", "left").select("pivot", "node", F.coalesce("root", "node").alias("root"))
    pivot_root = roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    own = own.join(pivot_root, "pivot", "left").withColumn("outer", F.col("root") != F.coalesce("pivot_root", "pivot"))
    counts = own.groupBy("pivot").agg(
        F.ceil(F.count("*") / BLOCK).alias("inner_blocks"), F.ceil(F.sum(F.col("outer").cast("int")) / BLOCK).alias("outer_blocks"),
        F.count("*").alias("members"),
    ).where("outer_blocks > 0 and members > 2")
    own = own.join(counts, "pivot")
    spread = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks))
    outer = own.where("outer").select(
        "pivot", spread("outer_blocks").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("inner_blocks") - 1)).alias("j"),
        F.lit(0).alias("role"), "node",
    )
    inner = own.select(
        "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer_blocks") - 1)).alias("i"), spread("inner_blocks").alias("j"),
        F.lit(1).alias("role"), "node",
    )
    block, order = ["pivot", "i", "j"], ["pivot", "i", "j", "role", "node"]
    left = materialized(
        outer.unionByName(inner).join(nodes.select("node", *SKETCH), "node").select(*order, *SKETCH)
        .repartition(*block).sortWithinPartitions(*order)
        .mapInArrow(_block_candidates(percent), "pivot long, i long, j long, role int, node long"), scratch,
    )
    if not left.isEmpty():
        missing = materialized(left.select("node").distinct().join(sets.select("node"), "node", "left_anti"), scratch)
        if not missing.isEmpty():
            sets = sets.unionByName(whole_sets(missing))
        rest = (
            left.join(sets, "node").select(*order, "elements")
            .repartition(*block).sortWithinPartitions(*order).mapInArrow(_block_links(percent), "a long, b long")
        )
        roots = extended(roots, materialized(rest, scratch), scratch)
    roots = materialized(roots)
    discard(spark, scratch)
    return roots


def grouped(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, set_key, n_shingles, root, component_id) of every row of ``docs`` (doc_id, text).

    root names the component by one of its set keys, also where ids are null or used by several components.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, set_key long, band int, own binary, below binary"
    keyed = materialized(docs.mapInArrow(_keyed(shingle, percent, docs.columns), kind))
    roots = set_links(docs, keyed.where("set_key is not null"), shingle, percent)
    own = keyed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    own = own.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(least, "root").select("set_key", "root", "component_id")
    return keyed.join(named, "set_key", "left").select(
        "doc_id", "text_hash", "set_key", "n_shingles", "root",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of every component the row of the smallest id stays.

    Rows without words stay. Null ids come last; of equal ids the smallest set key stays, then the smallest hash of the
    text, of repeated rows with all three one. Components that share an id are told apart by their roots. Only rows that
    are, by their marks, likely to go or to be repeated are shuffled.
    """
    found = grouped(docs, shingle, percent).where("set_key is not null")
    counted = found.groupBy("root", "doc_id", "set_key", "text_hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "set_key", "text_hash")
    keep = counted.groupBy("root").agg(F.count("*").alias("kinds"), F.max("n").alias("most"), F.min(order).alias("first"))
    keep = keep.where("kinds > 1 or most > 1")
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))
    several = materialized(counted.join(keep, "root").where(~stays | (F.col("n") > 1)).select(
        F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_text"), stays.alias("stays"),
        F.xxhash64("doc_id", "text_hash").alias("of_hash"),
    ))
    rows = textkit.shielded(docs).withColumn("text_hash", F.xxhash64("in_text"))
    rows = with_mark(rows.withColumn("hash", F.xxhash64("in_doc_id", "text_hash")), several.select("of_hash"))
    joined = rows.where("marked").join(several, F.col("in_doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_text")), "left")
    alone = rows.where("not marked").unionByName(joined.where("stays is null").select(*rows.columns))
    own = [f"in_{c}" for c in docs.columns]
    repeated = joined.where("stays").groupBy("of_id", "of_text").agg(F.any_value(F.struct(*own)).alias("row")).select("row.*")
    return textkit.restored(alone, docs.columns).unionByName(textkit.restored(repeated, docs.columns))


def op10_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under the shingle join."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grouped(docs).select("doc_id", "n_shingles", "component_id")
