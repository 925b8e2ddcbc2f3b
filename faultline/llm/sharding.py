"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts, told apart by a 128-bit digest) are sorted by size, largest first; each enters the bin with
the tightest remaining capacity that still holds it, found in a balanced tree of remaining capacities; a new bin
opens when none does. For a fixed number of bins, the capacity is the smallest one (found by bisection) for which
the groups fit; a group above it gets a bin of its own size, and does not count for the mean that the others share.

Groups of one size are interchangeable, so only the histogram (size, number of groups) is packed: while the
tightest bin holds more of a size, it stays the tightest one, and takes them together. A corpus of B bytes has at
most sqrt(2 B) different sizes, whatever the number of groups. Each group then finds its bin by its rank among the
groups of its size; ranks are counted per cell, so that a size of very many groups is not one task. The rows join
the bins of their groups by text; texts of more than 1 / HOT of all rows, of which there are at most HOT, are
broadcast, so no task gets more than that share of the rows.

Cases: a null text counts as empty; an empty table gives an empty result; repeated rows and null ids stay in
one shard with their text; groups never break; further columns are not read.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from faultline.sources.storage import materialized

SHARDS = 16
#: A text is hot above this share (1 / HOT) of all rows; there are at most HOT of them.
HOT = 4096
#: Rows of a shard, and groups of a size, are numbered in this number of cells.
CELLS = 1024
#: Runs of the packing are broadcast up to this number (of 32 bytes), and joined by a shuffle beyond it.
BROADCAST_RUNS = 500_000


class Rooms:
    """Ordered set of (room, bin), kept as a treap: a search tree balanced by random heap keys."""

    def __init__(self) -> None:
        self.root, self.random = None, random.Random(0)

    def add(self, item: tuple[int, int]) -> None:
        low, high = self._split(self.root, item)
        self.root = self._merge(self._merge(low, [item, self.random.random(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest (room, bin) whose room holds ``size``."""
        low, high = self._split(self.root, (size, -1))
        found = self._first(high)
        if found is not None:
            high = self._split(high, (found[0], found[1] + 1))[1]
        self.root = self._merge(low, high)
        return found

    @staticmethod
    def _first(node):
        while node is not None and node[2] is not None:
            node = node[2]
        return node and node[0]

    def _split(self, node, item):
        """Trees of what lies before ``item``, and of the rest."""
        if node is None:
            return None, None
        if node[0] < item:
            low, high = self._split(node[3], item)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], item)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, low, high):
        if low is None or high is None:
            return low if high is None else high
        if low[1] > high[1]:
            return [low[0], low[1], low[2], self._merge(low[3], high)]
        return [high[0], high[1], self._merge(low, high[2]), high[3]]


def pack_histogram(
    counts: list[tuple[int, int]], capacity: int, limit: int | None = None
) -> list[tuple[int, int, int]] | None:
    """Best fit decreasing of (size, count) pairs sorted by size, largest first: runs (size, bin, count).

    An item above the capacity gets a bin alone. None if more than ``limit`` bins would open.
    """
    rooms, bins, runs = Rooms(), 0, []
    for size, left in counts:
        while left:
            found = rooms.take_tightest(size)
            if found is None:
                if bins == limit:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            room, number = found
            taken = min(left, room // size)
            runs.append((size, number, taken))
            rooms.add((room - taken * size, number))
            left -= taken
    return runs


def pack_histogram_into(counts: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Runs for a fixed number of bins, with the smallest capacity that bisection finds."""
    if not counts:
        return []
    # Items above the mean of what is left get bins of their own; the others share the bins that are left.
    rest, free = sum(s * n for s, n in counts), bins
    largest = 0
    for size, count in counts:
        alone = 0
        while alone < count and free > 1 and size * free > rest:
            rest, free, alone = rest - size, free - 1, alone + 1
        if alone < count:
            largest = size
            break
    # With room for one more item above that mean, an item that fits nowhere would mean more than all bytes.
    low = max(1, -(-rest // free))
    high = low + largest
    best = pack_histogram(counts, high, bins)
    while low < high:
        middle = (low + high) // 2
        found = pack_histogram(counts, middle, bins)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return best


def _of_items(sizes: list[int], runs: list[tuple[int, int, int]]) -> list[int]:
    waiting = defaultdict(list)
    for size, number, count in reversed(runs):
        waiting[size].extend([number] * count)
    return [waiting[s].pop() for s in sizes]


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item by best fit decreasing; an item above the capacity gets a bin alone."""
    return _of_items(sizes, pack_histogram(sorted(Counter(sizes).items(), reverse=True), capacity))


def pack_into(sizes: list[int], bins: int) -> list[int]:
    """Bins of single items for a fixed number of them."""
    return _of_items(sizes, pack_histogram_into(sorted(Counter(sizes).items(), reverse=True), bins))


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with size, checksum and the key of the text; the text itself goes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text).alias("text_key"), F.xxhash64(text).alias("text_hash"),
    )


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` of ``sized`` with shard and slot; equal texts stay together, bytes are near equal."""
    rows = materialized(rows)
    cell = F.pmod(F.xxhash64("text_key"), F.lit(CELLS)).cast("int")
    groups = materialized(rows.groupBy("text_key").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies")
    ).withColumn("cell", cell))
    # One row per size: at most the square root of twice the bytes of the corpus.
    histogram = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes")).collect()
    runs = pack_histogram_into([(r["bytes"], r["n"]) for r in histogram], shards)
    homes = group_shards(groups, runs)
    hot_from = rows.count() // HOT
    is_hot = F.col("copies") > hot_from
    # at most HOT texts have more copies than that
    hot = homes.where(is_hot).select("text_key", F.col("shard").alias("hot_shard"))
    cold = homes.where(~is_hot).select("text_key", F.col("shard").alias("cold_shard"))
    marked = rows.join(F.broadcast(hot), "text_key", "left")
    columns = [*rows.columns, F.coalesce("hot_shard", "cold_shard").alias("shard")]
    placed = marked.where(F.col("hot_shard").isNotNull()).select(*rows.columns, F.col("hot_shard").alias("shard")).unionByName(
        marked.where(F.col("hot_shard").isNull()).join(cold, "text_key").select(*columns)
    )
    return numbered(materialized(placed), shards)


def group_shards(groups: DataFrame, runs: list[tuple[int, int, int]]) -> DataFrame:
    """``groups`` (text_key, bytes, copies, cell) with the shard of the run that holds a group's rank in its size."""
    upto: Counter = Counter()
    spans = []
    for size, number, count in runs:
        spans.append((size, number, upto[size], upto[size] + count))
        upto[size] += count
    table = groups.sparkSession.createDataFrame(spans, "bytes long, shard int, first long, last long")
    if len(spans) <= BROADCAST_RUNS:
        table = F.broadcast(table)
    counts = groups.groupBy("bytes", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        "bytes", "cell", (F.sum("n").over(Window.partitionBy("bytes").orderBy("cell")) - F.col("n")).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("bytes", "cell").orderBy("text_key")) - 1
    ranked = groups.withColumn("inside", inside).join(before, ["bytes", "cell"])
    rank = F.col("before") + F.col("inside")
    return ranked.withColumn("rank", rank).join(table, "bytes").where(
        (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    ).select("text_key", "copies", "shard")


def numbered(placed: DataFrame, shards: int) -> DataFrame:
    """Gapless slots per shard: rows are counted per cell, and a row's slot is its cell's offset plus its place in it."""
    cell = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(CELLS)).cast("int")
    placed = placed.withColumn("cell", cell)
    counts = placed.groupBy("shard", "cell").count()
    before = counts.select(
        "shard", "cell",
        (F.sum("count").over(Window.partitionBy("shard").orderBy("cell")) - F.col("count")).alias("before"),
    )
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_hash", "size"))
    return placed.withColumn("inside", inside).join(F.broadcast(before), ["shard", "cell"]).withColumn(
        "slot", (F.col("before") + F.col("inside") - 1).cast("long")
    ).drop("before", "inside", "cell")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    return assign(sized(docs.select("doc_id", "text")), shards)


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of near-equal bytes."""
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
