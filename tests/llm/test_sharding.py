import random
import zlib
from collections import defaultdict

from faultline.llm import sharding


def test_pack_is_best_fit_decreasing():
    sizes = [5, 7, 5, 2, 4, 2, 5, 1, 6]
    room, bins = {}, {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = sorted((r, b) for b, r in room.items() if r >= sizes[i])
        b = fits[0][1] if fits else len(room)
        room[b] = room.get(b, 10) - sizes[i]
        bins[i] = b
    assert sharding.pack(sizes, 10) == [bins[i] for i in range(len(sizes))]
    assert len(set(sharding.pack([11, 3], 10))) == 2
    assert max(sharding.pack_into([4, 4, 4, 4, 2, 2], 2)) == 1 and sharding.pack_into([], 3) == []


def check(rows, docs, shards=16):
    assert len(rows) == len(docs)
    slots, by_text, load = defaultdict(list), defaultdict(set), defaultdict(int)
    texts = defaultdict(list)
    for d, t in docs:
        texts[(d, zlib.crc32((t or "").encode()))].append(t)
    for r in rows:
        t = texts[(r.doc_id, r.text_crc32)][0]
        assert r["size"] == len((t or "").encode()) + 1 and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        by_text[t or ""].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())
    return load


def test_groups_stay_together_on_odd_rows(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice([None, "", "é" * rng.randrange(300), "same " * 40])) for i in range(700)] + [(None, "x"), (3, "y"), (3, "y")]
    d = spark.createDataFrame([(*r, "b") for r in docs], "doc_id long, text string, shard string")
    check(sharding.shard(d).collect(), docs)
    assert sharding.shard(d.limit(0)).count() == 0


def test_query_over_the_whole_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    load = check(sharding.op2_best_fit(spark, small).collect(), docs)
    total = sum(load.values())
    largest = max(len(t.encode()) + 1 for _, t in docs)
    assert max(load.values()) <= total / 16 + largest and len(load) == 16


def single_best_fit(sizes, capacity):
    """Item by item, largest first, each into the fullest bin that holds it."""
    room, loads = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, b) for b, r in enumerate(room) if r >= s]
        if fits:
            b = min(fits)[1]
        else:
            b = len(room)
            room.append(max(capacity, s))
            loads.append(0)
        room[b] -= s
        loads[b] += s
    return loads


def test_packing_a_histogram_is_packing_its_items():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 3, 7, 7, 7, 20, rng.randrange(1, 60)]) for _ in range(rng.randrange(1, 80))]
        capacity = rng.randrange(5, 90)
        loads = defaultdict(int)
        for s, b in zip(sizes, sharding.pack(sizes, capacity), strict=True):
            loads[b] += s
        assert [loads[b] for b in range(len(loads))] == single_best_fit(sizes, capacity)
        into = sharding.pack_into(sizes, 4)
        assert max(into) < 4


def test_tree_finds_the_tightest_room():
    rng, rooms, plain = random.Random(5), sharding.Rooms(), set()
    for i in range(3000):
        if rng.random() < 0.6:
            item = (rng.randrange(500), i)
            rooms.add(item)
            plain.add(item)
        else:
            size = rng.randrange(600)
            found = min((x for x in plain if x[0] >= size), default=None)
            assert rooms.take_tightest(size) == found
            plain.discard(found)


def test_groups_are_packed_one_by_one_whatever_their_size(spark, small):
    """Loads are those of best fit over all groups of the table, at the smallest capacity for 16 bins."""
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    load = check(sharding.shard(spark.read.parquet(f"{small}/documents.parquet")).collect(), docs)
    by_text = defaultdict(int)
    for _, t in docs:
        by_text[t or ""] += len((t or "").encode()) + 1
    sizes = list(by_text.values())
    found = next(
        loads for loads in (single_best_fit(sizes, c) for c in range(max(load.values()), sum(sizes))) if len(loads) <= 16
    )
    assert sorted(load.values()) == sorted(found)


def test_many_groups_of_one_size_and_a_hot_text(spark):
    docs = [(i, f"{i:08d}") for i in range(5000)] + [(9000 + i, "copy") for i in range(2500)] + [(None, None), (1, "x" * 200_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    load = check(sharding.shard(d).collect(), docs)
    assert load[max(load, key=load.get)] >= 200_001 and len(load) == 16
    rest = sorted(load.values())[:-1]
    assert rest[-1] - rest[0] <= 2500 * 5
