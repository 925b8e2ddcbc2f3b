"""Conversation repair: every edit string of short rows, hash collisions, segments, odd rows, a plain version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from faultline.llm import repair

PATTERN = re.compile(r"(s?(ua)+)?\Z")


def all_edits(rows):
    """(cost, audit) of every edit string with at most two inserts before each row and at the end."""
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]

    def choices(i):
        initial, must_go, cut = rows[i]
        yield 2, "D", ""
        if not must_go:
            yield 5 * cut, "K", initial if initial else "?"
            yield 1 + 5 * cut, "R", "u"
            yield 1 + 5 * cut, "R", "a"

    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for picked in itertools.product(*[list(choices(i)) for i in range(len(rows))]):
            roles = "".join("".join(g) + p[2] for g, p in zip(gaps, picked)) + "".join(gaps[-1])
            if PATTERN.match(roles):
                audit = "".join("I" * len(g) + p[1] for g, p in zip(gaps, picked)) + "I" * len(gaps[-1])
                yield 5 * sum(map(len, gaps)) + sum(p[0] for p in picked), audit


def finished(rows):
    tables = [{(0, b): v[:2] for b, v in repair.cheapest(rows, 0).items()}]
    cost, ((_, end),) = repair.path_through(tables)
    return cost, repair.cheapest(rows, 0)[end][2] + "I" * repair.TAIL[end]


KINDS = [(i, g, c) for i in ("s", "u", "a", "x") for g, c in ((False, False), (False, True), (True, False))]


def test_short_conversations_against_every_edit_string():
    rng = random.Random(3)
    for n in (1, 2, 3):
        for rows in [tuple(rng.choice(KINDS) for _ in range(n)) for _ in range(40)]:
            assert finished(rows) == min(all_edits(rows)), rows


def plain(rows):
    """The same program with whole strings instead of nodes."""
    best = {0: (0, "")}
    for row in rows:
        found = {}
        for state, (cost, text) in best.items():
            for k, entered in enumerate(repair.INSERTED[state]):
                for after, price, letter in repair._options(entered, row):
                    option = (cost + 5 * k + price, text + "I" * k + letter)
                    found[after] = min(found.get(after, option), option)
        best = found
    return min((c + 5 * repair.TAIL[s], t + "I" * repair.TAIL[s]) for s, (c, t) in best.items())


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 7, 2, 1])
def test_ties_and_hash_collisions(prime):
    rng = random.Random(prime)
    for n in (5, 20, 90):
        for _ in range(8):
            rows = tuple(rng.choice(KINDS) for _ in range(n))
            found = repair.cheapest(rows, 0, repair.Paths(prime=prime))
            best = min((c + 5 * repair.TAIL[s], t + "I" * repair.TAIL[s]) for s, (c, _, t) in found.items())
            assert best == plain(rows)
            by_place = sorted(found.values(), key=lambda v: v[1])
            assert [v[2] for v in by_place] == sorted(v[2] for v in found.values())


def test_segments_give_the_whole_solution():
    rng = random.Random(11)
    for size in (1, 3, 10):
        for _ in range(10):
            rows = tuple(rng.choice(KINDS) for _ in range(43))
            parts = [rows[i:i + size] for i in range(0, len(rows), size)]
            solved = [{(a, b): v for a in ((0,) if not i else range(4)) for b, v in repair.cheapest(p, a).items()} for i, p in enumerate(parts)]
            cost, steps = repair.path_through([{k: v[:2] for k, v in t.items()} for t in solved])
            audit = "".join(t[s][2] for t, s in zip(solved, steps)) + "I" * repair.TAIL[steps[-1][1]]
            assert (cost, audit) == plain(rows)


def expected(table):
    """The whole query with plain Python."""
    seen, out = {}, []
    space = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in table:
        seen.setdefault(conv, [])
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        seen[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, rows in seen.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, marks, earlier = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
        for _, role, text in rows:
            visible = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not visible else "duplicate" if (role, text) in earlier else "truncated" if visible[-1] not in ".!?" else None
            earlier.add((role, text))
            if fault:
                counts[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit = plain(marks) if rows else (0, "")
        kept, state, at = [], "", 0
        for letter in audit:
            wanted = "a" if state == "u" else "u"
            if letter == "I":
                kept.append(("user" if wanted == "u" else "assistant") + ":")
                state = wanted
                continue
            _, role, text = rows[at]
            at += 1
            if letter == "K":
                kept.append(f"{role}:{text}")
                state = role[0]
            elif letter == "R":
                kept.append(("user" if wanted == "u" else "assistant") + ":" + text)
                state = wanted
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def odd_table():
    rng = random.Random(9)
    texts = ["Yes.", "No!", "open end", "", " \n\t", None, "Ünï?", "a.\n", "x" * 50_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    table = [
        (rng.choice([*range(40), None]), rng.choice([*range(9), None]), rng.choice(roles), rng.choice(texts)) for _ in range(900)
    ]
    table += table[:60]  # repeated rows
    table += [(700 + i, 0, "user", "Alone.") for i in range(60)]  # some lose their only row
    return table


def test_odd_rows_against_the_plain_version(spark, tmp_path):
    table = odd_table()
    spark.createDataFrame(table, SCHEMA).withColumn("key", F.lit(1)).withColumn("part", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    out = repair.op12_audit_repair(spark, str(tmp_path))
    assert out.columns == COLUMNS
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected(table)


def test_hot_conversation_in_segments(spark):
    rng = random.Random(4)
    table = [(1, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice([f"t {i % 90}.", "cut", f"n{i}!"])) for i in range(700)]
    table += [(2, None, "user", f"same turn {i}.") for i in range(60)]
    rows = repair.damaged(spark.createDataFrame(table, SCHEMA))
    whole, cut = repair.Repair(rows), repair.Repair(rows, segment=50)
    assert cut.segments.groupBy("key").count().agg(F.max("count")).first()[0] > 10
    for name in ("costs", "audits", "faults"):
        a, b = getattr(whole, name)().collect(), getattr(cut, name)().collect()
        assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)
    want = {r[0]: r for r in expected(table)}
    assert {r["key"]: (r["audit"], r["repaired_sha256"]) for r in cut.audits().collect()} == {f"={k}": v[7:] for k, v in want.items()}


def test_repaired_rows_alternate(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, 2, "user", "Go on."), (2, 0, "user", "")], SCHEMA)
    out = repair.Repair(rows).repaired().orderBy("key", "place").collect()
    assert [(r["key"], r["place"], r["edit"], r["role"], r["text"]) for r in out] == [
        ("=1", 0, "R", "user", "Hi."), ("=1", 1, "R", "assistant", "Go on."),
    ]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op12_audit_repair(spark, str(tmp_path)).collect() == []
