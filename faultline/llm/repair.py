"""Conversation structure repair by dynamic programming over edits with persistent audits.

The rows of a conversation, in turn order, are kept (K), given the role user or assistant (R), deleted (D), or
preceded by inserted empty rows (I), so that the role initials become ``(s?(ua)+)?`` at the least cost. After each
row the program holds, for each of the four states of that pattern, the cheapest edits that lead there. Edits are
nodes that share their prefixes; a node knows its ancestors at distances of powers of two and a rolling hash of its
path. Of two paths of equal cost the ASCII-least wins: their longest common prefix is found by jumps over equal
hashes and then verified, letter by letter, until both paths meet in one node; where hashes of unlike paths met,
the letters alone decide.

Equal rows of a conversation and turn are one row with a count, since all but the first of them have to go. A
conversation of more than ``SEGMENT`` such rows is cut into segments by rank. A segment yields, for every pair of
states, its cheapest edits; a fold over these small tables picks a path through the segments, comparing paths by the
order of their prefixes and then of their parts. So no task holds more than a segment of rows, and repaired rows and
their digest are read off the sorted rows as a stream.

Cases: a null role, text, conversation or turn counts as one space wherever its text is needed; null turns come
first and null ids are one conversation; rows of one turn go by role and text. A text without visible characters is
blank, whatever its length. A turn range beyond 64 bits has null gaps. A conversation without rows is neither repaired
nor reported here (the query reports it with zeros); an empty table gives an empty table; further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from faultline.operators.ordered import core_rows, ordered_blocks
from faultline.sources.storage import materialized

#: Rows of a conversation in one segment, copies not counted.
SEGMENT = 20_000
#: Rows up to which equal sequences are solved once per task.
SHORT = 12
#: Costs of the edits, and what a truncated row that stays adds.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NO_TEXT = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: State after inserting 0, 1 or 2 rows; more would repeat a state.
INSERTED = {START: (START, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (ASSISTANT, USER)}
#: State after a row of role user or assistant, and rows inserted after the last one to end the pattern.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = ("su", "ua", "au")


class Paths:
    """Tree of edit strings: a node is its parent's string and one letter."""

    def __init__(self, base: int = 1_000_003, prime: int = (1 << 61) - 1):
        self.base, self.prime = base, prime
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, parent: int, letter: str) -> int:
        node = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.base + ord(letter)) % self.prime)
        ups, k = [parent], 0
        while k < len(self.up[ups[k]]):
            ups.append(self.up[ups[k]][k])
            k += 1
        self.up.append(ups)
        return node

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def at_depth(self, node: int, depth: int) -> int:
        rest = self.depth[node] - depth
        while rest:
            node = self.up[node][rest.bit_length() - 1]
            rest = self.depth[node] - depth
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth have the same letters: checked up to the node that both share."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def before(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` sorts before that of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.at_depth(a, depth), self.at_depth(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        if self.hash[x] == self.hash[y]:
            if self.same(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)
        # the highest ancestors whose hashes differ; their parents end the common prefix
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]):
                p, q = self.up[x][k], self.up[y][k]
                if self.hash[p] != self.hash[q]:
                    x, y = p, q
        if self.letter[x] != self.letter[y] and self.same(self.up[x][0], self.up[y][0]):
            return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)


def _options(state: int, row: tuple[str, bool, bool]) -> Iterator[tuple[int, int, str]]:
    """(state after, cost, letter) of the ways to treat one row."""
    initial, must_go, truncated = row
    yield state, DELETE, "D"
    if must_go:
        return
    stays = TRUNCATED if truncated else 0
    after = NEXT[state]
    if initial == "s" and state == START:
        yield SYSTEM, stays, "K"
    if initial == ("a" if after == ASSISTANT else "u"):
        yield after, stays, "K"
    else:
        yield after, RELABEL + stays, "R"


def cheapest(rows: tuple[tuple[str, bool, bool], ...], start: int, paths: Paths | None = None) -> dict[int, tuple[int, int, str]]:
    """state -> (cost, place, edits) of the cheapest, then ASCII-least, edits of the rows from the state ``start``.

    ``place`` ranks the edit strings of the reached states. A row is (role initial, has to go, truncated).
    """
    paths = paths or Paths()
    best: dict[int, tuple[int, int]] = {start: (0, 0)}
    for row in rows:
        found: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in best.items():
            for inserts, entered in enumerate(INSERTED[state]):
                if inserts:
                    node = paths.add(node, "I")
                for after, price, letter in _options(entered, row):
                    total = cost + inserts * INSERT + price
                    known = found.get(after)
                    if known is None or total <= known[0]:
                        made = paths.add(node, letter)
                        if known is None or total < known[0] or paths.before(made, known[1]):
                            found[after] = (total, made)
        best = found
    order: list[int] = []
    for state in best:
        at = 0
        while at < len(order) and paths.before(best[order[at]][1], best[state][1]):
            at += 1
        order.insert(at, state)
    return {s: (best[s][0], place, paths.text(best[s][1])) for place, s in enumerate(order)}


_short = lru_cache(maxsize=1 << 15)(cheapest)


def solved(rows: tuple[tuple[str, bool, bool], ...], start: int) -> dict[int, tuple[int, int, str]]:
    return _short(rows, start) if len(rows) <= SHORT else cheapest(rows, start)


def path_through(tables: list[dict[tuple[int, int], tuple[int, int]]]) -> tuple[int, list[tuple[int, int]]]:
    """(cost with the closing inserts, (from, to) of every segment) from tables (from, to) -> (cost, place)."""
    reached, back = {START: (0, 0)}, []
    for table in tables:
        found = {}
        for (a, b), (cost, place) in table.items():
            if a in reached:
                option = (reached[a][0] + cost, reached[a][1], place, a)
                found[b] = min(found.get(b, option), option)
        order = sorted(found, key=lambda b: found[b][1:3])
        back.append({b: found[b][3] for b in found})
        reached = {b: (found[b][0], order.index(b)) for b in found}
    end = min(reached, key=lambda b: (reached[b][0] + INSERT * TAIL[b], reached[b][1]))
    cost, steps = reached[end][0] + INSERT * TAIL[end], []
    for choice in reversed(back):
        steps.append((choice[end], end))
        end = choice[end]
    return cost, steps[::-1]


# ---------------------------------------------------------------- rows and their faults
def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that the checksum of ``conv_id:turn`` deals out."""
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_spaced("text"), ".!?", "")).otherwise(_spaced("text"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(_spaced("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv_id, turn, role, text): number of copies, role initial and faults.

    ``key`` is the conversation as a text that is never null; ``repeated`` says that role and text come earlier.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key")
    one = rows.select(key, "conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text")).groupBy(
        "key", "conv_id", "turn", "role", "text"
    ).agg(F.count(F.lit(1)).alias("copies"))
    # role and text as one digest of 256 bits; the length keeps the border between them
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    one = materialized(one.withColumn("same", same))
    first = one.groupBy("key", "same").agg(F.min(when).alias("first"))
    visible = F.rtrim(F.col("text"), F.lit(NO_TEXT))
    return one.join(first, ["key", "same"]).select(
        "key", "conv_id", "turn", "role", "text", "copies", F.substring("role", 1, 1).alias("initial"),
        (visible == "").alias("blank"), (when != F.col("first")).alias("repeated"),
        (~F.substring(visible, -1, 1).isin(*STOPS)).alias("cut"),
    )


def placed(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows of :func:`marked` with their segment ``part`` and ``place`` inside it."""
    order = ["turn", "role", "text"]
    blocks, _ = ordered_blocks(rows, ["key"], order, before=0, hot_rows=segment)
    within = Window.partitionBy("key", "_hot", "_block").orderBy(*order)
    out = blocks.withColumns({"place": F.row_number().over(within), "part": F.col("_block")})
    return core_rows(out)


# ---------------------------------------------------------------- segments
def _grouped(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Groups of sorted rows by the columns ``names``, one row at a time."""
    from itertools import groupby

    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[n] for n in names))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


SEGMENT_SCHEMA = pa.schema([
    ("key", pa.string()), ("part", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
    ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int32())), ("edits", pa.list_(pa.string())),
])
SEGMENT_KIND = "key string, part long, illegal long, head string, tail string, cost array<long>, rank array<int>, edits array<string>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per segment: its cheapest edits between all states, in lists of 16, null where there is no way."""

    def solve() -> Iterator[tuple]:
        for (key, part), rows in _grouped(batches, ("key", "part")):
            sequence, extra, illegal, head, last = [], 0, 0, None, None
            for r in rows:
                sequence.append((r["initial"], r["blank"] or r["repeated"], r["cut"]))
                extra += (r["copies"] - 1) * DELETE
                illegal += r["copies"] - 1 + (last is not None and last + r["initial"] not in LEGAL)
                head, last = (r["initial"] if head is None else head), r["initial"]
            found = {}
            for start in STATES if part else (START,):
                for end, (cost, rank, edits) in solved(tuple(sequence), start).items():
                    found[4 * start + end] = (cost + extra, rank, edits)
            lists = [[found[i][c] if i in found else None for i in range(16)] for c in range(3)]
            yield (key, part, illegal, head, last, *lists)

    return _batches(solve(), SEGMENT_SCHEMA, 64)


CHOICE_SCHEMA = pa.schema([("key", pa.string()), ("part", pa.int64()), ("way", pa.int32()), ("cost", pa.int64()), ("illegal", pa.int64())])


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way taken through each segment; the first one carries the cost and the illegal neighbours of the conversation."""

    def choose() -> Iterator[tuple]:
        for (key,), rows in _grouped(batches, ("key",)):
            tables, parts, illegal, last = [], [], 0, None
            for r in rows:
                parts.append(r["part"])
                tables.append({divmod(i, 4): (c, r["rank"][i]) for i, c in enumerate(r["cost"]) if c is not None})
                illegal += r["illegal"] + (last is not None and last + r["head"] not in LEGAL)
                last = r["tail"]
            cost, steps = path_through(tables)
            for i, (part, (a, b)) in enumerate(zip(parts, steps, strict=True)):
                yield key, part, 4 * a + b, 0 if i else cost, 0 if i else illegal

    return _batches(choose(), CHOICE_SCHEMA)


def _repaired(batches: Iterator[pa.RecordBatch], take: Callable) -> Iterator[tuple]:
    """Walk the rows of each conversation with the edits of its segments; ``take(key, items)`` gets (edit, role, text)."""

    def items(rows: Iterator[dict]) -> Iterator[tuple[str, str | None, str | None]]:
        state, edits = START, iter("")
        for r in rows:
            if r["edits"] is not None:
                edits = iter(r["edits"])
                continue
            for letter in edits:
                if letter == "D":
                    yield letter, None, None
                elif letter == "K":
                    state = SYSTEM if state == START and r["initial"] == "s" else NEXT[state]
                    yield letter, r["role"], r["text"]
                else:
                    state = NEXT[state]
                    yield letter, "user" if state == USER else "assistant", "" if letter == "I" else r["text"]
                if letter != "I":
                    break
            for _ in range(r["copies"] - 1):
                yield "D", None, None
        for _ in range(TAIL[state]):
            state = NEXT[state]
            yield "I", "user" if state == USER else "assistant", ""

    for (key,), rows in _grouped(batches, ("key",)):
        yield from take(key, items(rows))


def _digest(key: str, items: Iterator) -> Iterator[tuple]:
    digest, letters, some = hashlib.sha256(), [], False
    for letter, role, text in items:
        letters.append(letter)
        if role is not None:
            digest.update((("\n" if some else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            some = True
    yield key, "".join(letters), digest.hexdigest()


def _rows(key: str, items: Iterator) -> Iterator[tuple]:
    place = 0
    for letter, role, text in items:
        if role is not None:
            yield key, place, letter, role, text
            place += 1


class Repair:
    """Faults, audits and repaired rows of a conversation table; ``segment`` bounds the rows solved in one piece."""

    def __init__(self, rows: DataFrame, segment: int = SEGMENT):
        self.rows = materialized(placed(materialized(marked(rows)), segment))
        slim = self.rows.select("key", "part", "place", "initial", "blank", "repeated", "cut", "copies")
        # the counts are as small as the rows without their texts; a segment is bounded, so is a task's group
        self.segments = materialized(
            slim.repartition("key", "part").sortWithinPartitions("key", "part", "place").mapInArrow(_segments, SEGMENT_KIND)
        )
        tables = self.segments.drop("edits").repartition("key").sortWithinPartitions("key", "part")
        self.choices = materialized(
            tables.mapInArrow(_choices, "key string, part long, way int, cost long, illegal long")
        )

    def faults(self) -> DataFrame:
        """Per conversation: key, conv_id, gaps, blank, duplicate, truncated."""
        copies, blank, again = F.col("copies"), F.col("blank"), F.col("repeated")
        wide = [f(F.col("turn").cast("decimal(38,0)")) for f in (F.max, F.min)]
        gaps = F.when(F.count("turn") == 0, 0).otherwise((wide[0] - wide[1] + 1 - F.count_distinct("turn")).try_cast("long"))
        return self.rows.groupBy("key", "conv_id").agg(
            gaps.cast("long").alias("gaps"),
            F.sum(F.when(blank, copies).otherwise(0)).alias("blank"),
            F.sum(F.when(blank, 0).when(again, copies).otherwise(copies - 1)).alias("duplicate"),
            F.count_if(~blank & ~again & F.col("cut")).alias("truncated"),
        )

    def costs(self) -> DataFrame:
        """Per conversation: key, cost, illegal."""
        return self.choices.groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))

    def _walk(self, take: Callable, schema: pa.Schema, kind: str) -> DataFrame:
        taken = self.segments.select("key", "part", "edits").join(self.choices.select("key", "part", "way"), ["key", "part"])
        nothing = F.lit(None).cast("string")
        heads = taken.select(
            "key", "part", F.lit(0).alias("place"), F.get("edits", F.col("way")).alias("edits"), nothing.alias("initial"),
            nothing.alias("role"), nothing.alias("text"), F.lit(0).cast("long").alias("copies"),
        )
        body = self.rows.select("key", "part", "place", nothing.alias("edits"), "initial", "role", "text", "copies")
        stream = heads.unionByName(body).repartition("key").sortWithinPartitions("key", "part", "place")
        return stream.mapInArrow(lambda batches: _batches(_repaired(batches, take), schema), kind)

    def audits(self) -> DataFrame:
        """Per conversation: key, audit and the digest of the repaired rows."""
        schema = pa.schema([("key", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        return self._walk(_digest, schema, "key string, audit string, repaired_sha256 string")

    def repaired(self) -> DataFrame:
        """The repaired rows: key, place, edit (K, R or I), role, text."""
        schema = pa.schema([(n, pa.int64() if n == "place" else pa.string()) for n in ("key", "place", "edit", "role", "text")])
        return self._walk(_rows, schema, "key string, place long, edit string, role string, text string")


#: The same in SQL, with whole audit strings instead of shared nodes; the checksum is computed bit by bit.
OP12_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT coalesce('=' || CAST(conv_id AS VARCHAR), '') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce(
    list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, CAST(i AS INTEGER), 1)) AS UBIGINT)),
    lambda c, b: list_reduce(CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[]),
      lambda e, i: xor(e >> 1, CAST(3988292384 AS UBIGINT) * (e & 1)), xor(c, b)),
    CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % 20 AS kind FROM raw
), damaged AS (
  SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(2) AS c(i) WHERE kind <> 0 AND (i = 0 OR kind = 3)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS v FROM damaged
), faulted AS (
  SELECT *, v = '' AS blank, row_number() OVER (PARTITION BY key, role, text ORDER BY n) > 1 AS again,
    right(v, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS ini,
    lag(left(role, 1)) OVER (PARTITION BY key ORDER BY n) || left(role, 1) AS pair FROM numbered
), ways(state, ins, entered) AS (
  VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)
), letters(letter) AS (VALUES ('D'), ('K'), ('R')),
dp AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, 0 AS state, 0 AS cost, '' AS audit, '' AS done FROM faulted
  UNION ALL
  SELECT key, n, state, cost, audit, done FROM (
    SELECT *, row_number() OVER (PARTITION BY key, state ORDER BY cost, audit) AS place FROM (
      SELECT d.key, f.n,
        CASE letter WHEN 'D' THEN entered WHEN 'K' THEN CASE ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
          ELSE CASE WHEN entered = 2 THEN 3 ELSE 2 END END AS state,
        d.cost + 5 * ins + CASE letter WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END
          + CASE WHEN letter <> 'D' AND cut THEN 5 ELSE 0 END AS cost,
        d.audit || repeat('I', ins) || letter AS audit,
        d.done || CASE WHEN ins = 0 THEN '' WHEN d.state = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END
          || CASE WHEN ins < 2 THEN '' ELSE chr(10) || 'assistant:' END
          || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
            ELSE chr(10) || CASE WHEN entered = 2 THEN 'assistant:' ELSE 'user:' END || text END AS done
      FROM dp d JOIN faulted f ON f.key = d.key AND f.n = d.n + 1 JOIN ways w ON w.state = d.state, letters
      WHERE letter = 'D' OR (NOT blank AND NOT again AND (letter = 'R' OR (ini = 's' AND entered = 0)
        OR (ini = 'u' AND entered IN (0, 1, 3)) OR (ini = 'a' AND entered = 2)))
    )
  ) WHERE place = 1
), sizes AS (
  SELECT key, count(*) AS n, coalesce(CAST(max(turn) - min(turn) + 1 - count(DISTINCT turn) AS BIGINT), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulted GROUP BY key
), closed AS (
  SELECT key, n, cost + 5 * least(state % 3, 1) * (3 - state) AS cost, audit || repeat('I', CASE state WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS audit,
    done || CASE state WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END AS done
  FROM dp JOIN sizes USING (key, n)
), chosen AS (
  SELECT * FROM closed QUALIFY row_number() OVER (PARTITION BY key ORDER BY cost, audit) = 1
), ids AS (SELECT DISTINCT conv_id, coalesce('=' || CAST(conv_id AS VARCHAR), '') AS key FROM conversations)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(substr(done, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN sizes USING (key) LEFT JOIN chosen USING (key)
"""


def op12_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest audit and digest of the repaired rows of every damaged conversation."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    done = Repair(damaged(conversations))
    found = done.faults().drop("conv_id").join(done.costs(), "key").join(done.audits(), "key")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key")
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return conversations.select("conv_id", key).distinct().join(found, "key", "left").select(
        "conv_id", F.when(F.col("cost").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias("gaps"), *numbers,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
