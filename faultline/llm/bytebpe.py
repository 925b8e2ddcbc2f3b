"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Texts are split into pre-tokens by the public pattern, vectorised over character classes. Neighbouring whole
texts form chunks of bounded size; a chunk keeps its pre-tokens as positions in the list of its distinct
words. The words of a chunk are packed by hash bucket and shuffled by
bucket: each distinct word is encoded once, next to all chunks that hold it, and the ids go back to the
chunks, where the positions put the token sequences together again. A word travels once per chunk instead of once
per occurrence, so a word that holds a third of all tokens is no hot key. Decoding looks every id up in the
table of token bytes, which has a row per vocabulary entry.

Chunks are cut twice from the same input (for words and for positions), so the input has to be a table or files,
which give the same rows in the same order when read again; every row carries a checksum of its chunk's words, and a mismatch ends the job.

Cases: null and empty texts have no tokens; repeated rows and null ids are encoded row by row; a text larger
than a chunk is a chunk of its own; further columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultline.llm import textkit

CHUNK_BYTES = 4 << 20
#: Bytes of texts that a task splits into words at once; its arrays take many times that.
SLICE_BYTES = 1 << 18
#: Encoded words that a task remembers; beyond that it starts anew, at the cost of encoding a word again.
REMEMBERED = 1 << 17
OTHER, LETTERS, NUMBERS, SPACES = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point under the pattern's character classes."""
    numbers = np.arange(0x110000, dtype="<u4")
    numbers[0xD800:0xE000] = 0
    # one text of all code points; as a list of characters it took more memory than all else a task holds
    points = numbers.tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for number, pattern in ((LETTERS, r"\p{L}+"), (NUMBERS, r"\p{N}+"), (SPACES, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, points):
            table[m.start():m.end()] = number
    return table


def code_points(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the place of the first byte of each."""
    at = np.flatnonzero((values & 0xC0) != 0x80)
    lead = values[at].astype(np.uint32)
    if len(at) == len(values):
        return lead, at
    padded = np.append(values, np.zeros(3, np.uint8)).astype(np.uint32) & 0x3F
    two = (lead & 0x1F) << 6 | padded[at + 1]
    three = (lead & 0x0F) << 12 | padded[at + 1] << 6 | padded[at + 2]
    four = (lead & 0x07) << 18 | padded[at + 1] << 12 | padded[at + 2] << 6 | padded[at + 3]
    return np.where(lead < 0x80, lead, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))), at


def pretoken_starts(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of all pre-tokens of the joined texts; a token ends where the next begins."""
    points, at = code_points(values)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    head = np.zeros(n + 4, bool)
    head[np.searchsorted(at, offsets)] = True
    head[n:] = True
    change = head.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    start = change.copy()
    # The last white space before other text stands alone, or goes with that text if it is a blank.
    word = np.flatnonzero(change[1:n] & ~head[1:n] & (kind[1:] != SPACES) & (kind[:-1] == SPACES)) + 1
    start[word - 1] = True
    start[word[points[word - 1] == 0x20]] = False
    # A lone apostrophe takes one of a few letter groups with it.
    points = np.append(points, np.zeros(4, np.uint32))
    quote = np.flatnonzero((points[:n] == 0x27) & start[:n] & change[:n])
    quote = quote[(quote + 1 < n) & change[quote + 1] & ~head[quote + 1]]
    one = quote[np.isin(points[quote + 1], [ord(c) for c in "stmd"])]
    quote = quote[~head[np.minimum(quote + 2, n)]]
    pair = points[quote + 1] << np.uint32(8) | points[quote + 2]
    two = quote[np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])]
    for places, size in ((one, 2), (two, 3)):
        start[places + 1] = False
        start[np.minimum(places + size, n)] = True
    return at[np.flatnonzero(start[:n])]


def token_words(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of all pre-tokens as a column; a token ends where the next begins, so the bytes are not copied."""
    offsets = np.append(starts, len(values)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def chunks(batches: Iterator[pa.RecordBatch], limit: int):
    """(ids, bytes, token starts, tokens per text) of runs of whole texts."""
    ids, parts, starts, counts, size = [], [], [], [], 0
    for batch in batches:
        for row, values, offsets in textkit.slices(batch.column(0), SLICE_BYTES):
            first = pretoken_starts(values, offsets)
            ids.append(batch.column(1).slice(row, len(offsets) - 1))
            parts.append(values)
            starts.append(first + size)
            counts.append(np.diff(np.searchsorted(first, offsets)))
            size += len(values)
            if size >= limit:
                yield pa.chunked_array(ids), *(np.concatenate(x) for x in (parts, starts, counts))
                ids, parts, starts, counts, size = [], [], [], [], 0
    if ids:
        yield pa.chunked_array(ids), *(np.concatenate(x) for x in (parts, starts, counts))


def packed_list(words: pa.Array) -> bytes:
    """A list of byte strings: their lengths, then their bytes, compressed."""
    values, offsets = textkit.buffers(words)
    return pa.compress(np.diff(offsets).astype("<u4").tobytes() + values.tobytes(), "zstd", asbytes=True)


def unpacked_list(data: bytes, n: int, size: int) -> pa.Array:
    raw = pa.decompress(data, 4 * n + size, "zstd", asbytes=True)
    offsets = np.append(0, np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64))
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[4 * n:])])


PIECES = pa.schema([
    ("chunk", pa.int64()), ("bucket", pa.int32()), ("check", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("data", pa.binary()),
])
PIECE_KIND = "chunk long, bucket int, check long, n long, size long, data binary"
#: Bucket number of the row that holds the positions of a chunk.
HEAD = -1


def _piece(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, PIECES, strict=True)], schema=PIECES)


def _cut(limit: int, buckets: int, positions: bool):
    """Rows of each chunk: its positions, or its distinct words packed by bucket and numbered bucket by bucket."""

    def pieces(number: int, ids: pa.ChunkedArray, values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        coded = token_words(values, starts).dictionary_encode()
        known = coded.dictionary
        joined, bounds = textkit.buffers(known)
        check = zlib.crc32(joined.tobytes())
        dealt = textkit.hash_spans(joined, bounds[:-1], bounds[1:]) % np.uint64(buckets)
        order = np.argsort(dealt, kind="stable")
        if positions:
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            inverse = place[coded.indices.to_numpy(zero_copy_only=False)]
            # The bytes of the positions are grouped by significance, which packs better.
            stream = inverse.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            head = {
                "known": len(known), "stream": pa.compress(stream, "zstd", asbytes=True), "tokens": len(inverse),
                "doc_ids": ids.to_pylist(), "counts": counts,
            }
            yield _piece(number, HEAD, check, 1, 0, pickle.dumps(head))
            return
        del coded
        edges = np.searchsorted(dealt[order], np.arange(buckets + 1, dtype=np.uint64))
        for bucket in np.flatnonzero(edges[1:] > edges[:-1]):
            words = known.take(pa.array(order[edges[bucket]:edges[bucket + 1]]))
            _, spans = textkit.buffers(words)
            yield _piece(number, int(bucket), check, len(words), int(spans[-1]), packed_list(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, base = textkit.numbered(batches)
        found, number = chunks(batches, limit), base
        while chunk := next(found, None):
            yield from pieces(number, *chunk)
            # nothing of a chunk is kept while the next one is read
            chunk, number = None, number + 1
            pa.default_memory_pool().release_unused()

    return run


class Merger:
    """Merges the bytes of a word by rank: always the lowest rank, the leftmost on ties."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def encode(self, word: bytes) -> list[int]:
        known = self.ranks.get(word)
        if known is not None:
            return [known]
        get = self.ranks.get
        part = [word[i:i + 1] for i in range(len(word))]
        follow, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(r, i) for i in range(len(part) - 1) if (r := get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = follow[i]
            if part[i] is None or j >= len(part) or get(part[i] + part[j]) != rank:
                continue
            part[i] += part[j]
            part[j] = None
            follow[i] = k = follow[j]
            if k < len(part):
                before[k] = i
                if (r := get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [self.ranks[p] for p in part if p is not None]


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file; its path is a parameter of all functions here."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _encode_words(shared, remembered: int = REMEMBERED):
    """Packed words of a bucket to packed ids; a word is encoded once, next to all chunks that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, known, bucket = Merger(shared.value), {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket or len(known) > remembered:
                    known, bucket = {}, row["bucket"]
                words = unpacked_list(row["data"], row["n"], row["size"]).to_pylist()
                for word in words:
                    if word not in known:
                        known[word] = np.array(merger.encode(word), "<u4").tobytes()
                ids = pa.array([known[word] for word in words], pa.large_binary())
                size = int(textkit.buffers(ids)[1][-1])
                yield _piece(row["chunk"], row["bucket"], row["check"], row["n"], size, packed_list(ids))

    return run


def _assemble(id_type: pa.DataType):
    def sequences(head: dict, parts: list[pa.Array]) -> pa.RecordBatch:
        words = pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())
        if len(words) != head["known"]:
            raise RuntimeError("the words of a chunk do not fit its positions: the input changed between two reads")
        data, bounds = textkit.buffers(words)
        ids, bounds = np.frombuffer(data.tobytes(), "<u4"), bounds // 4
        total = head["tokens"]
        raw = pa.decompress(head["stream"], 4 * total, "zstd", asbytes=True)
        inverse = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, total).T).view("<u4").ravel()
        sizes = np.diff(bounds)[inverse]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(bounds[:-1][inverse] - ends + sizes, sizes) + np.arange(ends[-1] if total else 0)]
        per_text = np.append(0, np.cumsum(head["counts"]))
        cut = np.append(0, ends)[per_text]
        packed = pa.Array.from_buffers(
            pa.binary(), len(cut) - 1, [None, pa.py_buffer((4 * cut).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))]
        )
        return pa.RecordBatch.from_arrays([pa.array(head["doc_ids"], id_type), pa.array(np.diff(cut)), packed], ["doc_id", "n_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, check, parts = None, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != HEAD:
                    if row["check"] != check:
                        raise RuntimeError("the words of a chunk do not fit its positions: the input changed between two reads")
                    parts.append(unpacked_list(row["data"], row["n"], row["size"]))
                    continue
                if head:
                    yield sequences(head, parts)
                head, check, parts = pickle.loads(row["data"]), row["check"], []
        if head:
            yield sequences(head, parts)

    return run


ENCODED = ("doc_id", "n_tokens", "ids")


def coded_pieces(docs: DataFrame, ranks: dict[bytes, int], chunk_bytes: int, buckets: int | None) -> DataFrame:
    """The encoded words and the positions of every chunk, chunk by chunk, ready for :func:`_assemble`."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("text", "doc_id", F.spark_partition_id().alias("part"))
    words = docs.mapInArrow(_cut(chunk_bytes, buckets, False), PIECE_KIND).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    heads = docs.mapInArrow(_cut(chunk_bytes, buckets, True), PIECE_KIND)
    coded = words.mapInArrow(_encode_words(shared), PIECE_KIND)
    return coded.unionByName(heads).repartition("chunk").sortWithinPartitions("chunk", "bucket")


def encode(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of ``docs`` (doc_id, text); ids as little-endian 32-bit integers.

    Words are dealt to ``buckets``, by default as many as the session has shuffle partitions.
    """
    kind = docs.schema["doc_id"].dataType
    whole = coded_pieces(docs, read_ranks(path), chunk_bytes, buckets)
    return whole.mapInArrow(_assemble(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, n_tokens long, ids binary")


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of every id."""
    table: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        table[rank] = word
    return table


def _decode(shared, names: list[str]):
    """Rows with the bytes of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, bounds = textkit.buffers(pa.array(shared.value, pa.binary()))
        for batch in batches:
            out = [pa.array([], pa.binary())]
            for _, values, offsets in textkit.slices(batch.column(names.index("ids"))):
                ids = np.frombuffer(values.tobytes(), "<u4")
                ends = np.append(0, np.cumsum(bounds[ids + 1] - bounds[ids]))
                text = take_bytes(data, bounds[ids], bounds[ids + 1])
                cut = ends[offsets // 4]
                out.append(pa.Array.from_buffers(
                    pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(text)]
                ))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(out)], [*names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(token_table(read_ranks(path)))
    names = [c for c in encoded.columns if c != "decoded"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*names).schema]
    return encoded.select(*names).mapInArrow(_decode(shared, names), ", ".join([*fields, "decoded binary"]))


def take_bytes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    sizes = ends - starts
    reach = np.cumsum(sizes)
    return values[np.repeat(starts - reach + sizes, sizes) + np.arange(reach[-1] if len(reach) else 0)]


def encoded_and_decoded(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> DataFrame:
    """The rows of ``decode(encode(docs))``.

    The task that puts the ids together decodes them as well: as two steps, every task kept two Python workers, and Spark
    uses all workers of an executor in turn from then on, so each of them stays as large as its largest task.
    """
    kind, ranks = docs.schema["doc_id"].dataType, read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast(token_table(ranks))
    assembled, decoded = _assemble(to_arrow_type(kind)), _decode(shared, list(ENCODED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoded(assembled(batches))

    return coded_pieces(docs, ranks, chunk_bytes, buckets).mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """Digests of the ids of every document and of the bytes decoded from them."""
    return encoded_and_decoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
