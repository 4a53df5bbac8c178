"""Operator 3: token ids in a range asymmetric numeral system (rANS) container.

Documents go in ascending doc_id order to range partitions; each task encodes segments of at most SEGMENT_TOKENS ids (or one
longer document). A segment has one static frequency table, shared by its blocks. A block is BLOCK_TOKENS ids over LANES
interleaved coders; its checkpoint (stream offset, lane states) and checksum let any block be decoded alone. All blocks of a
segment are coded side by side with numpy.

Container: Parquet rows (part, seq, base, doc_ids, lengths, data) in ``path``; ``data`` is the binary segment. Rows are written by
Spark's committer, so a lost executor leaves no half segment.

Defined cases: null text has no ids but the end id; null doc_id sorts first; rows with the same doc_id follow one another in the
order of their texts' hashes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import batched, fresh_path, slices
from keelson.llm.tokens import Encoder, crc, tokenizer_path

MAGIC = b"KRA1"
SEGMENT_TOKENS = 2_000_000
BLOCK_TOKENS = 16_384
LANES = 32
SCALE = 18
HEADER = struct.Struct("<4sQIIIIIII")
LOW = np.uint64(32)
SCHEMA = "part int, seq int, base long, doc_ids array<long>, lengths array<int>, data binary"


class DamagedSegment(ValueError):
    """A checksum or a length doesn't agree."""


def frequencies(counts: np.ndarray, scale: int) -> np.ndarray:
    """Counts scaled to a sum of 2**scale, each at least 1; the largest give or take the rounding."""
    total = 1 << scale
    f = np.maximum(1, counts.astype(np.float64) * (total / counts.sum())).astype(np.int64)
    off = total - int(f.sum())
    order = np.argsort(-f, kind="stable")
    if off > 0:
        f[order[0]] += off
    for k in order:
        if off >= 0:
            break
        take = min(-off, int(f[k]) - 1)
        f[k] -= take
        off += take
    return f.astype(np.uint64)


def encode_segment(ids: np.ndarray) -> bytes:
    """Any array of unsigned 32-bit ids, the empty one included."""
    n = len(ids)
    block = max(LANES, min(BLOCK_TOKENS, -(-n // LANES) * LANES))
    steps, blocks = block // LANES, -(-n // block)
    symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    scale = max(SCALE, int(len(symbols) + 1).bit_length() + 3)
    #: The last entry is never coded: no frequency may be the whole range.
    freq = frequencies(np.append(counts, 1), scale) if n else np.zeros(0, np.uint64)
    cum = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint64)
    padded = np.full(blocks * block, int(np.argmax(counts)) if n else 0, np.int64)
    padded[:n] = index.reshape(-1)
    # (step, block, lane): a step codes one id of each lane of all blocks
    grid = padded.reshape(blocks, steps, LANES).transpose(1, 0, 2)
    x = np.full((blocks, LANES), 1 << 32, np.uint64)
    out = np.zeros(grid.shape, np.uint32)
    moved = np.zeros(grid.shape, bool)
    room, shift = np.uint64(64 - scale), np.uint64(scale)
    for s in range(steps - 1, -1, -1):
        f = freq[grid[s]]
        full = x >= (f << room)
        out[s], moved[s] = x.astype(np.uint32), full
        x = np.where(full, x >> LOW, x)
        q, r = np.divmod(x, f)
        x = (q << shift) + r + cum[grid[s]]
    moved_b = moved.transpose(1, 0, 2)
    stream = out.transpose(1, 0, 2)[moved_b].astype("<u4").tobytes()
    words = moved_b.sum((1, 2)).astype("<u4")
    sums = np.array([crc(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) for k in range(blocks)], "<u4")
    table = zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    head = HEADER.pack(MAGIC, n, block, LANES, scale, len(symbols), blocks, len(table), len(stream))
    body = table + words.tobytes() + sums.tobytes() + x.astype("<u8").tobytes() + stream
    return head + struct.pack("<I", crc(body)) + body


def decode_segment(data: bytes, blocks_wanted: range | None = None) -> np.ndarray:
    """All ids, or those of a range of blocks. Raises DamagedSegment rather than give wrong ids."""
    try:
        magic, n, block, lanes, scale, n_sym, blocks, n_table, n_stream = HEADER.unpack_from(data)
        (check,) = struct.unpack_from("<I", data, HEADER.size)
    except struct.error as e:
        raise DamagedSegment("too short") from e
    body = memoryview(data)[HEADER.size + 4 :]
    if magic != MAGIC or len(body) != n_table + 8 * blocks + 8 * blocks * lanes + n_stream or crc(body) != check:
        raise DamagedSegment("not a segment, cut off, or changed")
    if n == 0:
        return np.zeros(0, np.uint32)
    table = zlib.decompress(body[:n_table])
    symbols = np.frombuffer(table, "<u4", n_sym)
    freq = np.frombuffer(table, "<u4", n_sym + 1, 4 * n_sym).astype(np.uint64)
    cum = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint64)
    slot_symbol = np.repeat(np.arange(n_sym + 1, dtype=np.int32), freq.astype(np.int64))
    words = np.frombuffer(body, "<u4", blocks, n_table).astype(np.int64)
    sums = np.frombuffer(body, "<u4", blocks, n_table + 4 * blocks)
    x = np.frombuffer(body, "<u8", blocks * lanes, n_table + 8 * blocks).reshape(blocks, lanes).astype(np.uint64)
    stream = np.append(np.frombuffer(body, "<u4", n_stream // 4, n_table + 8 * blocks + 8 * blocks * lanes), np.uint32(0))
    want = np.arange(blocks)[blocks_wanted.start : blocks_wanted.stop] if blocks_wanted is not None else np.arange(blocks)
    at = (np.cumsum(words) - words)[want]
    x = x[want]
    steps = block // lanes
    out = np.empty((steps, len(want), lanes), np.int32)
    mask, shift, low = np.uint64((1 << scale) - 1), np.uint64(scale), np.uint64(1 << 32)
    for s in range(steps):
        slot = x & mask
        sym = slot_symbol[slot]
        out[s] = sym
        x = freq[sym] * (x >> shift) + slot - cum[sym]
        need = x < low
        place = np.cumsum(need, 1)
        got = stream[np.minimum(at[:, None] + place - 1, len(stream) - 1)]
        x = np.where(need, (x << LOW) | got, x)
        at += place[:, -1]
    ids = symbols[np.minimum(out.transpose(1, 0, 2).reshape(len(want), -1), n_sym - 1)]
    parts = [ids[i, : max(0, min(block, n - int(k) * block))] for i, k in enumerate(want)]
    for p, k in zip(parts, want, strict=True):
        if crc(p.astype("<u4").tobytes()) != sums[k]:
            raise DamagedSegment(f"block {k}")
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int | None = 2) -> None:
    """Encodes ``docs`` (doc_id, text) into a container at ``path``. One shuffle, by range of doc_id."""
    tokenizer = tokenizer or tokenizer_path()
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        state = {"seq": 0, "base": 0, "held": 0}

        def flush() -> pa.RecordBatch:
            data = encode_segment(np.concatenate(held) if held else np.zeros(0, np.uint32))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([state["seq"]], pa.int32()), pa.array([state["base"]], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([data], pa.binary())],
                ["part", "seq", "base", "doc_ids", "lengths", "data"],
            )
            state["seq"] += 1
            state["base"] += state["held"]
            state["held"] = 0
            held.clear(), doc_ids.clear(), lengths.clear()
            return row

        for batch in batches:
            for b in slices(batch, most=2 << 20, holds="tokens"):
                ids, counts = encoder.encode(b.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                    counts = counts + 1
                held.append(ids.astype(np.uint32))
                doc_ids.extend(b.column("doc_id").to_pylist())
                lengths.extend(counts.tolist())
                state["held"] += len(ids)
                if state["held"] >= SEGMENT_TOKENS:
                    yield flush()
        if doc_ids:
            yield flush()

    rows.transform(batched).mapInArrow(encode, SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids as binary."""
    return _decoded(spark, path, ids=True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark, path, ids=False)


def _decoded(spark: SparkSession, path: str, *, ids: bool) -> DataFrame:
    rows = spark.read.schema(SCHEMA).parquet(path)
    # one total for each range partition, which is what places its ids
    totals = rows.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n")).orderBy("part").collect()
    base, bases = 0, {}
    for r in totals:
        bases[r.part] = base
        base += r.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, doc_ids, lengths, data in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "doc_ids", "lengths", "data")), strict=True):
                flat = decode_segment(data).astype("<u4")
                ends = np.cumsum(np.array(lengths, np.int64))
                if (int(ends[-1]) if len(ends) else 0) != len(flat):
                    raise DamagedSegment("lengths and ids don't agree")
                starts = ends - np.array(lengths, np.int64)
                parts = [flat[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(starts + bases[part] + before), pa.array(lengths, pa.int64()), pa.array([crc(p) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary())] * ids, names + ["ids"] * ids)

    return rows.select("part", "base", "doc_ids", "lengths", "data").transform(batched).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "op3-tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_digests(spark, path)
