"""Shared pieces: the shared folder, bounded slices of Arrow batches, words as Arrow arrays, vectorised hashing."""

from __future__ import annotations

import atexit
import contextvars
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds as words at once.
SLICE_BYTES = 6 << 20


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one is made, in local mode only (as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='keelson-')}"
            atexit.register(shutil.rmtree, _LOCAL[app].removeprefix("file://"), ignore_errors=True)
        found = _LOCAL[app]
    return found.rstrip("/")


class Scratch:
    """The tables that one run writes to the shared folder. Inside ``with``, ``fresh_path`` and ``stored`` hand them out on its account.

    Runs beside it, in other threads too, have their own. A Scratch inside another hands what it keeps over to it.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        self._outer = _CURRENT.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _CURRENT.reset(self._outer)
        if outer := _CURRENT.get():
            outer.paths += self.paths

    def release(self, spark: SparkSession, *, keep: DataFrame | None = None) -> int:
        """Deletes the run's tables but those that ``keep`` reads. Other frames on them must have been used."""
        held = [] if keep is None else [f.rsplit("/", 1)[0] for f in keep.inputFiles()]
        names = {h.rsplit("/", 1)[-1] for h in held}
        gone = [p for p in self.paths if p.rsplit("/", 1)[-1] not in names]
        for path in gone:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.paths = [p for p in self.paths if p not in gone]
        return len(gone)


_CURRENT: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("scratch", default=None)


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    if run := _CURRENT.get():
        run.paths.append(path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written once to the shared folder and read again: cuts the lineage, survives lost executors, is computed once."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of 64 bits that tell which ids may be in a set: a bound of 4 MB for the broadcast, however large the set.
SLOTS = 1 << 18


def parted(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``docs`` by ``key``: those that may be in ``ids`` (one column, long), and those that surely aren't; nulls aren't.

    A Bloom filter of one hash and bounded size is broadcast, so that only rows that may be meant have to move to meet ``ids``. A set
    too large for the filter only makes more rows move.
    """
    h, bits, slot = F.xxhash64(F.col(ids.columns[0]).cast("long")), free(docs, "_bits"), free(docs, "_slot")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    place = lambda h: F.pmod(F.shiftright(h, 6), F.lit(SLOTS))
    table = F.broadcast(ids.select(place(h).alias(slot), bit(h).alias(bits)).groupBy(slot).agg(F.bit_or(bits).alias(bits)))
    own = F.xxhash64(F.col(key).cast("long"))
    there = F.coalesce(F.col(bits).bitwiseAND(bit(own)), F.lit(0)) != 0
    met = docs.withColumn(slot, F.when(F.col(key).isNotNull(), place(own))).join(table, slot, "left")
    return met.filter(there).select(*map(quoted, docs.columns)), met.filter(~there).select(*map(quoted, docs.columns))


#: Bytes of an Arrow batch between the JVM and a worker at most, or one row if that has more: 10,000 rows, Spark's own bound, may be any size.
BATCH_BYTES = 4 << 20


def batched(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches by bytes, unless they are bounded lower; ``df`` itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = int(df.sparkSession.conf.get(key).rstrip("bB"))
    if not 0 < most <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def filtered(docs: DataFrame, keep: Callable[[pa.Array], pa.Array], most: int) -> DataFrame:
    """The rows whose texts ``keep`` keeps (texts of ``most`` bytes at once), all columns as they are, whatever their names."""
    plain = docs.toDF(*["text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, most=most):
                yield b.filter(keep(b.column("text")))

    return plain.transform(batched).mapInArrow(run, plain.schema).toDF(*docs.columns)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library: it keeps what it likes
    _trim = None


def tidy() -> None:
    """Gives freed memory back to the system: a worker goes on to other operators, beside an executor that needs the room."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


#: What operators keep in a worker from task to task, as functions that drop it.
HELD: dict[str, Callable[[], None]] = {}


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES, holds: str = "") -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``most`` text bytes, or one row if that is longer; memory is tidied after the last.

    What other operators than ``holds`` have kept in this worker is dropped: a worker serves one at a time.
    """
    for name in [n for n in HELD if n != holds]:
        HELD.pop(name)()
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
    tidy()


def white_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, flat, and how many each text has; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    return _flat(lists)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not keep.all():
        doc = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(doc[keep], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(keep))
    return flat, counts


def alnum_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: a byte table turns every separator into a space."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    raw = b"" if data is None else data.to_pybytes().translate(LOWER_ALNUM)
    clean = pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(raw)], offset=texts.offset)
    return _flat(pc.ascii_split_whitespace(clean))


LOWER_ALNUM = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers that looks random."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def hash_spans(raw: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each span of bytes: a 64-bit hash of all of it, its first eight bytes and its last eight (all of it, if shorter).

    Eight bytes at a time, vectorised over the spans that are still running.
    """
    buf = np.zeros(len(raw) + 8, np.uint8)
    buf[: len(raw)] = raw
    eight = np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1))
    load = lambda at: np.ascontiguousarray(eight[at]).view("<u8")[:, 0]
    first = load(start) & _KEEP[np.minimum(size, 8)]
    last = first.copy()
    h = mix((size.astype(np.uint64) + np.uint64(seed) * _M3) * _M1 + first)
    run = np.flatnonzero(size > 8)
    last[run] = load(start[run] + size[run] - 8)
    h[run] = mix(h[run] ^ last[run])
    run = run[size[run] > 16]
    at, rest = start[run] + 8, size[run] - 16
    while len(run):
        h[run] = mix(h[run] ^ (load(at) & _KEEP[np.minimum(rest, 8)]))
        on = rest > 8
        run, at, rest = run[on], at[on] + 8, rest[on] - 8
    return h, first, last


def hash_words(flat: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word, from its bytes alone."""
    n = len(flat)
    if n == 0:
        return np.zeros(0, np.uint64)
    _, off, data = flat.buffers()
    offsets = np.frombuffer(off, np.int64 if pa.types.is_large_string(flat.type) else np.int32)[flat.offset : flat.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    with np.errstate(over="ignore"):
        return hash_spans(raw, offsets[:-1] - offsets[0], np.diff(offsets), seed)[0]


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive entries (doubling: log n passes), for every start; the last n - 1 starts are missing."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    have, size, out, done = h, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                if out is None:
                    out, done = have, size
                else:
                    m = min(len(out), len(have) - done)
                    out = mix(out[:m] * _M2 + have[done : done + m])
                    done += size
            size *= 2
            if size > n:
                return out[: len(h) - n + 1]
            half = size // 2
            have = mix(have[:-half] * _M1 + have[half:] * _M3)


def window_starts(counts: np.ndarray, n: int) -> np.ndarray:
    """True at each flat word from which n words remain in its own document; length sum(counts) - n + 1 at most."""
    total = int(counts.sum())
    if total < n:
        return np.zeros(0, bool)
    ends = np.repeat(np.cumsum(counts), counts)
    return (np.arange(total) + n <= ends)[: total - n + 1]
