"""Operator 7: best-fit packing with certified bin counts and repacking.

Every document is cut into pieces; a full piece is a sequence of its own, the rest (one at most a document) are packed by
best-fit decreasing in groups of GROUP_ITEMS. For each group dual feasible functions give a lower bound of its bins: a group that
meets its bound is certified and done. The others release the documents of their bins that are not full; the released documents are
dealt anew over all such groups and packed again, and a round is kept only if it saves bins. Rounds go on until every group
is certified or MISSES exchanges in a row save nothing. The certificate is part of the result: for each piece the bins of its group and
the bound under them (a full bin is its own certificate), so a gap that stays open shows.

Only lengths and row numbers move between rounds. Defined cases: null text is empty and has the end id alone; rows with the same
doc_id, or a null one, are packed apart; a very long text gives many full pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import batched, slices, stored
from keelson.llm.tokens import Encoder, crc, tokenizer_path

GROUP_ITEMS = 6_000
MISSES = 2
PIECES = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "rid long, length long, bin long, offset long, used long, bins long, bound long"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions, over the histogram of lengths."""
    if len(lengths) == 0:
        return 0
    h = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    count, mass = np.concatenate([[0], np.cumsum(h)]), np.concatenate([[0], np.cumsum(h * x)])
    lam = np.arange(capacity // 2 + 1)
    large = count[-1] - count[capacity - lam + 1]  # longer than capacity - lam
    middle = mass[capacity - lam + 1] - mass[lam]
    best = int(np.max(large + -(-middle // capacity)))
    for k in range(1, 33):
        u = (k + 1) * x
        value = np.where(u % capacity == 0, x * k, (u // capacity) * capacity)  # times k, over capacity * k
        best = max(best, -(-int((h * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the tokens in each bin. Free space is a bit set, so the best fit is one shift away."""
    order = np.argsort(-lengths, kind="stable")
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = there >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                there &= ~(1 << room)
        else:
            room, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, capacity - room
        used[b] = capacity - room + n
        room -= n
        if room:
            free[room].append(b)
            there |= 1 << room
    return bins, offsets, np.array(used, np.int64)


def pieces(docs: DataFrame, *, capacity: int, tokenizer: str, end_id: int | None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rid = Encoder.of(tokenizer), TaskContext.get().partitionId() << 36
        for batch in batches:
            for b in slices(batch, most=2 << 20, holds="tokens"):
                ids, counts = encoder.encode(b.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                    counts = counts + 1
                ids = ids.astype("<u4")
                out: tuple[list, ...] = ([], [], [], [], [], [])
                at = 0
                for doc, n in zip(b.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    start = piece = 0
                    while start < n:
                        size = n if n <= capacity else (n % capacity or capacity) if piece == 0 else capacity
                        for o, v in zip(out, (rid, doc, piece, start, size, crc(ids[at + start : at + start + size].tobytes())), strict=True):
                            o.append(v)
                        rid, piece, start = rid + 1, piece + 1, start + size
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int32() if k == 2 else pa.int64()) for k, o in enumerate(out)], ["rid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.transform(batched).mapInArrow(cut, PIECES)


def _packed(items: DataFrame, groups: int, salt: int, capacity: int, base: int) -> DataFrame:
    """Deals items to groups of the same expected size by the hash of their number, and packs each group."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        lengths = pdf["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        grp = int(pdf["grp"].iloc[0])
        return pd.DataFrame({"rid": pdf["rid"], "length": lengths, "bin": base + (grp << 24) + bins, "offset": offsets, "used": used[bins], "bins": len(used), "bound": lower_bound(lengths, capacity)})

    dealt = items.select("rid", "length", F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").applyInPandas(pack, BINS)


def pack_documents(docs: DataFrame, *, capacity: int = 2048, tokenizer: str | None = None, end_id: int | None = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the certificate: group_bins, group_bound."""
    cut = stored(pieces(docs, capacity=capacity, tokenizer=tokenizer or tokenizer_path(), end_id=end_id), "packing-pieces")
    one, cols = F.lit(1).cast("long"), ["rid", "bin", "offset", "bins", "bound"]
    done = cut.filter(F.col("length") == capacity).select("rid", F.col("rid").alias("bin"), F.lit(0).cast("long").alias("offset"), one.alias("bins"), one.alias("bound"))
    items = cut.filter(F.col("length") < capacity).select("rid", "length")
    n, k, misses = items.count(), 0, 0
    placed = stored(_packed(items, max(1, -(-n // GROUP_ITEMS)), 0, capacity, 1 << 62), "packing-0") if n else None
    open_ = (F.col("bins") > F.col("bound")) & (F.col("used") < capacity)
    while placed is not None and misses < MISSES:
        k += 1
        now = placed.filter(open_).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("offset") == 0, 1)).alias("bins")).head()
        if not now.n:
            break
        again = stored(_packed(placed.filter(open_).select("rid", "length"), max(1, -(-now.n // GROUP_ITEMS)), k, capacity, (1 << 62) + (k << 48)), f"packing-{k}")
        if again.agg(F.sum(F.when(F.col("offset") == 0, 1))).head()[0] < now.bins:
            # what stays of an open group is its full bins
            full = F.col("bins") > F.col("bound")
            done = done.unionAll(placed.filter(~open_).select("rid", "bin", "offset", F.when(full, one).otherwise(F.col("bins")).alias("bins"), F.when(full, one).otherwise(F.col("bound")).alias("bound")))
            placed, misses = again, 0
        else:
            misses += 1
    if placed is not None:
        done = done.unionAll(placed.select(cols))
    return cut.join(done, "rid").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", F.col("bins").alias("group_bins"), F.col("bound").alias("group_bound"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
