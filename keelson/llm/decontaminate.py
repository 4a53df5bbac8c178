"""Operator 9: benchmark decontamination by training suffix arrays.

Documents are taken in shards of a few MB. Each shard gets a suffix array over its words, of those suffixes that can begin a
match (their first two words follow one another in the benchmark), sorted to the window's depth. The first WINDOW words of every test
suffix are binary-searched in every shard; the ranges found give all verbatim occurrences. Occurrences that follow one another both
in the document and in the item extend to the longest verbatim match, whose length and places in both are part of the result.

Words are lower-cased (A-Z) runs of ASCII letters and digits and all bytes beyond ASCII. A window is WINDOW words of an item; an
item of fewer is one window. The benchmark is a stated test set: it goes to the executors in blocks of at most BLOCK_BYTES of text, built
one by one on the driver; a longer item is cut, with an overlap that loses no window. A worker holds one block at a time.

Defined cases: null texts have no words, hits or items; items without words or id match nothing; repeated items count by
distinct item_id; rows of documents are judged one by one, repeated or not; empty tables give no hits; an empty text has no words; a
very long text is a shard of its own. Of longest matches the first in the document counts, then the smallest item_id. Other columns, whatever
their names, pass through ``decontaminate`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import alnum_words, batched, filtered, slices

WINDOW = 8
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20
#: Items whose windows occur in a document that ``scan`` calls contaminated.
MIN_ITEMS = 2
DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long, longest_item long"


@dataclass
class TestSet:
    """Distinct windows of a block of items as rows of word numbers (0: past a short item's end), who has them, and where: a place is a
    number over all words of the block, so that neighbouring places are neighbours in an item."""

    vocabulary: pa.Array
    windows: np.ndarray
    sizes: np.ndarray
    owner_at: np.ndarray
    owners: np.ndarray
    place_at: np.ndarray
    places: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    pairs: np.ndarray | None

    @staticmethod
    def build(ids: list[int], texts: list[str], window: int) -> TestSet | None:
        flat, counts = alnum_words(pa.array(texts, pa.string()))
        if not len(flat):
            return None
        coded = flat.dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        rows, owner, place, at = [], [], [], 0
        for item, n in zip(ids, counts.tolist(), strict=True):
            own = word[at : at + n]
            place += range(at, at + (max(1, n - window + 1) if n else 0))
            at += n
            if n >= window:
                rows.append(np.lib.stride_tricks.sliding_window_view(own, window))
            elif n:
                rows.append(np.pad(own, (0, window - n))[None])
            owner += [item] * (max(1, n - window + 1) if n else 0)
        windows, back = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        back, place = back.reshape(-1), np.array(place, np.int64)
        both = np.unique(np.stack([back, np.array(owner)], 1), axis=0)
        order = np.lexsort((place, back))
        pairs = None
        if window > 1 and (windows[:, 1] > 0).all():
            pairs = np.zeros(1 << 22, bool)
            pairs[TestSet.slot(windows[:, 0], windows[:, 1])] = True
        every = np.arange(len(windows) + 1)
        return TestSet(coded.dictionary, windows, (windows > 0).sum(1), np.searchsorted(both[:, 0], every), both[:, 1], np.searchsorted(back[order], every), place[order], np.cumsum(counts), np.array(ids, np.int64), pairs)

    @staticmethod
    def slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7_919) & ((1 << 22) - 1)


def packed(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Several word numbers to a 64-bit key, first word highest: keys in order compare as the words do."""
    per = 64 // bits
    keys = []
    for k in range(0, len(columns), per):
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns[k : k + per]:
            key = (key << np.uint64(bits)) | c.astype(np.uint64)
        keys.append(key << np.uint64(bits * (per - len(columns[k : k + per]))))
    return keys


def bound(suffixes: list[np.ndarray], probe: list[np.ndarray]) -> np.ndarray:
    """For each probe, how many sorted suffixes are smaller: all binary searches step together."""
    low, high = np.zeros(len(probe[0]), np.int64), np.full(len(probe[0]), len(suffixes[0]), np.int64)
    while (low < high).any():
        mid = (low + high) >> 1
        at = np.minimum(mid, len(suffixes[0]) - 1)
        less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for s, p in zip(suffixes, probe, strict=True):
            v = s[at]
            less |= same & (v < p)
            same &= v == p
        open_ = low < high
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    return low


def search(texts: pa.Array, test: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, starts of occurrences in the flat words, their windows, the text of each occurrence)."""
    flat, counts = alnum_words(texts)
    none = np.zeros(0, np.int64)
    if not len(flat):
        return counts, none, none, none
    code = pc.fill_null(pc.index_in(flat, value_set=test.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    depth = test.windows.shape[1]
    ends = np.repeat(np.cumsum(counts), counts)
    padded = np.append(code, np.zeros(depth, np.int64))
    start = code > 0
    if test.pairs is not None:
        start &= test.pairs[TestSet.slot(code, padded[1 : len(code) + 1])]
    start = np.flatnonzero(start)
    if not len(start):
        return counts, none, none, none
    left = ends[start] - start
    columns = [np.where(left > k, padded[start + k], 0) for k in range(depth)]
    bits = (len(test.vocabulary) + 1).bit_length()
    keys = packed(columns, bits)
    order = np.lexsort(keys[::-1])
    suffix = [k[order] for k in keys]  # the shard's suffix array, and its suffixes to the window's depth
    low = bound(suffix, packed(list(test.windows.T), bits))
    after = test.windows.copy()
    after[np.arange(len(after)), test.sizes - 1] += 1  # the least sequence beyond all that begin with the window
    high = bound(suffix, packed(list(after.T), bits))
    n = np.maximum(0, high - low)
    which = np.repeat(np.arange(len(n)), n)
    at = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    doc = np.repeat(np.arange(len(counts)), counts)
    return counts, start[at], which, doc[start[at]]


def longest(at: np.ndarray, which: np.ndarray, doc: np.ndarray, test: TestSet) -> dict[int, tuple[int, int, int]]:
    """For each text with occurrences its longest verbatim match: (words, minus the first flat word, minus the item's id).

    Matches grow word by word: one at a place follows one at the place before. Only two neighbouring words' places are held.
    """
    best: dict[int, tuple[int, int, int]] = {}
    order = np.lexsort((which, at))
    last_at, last_doc = -2, -1
    last_places, last_runs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    window = test.windows.shape[1]
    for p, w, d in zip(at[order].tolist(), which[order].tolist(), doc[order].tolist(), strict=True):
        places = test.places[test.place_at[w] : test.place_at[w + 1]]
        size = int(test.sizes[w])
        runs = np.ones(len(places), np.int64)
        if size == window:
            if p == last_at + 1 and d == last_doc and len(last_places):
                k = np.minimum(np.searchsorted(last_places, places - 1), len(last_places) - 1)
                follows = last_places[k] == places - 1
                runs[follows] += last_runs[k[follows]]
            last_at, last_doc, last_places, last_runs = p, d, places, runs
        most = int(runs.max())
        ids = test.items[np.searchsorted(test.item_at, places[runs == most], side="right")]
        found = (most + size - 1, -(p - most + 1), -int(ids.min()))
        if found > best.get(d, (0, 0, 0)):
            best[d] = found
    return best


def digest(texts: pa.Array, tests: Iterable[TestSet]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[tuple[int, int | None, int | None]]]:
    """Words, hit words, item ids and the longest match (words, first word, item) of each text, over all blocks of the benchmark."""
    counts, items, best = None, [], {}
    for test in tests:
        counts, at, which, doc = search(texts, test)
        if not items:
            items = [np.zeros(0, np.int64)] * len(counts)
            edge = np.zeros(int(counts.sum()) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + test.sizes[which], -1)
        pair = np.unique(np.stack([doc, which], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
        n = test.owner_at[pair[:, 1] + 1] - test.owner_at[pair[:, 1]]
        own = test.owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(test.owner_at[pair[:, 1]], n)]
        owner_doc = np.repeat(pair[:, 0], n)
        cuts = np.searchsorted(owner_doc, np.arange(len(counts) + 1))
        for d in np.unique(owner_doc).tolist():
            items[d] = np.union1d(items[d], own[cuts[d] : cuts[d + 1]])
        for d, found in longest(at, which, doc, test).items():
            best[d] = max(found, best.get(d, found))
    if counts is None:
        counts = alnum_words(texts)[1]
        return counts, np.zeros(len(counts), np.int64), [np.zeros(0, np.int64)] * len(counts), [(0, None, None)] * len(counts)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    ends = np.cumsum(counts)
    base = (ends - counts).tolist()
    runs = [(best[d][0], -best[d][1] - base[d], -best[d][2]) if d in best else (0, None, None) for d in range(len(counts))]
    return counts, hit[ends] - hit[ends - counts], items, runs


def pieces(text: str, window: int) -> Iterator[str]:
    """A text of more than BLOCK_BYTES in parts of about that, which overlap by a window less a word."""
    if len(text) <= BLOCK_BYTES:
        yield text
        return
    flat, _ = alnum_words(pa.array([text], pa.large_string()))
    step = max(window, len(flat) * BLOCK_BYTES // max(1, len(text)))
    for a in range(0, max(1, len(flat) - window + 1), step):
        yield " ".join(flat.slice(a, step + window - 1).to_pylist())


def test_blocks(benchmark: DataFrame, window: int = WINDOW) -> list:
    """The benchmark as broadcast blocks; the driver holds the text of one at a time."""
    sc, out = benchmark.sparkSession.sparkContext, []
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    ids, texts, size = [], [], 0

    def flush() -> None:
        if ids and (t := TestSet.build(ids, texts, window)):
            out.append(sc.broadcast(t))
        ids.clear(), texts.clear()

    for r in rows.toLocalIterator():
        for text in pieces(r.text, window):
            if size + len(text) > BLOCK_BYTES:
                flush()
                size = 0
            ids.append(r.item_id)
            texts.append(text)
            size += len(text)
    flush()
    return out


def each(blocks: list) -> Iterator[TestSet]:
    """One block after the other; of several none is kept in this worker's memory."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            vars(b).pop("_value", None)


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """The digest of every document."""
    blocks = test_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, most=SHARD_BYTES):
                counts, hit, items, runs = digest(b.column("text"), each(blocks))
                n = np.array([len(i) for i in items], np.int64)
                sums = [hashlib.sha256(",".join(sorted(map(str, i.tolist()))).encode()).hexdigest() if len(i) else EMPTY for i in items]
                cols = [b.column("doc_id"), pa.array(counts), pa.array(hit), pa.array(n), pa.array(sums, pa.string()), pa.array(n >= min_items), *[pa.array([r[k] for r in runs], pa.int64()) for k in range(3)]]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(batched).mapInArrow(run, DIGEST)


EMPTY = hashlib.sha256(b"").hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_items: int = 1) -> DataFrame:
    """The documents in which windows of fewer than ``min_items`` items occur, all their columns as they were."""
    blocks = test_blocks(benchmark, window)
    return filtered(docs, lambda texts: pa.array([len(i) < min_items for i in digest(texts, each(blocks))[2]], pa.bool_()), SHARD_BYTES)


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE_SQL = f"""WITH b AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT item_id, i AS place, w[i:i + {WINDOW - 1}] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
v AS (SELECT doc_id, i, w[i:i + n - 1] AS win, n FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT len(win) AS n FROM t))),
h AS (SELECT doc_id, i, n, item_id, i - place AS diagonal, i - row_number() OVER (PARTITION BY doc_id, item_id, i - place, n ORDER BY i) AS island FROM v JOIN t USING (win)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY 1),
r AS (SELECT doc_id, item_id, min(i) - 1 AS began, CASE WHEN n = {WINDOW} THEN count(*) + n - 1 ELSE n END AS words FROM h GROUP BY doc_id, item_id, diagonal, n, island),
l AS (SELECT doc_id, words AS longest, began AS longest_at, item_id AS longest_item FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, began, item_id) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= {MIN_ITEMS} AS contaminated,
 CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(longest_at AS BIGINT) AS longest_at, longest_item FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN l USING (doc_id)"""


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
