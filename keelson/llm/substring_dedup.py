"""Operator 8: substring dedup by prefix-partitioned suffix trees.

A suffix tree of all words of a corpus would ship each suffix's next WINDOW words, thirteen times the text. These trees are sparse: of
the GRAM-word grams in a window the one of least hash is its anchor, and the suffixes of all windows that have one anchor go together,
as the WINDOW words around it and a few more, to the group of the anchor's words, the prefix that equal windows share. There are as
many groups as the anchors of all documents need. Grams that alone would take a large part of a group are found by a sample of all
grams and are no anchors: a window's anchor is the least of its other grams. Only windows of nothing but such grams go apart, by
a prefix of all their WINDOW words. So each group fits a worker's memory, and what moves grows with the text alone.

A group sorts its suffixes by their words, as codes of the group's own dictionary, and neighbours in that order with a common prefix
of WINDOW words or more are the leaves below a deep inner node. Words are compared, not hashes: a hash only says where a suffix goes.
A node with several documents is a repeat: all its places but those of the smallest doc_id are marked. Overlapping marks join to the
maximal repeats, which are cut out.

Before the shuffle each slice of documents reduces a node to the leaves of its smallest document: the others are marked on the
spot, so a passage that a third of all documents share reaches its group once for each slice. What moves is compressed text, about ten
bytes a word, of several slices at once, as text in small pieces compresses badly; documents move to meet their marks only if a bounded filter can't rule out that they have some, in buckets of bounded size.

Defined cases: null text has no words; a null doc_id neither marks nor is marked; rows with the same doc_id don't mark each other
and are judged apart; fewer than WINDOW words: nothing is removed; a very long text is a slice of its own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import batched, chain, hash_words, mix, parted, slices, stored, tidy, white_words, window_starts

WINDOW, GRAM = 13, 4
#: Anchors of a group, about: their suffixes are some 20 MB of text.
GROUP = 150_000
#: Parts of a group: a gram that would take more than one is no anchor. Of how many grams the sample has one.
PARTS, SAMPLE = 4, 128
NONE = np.uint64(2**64 - 1)
#: Text bytes of a slice, and of a final bucket, about.
SLICE, BUCKET_BYTES = 6 << 20, 4 << 20
#: Bytes of the words whose suffixes are compressed at once, and how many words are taken for it at a time.
HOLD, TAKE = 40 << 20, 1 << 20
BLOBS = "grp long, bucket long, data binary"
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def anchored(h: np.ndarray, counts: np.ndarray, window: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, its anchor's first word, the anchor's hash): the least gram in it that isn't hot, the first of equal ones.

    ``hot`` has sorted hashes. The hash of a window of hot grams alone is NONE.
    """
    start = np.flatnonzero(window_starts(counts, window))
    gram = min(GRAM, window)
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    g = mix(chain(h, gram))
    if len(hot):
        may = np.zeros(1 << 16, bool)
        may[(hot >> np.uint64(48)).astype(np.int64)] = True
        look = np.flatnonzero(may[(g >> np.uint64(48)).astype(np.int64)])
        g[look[hot[np.minimum(np.searchsorted(hot, g[look]), len(hot) - 1)] == g[look]]] = NONE
    at, least = start.copy(), g[start]
    for k in range(1, window - gram + 1):
        other = g[start + k]
        less = other < least
        at[less], least[less] = start[less] + k, other[less]
    return start, at, least


def census(docs: DataFrame, window: int, group: int) -> tuple[np.ndarray, int, int]:
    """The hot grams' hashes, sorted; how many groups there are; all text bytes. The driver gets three sums and the hot grams.

    A hot gram is there group / PARTS times or more, as a sample of the grams of all documents has it.
    """
    gram, most = min(GRAM, window), group // PARTS
    rate = max(1, min(SAMPLE, most // 256))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, most=SLICE):
                flat, counts = white_words(b.column("text"))
                h = hash_words(flat)
                start, at, _ = anchored(h, counts, window, np.zeros(0, np.uint64))
                g = mix(chain(h, gram)[np.flatnonzero(window_starts(counts, gram))])
                some, n = np.unique(g[mix(np.arange(len(g), dtype=np.uint64)) % np.uint64(rate) == 0].view(np.int64), return_counts=True)
                sums = [len(start) and 1 + int((at[1:] != at[:-1]).sum()), len(g), b.column("text").nbytes]
                cols = [np.append([1, 2, 3], np.zeros(len(some))).astype(np.int32), np.append([0, 0, 0], some).astype(np.int64), np.append(sums, n).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["what", "gram", "n"])

    every = docs.transform(batched).mapInArrow(count, "what int, gram long, n long").groupBy("what", "gram").agg(F.sum("n").alias("n"))
    rows = every.filter((F.col("what") > 0) | (F.col("n") * rate >= max(2, most))).collect()
    sums = {r.what: r.n for r in rows if r.what}
    hot = [(r.gram, r.n * rate) for r in rows if not r.what]
    # windows of hot grams alone are about the square of the hot grams' share
    share = min(1.0, sum(n for _, n in hot) / max(1, sums.get(2, 0)))
    runs = sums.get(1, 0) + int(share**2 * sums.get(2, 0))
    return np.sort(np.array([g for g, _ in hot], np.int64).view(np.uint64)), max(1, -(-runs // group)), sums.get(3, 0)


def planes(numbers: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte: neighbours are close, so little is left after compression."""
    return np.ascontiguousarray(np.diff(numbers, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def whole(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8")[:, 0])


def pack(docs: np.ndarray, places: np.ndarray, sizes: np.ndarray | None = None, text: bytes = b"") -> bytes:
    """Documents and places (of marks, or of the first windows of runs of ``sizes`` windows, whose words are ``text``)."""
    press = zstandard.ZstdCompressor(level=1)
    head = press.compress(planes(docs) + planes(places) + (b"" if sizes is None else sizes.astype(np.uint8).tobytes()))
    return len(head).to_bytes(8, "little") + head + (press.compress(text) if text else b"")


def unpack(data: bytes, runs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, bytes]:
    n = int.from_bytes(data[:8], "little")
    head = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])
    k = len(head) // (17 if runs else 16)
    rest = zstandard.ZstdDecompressor().decompress(data[8 + n :]) if len(data) > 8 + n else b""
    return whole(head[: 8 * k]), whole(head[8 * k : 16 * k]), np.frombuffer(head, np.uint8, k, 16 * k).astype(np.int64) if runs else None, rest


def bucket_of(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def keys_of(code: np.ndarray, start: np.ndarray, window: int, size: int) -> list[np.ndarray]:
    """The word codes of each window packed to 64-bit keys, first word highest: keys in order compare as the words' codes do."""
    bits = max(1, size.bit_length())
    per = 64 // bits
    out = []
    for a in range(0, window, per):
        key = np.zeros(len(start), np.uint64)
        for k in range(a, min(window, a + per)):
            key = (key << np.uint64(bits)) | code[start + k].astype(np.uint64)
        out.append(key)
    return out


def shared(path: np.ndarray) -> np.ndarray:
    """Places of the numbers that are there more than once."""
    order = np.argsort(path, kind="stable")
    same = path[order][1:] == path[order][:-1]
    return np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])])


def later_leaves(code: np.ndarray, start: np.ndarray, docs: np.ndarray, window: int, size: int) -> np.ndarray:
    """Suffixes in order of their words; of those below one node of the window's depth, the ones that aren't of its smallest document.

    Suffixes whose first words' hash no other has are leaves of their own and are left out before the sort.
    """
    if not len(start):
        return start
    near = shared(chain(mix(code.astype(np.uint64)), window)[start])
    keys = keys_of(code, start[near], window, size)
    order = np.lexsort(keys[::-1])
    deep = np.ones(max(0, len(order) - 1), bool)  # a common prefix of the whole window with the neighbour before
    for key in keys:
        s = key[order]
        deep &= s[1:] == s[:-1]
    begin = np.flatnonzero(np.concatenate([[True], ~deep])) if len(order) else order
    own = docs[near][order]
    least = np.minimum.reduceat(own, begin) if len(order) else own
    return near[order[own > np.repeat(least, np.diff(begin, append=len(order)))]]


def mark_blobs(docs: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    b = bucket_of(docs, buckets)
    order = np.lexsort((places, docs, b))
    docs, places, b = docs[order], places[order], b[order]
    cuts = np.flatnonzero(np.diff(b, prepend=-1)).tolist() + [len(b)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        yield int(b[x]), pack(docs[x:y], places[x:y])


def repeats(docs: DataFrame, window: int = WINDOW, group: int | None = None) -> tuple[DataFrame, int]:
    """Marks as blobs of (document, place) for each bucket, stored, and how many buckets there are.

    ``docs`` has doc_id, text and tag (a hash of the text, to tell rows of one doc_id apart); a place is tag << 32 | word.
    """
    hot, n_groups, size = census(docs.select("text"), window, group or GROUP)
    buckets = max(1, -(-size // BUCKET_BYTES))

    def rows(out: Iterable[tuple[int, int, bytes]]) -> pa.RecordBatch:
        grp, bucket, data = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(bucket, pa.int64()), pa.array(data, pa.binary())], ["grp", "bucket", "data"])

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A blob for each group: the runs of all slices held, whose words are taken TAKE at a time."""
        begin = np.cumsum([0] + [len(x[0]) for x in held])
        flat = pa.concat_arrays([x[0] for x in held])
        start, m, doc, place, grp = (np.concatenate([x[k] + (begin[i] if k == 1 else 0) for i, x in enumerate(held)]) for k in range(1, 6))
        held.clear()
        by = np.argsort(grp, kind="stable")
        start, m, doc, place, grp = start[by], m[by], doc[by], place[by], grp[by]
        cuts = np.append(np.flatnonzero(np.diff(grp, prepend=-1)), len(grp))
        ends = np.concatenate([[0], np.cumsum(m + window - 1)])[cuts]
        part = np.append(np.flatnonzero(np.diff(ends[:-1] // TAKE, prepend=-1)), len(cuts) - 1).tolist()
        for i, j in zip(part, part[1:], strict=False):
            x, y = cuts[i], cuts[j]
            words = flat.take(pa.array(spans(start[x:y], m[x:y] + window - 1)))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends[i : j + 1] - ends[i], pa.int32()), words), " ")
            own = list(zip(cuts[i:j].tolist(), cuts[i + 1 : j + 1].tolist(), strict=True))
            yield rows((int(grp[x]), -1, pack(doc[x:y], place[x:y], m[x:y], texts[k].as_buffer().to_pybytes())) for k, (x, y) in enumerate(own))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            for b in slices(batch, most=SLICE):
                b = b.take(pc.sort_indices(b, sort_keys=[("doc_id", "ascending"), ("tag", "ascending")]))
                flat, n = white_words(b.column("text"))
                h = hash_words(flat)
                start, at, least = anchored(h, n, window, hot)
                if not len(start):
                    continue
                row = np.repeat(np.arange(len(n)), n)[start]
                doc = b.column("doc_id").to_numpy()[row]
                place = (b.column("tag").to_numpy()[row] << 32) + (start - (np.cumsum(n) - n)[row])
                path = chain(h, window)[start]
                # windows of equal hash: those whose words are the first one's, in a later document
                order = np.argsort(path, kind="stable")
                begin = np.flatnonzero(np.concatenate([[True], path[order][1:] != path[order][:-1]]))
                head = np.empty(len(order), np.int64)
                head[order] = np.repeat(order[begin], np.diff(begin, append=len(order)))
                late = np.flatnonzero(doc > doc[head])
                code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                same = np.ones(len(late), bool)
                for k in range(window):
                    same &= code[start[late] + k] == code[start[head[late]] + k]
                late = late[same]
                if len(late):
                    yield rows((k % n_groups, k, d) for k, d in mark_blobs(doc[late], place[late], buckets))
                keep = np.ones(len(start), bool)
                keep[late] = False
                alone = least == NONE
                opens = np.ones(len(start), bool)  # runs of windows with one anchor
                opens[1:] = ~keep[:-1] | (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1]) | alone[1:]
                run = np.flatnonzero(opens & keep)
                m = np.bincount(np.cumsum(opens & keep)[keep] - 1, minlength=len(run))
                grp = (mix(np.where(alone[run], path[run], least[run])) % np.uint64(n_groups)).astype(np.int64)
                if held and size + flat.nbytes > HOLD:
                    yield from packed(held)
                    held, size = [], 0
                held.append((flat, start[run], m, doc[run], place[run], grp))
                size += flat.nbytes
        if held:
            yield from packed(held)

    def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(int(b), d) for b, d in zip(pdf["bucket"], pdf["data"], strict=True) if b >= 0]
        parts = [unpack(d, True) for b, d in zip(pdf["bucket"], pdf["data"], strict=True) if b < 0]
        if len(parts) > 1:
            doc, place, m = (np.concatenate([p[k] for p in parts]) for k in range(3))
            flat, _ = white_words(pa.array([p[3] for p in parts], pa.binary()).cast(pa.string()))
            coded = flat.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            del parts, flat
            size = m + window - 1
            start = spans(np.cumsum(size) - size, m)
            doc, place = np.repeat(doc, m), spans(place, m)
            gone = later_leaves(code, start, doc, window, len(coded.dictionary))
            if len(gone):
                out += mark_blobs(doc[gone], place[gone], buckets)
        tidy()
        return pd.DataFrame({"bucket": [o[0] for o in out], "data": [o[1] for o in out]}).astype({"bucket": "int64"})

    found = docs.transform(batched).mapInArrow(suffixes, BLOBS).groupBy("grp").applyInPandas(subtree, "bucket long, data binary")
    return stored_alone(found, "substring-marks"), buckets


def stored_alone(df: DataFrame, what: str) -> DataFrame:
    """``stored``, and the files of its shuffle go as soon as it is written: several times the text, else there until a driver's collection."""
    key, spark = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return stored(df, what)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def marked(marks: DataFrame) -> DataFrame:
    """The documents that marks name."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(unpack(d, False)[0]) for d in b.column("data").to_pylist()]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(own)))], ["doc_id"])

    return marks.select("data").transform(batched).mapInArrow(ids, "doc_id long")


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, group: int | None = None, texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and the kept words joined by a space if ``texts``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tag", F.coalesce(F.xxhash64("text"), F.lit(0)).bitwiseAND(F.lit(0x7FFFFFFF)))
    marks, buckets = repeats(rows, window, group)
    maybe, rest = parted(rows, marked(marks))

    def judged(d: int | None, words: list[bytes], n: int) -> tuple:
        kept = b" ".join(words)
        return (d, n, n - len(words), hashlib.sha256(kept).hexdigest()) + ((kept.decode(),) if texts else ())

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts
    schema = OUT + ", kept string" * texts

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(d, False) for d in right["data"]]
        if parts:
            doc, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order]
        out = []
        for d, text, tag in zip(left["doc_id"].tolist(), left["text"], left["tag"].tolist(), strict=True):
            words = text.encode().split() if text is not None else []
            n = len(words)
            if parts and d is not None and d == d and n:
                a, z = np.searchsorted(doc, [d, d + 1])
                own = place[a:z]
                own = own[(own >> 32) == tag] & 0xFFFFFFFF
                if len(own):
                    edge = np.zeros(n + window + 1, np.int64)
                    np.add.at(edge, own, 1)
                    np.add.at(edge, own + window, -1)
                    words = [w for w, c in zip(words, (np.cumsum(edge[:n]) > 0).tolist(), strict=True) if not c]
            out.append(judged(d, words, n))
        tidy()
        pdf = pd.DataFrame(out, columns=names)
        return pdf.assign(doc_id=pdf["doc_id"].astype("Int64"))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                split = ((d, (t or "").encode().split()) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True))
                out = [judged(d, w, len(w)) for d, w in split]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(cols)], names)

    # the same bucket as the marks': splitmix64 is not a Spark function, so the bucket is computed with the rows in Arrow
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pc.fill_null(b.column("doc_id"), 0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket_of(ids, buckets))], [*b.schema.names, "bucket"])

    dealt = maybe.transform(batched).mapInArrow(deal, "doc_id long, text string, tag long, bucket long")
    done = dealt.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInPandas(cut, schema)
    return done.unionAll(rest.select("doc_id", "text").transform(batched).mapInArrow(untouched, schema))


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, i, w[i:i + {WINDOW - 1}] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS least FROM v GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS pos FROM v JOIN f USING (win) WHERE doc_id > least),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
r AS (SELECT p.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE gone.pos IS NULL) AS kept FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.pos = p.pos GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
