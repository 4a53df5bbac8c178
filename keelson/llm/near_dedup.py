"""Operator 10: MinHash near-dedup with odd sketches.

1. Each document's shingle set gives a 128-bit set hash, BANDS bands of ROWS MinHash values, and an odd sketch: the
   BANDS * ROWS samples folded into a parity bitmap of SKETCH bits, so that the population count of the XOR of two bitmaps estimates
   a high similarity well.
2. Documents with equal sets are one class; its smallest doc_id stands for it. Exact copies go no further.
3. Classes that share a band bucket are candidates. Each chooses one partner before any sketch is fetched: the least member of its
   buckets that most of them have. The pair passes the odd-sketch test and is confirmed on full sets; components contract.
4. Again in buckets that still hold several components, where each document outside a bucket's least component chooses
   that component's least member, until a round links few of those who chose.
5. What is left is searched whole. In each bucket of several components, every document outside its largest component meets all
   members of other components, in blocks, sketches only; a task gives back the documents with a partner that passes, and a spanning
   forest of their components, never pairs. Components so connected form a cluster, whose documents with partners are dealt to blocks
   by bytes; each pair of blocks confirms its pairs across components on full sets, the most similar first, and gives back links that join.
6. The smallest doc_id of each component stays.

A pair of similarity s shares no band with probability (1 - s**ROWS)**BANDS, 5e-6 at 0.8; the bits that two sketches may differ by
follow from the threshold (DEVIATIONS above their mean). Everything else is exact. Groups of texts are sized by bytes.

Defined cases: null or blank texts have no shingles and link with nothing; a text with fewer words than a shingle has one shingle,
all its words; a very long text is one set, hashed in linear time; a null doc_id takes no part (its component is null, it is kept); rows with the same doc_id are one node;
an empty table gives no rows; other columns, whatever their names, pass through ``dedup`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import LOWER, Scratch, batched, chain, free, hash_words, mix, parted, slices, stored, white_words
from keelson.llm.graph import components

SHINGLE = 2
THRESHOLD = 80  # per cent
BANDS, ROWS, SKETCH = 40, 6, 512
#: The XOR of two sketches may have so many standard deviations more set bits than it has on average at the threshold.
DEVIATIONS = 5.5
#: Documents outside a bucket's largest component, and members, that are compared at once; rows of a group of such buckets, about.
STRAYS, MEMBERS, ROWS_OF_GROUP = 512, 4096, 20_000
#: Documents, and bytes of their texts, in a block of a cluster at most, about.
BLOCK, BLOCK_BYTES = 256, 1 << 20
#: Rounds of choosing go on while so many of those who chose, one in so many, found a link.
WORTH = 8
#: Text bytes of a document's partners in one group, and of a group.
PARTNER_BYTES, GROUP_BYTES = 1 << 20, 4 << 20
SIGNATURE = "doc_id long, n_shingles long, bytes long, set_a long, set_b long, bands array<long>, sketch array<long>"


def far(threshold: int) -> int:
    """Set bits of the XOR beyond which two sketches are of sets below the threshold (per cent).

    Of BANDS * ROWS samples a share 1 - s differs, and each of those flips a bit in either sketch.
    """
    differ = 1 - threshold / 100
    flips = 2 * BANDS * ROWS * differ
    mean = SKETCH * (1 - (1 - 2 / SKETCH) ** flips) / 2
    slope = (1 - 2 / SKETCH) ** flips
    spread = np.sqrt(SKETCH / 4 * (1 - slope**2) + (2 * slope) ** 2 * BANDS * ROWS * differ * (1 - differ))
    return int(np.ceil(mean + DEVIATIONS * spread))


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes, flat and sorted within each text, and how many each text has."""
    flat, counts = white_words(lower(texts))
    h = hash_words(flat)
    pieces, owner = [], []
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(h) >= n:
        grams = chain(h, n)
        ok = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :]) if n > 1 else np.arange(len(h))
        pieces.append(grams[ok])
        owner.append(doc[ok])
    short = np.flatnonzero((counts > 0) & (counts < n))
    starts = np.cumsum(counts) - counts
    for size in range(1, n):
        own = short[counts[short] == size]
        if len(own):
            whole = np.full(len(own), size, np.uint64)
            for k in range(size):
                whole = mix(whole ^ h[starts[own] + k])
            pieces.append(whole)
            owner.append(own)
    if not pieces:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    x, d = np.concatenate(pieces), np.concatenate(owner)
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (d[1:] != d[:-1])]) if len(x) else np.zeros(0, bool)
    return x[new], np.bincount(d[new], minlength=len(counts)).astype(np.int64)


def lower(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(b"" if data is None else data.to_pybytes().translate(LOWER))], offset=texts.offset)


def signatures(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts with shingles: (set hashes, bands, sketches)."""
    starts = np.cumsum(counts) - counts
    rng = np.random.default_rng(20_111)
    with np.errstate(over="ignore"):
        sums = np.stack([np.add.reduceat(mix(x ^ np.uint64(k)), starts) for k in (0x51ED27, 0xA3C59B)], 1)
        bands = np.zeros((len(counts), BANDS), np.uint64)
        bits = np.zeros((len(counts), SKETCH), np.uint8)
        row = np.arange(len(counts))
        for k in range(BANDS * ROWS):
            a, b = (np.uint64(v | 1) for v in rng.integers(0, 2**63, 2, dtype=np.uint64).tolist())
            low = np.minimum.reduceat((x ^ b) * a, starts)
            bands[:, k // ROWS] = mix(bands[:, k // ROWS] ^ low + np.uint64(k))
            bits[row, (mix(low ^ np.uint64(k)) % np.uint64(SKETCH)).astype(np.int64)] ^= 1
    return sums, bands, np.packbits(bits, 1).view("<u8")


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, most=2 << 20):
                x, counts = shingle_sets(b.column("text"), shingle)
                full = np.flatnonzero(counts)
                sums, bands, sketch = np.zeros((len(counts), 2), np.int64), [None] * len(counts), [None] * len(counts)
                if len(full):
                    s, bd, sk = signatures(x, counts[full])
                    sums[full] = s.view(np.int64)
                    list_of = lambda m: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(np.ascontiguousarray(m).view(np.int64).reshape(-1)))
                    spread = np.full(len(counts), -1)
                    spread[full] = np.arange(len(full))
                    take = pa.array(spread, mask=spread < 0)
                    bands, sketch = list_of(bd).take(take), list_of(sk).take(take)
                else:
                    bands = sketch = pa.array([None] * len(counts), pa.list_(pa.int64()))
                size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts), size, pa.array(sums[:, 0]), pa.array(sums[:, 1]), bands, sketch], ["doc_id", "n_shingles", "bytes", "set_a", "set_b", "bands", "sketch"])

    return docs.transform(batched).mapInArrow(run, SIGNATURE)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def shingle_set(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    w = _words(text)
    return set(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else {tuple(w)} if w else set()


def near(pairs: DataFrame, sigs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) that sizes and odd sketches allow, with the bytes of their texts: XOR and population count, in array functions."""
    one = lambda c: sigs.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("bytes").alias(f"z{c}"), F.col("sketch").alias(f"s{c}"))
    bits = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)
    fits = 100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    return pairs.join(one("a"), "a").join(one("b"), "b").filter(fits & (bits <= far(threshold))).select("a", "b", "za", "zb")


def confirmed(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar, stored. A document's partners are dealt in chunks and chunks in groups, both by bytes."""
    pairs = stored(near(pairs, sigs, threshold), "near-pairs")
    total = pairs.agg(F.coalesce(F.sum(F.col("za") + F.col("zb")), F.lit(0))).head()[0]
    groups = 1 + total // GROUP_BYTES
    many = pairs.groupBy("a").agg(F.ceil(F.sum("zb") / PARTNER_BYTES).alias("chunks"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.greatest("chunks", F.lit(1))).alias("chunk"))
    need = dealt.select("a", "chunk", F.col("b").alias("doc_id")).union(dealt.select("a", "chunk", F.col("a").alias("doc_id")).distinct())
    rows = need.join(texts, "doc_id").withColumn("g", F.pmod(F.xxhash64("a", "chunk"), F.lit(groups)))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (a, _), group in pdf.groupby(["a", "chunk"], sort=False):
            own: list[set] = [shingle_set(t, shingle) for d, t in zip(group["doc_id"], group["text"], strict=True) if d == a]
            for d, t in zip(group["doc_id"], group["text"], strict=True):
                if d != a:
                    s = shingle_set(t, shingle)
                    for o in own:
                        m = len(s & o)
                        if m and 100 * m >= threshold * (len(s) + len(o) - m):
                            out.append((a, d))
                            break
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return stored(rows.groupBy("g").applyInPandas(verify, "a long, b long").distinct(), "near-links")


def mixed(placed: DataFrame) -> DataFrame:
    """(bucket, low) of the buckets that hold several components: the least of them."""
    return placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("bucket", "low")


def moved(placed: DataFrame, links: DataFrame, what: str) -> DataFrame:
    """``placed`` with the components that confirmed links (a, b) join."""
    where = placed.select("doc_id", "comp").distinct()
    up = lambda c: where.select(F.col("doc_id").alias(c), F.col("comp").alias(f"up_{c}"))
    edges = links.join(up("a"), "a").join(up("b"), "b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).filter("a <> b")
    merged = components(edges, what).select(F.col("node").alias("comp"), F.col("comp").alias("least"))
    return stored(placed.join(merged, "comp", "left").select("bucket", "doc_id", F.coalesce("least", "comp").alias("comp")), "near-placed")


def chosen(placed: DataFrame) -> DataFrame:
    """Pairs (a, b): for each document b of buckets with a smaller component, the least member a of those that most buckets offer."""
    inside = placed.join(mixed(placed), "bucket")
    heads = inside.filter("comp = low").groupBy("bucket").agg(F.min("doc_id").alias("a"))
    return top_voted(inside.filter("comp <> low").select("bucket", F.col("doc_id").alias("b")).join(heads, "bucket"))


def top_voted(offers: DataFrame) -> DataFrame:
    votes = offers.groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))
    top = votes.groupBy("b").agg(F.max(F.struct("votes", (-F.col("a")).alias("minus"))).alias("x"))
    return top.select((-F.col("x.minus")).alias("a"), "b")


def forest(c: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of edges."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    out = []
    for x, y in zip(c.tolist(), e.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((min(x, y), max(x, y)))
    return out


def close_pairs(comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of left, of right) of different components that sizes and sketches allow."""
    xs, ys = [], []
    step = max(1, (1 << 20) // max(1, len(right)))
    for k in range(0, len(left), step):
        own = left[k : k + step]
        bits = np.bitwise_count(sketch[own][:, None] ^ sketch[right][None]).sum(2, dtype=np.int32)
        low, high = np.minimum(n[own][:, None], n[right][None]), np.maximum(n[own][:, None], n[right][None])
        i, j = np.nonzero((bits <= limit) & (100 * low >= threshold * high) & (comp[own][:, None] != comp[right][None]))
        xs.append(own[i]), ys.append(right[j])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *xs]), np.concatenate([none, *ys])


def partners(placed: DataFrame, sigs: DataFrame, threshold: int) -> DataFrame:
    """Rows (kind, a, b): kind 'edge' joins components of documents that share a bucket and pass the sketch test; kind 'doc' names such a document and its component."""
    inside = placed.join(mixed(placed).select("bucket"), "bucket")
    sizes = inside.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("x"), F.sum("n").alias("all"))
    main = main.select("bucket", F.col("x.comp").alias("main"), F.ceil(F.col("all") / MEMBERS).alias("parts"), F.ceil((F.col("all") - F.col("x.n")) / STRAYS).alias("blocks"))
    rows = stored(inside.join(main, "bucket").join(sigs.select("doc_id", "n_shingles", "sketch"), "doc_id"), "near-inside")
    groups = 1 + rows.count() // ROWS_OF_GROUP
    deal = lambda c, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    cols = ["bucket", "block", "part", "stray", "doc_id", "comp", "n_shingles", "sketch"]
    strays = rows.filter("comp <> main").withColumn("block", deal("blocks", 1)).withColumn("part", every("parts")).withColumn("stray", F.lit(True))
    members = rows.withColumn("part", deal("parts", 2)).withColumn("block", every("blocks")).withColumn("stray", F.lit(False))
    limit = far(threshold)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "block", "part"])
        doc, comp, n, stray = (pdf[c].to_numpy() for c in ("doc_id", "comp", "n_shingles", "stray"))
        sketch = np.stack(pdf["sketch"].to_list()).astype(np.int64).view(np.uint64)
        key = pdf[["bucket", "block", "part"]].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(pdf)]
        edges, docs = [], []
        for a, z in zip(cuts, cuts[1:], strict=False):
            row = np.arange(a, z)
            x, y = close_pairs(comp, n, sketch, row[stray[a:z]], row[~stray[a:z]], threshold, limit)
            if len(x):
                edges.append(np.unique(np.stack([np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])], 1), axis=0))
                docs.append(np.unique(np.concatenate([x, y])))
        if not edges:
            return pd.DataFrame({"kind": [], "a": [], "b": []}).astype({"kind": "object", "a": "int64", "b": "int64"})
        both = np.concatenate(edges)
        tree = np.array(forest(both[:, 0], both[:, 1]), np.int64).reshape(-1, 2)
        own = np.unique(np.stack([comp[np.concatenate(docs)], doc[np.concatenate(docs)]], 1), axis=0)
        return pd.DataFrame({"kind": ["edge"] * len(tree) + ["doc"] * len(own), "a": np.concatenate([tree[:, 0], own[:, 0]]), "b": np.concatenate([tree[:, 1], own[:, 1]])})

    spread = strays.select(cols).unionAll(members.select(cols)).withColumn("g", F.pmod(F.xxhash64("bucket", "block", "part"), F.lit(groups)))
    return spread.groupBy("g").applyInPandas(search, "kind string, a long, b long").distinct()


def searched(found: DataFrame, sigs: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Confirmed links (a, b) that join the components of each cluster of ``partners``. A task returns fewer links than it has documents."""
    clusters = components(found.filter("kind = 'edge'").select("a", "b"), "near-clusters").select(F.col("node").alias("comp"), F.col("comp").alias("cluster"))
    docs = found.filter("kind = 'doc'").select(F.col("a").alias("comp"), F.col("b").alias("doc_id")).join(clusters, "comp").join(sigs.select("doc_id", "n_shingles", "bytes", "sketch"), "doc_id")
    size = docs.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    dealt = docs.join(size, "cluster").withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).join(texts, "doc_id")
    spread = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("cluster", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "doc_id", "comp", "n_shingles", "sketch", "text")
    limit = far(threshold)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id"]).reset_index(drop=True)
        doc, comp, n, block = (pdf[c].to_numpy() for c in ("doc_id", "comp", "n_shingles", "i"))
        sketch = np.stack(pdf["sketch"].to_list()).astype(np.int64).view(np.uint64)
        text, sets = pdf["text"].to_list(), {}
        lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        x, y = close_pairs(comp, n, sketch, left, right, threshold, limit)
        if lo == hi:
            x, y = x[x < y], y[x < y]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.setdefault(c, c)) != c:
                root[c] = root[up]
                c = root[c]
            return c

        def set_of(k: int) -> set:
            if k not in sets:
                sets[k] = shingle_set(text[k], shingle)
            return sets[k]

        order = np.argsort(np.bitwise_count(sketch[x] ^ sketch[y]).sum(1), kind="stable")
        out = []
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            p, q = find(comp[i]), find(comp[j])
            if p != q:
                s, o = set_of(i), set_of(j)
                m = len(s & o)
                if m and 100 * m >= threshold * (len(s) + len(o) - m):
                    root[max(p, q)] = min(p, q)
                    out.append((int(doc[i]), int(doc[j])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return spread.groupBy("cluster", "lo", "hi").applyInPandas(search, "a long, b long")


def cluster(docs: DataFrame, *, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Stored; what the run wrote besides is deleted."""
    with Scratch() as run:
        out = stored(_cluster(docs, shingle, threshold), "near-components")
        run.release(docs.sparkSession, keep=out)
    return out


def _cluster(docs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = stored(signed(rows, shingle), "near-sigs")
    linked = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    keys = ["set_a", "set_b", "n_shingles"]
    classes = linked.groupBy(*keys).agg(F.min("doc_id").alias("rep"))
    own = lambda c: F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c)
    same = stored(linked.join(classes, keys).select("doc_id", "rep", "n_shingles", "bytes", own("bands"), own("sketch")), "near-classes")
    reps = same.filter("doc_id = rep")

    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "value")).select("doc_id", F.xxhash64("band", "value").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low <> high").select("bucket")
    placed = stored(banded.join(shared, "bucket").select("bucket", "doc_id", F.col("doc_id").alias("comp")), "near-buckets")
    comp = same.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    comps = reps.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("comp")).limit(0)
    if not placed.isEmpty():
        maybe, _ = parted(rows, placed.select("doc_id"))
        texts = stored(maybe.join(placed.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "near-texts")
        comps = _linked(placed, reps, texts, shingle, threshold).select(F.col("doc_id").alias("rep"), "comp").distinct()
    # a doc_id with several sets joins its classes
    several = same.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("doc_id")
    more = stored(same.join(several, "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), "near-several")
    if not more.isEmpty():
        comps = components(more.union(comps.select(F.col("comp").alias("a"), F.col("rep").alias("b"))), "near-several").withColumnRenamed("node", "rep")
    comp = comp.join(comps, "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles").join(comp, "doc_id", "left")
    blank = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", blank.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _linked(placed: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """``placed`` (bucket, doc_id, comp) with all links between members of one bucket found and joined."""
    k, going = 0, True
    while going:
        pairs = stored(chosen(placed), "near-chosen")
        links = confirmed(pairs, reps, texts, shingle, threshold)
        found, k = links.count(), k + 1
        going = found * WORTH >= pairs.count() > 0
        if found:
            placed = moved(placed, links, f"near-round-{k}")
    left = stored(partners(placed, reps, threshold), "near-partners")
    if not left.filter("kind = 'edge'").isEmpty():
        links = stored(searched(left, reps, texts, shingle, threshold), "near-more")
        if not links.isEmpty():
            placed = moved(placed, links, "near-last")
    return placed


def dedup(docs: DataFrame, *, shingle: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The documents with one of each component; rows that repeat a doc_id and its text are one document."""
    found = cluster(docs, shingle=shingle, threshold=threshold)
    own = free(docs, "_gone")
    again = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    gone = stored(found.filter("NOT kept").select("doc_id", F.lit(False).alias("again")).union(again.select("doc_id", F.lit(True).alias("again"))).distinct(), "near-gone")
    maybe, rest = parted(docs, gone.select("doc_id"))
    at = lambda ids: ids.select(F.col("doc_id").alias(own)).hint("merge")
    match = F.col("doc_id").cast("long") == F.col(own)
    out = rest.unionAll(maybe.join(at(gone), match, "left_anti"))
    if gone.filter("again").isEmpty():
        return out
    return out.unionAll(maybe.join(at(gone.filter("again")), match, "left_semi").dropDuplicates(["doc_id", "text"]))


ORACLE_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + {SHINGLE - 1}] AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
q AS (SELECT s.doc_id, x, n FROM s JOIN n USING (doc_id)),
l AS (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS total, count(*) AS m FROM q a JOIN q b USING (x) WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) GROUP BY 1, 2) WHERE 100 * m >= {THRESHOLD} * (total - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/documents.parquet"))
