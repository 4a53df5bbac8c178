"""Operator 2: quality classifier of supervised subword embeddings.

Every word, word bigram (a word with itself: one feature) and character n-gram (3 and 4 bytes, word edges marked) is hashed to one of BUCKETS learned vectors. A
document is the mean of its features' vectors, a linear layer with softmax gives the two classes, and numpy stochastic gradient
descent learns both. After training a feature's vector meets the output layer once, so that a text's score is a mean of table values.

The model is fitted on TRAIN_DOCS labelled documents of TRAIN_BYTES of text at most (those of the least hashed ids that fit, so the choice
doesn't depend on partitioning), in one task; every whole text is scored. labels, lang, source and doc_id are no features.

Defined cases: a null or blank text has no features and gets the score of the bias; without labelled rows every score is 0.5;
a null doc_id is held out; null labels are not learned from, a doc_id with several labels takes its least, one with several texts is
learned from once, by its least text; a very long text is scored whole, in memory linear in it; an empty table gives no rows;
other columns, whatever their names, are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import Scratch, batched, chain, filtered, hash_words, mix, slices, stored, tidy, white_words

BUCKETS = 1 << 17
DIM = 8
#: Bounds of the sample that the model is fitted on: documents, and bytes of their texts.
TRAIN_DOCS, TRAIN_BYTES = 4_000, 32 << 20
EPOCHS = 6
RATE = 0.3
NGRAMS = (3, 4)
#: Text bytes scored at once: a worker that other operators have used still holds their caches.
SCORE_BYTES = 2 << 20
SAME = np.uint64(BUCKETS - 1)


def word_features(flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its distinct word, features of the distinct words, how many each distinct word has)."""
    h = hash_words(flat)
    uniq, where, back = np.unique(h, return_index=True, return_inverse=True)
    words = flat.take(pa.array(where))
    _, off, data = words.buffers()
    offsets = np.frombuffer(off, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(offsets) + 2
    start = np.cumsum(size) - size
    buf = np.zeros(int(size.sum()), np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(buf)) - start[owner]
    buf[place == 0], buf[place == size[owner] - 1] = 1, 2
    inner = (place > 0) & (place < size[owner] - 1)
    buf[inner] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    feats, owners = [mix(uniq ^ np.uint64(1)) % np.uint64(BUCKETS - 1)], [np.arange(len(words))]
    for n in NGRAMS:
        if len(buf) < n:
            continue
        gram = np.zeros(len(buf) - n + 1, np.uint64)
        for k in range(n):
            gram = (gram << np.uint64(8)) | buf[k : len(buf) - n + 1 + k]
        ok = place[: len(gram)] + n <= size[owner[: len(gram)]]
        feats.append(mix(gram[ok] + np.uint64(n << 40)) % np.uint64(BUCKETS - 1))
        owners.append(owner[: len(gram)][ok])
    f, o = np.concatenate(feats).astype(np.int64), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return h, back.reshape(-1), f[order], np.bincount(o, minlength=len(words))


def bigrams(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of word pairs, and the text of each. All pairs of a word with itself are one feature, whichever word it is."""
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(h) < 2:
        return np.zeros(0, np.int64), doc[:0]
    ok = doc[:-1] == doc[1:]
    pair = np.where(h[:-1] == h[1:], SAME, chain(h, 2) % np.uint64(BUCKETS - 1))
    return pair[ok].astype(np.int64), doc[:-1][ok]


def text_features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares."""
    flat, counts = white_words(texts)
    none = (np.zeros(0, np.int64), np.zeros(0, np.float32))
    if not len(flat):
        return [none] * len(counts)
    h, word, feats, per = word_features(flat)
    start = np.cumsum(per) - per
    two, two_doc = bigrams(h, counts)
    cut = np.searchsorted(two_doc, np.arange(len(counts) + 1))
    ends, out = np.cumsum(counts), []
    for k, n in enumerate(counts.tolist()):
        w = word[ends[k] - n : ends[k]]
        rep = per[w]
        own = feats[np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep) + np.repeat(start[w], rep)]
        b, c = np.unique(np.concatenate([own, two[cut[k] : cut[k + 1]]]), return_counts=True)
        out.append((b, (c / max(1, c.sum())).astype(np.float32)) if n else none)
    return out


def text_scores(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    flat, counts = white_words(texts)
    total, n = np.zeros(len(counts)), np.zeros(len(counts))
    if len(flat):
        h, word, feats, per = word_features(flat)
        value = np.add.reduceat(table[feats], np.cumsum(per) - per)
        doc = np.repeat(np.arange(len(counts)), counts)
        two, two_doc = bigrams(h, counts)
        total = np.bincount(doc, value[word], len(counts)) + np.bincount(two_doc, table[two], len(counts))
        n = np.bincount(doc, per[word], len(counts)) + np.bincount(two_doc, minlength=len(counts))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -30, 30)))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent, a document a step; gives each bucket's log-odds and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    output[0] = (-0.5, 0.5)
    done, steps = 0, max(1, epochs * len(samples))
    for _ in range(epochs):
        for k in rng.permutation(len(samples)).tolist():
            b, share, label = samples[k]
            lr = rate * (1 - done / steps)
            done += 1
            v = vectors[b]
            hidden = share @ v
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = output @ p
            output -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            # features of a long text have small shares: its step is spread by the root of their squares
            vectors[b] = v - (lr * 4 / max(1e-3, float(np.sqrt(share @ share)))) * np.outer(share, back) if len(b) else v
    table = vectors @ (output[:, 1] - output[:, 0])
    return table.astype(np.float64), float(bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, float]:
    """The model, trained by one task on at most ``most`` labelled documents of ``most_bytes`` of text together; the driver gets the model alone."""
    spark = docs.sparkSession
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most)  # at most TRAIN_DOCS small rows: a bound for the broadcast
    text = F.col("text").cast("string")
    with Scratch() as run:
        # of rows with one doc_id the least text counts
        rows = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), text.alias("text")).join(F.broadcast(chosen), "_id")
        rows = stored(rows.groupBy("_id", "_label").agg(F.min("text").alias("text")), "quality-train")
        sizes = rows.select("_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("_id"), "_id").collect()
        held, size = [], 0
        for r in sizes:
            if size + r.n <= most_bytes:
                size += r.n
                held.append((r["_id"],))
        if not held:
            return np.zeros(BUCKETS), 0.0
        own = rows.join(F.broadcast(spark.createDataFrame(held, "_id long")), "_id").repartition(1)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            samples = []
            for batch in batches:
                for b in slices(batch, most=2 << 20):
                    for i, label, (x, y) in zip(b.column("_id").to_pylist(), b.column("_label").to_pylist(), text_features(b.column("text")), strict=True):
                        if len(x):
                            samples.append((i, x.astype(np.int32), y, int(label)))
            samples.sort(key=lambda s: s[0])
            table, bias = train([s[1:] for s in samples]) if samples else (np.zeros(BUCKETS), 0.0)
            samples.clear()
            tidy()
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([bias])], ["model", "bias"])

        model = own.select("_id", "_label", "text").transform(batched).mapInArrow(learn, "model binary, bias double").collect()[0]
        run.release(spark)
    return np.frombuffer(model.model, np.float64), float(model.bias)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, most=SCORE_BYTES):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text_scores(b.column("text"), *model.value))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(batched).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted 1, all their columns as they were."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return filtered(docs, lambda texts: pc.greater_equal(pa.array(text_scores(texts, *model.value)), 0.5), SCORE_BYTES)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
