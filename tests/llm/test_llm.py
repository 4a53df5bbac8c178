import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, items string, n_words long, kept boolean, bucket long"


def frame(spark, texts):
    """Documents with extra columns whose names clash with those of operators."""
    rows = [(k, t, "en", "s", len(t or ""), None, -1, None, 3) for k, t in (texts if texts and isinstance(texts[0], tuple) else enumerate(texts))]
    return spark.createDataFrame(rows, DOCS)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="session")
def sample(spark):
    """All documents of the smallest test table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


EDGES = [None, "", " ", "\n\n", "one", "one two", "one two three four five six seven eight nine", "x" * 5000, "a " * 3000, "é ü ß — ¿", "A.B,C", None, "one two"]


def test_op9(spark, sample):
    from keelson.llm import decontaminate as D

    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    bench += [(500, None), (501, ""), (502, "one TWO"), (502, "one two"), (503, "nine"), (None, "one two three four five six seven eight"), (504, "Two three four five six seven eight NINE")]
    docs = [*sample, *[(10_000 + k, t) for k, t in enumerate(EDGES)], (20_000, bench[0][1] + " " + bench[1][1]), (20_001, bench[0][1] * 3)]
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = rows(D.scan(frame(spark, docs), b), *cols)
    want = sorted(brute.op9(docs, bench))
    assert got == want
    long_bench = [x for x in bench if x[0] is not None and len((x[1] or "").split()) >= 8]  # no short items: the pair filter is on
    assert rows(D.scan(frame(spark, docs), spark.createDataFrame(long_bench, "item_id long, text string")), *cols) == sorted(brute.op9(docs, long_bench))
    kept = {r.doc_id for r in D.decontaminate(frame(spark, docs), b, min_items=2).collect()}
    assert kept == {w[0] for w in want if not w[5]}
    assert {r.doc_id for r in D.decontaminate(frame(spark, docs), b).collect()} == {w[0] for w in want if not w[3]}
    assert D.decontaminate(frame(spark, docs), b).columns == frame(spark, docs).columns
    assert rows(D.scan(frame(spark, docs[:3]), b.limit(0)), "n_hit") == [(0,)] * 3
    assert D.scan(frame(spark, []), b).count() == 0
    before, D.BLOCK_BYTES = D.BLOCK_BYTES, 300  # several blocks give the same
    assert rows(D.scan(frame(spark, docs), b), *cols) == want
    D.BLOCK_BYTES = 60  # so do items that are cut
    assert rows(D.scan(frame(spark, docs), b), *cols) == want
    D.BLOCK_BYTES = before
    import duckdb
    import pandas as pd

    documents, benchmark = pd.DataFrame(docs, columns=["doc_id", "text"]), pd.DataFrame(bench, columns=["item_id", "text"]).astype({"item_id": "Int64"})  # noqa: F841
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, D.scan(frame(spark, docs), b).collect()), key=key) == sorted(duckdb.sql(D.ORACLE_SQL).fetchall(), key=key)
    runs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "c d e f g h i j k l m"), (3, "u u u u u u u u u u")], "item_id long, text string")
    texts = ["x a b c d e f g h i j y", "a b c d e f g", "z a b c d e f g h i j k l", "u u u u u u u u u " * 3, "a b c d e f g h u u u u u u u u"]
    assert rows(D.scan(frame(spark, texts), runs), "doc_id", "longest", "longest_at", "longest_item") == [(0, 10, 1, 1), (1, 0, None, None), (2, 10, 1, 1), (3, 10, 0, 3), (4, 8, 0, 1)]


def test_tokens(spark, sample):
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from keelson.llm.common import fresh_path
    from keelson.llm.token_output import DamagedSegment, decode_segment, encode_segment, read_tokens, write_tokens
    from keelson.llm.tokens import Encoder, tokenizer_path

    plain = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    odd = ["a  b", "a \n b", "x   y", "don't 's", "<|endoftext|>", "　 a ", "a\n ", "é, é.", *["".join(rng.choices("ab1 \n\t 　'!é.,st", k=rng.randint(0, 12))) for _ in range(500)]]
    ids, counts = Encoder.of(tokenizer_path()).encode(pa.array([None, *odd], pa.string()))
    assert ids.tolist() == [i for t in odd for i in plain.encode(t, add_special_tokens=False).ids] and counts[0] == 0
    assert Encoder.of(tokenizer_path()).encode(pa.array(["a <|endoftext|> b"]))[0].tolist() == [64, 220, 50256, 275]
    docs = [*sample, *[(10_000 + k, t) for k, t in enumerate(EDGES)], (30_000, "a<|endoftext|>b, c<|endoftext|>")]
    path = fresh_path(spark, "test-tokens")
    write_tokens(frame(spark, docs), path)
    start, want = 0, []
    for d, t in sorted(docs, key=lambda x: x[0]):
        own = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(own), brute.crc(own), np.array(own, "<u4").tobytes()))
        start += len(own)
    assert rows(read_tokens(spark, path), "doc_id", "start", "n_tokens", "ids_crc32", "ids") == [(*w[:4], bytearray(w[4])) for w in want]
    empty = fresh_path(spark, "test-tokens")
    write_tokens(frame(spark, []), empty)
    assert read_tokens(spark, empty).count() == 0
    again = fresh_path(spark, "test-tokens")  # repeated and null ids: null first, each row by itself
    write_tokens(frame(spark, [(7, "a b"), (None, "c"), (7, "a b"), (7, None)]), again)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in read_tokens(spark, again).collect()) == [(-1, 2), (7, 1), (7, 3), (7, 3)]
    assert [r.start for r in read_tokens(spark, again).filter("doc_id IS NULL").collect()] == [0]
    for n in (0, 1, 33, 40_000):
        a = np.random.default_rng(n).zipf(1.5, n).clip(0, 60_000).astype(np.uint32)
        data = encode_segment(a)
        assert (decode_segment(data) == a).all()
        with pytest.raises(DamagedSegment):
            decode_segment(data[:-1] + bytes([data[-1] ^ 1]))
        with pytest.raises(DamagedSegment):
            decode_segment(data[:20])
    assert (decode_segment(data, range(1, 2)) == a[16_384:32_768]).all()


def test_packing(spark, sample):
    from tokenizers import Tokenizer

    from keelson.llm import packing as P
    from keelson.llm.tokens import tokenizer_path

    plain = Tokenizer.from_file(tokenizer_path())
    docs = [*sample, *[(10_000 + k, t) for k, t in enumerate(EDGES)], (5, "a row more with a doc_id that is there"), (30_000, "a<|endoftext|>b")]
    before, P.GROUP_ITEMS = P.GROUP_ITEMS, 40
    got = P.pack_documents(frame(spark, docs)).toPandas()
    P.GROUP_ITEMS = before
    want = []
    for d, t in docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0] + list(range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)) if len(ids) > 2048 else [0, len(ids)]
        want += [(d, k, a, z - a, brute.crc(ids[a:z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) * 1.1 + 2
    # the certificate: bins of a group are there, no fewer than its bound; full bins are groups of their own
    whole = got.groupby("sequence_id")["length"].sum()
    full = got["sequence_id"].map(whole) == 2048
    assert (got["group_bins"] >= got["group_bound"]).all() and (got[~full]["group_bins"] > 0).all()
    own = got.groupby("sequence_id")[["group_bins", "group_bound"]].first()
    for (bins, bound), g in own.groupby(["group_bins", "group_bound"]):
        assert bound >= 1 and (bins == 1 or len(g) % 1 == 0)
    assert sum(1 / b for b in own["group_bins"]) <= len(own) and got["sequence_id"].nunique() - own["group_bound"].div(own["group_bins"]).sum() < 3
    assert P.pack_documents(frame(spark, [])).count() == 0
    assert sorted((r.doc_id or -1, r.length) for r in P.pack_documents(frame(spark, [(None, "a b"), (None, None), (1, "")])).collect()) == [(-1, 1), (-1, 3), (1, 1)]
    import numpy as np

    for k in range(20):
        lengths = np.random.default_rng(k).integers(1, 2048, 50)
        bins, offsets, used = P.best_fit_decreasing(lengths, 2048)
        assert -(-lengths.sum() // 2048) <= P.lower_bound(lengths, 2048) <= len(used) and used.max() <= 2048
    assert P.lower_bound(np.array([1025] * 7), 2048) == 7 and P.lower_bound(np.array([683] * 7), 2048) == 4


def test_op8(spark, sample):
    from keelson.llm import substring_dedup as S

    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    shared = [" ".join(rng.choices(words, k=n)) for n in (12, 13, 14, 40)]
    more = [" ".join([*rng.choices(words, k=rng.randint(0, 9)), rng.choice(shared), *rng.choices(words, k=rng.randint(0, 9)), rng.choice(shared)]) for _ in range(60)]
    docs = [*sample, *[(10_000 + k, t) for k, t in enumerate(EDGES)], *[(5_000 - k, t) for k, t in enumerate(more)], (30_000, sample[0][1]), (30_000, more[0]), (30_001, "a " * 3000)]
    want = sorted(brute.op8([d for d in docs if d[0] != 30_000]))
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    for group in (None, 500):
        got = rows(S.remove_repeats(frame(spark, docs), group=group).filter("doc_id <> 30000"), *cols)
        assert got == want
    twice = sorted(brute.op8([d for d in docs if d[1] is not more[0] or d[0] != 30_000]) + brute.op8([d for d in docs if d[1] != sample[0][1] or d[0] != 30_000]))
    assert rows(S.remove_repeats(frame(spark, docs)).filter("doc_id = 30000"), *cols) == [t for t in twice if t[0] == 30_000]
    odd = frame(spark, [(None, more[0]), (7, more[0]), (8, more[0]), (9, None)])
    assert sorted((r.doc_id or -1, r.n_removed > 0, r.kept is None) for r in S.remove_repeats(odd, texts=True).collect()) == [(-1, False, False), (7, False, False), (8, True, False), (9, False, False)]
    assert S.remove_repeats(frame(spark, [])).count() == 0


def near_copies(rng, base, n, edits):
    words = base.split()
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        out.append(" ".join(w))
    return out


def test_op10(spark, sample):
    from keelson.llm import near_dedup as N

    rng = random.Random(9)
    base = [" ".join(f"v{rng.randrange(300)}" for _ in range(n)) for n in (60, 150)]
    docs = [*sample, *[(10_000 + k, t) for k, t in enumerate(EDGES)], *[(3_000 + k, t) for k, t in enumerate(near_copies(rng, base[0], 50, 6) + near_copies(rng, base[1], 90, 14))], (40_000, "THE " + base[0]), (40_001, "a b c d e f"), (40_002, "a b c d e"), (40_003, "one"), (40_004, "ONE")]
    cols = ["doc_id", "n_shingles", "component_id", "kept"]
    want = sorted(brute.op10(docs))
    names = "STRAYS", "MEMBERS", "ROWS_OF_GROUP", "BLOCK", "BLOCK_BYTES", "PARTNER_BYTES", "GROUP_BYTES", "WORTH"
    before = [getattr(N, x) for x in names]
    assert rows(N.cluster(frame(spark, docs)), *cols) == want
    for small in ((3, 5, 20, 4, 2000, 300, 2000, 8), (3, 5, 20, 20, 10**6, 300, 2000, 0)):  # blocks, groups and rounds change nothing
        for x, v in zip(names, small, strict=True):
            setattr(N, x, v)
        assert rows(N.cluster(frame(spark, docs)), *cols) == want
    for x, v in zip(names, before, strict=True):
        setattr(N, x, v)
    want5 = sorted(brute.op10(docs, 5))
    assert rows(N.cluster(frame(spark, docs), shingle=5), *cols) == want5
    assert sorted(r.doc_id for r in N.dedup(frame(spark, docs)).collect()) == [w[0] for w in want5 if w[3]]
    odd = frame(spark, [(None, base[0]), (5, base[0]), (6, base[0]), (6, base[1]), (7, base[1]), (8, None)])
    assert rows(N.cluster(odd).filter("doc_id IS NOT NULL"), "doc_id", "component_id", "kept") == [(5, 5, True), (6, 5, False), (6, 5, False), (7, 5, False), (8, 8, True)]
    assert rows(N.cluster(odd).filter("doc_id IS NULL"), "component_id", "kept") == [(None, True)]
    assert sorted((r.doc_id or -1) for r in N.dedup(frame(spark, [(None, base[0]), (5, base[0]), (5, base[0]), (5, base[1]), (7, base[1]), (8, None), (8, None)])).collect()) == [-1, 5, 5, 8]
    assert N.cluster(frame(spark, [])).count() == 0


def test_op2_scores_are_plain_means(spark):
    """Features and score of each text, one word and one n-gram at a time."""
    import numpy as np
    import pyarrow as pa

    from keelson.llm import common
    from keelson.llm import quality as Q

    table, bias = np.random.default_rng(2).normal(size=Q.BUCKETS), 0.25
    texts = [None, "", "  ", "one", "one one one", "Ein größerer Text, mit mehr Wörtern.", "a b c d e f g a b c", "日本 語", "x" * 70]

    def one(text):
        words = [w.encode() for w in (text or "").split()]
        h = [common.hash_words(pa.array([w.decode()]))[0] for w in words]
        feats = []
        for w, x in zip(words, h, strict=True):
            feats.append(int(common.mix(np.array([x ^ np.uint64(1)]))[0] % np.uint64(Q.BUCKETS - 1)))
            marked = [1, *w, 2]
            for n in Q.NGRAMS:
                for k in range(len(marked) - n + 1):
                    gram = sum(b << (8 * (n - 1 - j)) for j, b in enumerate(marked[k : k + n]))
                    feats.append(int(common.mix(np.array([gram + (n << 40)], np.uint64))[0] % np.uint64(Q.BUCKETS - 1)))
        for x, y in zip(h, h[1:], strict=False):
            feats.append(Q.BUCKETS - 1 if x == y else int(common.chain(np.array([x, y]), 2)[0] % np.uint64(Q.BUCKETS - 1)))
        return feats, 1 / (1 + np.exp(-(np.mean(table[feats]) if feats else 0.0) - bias))

    want = [one(t) for t in texts]
    assert np.allclose(Q.text_scores(pa.array(texts, pa.string()), table, bias), [s for _, s in want], atol=1e-12)
    for (b, share), (feats, _) in zip(Q.text_features(pa.array(texts, pa.string())), want, strict=True):
        assert b.tolist() == sorted(set(feats)) and np.allclose(share, [feats.count(x) / len(feats) for x in b.tolist()])
    # a step of descent against numerical gradients: the loss falls, and the bias moves towards the labels
    a, b_ = Q.text_features(pa.array(["good text here", "bad words there"], pa.string()))
    model, offset = Q.train([(*a, 1), (*b_, 0)], epochs=200)
    score = lambda t: Q.text_scores(pa.array([t]), model, offset)[0]
    assert score("good text here") > 0.8 and score("bad words there") < 0.2


def test_op2_sample_is_bounded(spark):
    """Documents beyond the bounds are not learned from; repeated rows count once."""
    import numpy as np

    from keelson.llm import quality as Q

    docs = frame(spark, [(k, f"{'good' if k % 2 else 'poor'} text {k} " * (1 + k % 3)) for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    whole = Q.fit(docs, labels)
    assert np.array_equal(whole[0], Q.fit(docs.union(docs), labels.union(labels))[0])
    for bounds in ({"most": 5}, {"most_bytes": 200}):
        few = Q.fit(docs, labels, **bounds)
        assert not np.array_equal(few[0], whole[0]) and np.array_equal(few[0], Q.fit(docs.union(docs), labels, **bounds)[0])
    assert not Q.fit(docs, labels, most_bytes=1)[0].any()


def test_op2(spark):
    from keelson.llm import quality as Q

    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in Q.score(docs, labels).collect()}
    import zlib

    truth = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in got]
    assert all(g.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, g in got.items()) and len(got) == docs.count()
    for label in (0, 1):
        own = [g.predicted == q for g, q in truth if g.held_out and q == label]
        assert sum(own) >= 0.9 * len(own)
    # what the held-out rows are labelled doesn't matter, nor do other columns
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    again = {r.doc_id: r.score for r in Q.score(docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS quality", "0 AS score"), flipped).collect()}
    assert again == {k: g.score for k, g in got.items()}
    odd = frame(spark, [(1, None), (2, ""), (3, "a"), (None, "a b"), (4, "a " * 50_000), (4, "a")])
    out = Q.score(odd, labels.limit(0)).collect()
    assert len(out) == 6 and all(r.score == 0.5 and r.predicted == 1 for r in out) and [r.held_out for r in out if r.doc_id is None] == [True]
    assert Q.score(frame(spark, []), labels).count() == 0
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, g in got.items() if g.predicted}


def test_op4(spark):
    from keelson.llm import url_filter as U

    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/x", "http://example.org/es", "http://example.org/en/12?q", "x://notexample.org/en/1", "http://fr.com/fr/a#b", "http://com/de/", "http://com/dE/", "https://a.net/CASINO-x", "https://a.net/casinos",
            "https://a.net/free", "https://a.net/free/win", "https://a.net/free/free", "https://a.net?x=http://b.org/", "://", "http://a.org", "http://é.net/xxx", "http://a.net/éxxx", "http://a.org/casino"]
    pages = spark.createDataFrame([(k, u, "h", 5) for k, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, U.CONTRACT).collect()}
    want = [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/es", "org/", "allow"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("notexample.org", "/en/1", "org/", "allow"), ("fr.com", "/fr/a", "com/fr/", "allow"), ("com", "/de/", "com/de/", "block"), ("com", "/dE/", None, "allow"), ("a.net", "/CASINO-x", None, "block"), ("a.net", "/casinos", None, "allow"),
        ("a.net", "/free", None, "allow"), ("a.net", "/free/win", None, "block"), ("a.net", "/free/free", None, "allow"), ("a.net", "", None, "allow"), ("", "", None, "allow"), ("a.org", "", None, "allow"), ("é.net", "/xxx", None, "block"), ("a.net", "/éxxx", None, "block"), ("a.org", "/casino", "org/", "allow"),
    ]
    assert [got[k] for k in range(len(urls))] == want
    import duckdb
    import pandas as pd

    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls})  # noqa: F841
    assert sorted(duckdb.sql(U.ORACLE_SQL).fetchall()) == sorted((k, *want[k], *U.hits(U.automaton(U.STRICT, U.SOFT), urls[k])) for k in range(len(urls)))
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), ()).count() == 0
    odd = spark.createDataFrame([(None, "http://a.net/xxx", 1), (1, "http://a.net/" + "y/" * 200_000 + "free/win", 2), (1, "http://a.net/free", 3), (1, "http://a.net/free", 3)], "page_id long, url string, host int")
    assert sorted((r.page_id or -1, r.verdict) for r in U.judge(odd, U.CONTRACT).collect()) == [(-1, "block"), (1, "allow"), (1, "allow"), (1, "block")]
    tie = [U.Rule("net", "/a", "allow"), U.Rule("net", "/a", "block")]
    assert [r.verdict for r in U.judge(spark.createDataFrame([(1, "http://x.net/ab")], "page_id long, url string"), tie).collect()] == ["block"]


def test_op5(spark, sample):
    import duckdb
    import pandas as pd

    from keelson.llm import line_dedup as L

    rng = random.Random(4)
    lines = [f"line {k}" for k in range(12)] + ["", " \t"] + [f"long {k} " * 50 for k in range(3)] + [f"middling {k} " * 16 for k in range(3)]
    docs = [*sample, *[(10_000 + k, t) for k, t in enumerate(EDGES)], *[(3_000 - k, "\n".join(rng.choices(lines, k=rng.randint(0, 14)))) for k in range(160)], (20_000, "a\n" * 50), (20_001, "x\n\ny\nz\n"), (20_002, "w\nx\ny\nz"), (20_003, "　\n　\n　\n　")]
    documents = pd.DataFrame(docs, columns=["doc_id", "text"])  # noqa: F841
    want = sorted(duckdb.sql(L.sql()).fetchall())
    cols = ["doc_id", "n_lines", "n_removed", "text"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, L.line_report(frame(spark, docs)).select(cols).collect()), key=key) == sorted(want, key=key)
    wide = sorted(duckdb.sql(L.sql(5, 700)).fetchall())
    assert wide != want and sorted(map(tuple, L.line_report(frame(spark, docs), lines=5, long=700).select(cols).collect()), key=key) == sorted(wide, key=key)
    # plain Python, for the SQL itself
    seen, gone = set(), {}
    for d, t in sorted(x for x in docs if x[1] is not None):
        full = [(k, x) for k, x in enumerate(t.split("\n")) if x.translate(dict.fromkeys(map(ord, L.BLANK)))]
        runs = [full[j : j + m] for j in range(len(full)) for m in (1, 2, 3) if j + m <= len(full)]
        for run in runs:  # in order of where they begin
            words = tuple(x for _, x in run)
            if len(run) == 3 or sum(len(x.encode()) for x in words) >= L.LONG:
                if words in seen:
                    gone.setdefault(d, set()).update(k for k, _ in run)
                seen.add(words)
    assert {d: n for d, _, n, _ in want if n} == {d: len(g) for d, g in gone.items()}
    one = "a single line of more than fifty words " * 8
    assert [r.n_removed for r in L.line_report(frame(spark, [(1, one), (2, "short\n" + one + "\nother")])).orderBy("doc_id").collect()] == [0, 1]
    out = L.dedup(frame(spark, docs))
    assert out.columns == frame(spark, docs).columns
    got = {r.doc_id: (r.text, r.n_chars, r.kept) for r in out.collect()}
    assert set(got) == {d for d, _, gone, t in want if not gone or t.strip(" \t\r\x0b\x0c\n")}
    assert all(got[d][0] == t for d, _, _, t in want if d in got) and all(t is None or n == len(t) for t, n, _ in got.values())
    odd = frame(spark, [(None, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (2, "a\nb\nc"), (3, None)])
    assert sorted((r.doc_id or -1, r.text or "-", r.n_removed) for r in L.line_report(odd).collect()) == [(-1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "-", 3), (2, "-", 3), (3, "-", 0)]
    assert L.line_report(frame(spark, [])).count() == 0


CLASH = ["_id", "_key", "_gone", "_tag", "_lines", "_text", "_spans", "_bits", "_slot", "_label", "_K`ey", "seq", "q", "g"]


def clashing(spark, texts):
    """Documents with columns that are named as an operator might name its own."""
    rows_ = [(d, t, *[f"{c} of {d}" for c in CLASH]) for d, t in texts]
    return spark.createDataFrame(rows_, "doc_id long, text string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in CLASH))


def test_columns_of_any_name_pass_through(spark):
    from keelson.llm import decontaminate, line_dedup, near_dedup, pii, quality

    texts = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "mail a@b.co now"), (4, None), (5, "a\nb\nc\nd")]
    df = clashing(spark, texts)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "never in there")], "item_id long, text string")
    for run in (line_dedup.dedup, near_dedup.dedup, pii.sanitize, lambda d: quality.keep_good(d, labels), lambda d: decontaminate.decontaminate(d, bench)):
        out = run(df)
        assert out.columns == df.columns
        found = out.collect()
        assert found and all(r[c] == f"{c} of {r.doc_id}" for r in found for c in CLASH)


def test_op5_on_a_text_of_very_many_lines(spark):
    import time

    from keelson.llm import line_dedup as L

    text = "\n".join(f"row {k}" for k in range(100_000))
    df = spark.createDataFrame([(1, text), (2, text + "\nlast")], "doc_id long, text string").repartition(2)
    began = time.time()
    assert [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in L.line_report(df).orderBy("doc_id").collect()] == [(1, 100_000, 0, text), (2, 100_001, 100_000, "last")]
    assert time.time() - began < 60


def test_op6(spark, sample):
    from keelson.llm import pii as P

    rng = random.Random(8)
    odd = [
        "mail a.b+c@d-e.fg.hi, x@y, a@b.c@d.e _q@w.e..r", "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.001 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 5500000000000004", "+1 (499) 555-6503, +12, +1((((, +1234567890123456 ++44 20 7946 0958.",
        "é😀 a@b.co 😀 1.1.1.1 x", "9" * 30_000, "a" * 30_000 + "@b.c", "a.b@" * 3_000, "1.1." * 5_000, "+1 " * 5_000, "@." * 100, "4111111111111111" * 30, "a@b" + ".c" * 20_000,
    ]
    odd += ["".join(rng.choices("ab@.1259+-() _", k=rng.randint(1, 60))) for _ in range(300)]
    odd += [f"call Zanzibarious Quillon at boss{rng.randint(0, 1)}@corp.org about number {k} of many things" for k in range(8)]
    odd += [f"Vorvax number {k} lives beside 10.9.8.7" for k in range(16)]
    docs = [*sample, *[(10_000 + k, t) for k, t in enumerate([*EDGES, *odd])]]
    got = {r.doc_id: r for r in P.report(frame(spark, docs)).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        want = brute.base_spans(t)
        spelled = ",".join(f"{k}:{a}:{z}" for k, a, z in want)
        r = got[d]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in brute.KINDS), (d, (t or "")[:80])
        assert r.base_sha256 == brute.sha(spelled) and (r.spans == spelled or r.spans.startswith(spelled + "," if spelled else "term:")), d
    # the method's spans, against plain counting; the same rows twice change nothing
    plain = brute.terms(docs)
    assert any(plain.values()) and {"generalise", "remove"} == {x[2] for v in plain.values() for x in v}
    for again in (docs, docs + docs):
        found = {r.doc_id: [(x.start, x.end, x.value) for x in r.terms] for r in P.spans(frame(spark, again)).collect()}
        assert found == plain
    terms = {t[int(a) : int(z)] for d, t in docs if t for k, a, z in (x.split(":") for x in got[d].spans.split(",") if x) if k == "term"}
    assert {"Zanzibarious", "Quillon"} <= terms
    clean = {r.doc_id: r.text for r in P.sanitize(frame(spark, docs)).collect()}
    assert clean[10_000] is None and all("@corp" not in (t or "") and "Zanzibarious" not in (t or "") for t in clean.values())
    assert clean[10_000 + len(EDGES) + 4] == "é😀 [EMAIL] 😀 [IP] x"
    assert P.report(frame(spark, [])).count() == 0 and P.sanitize(frame(spark, docs[:1])).columns == frame(spark, []).columns
    assert P.report(frame(spark, [(None, "a@b.c"), (None, None)])).count() == 2


def exact_neighbours(rows, queries, k=10):
    import numpy as np

    out = {}
    for q, v in queries:
        best = {}
        for i, x in rows:
            if i != q:
                d = float(np.sqrt(((np.array(x, float) - np.array(v, float)) ** 2).sum()))
                best[i] = min(d, best.get(i, d))
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def test_op1(spark):
    import numpy as np

    from keelson.llm import ann as A

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows_ = [(r.vec_id, r.embedding) for r in table.collect()]
    x = np.array([v for _, v in rows_], np.float64)
    got = {}
    for r in A.op1(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, v in rows_:
        if q % 100 == 0:
            d = np.sqrt(((x - np.array(v, np.float64)) ** 2).sum(1))
            want = [i for _, i in sorted((d[k], i) for k, (i, _) in enumerate(rows_) if i != q)[:10]]
            own = sorted(got[q])
            assert [o[0] for o in own] == list(range(1, 11)) and [(o[2], o[1]) for o in own] == sorted((o[2], o[1]) for o in own)
            assert all(abs(s - d[i]) < 1e-12 for _, i, s in own) if rows_[5][0] == 5 else True
            hits, total = hits + len({o[1] for o in own} & set(want)), total + 10
    assert hits >= 0.9 * total
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 12))
    vecs = [(k, [float(c) for c in (base[k % 3] + (0.01 * rng.normal(size=12) if k % 2 else 0)) * (1 + k % 5)]) for k in range(300)]
    bad = [(900, None), (901, [0.0] * 12), (902, [None] + [1.0] * 11), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [1.0] * 5), (906, []), (None, [1.0] * 12), (7, [9.0] * 12), (7, vecs[7][1])]
    df = spark.createDataFrame(vecs + bad, "vec_id long, embedding array<double>")
    good = vecs + [(7, [9.0] * 12)]
    for hashes in (1, 2):
        found = {}
        for r in A.search(df, df.filter("vec_id % 50 = 0 OR vec_id = 901"), hashes=hashes, probes=100).collect():
            found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        want = exact_neighbours(good, [v for v in vecs if v[0] % 50 == 0])
        assert set(found) == set(want)
        for q in want:
            assert [i for _, i in sorted(found[q])] == [i for _, i in want[q]]
    # lengths apart; clusters far from the origin; numbers whose squares leave the range of doubles, both ways
    rng = np.random.default_rng(4)
    for scale, shift in ((1.0, 1e6), (1e160, 0.0), (1e-170, 0.0), (1e-3, 1e9)):
        far = [(k, [float(c) for c in shift + scale * rng.normal(size=6)]) for k in range(200)] + [(500 + k, [float(c) for c in rng.normal(size=4)]) for k in range(30)]
        df_ = spark.createDataFrame(far, "vec_id long, embedding array<double>")
        found = {}
        for r in A.search(df_, df_.filter("vec_id % 10 = 0"), probes=100).collect():
            found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert len(found) == 23
        for q, v in far:
            if q % 10 == 0:
                own = np.array(v)
                d = sorted((float(A.distances(np.array([x]), own)[0]), i) for i, x in far if i != q and len(x) == len(v))[:10]
                assert [(i, s) for _, i, s in sorted(found[q])] == [(i, s) for s, i in d], (scale, shift)
                assert all(0 < s < float("inf") for s, _ in d)
    before, A.CHUNK = A.CHUNK, 7  # chunks change nothing
    again = {(r.query_id, r.rank, r.vec_id) for r in A.search(df, df.filter("vec_id % 50 = 0"), probes=100).collect()}
    A.CHUNK = before
    assert again == {(q, k, i) for q, w in want.items() for k, (_, i) in enumerate(w, 1)}
    few = spark.createDataFrame(vecs[:4], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in A.search(few, few).collect()) == [(a, b) for a in range(4) for b in range(4) if a != b]
    assert A.search(df.limit(0), df).count() == 0 and A.search(df, df.limit(0)).count() == 0
