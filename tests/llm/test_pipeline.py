import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402


def test_pipeline_is_its_stages_in_plain_python(spark):
    import duckdb
    import pandas as pd
    from tokenizers import Tokenizer

    import corpus_pipeline as C
    from keelson.llm import line_dedup, quality
    from keelson.llm.tokens import tokenizer_path

    d = "/root/testdata/sf0.001"
    docs, labels, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    good = {r.doc_id for r in quality.score(docs, labels).collect() if r.predicted}
    documents = pd.DataFrame([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good], columns=["doc_id", "text"])  # noqa: F841
    lines = duckdb.sql(line_dedup.sql()).fetchall()
    left = [(i, t) for i, _, gone, t in lines if not gone or t.strip(" \t\r\x0b\x0c\n")]
    near = {r[0] for r in brute.op10(left, 5) if r[3]}
    left = [x for x in left if x[0] in near]
    hit = {r[0] for r in brute.op9(left, [(r.item_id, r.text) for r in bench.collect()]) if r[3]}
    left = [x for x in left if x[0] not in hit]
    assert 0 < len(left) < len(documents)
    plain = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in left:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want += [(i, k, a, z - a, brute.crc(ids[a:z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = C.run(spark, d)
    assert sorted(tuple(r) for r in got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == sorted(want)


def test_stages_keep_the_columns(spark):
    import corpus_pipeline as C

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs.limit(5), d).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), d).count() == 0
    assert 4 <= len(C.STAGES) <= 5


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, copies, repeated rows, rows without id and columns that operators might call their own."""
    import duckdb
    import pandas as pd

    import corpus_pipeline as C
    from keelson.llm import line_dedup, quality

    d = "/root/testdata/sf0.001"
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    prose = next(t for _, t in sorted(base, key=lambda x: -len(x[1] or "")) if t)
    odd = [(9_001, None), (9_002, ""), (9_003, " \n\t"), (9_004, "one"), (9_005, (prose + "\n") * 30), (9_006, prose), (9_006, prose), (None, prose), (None, None), (9_007, "a\nb\nc"), (9_008, "x\na\nb\nc")]
    rows = [(i, t, "en", "s", len(t or ""), f"id {i}", f"gone {i}") for i, t in base + odd]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, _gone string").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs, labels, bench = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels", "benchmark"))

    good = [(r.doc_id, r.text) for r in quality.keep_good(docs, labels).collect()]
    documents = pd.DataFrame(sorted({x for x in good if x[0] is not None}, key=str), columns=["doc_id", "text"]).astype({"doc_id": "int64"})  # noqa: F841
    left = [(i, t) for i, _, gone, t in duckdb.sql(line_dedup.sql()).fetchall() if not gone or t.strip(" \t\r\x0b\x0c\n")] + [x for x in good if x[0] is None]
    near = {r[0] for r in brute.op10([x for x in left if x[0] is not None], 5) if r[3]}
    left = [x for x in left if x[0] is None or x[0] in near]
    hit = [r[3] for r in brute.op9(left, [(r.item_id, r.text) for r in bench.collect()])]
    want = sorted((str(i), t or "") for (i, t), n in zip(left, hit, strict=True) if not n)
    now = docs
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
    got = now.collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == want and all(r["_id"] == f"id {r.doc_id}" and r["_gone"] == f"gone {r.doc_id}" for r in got)
    packed = C.run(spark, str(tmp_path)).toPandas()
    assert len(packed[packed["piece"] == 0]) == len(want) and (packed.groupby("sequence_id")["length"].sum() <= 2048).all()
