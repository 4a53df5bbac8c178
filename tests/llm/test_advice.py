
import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from test_llm import frame, sample  # noqa: E402, F401


def test_op6_rare_entities_over_whole_documents(spark, sample):  # noqa: F811
    from keelson.llm import pii as P

    far = " " + sample[0][1][:400].replace("@", " ") + " "
    docs = [*sample, (60_000, f"Qz7{far}only@one.org"), *[(61_000 + k, f"Xqj w{k}{far}eight@texts.org") for k in range(8)], *[(62_000 + k, f"Vyk{far}copied@eight.org") for k in range(8)]]
    docs += [(None, "Qz7 only@one.org")]
    got = {r.doc_id: r.terms for r in P.spans(frame(spark, docs)).collect()}
    found = {d: {(t[x.start : x.end], x.value) for x in got[d]} for d, t in docs if t}
    assert ("Qz7", "generalise") in found[60_000]  # short, far from the mention, an entity of one document
    assert all(("Xqj", "remove") in found[61_000 + k] for k in range(8))
    assert all(("Vyk", "generalise") in found[62_000 + k] for k in range(8))  # eight copies are one text
    assert found[None] == set() and all(not got[d] for d, t in sample if "@" not in t and not any(c.isdigit() for c in t))


def test_op1_recall_with_any_number_of_axes(spark):
    """Production tables and probes; three axes on few dimensions, where there are as many buckets as with two on many."""
    import numpy as np
    from keelson.llm import ann as A

    for hashes, dim in ((1, 64), (2, 64), (3, 8)):
        rng = np.random.default_rng(6)
        x = rng.normal(size=(2000, dim))
        x /= np.sqrt((x**2).sum(1))[:, None]
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in A.search(df, df.filter("vec_id % 40 = 0"), hashes=hashes).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = sum(len(got[q] & set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:11].tolist())) for q in range(0, 2000, 40))
        assert hits >= 0.9 * 500, (hashes, dim, hits)
