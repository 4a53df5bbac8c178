"""Findings of FINDINGS_r02.md: each of these failed before its change."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from test_llm import frame, rows  # noqa: E402


def shuffled(spark):
    """Bytes that all shuffles of the session have written so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_op8_moves_no_more_where_text_fills_many_groups(spark):
    """Hundreds of groups, as many gigabytes have: anchors stay together, and windows don't go apart with all their words."""
    from keelson.llm import substring_dedup as S

    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(50_000):05}"
    common = [[word() for _ in range(n)] for n in (5, 8, 13, 30)]  # grams of far more places than a group has, in texts of their own
    docs = []
    for k in range(1000):
        w = [word() for _ in range(300)]
        for c in common:
            at = rng.randrange(len(w))
            w[at:at] = c
        docs.append((k, " ".join(w)))
    size, cols = sum(len(t) for _, t in docs), ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = sorted(brute.op8(docs))
    moved = {}
    for group in (150_000, 50):
        before = shuffled(spark)
        got = rows(S.remove_repeats(frame(spark, docs), group=group), *cols)
        moved[group] = (shuffled(spark) - before) / size
        assert got == want
    assert moved[50] < 3.5 * moved[150_000], moved


def test_op8_hot_grams(spark):
    """Texts of a few grams, all of them hot: windows go apart by all their words. Results are as before, whatever is hot."""
    from keelson.llm import substring_dedup as S

    rng = random.Random(4)
    docs = [(k, " ".join(rng.choices("ab", k=rng.randrange(40)))) for k in range(300)] + [(400 + k, "a " * 60) for k in range(50)] + [(500, None)]
    want = sorted(brute.op8(docs))
    hot, groups, size = S.census(frame(spark, docs).select("text"), S.WINDOW, 40)
    assert len(hot) == 16 and (hot[1:] > hot[:-1]).all() and groups > 100 and size >= sum(len(t or "") for _, t in docs)
    assert rows(S.remove_repeats(frame(spark, docs), group=40), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert S.census(frame(spark, []).select("text"), S.WINDOW, 40)[1:] == (1, 0)


def test_op8_blobs_of_several_slices(spark):
    """Slices far smaller than a task's text, compressed together and apart."""
    from keelson.llm import substring_dedup as S

    rng = random.Random(5)
    shared = [" ".join(f"v{rng.randrange(99)}" for _ in range(40)) for _ in range(9)]
    docs = [(k, " ".join([f"x{rng.randrange(5000)}" for _ in range(rng.randrange(60))] + [rng.choice(shared)])) for k in range(300)]
    want = sorted(brute.op8(docs))
    before = S.SLICE, S.HOLD, S.TAKE
    for S.SLICE, S.HOLD, S.TAKE in ((500, 1 << 20, 200), (500, 3000, 1 << 20), (300, 0, 1)):
        assert rows(S.remove_repeats(frame(spark, docs), group=700), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    S.SLICE, S.HOLD, S.TAKE = before
