from collections import defaultdict

import pytest
from corpus import awkward, documents, empty

from ledgerspark.llm import mixing


def brute_targets(sizes, weights=(1.0, 2.0, 3.0), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_and_taken_words(spark):
    rows = mixing.mix(documents(spark), block=8).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    expected = brute_targets(sizes)
    assert len(rows) == documents(spark).count()
    for source, words in expected.items():
        assert target[source] == pytest.approx(words)
        own = [r.size for r in rows if r.source == source]
        assert abs(taken[source] - words) <= max(own)


def test_caps_reshare_and_null_source(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (1, "b"), (500, None), (300, None), (40, "c")])]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    sizes = {"a": 10, "b": 1, None: 800, "c": 40}
    expected = brute_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in out} == {s: pytest.approx(t) for s, t in expected.items()}
    assert all(r.taken <= 3 * r.size for r in out)


def test_copies_are_unbiased_and_reruns_agree(spark):
    rows = [(i, "w " * (20 + i % 7), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    runs = [{r.doc_id: r.copies for r in mixing.mix(df, seed=s, block=32).collect()} for s in (1, 1, 2, 3)]
    assert runs[0] == runs[1] and runs[1] != runs[2]
    due = {r.doc_id: r.target / r.source_size for r in mixing.mix(df, seed=9).collect()}
    for r in runs:
        assert all(abs(c - due[i]) < 1 + 1e-9 for i, c in r.items())


def test_awkward_and_empty(spark):
    rows = mixing.mix(awkward(spark)).collect()
    assert len(rows) == 9
    assert [r.taken for r in rows if r.size == 0] == [0, 0, 0]
    assert sum(r.doc_id == 4 for r in rows) == 2 and any(r.doc_id is None for r in rows)
    assert mixing.mix(empty(spark)).collect() == []


def test_ranks_by_code_point(spark):
    df = spark.createDataFrame([("b",), ("é",), ("Z",), (None,), ("😀",), ("ﬀ",), ("a",)], "s string")
    got = [r.s for r in mixing.ranked(df, "s").orderBy("rank").collect()]
    assert got == ["Z", "a", "b", "é", "ﬀ", "😀", None]
