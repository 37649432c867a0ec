import re
from collections import Counter

import numpy as np
import pytest
from corpus import awkward, documents, empty

from ledgerspark.llm import quality


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 5))
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def test_statistics_of_whole_documents(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = quality.judge(documents(spark)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert brute_statistics(texts[r.doc_id]) == tuple(r[c] for c in (*quality.STATS, "base_failed"))
        assert not (r.kept and r.base_failed)


def test_statistics_of_odd_texts(spark):
    odd = [" a b c d e a b c d e ", "x\nx\n\n \nx", "a a a a a a a a", "😀 # 😀\t<b> &", "a b c d e f a b c d e f a b c d e", "", None]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(odd)], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.measure(df, "doc_id", "text", "lang").withColumnRenamed("id", "doc_id").collect()}
    for i, t in enumerate(odd):
        assert brute_statistics(t) == tuple(got[i][c] for c in (*quality.STATS, "base_failed"))


def rank(values, share):
    return np.sort(values)[max(0, int(np.ceil(share * len(values))) - 1)]


def squared(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def brute_starts(x):
    floors = np.array(quality.FLOORS)
    q = np.array([[rank(x[:, i], p) for p in (0.25, 0.5, 0.75)] for i in range(x.shape[1])])
    middle, spread = q[:, 1], np.maximum((q[:, 2] - q[:, 0]) / 1.349, floors)
    z = (x - middle) / spread
    signs = z / np.sqrt(np.maximum((z**2).sum(1, keepdims=True), 1e-12))
    turned = signs.T @ signs / len(x)
    for shape in (np.eye(x.shape[1]), np.corrcoef(np.tanh(z).T), turned / np.sqrt(np.outer(np.diag(turned), np.diag(turned)))):
        shape = np.where(np.eye(x.shape[1], dtype=bool), 1.0, quality.SHRUNK * shape)
        yield middle, shape * np.outer(spread, spread)


def brute_core(x):
    """Least determinant that concentration reaches from the starts, each followed to its end."""
    d, best = x.shape[1], None
    floors = np.diag(np.array(quality.FLOORS) ** 2)
    share = next(s for s in quality.CORE_SHARES if s >= min(1.0, (len(x) + d + 1) / (2 * len(x))))
    for mean, cov in brute_starts(x):
        size = np.inf
        while True:
            d2 = squared(x, mean, cov)
            core = x[d2 <= rank(d2, share)]
            new = core.mean(0), np.cov(core.T, bias=True) + floors
            fresh = np.log(np.linalg.det(new[1]))
            if not size - fresh > quality.FALL:
                break
            size, (mean, cov) = fresh, new
        if best is None or size < best[0]:
            best = size, mean, cov
    return best


def brute_estimate(x):
    """Squared distances, scaled, after the estimate was taken again from what is no outlier."""
    floors = np.diag(np.array(quality.FLOORS) ** 2)
    _, mean, cov = brute_core(x)
    d2 = squared(x, mean, cov)
    inside = x[d2 / max(1.0, rank(d2, 0.5) / quality.CHI2_MEDIAN) <= quality.CHI2_EDGE]
    d2 = squared(x, inside.mean(0), np.cov(inside.T, bias=True) + floors)
    return d2 / max(1.0, rank(d2, 0.5) / quality.CHI2_MEDIAN)


def test_distances_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) @ np.diag([0.3, 0.2, 0.4, 0.5]) + rng.normal(size=(400, 1)) * 0.3
    x[:40] += 6
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g0 string, x0 double, x1 double, x2 double, x3 double")
    estimate = quality.minimum_covariance(df, ["g0"], 4)
    rows = quality._distances(df, estimate, ["g0"], 4).collect()
    scale = estimate.first().scale
    got = {round(r.x0, 9): r.d2 / scale for r in rows}
    expected = brute_estimate(x)
    assert [got[round(float(r[0]), 9)] for r in x] == pytest.approx(list(expected), rel=1e-6)
    assert expected[:40].min() > quality.CHI2_FAR
    assert (expected[40:] > quality.CHI2_FAR).mean() < 0.02


def test_nearly_half_of_a_group_may_be_junk(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(330, 4)) * 0.3, rng.normal(size=(270, 4)) * 0.2 + [3.0, 2.0, 2.5, -3.0]])
    rows = [("a", *map(float, r)) for r in x] + [("b", *map(float, r)) for r in x[:330]] + [("c", 1.0, 0.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "g0 string, x0 double, x1 double, x2 double, x3 double")
    estimate = quality.minimum_covariance(df, ["g0"], 4)
    assert estimate.count() == 3
    far = quality._keyed(quality._distances(df, estimate, ["g0"], 4), estimate.select("g0", "scale"), ["g0"])
    far = {(r.g0, round(r.x0, 9)): r.d2 / r.scale > quality.CHI2_FAR for r in far.collect()}
    assert all(far["a", round(float(v), 9)] for v in x[330:, 0])
    assert sum(far["a", round(float(v), 9)] for v in x[:330, 0]) <= 6
    assert not far["c", 1.0]


def test_outliers_go_and_clean_texts_stay(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    clean = [(i, " ".join(words[(i * 7 + k * k) % 12] + str(k) for k in range(30 + i % 9)), "en", "s") for i in range(80)]
    junk = [(100 + i, " ".join(f"w{k}### $$$ &{k}" for k in range(20)), "en", "s") for i in range(6)]
    df = spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id for r in quality.judge(df).collect() if r.kept}
    assert kept == set(range(80))


def test_awkward_and_empty(spark):
    rows = quality.judge(awkward(spark)).collect()
    assert len(rows) == 9
    assert all(r.base_failed and not r.kept and r.distance is None for r in rows if r.doc_id in (1, 2, 3, 7))
    assert all(r.kept for r in rows if not r.base_failed)
    assert quality.judge(empty(spark)).collect() == []
