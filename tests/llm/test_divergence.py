import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
import regex
from corpus import AWKWARD, awkward, empty

from ledgerspark.llm import divergence

SCHEMA = "text string, lang string, source string, term string, n int, block string, value double"


def brute(rows, min_documents=10, top=10):
    """The audit of (text, lang, source) rows by plain loops over every term."""
    docs = [tuple(x or "" for x in r) for r in rows]
    counts, df = {}, Counter()
    for text, lang, source in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts.setdefault((lang, source), Counter()).update(terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang in {lang for lang, _ in counts}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= min_documents]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        p = {}
        for s, c in [*groups.items(), (None, sum(groups.values(), Counter()))]:
            size = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if groups[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def collected(df):
    return sorted(map(tuple, df.collect()))


def corpus(seed, sources=7):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a, b in product("abcdeéßя", "xyzuv😀")]
    rows = []
    for _ in range(260):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice([None, *(f"s{i}" for i in range(sources))])
        text = " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice([text, text.upper(), text.replace(" ", "1")]), lang, source, "t", 1, "b", 0.5))
    return rows + [(None, "en", "silent", "t", 1, "b", 0.5), ("ÀB cd ÀB", "lone", "x", "t", 1, "b", 0.5), ("q", "lone", "y", "t", 1, "b", 0.5)] + rows[:40]


@pytest.mark.parametrize("block_terms, tile_sources, min_documents", [(4096, 32, 10), (4, 2, 3), (1, 3, 10), (16, 1, 1)])
def test_audit_matches_brute_force(spark, block_terms, tile_sources, min_documents):
    rows = corpus(block_terms)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), block_terms=block_terms, tile_sources=tile_sources, min_documents=min_documents)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert collected(got) == brute([r[:3] for r in rows], min_documents)


def test_awkward_and_empty(spark):
    rows = [(t, lang, source) for _, t, lang, source, *_ in AWKWARD]
    assert collected(divergence.audit(awkward(spark), min_documents=1)) == brute(rows, 1)
    # no term is in ten documents, sources are compared all the same
    assert {r.value for r in divergence.audit(awkward(spark)).collect()} == {0}
    assert divergence.audit(empty(spark)).collect() == []


def test_equal_subtrees_share_nodes():
    counts = np.zeros((3, 1024), np.int64)
    counts[0, :4] = counts[1, :4] = (5, 1, 5, 1)
    counts[2, 512:516] = (5, 1, 5, 1)
    values, levels, roots = divergence.segment_trees(counts)
    assert values.tolist() == [0, 1, 5] and roots[0] == roots[1] != roots[2]
    # each level has the zero node and one other, until left and right halves differ
    assert [len(level) for level in levels] == [2] * 9 + [3]
    other, left, right, times = divergence.paired_counts(levels, int(roots[0]), roots[1:])
    met = {(int(o), int(values[x]), int(values[y])): int(t) for o, x, y, t in zip(other, left, right, times)}
    assert met == {(0, 5, 5): 2, (0, 1, 1): 2, (1, 5, 0): 2, (1, 1, 0): 2, (1, 0, 5): 2, (1, 0, 1): 2}


def test_walk_meets_every_pair_of_counts():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 3, (6, 64)) * rng.integers(0, 2, (6, 64))
    values, levels, roots = divergence.segment_trees(counts)
    for a in range(6):
        other, left, right, times = divergence.paired_counts(levels, int(roots[a]), roots)
        got = {(int(o), int(values[x]), int(values[y])): int(t) for o, x, y, t in zip(other, left, right, times)}
        want = Counter((b, int(x), int(y)) for b in range(6) for x, y in zip(counts[a], counts[b]) if x or y)
        assert got == want


def test_frequencies_of_huge_counts_are_exact():
    count, size = 7 * 10**15 + 3, 9 * 10**16 + 11
    assert divergence.frequencies(np.array([count]), size).tolist() == [1 + 10**9 * (count + 2) // size]
