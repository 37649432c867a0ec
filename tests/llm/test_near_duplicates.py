import random
import re

import numpy as np
import pytest
import xxhash
from corpus import awkward, documents, empty

from ledgerspark.llm import simhash
from ledgerspark.llm.components import components


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fingerprints):
    """{id: smallest id reachable} for {id: fingerprint}."""
    ids = sorted(fingerprints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (fingerprints[i] ^ fingerprints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_documents_match_brute_force(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    expected = brute_components(prints)
    for r in simhash.near_duplicates(documents(spark)).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == expected[r.doc_id]


def flipped(rng, base, most):
    for bit in rng.sample(range(64), rng.randint(0, most)):
        base ^= 1 << bit
    return base


@pytest.mark.parametrize("hot_key", [50_000, 3])
def test_links_find_every_near_pair(spark, hot_key):
    """Clusters around a few centres, by the way for ordinary keys and by the one for hot keys."""
    rng = random.Random(hot_key)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {i: flipped(rng, rng.choice(centres), 4) for i in range(300)} | {300 + i: rng.getrandbits(64) for i in range(50)}
    expected = brute_components(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in set(prints.values())], "fp bigint")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.link(df, hot_key).collect()]
    least = {}
    for i, p in prints.items():
        least[p] = min(i, least.get(p, i))
    got = {least[p]: least[p] for p in least}

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for a, b in links:
        x, y = find(least[a]), find(least[b])
        got[max(x, y)] = min(x, y)
    assert all(find(least[prints[i]]) == expected[i] for i in prints)


def test_large_key_meets_in_variants():
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fp = np.unique(np.array([flipped(rng, base, 5) ^ (rng.getrandbits(3) << 20) for _ in range(400)], dtype=np.uint64))
    key = base >> 32
    own = fp[(fp >> np.uint64(32)) == key]
    near = fp[np.bitwise_count((fp >> np.uint64(32)) ^ np.uint64(key)) <= 1]
    left, right = simhash._meet(0, key, near)
    root = simhash._roots(len(near), left, right)
    a, b = np.nonzero(np.bitwise_count(near[:, None] ^ near) <= 3)
    at_home = np.isin(near[a], own) | np.isin(near[b], own)
    assert len(own) > 50 and (root[a[at_home]] == root[b[at_home]]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (101, 100)]
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 160)}


def test_awkward_and_empty(spark):
    rows = simhash.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 9
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (4, 5)} == {(f"{brute_fingerprint(awkward(spark).filter('doc_id = 5').first().text):016x}", 4)}
    assert simhash.near_duplicates(empty(spark)).collect() == []
    kept = simhash.deduplicate(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "7", "None"]
    assert simhash.deduplicate(empty(spark)).collect() == []


def test_one_document_of_each_group_stays(spark):
    """The kept ids are the smallest of the groups that brute force finds; all columns stay."""
    docs = documents(spark)
    expected = set(brute_components({r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}).values())
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)


def test_rows_without_an_id(spark):
    """A named row is kept before one without an id; groups without any id keep one row each."""
    rows = [(None, "a b c d e f g", 1), (7, "a b c d e f g", 2), (7, "a b c d e f g", 3), (None, "x y z", 4), (None, "x y z", 5), (None, "q r s t", 6)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string, root int")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("7", "a b c d e f g"), ("None", "q r s t"), ("None", "x y z")]
