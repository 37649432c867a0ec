import hashlib
import random
import zlib

import pytest
from corpus import SMALL
from pyspark.sql import functions as F

from ledgerspark.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, hi int, least string"


def brute(conversations):
    """Node rows of {id: [(role, text), ...]}, one set per prefix."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[b] for b in below) or 1
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        saved[path] = own + sum(saved[b] for b in below)
    rows = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(conversations[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        rows.append(
            (min(ids), len(path), parent, len(ids), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(rows, key=str)


def turns_of(rows):
    """{id: turns} of table rows, ordered by turn with NULL first."""
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def regrafted(conversations):
    out = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = conversations.get(c - c % 100, [])[:h] + own[h:]
    return out


def collected(nodes):
    return sorted(map(tuple, nodes.collect()), key=str)


def forest(seed, n=250):
    """Conversations that share beginnings, with copies, prefixes of others and very common first turns."""
    rng = random.Random(seed)
    made = [[("user", "hi")]]
    for _ in range(n):
        base = rng.choice(made + [made[0]] * len(made))
        turns = base[: rng.randint(0, len(base))] + [(rng.choice(["user", "assistant", ""]), rng.choice(["", "a", "bé", "long 😀"])) for _ in range(rng.choice([0, 0, 1, 2, 5]))]
        made.append(turns)
    return [(i, t, role, text, "x", 1, "y") for i, turns in enumerate(made) for t, (role, text) in enumerate(turns)]


@pytest.mark.parametrize("container", [1, 3, 10, 1000])
def test_nodes_match_brute_force(spark, container):
    rows = forest(container)
    sequences = prefix_trie.turn_sequences(spark.createDataFrame(rows, SCHEMA))
    assert collected(prefix_trie.prefix_trie(sequences, container)) == brute(turns_of(rows))
    nodes = prefix_trie.prefix_trie(prefix_trie.regrafted(sequences), container)
    assert collected(nodes) == brute(regrafted(turns_of(rows)))


def test_salted_heads(spark, monkeypatch):
    """Joins against more heads than may be broadcast give the same nodes."""
    monkeypatch.setattr(prefix_trie, "BROADCAST_HEADS", 0)
    rows = forest(7, 120)
    nodes = prefix_trie.prefix_trie(prefix_trie.turn_sequences(spark.createDataFrame(rows, SCHEMA)), 4)
    assert collected(nodes) == brute(turns_of(rows))


def test_copies_chunks_and_empty(spark):
    """A third of all rows in copies of one conversation, ids of several chunks, negative ids; nothing at all."""
    rows = [(c, t, "user", f"turn {t}", "", 0, "") for c in range(-1500, 1500) for t in range(2)]
    sequences = prefix_trie.turn_sequences(spark.createDataFrame(rows, SCHEMA))
    assert collected(prefix_trie.prefix_trie(sequences, 2)) == brute(turns_of(rows))
    nothing = prefix_trie.turn_sequences(spark.createDataFrame([], SCHEMA))
    assert prefix_trie.prefix_trie(prefix_trie.regrafted(nothing)).collect() == []


def test_awkward_rows(spark):
    """NULLs everywhere, ties, repeated rows, turnless conversations."""
    rows = [(None, 1, "user", "lost", "", 0, ""), (5, None, "a", None, "", 0, ""), (5, None, None, "x", "", 0, ""), (5, None, None, "x", "", 0, ""), (5, 2, "a", "b", "", 0, "")]
    rows += [(c, 0, "user", "only", "", 0, "") for c in (101, 102, 103)]  # regrafted to nothing where h > 0
    rows += [(200, t, "user", f"{t} " * 3, "", 0, "") for t in range(7)] + [(201, t, "user", f"{t} " * 3, "", 0, "") for t in range(6)]
    sequences = prefix_trie.turn_sequences(spark.createDataFrame(rows, SCHEMA))
    conversations = turns_of(rows)
    conversations[5] = [("", "x"), ("", "x"), ("a", ""), ("a", "b")]  # ties by role
    assert collected(prefix_trie.prefix_trie(sequences, 3)) == brute(conversations)
    got = collected(prefix_trie.prefix_trie(prefix_trie.regrafted(sequences), 1))
    assert got == brute(regrafted(conversations)) and any(r[1] == 0 and r[7] != prefix_trie.NOTHING for r in got)


def test_very_long_conversations(spark):
    """Thousands of turns, one the beginning of the other, in one container."""
    rows = [(c, t, "user", f"{t} " * 3, "", 0, "") for c, n in ((200, 3_000), (201, 2_500)) for t in range(n)]
    nodes = prefix_trie.prefix_trie(prefix_trie.turn_sequences(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(nodes) == 3_001 and {r.n_convs for r in nodes if r.depth <= 2_500} == {2}
    assert {r.n_convs for r in nodes if r.depth > 2_500} == {1} and sum(r.n_children == 0 for r in nodes) == 1
    assert max(r.saved_tokens for r in nodes) == sum(len(f"{t} " * 3) for t in range(2_500))


def test_long_text_counts_code_points(spark):
    rows = [(c, 0, "user", "😀é" * 200_000, "", 0, "") for c in (1, 2)]
    nodes = prefix_trie.prefix_trie(prefix_trie.turn_sequences(spark.createDataFrame(rows, SCHEMA)))
    assert {r.depth: r.saved_tokens for r in nodes.collect()} == {0: 400_000, 1: 400_000}


def test_small_containers_agree_on_the_table(spark):
    sequences = prefix_trie.turn_sequences(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    whole = collected(queries.op11_prefix_trie(spark, SMALL))
    assert collected(prefix_trie.prefix_trie(prefix_trie.regrafted(sequences), 2)) == whole


def test_heads_split_only_where_distinct(spark):
    """Copies alone never burst a container."""
    rows = spark.range(50).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"), F.lit("t").alias("text"))
    suffixes = prefix_trie.suffixes(prefix_trie.paths(prefix_trie.turn_sequences(rows)))
    containers, ends, heads = prefix_trie.burst(suffixes, 3)
    assert not heads and not ends and len(containers) == 1 and containers[0].first().n == 50
