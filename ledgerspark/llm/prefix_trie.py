"""The trie of conversation prefixes, built as a burst trie.

Every turn becomes a 128-bit id, every prefix of a conversation the exclusive or of its turns' ids
mixed with their positions, so a prefix's id needs no other row. Conversations that are equal as a
whole become one *suffix* with a count, so copies never make a container large.

All suffixes start in the container of the root. A container of more than ``container`` suffixes
bursts: its prefix becomes a trie *head*, and its suffixes go to containers by their next turn id.
Rounds go on among the suffixes of oversized containers only. Heads stand for more than ``container``
suffixes each, so there are few; joins against them are broadcast up to a checked number and salted
beyond. The containers left are hashed over the cluster, sorted and swept into nodes with a stack,
keeping only the open path and the closed children of its nodes. The tops of containers are then
summed into the heads, from the deepest to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ledgerspark.llm.common import reachable, written

CONTAINER = 1024
# heads sent whole to every executor, some 50 bytes each; beyond, joins against them are salted
BROADCAST_HEADS = 100_000
SALTS = 32
IDS_AT_ONCE = 1000
ROWS_AT_ONCE = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
TOP = "hi bigint, lo bigint, p_hi bigint, p_lo bigint"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def turn_sequences(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, turns): the (hi, lo, chars) of each conversation's turns, in order of turn, NULL first.

    NULL roles and texts are empty. Equal turns go by role, then by hash of the text. Rows without a
    conversation belong to none and are left out. Only numbers are shuffled; a conversation is one row.
    """
    said = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text)]
    place = F.struct(
        F.col(f"`{turn}`").isNotNull().alias("numbered"),
        F.col(f"`{turn}`").alias("turn"),
        said[0].alias("role"),
        F.xxhash64(*said).alias("hi"),
        F.xxhash64(F.lit(1), *said).alias("lo"),
        F.length(said[1]).alias("chars"),
    )
    rows = df.filter(F.col(f"`{conversation}`").isNotNull())
    grouped = rows.select(F.col(f"`{conversation}`").cast("bigint").alias("conv_id"), place.alias("t")).groupBy("conv_id")
    ordered = grouped.agg(F.array_sort(F.collect_list("t")).alias("t"))
    parts = F.transform("t", lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"), t["chars"].alias("chars")))
    return ordered.select("conv_id", parts.alias("turns"))


def regrafted(sequences: DataFrame, span: int = 100, longest: int = 6) -> DataFrame:
    """Conversations whose first turns come from the one that heads their block of ``span`` ids.

    The first h turns, h = crc32(decimal id) mod ``longest``, are those of conversation id - id % span
    (all it has, none if there is none); the conversation's own turns after its first h follow.
    """
    heads = sequences.filter(F.col("conv_id") % span == 0).select(
        F.col("conv_id").alias("head"), F.slice("turns", 1, longest - 1).alias("head_turns")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    joined = sequences.withColumns({"head": F.col("conv_id") - F.col("conv_id") % span, "h": h}).join(heads, "head", "left")
    given = F.coalesce(F.slice("head_turns", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(given, own).alias("turns"))


def _mixed(ids: np.ndarray, places: np.ndarray, odd: int) -> np.ndarray:
    """A 64-bit mix of an id with its place (multiplications and shifts, wrapping around)."""
    x = ids ^ (places.astype(np.uint64) + np.uint64(1)) * np.uint64(odd)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def paths(sequences: DataFrame) -> DataFrame:
    """(conv_id, path, chars): the (hi, lo) ids of every prefix from the first turn on, and lengths."""
    schema = "conv_id bigint, path array<struct<hi: bigint, lo: bigint>>, chars array<int>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["turns"]
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            begins = np.cumsum(sizes) - sizes
            places = np.arange(len(flat)) - np.repeat(begins, sizes)
            ids = []
            for field, odd in (("hi", 0x9E3779B97F4A7C15), ("lo", 0xD1342543DE82EF95)):
                mixed = _mixed(flat.field(field).to_numpy(zero_copy_only=False).view(np.uint64), places, odd)
                running = np.append(np.uint64(0), np.bitwise_xor.accumulate(mixed))
                ids.append((running[1:] ^ np.repeat(running[begins], sizes)).view(np.int64))
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            path = pa.StructArray.from_arrays([pa.array(i) for i in ids], names=["hi", "lo"])
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], pa.ListArray.from_arrays(offsets, path), pa.ListArray.from_arrays(offsets, flat.field("chars"))],
                schema=arrow,
            )

    return reachable(sequences).mapInArrow(run, schema)


def id_digests(keyed: DataFrame) -> DataFrame:
    """(hi, lo, n, least, digest) of (hi, lo, conv_id): the ids' count, minimum and joint hash.

    Ids are range-partitioned with their key, so a key with very many is spread; what meets in one task
    are strings of up to a thousand joined ids, hashed as they stream by.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            hi, lo, ids = (batch[c].to_numpy(zero_copy_only=False) for c in ("hi", "lo", "conv_id"))
            new = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))
            begins = np.nonzero(new)[0]
            # runs are cut at a thousand ids
            cuts = np.concatenate([np.arange(b, e, IDS_AT_ONCE) for b, e in zip(begins, np.append(begins[1:], len(ids)))])
            ends = np.append(cuts[1:], len(ids))
            words = list(map(str, ids.tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hi[cuts]), pa.array(lo[cuts]), pa.array(ids[cuts]), pa.array(ends - cuts), pa.array([",".join(words[b:e]) for b, e in zip(cuts.tolist(), ends.tolist())], pa.string())],
                names=["hi", "lo", "least", "n", "ids"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state, n, least = None, None, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for hi, lo, first, count, ids in zip(*(batch[c].to_pylist() for c in ("hi", "lo", "least", "n", "ids"))):
                if (hi, lo) != open_key:
                    if open_key:
                        out.append((*open_key, n, least, state.hexdigest()))
                    open_key, state, n, least = (hi, lo), hashlib.sha256(), 0, first
                else:
                    state.update(b",")
                state.update(ids.encode())
                n += count
            yield table(out)
        if open_key:
            yield table([(*open_key, n, least, state.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)

    schema = "hi bigint, lo bigint, n bigint, least bigint, digest string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    ranged = reachable(keyed).repartitionByRange("hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id")
    joined = ranged.select("hi", "lo", "conv_id").mapInArrow(join, "hi bigint, lo bigint, least bigint, n bigint, ids string")
    return joined.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "least").mapInArrow(digest, schema)


def suffixes(walked: DataFrame) -> DataFrame:
    """(path, chars, n, least, digest): one row per distinct conversation, with its members."""
    last = F.when(F.size("path") > 0, F.element_at("path", -1))
    keyed = walked.select(F.coalesce(last["hi"], F.lit(0)).alias("hi"), F.coalesce(last["lo"], F.lit(0)).alias("lo"), "conv_id")
    members = written(id_digests(keyed))
    return walked.join(members.select("n", "least", "digest"), F.col("conv_id") == F.col("least")).drop("conv_id")


def _with_heads(rows: DataFrame, heads: DataFrame, hi: str, lo: str, how: str, count: int) -> DataFrame:
    """Join rows with heads on their key; a key with very many rows isn't one task's work."""
    heads = heads.withColumnsRenamed({"hi": hi, "lo": lo})
    if count <= BROADCAST_HEADS:
        return rows.join(F.broadcast(heads), [hi, lo], how)
    salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("least"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [hi, lo, "salt"], how).drop("salt")


def _at(depth: int, field: str) -> Column:
    """Field of a path's prefix id at a depth; the root's is zero."""
    return F.element_at("path", depth)[field] if depth else F.lit(0).cast("bigint")


def burst(rows: DataFrame, container: int) -> tuple[list[DataFrame], list[DataFrame], list[tuple[DataFrame, int]]]:
    """(containers, ends, heads) by rounds: suffixes with their container, those that end at a head, heads."""
    containers, ends, heads = [], [], []
    active, depth = rows, 0
    while True:
        at = active.withColumns({"hi": _at(depth, "hi"), "lo": _at(depth, "lo")})
        parent = [_at(max(depth - 1, 0), f) for f in ("hi", "lo")]
        chars = F.element_at("chars", depth) if depth else F.lit(0)
        large = at.groupBy("hi", "lo").agg(
            F.count("*").alias("size"), F.max(chars).alias("own"), F.max(parent[0]).alias("p_hi"), F.max(parent[1]).alias("p_lo")
        )
        large = written(large.filter(F.col("size") > container).drop("size"))
        count = large.count()
        placed = at.withColumns({"own": chars, "p_hi": parent[0], "p_lo": parent[1], "depth": F.lit(depth)})
        if not count:
            return [*containers, placed], ends, heads
        marks = large.select("hi", "lo", F.lit(True).alias("large"))
        step = written(_with_heads(placed, marks, "hi", "lo", "left", count))
        containers.append(step.filter("large IS NULL").drop("large"))
        over = step.filter("large")
        ends.append(over.filter(F.size("path") == depth).select("hi", "lo", "n", "least", "digest"))
        heads.append((large, count))
        active = over.filter(F.size("path") > depth).drop("hi", "lo", "own", "p_hi", "p_lo", "depth", "large")
        depth += 1


class _Node:
    """An open node of the sweep."""

    __slots__ = ("chars", "children", "digest", "least", "n", "n_children", "n_leaves", "saved")

    def __init__(self, chars: int):
        self.chars, self.least, self.n, self.n_children, self.n_leaves, self.saved = chars, None, 0, 0, 0, 0
        self.digest, self.children = NOTHING, []

    def add(self, least: int, n: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


def sweep(rows: DataFrame) -> DataFrame:
    """Nodes of containers: those below the tops with their parents, the tops with their keys.

    ``rows`` has (hi, lo, p_hi, p_lo, depth, own, path, chars, n, least, digest), the container's key,
    its parent's key, depth and last length, and the suffix's prefix ids and lengths below the top.
    """
    schema = f"{NODE}, {TOP}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        here, stack, before = None, [], []

        def close(depth: int) -> None:
            """Close the last node of the stack, which is ``depth`` turns deep."""
            node = stack.pop()
            node.saved += (node.n - 1) * node.chars
            node.n_leaves = node.n_leaves or 1
            for child in node.children:
                out.append((child[0], depth + 1, node.least, *child[1:], None, None, None, None))
            row = (node.least, node.n, node.n_children, node.n_leaves, node.saved, node.digest)
            if stack:
                parent = stack[-1]
                parent.add(node.least, node.n)
                parent.n_children += 1
                parent.n_leaves += node.n_leaves
                parent.saved += node.saved
                parent.children.append(row)
            else:
                out.append((row[0], depth, None, *row[1:], *here[:4]))

        def close_to(kept: int) -> None:
            while len(stack) > kept:
                close(here[4] + len(stack) - 1)

        for batch in batches:
            tops = zip(*(batch[c].to_pylist() for c in ("hi", "lo", "p_hi", "p_lo", "depth", "own")))
            paths_, lengths = batch["path"], batch["chars"].to_pylist()
            flat = paths_.flatten()
            pairs = list(zip(flat.field("hi").to_pylist(), flat.field("lo").to_pylist()))
            offsets = (paths_.offsets.to_numpy() - paths_.offsets[0].as_py()).tolist()
            members = zip(*(batch[c].to_pylist() for c in ("n", "least", "digest")))
            for at, (top, (n, least, digest)) in enumerate(zip(tops, members)):
                path = pairs[offsets[at] : offsets[at + 1]]
                if top != here:
                    close_to(0)
                    here, before = top, []
                    stack.append(_Node(top[5]))
                shared = 0
                for x, y in zip(path, before):
                    if x != y:
                        break
                    shared += 1
                close_to(shared + 1)
                stack.extend(map(_Node, lengths[at][shared:]))
                stack[-1].add(least, n)
                stack[-1].digest = digest
                before = path
                if len(out) >= ROWS_AT_ONCE:
                    yield table(out)
                    out.clear()
        close_to(0)
        yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

    below = lambda c: F.slice(c, F.col("depth") + 1, F.greatest(F.size(c) - F.col("depth"), F.lit(0)))
    rows = rows.select("hi", "lo", "p_hi", "p_lo", "depth", "own", below("path").alias("path"), below("chars").alias("chars"), "n", "least", "digest")
    return reachable(rows).repartition("hi", "lo").sortWithinPartitions("hi", "lo", "path").mapInArrow(run, schema)


def prefix_trie(sequences: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row per node of the trie of (conv_id, turns), as ``turn_sequences`` gives them.

    conv_id is the node's smallest member, parent_conv_id its parent's (NULL at the root); n_convs,
    n_children, n_leaves (childless nodes of its subtree, itself included), saved_tokens (over its
    subtree, the length of each node's last text for every member but one), and ends_sha256 of the
    members that end there. Conversations without turns end at the root; without any conversation
    there is no node.
    """
    rows = written(suffixes(written(paths(sequences))))
    containers, ends, heads = burst(rows, container)
    swept = written(reduce(DataFrame.unionByName, [sweep(c) for c in containers]))
    if not heads:
        return swept.select(*COLUMNS)
    tops = swept.filter("hi IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    stats: list[DataFrame] = []
    for depth in reversed(range(len(heads))):
        head = heads[depth][0]
        children = tops.filter(F.col("depth") == depth + 1)
        if stats:
            children = children.unionByName(stats[-1])
        given = children.select(
            F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo"), "conv_id", "n_convs", F.lit(1).alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256")
        )
        ended = ends[depth].select(
            "hi", "lo", F.col("least").alias("conv_id"), F.col("n").alias("n_convs"), F.lit(0).alias("n_children"), F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.col("digest").alias("ends_sha256")
        )
        summed = given.unionByName(ended).groupBy("hi", "lo").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
        node = head.join(summed, ["hi", "lo"]).select(
            "conv_id",
            F.lit(depth).cast("bigint").alias("depth"),
            F.lit(None).cast("bigint").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("own")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
            "hi", "lo", "p_hi", "p_lo",
        )
        stats.append(written(node))
    above = reduce(DataFrame.unionByName, stats)
    parents = above.select("hi", "lo", F.col("depth").alias("p_depth"), F.col("conv_id").alias("p_conv"))
    # a top's parent is a head one turn up; tops and heads alike look it up by key
    inner = tops.unionByName(above).filter("depth > 0").withColumn("least", F.col("conv_id"))
    named = _with_heads(inner, parents.drop("p_depth"), "p_hi", "p_lo", "inner", sum(n for _, n in heads))
    named = named.withColumn("parent_conv_id", F.col("p_conv"))
    root = above.filter("depth = 0")
    return reduce(DataFrame.unionByName, [part.select(*COLUMNS) for part in (swept.filter("hi IS NULL"), named, root)])
