"""How far the word frequencies of sources diverge, by hash-consed segment trees over term ids.

The terms of a language are dealt by hash to blocks of about ``block_terms``; within a block the most
frequent comes first, so counts of rare terms, mostly zero, stand together. The counts of one source
over a block are the leaves of a segment tree. Trees are built for all sources of a task level by
level: two nodes with equal children are one node, so equal subtrees are shared within and between
trees. Two trees are then walked together from their roots: each pair of nodes is met once per level,
with the number of times it occurs, and where both are all zero the walk stops. At the leaves every
pair of counts is priced once.

A price depends on both counts and both sources' sizes. What zero against zero costs is paid for the
whole vocabulary at once, so only differences from it are walked, and blocks without a source's terms
cost nothing. Sources are dealt to tiles of about ``tile_sources``; a task holds one block of terms
for two tiles, so its memory doesn't grow with the corpus, and a language or source that holds most
rows is spread over the blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import reachable, slices, written

MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
BLOCK_TERMS = 4096
TILE_SOURCES = 32
# distinct (group, term) pairs a task counts before it hands them on
COUNTERS = 400_000
# letters A-Z are lower-cased first; every byte of another alphabet is 0x80 or more
TERM = re.compile(rb"[a-z\x80-\xff]+")


def group_terms(df: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): counts of occurrences and documents; a key may have several rows."""

    def flushed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()),
                    pa.array([source] * size, pa.string()),
                    pa.array(list(n), pa.binary()).cast(pa.string()),
                    pa.array(list(n.values()), pa.int64()),
                    pa.array([docs[t] for t in n], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "df"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        fresh = 0
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part["text"].cast(pa.binary()).to_pylist()
                for lang, source, text in zip(part["lang"].to_pylist(), part["source"].to_pylist(), texts):
                    terms = TERM.findall(text.lower())
                    distinct = set(terms)
                    n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    before = len(n)
                    n.update(terms)
                    docs.update(distinct)
                    fresh += len(n) - before
                if fresh >= COUNTERS:
                    yield from flushed(held)
                    held, fresh = {}, 0
        yield from flushed(held)

    return reachable(df).mapInArrow(run, "lang string, source string, term string, n bigint, df bigint")


def kept_terms(df: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, n, groups): terms in enough documents of their language, with counts by source.

    One exchange of partial counts. A list holds as many entries as the language has sources.
    """
    counted = group_terms(df).repartition("lang", "term")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    gathered = counted.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("groups")
    )
    return gathered.filter(F.col("df") >= min_documents).drop("df")


def _unique(codes: np.ndarray, *parts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct codes' parts, with summed weights."""
    _, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    return *(p[first] for p in parts), np.bincount(inverse, weights=weight, minlength=len(first)).astype(np.int64)


def segment_trees(counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(values, levels, roots) of the hash-consed trees over the rows of ``counts``.

    Leaf node i holds ``values[i]``. ``levels`` go from the leaves up: row i of a level has the two
    children of node i. Node 0 of each level is all zero. The number of columns is a power of two.
    """
    values, nodes = np.unique(np.append(counts.ravel(), 0), return_inverse=True)
    nodes = nodes[:-1].reshape(counts.shape)
    levels, size = [], len(values)
    while nodes.shape[1] > 1:
        codes = np.append(nodes[:, 0::2].ravel() * size + nodes[:, 1::2].ravel(), 0)
        distinct, inverse = np.unique(codes, return_inverse=True)
        levels.append(np.stack(np.divmod(distinct, size), axis=1))
        nodes = inverse[:-1].reshape(nodes.shape[0], -1)
        size = len(distinct)
    return values, levels, nodes[:, 0]


def paired_counts(levels: list[np.ndarray], root: int, others: np.ndarray) -> tuple[np.ndarray, ...]:
    """(other, left leaf, right leaf, times): the leaves met by walking one tree with each other one.

    Equal node pairs are walked once; pairs of zeros are left out.
    """
    other = np.arange(len(others))
    left, right, times = np.full(len(others), root), others, np.ones(len(others), np.int64)
    met = (left != 0) | (right != 0)
    other, left, right, times = other[met], left[met], right[met], times[met]
    for children in reversed(levels):
        other, times = np.concatenate([other, other]), np.concatenate([times, times])
        left, right = children[left].T.ravel(), children[right].T.ravel()
        met = (left != 0) | (right != 0)
        other, left, right, times = other[met], left[met], right[met], times[met]
        base = max(left.max(initial=0), right.max(initial=0)) + 1
        other, left, right, times = _unique((other * base + left) * base + right, other, left, right, weight=times)
    return other, left, right, times


def frequencies(values: np.ndarray, size: int) -> np.ndarray:
    """Scaled, smoothed frequencies of counts in a group; Python numbers, so nothing overflows."""
    return np.array([1 + SCALE * (int(c) + 2) // size for c in values], np.int64)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _price_block(table: pa.Table) -> pa.Table:
    """Partial divergences of the sources of two tiles over one block of terms."""
    lang, block, i, j = (table[c][0].as_py() for c in ("lang", "block", "i", "j"))
    heads = table.filter(pc.is_null(table["term"]))
    sides: dict[int, list[tuple[str, int]]] = {}
    for tile, groups in zip(heads["tile"].to_pylist(), heads["groups"].to_pylist()):
        sides[tile] = sorted((g["source"], g["n"]) for g in groups)
    vocabulary = heads["n"][0].as_py()
    left, right = sides.get(i, []), sides.get(j, [])
    both = left if i == j else left + right
    rows = table.filter(pc.is_valid(table["term"])).sort_by([("n", "descending"), ("term", "ascending")])
    counts = np.zeros((len(both), 1 << max(rows.num_rows - 1, 0).bit_length()), np.int64)
    if rows.num_rows:
        lists = rows["groups"].combine_chunks()
        entries = lists.flatten()
        at = pc.index_in(entries.field("source"), pa.array([s for s, _ in both], pa.string())).to_numpy(zero_copy_only=False)
        position = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        counts[at.astype(np.int64), position] = entries.field("n").to_numpy(zero_copy_only=False)
    values, levels, roots = segment_trees(counts)
    # without terms there is nothing to price and sizes may be zero
    scaled = np.array([frequencies(values, n + 2 * vocabulary) if vocabulary else values + 1 for _, n in both]).reshape(len(both), -1)
    out: dict[str, list] = {"a": [], "b": [], "value": []}
    for a in range(len(left)):
        begin = a + 1 if i == j else len(left)
        zero = price(scaled[a, 0], scaled[begin:, 0])
        other, x, y, times = paired_counts(levels, int(roots[a]), roots[begin:])
        cost = (price(scaled[a, x], scaled[begin + other, y]) - zero[other]) * times
        total = np.zeros(len(zero), np.int64)
        np.add.at(total, other, cost)
        if block == 0:
            total += zero * vocabulary
        shown = np.arange(len(zero)) if block == 0 else np.nonzero(total)[0]
        out["a"] += [both[a][0]] * len(shown)
        out["b"] += [both[begin + k][0] for k in shown]
        out["value"] += total[shown].tolist()
    return pa.table(
        {"lang": pa.array([lang] * len(out["a"]), pa.string()), "a": pa.array(out["a"], pa.string()), "b": pa.array(out["b"], pa.string()), "value": pa.array(out["value"], pa.int64())}
    )


def _pairs_of_tiles(tile: Column, tiles: Column) -> Column:
    """The pairs (i <= j) of a tile with every tile of its language."""
    every = F.sequence(F.lit(0), (tiles - 1).cast("int"))
    return F.transform(every, lambda u: F.struct(F.least(tile, u).alias("i"), F.greatest(tile, u).alias("j")))


def pair_values(terms: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two sources a < b of a language's task order, summed over blocks."""
    tile = lambda source, tiles: F.pmod(F.xxhash64(source), tiles).cast("int")
    dealt = terms.join(langs.drop("n"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    held = F.array_distinct(F.transform("groups", lambda g: tile(g["source"], F.col("tiles"))))
    pairs = F.array_distinct(F.flatten(F.transform(held, lambda t: _pairs_of_tiles(t, F.col("tiles")))))
    dealt = dealt.withColumn("pair", F.explode(pairs))
    of_pair = F.filter("groups", lambda g: tile(g["source"], F.col("tiles")).isin(F.col("pair.i"), F.col("pair.j")))
    rows = dealt.select("lang", "block", "pair.i", "pair.j", "term", "n", of_pair.alias("groups"), F.lit(0).alias("tile"))
    heads = groups.join(langs.drop("n"), "lang").withColumn("tile", tile(F.col("source"), F.col("tiles")))
    heads = heads.groupBy("lang", "tile", "tiles", "blocks", "v").agg(F.collect_list(F.struct("source", "n")).alias("groups"))
    heads = heads.withColumn("pair", F.explode(_pairs_of_tiles(F.col("tile"), F.col("tiles")))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    )
    heads = heads.select("lang", "block", "pair.i", "pair.j", F.lit(None).cast("string").alias("term"), F.col("v").alias("n"), "groups", "tile")
    partial = rows.unionByName(heads).groupBy("lang", "block", "i", "j").applyInArrow(_price_block, "lang string, a string, b string, value bigint")
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _frequency(n: str, size: str) -> Column:
    """As ``frequencies``, of columns."""
    return F.expr(f"1 + CAST((CAST({n} AS DECIMAL(38,0)) + 2) * {SCALE} AS DECIMAL(38,0)) div CAST({size} AS DECIMAL(38,0))")


def audit(
    df: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    min_documents: int = MIN_DOCUMENTS,
    top_terms: int = TOP_TERMS,
    block_terms: int = BLOCK_TERMS,
    tile_sources: int = TILE_SOURCES,
) -> DataFrame:
    """(lang, source, part, item, value, rank): every two sources of a language, and each one's own terms.

    Part ``pair`` has the divergence from each other source of the language over all kept terms, part
    ``term`` the ``top_terms`` terms that a source uses more than its language, by their share of the
    divergence; ranks go by value, then by item. NULL language, source and text are empty strings;
    repeated rows count as often as they stand there; sources without terms are compared all the same;
    a language without kept terms has value 0 everywhere. Other columns are ignored, an empty table
    gives no rows.
    """
    named = lambda c, as_: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(as_)
    docs = df.select(named(lang, "lang"), named(source, "source"), named(text, "text"))
    terms = written(kept_terms(docs, min_documents))
    entries = terms.select("lang", "term", F.col("n").alias("all_n"), F.explode("groups").alias("g"))
    entries = entries.select("lang", "term", "all_n", "g.source", "g.n")
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    groups = written(groups)
    vocabularies = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile_sources).alias("tiles")).join(vocabularies, "lang", "left")
    langs = written(
        langs.select(
            "lang",
            "tiles",
            F.coalesce("v", F.lit(0)).alias("v"),
            F.coalesce("n", F.lit(0)).alias("n"),
            F.greatest(F.ceil(F.coalesce("v", F.lit(0)) / block_terms), F.lit(1)).alias("blocks"),
        )
    )
    pairs = pair_values(terms, groups, langs)
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = pairs.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    own = entries.join(groups.withColumnRenamed("n", "group_n"), ["lang", "source"]).join(langs.select("lang", "v", F.col("n").alias("lang_n")), "lang")
    own = own.withColumns({"p": _frequency("n", "group_n + 2 * v"), "q": _frequency("all_n", "lang_n + 2 * v")}).filter("p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda part: part.withColumn("rank", F.row_number().over(place))
    return ranked(pairs).unionByName(ranked(own).filter(F.col("rank") <= top_terms))
