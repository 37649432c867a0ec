"""Near duplicates by SimHash, linked by ball hashing that meets in the middle.

Two 64-bit fingerprints within three bits share a value that is one flip from the one and two from
the other. One half of the bits then differs in at most one place, so the flips split into a *key*
(the quiet half, as it is or with one bit flipped) and flips in the other half. Every distinct
fingerprint is sent to its keys, 50 rows on average in place of its 2,081 variants, and the flips of
the other half are made where equal keys meet. Fingerprints that meet in a variant all hang on the
smallest one, after their distance is verified; pairs within a group are never listed. Keys held by
very many fingerprints are spread over the cluster by the whole variant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import map_texts, reachable, written
from ledgerspark.llm.components import components

RADIUS = 3
SHINGLE, SEED = 3, 42
HASHES_AT_ONCE = 1 << 16
PAIRWISE = 96
HOT_KEY = 50_000
VARIANTS_AT_ONCE = 4_000

ONE = np.uint64(1)
FLIPS1 = np.left_shift(ONE, np.arange(32, dtype=np.uint64))
FLIPS2 = np.array([a | b for i, a in enumerate(FLIPS1) for b in FLIPS1[i + 1 :]], dtype=np.uint64)
LOW = np.uint64(0xFFFFFFFF)
SHIFT = np.uint64(32)


def fingerprint(text: str | None, words_each: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles, repeats included; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    run = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(words_each, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(run[s:e], seed) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())],
        np.uint64,
        len(words) - k + 1,
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[i : i + HASHES_AT_ONCE].astype("<u8", copy=False)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    majority = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_each: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """(id, text_hash, fp) of every row; fp holds the 64 bits as a signed number."""

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([fingerprint(t, words_each, seed) for t in batch["text"].to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch["id"], batch["text_hash"], pa.array(bits.view(np.int64))], names=["id", "text_hash", "fp"]
        )

    source = df.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    kind = source.schema["id"].dataType.simpleString()
    return map_texts(source, "text", body, f"id {kind}, text_hash bigint, fp bigint")


def keyed(distinct: DataFrame) -> DataFrame:
    """(half, key, fp): the keys under which a fingerprint may meet one within three bits.

    ``distinct`` has fp and may have ``space``; fingerprints of different spaces never meet. The half
    that is quiet and the space share a number: twice the space, plus 0 for the high half and 1 for
    the low one.

    A key with one bit flipped is needed from either side if the other half differs in one bit too,
    and from fingerprints of even weight only if it differs in two, which changes the weight's parity.
    """

    def rows(fp: np.ndarray, half: np.ndarray, key: np.ndarray, flipped: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        near = (key[flipped][:, None] ^ FLIPS1).ravel()
        each = lambda x: np.repeat(x[flipped], len(FLIPS1))
        return [(half, key, fp), (each(half), near, each(fp))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            twice = 2 * batch["space"].to_numpy(zero_copy_only=False).astype(np.int32)
            even, all_ = np.bitwise_count(fp) % 2 == 0, np.ones(len(fp), bool)
            for half, key, who in rows(fp, twice, fp >> SHIFT, all_) + rows(fp, twice + 1, fp & LOW, even):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(half.astype(np.int32)),
                        pa.array(key.astype(np.int64)),
                        pa.array(who.view(np.int64)),
                    ],
                    names=["half", "key", "fp"],
                )

    return reachable(distinct.select("space", "fp")).mapInArrow(run, "half int, key bigint, fp bigint")


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points over the given links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def link_group(half: int, key: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints of one key within three bits of each other."""
    fp = np.unique(fp)
    if len(fp) <= PAIRWISE:
        left, right = np.nonzero(np.bitwise_count(fp[:, None] ^ fp) <= RADIUS)
    else:
        left, right = _meet(half, key, fp)
    root = _roots(len(fp), left, right)
    moved = np.nonzero(root != np.arange(len(fp)))[0]
    return fp[moved], fp[root[moved]]


def _meet(half: int, key: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of links found by meeting in a variant of the other half."""
    own = (fp >> SHIFT if half == 0 else fp & LOW) == np.uint64(key)
    rest = fp & LOW if half == 0 else fp >> SHIFT
    home = np.nonzero(own)[0]
    # within one flip, the flipped key included
    spot = np.concatenate([rest, (rest[home][:, None] ^ FLIPS1).ravel()])
    who = np.concatenate([np.arange(len(fp)), np.repeat(home, len(FLIPS1))])
    order = np.lexsort((who, spot))
    spot, who = spot[order], who[order]
    first = np.concatenate([[True], spot[1:] != spot[:-1]])
    centre = who[first][np.cumsum(first) - 1]
    lefts, rights = [who], [centre]
    spots, centres = spot[first], who[first]
    for i in range(0, len(home), VARIANTS_AT_ONCE):
        part = home[i : i + VARIANTS_AT_ONCE]
        variants = (rest[part][:, None] ^ FLIPS2).ravel()
        at = np.minimum(np.searchsorted(spots, variants), len(spots) - 1)
        hit = spots[at] == variants
        lefts.append(np.repeat(part, len(FLIPS2))[hit])
        rights.append(centres[at[hit]])
    left, right = np.concatenate(lefts), np.concatenate(rights)
    sure = np.bitwise_count(fp[left] ^ fp[right]) <= RADIUS
    return left[sure], right[sure]


def _links_of_keys(rows: DataFrame) -> DataFrame:
    """Links among rows that are sorted by key within their partition; one key is held at a time."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            half = batch["half"].to_numpy(zero_copy_only=False).astype(np.uint64)
            key = batch["key"].to_numpy(zero_copy_only=False).astype(np.uint64)
            table = np.stack([half << SHIFT | key, batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)])
            kept.append(table)
            last = table[0, -1]
            if kept[0][0, 0] == last:
                continue
            table = np.concatenate(kept, axis=1)
            done = int(np.searchsorted(table[0], last))
            kept = [table[:, done:]]
            yield links(table[:, :done])
        if kept:
            yield links(np.concatenate(kept, axis=1))

    def links(table: np.ndarray) -> pa.RecordBatch:
        keys, fps = table
        begins = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        ends = np.append(begins[1:], len(keys))
        found = [(np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for b, e in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist()):
            half = int(keys[b] >> SHIFT)
            left, right = link_group(half % 2, int(keys[b] & LOW), fps[b:e])
            found.append((np.full(len(left), half // 2, np.int32), left, right))
        space, a, b = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays(
            [pa.array(space), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["space", "a", "b"]
        )

    return rows.mapInArrow(stream, "space int, a bigint, b bigint")


def _links_of_hot_keys(rows: DataFrame) -> DataFrame:
    """The same links with every variant as a row: only minima are kept per variant."""
    high = F.col("half") % 2 == 0
    quiet = F.when(high, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    rest = F.when(high, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    flips1 = F.array(*[F.lit(int(m)) for m in FLIPS1])
    flips2 = F.array(*[F.lit(int(m)) for m in FLIPS2])
    near = F.concat(F.array(F.lit(0).cast("bigint")), F.when(quiet == F.col("key"), flips1).otherwise(F.array().cast("array<bigint>")))
    spread = lambda flips: rows.select(
        "half", "key", "fp", F.explode(flips).alias("flip")
    ).select("half", "key", rest.bitwiseXOR(F.col("flip")).alias("spot"), "fp")
    close = spread(near)
    centres = written(close.groupBy("half", "key", "spot").agg(F.min("fp").alias("b")))
    far = rows.filter(quiet == F.col("key")).select("half", "key", "fp", F.explode(flips2).alias("flip")).select(
        "half", "key", rest.bitwiseXOR(F.col("flip")).alias("spot"), "fp"
    )
    met = close.unionByName(far).join(centres, ["half", "key", "spot"]).select(
        F.floor(F.col("half") / 2).cast("int").alias("space"), F.col("fp").alias("a"), "b"
    )
    return met.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).distinct()


def link(distinct: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """(space, a, b): links that connect every two distinct fingerprints of a space within three bits."""
    if "space" not in distinct.columns:
        distinct = distinct.withColumn("space", F.lit(0))
    rows = keyed(distinct)
    twice = F.col("space") * 2
    halves = F.array(
        F.struct(twice.alias("half"), F.shiftrightunsigned("fp", 32).alias("key")),
        F.struct((twice + 1).alias("half"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("key")),
    )
    counts = distinct.select(F.explode(halves).alias("h")).groupBy("h.half", "h.key").count()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(int(m)) for m in FLIPS1])
    hot = written(
        counts.filter(F.col("count") > hot_key)
        .select("half", F.explode(F.transform(flips, lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
        .distinct()
    )
    some = not hot.isEmpty()
    cool = rows.join(hot, ["half", "key"], "left_anti") if some else rows
    links = _links_of_keys(cool.repartition("half", "key").sortWithinPartitions("half", "key"))
    if some:
        links = links.unionByName(_links_of_hot_keys(written(rows.join(hot, ["half", "key"], "left_semi"))))
    return links


def cluster(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_each: int = SHINGLE, seed: int = SEED,
    hot_key: int = HOT_KEY,
) -> DataFrame:
    """(id, text_hash, fp, root, component): the smallest id that links reach from each row.

    ``root``, the smallest linked fingerprint, names the group even where all its ids are NULL. One row
    per row of ``df``; repeated rows share a component. NULL and empty texts have fingerprint
    zero and link like any other. A NULL id never names a component unless all its ids are NULL.
    """
    rows = written(fingerprints(df, id_column, text_column, words_each, seed))
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(link(distinct, hot_key))
    rooted = distinct.join(roots.withColumnRenamed("a", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("b", "fp").alias("root")
    )
    rooted = written(rooted)
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component")))
    named = written(rooted.join(named, "root").select("fp", "root", "component"))
    return rows.join(named, "fp")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: int) -> DataFrame:
    """(id, fingerprint, component_id) of every row; see ``cluster`` for NULLs, ties and repeats."""
    return cluster(df, id_column, text_column, **options).select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def deduplicate(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: int) -> DataFrame:
    """``df`` with one row of each group of linked fingerprints, that of the smallest id.

    All columns stay. Repeated rows become one; texts without words, NULL included, share fingerprint
    zero and so one group; of equal ids the smaller text hash stays, NULL ids come last. An empty
    table gives an empty result.
    """
    rows = written(cluster(df, id_column, text_column, **options).select("id", "text_hash", "root"))
    # NULL ids come last: a named document is kept before one without an id
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "text_hash")
    first = rows.groupBy("root").agg(F.min(place).alias("first")).select("root", "first.id", "first.text_hash")
    first = written(first.select("root", F.col("id").alias("first_id"), F.col("text_hash").alias("first_hash")))
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    decided = written(
        rows.groupBy("root", "id", "text_hash").agg(F.count("*").alias("n")).join(first, "root").select("id", "text_hash", "n", stays.alias("stays"))
    )
    hashed = F.xxhash64(F.col(f"`{text_column}`"))

    def keyed(keys: DataFrame, how: str, of: DataFrame) -> DataFrame:
        named = keys.select(F.col("id").alias("key_id"), F.col("text_hash").alias("key_hash"))
        return of.join(named, F.col(f"`{id_column}`").eqNullSafe(F.col("key_id")) & (hashed == F.col("key_hash")), how)

    # rows that go and keys that repeat are the fewer: the rest is only probed
    rest = keyed(written(decided.filter("NOT stays")), "left_anti", df)
    repeated = written(decided.filter("stays AND n > 1"))
    if repeated.isEmpty():
        return rest
    once = keyed(repeated, "left_semi", rest).withColumn("__text", hashed).dropDuplicates([id_column, "__text"]).drop("__text")
    return keyed(repeated, "left_anti", rest).unionByName(once)
