"""Non-negative matrix factorisation of TF-IDF weights.

Both factors stay distributed: k numbers per document and per term, packed by block of documents and by
part of the vocabulary. Only k×k products of a factor with itself reach the driver. Each sweep updates
every factor by exact coordinate descent, which needs just ``X·Hᵀ`` with ``H·Hᵀ``, and ``Xᵀ·W`` with ``Wᵀ·W``.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.tfidf import evenly, spark_hashes
from ledgerspark.session import checkpoint_dir
from ledgerspark.sources.tables import read_note, remove_folder, scratch_folder, write_note

# The rows of a term factor up to this size are sent whole to the executors to be packed; more meet their places by shuffle.
BROADCAST_BYTES = 256 * 1024 * 1024
# Weights of one block, some 100 bytes each while a task packs them and 30 while it multiplies.
BLOCK_WEIGHTS = 2_000_000
# Documents whose factor one task holds while it multiplies, some 16 bytes per column each.
RANGE_DOCS = 500_000
# With this setting, Spark removes the exchanged rows of a query when it ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Steps of coordinate descent per reading of the weights.
PASSES = 8
# Rows of a factor that are descended at a time, so that they stay in a processor's cache.
DESCENT_ROWS = 8_192
# Extra columns carried while the leading vectors are sought.
OVERSAMPLING = 6
# A factor as it travels: a row per unit (a block of documents, or a part of the vocabulary) with its numbers
# by column, their products with each other, how far the unit was from optimal, and its share of ``<X, W·H>``.
PACKED = "unit long, numbers binary, gram array<double>, violation double, fit double"


@dataclass(frozen=True)
class NmfModel:
    """``chunks`` (doc, weights) and ``components`` (term, weights), weights being k numbers."""

    chunks: DataFrame
    components: DataFrame
    losses: list[float]
    sweeps: int
    converged: bool


def _names(k: int) -> list[str]:
    return [f"c{j}" for j in range(k)]


def _gram(factor: DataFrame, k: int, *extra: str) -> tuple[np.ndarray, tuple]:
    """``FᵀF`` of a packed factor as a k×k array, and any further aggregates of the same pass."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = factor.selectExpr(*[f"sum(gram[{i * k + j}])" for i, j in pairs], *extra).first()
    gram = np.zeros((k, k))
    for (i, j), value in zip(pairs, row):
        gram[i, j] = gram[j, i] = value or 0.0
    return gram, tuple(row[len(pairs):])


def _numbers(packed: bytes, k: int) -> np.ndarray:
    """The columns of a unit, one row each."""
    return np.frombuffer(packed, dtype=np.float64).reshape(k, -1)


def _unit(unit: int, columns: np.ndarray, violation: float = 0.0, fit: float = 0.0) -> pa.Table:
    """One row of a packed factor."""
    held = {
        "unit": pa.array([unit], pa.int64()),
        "numbers": pa.array([np.ascontiguousarray(columns).tobytes()], pa.binary()),
        "gram": pa.array([(columns @ columns.T).ravel()], pa.list_(pa.float64())),
        "violation": pa.array([violation], pa.float64()),
        "fit": pa.array([fit], pa.float64()),
    }
    return pa.table(held)


def _summed(shares: pa.Table, k: int) -> np.ndarray:
    """The shares of one unit added up in their order, which doesn't depend on the order in which they came."""
    total = None
    for packed in shares.sort_by("share")["numbers"]:
        share = _numbers(packed.as_py(), k)
        total = share.copy() if total is None else total + share
    return total


def _times(factor: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Multiply each row of a packed factor by a small matrix."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, packed in zip(batch["unit"], batch["numbers"]):
                yield from _unit(unit.as_py(), matrix.T @ _numbers(packed.as_py(), len(matrix))).to_batches()

    return factor.select("unit", "numbers").mapInArrow(multiply, PACKED)


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Let no sweep's exchanged rows stay on disk until the driver happens to collect its garbage."""
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(REMOVE_SHUFFLES) if before is None else spark.conf.set(REMOVE_SHUFFLES, before)


def _blocks_of(batches: Iterator[pa.RecordBatch], weights: int) -> Iterator[pa.Table]:
    """Tables of whole documents with about so many weights."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch["postings"]).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            passed = ends[at - 1] if at else 0
            stop = min(int(np.searchsorted(ends, passed + weights - size, "left")) + 1, batch.num_rows)
            held.append(batch.slice(at, stop - at))
            size, at = size + int(ends[stop - 1] - passed), stop
            if size >= weights:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _cut(docs: pa.Table, unit: int, doc: str, ranges: int, parts: int) -> pa.Table:
    """A block of documents cut by part of the vocabulary: (unit, range, part, docs, names, counts, places, weights).

    A row holds the terms of a part, for each document the number of its weights, and by document the
    places of their terms and the weights. The documents' ids come with the first row.
    """
    lists = docs["postings"].combine_chunks()
    flat = lists.flatten()
    encoded = flat.field("term").dictionary_encode()
    names, code, weights = encoded.dictionary, encoded.indices.to_numpy(), flat.field("weight").to_numpy()
    part = np.mod(spark_hashes(names), parts)
    grouped = np.argsort(part, kind="stable")
    place = np.empty(len(names), dtype=np.int32)
    place[grouped] = np.arange(len(names), dtype=np.int32)
    names, first = names.take(pa.array(grouped)), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
    part = part[code]
    order, start = np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
    row = np.repeat(np.arange(docs.num_rows), pc.list_value_length(lists).to_numpy())[order]
    place, weights = place[code][order], weights[order]
    held = {c: [] for c in ("part", "docs", "names", "counts", "places", "weights")}
    for p in np.flatnonzero(np.diff(start)):
        i, j = start[p], start[p + 1]
        held["docs"].append(None if held["part"] else docs[doc].to_pylist())
        held["part"].append(int(p))
        held["names"].append(names.slice(first[p], first[p + 1] - first[p]))
        held["counts"].append(np.bincount(row[i:j], minlength=docs.num_rows).astype(np.int32).tobytes())
        held["places"].append((place[i:j] - first[p]).astype(np.int32).tobytes())
        held["weights"].append(weights[i:j].tobytes())
    sizes = pa.array(np.concatenate([[0], np.cumsum([len(n) for n in held["names"]])]).astype(np.int32))
    columns = {
        "unit": pa.array([unit] * len(held["part"]), pa.int64()),
        "range": pa.array([unit % ranges] * len(held["part"]), pa.int32()),
        "part": pa.array(held["part"], pa.int32()),
        "docs": pa.array(held["docs"], pa.list_(docs.schema.field(doc).type)),
        "names": pa.ListArray.from_arrays(sizes, pa.concat_arrays(held["names"])),
    }
    return pa.table(columns | {c: pa.array(held[c], pa.binary()) for c in ("counts", "places", "weights")})


def _united(cut: pa.Table) -> pa.Table:
    """The sorted terms of one part of the vocabulary."""
    names = pc.unique(cut["names"].combine_chunks().flatten())
    names = names.take(pc.sort_indices(names))
    offsets = pa.array([0, len(names)], pa.int32())
    return pa.table({"unit": cut["part"][:1].cast(pa.int64()), "names": pa.ListArray.from_arrays(offsets, names)})


def _placed(cut: pa.Table, vocabulary: pa.Table) -> pa.Table:
    """The rows of one block with ``at``, the places of their terms in the part's vocabulary, for the terms."""
    lists = cut["names"].combine_chunks()
    found = pc.index_in(lists.flatten(), value_set=vocabulary["names"].combine_chunks().flatten()).to_numpy().astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    at = pa.array([found[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())
    return cut.drop_columns(["names"]).append_column("at", at)


def _packs(block: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Unit, counts by document, places of the weights' terms, weights, and the terms' places in their part."""
    for row in block.select(["unit", "counts", "places", "weights", "at"]).to_batches():
        for unit, counts, places, weights, at in zip(*row.columns):
            number = lambda value, kind: np.frombuffer(value.as_buffer(), dtype=kind)
            yield unit.as_py(), number(counts, np.int32), number(places, np.int32), number(weights, np.float64), number(at, np.int32)


SHARES = "unit long, share int, numbers binary"


def _shares(units: list[int], share: int, numbers: list[np.ndarray]) -> pa.Table:
    held = {"unit": pa.array(units, pa.int64()), "share": pa.array([share] * len(units), pa.int32())}
    return pa.table(held | {"numbers": pa.array([n.tobytes() for n in numbers], pa.binary())})


def _by_document(block: pa.Table, factor: pa.Table, k: int) -> pa.Table:
    """One block's share of ``X·F`` per block of documents; ``factor`` is the row of its part of the terms."""
    if not block.num_rows or not factor.num_rows:
        return _shares([], 0, [])
    terms, units, sums = _numbers(factor["numbers"][0].as_py(), k), [], []
    for unit, counts, places, weights, at in _packs(block):
        there = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts[there])[:-1]])
        share = np.zeros((k, len(counts)))
        for j in range(k):
            share[j, there] = np.add.reduceat(terms[j][at][places] * weights, starts)
        units.append(unit)
        sums.append(share)
    return _shares(units, block["part"][0].as_py(), sums)


def _by_term(block: pa.Table, factor: pa.Table, k: int) -> pa.Table:
    """One block's share of ``Xᵀ·F`` for its part of the terms; ``factor`` has the rows of its documents."""
    docs = {u.as_py(): n for u, n in zip(factor["unit"], factor["numbers"])}
    share, size = np.zeros((k, 0)), 0
    for unit, counts, places, weights, at in _packs(block) if docs else ():
        if unit not in docs:
            continue
        size = max(size, int(at.max()) + 1)
        if share.shape[1] < size:
            share = np.pad(share, ((0, 0), (0, size - share.shape[1])))
        numbers = _numbers(docs[unit].as_py(), k)
        for j in range(k):
            share[j, at] += np.bincount(places, weights=np.repeat(numbers[j], counts) * weights, minlength=len(at))
    return _shares([block["part"][0].as_py()], block["range"][0].as_py(), [share]) if size else _shares([], 0, [])


class _Matrix:
    """The weights in blocks, and their products with either factor.

    A block holds the weights of a range of documents and of a part of the vocabulary. Within it they lie by
    unit of documents, as they were packed. Blocks are bucketed and stay where they are; factors come to
    them packed: the numbers of a part once to each range, those of a unit of documents once to each part.
    A block adds up its own share before its packed numbers go back. So no weight and no term travels after
    the first time, and no row of a document or term is a row of Spark while the factors are sought.
    """

    def __init__(self, weights: DataFrame, doc: str, width: int):
        self.doc, self.width, self.spark = doc, width, weights.sparkSession
        self.kind = weights.schema[doc].dataType.simpleString()
        self.folder, self.table = scratch_folder(self.spark, "matrix"), f"weights_{uuid.uuid4().hex}"
        if "postings" not in weights.columns:
            pairs = F.struct("term", F.col("weight").cast("double").alias("weight"))
            weights = weights.groupBy(doc).agg(F.collect_list(pairs).alias("postings"))
        rows = self.kept("rows", weights.select(doc, "postings"))
        added = lambda value: F.aggregate("postings", F.lit(0.0), lambda a, p: a + value(p["weight"]))
        sums = rows.select(F.size("postings").alias("n"), added(lambda w: w).alias("w"), added(lambda w: w * w).alias("s"))
        size, self.total, self.squares, docs = sums.agg(F.sum("n"), F.sum("w"), F.sum("s"), F.count("*")).first()
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.blocks = max(1, math.ceil((size or 0) / BLOCK_WEIGHTS), min(tasks, 8 * (size or 0) // BLOCK_WEIGHTS))
        self.ranges = min(self.blocks, max(1, math.ceil(docs / RANGE_DOCS)))
        self.parts = math.ceil(self.blocks / self.ranges)
        self.tasks = self.ranges * self.parts
        cut = self.kept("cut", self._cut(rows))
        remove_folder(self.spark, f"{self.folder}/rows")
        self.doc_names = self.kept("docs", cut.filter("docs IS NOT NULL").select("unit", F.col("docs").alias("names")))
        dealt = cut.select("part", "names").repartition(self.parts, evenly(F.col("part"), self.parts))
        self.term_names = self.kept("terms", dealt.groupBy("part").applyInArrow(_united, "unit long, names array<string>"))
        # measured, as terms have no length limit of their own
        letters = F.sum(F.aggregate("names", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t)))
        self.n_terms, letters = (n or 0 for n in self.term_names.agg(F.sum(F.size("names")), letters).first())
        self.broadcast_terms = letters + self.n_terms * (width * 8 + 64) <= BROADCAST_BYTES
        self._store(cut)
        remove_folder(self.spark, f"{self.folder}/cut")
        self.packs = self.spark.table(self.table)

    def _cut(self, rows: DataFrame) -> DataFrame:
        doc, ranges, parts, weights = self.doc, self.ranges, self.parts, BLOCK_WEIGHTS

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # numbered as the rows are read, from files that no longer change
            first = TaskContext.get().partitionId() << 32
            for number, table in enumerate(_blocks_of(batches, weights)):
                yield from _cut(table, first + number, doc, ranges, parts).to_batches()

        return rows.mapInArrow(cut, f"unit long, range int, part int, docs array<{self.kind}>, names array<string>, counts binary, places binary, weights binary")

    def _block(self, part: Column, of_range: Column) -> Column:
        return evenly(of_range * self.parts + part, self.tasks).alias("block")

    def _store(self, cut: DataFrame) -> None:
        numbers = [F.col(c) for c in ("unit", "range", "part", "names", "counts", "places", "weights")]
        dealt = cut.select(self._block(F.col("part"), F.col("range")), *numbers).repartition(self.tasks, "block")
        names = self._to_ranges(self.term_names, "names")
        kinds = "block int, unit long, range int, part int, counts binary, places binary, weights binary, at binary"
        packs = dealt.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(_placed, kinds)
        writer = packs.write.bucketBy(self.tasks, "block").sortBy("block").option("compression", "zstd")
        writer.option("path", f"{self.folder}/packs").saveAsTable(self.table)

    def _to_ranges(self, rows: DataFrame, *columns: str) -> DataFrame:
        """What is known of a part of the vocabulary, for each block that holds weights of it."""
        each = rows.select("unit", *columns, F.explode(F.sequence(F.lit(0), F.lit(self.ranges - 1))).alias("range"))
        return each.select(self._block(F.col("unit"), F.col("range")), "unit", *columns).repartition(self.tasks, "block")

    def _to_parts(self, rows: DataFrame, *columns: str) -> DataFrame:
        """What is known of a unit of documents, for each block that may hold weights of it."""
        each = rows.select("unit", *columns, F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part"))
        block = self._block(F.col("part"), F.pmod("unit", F.lit(self.ranges)))
        return each.select(block, "unit", *columns).repartition(self.tasks, "block")

    def kept(self, name: str, rows: DataFrame) -> DataFrame:
        """Write rows that later steps read."""
        path = f"{self.folder}/{name}"
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def forget(self, name: str) -> None:
        remove_folder(self.spark, f"{self.folder}/{name}")

    def release(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove_folder(self.spark, self.folder)

    @property
    def vocabulary(self) -> DataFrame:
        return self.term_names.select(F.explode("names").alias("term"))

    def of_docs(self, terms: DataFrame, k: int) -> DataFrame:
        """Shares of ``X·F`` per unit of documents for a packed factor of the terms."""
        met = self.packs.groupBy("block").cogroup(self._to_ranges(terms, "numbers").groupBy("block"))
        return met.applyInArrow(lambda block, rows: _by_document(block, rows, k), SHARES)

    def of_terms(self, docs: DataFrame, k: int) -> DataFrame:
        """Shares of ``Xᵀ·F`` per part of the terms for a packed factor of the documents."""
        met = self.packs.groupBy("block").cogroup(self._to_parts(docs, "numbers").groupBy("block"))
        return met.applyInArrow(lambda block, rows: _by_term(block, rows, k), SHARES)

    def packed_docs(self, factor: DataFrame, k: int) -> DataFrame:
        return packed(factor, self.doc_names, self.doc, k)

    def packed_terms(self, factor: DataFrame, k: int) -> DataFrame:
        return packed(F.broadcast(factor) if self.broadcast_terms else factor, self.term_names, "term", k)

    def with_terms(self, factor: DataFrame, k: int) -> DataFrame:
        """``X·F`` per document for a factor (term, c0…)."""
        return rows_of(added(self.of_docs(self.packed_terms(factor, k), k), k), self.doc_names, self.doc, self.kind, k)

    def with_docs(self, factor: DataFrame, k: int) -> DataFrame:
        """``Xᵀ·F`` per term for a factor (doc, c0…)."""
        return rows_of(added(self.of_terms(self.packed_docs(factor, k), k), k), self.term_names, "term", "string", k)


def added(shares: DataFrame, k: int) -> DataFrame:
    """The packed factor of which each unit's shares are given."""
    return shares.groupBy("unit").applyInArrow(lambda rows: _unit(rows["unit"][0].as_py(), _summed(rows, k)), PACKED)


def packed(rows: DataFrame, names: DataFrame, key: str, k: int) -> DataFrame:
    """A factor with a row (key, c0…) per document or term, packed by unit; rows that are missing are zero."""
    columns = _names(k)
    placed = names.select("unit", F.size("names").alias("size"), F.posexplode("names").alias("place", key))
    found = placed.join(rows.select(key, *columns), key, "left").select("unit", "size", "place", *columns)

    def pack(table: pa.Table) -> pa.Table:
        numbers, at = np.zeros((k, table["size"][0].as_py())), table["place"].to_numpy()
        for j, c in enumerate(columns):
            numbers[j, at] = table[c].fill_null(0.0).to_numpy()
        return _unit(table["unit"][0].as_py(), numbers)

    return found.groupBy("unit").applyInArrow(pack, PACKED)


def rows_of(factor: DataFrame, names: DataFrame, key: str, kind: str, k: int) -> DataFrame:
    """A packed factor as rows (key, c0…)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, numbers in zip(batch["names"], batch["numbers"]):
                columns = _numbers(numbers.as_py(), k)
                for at in range(0, len(held), DESCENT_ROWS):
                    part = columns[:, at : at + DESCENT_ROWS]
                    yield pa.RecordBatch.from_arrays([held.values.slice(at, DESCENT_ROWS), *map(pa.array, part)], names=[key, *_names(k)])

    met = names.join(factor.select("unit", "numbers"), "unit").select("names", "numbers")
    return met.mapInArrow(unpack, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in _names(k)))


def _orthonormal(factor: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Rotate to orthonormal columns, dropping directions that carry nothing."""
    values, vectors = np.linalg.eigh(_gram(factor, k)[0])
    keep = values > max(values.max(), 0.0) * 1e-10
    if not keep.any():
        raise ValueError("the weights are all zero")
    return _times(factor, vectors[:, keep] / np.sqrt(values[keep])), int(keep.sum())


def _random_terms(x: _Matrix, width: int, seed: int) -> DataFrame:
    """A fixed pseudo-random packed factor, derived from the terms themselves, so reruns and retries agree."""
    value = lambda j: lambda t: F.pmod(F.xxhash64(t, F.lit(seed * 1000 + j)), F.lit(1 << 32)) / float(1 << 31) - 1.0
    columns = [F.transform("names", value(j)).alias(f"c{j}") for j in range(width)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, *numbers in zip(*batch.columns):
                yield from _unit(unit.as_py(), np.stack([n.values.to_numpy() for n in numbers])).to_batches()

    return x.term_names.select("unit", *columns).mapInArrow(pack, PACKED)


def _leading_vectors(x: _Matrix, k: int, seed: int, power: int):
    """Leading singular values with document and term vectors, by subspace iteration."""
    width = k + OVERSAMPLING
    terms = _random_terms(x, width, seed)
    for step in range(power + 1):
        docs = x.kept(f"left-{step}", added(x.of_docs(terms, width), width))
        docs, width = _orthonormal(docs, width)
        terms = x.kept(f"right-{step}", added(x.of_terms(docs, width), width))
        if step:
            x.forget(f"left-{step - 1}")
            x.forget(f"right-{step - 1}")
        if step < power:
            terms, width = _orthonormal(terms, width)
    values, vectors = np.linalg.eigh(_gram(terms, width)[0])
    order = np.argsort(values)[::-1][:k]
    order = order[values[order] > max(values.max(), 0.0) * 1e-12]
    singular = np.sqrt(values[order])
    rotation = vectors[:, order]
    docs, terms, found = _times(docs, rotation), _times(terms, rotation / singular), len(order)
    return singular, rows_of(docs, x.doc_names, x.doc, x.kind, found), rows_of(terms, x.term_names, "term", "string", found)


def _start_factors(x: _Matrix, k: int, fill: float, seed: int, power: int):
    """Non-negative start from the leading singular vectors; zeros take the mean of the data."""
    singular, docs, terms = _leading_vectors(x, k, seed, power)
    found = len(singular)

    def part_norms(factor: DataFrame):
        sums = []
        for j in range(found):
            c = F.col(f"c{j}")
            sums += [F.sum(F.when(c > 0, c * c)), F.sum(F.when(c < 0, c * c))]
        row = factor.agg(*sums).first()
        return [(np.sqrt(row[2 * j] or 0.0), np.sqrt(row[2 * j + 1] or 0.0)) for j in range(found)]

    doc_norms, term_norms = part_norms(docs), part_norms(terms)

    def non_negative(factor: DataFrame, key: str, norms) -> DataFrame:
        columns = []
        for j in range(k):
            if j >= found:
                value = F.lit(0.0)
            elif j == 0:
                value = F.abs(F.col("c0")) * float(np.sqrt(singular[0]))
            else:
                plus = doc_norms[j][0] * term_norms[j][0]
                minus = doc_norms[j][1] * term_norms[j][1]
                sign, norm, size = (1.0, norms[j][0], plus) if plus > minus else (-1.0, norms[j][1], minus)
                scale = float(np.sqrt(singular[j] * size) / norm) if norm > 0 else 0.0
                value = F.greatest(F.col(f"c{j}") * sign, F.lit(0.0)) * scale
            columns.append(F.when(value < 1e-6, F.lit(fill)).otherwise(value).alias(f"c{j}"))
        return factor.select(key, *columns)

    return non_negative(docs, x.doc, doc_norms), non_negative(terms, "term", term_norms)


def _updated(shares: DataFrame, factor: DataFrame, gram: np.ndarray, k: int, passes: int = 1) -> DataFrame:
    """Coordinate descent over the k columns of every row, ``passes`` times with the same products.

    Rows don't depend on each other, so further passes cost no reading of the weights.
    ``violation`` measures how far a unit was from optimal, ``fit`` is its share of ``<X, W·H>``.
    """

    def descend(shares: pa.Table, rows: pa.Table) -> pa.Table:
        whole, sums = _numbers(rows["numbers"][0].as_py(), k).copy(), _summed(shares, k)
        violation = 0.0
        for at in range(0, whole.shape[1], DESCENT_ROWS):
            c, p = whole[:, at : at + DESCENT_ROWS].copy(), np.zeros_like(whole[:, at : at + DESCENT_ROWS])
            # terms behind the last one of a range have no product with it
            part = sums[:, at : at + DESCENT_ROWS]
            p[:, : part.shape[1]] = part
            for step in range(passes):
                for j in range(k):
                    slope = gram[:, j] @ c - p[j]
                    if step == 0:
                        violation += float(np.abs(np.where(c[j] == 0, np.minimum(slope, 0), slope)).sum())
                    if gram[j, j] > 0:
                        c[j] = np.maximum(c[j] - slope / gram[j, j], 0)
            whole[:, at : at + DESCENT_ROWS] = c
        size = min(sums.shape[1], whole.shape[1])
        return _unit(rows["unit"][0].as_py(), whole, violation, float((whole[:, :size] * sums[:, :size]).sum()))

    return shares.groupBy("unit").cogroup(factor.select("unit", "numbers").groupBy("unit")).applyInArrow(descend, PACKED)


class _Sweeps:
    """Factors and figures of the last finished sweep, kept in a folder that all executors share.

    Each sweep writes a folder of its own and then the note that names it; only then does the folder of
    the sweep before go. A fit that ended early goes on from the note. Factors are packed; the ids of their
    rows lie beside them once, in a folder of the run that the note names too.
    """

    def __init__(self, spark: SparkSession, folder: str, about: dict):
        self.spark, self.folder, self.about, self.run = spark, folder, about, f".names-{uuid.uuid4().hex}"

    def last(self) -> dict | None:
        text = read_note(self.spark, f"{self.folder}/state.json")
        state = json.loads(text) if text else None
        if state and state["about"] != self.about:
            raise ValueError(f"{self.folder} holds the fit of other weights or options: {state['about']}")
        return state

    def keep_names(self, **names: DataFrame) -> None:
        for name, rows in names.items():
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{self.run}/{name}")

    def names(self, run: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{run}/{name}")

    def keep(self, sweep: int, name: str, factor: DataFrame) -> DataFrame:
        path = f"{self.folder}/sweep-{sweep}/{name}"
        factor.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(factor.schema).parquet(path)

    def kept(self, sweep: int, name: str) -> DataFrame:
        return self.spark.read.schema(PACKED).parquet(f"{self.folder}/sweep-{sweep}/{name}")

    def finish(self, sweep: int, losses: list[float], first_violation: float | None, done: bool, before: str | None = None) -> None:
        state = {"about": self.about, "run": self.run, "sweep": sweep, "losses": losses, "first_violation": first_violation, "done": done}
        write_note(self.spark, f"{self.folder}/state.json", json.dumps(state))
        if sweep:
            remove_folder(self.spark, f"{self.folder}/sweep-{sweep - 1}")
        if before and before != self.run:
            remove_folder(self.spark, f"{self.folder}/{before}")


def fit_nmf(
    weights: DataFrame,
    n_docs: int,
    k: int = 6,
    doc_id: str = "doc_id",
    max_sweeps: int = 500,
    tolerance: float = 1e-4,
    seed: int = 42,
    power: int = 4,
    passes: int = PASSES,
    folder: str | None = None,
) -> NmfModel:
    """Factorise (doc, term, weight), or (doc, postings) with a document's terms in one row, into k components.

    Stops when the optimality violation has fallen to ``tolerance`` of its first value. Each sweep reads
    the weights twice and takes ``passes`` steps of coordinate descent with what it read, so the loss falls
    faster per reading. Factors are written every sweep: plans stay short and a lost executor costs
    one sweep. With a ``folder``, a fit of the same weights that ended early is taken up where it was;
    by default they go to a scratch folder of the application.
    """
    with _shuffles_removed(weights.sparkSession):
        return _fit(weights, n_docs, k, doc_id, max_sweeps, tolerance, seed, power, passes, folder)


def _fit(
    weights: DataFrame, n_docs: int, k: int, doc_id: str, max_sweeps: int, tolerance: float, seed: int, power: int, passes: int, folder: str | None
) -> NmfModel:
    spark = weights.sparkSession
    checkpoint_dir(spark)
    x = _Matrix(weights, doc_id, k + OVERSAMPLING)
    try:
        if x.n_terms == 0:
            raise ValueError("no term is left to factorise")
        total, squares = x.total, x.squares
        about = {"k": k, "doc_id": doc_id, "n_docs": n_docs, "n_terms": x.n_terms, "weight": f"{total:.6g}", "seed": seed, "power": power}
        saved = _Sweeps(spark, folder or scratch_folder(spark, "nmf"), about)
        state = saved.last()
        if state is None:
            state = {"run": saved.run, "sweep": 0, "losses": [], "first_violation": None, "done": False}
            rows = _start_factors(x, k, float(total / (n_docs * x.n_terms)), seed, power)
        else:
            held = [(saved.kept(state["sweep"], n), saved.names(state["run"], n)) for n in ("docs", "terms")]
            rows = [rows_of(*pair, key, kind, k) for pair, key, kind in zip(held, (doc_id, "term"), (x.kind, "string"))]
        run, losses, first_violation, sweeps = state["run"], state["losses"], state["first_violation"], state["sweep"]
        docs, terms = rows
        if not state["done"] and sweeps < max_sweeps:
            saved.keep_names(docs=x.doc_names, terms=x.term_names)
            docs, terms = x.kept("start-docs", x.packed_docs(docs, k)), x.kept("start-terms", x.packed_terms(terms, k))
            term_gram = _gram(terms, k)[0]
        while not state["done"] and sweeps < max_sweeps:
            sweeps += 1
            docs = saved.keep(sweeps, "docs", _updated(x.of_docs(terms, k), docs, term_gram, k, passes))
            doc_gram, (doc_violation,) = _gram(docs, k, "sum(violation)")
            terms = saved.keep(sweeps, "terms", _updated(x.of_terms(docs, k), terms, doc_gram, k, passes))
            term_gram, (term_violation, fit) = _gram(terms, k, "sum(violation)", "sum(fit)")
            losses.append(float(squares - 2 * fit + (doc_gram * term_gram).sum()))
            violation = doc_violation + term_violation
            first_violation = violation if first_violation is None else first_violation
            state["done"] = bool(first_violation == 0 or violation <= tolerance * first_violation)
            saved.finish(sweeps, losses, first_violation, state["done"], run)
            run, state["run"] = saved.run, saved.run
        if state["sweep"] < sweeps:
            docs = rows_of(docs, saved.names(run, "docs"), doc_id, x.kind, k)
            terms = rows_of(terms, saved.names(run, "terms"), "term", "string", k)
    finally:
        x.release()
    columns = _names(k)
    return NmfModel(
        docs.select(doc_id, F.array(*columns).alias("weights")),
        terms.select("term", F.array(*columns).alias("weights")),
        losses,
        sweeps,
        state["done"],
    )
