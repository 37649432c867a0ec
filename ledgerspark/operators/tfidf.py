"""TF-IDF weights as a long table (scope…, doc, term, weight) with unit-length documents.

``scope`` columns, such as the company, keep corpora apart: document frequencies and counts are
taken per scope. Without scope all documents form one corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark import constants as C
from ledgerspark.functions.text import ngrams, tokens
from ledgerspark.sources.tables import scratch_table

# a term of more documents than this is not joined by one task
HOT_DF = 1_000_000
# vocabulary rows, some 60 bytes each, that are sent whole to every executor
BROADCAST_TERMS = 200_000
# words of the documents that one task weighs at a time, some 150 bytes each while it does
BLOCK_WORDS = 1_500_000
# letters of a text, blanks and stop words included, for each word that counts
LETTERS = 6
# numbers that get labels of their own; more than that are dealt evenly enough by their hash
LABELLED = 2_000


@dataclass(frozen=True)
class TfidfSpec:
    """How texts become terms and which terms count."""

    stop_words: Iterable[str] = C.STOP_WORDS
    longest_ngram: int = 2
    min_df: int = 1
    max_df: float = 1.0
    scope: Sequence[str] = field(default_factory=tuple)


def document_words(docs: DataFrame, spec: TfidfSpec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise once and hash the documents by id.

    Everything per document below (term counts, length) then runs without another shuffle, and
    Spark reuses this exchange for the document-frequency branch, so texts are read once. Only
    single words travel; word pairs are formed behind the exchange.
    """
    return keyed_words(docs, spec, doc_id, text).repartition(doc_id)


def keyed_words(docs: DataFrame, spec: TfidfSpec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(scope…, doc, _words) of the documents that have their keys."""
    # joins on the keys add this filter to some branches; stated here, all branches stay the same
    # and share the exchange
    keyed = docs
    for key in (*spec.scope, doc_id):
        keyed = keyed.filter(F.col(key).isNotNull())
    return keyed.select(*spec.scope, doc_id, tokens(F.col(text), spec.stop_words).alias("_words"))


def term_counts(words: DataFrame, spec: TfidfSpec, doc_id: str = "doc_id") -> DataFrame:
    """(scope…, doc, term, tf); documents without terms have no rows."""
    terms = words.select(*spec.scope, doc_id, F.explode(ngrams(F.col("_words"), spec.longest_ngram)).alias("term"))
    return terms.groupBy(*spec.scope, doc_id, "term").agg(F.count("*").alias("tf"))


def inverse_document_frequency(n_docs: Column, df: Column) -> Column:
    """Smoothed: as if one more document held every term, so no term gets weight zero."""
    return F.log((1 + n_docs) / (1 + df)) + 1


def vocabulary(docs: DataFrame, spec: TfidfSpec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(scope…, term, df, idf) for the terms within the document-frequency bounds.

    A document is one row, so its distinct terms are found in the row; only partial counts per term
    are shuffled.
    """
    keyed = docs
    for key in (*spec.scope, doc_id):
        keyed = keyed.filter(F.col(key).isNotNull())
    held = F.array_distinct(ngrams(tokens(F.col(text), spec.stop_words), spec.longest_ngram))
    terms = keyed.select(*spec.scope, F.explode(held).alias("term"))
    frequency = terms.groupBy(*spec.scope, "term").agg(F.count("*").alias("df"))
    if spec.scope:
        sizes = docs.groupBy(*spec.scope).agg(F.count("*").alias("n_docs"))
        frequency = frequency.join(sizes, list(spec.scope))
    else:
        frequency = frequency.withColumn("n_docs", docs.agg(F.count("*")).scalar())
    if spec.min_df > 1:
        frequency = frequency.filter(F.col("df") >= spec.min_df)
    if spec.max_df < 1.0:
        frequency = frequency.filter(F.col("df") <= F.col("n_docs") * spec.max_df)
    idf = inverse_document_frequency(F.col("n_docs"), F.col("df"))
    return frequency.select(*spec.scope, "term", "df", idf.alias("idf"))


def normalised(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scale each vector, identified by ``keys``, to length one."""
    vector = Window.partitionBy(*keys)
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(vector))
    return weights.withColumn("weight", F.try_divide("weight", length))


def weighted_counts(counts: DataFrame, vocabulary: DataFrame, spec: TfidfSpec, doc_id: str = "doc_id") -> DataFrame:
    """(scope…, doc, term, weight) before scaling, by one join on the term."""
    joined = counts.join(vocabulary, [*spec.scope, "term"])
    return joined.select(*spec.scope, doc_id, "term", (F.col("tf") * F.col("idf")).alias("weight"))


def weighted_without_skew(
    counts: DataFrame, vocabulary: DataFrame, spec: TfidfSpec, doc_id: str = "doc_id", hot_df: int = HOT_DF
) -> DataFrame:
    """``weighted_counts`` where no task joins all rows of a term that very many documents hold.

    A term's rows are its documents, so the vocabulary, which should be a written table, says which
    terms are hot. There are at most (rows of counts / ``hot_df``) of them: they are broadcast, unless
    even they are many, in which case they are salted so that a salt has some ``hot_df`` rows at most.
    """
    keys = [*spec.scope, "term"]
    hot = vocabulary.filter(F.col("df") > hot_df)
    n_hot = hot.count()
    if not n_hot:
        return weighted_counts(counts, vocabulary, spec, doc_id)
    cold = weighted_counts(counts, vocabulary.filter(F.col("df") <= hot_df), spec, doc_id)
    if n_hot <= BROADCAST_TERMS:
        return cold.unionByName(weighted_counts(counts, F.broadcast(hot), spec, doc_id))
    salts = math.ceil(hot.agg(F.max("df")).first()[0] / hot_df)
    dealt = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int"))
    joined = salted.join(dealt, [*keys, "_salt"])
    return cold.unionByName(joined.select(*spec.scope, doc_id, "term", (F.col("tf") * F.col("idf")).alias("weight")))


def block_count(letters: DataFrame, buckets: int | None = None) -> int:
    """Blocks of about ``BLOCK_WORDS`` words at most, more for small corpora; a multiple of ``buckets``.

    The words are reckoned from the texts' lengths, as finding them takes as long as the rest of a reading.
    """
    size = (letters.first()[0] or 0) // LETTERS
    tasks = int(letters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(size / BLOCK_WORDS), min(tasks, 4 * size // BLOCK_WORDS))
    return math.ceil(blocks / buckets) * buckets if buckets else blocks


@cache
def even_labels(count: int) -> tuple[int, ...]:
    """As many numbers, of which ``repartition(count, number)`` deals one to each partition.

    Numbers from 0 on would meet by twos and threes in some partitions and leave others empty.
    """
    if 1 < count <= LABELLED:
        tried = SparkSession.active().range(count * (8 + math.ceil(math.log(count)))).select(F.col("id").cast("int").alias("label"))
        first = tried.groupBy(F.pmod(F.hash("label"), F.lit(count)).alias("_place")).agg(F.min("label").alias("label")).collect()
        if len(first) == count:
            return tuple(r["label"] for r in sorted(first))
    return tuple(range(count))


def evenly(number: Column, count: int) -> Column:
    """The label (see ``even_labels``) of a number under ``count``."""
    labels = even_labels(count)
    if labels == tuple(range(count)):
        return number.cast("int")
    return F.element_at(F.lit(list(labels)), number.cast("int") + 1)


def dealt_words(words: DataFrame, blocks: int, doc_id: str) -> DataFrame:
    """The documents' words with their ``block``; blocks divide the buckets of a table by document.

    They are dealt by ``_place``, the block's label, so that each block is a partition of its own.

    Words travel as one text, a third of the bytes of a list; they hold no blanks.
    """
    block = F.pmod(F.hash(doc_id), F.lit(blocks))
    keys = [c for c in words.columns if c != "_words"]
    named = [block.alias("block"), evenly(block, blocks).alias("_place")]
    sent = words.select(*keys, F.array_join("_words", " ").alias("_text"), *named).repartition(blocks, "_place")
    empty = F.array().cast("array<string>")
    return sent.select(*keys, "block", "_place", F.when(F.col("_text") == "", empty).otherwise(F.split("_text", " ")).alias("_words"))


def placed_terms(dealt: DataFrame, sizes: DataFrame, spec: TfidfSpec, parts: int) -> DataFrame:
    """(scope…, term, df, n_docs, blocks) of every term; ``blocks`` is null where one block has them all.

    A block's terms are counted where it is, and a term travels once per block that holds it, not once
    per document.
    """
    keys = [*spec.scope, "term"]
    labels = even_labels(parts)
    # all columns, so that the documents' words, read again to be weighed, are exchanged once
    counted = dealt.groupBy("_place").applyInArrow(
        lambda docs: counted_terms(docs, spec, parts, labels), f"_part int, block int, {_pack_schema(dealt, spec.scope, 'n')}"
    )
    sent = counted.repartition(parts, "_part")

    def added(packed: pa.Table) -> pa.Table:
        held = _opened(packed, ["block"], "n", spec.scope).group_by(keys).aggregate([("n", "sum"), ("block", "list")])
        held = held.take(pc.sort_indices(held["term"]))
        return pa.table({c: held[c] for c in keys} | {"df": held["n_sum"], "blocks": held["block_list"]})

    kinds = ", ".join([*(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in spec.scope), "term string"])
    placed = sent.groupBy("_part").applyInArrow(added, f"{kinds}, df long, blocks array<int>")
    blocks = F.when(F.size("blocks") > 1, F.col("blocks"))
    return with_sizes(placed, sizes, spec).select(*keys, "df", "n_docs", blocks.alias("blocks"))


def packed_terms(rows: DataFrame, keys: Sequence[str], number: str, scope: Sequence[str] = ()) -> DataFrame:
    """(keys…, scope…, runs, terms, number): the terms of equal ``keys`` in one text, as far as a task's batches go.

    ``rows`` has a term and a number in each row. Where rows come sorted by term, neighbours have long
    beginnings in common, so a term and its number travel in some four bytes in place of forty. Terms hold
    no line breaks. A scope's values are listed with the number of their terms: a row for each of them would
    hold few terms, and there would be as many rows as blocks times parts times values.
    """
    scope = list(scope)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            # by number, as equal keys need only lie together; a sort of texts took longer than the rest
            order = np.argsort(_codes(*[table[c] for c in (*keys, *scope)]), kind="stable")
            table = table.take(pa.array(order))
            yield from _packed(table, keys, scope, number).to_batches()
            del table
        pa.default_memory_pool().release_unused()

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.select(*keys, *scope, "term", number).mapInArrow(pack, f"{kinds}, {_pack_schema(rows, scope, number)}")


def _pack_schema(rows: DataFrame, scope: Sequence[str], number: str) -> str:
    scopes = [f"`{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in scope]
    return ", ".join([*scopes, "runs array<long>", "terms binary", "terms_size long", f"{number} binary", f"{number}_size long"])


def _starts(*columns: pa.ChunkedArray) -> np.ndarray:
    """Where rows begin that differ from the row before."""
    codes = _codes(*columns)
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)])


def _packed(table: pa.Table, keys: Sequence[str], scope: Sequence[str], number: str) -> pa.Table:
    """One row per ``keys`` of a table that is sorted by them and by scope."""
    starts, runs = _starts(*[table[c] for c in keys]), _starts(*[table[c] for c in (*keys, *scope)])
    ends, sizes = np.append(starts[1:], table.num_rows), np.diff(runs, append=table.num_rows)
    first = pa.array(np.searchsorted(runs, np.append(starts, table.num_rows)).astype(np.int32))
    terms, numbers = table["term"].combine_chunks(), table[number].to_numpy().astype(np.int64)
    codec = pa.Codec("zstd", 3)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(terms)), pa.int32()), terms), "\n")
    columns = {c: table[c].take(pa.array(starts)) for c in keys}
    columns |= {c: pa.ListArray.from_arrays(first, table[c].take(pa.array(runs)).combine_chunks()) for c in scope}
    columns["runs"] = pa.ListArray.from_arrays(first, pa.array(sizes, pa.int64()))
    for name, parts in (("terms", [t.as_buffer() for t in joined]), (number, [numbers[i:j].tobytes() for i, j in zip(starts, ends)])):
        columns |= {name: pa.array([codec.compress(p, asbytes=True) for p in parts], pa.binary()), f"{name}_size": pa.array([len(p) for p in parts], pa.int64())}
    return pa.table(columns)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 2 * BLOCK_WORDS) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _opened(packed: pa.Table | pa.RecordBatch, keys: Sequence[str], number: str, scope: Sequence[str] = ()) -> pa.Table:
    """The rows of packed terms, one term each."""
    codec = pa.Codec("zstd")
    read = lambda name: [codec.decompress(b.as_py(), n.as_py(), asbytes=True) for b, n in zip(packed[name], packed[f"{name}_size"])]
    terms = [pc.split_pattern(pa.array([t.decode()]), "\n").flatten() for t in read("terms")]
    numbers = np.concatenate([np.frombuffer(n, dtype=np.int64) for n in read(number)] or [np.empty(0, np.int64)])
    row = pa.array(np.repeat(np.arange(len(terms)), np.array([len(t) for t in terms], dtype=np.int64)))
    columns = {c: packed[c].take(row) for c in keys}
    if scope:
        flat = lambda c: pc.list_flatten(packed[c])
        run = pa.array(np.repeat(np.arange(len(flat("runs"))), flat("runs").to_numpy()))
        columns |= {c: flat(c).take(run) for c in scope}
    return pa.table(columns | {"term": pa.concat_arrays([pa.array([], pa.string()), *terms]), number: pa.array(numbers)})


def with_sizes(rows: DataFrame, sizes: DataFrame, spec: TfidfSpec) -> DataFrame:
    """``rows`` with ``n_docs``, the documents of their scope."""
    return rows.join(sizes, list(spec.scope)) if spec.scope else rows.withColumn("n_docs", sizes.scalar())


def stored_sizes(sizes: DataFrame, spec: TfidfSpec) -> DataFrame:
    """``sizes`` of few scopes are sent to the executors, so that no words are exchanged to meet them."""
    if not spec.scope:
        return sizes
    sizes = scratch_table(sizes)
    return F.broadcast(sizes) if sizes.count() <= BROADCAST_TERMS else sizes


def within_bounds(terms: DataFrame, spec: TfidfSpec) -> DataFrame:
    """The vocabulary (scope…, term, df, idf) of terms with ``df`` and ``n_docs``."""
    kept = terms.filter(F.col("df") >= spec.min_df)
    if spec.max_df < 1.0:
        kept = kept.filter(F.col("df") <= F.col("n_docs") * spec.max_df)
    return kept.select(*spec.scope, "term", "df", inverse_document_frequency(F.col("n_docs"), F.col("df")).alias("idf"))


def _codes(*columns: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """One number per distinct combination of the columns' values."""
    codes = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        encoded = whole.dictionary_encode()
        codes = np.unique(codes * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(), return_inverse=True)[1]
    return codes


def spark_hashes(texts: pa.Array) -> np.ndarray:
    """``hash`` of each text as Spark finds it, so that rows dealt by a task lie in the buckets of their table."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    starts, lengths = offsets[:-1].astype(np.int64), np.diff(offsets)
    letters = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    turned = lambda x, n: (x << np.uint32(n)) | (x >> np.uint32(32 - n))
    found = np.full(len(texts), 42, dtype=np.uint32)

    def mix(at: np.ndarray, value: np.ndarray) -> None:
        value = turned(value * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        found[at] = turned(found[at] ^ value, 13) * np.uint32(5) + np.uint32(0xE6546B64)

    for step in range(int(lengths.max(initial=0)) // 4):
        at = np.flatnonzero(lengths >= 4 * step + 4)
        first = starts[at] + 4 * step
        mix(at, sum(letters[first + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4)))
    for step in range(3):
        at = np.flatnonzero(lengths % 4 > step)
        mix(at, letters[starts[at] + lengths[at] // 4 * 4 + step].astype(np.int8).astype(np.int32).view(np.uint32))
    found ^= lengths.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        found = (found ^ (found >> np.uint32(shift))) * np.uint32(factor)
    return (found ^ (found >> np.uint32(16))).view(np.int32)


def _coded_ngrams(words: pa.Array, row: np.ndarray, longest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different runs of up to ``longest`` words within a row, and of every run its number and row.

    Runs are put together as numbers; only the different ones become texts. Those of equal length are sorted.
    """
    encoded = words.dictionary_encode()
    order = pc.sort_indices(encoded.dictionary)
    single, rank = encoded.dictionary.take(order), np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    word = rank[encoded.indices.to_numpy()]
    names, codes, rows, run, last = [single], [word], [row], word, single
    for n in range(2, longest + 1):
        first = np.flatnonzero(row[: max(len(row) - n + 1, 0)] == row[n - 1 :])
        # ``run`` numbers the runs that are one word shorter, by where they start
        number = np.full(len(row), -1, dtype=np.int64)
        different, number[first] = np.unique(run[first] * max(len(single), 1) + word[first + n - 1], return_inverse=True)
        last = pc.binary_join_element_wise(last.take(pa.array(different // max(len(single), 1))), single.take(pa.array(different % max(len(single), 1))), " ")
        codes.append(number[first] + sum(map(len, names)))
        names.append(last)
        rows.append(row[first])
        run = number
    return pa.concat_arrays(names), np.concatenate(codes), np.concatenate(rows)


def counted_terms(docs: pa.Table, spec: TfidfSpec, parts: int, labels: Sequence[int]) -> pa.Table:
    """(_part, block, scope…, term, n) of one block: the rows of ``docs`` that hold each term, packed by part."""
    scope = list(spec.scope)
    words = docs["_words"].combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    names, code, row = _coded_ngrams(words.flatten(), np.repeat(np.arange(docs.num_rows), lengths), spec.longest_ngram)
    size = max(len(names), 1)
    pairs = _counted(row * size + code)[0]
    del row, code
    scopes, first = np.zeros(docs.num_rows, dtype=np.int64), np.zeros(1, dtype=np.int64)
    if scope:
        _, first, scopes = np.unique(_codes(*[docs[c] for c in scope]), return_index=True, return_inverse=True)
    held = np.bincount(scopes[pairs // size] * size + pairs % size)
    there = np.flatnonzero(held)
    part = np.mod(spark_hashes(names), parts)[there % size]
    order = np.argsort(part, kind="stable")
    there, part = there[order], part[order]
    at = pa.array(first[there // size])
    columns = {"_part": pa.array(np.array(labels, dtype=np.int32)[part])} | {c: docs[c].take(at) for c in ("block", *scope)}
    counted = _packed(pa.table(columns | {"term": names.take(pa.array(there % size)), "n": pa.array(held[there])}), ["_part", "block"], scope, "n")
    # the worker waits for a while beside the next stage's
    pa.default_memory_pool().release_unused()
    return counted


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and how often each is there."""
    values = np.sort(values)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
    return values[starts], np.diff(starts, append=len(values))


def weigh_block(docs: pa.Table, shared: pa.Table, spec: TfidfSpec, doc_id: str) -> pa.Table:
    """(scope…, doc, postings) of one block: the terms of each document with weights of length one.

    ``docs`` has words and ``n_docs``; ``shared`` the ``df`` of terms that other blocks hold too. The
    other terms' frequencies are those of the block.
    """
    scope = list(spec.scope)
    words = docs["_words"].combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    names, code, row = _coded_ngrams(words.flatten(), np.repeat(np.arange(docs.num_rows), lengths), spec.longest_ngram)
    known = shared["term"].combine_chunks()
    scopes = np.zeros(docs.num_rows, dtype=np.int64)
    if scope:
        # equal terms of different scopes are different terms
        both = _codes(*[pa.concat_arrays([c for t in (docs, shared) for c in t[name].chunks]) for name in scope])
        scopes, of_known = both[: docs.num_rows], both[docs.num_rows :]
        marked = lambda texts, codes: pc.binary_join_element_wise(pa.array(codes).cast(pa.string()), texts, ":")
        both, code = np.unique(scopes[row] * max(len(names), 1) + code, return_inverse=True)
        names, known = marked(names.take(pa.array(both % max(len(names), 1))), both // max(len(names), 1)), marked(known, of_known)
    size = max(len(names), 1)
    pairs, tf = _counted(row * size + code)
    del row, code
    df = np.bincount(pairs % size, minlength=size)
    total = np.zeros(size)
    total[pairs % size] = docs["n_docs"].to_numpy()[pairs // size]
    place = pc.index_in(names, value_set=known)
    elsewhere = np.flatnonzero(pc.is_valid(place).to_numpy(zero_copy_only=False))
    df[elsewhere] = shared["df"].to_numpy()[pc.drop_null(place).to_numpy()]
    keep = df >= spec.min_df
    if spec.max_df < 1.0:
        keep &= df <= total * spec.max_df
    idf = np.log((1 + total) / (1 + df)) + 1
    # rows of one document are one vector
    _, first, unit = np.unique(_codes(docs[doc_id]) * (scopes.max(initial=0) + 1) + scopes, return_index=True, return_inverse=True)
    if len(first) < docs.num_rows:
        pairs, back = np.unique(unit[pairs // size] * size + pairs % size, return_inverse=True)
        tf, unit = np.bincount(back, weights=tf), np.arange(len(first))
    else:
        first, unit = np.arange(docs.num_rows), np.arange(docs.num_rows)
    unit, code = pairs // size, pairs % size
    chosen = keep[code]
    unit, code, weight = unit[chosen], code[chosen], (tf * idf[code])[chosen]
    doc = _codes(docs[doc_id].take(pa.array(first)))[unit]
    weight = weight / np.sqrt(np.bincount(doc, weights=weight * weight))[doc]
    there, counts = np.unique(unit, return_counts=True)
    if scope:
        names = pc.replace_substring_regex(names, "^[0-9]+:", "")
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    postings = pa.StructArray.from_arrays([names.take(pa.array(code)), pa.array(weight)], ["term", "weight"])
    at = pa.array(first[there])
    columns = {name: docs[name].take(at) for name in (*scope, doc_id)}
    return pa.table(columns | {"postings": pa.ListArray.from_arrays(offsets, postings)})


def packed_weights(dealt: DataFrame, placed: DataFrame, sizes: DataFrame, spec: TfidfSpec, blocks: int, doc_id: str) -> DataFrame:
    """(scope…, doc, postings): one row per document, dealt by block, its terms weighted to length one."""
    docs = with_sizes(dealt, sizes, spec)
    # renamed to themselves, as both sides of the cogroup may come from the same rows
    named = [F.col(c).alias(c) for c in (*spec.scope, "term", "df")]
    places = evenly(F.col("block"), blocks).alias("_place")
    shared = packed_terms(placed.filter("blocks IS NOT NULL").select(F.explode("blocks").alias("block"), *named), ["block"], "df", spec.scope)
    kinds = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in (*spec.scope, doc_id))
    weigh = lambda left, right: weigh_block(left, _opened(right, ["block"], "df", spec.scope), spec, doc_id)
    return (
        docs.groupBy("_place")
        .cogroup(shared.select("*", places).repartition(blocks, "_place").groupBy("_place"))
        .applyInArrow(weigh, f"{kinds}, postings array<struct<term: string, weight: double>>")
    )


@dataclass(frozen=True)
class TfidfIndex:
    """A fitted corpus: term counts, hashed by document, and the vocabulary.

    Nothing is computed until it is read. ``operators.index.store_index`` writes it for many readers.
    """

    vocabulary: DataFrame
    counts: DataFrame
    spec: TfidfSpec
    doc_id: str
    words: DataFrame
    sizes: DataFrame
    letters: DataFrame

    @property
    def documents(self) -> DataFrame:
        """(scope…, doc, postings): one row per document, its terms weighted to length one."""
        blocks, sizes = block_count(self.letters), stored_sizes(self.sizes, self.spec)
        dealt = dealt_words(self.words, blocks, self.doc_id)
        placed = placed_terms(dealt, sizes, self.spec, blocks)
        return packed_weights(dealt, placed, sizes, self.spec, blocks, self.doc_id)

    @property
    def weights(self) -> DataFrame:
        """(scope…, doc, term, weight), every document of length one."""
        return exploded(self.documents, self.spec, self.doc_id)


def exploded(packed: DataFrame, spec: TfidfSpec, doc_id: str) -> DataFrame:
    """(scope…, doc, term, weight) of packed documents; it stays dealt as they are."""
    return packed.select(*spec.scope, doc_id, F.inline("postings"))


def fit_tfidf(
    docs: DataFrame, spec: TfidfSpec | None = None, doc_id: str = "doc_id", text: str = "text"
) -> TfidfIndex:
    """Fit a corpus. ``doc_id`` must identify a document across all scopes."""
    spec = spec or TfidfSpec()
    counts = term_counts(document_words(docs, spec, doc_id, text), spec, doc_id)
    sizes = docs.groupBy(*spec.scope).agg(F.count("*").alias("n_docs"))
    letters = docs.agg(F.sum(F.length(text)))
    return TfidfIndex(vocabulary(docs, spec, doc_id, text), counts, spec, doc_id, keyed_words(docs, spec, doc_id, text), sizes, letters)


def query_vectors(
    queries: DataFrame, index: TfidfIndex, query_id: str = "question_id", text: str = "text"
) -> DataFrame:
    """Weigh query texts with the corpus vocabulary; unknown terms drop out before scaling.

    Rows keep the term's df and idf, so that scoring need not join the vocabulary again.
    """
    spec = index.spec
    words = queries.select(*spec.scope, query_id, tokens(F.col(text), spec.stop_words).alias("_words"))
    counts = term_counts(words, spec, query_id)
    known = counts.join(index.vocabulary, [*spec.scope, "term"])
    weighted = known.select(*spec.scope, query_id, "term", "df", "idf", (F.col("tf") * F.col("idf")).alias("weight"))
    return normalised(weighted, [query_id])
