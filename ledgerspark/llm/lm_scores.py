"""Language-model scores: stupid backoff over bigram counts of the whole corpus.

The probability of a word after another is c(v w) / c(v) if the pair is known, else 0.4 c(w) / N. Counts
are those of all *other* documents, so a text does not vouch for itself, and repeats within a text do
not either.

Documents are dealt to blocks by hash. A block sends each of its distinct words and pairs once, as a
64-bit hash with its count in the block, packed into one row per partition of the count table; a
partition adds the counts of equal hashes and returns the totals in the order it got the hashes. A
block then joins them to its documents' words and sums per document. Frequent words cost one entry per
block, so no key is hot, and both tables grow in parts of bounded size.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import reachable

BACKOFF = 0.4
UNSEEN = 0.5
BLOCK_BYTES = 12 << 20
PART_BYTES = 32 << 20
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class WordHashes(dict):
    """64-bit hashes of words, worked out once per block."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of the texts in order, and where each text begins."""
    known, hashes, begins = WordHashes(), [], [0]
    for text in texts:
        # words are parted by ASCII white space
        words = (text or "").lower().encode().split()
        hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        begins.append(begins[-1] + len(words))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.array(begins)


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """A hash for each word and its successor."""
    a, b = words[:-1], words[1:]
    x = (a * MIX[0]) ^ ((b << np.uint64(31) | b >> np.uint64(33)) * MIX[1])
    return x ^ (x >> np.uint64(29))


class Grams:
    """Distinct words and pairs of a block, and where its documents use them."""

    def __init__(self, texts: list[str | None], parts: int):
        words, self.begins = word_hashes(texts)
        inside = np.ones(max(0, len(words) - 1), bool)
        edges = self.begins[1:-1]
        inside[edges[(edges > 0) & (edges < len(words))] - 1] = False  # no pair crosses texts
        self.pair_at = np.nonzero(inside)[0]
        pairs = pair_hashes(words)[self.pair_at] if len(words) > 1 else np.zeros(0, np.uint64)
        self.words, self.word_of, self.word_n = np.unique(words, return_inverse=True, return_counts=True)
        self.pairs, self.pair_of, self.pair_n = np.unique(pairs, return_inverse=True, return_counts=True)
        self.parts = parts

    def packed(self) -> list[tuple[int, int, bytes, bytes]]:
        """(part, order, hashes, counts): sorted hashes of each part of the count table."""
        out = []
        for order, hashes, counts in ((1, self.words, self.word_n), (2, self.pairs, self.pair_n)):
            part = hashes % np.uint64(self.parts)
            place = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[place], np.arange(self.parts + 1, dtype=np.uint64))
            for p, (b, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                if e > b:
                    at = place[b:e]
                    out.append((p, order, hashes[at].tobytes(), zlib.compress(counts[at].astype("<u4").tobytes(), 1)))
        return out

    def totals(self, rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of the block's words and pairs from the rows its parts sent back."""
        word, pair = np.zeros(len(self.words), np.int64), np.zeros(len(self.pairs), np.int64)
        for order, hashes, into in ((1, self.words, word), (2, self.pairs, pair)):
            part = hashes % np.uint64(self.parts)
            place = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[place], np.arange(self.parts + 1, dtype=np.uint64))
            for p, o, data in rows:
                if o == order:
                    into[place[cuts[p] : cuts[p + 1]]] = np.frombuffer(zlib.decompress(data), "<i8")
        return word, pair


def document_scores(grams: Grams, word_total: np.ndarray, pair_total: np.ndarray, n_words: int) -> list[tuple]:
    """(words, log score) of every text of a block."""
    begins = grams.begins
    docs = len(begins) - 1
    doc_of = np.repeat(np.arange(docs), np.diff(begins))

    def others(index: np.ndarray, doc: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Counts outside the own document, per use."""
        key = doc * np.int64(max(1, len(totals))) + index
        _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
        return totals[index] - own[inverse]

    word = others(grams.word_of, doc_of, word_total)
    rest = n_words - np.diff(begins)[doc_of]
    logs = np.log(np.maximum(word, UNSEEN)) - np.log(np.maximum(rest, 1))
    score = logs + math.log(BACKOFF)
    score[begins[:-1][np.diff(begins) > 0]] -= math.log(BACKOFF)  # a first word has no history
    at = grams.pair_at
    pair = others(grams.pair_of, doc_of[at], pair_total)
    known = pair > 0
    history = word[at][known]
    score[at[known] + 1] = np.log(pair[known]) - np.log(np.maximum(history, 1))
    sums = np.zeros(docs)
    np.add.at(sums, doc_of, score)
    return list(zip(np.diff(begins).tolist(), sums.tolist()))


def add_counts(rows: list[tuple[int, int, bytes, bytes]]) -> list[tuple[int, int, bytes]]:
    """(block, order, totals) for the (block, order, hashes, counts) that one part received."""
    out = []
    for order in (1, 2):
        own = [(b, np.frombuffer(h, np.uint64), np.frombuffer(zlib.decompress(c), "<u4")) for b, o, h, c in rows if o == order]
        if not own:
            continue
        hashes = np.concatenate([h for _, h, _ in own])
        distinct, inverse = np.unique(hashes, return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate([c for _, _, c in own]), minlength=len(distinct))
        back = totals.astype("<i8")[inverse]
        at = 0
        for block, h, _ in own:
            out.append((block, order, zlib.compress(back[at : at + len(h)].tobytes(), 1)))
            at += len(h)
    return out


def backoff_scores(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_bytes: int = BLOCK_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(id, n_words, log_score, mean_log_score) of every row of ``df``.

    One row per row, repeated rows included: copies count as other documents. A NULL or empty text has
    no words, score 0 and a NULL mean. An empty table gives an empty result; other columns are ignored.
    """
    size, rows = df.agg(F.sum(F.octet_length(f"`{text_column}`")), F.count("*")).first()
    blocks = max(1, math.ceil((size or 0) / block_bytes))
    # a byte of text makes about two bytes of hashes
    parts = max(1, math.ceil(2 * (size or 0) / part_bytes))
    texts = reachable(df).select(
        F.pmod(F.xxhash64(f"`{id_column}`", f"`{text_column}`"), F.lit(blocks)).cast("int").alias("block"),
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{text_column}`").alias("text"),
    )
    id_kind = texts.schema["id"].dataType.simpleString()

    def send(key: tuple, table: pa.Table) -> pa.Table:
        grams = Grams(table["text"].to_pylist(), parts)
        block = key[0].as_py()
        out = [(p, block, o, h, c, 0) for p, o, h, c in grams.packed()]
        # the number of words of the block goes to every part, and from there to every block
        total = int(grams.begins[-1])
        out += [(p, block, 0, b"", b"", total) for p in range(parts)]
        return pa.Table.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))],
            names=["part", "block", "order", "hashes", "counts", "n"],
        )

    def add(key: tuple, table: pa.Table) -> pa.Table:
        columns = [table[c].to_pylist() for c in ("block", "order", "hashes", "counts", "n")]
        n_words = sum(n for o, n in zip(columns[1], columns[4]) if o == 0)
        part = key[0].as_py()
        out = [(b, part, o, data, n_words) for b, o, data in add_counts([r[:4] for r in zip(*columns) if r[1]])]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        return pa.Table.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, kinds)],
            names=["block", "part", "order", "totals", "n"],
        )

    def score(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
        grams = Grams(docs["text"].to_pylist(), parts)
        rows = list(zip(*(counts[c].to_pylist() for c in ("part", "order", "totals"))))
        n_words = counts["n"][0].as_py() if len(counts) else 0
        scored = document_scores(grams, *grams.totals(rows), n_words)
        return pa.Table.from_arrays(
            [
                docs["id"],
                pa.array([n for n, _ in scored], pa.int64()),
                pa.array([s for _, s in scored], pa.float64()),
            ],
            names=["id", "n_words", "log_score"],
        )

    # both readers of the texts share this exchange
    dealt = texts.repartition(blocks, "block")
    sent = dealt.groupBy("block").applyInArrow(
        send, "part int, block int, order int, hashes binary, counts binary, n bigint"
    )
    counted = (
        sent.repartition(parts, "part")
        .groupBy("part")
        .applyInArrow(add, "block int, part int, order int, totals binary, n bigint")
    )
    scored = (
        dealt.groupBy("block")
        .cogroup(counted.repartition(blocks, "block").groupBy("block"))
        .applyInArrow(score, f"id {id_kind}, n_words bigint, log_score double")
    )
    return scored.select(
        F.col("id").alias(id_column),
        "n_words",
        "log_score",
        F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"),
    )
