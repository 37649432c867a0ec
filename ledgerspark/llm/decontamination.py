"""Benchmark decontamination: BM25 with block-max WAND over test items, then overlap of the parts.

The inverted index holds the benchmark, not the corpus. Every passage of every document queries it:
overlapping windows twice as long as the longest item, so that any copy of an item lies whole in one.
Scores are BM25 divided by the score of the item's own text, so one threshold serves all items.

Pruning is exact. Per item the terms of least impact are non-essential and have no postings; the rest of
an item's bound must come from its essential terms, whose impacts are scaled so that every item needs a
sum of 1. A posting list keeps its greatest impact and that of each block of postings. Per passage the
lists of its terms are walked together: items before the pivot, where greatest impacts first add up to 1,
are skipped, and so are stretches whose blocks don't reach it.
Retrieved items are reported if the passage also holds enough of their question and their answer.

Items of fewer than five words say too little for a score. They are reported where whole sentences or
lines of a text say exactly their words.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import map_texts

TERM = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=\S)")
K1, B = 1.2, 0.75
MIN_SCORE, MIN_QUESTION, MIN_ANSWER = 0.6, 0.5, 0.5
OPENED_LATE = 0.5
SHINGLE, MIN_WORDS = 5, 5
SHARD_BYTES = 8 << 20
BLOCK = 64
# sums of scaled impacts are compared a rounding error below 1; scores are computed anew after that
NEEDED = 1 - 1e-9

_built: dict[str, "Index"] = {}


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


def parts(text: str) -> tuple[str, str]:
    """Question and answer: the last line answers the ones before it; of one line the last sentence."""
    lines = [line for line in text.split("\n") if line.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    sentences = SENTENCE_END.split(text.strip())
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, "")


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Item:
    """One test item: normalised impacts, the bound of its late terms, and its parts."""

    def __init__(self, item_id, text: str, words: list[str], inverse: dict[str, float], mean_length: float):
        self.item_id = item_id
        lengthy = K1 * (1 - B + B * len(words) / mean_length)
        impact = {w: inverse[w] * n * (K1 + 1) / (n + lengthy) for w, n in Counter(words).items()}
        total = sum(impact.values())
        self.impact = {w: v / total for w, v in impact.items()}
        self.late, self.essential = 0.0, {}
        for w, v in sorted(self.impact.items(), key=lambda x: (x[1], x[0])):
            if not self.essential and self.late + v < OPENED_LATE * MIN_SCORE:
                self.late += v
            else:
                self.essential[w] = v
        question, answer = parts(text)
        asked = terms(question)
        # what only the answer says, unless it says nothing of its own
        said = set(terms(answer))
        self.question, self.answer = shingles(asked), said - set(asked) or said

    def overlaps(self, passage: list[str]) -> tuple[float, float]:
        held = shingles(passage)
        # a question of fewer words than a shingle is one shorter run
        if len(self.question) == 1 and len(one := next(iter(self.question))) < SHINGLE:
            held = shingles(passage, len(one))
        question = len(self.question & held) / len(self.question) if self.question else 1.0
        answer = len(self.answer & set(passage)) / len(self.answer) if self.answer else 1.0
        return question, answer


class Postings:
    """Items of one term in order, their scaled impacts, and the greatest of all and of each block."""

    __slots__ = ("items", "impacts", "tops", "top")

    def __init__(self, postings: list[tuple[int, float]]):
        self.items = [i for i, _ in postings]
        self.impacts = [v for _, v in postings]
        self.tops = [max(self.impacts[at : at + BLOCK]) for at in range(0, len(postings), BLOCK)]
        self.top = max(self.tops)


def retrieve(lists: list[Postings]) -> list[int]:
    """Items whose impacts in ``lists`` add up to 1, by block-max WAND."""
    found = []
    # (item, place in the list, number of the list): where each list stands
    stands = [(held.items[0], 0, n) for n, held in enumerate(lists)]
    while True:
        stands.sort()
        bound, last = 0.0, -1
        for last, (_, _, n) in enumerate(stands):
            bound += lists[n].top
            if bound >= NEEDED:
                break
        if bound < NEEDED:
            return found
        pivot = stands[last][0]
        while last + 1 < len(stands) and stands[last + 1][0] == pivot:
            last += 1
        front = [(bisect_left(lists[n].items, pivot, at), n) for _, at, n in stands[: last + 1]]
        front = [(at, n) for at, n in front if at < len(lists[n].items)]
        goal = pivot
        if sum(lists[n].tops[at // BLOCK] for at, n in front) >= NEEDED:
            on_pivot = [lists[n].impacts[at] for at, n in front if lists[n].items[at] == pivot]
            if sum(on_pivot) >= NEEDED:
                found.append(pivot)
            goal = pivot + 1
        else:
            # no item reaches it before one of these blocks ends or another list joins in
            ends = [lists[n].items[min((at // BLOCK + 1) * BLOCK, len(lists[n].items)) - 1] + 1 for at, n in front]
            goal = min(ends + [s[0] for s in stands[last + 1 : last + 2]])
        moved = [(bisect_left(lists[n].items, goal, at), n) for at, n in front]
        stands = stands[last + 1 :] + [(lists[n].items[at], at, n) for at, n in moved if at < len(lists[n].items)]


class Index:
    """Inverted lists of the essential terms of one shard of the benchmark, and its short items."""

    def __init__(self, items: list[tuple], frequency: dict[str, int], n_items: int, mean_length: float):
        inverse = {w: math.log(1 + (n_items - n + 0.5) / (n + 0.5)) for w, n in frequency.items()}
        self.items = []
        self.short: dict[tuple[str, ...], list[Item]] = defaultdict(list)
        longest = SHINGLE
        for item_id, text in items:
            words = terms(text)
            if not words:
                continue
            item = Item(item_id, text, words, inverse, mean_length)
            if len(words) < MIN_WORDS:
                self.short[tuple(words)].append(item)
                continue
            self.items.append(item)
            longest = max(longest, len(words))
        self.step, self.width = longest, 2 * longest
        held: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, item in enumerate(self.items):
            for w, v in item.essential.items():
                held[w].append((i, v / (MIN_SCORE - item.late)))
        self.lists = {w: Postings(postings) for w, postings in held.items()}

    def search(self, text: str | None) -> list[tuple[Item, float, float, float]]:
        """(item, score, question, answer) of every item found in a passage, at its best passage."""
        words = terms(text)
        lists = self.lists
        passages: dict[int, set[str]] = defaultdict(set)
        for at, w in enumerate(words):
            if w in lists:
                p = at // self.step
                passages[p].add(w)
                if p:
                    passages[p - 1].add(w)
        best: dict[int, tuple[float, float, float]] = {}
        for p in sorted(passages):
            for i in retrieve([lists[w] for w in passages[p]]):
                item = self.items[i]
                passage = words[p * self.step : p * self.step + self.width]
                score = sum(item.impact[w] for w in item.impact.keys() & set(passage))
                if score < MIN_SCORE or (i in best and score <= best[i][0]):
                    continue
                question, answer = item.overlaps(passage)
                if question >= MIN_QUESTION and answer >= MIN_ANSWER:
                    best[i] = (score, question, answer)
        return [(self.items[i], *scores) for i, scores in best.items()] + self._short_items(text)

    def _short_items(self, text: str | None) -> list[tuple[Item, float, float, float]]:
        if not self.short or not text:
            return []
        sentences = (terms(x) for line in text.split("\n") for x in SENTENCE_END.split(line))
        said = [words for words in sentences if words]
        found = set()
        for at in range(len(said)):
            run: tuple[str, ...] = ()
            for words in said[at : at + MIN_WORDS]:
                run += tuple(words[:MIN_WORDS])
                if len(run) >= MIN_WORDS:
                    break
                if run in self.short:
                    found.add(run)
        return [(item, 1.0, 1.0, 1.0) for run in sorted(found) for item in self.short[run]]


def shards(benchmark: DataFrame, id_column: str, text_column: str, shard_bytes: int) -> Iterable[Callable[[], Index]]:
    """Loaders of the index, shard by shard; a shard holds about ``shard_bytes`` of items.

    Document frequencies and lengths are those of the whole benchmark.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / shard_bytes))
    items = items.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(n)))

    def tokens(batch: pa.RecordBatch) -> list[dict]:
        return [
            {"shard": s, "term": w, "first": i == 0, "n": len(words)}
            for s, words in zip(batch["shard"].to_pylist(), map(terms, batch["text"].to_pylist()))
            for i, w in enumerate(dict.fromkeys(words))
        ]

    held = map_texts(items, "text", tokens, "shard bigint, term string, first boolean, n bigint")
    n_items, length = held.filter("first").agg(F.count("*"), F.avg("n")).first()
    frequency = held.groupBy("term").agg(F.count("*").alias("n"))
    for shard in range(n):
        rows = items.filter(F.col("shard") == shard).select("id", "text").collect()
        own = held.filter(F.col("shard") == shard).select("term").distinct()
        counts = {r["term"]: r["n"] for r in (frequency.join(own, "term") if n > 1 else frequency).collect()}
        sent = spark.sparkContext.broadcast(([(r["id"], r["text"] or "") for r in rows], counts, n_items, length or 1.0))
        yield _loader(sent)


def _loader(sent) -> Callable[[], Index]:
    key = uuid.uuid4().hex

    def load() -> Index:
        if key not in _built:
            _built.clear()
            _built[key] = Index(*sent.value)
        return _built[key]

    return load


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap): every test item found in a document.

    One row per document row and item, at the item's best passage; repeated documents or items are
    reported each. NULL and empty texts hold nothing, and items without a word are never reported; a
    short item has score and overlaps of 1. Very long texts are searched passage by passage to their end.
    No rows come from an empty table on either side; other columns are ignored. The benchmark is
    searched in shards of bounded size, each of which is broadcast; the corpus is never shuffled.
    """
    source = documents.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    id_kind = source.schema["id"].dataType.simpleString()
    item_kind = benchmark.schema[item_id_column].dataType.simpleString()
    schema = f"id {id_kind}, item {item_kind}, score double, question_overlap double, answer_overlap double"

    def searching(load: Callable[[], Index]) -> Callable[[pa.RecordBatch], list[dict]]:
        def body(batch: pa.RecordBatch) -> list[dict]:
            index = load()
            return [
                {"id": key, "item": item.item_id, "score": s, "question_overlap": q, "answer_overlap": a}
                for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist())
                for item, s, q, a in index.search(text)
            ]

        return body

    found = None
    for load in shards(benchmark, item_id_column, item_text_column, shard_bytes):
        part = map_texts(source, "text", searching(load), schema)
        found = part if found is None else found.unionByName(part)
    return found.select(
        F.col("id").alias(id_column), F.col("item").alias(item_id_column), "score", "question_overlap", "answer_overlap"
    )


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``documents`` without the rows that hold a test item; columns, repeats and NULL texts stay.

    Very long texts are searched to their end; an empty benchmark leaves all rows, and an empty table
    stays empty.
    """
    columns = documents.columns
    names = [f"c{i}" for i in range(len(columns))]
    text = names[columns.index(text_column)]
    kept = documents.toDF(*names)
    schema = kept.schema

    def cleaning(load: Callable[[], Index]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def body(batch: pa.RecordBatch) -> pa.RecordBatch:
            index = load()
            return batch.filter(pa.array([not index.search(t) for t in batch[text].to_pylist()], pa.bool_()))

        return body

    for load in shards(benchmark, item_id_column, item_text_column, shard_bytes):
        kept = map_texts(kept, text, cleaning(load), schema)
    return kept.toDF(*columns)
