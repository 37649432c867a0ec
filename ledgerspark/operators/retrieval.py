"""Top-k text retrieval for a table of questions, and the evidence packs built from it."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark import constants as C
from ledgerspark.functions.text import contains_any
from ledgerspark.operators.index import StoredIndex, store_index, term_heads
from ledgerspark.operators.tfidf import TfidfIndex, evenly, query_vectors
from ledgerspark.sources.tables import scratch_table

# what rounding may take from a sum of products of unit vectors
TOLERANCE = 1e-9
# Postings left aside for each one read, from which finding documents by some terms first is worth it.
WORTH_SPLITTING = 2
# Postings of a block of questions, counted per question, up to which pairs are rows.
PAIR_ROWS = 5_000_000
# Postings that one task holds, some 60 bytes each, while it scores questions.
SHARD_ROWS = 2_000_000
# A term of at least one in so many of a shard's documents is held as a column of all of them.
COMMON = 4
# Postings summed and questions answered by one task, in a few seconds each.
PART_PAIRS = 200_000_000
PART_QUESTIONS = 20_000
# Tasks per core of one scoring; a shard's postings are sent to no more parts than this calls for.
TASKS_PER_CORE = 3
# Query-vector rows (about 60 bytes each) that are sent whole to every executor at a time.
BLOCK_ROWS = 3_000_000


def vector_rows_bound(queries: DataFrame, text: str, longest_ngram: int) -> int:
    """At most this many (question, term) rows: a term takes two characters and a separator.

    Needs the text lengths only, so the check costs one scan of the questions.
    """
    longest = F.sum(F.floor(F.length(text) / 3) + 1)
    return (queries.agg(longest).first()[0] or 0) * longest_ngram


def expand_query(text: Column, expansions: Mapping[str, str] = C.QUERY_EXPANSIONS) -> Column:
    """Separate letters from a following digit and append filing terms for common wording."""
    spaced = F.regexp_replace(text, r"(?<=[A-Za-z])(?=\d)", " ")
    lowered = F.lower(spaced)
    extra = [F.when(F.contains(lowered, F.lit(word)), F.lit(terms)) for word, terms in expansions.items()]
    return F.concat_ws(" ", spaced, *extra)


def needs_explanation(text: Column, terms=C.EXPLANATION_TERMS) -> Column:
    return contains_any(F.lower(text), terms)


def scores_of_pairs(pairs: DataFrame, vectors: DataFrame, index: StoredIndex, query_id: str = "question_id") -> DataFrame:
    """(scope…, doc, question, score): the cosine over the given terms of the given pairs.

    ``vectors`` (scope…, question, term, query_weight) is one block's and is sent to the executors; the
    corpus is read by bucket of the document, where the pairs come to it.
    """
    keys, doc = list(index.spec.scope), index.doc_id
    # a document id is of one scope; joined by it alone, the buckets serve
    met = index.forward.join(pairs.select(doc, query_id), doc)
    met = met.join(F.broadcast(vectors.select(*keys, query_id, "term", "query_weight")), [*keys, query_id, "term"])
    return met.groupBy(*keys, doc, query_id).agg(F.sum(F.col("weight") * F.col("query_weight")).alias("score"))


def asked_heads(vectors: DataFrame, index: StoredIndex) -> DataFrame:
    """The heads (see ``term_heads``) of the terms of a block of questions."""
    keys = [*index.spec.scope, "term"]
    asked = index.forward.join(F.broadcast(vectors.select(*keys).distinct()), keys)
    return term_heads(asked, index.spec, index.doc_id)


def first_guesses(
    vectors: DataFrame, heads: DataFrame, index: StoredIndex, k: int, query_id: str = "question_id"
) -> DataFrame:
    """(scope…, question, doc): documents that stand high in the heads of a question's terms."""
    keys, doc = list(index.spec.scope), index.doc_id
    heads = heads.join(F.broadcast(vectors), [*keys, "term"]).select(
        *keys, query_id, "query_weight", F.explode("postings").alias("p")
    )
    partial = heads.groupBy(*keys, query_id, F.col("p.doc").alias(doc)).agg(
        F.sum(F.col("query_weight") * F.col("p.weight")).alias("partial")
    )
    best = Window.partitionBy(query_id).orderBy(F.col("partial").desc(), F.col(doc).desc())
    return partial.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= 2 * k).drop("_n", "partial")


def split_terms(
    vectors: DataFrame, floors: DataFrame, heads: DataFrame, index: StoredIndex, query_id: str = "question_id"
) -> DataFrame:
    """``vectors`` (with ``df``) with ``essential``, ``rest`` and ``floor``.

    A term adds at most its weight times the largest weight of a document. Terms are summed from the
    smallest such bound; as long as the sum stays under the question's floor, a document that holds
    none of the other terms can't be a hit. ``rest`` is what the terms left aside may add together.
    """
    keys = list(index.spec.scope)
    known = vectors.join(heads.select(*keys, "term", "largest"), [*keys, "term"]).join(floors, query_id, "left")
    bound = known.withColumns(
        {"_bound": F.col("query_weight") * F.col("largest"), "floor": F.coalesce("floor", F.lit(0.0))}
    )
    smallest = Window.partitionBy(query_id).orderBy("_bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    summed = bound.withColumn("_sum", F.sum("_bound").over(smallest))
    split = summed.withColumn("essential", F.col("_sum") + TOLERANCE >= F.col("floor"))
    whole = Window.partitionBy(query_id)
    rest = F.coalesce(F.max(F.when(~F.col("essential"), F.col("_sum"))).over(whole), F.lit(0.0))
    return split.withColumn("rest", rest).select(
        *keys, query_id, "term", "query_weight", "essential", "rest", "floor", "df"
    )


def candidates(terms: DataFrame, index: StoredIndex, query_id: str = "question_id") -> DataFrame:
    """(scope…, doc, question, partial): documents whose essential terms leave a chance of a hit.

    The corpus stays in its buckets, no pair is shuffled, and what can't be a hit is dropped in place.
    """
    keys, doc = list(index.spec.scope), index.doc_id
    asked = F.broadcast(terms.filter("essential").drop("essential", "df"))
    pairs = index.forward.join(asked, [*keys, "term"])
    summed = pairs.groupBy(*keys, doc, query_id).agg(
        F.sum(F.col("weight") * F.col("query_weight")).alias("partial"), F.max("rest").alias("rest"), F.max("floor").alias("floor")
    )
    return summed.filter(F.col("partial") + F.col("rest") + TOLERANCE >= F.col("floor")).drop("rest", "floor")


def _largest(values: np.ndarray, k: int) -> float:
    """The k-th largest value."""
    if k > 8:
        return np.partition(values, len(values) - k)[-k]
    left = values.copy()
    for _ in range(k):
        at = left.argmax()
        least, left[at] = left[at], -np.inf
    return least


def best_of_shard(postings: pa.Table, asked: pa.Table, k: int, doc: str, query_id: str) -> pa.Table:
    """(doc, question, score) of each question's k best documents of one shard.

    ``postings`` holds (doc, term, weight) with numbered terms, ``asked`` a row per question with its
    terms and weights. Questions that weigh the same terms alike are summed once.
    """
    docs = postings[doc].combine_chunks()
    smallest_first = pc.unique(docs)
    smallest_first = smallest_first.take(pc.sort_indices(smallest_first))
    place = pc.index_in(docs, value_set=smallest_first).to_numpy()
    term, weight = postings["term"].to_numpy(), postings["weight"].to_numpy()
    order = np.argsort(term, kind="stable")
    term, place, weight = term[order], place[order].astype(np.int64), weight[order]
    lists = asked["terms"].combine_chunks()
    ends = np.cumsum(np.concatenate([[0], pc.list_value_length(lists).to_numpy()]))
    wanted, factors = lists.flatten().to_numpy(), asked["weights"].combine_chunks().flatten().to_numpy()
    low, high = np.searchsorted(term, wanted, "left"), np.searchsorted(term, wanted, "right")
    best: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}
    found, scores, questions = [], [], []
    size, spread, buffer = len(smallest_first), {}, np.empty(len(smallest_first))
    for q, (i, j) in enumerate(zip(ends[:-1], ends[1:])):
        key = wanted[i:j].tobytes(), factors[i:j].tobytes()
        if key not in best:
            spans = [(low[n], high[n], factors[n]) for n in range(i, j) if low[n] < high[n]]
            # a term of many documents is added as a whole column, in a fraction of its postings' time
            common = [s for s in spans if (s[1] - s[0]) * COMMON >= size]
            rare = [s for s in spans if (s[1] - s[0]) * COMMON < size] if common else spans
            at = np.concatenate([place[x:y] for x, y, _ in rare] or [place[:0]])
            parts = np.concatenate([weight[x:y] * f for x, y, f in rare] or [weight[:0]])
            if len(at) * 8 < size and not common:
                held, at = np.unique(at, return_inverse=True)
                sums = np.bincount(at, weights=parts, minlength=len(held))
            else:
                held, sums = None, np.bincount(at, weights=parts, minlength=size).astype(np.float64, copy=False)
                for x, y, f in common:
                    if x not in spread:
                        spread[x] = np.zeros(size)
                        np.add.at(spread[x], place[x:y], weight[x:y])
                    sums += np.multiply(spread[x], f, out=buffer)
            # weights are positive, so what was not met has the sum zero
            least = _largest(sums, k) if len(sums) > k else 0.0
            near = np.flatnonzero(sums >= least - TOLERANCE) if least > TOLERANCE else np.flatnonzero(sums)
            if len(near) > k:
                # the order of ``top_documents``: rounded scores, of equal ones the larger id
                near = near[np.lexsort((near, np.round(sums[near], 10)))][-k:]
            best[key] = near if held is None else held[near], sums[near]
        held, sums = best[key]
        found.append(held)
        scores.append(sums)
        questions.append(np.full(len(held), q))
    join = lambda parts, kind: np.concatenate(parts or [np.empty(0)]).astype(kind)
    return pa.table(
        {
            doc: smallest_first.take(pa.array(join(found, np.int64))),
            query_id: asked[query_id].take(pa.array(join(questions, np.int64))),
            "score": pa.array(join(scores, np.float64)),
        }
    )


def sharded_scores(vectors: DataFrame, index: StoredIndex, k: int, query_id: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(scope…, doc, question, score) of each question's k best documents of every shard of the corpus.

    The postings of the asked terms are dealt by document to shards of about ``shard_rows``, the
    questions to parts, and each task sums one shard for one part; no pair of a question and a document
    is a row.
    """
    spark, keys, doc = vectors.sparkSession, list(index.spec.scope), index.doc_id
    known = vectors.select(*keys, "term", "df").distinct()
    numbered = scratch_table(known.withColumn("_id", F.monotonically_increasing_id()))
    rows = numbered.agg(F.sum("df")).first()[0] or 0
    pairs, questions = vectors.agg(F.sum("df"), F.approx_count_distinct(query_id)).first()
    shards = max(1, math.ceil(rows / shard_rows))
    # a shard's postings are sent to each part, so there are no more than tasks or sums call for
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    wanted = min(tasks, math.ceil((pairs or 0) / PART_PAIRS + questions / PART_QUESTIONS))
    parts = max(1, math.ceil(wanted / shards))
    ids = numbered.drop("df")
    ids = F.broadcast(ids) if ids.count() <= BLOCK_ROWS else ids
    postings = index.forward.join(ids, [*keys, "term"]).select(doc, F.col("_id").alias("term"), "weight")
    tasks, number = shards * parts, lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    shard, part = F.pmod(F.xxhash64(doc), F.lit(shards)), F.pmod(F.xxhash64(query_id), F.lit(parts))
    dealt = postings.select("*", shard.alias("_s"), number(parts).alias("_p"))
    terms = F.sort_array(F.collect_list(F.struct("_id", "query_weight")))
    asked = vectors.join(ids, [*keys, "term"]).groupBy(*keys, query_id).agg(terms.alias("_t"))
    copied = asked.select(query_id, part.alias("_p"), number(shards).alias("_s"), F.col("_t._id").alias("terms"), F.col("_t.query_weight").alias("weights"))
    # by number, as tasks of few bytes are long here too and shall not be put together
    task = evenly(F.col("_s") * parts + F.col("_p"), tasks)
    left, right = (side.withColumn("task", task).drop("_s", "_p").repartition(tasks, "task") for side in (dealt, copied))
    kind = {t.name: t.dataType.simpleString() for t in (*index.forward.schema, *vectors.schema)}
    best = (
        left.groupBy("task")
        .cogroup(right.groupBy("task"))
        .applyInArrow(lambda p, a: best_of_shard(p, a, k, doc, query_id), f"`{doc}` {kind[doc]}, `{query_id}` {kind[query_id]}, score double")
    )
    return best.join(asked.select(*keys, query_id), query_id).select(*keys, doc, query_id, "score") if keys else best


def pruned_scores(
    queries: DataFrame, index: StoredIndex, k: int, query_id: str, text: str, pair_rows: int = PAIR_ROWS
) -> DataFrame:
    """(scope…, doc, question, score) of every document that may be among a question's k best.

    Where the questions' terms have over ``pair_rows`` postings, counted per question, see ``sharded_scores``.
    Else

    1. The heads of the question's terms give first guesses, whose exact scores set a floor: the k-th
       best of them is beaten or met by every hit.
    2. Terms that can't lift a document over the floor by themselves are left aside (the common ones,
       with most postings); documents are found by the essential ones only.
    3. What could still reach the floor with the terms left aside is scored over those too, from the
       side of the documents or of the terms, whichever has fewer rows.

    Where hardly any postings would be left aside, all terms are summed at once and only what reaches
    the floor goes on. Either way no more postings are read than a question's terms have.
    """
    vectors = stored_vectors(queries, index, query_id, text)
    if postings_of(vectors) > pair_rows:
        return sharded_scores(vectors, index, k, query_id)
    return split_scores(vectors, index, k, query_id)


def stored_vectors(queries: DataFrame, index: StoredIndex, query_id: str, text: str) -> DataFrame:
    """(scope…, question, term, query_weight, df), written once for the steps that read them."""
    weighed = query_vectors(queries, index, query_id, text).withColumnRenamed("weight", "query_weight")
    return scratch_table(weighed.select(*index.spec.scope, query_id, "term", "query_weight", "df"))


def postings_of(vectors: DataFrame) -> int:
    """Postings of the questions' terms, counted per question."""
    return vectors.agg(F.sum("df")).first()[0] or 0


def split_scores(vectors: DataFrame, index: StoredIndex, k: int, query_id: str) -> DataFrame:
    """Steps 1 to 3 of ``pruned_scores`` for one block of vectors, which are sent to the executors."""
    keys, doc = list(index.spec.scope), index.doc_id
    heads = scratch_table(asked_heads(vectors, index))
    guesses = scores_of_pairs(scratch_table(first_guesses(vectors, heads, index, k, query_id)), vectors, index, query_id)
    place = Window.partitionBy(query_id).orderBy(F.col("score").desc())
    floors = guesses.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") == k)
    floors = floors.select(query_id, F.col("score").alias("floor"))
    terms = scratch_table(split_terms(vectors, floors, heads, index, query_id))
    work = terms.groupBy("essential").agg(F.sum("df").alias("rows"))
    rows = {r["essential"]: r["rows"] for r in work.collect()}
    essential, aside = rows.get(True, 0), rows.get(False, 0)
    if aside < essential * WORTH_SPLITTING:
        whole = terms.withColumns({"essential": F.lit(True), "rest": F.lit(0.0)})
        return candidates(whole, index, query_id).withColumnRenamed("partial", "score")
    found = scratch_table(candidates(terms, index, query_id))
    rest = terms.filter("NOT essential")
    if found.count() * index.terms_per_document <= aside:
        added = scores_of_pairs(found, rest, index, query_id)
    else:
        every = candidates(rest.withColumns({"essential": F.lit(True), "floor": F.lit(0.0)}), index, query_id)
        added = every.join(found.select(doc, query_id), [doc, query_id], "left_semi").withColumnRenamed("partial", "score")
    parts = found.withColumnRenamed("partial", "score").unionByName(added)
    return parts.groupBy(*keys, doc, query_id).agg(F.sum("score").alias("score"))


def top_documents(scores: DataFrame, k: int, query_id: str, doc_id: str, decimals: int = 4) -> DataFrame:
    """The k best documents of each question; a window limit trims each task before the shuffle.

    Only documents that passed the question's floor come here, not every scored pair.

    Scores are compared after rounding to ten decimals, so the order does not depend on the order
    of additions; of equal scores the larger document id comes first.
    """
    best_first = Window.partitionBy(query_id).orderBy(F.round("score", 10).desc(), F.col(doc_id).desc())
    ranked = scores.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    return ranked.withColumn("retrieval_score", F.round("score", decimals)).drop("score")


def retrieve(
    questions: DataFrame,
    index: StoredIndex | TfidfIndex,
    k: int = 3,
    query_id: str = "question_id",
    text: str = "text",
    expand: Mapping[str, str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(scope…, question, doc, rank, retrieval_score) for the k most similar documents.

    Documents that share no term with a question are not listed. Questions of equal texts are answered
    once. Where their terms have many postings all are scored by shards, in one reading of the corpus.
    Else they are taken in blocks by hash, as many as keep a block's vectors under about ``block_rows``
    rows; a question's hits all come from its own block, so the result doesn't depend on their number.
    An index that isn't stored yet is written to a scratch folder first.
    """
    if not isinstance(index, StoredIndex):
        index = store_index(index)
    keys = list(index.spec.scope)
    asked, texts = distinct_questions(questions, keys, query_id, text)
    if expand is not None:
        texts = texts.withColumn(text, expand_query(F.col(text), expand))
    vectors = stored_vectors(texts, index, "_text_id", text)
    if postings_of(vectors) > PAIR_ROWS:
        scores = [sharded_scores(vectors, index, k, "_text_id")]
    else:
        blocks = max(1, math.ceil(vectors.count() / block_rows))
        place = F.pmod(F.xxhash64("_text_id"), F.lit(blocks))
        scores = [split_scores(vectors.filter(place == block), index, k, "_text_id") for block in range(blocks)]
    hits = union_all([top_documents(part, k, "_text_id", index.doc_id) for part in scores])
    return hits.join(asked, "_text_id").select(*keys, index.doc_id, query_id, "rank", "retrieval_score")


def distinct_questions(questions: DataFrame, keys: Sequence[str], query_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(question, _text_id) of every question, and (scope…, _text_id, text) of the different ones.

    Rows of one question are one question, as their terms are counted together; so questions are equal
    where their rows are, each as often.
    """
    told = questions.select(*keys, query_id, text).filter(F.col(text).isNotNull()).repartition(query_id)
    counted = told.groupBy(*keys, query_id, text).agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(text).alias("text"), "n")))
    whole = scratch_table(counted.groupBy(*keys, query_id).agg(rows.alias("_rows")))
    numbered = scratch_table(whole.select(*keys, "_rows").distinct().withColumn("_text_id", F.monotonically_increasing_id()))
    asked = whole.join(numbered, [*keys, "_rows"]).select(query_id, "_text_id")
    each = numbered.select(*keys, "_text_id", F.explode("_rows").alias("_r"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_r.n")))
    return asked, each.select(*keys, "_text_id", F.col("_r.text").alias(text), copies.alias("_n")).drop("_n")


def pad_hits(
    hits: DataFrame,
    questions: DataFrame,
    docs: DataFrame,
    k: int = 3,
    query_id: str = "question_id",
    doc_id: str = "doc_id",
    scope: Sequence[str] = (),
) -> DataFrame:
    """Fill the hits of every question up to k with documents of score zero, the largest ids first.

    Of each scope only its 2k largest ids are looked at: k at most of them are hits already.
    """
    last = Window.partitionBy(*scope, F.lit(0)).orderBy(F.col(doc_id).desc())
    ends = docs.select(*scope, doc_id).withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= 2 * k)
    if scope:
        lists = ends.groupBy(*scope).agg(F.collect_list(doc_id).alias("_ids"))
        asked = questions.select(*scope, query_id).join(lists, list(scope))
    else:
        ids = [r[0] for r in ends.select(doc_id).collect()]
        asked = questions.select(query_id, F.array(*[F.lit(i) for i in ids]).alias("_ids"))
    free = asked.select(*scope, query_id, F.explode("_ids").alias(doc_id)).join(hits, [query_id, doc_id], "left_anti")
    columns = [*scope, query_id, doc_id]
    every = hits.select(*columns, "rank", "retrieval_score").unionByName(
        free.select(*columns, F.lit(k + 1).alias("rank"), F.lit(0.0).alias("retrieval_score"))
    )
    order = Window.partitionBy(query_id).orderBy("rank", F.col(doc_id).desc())
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def attach_documents(hits: DataFrame, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Add the stored columns of the hit documents.

    Hits are written first: the planner then sees that they are few, and probes the corpus where it is
    instead of exchanging its texts.
    """
    extra = [c for c in docs.columns if c == doc_id or c not in hits.columns]
    return scratch_table(hits).join(docs.select(*extra), doc_id)


def _joined_blocks(hits: DataFrame, block: Column, query_id: str, name: str, passes: Column) -> DataFrame:
    """Join the blocks of each question in rank order; at most k rows per question."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    text = F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n")
    # the gate looks at the best hit as displayed, that is rounded
    return hits.filter(passes).groupBy(query_id).agg(
        text.alias(name), F.max("retrieval_score").alias("best_score")
    ).filter(F.col("best_score") > 0)


def mda_context(hits: DataFrame, query_id: str = "question_id", chunk_id: str = "chunk_id") -> DataFrame:
    """Labelled [M1], [M2]… blocks of management discussion per question that asks for reasons.

    ``hits`` holds rank, retrieval_score, chunk id, chunk text and the question in ``question``.
    """
    block = F.concat(
        F.lit("[M"),
        F.col("rank").cast("string"),
        F.lit("] Item 7. MD&A, retrieved chunk "),
        F.col(chunk_id).cast("string"),
        F.lit("\n"),
        F.col("text"),
    )
    return _joined_blocks(hits, block, query_id, "context", needs_explanation(F.col("question")))


def risk_evidence(hits: DataFrame, query_id: str = "question_id", chunk_id: str = "chunk_id") -> DataFrame:
    """Labelled [1], [2]… blocks of risk excerpts per question."""
    block = F.concat(
        F.lit("["),
        F.col("rank").cast("string"),
        F.lit("] Topic: "),
        F.col("topic_label"),
        F.lit("\nChunk ID: "),
        F.col(chunk_id).cast("string"),
        F.lit("\nSEC excerpt:\n"),
        F.col("text"),
    )
    return _joined_blocks(hits, block, query_id, "evidence", F.lit(True))


def evidence_preview(hits: DataFrame, characters: int = C.PREVIEW_CHARACTERS) -> DataFrame:
    """Listing form of the hits: the whole text stays, with a shortened preview beside it."""
    return hits.withColumn("preview", F.left("text", F.lit(characters)))


def cited_labels(text: Column, labels: Column) -> Column:
    """The labels that occur in a text, in the order of ``labels``."""
    return F.filter(labels, lambda label: F.contains(text, label))


def citation_labels(count: int, prefix: str = "") -> Column:
    return F.array(*[F.lit(f"[{prefix}{i}]") for i in range(1, count + 1)])


def reference_list(
    answers: DataFrame,
    hits: DataFrame,
    metadata: DataFrame,
    query_id: str = "question_id",
    prefix: str = "",
) -> DataFrame:
    """Reference lines for the evidence an answer cites, and the filing they come from.

    ``answers`` has (question, filing_id, answer), ``hits`` (question, rank, source_title) and
    ``metadata`` one row per filing.
    """
    label = F.concat(F.lit(f"[{prefix}"), F.col("rank").cast("string"), F.lit("]"))
    cited = (
        answers.join(hits.select(query_id, "rank", "source_title"), query_id)
        .filter(F.contains("answer", label))
        .join(metadata.select("filing_id", "company", "form"), "filing_id", "left")
        .select(
            query_id,
            "rank",
            # what isn't known of the filing is left out of the line
            F.concat_ws(
                " — ", F.concat_ws(" ", label, F.col("company"), F.col("form")), F.col("source_title")
            ).alias("line"),
        )
    )
    lines = F.array_sort(F.collect_list(F.struct("rank", "line")))
    listed = cited.groupBy(query_id).agg(
        F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("reference_lines")
    )
    source = F.concat(
        F.col("company"), F.lit(" "), F.col("form"), F.lit(", filed "), F.col("filing_date"), F.lit("\n"), F.col("source_url")
    )
    return (
        answers.join(metadata, "filing_id", "left")
        .join(listed, query_id, "left")
        .select(
            query_id,
            F.coalesce("reference_lines", F.lit("")).alias("reference_lines"),
            source.alias("filing_source"),
        )
    )


def explained_references(
    answers: DataFrame, hits: DataFrame, metadata: DataFrame, query_id: str = "question_id"
) -> DataFrame:
    """Answers that explain figures, with their references: [F1] always, then each [Mn] they cite.

    ``answers`` has (question, filing_id, answer), ``hits`` (question, rank) and ``metadata`` one row per
    filing. Returns (question, reference_lines, referenced_answer). What isn't known of a filing is
    left out; an answer without hits lists the statements only.
    """
    found = hits.groupBy(query_id).agg(F.max("rank").alias("_hits"))
    known = answers.join(metadata.select("filing_id", "company", "form", "filing_date", "source_url"), "filing_id", "left")
    joined = known.join(found, query_id, "left")
    filing = lambda label: F.concat_ws(" ", label, F.col("company"), F.col("form"))
    filed = F.concat(F.lit(", filed "), F.col("filing_date"))
    statements = F.concat(filing(F.lit("[F1]")), F.lit(f" — {C.STATEMENTS_TITLE}"), F.coalesce(filed, F.lit("")))
    ranks = F.slice(F.sequence(F.lit(0), F.coalesce("_hits", F.lit(0))), 2, F.greatest(F.coalesce("_hits", F.lit(0)), F.lit(0)))
    labels = F.transform(ranks, lambda n: F.concat(F.lit("[M"), n.cast("string"), F.lit("]")))
    cited = F.transform(
        cited_labels(F.col("answer"), labels), lambda label: F.concat(filing(label), F.lit(f" — {C.MDA_TITLE}"))
    )
    lines = F.array_join(F.concat(F.array(statements), cited), "\n")
    text = F.concat_ws("\n", F.concat(F.col("answer"), F.lit(f"\n\n{C.REFERENCES_HEADING}")), "reference_lines", "source_url")
    return joined.withColumn("reference_lines", lines).select(query_id, "reference_lines", text.alias("referenced_answer"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
