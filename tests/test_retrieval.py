import math
import random
import re
from collections import Counter

import pytest

from ledgerspark import constants as C
from ledgerspark.operators import retrieval, tfidf
from ledgerspark.operators.index import open_index, store_index
from queries import text as text_queries
from pyspark.sql import functions as F

DOCS = [
    (1, "a", "Net sales grew because services sales grew."),
    (2, "a", "Foreign currency lowered net sales; the dollar rose."),
    (3, "b", "Suppliers and tariffs: supply chain trade, net."),
    (4, "b", "the of and"),
    (5, "b", "Suppliers and tariffs: supply chain trade, net."),
]
QUESTIONS = [(1, "a", "Why did net sales grow?"), (2, "b", "supply chain tariffs"), (3, "b", "zebra")]


def terms(text):
    words = [w for w in re.findall(r"\w{2,}", text.lower()) if w not in C.STOP_WORDS]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def vectors(texts, idf):
    out = []
    for text in texts:
        raw = {t: n * idf[t] for t, n in terms(text).items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out.append({t: w / norm for t, w in raw.items()})
    return out


def brute_force(docs, queries, k):
    """Rank every pair directly."""
    df = Counter(t for _, text in docs for t in terms(text))
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}
    weights = vectors([text for _, text in docs], idf)
    hits = {}
    for (qid, text), q in zip(queries, vectors([t for _, t in queries], idf)):
        scored = [(round(sum(q[t] * d.get(t, 0) for t in q), 10), doc_id) for (doc_id, _), d in zip(docs, weights)]
        best = sorted([s for s in scored if s[0] > 0], reverse=True)[:k]
        hits[qid] = [(doc_id, round(score, 4)) for score, doc_id in best]
    return hits


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id int, scope string, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUESTIONS, "question_id int, scope string, text string")


def hit_map(df):
    out = {}
    for r in df.orderBy("question_id", "rank").collect():
        out.setdefault(r["question_id"], []).append((r["doc_id"], r["retrieval_score"]))
    return out


def test_vectors_have_unit_length(docs):
    lengths = tfidf.fit_tfidf(docs).weights.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n"))
    rows = lengths.collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 5} and all(r["n"] == pytest.approx(1) for r in rows)


@pytest.mark.parametrize("block_rows", [1_000_000, 20])
def test_matches_brute_force(docs, queries, block_rows):
    index = tfidf.fit_tfidf(docs.drop("scope"))
    found = hit_map(retrieval.retrieve(queries.drop("scope"), index, 3, block_rows=block_rows))
    expected = brute_force([(d, t) for d, _, t in DOCS], [(q, t) for q, _, t in QUESTIONS], 3)
    assert found == {q: h for q, h in expected.items() if h}


def test_scopes_are_separate_corpora(docs, queries):
    index = tfidf.fit_tfidf(docs, tfidf.TfidfSpec(scope=("scope",)))
    found = hit_map(retrieval.retrieve(queries, index, 3))
    expected = {}
    for scope in ("a", "b"):
        expected |= brute_force([(d, t) for d, s, t in DOCS if s == scope], [(q, t) for q, s, t in QUESTIONS if s == scope], 3)
    assert found == {q: h for q, h in expected.items() if h}


def random_corpus(seed, n_docs=300, n_queries=40):
    """Zipf-like words, copies of documents, and words that every document holds."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    odds = [1 / (i + 1) for i in range(120)]
    text = lambda n: "every " + " ".join(rng.choices(words, odds, k=n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[0][1]) for i in range(30)] + [(999, "w0"), (1000, "the of")]
    queries = [(i, text(rng.randint(0, 12))) for i in range(n_queries)] + [(777, docs[0][1]), (778, "w119 w118"), (779, "nothing known")]
    return docs, queries


@pytest.fixture(scope="module")
def random_index(spark):
    docs, _ = random_corpus(1)
    return store_index(tfidf.fit_tfidf(spark.createDataFrame(docs, "doc_id int, text string")), buckets=4)


@pytest.mark.parametrize("k", [1, 3, 40])
def test_pruned_hits_match_brute_force(spark, random_index, k):
    docs, queries = random_corpus(1)
    found = hit_map(retrieval.retrieve(spark.createDataFrame(queries, "question_id int, text string"), random_index, k))
    expected = brute_force(docs, queries, k)
    assert found == {q: h for q, h in expected.items() if h}


def test_common_terms_are_left_aside(spark, random_index):
    """Fewer than half of the pairs that share a term are scored, in a corpus of few and common words."""
    docs, queries = random_corpus(1)
    asked = spark.createDataFrame(queries, "question_id int, text string")
    vectors = tfidf.query_vectors(asked, random_index).withColumnRenamed("weight", "query_weight").drop("idf")
    sharing = random_index.forward.join(vectors, "term").select("doc_id", "question_id").distinct().count()
    kept = retrieval.pruned_scores(asked, random_index, 3, "question_id", "text").count()
    assert sharing > 10_000 and kept < sharing / 2


def joined_by_exchange(df):
    """Exchanges of the executed plan that aren't broadcasts, below its last aggregation."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def test_stored_corpus_is_not_exchanged(spark, random_index):
    rows = [(1, "every", 0.5, True, 0.0, 0.0), (1, "w3", 0.5, False, 0.0, 0.0)]
    terms = spark.createDataFrame(rows, "question_id int, term string, query_weight double, essential boolean, rest double, floor double")
    found = retrieval.candidates(terms, random_index)
    assert joined_by_exchange(found) == []
    assert joined_by_exchange(retrieval.scores_of_pairs(found, terms, random_index)) == []
    # pairs that come from elsewhere are dealt to the corpus' buckets, not the corpus to them
    pairs = spark.createDataFrame([(5, 1)], "doc_id int, question_id int")
    plan = retrieval.scores_of_pairs(pairs.hint("merge"), terms, random_index)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "Bucketed: true" in plan


def test_index_is_shared_and_opened_again(spark, docs, queries, tmp_path):
    stored = store_index(tfidf.fit_tfidf(docs.drop("scope")), str(tmp_path / "index"), buckets=3)
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("tfidf_") and not t.isTemporary]
    first = hit_map(retrieval.retrieve(queries.drop("scope"), stored))
    for name in names:  # as in another session; the files stay
        if spark.sql(f"DESCRIBE FORMATTED {name}").filter(f"data_type LIKE '%{tmp_path.name}%'").count():
            spark.sql(f"DROP TABLE {name}")
    again = open_index(spark, str(tmp_path / "index"))
    assert hit_map(retrieval.retrieve(queries.drop("scope"), again)) == first
    assert vars(again.spec) | {"stop_words": ()} == vars(stored.spec) | {"stop_words": ()}
    assert "SelectedBucketsCount: 3 out of 3" in again.forward.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()


def test_two_queries_share_one_fit(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(text_queries, "store_index", lambda index: calls.append(1) or store_index(index))
    monkeypatch.setattr(text_queries, "_STORED", {})
    text_queries.tfidf_vectors(spark, "/root/testdata/sf0.001")
    text_queries.retrieve_topk(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_a_term_of_every_document_is_not_one_task(spark, monkeypatch, broadcast):
    """Terms of over five documents are broadcast or salted; weights stay the same."""
    monkeypatch.setattr(tfidf, "BROADCAST_TERMS", broadcast)
    texts, _ = random_corpus(2)
    index = tfidf.fit_tfidf(spark.createDataFrame(texts, "doc_id int, text string"))
    counts, vocabulary = index.counts.cache(), index.vocabulary.cache()
    split = tfidf.weighted_without_skew(counts, vocabulary, index.spec, hot_df=5)
    rounded = lambda df: sorted((r.doc_id, r.term, round(r.weight, 9)) for r in df.collect())
    assert rounded(split) == rounded(tfidf.weighted_counts(counts, vocabulary, index.spec))
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert ("_salt" in plan) == (broadcast == 0)
    if not broadcast:
        rows = counts.filter("term = 'every'").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(67))).groupBy("salt").count()
        assert rows.count() > 40 and rows.agg(F.max("count")).first()[0] < 20


def test_bound_covers_all_terms(queries):
    words = tfidf.document_words(queries, tfidf.TfidfSpec(stop_words=()), "question_id")
    rows = tfidf.term_counts(words, tfidf.TfidfSpec(stop_words=()), "question_id").count()
    assert retrieval.vector_rows_bound(queries, "text", 2) >= rows


def test_expansion(spark):
    df = spark.createDataFrame([("Why did iPhone15 revenue and cash flow fall?",), ("None",)], "t string")
    got = [r[0] for r in df.select(retrieval.expand_query(F.col("t"))).collect()]
    assert got == [
        "Why did iPhone 15 revenue and cash flow fall? net sales sales cash generated by operating activities liquidity iPhone net sales",
        "None",
    ]


def test_context_needs_a_reason_and_a_score(spark):
    rows = [
        (1, "Why?", 2, 20, 0.2, "second"),
        (1, "Why?", 1, 10, 0.5, "first"),
        (2, "What?", 1, 10, 0.5, "first"),
        (3, "Why so?", 1, 10, 0.0, "first"),
    ]
    hits = spark.createDataFrame(rows, "question_id int, question string, rank int, chunk_id int, retrieval_score double, text string")
    got = retrieval.mda_context(hits).collect()
    assert [(r["question_id"], r["context"]) for r in got] == [
        (1, "[M1] Item 7. MD&A, retrieved chunk 10\nfirst\n\n[M2] Item 7. MD&A, retrieved chunk 20\nsecond")
    ]
    pack = retrieval.risk_evidence(hits.filter("question_id = 2").withColumn("topic_label", F.lit("T"))).first()
    assert pack["evidence"] == "[1] Topic: T\nChunk ID: 10\nSEC excerpt:\nfirst"
    assert retrieval.evidence_preview(hits, 3).filter("chunk_id = 20").first()["preview"] == "sec"


def test_references_list_what_is_cited(spark):
    answers = spark.createDataFrame([(1, 7, "x [2] y"), (2, 7, "none")], "question_id int, filing_id int, answer string")
    hits = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, "A")], "question_id int, rank int, source_title string")
    metadata = spark.createDataFrame([(7, "Acme Inc.", "10-K", "2025-10-31", "u")], "filing_id int, company string, form string, filing_date string, source_url string")
    got = {r["question_id"]: r for r in retrieval.reference_list(answers, hits, metadata).collect()}
    assert got[1]["reference_lines"] == "[2] Acme Inc. 10-K — B" and got[2]["reference_lines"] == ""
    assert got[1]["filing_source"] == "Acme Inc. 10-K, filed 2025-10-31\nu"


def test_hits_are_filled_up(spark, docs, queries):
    hits = retrieval.retrieve(queries.drop("scope"), tfidf.fit_tfidf(docs.drop("scope")), k=3)
    full = retrieval.pad_hits(hits, queries.drop("scope"), docs, k=3)
    by = {}
    for r in full.orderBy("question_id", "rank").collect():
        by.setdefault(r["question_id"], []).append((r["doc_id"], r["retrieval_score"]))
    assert {q: len(v) for q, v in by.items()} == {1: 3, 2: 3, 3: 3}
    assert by[3] == [(5, 0.0), (4, 0.0), (3, 0.0)]
    found = {(r["question_id"], r["doc_id"]) for r in hits.collect()}
    assert all(((q, d) in found) == (s > 0) for q, v in by.items() for d, s in v)
    scoped = retrieval.pad_hits(hits.join(docs.select("scope", "doc_id"), "doc_id").limit(0), queries, docs, 2, scope=("scope",))
    assert {(r["question_id"], r["doc_id"]) for r in scoped.collect()} == {(1, 2), (1, 1), (2, 5), (2, 4), (3, 5), (3, 4)}


def test_references_without_a_known_filing(spark):
    answers = spark.createDataFrame([(1, 7, "a [1]"), (2, 8, "b [1]")], "question_id int, filing_id int, answer string")
    hits = spark.createDataFrame([(1, 1, "Risk"), (2, 1, "Risk")], "question_id int, rank int, source_title string")
    known = spark.createDataFrame([(7, "Acme", "10-K", "2025-01-01", "u")], "filing_id int, company string, form string, filing_date string, source_url string")
    out = {r["question_id"]: tuple(r)[1:] for r in retrieval.reference_list(answers, hits, known).collect()}
    assert out == {1: ("[1] Acme 10-K — Risk", "Acme 10-K, filed 2025-01-01\nu"), 2: ("[1] — Risk", None)}


def test_explained_answers_list_statements_first(spark):
    rows = [(1, 7, "a [M2] [F1]"), (2, 7, "b [M1][M3] [M9]"), (3, 8, "c [M1]"), (4, 7, "d [M1]")]
    answers = spark.createDataFrame(rows, "question_id int, filing_id int, answer string")
    hits = spark.createDataFrame([(q, r) for q in (1, 2, 3) for r in (1, 2, 3)], "question_id int, rank int")
    known = spark.createDataFrame([(7, "Acme Inc.", "10-K", "2025-10-31", "u")], "filing_id int, company string, form string, filing_date string, source_url string")
    got = {r["question_id"]: r for r in retrieval.explained_references(answers, hits, known).collect()}
    statements, discussion = "[F1] Acme Inc. 10-K — Financial Statements, filed 2025-10-31", "Acme Inc. 10-K — Item 7. Management’s Discussion and Analysis"
    assert got[1]["reference_lines"] == f"{statements}\n[M2] {discussion}"
    assert got[2]["reference_lines"] == f"{statements}\n[M1] {discussion}\n[M3] {discussion}"
    assert got[2]["referenced_answer"] == f"b [M1][M3] [M9]\n\nReferences:\n{statements}\n[M1] {discussion}\n[M3] {discussion}\nu"
    assert got[3]["reference_lines"] == "[F1] — Financial Statements\n[M1] — Item 7. Management’s Discussion and Analysis"
    assert got[4]["reference_lines"] == statements


def sharded_hits(questions, index, k, **options):
    vectors = tfidf.query_vectors(questions, index).withColumnRenamed("weight", "query_weight").drop("idf")
    scores = retrieval.sharded_scores(vectors, index, k, "question_id", **options)
    return scores, retrieval.top_documents(scores, k, "question_id", index.doc_id)


@pytest.mark.parametrize("k", [1, 3, 40])
@pytest.mark.parametrize("rows, pairs", [(2_000_000, 200_000_000), (500, 200_000_000), (3_000, 1_000)])
def test_sharded_hits_match_brute_force(spark, random_index, monkeypatch, k, rows, pairs):
    """One shard, many shards, and several parts of the questions; no question has more than k rows of a shard."""
    monkeypatch.setattr(retrieval, "PART_PAIRS", pairs)
    docs, queries = random_corpus(1)
    scores, hits = sharded_hits(spark.createDataFrame(queries, "question_id int, text string"), random_index, k, shard_rows=rows)
    expected = brute_force(docs, queries, k)
    assert hit_map(hits) == {q: h for q, h in expected.items() if h}
    if rows > 1_000_000:
        assert scores.groupBy("question_id").count().agg(F.max("count")).first()[0] <= k


def test_sharded_hits_keep_to_their_scope_and_take_text_ids(spark, docs, queries):
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    index = store_index(tfidf.fit_tfidf(named, tfidf.TfidfSpec(scope=("scope",))))
    found = hit_map(retrieval.retrieve(queries, index, 3))
    assert hit_map(sharded_hits(queries, index, 3)[1]) == found and {d for h in found.values() for d, _ in h} == {"d1", "d2", "d3", "d5"}


def test_many_postings_are_not_joined_as_rows(spark, random_index):
    _, queries = random_corpus(1)
    asked = spark.createDataFrame(queries, "question_id int, text string")
    few = retrieval.pruned_scores(asked, random_index, 3, "question_id", "text", pair_rows=0)
    assert "CoGroups" in few._jdf.queryExecution().executedPlan().toString() and few.count() <= 3 * len(queries)


@pytest.mark.parametrize("spec", [{}, {"longest_ngram": 3}, {"min_df": 2, "max_df": 0.5}, {"scope": ("part",), "min_df": 2, "max_df": 0.9}])
@pytest.mark.parametrize("words", [1_500_000, 200])
def test_packed_weights_are_those_of_a_join(spark, monkeypatch, spec, words):
    """One block or many, with equal rows, rows of one document, null keys and empty texts."""
    monkeypatch.setattr(tfidf, "BLOCK_WORDS", words)
    texts, _ = random_corpus(3, 120)
    rows = [(i, f"p{i % 3}", t) for i, t in texts] + [(3, "p0", texts[3][1]), (4, "p1", "w1 other"), (None, "p1", "w1"), (500, None, "w1 w2"), (501, "p1", None)]
    index = tfidf.fit_tfidf(spark.createDataFrame(rows, "doc_id int, part string, text string"), tfidf.TfidfSpec(**spec))
    joined = tfidf.normalised(tfidf.weighted_counts(index.counts, index.vocabulary, index.spec), ["doc_id"])
    keys = [*index.spec.scope, "doc_id", "term"]
    rounded = lambda df: sorted((*[str(r[c]) for c in keys], round(r.weight, 9)) for r in df.collect())
    assert rounded(index.weights) == rounded(joined)
    stored = store_index(index)
    assert rounded(stored.weights) == rounded(joined)
    tuples = lambda df: sorted((*[str(r[c]) for c in (*index.spec.scope, "term")], r.df, round(r.idf, 9)) for r in df.collect())
    assert tuples(stored.vocabulary) == tuples(index.vocabulary)


def test_a_term_travels_once_per_block(spark):
    rows = [(i, "alpha beta gamma " + ("odd" if i else "rare")) for i in range(100)]
    index = tfidf.fit_tfidf(spark.createDataFrame(rows, "doc_id int, text string"))
    dealt = tfidf.dealt_words(index.words, 4, "doc_id")
    terms = {r["term"]: r for r in tfidf.placed_terms(dealt, index.sizes, index.spec, 2).collect()}
    assert sorted(terms["alpha"]["blocks"]) == [0, 1, 2, 3] and terms["alpha"]["df"] == 100
    assert terms["rare"]["blocks"] is None and terms["rare"]["df"] == 1


def test_texts_of_hits_are_not_exchanged(spark):
    """Few hits are sent to the documents, though their number isn't known before they are found."""
    hits = spark.range(10_000_000).filter("id < 3").selectExpr("id AS doc_id", "id AS question_id")
    docs = spark.range(2_000_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    found = retrieval.attach_documents(hits, docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [(0, "text 0"), (1, "text 1"), (2, "text 2")]


@pytest.mark.parametrize("pairs", [5_000_000, 0])
def test_equal_questions_are_answered_once_and_the_corpus_is_read_once(spark, random_index, monkeypatch, pairs):
    """However many rows the questions' vectors have; rows of one question are one question."""
    docs, queries = random_corpus(1)
    texts = [t for _, t in queries]
    asked = [(i, texts[i % len(texts)]) for i in range(4 * len(texts))] + [(9_000, texts[0]), (9_000, texts[0]), (9_001, texts[0]), (9_001, texts[1])]
    monkeypatch.setattr(retrieval, "PAIR_ROWS", pairs)
    scored = []
    for name in ("sharded_scores", "split_scores"):
        original = getattr(retrieval, name)
        spy = lambda vectors, *args, original=original, name=name: scored.append((name, vectors.select("_text_id").distinct().count())) or original(vectors, *args)
        monkeypatch.setattr(retrieval, name, spy)
    frame = spark.createDataFrame([*asked, (9_002, None)], "question_id int, text string")
    found = hit_map(retrieval.retrieve(frame, random_index, 3, block_rows=100))
    merged = {}
    for q, t in asked:
        merged[q] = f"{merged[q]} the of {t}" if q in merged else t
    expected = brute_force(docs, [(q, t) for q, t in merged.items() if q < 9_000], 3)
    assert {q: h for q, h in found.items() if q < 9_000} == {q: h for q, h in expected.items() if h}
    assert found[9_000] == found[0] and {len(found[q]) for q in (9_000, 9_001)} == {3} and 9_002 not in found
    different = len(set(texts)) + 2
    if pairs:
        assert len(scored) > 1 and sum(n for _, n in scored) <= different
    else:
        assert [name for name, _ in scored] == ["sharded_scores"] and scored[0][1] <= different


def test_terms_travel_packed(spark):
    """Counts and frequencies go to the terms' and documents' blocks as sorted texts, no row per term."""
    rows = [(i, "alpha beta gamma " + " ".join(f"w{i * 7 + j}" for j in range(200))) for i in range(60)]
    index = tfidf.fit_tfidf(spark.createDataFrame(rows, "doc_id int, text string"))
    terms = spark.createDataFrame([(b, f"t{i:04d}", i) for b in (1, 2) for i in range(500, 0, -1)], "block int, term string, n long").coalesce(1)
    packed = tfidf.packed_terms(terms, ["block"], "n")
    assert [(r["block"], r["terms_size"]) for r in packed.orderBy("block").collect()] == [(1, 2999), (2, 2999)]
    opened = tfidf._opened(packed.toArrow(), ["block"], "n").to_pylist()
    assert sorted((r["block"], r["term"], r["n"]) for r in opened) == sorted(tuple(r) for r in terms.collect())
    dealt = tfidf.dealt_words(index.words, 3, "doc_id")
    placed = tfidf.placed_terms(dealt, index.sizes, index.spec, 3)
    assert {r["term"]: r["df"] for r in placed.collect()} == {r["term"]: r["df"] for r in index.vocabulary.collect()}
    # no row per term is exchanged, only packs by their part
    keys = joined_by_exchange(placed)
    assert any(k.startswith("_part") for k in keys) and not any(k.startswith("term") for k in keys)


@pytest.mark.parametrize("spec", [{}, {"longest_ngram": 3}, {"scope": ("part",)}])
def test_a_block_counts_its_terms_where_it_is(spark, spec):
    """Terms become rows when they are counted, not before; equal rows are two documents, null texts none."""
    rows = [(1, "p0", "alpha beta alpha beta"), (1, "p0", "alpha beta alpha beta"), (2, "p1", "beta gamma alpha"), (3, "p1", None), (4, "p0", "")]
    index = tfidf.fit_tfidf(spark.createDataFrame(rows, "doc_id int, part string, text string"), tfidf.TfidfSpec(**spec))
    dealt = tfidf.dealt_words(index.words, 3, "doc_id")
    placed = tfidf.placed_terms(dealt, index.sizes, index.spec, 2)
    keys = [*index.spec.scope, "term"]
    count = lambda df: {tuple(r[c] for c in keys): r["df"] for r in df.collect()}
    assert count(placed) == count(index.vocabulary)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Generate" not in plan


@pytest.mark.parametrize("count", [1, 7, 16, 70])
def test_blocks_have_a_partition_each(spark, count):
    """By their numbers alone some would meet in one partition and others stay empty."""
    words = spark.range(40 * count).select(F.col("id").alias("doc_id"), F.array(F.lit("w")).alias("_words"))
    dealt = tfidf.dealt_words(words, count, "doc_id")
    met = dealt.select("block", F.spark_partition_id().alias("at")).distinct().collect()
    assert {r["block"] for r in met} == set(range(count)) == {r["at"] for r in met} and len(met) == count


def test_only_different_questions_are_expanded(spark, random_index, monkeypatch):
    expanded = []
    original = retrieval.stored_vectors
    monkeypatch.setattr(retrieval, "stored_vectors", lambda texts, *args: expanded.append(texts.count()) or original(texts, *args))
    told = []
    spaced = retrieval.expand_query
    monkeypatch.setattr(retrieval, "expand_query", lambda text, terms: told.append(1) or spaced(text, terms))
    asked = spark.createDataFrame([(i, "w1 w2" if i % 2 else "ask w3") for i in range(40)] + [(50, None)], "question_id int, text string")
    plain = asked.withColumn("text", spaced(F.col("text"), {"ask": "w1 w2"}))
    found = retrieval.retrieve(asked, random_index, 3, expand={"ask": "w1 w2"})
    assert hit_map(found) == hit_map(retrieval.retrieve(plain, random_index, 3)) and expanded[0] == 2 and len(told) == 1
    assert "regexp_replace" not in retrieval.distinct_questions(asked, [], "question_id", "text")[0]._jdf.queryExecution().optimizedPlan().toString()


def test_packs_of_a_block_hold_all_its_scopes(spark):
    """As many packs as blocks have parts, whatever the number of scopes; words are exchanged once."""
    rows = [(i, f"p{i % 30}", f"alpha beta w{i} w{i % 7}") for i in range(300)]
    index = tfidf.fit_tfidf(spark.createDataFrame(rows, "doc_id int, part string, text string"), tfidf.TfidfSpec(scope=("part",)))
    counted = index.counts.groupBy("part", "term").agg(F.count("*").alias("n")).withColumn("block", F.lit(1)).coalesce(1)
    packed = tfidf.packed_terms(counted, ["block"], "n", ["part"])
    assert packed.count() == 1
    opened = tfidf._opened(packed.toArrow(), ["block"], "n", ["part"]).to_pylist()
    tuples = lambda found: sorted((r["block"], r["part"], r["term"], r["n"]) for r in found)
    assert tuples(opened) == tuples(counted.collect())
    documents = index.documents
    assert len(documents.collect()) == 300
    plan = documents._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and "Exchange hashpartitioning(part" not in plan


def test_terms_are_dealt_as_spark_deals_them(spark):
    import pyarrow as pa

    texts = ["", "a", "ab", "abc", "abcd", "é", "éé ü", "wörld of words", "x" * 101]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(F.hash("t")).collect()
    assert tfidf.spark_hashes(pa.array(["other", *texts]).slice(1)).tolist() == [r[0] for r in rows]


@pytest.mark.parametrize("k", [1, 3, 40])
def test_whole_columns_give_the_sums_of_postings(monkeypatch, k):
    """Terms of many documents are added as columns; hits are the same whichever terms are."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    there = rng.random((200, 30)) < np.linspace(0.9, 0.01, 30)
    doc, term = np.nonzero(there)
    weight = rng.integers(1, 5, len(doc)) / 10
    postings = pa.table({"doc": pa.array(doc * 7), "term": pa.array(term), "weight": pa.array(weight)})
    lists = [sorted(rng.choice(30, 6, replace=False).tolist()) for _ in range(50)]
    asked = pa.table({"q": pa.array(range(50)), "terms": pa.array(lists), "weights": pa.array([[0.5] * 6] * 50)})
    dense = np.zeros((200, 30))
    dense[doc, term] = weight
    found = []
    for common in (0, 4, 1_000_000):
        monkeypatch.setattr(retrieval, "COMMON", common)
        rows = retrieval.best_of_shard(postings, asked, k, "doc", "q").to_pylist()
        found.append({q: sorted((round(r["score"], 9), r["doc"]) for r in rows if r["q"] == q) for q in range(50)})
    scores = lambda terms: sorted((round(float(s), 9), i * 7) for i, s in enumerate(dense[:, terms].sum(axis=1) * 0.5) if s)[-k:]
    assert found[0] == found[1] == found[2] == {q: scores(terms) for q, terms in enumerate(lists)}
