import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark import constants as C
from ledgerspark.functions import text as X
from ledgerspark.operators import nmf, topics
from ledgerspark.plans.filing_text import label_chunks, section_chunks, topic_model, RISK_SECTION

CORPUS = [
    "security breach data attacks servers",
    "attacks security unauthorized data servers",
    "software competition products features",
    "features products competition software",
    "currency dollar foreign hedges",
    "hedges foreign dollar currency",
    "credit tax receivables rates",
    "receivables rates tax credit",
    "regulations legal laws courts",
    "laws courts legal regulations",
    "imports tariffs partners supply",
    "supply partners tariffs imports",
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(list(enumerate(CORPUS, start=1)), "chunk_id int, text string")


@pytest.fixture(scope="module")
def model(chunks):
    return topic_model(chunks, power=2, max_sweeps=60)


def test_shapes_signs_and_loss(model):
    w = [r["weights"] for r in model.chunks.collect()]
    h = [r["weights"] for r in model.components.collect()]
    assert len(w) == len(CORPUS) and {len(x) for x in w + h} == {6}
    assert min(v for x in w + h for v in x) >= 0
    assert all(b <= a + 1e-9 for a, b in zip(model.losses, model.losses[1:]))
    # twelve unit rows in six exact pairs of words: little is left over
    assert model.losses[-1] < 4


def test_labels_are_a_permutation_and_fit(spark, chunks, model):
    assigned = {r["component"]: r["topic_id"] for r in topics.assign_topics(topics.topic_scores(model.components)).collect()}
    assert sorted(assigned.values()) == list(C.TOPIC_LABELS)
    labelled = {r["chunk_id"]: r for r in label_chunks(chunks, model).collect()}
    assert [labelled[i]["topic_id"] for i in range(1, 13)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6]
    assert all(r["classification_status"] == "confident" for r in labelled.values())


def reference_updates(x, w, h, sweeps):
    for _ in range(sweeps):
        for a, f, g in ((x @ h.T, w, h @ h.T), (None, None, None)):
            if a is None:
                a, f, g = (w.T @ x).T, h.T, w.T @ w
            for j in range(f.shape[1]):
                if g[j, j] > 0:
                    f[:, j] = np.maximum(f[:, j] - (f @ g[:, j] - a[:, j]) / g[j, j], 0)
    return w, h


@pytest.mark.parametrize("limit", [nmf.BROADCAST_BYTES, 0])
def test_sweeps_equal_dense_updates(spark, monkeypatch, limit):
    """Distributed factors follow dense coordinate descent, on the broadcast and the shuffle path."""
    monkeypatch.setattr(nmf, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(0)
    x = np.maximum(rng.random((9, 7)) - 0.4, 0)
    x[:, 0] += 0.1
    rows = [(i, f"t{j}", float(x[i, j])) for i in range(9) for j in range(7) if x[i, j] > 0]
    weights = spark.createDataFrame(rows, "doc_id int, term string, weight double")
    starts = {}
    original = nmf._start_factors

    def remember(*args):
        docs, terms = original(*args)
        starts["w"] = {r["doc_id"]: list(r)[1:] for r in docs.collect()}
        starts["h"] = {r["term"]: list(r)[1:] for r in terms.collect()}
        return docs, terms

    monkeypatch.setattr(nmf, "_start_factors", remember)
    model = nmf.fit_nmf(weights, 9, k=3, max_sweeps=4, tolerance=0.0, passes=1)
    w = np.array([starts["w"][i] for i in range(9)])
    h = np.array([starts["h"][f"t{j}"] for j in range(7)]).T.copy()
    w, h = reference_updates(x, w, h, 4)
    got_w = {r["doc_id"]: r["weights"] for r in model.chunks.collect()}
    got_h = {r["term"]: r["weights"] for r in model.components.collect()}
    assert np.allclose(np.array([got_w[i] for i in range(9)]), w, atol=1e-8)
    assert np.allclose(np.array([got_h[f"t{j}"] for j in range(7)]).T, h, atol=1e-8)
    assert model.losses[-1] == pytest.approx(((x - w @ h) ** 2).sum(), abs=1e-8)


def factors(model):
    return {r[0]: r["weights"] for r in model.chunks.collect()}, {r[0]: r["weights"] for r in model.components.collect()}


def random_weights(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.random((40, 3)) @ rng.random((3, 30)) + 0.2 * rng.random((40, 30))
    rows = [(i, f"t{j}", float(x[i, j])) for i in range(40) for j in range(30)]
    return spark.createDataFrame(rows, "doc_id int, term string, weight double")


def test_a_fit_is_taken_up_where_it_ended(spark, tmp_path):
    """Five sweeps and then the rest give what one run gives; finished sweeps leave one folder."""
    weights = random_weights(spark, 4)
    options = {"n_docs": 40, "k": 3, "tolerance": 1e-9, "power": 2, "passes": 2}
    whole = nmf.fit_nmf(weights, max_sweeps=9, **options)
    folder = str(tmp_path / "fit")
    part = nmf.fit_nmf(weights, max_sweeps=5, folder=folder, **options)
    rest = nmf.fit_nmf(weights, max_sweeps=9, folder=folder, **options)
    assert (part.sweeps, rest.sweeps) == (5, 9) and rest.losses[:5] == part.losses
    for a, b in zip(factors(whole), factors(rest)):
        assert a.keys() == b.keys() and all(np.allclose(a[x], b[x], atol=1e-9) for x in a)
    assert sorted(f.name for f in (tmp_path / "fit").iterdir() if not f.name.startswith(".")) == ["state.json", "sweep-9"]
    with pytest.raises(ValueError):
        nmf.fit_nmf(weights, folder=folder, **{**options, "k": 2})


def test_more_passes_fall_faster(spark):
    """More steps per reading leave a smaller loss after as many sweeps, and the loss never rises."""
    weights = random_weights(spark, 5)
    one, eight = (nmf.fit_nmf(weights, 40, k=3, passes=p, tolerance=0.0, max_sweeps=5) for p in (1, 8))
    assert eight.losses[-1] < one.losses[-1] and not eight.converged
    assert all(b <= a + 1e-9 for a, b in zip(eight.losses, eight.losses[1:]))


def test_weights_are_released_on_an_error(spark, monkeypatch):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    with pytest.raises(ValueError):
        nmf.fit_nmf(spark.createDataFrame([], "doc_id int, term string, weight double"), 3)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_leading_vectors_match_dense_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.random((8, 6))
    rows = [(i, f"t{j}", float(x[i, j])) for i in range(8) for j in range(6)]
    nmf.checkpoint_dir(spark)
    matrix = nmf._Matrix(spark.createDataFrame(rows, "doc_id int, term string, weight double"), "doc_id", 12)
    singular, docs, _ = nmf._leading_vectors(matrix, 3, 42, 4)
    u, s, _ = np.linalg.svd(x)
    assert np.allclose(singular, s[:3], atol=1e-6)
    got = np.array([list(r)[1:] for r in docs.orderBy("doc_id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :3]), atol=1e-4)


def test_first_of_equal_weights_and_low_share(spark):
    rows = [(1, "tax credit.", [0.4, 0.4, 0.1]), (2, "x", [0.0, 0.0, 0.0]), (3, "y", [0.1, 0.2, 0.9])]
    df = spark.createDataFrame(rows, "chunk_id int, text string, weights array<double>")
    labels = {1: "One", 2: "Two", 3: "Three"}
    anchors = {1: ("tax",), 2: ("b",), 3: ("c",)}
    got = {r["chunk_id"]: r for r in topics.classify_chunks(df, {0: 2, 1: 1, 2: 3}, labels, anchors).collect()}
    assert (got[1]["topic_id"], got[1]["classification_status"], got[1]["topic_share"]) == (2, "review", 0.4444)
    assert (got[2]["topic_share"], got[2]["display_topic_label"]) == (0.0, C.MIXED_TOPIC_LABEL)
    assert (got[3]["topic_label"], got[3]["display_topic_label"], got[3]["topic_share"]) == ("Three", "Three", 0.75)
    totals = topics.theme_totals(spark.createDataFrame([("A",), ("A",), (C.MIXED_TOPIC_LABEL,)], "display_topic_label string")).first()
    assert tuple(totals) == (3, 1, True, 2)


def test_filing_to_section_chunks(spark):
    page = (
        "<p>Item 1A. Risk Factors</p>" + "<p>Filler.</p>" * 100 + "<h2>Item 1A.&nbsp;Risk Factors</h2><p>The following summarizes factors. "
        + "Risk is everywhere. " * 200 + "</p><h2>Item 1B. Unresolved Staff Comments</h2>"
    )
    filings = spark.createDataFrame([(1, page)], "filing_id int, html string")
    rows = section_chunks(filings, RISK_SECTION, 0).orderBy("chunk_id").collect()
    assert len(rows) == 3 and all(len(r["text"]) <= 1500 for r in rows)
    assert rows[0]["text"].startswith("Item 1A. Risk Factors The following summarizes factors.")


@pytest.mark.parametrize("k", [3, 5, 11])
def test_assignment_is_the_best_and_first(spark, k):
    import random
    from itertools import permutations

    rng = random.Random(k)
    gain = [[float(rng.randrange(4)) for _ in range(k)] for _ in range(k)]
    scores = spark.createDataFrame([(c, t, gain[c][t]) for c in range(k) for t in range(k) if gain[c][t]], "component int, topic_id int, score double")
    got = [r["topic_id"] for r in topics.assign_topics(scores, tuple(range(k))).orderBy("component").collect()]
    assert sorted(got) == list(range(k))
    if k < 8:
        assert tuple(got) == max(permutations(range(k)), key=lambda p: (sum(gain[c][t] for c, t in enumerate(p)), [-t for t in p]))


def test_costly_weights_are_found_once_per_chunk(spark):
    """However many columns and sentences read them."""
    chunks = spark.createDataFrame([(1, "A one. B two.")], "chunk_id int, text string")
    weights = F.array(*[X.count_occurrences(F.lower("text"), F.lit(f"mark{i}")).cast("double") for i in range(2)])
    found = topics.classify_chunks(chunks.withColumn("weights", weights), {0: 1, 1: 2}, {1: "x", 2: "y"}, {1: ["one"], 2: ["two"]})
    plan = found.filter("display_topic_label = 'x'")._jdf.queryExecution().optimizedPlan().toString()
    # once for the filter, once for the rows it leaves
    assert plan.count("mark1") <= 2


def test_excerpts_of_winners_are_those_of_all(spark):
    rows = [(i, f"A one {'one ' * (i % 4)}. B two {'two ' * (i % 3)}. C.", [float(i % 4), float(i % 3)]) for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id int, text string, weights array<double>")
    classified = lambda df: topics.classify_chunks(df, {0: 1, 1: 2}, {1: "x", 2: "y"}, {1: ["one"], 2: ["two"]}, low_share=0.6)
    best = topics.best_chunks(classified(chunks))
    winners = chunks.join(best.select("chunk_id"), "chunk_id", "left_semi")
    of_all = {tuple(r) for r in topics.best_excerpts(classified(chunks)).collect()}
    assert {tuple(r) for r in topics.best_excerpts(classified(winners), best=best).collect()} == of_all and len(of_all) == 3


@pytest.mark.parametrize("limit", [nmf.BROADCAST_BYTES, 0])
def test_products_leave_the_weights_where_they_are(spark, monkeypatch, limit):
    """Many blocks: factors come to the stored weights, a term goes back once per block, and nothing stays."""
    monkeypatch.setattr(nmf, "BLOCK_WEIGHTS", 100)
    monkeypatch.setattr(nmf, "BROADCAST_BYTES", limit)
    weights = random_weights(spark, 6)
    persisted = len(spark.sparkContext._jsc.getPersistentRDDs())
    matrix = nmf._Matrix(weights, "doc_id", 12)
    x = np.zeros((40, 30))
    for r in weights.collect():
        x[r["doc_id"], int(r["term"][1:])] = r["weight"]
    ones = [F.lit(1.0).alias("c0"), F.lit(2.0).alias("c1")]
    of_docs = matrix.with_terms(matrix.vocabulary.select("term", *ones), 2)
    of_terms = matrix.with_docs(weights.select("doc_id").distinct().select("doc_id", *ones), 2)
    got = {r["doc_id"]: r["c1"] for r in of_docs.collect()}
    assert np.allclose([got[i] for i in range(40)], 2 * x.sum(axis=1))
    got = {r["term"]: r["c1"] for r in of_terms.collect()}
    assert np.allclose([got[f"t{j}"] for j in range(30)], 2 * x.sum(axis=0))
    assert matrix.blocks == 12
    for product in (of_docs, of_terms):
        plan = product._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("Exchange hashpartitioning(block") == 1 and "Bucketed: true" in final
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == persisted
    matrix.release()
    assert not spark.catalog.tableExists(matrix.table)


@pytest.mark.parametrize("docs", [500_000, 15])
def test_factors_travel_packed(spark, monkeypatch, docs):
    """A share of a product is one row per unit and block, whatever the number of its terms and documents."""
    monkeypatch.setattr(nmf, "BLOCK_WEIGHTS", 100)
    monkeypatch.setattr(nmf, "RANGE_DOCS", docs)
    weights = random_weights(spark, 7)
    x = np.zeros((40, 30))
    for r in weights.collect():
        x[r["doc_id"], int(r["term"][1:])] = r["weight"]
    matrix = nmf._Matrix(weights, "doc_id", 12)
    assert matrix.ranges == (1 if docs > 40 else 3) and matrix.tasks == matrix.ranges * matrix.parts >= matrix.blocks
    f, g = np.arange(60.0).reshape(30, 2), np.arange(80.0).reshape(40, 2)
    terms = matrix.packed_terms(spark.createDataFrame([(f"t{j}", *map(float, f[j])) for j in range(30)], "term string, c0 double, c1 double"), 2)
    held = matrix.packed_docs(spark.createDataFrame([(i, *map(float, g[i])) for i in range(40)], "doc_id int, c0 double, c1 double"), 2)
    assert terms.count() <= matrix.parts and held.count() == matrix.doc_names.count()
    of_docs, of_terms = matrix.of_docs(terms, 2), matrix.of_terms(held, 2)
    assert of_docs.count() <= matrix.parts * matrix.doc_names.count() and of_terms.count() <= matrix.parts * matrix.ranges
    rows = {r[0]: list(r)[1:] for r in nmf.rows_of(nmf.added(of_docs, 2), matrix.doc_names, "doc_id", "int", 2).collect()}
    assert np.allclose([rows[i] for i in range(40)], x @ f)
    rows = {r[0]: list(r)[1:] for r in nmf.rows_of(nmf.added(of_terms, 2), matrix.term_names, "term", "string", 2).collect()}
    assert np.allclose([rows[f"t{j}"] for j in range(30)], x.T @ g)
    matrix.release()


def test_a_document_in_one_row_is_fitted_like_its_weights(spark):
    """Weights come as the index has them, without a row per weight."""
    weights = random_weights(spark, 8)
    lists = weights.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("postings"))
    long, short = (nmf.fit_nmf(rows, 40, k=3, max_sweeps=2, power=2) for rows in (weights, lists))
    assert np.allclose(long.losses, short.losses)
    for a, b in zip(factors(long), factors(short)):
        assert a.keys() == b.keys() and all(np.allclose(a[x], b[x], atol=1e-9) for x in a)
