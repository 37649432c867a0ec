import zlib

from corpus import SMALL, awkward, documents, empty

from ledgerspark.llm import toxicity as tox

SF = "/root/testdata/sf0.01"
ENOUGH_LABELS = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{ENOUGH_LABELS}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = tox.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(t and p for t, p in held)
    assert hit / max(1, sum(p for _, p in held)) >= 0.95 and hit / sum(t for t, _ in held) >= 0.85


def test_few_labels_still_rank_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(truth[r.doc_id], r.score) for r in tox.toxicity(docs, labels).collect() if r.held_out and r.doc_id in truth]
    toxic, clean = ([s for t, s in rows if t == label] for label in (1, 0))
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean)
    assert wins / (len(toxic) * len(clean)) >= 0.85


def test_lexicons_leave_their_fold_out(spark):
    rows = [(f"plain{k} words vile" if label else "plain words " * 50, label, k % 5) for k in range(50) for label in (0, 1)]
    rows += [("only here " * 3 + "nasty", 1, 2)] * 4 + [(None, 0, 1), ("", 1, 4)]
    lexicons = tox.learn_lexicons(spark.createDataFrame(rows, "text string, label int, fold int"))
    assert len(lexicons) == 6 and all("vile" in lexicon for lexicon in lexicons)
    assert ["nasty" in lexicon for lexicon in lexicons] == [True, True, False, True, True, True]
    assert tox.learn_lexicons(spark.createDataFrame([("a bcd", 0, 0)], "text string, label int, fold int")) == [{}] * 6


def test_features():
    codes = tox.WordCodes({"idiot": 16, "mora*": 8})
    x = dict(zip(tox.FEATURES, tox.features("You IDIOT!! 1d10t moralo aaargh plain words here", codes)))
    assert x["hit_density"] == 3 / 8 and x["strong_density"] == 2 / 8 and x["disguised_density"] == 1 / 8
    assert x["weight_density"] == (4 + 4 + 2) / 8 and x["near_second_person"] == 1.0
    assert x["capital_words"] == 1 / 8 and x["exclamations"] == 2 / 8 and x["stretched_words"] == 1 / 8
    assert tox.features(None, codes) == tox.features("  ", codes) == [0.0] * len(tox.FEATURES)


def test_scores_depend_on_text_only(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.train(docs, labels)
    text = docs.filter("doc_id = 28").first().text
    twins = spark.createDataFrame([(1, text, "en"), (2, text, "xx"), (None, text, None)], "doc_id bigint, text string, lang string")
    assert len({r.score for r in model.score(twins).collect()}) == 1


def test_awkward_and_empty(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    one_class = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (4, 0, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    for known in (one_class, labels.filter("false")):
        rows = tox.toxicity(awkward(spark), known).collect()
        assert len(rows) == 9 and {r.score for r in rows} == {0.0}
        assert tox.reject_toxic(awkward(spark), known).count() == 9
    assert tox.toxicity(empty(spark), one_class).collect() == []


def test_rejection_takes_effect(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SMALL}/labels.parquet")
    bad = {r.doc_id for r in tox.toxicity(docs, labels).collect() if r.predicted}
    kept = tox.reject_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad
