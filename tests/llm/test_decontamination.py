import random
from collections import Counter

from corpus import SMALL, awkward, documents, empty

from ledgerspark.llm import decontamination as dec

ITEMS = [
    (1, "Which river runs through the old capital and past the glass factory?\nThe river Aller runs there."),
    (2, "Name the largest moon of the ringed planet. It is called Titan by astronomers."),
    (3, "of the and"),
    (4, None),
    (1, "Which river runs through the old capital and past the glass factory?\nThe river Aller runs there."),
]
FILLER = "plain words that have little to do with any of this and go on for a while " * 30


def benchmark(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


def test_documents_that_hold_an_item(spark):
    items = {r.item_id: r.text for r in benchmark(spark).collect()}
    expected = {(r.doc_id, i) for r in documents(spark).collect() for i, t in items.items() if t in r.text}
    found = {(r.doc_id, r.item_id) for r in dec.contaminated(documents(spark), benchmark(spark)).collect()}
    assert expected and expected == found
    kept = {r.doc_id for r in dec.decontaminate(documents(spark), benchmark(spark)).collect()}
    assert kept == {r.doc_id for r in documents(spark).collect()} - {d for d, _ in expected}


def test_shards_agree(spark):
    one = dec.contaminated(documents(spark), benchmark(spark)).collect()
    many = dec.contaminated(documents(spark), benchmark(spark), shard_bytes=2_000).collect()
    assert sorted((r.doc_id, r.item_id) for r in one) == sorted((r.doc_id, r.item_id) for r in many)


def test_pruning_loses_nothing():
    """Every passage scored in full, without bounds."""
    items = [(i, t) for i, t in ITEMS[:2]]
    frequency = {}
    for _, t in items:
        for w in set(dec.terms(t)):
            frequency[w] = frequency.get(w, 0) + 1
    index = dec.Index(items, frequency, 2, 13.0)
    texts = [FILLER + ITEMS[0][1].upper() + FILLER, FILLER, ITEMS[1][1], "moon Titan planet", FILLER + ITEMS[1][1] + " " + ITEMS[0][1]]
    for text in texts:
        words, expected = dec.terms(text), {}
        for p in range(0, max(1, len(words)), index.step):
            passage = words[p : p + index.width]
            for item in index.items:
                score = sum(item.impact[w] for w in item.impact.keys() & set(passage))
                q, a = item.overlaps(passage)
                if score >= dec.MIN_SCORE and q >= dec.MIN_QUESTION and a >= dec.MIN_ANSWER:
                    expected[item.item_id] = max(score, expected.get(item.item_id, 0))
        assert {i.item_id: s for i, s, _, _ in index.search(text)} == expected


def test_question_without_answer_is_kept(spark):
    question = ITEMS[0][1].split("\n")[0]
    rows = [(1, FILLER + question + FILLER), (2, FILLER + ITEMS[0][1] + FILLER), (3, "of the and")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = sorted((r.doc_id, r.item_id) for r in dec.contaminated(docs, items).collect())
    # the short item is all that document 3 says
    assert found == [(2, 1), (2, 1), (3, 3)]


def test_blocks_and_pivots_lose_nothing():
    rng = random.Random(4)
    for trial in range(300):
        spread = rng.choice([40, 400, 3_000])
        lists = [
            [(i, rng.choice([0.01, 0.1, 0.3, 0.6])) for i in sorted(rng.sample(range(spread), rng.randint(1, spread)))]
            for _ in range(rng.randint(1, 9))
        ]
        sums = Counter()
        for postings in lists:
            sums.update(dict(postings))
        expected = sorted(i for i, v in sums.items() if v >= dec.NEEDED)
        assert dec.retrieve([dec.Postings(p) for p in lists]) == expected
    assert dec.retrieve([]) == []


def test_short_items_are_found_where_a_line_or_sentence_says_them(spark):
    items = spark.createDataFrame([(1, "Aller\nYes."), (2, "The moon Titan"), (3, "??")], "item_id bigint, text string")
    rows = [(1, "Rivers. Aller! yes\nmore"), (2, "It is the moon Titan of course."), (3, "so\nthe Moon, Titan.\nso"), (4, "??"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((r.doc_id, r.item_id, r.score) for r in dec.contaminated(docs, items).collect())
    assert found == [(1, 1, 1.0), (3, 2, 1.0)]
    assert sorted(r.doc_id for r in dec.decontaminate(docs, items).collect()) == [2, 4, 5]
    assert dec.decontaminate(docs.filter("false"), items).collect() == []
    assert dec.decontaminate(docs, items.filter("false")).count() == 5


def test_a_very_long_text_is_searched_to_its_end(spark):
    docs = spark.createDataFrame([(1, FILLER * 2_000 + ITEMS[0][1]), (2, FILLER * 2_000)], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS[:2], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in dec.contaminated(docs, items).collect()] == [(1, 1)]
    assert [r.doc_id for r in dec.decontaminate(docs, items).collect()] == [2]


def test_awkward_and_empty(spark):
    assert dec.contaminated(awkward(spark), benchmark(spark)).collect() == []
    assert dec.contaminated(empty(spark), benchmark(spark)).collect() == []
    none = benchmark(spark).filter("false")
    assert dec.contaminated(awkward(spark), none).collect() == []
    kept = dec.decontaminate(awkward(spark), benchmark(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == 9
