"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    message, rows = compare(spark, duck, QUERIES[name], ORACLES[name], SMALL)
    assert message == ""
    assert rows > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_routed_answers(spark):
    rows = QUERIES["routed_answers"](spark, SMALL).collect()
    asked = spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert len(rows) == asked == len({r["question_id"] for r in rows})
    by_route = {}
    for r in rows:
        by_route.setdefault(r["route"], []).append(r)
    assert set(by_route) == {"financial", "risk", "unsupported"}
    assert all(r["answer"].startswith("This question is outside") for r in by_route["unsupported"])
    assert all((r["answer"] is None) == (r["evidence"] is not None) for r in by_route["risk"])
    financial = by_route["financial"]
    assert all((r["answer"] is None) == (r["context"] is not None) for r in financial)
    assert any(r["context"] is not None and r["context"].startswith("[M1] ") for r in financial)


def test_answer_texts_agree_with_sentences(spark):
    answers = {r["question_id"]: r["answer"] for r in QUERIES["answer_texts"](spark, SMALL).collect()}
    sentences = QUERIES["change_sentences"](spark, SMALL).collect()
    assert sentences
    assert all(s["sentence"] in answers[s["question_id"]] for s in sentences)
