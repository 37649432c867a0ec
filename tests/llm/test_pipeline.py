import tempfile

import corpus_pipeline
from corpus import SMALL, documents

import __spark_entry__ as contract


def test_stages_run_one_after_another(spark):
    folder = tempfile.mkdtemp(prefix="pipeline-")
    docs, counts = documents(spark), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        counts.append(docs.count())
        if name != "mixing":
            assert dict(docs.dtypes) == dict(before.dtypes)
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
    assert counts[1] < counts[0] and counts[2] < counts[1]
    assert counts[2] == counts[3] == counts[4]
    whole = {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert whole == {(r.doc_id, r.taken) for r in docs.collect()}


def test_every_operator_has_one_query():
    names = contract.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
