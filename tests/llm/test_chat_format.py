import hashlib
import random

import pytest
from corpus import SMALL
from pyspark.sql import functions as F

from ledgerspark.llm import chat_format, queries

SCHEMA = "conv_id bigint, seq bigint, kind string, message string, role string, text string, opened string, formatted int"


def brute(events):
    """{conv: [(role, text)]} by a fold over the sorted events of each conversation."""
    out = {}
    first = lambda x: (x is not None, x)
    for c in {e[0] for e in events}:
        rows = [(e[1], e[3], e[2] or "delta", e[4], e[5] or "") for e in events if e[0] == c]
        rows.sort(key=lambda r: (*map(first, r[:2]), r[2], first(r[3]), r[4]))
        messages, place = [], {}
        for _, name, kind, role, text in rows:
            if name is None or name not in place:
                messages.append({"role": None, "text": "", "gone": False})
                at = len(messages) - 1
                if name is not None:
                    place[name] = at
            else:
                at = place[name]
            m = messages[at]
            m["role"] = m["role"] if m["role"] is not None else role
            m["text"] = m["text"] + text if kind not in ("start", "edit", "regenerate") else text
            if kind == "regenerate":
                for later in messages[at + 1 :]:
                    later["gone"] = True
        out[c] = [(m["role"] or "", m["text"]) for m in messages if not m["gone"]]
    return out


def log(seed):
    rng = random.Random(seed)
    texts = [None, "", "<", "\\", "\\l", "</turn>\n", "<turn>", "\\<text>", "ünï 😀", "plain ", "\\\\l<"]
    rows = []
    for c in (1, 2, 3, None):
        for s in range(rng.randint(1, 60)):
            kind = rng.choices(["start", "delta", "edit", "regenerate", None, "other"], [3, 8, 2, 1, 1, 1])[0]
            name = rng.choice([None, *"abcdefg"])
            rows.append((c, rng.choice([None, s, s // 3]), kind, name, rng.choice([None, "user", "assistant", "<\\"]), rng.choice(texts), "x", 1))
    return rows + rows[:3]


@pytest.mark.parametrize("seed", range(3))
def test_logs_fold_like_a_loop(spark, seed):
    rows = log(seed)
    expected = {c: m for c, m in brute(rows).items() if m}
    out = chat_format.format_log(spark.createDataFrame(rows, SCHEMA)).cache()
    read = out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l"))
    got = {r.conv_id: r for r in read.collect()}
    assert {c: [tuple(t) for t in r.t] for c, r in got.items()} == expected
    assert {c: r.l for c, r in got.items()} == {c: [t for who, t in m if who == "assistant"] for c, m in expected.items()}
    # every guard character belongs to a mark
    for r in out.collect():
        assert r.formatted.count("<") == 3 * len(expected[r.conv_id])


def test_streamed_regenerated_edited(spark):
    rows = [
        (1, 1, "start", "q", "user", "2+2", "", 0),
        (1, 2, "start", "a", "assistant", "", "", 0),
        (1, 3, "delta", "a", None, "fi", "", 0),
        (1, 4, "delta", "a", None, "ve", "", 0),
        (1, 5, "start", "q2", "user", "sure?", "", 0),
        (1, 6, "regenerate", "a", None, "", "", 0),
        (1, 7, "delta", "a", None, "fo", "", 0),
        (1, 8, "delta", "a", None, "ur", "", 0),
        (1, 9, "edit", "q", None, "2 + 2", "", 0),
    ]
    out = chat_format.format_log(spark.createDataFrame(rows, SCHEMA)).first()
    assert out.formatted == "<turn>user<text>2 + 2</turn>\n<turn>assistant<text>four</turn>\n"
    begin, end = out.loss_spans[0]
    assert out.formatted.encode()[begin:end] == b"four" and len(out.loss_spans) == 1


def test_empty_long_and_other_marks(spark):
    assert chat_format.format_log(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "long \\ < 😀 " * 50_000
    template = chat_format.Template("#a ", "#b ", "#c\n", guard="#")
    rows = [(1, i, "delta", "m", "assistant", long[i : i + 10_000], "", 0) for i in range(0, len(long), 10_000)]
    out = chat_format.format_log(spark.createDataFrame(rows, SCHEMA), template)
    got = out.select(chat_format.read_turns(F.col("formatted"), template)[0]["text"], chat_format.read_loss(F.col("formatted"), F.col("loss_spans"), template)[0]).first()
    assert got[0] == got[1] == long
    with pytest.raises(ValueError):
        chat_format.Template(before="turn")


def test_awkward_conversations(spark, tmp_path):
    """NULL turns, roles and texts, ties and repeated rows in the table of the query."""
    rows = [(1, None, "user", "b"), (1, None, "user", "b"), (1, 0, "assistant", None), (1, 0, None, "x"), (2, 5, "assistant", "é"), (None, 1, "user", "n")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit("z")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op12_chat_format(spark, str(tmp_path)).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {1: 4, 2: 1, None: 1, -7: 2}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("user\nb\nuser\nb\n\nx\nassistant\n\n")
    assert got[-7].loss_sha256 == digest("\\### Assistant: </turn> ok") and got[-7].loss_chars == 26
    assert got[2].loss_sha256 == digest("é") and got[2].formatted_chars == len("<turn>assistant<text>é</turn>\n")


def test_conversations_are_dealt_once(spark):
    plan = queries.op12_chat_format(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
