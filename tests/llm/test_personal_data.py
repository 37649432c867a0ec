import re
import time

from corpus import awkward, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerspark.llm import personal_data as pii
from ledgerspark.llm.common import joined, sha256


def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19:
            twice = [int(c) * (2 if (len(digits) - i) % 2 == 0 else 1) for i, c in enumerate(digits)]
            if sum(d - 9 if d > 9 else d for d in twice) % 10 == 0:
                out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    order = ("email", "ip", "card", "phone")
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab9@.-+ %_1203456()é\n", max_size=60))
def test_base_spans_match_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("4111 1111 1111 1111|a@b.co|1.2.3.4|300.1.1.1|+1 (323) 555-9830|x@y|@|.5|word, ".split("|")), max_size=8))
def test_base_spans_match_patterns_on_pieces(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute_spans(text)


def test_digest_of_whole_documents(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    for r in pii.find_personal_data(documents(spark)).collect():
        spans = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == sha256(joined(spans))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")
        )
        assert set(joined(spans).split(",")) <= set(r.spans.split(","))


def corpus(spark):
    common = ["the report was sent to everyone in the office on monday morning"] * 40
    telling = [f"please ask zanzibar about it, write to boss@corp.example or call room {i}" for i in range(6)]
    often = ["monday the office report again"] * 20
    rows = [(i, t) for i, t in enumerate(common + telling + often)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_terms_that_reveal_an_entity(spark):
    df = corpus(spark)
    found = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    for i in range(40, 46):
        named = {texts[i][int(s):int(e)] for k, s, e in (x.split(":") for x in found[i].spans.split(",")) if k == "reveals"}
        assert "zanzibar" in named and "monday" not in named
    assert all(found[i].spans == "" for i in found if not 40 <= i < 46)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all(clean[i] == texts[i] for i in clean if not 40 <= i < 46)
    assert "zanzibar" not in clean[40] and "boss@" not in clean[40] and "[EMAIL]" in clean[40]


def test_disclosure_is_relative_information(spark):
    df = corpus(spark)
    scanned = pii.scan(df)
    pairs = pii.disclosing_pairs(scanned, pii.term_counts(df)).collect()
    words = [pii.term_of(w)[0] for r in df.collect() for w in r.text.split()]
    near = [n for r in scanned.collect() for n in r.near]
    import math

    for r in pairs:
        joint = sum(n["term"] == r.term for n in near)
        share = joint / words.count(r.term)
        information = math.log2(len(words) / len(near))
        assert 1 + math.log2(share) / information >= pii.GENERALISE_AT


def test_awkward_and_empty(spark):
    rows = pii.find_personal_data(awkward(spark)).collect()
    assert len(rows) == 9 and all(r.spans == "" for r in rows)
    assert pii.find_personal_data(empty(spark)).collect() == []
    same = pii.sanitise(awkward(spark))
    assert same.columns == awkward(spark).columns
    assert sorted(map(repr, same.collect())) == sorted(map(repr, awkward(spark).collect()))
    assert pii.sanitise(empty(spark)).collect() == []


def test_very_many_mentions_take_linear_time():
    """20,000 mentions in one text: seconds, and the same terms as testing every word against every span."""
    text = " ".join(f"Person{i} wrote to a{i}@b.example, then {i % 250}.1.1.1 said so." for i in range(10_000))
    begin = time.perf_counter()
    spans = pii.base_spans(text)
    near = pii.terms_near(text, spans)
    assert len(spans) == 20_000 and len(near) > 100_000 and time.perf_counter() - begin < 20
    short = text[:4_000]
    few = pii.base_spans(short)
    touching = lambda t: any(s < t["end"] and t["start"] < e for _, s, e in few)
    assert not any(map(touching, pii.terms_near(short, few)))


def test_stretches_are_merged():
    assert pii.merged([("ip", 5, 9), ("card", 7, 12), ("email", 20, 22), ("phone", 12, 13)]) == ([5, 20], [13, 22])
