import random
import re
import string
import time

from corpus import awkward, documents, empty

from ledgerspark.llm import secret_scan as secrets
from ledgerspark.llm.common import joined, sha256


def brute_spans(text):
    out = []
    pattern = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [("assign", *m.span()) for m in re.finditer(pattern, text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ("assign", "access", "hex")
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def test_base_spans():
    cases = [
        'Password: "hunter2hunter2" API_KEY=abcdefgh token = short',
        "toKen=abcdefgh1 toKen=abcdefgh1",  # the Kelvin sign is no k
        "AKIAABCDEFGHIJKL AKIASHORT xAKIA0123456789ABCD",
        "0" * 31 + " " + "a1" * 20 + "g" + "f" * 32,
        "secret:secret:abcdefghij",
    ]
    for text in cases:
        assert secrets.base_spans(text) == brute_spans(text)


def test_digest_of_whole_documents(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    for r in secrets.find_secrets(documents(spark)).collect():
        spans = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == sha256(joined(spans))
        assert set(joined(spans).split(",")) <= set(r.spans.split(","))


def test_battery_tells_random_runs_from_structured_ones():
    rng = random.Random(4)
    letters = string.ascii_letters + string.digits + "+/"
    random_runs = ["".join(rng.choices(letters, k=44)) for _ in range(200)]
    encoded = [secrets.infer_encoding(r) for r in random_runs]
    kept = [secrets.randomness_p(r, e) > 0.01 for r, e in zip(random_runs, encoded) if e]
    assert sum(kept) / len(kept) > 0.95
    for run in ("a1" * 22, "section-3-of-the-annual-report-for-the-year", "0123456789abcdefghijklmnopqrstuvwxyz", "x" * 30 + "1"):
        assert secrets.randomness_p(run, secrets.infer_encoding(run)) < 0.01
    assert secrets.infer_encoding("plainwordsonly") is None and secrets.infer_encoding("123456") is None


def test_false_discovery_control_matches_sorting():
    rng = random.Random(1)
    bins = [secrets.p_bin(rng.random() ** rng.choice((1, 30))) for _ in range(500)]
    cut = secrets.rejection_bins({(6, b): bins.count(b) for b in set(bins)}, 0.05)[6]
    edges = sorted(10 ** (-b / secrets.BINS_PER_DECADE) for b in bins)
    # the step-up procedure on the bins' upper edges
    passed = [p for i, p in enumerate(edges, 1) if p <= 0.05 * i / len(edges)]
    assert {b for b in bins if b >= cut} == {b for b in bins if passed and 10 ** (-b / secrets.BINS_PER_DECADE) <= max(passed)}


def test_added_spans(spark):
    rng = random.Random(2)
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    rows = [(1, f"the key {key} is here"), (2, "see section-3-of-the-annual-report-for-the-year 2020")]
    out = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1].spans == f"random:8:{8 + len(key)}" and out[2].spans == ""


def test_awkward_and_empty(spark):
    rows = secrets.find_secrets(awkward(spark)).collect()
    assert len(rows) == 9 and all(r.n_assign == r.n_access == r.n_hex == 0 for r in rows)
    assert secrets.find_secrets(empty(spark)).collect() == []


def test_keys_in_paths_prefixes_and_letters_are_found(spark):
    """Keys glued to a path or a prefix, short ones and ones without digits; words and paths are not."""
    rng = random.Random(11)
    key = lambda n, letters=string.ascii_letters + string.digits: "".join(rng.choices(letters, k=n))
    keys = ["https://host.example/hook/v2-x/" + key(40), key(18), "sk_live_" + key(24), key(28, string.ascii_letters), key(32)]
    words = ["Zueinlichlichlich", "Thndtionthwhhest", "getElementsByClassNameOfNode", "/usr/local/share/applications-menu/defaults", "2024-10-31T10-15-30-0000"]
    rows = [(i, f"see {k} there") for i, k in enumerate(keys)] + [(100 + i, f"see {w} there") for i, w in enumerate(words * 12)]
    found = {r.doc_id: r.n_random for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert all(found[i] == 1 for i in range(5))
    assert sum(n > 0 for i, n in found.items() if i >= 100) == 0


def test_many_spans_and_runs_take_linear_time():
    text = "a0f4" * 10 + " " + ("0123456789abcdef" * 2 + " X1y2Z3a4B5c6D7e8F9g0 ") * 20_000
    spans = secrets.base_spans(text)
    begin = time.perf_counter()
    assert len(spans) > 20_000 and len(secrets.candidates(text, spans)) == 20_000
    assert time.perf_counter() - begin < 20
