import html
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerspark import constants as C
from ledgerspark.functions import text as X
from ledgerspark.functions.html import html_to_text, unescape_html
from ledgerspark.operators import chunking, generated_text, sections, topics


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def packed(text, limit, overlap):
    """The plain definition of greedy packing."""
    out, current = [], []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        if current and len(" ".join([*current, sentence])) > limit:
            out.append(" ".join(current))
            current = (current[-overlap:] if overlap else []) + [sentence]
        else:
            current.append(sentence)
    return [*out, " ".join(current)]


def chunk_list(spark, text, limit, overlap):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = chunking.chunk_text(df, limit, overlap).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == list(range(1, len(rows) + 1))
    return [r["text"] for r in rows]


def test_chunks_keep_all_sentences(spark):
    text = "The firm faces rivals. Demand may shrink. Costs may go up."
    chunks = chunk_list(spark, text, 30, 0)
    assert len(chunks) == 3 and " ".join(chunks) == text and all(len(c) <= 30 for c in chunks)


@pytest.mark.parametrize("overlap", [0, 1, 2, 5])
@pytest.mark.parametrize("limit", [1, 20, 60, 1500])
def test_chunks_match_the_plain_definition(spark, limit, overlap):
    text = "One. Two is a bit longer! Is three?  Four here. " + "x" * 70 + ". Five. Six. Seven is here. é€. "
    assert chunk_list(spark, text, limit, overlap) == packed(text, limit, overlap)


def test_chunks_of_an_empty_text(spark):
    assert chunk_list(spark, "", 10, 1) == [""]


def seconds(df):
    """The quicker of two runs."""
    def run():
        begin = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    run()
    return min(run(), run())


def test_packing_is_linear(spark):
    """A text of 100,000 sentences takes about ten times as long as one of 10,000, and packs the same."""
    text = lambda n: " ".join(f"Sentence number {i} é is of some length." for i in range(n))
    assert chunk_list(spark, text(5_000), 300, 2) == packed(text(5_000), 300, 2)
    texts = {n: spark.createDataFrame([(1, text(n))], "id int, text string").coalesce(1).cache() for n in (10_000, 100_000)}
    short, long = (seconds(chunking.chunk_text(df, 300, 1)) for df in texts.values())
    assert long < 25 * max(short, 0.1)


def test_term_pairs_are_linear(spark):
    """The words of a text are read once, not once per position."""
    texts = {n: spark.createDataFrame([(" ".join(f"word{i % 5000}" for i in range(n)),)], "t string").coalesce(1).cache() for n in (2_000, 20_000)}
    short, long = (seconds(df.select(X.ngrams(X.tokens(F.col("t"))))) for df in texts.values())
    assert long < 25 * max(short, 0.1)


def test_abbreviations_do_not_end_sentences(spark):
    text = "Acme Inc. is exposed to the U.S. dollar. Other currencies matter."
    assert one(spark, text, X.split_sentences_keeping) == [
        "Acme Inc. is exposed to the U.S. dollar.",
        "Other currencies matter.",
    ]


@pytest.mark.parametrize(
    "text",
    ["a &amp; b", "&lt;p&gt;", "x&#8217;s &#x2019;", "&nbsp;&copy;&euro;", "&unknown; &", "AT&T &amp;amp;", "&#146;", "no reference"],
)
def test_references_decode_like_the_standard_library(spark, text):
    assert one(spark, text, unescape_html) == html.unescape(text)


def test_markup_to_text(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T&amp;C</title><style>p{}</style><script>var t='</p><b>';</script></head>"
        "<body><!-- <p>hidden</p> --><p>resul<b>ts</b>&nbsp;\n 5 < 6</p><TEMPLATE>x</TEMPLATE>canbe ANDTHE</body></html>"
    )
    assert one(spark, page, html_to_text) == "T&C resul ts 5 < 6 can be and the"


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<p title=\"a > b\" class='x>y'>shown</p>", "shown"),
        ("a<script>var x = '</p>'; if (a < b) go()", "a"),
        ("a<script>x</SCRIPT >b<style>p > q {}</style>c<template>d", "a b c"),
        ("a <b title=\"never ends>bold</b> c", "a bold c"),
        ("1 < 2 and a<!-- <p> -- > hidden --> c <!-- open", "1 < 2 and a c"),
        ("x <a href='?q=\"'>link</a> y", "x link y"),
        ("<" + "a 'b>' " * 5_000 + ">" + " end", None),
        ("<a " + '"x" ' * 100_000 + ">end", "end"),
        ("<script>" + "<x " * 300_000, ""),
    ],
)
def test_tags_are_read_as_a_browser_does(spark, page, expected):
    """Quoted values, raw text elements, comments; texts that would exhaust a recursive scanner."""
    got = one(spark, page, html_to_text)
    assert got == expected if expected is not None else got.endswith("end")


def test_every_named_reference(spark):
    from html.entities import html5

    text = " ".join(f"&{name}" for name in html5) + " &notit; &copy2024 &#8364 &#x20AC; &nosuch; &"
    assert one(spark, text, unescape_html) == html.unescape(text)


def test_sections_skip_the_table_of_contents(spark):
    filler = "Nothing to see. " * 60
    body = (
        "Item 1A. Risk Factors 5 Item 1B. Unresolved Staff Comments 17 "
        + filler
        + "Item 1A. Risk Factors The following summarizes factors. Much risk. Item 1B. Unresolved Staff Comments None."
    )
    rows = sections.extract_sections(spark.createDataFrame([(1, body), (2, filler)], "id int, text string"))
    found = sections.found_sections(rows).collect()
    assert [(r["id"], r["text"]) for r in found] == [
        (1, "Item 1A. Risk Factors The following summarizes factors. Much risk.")
    ]
    assert sections.quarantined_sections(rows).count() == 3


def test_tokens_and_pairs(spark):
    words = one(spark, "The Über-risk of a 10x tax_rate, and tax", lambda c: X.tokens(c))
    assert words == ["über", "risk", "10x", "tax_rate", "tax"]
    pairs = one(spark, "risk tax law", lambda c: X.ngrams(X.tokens(c), 3))
    assert pairs == ["risk", "tax", "law", "risk tax", "tax law", "risk tax law"]
    assert one(spark, "risk", lambda c: X.ngrams(X.tokens(c))) == ["risk"]
    assert one(spark, "", lambda c: X.ngrams(X.tokens(c))) == []


def test_default_stop_words_are_those_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    shipped = StopWordsRemover.loadDefaultStopWords("english")
    assert set(C.STOP_WORDS) == {w for w in shipped if "'" not in w}


def test_generated_text_cleanup(spark):
    raw = "# **Fleet**\n|Ship|Crew|\n|:--|--:|\n|Aurora|12|\n\n\n\n* loads rose up7 to 4Mtons[3].Then 9%fell"
    cleaned = one(spark, raw, generated_text.clean_generated_text).split("\n")
    assert cleaned[:3] == ["Fleet", "Ship: Crew", "Aurora: 12"]
    assert cleaned[3] == "" and len(cleaned) == 5
    assert cleaned[4].endswith("loads rose up 7 to 4M tons [3]. Then 9% fell")


def test_space_before_each_citation(spark):
    assert one(spark, "A known risk[1][M2].", generated_text.clean_generated_text) == "A known risk [1] [M2]."


def test_parse_evidence(spark):
    text = (
        "No financial data was found for: FY2031\n\nFinancial metrics by fiscal year:\n\nFY2024\nRevenue: $1.00B\nRevenue: $2.00B\n"
        "\nFY2025\nNet Income: $-4.93B\n\nOverall change from FY2024 to FY2025:\nRevenue: -$4.93B\n\nSource: x: y"
    )
    df = spark.createDataFrame([(1, text), (2, "Revenue in FY2025: $1,416.16B")], "question_id int, evidence string")
    rows = {(r["question_id"], r["kind"], r["fiscal_year"], r["label"], r["value"], r["number"]) for r in generated_text.parse_evidence(df).collect()}
    assert rows == {
        (1, "year", 2024, "Revenue", "$2.00B", 2.0),
        (1, "year", 2025, "Net Income", "$-4.93B", -4.93),
        (1, "overall", None, "Revenue", "-$4.93B", 4.93),
        (2, "single", 2025, "Revenue", "$1,416.16B", 1416.16),
    }


def test_evidence_is_parsed_in_its_row(spark):
    """No exchange; headings and labels that repeat, other sections, blanks, very many lines."""
    text = "Label: lost\nFY2024\n A: 1 \nB: 2\nno colon\nFY2025\nA: 3\nFY2024\nA: 4\nC: x: y\nA: 5\nOverall change one:\nD: 6\nSource: z\nE: 7\nOverall change two:\nD: 8\nF: 9"
    many = "FY2020\n" + "\n".join(f"L{i % 700}: {i}" for i in range(30_000))
    rows = [(1, text), (2, None), (3, ""), (4, many), (5, "Revenue in FY2025: $416.16B")]
    parsed = generated_text.parse_evidence(spark.createDataFrame(rows, "question_id int, evidence string"))
    assert "Exchange" not in parsed._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in parsed.collect():
        got.setdefault(r["question_id"], set()).add((r["kind"], r["fiscal_year"], r["label"], r["value"]))
    assert got[1] == {("year", 2024, "A", "5"), ("year", 2024, "C", "x: y"), ("year", 2025, "A", "3"), ("overall", None, "D", "8"), ("overall", None, "F", "9")}
    assert got[5] == {("single", 2025, "Revenue", "$416.16B")} and set(got) == {1, 4, 5}
    assert got[4] == {("year", 2020, f"L{i % 700}", str(i)) for i in range(30_000 - 700, 30_000)}


def test_excerpt_ranks_sentences_by_anchor_hits(spark):
    sentences = ["Rain fell.", "Owls hunt mice.", "Mice fear owls and owls fear none.", "Boats left.", "An owl is a bird."]
    excerpt = one(spark, " ".join(sentences), lambda c: topics.topic_excerpt(c, X.string_array(["owl", "mice"])))
    picked = [s for s in sentences if s in excerpt]
    assert picked == [sentences[1], sentences[2], sentences[4]]
    assert sorted(picked, key=excerpt.index) == picked


def test_excerpt_without_hits_takes_the_first_sentences(spark):
    text = "A. B. C. D. E."
    assert one(spark, text, lambda c: topics.topic_excerpt(c, X.string_array(["zzz"]))) == "A. B. C. D."


def test_page_footers(spark):
    text = "one Acme (U.S.) Inc. | 2025 Form 10-K | 12two"
    assert one(spark, text, lambda c: topics.remove_page_footers(c, "Acme (U.S.) Inc.")) == "one two"


def test_sections_behind_supplementary_characters(spark):
    from ledgerspark.operators import sections

    body = "\U0001f600" * 7 + " Item 1A. Risk Factors The following summarizes factors all kinds \U0001d538 of harm. Item 1B. Unresolved Staff Comments"
    df = spark.createDataFrame([(1, body), (2, body[:60]), (3, None), (4, "\U0001f600 nothing")], "id int, text string")
    rows = {(r["id"], r["section"]): r for r in sections.extract_sections(df).collect()}
    risk = C.SECTION_SPECS[0][0]
    assert rows[1, risk]["text"] == body[8:].rsplit(" Item 1B", 1)[0] and rows[1, risk]["reason"] is None
    assert all((r["text"] is None) == (r["reason"] is not None) for r in rows.values())
    assert rows[3, risk]["reason"] == rows[4, risk]["reason"] == "heading not found"
