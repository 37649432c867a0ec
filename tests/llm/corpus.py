"""Small tables for the corpus operators: awkward rows, and documents of the shared test tables."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, id string, text_hash int, size string, key double"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))

AWKWARD = [
    # NULLs, empty and blank texts, repeats, ties, a very long text; the last columns clash with inner names
    (1, None, "en", "a", "x", 1, "s", 0.5),
    (2, "", "en", "a", "x", 1, "s", 0.5),
    (3, " \t\n ", None, None, None, None, None, None),
    (4, "one two three four five six seven eight nine ten eleven", "en", "b", "x", 1, "s", 0.5),
    (4, "one two three four five six seven eight nine ten eleven", "en", "b", "x", 1, "s", 0.5),
    (5, "one two three four five six seven eight nine ten eleven", "en", "b", "x", 1, "s", 0.5),
    (None, "no id here but some words anyway", "en", "b", "x", 1, "s", 0.5),
    (6, LONG, "de", "c", "x", 1, "s", 0.5),
    (7, "ünï cödé 😀😀 text with odd spaces", "fr", None, "x", 1, "s", 0.5),
]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(rows, schema="doc_id bigint, text string"):
    return lambda spark: spark.createDataFrame(rows, schema)
