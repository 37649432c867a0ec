"""Text expressions: whitespace, sentences, tokens and literal tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark import constants as C
from ledgerspark.functions.binding import bind

SPACE = C.SPACE
SENTENCE_BREAK = rf"(?<=[.!?]){SPACE}+"
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\x{2028}\x{2029}]"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def quote_regex(text: str) -> str:
    """Make ``text`` match itself in a Java pattern."""
    return "".join(f"\\{c}" if c in r"\^$.|?*+()[]{}" else c for c in text)


def strip(col: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(col, rf"^{SPACE}+|{SPACE}+$", "")


def collapse_space(col: Column) -> Column:
    """Turn each run of white space, no-break spaces included, into one blank."""
    return F.regexp_replace(col, f"{SPACE}+", " ")


def replace_all(col: Column, pairs: Mapping[str, str]) -> Column:
    """Apply literal replacements in the given order."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs.items(), col)


def replace_words(col: Column, pairs: Mapping[str, str]) -> Column:
    """Apply whole-word replacements in the given order, ignoring case.

    Texts without any of the words, nearly all, only pay for a plain search.
    """

    def replaced(text: Column) -> Column:
        fixed = reduce(
            lambda c, p: F.regexp_replace(c, rf"(?i)\b{quote_regex(p[0])}\b", p[1]), pairs.items(), text
        )
        hit = bind(F.lower(text), lambda lowered: contains_any(lowered, [w.lower() for w in pairs]))
        return F.when(hit, fixed).otherwise(text)

    return bind(col, replaced)


def clean_filing_text(col: Column, fixes: Mapping[str, str] = C.FILING_SPACING_FIXES) -> Column:
    """Normalise white space and repair words that filing markup glued together."""
    return strip(replace_words(collapse_space(col), fixes))


def split_sentences(col: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space."""
    return F.split(col, SENTENCE_BREAK)


def split_sentences_keeping(col: Column, abbreviations: Iterable[str] = C.ABBREVIATIONS) -> Column:
    """Split into sentences without breaking after the given abbreviations."""
    hidden = replace_all(col, {a: a.replace(".", C.PERIOD_TOKEN) for a in abbreviations})
    return F.transform(
        split_sentences(hidden), lambda s: F.replace(s, F.lit(C.PERIOD_TOKEN), F.lit("."))
    )


def split_lines(col: Column) -> Column:
    return F.split(col, LINE_BREAK)


def tokens(col: Column, stop_words: Iterable[str] = C.STOP_WORDS) -> Column:
    """Lower-cased runs of two or more word characters that are not stop words, in text order."""
    words = F.regexp_extract_all(F.lower(col), F.lit(TOKEN), F.lit(0))
    stop = sorted(set(stop_words))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def _runs(words: Column, n: int) -> Column:
    """Every run of ``n`` neighbouring words, joined by blanks."""

    def run(first: Column, i: Column) -> Column:
        return F.concat_ws(" ", first, *[F.get(words, i + step) for step in range(1, n)])

    starts = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(starts, run)


def ngrams(words: Column, longest: int = 2) -> Column:
    """The words themselves followed by every run of up to ``longest`` neighbours.

    The words are bound once: read inside a lambda, an expression would be evaluated per position.
    """
    if longest <= 1:
        return words
    return bind(words, lambda bound: F.concat(bound, *[_runs(bound, n) for n in range(2, longest + 1)]))


def contains_any(col: Column, needles: Iterable[str]) -> Column:
    """True when the text holds at least one of the needles."""
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(n)) for n in needles], F.lit(False))


def count_occurrences(col: Column, needle: Column) -> Column:
    """How often ``needle`` occurs without overlap."""
    removed = F.length(col) - F.length(F.replace(col, needle, F.lit("")))
    return (removed / F.length(needle)).cast("int")


def string_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
