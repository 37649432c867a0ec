"""Clean-up of generated answers and parsing of line-oriented evidence, over text columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark import constants as C
from ledgerspark.functions.binding import bind
from ledgerspark.functions.numbers import first_number
from ledgerspark.functions.text import replace_all, split_lines, strip


def _spacing(text: Column, fixes: Mapping[str, str]) -> Column:
    """Repair glued words and the blanks missing after sentences, before citations, after units."""
    text = replace_all(text, fixes)
    for pattern, replacement in C.ANSWER_SPACING_PATTERNS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _clean_line(line: Column, cells: Column) -> Column:
    """(keep, blank, out) of one line: rules and table headers go, other rows become sentences."""
    is_rule = line.rlike(C.TABLE_RULE)
    head = F.get(cells, F.lit(0))
    rest = F.filter(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: c != "")
    is_row = F.contains(line, F.lit("|"))
    is_header = is_row & F.lower(head).isin(*C.TABLE_HEADER_CELLS)
    as_row = F.concat(head, F.lit(": "), F.array_join(rest, ", "))
    plain = F.regexp_replace(line, C.LINE_MARKS, "")
    blank = line == ""
    return F.struct(
        (blank | ~(is_rule | is_header)).alias("keep"),
        blank.alias("blank"),
        F.when(blank, F.lit("")).when(is_row & (F.size(cells) >= 2), as_row).otherwise(plain).alias("out"),
    )


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, C.CELL_BORDERS, ""), r"\|"), strip)


def _without_repeated_blanks(lines: Column) -> Column:
    """A blank line stays only behind a line with text; an earlier blank is no such line either way."""
    return F.filter(
        lines, lambda s, i: ~s["blank"] | ((i > 0) & (F.coalesce(F.get(lines, i - 1)["out"], F.lit("")) != ""))
    )


def clean_generated_text(text: Column, fixes: Mapping[str, str] = C.ANSWER_SPACING_FIXES) -> Column:
    """Plain, evenly spaced text: no bold marks, no table syntax, single blank lines."""
    raw = split_lines(_spacing(text, fixes))
    lines = F.transform(raw, lambda line: F.replace(strip(line), F.lit("**"), F.lit("")))
    cleaned = F.transform(lines, lambda line: bind(_cells(line), lambda cells: _clean_line(line, cells)))
    kept = bind(F.filter(cleaned, lambda s: s["keep"]), _without_repeated_blanks)
    return strip(F.array_join(F.transform(kept, lambda s: s["out"]), "\n"))


def parse_evidence(evidence: DataFrame, key: str = "question_id", text: str = "evidence") -> DataFrame:
    """Rows (key, kind, fiscal_year, label, value, number) of a figures text.

    kind is ``year`` for values under a year heading, ``overall`` for the change block and
    ``single`` for a one-value text. A repeated year heading starts that year afresh and the last
    of equal labels counts. A text is read within its row; nothing is shuffled.
    """
    entries = bind(F.transform(split_lines(F.col(text)), strip), lambda lines: _section_entries(lines))
    single = F.when(
        F.col(text).rlike(C.SINGLE_VALUE),
        F.array(
            F.struct(
                F.lit("single").alias("kind"),
                F.regexp_extract(text, C.SINGLE_VALUE, 2).cast("int").alias("fiscal_year"),
                F.regexp_extract(text, C.SINGLE_VALUE, 1).alias("label"),
                F.regexp_extract(text, C.SINGLE_VALUE, 3).alias("value"),
            )
        ),
    )
    found = F.concat(entries, F.coalesce(single, F.slice(entries, 1, 0)))
    return evidence.select(key, F.inline(found)).withColumn("number", first_number(F.col("value")))


def _heading(line: Column) -> Column:
    """The (kind, fiscal_year) that a line opens, NULL for lines that open nothing."""
    year = F.regexp_extract(line, C.YEAR_HEADING, 1)
    opens = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("int").alias("fiscal_year"))
    return (
        F.when(year != "", opens("year", year))
        .when(line.startswith(C.CHANGE_HEADING), opens("overall", F.lit(None)))
        .when(line.startswith(C.SOURCE_HEADING), opens("none", F.lit(None)))
    )


def _last_of_each(items: Column, *keys: str) -> Column:
    """Of items sorted by their keys and then by place, the last of each equal keys."""

    def differs(item: Column, i: Column, every: Column) -> Column:
        following = F.get(every, i + 1)
        return following.isNull() | reduce(lambda a, b: a | b, [~item[k].eqNullSafe(following[k]) for k in keys])

    return bind(F.array_sort(items), lambda every: F.filter(every, lambda item, i: differs(item, i, every)))


def _section_entries(lines: Column) -> Column:
    """(kind, fiscal_year, label, value) of the lines with a colon, by the heading they stand under.

    Sections are cut at their headings, so every line is looked at once; sorting finds the last heading
    of a year and the last of equal labels.
    """
    at = F.transform(lines, lambda line, i: F.struct(_heading(line).alias("heading"), i.alias("at")))
    headings = F.filter(at, lambda h: h["heading"].isNotNull())

    def section(h: Column, i: Column, every: Column) -> Column:
        end = F.coalesce(F.get(every, i + 1)["at"], F.size(lines))
        body = F.slice(lines, h["at"] + 2, F.greatest(end - h["at"] - 1, F.lit(0)))
        # only year headings start afresh; all change blocks count
        start = F.when(h["heading"]["kind"] == "year", F.lit(0)).otherwise(h["at"])
        return F.struct(
            h["heading"]["kind"].alias("kind"), h["heading"]["fiscal_year"].alias("fiscal_year"), start.alias("start"), h["at"].alias("at"), body.alias("body")
        )

    sections = bind(headings, lambda every: F.transform(every, lambda h, i: section(h, i, every)))
    newest = _last_of_each(F.filter(sections, lambda s: s["kind"] != "none"), "kind", "fiscal_year", "start")

    def entry(s: Column, line: Column, i: Column) -> Column:
        return F.struct(
            s["kind"].alias("kind"),
            s["fiscal_year"].alias("fiscal_year"),
            strip(F.substring_index(line, ":", 1)).alias("label"),
            (s["at"] + i).alias("at"),
            strip(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("value"),
        )

    def entries(s: Column) -> Column:
        # places are taken before lines without a colon are dropped
        return F.filter(F.transform(s["body"], lambda line, i: F.when(F.contains(line, F.lit(":")), entry(s, line, i))), lambda e: e.isNotNull())

    last = _last_of_each(F.flatten(F.transform(newest, entries)), "kind", "fiscal_year", "label")
    return F.transform(last, lambda e: F.struct(*[e[c].alias(c) for c in ("kind", "fiscal_year", "label", "value")]))
