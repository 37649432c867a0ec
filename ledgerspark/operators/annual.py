"""Reported facts to one wide row per company and fiscal period.

Facts columns: entity, concept, unit, start, end, val, form, fp, filed, accn.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark import constants as C
from ledgerspark.functions.numbers import percent_of

KEYS = ("entity", "end")


def annual_facts(facts: DataFrame, form: str = "10-K", fp: str = "FY", unit: str = "USD") -> DataFrame:
    """Keep full-year facts from annual filings; plain predicates, so they reach the scan."""
    return facts.filter((F.col("form") == form) & (F.col("fp") == fp) & (F.col("unit") == unit))


def _recency() -> Column:
    """Ordering of competing facts for one period: latest filing, longest span, then fixed tie-breaks."""
    return F.struct(
        F.col("filed"),
        F.date_diff(F.lit("9999-12-31").cast("date"), F.col("start")).alias("span"),
        F.col("accn"),
        F.col("val"),
    )


def latest_facts(facts: DataFrame) -> DataFrame:
    """Keep the most recently filed fact of each (entity, concept, end).

    ``max_by`` is combined before the shuffle, so a key with very many restatements costs each
    task one row instead of flooding one reducer.
    """
    kept = F.max_by(F.struct("val", "filed", "start", "accn"), _recency()).alias("f")
    return facts.groupBy("entity", "concept", "end").agg(kept).select("entity", "concept", "end", "f.*")


def scaled_metric(facts: DataFrame, concept: str, column: str, scale: float = C.UNIT_SCALE) -> DataFrame:
    """One annual metric as (entity, end, column)."""
    value = F.max_by("val", _recency()) / F.lit(float(scale))
    return facts.filter(F.col("concept") == concept).groupBy(*KEYS).agg(value.alias(column))


def add_margins(summary: DataFrame) -> DataFrame:
    revenue = F.col("revenue_billions")
    return summary.withColumns(
        {
            "operating_margin_pct": percent_of(F.col("operating_income_billions"), revenue),
            "net_profit_margin_pct": percent_of(F.col("net_income_billions"), revenue),
        }
    )


def add_fiscal_year(summary: DataFrame) -> DataFrame:
    return summary.withColumn("fiscal_year", F.year("end"))


def annual_summary(
    facts: DataFrame,
    concepts: Mapping[str, str] = C.CONCEPT_COLUMNS,
    scale: float = C.UNIT_SCALE,
) -> DataFrame:
    """Wide table of the periods for which every concept was reported.

    De-duplication, pivot and the all-concepts test are one aggregation with one shuffle. Presence
    is tested, not value: a reported null survives so that the quality report can name it.
    """
    recency = _recency()
    aggregates = []
    for column, concept in concepts.items():
        match = F.col("concept") == concept
        value = F.max_by(F.when(match, F.col("val")), F.when(match, recency))
        aggregates.append((value / F.lit(float(scale))).alias(column))
        aggregates.append(F.bool_or(match).alias(f"_has_{column}"))
    wide = facts.filter(F.col("concept").isin(*concepts.values())).groupBy(*KEYS).agg(*aggregates)
    complete = reduce(lambda a, b: a & b, [F.col(f"_has_{c}") for c in concepts])
    summary = wide.filter(complete).select(*KEYS, *concepts)
    return add_fiscal_year(add_margins(summary))


def annual_summary_by_joins(
    facts: DataFrame,
    concepts: Mapping[str, str] = C.CONCEPT_COLUMNS,
    scale: float = C.UNIT_SCALE,
) -> DataFrame:
    """Same table as inner joins of the metric tables; each input is already hashed on the keys."""
    tables = [scaled_metric(facts, concept, column, scale) for column, concept in concepts.items()]
    joined = reduce(lambda left, right: left.join(right, list(KEYS)), tables)
    return add_fiscal_year(add_margins(joined))


def missing_years(requests: DataFrame, summary: DataFrame) -> DataFrame:
    """Requested (entity, fiscal_year) pairs that the summary does not hold."""
    return requests.join(summary.select("entity", "fiscal_year"), ["entity", "fiscal_year"], "left_anti")


def require_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Names in ``columns`` that the table lacks, in the given order."""
    return [c for c in columns if c not in df.columns]
