"""Wide to long and back, and the display form of the summary table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark import constants as C


def series_long(summary: DataFrame, metrics: Sequence[str] = C.SUMMARY_METRICS) -> DataFrame:
    """One row per company, period and metric."""
    return summary.unpivot(["entity", "end", "fiscal_year"], list(metrics), "metric", "value")


def transpose_years(
    summary: DataFrame, years: Sequence[int], metrics: Sequence[str] = C.SUMMARY_METRICS
) -> DataFrame:
    """One row per company and metric with a column ``FY<year>`` for each requested year."""
    # a year with two period ends shows the later one
    latest = {
        y: F.max_by(
            F.when(F.col("fiscal_year") == y, F.col("value")), F.when(F.col("fiscal_year") == y, F.col("end"))
        ).alias(f"FY{y}")
        for y in years
    }
    return series_long(summary, metrics).groupBy("entity", "metric").agg(*latest.values())


def display_table(
    summary: DataFrame, columns: Mapping[str, str] = C.DISPLAY_COLUMNS, decimals: int = 2
) -> DataFrame:
    """Renamed and rounded columns for display, company first."""
    types = dict(summary.dtypes)
    shown = [
        (F.round(name, decimals) if types[name] == "double" else F.col(name)).alias(title)
        for name, title in columns.items()
    ]
    return summary.select("entity", *shown)


def years_descending(summary: DataFrame) -> DataFrame:
    """(entity, years): the fiscal years of each company, latest first; its periods bound the list."""
    years = F.sort_array(F.collect_set("fiscal_year"), asc=False)
    return summary.groupBy("entity").agg(years.alias("years"))
