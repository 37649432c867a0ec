"""Change over time per company: growth, CAGR, intervals, best and worst years, snapshots.

Windows are partitioned by company and run on summary rows, one per fiscal period, so a partition
holds at most a company's reported periods however many facts it filed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.numbers import format_value, formatted, percent_change, signed_percent
from ledgerspark.operators.reshape import series_long

DEFAULT_YEARS = 5


def latest_periods(summary: DataFrame, periods: int = DEFAULT_YEARS) -> DataFrame:
    """The latest ``periods`` rows of each company; pruned before the shuffle by the window limit."""
    newest_first = Window.partitionBy("entity").orderBy(F.col("end").desc())
    ranked = summary.withColumn("_rank", F.row_number().over(newest_first))
    return ranked.filter(F.col("_rank") <= periods).drop("_rank")


def add_growth(summary: DataFrame) -> DataFrame:
    """Changes against the previous row of the same company, NULL on its first row."""
    by_time = Window.partitionBy("entity").orderBy("end")

    def previous(name: str):
        return F.lag(name).over(by_time)

    return summary.withColumns(
        {
            "revenue_growth_pct": percent_change(F.col("revenue_billions"), previous("revenue_billions")),
            "cash_flow_growth_pct": percent_change(
                F.col("operating_cash_flow_billions"), previous("operating_cash_flow_billions")
            ),
            "operating_margin_change_pp": F.col("operating_margin_pct") - previous("operating_margin_pct"),
        }
    )


def revenue_cagr(summary: DataFrame) -> DataFrame:
    """Compound annual growth between a company's first and last row; NULL with a single row."""
    first = F.min_by("revenue_billions", "end")
    last = F.max_by("revenue_billions", "end")
    intervals = F.count("*") - 1
    ratio = F.try_divide(last, first)
    cagr = F.when((intervals > 0) & (ratio >= 0), (F.pow(ratio, 1 / intervals) - 1) * 100)
    return summary.groupBy("entity").agg(F.count("*").alias("periods"), cagr.alias("revenue_cagr_pct"))


def takeaways(summary: DataFrame) -> DataFrame:
    """Headline figures, one row per company: latest growth, CAGR, margin and cash-flow change."""
    return (
        add_growth(summary)
        .groupBy("entity")
        .agg(
            F.max("fiscal_year").alias("latest_year"),
            F.max_by("revenue_growth_pct", "end").alias("revenue_growth_pct"),
            F.max_by("operating_margin_change_pp", "end").alias("operating_margin_change_pp"),
            F.max_by("cash_flow_growth_pct", "end").alias("cash_flow_growth_pct"),
            F.min_by("revenue_billions", "end").alias("_first"),
            F.max_by("revenue_billions", "end").alias("_last"),
            (F.count("*") - 1).alias("_intervals"),
        )
        .withColumn("_ratio", F.try_divide("_last", "_first"))
        .withColumn(
            "revenue_cagr_pct",
            F.when(
                (F.col("_intervals") > 0) & (F.col("_ratio") >= 0),
                (F.pow("_ratio", 1 / F.col("_intervals")) - 1) * 100,
            ),
        )
        .drop("_first", "_last", "_intervals", "_ratio")
    )


def kpi_snapshot(summary: DataFrame, fiscal_year: int | None = None) -> DataFrame:
    """Four headline values per company and year with the note shown under each.

    Growth is taken before the year is picked, so it sees the preceding row.
    """
    grown = add_growth(summary)
    if fiscal_year is not None:
        grown = grown.filter(F.col("fiscal_year") == fiscal_year)

    def change_note(name: str):
        return F.when(
            F.col(name).isNotNull(), F.concat(signed_percent(F.col(name)), F.lit(" year-over-year"))
        ).otherwise(F.lit("First year in range"))

    def card(position: int, label: str, value: str, note):
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(label).alias("label"),
            F.col(value).alias("value"),
            format_value(F.col(value), F.lit("$B")).alias("display"),
            note.alias("note"),
        )

    cards = F.array(
        card(1, "Revenue", "revenue_billions", change_note("revenue_growth_pct")),
        card(
            2,
            "Operating Income",
            "operating_income_billions",
            F.coalesce(formatted("%.2f%% operating margin", F.col("operating_margin_pct")), F.lit("n/a")),
        ),
        card(
            3,
            "Net Income",
            "net_income_billions",
            F.coalesce(formatted("%.2f%% net margin", F.col("net_profit_margin_pct")), F.lit("n/a")),
        ),
        card(4, "Operating Cash Flow", "operating_cash_flow_billions", change_note("cash_flow_growth_pct")),
    )
    return grown.select("entity", "fiscal_year", "end", F.inline(cards))


def overall_change(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """First-to-last absolute and relative change of each metric per company."""
    return (
        series_long(summary, metrics)
        .groupBy("entity", "metric")
        .agg(
            F.min("fiscal_year").alias("first_year"),
            F.max("fiscal_year").alias("last_year"),
            F.min_by("value", "end").alias("first_value"),
            F.max_by("value", "end").alias("last_value"),
        )
        .withColumn("value_change", F.col("last_value") - F.col("first_value"))
        .withColumn("growth_pct", F.try_divide("value_change", "first_value") * 100)
    )


def best_worst_year(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Year of the highest and of the lowest value; the earlier year wins a tie."""
    year = F.col("fiscal_year")
    return (
        series_long(summary, metrics)
        .groupBy("entity", "metric")
        .agg(
            F.max_by("fiscal_year", F.struct("value", (-year).alias("y"))).alias("highest_year"),
            F.min_by("fiscal_year", F.struct("value", "fiscal_year")).alias("lowest_year"),
        )
    )


def interval_changes(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Largest interval and direction flags per company and metric.

    Changes are taken between displayed values (two decimals), which is what readers compare.
    """
    by_time = Window.partitionBy("entity", "metric").orderBy("end")
    shown = F.round("value", 2)
    steps = series_long(summary, metrics).select(
        "entity",
        "metric",
        F.lag("fiscal_year").over(by_time).alias("start_year"),
        F.col("fiscal_year").alias("end_year"),
        (shown - F.lag(shown).over(by_time)).alias("change"),
    )
    size = F.struct(F.round(F.abs("change"), 6).alias("size"), (-F.col("start_year")).alias("y"))
    return (
        steps.filter(F.col("start_year").isNotNull())
        .groupBy("entity", "metric")
        .agg(
            F.count("*").alias("intervals"),
            F.max_by("start_year", size).alias("largest_start"),
            F.max_by("end_year", size).alias("largest_end"),
            F.max_by("change", size).alias("largest_change"),
            F.bool_and(F.col("change") >= 0).alias("never_fell"),
            F.bool_and(F.col("change") <= 0).alias("never_rose"),
        )
    )
