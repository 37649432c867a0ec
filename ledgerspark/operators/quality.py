"""Data quality report over the annual summary, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark import constants as C
from ledgerspark.functions.numbers import is_missing
from ledgerspark.operators.annual import require_columns

REQUIRED_COLUMNS = ("end", *C.SUMMARY_METRICS)


class QualityError(ValueError):
    """A strict validation found a failing check."""


def quality_report(summary: DataFrame, required: tuple[str, ...] = REQUIRED_COLUMNS) -> DataFrame:
    """Rows (position, check, failed_rows, passed), in the order the checks apply.

    Groups are counted per (entity, end) first, combining before the shuffle; the second, global
    step only adds up those counters.
    """
    absent = require_columns(summary, required)
    if absent:
        return summary.sparkSession.range(1).select(
            F.lit(0).alias("position"),
            F.lit(f"Missing columns: {', '.join(absent)}").alias("check"),
            F.lit(len(absent)).cast("bigint").alias("failed_rows"),
            F.lit(False).alias("passed"),
        )

    types = dict(summary.dtypes)
    incomplete = F.lit(False)
    for name in summary.columns:
        incomplete = incomplete | is_missing(F.col(name), types[name] in ("double", "float"))
    margin = F.col("operating_margin_pct")
    rules = {
        "Financial data contains missing values.": incomplete,
        "Revenue must be positive.": F.col("revenue_billions") <= 0,
        **{f"{c} must be positive.": F.col(c) <= 0 for c in C.POSITIVE_COLUMNS},
        "Operating margin is outside the expected range.": ~F.coalesce(margin.between(0, 100), F.lit(False)),
    }
    keys = [k for k in ("entity", "end") if k in summary.columns]
    per_period = summary.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.count_if(failed).alias(f"r{i}") for i, failed in enumerate(rules.values())],
    )
    totals = per_period.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"),
        *[F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"r{i}") for i in range(len(rules))],
    )
    names = list(rules)
    ordered = [
        ("Financial data is empty.", F.when(F.col("rows") == 0, 1).otherwise(0)),
        (names[0], F.col("r0")),
        ("Financial data contains duplicate fiscal years.", F.col("repeats")),
        *[(name, F.col(f"r{i}")) for i, name in enumerate(names) if i > 0],
    ]
    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("check"),
                failed.cast("bigint").alias("failed_rows"),
                (failed == 0).alias("passed"),
            )
            for i, (name, failed) in enumerate(ordered, start=1)
        ]
    )
    return totals.select(F.inline(lines))


def validate(summary: DataFrame) -> DataFrame:
    """Return the summary unchanged, or raise on the first failing check."""
    failures = quality_report(summary).filter(~F.col("passed")).orderBy("position").limit(1).collect()
    if failures:
        raise QualityError(failures[0]["check"])
    return summary
