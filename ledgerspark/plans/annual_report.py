"""Facts to a published, validated annual table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerspark.operators.annual import annual_facts, annual_summary
from ledgerspark.operators.quality import validate
from ledgerspark.sources.tables import new_version, publish_version, remove_folder, write_summary


def build_annual_summary(facts: DataFrame, form: str = "10-K", fp: str = "FY", unit: str = "USD") -> DataFrame:
    return annual_summary(annual_facts(facts, form, fp, unit))


def publish_annual_summary(facts: DataFrame, path: str, strict: bool = True) -> None:
    """Write a new version beside the published one, check what was written, and point readers to it.

    Bad figures never reach readers, and the summary is computed once.
    """
    spark = facts.sparkSession
    version = new_version(path)
    try:
        summary = build_annual_summary(facts)
        write_summary(summary, version)
        if strict:
            # the schema is known, so an empty table is a finding and not a reading error
            validate(spark.read.schema(summary.schema).parquet(version))
        publish_version(spark, path, version)
    except Exception:
        remove_folder(spark, version)
        raise
