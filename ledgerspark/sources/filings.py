"""Filing index, filing documents and filing metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMES = ("form", "accessionNumber", "primaryDocument", "filingDate", "reportDate")
RECENT = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in _NAMES])
SUBMISSIONS = T.StructType(
    [
        T.StructField("cik", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("filings", T.StructType([T.StructField("recent", RECENT)])),
    ]
)
METADATA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "company",
            "cik",
            "form",
            "filing_date",
            "report_date",
            "accession_number",
            "primary_document",
            "source_url",
        )
    ]
)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSIONS).option("multiLine", True).json(path)


def filing_index(submissions: DataFrame) -> DataFrame:
    """One row per filing; the source keeps a filing's fields in parallel arrays."""
    recent = F.arrays_zip(*[F.col(f"filings.recent.{n}").alias(n) for n in _NAMES])
    return submissions.select("cik", F.posexplode(recent).alias("position", "f")).select(
        "cik",
        "position",
        F.col("f.form").alias("form"),
        F.col("f.accessionNumber").alias("accession_number"),
        F.col("f.primaryDocument").alias("primary_document"),
        F.col("f.filingDate").alias("filing_date"),
        F.col("f.reportDate").alias("report_date"),
    )


def filing_url(cik: Column, accession_number: Column, primary_document: Column) -> Column:
    """Archive address of a filing's main document."""
    return F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"),
        cik.cast("bigint").cast("string"),
        F.lit("/"),
        F.replace(accession_number, F.lit("-"), F.lit("")),
        F.lit("/"),
        primary_document,
    )


def latest_filing(index: DataFrame, form: str = "10-K") -> DataFrame:
    """First filing of the form in index order per company, with its archive address.

    The smallest position is found with a combining aggregate, so a long index is not sorted.
    """
    fields = ("accession_number", "primary_document", "filing_date", "report_date")
    first = F.min_by(F.struct("form", *fields), "position").alias("f")
    latest = index.filter(F.col("form") == form).groupBy("cik").agg(first).select("cik", "f.*")
    return latest.withColumn(
        "source_url", filing_url(F.col("cik"), F.col("accession_number"), F.col("primary_document"))
    )


def read_text_files(spark: SparkSession, path: str, column: str = "html") -> DataFrame:
    """Whole files, one row each, with the path as the filing id."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.input_file_name().alias("filing_id"), F.col("value").alias(column))


def read_filing_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).option("multiLine", True).json(path)
