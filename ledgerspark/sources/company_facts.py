"""Company facts: nested JSON, one document per company, to fact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT = T.StructType(
    [
        T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()),
        T.StructField("val", T.DoubleType()),
        T.StructField("accn", T.StringType()),
        T.StructField("fy", T.IntegerType()),
        T.StructField("fp", T.StringType()),
        T.StructField("form", T.StringType()),
        T.StructField("filed", T.StringType()),
        T.StructField("frame", T.StringType()),
    ]
)
CORRUPT = "_corrupt"
CONCEPT = T.StructType(
    [
        T.StructField("units", T.MapType(T.StringType(), T.ArrayType(FACT))),
        T.StructField(CORRUPT, T.StringType()),
    ]
)
# Taxonomies, concepts and units are keys of the document, hence maps: inferring a schema would
# turn each of thousands of concept names into a column. A concept stays JSON text until it has a row
# of its own, so a very large company is never held as one nested value.
COMPANY_FACTS = T.StructType(
    [
        T.StructField("cik", T.StringType()),
        T.StructField("entityName", T.StringType()),
        T.StructField(
            "facts", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
        ),
        T.StructField(CORRUPT, T.StringType()),
    ]
)
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    """Read a folder of company documents, one JSON object per file, with the file as ``document``.

    Malformed files stay as rows whose text is in ``_corrupt``; see ``quarantined_documents``.
    """
    read = spark.read.schema(COMPANY_FACTS).options(multiLine=True, **_OPTIONS).json(path)
    return read.withColumn("document", F.input_file_name())


def parse_company_facts(documents: DataFrame, json: str = "json", document: Column | None = None) -> DataFrame:
    """Parse documents already held in a text column; ``document`` names them in the quarantine."""
    named = F.lit(None).cast("string") if document is None else document.cast("string")
    parsed = documents.select(F.from_json(json, COMPANY_FACTS, _OPTIONS).alias("d"), named.alias("document"))
    return parsed.select("d.*", "document")


def _concepts(companies: DataFrame, taxonomy: str, entity: Column, partitions: int | None) -> DataFrame:
    concepts = companies.filter(F.col(CORRUPT).isNull()).select(
        entity.alias("entity"), F.explode(F.try_element_at("facts", F.lit(taxonomy))).alias("concept", "json")
    )
    if partitions:
        concepts = concepts.repartition(partitions, "entity", "concept")
    return concepts.withColumn("body", F.from_json("json", CONCEPT, _OPTIONS))


def flatten_facts(
    companies: DataFrame, taxonomy: str = "us-gaap", entity: Column | None = None, partitions: int | None = None
) -> DataFrame:
    """One row per reported fact of the well-formed documents and concepts.

    With ``partitions``, the concepts of very large documents are dealt out before they are parsed.
    """
    entity = F.col("cik") if entity is None else entity
    concepts = _concepts(companies, taxonomy, entity, partitions)
    units = concepts.select("entity", "concept", F.explode("body.units").alias("unit", "records"))
    return units.select("entity", "concept", "unit", F.inline("records")).select(
        "entity",
        "concept",
        "unit",
        F.to_date("start").alias("start"),
        F.to_date("end").alias("end"),
        "val",
        "form",
        "fp",
        F.to_date("filed").alias("filed"),
        "accn",
    )


def quarantined_documents(companies: DataFrame, taxonomy: str = "us-gaap", characters: int = 200) -> DataFrame:
    """(document, concept, reason, beginning): documents, and concepts of good ones, that aren't as expected."""
    # files can't be asked for their malformed text alone, so another column is always read
    malformed = F.col(CORRUPT).isNotNull() & (F.coalesce(F.length("cik"), F.lit(-1)) >= -1)
    whole = companies.filter(malformed).select(
        "document",
        F.lit(None).cast("string").alias("concept"),
        F.lit("document is malformed").alias("reason"),
        F.left(CORRUPT, F.lit(characters)).alias("beginning"),
    )
    parts = _concepts(companies, taxonomy, F.col("document"), None).filter(
        F.col("json").isNotNull() & (F.col("body").isNull() | F.col(f"body.{CORRUPT}").isNotNull())
    )
    parts = parts.select(
        F.col("entity").alias("document"), "concept", F.lit("concept is malformed").alias("reason"), F.left("json", F.lit(characters)).alias("beginning")
    )
    return whole.unionByName(parts)
