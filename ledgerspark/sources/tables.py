"""Tables between the steps: chunks, sections and the published summary."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.session import checkpoint_dir

MDA_CHUNK = "chunk_id INT, section STRING, text STRING"
RISK_CHUNK = (
    "chunk_id INT, topic_id INT, topic_label STRING, display_topic_label STRING, topic_score DOUBLE, "
    "topic_share DOUBLE, classification_status STRING, excerpt STRING, text STRING"
)


def read_chunks(spark: SparkSession, path: str, schema: str = MDA_CHUNK) -> DataFrame:
    """Read chunk files, either JSON arrays of objects or JSON lines per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def with_display_fallbacks(chunks: DataFrame) -> DataFrame:
    """Older chunk tables lack the display label or the excerpt; fall back to label and text."""
    for column, fallback in (("display_topic_label", "topic_label"), ("excerpt", "text")):
        source = F.coalesce(column, fallback) if column in chunks.columns else F.col(fallback)
        chunks = chunks.withColumn(column, source)
    return chunks


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def write_sections(sections: DataFrame, path: str) -> None:
    sections.write.mode("overwrite").partitionBy("section").parquet(path)


def write_summary(summary: DataFrame, path: str, tasks_per_year: int = 32) -> None:
    """Partitioned by year, so a question about some years reads only those folders.

    Rows are gathered by year first, with a second key so that one year is not one task.
    """
    spread = summary.repartition("fiscal_year", F.pmod(F.hash("entity"), F.lit(tasks_per_year)))
    spread.write.mode("overwrite").partitionBy("fiscal_year").parquet(path)


CURRENT = "_current"


def new_version(path: str) -> str:
    """A folder beside the versions of a published table, which no reader looks at yet."""
    return f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"


def publish_version(spark: SparkSession, path: str, version: str, keep: int = 2) -> None:
    """Make a finished version the one that readers of ``path`` see.

    Only a small note changes, in one step: before it readers find the old version whole, after it the
    new one, and whatever fails leaves the old one in place. The ``keep`` latest versions stay, for
    readers that are under way.
    """
    root = path.rstrip("/")
    named = version.rstrip("/").rsplit("/", 1)[-1]
    before = read_note(spark, f"{root}/{CURRENT}")
    history = [named, *(v for v in (before or "").split() if v != named)]
    write_note(spark, f"{root}/{CURRENT}", "\n".join(history[:keep]))
    for old in history[keep:]:
        remove_folder(spark, f"{root}/{old}")


def published_folder(spark: SparkSession, path: str) -> str:
    """Where the current version lies; a plain folder is its own version."""
    history = read_note(spark, f"{path.rstrip('/')}/{CURRENT}")
    return f"{path.rstrip('/')}/{history.split()[0]}" if history else path


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Read a published summary, or a plain folder of one; a missing path is an error."""
    return spark.read.parquet(published_folder(spark, path))


def publish_table(df: DataFrame, name: str) -> DataFrame:
    """Create or replace a managed table and return it."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Register a session view for SQL users."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def _file_system(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: readers see the old text or the new one.

    The note is finished beside its place and then renamed over it.
    """
    file, files = _file_system(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(file.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(beside), files.makeQualified(file), options)


def read_note(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    file, files = _file_system(spark, path)
    if not files.exists(file):
        return None
    stream = files.open(file)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove_folder(spark: SparkSession, path: str) -> None:
    file, files = _file_system(spark, path)
    files.delete(file, True)


def scratch_folder(spark: SparkSession, prefix: str = "tables") -> str:
    """A new folder where all executors can write; it goes when the application ends."""
    path = f"{checkpoint_dir(spark)}/{prefix}-{uuid.uuid4().hex}"
    folder, files = _file_system(spark, path)
    files.deleteOnExit(folder)
    return path


def scratch_table(df: DataFrame) -> DataFrame:
    """Write rows that several steps read, and read them again; the planner then knows their size."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
