"""What several corpus operators share: batches of bounded size, words, span digests, checkpoints."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ledgerspark.session import checkpoint_dir

# ASCII white space parts words; every other code point belongs to one.
SPACE = r"\x20\x09-\x0D"
WORD = re.compile(rf"[^{SPACE}]+")
BATCH_BYTES = 8 << 20

# (kind, start, end), in code points, end exclusive
Span = tuple[str, int, int]


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, or one longer row."""
    sizes = pc.binary_length(batch[column]).fill_null(0).to_pylist()
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin)


def reachable(df: DataFrame) -> DataFrame:
    """``df``, after Python workers have been told where this package lies on the driver.

    An installed package is found anyway; this is for a checkout that every machine has at one place.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", root)
    return df


def map_texts(
    df: DataFrame,
    column: str,
    body: Callable[[pa.RecordBatch], Iterable[dict] | pa.RecordBatch | None],
    schema: str | StructType,
) -> DataFrame:
    """``mapInArrow`` over slices of bounded bytes; ``body`` returns rows as dicts or a batch."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = body(part)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield pa.RecordBatch.from_pylist(list(out), schema=arrow)

    return reachable(df).mapInArrow(run, kind)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the folder all executors share, and read them again.

    The planner then knows the true size. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
    reachable(df).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def ordered(spans: Iterable[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then by the place of the kind in ``kinds``."""
    rank = {kind: i for i, kind in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the given columns only."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")) / float(1 << 53)


def count_words(text: Column) -> Column:
    """Words of a text; NULL counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("long")
