"""What the corpus operators share: table access, scratch tables and text normalisation."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.cluster import ship

#: Fixed value: the ASCII capitals, the only letters that normalisation lower-cases.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows in one Arrow batch handed to Python; texts can be long.
BATCH_ROWS = 1000
#: Bytes in one, about, within short_batches().
BATCH_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir. Where that is unset, a temporary one of our own on
    a local master; on any other, executors would each write to a disk of their own, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='leadspark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. The tables
    of an application stand in one folder, which goes when the driver ends."""
    spark = df.sparkSession
    top = f"{scratch_dir(spark)}/leadspark-{spark.sparkContext.applicationId}"
    if top not in _TO_DELETE:
        _TO_DELETE.add(top)
        atexit.register(_delete, spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_TO_DELETE: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    """Delete an application's scratch tables, if its context still runs; what can't be deleted then stays."""
    if spark.sparkContext._jsc is None:
        return
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() does the same on pure ASCII, and is much faster there."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def map_batches(df: DataFrame, make: Callable[[], tuple[Callable, Callable] | Callable], schema: str) -> DataFrame:
    """mapInArrow in slices of BATCH_ROWS rows. make() runs once in each task and returns the function of a slice, or
    that and a function of nothing whose batches come last; both may return None."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        each, finish = made if isinstance(made, tuple) else (made, lambda: None)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                out = each(batch.slice(start, BATCH_ROWS))
                if out is not None and out.num_rows:
                    yield out
        if (out := finish()) is not None and out.num_rows:
            yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, object]) -> Iterator[None]:
    """The session's settings return when it ends."""
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def short_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What runs within it gets batches of BATCH_ROWS rows and about BATCH_BYTES at most, where Spark would make them of
    10,000 rows: executor and Python worker each hold a batch whole, and room to grow in."""
    return _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES})


def little_disk(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What is made and run within it deletes its shuffled files as soon as it has run, where Spark would keep them until
    the driver happens to collect garbage, and its Parquet tables are packed closely."""
    return _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"})


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], list(columns))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The texts of a slice as UTF-8; null is empty."""
    for value in batch.column(name):
        buffer = value.as_buffer() if value.is_valid else None
        yield b"" if buffer is None else buffer.to_pybytes()


def words_of(text: bytes) -> list[bytes]:
    """Lower-case A-Z and split at the six ASCII white-space characters."""
    return text.lower().split()
