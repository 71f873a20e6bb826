"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  loads pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in an Arrow batch, and bytes of text that a function is given at once.
BATCH_ROWS = 1000
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch, of a Parquet row group, which a writer holds in memory, and rows of a batch that is read.
BATCH_BYTES, GROUP_BYTES, READ_ROWS = 1 << 20, 16 << 20, 512


def arrow_session(spark: SparkSession) -> None:
    """Keep batches small, as texts can be long. The settings are read when a query runs, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``; where that is unset, as in tests on one
    machine, one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: it cuts lineage and outlives executors. As a result
    may be read at any time, nothing is deleted here; the folder is the session's owner's to clear."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose values in a string column have at most ``limit`` bytes, or one row each."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of a string column; null gives an empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Returns memory that Python has freed to the machine: workers stay alive between tasks, several to an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def frugal(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over batches that gives memory back at its end."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def fresh(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as keep it apart from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def per_text(df: DataFrame, make: Callable[[], Callable[[list], dict]], outputs: str, text: str = "text", drop_text: bool = False, raw: bool = True) -> DataFrame:
    """Appends columns that depend on the text of a row alone. It neither shuffles nor gathers rows, and only the text
    travels to Python; other columns stay where they are.

    ``make()`` runs once in a task and gives a function from a list of texts (bytes if ``raw``, else str or None) to a
    dict of lists, one for each column in the DDL string ``outputs``. A column of ``df`` that has the name of an output is
    replaced; all others are passed on.
    """
    arrow_session(df.sparkSession)
    new = T._parse_datatype_string(outputs)
    names = {n.lower() for n in new.names}
    kept = [c for c in df.columns if c.lower() not in names and not (drop_text and c == text)]
    types = [f.type for f in to_arrow_schema(new)]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        try:
            for column in columns:
                batch = pa.RecordBatch.from_arrays([column], names=["text"])
                parts = []
                for part in slices(batch, "text"):
                    made = f(text_bytes(part, "text") if raw else part.column("text").to_pylist())
                    parts.append(pa.StructArray.from_arrays([pa.array(made[k], type=t) for k, t in zip(new.names, types, strict=True)], names=new.names))
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(new.names, types, strict=True))))
        finally:
            give_back()

    made = fresh(df.columns, "_made")
    out = df.withColumn(made, F.arrow_udf(run, new)(F.col(f"`{text}`")))
    return out.select(*(f"`{c}`" for c in kept), *(F.col(made)[n].alias(n) for n in new.names))
