"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every operator: U+0020 and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent on a single machine (tests), a folder is made once
    per session; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = getattr(spark, "_tallyweave_shared", None) or tempfile.mkdtemp(prefix="tallyweave-")
        spark._tallyweave_shared = path
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result no longer depends on the plan that made it, and is not lost with
    an executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Delete all intermediate tables in the shared folder; results that were not written elsewhere are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores after it until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


#: Byte table that lower-cases A-Z.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def release_memory() -> None:
    """Give what a task has freed back to the system, as a reused Python worker would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the C library of most Linux systems has it
        trim(0)


def slices(sizes, limit: int):
    """Consecutive ranges of rows whose sizes sum to at most ``limit`` (one row at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def token_blocks(text: bytes, block: int = 1 << 18):
    """The words of a text, some 256 KB at a time; bytes split at 0x20 and 0x09-0x0D."""
    at = 0
    while at < len(text):
        end = at + block
        if end < len(text):
            while end < len(text) and text[end] not in b" \t\n\v\f\r":
                end += 1
        yield text[at:end].split()
        at = end


def byte_column(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary column as (bytes, offsets); null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]
