"""What the corpus operators share: stored intermediate tables, per-worker objects, Arrow kernels over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.session import staging_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one all executors share, ``spark.checkpoint.dir``."""
    return staging_folder(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: written once to the shared folder, read from there, so lost executors cost no recomputation."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def per_worker(key: tuple, build: Callable[[], object]) -> object:
    """One object per Python worker process.

    Functions travel to the workers by value, so module globals are new in every task; a worker serves many tasks.
    """
    import sys
    import types

    store = sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


#: bytes of text that a kernel looks at together
SLICE = 8 << 20


def slices(batches: Iterator, column: int = 1, size: int = SLICE) -> Iterator:
    """The rows of Arrow batches in parts of about ``size`` bytes of text (at least one row), which bounds what a kernel
    builds beside them; what Arrow holds for nothing is given back at the end of the task."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def byte_texts(array) -> Iterator[bytes]:
    """UTF-8 bytes of every text of an Arrow column; a null is an empty text."""
    import pyarrow as pa

    for value in array.cast(pa.binary()):
        yield value.as_py() or b""


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def text_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, text) of a table with any further columns."""
    return docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
