"""What the operators of this package share: reading, scratch tables, Arrow plumbing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or, where that is unset and Spark runs on this machine alone (tests), below a folder of it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pairweave-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/pairweave-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again: its lineage ends there and a lost executor costs nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Texts:
    """The texts of an Arrow string column as one byte array. Null texts are empty."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.fill_null("") if column.null_count else column
        column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        n = len(column)
        self.offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def chunks(self, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, end, bytes, offsets within them) of runs of texts with about ``most`` bytes, at least one text each; bounds the memory that array work takes."""
        i, n = 0, len(self)
        while i < n:
            j = int(np.searchsorted(self.offsets, self.offsets[i] + most, "right")) - 1
            j = min(max(j, i + 1), n)
            a, b = int(self.offsets[i]), int(self.offsets[j])
            yield i, j, self.data[a:b], self.offsets[i : j + 1] - a
            i = j
