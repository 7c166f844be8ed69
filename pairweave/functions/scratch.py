"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset and Spark runs on this machine alone (tests), below a folder of it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pairweave-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


#: Rows up to which a table of one row for each key is sent to all tasks.
MOST_SENT = 200_000


def sent(df: DataFrame) -> DataFrame:
    """The table, written, and to be sent to all tasks for joins unless it has too many rows."""
    rows = stored(df)
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def stored(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
