"""Which proteins have all their inputs: catalogues of several kinds joined by a normalised id."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(name: Column) -> Column:
    """A file's or chain's name as an id: without folders, what follows the first dot, and underscores."""
    return F.regexp_replace(F.split(F.regexp_extract(name, "[^/]*$", 0), r"\.")[0], "_", "")


def presence(inputs: dict[str, DataFrame], depth: str | None = None) -> DataFrame:
    """(protein, one flag for each kind of input, n): every id that any input has. ``inputs``: DataFrames with ``name``; that of ``depth`` has ``n``, its number of sequences (the greatest, where names agree).

    One aggregation over the union of the ids, whatever the number of inputs.
    """
    each = [df.select(normalised(F.col("name")).alias("protein"), F.lit(kind).alias("kind"), (F.col("n") if kind == depth else F.lit(None)).cast("long").alias("n")) for kind, df in inputs.items()]
    rows = functools.reduce(DataFrame.unionByName, each).filter("protein is not null")
    flags = [F.max((F.col("kind") == k).cast("int")).cast("boolean").alias(k) for k in inputs]
    return rows.groupBy("protein").agg(*flags, F.max("n").alias("n"))


def complete(found: DataFrame, kinds: list[str], least: int = 10) -> DataFrame:
    """Adds ``reasons``, what speaks against a protein, and ``kept``: all inputs are there and the alignment has ``least`` sequences at least."""
    missing = [F.when(~F.col(k), F.lit(f"no {k}")) for k in kinds]
    shallow = F.when(F.col("n") < least, F.lit("few sequences"))
    reasons = F.array_compact(F.array(*missing, shallow))
    return found.withColumn("reasons", F.array_join(reasons, "; ")).withColumn("kept", F.size(reasons) == 0)


def with_inputs(rows: dict[str, DataFrame], kept: DataFrame) -> dict[str, DataFrame]:
    """Each input's rows (``name``, ...) of kept proteins, with ``protein`` beside the name."""
    ids = kept.filter("kept").select("protein")
    return {k: df.withColumn("protein", normalised(F.col("name"))).join(ids, "protein", "left_semi") for k, df in rows.items()}
