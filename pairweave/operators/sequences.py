"""Marked sequences: upper case for resolved residues, lower case for unresolved ones. Array functions in the row; no character becomes a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairweave.functions.scratch import sent, stored


def _places(text: Column, of) -> Column:
    """Where (from 0) the characters are that ``of`` holds for."""
    at = F.transform(F.split(text, ""), lambda c, i: F.when(of(c), i))
    return F.filter(at, lambda i: i.isNotNull())


def gap_offsets(marked: Column) -> Column:
    """How many resolved residues stand before each run of unresolved ones, without a run at either end."""
    inner = F.regexp_replace(marked, "^[^A-Z]+|[^A-Z]+$", "")
    breaks = F.regexp_replace(inner, "[^A-Z]+", "!")
    return F.transform(_places(breaks, lambda c: c == "!"), lambda at, k: at - k)


def break_offsets(chain: Column) -> Column:
    """How many residues in upper case stand before each chain break ``!``."""
    return F.transform(_places(F.regexp_replace(chain, "[^A-Z!]", ""), lambda c: c == "!"), lambda at, k: at - k)


def gaps_confirmed(sequences: DataFrame, chains: DataFrame) -> DataFrame:
    """(protein, gaps, unconfirmed, valid): whether each inner gap of a marked sequence is a break of the chain at the same residue.

    sequences: (protein, marked); chains: (protein, chain). A break that no gap
    asks for doesn't matter. A null sequence or chain has no gaps or breaks.
    """
    both = sequences.join(chains, "protein")
    gaps, breaks = F.coalesce(gap_offsets(F.col("marked")), F.array().cast("array<int>")), F.coalesce(break_offsets(F.col("chain")), F.array().cast("array<int>"))
    rows = both.select("protein", gaps.alias("offsets"), F.array_except(gaps, breaks).alias("missing"))
    return rows.select("protein", F.size("offsets").alias("gaps"), F.size("missing").alias("unconfirmed"), (F.size("missing") == 0).alias("valid"))


def position_map(marked: Column) -> Column:
    """Place in the whole sequence, from 1, of the resolved residues in order, and after them the end of the sequence. Unresolved residues at the end don't count."""
    whole = F.regexp_replace(marked, "[a-z]+$", "")
    resolved = F.transform(_places(whole, lambda c: (c != "") & ((c < "a") | (c > "z"))), lambda i: i + 1)
    return F.when(whole != "", F.concat(resolved, F.array(F.length(whole)))).otherwise(F.array(F.lit(0)))


def renumbered(residues: DataFrame, sequences: DataFrame) -> DataFrame:
    """Adds ``new_no`` to rows (protein, res_no, ...): the residue's place in the whole marked sequence; null where the sequence has no such residue. sequences: (protein, marked), a row for each protein.

    Only sequences of proteins that have residues are mapped, each once.
    """
    wanted = sent(residues.select("protein").distinct())
    maps = stored(sequences.join(wanted, "protein", "left_semi").select("protein", position_map(F.col("marked")).alias("_map")))
    n = F.col("res_no").cast("int")
    return residues.join(maps, "protein").withColumn("new_no", F.when(n > 0, F.get("_map", n - 1))).drop("_map")
