"""Alignments: identities, sequence weights, weighted counts and frequencies.

``alignment`` has (protein, seq_id, states ARRAY<INT>), ``cells`` its long form
(protein, seq_id, pos, state). State 20 is a gap. Counts are sparse: only what
occurs has a row, pairs of positions with i <= j.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairweave.functions.scalars import GAP


def cells(alignment: DataFrame) -> DataFrame:
    return alignment.select("protein", "seq_id", F.posexplode("states").alias("pos", "state"))


def lengths(alignment: DataFrame) -> DataFrame:
    return alignment.groupBy("protein").agg(F.max(F.size("states")).alias("length"), F.count(F.lit(1)).alias("n"))


def drop_gapped_sequences(alignment: DataFrame, percent: float) -> DataFrame:
    """Keeps sequences whose gaps are fewer than ``percent`` of their length."""
    gaps = F.size(F.filter("states", lambda s: s == GAP))
    return alignment if percent >= 100 else alignment.filter(gaps < percent / 100 * F.size("states"))


def gap_fractions(long: DataFrame) -> DataFrame:
    return long.groupBy("protein", "pos").agg(F.avg((F.col("state") == GAP).cast("int")).alias("gap_fraction"))


def drop_gapped_positions(long: DataFrame, percent: float) -> tuple[DataFrame, DataFrame]:
    """(cells of the other positions with new numbers, dropped positions): positions with gaps in ``percent`` of the sequences or more go."""
    fractions = gap_fractions(long)
    kept = fractions.filter(F.col("gap_fraction") < percent / 100)
    new = F.row_number().over(Window.partitionBy("protein").orderBy("pos")) - 1
    dropped = fractions.join(kept, ["protein", "pos"], "left_anti").select("protein", "pos")
    return long.join(kept.withColumn("new_pos", new).select("protein", "pos", "new_pos"), ["protein", "pos"]).select("protein", "seq_id", F.col("new_pos").alias("pos"), "state"), dropped


def mean_gap_fraction(long: DataFrame) -> DataFrame:
    return gap_fractions(long).groupBy("protein").agg(F.avg("gap_fraction").alias("gap_fraction"))


#: Sequences of a protein in one block; a task compares two blocks.
BLOCK = 512


def _block_pairs(alignment: DataFrame, size: int) -> DataFrame:
    """(protein, seq_id, states, block, u, v): each sequence in every pair u <= v of its protein's blocks that its own is one of. A deep protein is dealt over as many tasks as it has pairs of blocks."""
    blocks = alignment.groupBy("protein").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    rows = alignment.select("protein", "seq_id", "states").join(blocks, "protein").withColumn("block", F.pmod(F.xxhash64("seq_id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("u"), F.greatest(k, "block").alias("v")))
    return rows.withColumn("pair", F.explode(pairs)).select("protein", "seq_id", "states", "block", "pair.u", "pair.v")


@dataclass
class _Blocks:
    """The sequences of two blocks as arrays; of one block twice where both are one."""

    protein: pa.Scalar
    seq_x: np.ndarray
    x: np.ndarray
    seq_y: np.ndarray
    y: np.ndarray
    one: bool

    #: Rows of x, and positions, of one product of matrices.
    ROWS, POSITIONS = 512, 256

    @classmethod
    def of(cls, table: pa.Table) -> _Blocks:
        states, block = table.column("states").combine_chunks(), table.column("block").to_numpy()
        seq = table.column("seq_id").to_numpy()
        length = np.diff(states.offsets.to_numpy())
        cells = np.full((len(seq), max(length.max(initial=0), 1)), -1, np.int16)
        cells[np.arange(cells.shape[1]) < length[:, None]] = states.flatten().to_numpy()
        u, v = table.column("u")[0].as_py(), table.column("v")[0].as_py()
        return cls(table.column("protein")[0], seq[block == u], cells[block == u], seq[block == v], cells[block == v], u == v)

    def counts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row of x, which pairs count, alike positions, of these gaps, positions where neither has a gap), as matrices of rows of x and all of y; a pair counts once where both blocks are one.

        Numbers of equal states are products of indicators, so a stretch of
        positions is one product of matrices; single precision is exact below
        2 to the 24. What shorter sequences are filled up with, -1, is a state.
        """
        states = np.intersect1d(self.x, self.y)
        one = lambda cells: (cells[:, :, None] == states).reshape(len(cells), -1).astype(np.float32)
        parts = [slice(at, at + self.POSITIONS) for at in range(0, self.x.shape[1], self.POSITIONS)]
        for start in range(0, len(self.x), self.ROWS):
            x = self.x[start : start + self.ROWS]
            ids, shared, residues = (np.zeros((len(x), len(self.y)), np.float32) for _ in range(3))
            for part in parts:
                u, v = x[:, part], self.y[:, part]
                gap_u, gap_v = (u == GAP).astype(np.float32), (v == GAP).astype(np.float32)
                ids += one(u) @ one(v).T
                shared += gap_u @ gap_v.T
                residues += (1 - gap_u) @ (1 - gap_v).T
            counted = np.arange(len(self.y)) > np.arange(start, start + len(x))[:, None] if self.one else np.ones(ids.shape, bool)
            yield start, counted, ids, shared, residues


def identities(alignment: DataFrame, block: int = BLOCK) -> DataFrame:
    """(protein, a, b, ids, shared_gaps, both_residues, length) of all sequence pairs a < b of a protein.

    All pairs of a protein are the result, so the work is their number; they are
    dealt by pairs of blocks and compared as arrays.
    """

    def work(table: pa.Table) -> pa.Table:
        both = _Blocks.of(table)
        first, second, numbers = [both.seq_x[:0]], [both.seq_x[:0]], [np.zeros((3, 0), np.int32)]
        for start, counted, *found in both.counts():
            mine, theirs = np.broadcast_arrays(both.seq_x[start : start + len(counted), None], both.seq_y)
            mine, theirs = mine[counted], theirs[counted]
            first.append(np.minimum(mine, theirs))
            second.append(np.maximum(mine, theirs))
            numbers.append(np.stack([x[counted].astype(np.int32) for x in found]))
        ids, shared, residues = np.concatenate(numbers, axis=1)
        kind = table.schema.field("seq_id").type
        a, b = (pa.array(np.concatenate(x), kind) for x in (first, second))
        return pa.table({"protein": pa.repeat(both.protein, len(a)), "a": a, "b": b} | {n: pa.array(x, pa.int32()) for n, x in (("ids", ids), ("shared_gaps", shared), ("both_residues", residues), ("length", np.full(len(a), both.x.shape[1])))})

    p, q = (alignment.schema[c].dataType.simpleString() for c in ("protein", "seq_id"))
    schema = f"protein {p}, a {q}, b {q}, ids int, shared_gaps int, both_residues int, length int"
    return _block_pairs(alignment, block).groupBy("protein", "u", "v").applyInArrow(work, schema)


def _alike(ids: np.ndarray, shared: np.ndarray, residues: np.ndarray, length: int, cutoff: float, rule: str, ignore_gaps: bool) -> np.ndarray:
    """Which pairs count as alike (whole numbers, in single precision, are compared in double): ids >= ceil(cutoff * length); with ``ignore_gaps`` shared gaps count neither as alike nor as length; rule "ungapped_strict": more than cutoff of the columns where both have a residue."""
    shared, residues = shared.astype(float), residues.astype(float)
    if rule == "ungapped_strict":
        return ids - shared > cutoff * residues
    if ignore_gaps:
        return ids - shared >= np.ceil(cutoff * (length - shared))
    return ids >= np.ceil(cutoff * length)


def sequence_weights(alignment: DataFrame, cutoff: float = 0.8, rule: str = "simple", ignore_gaps: bool = False, block: int = BLOCK) -> DataFrame:
    """(protein, seq_id, weight): one over the number of alike sequences, itself among them. Tasks hand on counts, not pairs."""

    def work(table: pa.Table) -> pa.Table:
        both = _Blocks.of(table)
        count = np.zeros(len(both.x), np.int64), np.zeros(len(both.y), np.int64)
        for start, counted, *found in both.counts():
            near = _alike(*found, both.x.shape[1], cutoff, rule, ignore_gaps) & counted
            count[0][start : start + len(near)] += near.sum(1)
            count[1][:] += near.sum(0)
        seq = pa.array(np.concatenate([both.seq_x, both.seq_y]), table.schema.field("seq_id").type)
        return pa.table({"protein": pa.repeat(both.protein, len(seq)), "seq_id": seq, "k": pa.array(np.concatenate(count), pa.int64())})

    p, q = (alignment.schema[c].dataType.simpleString() for c in ("protein", "seq_id"))
    schema = f"protein {p}, seq_id {q}, k long"
    counts = _block_pairs(alignment, block).groupBy("protein", "u", "v").applyInArrow(work, schema)
    return counts.groupBy("protein", "seq_id").agg((1.0 / (F.sum("k") + 1)).alias("weight"))


def effective_number(weights: DataFrame) -> DataFrame:
    return weights.groupBy("protein").agg(F.sum("weight").alias("neff"))


def single_counts(long: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    w = F.lit(1.0) if weights is None else F.col("weight")
    rows = long if weights is None else long.join(weights, ["protein", "seq_id"])
    return rows.groupBy("protein", F.col("pos").alias("i"), F.col("state").alias("a")).agg(F.sum(w).alias("n"))


def pair_counts(long: DataFrame, weights: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(protein, i, j, a, b, n), i <= j; only ``pairs`` (protein, i, j) where given. Partial sums are made before the shuffle."""
    rows = long.withColumn("w", F.lit(1.0)) if weights is None else long.join(weights, ["protein", "seq_id"]).withColumnRenamed("weight", "w")
    x = rows.select("protein", "seq_id", F.col("pos").alias("i"), F.col("state").alias("a"), "w")
    y = long.select("protein", "seq_id", F.col("pos").alias("j"), F.col("state").alias("b"))
    both = x.join(y, ["protein", "seq_id"]).filter("i <= j")
    if pairs is not None:
        both = both.join(pairs.select("protein", "i", "j"), ["protein", "i", "j"], "left_semi")
    return both.groupBy("protein", "i", "j", "a", "b").agg(F.sum("w").alias("n"))


def residue_numbers(counts: DataFrame, keys: list[str], states: list[str]) -> DataFrame:
    """Weighted numbers of sequences without a gap at the position, or at both."""
    inside = F.lit(True)
    for s in states:
        inside = inside & (F.col(s) != GAP)
    return counts.groupBy(*keys).agg(F.sum(F.when(inside, F.col("n")).otherwise(0.0)).alias("residues"))


def states(spark, n: int = 20) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("a"))


def dense_single(counts: DataFrame, n: int = 20) -> DataFrame:
    """Counts with a row for each of n states of every position."""
    grid = counts.select("protein", "i").distinct().withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(counts, ["protein", "i", "a"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))


def entropy_effective_number(long: DataFrame) -> DataFrame:
    """2 to the mean entropy of unweighted columns: a thousandth is added to each count, all 21 states divide, 20 are summed."""
    counts = dense_single(single_counts(long))
    total = long.groupBy("protein", F.col("pos").alias("i")).agg(F.count(F.lit(1)).alias("total"))
    f = (F.col("n") + 1e-3) / F.col("total")
    h = counts.join(total, ["protein", "i"]).groupBy("protein", "i").agg(F.sum(-f * F.log2(f)).alias("h"))
    return h.groupBy("protein").agg(F.pow(F.lit(2.0), F.avg("h")).alias("neff_hh"))


def frequencies(counts: DataFrame, neff: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """(protein, i, a, f, f_pc): gap-free shares, and mixed with pseudocounts (a, f), by default 1/21 for each residue; 1 / (neff + 1) of the mixture is pseudocounts."""
    dense = dense_single(counts.filter(F.col("a") < 20))
    total = residue_numbers(counts, ["protein", "i"], ["a"])
    rows = dense.join(total, ["protein", "i"]).join(neff, "protein").withColumn("f", F.col("n") / (F.col("residues") + 1e-10))
    pc = F.lit(1 / 21.0)
    if background is not None:
        rows, pc = rows.join(F.broadcast(background.select("a", F.col("f").alias("pc"))), "a"), F.col("pc")  # 20 rows
    tau = 1.0 / (F.col("neff") + 1)
    return rows.select("protein", "i", "a", "f", ((1 - tau) * F.col("f") + tau * pc).alias("f_pc"))


def overall_shares(counts: DataFrame) -> DataFrame:
    """(protein, a, f): weighted share of each of the 21 states, the gap among them, over all positions."""
    total = counts.groupBy("protein", "a").agg(F.sum("n").alias("n"))
    return total.select("protein", "a", (F.col("n") / F.sum("n").over(Window.partitionBy("protein"))).alias("f"))  # 21 rows a protein


def frequencies_from_overall(counts: DataFrame, neff: DataFrame, weight: float = 1.0) -> DataFrame:
    """(protein, i, a, f, f_pc) like ``frequencies``, mixed with the protein's own overall shares; weight / (neff + weight) of the mixture is theirs."""
    dense = dense_single(counts.filter(F.col("a") < 20))
    total = residue_numbers(counts, ["protein", "i"], ["a"])
    rows = dense.join(total, ["protein", "i"]).join(neff, "protein").withColumn("f", F.col("n") / (F.col("residues") + 1e-10))
    rows = rows.join(overall_shares(counts).select("protein", "a", F.col("f").alias("pc")), ["protein", "a"], "left")
    tau = F.lit(weight) / (F.col("neff") + weight)
    return rows.select("protein", "i", "a", "f", ((1 - tau) * F.col("f") + tau * F.coalesce("pc", F.lit(0.0))).alias("f_pc"))


def pair_frequencies(counts2: DataFrame, single: DataFrame, neff: DataFrame) -> DataFrame:
    """(protein, i, j, a, b, f2, residues), i < j: pseudocounted shares of all 400 residue pairs, also of those that never occur."""
    inner = counts2.filter("i < j and a < 20 and b < 20")
    total = inner.groupBy("protein", "i", "j").agg(F.sum("n").alias("residues"))
    x = single.select("protein", "i", "a", F.col("f").alias("fi"), F.col("f_pc").alias("pi"))
    y = single.select("protein", F.col("i").alias("j"), F.col("a").alias("b"), F.col("f").alias("fj"), F.col("f_pc").alias("pj"))
    grid = total.join(x, ["protein", "i"]).join(y, ["protein", "j"]).join(neff, "protein").join(inner, ["protein", "i", "j", "a", "b"], "left")
    keep = 1 - 1.0 / (F.col("neff") + 1)
    f = F.coalesce("n", F.lit(0.0)) / (F.col("residues") + 1e-10)
    f2 = keep * keep * (f - F.col("fi") * F.col("fj")) + F.col("pi") * F.col("pj")
    return grid.select("protein", "i", "j", "a", "b", f2.alias("f2"), "pi", "pj", "residues", F.coalesce("n", F.lit(0.0)).alias("n"))


def gapped_frequencies(counts: DataFrame, neff: DataFrame, pseudocounts: str = "uniform") -> DataFrame:
    """(protein, i, a, f) over 21 states, gaps among them; pseudocounts "uniform" (1/21), "constant" (the mean over positions) or "none"."""
    f = dense_single(counts, 21).join(neff, "protein").withColumn("raw", F.col("n") / F.col("neff"))
    tau = 1.0 / (F.col("neff") + 1)
    pc = {"uniform": F.lit(1 / 21.0), "constant": F.avg("raw").over(Window.partitionBy("protein", "a")), "none": F.col("raw")}[pseudocounts]
    return f.select("protein", "i", "a", ((1 - tau) * F.col("raw") + tau * pc).alias("f"))


def degapped(freq: DataFrame) -> DataFrame:
    gap = F.sum(F.when(F.col("a") == GAP, F.col("f")).otherwise(0.0)).over(Window.partitionBy("protein", "i"))
    return freq.withColumn("f", F.col("f") / (1 - gap)).filter(F.col("a") < GAP)


def position_weights(counts: DataFrame) -> DataFrame:
    """Counts over their column's total."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("protein", "i")))
