"""Feature tables of pairs, and filters on evidence, scores and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairweave.functions.scratch import sent, stored
from pairweave.operators.couplings import norm_of
from pairweave.operators.information import average_product
from pairweave.operators.structure import distance_map
from pairweave.operators.stats import correlation


def global_features(lengths: DataFrame, neff: DataFrame) -> DataFrame:
    """(protein, length, log_length, n, diversity, neff)."""
    return lengths.join(neff, "protein").withColumns({"log_length": F.ln("length"), "diversity": F.sqrt("n") / F.col("length")})


def pair_features(pairs: DataFrame, of_protein: DataFrame, of_position: DataFrame, names: list[str]) -> DataFrame:
    """Wide rows: the pair's columns, its separation, the protein's features, and each position's features as name_i and name_j."""
    out = pairs.withColumn("separation", F.col("j") - F.col("i")).join(of_protein, "protein")
    for side in ("i", "j"):
        out = out.join(of_position.select("protein", F.col("i").alias(side), *[F.col(n).alias(f"{n}_{side}") for n in names]), ["protein", side])
    return out.withColumns({"relative_i": F.col("i") / F.col("length"), "relative_j": F.col("j") / F.col("length")})


def finite_rows(rows: DataFrame, names: list[str]) -> tuple[DataFrame, Column]:
    """(rows whose values are all finite, the condition)."""
    ok = F.lit(True)
    for n in names:
        x = F.col(n).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.filter(ok), ok


def diverse(lengths: DataFrame, least: float) -> DataFrame:
    return lengths.filter(F.sqrt("n") / F.col("length") >= least)


#: Bins that a range of scores is cut into, and scores of a protein that are sorted in one task.
BINS, SORTED = 4096, 200_000


def ranked_pairs(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """(protein, score, i, j) of the pair that has rank ``k``, from 1, by falling score, then i and j. ``wanted``: (protein, k); proteins with fewer pairs have no row.

    Scores are counted in bins of a range that shrinks to the one that is looked
    for; only the last range is sorted, so no task holds a protein's pairs.
    """
    score = F.col("score")
    bounds = scores.groupBy("protein").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("score").alias("n")).join(wanted.select("protein", "k"), "protein").filter("k <= n")
    at = sent(bounds)
    within = lambda: scores.select("protein", "i", "j", "score").join(at, "protein").filter(score.between(F.col("lo"), F.col("hi")))
    while at.filter(f"n > {SORTED} and lo < hi").head():
        width = F.when(F.col("lo") < F.col("hi"), F.col("hi") - F.col("lo")).otherwise(1)
        number = F.least(F.floor((score - F.col("lo")) / width * BINS), F.lit(BINS - 1))
        cells = within().groupBy("protein", "k", number.alias("cell")).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("protein").orderBy(F.col("cell").desc()))
        at = sent(cells.withColumn("upto", upto).filter("upto >= k and upto - n < k").select("protein", "lo", "hi", "n", (F.col("k") - F.col("upto") + F.col("n")).alias("k")))
    rank = F.row_number().over(Window.partitionBy("protein").orderBy(score.desc(), "i", "j"))
    return within().withColumn("rank", rank).filter("rank = k").select("protein", "score", "i", "j")


def strong_contacts(scores: DataFrame, lengths: DataFrame) -> DataFrame:
    """Contacts whose score reaches the one ranked length / 2 (from 0) in the square matrix, and all other pairs.

    Each pair stands twice in the square; the diagonal counts as 0, and so holds
    the rank where too few scores are greater.
    """
    rank = F.floor(F.col("length") / 2)
    positive = scores.groupBy("protein").agg(F.count_if(F.col("score") > 0).alias("positive"))
    wanted = stored(positive.join(lengths.select("protein", "length"), "protein").select("protein", F.when(rank < 2 * F.col("positive"), F.floor(rank / 2) + 1).alias("k")))
    limit = ranked_pairs(scores, wanted.filter("k is not null")).select("protein", F.col("score").alias("limit_"))
    limit = sent(limit.union(wanted.filter("k is null").select("protein", F.lit(0.0))))
    return scores.join(limit, "protein").filter("contact = 0 or score >= limit_").drop("limit_")


def evidence(freq2: DataFrame, least: float) -> DataFrame:
    """State pairs that either the product of the positions' shares or their joint share leads to expect more than ``least`` times."""
    expected = F.greatest(F.col("pi") * F.col("pj"), F.col("f2")) * F.col("residues")
    return freq2.withColumn("expected", expected).filter(F.col("expected") > least)


def banded(rows: DataFrame, value: str, low: float, high: float, other: str, least: float) -> DataFrame:
    return rows.filter((F.col(value) > low) & (F.col(value) <= high) & (F.col(other) >= least))


def state_lookup(points: DataFrame, query: DataFrame) -> DataFrame:
    """(protein, i, j, d, a, b): distances of a chain's points with the states of one sequence at both positions; gaps go. ``query``: (protein, pos, state)."""
    known = points.join(query.filter("state < 20").select("protein", "pos", "state"), ["protein", "pos"])
    return distance_map(known, both=["state"]).withColumnsRenamed({"state_i": "a", "state_j": "b"})


def agreement_with_model(freq2: DataFrame) -> DataFrame:
    """Correlation by protein of pair shares with products of single shares, and of counts with shares."""
    return freq2.groupBy("protein").agg(correlation(F.col("f2"), F.col("pi") * F.col("pj")).alias("r_independent"), correlation(F.col("n") / F.col("residues"), F.col("f2")).alias("r_pairs"))


def observed_against_model(single: DataFrame, pairs: DataFrame, log: bool = False) -> DataFrame:
    """(protein, r_single, r_pairs, r_covariances): how shares counted in an alignment agree with those of a model.

    single: (protein, i, a, observed, model); pairs: (protein, i, j, a, b,
    observed, model), i < j. Covariances are pair shares less the products of
    single ones, on either side. With ``log`` single and pair shares are compared
    as logarithms; those that aren't positive are left out.
    """
    scale = (lambda c: F.when(F.col(c) > 0, F.ln(c))) if log else F.col
    side = lambda place, state, to: single.select("protein", F.col("i").alias(place), F.col("a").alias(state), F.col("observed").alias(f"o_{to}"), F.col("model").alias(f"m_{to}"))
    both = pairs.join(side("i", "a", "i"), ["protein", "i", "a"]).join(side("j", "b", "j"), ["protein", "j", "b"])
    cov = correlation(F.col("observed") - F.col("o_i") * F.col("o_j"), F.col("model") - F.col("m_i") * F.col("m_j"))
    of_pairs = both.groupBy("protein").agg(correlation(scale("observed"), scale("model")).alias("r_pairs"), cov.alias("r_covariances"))
    return single.groupBy("protein").agg(correlation(scale("observed"), scale("model")).alias("r_single")).join(of_pairs, "protein")


def covariance_couplings(freq2: DataFrame) -> DataFrame:
    """(protein, i, j, w): covariances of the 400 state pairs, in order."""
    cell = F.struct((F.col("a") * 20 + F.col("b")).alias("ab"), (F.col("f2") - F.col("pi") * F.col("pj")).alias("w"))
    return freq2.groupBy("protein", "i", "j").agg(F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["w"]).alias("w"))


def mean_propensities(positions: DataFrame, names: list[str]) -> DataFrame:
    """Means over a protein's positions of predicted propensities, one column each."""
    return positions.groupBy("protein").agg(*[F.avg(n).alias(f"mean_{n}") for n in names])


def coupling_study(couplings: DataFrame, features: DataFrame, pairs: dict[str, int]) -> DataFrame:
    """Each pair's sum of couplings and sizes of the couplings of named residue pairs (numbers within the block, from 0), beside the protein's length, depth and diversity."""
    one = [F.abs(F.try_element_at("w", F.lit(ab + 1))).alias(name) for name, ab in pairs.items()]
    rows = couplings.select("protein", "i", "j", F.aggregate("w", F.lit(0.0), lambda s, v: s + v).alias("sum_w"), *one)
    ratio = (0.2 * F.col("length") / F.col("neff")).alias("depth_ratio")
    return rows.join(features.select("protein", "length", "neff", "diversity", ratio), "protein")


#: Columns that tell what a pair is; all others are features.
CLASS_COLUMNS = ["distance", "contact", "noncontact", "i", "j", "length", "protein"]


def external_score(pairs: DataFrame, scores: DataFrame, name: str, lengths: DataFrame | None = None) -> DataFrame:
    """Adds another method's ``score`` of a pair as feature ``name``; with ``lengths``, corrected by average products. Pairs without a score have a null."""
    if lengths is not None:
        scores = average_product(scores.select("protein", "i", "j", "score"), lengths).select("protein", "i", "j", F.col("apc").alias("score"))
    return pairs.join(scores.select("protein", "i", "j", F.col("score").alias(name)), ["protein", "i", "j"], "left")


def coupling_features(pairs: DataFrame, couplings: DataFrame, lengths: DataFrame, raw: bool = False, probabilities: DataFrame | None = None) -> DataFrame:
    """Adds ``norm`` and ``norm_apc`` of a pair's couplings; on request the couplings themselves (``raw``, an array) and a pair's model probabilities (``model``, an array). Arrays stay arrays in the row."""
    keys = ["protein", "i", "j"]
    out = pairs.join(couplings.select(*keys, *([F.col("w").alias("raw")] if raw else []), norm_of("w").alias("norm")), keys)
    out = external_score(out, couplings.select(*keys, norm_of("w").alias("score")), "norm_apc", lengths)
    if probabilities is not None:
        out = out.join(probabilities.select(*keys, F.col("q").alias("model")), keys)
    return out


def assembled(rows: DataFrame, scalars: list[str], arrays: list[str] = ()) -> DataFrame:
    """Adds ``features``, one array of the scalar features and then the arrays, in order."""
    return rows.withColumn("features", F.concat(F.array(*[F.col(c).cast("double") for c in scalars]), *[F.transform(c, lambda x: x.cast("double")) for c in arrays]))


def split_features(rows: DataFrame, classes: list[str] = CLASS_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(features, classes) of wide rows: columns named in ``classes`` that are there go to the second, all others to the first."""
    given = [c for c in rows.columns if c in classes]
    return rows.drop(*given), rows.select(*given)


def marked_map(pairs: DataFrame, lengths: DataFrame, contact: float, divisor: int = 2) -> DataFrame:
    """(protein, i, j, distance, score, mark), positions from 1: "TP" or "FP" for a protein's best length / divisor pairs by score, null for the others. ``pairs``: (protein, i, j, d, score)."""
    size = pairs.groupBy("protein").agg(F.count("score").alias("n")).join(lengths.select("protein", "length"), "protein")
    wanted = size.select("protein", F.least(F.floor(F.col("length") / divisor), F.col("n")).alias("k"))
    last = ranked_pairs(pairs, stored(wanted).filter("k > 0")).select("protein", F.col("score").alias("score_"), F.col("i").alias("i_"), F.col("j").alias("j_"))
    rows = pairs.join(sent(last), "protein", "left")
    best = F.col("score").isNotNull() & (F.struct(-F.col("score"), "i", "j") <= F.struct(-F.col("score_"), F.col("i_"), F.col("j_")))
    mark = F.when(best, F.when(F.col("d") <= contact, "TP").otherwise("FP"))
    return rows.select("protein", (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), F.col("d").alias("distance"), "score", mark.alias("mark"))
