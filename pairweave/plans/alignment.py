"""Alignment and information queries. Embeddings are an alignment: a label is a protein, a vector a sequence, a dimension a position, and its value, in 21 steps, the state."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from pairweave.functions import scalars as C
from pairweave.functions.scratch import stored
from pairweave.operators import alignment as A
from pairweave.operators import evaluation as E
from pairweave.operators import information as I
from pairweave.plans.registry import query, r6, rounded, table

CUTOFF = 0.125


def alignment(spark, d):
    step = lambda e: F.greatest(F.lit(0), F.least(F.lit(20), F.floor((e.cast("double") + 0.3) * 35))).cast("int")
    return table(spark, d, "embeddings").select(F.col("label").alias("protein"), F.col("vec_id").alias("seq_id"), F.transform("embedding", step).alias("states"))


def long(spark, d):
    return A.cells(alignment(spark, d))


def weights(spark, d):
    return A.sequence_weights(alignment(spark, d), CUTOFF, ignore_gaps=True)


class Shared:
    """Tables that a query uses several times, each made and written once."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    @cached_property
    def weights(self):
        return stored(weights(self.spark, self.d))

    @cached_property
    def neff(self):
        return A.effective_number(self.weights)

    @cached_property
    def single(self):
        return stored(A.frequencies(A.single_counts(long(self.spark, self.d), self.weights), self.neff))

    @cached_property
    def counts2(self):
        return stored(A.pair_counts(long(self.spark, self.d), self.weights))

    @cached_property
    def freq2(self):
        return A.pair_frequencies(self.counts2, self.single, self.neff)

    def with_apc(self, scores):
        return I.average_product(stored(scores), A.lengths(alignment(self.spark, self.d)))


def counts2(spark, d):
    """For queries that read them once."""
    return A.pair_counts(long(spark, d), weights(spark, d))


def counts(spark, d):
    return A.single_counts(long(spark, d), weights(spark, d))


def neff(spark, d):
    return A.effective_number(weights(spark, d))


def single(spark, d):
    return A.frequencies(counts(spark, d), neff(spark, d))


AL = """WITH al AS (SELECT label AS protein, vec_id AS seq_id, list_transform(embedding, lambda e: CAST(greatest(0, least(20, floor((e::DOUBLE + 0.3::DOUBLE) * 35))) AS INT)) AS states FROM embeddings),
cell AS (SELECT protein, seq_id, unnest(range(len(states))) AS pos, unnest(states) AS state FROM al)"""
IDS = AL + """, ids AS (SELECT a.protein, a.seq_id AS a, b.seq_id AS b, len(a.states) AS length, len(list_filter(list_zip(a.states, b.states), lambda z: z[1] = z[2])) AS ids,
  len(list_filter(list_zip(a.states, b.states), lambda z: z[1] = z[2] AND z[1] = 20)) AS shared_gaps, len(list_filter(list_zip(a.states, b.states), lambda z: z[1] <> 20 AND z[2] <> 20)) AS both_residues
  FROM al a JOIN al b ON a.protein = b.protein AND a.seq_id < b.seq_id)"""
W = IDS + """, near AS (SELECT * FROM ids WHERE ids - shared_gaps >= ceil(0.125::DOUBLE * (length - shared_gaps))),
w AS (SELECT protein, seq_id, 1.0::DOUBLE / (1 + (SELECT count(*) FROM near n WHERE n.protein = al.protein AND (n.a = seq_id OR n.b = seq_id))) AS weight FROM al),
neff AS (SELECT protein, sum(weight) AS neff FROM w GROUP BY 1),
c1 AS (SELECT protein, pos AS i, state AS a, sum(weight) AS n FROM cell JOIN w USING (protein, seq_id) GROUP BY ALL)"""
F1 = W + """, t1 AS (SELECT protein, i, coalesce(sum(n) FILTER (a < 20), 0) AS residues FROM c1 GROUP BY ALL),
f1 AS (SELECT t1.protein, t1.i, s.a, coalesce(c1.n, 0) / (residues + 1e-10) AS f, (1 - 1 / (neff + 1)) * (coalesce(c1.n, 0) / (residues + 1e-10)) + 1 / (neff + 1) / 21 AS f_pc
  FROM t1 CROSS JOIN (SELECT unnest(range(20)) AS a) s JOIN neff USING (protein) LEFT JOIN c1 ON c1.protein = t1.protein AND c1.i = t1.i AND c1.a = s.a)"""
C2 = F1 + """, c2 AS (SELECT x.protein, x.pos AS i, y.pos AS j, x.state AS a, y.state AS b, sum(weight) AS n FROM cell x JOIN cell y ON x.protein = y.protein AND x.seq_id = y.seq_id AND x.pos <= y.pos JOIN w ON w.protein = x.protein AND w.seq_id = x.seq_id GROUP BY ALL),
t2 AS (SELECT protein, i, j, coalesce(sum(n) FILTER (a < 20 AND b < 20), 0) AS residues FROM c2 GROUP BY ALL)"""
F2 = C2 + """, f2 AS (SELECT t2.protein, t2.i, t2.j, x.a, y.a AS b, pow(1 - 1 / (neff + 1), 2) * (coalesce(c2.n, 0) / (residues + 1e-10) - x.f * y.f) + x.f_pc * y.f_pc AS f2, x.f_pc AS pi_, y.f_pc AS pj
  FROM t2 JOIN neff USING (protein) JOIN f1 x ON x.protein = t2.protein AND x.i = t2.i JOIN f1 y ON y.protein = t2.protein AND y.i = t2.j LEFT JOIN c2 ON c2.protein = t2.protein AND c2.i = t2.i AND c2.j = t2.j AND c2.a = x.a AND c2.b = y.a WHERE t2.i < t2.j)"""
MI = F2 + ", mi AS (SELECT protein, i, j, sum(CASE WHEN f2 > 0 THEN f2 * log2(f2 / (pi_ * pj)) ELSE 0 END) AS score FROM f2 GROUP BY ALL)"


def apc_sql(scores: str, diagonal: bool = False) -> str:
    return f""", full_ AS (SELECT protein, i, j, score FROM {scores} UNION ALL SELECT protein, j, i, score FROM {scores} WHERE i < j),
m AS (SELECT protein, i, sum(score) / 64 AS mean FROM full_ GROUP BY ALL), o AS (SELECT protein, sum(score) / 64 / 64 AS overall FROM full_ GROUP BY ALL),
apc AS (SELECT s.protein, s.i, s.j, s.score, x.mean * y.mean / overall AS apc_term, s.score - x.mean * y.mean / overall AS apc FROM {scores} s JOIN m x ON x.protein = s.protein AND x.i = s.i JOIN m y ON y.protein = s.protein AND y.i = s.j JOIN o ON o.protein = s.protein)"""


@query(AL + "SELECT protein, seq_id, pos, state FROM cell")
def sca1_alignment_cells(spark, d):
    return long(spark, d)


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(state) AS BIGINT) AS total, CAST(count(*) FILTER (state = 20) AS BIGINT) AS gaps, min(letter) AS least FROM (SELECT doc_id, CASE WHEN instr('ARNDCQEGHILKMFPSTWYV', upper(c)) > 0 THEN instr('ARNDCQEGHILKMFPSTWYV', upper(c)) - 1 ELSE 20 END AS state, substring('ARNDCQEGHILKMFPSTWYV-', state + 1, 1) AS letter FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '[^A-Za-z]', '-', 'g'), '')) AS c FROM documents) WHERE c <> '') GROUP BY 1")
def sca1_encode_letters(spark, d):
    """Every letter of every text as a state and back."""
    letters = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.regexp_replace("text", "[^A-Za-z]", "-"), "")).alias("c")).filter("c <> ''")
    rows = letters.withColumn("state", C.encode_state(F.col("c"))).withColumn("letter", C.decode_state(F.col("state")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("state").alias("total"), F.sum((F.col("state") == 20).cast("long")).alias("gaps"), F.min("letter").alias("least"))


@query("SELECT ab, substring('ARNDCQEGHILKMFPSTWYV', ab // 20 + 1, 1) || '-' || substring('ARNDCQEGHILKMFPSTWYV', ab % 20 + 1, 1) AS name, count(*) AS n FROM (SELECT CAST((l_partkey % 20) * 20 + l_suppkey % 20 AS INT) AS ab FROM lineitem) GROUP BY ALL")
def sca3_pair_names(spark, d):
    ab = C.pair_index(F.col("l_partkey") % 20, F.col("l_suppkey") % 20).cast("int")
    return table(spark, d, "lineitem").groupBy(ab.alias("ab")).agg(F.count(F.lit(1)).alias("n")).withColumn("name", C.pair_name(F.col("ab")))


@query(AL + "SELECT protein, seq_id FROM al WHERE len(list_filter(states, lambda s: s = 20)) < 0.02::DOUBLE * len(states)")
def fil1_gapped_sequences(spark, d):
    return A.drop_gapped_sequences(alignment(spark, d), 2).select("protein", "seq_id")


G = AL + ", g AS (SELECT protein, pos, avg((state = 20)::INT) AS gap_fraction FROM cell GROUP BY ALL)"


@query(G + ", k AS (SELECT protein, pos, row_number() OVER (PARTITION BY protein ORDER BY pos) - 1 AS new_pos FROM g WHERE gap_fraction < 0.02::DOUBLE) SELECT protein, new_pos AS pos, count(*) AS n, CAST(sum(state) AS BIGINT) AS total FROM cell JOIN k USING (protein, pos) GROUP BY ALL")
def fil2_gapped_positions(spark, d):
    kept, _ = A.drop_gapped_positions(long(spark, d), 2)
    return kept.groupBy("protein", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("state").alias("total"))


@query(G + "SELECT protein, pos FROM g WHERE gap_fraction >= 0.02::DOUBLE")
def fil2_dropped_positions(spark, d):
    return A.drop_gapped_positions(long(spark, d), 2)[1]


@query(G + "SELECT protein, pos, round(gap_fraction, 6) + 0.0 AS gap_fraction FROM g")
def agg1_gap_fractions(spark, d):
    return rounded(A.gap_fractions(long(spark, d)), "gap_fraction")


@query(G + "SELECT protein, round(avg(gap_fraction), 6) + 0.0 AS gap_fraction FROM g GROUP BY 1")
def agg8_mean_gap_fraction(spark, d):
    return rounded(A.mean_gap_fraction(long(spark, d)), "gap_fraction")


@query(IDS + "SELECT protein, a, b, CAST(ids AS INT) AS ids, round(ids / length, 6) + 0.0 AS fraction FROM ids")
def join7_identities(spark, d):
    return A.identities(alignment(spark, d)).select("protein", "a", "b", "ids", r6(F.col("ids") / F.col("length")).alias("fraction"))


@query(W + "SELECT protein, seq_id, round(weight, 6) + 0.0 AS weight FROM w")
def agg4_sequence_weights(spark, d):
    return rounded(weights(spark, d), "weight")


@query(IDS + ", near AS (SELECT * FROM ids WHERE ids - shared_gaps > 0.125::DOUBLE * both_residues) SELECT protein, seq_id, round(1.0::DOUBLE / (1 + (SELECT count(*) FROM near n WHERE n.protein = al.protein AND (n.a = seq_id OR n.b = seq_id))), 6) + 0.0 AS weight FROM al")
def agg4b_ungapped_weights(spark, d):
    return rounded(A.sequence_weights(alignment(spark, d), CUTOFF, "ungapped_strict"), "weight")


@query(W + "SELECT protein, round(neff, 6) + 0.0 AS neff FROM neff")
def agg5_effective_number(spark, d):
    return rounded(neff(spark, d), "neff")


@query(AL + ", c AS (SELECT protein, pos, state, count(*) AS n FROM cell GROUP BY ALL), t AS (SELECT protein, pos, count(*) AS total FROM cell GROUP BY ALL), h AS (SELECT t.protein, t.pos, sum(-(coalesce(n, 0) + 1e-3) / total * log2((coalesce(n, 0) + 1e-3) / total)) AS h FROM t CROSS JOIN (SELECT unnest(range(20)) AS a) s LEFT JOIN c ON c.protein = t.protein AND c.pos = t.pos AND c.state = s.a GROUP BY ALL) SELECT protein, round(pow(2, avg(h)), 6) + 0.0 AS neff_hh FROM h GROUP BY 1")
def agg6_entropy_effective_number(spark, d):
    return rounded(A.entropy_effective_number(long(spark, d)), "neff_hh")


@query(W + "SELECT protein, i, a, round(n, 6) + 0.0 AS n FROM c1")
def agg2_single_counts(spark, d):
    return rounded(counts(spark, d), "n")


@query(C2 + "SELECT protein, i, j, a, b, round(n, 6) + 0.0 AS n FROM c2")
def agg3_pair_counts(spark, d):
    return rounded(counts2(spark, d), "n")


@query(C2 + "SELECT protein, i, j, round(residues, 6) + 0.0 AS residues FROM t2")
def agg7_residue_numbers(spark, d):
    return rounded(A.residue_numbers(counts2(spark, d), ["protein", "i", "j"], ["a", "b"]), "residues")


@query(G + ", x AS (SELECT protein, avg(gap_fraction) AS g FROM g GROUP BY 1), k AS (SELECT protein, max(len(states)) AS length, count(*) AS n FROM al GROUP BY 1) SELECT protein, CAST(length AS INT) AS length, n, round(sqrt(n) / length, 6) + 0.0 AS diversity, round(g, 6) + 0.0 AS gap_fraction FROM k JOIN x USING (protein)")
def prj9_protein_summary(spark, d):
    rows = A.lengths(alignment(spark, d)).join(A.mean_gap_fraction(long(spark, d)), "protein")
    return rounded(rows.withColumn("diversity", F.sqrt("n") / F.col("length")), "diversity", "gap_fraction")


@query(F1 + "SELECT protein, i, a, round(f, 6) + 0.0 AS f, round(f_pc, 6) + 0.0 AS f_pc FROM f1")
def agg9_frequencies(spark, d):
    return rounded(single(spark, d), "f", "f_pc")


@query(F2 + "SELECT protein, i, j, round(sum(f2), 6) + 0.0 AS total, round(max(f2), 6) + 0.0 AS greatest_, round(min(f2), 6) + 0.0 AS least_ FROM f2 GROUP BY ALL")
def agg9_pair_frequencies(spark, d):
    t = Shared(spark, d)
    out = t.freq2.groupBy("protein", "i", "j").agg(F.sum("f2").alias("total"), F.max("f2").alias("greatest_"), F.min("f2").alias("least_"))
    return rounded(out, "total", "greatest_", "least_")


G10 = W + ", p AS (SELECT protein, i, unnest(range(21)) AS a FROM (SELECT DISTINCT protein, i FROM c1)), raw AS (SELECT p.protein, p.i, p.a, coalesce(n, 0) / neff AS raw, 1 / (neff + 1) AS tau FROM p JOIN neff USING (protein) LEFT JOIN c1 ON c1.protein = p.protein AND c1.i = p.i AND c1.a = p.a), fg AS (SELECT protein, i, a, (1 - tau) * raw + tau * avg(raw) OVER (PARTITION BY protein, a) AS f FROM raw)"


@query(G10 + "SELECT protein, i, a, round(f, 6) + 0.0 AS f FROM fg")
def agg10_gapped_frequencies(spark, d):
    return rounded(A.gapped_frequencies(counts(spark, d), neff(spark, d), "constant"), "f")


@query(G10 + "SELECT protein, i, a, round(f, 6) + 0.0 AS f FROM (SELECT protein, i, a, f / (1 - sum(f) FILTER (a = 20) OVER (PARTITION BY protein, i)) AS f FROM fg) WHERE a < 20")
def agg11_degapped(spark, d):
    return rounded(A.degapped(A.gapped_frequencies(counts(spark, d), neff(spark, d), "constant")), "f")


@query(W + "SELECT protein, i, a, round(n / sum(n) OVER (PARTITION BY protein, i), 6) + 0.0 AS share FROM c1")
def agg12_position_weights(spark, d):
    return rounded(A.position_weights(counts(spark, d)), "share").drop("n")


H = W + ", h AS (SELECT protein, i, sum(-p * log2(p)) AS entropy FROM (SELECT protein, i, n / sum(n) OVER (PARTITION BY protein, i) AS p FROM c1 WHERE a < 20) GROUP BY ALL)"


@query(H + "SELECT protein, i, round(entropy, 6) + 0.0 AS entropy, round(entropy / max(entropy) OVER (PARTITION BY protein), 6) + 0.0 AS scaled FROM h")
def agg14_scaled_entropy(spark, d):
    return rounded(I.scaled_by_maximum(I.entropies(counts(spark, d), ["protein", "i"], gaps=False)), "entropy", "scaled")


@query(W + "SELECT protein, i, round(sum(-p * log2(p)), 6) + 0.0 AS entropy FROM (SELECT protein, i, n / sum(n) OVER (PARTITION BY protein, i) AS p FROM c1) GROUP BY ALL")
def agg13_entropy_with_gaps(spark, d):
    return rounded(I.entropies(counts(spark, d), ["protein", "i"], gaps=True), "entropy")


@query(C2 + "SELECT protein, i, j, round(sum(-p * log2(p)), 6) + 0.0 AS entropy FROM (SELECT protein, i, j, n / sum(n) OVER (PARTITION BY protein, i, j) AS p FROM c2) GROUP BY ALL")
def agg15_joint_entropy(spark, d):
    return rounded(I.entropies(counts2(spark, d), ["protein", "i", "j"], gaps=True), "entropy")


BG = "(SELECT unnest(range(20)) AS a, unnest([" + ", ".join(f"{x}::DOUBLE" for x in I.BACKGROUND) + "]) AS q)"


@query(F1 + f", x AS (SELECT protein, i, f_pc / sum(f_pc) OVER w AS p, q / sum(q) OVER w AS q, (f_pc + q) / sum(f_pc + q) OVER w AS m FROM f1 JOIN {BG} USING (a) WINDOW w AS (PARTITION BY protein, i)) SELECT protein, i, round(sum(p * log2(p / q)), 6) + 0.0 AS kl, round(0.5::DOUBLE * (sum(p * log2(p / m)) + sum(q * log2(q / m))), 6) + 0.0 AS js FROM x GROUP BY ALL")
def agg16_divergences(spark, d):
    return rounded(I.divergences(single(spark, d), I.background(spark)), "kl", "js")


@query(MI + apc_sql("mi") + "SELECT protein, i, j, round(score, 6) + 0.0 AS score, round(apc, 6) + 0.0 AS apc FROM apc")
def agg17_mutual_information_apc(spark, d):
    t = Shared(spark, d)
    scores = I.mutual_information(t.freq2)
    return rounded(t.with_apc(scores), "score", "apc").drop("apc_term")


@query(MI + ", je AS (SELECT protein, i, j, sum(-p * log2(p)) AS entropy FROM (SELECT protein, i, j, n / sum(n) OVER (PARTITION BY protein, i, j) AS p FROM c2) GROUP BY ALL) SELECT protein, i, j, round(score / entropy, 6) + 0.0 AS normalized FROM mi JOIN je USING (protein, i, j)")
def agg18_normalized_mi(spark, d):
    t = Shared(spark, d)
    joint = I.entropies(t.counts2, ["protein", "i", "j"], gaps=True)
    return I.mutual_information(t.freq2).join(joint, ["protein", "i", "j"]).select("protein", "i", "j", r6(F.col("score") / F.col("entropy")).alias("normalized"))


OM = C2 + ", om AS (SELECT c2.protein, c2.i, c2.j, sum(pow(n - residues * x.f_pc * y.f_pc, 2) / residues) AS score, sum(pow(n - residues * x.f_pc * y.f_pc, 2) / (residues * x.f_pc * y.f_pc)) AS kass FROM c2 JOIN t2 USING (protein, i, j) JOIN f1 x ON x.protein = c2.protein AND x.i = c2.i AND x.a = c2.a JOIN f1 y ON y.protein = c2.protein AND y.i = c2.j AND y.a = c2.b GROUP BY ALL)"


@query(OM + apc_sql("om") + "SELECT protein, i, j, round(score, 6) + 0.0 AS score, round(apc, 6) + 0.0 AS apc FROM apc")
def agg19_omes_apc(spark, d):
    t = Shared(spark, d)
    return rounded(t.with_apc(I.omes(t.counts2, t.single)), "score", "apc").drop("apc_term")


@query(OM + "SELECT protein, i, j, round(kass, 6) + 0.0 AS score FROM om")
def agg19_omes_expected(spark, d):
    t = Shared(spark, d)
    return rounded(I.omes(t.counts2, t.single, "expected"), "score")


PROPERTIES = "(SELECT CAST(p_size % 13 AS INT) AS property, CAST(p_partkey % 20 AS INT) AS a, avg(p_retailprice) / 1000 AS value FROM part GROUP BY ALL)"
POTENTIAL = "(SELECT CAST(p_partkey % 20 AS INT) AS a, CAST(p_size % 20 AS INT) AS b, avg(p_retailprice) / 1000 AS value FROM part GROUP BY ALL)"


def properties(spark, d):
    """Scales of residues from the parts' prices."""
    return table(spark, d, "part").groupBy((F.col("p_size") % 13).alias("property"), (F.col("p_partkey") % 20).cast("int").alias("a")).agg((F.avg("p_retailprice") / 1000).alias("value"))


@query(F1 + f"SELECT protein, i, property, round(sum(f_pc * value), 6) + 0.0 AS mean_value FROM f1 JOIN {PROPERTIES} USING (a) GROUP BY ALL")
def agg20_expected_property(spark, d):
    return rounded(I.expected_property(single(spark, d), properties(spark, d)), "mean_value")


@query(F2 + f"SELECT protein, i, j, round(sum(f2 * value), 6) + 0.0 AS mean_value FROM f2 JOIN {POTENTIAL} USING (a, b) GROUP BY ALL")
def agg21_expected_potential(spark, d):
    t = Shared(spark, d)
    potential = table(spark, d, "part").groupBy((F.col("p_partkey") % 20).cast("int").alias("a"), (F.col("p_size") % 20).alias("b")).agg((F.avg("p_retailprice") / 1000).alias("value"))
    return rounded(I.expected_potential(t.freq2, potential), "mean_value")


@query(AL + f", v AS (SELECT protein, seq_id, pos, property, value FROM cell JOIN {PROPERTIES} ON a = state), r AS (SELECT x.protein, x.pos AS i, y.pos AS j, x.property, CASE WHEN stddev_pop(x.value) > 0 AND stddev_pop(y.value) > 0 THEN corr(x.value, y.value) END AS r FROM v x JOIN v y ON x.protein = y.protein AND x.seq_id = y.seq_id AND x.property = y.property AND x.pos < y.pos GROUP BY ALL) SELECT protein, i, j, " + ", ".join(f"round(max(r) FILTER (property = {k}), 6) + 0.0 AS r_{k}" for k in range(13)) + " FROM r GROUP BY ALL")
def agg22_property_correlation(spark, d):
    return rounded(I.property_correlation(long(spark, d), properties(spark, d)), *[f"r_{k}" for k in range(13)])


@query(F1 + "SELECT protein, a, round(avg(f_pc), 6) + 0.0 AS f FROM f1 GROUP BY ALL")
def agg23_global_frequencies(spark, d):
    return rounded(I.global_frequencies(single(spark, d)), "f")


@query(F1 + ", m AS (SELECT protein, i, a, avg(f_pc) OVER (PARTITION BY protein, a ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x FROM f1) SELECT protein, i, a, round(x, 6) + 0.0 AS moving_mean FROM m")
def win4_windowed_features(spark, d):
    return rounded(E.moving_mean(single(spark, d), ["protein", "a"], ["i"], "f_pc", 5), "moving_mean").select("protein", "i", "a", "moving_mean")


@query(F1 + f"SELECT protein, i, a, round(log2(f_pc / q), 6) + 0.0 AS pssm FROM f1 JOIN {BG} USING (a)")
def sca8_pssm(spark, d):
    back = I.background(spark).withColumnRenamed("f", "q")
    return single(spark, d).join(F.broadcast(back), "a").select("protein", "i", "a", r6(F.log2(F.col("f_pc") / F.col("q"))).alias("pssm"))


@query(F1 + """, k AS (SELECT protein, a, sum(n) AS n FROM c1 GROUP BY 1, 2), g AS (SELECT protein, a, n / sum(n) OVER (PARTITION BY protein) AS pc FROM k)
SELECT f1.protein, f1.i, f1.a, round(f, 6) + 0.0 AS f, round((1 - 2 / (neff + 2)) * f + 2 / (neff + 2) * coalesce(pc, 0), 6) + 0.0 AS f_pc FROM f1 JOIN neff USING (protein) LEFT JOIN g ON g.protein = f1.protein AND g.a = f1.a""")
def agg10b_overall_pseudocounts(spark, d):
    t = Shared(spark, d)
    return rounded(A.frequencies_from_overall(A.single_counts(long(spark, d), t.weights), t.neff, 2.0), "f", "f_pc")


# --- corrections: the mutual information stands for the strength of couplings ----


@query(MI + """, u AS (SELECT protein, i, sum(-f_pc * log2(f_pc)) AS u, sum(pow(f_pc * log2(f_pc), 2)) AS v FROM f1 GROUP BY ALL), s AS (SELECT mi.protein, mi.i, mi.j, score, x.u * y.u AS e FROM mi JOIN u x ON x.protein = mi.protein AND x.i = mi.i JOIN u y ON y.protein = mi.protein AND y.i = mi.j),
vv AS (SELECT protein, pow(sum(v), 2) AS vv FROM u GROUP BY 1), eta AS (SELECT protein, 2 * sum(score * score * e) / any_value(vv) AS eta FROM s JOIN vv USING (protein) GROUP BY ALL) SELECT protein, i, j, round(score * score - eta * e, 6) + 0.0 AS corrected, round(eta, 6) + 0.0 AS eta FROM s JOIN eta USING (protein)""")
def cor1_entropy_correction(spark, d):
    t = Shared(spark, d)
    from pairweave.operators import couplings as K

    norms = I.mutual_information(t.freq2).withColumnRenamed("score", "norm")
    return rounded(K.entropy_correction(norms, K.entropy_terms(t.single), squared=True), "corrected", "eta").select("protein", "i", "j", "corrected", "eta")


@query(MI + ", je AS (SELECT protein, i, j, sum(CASE WHEN f2 > 0 THEN -f2 * log2(f2) ELSE 0 END) AS h FROM f2 GROUP BY ALL) SELECT protein, i, j, round(score / (h + exp(-h)), 6) + 0.0 AS scaled FROM mi JOIN je USING (protein, i, j)")
def cor4_joint_entropy_scaling(spark, d):
    t = Shared(spark, d)
    from pairweave.operators import couplings as K

    f2 = t.freq2
    return rounded(K.joint_entropy_scaling(I.mutual_information(f2).withColumnRenamed("score", "norm"), I.joint_entropies(f2)), "scaled").select("protein", "i", "j", "scaled")


@query(MI + ", je AS (SELECT protein, i, j, sum(CASE WHEN f2 > 0 THEN -f2 * log2(f2) ELSE 0 END) AS h FROM f2 GROUP BY ALL), eta AS (SELECT protein, sum(score * h) / sum(h * h) AS eta FROM mi JOIN je USING (protein, i, j) GROUP BY ALL) SELECT protein, i, j, round(score - eta * h, 6) + 0.0 AS corrected FROM mi JOIN je USING (protein, i, j) JOIN eta USING (protein)")
def cor3_joint_entropy_correction(spark, d):
    t = Shared(spark, d)
    from pairweave.operators import couplings as K

    f2 = t.freq2
    return rounded(K.joint_entropy_correction(I.mutual_information(f2).withColumnRenamed("score", "norm"), I.joint_entropies(f2), 1.0), "corrected").select("protein", "i", "j", "corrected")


@query(MI + apc_sql("mi") + ", u AS (SELECT protein, i, sum(-f_pc * log2(f_pc)) AS u FROM f1 GROUP BY ALL) SELECT apc.protein, round(corr(apc_term, x.u * y.u), 6) + 0.0 AS r FROM apc JOIN u x ON x.protein = apc.protein AND x.i = apc.i JOIN u y ON y.protein = apc.protein AND y.i = apc.j GROUP BY ALL")
def agg41_apc_against_entropy(spark, d):
    t = Shared(spark, d)
    from pairweave.operators import couplings as K

    apc = t.with_apc(I.mutual_information(t.freq2))
    return K.with_pair_terms(apc, K.entropy_terms(t.single)).groupBy("protein").agg(r6(F.corr("apc_term", "e")).alias("r"))


UNSQUARED = MI + """, u AS (SELECT protein, i, sum(-f_pc * log2(f_pc)) AS u FROM f1 GROUP BY ALL), s AS (SELECT mi.protein, mi.i, mi.j, score, x.u AS u_i, y.u AS u_j, x.u * y.u AS e FROM mi JOIN u x ON x.protein = mi.protein AND x.i = mi.i JOIN u y ON y.protein = mi.protein AND y.i = mi.j),
uu AS (SELECT protein, pow(sum(u), 2) AS uu FROM u GROUP BY 1), eta AS (SELECT protein, 2 * sum(score * sqrt(e)) / any_value(uu) AS eta FROM s JOIN uu USING (protein) GROUP BY ALL)"""


def norms_and_terms(t):
    from pairweave.operators import couplings as K

    return stored(I.mutual_information(t.freq2).withColumnRenamed("score", "norm")), K.entropy_terms(t.single)


@query(UNSQUARED + " SELECT protein, i, j, round(score - eta * sqrt(e), 6) + 0.0 AS corrected, round(eta, 6) + 0.0 AS eta FROM s JOIN eta USING (protein)")
def cor2_unsquared_scale(spark, d):
    from pairweave.operators import couplings as K

    norms, terms = norms_and_terms(Shared(spark, d))
    return rounded(K.entropy_correction(norms, terms, squared=False), "corrected", "eta").select("protein", "i", "j", "corrected", "eta")


@query(UNSQUARED + " SELECT protein, i, j, round(u_i, 6) + 0.0 AS u_i, round(u_j, 6) + 0.0 AS u_j, round(e, 6) + 0.0 AS e, round(score, 6) + 0.0 AS norm, round(eta, 6) + 0.0 AS eta, round(score - eta * sqrt(e), 6) + 0.0 AS corrected FROM s JOIN eta USING (protein) WHERE i = 3 AND j = 17")
def cor5_correction_detail(spark, d):
    """How the correction of one pair of positions comes about, in each protein."""
    from pairweave.operators import couplings as K

    norms, terms = norms_and_terms(Shared(spark, d))
    detail = K.correction_detail(norms, terms, 3, 17, squared=False)
    return rounded(detail, "u_i", "u_j", "e", "norm", "eta", "corrected").select("protein", "i", "j", "u_i", "u_j", "e", "norm", "eta", "corrected")


@query(UNSQUARED + " SELECT protein, round(neff, 6) + 0.0 AS neff, round(eta, 6) + 0.0 AS eta FROM eta JOIN neff USING (protein)")
def cor11_scale_by_depth(spark, d):
    from pairweave.operators import couplings as K

    t = Shared(spark, d)
    norms, terms = norms_and_terms(t)
    return rounded(K.eta(K.with_pair_terms(norms, terms), terms, squared=False).join(t.neff, "protein"), "neff", "eta").select("protein", "neff", "eta")
