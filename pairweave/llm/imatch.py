"""Operator 3, I-Match fingerprints, in DataFrame functions only.

Terms are the words of a text. Those whose document frequency lies in a band
are the lexicon; a text's terms in it, sorted and distinct, are hashed once for
each of SUBSETS random parts of the lexicon. The parts have several rates, so
short and long texts alike have parts that hold about one of their terms; the
likeness of two fingerprints is the share of parts with equal hashes, at the
rate that tells most.

The band is a share of all documents from below, so the lexicon has at most
``LEAST * mean distinct terms per document`` entries however many documents
there are; it is sent to the scan behind a check of its size.

A text's neighbour in the order of ``doc_id`` comes from windows over ranges of
ids, whose outer rows are joined; no task sees all rows. Rows without ``doc_id``
are one range.

Cases: a null text is empty; an empty text, or one without terms of the lexicon,
has the digest of the whole text as its fingerprint; texts are worked on whole;
rows of equal ``doc_id`` follow each other in the order of their texts, and
repeated rows are rows like others; a null ``doc_id`` comes last in descending
order; a single row is its own next document; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairweave.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
#: A term of the lexicon is in one of LEAST documents at least, in one of MOST at most.
LEAST, MOST = 200, 20
#: Part s holds a term if digits 2s, 2s + 1 of the term's MD5 are below this: one term of 4, 16, 64 or 256.
RATES = ["40", "10", "04", "01"]
PER_RATE = 4
SUBSETS = PER_RATE * len(RATES)
#: Hexadecimal digits of a part's hash.
DIGITS = 8
#: Lexicons of more terms are joined by a shuffle.
MOST_SENT = 400_000
ROWS_PER_RANGE = 256
#: Quantiles that cut the ids into ranges before; and bits of a range's number that count inside of one.
RANGES, UPPER = 500, 40


def terms(text: Column) -> Column:
    """Distinct words, and the empty string, which stands for the row itself."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(text, SPACE)))


def lexicon(docs: DataFrame) -> DataFrame:
    """(term, parts): the terms of the band, and the random parts that they are in as bits."""
    n = docs.count()
    count = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).filter("term <> ''").groupBy("term").count()
    digest = F.md5(F.col("term").cast("binary"))
    parts = sum((F.when(F.substring(digest, 2 * s + 1, 2) < RATES[s // PER_RATE], 1 << s).otherwise(0) for s in range(SUBSETS)), F.lit(0))
    return count.filter((F.col("count") * LEAST >= n) & (F.col("count") * MOST <= n)).select("term", parts.alias("parts"))


def spans(rows: DataFrame) -> Column:
    """A number for ranges of about ROWS_PER_RANGE rows, ascending with doc_id; -1 for nulls.

    RANGES quantiles cut the ids, so that a far id moves no others together;
    between two quantiles ranges are equally wide. The upper bits say between which.
    """
    n, low = rows.agg(F.count("doc_id"), F.min("doc_id")).first()
    if not n:
        return F.lit(-1).cast("long")
    cuts = rows.approxQuantile("doc_id", [i / RANGES for i in range(1, RANGES + 1)], 0.2 / RANGES)
    edges = sorted({low, *(int(x) for x in cuts if x > low)})
    each = max(1, n // len(edges) // ROWS_PER_RANGE)  # ranges between two quantiles
    width = [max(1, -(-(y - x) // each)) for x, y in zip(edges, [*edges[1:], edges[-1] + 1])]
    step = math.isqrt(len(edges)) + 1
    groups = [edges[i : i + step] for i in range(0, len(edges), step)]
    of = lambda values: F.array(*[F.lit(x).cast("long") for x in values])
    group = F.size(F.filter(of([g[0] for g in groups]), lambda x: x <= F.col("doc_id")))
    inside = F.size(F.filter(F.element_at(F.array(*[of(g) for g in groups]), group), lambda x: x <= F.col("doc_id")))
    k = (group - 1) * step + inside
    place = F.least(F.floor((F.col("doc_id") - F.element_at(of(edges), k)) / F.element_at(of(width), k)), F.lit((1 << UPPER) - 1))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.shiftleft(k.cast("long"), UPPER) + place).cast("long")


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, span, place, next_span, next_place): each row with the next one in descending order of doc_id, around to the first; (span, place) is unique."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    span = spans(rows)
    dealt = rows.withColumn("span", span).repartition("span")  # the one shuffle of texts
    ordered = Window.partitionBy("span").orderBy("doc_id", "text")
    placed = dealt.select("*", F.row_number().over(ordered).alias("place"), F.lag("text").over(ordered).alias("below"))
    # The last row of each range is the next document of the first row of the range above.
    last = F.struct("doc_id", "text")
    tops = dealt.groupBy("span").agg(F.max(last).alias("x"), F.count(F.lit(1)).cast("int").alias("rows")).select(F.col("span").alias("next_span"), F.col("rows").alias("next_place"), F.col("x.text").alias("top_text"))
    ids = rows.select(span.alias("span")).groupBy("span").agg(F.lit(0).alias("one")).withColumn("part", F.shiftright("span", UPPER))
    parts = ids.groupBy("part").agg(F.max("span").alias("highest"))  # RANGES + 1 rows at most
    around, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.lag("highest").over(around), F.last("highest").over(whole)).alias("before"))
    heads = ids.join(F.broadcast(parts), F.col("part") == F.col("p")).select(F.col("span").alias("at"), F.coalesce(F.lag("span").over(Window.partitionBy("part").orderBy("span")), "before").alias("below_span"))
    heads = heads.join(tops, F.col("below_span") == F.col("next_span")).select("at", "next_span", "next_place", "top_text")
    joined = placed.join(heads.hint("merge"), (F.col("span") == F.col("at")) & (F.col("place") == 1), "left")
    inside = F.col("place") > 1
    return joined.select(
        "doc_id", "text", F.when(inside, F.col("below")).otherwise(F.col("top_text")).alias("next_text"), "span", "place",
        F.when(inside, F.col("span")).otherwise(F.col("next_span")).alias("next_span"), F.when(inside, F.col("place") - 1).otherwise(F.col("next_place")).alias("next_place"),
    )


def fingerprints(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(span, place, also, fingerprint, edited_fingerprint) of rows (span, place, text, edited, also)."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("text"), F.col("also").alias("also")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text"), F.lit(None).cast(rows.schema["also"].dataType).alias("also"))))
    flat = rows.select("span", "place", both.alias("v")).select("span", "place", "v.version", "v.also", F.md5(F.col("v.text").cast("binary")).alias("whole"), F.explode(terms(F.col("v.text"))).alias("term"))
    row = F.col("term") == ""  # what belongs to the row travels with its empty term only
    flat = flat.select("span", "place", "version", "term", F.when(row, F.col("also")).alias("also"), F.when(row, F.col("whole")).alias("whole"))
    words = words.union(words.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).alias("parts")))
    few = words.count() <= MOST_SENT
    kept = flat.join(F.broadcast(words) if few else words, "term")
    of = lambda v: F.sort_array(F.collect_list(F.when((F.col("term") != "") & (F.col("version") == v), F.struct("term", "parts"))))
    whole = lambda v: F.max(F.when(F.col("version") == v, F.col("whole")))
    grouped = kept.groupBy("span", "place").agg(F.max("also").alias("also"), *[f(v).alias(f"{n}{v}") for v in (0, 1) for n, f in (("t", of), ("whole", whole))])

    def fingerprint(v: int):
        inside = [F.expr(f"filter(t{v}, x -> x.parts & {1 << s} > 0)") for s in range(SUBSETS)]
        parts = F.array(*[F.when(F.size(x) > 0, F.substring(F.md5(F.array_join(x.getField("term"), " ").cast("binary")), 1, DIGITS)).otherwise("") for x in inside])
        return F.when(F.size(f"t{v}") == 0, F.concat(F.lit("x"), F.col(f"whole{v}"))).otherwise(F.array_join(parts, ":"))

    return grouped.select("span", "place", "also", fingerprint(0).alias("fingerprint"), fingerprint(1).alias("edited_fingerprint"))


def _parts(fingerprint: str) -> Column:
    """The hashes of the parts; none in the fingerprint of a text without terms of the lexicon."""
    return F.when(F.col(fingerprint).startswith("x"), F.array(*[F.lit("")] * SUBSETS)).otherwise(F.split(fingerprint, ":"))


def with_likeness(rows: DataFrame, name: str, x: str, y: str, p: str, q: str) -> DataFrame:
    """Adds the likeness of fingerprints x and y, whose parts are p and q: the best share of equal parts of a rate that has two parts with terms, or the share of all parts."""

    def by_rate(flag: str) -> Column:
        flags = f"zip_with({p}, {q}, (a, b) -> int({flag}))"
        return F.expr(f"transform(sequence(0, {len(RATES) - 1}), g -> aggregate(slice({flags}, g * {PER_RATE} + 1, {PER_RATE}), 0, (a, b) -> a + b))")

    total = "aggregate({}, 0, (a, b) -> a + b)"
    either, equal = total.format("_either"), total.format("_equal")
    best = "array_max(zip_with(_either, _equal, (e, m) -> if(e >= 2, m / e, 0.0D)))"
    value = F.expr(f"case when {x} = {y} then 1.0D when {either} = 0 then 0.0D else greatest({best}, {equal} / {either}) end")
    out = rows.withColumns({"_either": by_rate("a <> '' or b <> ''"), "_equal": by_rate("a <> '' and a = b")})
    return out.withColumn(name, value).drop("_either", "_equal")


def imatch(docs: DataFrame) -> DataFrame:
    """One row for each document: fingerprints of its text and of its edited text, and how alike they and the next document's are."""
    third = F.expr("int(floor(char_length(text) / 3))")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 3)))"), F.substring("next_text", F.lit(1), third))
    rows = in_order(docs).withColumn("edited", edited)
    also = F.struct("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "next_span", "next_place")
    found = stored(fingerprints(rows.select("span", "place", "text", "edited", also.alias("also")), stored(lexicon(docs))))
    own = found.select("span", "place", "also.*", "fingerprint", "edited_fingerprint")
    following = found.select(F.col("span").alias("next_span"), F.col("place").alias("next_place"), F.col("fingerprint").alias("next_fingerprint"))
    rows = own.join(following, ["next_span", "next_place"]).withColumns({"p": _parts("fingerprint"), "q": _parts("edited_fingerprint"), "r": _parts("next_fingerprint")})
    rows = with_likeness(rows, "near_edited", "fingerprint", "edited_fingerprint", "p", "q")
    rows = with_likeness(rows, "near_next", "fingerprint", "next_fingerprint", "p", "r")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
