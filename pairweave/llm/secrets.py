"""Operator 5, secret scans, in DataFrame functions only.

Three kinds of spans come from patterns. The method adds a fourth, "random":
runs of 20 and more characters of common encodings, letters and digits mixed,
that are too even for a name. For each run the encoding is inferred
(hexadecimal, base 32, base 64 with either set of signs).

1.  The test battery asks whether the run can be random: chi-squared tells
    whether its alphabet is used evenly, a runs test whether high and low symbols
    alternate as they should, and the lag-1 serial correlation whether neighbours
    are alike. The three p-values are combined by Fisher's method; a run that is
    rejected at ALPHA (words, repeats, series) is no candidate.
2.  The hypothesis that is tested for reporting is that the run is an ordinary
    name. Its sum of squared counts, which is chi-squared but for constants, has
    a mean and a variance that follow from its length and from how evenly names
    use the alphabet; its runs of capitals, of small letters and of digits are as
    long as those of names (NAMES). The p-value is that of a sum as small and of
    runs as short, by Stouffer's method.
3.  The Benjamini-Hochberg rule at LEVEL rejects that hypothesis, within each
    band of lengths, as longer runs tell more: of what is reported, a share of
    LEVEL at most is expected to be names. What is rejected is a span; a run that
    is no candidate counts as a test of p-value 1. p-values are rounded up to
    steps, so that the rule needs a histogram of bounded size only.

Positions are code points, ends exclusive. All expressions exist in Spark SQL
and in DuckDB from one text (``Dialect``).

Cases: a null text is empty and has no spans; texts are worked on whole; equal
rows get equal results, one row each; a null ``doc_id`` stays; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.llm.common import stored

KINDS = ["assign", "access", "hex", "random"]


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, ["password", "passwd", "secret", "token", "api_?key"])) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What a text with a span of the kind has, found faster.
ASSIGN_HINT = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}"""
#: A run that is too short fails whole, so least lengths may be part of these two patterns.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
LEVEL = 0.02
#: A run is no candidate where the battery rejects randomness at this level; of random runs, so many are lost.
ALPHA = 0.01
# Fixed values, by the size of the alphabet: sums of the squares and of the cubes of symbols' shares in ordinary names (English letters; in 64 symbols, about one in eight a capital, a digit or a sign); mean and spread over names of the share of places where capitals, small letters and digits change.
NAMES = {16: (0.11, 0.014, 0.25, 0.12), 32: (0.054, 0.0039, 0.15, 0.08), 64: (0.05, 0.0033, 0.35, 0.12)}
#: Lengths at which the next band begins.
BANDS = [24, 32, 48]
#: p-values are rounded up to powers of 2 ** (1 / STEPS); LAST is the smallest step.
STEPS, LAST = 8, 400
ALPHABETS = {
    "lower hexadecimal": ("^[0-9a-f]+$", "0123456789abcdef"),
    "upper hexadecimal": ("^[0-9A-F]+$", "0123456789ABCDEF"),
    "base 32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base 64 for URLs": ("^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    "base 64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}


@dataclass
class Dialect:
    duck: bool

    def quoted(self, pattern: str) -> str:
        pattern = pattern.replace("'", "''") if self.duck else pattern.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{pattern}'"

    def fn(self, args: str, body: str) -> str:
        return f"lambda {args}: {body}" if self.duck else f"{args} -> {body}"

    def map(self, items: str, x: str, body: str) -> str:
        return f"{'list_transform' if self.duck else 'transform'}({items}, {self.fn(x, body)})"

    def keep(self, items: str, x: str, body: str) -> str:
        return f"{'list_filter' if self.duck else 'filter'}({items}, {self.fn(x, body)})"

    def total(self, items: str) -> str:
        return f"coalesce(list_sum({items}), 0)" if self.duck else f"aggregate({items}, 0D, (a_, b_) -> a_ + b_)"

    def count(self, items: str) -> str:
        return f"len({items})" if self.duck else f"size({items})"

    def at(self, items: str, i: str) -> str:
        return f"{'list_extract' if self.duck else 'element_at'}({items}, {i})"

    def numbers(self, last: str) -> str:
        return f"range(1, CAST({last} AS BIGINT) + 1)" if self.duck else f"if({last} < 1, cast(array() as array<int>), sequence(1, cast({last} as int)))"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}" if self.duck else "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.quoted(pattern)})" if self.duck else f"{text} rlike {self.quoted(pattern)}"

    def extract(self, text: str, pattern: str, group: int) -> str:
        return f"regexp_extract_all({text}, {self.quoted(pattern)}, {group})"

    def lengths(self, items: str) -> str:
        return self.map(items, "s_", "length(s_)")

    def pieces(self, text: str, pattern: str) -> str:
        return f"string_split_regex({text}, {self.quoted(pattern)})" if self.duck else f"split({text}, {self.quoted(pattern)}, -1)"

    def ends(self, sizes: str) -> str:
        """Running totals."""
        if self.duck:
            return f"list_transform({sizes}, lambda s_, i_: CAST(list_sum({sizes}[1:i_]) AS BIGINT))"
        return f"aggregate({sizes}, cast(array() as array<int>), (a_, s_) -> array_append(a_, coalesce(try_element_at(a_, -1), 0) + s_))"

    def when(self, hint: str, items: str, kind: str) -> str:
        return f"CASE WHEN {hint} THEN {items} ELSE {f'[]::{kind}[]' if self.duck else f'cast(array() as array<{kind}>)'} END"


def placed(d: Dialect, k: str, kind: int) -> str:
    """(start, kind, stop, t, v) of the matches of kind ``k``, from the running totals of gaps and lengths."""
    stop, t = d.at(f"ends_{k}", "i_"), d.at(f"match_{k}", "i_")
    return d.map(d.numbers(d.count(f"match_{k}")), "i_", d.struct(start=f"{stop} - length({t})", kind=str(kind), stop=stop, t=t, v=d.at("value_assign", "i_") if k == "assign" else t))


def tail(z: str) -> str:
    """Of the normal distribution, above z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = f"(1 / (1 + 0.2316419 * ({z})))"
    return f"(exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"


def steps(d: Dialect) -> list[list[tuple[str, str]]]:
    """Columns to add one after another to a table with ``text``; the last are ``base`` and ``tested``."""
    patterns = {"assign": (ASSIGN, d.matches("text", ASSIGN_HINT)), "access": (ACCESS, d.matches("text", "AKIA")), "hex": (HEX, d.matches("text", HEX)), "random": (CANDIDATE, d.matches("text", CANDIDATE))}
    string, number = ("VARCHAR", "BIGINT") if d.duck else ("string", "int")
    found = [(f"match_{k}", d.when(hint, d.extract("text", p, 0), string)) for k, (p, hint) in patterns.items()]
    found += [(f"gap_{k}", d.when(hint, d.lengths(d.pieces("text", p)), number)) for k, (p, hint) in patterns.items()]
    found += [("value_assign", d.when(patterns["assign"][1], d.extract("text", ASSIGN, 2), string))]
    sizes = [(f"size_{k}", d.map(d.numbers(d.count(f"match_{k}")), "i_", f"{d.at(f'gap_{k}', 'i_')} + length({d.at(f'match_{k}', 'i_')})")) for k in KINDS]
    ends = [(f"ends_{k}", d.ends(f"size_{k}")) for k in KINDS]
    spans = [(f"all_{k}", placed(d, k, i)) for i, k in enumerate(KINDS)]
    narrow = d.struct(start="x.start", kind="x.kind", stop="x.stop")
    lists = [d.map(d.keep("all_assign", "x", "length(x.v) >= 12"), "x", narrow), d.map("all_access", "x", narrow), d.map("all_hex", "x", narrow)]
    base = f"list_sort(list_concat({', '.join(lists)}))" if d.duck else f"sort_array(concat({', '.join(lists)}))"
    free = f"{d.count(d.keep('base', 'b', 'b.start < x.stop AND x.start < b.stop'))} = 0"
    mixed = f"{d.matches('x.t', '[0-9]')} AND {d.matches('x.t', '[A-Za-z]')}"  # letters alone are words, digits alone numbers
    letters = "CASE " + " ".join(f"WHEN {d.matches('x.t', p)} THEN '{a}'" for p, a in list(ALPHABETS.values())[:-1]) + f" ELSE '{ALPHABETS['base 64'][1]}' END"
    chosen = d.map(d.keep(d.keep("all_random", "x", mixed), "x", free), "x", d.struct(start="x.start", stop="x.stop", t="x.t", letters=letters))
    values = d.map("chosen", "x", d.struct(start="x.start", stop="x.stop", size="CAST(length(x.letters) AS DOUBLE)", v=d.map(d.numbers("length(x.t)"), "i_", "CAST(instr(x.letters, substring(x.t, i_, 1)) - 1 AS DOUBLE)")))
    n = f"CAST({d.count('x.v')} AS DOUBLE)"
    same = d.total(d.map(f"{'list_distinct' if d.duck else 'array_distinct'}(x.v)", "s_", f"CAST({d.count(d.keep('x.v', 'y_', 'y_ = s_'))} AS DOUBLE) * {d.count(d.keep('x.v', 'y_', 'y_ = s_'))}"))
    high = d.keep("x.v", "y_", "y_ >= x.size / 2")
    following = d.numbers(f"{d.count('x.v')} - 1")
    now, after = d.at("x.v", "i_"), d.at("x.v", "i_ + 1")
    turns = d.total(d.map(following, "i_", f"CASE WHEN ({now} >= x.size / 2) <> ({after} >= x.size / 2) THEN 1.0 ELSE 0.0 END" if d.duck else f"CASE WHEN ({now} >= x.size / 2) <> ({after} >= x.size / 2) THEN 1D ELSE 0D END"))
    cls = lambda v: f"CASE WHEN x.size <= 16 THEN CASE WHEN {v} >= 10 THEN 1 ELSE 0 END WHEN {v} >= 52 THEN 2 WHEN {v} >= 26 THEN 1 ELSE 0 END"
    changes = f"CAST({d.count(d.keep(following, 'i_', f'({cls(now)}) <> ({cls(after)})'))} AS DOUBLE)"
    sums = d.map("vals", "x", d.struct(start="x.start", stop="x.stop", size="x.size", n=n, changes=changes, same=same, high=f"CAST({d.count(high)} AS DOUBLE)", turns=turns, mean=f"{d.total('x.v')} / {n}", v="x.v"))
    lag = d.total(d.map(following, "i_", f"({now} - x.mean) * ({after} - x.mean)"))
    spread = d.total(d.map("x.v", "y_", "(y_ - x.mean) * (y_ - x.mean)"))
    moments = d.map("sums", "x", d.struct(start="x.start", stop="x.stop", size="x.size", n="x.n", changes="x.changes", same="x.same", turns="x.turns", expected="2 * x.high * (x.n - x.high) / x.n", lag=lag, spread=spread))
    # z of each test; where a test has no spread (one symbol, one side only) it rejects outright.
    df = "(x.size - 1)"
    chi = f"(pow((x.size / x.n * x.same - x.n) / {df}, 1.0 / 3) - (1 - 2 / (9 * {df}))) / sqrt(2 / (9 * {df}))"
    runs = "CASE WHEN x.expected * (x.expected - 1) <= 0 THEN 40.0 ELSE abs(x.turns - x.expected) / sqrt(x.expected * (x.expected - 1) / (x.n - 1)) END"
    serial = "CASE WHEN x.spread <= 0 THEN 40.0 ELSE abs(x.lag / x.spread) * sqrt(x.n) END"
    by_size = lambda k: "CASE " + " ".join(f"WHEN x.size <= {m} THEN {v[k]}" for m, v in list(NAMES.items())[:-1]) + f" ELSE {NAMES[64][k]} END"
    s2, s3, mean, sd = (f"CAST({by_size(k)} AS DOUBLE)" for k in range(4))
    # The number of equal pairs, half of what the sum of squares has over n, as a gamma distribution of that mean and variance, by Wilson and Hilferty.
    expected = f"(x.n * (x.n - 1) / 2 * {s2})"
    shape = f"({expected} * {expected} / (x.n * (x.n - 1) / 2 * ({s2} - {s2} * {s2}) + x.n * (x.n - 1) * (x.n - 2) * ({s3} - {s2} * {s2})))"
    even = f"((1 - 1 / (9 * {shape}) - pow((x.same - x.n) / 2 / {expected}, 1.0 / 3)) * 3 * sqrt({shape}))"
    short = f"(x.changes / (x.n - 1) - {mean}) / sqrt({sd} * {sd} + {mean} * (1 - {mean}) / (x.n - 1))"
    name = f"({even} + {short}) / sqrt(2.0)"
    scores = d.map("moments", "x", d.struct(start="x.start", stop="x.stop", n="x.n", name=f"CAST(least(37.0, greatest(-37.0, {name})) AS DOUBLE)", chi=f"CAST(least(37.0, greatest(-37.0, {chi})) AS DOUBLE)", runs=f"CAST(least(37.0, {runs}) AS DOUBLE)", serial=f"CAST(least(37.0, {serial}) AS DOUBLE)"))
    logs = d.map("scores", "x", d.struct(start="x.start", stop="x.stop", n="x.n", name=f"CASE WHEN x.name >= 0 THEN {tail('x.name')} ELSE 1 - {tail('-x.name')} END", half=f"-ln(CASE WHEN x.chi >= 0 THEN {tail('x.chi')} ELSE 1 - {tail('-x.chi')} END) - ln(2 * {tail('x.runs')}) - ln(2 * {tail('x.serial')})"))
    p = "exp(-greatest(x.half, 0.0)) * (1 + greatest(x.half, 0.0) + greatest(x.half, 0.0) * greatest(x.half, 0.0) / 2)"
    band = "CASE " + " ".join(f"WHEN x.n < {b} THEN {i}" for i, b in enumerate(BANDS)) + f" ELSE {len(BANDS)} END"
    step = f"CAST(least({LAST}, greatest(0, floor(-ln(greatest(CASE WHEN {p} < {ALPHA} THEN 1.0 ELSE x.name END, 1e-300)) / ln(2.0) * {STEPS}))) AS INT)"
    tested = d.map("logs", "x", d.struct(start="x.start", stop="x.stop", band=band, step=step))
    return [found, sizes, ends, spans, [("base", base)], [("chosen", chosen)], [("vals", values)], [("sums", sums)], [("moments", moments)], [("scores", scores)], [("logs", logs)], [("tested", tested)]]


SPARK, DUCK = Dialect(False), Dialect(True)


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``, the patterns' spans, and ``tested``, the runs with their band and step; ``text`` not null."""
    names = [c for c in docs.columns if c != "text"]
    out = docs.select(*names, F.coalesce("text", F.lit("")).alias("text"))
    held = list(out.columns)
    for step in steps(SPARK):
        out = out.select(*out.columns, *[F.expr(e).alias(c) for c, e in step])
    return out.select(*held, "base", "tested")


def thresholds(tested: DataFrame) -> list[int]:
    """For each band the least step that is rejected, from a histogram of (band, step)."""
    counts: dict[tuple[int, int], int] = {}
    for r in tested.select(F.explode("tested").alias("x")).groupBy("x.band", "x.step").count().collect():  # at most bands * steps rows
        counts[r.band, r.step] = r["count"]
    return [rejected_from([counts.get((band, s), 0) for s in range(LAST + 1)]) for band in range(len(BANDS) + 1)]


def rejected_from(counts: list[int]) -> int:
    """Benjamini-Hochberg over p-values of 2 ** (-step / STEPS), counts[step] of each: the least rejected step, or one past the last."""
    total, seen, least = sum(counts), 0, LAST + 1
    for step in range(LAST, -1, -1):
        seen += counts[step]
        if seen and 2.0 ** (-step / STEPS) <= seen / total * LEVEL:
            least = step
    return least


def reported(limits: list[int]) -> str:
    limit = "CASE x.band " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(limits)) + " END"
    return f"transform(filter(tested, x -> x.step >= {limit}), x -> named_struct('start', x.start, 'kind', {KINDS.index('random')}, 'stop', x.stop))"


NAMED = "CASE x.kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat({NAMED}, ':', x.start, ':', x.stop)), ',')"


def secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: numbers and places of its spans."""
    rows = stored(scanned(docs.select("doc_id", "text")).select("doc_id", "base", "tested"))
    rows = rows.withColumn("spans", F.expr(f"sort_array(concat(base, {reported(thresholds(rows))}))"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return rows.select("doc_id", *counts, F.sha2(F.expr(_joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_joined("spans")).alias("spans"))


MASK = "[SECRET]"


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of a secret replaced by MASK; overlapping spans by one. A null text becomes an empty one."""
    limits = thresholds(scanned(docs.select("text").filter(F.col("text").rlike(CANDIDATE))))  # other texts have no runs
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")  # so that no column of the documents clashes
    out = scanned(whole).withColumn("_spans", F.expr(f"sort_array(concat(base, {reported(limits)}))"))
    start = "named_struct('at', 0, 'out', '')"
    merge = f"(a_, x) -> CASE WHEN x.start >= a_.at THEN named_struct('at', x.stop, 'out', concat(a_.out, substring(text, a_.at + 1, x.start - a_.at), '{MASK}')) ELSE named_struct('at', greatest(a_.at, x.stop), 'out', a_.out) END"
    text = f"CASE WHEN size(_spans) = 0 THEN text ELSE aggregate(_spans, {start}, {merge}, a_ -> concat(a_.out, substring(text, a_.at + 1))) END"
    out = out.withColumn("_new", F.expr(text)).select(*[F.col("_new").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sql() -> str:
    """DuckDB twin of ``secrets`` over the view ``documents``."""
    d, ctes, before = DUCK, ["t0 AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"], "t0"
    for k, step in enumerate(steps(d), 1):
        ctes.append(f"t{k} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {c}' for c, e in step)} FROM {before})")
        before = f"t{k}"
    random = KINDS.index("random")
    joined = lambda s: f"array_to_string(list_transform({s}, lambda x: {NAMED} || ':' || x.start || ':' || x.stop), ',')"
    ctes += [
        f"h AS (SELECT x.band AS band, x.step AS step, count(*) AS n FROM (SELECT unnest(tested) AS x FROM {before}) GROUP BY ALL)",
        "c AS (SELECT band, step, sum(n) OVER (PARTITION BY band ORDER BY step DESC) AS seen, sum(n) OVER (PARTITION BY band) AS total FROM h)",
        # between steps that occur the bound may be met as well: the least step s with 2 ** (-s / STEPS) <= seen / total * LEVEL
        f"e AS (SELECT band, min(step) AS limit_ FROM c WHERE pow(2.0, -step / {STEPS}.0) <= seen / total * {LEVEL} GROUP BY band)",
        f"a AS (SELECT r, list({{'start': x.start, 'kind': {random}, 'stop': x.stop}}) AS more FROM (SELECT r, unnest(tested) AS x FROM {before}) JOIN e ON e.band = x.band WHERE x.step >= limit_ GROUP BY r)",
        f"s AS (SELECT doc_id, base, list_sort(CASE WHEN more IS NULL THEN base ELSE list_concat(base, more) END) AS spans FROM {before} LEFT JOIN a USING (r))",
    ]
    counts = ", ".join(f"CAST(len(list_filter(base, lambda x: x.kind = {i})) AS BIGINT) AS n_{k}" for i, k in enumerate(KINDS[:3]))
    return f"WITH {', '.join(ctes)} SELECT doc_id, {counts}, sha256({joined('base')}) AS base_sha256, {joined('spans')} AS spans FROM s"
