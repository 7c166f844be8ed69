"""Scalar functions as column expressions: encoding, log space, densities, indices."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of the residue alphabet; a gap follows as state 20.
ALPHABET = "ARNDCQEGHILKMFPSTWYV"
GAP = 20


def encode_state(residue: Column) -> Column:
    """State 0 to 19 of a residue letter in either case; anything else is a gap."""
    return F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), F.upper(residue)), F.lit(0)) - 1, F.lit(GAP))


def decode_state(state: Column) -> Column:
    return F.substring(F.lit(ALPHABET + "-"), state + 1, F.lit(1))


# Of residue numbers in four columns: how many begin with a digit, how many more with one of the 26 letters of a case, and A000 as a number of base 36.
_DIGITS, _LETTERS, _FIRST = 10_000, 26 * 36**3, 10 * 36**3


def residue_number(text: Column) -> Column:
    """The number that stands in a structure file's four columns. Beyond 9999 it goes on as A000 to ZZZZ and a000 to zzzz, of base 36 ("hybrid-36")."""
    letters = F.conv(text, 36, 10).cast("int") - _FIRST + _DIGITS
    return F.when(text.rlike("^[A-Z]"), letters).when(text.rlike("^[a-z]"), letters + _LETTERS).otherwise(F.when(~text.rlike("^[A-Za-z]"), text).cast("int"))


def residue_columns(number: Column) -> Column:
    """The number as ``residue_number`` reads it; an error where four columns can't hold it."""
    letters = lambda first: F.conv((number - first + _FIRST).cast("string"), 10, 36)
    return (
        F.when(number < _DIGITS, F.lpad(number.cast("string"), 4, " ")).when(number < _DIGITS + _LETTERS, letters(_DIGITS))
        .when(number < _DIGITS + 2 * _LETTERS, F.lower(letters(_DIGITS + _LETTERS))).otherwise(F.raise_error(F.lit("a residue number beyond four columns")))
    )


def pair_index(a: Column, b: Column) -> Column:
    return a * 20 + b


def pair_name(index: Column) -> Column:
    return F.concat_ws("-", decode_state(F.floor(index / 20).cast("int")), decode_state((index % 20).cast("int")))


def log_add(x: Column, y: Column) -> Column:
    """ln(exp(x) + exp(y))."""
    return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))


def log_sum(xs: list[Column]) -> Column:
    top = F.greatest(*xs) if len(xs) > 1 else xs[0]
    return top + F.ln(functools.reduce(operator.add, [F.exp(x - top) for x in xs]))


def entropy_term(f: Column) -> Column:
    """-f log2 f; 0 where f isn't positive."""
    return F.when(f > 0, -f * F.log2(f)).otherwise(0.0)


def variance_term(f: Column) -> Column:
    return f * (1 - f)


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(functools.reduce(operator.add, [(x - y) * (x - y) for x, y in zip(a, b)]))


def length_prior(length: Column, intercept: Column, slope: Column) -> Column:
    """Expected share of contacts in a chain of ``length`` residues."""
    return (intercept + slope * F.ln(length)) / (length - 1)


def triangle_index(i: Column, j: Column, length: Column) -> Column:
    """Number of the pair i < j, row by row."""
    return F.expr("0") + i * length - (i * (i + 1) / 2).cast("long") + j - i - 1


def triangle_pair(index: Column, length: Column) -> tuple[Column, Column]:
    """(i, j) of a number from ``triangle_index``."""
    m = 2 * length - 1
    i = F.floor((m - F.sqrt((m * m - 8 * index).cast("double"))) / 2)
    i = F.when(triangle_index(i, i + 1, length) > index, i - 1).otherwise(i)
    i = F.when(triangle_index(i + 1, i + 2, length) <= index, i + 1).otherwise(i)
    return i.cast("long"), (index - triangle_index(i, i + 1, length) + i + 1).cast("long")


def normal_density(x: Column, mean: Column, precision: Column) -> Column:
    return F.sqrt(precision / (2 * F.pi())) * F.exp(-0.5 * precision * (x - mean) * (x - mean))


def json_number(document: Column, *paths: str) -> Column:
    """The number at the first path that the JSON document has."""
    return F.coalesce(*[F.get_json_object(document, p).cast("double") for p in paths])
