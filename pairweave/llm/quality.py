"""Operator 4, quality rules: repetition inside a text from a suffix array.

The suffix array is over words, in the order of their hashes, and holds the
suffixes whose first ``WINDOW`` words occur again in the same text; no other
suffix can take part in a repeat of that length. Its symbols are these windows.
Prefix doubling ranks the suffixes at 1, 2, 4, ... symbols; the common prefix of
neighbours in suffix order is read back from these ranks. A suffix's longest common prefix with either neighbour
is the longest repeat that starts there, so the union of the spans
``[i, i + lcp)`` is what maximal repeated substrings cover.

Cases: a null or empty text has no words, fails the base rule and has all
figures 0; texts of any length are worked on whole (memory grows with the
longest text of a batch); equal rows get equal results, one row each; an empty
table gives an empty result; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairweave.llm.common import Texts
from pairweave.llm.words import Words, mix, prefix_hash, span_hash, words

WINDOW = 3
#: Repeats of fewer words are ordinary phrases and don't count as covered.
MIN_REPEAT = 10
#: A text goes if repeats cover more than this share of its words,
MAX_COVERED = 0.4
#: or if a single repeat is longer than this, in words.
MAX_REPEAT = 200
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, " + ", ".join(f"{x} long" for x in FIGURES) + ", covered_words long, longest_repeat long, base_failed boolean, kept boolean"
_U = np.uint64


def longest_prefixes(w: Words) -> np.ndarray:
    """For each word the length, in words, of the longest repeat within its text that starts there; 0 if shorter than WINDOW."""
    n = len(w.hash)
    lcp = np.zeros(n, np.int64)
    if n < WINDOW:
        return lcp
    window = mix(w.doc[: n - WINDOW + 1].astype(np.uint64) + _U(1))
    for j in range(WINDOW):
        window = mix(window * _U(0xD6E8FEB86659FD93) + w.hash[j : n - WINDOW + 1 + j])
    at = np.flatnonzero(w.doc[: n - WINDOW + 1] == w.doc[WINDOW - 1 :])
    order = np.argsort(window[at], kind="stable")
    at, new = at[order], np.ones(len(at), bool)
    new[1:] = window[at[1:]] != window[at[:-1]]
    alone = new & np.append(new[1:], True)
    at, new = at[~alone], new[~alone]
    if not len(at):
        return lcp
    rank = np.zeros(n + 1, np.int64)  # of each candidate: where its group begins, from 1; of other words 0
    rank[at] = np.maximum.accumulate(np.where(new, np.arange(1, len(at) + 1), 0))
    levels, live, step = [rank], at, 1
    while len(live):
        rank = levels[-1]
        second = rank[np.minimum(live + step, n)]
        second = np.where(second > 0, second, -1 - live)  # a word that begins no repeat equals nothing
        order = np.lexsort([second, rank[live]])
        live, second, group = live[order], second[order], rank[live][order]
        begins, new = np.ones(len(live), bool), np.ones(len(live), bool)
        begins[1:] = group[1:] != group[:-1]
        new[1:] = begins[1:] | (second[1:] != second[:-1])
        index = np.arange(len(live))
        finer = group + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(begins, index, 0))
        rank = rank.copy()
        rank[live] = finer
        levels.append(rank)
        live = live[~(new & np.append(new[1:], True))]
        step *= 2
    order = at[np.argsort(rank[at], kind="stable")]
    a, b = order[:-1], order[1:]
    same = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = np.minimum(a + same, n), np.minimum(b + same, n)
        same += ((levels[k][i] > 0) & (levels[k][i] == levels[k][j])) * (1 << k)
    same = np.where(same > 0, same + WINDOW - 1, 0)
    np.maximum.at(lcp, a, same)
    np.maximum.at(lcp, b, same)
    return lcp


def figures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All columns of the result but ``doc_id`` for the texts of one run of bytes."""
    n_docs = len(offsets) - 1
    prefix = prefix_hash(data)
    w = words(data, offsets, prefix=prefix)
    n = np.diff(w.first)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc[flags], minlength=n_docs).astype(np.int64)

    lead = (data & 0xC0) != 0x80  # first bytes of code points
    points = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    word_chars = np.bincount(w.doc, points[w.end] - points[w.start], minlength=n_docs).astype(np.int64)

    breaks = np.flatnonzero(data == 10)
    line_start, line_end = np.sort(np.concatenate([breaks + 1, offsets[:-1]])), np.sort(np.concatenate([breaks, offsets[1:]]))
    holds = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
    line_start, line_end = line_start[holds], line_end[holds]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    _, first = np.unique(mix(span_hash(prefix, line_start, line_end) + mix(line_doc.astype(np.uint64) + _U(1))), return_index=True)
    dup_lines = np.bincount(line_doc, minlength=n_docs) - np.bincount(line_doc[first], minlength=n_docs)

    lcp = longest_prefixes(w)

    def covered(least: int) -> np.ndarray:
        start = np.flatnonzero(lcp >= least)
        step = np.zeros(len(lcp) + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + lcp[start], -1)
        return per_word(np.cumsum(step)[:-1] > 0)

    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, w.doc, lcp)
    long_covered, repeat = covered(MIN_REPEAT), covered(WINDOW)
    base_failed = (n < MIN_WORDS) | (100 * repeat > 50 * n)
    return {
        "n_words": n.astype(np.int64), "word_chars": word_chars, "n_symbols": per_text(_SYMBOL[data]), "n_dup_lines": dup_lines.astype(np.int64), "n_repeat_words": repeat,
        "covered_words": long_covered, "longest_repeat": longest, "base_failed": base_failed,
        "kept": ~base_failed & (long_covered <= MAX_COVERED * n) & (longest <= MAX_REPEAT),
    }


def _of_batch(column: pa.Array) -> dict[str, np.ndarray]:
    parts = [figures(data, offsets) for _, _, data, offsets in Texts(column).chunks()]
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}


def quality(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: its figures and whether it is kept. One pass, no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = _of_batch(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *map(pa.array, out.values())], ["doc_id", *out])

    names = ["doc_id", *FIGURES, "covered_words", "longest_repeat", "base_failed", "kept"]
    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA).select(*names)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_of_batch(b.column("text"))["kept"]))

    return docs.mapInArrow(work, docs.schema)
