"""Operators 2, 6 and 9: token counts by section, encoding and decoding, packing.

Each encodes whole texts in one pass over the documents, without a shuffle.
Vocabulary files are read by the Python workers from a path given as a
parameter, once each.

Cases, for all three: a null text counts as empty; an empty text has no tokens
of its own; texts are never cut, and a batch of results is sent on every few
megabytes; equal rows get equal results, one set each; an empty table gives an
empty result; a null ``doc_id`` stays null; other columns are not read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pairweave.llm.bpe import bpe, load_ranks

#: Results are handed over whenever about so many bytes have gathered.
HAND_OVER = 8 << 20


def _rows(batches: Iterator[pa.RecordBatch], work: Callable[[str], tuple[list[tuple], int]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """``work(text)`` gives rows (without ``doc_id``) and about how many bytes they take."""
    ready: list[list] = [[] for _ in names]
    held = 0
    for b in batches:
        for key, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            rows, size = work(text.as_py() or "")
            for row in rows:
                ready[0].append(key)
                for column, value in zip(ready[1:], row):
                    column.append(value)
            held += size
            if held >= HAND_OVER:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(ready, types)], names)
                ready, held = [[] for _ in names], 0
    if ready[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(ready, types)], names)


# --- operator 6 -------------------------------------------------------------


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, and the bytes that they decode to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(ranks_path, pattern)

        def one(text: str) -> tuple[list[tuple], int]:
            ids = coder.encode(text)
            decoded = coder.decode(ids)
            return [(len(ids) // 4, ids, decoded)], len(ids) + len(decoded) + 16

        yield from _rows(batches, one, ["doc_id", "n_tokens", "ids", "decoded"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids binary, decoded binary")


# --- operator 2 -------------------------------------------------------------


@functools.cache
def _library(ranks_path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The library's encoder, and the bytes in each token."""
    ranks = load_ranks(ranks_path)
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(text: str, ids: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens by ``rule``, crossing tokens touched, proportional share) of each section.

    bounds: where sections begin, in code points, and where the last ends. They
    tile the text. A token's span is the code points that its bytes touch. A
    token in one section counts there; one that crosses counts under "largest"
    where most of its code points are (the earliest of equals), under "first"
    and "last" where its span begins and ends.
    """
    m = len(bounds) - 1
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead)])
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    a, b = points[starts + 1] - 1, points[ends]
    low, high = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b - 1, "right") - 1
    inside = low == high
    count = np.bincount(low[inside], minlength=m)
    share, crossing = count.astype(float), np.zeros(m, np.int64)
    for i in np.flatnonzero(~inside):
        sections = np.arange(low[i], high[i] + 1)
        overlap = np.minimum(b[i], bounds[sections + 1]) - np.maximum(a[i], bounds[sections])
        share[sections] += overlap / (b[i] - a[i])
        crossing[sections[overlap > 0]] += 1
        count[{"largest": sections[np.argmax(overlap)], "first": low[i], "last": high[i]}[rule]] += 1
    return count, crossing, share


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "largest") -> DataFrame:
    """One row for each line of each text: its span in code points (with its line break), and its tokens.

    The text is encoded whole, so the counts of a text add up to its tokens. A
    text without lines (empty or null) has one section of no characters.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _library(ranks_path, pattern)

        def one(text: str) -> tuple[list[tuple], int]:
            lines = text.split("\n")
            sizes = [len(x) + 1 for x in lines[:-1]] + ([len(lines[-1])] if lines[-1] else [])
            if not sizes:
                return [(0, 0, 0, 0, 0, 0.0)], 48
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            count, crossing, share = attribute(text, encoder.encode_to_numpy(text), lengths, bounds, rule)
            return list(zip(range(len(sizes)), bounds[:-1].tolist(), bounds[1:].tolist(), count.tolist(), crossing.tolist(), share.tolist())), 48 * len(sizes)

        names = ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "token_share"]
        yield from _rows(batches, one, names, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long, token_share double")


# --- operator 9 -------------------------------------------------------------


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a JSON tokenizer, whose vocabulary is that of a rank file."""
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def binary_lengths(n: int, most: int) -> list[int]:
    """Powers of two, largest first, that add up to n; none over ``most``, itself a power of two."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if n % most >> k & 1]


def pack(docs: DataFrame, ranks_path: str, pattern: str, most: int = 1024, end_id: int = 0, special: dict[str, int] | None = None) -> DataFrame:
    """Each text's ids and ``end_id``, cut into pieces of binary length; each piece is a sequence of its own.

    So no sequence crosses documents and none is padded. ``sequence_id`` counts
    up within a bucket of equal lengths; its upper bits are the bucket, then the
    partition of the scan, so no count over all rows is needed, and a task that
    runs again numbers alike. ``special``: strings that are one id wherever
    they occur in a text, as the JSON tokenizer takes its added tokens.
    """
    special = special or {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _library(ranks_path, pattern)
        part = TaskContext.get().partitionId() << 33
        used = dict.fromkeys(range(most.bit_length()), 0)

        def ids_of(text: str, left: list[str]) -> list[np.ndarray]:
            if not left:
                return [encoder.encode_to_numpy(text)] if text else []
            out: list[np.ndarray] = []
            for k, x in enumerate(text.split(left[0])):
                out += [np.array([special[left[0]]], np.uint32)] * bool(k) + ids_of(x, left[1:])
            return out

        def one(text: str) -> tuple[list[tuple], int]:
            ids = np.concatenate([*ids_of(text, [s for s in special if s in text]), np.array([end_id], np.uint32)]).astype("<u4")
            rows, at = [], 0
            for length in binary_lengths(len(ids), most):
                bucket = length.bit_length() - 1
                rows.append((at, length, ids[at : at + length].tobytes(), len(ids), (bucket << 57) + part + used[bucket], 0))
                used[bucket] += 1
                at += length
            return rows, 4 * len(ids) + 48 * len(rows)

        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        yield from _rows(batches, one, names, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
