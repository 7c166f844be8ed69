"""Operator 7, chat formatting with a grammar round trip.

Grammar of the output, one segment for each turn::

    conversation := turn*
    turn         := "### " role ": " body " </turn>" newline

``###`` and ``</turn>`` are control strings. One that follows an odd number of
backslashes, 2n + 1, stands for n backslashes and the string itself. Each turn
is rendered as it is and reparsed; if what comes back differs from the source,
its control strings are escaped, until both are identical.

Turns are formatted one by one, so a conversation of any length needs no more
memory than its longest turn; reading back streams over the sorted turns.

Cases: null roles and texts are empty; turns are in the order of ``turn``
(nulls first), those of equal ``turn`` in the order of their segments, repeated
rows one after the other; a null ``conv_id`` is a conversation of its own; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

OPEN, CLOSE = "###", "</turn>"
CONTROL = re.compile(rf"(\\*)({OPEN}|{CLOSE})")
ROLE = {"\\": "\\\\", ":": "\\c", "\n": "\\n"}
#: Text of this role is under the loss mask.
LEARNED = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def _role_out(role: str) -> str:
    return "".join(ROLE.get(c, c) for c in role)


def _role_in(role: str) -> str:
    return re.sub(r"\\[\\cn]", lambda m: next(k for k, v in ROLE.items() if v == m[0]), role)


def render(role: str, body: str) -> tuple[str, int]:
    """(segment, where the body begins)."""
    head = f"{OPEN} {_role_out(role)}: "
    return f"{head}{body} {CLOSE}\n", len(head)


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The turns of a formatted text, or None if the grammar doesn't give it."""
    turns, at = [], 0
    while at < len(formatted):
        colon = formatted.find(": ", at)
        if not formatted.startswith(f"{OPEN} ", at) or colon < 0:
            return None
        body = colon + 2
        for m in CONTROL.finditer(formatted, body):
            if len(m[1]) % 2 == 0:
                break
        else:
            return None
        if m[0] != CLOSE or m.start() <= body - 1 or formatted[m.start() - 1] != " " or formatted[m.end() : m.end() + 1] != "\n" or m.start() - 1 < body:
            return None
        turns.append((_role_in(formatted[at + len(OPEN) + 1 : colon]), unescape(formatted[body : m.start() - 1])))
        at = m.end() + 1
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(segment, begin and end of the text in it): the least escaped rendering that parses to the turn alone."""
    body = text
    for _ in range(2):
        segment, start = render(role, body)
        if parse(segment) == [(role, text)]:
            return segment, start, start + len(body)
        body = escape(text)
    raise ValueError("a turn doesn't survive the round trip")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end) for each row: the formatted turn, and the code points of it under the loss mask (null: none)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(s, *((x, y) if (role or "") == LEARNED else (None, None))) for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist()) for s, x, y in [format_turn(role or "", text or "")]]
            segment, start, end = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("conv_id").cast(pa.int64()), b.column("turn").cast(pa.int64()), pa.array(segment, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["conv_id", "turn", "segment", "loss_start", "loss_end"])

    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(work, "conv_id long, turn long, segment string, loss_start long, loss_end long")


def read_back(segments: DataFrame) -> DataFrame:
    """One row for each conversation: its turns and its text under the loss mask, parsed from the formatted segments in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, open_, rows = None, False, []

        def close():
            rows.append((now, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names)

        for b in batches:
            for conv, segment, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))):
                if not open_ or conv != now:
                    if open_:
                        close()
                    now, open_, n_turns, loss_chars, chars, turns, loss = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in parse(segment):
                    n_turns += 1
                    turns.update(f"{role}\n{text}\n".encode())
                if start is not None:
                    text = unescape(segment[start:end])
                    loss_chars += len(text)
                    loss.update(text.encode())
                chars += len(segment)
            if rows:
                yield batch()
                rows.clear()
        if open_:
            close()
            yield batch()

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
