"""Operator 13, repair of conversations' structure over a suffix-shared automaton.

A row's first fault counts: blank, a duplicate of an earlier row (role and
text), or truncated (without a closing ``.``, ``!`` or ``?``). Edits: Keep (0),
Rerole to user or assistant (2), Delete (3; blank and duplicate rows must go),
Insert an empty user or assistant turn (2); a truncated row that stays costs 1.
The cheapest edits are sought that give roles ``(s?(ua)+)?`` by initials, of
equal cost the least in ASCII.

1.  A conversation becomes its signature, one sign for each row: ``x`` for rows
    that must go, else ``s``, ``u``, ``a`` or ``o`` for the role's initial, in
    upper case where truncated. Whether a row repeats an earlier one comes from
    an aggregation (first turn of each role and text), not from a set in memory.
2.  The distinct signatures are dealt by range of their reversals and sorted, so
    that those with common ends stand together. A stack holds the automaton's
    nodes from the end to the present signature: a node is a suffix, made once
    for all signatures that share it. For each grammar state (nothing yet, after
    s, u or a) it holds the cost to go, and the best audit as its first edit and
    the state behind it. The four costs less their minimum take few values, so a
    step from node to node is remembered by (sign, costs).
3.  Audits go back to the conversations of their signature, and are applied to
    their rows, which stream by in order.

Cases: nulls are read as one space (role, text, and in the key that the damage
depends on); rows are in the order of ``turn`` (nulls first), those of one turn
by role and then by MD5 of the text, repeated rows one after the other; a null
``conv_id`` is a conversation of its own; a conversation without rows has an
empty audit; texts are taken whole; an empty table gives an empty result; other
columns are not read. A conversation of any length streams; what is held of it
are its signature and audit, a byte or so for each row.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.llm.common import stored

DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: Grammar states: nothing yet, after s, after u, after a. What an inserted or re-roled turn must be, and the state after it.
NEEDED, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: The state after a turn of that initial is kept.
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: At the end of a conversation: cost to go. States without cost are accepted.
END = (0, 2 * COST[INSERT], COST[INSERT], 0)
LEGAL = ("su", "ua", "au")
#: Results are handed over whenever about so many bytes have gathered.
HAND_OVER = 8 << 20


# --- damage -----------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): what the contract's damage makes of each row, and how often it stands there."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


# --- 1. signatures ----------------------------------------------------------


def facts(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, mark, times, blank, truncated, again) of each row: ``mark`` stands for the text, ``again``: role and text stand in an earlier turn."""
    body = F.rtrim(F.regexp_replace("text", r"[\x09-\x0D]", " "))
    own = rows.select("conv_id", "turn", "role", F.md5("text").alias("mark"), "times", (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"))
    first = own.filter("times > 0").groupBy("conv_id", "role", "mark").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "role", "mark")]
    later = F.struct(F.col("o.turn").isNotNull().alias("known"), F.col("o.turn").alias("turn")) > F.col("f.first")
    return own.alias("o").join(first.alias("f"), same, "left").select("o.*", F.coalesce(later, F.lit(False)).alias("again"))


SUMMARY = "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


def summaries(rows: DataFrame) -> DataFrame:
    """One row for each conversation: its signature and its faults."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SUMMARY.split(", ")]
        types = [pa.int64(), pa.string()] + [pa.int64()] * 5
        ready: list[list] = [[] for _ in names]
        now, held = None, 0
        signature, last, faults, initial, turns = bytearray(), None, [0, 0, 0, 0], "", [None, None, 0]

        def close() -> int:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            for column, value in zip(ready, (now[0], signature.decode(), gaps, *faults)):
                column.append(value)
            return len(signature) + 64

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(ready, types)], names)

        for b in batches:
            for conv, turn, role, mark, times, blank, truncated, again in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "mark", "times", "blank", "truncated", "again"))):
                if now != (conv,):
                    if now:
                        held += close()
                        if held >= HAND_OVER:
                            yield out()
                            ready, held = [[] for _ in names], 0
                    now, signature, last, faults, initial, turns = (conv,), bytearray(), None, [0, 0, 0, 0], "", [None, None, 0]
                for _ in range(times):
                    # Equal rows of one turn stand side by side.
                    twice, last = again or last == (turn, role, mark), (turn, role, mark)
                    sign = role[:1] if role[:1] and role[:1] in "sua" else "o"
                    if blank or twice:
                        faults[0 if blank else 1] += 1
                        sign = "x"
                    elif truncated:
                        faults[2] += 1
                        sign = sign.upper()
                    if signature and initial + role[:1] not in LEGAL:
                        faults[3] += 1
                    signature += sign.encode()
                    initial = role[:1]
                    if turn is not None and turn != turns[1]:
                        turns = [turn if turns[2] == 0 else turns[0], turn, turns[2] + 1]
        if now:
            close()
            yield out()

    ordered = facts(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "mark")
    return ordered.mapInArrow(work, SUMMARY)


# --- 2. the automaton -------------------------------------------------------


@functools.cache
def step(sign: str, costs: tuple[int, ...]) -> tuple[int, tuple[int, ...], str, tuple[int, ...]]:
    """The node before ``sign``, from the costs behind it: (what its costs have in common, the rest of each, the first edit in each state, the state behind that)."""
    best = []
    for q in range(4):
        options = [(COST[DELETE] + costs[q], DELETE, q)]
        if sign != "x":
            stays = int(sign.isupper())
            options.append((COST[REROLE] + stays + costs[AFTER[q]], REROLE, AFTER[q]))
            if (to := KEPT.get((sign.lower(), q))) is not None:
                options.append((COST[KEEP] + stays + costs[to], KEEP, to))
        best.append(min(options))
    plain = list(best)
    for q in (2, 3):  # two insertions from there lead back
        best[q] = min(plain[q], (COST[INSERT] + plain[AFTER[q]][0], INSERT, AFTER[q]))
    for q in (0, 1):
        best[q] = min(plain[q], (COST[INSERT] + best[AFTER[q]][0], INSERT, AFTER[q]))
    least = min(c for c, _, _ in best)
    return least, tuple(c - least for c, _, _ in best), "".join(e for _, e, _ in best), tuple(q for _, _, q in best)


class Suffixes:
    """The nodes from the end of a conversation to the suffix of the last signature given."""

    def __init__(self) -> None:
        self.nodes: list[tuple[str, tuple[int, ...], str, tuple[int, ...]]] = [("", END, "", AFTER)]
        self.base = [0]
        self.made = 0

    def audit(self, signature: str) -> tuple[int, str]:
        """(cost, audit) from the start of the grammar. Signatures that follow each other share the nodes of their common end."""
        backwards = signature[::-1]
        shared = 0
        while shared < min(len(backwards), len(self.nodes) - 1) and self.nodes[shared + 1][0] == backwards[shared]:
            shared += 1
        del self.nodes[shared + 1 :], self.base[shared + 1 :]
        for sign in backwards[shared:]:
            more, costs, edits, to = step(sign, self.nodes[-1][1])
            self.nodes.append((sign, costs, edits, to))
            self.base.append(self.base[-1] + more)
            self.made += 1
        depth, state, out = len(backwards), 0, []
        while depth or END[state]:
            _, _, edits, to = self.nodes[depth]
            edit = edits[state] if depth else INSERT
            out.append(edit)
            state = to[state]
            depth -= edit != INSERT
        return self.base[-1] + self.nodes[-1][1][0], "".join(out)


def audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = Suffixes()
        for b in batches:
            given = b.column("signature").to_pylist()
            found = [suffixes.audit(s) for s in given]
            yield pa.RecordBatch.from_arrays([b.column("signature").cast(pa.string()), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])

    ends = signatures.select("signature").distinct().withColumn("ends", F.reverse("signature"))
    return ends.repartitionByRange("ends").sortWithinPartitions("ends").select("signature").mapInArrow(work, "signature string, cost long, audit string")


def audited(rows: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, and the cost and audit of its repair. ``rows``: (conv_id, turn, role, text, times), ``times`` 0 for a row that isn't there."""
    summary = stored(summaries(rows))
    return summary.join(audits(summary), "signature").drop("signature")


# --- 3. repair --------------------------------------------------------------


def applied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns after the edits of ``plan`` (conv_id, audit). Conversations are whole and in order within partitions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["conv_id", "position", "edit", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        ready: list[list] = [[] for _ in names]
        now, audit, at, state, position, held = None, "", 0, 0, 0, 0

        def put(edit: str, role: str, text: str) -> None:
            nonlocal position, held
            for column, value in zip(ready, (now, position, edit, role, text)):
                column.append(value)
            position += 1
            held += len(text) + 64

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == INSERT:
                put(INSERT, NEEDED[state], "")
                at, state = at + 1, AFTER[state]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(ready, types)], names)

        for b in batches:
            for conv, given, role, text, times in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "times"))):
                if given is not None:  # a conversation begins
                    inserted()
                    now, audit, at, state, position = conv, given, 0, 0, 0
                for _ in range(times):
                    inserted()
                    edit = audit[at]
                    at += 1
                    if edit == KEEP:
                        state = KEPT[role[:1], state]
                        put(KEEP, role, text)
                    elif edit == REROLE:
                        role, state = NEEDED[state], AFTER[state]
                        put(REROLE, role, text)
                if held >= HAND_OVER:
                    yield out()
                    ready, held = [[] for _ in names], 0
        inserted()
        if ready[0]:
            yield out()

    none = F.lit(None).cast("string")
    turns = rows.select("conv_id", none.alias("audit"), "turn", "role", "text", "times", F.md5("text").alias("mark"))
    heads = plan.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), F.lit(0).alias("times"), none.alias("mark"))
    order = ["conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "mark"]
    return heads.union(turns).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(work, "conv_id long, position long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` joined by newlines; ``turns`` as ``applied`` gives them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, hashlib.sha256()
        for b in batches:
            convs: list = []
            hashes: list[str] = []
            for conv, position, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if now:
                        convs.append(now[0])
                        hashes.append(sha.hexdigest())
                    now, sha = (conv,), hashlib.sha256()
                sha.update(f"{'' if position == 0 else chr(10)}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return turns.mapInArrow(work, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with faults, cost and audit; their turns after the repair) of rows (conv_id, turn, role, text, times)."""
    plan = stored(audited(rows))
    return plan, applied(rows, plan)
