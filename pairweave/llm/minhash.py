"""Operator 8, near-duplicates: a multi-index Hamming join of MinHash signatures.

A signature has POSITIONS symbols of b = 16 bits. It is cut into CHUNKS; two
signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 positions differ in
at most ERRORS positions of some chunk, by the pigeonhole principle. For each
chunk all choices of ERRORS wrong positions are enumerated and the symbols of
the others are a key, so every such pair shares a key. At a similarity of 0.75
all of a pair's chunks have more errors with probability 1.2e-5; above, less.

A bucket (the documents of one key) never gives all its pairs as rows:

1.  each member is linked with the bucket's first member, its hub, only; these
    links are confirmed on the whole shingle sets; components are built from them;
2.  where a bucket still holds several components, its members are linked with
    the member that agrees best with the bucket's most frequent symbols (a text
    that the others were made from, where there is one), as in step 1;
3.  where it holds several components even then, tasks compare signatures, and
    sketches of SKETCH symbols, across components, buckets of over BLOCK members
    block by block, and give the pairs that are near enough. A pair comes from the
    first bucket it shares. These are confirmed on the whole sets as well, hub by
    hub, so that a set travels once for each hub and not once for each pair.

So every pair within the distance bound is confirmed or refuted on its sets, or
joined through other links already, but for those that the sketches of step 3 rule
out: one in 100,000 of the pairs at a similarity of 0.75, fewer above. Documents of equal shingle sets are one node
throughout.

Cases: a null or empty text, or one without words, has no shingles and is in no
group; a text of one to four words has one shingle, all its words; texts are
worked on whole; a row with a null ``doc_id`` can't name a group and is left
alone (component null, kept); rows that repeat a ``doc_id`` and text get equal
results; rows of one ``doc_id`` and several texts are judged by their texts; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pairweave.llm.common import Texts, stored
from pairweave.llm.words import mix, shingles, words

K = 5
CHUNKS, CHUNK, ERRORS = 5, 5, 2
POSITIONS = CHUNKS * CHUNK
BOUND = CHUNKS * (ERRORS + 1) - 1
#: Pairs that agree in fewer positions are not worth a look at their sets: at a similarity of 0.75 one in 100,000.
LEAST_EQUAL = 9
#: A sketch has 8 bits of each of SKETCH more hash functions; at a similarity of 0.75 fewer than LEAST_SKETCH agree in one of 100,000 pairs.
SKETCH, LEAST_SKETCH = 1024, 708
#: Members of a bucket, and about how many shingles of a hub's partners, that one task holds at a time (twice these, where blocks meet).
BLOCK, BLOCK_SHINGLES = 4096, 50_000
#: Up to so many documents, those to be read again are sent to the scan; beyond, the texts are shuffled.
MOST_SENT = 200_000

_U = np.uint64
_random = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (2, POSITIONS + SKETCH), dtype=np.uint64) * _U(2) + _U(1)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in Texts(column).chunks():
        s, before = shingles(words(data, offsets, lower=True), K)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            yield np.unique(s[a:b])


def _least(values: np.ndarray, first: int, end: int) -> np.ndarray:
    """The least value under each of the hash functions first to end, spread over all bits."""
    out = np.empty(end - first, np.uint64)
    for a in range(first, end, 16):
        part = _random[:, a : min(a + 16, end), None]
        out[a - first : a - first + 16] = ((values ^ part[0]) * part[1]).min(axis=1)
    return mix(out)


def signature(values: np.ndarray) -> np.ndarray:
    return (_least(values, 0, POSITIONS) >> _U(48)).astype(np.uint16)


def sketch(values: np.ndarray) -> np.ndarray:
    return (_least(values, POSITIONS, POSITIONS + SKETCH) >> _U(56)).astype(np.uint8)


def signatures(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, digest, sig) for each row; ``row`` is unique."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            n, digest, sig = [], [], []
            for s in _sets(b.column("text")):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s).tobytes() if len(s) else None)
            rows = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([rows, b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["row", "doc_id", "n_shingles", "digest", "sig"])

    return docs.select("doc_id", "text").mapInArrow(work, "row long, doc_id long, n_shingles long, digest binary, sig binary")


#: (chunk, the positions that must agree) of each key.
CHOICES = [tuple(c * CHUNK + p for p in keep) for c in range(CHUNKS) for keep in itertools.combinations(range(CHUNK), CHUNK - ERRORS)]


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS).astype(np.uint64)


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """(key, node) for each node and choice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                s = _symbols(b.column("sig"))
                keys = np.empty((len(CHOICES), len(s)), np.uint64)
                for k, choice in enumerate(CHOICES):
                    packed = np.full(len(s), k + 1, np.uint64)
                    for p in choice:
                        packed = packed << _U(16) | s[:, p]
                    keys[k] = mix(packed) & ~_U(63) | _U(k)  # the choice can be read from the key
                node = np.tile(b.column("node").to_numpy(), len(CHOICES))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(work, "key long, node long")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b, hub, n), hub being a, whose sizes allow the similarity and whose signatures agree in LEAST_EQUAL positions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                equal = (_symbols(b.column("sig_a")) == _symbols(b.column("sig_b"))).sum(axis=1)
                near = pa.array(equal >= LEAST_EQUAL)
                yield pa.RecordBatch.from_arrays([b.column(c).filter(near) for c in ("a", "b", "a", "n_b")], ["a", "b", "hub", "n"])

    both = (
        pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a")), "a")
        .join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b")), "b")
        .filter("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
    )
    return both.select("a", "b", "n_b", "sig_a", "sig_b").mapInArrow(work, "a long, b long, hub long, n long")


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles, sketch) of the wanted (node, doc_id, digest), from their whole texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                found = [(n, s) for n, d, s in zip(b.column("node").to_pylist(), b.column("digest").to_pylist(), _sets(b.column("text"))) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64())), pa.array([sketch(s).tobytes() for _, s in found], pa.binary())], ["node", "shingles", "sketch"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = wanted.count() <= MOST_SENT
    joined = texts.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "doc_id")
    return joined.select("node", "digest", "text").mapInArrow(work, "node long, shingles array<long>, sketch binary")


def _blocks(node: str, count: Column) -> Column:
    return F.pmod(F.xxhash64(node), count).cast("int")


def _dealt(rows: DataFrame, count: Column, node: str = "node") -> DataFrame:
    """``rows`` once for each pair of blocks (p, q), p <= q, that their own block ``own`` is in."""
    rows = rows.withColumn("own", _blocks(node, count)).withColumn("other", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    return rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("other")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (a, b, hub, n: shingles of b) whose sets have a similarity of 0.75 or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            shingle = batch.column("shingles")
            for i, (key, a, b) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in ("hub", "p", "q"))), batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                if key != now:
                    now, held = key, {}
                if b is None:
                    held[a] = shingle[i].values.to_numpy(zero_copy_only=False)
                    continue
                x, y = held[a], held[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], ["a", "b"])

    # A group (hub, p, q) holds the sets of two blocks of the hub's partners, and a star's groups one block each and the hub.
    many = F.sum("n") / BLOCK_SHINGLES
    count = pairs.groupBy("hub").agg(F.ceil(F.when(F.bool_and(F.col("a") == F.col("hub")), many).otherwise(F.sqrt(2 * many))).alias("count"))
    own = pairs.join(count, "hub").withColumn("x", _blocks("a", F.col("count"))).withColumn("y", _blocks("b", F.col("count")))
    own = stored(own.select("hub", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "a", "b"))
    group = ["hub", "p", "q"]
    ends = own.select(*group, F.col("a").alias("node")).union(own.select(*group, F.col("b").alias("node"))).distinct()
    held = ends.join(sets.select("node", "shingles"), "node").select(*group, F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    both = held.union(own.withColumn("shingles", F.lit(None).cast("array<long>"))).repartition(*group).sortWithinPartitions(*group, F.col("b").asc_nulls_first())
    return both.mapInArrow(work, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node that it is connected with.

    Large-star and small-star steps in turn until nothing changes; every round
    is written to the shared folder, so that lineage stays short.
    """

    def neighbours(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def large_star(e: DataFrame) -> DataFrame:
        n = neighbours(e)
        low = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return n.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        n = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = n.groupBy("u").agg(F.min("v").alias("m"))
        to = n.join(low, "u")
        return to.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.filter("a <> b").distinct())
    seen = state(now)
    while True:
        now = stored(small_star(large_star(now)))
        if (after := state(now)) == seen:
            break
        seen = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: For the positions of a chunk that agree, as bits: which of its choices is the first; past the last if none.
PER_CHUNK = len(CHOICES) // CHUNKS
_FIRST = np.array([next((i for i, keep in enumerate(CHOICES[:PER_CHUNK]) if all(bits >> p & 1 for p in keep)), PER_CHUNK) for bits in range(1 << CHUNK)])


def first_choice(equal: np.ndarray) -> np.ndarray:
    """The first choice whose positions all agree, of rows of POSITIONS flags."""
    bits = (equal.reshape(-1, CHUNKS, CHUNK) << np.arange(CHUNK)).sum(axis=2)
    first = _FIRST[bits]
    chunk = (first < PER_CHUNK).argmax(axis=1)
    return np.where((first < PER_CHUNK).any(axis=1), chunk * PER_CHUNK + first[np.arange(len(first)), chunk], len(CHOICES))


def near_in_bucket(choice: int, sig: np.ndarray, sketches: np.ndarray, size: np.ndarray, root: np.ndarray, own: np.ndarray, across: bool, hub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of members of different roots that are near enough and meet in this bucket first; ``across``: of different blocks only. Pairs with the hub have been looked at."""
    out = []
    for i in range(len(sig) - 1):
        j = np.arange(i + 1, len(sig))
        j = j[(root[j] != root[i]) & ~hub[j] & (100 * np.minimum(size[j], size[i]) >= 75 * np.maximum(size[j], size[i]))] if not hub[i] else j[:0]
        if across:
            j = j[own[j] != own[i]]
        if len(j):
            equal = sig[j] == sig[i]
            near = equal.sum(axis=1) >= LEAST_EQUAL
            j = j[near][first_choice(equal[near].astype(np.int64)) == choice]
            j = j[(sketches[j] == sketches[i]).sum(axis=1) >= LEAST_SKETCH]
            out.append(np.stack([np.full(len(j), i), j]))
    both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, names: list[str], arrays: list[tuple[str, type, int]]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The groups of rows sorted by their first ``keys`` columns: integer columns, one line each, and columns of fixed-width symbols."""
    held, extra = np.zeros((len(names), 0), np.int64), [np.zeros((0, width), kind) for _, kind, width in arrays]

    def cut(x: np.ndarray, more: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        if x.shape[1]:
            at = np.flatnonzero((x[:keys, 1:] != x[:keys, :-1]).any(axis=0)) + 1
            for i, j in zip([0, *at], [*at, x.shape[1]]):
                yield x[:, i:j], [m[i:j] for m in more]

    for batch in batches:
        if not batch.num_rows:
            continue
        held = np.concatenate([held, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])], axis=1)
        extra = [np.concatenate([m, np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(-1, width)]) for m, (c, kind, width) in zip(extra, arrays)]
        other = np.flatnonzero((held[:keys] != held[:keys, -1:]).any(axis=0))
        done = int(other[-1]) + 1 if len(other) else 0
        yield from cut(held[:, :done], [m[:done] for m in extra])
        held, extra = held[:, done:], [m[done:] for m in extra]
    yield from cut(held, extra)


def _mixed(rows: DataFrame) -> DataFrame:
    """``rows`` (key, node, hub, root) of buckets of several roots, with the bucket's ``size``."""
    per_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(per_root.groupBy("key").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("roots")).filter("roots > 1 and size > 2").select("key", "size"), "key")


def _central(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): each member of a mixed bucket with the member that agrees best with the most frequent symbols, where their roots differ. Large buckets are judged block by block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for x, (sig,) in _grouped(batches, 2, ["key", "own", "node"], [("sig", np.uint16, POSITIONS)]):
            score = np.zeros(len(sig), np.int64)
            for p in range(POSITIONS):
                _, which, count = np.unique(sig[:, p], return_inverse=True, return_counts=True)
                score += which == count.argmax()
            best = int(score.argmax())
            out.append((int(x[0, 0]), int(x[2, best]), int(score[best])))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "node", "score"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "node", "score"])

    own = rows.select("key", "node", _blocks("node", F.ceil(F.col("size") / BLOCK)).alias("own")).join(nodes.select("node", "sig"), "node")
    scored = own.repartition("key", "own").sortWithinPartitions("key", "own").mapInArrow(work, "key long, node long, score long")
    best = scored.groupBy("key").agg(F.max(F.struct("score", "node")).alias("x")).select("key", F.col("x.node").alias("centre"))
    roots = rows.select(F.col("node").alias("centre"), F.col("root").alias("centre_root")).distinct()
    return rows.join(best.join(roots, "centre"), "key").filter("root <> centre_root").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()


def _across(rows: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, hub, n): near pairs of different roots that share a bucket; ``rows``: (key, node, hub, root, size)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "p", "q", "node", "hub", "root", "own", "n_shingles"]
        for x, (sig, sketches) in _grouped(batches, 3, names, [("sig", np.uint16, POSITIONS), ("sketch", np.uint8, SKETCH)]):
            a, b = near_in_bucket(int(x[0, 0]) & 63, sig, sketches, x[7], x[5], x[6], x[1, 0] != x[2, 0], x[3] == x[4])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x[3, a], x[3, b], x[4, a], x[7, b])], ["a", "b", "hub", "n"])

    members = rows.join(nodes.select("node", "n_shingles", "sig"), "node").join(sets.select("node", "sketch"), "node")
    dealt = _dealt(members, F.ceil(F.col("size") / BLOCK))
    return dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(work, "a long, b long, hub long, n long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, digest, component_id, kept) for each row of ``docs``."""
    rows = stored(signatures(docs))
    named = rows.filter("n_shingles > 0 and doc_id is not null")
    nodes = stored(
        named.groupBy("digest").agg(F.min(F.struct("doc_id", "row", "n_shingles", "sig")).alias("x"))
        .select("digest", F.col("x.doc_id").alias("doc_id"), F.col("x.row").alias("node"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.sig").alias("sig"))
    )
    keys = bucket_keys(nodes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1").select("key", "hub")
    members = stored(keys.join(shared, "key"))
    near = nodes.join(members.select("node").distinct(), "node").select("node", "doc_id", "digest")
    sets = stored(_whole_sets(docs, near))
    edges = stored(_confirmed(stored(_alike(members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), nodes)), sets))
    joined = components(edges)

    def mixed() -> DataFrame:
        rooted = members.join(joined, "node", "left").select("key", "node", "hub", F.coalesce("root", "node").alias("root"))
        return stored(_mixed(rooted))

    for find in (lambda rows: _alike(_central(rows, nodes), nodes), lambda rows: _across(rows, nodes, sets)):
        more = stored(_confirmed(stored(find(mixed())), sets))
        if not more.isEmpty():
            joined = components(joined.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    known = nodes.select("node", F.col("doc_id").alias("first_id"), "digest").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("first_id").alias("least_id"))
    by_digest = known.join(least, "root").select("digest", "least_id")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = rows.join(by_digest, "digest", "left").withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")))
    return out.select("row", "doc_id", "n_shingles", "digest", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that a smaller ``doc_id`` of their group stands for; of rows of a kept ``doc_id`` with equal shingle sets, one stays."""
    found = stored(near_duplicates(docs).filter("doc_id is not null").select("doc_id", "digest", "kept"))
    ids = stored(found.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or("kept").alias("any"), F.count(F.lit(1)).alias("n")))
    gone = ids.filter("not any").select("_id")
    left = docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
    several = ids.filter("any and n > 1").select("_id")
    if several.isEmpty():
        return left

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in _sets(b.column("row").field("text"))]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(digest, pa.binary())], ["row", "id", "digest"])

    # Ids of several rows are judged row by row.
    again = left.join(several, left["doc_id"] == several["_id"], "left_semi").select(F.struct(*[left[c] for c in docs.columns]).alias("row"), left["doc_id"].cast("long").alias("id"))
    schema = StructType([*again.schema.fields, StructField("digest", BinaryType())])
    kept = found.filter("kept").select(F.col("doc_id").alias("id"), "digest").distinct()
    again = again.mapInArrow(work, schema).join(kept, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
    return left.join(several, left["doc_id"] == several["_id"], "left_anti").unionByName(again)
