"""Operator 11, cross-tokenizer alignment by diagonal run skipping.

Both tokenizers read a space and the text: A is a byte-level vocabulary given
as ranks, B a sentence-piece model (which adds the space itself). Byte offsets
where tokens of both end cut the tokens into groups.

1.  Encoding. A boundary between a character that is no white space and a
    space with another such character behind it is a boundary of tokens on both
    sides: A's pattern starts anew there, and no piece of B has a space after
    anything else (checked when the model is read). So a text is a row of words,
    each with the space before it, whose tokens and groups don't depend on each
    other. A worker remembers what it has met, some HELD bytes of it.
2.  Alignment. The words of a text that are not known are encoded and aligned as
    one stretch. From a common end on, the ends of both sides are compared at
    the present index shift, in slices of 1, 2, 4, ... tokens while they agree,
    then in halves to the first that doesn't: a stretch of one-to-one groups is
    jumped over. An irregular group is resolved token by token, which changes the
    shift. Texts go through in blocks of words, so that memory is bounded by a
    block and the longest word.
3.  Counts. Each document hands on its distinct id pairs with their links.
    Summed over the corpus, they are rejoined with the documents: pairs that
    hold at least one of HEAVY links number at most HEAVY by that, and are
    broadcast; the rest of each document's pairs is shuffled.

Cases: null and empty texts, and those whose tokens don't give the text back on
both sides, have no tokens; special tokens' strings are plain text; texts are
encoded whole whatever their length; equal rows get equal results, one each; a
null ``doc_id`` stays null; an empty table gives an empty result; other columns
are not read. Ties: every link whose pair has the highest count of its B id is
a best one.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.llm.bpe import load_ranks
from pairweave.llm.common import stored

#: Bytes, about, that a worker keeps of the words that it has met, before it begins anew.
HELD = 128 << 20
#: Characters that are encoded and aligned at a time, about.
BLOCK = 1 << 18
#: Pairs with at least one of so many links are broadcast: so many at most.
HEAVY = 1 << 17
#: Results are handed over whenever about so many bytes have gathered.
HAND_OVER = 8 << 20

_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: White space of Python holds that of the pattern.
_WORD = re.compile(r" (?<=\S )(?=\S)")


@dataclass
class Side:
    """What is known of a vocabulary's ids: their bytes, and how many these are."""

    tokens: list[bytes]

    def __post_init__(self) -> None:
        self.size = len(self.tokens)
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        #: The ids in decimal digits, first digit in the lowest byte, and the bits that these take.
        self.digits = np.array([int.from_bytes(str(i).encode(), "little") for i in range(self.size)], np.uint64)
        self.bits = np.array([8 * len(str(i)) for i in range(self.size)], np.uint64)
        if self.size > 10**7:
            raise ValueError("an id and a sign after it must fit in eight bytes")


class Encoders:
    """Both tokenizers of one worker, and what they made of the words that they have met."""

    def __init__(self, ranks_path: str, pattern: str, model_path: str):
        ranks = load_ranks(ranks_path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.a = Side(tokens)
        self.encode_a = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of the model goes on beyond a space")
        self.b = Side([bytes([int(m[1], 16)]) if model.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.encode_b = model.encode
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  #: a word's number; -1: B doesn't give it back
        self.groups: list[bytes] = []  #: by number, the groups as written
        self.held = 0  #: bytes, about
        self.sizes = np.zeros((1 << 12, 4), np.int64)  #: tokens of A, of B, groups, links
        self.pairs = np.zeros(1 << 14, np.int64)  #: the linked pairs of all words
        self.before = np.zeros((1 << 12) + 1, np.int64)  #: links of the words before

    def learn(self, words: list[str]) -> None:
        """Encodes and aligns words that are not known, in one stretch of text."""
        text = " " + " ".join(words)
        ids = self.encode_b(words, num_threads=1)
        tokens = self.b.tokens
        if b"".join([tokens[i] for word in ids for i in word]) != text.encode():
            given = [b"".join([tokens[i] for i in x]) == (" " + w).encode() for x, w in zip(ids, words)]
            self.known |= {w: -1 for w, ok in zip(words, given) if not ok}
            words, ids = [w for w, ok in zip(words, given) if ok], [x for x, ok in zip(ids, given) if ok]
            if not words:
                return
            text = " " + " ".join(words)
        b = np.array([i for x in ids for i in x], np.int64)
        a = self.encode_a(text).astype(np.int64)
        ends_a, ends_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        to_b = np.cumsum([len(x) for x in ids])
        word_ends = ends_b[to_b - 1]
        to_a = np.searchsorted(ends_a, word_ends) + 1
        if (ends_a[to_a - 1] != word_ends).any():
            raise ValueError("a token of A goes on beyond a word")
        first_a, first_b, link_a, link_b = align(a, b, ends_a, ends_b)
        linked = np.argsort(link_a + link_b)  # each link is a step on either side or on both
        link_a, link_b = link_a[linked], link_b[linked]
        to_link = np.searchsorted(link_a, to_a)
        sizes = np.diff(np.stack([to_a, to_b, np.searchsorted(first_a, to_a), to_link], axis=1), axis=0, prepend=0)
        long_a, long_b = (np.cumsum(side.bits[x] // 8 + 1).astype(np.int64) for side, x in ((self.a, a), (self.b, b)))
        groups, cut = written(a, b, first_a, first_b, self.a, self.b), (long_a[to_a - 1] + long_b[to_b - 1]).tolist()
        n, links = len(self.groups), int(self.before[len(self.groups)])
        while len(self.sizes) < n + len(words):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.before = np.concatenate([self.before, np.zeros(len(self.before) - 1, np.int64)])
        while len(self.pairs) < links + len(link_a):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.sizes[n : n + len(words)] = sizes
        self.before[n + 1 : n + 1 + len(words)] = links + to_link
        self.pairs[links : links + len(link_a)] = a[link_a] * self.b.size + b[link_b]
        self.groups += [groups[i:j] for i, j in zip([0, *cut], cut)]
        self.known |= zip(words, range(n, n + len(words)))
        self.held += 2 * len(text) + 2 * len(groups) + 8 * len(link_a) + 256 * len(words)

    def numbers(self, words: list[str]) -> np.ndarray:
        if self.held > HELD:
            self.forget()
        known = self.known
        if new := [w for w in dict.fromkeys(words) if w not in known]:
            odd = [w for w in new if not w or w[0].isspace() or w[-1].isspace()]  # only at either end of a text
            for group in ([w for w in new if w not in odd] if odd else new), *([w] for w in odd):
                if group:
                    self.learn(group)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def blocks(self, text: str) -> Iterator[tuple[np.ndarray, bytes, np.ndarray] | None]:
        """(tokens of A, tokens of B, groups and links; the groups as written; the linked pairs) of each block; None where the tokens don't give the text back."""
        start = 0
        while start < len(text):
            cut = _WORD.search(text, start + BLOCK)
            numbers = self.numbers(_WORD.split(text[start : cut.start()] if cut else text[start:]))
            start = cut.end() if cut else len(text)
            if numbers.min() < 0:
                yield None
                return
            size = self.sizes[numbers]
            at = np.repeat(self.before[numbers] - np.cumsum(size[:, 3]) + size[:, 3], size[:, 3]) + np.arange(size[:, 3].sum())
            groups = self.groups
            yield size.sum(axis=0), b"".join([groups[i] for i in numbers.tolist()]), self.pairs[at]


@functools.cache
def encoders(ranks_path: str, pattern: str, model_path: str) -> Encoders:
    return Encoders(ranks_path, pattern, model_path)


def runs(ea: list[int], eb: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(stretches, irregular, links), each flat: where stretches of one-to-one groups begin on both sides and how long they are; where irregular groups begin; and the tokens that overlap in these.

    ea, eb: where the tokens of either side end, ascending, the last ones equal.
    """
    stretches: list[int] = []
    irregular: list[int] = []
    links: list[int] = []
    i = shift = 0
    n = len(ea)
    while i < n:
        j = i + shift
        x, y = ea[i], eb[j]
        if x == y:
            start, step = i, 1
            i += 1
            # Ends ascend to the same last one, so slices that are cut short at the end of both still tell.
            while i < n and ea[i : i + step] == eb[i + shift : i + shift + step]:
                i += step
                step += step
            while step > 1 and i < n:
                step >>= 1
                if ea[i : i + step] == eb[i + shift : i + shift + step]:
                    i += step
            i = min(i, n)
            stretches += (start, start + shift, i - start)
        else:
            irregular += (i, j)
            links += (i, j)
            while x != y:
                if x < y:
                    i += 1
                    x = ea[i]
                else:
                    j += 1
                    y = eb[j]
                links += (i, j)
            i += 1
            shift = j + 1 - i
    return stretches, irregular, links


def align(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first tokens of the groups on side A, on side B, the linked tokens of A, those of B)."""
    stretches, irregular, links = runs(ends_a.tolist(), ends_b.tolist())
    i, j, length = np.array(stretches, np.int64).reshape(-1, 3).T
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    one_a, one_b = np.repeat(i, length) + within, np.repeat(j, length) + within
    other, more = np.array(irregular, np.int64).reshape(-1, 2), np.array(links, np.int64).reshape(-1, 2)
    first_a, first_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    first_a[one_a] = first_b[one_b] = first_a[other[:, 0]] = first_b[other[:, 1]] = True
    return np.flatnonzero(first_a), np.flatnonzero(first_b), np.concatenate([one_a, more[:, 0]]), np.concatenate([one_b, more[:, 1]])


def written(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, side_a: Side, side_b: Side) -> bytes:
    """``a1,a2|b1;a3|b2,b3;`` for the groups that begin at the given tokens."""
    size_a, size_b = np.diff(first_a, append=len(a)), np.diff(first_b, append=len(b))
    # A group's tokens of A come after all of B in the groups before, and its tokens of B after its own of A.
    out = np.empty(len(a) + len(b), np.uint64)
    for ids, side, at, last, end in (
        (a, side_a, np.arange(len(a)) + np.repeat(first_b, size_a), first_a + size_a - 1, "|"),
        (b, side_b, np.arange(len(b)) + np.repeat(first_a + size_a, size_b), first_b + size_b - 1, ";"),
    ):
        sign = np.full(len(ids), ord(","), np.uint64)
        sign[last] = ord(end)
        out[at] = side.digits[ids] | sign << side.bits[ids]
    return out.astype("<u8").tobytes().translate(None, b"\0")


DOCUMENT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, ranks_path: str, pattern: str, model_path: str) -> DataFrame:
    """One row for each document: its tokens, groups, and distinct id pairs (A's id times the size of B, plus B's id) with the links of each. ``row`` tells rows apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoders(ranks_path, pattern, model_path)
        names = [x.split()[0] for x in DOCUMENT.split(", ")]
        types = [pa.int64()] * 6 + [pa.string()] + [pa.list_(pa.int64())] * 2
        ready: list[list] = [[] for _ in names]
        row, held = TaskContext.get().partitionId() << 33, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(ready, types)], names)

        def one(text: str) -> tuple:
            none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
            if not text:
                return none
            digest, before, sizes = hashlib.sha256(), b"", np.zeros(4, np.int64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for block in use.blocks(text):
                if block is None:
                    return none
                size, groups, pairs = block
                sizes += size
                digest.update(before + memoryview(groups)[:-1])
                before = groups[-1:]
                found.append(np.unique(pairs, return_counts=True))
                if len(found) > 16:
                    found = [summed(found)]
            return (*sizes.tolist(), digest.hexdigest(), *summed(found))

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                got = one(text.as_py() or "")
                for column, value in zip(ready, (row, key, *got)):
                    column.append(value)
                row += 1
                held += 16 * len(got[-1]) + 128
                if held >= HAND_OVER:
                    yield out()
                    ready, held = [[] for _ in names], 0
        if ready[0]:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, DOCUMENT)


def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(found) == 1:
        return found[0]
    pairs, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
    return pairs, np.bincount(at, np.concatenate([n for _, n in found]), len(pairs)).astype(np.int64)


def pair_counts(documents: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best) over the corpus: the links that hold the id pair, and whether no pair of its B id has more."""
    counts = documents.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    counts = counts.withColumn("b", F.col("pair") % size_b)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # no more rows than B has ids
    return counts.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def token_alignment(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    documents = stored(aligned(docs, ranks_path, pattern, model_path))
    size_b = sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()
    counts = stored(pair_counts(documents, size_b))
    total = counts.agg(F.sum("count")).first()[0] or 0
    much = F.col("count") * heavy >= total
    links = documents.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    told = links.join(F.broadcast(counts.filter(much)), "pair", "left")
    rest = told.filter("count IS NULL").select("row", "pair", "times").join(counts.filter(~much), "pair")
    sums = [F.sum(F.col("count") * F.col("times")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best")]
    parts = [x.groupBy("row").agg(*sums) for x in (told.filter("count IS NOT NULL"), rest)]
    of_row = parts[0].union(parts[1]).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = documents.drop("pairs", "times").join(of_row, "row", "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
