"""Byte-level BPE from a rank file: splitting, exact encoding, decoding.

A piece (one match of the splitting pattern) is encoded from longest matches.
Its bytes, read as Latin-1, run through an Aho-Corasick automaton of all
tokens, which gives the tokens that begin at each byte. From the left, the
longest is taken that is compatible with the token before it; at a dead end
the last token is given up for its next shorter one, and the place is marked
as one that leads nowhere, so each place is given up once at most. Two tokens
are compatible if merging their joined bytes gives back just these two. A
sequence whose neighbours are all compatible is what the merges would give.
Compatibility is memoised for each pair of tokens, and encodings of pieces too.

Where a pattern's pieces hold white space at their beginning only (one space)
or are white space, a text is first cut before each space and at white space
by a plain pattern. Such a chunk holds whole pieces, so its ids are memoised
too, and the dearer pattern is asked for new chunks only.
"""

from __future__ import annotations

import base64
import functools
import re

import ahocorasick
import numpy as np
import regex

#: Bounds of the memos, in entries; a full memo starts anew.
MOST_PIECES, MOST_PAIRS, LONGEST_KEPT = 400_000, 1_000_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def splitter(pattern: str) -> re.Pattern:
    """``pattern`` for the standard library's faster ``re``: the classes that it lacks (\\p{L}, \\p{N}) and Unicode white space spelled out as ranges."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def ranges(kind: str) -> str:
        return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for m in regex.finditer(kind + "+", everything) for run in _runs(m[0]))

    space = "".join(f"\\U{ord(c):08x}" for c in "\t\n\v\f\r \x85\xa0                　")
    classes = {r"\p{L}": ranges(r"\p{L}"), r"\p{N}": ranges(r"\p{N}"), r"\s": space}
    inside = re.sub(r"\[[^\]]*\]", lambda m: _spelled(m[0], classes), pattern)
    for short, long in classes.items():
        inside = inside.replace(short, f"[{long}]")
    return re.compile(inside.replace(r"\S", f"[^{space}]"))


#: Alternatives that can't go past white space, but for one space before; and what must follow them.
BOUND, SPACES = re.compile(r"'\w+| \?(?:\\p\{\w+\}|\[\^\\s[^\]|]*\])\+"), r"\s+(?!\S)|\s+"


def chunker(pattern: str) -> re.Pattern | None:
    """A plain pattern whose matches hold whole matches of ``pattern``, or None where that isn't sure."""
    head, _, tail = pattern.partition(r"|\s")
    if r"\s" + tail != SPACES or not all(map(BOUND.fullmatch, head.split("|"))):
        return None
    return splitter(r" ?\S+|" + SPACES)


def _spelled(members: str, classes: dict[str, str]) -> str:
    for short, long in classes.items():
        members = members.replace(short, long)
    return members


def _runs(s: str) -> list[str]:
    """``s`` cut where neighbouring code points don't follow each other."""
    cuts = [0, *(i for i in range(1, len(s)) if ord(s[i]) != ord(s[i - 1]) + 1), len(s)]
    return [s[a:b] for a, b in zip(cuts, cuts[1:])]


class Bpe:
    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.split = splitter(pattern).findall
        chunks = chunker(pattern)
        self.chunks = chunks.findall if chunks else None
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.less = [len(t) - 1 for t in self.token]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.packed: dict[str, bytes] = {}
        self.chunk_ids: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges in order of rank, one by one: quadratic, for the short strings that compatibility asks about."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 40:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return known

    def reachable(self, a: int) -> bool:
        """Whether merging a token's bytes gives that token."""
        if (known := self.whole.get(a)) is None:
            known = self.whole[a] = self.merged(self.token[a]) == [a]
        return known

    def greedy(self, longest: list[int]) -> tuple[list[int], int]:
        """The longest match at every place as long as neighbours are compatible, and where that ends."""
        pairs, less, n = self.pairs, self.less, len(longest)
        last = longest[0]
        if last < 0 or not self.reachable(last):
            return [], 0
        out = [last]
        at = less[last] + 1
        while at < n:
            rank = longest[at]
            if rank < 0:
                break
            known = pairs.get((last, rank))
            if not (self.compatible(last, rank) if known is None else known):
                break
            out.append(rank)
            at += less[rank] + 1
            last = rank
        return out, at

    def encode_piece(self, data: bytes) -> list[int]:
        if (rank := self.ranks.get(data)) is not None:
            return [rank]
        n, less = len(data), self.less
        found = list(self.automaton.iter(data.decode("latin-1")))
        longest = [-1] * n
        for end, rank in found:
            longest[end - less[rank]] = rank  # ends ascend, so the longest comes last
        out, at = self.greedy(longest)
        if at == n:
            return out
        begins: list[list[int]] = [[] for _ in range(n)]
        for end, rank in found:
            begins[end - less[rank]].append(rank)
        tried: list[int] = []  # for each token of ``out``: how many of its place's choices are left
        place = 0
        for rank in out:
            tried.append(len(begins[place]) - 1)
            place += less[rank] + 1
        dead = bytearray(n + 1)
        left = len(begins[at])
        while at < n:
            while left:
                left -= 1
                rank = begins[at][left]
                end = at + less[rank] + 1
                if not dead[end] and (self.compatible(out[-1], rank) if out else self.reachable(rank)):
                    out.append(rank)
                    tried.append(left)
                    at, left = end, len(begins[end]) if end < n else 0
                    break
            else:
                if not out:
                    raise ValueError("no encoding: the ranks lack a byte")
                dead[at] = 1
                at -= less[out.pop()] + 1
                left = tried.pop()
        return out

    def pack(self, piece: str) -> bytes:
        """The ids of one piece as little-endian unsigned 32-bit integers."""
        ids = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self.packed) >= MOST_PIECES:
                self.packed.clear()
            self.packed[piece] = ids
        return ids

    def encode_split(self, text: str) -> bytes:
        get, pack = self.packed.get, self.pack
        return b"".join([get(p) or pack(p) for p in self.split(text)])

    def new_chunk(self, chunk: str) -> bytes:
        ids = self.encode_split(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self.chunk_ids) >= MOST_PIECES:
                self.chunk_ids.clear()
            self.chunk_ids[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.chunks:
            return self.encode_split(text)
        get, new = self.chunk_ids.get, self.new_chunk
        return b"".join([get(c) or new(c) for c in self.chunks(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def bpe(path: str, pattern: str) -> Bpe:
    """One for each Python worker; built on first use."""
    return Bpe(path, pattern)
