import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from pairweave.llm import queries, tokens
from pairweave.llm.bpe import Bpe, bpe, load_ranks

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def odd_texts():
    r = random.Random(3)
    some = [chr(r.choice([r.randrange(32, 127), r.randrange(32, 0x3000), r.randrange(0x10000, 0x1F000), 9, 10, 32, 32, 0x1C, 0x85, 0xA0, 0x2028])) for _ in range(900)]
    return [None, "", "\n", "\n\na\n\n\n", "a", "é" * 3000, "x" * 20_000, " " * 3000 + "y", "a<|endoftext|>b<|endoftext|>", "日本語\nテキスト\n"] + ["".join(r.choice(some) for _ in range(r.randrange(60))) for _ in range(300)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "e") for i, t in enumerate(odd_texts())]
    return spark.createDataFrame([*rows, (4, "a", "again"), (None, "null id", "x")], "doc_id long, text string, ids string")


def test_bpe_is_the_librarys(spark, table, library):
    got = tokens.encode_decode(table, RANKS, P.PATTERN).collect()
    want = sorted((d if d is not None else -1, library.encode_ordinary(t or "")) for d, t, _ in table.collect())
    assert sorted((g.doc_id if g.doc_id is not None else -1, np.frombuffer(bytes(g.ids), "<u4").tolist()) for g in got) == want
    texts = {d: (t or "").encode() for d, t, _ in table.collect()}
    assert all(bytes(g.decoded) == texts[g.doc_id] and g.n_tokens * 4 == len(g.ids) for g in got)
    assert tokens.encode_decode(table.limit(0), RANKS, P.PATTERN).count() == 0


def test_bpe_without_shortcut(library):
    """Backtracking on pieces that are tokens as well."""
    coder = bpe(RANKS, P.PATTERN)
    r = random.Random(1)
    for _ in range(3000):
        data = b"".join(coder.token[r.randrange(50_000)] for _ in range(r.randrange(1, 4)))
        if data not in coder.ranks:
            assert coder.encode_piece(data) == coder.merged(data)


def test_sections_add_up(spark, table, library):
    texts = [(d, t or "") for d, t, _ in table.collect()]
    got = {}
    for row in tokens.section_tokens(table, RANKS, P.PATTERN).collect():
        got.setdefault(row.doc_id, []).append(row)
    for d, t in texts:
        if d == 4:
            continue
        rows = sorted(got[d], key=lambda x: x.section)
        assert [x.section for x in rows] == list(range(len(rows)))
        assert "".join(t[x.char_start : x.char_end] for x in rows) == t
        assert all("\n" not in t[x.char_start : x.char_end - 1] for x in rows)
        ids, at = library.encode_ordinary(t), 0
        assert sum(x.n_tokens for x in rows) == len(ids)
        assert abs(sum(x.token_share for x in rows) - len(ids)) < 1e-6
        want = [0] * len(rows)
        where = [k for k, x in enumerate(rows) for _ in range(x.char_start, x.char_end)]
        touched = [i for i, c in enumerate(t) for _ in c.encode()]  # code point of each byte
        for i in ids:
            n = len(library.decode_single_token_bytes(i))
            inside = [where[c] for c in dict.fromkeys(touched[at : at + n])]
            want[max(dict.fromkeys(inside), key=inside.count)] += 1
            at += n
        assert [x.n_tokens for x in rows] == want


def test_chunks_hold_whole_pieces(library):
    r = random.Random(8)
    own = Bpe(RANKS, P.PATTERN)
    assert own.chunks and not Bpe(RANKS, r"\w+|\W+").chunks
    signs = ["a", "Zz", "é", "日本", "7", "'s", "'ll", "'", "!?", "_", " ", "  ", "\t", "\n", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b"]
    for _ in range(3000):
        t = "".join(r.choice(signs) for _ in range(r.randrange(12)))
        assert [p for c in own.chunks(t) for p in own.split(c)] == own.split(t)
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def test_packing(spark, table):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = tokens.pack(table.filter("doc_id is not null").dropDuplicates(["doc_id"]), RANKS, P.PATTERN, special=tokens.added_tokens(P.path("byte_bpe_50k.json"))).collect()
    assert len({g.sequence_id for g in got}) == len(got)
    by = {}
    for g in got:
        assert g.length & (g.length - 1) == 0 and 0 < g.length <= 1024 and g.offset == 0 and len(g.ids) == 4 * g.length
        by.setdefault(g.doc_id, []).append(g)
    for d, text, _ in table.collect():
        if d is not None:
            rows = sorted(by[d], key=lambda x: x.start)
            ids = np.frombuffer(b"".join(bytes(x.ids) for x in rows), "<u4").tolist()
            assert ids == t.encode(text or "", add_special_tokens=False).ids + [0]
            assert [x.start for x in rows] == np.cumsum([0, *[x.length for x in rows]])[:-1].tolist() and {x.doc_tokens for x in rows} == {len(ids)}
    buckets = {}
    for g in got:
        buckets.setdefault(g.sequence_id >> 57, set()).add(g.length)
    assert all(len(x) == 1 for x in buckets.values())


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
def test_binary_lengths(n):
    out = tokens.binary_lengths(n, 1024)
    assert sum(out) == n and sorted(out, reverse=True) == out and max(out) <= 1024


def test_queries_on_given_table(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op6_byte_bpe(spark, d).collect()
    assert len(rows) == len(texts)
    for g in rows:
        ids = np.array(library.encode_ordinary(texts[g.doc_id]), "<u4").tobytes()
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[g.doc_id].encode()).hexdigest())
    contract = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole = {k: np.array([*contract.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
    for g in queries.op9_packing(spark, d).collect():
        ids = whole[g.doc_id]
        assert g.doc_tokens == len(ids) and g.ids_crc32 == zlib.crc32(ids[g.start : g.start + g.length].tobytes())
