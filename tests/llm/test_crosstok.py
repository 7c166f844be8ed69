import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairweave.llm import crosstok
from pairweave.llm.queries import QUERIES, ranks_path

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """The contract's A and B, whole texts at once."""
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    tokens_a = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, open(ranks_path(), "rb"))}

    def tokens_b(i):
        piece = b.id_to_piece(i)
        m = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()

    def one(text):
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a, bytes_b = [tokens_a.get(i, b"\xff\xff") for i in ids_a], [tokens_b(i) for i in ids_b]
        want = (" " + text).encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return [], [], [], []
        spans = [[], []]
        for side, given_ in enumerate((bytes_a, bytes_b)):
            at = 0
            for x in given_:
                spans[side].append((at, at + len(x)))
                at += len(x)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for e in ends:
            ga, gb = [], []
            while i < len(ids_a) and spans[0][i][1] <= e:
                ga.append(ids_a[i])
                i += 1
            while j < len(ids_b) and spans[1][j][1] <= e:
                gb.append(ids_b[j])
                j += 1
            groups.append((ga, gb))
        links, j = [], 0
        for (s, e), x in zip(spans[0], ids_a):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(ids_b) and spans[1][k][0] < e:
                links.append((x, ids_b[k]))
                k += 1
        return ids_a, ids_b, groups, links

    return one


def brute(rows, plain):
    found = [(key, *plain(text)) for key, text in rows]
    counts = Counter(x for *_, links in found for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for key, a, b, groups, links in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((key, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "  two  spaces ", "tab\tand\nline \n\n end\r\n", "x\x00y", "▁", "a▁b c", "<|endoftext|> and </s> <s> <unk> <0x41>", "日本語の文 と 🙂🙂 é́",
    "don't we'll 12345 67,8.9 !!! ...", "\x1c\x1d \x85 　 x", "a" * 5000, "ab " * 3000, "​ ﻿", "naïve façade", "\n" * 300 + "x",
]


def test_query_against_brute_force(spark, plain):
    r = random.Random(5)
    words = ["the", "Over", "straße", "日本", "internationalization", "42", "x\n", "\n", "", "can't", "<|endoftext|>", "\t", "<s>", "🙂"]
    rows = list(enumerate(ODD)) + [(100 + i, " ".join(r.choices(words, k=r.randint(1, 60)))) for i in range(60)] + [(7, "ab " * 3000), (7, "ab " * 3000), (None, "the the"), (None, None)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, row string, pairs int").repartition(3)
    want = brute(rows, plain)
    for heavy in (crosstok.HEAVY, 20, 1):  # all pairs sent, some, hardly any
        got = crosstok.token_alignment(docs, ranks_path(), P.PATTERN, MODEL, heavy=heavy)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert crosstok.token_alignment(docs.limit(0), ranks_path(), P.PATTERN, MODEL).count() == 0


def test_whole_documents(spark, plain):
    d = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_token_alignment"](spark, d).collect()), key=repr) == brute(rows, plain)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "Ab", "é", "日", "'s", "12", ".", "!!", " ", "\x1f", "<s>", "🙂", "word"]), max_size=30).map("".join))
def test_words_give_the_tokens_of_the_whole_text(plain, text):
    use = crosstok.encoders(ranks_path(), P.PATTERN, MODEL)
    a, b, groups, links = plain(text)
    found = list(use.blocks(text))
    if None in found or not found:
        assert not a
        return
    ((sizes, written, pairs),) = found
    assert sizes.tolist() == [len(a), len(b), len(groups), len(links)]
    assert written.decode() == "".join(f"{','.join(map(str, x))}|{','.join(map(str, y))};" for x, y in groups)
    assert pairs.tolist() == [x * use.b.size + y for x, y in links]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.randoms())
def test_runs(lengths, r):
    ea = np.cumsum(lengths).tolist()
    eb = sorted({ea[-1]} | set(r.sample(range(1, ea[-1] + 1), r.randint(0, ea[-1] - 1)))) if r.random() < 0.3 else sorted({ea[-1]} | {x for x in ea if r.random() < 0.9} | {x - 1 for x in ea if x > 1 and r.random() < 0.1})
    stretches, irregular, links = crosstok.runs(ea, eb)
    common = sorted(set(ea) & set(eb))
    begins, before = [], 0
    for e in common:
        i, j = sum(x <= before for x in ea), sum(x <= before for x in eb)
        begins.append((i, j, ea[i] == e and eb[j] == e))
        before = e
    one = [(i + k, j + k) for i, j, n in zip(*[iter(stretches)] * 3) for k in range(n)]
    assert one == [(i, j) for i, j, single in begins if single]
    assert list(zip(*[iter(irregular)] * 2)) == [(i, j) for i, j, single in begins if not single]
    spans = [list(zip([0, *e], e)) for e in (ea, eb)]
    want = {(i, j) for i, (s, e) in enumerate(spans[0]) for j, (p, q) in enumerate(spans[1]) if p < e and s < q}
    assert sorted(one + list(zip(*[iter(links)] * 2))) == sorted(want)


def test_workers_forget_and_go_on(plain, monkeypatch):
    monkeypatch.setattr(crosstok, "HELD", 2000)
    monkeypatch.setattr(crosstok, "BLOCK", 64)
    use = crosstok.Encoders(ranks_path(), P.PATTERN, MODEL)
    text = " ".join(f"word{i % 97} é{i % 13}" for i in range(400))
    a, b, groups, links = plain(text)
    parts = list(use.blocks(text))
    assert len(parts) > 10 and sum(p[0] for p in parts).tolist() == [len(a), len(b), len(groups), len(links)]
    assert np.concatenate([p[2] for p in parts]).tolist() == [x * use.b.size + y for x, y in links]
