import hashlib
import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from pairweave.llm import chat
from pairweave.llm.queries import HOSTILE, ORACLES, QUERIES

HARD = ["", "\\", "###", "</turn>", "\\###", "\\\\### x", "a </turn>\n### user: b", "####", "######", "\\\\\\</turn>", "x \\", "##", "# </turn", HOSTILE, "é\n日本 ### ", ": ", " </turn>"]
TEXT = st.lists(st.sampled_from(["\\", "#", "###", "</turn>", " ", "\n", ": ", "a", "<", "/turn>", "é"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_round_trip(turns):
    parts = [chat.format_turn(r, t) for r, t in turns]
    assert chat.parse("".join(p[0] for p in parts)) == turns
    assert all(chat.unescape(s[a:b]) == t for (s, a, b), (_, t) in zip(parts, turns))


def test_plain_text_is_left_alone():
    assert chat.format_turn("user", "plain # text \\ x")[0] == "### user: plain # text \\ x </turn>\n"
    assert chat.parse("### user: no end") is None and chat.parse("x") is None


def test_conversations(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", None, "a:b"]), r.choice([*HARD, None]), "x") for c in (1, 2, None) for t in [0, 1, 1, None, 5, 9]]
    rows += [(3, 1, "assistant", "same", "x")] * 2 + [(9, i, "user" if i % 2 else "assistant", HARD[i % len(HARD)] * 50, "y") for i in range(500)]
    got = {g.conv_id: g for g in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string"))).collect()}
    assert set(got) == {1, 2, None, 3, 9}
    for conv, g in got.items():
        mine = sorted([(-1 if t is None else t, chat.format_turn(role or "", text or "")[0].encode(), role or "", text or "") for c, t, role, text, _ in rows if c == conv])
        loss = "".join(x[3] for x in mine if x[2] == "assistant")
        assert g.n_turns == len(mine) and g.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(x[1].decode()) for x in mine)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(empty)).count() == 0


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{d}/conversations.parquet'")
    want = con.sql(ORACLES["op7_chat_format"]).df()
    got = QUERIES["op7_chat_format"](spark, d).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
    assert -7 in set(got.conv_id)
