import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairweave.llm import repair
from pairweave.llm.queries import ORACLES, QUERIES

GRAMMAR = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def faults(rows):
    """The first fault of each (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired turns), by trying edits: all but insertions that are never needed twice in a row beyond two."""
    kinds = faults(rows)

    @functools.cache
    def best(i, made, inserted):
        """From row i on, when the initials end in ``made`` (the whole of them matters only by its end)."""
        options = []
        if i == len(rows):
            if made in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text = rows[i]
            options += [(3 + c, "D" + a, t) for c, a, t in [best(i + 1, made, 0)] if c < 99]
            if kinds[i] not in ("blank", "duplicate"):
                more = kinds[i] == "truncated"
                for letter, cost, new in [("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")]:
                    if grows(made, new[:1]):
                        c, a, t = best(i + 1, new[:1], 0)
                        options.append((cost + more + c, letter + a, ((new, text), *t)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if grows(made, new[:1]):
                    c, a, t = best(i, new[:1], inserted + 1)
                    options.append((2 + c, "I" + a, ((new, ""), *t)))
        return min(options, default=(10**6, "", ()), key=lambda o: o[:2])

    def grows(made, initial):
        return (made, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    return best(0, "", 0)


def brute(rows):
    """rows: (conv_id, turn, role, text) as given."""
    out = []
    hurt = damage(rows)
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = sorted([r for r in hurt if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        turns = [r[1] for r in mine if r[1] is not None]
        body = [(r[2], r[3]) for r in mine]
        kinds = faults(body)
        cost, audit, repaired = cheapest(tuple(body))
        assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in repaired))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(body))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, times int").repartition(3)
    plan, turns = repair.repair(repair.damaged(df))
    out = plan.alias("p").join(repair.digests(turns).alias("t"), F.col("p.conv_id").eqNullSafe(F.col("t.conv_id")), "left")
    return sorted(map(tuple, out.select("p.*", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))).collect()), key=repr)


def test_against_brute_force(spark):
    r = random.Random(7)
    texts = ["Yes.", "No", "", " \t\n", "Why?", "So!  ", "a ", "same.", "same.", "...", "é.", None, "x\n.", "long " * 2000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "umpire", "User"]
    rows = [(c, t, r.choice(roles), r.choice(texts)) for c in range(250) for t in range(r.randint(1, 9))]
    rows += [(None, None, "user", "a."), (None, None, "user", "a."), (None, 3, None, None), (7, 3, "user", "Yes."), (7, 3, "user", "Yes."), (7, None, "user", "Yes."), (8, -5, "assistant", "No."), (8, 10**12, "assistant", "No.")]
    assert run(spark, rows) == brute(rows)


def test_all_rows_gone_and_empty_tables(spark):
    gone = next(i for i in range(10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.")]
    assert run(spark, rows) == brute(rows) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert run(spark, []) == []


def test_a_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for t in range(20_000)]
    ((conv, gaps, blank, duplicate, truncated, _, cost, audit, digest),) = run(spark, rows)
    hurt = damage(rows)
    assert (conv, duplicate) == (1, len(hurt) - len({h[1] for h in hurt})) and blank == sum(not h[3] for h in hurt) and truncated == sum(bool(h[3]) and h[3][-1] != "." for h in hurt)
    assert gaps == max(h[1] for h in hurt) - min(h[1] for h in hurt) + 1 - len({h[1] for h in hurt})
    kept = [h for h, e in zip(hurt, audit.replace("I", "")) if e != "D"]
    assert len(audit) - audit.count("I") == len(hurt) and all(h[3] for h in kept)
    assert cost == 3 * audit.count("D") + 2 * audit.count("I") + 2 * audit.count("R") + sum(h[3][-1] != "." for h in kept)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("xsuaoSUAO", max_size=9), max_size=25))
def test_nodes_are_shared_and_costs_are_least(signatures):
    suffixes = repair.Suffixes()
    ordered = sorted(set(signatures), key=lambda s: s[::-1])
    for s in ordered:
        cost, audit = suffixes.audit(s)
        roles = {"s": "s", "u": "user", "a": "assistant", "o": "o"}
        rows = tuple((roles.get(c.lower(), "user"), "" if c == "x" else f"{i}" + ("" if c.isupper() else ".")) for i, c in enumerate(s))
        assert (cost, audit) == cheapest(rows)[:2]
    assert suffixes.made == len({s[i:] for s in ordered for i in range(len(s))})


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(x) for x in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_conversation_repair"](spark, d).collect()), key=repr) == brute(rows)


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    r = random.Random(21)
    odd = [(c, t, r.choice(["user", "assistant", "system", "tool", None]), r.choice(["Yes.", "no", "", " ", "So?", None, "same."])) for c in (1000, 1001, 1002, 1003) for t in range(9)]
    con = duckdb.connect()
    con.sql(f"create table conversations as select conv_id, turn, role, text from '{d}/conversations.parquet'")
    con.executemany("insert into conversations values (?, ?, ?, ?)", odd)
    want = con.sql(ORACLES["op13_conversation_repair"])
    rows = con.sql("from conversations").fetchall()
    assert sorted(map(tuple, want.fetchall()), key=repr) == brute(rows) == run(spark, rows)
    assert want.columns == QUERIES["op13_conversation_repair"](spark, d).columns
