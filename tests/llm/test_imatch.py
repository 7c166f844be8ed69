import duckdb
import pandas as pd
import pytest

from pairweave.llm import imatch
from pairweave.llm.queries import ORACLES


def plain(frame):
    out = []
    for row in frame.astype(object).values.tolist():
        row = [None if pd.isna(x) else x for x in row]
        out.append(tuple(round(float(x), 9) if c.startswith("near") else int(x) if x is not None and c in ("doc_id", "n_chars") else x for c, x in zip(frame.columns, row)))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def compare(spark, con, docs):
    want = con.sql(ORACLES["op3_imatch"]).df()
    got = imatch.imatch(docs).toPandas()[list(want.columns)]
    assert plain(got) == plain(want)
    return got


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{d}/documents.parquet'")
    got = compare(spark, con, spark.read.parquet(f"{d}/documents.parquet"))
    assert got.near_edited.mean() > got.near_next.mean() + 0.2


@pytest.mark.parametrize("rows_per_range, ranges", [(1, 3), (3, 50), (1000, 1)])
def test_cases(spark, monkeypatch, rows_per_range, ranges):
    monkeypatch.setattr(imatch, "ROWS_PER_RANGE", rows_per_range)
    monkeypatch.setattr(imatch, "RANGES", ranges)
    rows = [(i * i, f"w{i} w{i % 7} c{i % 3} é日 " * (i % 5 + 1)) for i in range(60)] + [(5000, None), (5001, ""), (5002, " \n"), (5003, "x" * 9000), (5003, "x"), (4, "a"), (4, "a"), (-9, "neg w1 w2")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fingerprint string, place int")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = compare(spark, con, docs)
    assert len(got) == len(rows)


def test_small_tables(spark):
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    (row,) = imatch.imatch(one).collect()
    assert (row.n_chars, row.near_next) == (5, 1.0)
    assert imatch.imatch(one.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c")], "doc_id long, text string")
    assert imatch.imatch(nulls).count() == 3


def test_far_ids_move_no_others_together(spark):
    ids = [*range(10_000), 10**12, 10**15, -(10**14), 2**62]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    found = rows.withColumn("span", imatch.spans(rows)).collect()
    sizes = {}
    for x in found:
        sizes[x.span] = sizes.get(x.span, 0) + 1
    assert max(sizes.values()) <= 2 * imatch.ROWS_PER_RANGE
    found.sort(key=lambda x: x.doc_id)
    assert [x.span for x in found] == sorted(x.span for x in found)


def test_lexicon_too_large_to_send(spark, monkeypatch):
    """Beyond MOST_SENT the lexicon is joined by a shuffle, with the same result."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, imatch.imatch(docs).collect()))
    monkeypatch.setattr(imatch, "MOST_SENT", 0)
    assert sorted(map(tuple, imatch.imatch(docs).collect())) == want
