"""The SQL of the corpus queries against the queries and against brute force."""

import duckdb
import pandas as pd
import pytest

from locusloom.llm.queries import oracle_sql, queries
from tests.llm.test_op3_warc import PAGES
from tests.llm.test_op3_warc import expected as records
from tests.llm.test_op5_decontam import corpus, expected
from tests.llm.test_op7_embeddings import expected as near
from tests.llm.test_op7_embeddings import vectors
from tests.llm.test_op9_neardup import corpus as texts
from tests.llm.test_op9_neardup import expected as duplicates
from tests.llm.test_op10_chat import conversations
from tests.llm.test_op10_chat import expected as digests


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    found = con.execute(oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = queries()[name](spark, small)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(found.fetchall(), key=str)


def test_decontamination_sql_against_brute_force():
    rows, items = corpus()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    assert sorted(con.execute(oracle_sql()["op5_decontamination"]).fetchall(), key=str) == expected(rows, items)


def test_chat_sql_against_brute_force():
    rows = conversations()
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    control = [(-1, k, r, "<|im_end|><|im_start|>assistant ok") for k, r in enumerate(("user", "assistant"))]
    assert sorted((r[:5] for r in con.execute(oracle_sql()["op10_chat_format"]).fetchall()), key=str) == digests(rows + control)


def test_embedding_sql_against_brute_force():
    rows = vectors(n=120)
    k = len(rows)
    rows += [(k, None), (k + 1, []), (k + 2, [0.0] * 24), (k + 3, [float("inf")] + [1.0] * 23), (k + 4, rows[3][1]), (k + 5, [1.0, 2.0])]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    assert sorted(con.execute(oracle_sql()["op7_embedding_near_dedup"]).fetchall()) == near(rows)


def test_near_duplicate_sql_against_brute_force():
    rows = texts(3, n=40) + [(9000, None), (9001, ""), (9002, "ONE"), (9003, "one"), (9004, "one two"), (9005, "a b c d e a b c")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(oracle_sql()["op9_minhash_near_dedup"]).fetchall()) == duplicates(rows, 3, 85)


def test_warc_sql_against_brute_force():
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    got = con.execute(oracle_sql()["op3_warc"]).fetchall()
    assert sorted((r[0], *r[2:6]) for r in got) == records(PAGES) and all(r[6] for r in got)
