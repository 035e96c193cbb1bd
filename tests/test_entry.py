import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = ["hybrid_search", "graph_search", "list_messages_page", "build_unit", "latency_percentiles", "merge_adjacent"]


def test_entry_and_contract(spark):
    assert len(entry.entry(spark).columns) == 9
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = entry.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))


LEXICAL = ["lexical_simple_and", "rrf_fuse", "merge_adjacent", "expand_windows", "fit_budget", "to_results", "context_block", "hybrid_search", "rerank_results", "debug_counters", "corpus_audit"]


@pytest.fixture(scope="module")
def odd_texts(tmp_path_factory):
    """The smallest tables, with queries whose second word holds two terms, and one text of a single word."""
    path = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        rows = f"SELECT * FROM '{DIR}/{t}.parquet'"
        if t == "conversations":
            rows = f"""SELECT conv_id, turn, role, CASE WHEN turn <> 0 THEN text WHEN conv_id = 4 THEN 'One' ELSE regexp_replace(text, '^([^ ]*) ([^ ]*)', '\\1 the.' || chr(10) || '\\2') END AS text FROM ({rows})"""
        con.execute(f"COPY ({rows}) TO '{path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return path, con


@pytest.mark.parametrize("name", LEXICAL)
def test_lexical_queries_ask_for_the_first_term_as_their_sql_does(spark, odd_texts, name):
    path, con = odd_texts
    got = entry.queries()[name](spark, str(path))
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))
    assert want
