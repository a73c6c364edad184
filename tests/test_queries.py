"""Every registered catalog query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tessera import curation_queries, file_queries, identity_queries, queries, upkeep_queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the standard tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", queries.SQL)
def test_same_rows_as_sql(spark, con, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = con.execute(queries.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()]) == ordered(want)


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_whole_key_matches_use_both_keys(spark, con):
    s, c = con.execute("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier").fetchall(), con.execute("SELECT c_custkey, c_nationkey, c_acctbal FROM customer").fetchall()
    nation = {(a, b) for a, n, x in s for b, m, y in c if n == m and x // 500 == y // 500}
    balance = {(a, b) for a, _, x in s for b, _, y in c if x // 20 == y // 20}
    assert nation - balance and balance - nation
    assert sorted((r["s_suppkey"], r["c_custkey"]) for r in queries.QUERIES["whole_key_matches"](spark, FOLDER).collect()) == sorted(nation | balance)


def test_whole_candidate_groups_hold_every_pair(spark, con):
    got = queries.QUERIES["whole_candidate_groups"](spark, FOLDER).collect()
    assert sum(r["n"] for r in got) == con.execute("SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)").fetchone()[0]
