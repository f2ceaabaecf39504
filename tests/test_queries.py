"""Every registered query of the library against its SQL, on the smallest tables, and a few at another number of partitions."""

import math
import os

import duckdb
import pytest

from corpusloom import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, float) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    found = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in found.description]
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", ["leakage_safe_split", "packed_blocks", "near_clusters", "bootstrap_interval", "shard_rollover", "conversation_near_dedup"])
def test_partitions_change_nothing(spark, name):
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = catalog.QUERIES[name](spark, SF_DIR)
        got.append(rows(df.columns, df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert got[0] == got[1]
