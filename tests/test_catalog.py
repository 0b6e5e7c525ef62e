"""Every query with SQL gives the rows of its SQL in DuckDB; the others run and give rows."""

import duckdb
import pytest

from quillon.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, tmp_path, name):
    catalog.QUERIES[name](spark, sf).write.parquet(str(tmp_path / "x"))
    mine = duck.sql(f"select * from '{tmp_path}/x/*.parquet'")
    if name not in catalog.SQL:
        assert len(mine) > 0
        return
    theirs = duck.sql(catalog.SQL[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    cols = ", ".join(f'"{c}"' for c in sorted(mine.columns))
    assert sorted(map(repr, mine.project(cols).fetchall())) == sorted(map(repr, theirs.project(cols).fetchall()))


def test_small_files_are_dealt_over_the_tasks(spark, sf):
    """A row of these queries is much work, and their table is one small file."""
    for name in ("sdr_noise", "sdr_dense"):
        assert catalog.QUERIES[name](spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
