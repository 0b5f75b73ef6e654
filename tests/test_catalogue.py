"""Every query against its SQL on the smallest tables."""

import tempfile

import pytest
from same import assert_same

from lectern import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        assert_same(found, duck.sql(SQL[name]).df())
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["q_id", "rank", "id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _gaps(spark, rows):
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double, l_orderkey long, l_linenumber long").coalesce(1).write.mode("overwrite").parquet(f"{path}/lineitem.parquet")
    return sorted(map(tuple, QUERIES["vertical_gaps"](spark, path).collect())), path


def test_lines_at_one_height_dont_hang_on_arrival(spark):
    rows = [(1, 1, 10.0, 31247, 4), (1, 1, 10.0, 7, 2), (1, 1, 10.0, 100007, 1), (1, 1, 10.0, 200_000_007 % 800 + 800, 1)]
    assert 7 % 800 == 100007 % 800  # 100,000 orders and one line apart: as high
    there, back = _gaps(spark, rows)[0], _gaps(spark, rows[::-1])[0]
    assert there == back and sum(r[3] == 0 for r in there) == sum(r[4] == 0 for r in there) == 1


def test_a_half_of_the_sixth_decimal_is_rounded_as_in_sql(spark):
    import duckdb

    found, path = _gaps(spark, [(109, 1, 10.0, 31247, 4), (109, 1, 10.0, 121652, 3)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
    assert found == sorted(con.sql(SQL["vertical_gaps"]).fetchall()) and found[0][3] == 4.999041


def test_lines_are_sorted_once_for_their_places(spark, sf):
    plan = QUERIES["reading_order"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Broadcast" not in plan
