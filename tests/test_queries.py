"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from larkspur.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    found = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    assert plain(found.collect(), found.columns) == plain(want.fetchall(), [c[0] for c in want.description])


def test_index_catalog(spark, tmp_path):
    from larkspur.operators import index

    docs = spark.createDataFrame([("a:1", 1, "Red apples"), ("a:2", 2, "green pears and apples"), ("b:3", 3, "apples")], "key string, doc_id long, text string")
    index.create(docs, str(tmp_path), "fruit", ["text"], prefix="a:")
    assert index.names(spark, str(tmp_path)) == ["fruit"]
    index.compact(spark, str(tmp_path), "fruit")
    assert {r.doc_id for r in index.search(spark, str(tmp_path), "fruit", "text", [["apples"]]).collect()} == {1, 2}
    plan = index.search(spark, str(tmp_path), "fruit", "text", [["apples"]])._jdf.queryExecution().toString()
    assert "In(term" in plan or "EqualTo(term" in plan
    with pytest.raises(Exception, match="exists"):
        index.create(docs, str(tmp_path), "fruit", ["text"])
    assert index.drop(spark, str(tmp_path), "fruit") and index.names(spark, str(tmp_path)) == []


def test_publish_with_many_globs(spark):
    from larkspur.operators.temporal import publish

    subs = [(f"s{i}", f"c{i}*", True) for i in range(500)] + [("x", "c[^1]?", True), ("y", "c.7", False), ("z", "c\\*7", True)]
    got = publish(spark.createDataFrame([("c17", 1), ("c.7", 2), ("c*7", 3), (None, 4)], "channel string, message int"), spark.createDataFrame(subs, "subscriber string, pattern string, is_glob boolean"))
    assert sorted((r.subscriber, r.message) for r in got.collect()) == [("s1", 1), ("s17", 1), ("x", 2), ("x", 3), ("y", 2), ("z", 3)]
