from larkspur.operators import index


def test_words_are_counted_where_they_are_read(spark, tmp_path):
    """Documents of one row each need no shuffle to be counted; ids that repeat are still one document; null is no document."""
    docs = spark.createDataFrame([(1, "red apples, red pears", "red"), (2, "", None), (3, None, "pears pears"), (4, "a the", "x")], "doc_id long, text string, title string")
    plan = index.counted(docs, ["text", "title"], "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    read = lambda name, part: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}/{part}").select(*cols[part]).collect())
    cols = {"postings": ["field", "doc_id", "term", "tf", "dl"], "terms": ["field", "term", "df", "cf"], "fields": ["field", "kind", "n", "avgdl"]}
    index.create(docs, str(tmp_path), "one", ["text", "title"])
    assert read("one", "postings") == [("text", 1, "apples", 1, 4), ("text", 1, "pears", 1, 4), ("text", 1, "red", 2, 4), ("title", 1, "red", 1, 1), ("title", 3, "pears", 2, 2)]
    assert read("one", "fields") == [("text", "TEXT", 3, 4 / 3), ("title", "TEXT", 3, 1.0)]
    assert not (tmp_path / "one" / "counted").exists()
    index.create(docs.unionByName(docs.where("doc_id = 1")), str(tmp_path), "two", ["text"])
    assert ("text", "red", 1, 4) in read("two", "terms")
    index.create(docs.where("false"), str(tmp_path), "none", ["text"])
    assert read("none", "fields") == [("text", "TEXT", 0, None)] and read("none", "postings") == []
