"""The URL model on held-out rows, odd tables, long urls and clashing columns."""

import time

from larkspur.llm import urls


def test_held_out(spark):
    from functools import reduce

    right = blocked = bad = seen = 0
    for part in (0, 3):
        learn = reduce(lambda a, b: a.unionByName(b), [urls.labelled_urls(spark, part=k) for k in range(5) if k != part])
        held = urls.judge(urls.labelled_urls(spark, part=part), learn, rules=()).select("label", "verdict").collect()
        seen += len(held)
        right += sum((r.verdict == "block") == bool(r.label) for r in held)
        bad += sum(r.label for r in held)
        blocked += sum(r.verdict == "block" and r.label for r in held)
    print("held out:", seen, "accuracy", right / seen, "recall of block", blocked / bad)
    assert right / seen > 0.9 and blocked / bad > 0.85


def test_odd_tables(spark):
    none = spark.createDataFrame([], "url string")
    assert urls.judge(none, urls.labelled_urls(spark)).count() == 0
    unlabelled = urls.judge(spark.createDataFrame([("http://casino.com/",)], "url string"), spark.createDataFrame([], "url string, label int"))
    assert unlabelled.first().verdict == "allow"
    own = spark.createDataFrame([("http://A.com/x", "mine", 7, "r")], "url string, host string, score int, rule string")
    r = urls.judge(own, urls.labelled_urls(spark)).first()
    assert (r.host, r.score, r.rule, r.host_, r.path, r.rule_) == ("mine", 7, "r", "a.com", "/x", None)
    began = time.time()
    long = spark.createDataFrame([("http://a.com/" + "poker/" * 100_000,)] * 2, "url string")
    assert urls.judge(long, urls.labelled_urls(spark)).select("score").distinct().count() == 1 and time.time() - began < 60
