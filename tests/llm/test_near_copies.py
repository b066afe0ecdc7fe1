"""The near-dedup stage of the pipeline against all pairs."""

import random
import re

import corpus_pipeline
from larkspur.llm import near_copies

PLAIN = r"[^\x20\x09-\x0D]+"


def shingles(text):
    w = re.findall(PLAIN, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """{id: smallest id of its component} where sets of similarity 0.8 or more are linked."""
    held = {i: shingles(t) for i, t in rows}
    low = {i: i for i in held}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in held.items():
        for j, b in held.items():
            if j < i and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                both = len(a & b)
                if 5 * both >= 4 * (len(a) + len(b) - both):
                    x, y = sorted((find(i), find(j)))
                    low[y] = x
    return {i: find(i) for i in held}


def edited(rng, text, n):
    w = re.findall(PLAIN, text)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_dedup_stage(spark):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    long = [(i, t) for i, t in rows if 60 <= len(re.findall(PLAIN, t or "")) <= 1500]
    for i, t in long[:50]:  # similarities from about 0.6 to 1, in chains too
        n = len(re.findall(PLAIN, t))
        for k in range(4):
            t2 = edited(rng, t, max(1, round(n * rng.uniform(0.002, 0.04))))
            rows.append((10**6 + i * 10 + k, t2))
            t = t2 if k % 2 else t
    rows += [(10**7, None), (10**7 + 1, ""), (10**7 + 2, " \t\n"), (10**7 + 3, "one"), (10**7 + 4, "ONE"), (10**7 + 5, "a b a b a b " * 400), (10**7 + 6, "a b a b a b " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs, split=300).collect()} == want  # buckets in parts
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(want.values()))
    assert len(set(want.values())) < len(rows) - 60
    more = docs.limit(3).unionByName(spark.createDataFrame([(None, rows[0][1]), (None, None)], docs.schema)).selectExpr("*", "'own' AS same", "'own' AS component_id")
    left = corpus_pipeline.near_dedup(spark, more, "").where("same = 'own' and component_id = 'own'").collect()
    assert [r.text for r in left if r.doc_id is None] == [None]  # the other row without an id is a copy
    twice = spark.createDataFrame([(1, "x y", "b"), (1, "x y", "a"), (1, "z", "c"), (None, "q", "d"), (None, "q", "d")], "doc_id long, text string, source string")
    runs = [sorted((r.doc_id or 0, r.text, r.source) for r in near_copies.drop_near_copies(twice.repartition(n)).collect()) for n in (1, 3)]
    assert runs[0] == runs[1] and [x[:2] for x in runs[0]] == [(0, "q"), (1, "x y"), (1, "z")]
    assert near_copies.drop_near_copies(docs.where("false")).count() == 0
