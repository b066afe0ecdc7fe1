"""The EM of the quality rules: accuracies come from the data, a noisy rule is outvoted, and a plain EM agrees."""

import math
import random

from larkspur.llm import quality

DOCS = "/root/testdata/sf0.01/documents.parquet"


def sampled(n, right, seed=1):
    """Votes of len(right) rules on n documents, 7 of 10 good; rule r votes rightly with probability right[r], or abstains."""
    draw, out = random.Random(seed), []
    for _ in range(n):
        good = draw.random() < 0.7
        out.append((good, tuple(0 if draw.random() < 0.1 else (1 if good == (draw.random() < p) else -1) for p in right)))
    return out


def counted(votes):
    out = {}
    for v in votes:
        out[v] = out.get(v, 0) + 1
    return out


def plain_em(rows, rounds=1000):
    """Document by document, without patterns."""
    belief = [(1 + v.count(1)) / (2 + v.count(1) + v.count(-1)) for v in rows]
    for _ in range(rounds):
        table = []
        for r in range(len(rows[0])):
            up = [quality.PRIOR * quality.SAID[1][k] for k in (0, 1)]
            down = [quality.PRIOR * quality.SAID[-1][k] for k in (0, 1)]
            for v, b in zip(rows, belief, strict=True):
                if v[r]:
                    side = up if v[r] > 0 else down
                    side[0] += b
                    side[1] += 1 - b
            table.append([(u / (u + d), d / (u + d)) for u, d in zip(up, down, strict=True)])
        good = (sum(belief) + quality.PRIOR * 0.8) / (len(rows) + quality.PRIOR)
        new = []
        for v in rows:
            odds = good / (1 - good) * math.prod(table[r][0][x < 0] / table[r][1][x < 0] for r, x in enumerate(v) if x)
            new.append(odds / (1 + odds))
        done = max(abs(a - b) for a, b in zip(new, belief, strict=True)) < 1e-9
        belief = new
        if done:
            break
    return belief


def test_a_noisy_rule_is_outvoted():
    right = (0.9, 0.85, 0.9, 0.8, 0.5)  # the last rule tosses a coin
    rows = sampled(20000, right)
    counts = counted(v for _, v in rows)
    rules, good = quality.fit_votes(counts)
    assert abs(good - 0.7) < 0.03
    for p, table in zip(right, rules, strict=True):
        assert abs(table[1][0] - p) < 0.04 and abs(table[-1][1] - p) < 0.04
    believed = {p: quality.posterior(p, rules, good) for p in counts}
    assert believed[1, 1, 1, 1, -1] > 0.9  # all-must-pass would reject it
    assert sum((believed[v] >= 0.5) == g for g, v in rows) / len(rows) > 0.95


def test_plain_em_agrees():
    rows = [v for _, v in sampled(800, (0.9, 0.8, 0.85, 0.6), 2)]
    counts = counted(rows)
    rules, good = quality.fit_votes(counts)
    assert all(abs(quality.posterior(v, rules, good) - b) < 1e-6 for v, b in zip(rows, plain_em(rows), strict=True))


def test_verdicts_come_through_the_estimates(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    made = quality.with_features(docs).select("doc_id", F.array(*quality.votes().values()).alias("v"), F.col("n_words"), F.col("n_repeat_words")).collect()
    belief = plain_em([tuple(r.v) for r in made])
    failed = [r.n_words < 50 or 2 * r.n_repeat_words > r.n_words for r in made]
    want = {r.doc_id: not f and b >= 0.5 for r, b, f in zip(made, belief, failed, strict=True)}
    found = quality.score_quality(docs, carry=["doc_id"]).collect()
    assert {r.doc_id: r.kept for r in found} == want
    must_pass = {r.doc_id for r, f in zip(made, failed, strict=True) if not f and -1 not in r.v}
    assert must_pass < {i for i, k in want.items() if k}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, k in want.items() if k}


def test_own_columns_stay(spark):
    rows = spark.createDataFrame([(1, "a b " * 60, "mine", "too")], "doc_id long, text string, n_words string, _words string")
    r = quality.score_quality(rows).first()
    assert (r.n_words, r._words, r.n_words_) == ("mine", "too", 120)
