"""Quality rules as weak supervision: rules vote or abstain, and the posterior of quality replaces all-must-pass.

A rule votes 1 (good), -1 (bad) or 0 (abstains). Documents with equal votes are alike, so the corpus is aggregated to
the counts of vote patterns, at most 3**rules rows; expectation-maximisation over these estimates how each rule votes
on good and on bad documents, and gives each pattern's posterior. A document keeps its pattern's verdict, so one that
a single noisy rule votes against can stay.

Features and votes are column expressions over the text alone, evaluated once and written with the columns that go on;
nothing but pattern counts is shuffled.

Defined results: a null text has no words and fails; ties and repeated rows do not matter; an empty table gives none;
a new column whose name docs already has gets an underscore after its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import free_names, numbered, stash, words

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_marks")


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def repeat_words(w: Column, n: int = 3) -> Column:
    """Words that lie in runs of n words which occur twice or more in the list w."""

    def slow(g: Column) -> Column:
        marked = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def near(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            zero = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("sum"))
            return F.aggregate(places, zero, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(n), p - a["last"])).alias("sum")))["sum"]

        return let(marked, near)

    def grams(v: Column) -> Column:
        runs = F.transform(F.slice(v, 1, F.size(v) - (n - 1)), lambda x, i: F.xxhash64(x, *[F.get(v, i + k) for k in range(1, n)]))
        return let(runs, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(slow(g)))

    return F.when(F.size(w) < n, F.lit(0)).otherwise(let(w, grams)).cast("long")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and the FEATURES of each text, as longs."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = docs.withColumn("_words", words(F.col(f"`{text}`"))).withColumn("_lines", lines)
    w = F.col("_words")
    return made.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": (F.size(F.split(t, r"[#*$%&|<>]", -1)) - 1).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat_words(w),
            "n_shouts": (F.size(F.split(t, r"[!?]{2,}", -1)) - 1).cast("long"),
            "n_marks": (F.size(F.split(t, r"[!-/:-@\[-`{-~]", -1)) - 1).cast("long"),
        }
    ).withColumn("_n_lines", F.size("_lines").cast("long"))


def votes() -> dict[str, Column]:
    """The rules; each abstains between its two bounds."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def low(x: Column, good: float, bad: float) -> Column:
        return F.when(x <= good, 1).when(x > bad, -1).otherwise(0)

    mean = F.col("word_chars") / n
    return {
        "length": F.when(F.col("n_words") < 50, -1).when(F.col("n_words") >= 100, 1).otherwise(0),
        "word_length": F.when((mean < 2.5) | (mean > 12), -1).when((mean >= 3) & (mean <= 10), 1).otherwise(0),
        "symbols": low(F.col("n_symbols") / n, 0.02, 0.1),
        "lines": low(F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)), 0.1, 0.3),
        "repeats": low(F.col("n_repeat_words") / n, 0.2, 0.5),
        "shouts": low(F.col("n_shouts") / n, 0.02, 0.1),
        "marks": low(F.col("n_marks") / n, 0.3, 0.5),
    }


#: What ``PRIOR`` documents of each class are taken to have said before any is seen: (on good, on bad) by vote.
PRIOR, SAID = 10.0, {1: (0.8, 0.5), -1: (0.1, 0.4)}


def fit_votes(counts: dict[tuple[int, ...], int], rounds: int = 1000, prior_good: float = 0.8, prior: float = PRIOR) -> tuple[list[dict[int, tuple[float, float]]], float]:
    """EM over vote patterns: for each rule and vote (P(vote | good), P(vote | bad)) where it votes, and P(good).

    Abstaining says nothing. It begins at the share of good votes in a pattern; the prior of a few documents only tells
    which class is the good one, so accuracies come from the data: a rule that disagrees with the others is learnt to
    be noisy and can be outvoted.
    """
    n_rules = len(next(iter(counts), ()))
    total, rules, good = sum(counts.values()), [], prior_good
    belief = {p: (1 + p.count(1)) / (2 + p.count(1) + p.count(-1)) for p in counts}
    for _ in range(rounds):
        rules = []
        for r in range(n_rules):
            seen = {v: [prior * s for s in said] for v, said in SAID.items()}
            for p, c in counts.items():
                if p[r]:
                    seen[p[r]][0] += c * belief[p]
                    seen[p[r]][1] += c * (1 - belief[p])
            sums = [sum(x[k] for x in seen.values()) for k in (0, 1)]
            rules.append({v: (x[0] / sums[0], x[1] / sums[1]) for v, x in seen.items()} | {0: (1.0, 1.0)})
        good = (sum(c * belief[p] for p, c in counts.items()) + prior * prior_good) / (total + prior)
        new = {p: posterior(p, rules, good) for p in counts}
        change = max((abs(new[p] - belief[p]) for p in counts), default=0)
        belief = new
        if change < 1e-9:
            break
    return rules, good


def posterior(pattern: tuple[int, ...], rules: list[dict[int, tuple[float, float]]], good: float) -> float:
    odds = math.log(good / (1 - good)) + sum(math.log(rules[r][v][0] / rules[r][v][1]) for r, v in enumerate(pattern))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def score_quality(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all) with n_words to n_marks, base_failed, quality (the posterior) and kept."""
    flat, at = numbered(docs, text)
    carried = [f"_c{docs.columns.index(c)}" for c in (docs.columns if carry is None else carry)]
    rules = votes()
    made = with_features(flat, at).select(*carried, *FEATURES, F.array(*[v.cast("byte") for v in rules.values()]).alias("v"))
    made = stash(made, "votes")
    held = made.groupBy("v").count().collect()  # at most 3**rules rows
    fitted, good = fit_votes({tuple(r.v): r["count"] for r in held}) if held else ([], 0.5)
    odds = F.lit(math.log(good / (1 - good)))
    for r, table in enumerate(fitted):
        part = {v: math.log(a / b) for v, (a, b) in table.items()}
        vote = F.get("v", F.lit(r))
        odds = odds + F.when(vote == 1, part[1]).when(vote == -1, part[-1]).otherwise(part[0])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    made = made.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    made = made.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop("v")
    names = docs.columns if carry is None else list(carry)
    return made.toDF(*names, *free_names(names, [*FEATURES, "base_failed", "quality", "kept"]))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that the rules reject."""
    flat, text = numbered(docs, text)
    return score_quality(flat, text).where("kept").select(*flat.columns).toDF(*docs.columns)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = score_quality(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), carry=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
