"""URL filters: rules by host and path decide first, logistic regression on hashed character n-grams the rest.

The model is trained by gradient descent from a small labelled table of URLs, at most ``MOST_LABELLED`` rows of it;
its features are made by the same column expression as those of the pages and come to the driver as hashed counts.
Scoring is one expression over the url alone; no page is shuffled and no other column is read.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
model's bias; repeated rows are judged alike; without labelled rows the model allows all; an empty table gives none;
a new column whose name pages already has gets an underscore after its name.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, lower_ascii, numbered
from .quality import let

SLOTS, SIZES = 4096, (3, 4)
MOST_LABELLED = 5000
#: The production rules, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words of hosts and paths of unwanted sites, and words of others, in four languages; the labelled table is combined from them.
UNWANTED = "casino poker bet bets slots jackpot roulette bingo lottery win winner prize bonus spins pills viagra cialis pharma cheap discount loans payday cash credit replica watches xxx porn adult cams sexy nude dating singles escort torrent warez crack keygen followers likes forex crypto miracle diet free hot now".split()
WANTED = "library weather university recipes garden history science museum news travel music health school research cooking sports bank post shop market city council hospital theatre film books review journal archive wiki forum help support docs code data maps train flight hotel family kids church energy water law jobs art photo nature animals farm wetter schule verein rathaus zeitung musee mairie journaux cuisine ecole noticias ayuntamiento escuela cocina".split()
PAGES = "about contact article articles products category index search team events help faq archive tag blog post download user".split()


def labelled_urls(spark: SparkSession, rows: int = 900, part: int | None = None, parts: int = 5) -> DataFrame:
    """The small labelled table: (url, label), 1 for block; one in three is. part: only rows of one of so many parts.

    A row's choices are the digits of a hash of its number: scheme, subdomain, one or two words, ending, and a path
    with a word of the same class, a neutral page, a number or nothing.
    """
    made = []
    for k in range(rows):
        if part is not None and k % parts != part:
            continue
        h = int.from_bytes(hashlib.sha256(f"url {k}".encode()).digest()[:16], "big")

        def pick(options):
            nonlocal h
            h, i = divmod(h, len(options))
            return options[i]

        label = int(k % 3 == 0)
        words = UNWANTED if label else WANTED
        host = pick(("", "www.", "m.", "blog.", "en.", "shop.")) + pick(words) + pick(("", "-", "")) + pick((pick(words), "", pick(PAGES))) + pick(("", "", "24", "online"))
        host += pick((".com", ".net", ".org", ".de", ".fr", ".es", ".co.uk", ".info", ".example.com", ".example.org"))
        path = pick(("", "/", f"/{pick(PAGES)}", f"/{pick(PAGES)}/{pick(range(9999))}", f"/{pick(('en', 'de', 'fr', 'es'))}/{pick(words)}", f"/{pick(('en', 'de', 'fr', 'es'))}/{pick(range(9999))}", f"/{pick(range(1999, 2030))}/{pick(words)}-{pick(words)}.html"))
        made.append((pick(("http://", "https://")) + host + path, label))
    return spark.createDataFrame(made, "url string, label int")


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(after)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def slots(host: Column, path: Column) -> Column:
    """Slots of the character n-grams of host and path, with repeats; host and path have slots of their own."""

    def grams(text: Column, salt: str) -> Column:
        def of(chars: Column) -> Column:
            def runs(n: int) -> Column:
                hashed = lambda x, i: F.xxhash64(F.lit(salt), F.concat_ws("", x, *[F.get(chars, i + k) for k in range(1, n)]))
                return F.transform(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1))), lambda x, i: F.pmod(hashed(x, i), F.lit(SLOTS)).cast("int"))

            return F.concat(*[runs(n) for n in SIZES])

        return let(F.split(F.concat(F.lit("^"), text, F.lit("$")), "", -1), of)

    return F.concat(grams(host, "h"), grams(path, "p"))


def train(labelled: DataFrame, rounds: int = 80, rate: float = 2.0, decay: float = 1e-3) -> tuple[list[float], float]:
    """(weights by slot, bias) from (url, label), by full-batch gradient descent over at most MOST_LABELLED rows."""
    rows = labelled.where("url is not null and label is not null").select("label", F.array_sort(F.array_distinct(slots(host_of(F.col("url")), path_of(F.col("url"))))).alias("s")).orderBy("label", F.xxhash64("s")).limit(MOST_LABELLED).collect()
    weights, bias = [0.0] * SLOTS, 0.0
    for _ in range(rounds if rows else 0):
        step, shift = {}, 0.0
        for r in rows:
            z = (bias + sum(weights[i] for i in r.s)) if len(r.s) else bias
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - r.label
            shift += error
            for i in r.s:
                step[i] = step.get(i, 0.0) + error
        n = len(rows)
        bias -= rate * shift / n
        for i, g in step.items():
            weights[i] -= rate * (g / n + decay * weights[i])
    return weights, bias if rows else -1.0


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest fitting rule as (rule, verdict), null if none fits; rules are a bounded list of the caller's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, rest = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, labelled: DataFrame, *, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, score (probability of block) and verdict."""
    weights, bias = train(labelled)
    learned = F.lit(weights)
    flat, at = numbered(pages, url)
    made = flat.withColumn("host", host_of(F.col(at))).withColumn("path", path_of(F.col(at)))
    z = F.aggregate(F.array_distinct(slots(F.col("host"), F.col("path"))), F.lit(bias), lambda a, s: a + F.get(learned, s))
    z = F.when((F.col("host") == "") & (F.col("path") == ""), F.lit(bias)).otherwise(z)
    made = made.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", 1 / (1 + F.exp(-z)))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    made = made.select(*flat.columns, "host", "path", F.col("fit.rule").alias("rule"), "score", verdict.alias("verdict"))
    return made.toDF(*pages.columns, *free_names(pages.columns, ["host", "path", "rule", "score", "verdict"]))


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), labelled_urls(spark))
    return found.select("page_id", "host", "path", "rule", "verdict")
