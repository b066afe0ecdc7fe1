"""Personal data by weak supervision: regex, gazetteer, context and shape labelers vote on candidate spans.

Candidates are the matches of four strict patterns (e-mail, IP, card, phone) and of four looser ones (spelled-out
addresses, IPs and cards with other separators, national phone numbers). Strict matches that pass their checks are
spans in any case. Expectation-maximisation over the counts of vote patterns (at most 3**4 for each pattern) estimates
how each labeler votes on real and on false candidates of the strict and of the loose kind. A logistic span classifier
is trained on at most ``sample`` candidates, taken by hash, labelled with these posteriors; it sees the votes and, in
hashed slots, the span's character shape and the words before it. A loose candidate that it gives at least
``threshold`` is added where no other span stands.

Places come from splitting the text by the same pattern that extracts the matches; running sums over the pieces are
taken in blocks of the square root of their number, and context comes from the piece before a match, so a text of many
matches stays cheap. Patterns are written so that they do not go back: possessive or bounded, and begun only at the
start of a run or where the last match ended.

Defined results: a null text is empty and has no spans; repeated rows have the same spans; an empty table gives none;
where ``pii`` is a carried column the spans are called ``pii_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import free_names, lower_ascii, numbered, stash
from .quality import let

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"A-Za-z0-9._%+-"
#: The strict patterns, each with a way to skip texts that cannot match.
STRICT = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BETWEEN = r"(?:\[\.\]|\(\.\)|[\[(]dot[\])]|\x20dot\x20)"
#: Looser patterns: spelled-out addresses, IPs with marked dots, cards with other separators, phone numbers without a plus.
LOOSE = {
    "email": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+(?:\x20?[\[(]at[\])]\x20?[a-z0-9-]{{1,63}}+(?:\x20?(?:\.|[\[(]dot[\])])\x20?[a-z0-9-]{{2,63}}+){{1,4}}|\x20at\x20[a-z0-9-]{{1,63}}+(?:\x20dot\x20[a-z0-9-]{{2,63}}+){{1,4}})",
    "ip": rf"(?i)(?<![0-9.])[0-9]{{1,3}}+(?:(?:{BETWEEN}|\.)[0-9]{{1,3}}+){{3}}(?![0-9.]?[0-9])",
    "card": r"(?<![0-9])[0-9]{4}+([./_\t]|\x20-\x20|\x20{2,3}|\u00a0)[0-9]{4}+\1[0-9]{4}+\1[0-9]{1,7}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+().-])(?:\(?[0-9]{2,4}\)?[\x20./-]{1,3}[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}|0[0-9]{8,14})(?![0-9A-Za-z-])",
}
NEEDS = {"email": "@", "phone": "+"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Gazetteers of ends of hosts, private and documentation networks, card issuers and country codes.
ENDS = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|mx|br|jp|cn|in)$"
NETWORKS = r"^(?:10|127|0)\.|^192\.168\.|^192\.0\.2\.|^255\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Cue words before a span, in four languages, and words that speak against one.
CUES = {
    "email": r"(?i)(?:mail|correo|courriel|contact|write|schreib|escrib)",
    "ip": r"(?i)(?:\bip\b|host|server|serv|address|adresse|login)",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|payment|zahlung|paiement|pago)",
    "phone": r"(?i)(?:phone|tel|call|fax|mobil|anruf|appel|llam)",
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|serial|model|build|\bv\.?)\s*[#:]?\s*$"
SPANS = "array<struct<kind:int,start:int,end:int,base:boolean,loose:boolean,votes:array<int>,slots:array<int>>>"
SLOTS = 512


def located(text: Column, pattern: str) -> Column:
    """All matches as structs start, end (code points, end exclusive), found, and up to 30 code points before."""

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = let(gaps, lambda g: F.transform(found, lambda m, i: F.struct(F.length(F.get(g, i)).alias("gap"), F.length(m).alias("len"), F.right(F.get(g, i), F.lit(30)).alias("before"))))

        def starts(s: Column) -> Column:
            block = F.greatest(F.ceil(F.sqrt(F.size(s))).cast("int"), F.lit(1))
            add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["gap"] + x["len"])
            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int")), lambda b: add(F.slice(s, b * block + 1, block)))
            before = let(sums, lambda v: F.transform(v, lambda x, b: F.aggregate(F.slice(v, F.lit(1), b), F.lit(0), lambda a, y: a + y)))

            def at(p: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    b = F.floor(i / block).cast("int")
                    start = F.get(p, b) + add(F.slice(s, b * block + 1, i - b * block)) + x["gap"]
                    return F.struct(start.cast("int").alias("start"), (start + x["len"]).cast("int").alias("end"), F.get(found, i).alias("found"), x["before"].alias("before"))

                return F.transform(s, one)

            return let(before, at)

        return let(steps, starts)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,found:string,before:string>>")
    return let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(placed(f)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    at = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(at, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def candidates(text: Column, kind: str, loose: bool) -> Column:
    """Candidate spans of a kind with the labelers' votes (regex, gazetteer, context, shape) and the classifier's slots."""
    pattern, k = (LOOSE if loose else STRICT)[kind], KINDS.index(kind)

    def judged(m: Column) -> Column:
        found, before = m["found"], m["before"]
        plain = F.regexp_replace(found, rf"(?i){BETWEEN}", ".")
        digits = F.regexp_replace(found, "[^0-9]", "")
        ok = passes(kind, plain)
        listed = {
            "email": vote(F.regexp_replace(plain, r"\x20", "").rlike(ENDS), F.lit(False)),
            "ip": vote(plain.rlike(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.") & ~plain.rlike(NETWORKS), plain.rlike(NETWORKS)),
            "card": vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
            "phone": vote(found.rlike(COUNTRIES) | digits.rlike(r"^(?:00?[1-9]|[2-9][0-9]{2}[2-9])"), digits.rlike(r"^(?:19|20)[0-9]{2}")),
        }[kind]
        shape = {
            "email": vote(F.length(found).between(6, 60), F.length(found) > 120),
            "ip": vote(~plain.rlike(r"(?:^|\.)0[0-9]"), plain.rlike(r"(?:^|\.)0[0-9]")),
            "card": vote(F.length(digits).between(15, 16), ~F.length(digits).between(13, 19)),
            "phone": vote(F.length(digits).between(9, 13), ~F.length(digits).between(9, 15)),
        }[kind]
        # character shape of the span, and the words before it
        form = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.right(found, F.lit(40)), "[0-9]", "9"), "[A-Za-z]+", "a"), r"a(?:\.a)+", "a.a")
        said = F.slice(F.reverse(F.filter(F.split(lower_ascii(before), r"[^\p{L}]+"), lambda w: w != "")), 1, 2)
        hints = F.concat(F.array(F.concat(F.lit("="), form)), F.transform(said, lambda w, i: F.concat(i.cast("string"), w)))
        slots = F.transform(hints, lambda h: F.pmod(F.xxhash64(F.lit(k), h), F.lit(SLOTS)).cast("int"))
        votes = F.array(vote(ok, ~ok), listed, vote(before.rlike(CUES[kind]) & ~before.rlike(AGAINST), before.rlike(AGAINST)), shape)
        return F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), (ok & F.lit(not loose)).alias("base"), F.lit(loose).alias("loose"), votes.alias("votes"), slots.alias("slots"))

    found = F.transform(located(text, pattern), judged)
    if not loose:
        found = F.filter(found, lambda s: s["base"])  # a match that fails its check is no candidate
    if kind in NEEDS and not loose:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(SPANS))
    return found.cast(SPANS)


#: What the labelers' prior of ``PRIOR`` candidates a class says: the chance of a right vote.
TRUST, PRIOR = (0.8, 0.7, 0.9, 0.7), 5.0


def fit_labelers(counts: dict[tuple[int, bool, tuple[int, ...]], int], rounds: int = 500) -> dict[tuple[int, bool, tuple[int, ...]], float]:
    """EM over (kind, loose, votes): P(vote | real) and P(vote | false) of each labeler for strict and for loose candidates, a prior for each pattern; returns posteriors."""
    belief = {x: (1 + x[2].count(1)) / (2 + x[2].count(1) + x[2].count(-1)) for x in counts}
    for _ in range(rounds):
        table: dict = {}
        for loose in (False, True):
            for j, trust in enumerate(TRUST):
                seen = {1: [PRIOR * trust, PRIOR * (1 - trust)], -1: [PRIOR * (1 - trust), PRIOR * trust]}
                for x, c in counts.items():
                    if x[1] == loose and x[2][j]:
                        seen[x[2][j]][0] += c * belief[x]
                        seen[x[2][j]][1] += c * (1 - belief[x])
                sums = [seen[1][k] + seen[-1][k] for k in (0, 1)]
                table[loose, j] = {v: math.log(s[0] / sums[0]) - math.log(s[1] / sums[1]) for v, s in seen.items()} | {0: 0.0}
        prior = {}
        for kind, loose in {x[:2] for x in counts}:
            held = [(c, belief[x]) for x, c in counts.items() if x[:2] == (kind, loose)]
            prior[kind, loose] = (sum(c * b for c, b in held) + 1) / (sum(c for c, _ in held) + 2)
        new = {}
        for x in counts:
            p = prior[x[:2]]
            odds = math.log(p / (1 - p)) + sum(table[x[1], j][v] for j, v in enumerate(x[2]))
            new[x] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        change = max((abs(new[x] - belief[x]) for x in new), default=0)
        belief = new
        if change < 1e-9:
            break
    return belief


def train_spans(rows: list[tuple[tuple[int, ...], list[int], float]], rounds: int = 150, rate: float = 1.0, decay: float = 1e-3) -> tuple[list[float], list[float], float]:
    """The span classifier from (votes, slots, posterior): weights of the votes, weights of the slots, bias."""
    weights, learned, bias, n = [0.0] * 4, [0.0] * SLOTS, 0.0, len(rows)
    for _ in range(rounds if rows else 0):
        step, shift, moved = [0.0] * 4, 0.0, {}
        for votes, slots, label in rows:
            z = bias + sum(w * v for w, v in zip(weights, votes, strict=True)) + sum(learned[i] for i in slots)
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label
            shift += error
            step = [s + error * v for s, v in zip(step, votes, strict=True)]
            for i in slots:
                moved[i] = moved.get(i, 0.0) + error
        bias -= rate * shift / n
        weights = [w - rate * s / n for w, s in zip(weights, step, strict=True)]
        for i, g in moved.items():
            learned[i] -= rate * (g / n + decay * learned[i])
    return weights, learned, bias


def standing(spans: Column) -> Column:
    """Of spans with (start, far, base) in order, the base ones and those that overlap no base one nor an added one before them."""
    none = F.array().cast(f"array<struct<start:int,far:int,s:{SPANS[6:-1]}>>")

    def fold(over: Column, first: Column, meets) -> Column:
        def step(a: Column, x: Column) -> Column:
            keep = x["s"]["base"] | ~meets(a["edge"], x)
            return F.struct(F.when(keep, meets(None, x, a["edge"])).otherwise(a["edge"]).alias("edge"), F.when(keep, F.array_append(a["kept"], x)).otherwise(a["kept"]).alias("kept"))

        return F.aggregate(over, F.struct(first.alias("edge"), none.alias("kept")), step, lambda a: a["kept"])

    # backwards only base spans set the edge, forwards all that stand
    back = lambda edge, x, old=None: x["s"]["end"] > edge if old is None else F.when(x["s"]["base"], F.least(old, x["start"])).otherwise(old)
    ahead = lambda edge, x, old=None: x["start"] < edge if old is None else F.greatest(old, x["s"]["end"])
    free = fold(F.reverse(spans), F.lit(2**31 - 1), back)
    return F.transform(fold(F.reverse(free), F.lit(-1), ahead), lambda x: x["s"])


def find_pii(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), threshold: float = 0.7, sample: int = 2000) -> DataFrame:
    """The carried columns and pii, the spans as structs kind (an index into KINDS), start, end, base, by kind and start."""
    flat, at, *carried = numbered(docs, text, *carry)
    t = F.coalesce(F.col(at), F.lit(""))
    parts = [candidates(t, k, False) for k in KINDS] + [candidates(t, k, True) for k in LOOSE]
    made = stash(flat.select(*carried, F.concat(*parts).alias("spans")), "spans")
    every = made.select(F.explode("spans").alias("s"))
    held = every.groupBy("s.kind", "s.loose", "s.votes").count().collect()  # at most 8 * 3**4 rows
    belief = fit_labelers({(r.kind, r.loose, tuple(r.votes)): r["count"] for r in held})
    # loose candidates first: strict ones are alike
    rows = every.select("s.*").orderBy(F.desc("loose"), F.xxhash64("kind", "votes", "slots", "start")).limit(sample).collect()
    weights, learned, bias = train_spans([(tuple(r.votes), r.slots, belief[r.kind, r.loose, tuple(r.votes)]) for r in rows])

    def z(s: Column) -> Column:
        voted = F.aggregate(F.zip_with(s["votes"], F.lit(weights), lambda v, w: v * w), F.lit(bias), lambda a, x: a + x)
        return voted + F.aggregate(s["slots"], F.lit(0.0), lambda a, i: a + F.get(F.lit(learned), i))

    base = F.filter("spans", lambda s: s["base"])
    likely = F.filter("spans", lambda s: ~s["base"] & (z(s) >= math.log(threshold / (1 - threshold))))
    order = F.array_sort(F.transform(F.concat(base, likely), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("far"), s.alias("s"))))
    found = F.when(F.exists("spans", lambda s: s["loose"]), let(likely, lambda x: F.when(F.size(x) == 0, base).otherwise(standing(order)))).otherwise(base)
    spans = F.sort_array(F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))))
    return made.select(*carried, spans.alias("pii")).toDF(*carry, *free_names(list(carry), ["pii"]))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.lit(list(KINDS)), s["kind"]), s["start"], s["end"])), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    base = F.filter("pii", lambda s: s["base"])
    counted = lambda k: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select(
        "doc_id", *[counted(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"),
    )
