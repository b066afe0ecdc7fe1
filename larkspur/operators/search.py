"""Full-text search: analysis, postings, BM25, a query language, and grouped aggregation over documents."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English words that are not indexed.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
#: Letters with marks and the letters they fold to.
MARKED, FOLDED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
K1, B = 1.2, 0.75


def pieces(text: Column) -> Column:
    """Lower-cased, unmarked pieces between other characters than letters and digits, in order."""
    return F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, FOLDED), r"[^\p{L}\p{N}]+")


def tokens(text: Column) -> Column:
    """Lower-cased, unmarked words of at least two bytes that are no stopwords, in order."""
    return F.filter(pieces(text), lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOPWORDS))


def postings(docs: DataFrame, fields: list[str], id: str = "doc_id") -> DataFrame:
    """(field, doc_id, term, tf, dl): term counts and document lengths; terms are counted before they are shuffled."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("words")) for f in fields])).alias("f")
    rows = docs.select(F.col(id).alias("doc_id"), each).select("doc_id", "f.field", F.size("f.words").alias("dl"), F.explode("f.words").alias("term"))
    return rows.groupBy("field", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame, field: str) -> DataFrame:
    """One row: n, the documents that have the field, and avgdl."""
    return docs.where(F.col(field).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.col(field)))).alias("avgdl"))


def _count(words: str, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, term))  # compiled, unlike a lambda


def bm25(docs: DataFrame, field: str, terms: list[str], *, id: str = "doc_id", k1: float = K1, b: float = B, weight: float = 1.0) -> DataFrame:
    """(doc_id, term, score): the terms are counted inside each row, so only matching rows leave the scan.

    One pass gives the corpus figures of all terms as one row, a second the scores.
    """
    w = docs.where(F.col(field).isNotNull()).select(F.col(id).alias("doc_id"), tokens(F.col(field)).alias("w"))
    counted = w.select("doc_id", F.size("w").alias("dl"), F.array(*[_count("w", t) for t in terms]).alias("tf"))
    df = F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(terms))])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), df.alias("dfs"))
    hits = counted.select("doc_id", "dl", F.posexplode("tf").alias("i", "tf")).where("tf > 0").crossJoin(F.broadcast(stats))  # one row
    s = hits.select("*", F.get("dfs", F.col("i")).alias("df"), F.get(F.array(*[F.lit(t) for t in terms]), F.col("i")).alias("term"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1.0))))
    return s.select("doc_id", "term", (weight * score).alias("score"))


@dataclass
class Node:
    """A query tree: kind is term, prefix, fuzzy, tag, num, and, or."""

    kind: str
    field: str | None = None
    values: tuple = ()
    parts: tuple = ()


def parse(query: str) -> Node:
    """term, term*, %term%, a b (and), a|b, ( ), @f:term, @f:(...), @f:{a|b}, @f:[lo hi] with ( for exclusive."""
    toks = re.findall(r"@\w+:|\{[^}]*\}|\[[^\]]*\]|[()|]|%+[^\s%()|]+%+|[^\s()|{}\[\]]+", query)
    at = 0

    def either(field, depth):
        nonlocal at
        if depth > 64:
            raise ValueError("query is nested too deeply")
        parts = [both(field, depth)]
        while at < len(toks) and toks[at] == "|":
            at += 1
            parts.append(both(field, depth))
        return parts[0] if len(parts) == 1 else Node("or", parts=tuple(parts))

    def both(field, depth):
        parts = []
        while at < len(toks) and toks[at] not in ("|", ")"):
            parts.append(one(field, depth))
        if not parts:
            raise ValueError("empty query")
        return parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts))

    def one(field, depth):
        nonlocal at
        t = toks[at]
        at += 1
        if t[0] == "@" and t[-1] == ":":
            if at == len(toks):
                raise ValueError(f"nothing follows {t}")
            return one(t[1:-1], depth)
        if t == "(":
            inside = either(field, depth + 1)
            if at == len(toks) or toks[at] != ")":
                raise ValueError("unbalanced (")
            at += 1
            return inside
        if t[0] == "{":
            return Node("tag", field, tuple(x for x in t[1:-1].split("|") if x))
        if t[0] == "[":
            return Node("num", field, tuple(t[1:-1].replace("inf", "inf").split()))
        if t[0] == "%":
            n = len(t) - len(t.lstrip("%"))
            return Node("fuzzy", field, (t.strip("%").lower(), n))
        if t.endswith("*") and len(t) > 1:
            return Node("prefix", field, (t[:-1].lower(),))
        return Node("term", field, (t.lower(),))

    out = either(None, 0)
    if at < len(toks):
        raise ValueError(f"unexpected {toks[at]}")
    return out


def condition(node: Node, text_fields: list[str], *, separator: str = ",", case_sensitive: bool = False) -> Column:
    """Membership of a row in a query, as a column over the document fields."""
    if node.kind in ("and", "or"):
        parts = [condition(p, text_fields, separator=separator, case_sensitive=case_sensitive) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.kind == "and" else out | p
        return out
    if node.kind == "num":
        low, high = node.values
        c = F.col(node.field).try_cast("double")
        a = c > float(low[1:]) if low[0] == "(" else c >= float(low)
        return a & (c < float(high[1:]) if high[0] == "(" else c <= float(high))
    if node.kind == "tag":
        fold = (lambda x: x) if case_sensitive else F.lower
        have = F.transform(F.split(F.coalesce(F.col(node.field), F.lit("")), re.escape(separator), -1), fold)
        return F.arrays_overlap(have, F.array(*[fold(F.lit(v)) for v in node.values]))
    out = F.lit(False)
    for f in [node.field] if node.field else text_fields:
        w, v = tokens(F.col(f)), node.values[0]
        test = {"term": lambda x: x == v, "prefix": lambda x: x.startswith(v), "fuzzy": lambda x: F.levenshtein(x, F.lit(v)) <= node.values[1]}[node.kind]
        out = out | (F.array_contains(w, v) if node.kind == "term" else F.exists(w, test))
    return out


def leaves(node: Node) -> list[str]:
    return [node.values[0]] if node.kind == "term" else [t for p in node.parts for t in leaves(p)]


def search(docs: DataFrame, query: str, text_fields: list[str], *, id: str = "doc_id", weights: dict[str, float] | None = None, offset: int = 0, count: int = 10) -> DataFrame:
    """FT.SEARCH: doc_id and score, summed over all text leaves and fields; best first, ties by id."""
    if query.strip() in ("", "*"):
        return docs.select(F.col(id).alias("doc_id"), F.lit(0.0).alias("score")).orderBy("doc_id").offset(offset).limit(count)
    tree = parse(query)
    member = docs.where(condition(tree, text_fields)).select(F.col(id).alias("doc_id"))
    terms = leaves(tree)
    if not terms:
        return member.withColumn("score", F.lit(0.0)).orderBy("doc_id").offset(offset).limit(count)
    scored = None
    for f in text_fields:
        part = bm25(docs, f, sorted(set(terms)), id=id, weight=(weights or {}).get(f, 1.0))
        scored = part if scored is None else scored.unionByName(part)
    total = scored.groupBy("doc_id").agg(F.sum("score").alias("score"))
    return member.join(total, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.col("score").desc(), "doc_id").offset(offset).limit(count)


def aggregate(docs: DataFrame, group_by: list[str], reducers: dict[str, tuple[str, str | None]], *, where: Column | None = None, sort_by: list[tuple[str, bool]] = (), offset: int = 0, count: int | None = None, apply: dict[str, Column] | None = None, having: Column | None = None) -> DataFrame:
    """FT.AGGREGATE: reducers name -> (COUNT, SUM, AVG, MIN, MAX or COUNT_DISTINCT, field). Keys become strings, missing is empty.

    apply adds columns made of the results (APPLY), having keeps rows of them (FILTER); groups have no limit.
    """
    rows = docs if where is None else docs.where(where)
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in group_by]

    def reducer(kind: str, field: str | None) -> Column:
        number = F.col(field).try_cast("double") if field else None
        return {
            "COUNT": lambda: F.count(F.lit(1)), "SUM": lambda: F.coalesce(F.sum(number), F.lit(0.0)), "AVG": lambda: F.avg(number),
            "MIN": lambda: F.min(number), "MAX": lambda: F.max(number), "COUNT_DISTINCT": lambda: F.count_distinct(F.col(field)),
        }[kind]()

    out = rows.groupBy(*keys).agg(*[reducer(*r).alias(n) for n, r in reducers.items()])
    for name, made in (apply or {}).items():
        out = out.withColumn(name, made)
    out = out if having is None else out.where(having)
    if sort_by:
        order = []
        for name, desc in sort_by:
            n, s = F.col(name).try_cast("double"), F.col(name).cast("string")
            order += [n.desc_nulls_last(), s.desc()] if desc else [n.asc_nulls_last(), s.asc()]
        out = out.orderBy(*order)
    return out.offset(offset).limit(count) if count is not None else out


def highlight(text: Column, terms: list[str], open: str = "<b>", close: str = "</b>") -> Column:
    """HIGHLIGHT: query words in marks."""
    return F.regexp_replace(text, rf"(?i)\b({'|'.join(map(re.escape, terms))})\b", f"{open}$1{close}")


def summarize(text: Column, terms: list[str], size: int = 20, separator: str = "...") -> Column:
    """SUMMARIZE: the window of words with the most query words, the first of equals."""
    w = F.split(text, r"\s+")
    hit = F.transform(w, lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")).isin([t.lower() for t in terms]).cast("int"))
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))
    best = F.array_max(F.transform(at, lambda i: F.struct(F.aggregate(F.slice(hit, i + 1, size), F.lit(0), lambda a, x: a + x).alias("n"), (-i).alias("i"))))
    return F.concat(F.array_join(F.slice(w, 1 - best["i"], size), " "), F.lit(separator))
