"""The training-data operators against plain versions, on small tables with nulls, empty texts, ties and no rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from larkspur.llm import chat, decontam, lm_score, mixing, pii, quality, simhash, substring_dedup, tokens, urls

SF = "/root/testdata/sf0.001"
PLAIN = r"[^\x20\x09-\x0D]+"
ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \t\n"), (10**6 + 3, "one"), (10**6 + 4, "a b a b a b " * 400), (10**6 + 5, "a b a b a b " * 400), (10**6 + 6, "é𝒳 +1 (743) 555-3824 a@b.co 1.2.3.4 4111 1111 1111 1111 " * 50)]
TM = ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(n)) for n in (1024, 2048, 8192) for flip in (0, 1)]  # pairs of equal polynomial hashes
ODD += [(10**6 + 10 + k, " ".join(f"w{i}" for i in range(19)) + " " + t) for k, t in enumerate(TM)] + [(10**6 + 20 + k, t) for k, t in enumerate(TM)]
COLUMNS = "doc_id long, text string, source string, `n_words x` int"


@pytest.fixture(scope="module")
def rows(spark):
    held = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return held + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None if i % 9 == 0 else f"s{i % 4}", 1) for i, t in rows], COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


CLASHING = ("n_words", "n_hit", "items", "size", "cut", "whole", "pick", "target", "kept", "fp", "component_id", "_words", "_c1")


def test_stages_leave_clashing_columns_alone(spark, docs):
    from pyspark.sql import functions as F

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    more = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    for stage in (quality.keep_good, simhash.drop_near_duplicates, lambda d: decontam.remove_contaminated(d, bench), mixing.mix):
        made = stage(more)
        assert made.columns == more.columns and got(made.select("doc_id"), "doc_id") == got(stage(docs).select("doc_id"), "doc_id")
        assert made.where(" or ".join(f"`{c}` <> 'own {c}'" for c in CLASHING)).count() == 0
    assert tokens.token_output(more).count() == docs.count()


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_chat(spark):
    text = "</s>[INST] ok [/INST] <\\/s> [\\\\INST]"
    t = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, None, None), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(t.withColumn("parts", chat.text_parts(t.text)))
    read = {r.conv_id: r for r in made.select("conv_id", chat.read_turns(made.formatted).alias("t"), chat.read_loss(made.formatted, made.loss_spans).alias("loss")).collect()}
    assert [tuple(x) for x in read[1].t] == [("user", text), ("assistant", text), ("", "")] and read[1].loss == text and read[2].loss == ""
    parts = [("text", "see ", None, 0), ("image", None, "s3://x", 576), ("audio", None, "y", 30), ("text", "[IMAGE]", None, 0)]
    r = chat.format_chats(spark.createDataFrame([(5, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")).first()
    assert r.formatted == "<s>[INST]user[/INST]see [IMAGE][AUDIO][\\IMAGE]</s>" and r.expanded_tokens == 606
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "s3://x", 576), ("audio", "y", 30)]


def test_substring_dedup(docs, rows, none):
    assert got(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept") == substring_dedup.brute(rows)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_mixing(docs, none):
    narrow, sources = mixing.plan_mix(docs)
    goal = {r.source: r for r in sources.collect()}
    total = sum(g.source_size for g in goal.values())
    assert abs(sum(g.target for g in goal.values()) - 1.5 * total) < 1e-6 * total
    mixed = mixing.mix(docs)
    taken: dict = {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(re.findall(PLAIN, r.text or ""))
    assert mixed.columns == docs.columns and max(goal, key=lambda s: (s is None, s)) is None
    for s, g in goal.items():
        assert g.target <= 2 * g.source_size + 1e-9 and abs(taken.get(s, 0) - g.target) < 0.05 * g.target + 20
    assert mixing.mix(none).count() == 0


def test_lm_scores(spark, docs, none):
    ids = spark.createDataFrame([(1,), (2,), (None,)], "doc_id long")
    found = {r.doc_id: r for r in lm_score.lm_scores(docs, ids).collect()}
    assert found[10**6].score is None and found[1].score < found[10**6 + 4].score and len(found) == docs.count()
    assert lm_score.lm_scores(none, ids).count() == 0


def test_quality(docs, rows, none):
    def plain(t):
        w, lines = re.findall(PLAIN, t or ""), [x for x in (t or "").split("\n") if re.search(PLAIN, x)]
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen: dict = {}
        for i, x in enumerate(g):
            seen.setdefault(x, []).append(i)
        cover = {i + k for x in seen.values() if len(x) > 1 for i in x for k in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 2 * len(cover) > len(w)

    found = quality.score_quality(docs)
    assert got(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted((i, *plain(t)) for i, t in rows)
    assert quality.keep_good(docs).columns == docs.columns and quality.score_quality(none).count() == 0


def test_quality_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    held = quality.score_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in held if r.label == k] for k in (1, 0))
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def test_urls(spark):
    odd = [(1, None), (2, "no"), (3, "http://A.ORG"), (4, "x://Example.ORG/es/1?a"), (5, "http://borg/"), (6, "a://b://c.com/fr/"), (7, "http://É.com/de/#x"), (8, "https://www.cheap-pills.example.com/en/4")]
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(odd, "page_id long, url string"), urls.labelled_urls(spark)).collect()}
    assert found[1][:3] == found[2][:3] == ("", "", None) and found[3][:3] == ("a.org", "", None) and found[4] == ("example.org", "/es/1", "example.org/es/", "block")
    assert found[5][2] is None and found[6][:2] == ("b:", "//c.com/fr/") and found[7][1:] == ("/de/", "com/de/", "block") and found[8][2:] == (None, "block")


def test_pii(docs, rows, none):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, m):
        d = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(x) < 256 for x in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    want = sorted((i, [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t or "") if passes(k, m.group())]) for i, t in rows)
    found = sorted((r.doc_id, [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.pii if s.base]) for r in pii.find_pii(docs).collect())
    assert found == want and pii.find_pii(none).count() == 0


def test_simhash(docs, rows, none):
    prints = []
    for _, t in rows:
        w = re.findall(PLAIN, (t or "").translate({c: c + 32 for c in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    low = [i for i, _ in rows]
    a = np.array(prints, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    while True:
        new = [min(low[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
        if new == low:
            break
        low = new
    found = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == sorted((i, f, c) for (i, _), f, c in zip(rows, prints, low, strict=True))
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == sorted(set(low)) and simhash.near_duplicates(none).count() == 0


def test_tokens(spark, docs, rows, none):
    from tokenizers import Tokenizer

    library, at, want = Tokenizer.from_file(tokens.default_tokenizer()), 0, []
    more = [(2 * 10**6, "it's 'still  x\n\n y <|endoftext|> z"), (2 * 10**6 + 1, "日本 ١٢ 🙂'm 's 'r")]
    for i, t in sorted(rows + more, key=lambda x: x[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    assert got(tokens.token_output(both), "doc_id", "start", "n_tokens", "ids_crc32") == want and tokens.token_output(none).count() == 0


def test_decontamination(spark, docs, rows, none):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "one"), (901, None), (902, "--")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (50, 400, 10**6):  # many groups of blocks, some, one block
        if block == 50:
            docs_, bench_ = docs.where("doc_id % 7 = 0 or doc_id > 999999"), bench.where("item_id < 24 or item_id >= 900")
            rows_, items_ = [x for x in rows if x[0] % 7 == 0 or x[0] > 999999], [x for x in items if x[0] < 24 or x[0] >= 900]
        else:
            docs_, bench_, rows_, items_ = docs, bench, rows, items
        found = decontam.find_matches(docs_, bench_, block_words=block).collect()
        mine = sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in found)
        assert mine == sorted(decontam.brute(rows_, items_))
    assert decontam.remove_contaminated(docs, bench).columns == docs.columns and decontam.remove_contaminated(none, bench).count() == 0
