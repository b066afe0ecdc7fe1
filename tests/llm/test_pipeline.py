"""The pipeline's stages against plain versions: which rows each keeps, stage by stage, then the whole run."""

import re
import zlib

import numpy as np
from test_near_copies import PLAIN, brute
from test_quality_em import plain_em

import corpus_pipeline
from larkspur.llm import decontam, quality, tokens

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}

    made = quality.with_features(docs).select("doc_id", F.array(*quality.votes().values()).alias("v"), "n_words", "n_repeat_words").collect()
    belief = plain_em([tuple(r.v) for r in made])
    good = {r.doc_id for r, b in zip(made, belief, strict=True) if b >= 0.5 and r.n_words >= 50 and 2 * r.n_repeat_words <= r.n_words}
    kept = corpus_pipeline.stash(stage["quality_rules"](spark, docs, SF), "test")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good

    low = brute([(i, held[i]) for i in good])
    kept = corpus_pipeline.stash(stage["near_dedup"](spark, kept, SF), "test")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values()))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in decontam.brute([(i, held[i]) for i in set(low.values())], items) if not r[2]}
    kept = corpus_pipeline.stash(stage["decontaminate"](spark, kept, SF), "test")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean and len(clean) < len(set(low.values()))

    mixed = corpus_pipeline.stash(stage["mix_sources"](spark, kept, SF), "test")
    times, size, taken, longest = {}, {}, {}, {}
    for r in kept.collect():
        size[r.source] = size.get(r.source, 0) + len(re.findall(PLAIN, r.text))
        longest[r.source] = max(longest.get(r.source, 0), len(re.findall(PLAIN, r.text)))
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        taken[r.source] = taken.get(r.source, 0) + len(re.findall(PLAIN, r.text))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    goal, free, left = {}, set(size), 1.5 * sum(size.values())
    while free:  # clamp, hand the excess on, again
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * size[s]}
        if not over:
            goal |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        goal |= {s: 2 * size[s] for s in over}
        left, free = left - sum(goal[s] for s in over), free - over
    assert mixed.columns == docs.columns and set(times) <= clean and max(times.values()) <= 2
    assert all(abs(taken.get(s, 0) - g) <= longest[s] for s, g in goal.items())

    library, at, want = Tokenizer.from_file(tokens.default_tokenizer()), 0, []
    for i in sorted(times):
        ids = [*library.encode(held[i], add_special_tokens=False).ids, 0]
        for _ in range(times[i]):
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert sorted(tuple(r) for r in stage["token_files"](spark, mixed, SF).collect()) == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want
