"""The near-dedup stage finds its links by SimHash: fingerprints, buckets and the tree against plain versions."""

import random

import numpy as np
import pyarrow as pa
from test_near_copies import brute, shingles

import corpus_pipeline
from larkspur.llm import near_copies as nc


def some_rows():
    rng, rows = random.Random(7), []
    for i in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 150, 400)))]
        rows.append((2 * i, " ".join(w)))
        w[rng.randrange(len(w))] = "edit"
        rows.append((2 * i + 1, " ".join(w)))
    return rows


def test_stage_rests_on_simhash_links(spark, monkeypatch):
    rows = some_rows()
    docs = spark.createDataFrame(rows + [(1000, rows[0][1])], "doc_id long, text string")
    low = brute(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(low.values())) and len(set(low.values())) < 50
    # without near prints only equal sets are one
    monkeypatch.setattr(nc, "RADIUS", -1)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [i for i, _ in rows]


def test_fingerprints_are_majorities():
    texts = [*(t for _, t in some_rows()[:20]), "", None, "one two", " ".join(f"x{i}" for i in range(1500))]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    for part, _, size, runs in nc.hashed(iter([batch])):
        assert size.tolist() == [len(shingles(t)) for t in part.column(1).to_pylist()]
        at = 0
        for n, found in zip(size.tolist(), nc.majority(runs, size), strict=True):
            for turn, word in zip(nc.TURN, found, strict=True):
                h = [int(x) for x in nc.tv.mix(runs[at : at + n] + turn)]
                assert int(word) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)
            at += n


def test_tree_with_leaders_connects_all_near_prints():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**64, (150, nc.PRINT), dtype=np.uint64)
    fp[20:90] = fp[0]
    for k, x in enumerate(fp[20:90]):  # from 0 to 60 bits away, in a chain for some
        x[:] = fp[19 + k] if k % 3 else fp[0]
        for b in rng.choice(192, k % 61, replace=False):
            x[b >> 6] ^= np.uint64(1 << int(b & 63))
    group = np.sort(rng.integers(0, 4, len(fp)))

    def classes(a, b, n):
        low = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                low[x] = low[y] = min(low[x], low[y])
        return low

    tree = nc.Stars(group, fp, nc.RADIUS)
    sorted_group = group[np.lexsort((nc.gray_rank(fp[:, 0]), nc.stars(group, fp, nc.RADIUS), group))]
    pairs = [(a, b) for part in [tree.led, *tree.links(nc.RADIUS)] for a, b in zip(*part, strict=True)]
    away = tree.fp[:, None] ^ tree.fp[None, :]
    bits = np.bitwise_count(away).astype(int)
    near = (bits.sum(2) <= nc.RADIUS) & (sorted_group[:, None] == sorted_group[None, :])
    led = set(zip(*(x.tolist() for x in tree.led), strict=True))
    assert all(near[a, b] for a, b in pairs)
    want = [(a, b) for a, b in np.argwhere(near) if a < b and (bits[a, b, 0] <= nc.FIRST or (a, b) in led or (b, a) in led)]
    assert classes(*zip(*pairs, strict=True), len(fp)) == classes(*zip(*want, strict=True), len(fp))


def test_plan_keeps_the_chance_to_miss():
    assert nc.plan(0)[0] == nc.plan(1000)[0] == 4
    rng, p = np.random.default_rng(1), np.arccos(8 / 9) / np.pi
    for n in (10**5, 10**7):
        width, count = nc.plan(n)
        assert n / 2**width <= nc.AVERAGE
        apart = rng.binomial(64 * nc.NAMING, p, 200_000) / (64 * nc.NAMING)
        assert ((1 - (1 - apart) ** width) ** count).mean() < 2 * nc.MISS
