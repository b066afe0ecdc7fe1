"""LM losses against a plain bigram model of all words."""

import math
import re
from collections import Counter

import pytest

from larkspur.llm import lm_score


def plain(rows, target):
    held = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))) for i, t in rows]
    size, out = len({x for _, w in held for x in w}), {}
    for k, chosen in enumerate(([w for i, w in held if i in target], [w for _, w in held])):
        words, pairs = Counter(x for w in chosen for x in w), Counter(p for w in chosen for p in zip([None, *w], w))
        words[None] = sum(1 for w in chosen if w)
        total = sum(words.values()) - words[None]
        for i, w in held:
            loss = [-math.log((pairs[a, b] + 20 * (words[b] + 1) / (total + size)) / (words[a] + 20)) for a, b in zip([None, *w], w)]
            out.setdefault(i, [len(w), None, None])[k + 1] = sum(loss) / len(loss) if w else None
    return out


@pytest.mark.parametrize("block_bytes", [50_000, lm_score.BLOCK])
def test_losses_are_those_of_exact_counts(spark, block_bytes):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    # more different bigrams than the 2^20 slots that models once had
    rows += [(10**6 + k, " ".join(f"w{(k * 7919 + j * j * 31 + j) % 99991}" for j in range(20_000))) for k in range(60)]
    rows += [(10**7, None), (10**7 + 1, " \n"), (10**7 + 2, "one"), (10**7 + 3, "The the THE the")]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string").repartition(3)
    target = {r[0] for r in rows[:30]} | {10**6, 10**7, 10**7 + 3}
    found = lm_score.lm_scores(docs, spark.createDataFrame([(i,) for i in target], "doc_id long"), block_bytes=block_bytes).collect()
    assert len(found) == len(rows) + 2
    want = plain(rows + rows[:2], target)
    for r in found:
        n, *losses = want[r.doc_id]
        assert r.n_tokens == n
        assert (r.target_loss is None and r.background_loss is None) if n == 0 else [r.target_loss, r.background_loss] == pytest.approx(losses, rel=1e-9)
