"""Substring dedup where texts without ids overlap others in part."""

from larkspur.llm import substring_dedup


def test_windows_of_texts_without_ids_count(spark):
    passage = [f"p{i}" for i in range(400)]
    rows, nameless = [], []
    for k in range(12):  # the two share 25 to 58 words, and go on differently
        own = [f"d{k}x{i}" for i in range(40)]
        part = passage[k * 30 : k * 30 + 25 + 3 * k]
        rows.append((k + 1, " ".join(own[:20] + part + own[20:])))
        nameless.append(" ".join([f"n{k}x{i}" for i in range(30)] + part + [f"m{k}x{i}" for i in range(30)]))
    want = {i: (n, gone, kept) for i, n, gone, kept in substring_dedup.brute([(-1 - k, t) for k, t in enumerate(nameless)] + rows) if i > 0}
    docs = spark.createDataFrame(rows + [(None, t) for t in nameless] + [(None, None), (None, nameless[0])], "doc_id long, text string")
    found = substring_dedup.substring_dedup(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found if r.doc_id is not None} == want
    assert sorted(r.kept for r in found if r.doc_id is None) == sorted([*nameless, "", nameless[0]])
    assert all(gone >= 20 for _, gone, _ in want.values())
