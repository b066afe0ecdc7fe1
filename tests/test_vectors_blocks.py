import numpy as np

from larkspur.operators import vectors as V


def table(spark, x, id="vec_id", vec="embedding"):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], f"{id} long, {vec} array<float>")


def test_every_block_meets_every_other(spark, monkeypatch):
    """Many queries make neither jobs nor plans: blocks meet in one cogroup; ties by id, null vectors left out."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-3, 4, (150, 3)), np.zeros((40, 3)), np.full((2, 3), 9)]).tolist()
    held = [None if i % 50 == 7 else v for i, v in enumerate(x)]
    monkeypatch.setattr(V, "BLOCK_NUMBERS", 120)
    v, q = table(spark, held), table(spark, x[:80], "query_id", "query")
    for metric in ("L2", "COSINE"):
        got = V.knn_join(v, q, 5, block=3, metric=metric)
        assert got._jdf.queryExecution().toString().count("FlatMapCoGroupsInArrow") <= 4
        found = {}
        for r in got.collect():
            found.setdefault(r.query_id, {})[r["rank"]] = (round(r.distance, 9), r.vec_id)

        def unit(a):
            n = np.linalg.norm(a)
            return np.array(a) / n if n else np.zeros(3)

        for i, w in enumerate(x[:80]):
            far = lambda y: float(((np.array(y) - np.array(w)) ** 2).sum()) if metric == "L2" else float(1 - unit(y) @ unit(w))
            want = sorted((round(far(y), 9) + 0.0, j) for j, y in enumerate(held) if y is not None)[:5]
            have = [found[i][n + 1] for n in range(5)]
            # parallel vectors are as far by cosine but for rounding
            assert have == want if metric == "L2" else np.allclose([d for d, _ in have], [d for d, _ in want]), (metric, i)


def test_no_rows(spark):
    assert V.knn_join(table(spark, [[1.0]]).where("false"), table(spark, [[1.0]], "query_id", "query"), 3).count() == 0
    assert V.knn_join(table(spark, [[1.0]]), table(spark, [[1.0]], "query_id", "query").where("false"), 3).count() == 0
