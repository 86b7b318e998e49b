"""Nearest neighbours of many queries against brute force."""

from quillon.operators import vectors


def test_knn_each(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SCAN_QUERIES", 3)
    data = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(120)] + [(120, None), (121, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in vectors.knn_each(df, df.where("vec_id % 10 = 0"), "l2", 4).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    rows = {i: v for i, v in data if v}
    want = {}
    for q in range(0, 120, 10):
        scored = [(-round(1 / (1 + sum((x - y) ** 2 for x, y in zip(v, rows[q], strict=True))), 6), i) for i, v in rows.items()]
        want[q] = sorted(scored)[:4]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert vectors.knn_each(df, df.where("false"), "cosine", 4).count() == 0
