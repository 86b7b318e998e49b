"""Stages of document pipelines against slices in Python."""

import pytest

from quillon.operators import pipeline

ROWS = [(i, i * 37 % 101, "ab"[i % 2]) for i in range(500)] + [(500, None, "a"), (501, None, "b")]
SORTED = sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, -r[0]))
SORT = {"$sort": {"v": 1, "i": -1}}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "i long, v long, g string").repartition(7)


def one_task(df) -> bool:
    """Whether a step has all rows in one partition."""
    return "SinglePartition, ENSURE_REQUIREMENTS" in df._jdf.queryExecution().executedPlan().toString().split("HashAggregate")[-1]


@pytest.mark.parametrize("skip", [0, 1, 100, 501, 502, 10_000])
def test_skip(docs, skip):
    out = pipeline.run(docs, [SORT, {"$skip": skip}])
    assert not one_task(out)
    assert [tuple(r) for r in out.collect()] == SORTED[skip:]
    matched = pipeline.run(docs, [SORT, {"$skip": skip}, {"$match": {"g": "a"}}, {"$limit": 50}]).collect()
    assert [tuple(r) for r in matched] == [r for r in SORTED[skip:] if r[2] == "a"][:50]
    count = pipeline.run(docs, [SORT, {"$skip": skip}, {"$count": "n"}])
    assert not one_task(count)
    assert [tuple(r) for r in count.collect()] == [(max(502 - skip, 0),)]


def test_skip_and_limit(docs, monkeypatch):
    for most in (100_000, 10):
        monkeypatch.setattr(pipeline, "TOP_ROWS", most)
        assert [tuple(r) for r in pipeline.run(docs, [SORT, {"$skip": 30}, {"$limit": 20}]).collect()] == SORTED[30:50]
    twice = pipeline.run(docs, [SORT, {"$limit": 90}, {"$skip": 40}, {"$skip": 30}, {"$count": "n"}])
    assert [tuple(r) for r in twice.collect()] == [(20,)]
    assert pipeline.run(docs.where("false"), [SORT, {"$skip": 3}, {"$count": "n"}]).collect()[0][0] == 0
