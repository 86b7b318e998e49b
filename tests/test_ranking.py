"""Row numbers by ranges against sorting in Python."""

import math
import statistics

from pyspark.sql import functions as F

from quillon.operators import keyed, ranking, relational


def test_numbered(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", float(i % 7)) for i in range(500)] + [(500, None, None), (501, None, 2.0), (502, "hot", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(7)
    got = {r["id"]: r["n"] for r in ranking.numbered(df, [F.desc("v"), "id"], "n", ["g"]).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        want |= {r[0]: i for i, r in enumerate(mine)}
    assert got == want
    whole = [(r["n"], r["id"]) for r in ranking.numbered(df, ["v", "id"], "n").collect()]
    by_value = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    assert sorted(whole) == list(enumerate(r[0] for r in by_value))
    assert ranking.numbered(df.where("false"), ["v"], "n", ["g"]).count() == 0


def test_equal_rows_and_scores(spark):
    same = spark.createDataFrame([(1, 1.0)] * 50, "member long, score double")
    assert sorted(r["zrank"] for r in keyed.zrank(same).collect()) == list(range(50))
    tied = spark.createDataFrame([(i, 1.0) for i in range(200)], "member long, score double")
    assert {r["member"]: r["zrank"] for r in keyed.zrank(tied).collect()} == {i: i for i in range(200)}


def test_long_recursion(spark):
    out = relational.recursive_union(spark.range(1), lambda new: new.where("id < 20").select((F.col("id") + 1).alias("id")))
    assert sorted(r["id"] for r in out.collect()) == list(range(21))


def test_percentiles(spark):
    rows = [("a", float(i * i % 97)) for i in range(301)] + [("b", 4.0)] * 80 + [("b", 1.0), ("b", None), ("c", None), (None, 2.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    asked = {"p50": ("cont", 0.5), "low": ("disc", 0.0), "p90": ("disc", 0.9), "top": ("cont", 1.0)}
    got = {r["g"]: (r["p50"], r["low"], r["p90"], r["top"]) for r in ranking.percentiles(df, ["g"], "v", asked).collect()}
    want = {}
    for g in ("a", "b", "c", None):
        vs = sorted(v for k, v in rows if k == g and v is not None)
        want[g] = (statistics.median(vs), vs[0], vs[math.ceil(0.9 * len(vs)) - 1], vs[-1]) if vs else (None,) * 4
    assert got == want
    every = sorted(v for _, v in rows if v is not None)
    assert [r["p50"] for r in ranking.percentiles(df, [], "v", {"p50": ("cont", 0.5)}).collect()] == [statistics.median(every)]
    assert ranking.percentiles(df.where("false"), ["g"], "v", asked).count() == 0
    assert [r["p50"] for r in ranking.percentiles(df.where("false"), [], "v", {"p50": ("cont", 0.5)}).collect()] == [None]
