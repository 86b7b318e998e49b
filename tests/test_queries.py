"""Every query with an oracle gives what DuckDB gives on the smallest tables."""

import datetime
import decimal
import math
import re

import duckdb
import pytest

from quillon.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()[:26].removesuffix("T00:00:00")
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in registry.TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def test_date_epochs_to_the_last_digit(spark, duck, tmp_path):
    """test_oracle compares nine digits, which hides a millisecond; here also halves, times before 1970 and null
    (without ny: its SQL is New York's winter time, the query follows the zone's rules)."""
    us = [0, 1, 499, 500, 501, 999, 1000, 1499, 1500, 2500, 1704067207179575, 10413792000000600, -1, -499, -500, -501, -999, -1000, -1499, -1500, -2500, -9246095999999400]
    duck.execute(f"copy (select row_number() over () as event_id, make_timestamp(u) as ts from (select unnest({us}::bigint[] || [null]) as u)) to '{tmp_path}/events.parquet' (format parquet)")
    for folder, rows in ((SF, 1000), (tmp_path, len(us) + 1)):
        got = registry.queries()["date_epochs"](spark, str(folder)).select("event_id", "us", "ms", "d", "f").collect()
        with_files = re.sub(r"\bFROM events\b", f"FROM read_parquet('{folder}/events.parquet')", registry.oracle_sql()["date_epochs"])
        want = duck.execute(f"select event_id, us, ms, d, f from ({with_files})").fetchall()
        assert len(want) == rows
        assert sorted(map(tuple, got)) == sorted(want)


def against(spark, duck, name, folder):
    """What the query and its SQL give over the files of a folder, every digit of it."""
    df = registry.queries()[name](spark, str(folder))
    text = re.sub(r"\b(FROM|JOIN) (customer|events)\b", rf"\1 read_parquet('{folder}/\2.parquet')", registry.oracle_sql()[name])
    return sorted(map(tuple, df.collect())), sorted(duck.execute(f"select {', '.join(df.columns)} from ({text})").fetchall())


def test_inet_numbers_beyond_32_bits(spark, duck, tmp_path):
    keys = [0, 1, 255, 256, 999, 1000, 65534, 65535, 65536, 65537, 89999, 899999, 2**32 - 1, 2**32, 2**40 + 7]
    duck.execute(f"copy (select unnest({keys}::bigint[]) as c_custkey) to '{tmp_path}/customer.parquet' (format parquet)")
    got, want = against(spark, duck, "inet_numbers", tmp_path)
    assert got == want and len(got) == len(keys)


def test_zset_ties(spark, duck, tmp_path):
    """Equal highest and lowest values, nulls, NaN and zeros of both signs."""
    rows = [(i, ["a", "d"][i % 2], [5.0, 1.0, -0.0, 0.0, None, 5.0, 12.5][i % 7]) for i in range(3, 400)] + [(400, "n", None), (None, "a", 9.0), (401, "a", float("nan")), (402, "a", float("nan"))]
    duck.execute("create or replace temp table rows_(event_id bigint, event_type varchar, value double)")
    duck.executemany("insert into rows_ values (?, ?, ?)", rows)
    duck.execute(f"copy rows_ to '{tmp_path}/events.parquet' (format parquet)")
    got, want = against(spark, duck, "kv_zset_commands", tmp_path)
    assert got == want and len(got) == 3


def test_every_query_has_a_schema(spark):
    assert registry.queries()["pricing_summary"](spark, SF).count() > 0
