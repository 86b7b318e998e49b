"""Range values as structs (lo, hi, lo_inc, hi_inc), with a null bound for an infinite one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lo: Column, hi: Column, bounds: str = "[)") -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(bounds[0] == "[").alias("lo_inc"), F.lit(bounds[1] == "]").alias("hi_inc"))


def empty(r: Column) -> Column:
    return F.coalesce((r["lo"] > r["hi"]) | (r["lo"] == r["hi"]) & ~(r["lo_inc"] & r["hi_inc"]), F.lit(False))


def _before(a: Column, b: Column) -> Column:
    """a ends before b begins."""
    return F.coalesce((a["hi"] < b["lo"]) | (a["hi"] == b["lo"]) & ~(a["hi_inc"] & b["lo_inc"]), F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    return ~empty(a) & ~empty(b) & ~_before(a, b) & ~_before(b, a)


def contains(a: Column, b: Column) -> Column:
    """Every value of b is in a."""
    low = a["lo"].isNull() | F.coalesce((a["lo"] < b["lo"]) | (a["lo"] == b["lo"]) & (a["lo_inc"] | ~b["lo_inc"]), F.lit(False))
    high = a["hi"].isNull() | F.coalesce((a["hi"] > b["hi"]) | (a["hi"] == b["hi"]) & (a["hi_inc"] | ~b["hi_inc"]), F.lit(False))
    return empty(b) | ~empty(a) & low & high


def contains_value(a: Column, v: Column) -> Column:
    return contains(a, make(v, v, "[]"))
