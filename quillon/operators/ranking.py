"""Row numbers over whole tables without a task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.sources.shared import stored


def numbered(df: DataFrame, order: list[Column | str], name: str, within: list[str] | None = None) -> DataFrame:
    """Add a row number from 0 by order (nulls as the order says; ties in any order), within groups if given.

    Rows are dealt to ranges of (within, order), so a hot group or a value that many rows share is split as long as
    the later columns of the order tell rows apart. Each range is sorted on its own and stored once; what the ranges
    before it hold is a sum over one row a range. A null group is a group; an empty table stays empty.
    """
    groups = within or []
    by = [F.col(g) for g in groups] + [F.col(o) if isinstance(o, str) else o for o in order]
    # the identifier is the range's number in the upper 31 bits and the place in it in the lower 33
    placed = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    ranged = placed.withColumn("_range", F.shiftright("_at", 33)).withColumn(name, F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
    held = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = held.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row a range: as many as the shuffle has partitions
    whole = ranged.join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
    if not groups:
        return whole
    first = whole.groupBy(*groups).agg(F.min(name).alias("_first")).select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), "_first")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    return whole.join(first, same).withColumn(name, F.col(name) - F.col("_first")).select(*df.columns, name)


def skipped(df: DataFrame, count: int) -> DataFrame:
    """All rows but the first, in the table's order, which is kept.

    The rows are stored once with their places, so that no task holds or passes on more than a partition.
    """
    # the identifier grows with the partition's number and the place in it, as do the ranges of a sorted table
    placed = stored(df.withColumn("_at", F.monotonically_increasing_id()))
    held = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = held.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row a partition
    whole = placed.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(before), "_range")
    return whole.where(F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) >= count).orderBy("_at").select(*df.columns)


def percentiles(df: DataFrame, groups: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact percentiles of each group: name -> ("cont" or "disc", share from 0 to 1). Nulls are left out; a group of nulls alone gives null.

    Values are counted before the shuffle. Only distinct values are then ranked, by ranges, so that neither a group
    of any size nor one with any number of distinct values is held by a task.
    """
    counted = df.groupBy(*groups, value).agg(F.count(value).alias("_c"))  # 0 for nulls
    by = [*(F.col(g) for g in groups), F.col(value)]
    placed = stored(counted.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    ranged = placed.withColumn("_range", F.shiftright("_at", 33))
    start = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(F.sum("_c").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(start), F.lit(0)).alias("_before"))
    upto = F.sum("_c").over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # rows up to and with this value, over the whole table; a row a range is broadcast
    ranked = ranged.withColumn("_upto", upto).join(F.broadcast(before), "_range").withColumn("_upto", F.col("_upto") + F.col("_before"))
    sizes = ranked.groupBy(*groups).agg(F.min(F.col("_upto") - F.col("_c")).alias("_first"), F.sum("_c").alias("_size"))
    sizes = sizes.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), "_first", "_size")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    rows = ranked.join(sizes, same) if groups else ranked.crossJoin(F.broadcast(sizes))  # one row without groups
    last = F.col("_upto") - F.col("_first") - 1  # places of a value in its group: from last - _c + 1 to last

    def at(place: Column) -> Column:
        return F.max(F.when((place <= last) & (place > last - F.col("_c")), F.col(value)))

    picked, out = [], []
    for name, (kind, share) in wanted.items():
        if kind == "disc":
            picked.append(at(F.greatest(F.ceil(F.lit(share) * F.col("_size")) - 1, F.lit(0))).alias(name))
            out.append(F.col(name))
            continue
        place = F.lit(share) * (F.col("_size") - 1)
        low, high, rest = f"_low_{name}", f"_high_{name}", f"_rest_{name}"
        picked += [at(F.floor(place)).alias(low), at(F.ceil(place)).alias(high), F.max(place - F.floor(place)).alias(rest)]
        out.append((F.col(low) + (F.col(high) - F.col(low)) * F.col(rest)).alias(name))
    return rows.groupBy(*groups).agg(*picked).select(*groups, *out)
