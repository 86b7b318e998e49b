"""Document pipelines: filters and stages over a DataFrame, as declarative plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import ranking

#: A $skip and the $limit behind it are taken together, as the first rows, up to this number.
TOP_ROWS = 100_000


def condition(column: Column, test: object) -> Column:
    """A field's test; a missing field is null, which $ne, $nin and $not match."""
    if not isinstance(test, dict):
        return column.eqNullSafe(F.lit(test))
    ops = {
        "$eq": lambda v: column.eqNullSafe(F.lit(v)), "$ne": lambda v: ~column.eqNullSafe(F.lit(v)),
        "$gt": lambda v: column > v, "$gte": lambda v: column >= v, "$lt": lambda v: column < v, "$lte": lambda v: column <= v,
        "$in": lambda v: column.isin(v), "$nin": lambda v: ~F.coalesce(column.isin(v), F.lit(False)),
        "$exists": lambda v: column.isNotNull() if v else column.isNull(), "$not": lambda v: ~condition(column, v),
    }
    return reduce(lambda a, b: a & b, (F.coalesce(ops[op](v), F.lit(False)) for op, v in test.items()), F.lit(True))


def match(test: dict) -> Column:
    parts = []
    for key, value in test.items():
        if key == "$and":
            parts.append(reduce(lambda a, b: a & b, map(match, value)))
        elif key == "$or":
            parts.append(reduce(lambda a, b: a | b, map(match, value)))
        else:
            parts.append(condition(F.col(key), value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def value(expr: object) -> Column:
    return F.col(expr[1:]) if isinstance(expr, str) and expr.startswith("$") else F.lit(expr)


def number(expr: object) -> Column:
    """What $sum adds: values that are no numbers count as nothing."""
    c = value(expr)
    return F.when(F.typeof(c).rlike("^(tinyint|smallint|int|bigint|float|double|decimal)"), c.try_cast("double"))


def project(df: DataFrame, spec: dict) -> DataFrame:
    """Only the named fields (_id, too, unless it is 0), or all but those that are 0."""
    if all(v in (0, False) for v in spec.values()):
        return df.drop(*spec)
    kept = {"_id": 1, **spec} if "_id" in df.columns else spec
    return df.select(*((F.col(k) if v in (1, True) else value(v)).alias(k) for k, v in kept.items() if v not in (0, False)))


def unwind(df: DataFrame, spec: str | dict) -> DataFrame:
    """A row for each element; missing and empty lists give none, or one with a null where they are to be kept."""
    spec = {"path": spec} if isinstance(spec, str) else spec
    field, index = spec["path"][1:], spec.get("includeArrayIndex")
    rows = (F.posexplode_outer if spec.get("preserveNullAndEmptyArrays") else F.posexplode)(field)
    out = df.select("*", rows.alias("_at", "_element")).withColumn(field, F.col("_element")).drop("_element")
    return out.withColumn(index, F.col("_at").cast("long")).drop("_at") if index else out.drop("_at")


AGGREGATES = {"$sum": lambda v: F.coalesce(F.sum(number(v)), F.lit(0.0)), "$avg": lambda v: F.avg(value(v)), "$min": lambda v: F.min(value(v)), "$max": lambda v: F.max(value(v)), "$count": lambda v: F.count(F.lit(1))}


def run(df: DataFrame, stages: list[dict]) -> DataFrame:
    """$match, $project, $group, $sort, $limit, $skip, $unwind and $count, in order."""
    skip = 0  # rows that only a count has to leave out: any will do, so none has to be put in order
    following = [next(iter(s.items())) for s in [*stages[1:], {None: None}]]
    for stage, (then, limit) in zip(stages, following, strict=False):
        ((name, spec),) = stage.items()
        if name == "$match":
            df = df.where(match(spec))
        elif name == "$project":
            df = project(df, spec)
        elif name == "$group":
            aggs = [AGGREGATES[op](arg).alias(k) for k, a in spec.items() if k != "_id" for op, arg in a.items()]
            df = df.groupBy(value(spec["_id"]).alias("_id")).agg(*aggs)
        elif name == "$sort":
            df = df.orderBy(*(F.col(k).asc_nulls_first() if v > 0 else F.col(k).desc_nulls_last() for k, v in spec.items()))
        elif name == "$limit":
            df = df.limit(spec)
        elif name == "$skip":
            if then == "$count":
                skip = spec
            elif then == "$limit" and spec + limit <= TOP_ROWS:
                df = df.offset(spec)  # with the limit a top-k
            else:
                df = ranking.skipped(df, spec)
        elif name == "$unwind":
            df = unwind(df, spec)
        elif name == "$count":
            df, skip = df.agg(F.greatest(F.count(F.lit(1)) - skip, F.lit(0)).alias(spec)), 0
        else:
            raise ValueError(f"no stage {name}")
    return df
