"""Joins and ranks in which no key has to fit into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbra.session import cut

#: A key is hot if it holds more than this part of the rows; so at most 1000 keys are, whatever the size.
HOT_PART = 1000


def join_hot(rows: DataFrame, groups: DataFrame, keys: Sequence[str], n: str, total: int) -> DataFrame:
    """Inner join of rows with one line per key; n is the key's number of rows.

    The at most HOT_PART keys above total / HOT_PART rows are broadcast, so their rows stay where they are;
    the rest meets in a shuffle in which no key holds more than that part.
    """
    keys, bound = list(keys), max(1, total // HOT_PART)
    if total < 10 * HOT_PART:
        return rows.join(groups, keys)
    hot = groups.filter(F.col(n) > bound)
    cold = groups.filter(F.col(n) <= bound)
    marked = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(marked, keys, "left_anti").join(cold, keys))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Sum of value over the rows of the group up to and with this one, without putting a group into one task.

    order has to be total within the group. Rows are range-partitioned by group and order; each range sums its own part,
    and what earlier ranges of the same group hold is added. The sums of ranges are one row for each range and group in it.
    """
    group = list(group)
    ranged = cut(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn(out, F.sum(value).over(within))
    same = [local[c].eqNullSafe(offsets[c]) for c in ("_part", *group)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return local.join(offsets, cond).select(*[local[c] for c in df.columns], (local[out] + offsets["_before"]).alias(out))


#: Rows, or bytes as the planner estimates them, up to which a table is numbered by sorting each group in a task.
SORTED, ESTIMATE = 1_000_000, 128 << 20


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """df with each row's place in its group, from 1; order has to be total within the group. Of a large table no group is sorted in one task: places are prefix sums."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ESTIMATE:
        return df.withColumn(out, place)
    df = cut(df, "rows")
    if df.count() <= SORTED:
        return df.withColumn(out, place)
    total = running_total(df.withColumn("_one", F.lit(1)), group, order, "_one", out)
    return total.drop("_one").withColumn(out, F.col(out).cast("int"))
