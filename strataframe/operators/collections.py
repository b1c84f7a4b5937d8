"""Ordered collections: caps, rankings, lookups, picks, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in iteration order: a distributed top-n, no global sort."""
    return df.orderBy(order).limit(n)


def with_total(df: DataFrame, capped: DataFrame, total: str = "total_count") -> DataFrame:
    """``capped`` with the row count of ``df`` beside each row, as a scalar subquery."""
    return capped.withColumn(total, df.agg(F.count("*")).scalar())


def cap_then_rank(df: DataFrame, order: str, by: str, n: int) -> DataFrame:
    """The first n rows, and only then their rank by a number, largest first; a missing number counts as 0 and ties
    keep their order. Not the top n. The rank's window runs over n rows."""
    w = Window.orderBy(F.coalesce(F.col(by), F.lit(0)).desc(), F.col(order))
    return head(df, order, n).withColumn("rank", F.row_number().over(w))


def global_rank(df: DataFrame, *order: Column) -> DataFrame:
    """The place of each row in one order over all rows, as ``rank``, without bringing them to one task: rows are parted
    by range, written, numbered inside their part, and moved by the sizes of the parts before it."""
    parts = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row a part.
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(before), "_part").withColumn("rank", (inside + F.col("_before")).cast("int")).drop("_part", "_before")


def rank_counts(df: DataFrame, n: str, order: str) -> DataFrame:
    """Counts, largest first, ties in their order, with the place that gives. ``df`` has one row a key."""
    return global_rank(df, F.col(n).desc(), F.col(order).asc())


def exact_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the middle of each key's values, or the mean of the two in the middle, however many there are; null
    values don't count. Values are parted by range within keys, so no task and no buffer holds a key's values."""
    rows = df.select(key, value).where(F.col(value).isNotNull())
    parts = checkpointed(rows.repartitionByRange(F.col(key), F.col(value)).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    # One row a key and part.
    in_key = Window.partitionBy(key)
    sizes = sizes.select(
        key, "_part", (F.sum("_n").over(in_key.orderBy("_part")) - F.col("_n")).alias("_before"), "_n", F.sum("_n").over(in_key).alias("_all")
    )
    middle = [F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)]
    holds = [(m > F.col("_before")) & (m <= F.col("_before") + F.col("_n")) for m in middle]
    some = parts.join(F.broadcast(sizes.where(holds[0] | holds[1])), [key, "_part"])  # only the parts with a middle
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy(value)) + F.col("_before")
    return some.withColumn("_place", place).where((F.col("_place") == middle[0]) | (F.col("_place") == middle[1])).groupBy(key).agg(F.avg(value).alias("median"))


def lookup(names: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Each asked name with the item of that name that comes first (null if there is none) and whether it was found."""
    first = items.groupBy(key).agg(F.min_by(F.struct(*(c for c in items.columns if c != key)), "ord").alias("item"))
    return names.join(first, key, "left").select(key, F.col("item").isNotNull().alias("found"), "item.*")


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A keyed collection built in order: each key has the last value and the first position."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias("position"))


def first_match_else_first(df: DataFrame, key: str, value: str, order: str, match: Column) -> DataFrame:
    """Per key the first value that matches, else the first value."""
    return df.groupBy(key).agg(
        F.coalesce(F.min_by(F.when(match, F.col(value)), F.when(match, F.col(order))), F.min_by(value, order)).alias(value),
        F.bool_or(match).alias("matched"),
    )


def first_match(df: DataFrame, key: str, value: str, order: str, match: Column) -> DataFrame:
    """Per key the first value that matches, or null with the reason in ``error``."""
    found = df.groupBy(key).agg(F.min_by(F.when(match, F.col(value)), F.when(match, F.col(order))).alias(value), F.bool_or(F.coalesce(match, F.lit(False))).alias("_found"))
    return found.select(key, value, F.when(~F.col("_found"), F.lit("no match")).alias("error"))


def first_of_array(values: Column) -> Column:
    """The first entry; null for an empty array."""
    return F.get(values, F.lit(0))


def page(df: DataFrame, order: str, count: int) -> DataFrame:
    """What a source that is asked for ``count`` rows gives: the first ones in its order. The limit is part of the scan's
    plan, so each task gives at most that many."""
    return head(df, order, count)


def bounded_burst(df: DataFrame, burst: str, order: str, capacity: int) -> DataFrame:
    """What a queue of ``capacity`` takes of each burst when nothing is taken out meanwhile: the first rows by arrival; the
    newest are dropped. With ``taken`` for each row. Ranks above the capacity aren't told apart, so a large burst is cut
    in the tasks before it is shuffled."""
    first = df.withColumn("_place", F.row_number().over(Window.partitionBy(burst).orderBy(order))).where(F.col("_place") <= capacity)
    last = first.groupBy(burst).agg(F.max(order).alias("_last"))
    return df.join(last, burst).withColumn("taken", F.col(order) <= F.col("_last")).drop("_last")

def last_match(df: DataFrame, key: str, value: str, order: str, match: Column) -> DataFrame:
    return df.where(match).groupBy(key).agg(F.max_by(value, order).alias(value))


def priority_pick(df: DataFrame, key: str, kind: str, value: str, order: str, priority: Sequence[str]) -> DataFrame:
    """Per key the (last) value of the first kind in a list of priorities that the key has, and that kind."""
    place = F.when(F.lit(False), 0)
    for i, k in enumerate(priority):
        place = place.when(F.col(kind) == k, i)
    ranked = df.withColumn("_place", place).where(F.col("_place").isNotNull())
    return ranked.groupBy(key).agg(
        F.min_by(F.col(kind), F.struct("_place", -F.col(order))).alias("picked_kind"),
        F.min_by(F.col(value), F.struct("_place", -F.col(order))).alias("picked"),
    )


def difference(after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """What is in ``after`` and not in ``before``, each once."""
    return after.select(key).distinct().join(before.select(key), key, "left_anti")


def whitelist(columns: Sequence[str]) -> Column:
    """A map of the named columns that aren't null, as text."""
    entries = F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns))
    return F.map_filter(F.map_from_entries(entries), lambda _, v: v.isNotNull())


def exactly_one(*given: Column) -> Column:
    """Whether exactly one of the arguments is given (neither null nor empty)."""
    return sum((F.when(F.coalesce(F.length(g.cast("string")) > 0, F.lit(False)), 1).otherwise(0) for g in given), F.lit(0)) == 1
