"""Pool odds, expected yields, shares, range aggregates over scopes, level costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share_of(df: DataFrame, by: Sequence[str], amount: Column, name: str) -> DataFrame:
    """``amount`` over the sum of its group; null where the sum is 0.  The sums are aggregated map-side and joined, so that a
    group with a third of all rows is split by the skew join and never sorted in one task, as a window would."""
    total = df.groupBy(*(F.col(c).alias(f"__by_{c}") for c in by)).agg(F.sum(amount).alias("__total"))
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    return df.join(total, same).select(*df.columns, (amount / F.nullif(F.col("__total"), F.lit(0.0))).alias(name))


def pool_odds(entries: DataFrame, pool: Sequence[str], weight: str, eligible: Column | None = None) -> DataFrame:
    """``chance`` of each entry: the denominator counts all entries of the pool, the others' odds are null."""
    made = share_of(entries, pool, F.col(weight), "chance")
    return made if eligible is None else made.withColumn("chance", F.when(eligible, F.col("chance")))


def per_attempt(chance: Column, rolls: Column, least: Column, most: Column) -> Column:
    """Expected number of items of one attempt."""
    return chance * rolls * (least + most) / 2


def group_index(df: DataFrame, key: str, order: Sequence[str], value: str, keep: int) -> DataFrame:
    """n_rows, first and last value of each group by ``order``, and ``firsts``: the ``keep`` first values in order.  No more than these
    are gathered of a group."""
    from .ordered import top_k

    at = F.struct(*order)
    ends = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.min_by(value, at).alias("first_id"), F.max_by(value, at).alias("last_id"))
    few = top_k(df, [key], [F.col(c) for c in order], keep, "__rank").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", F.col(value).alias("v")))), lambda x: x["v"]).alias("firsts"))
    return ends.join(few, key)


def scope(df: DataFrame, by: Sequence[str], value: str, tries: Column, chance: Column, flag: Column, member: str) -> DataFrame:
    """Range of a value, sum of tries where there is no chance, whether a flag always holds, and distinct members."""
    return df.groupBy(*by).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.sum(F.when(chance.isNull(), tries)).alias("tries"), F.bool_and(flag).alias("always"), F.count_distinct(member).alias("n_members"))


def agreed(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """The value of a group if all its rows that have one agree, else null."""
    return df.groupBy(*by).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias("agreed"))


def level_costs(df: DataFrame, key: str, levels: str, base: Column, step: Column, width: Column) -> DataFrame:
    """key, level (from 1), min_cost and max_cost for each level up to ``levels``."""
    made = df.where(F.col(levels) >= 1).select(key, base.alias("__b"), step.alias("__s"), width.alias("__w"), F.explode(F.sequence(F.lit(1), F.col(levels))).alias("level"))
    return made.select(key, "level", (F.col("__b") + F.col("__s") * (F.col("level") - 1)).alias("min_cost"), (F.col("__b") + F.col("__s") * (F.col("level") - 1) + F.col("__w")).alias("max_cost"))


def middle(low: Column, high: Column) -> Column:
    """The whole number in the middle, rounded down for negative sums too."""
    return F.floor((low + high) / 2)
