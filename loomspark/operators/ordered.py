"""Ordered operations: numbering without a hot task, top k, islands, forward fill with resets, mixed sorts, shards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _ranges(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows dealt out by ranges of group and order, written, with the number of their range in ``__part``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *group, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def _with_earlier(within: DataFrame, earlier: DataFrame, group: Sequence[str], carried: str) -> DataFrame:
    """``within`` joined with what ``earlier`` (``__part``, group, ``carried``) says for its range and group.  Only a group that goes on
    from one range into the next carries something over: at most one row a range, which is broadcast."""
    other = earlier.where(F.col(carried).isNotNull()).select(F.col("__part").alias("__p"), *(F.col(g).alias(f"__g_{g}") for g in group), carried)
    return within.join(F.broadcast(other), [F.col("__part") == F.col("__p"), *(F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group)], "left")


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """``name``: the number (from 1) of each row in its group by ``order``, whose last column must make it unique.

    Rows are dealt out by ranges of group and order; each range numbers its own and adds the sizes of those before, so that a
    group of any size is spread over many tasks."""
    dealt = _ranges(df, group, order)
    sizes = dealt.groupBy("__part", *group).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    within = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order)))
    return _with_earlier(within, sizes.select("__part", *group, before.alias("__before")), group, "__before").select(*df.columns, (F.col("__n") + F.coalesce("__before", F.lit(0))).alias(name))


def previous(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``name``: the value of the row before in its group, null in the first.  Each range of rows looks at its own; its first row takes
    what the range before it ends with."""
    dealt = _ranges(df.withColumn("__value", F.struct(value.alias("v"))), group, order)
    within = dealt.withColumn("__own", F.lag("__value").over(Window.partitionBy("__part", *group).orderBy(*order)))
    ends = dealt.groupBy("__part", *group).agg(F.max_by("__value", F.struct(*order)).alias("__end"))
    carried = F.lag("__end").over(Window.partitionBy(*group).orderBy("__part"))
    joined = _with_earlier(within, ends.select("__part", *group, carried.alias("__carried")), group, "__carried")
    return joined.select(*df.columns, F.coalesce("__own", "__carried")["v"].alias(name))


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` of each group; the limit is applied before the shuffle too."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def islands(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """first, last and n of each run of whole numbers that follow each other."""
    rows = numbered(df.select(*group, value).distinct(), group, [value], "__n")
    return rows.groupBy(*group, (F.col(value) - F.col("__n")).alias("__island")).agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("__island")


def scope_fill(df: DataFrame, group: Sequence[str], order: Sequence[str], sets: Column, resets: Column, value: Column, name: str) -> DataFrame:
    """``name``: the value of the last row that set the scope, null before any and after a reset."""
    return scope_fills(df, group, order, {name: (sets, resets, value)})


def scope_fills(df: DataFrame, group: Sequence[str], order: Sequence[str], scopes: Mapping[str, tuple[Column, Column, Column]]) -> DataFrame:
    """A column for each of ``scopes`` (name: sets, resets and value), filled as by ``scope_fill``, all in one pass.

    Each range of rows fills its own; what the ranges before it end with is carried over."""
    marks = {f"__mark_{n}": F.when(sets, F.struct(value.alias("v"))).when(resets, F.struct(F.lit(None).alias("v"))) for n, (sets, resets, value) in scopes.items()}
    dealt = _ranges(df.withColumns(marks), group, order)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    above = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.withColumns({f"__own_{n}": last(f"__mark_{n}", above) for n in scopes})
    ends = dealt.groupBy("__part", *group).agg(*(F.max_by(f"__mark_{n}", F.when(F.col(f"__mark_{n}").isNotNull(), F.struct(*order))).alias(f"__end_{n}") for n in scopes))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select("__part", *group, *(last(f"__end_{n}", before).alias(f"__end_{n}") for n in scopes))
    carried = F.when(reduce(Column.__or__, [F.col(f"__end_{n}").isNotNull() for n in scopes]), F.struct(*(f"__end_{n}" for n in scopes)))
    joined = _with_earlier(within, earlier.select("__part", *group, carried.alias("__carried")), group, "__carried")
    return joined.select(*df.columns, *(F.coalesce(F.col(f"__own_{n}"), F.col(f"__carried.__end_{n}"))["v"].alias(n) for n in scopes))


def declared(value: Column, order: Sequence[str], unknown: int = 999) -> Column:
    """Place of a value in a declared order; those that are not in it come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)) - 1, F.lit(unknown)).cast("int")


def last_if(flags: Sequence[Column], seq: str) -> list[Column]:
    """Sort keys that put rows with a flag last, for each flag in turn, and leave all else in the order of ``seq``."""
    return [F.coalesce(f, F.lit(False)).asc() for f in flags] + [F.col(seq).asc()]


def mixed_order(value: Column, descending: bool = False) -> list[Column]:
    """Sort keys of a text column: numbers first (a trailing % or s is dropped), then other text, blanks last either way."""
    number = F.regexp_replace(F.regexp_replace(F.trim(value), "%$", ""), "s$", "").try_cast("double")
    bucket = F.when(number.isNotNull(), 0).when(F.coalesce(F.trim(value), F.lit("")) != "", 1).otherwise(2)
    text = F.when(bucket == 1, F.lower(value))
    return [bucket.asc(), number.desc_nulls_last() if descending else number.asc_nulls_last(), text.desc_nulls_last() if descending else text.asc_nulls_last()]


def shards(df: DataFrame, kind: str, order: Sequence[str], size: int = 200) -> DataFrame:
    """``shard``: ``kind-i`` for each ``size`` rows of a kind in order."""
    made = numbered(df, [kind], order, "__at")
    return made.select(*df.columns, F.concat_ws("-", F.col(kind), F.floor((F.col("__at") - 1) / size).cast("string")).alias("shard"))
