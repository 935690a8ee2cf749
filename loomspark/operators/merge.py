"""Ranked tiers merged field by field with provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiered(tiers: Sequence[tuple[str, DataFrame]], key: str, fields: Sequence[str]) -> DataFrame:
    """key, each field and ``<field>_tier``: the last tier that has a value wins, and is recorded.

    Tiers come in rising order of precedence, with any of the fields and one row a key at most; values of a field are cast to
    the type it has where it comes first.  One union and one map-side aggregate: no chain of joins."""
    types = {f: next(d.schema[f].dataType for _, d in tiers if f in d.columns) for f in fields}
    union = None
    for rank, (tier, df) in enumerate(tiers):
        cols = [F.struct(F.lit(rank).alias("rank"), F.lit(tier).alias("tier"), F.col(f).cast(types[f]).alias("value")).alias(f) if f in df.columns else F.lit(None).cast(f"struct<rank:int,tier:string,value:{types[f].simpleString()}>").alias(f) for f in fields]
        rows = df.select(F.col(key), *cols)
        union = rows if union is None else union.unionByName(rows)
    best = union.groupBy(key).agg(*(F.max_by(F.when(F.col(f"{f}.value").isNotNull(), F.col(f)), F.when(F.col(f"{f}.value").isNotNull(), F.col(f"{f}.rank"))).alias(f) for f in fields))
    return best.select(key, *(c for f in fields for c in (F.col(f"{f}.value").alias(f), F.col(f"{f}.tier").alias(f"{f}_tier"))))


def aliases(rows: DataFrame, key: str, alias: str = "alias", seq: str = "seq", rank: str = "rank") -> DataFrame:
    """One row for each alias of a key: where it came first, and the strongest tier that gave it."""
    return rows.groupBy(key, alias).agg(F.min(seq).alias(seq), F.max(rank).alias(rank))


def sections(rows: DataFrame, key: str, kind: str = "kind", seq: str = "seq", front: str = "front") -> DataFrame:
    """One row for each kind of section of a key: the last one written, at the place of the first; those that are
    put in front come first, the last such one foremost.  ``slot`` orders them."""
    place = F.coalesce(F.min(F.when(F.col(front), -F.col(seq))), F.min(seq))
    rest = [c for c in rows.columns if c not in (key, kind, seq, front)]
    made = rows.groupBy(key, kind).agg(place.alias("slot"), F.max_by(F.struct(*rest), F.col(seq)).alias("__last"))
    return made.select(key, kind, "slot", *(F.col(f"__last.{c}").alias(c) for c in rest))


class ConflictError(ValueError):
    """Tags that give one key several values."""


def refuse_conflicts(facts: DataFrame, key: str) -> DataFrame:
    """The facts of ``fact_tiers``, or ConflictError with the first keys in conflict."""
    bad = facts.where("via = 'conflict'").select(key).orderBy(key).limit(5).collect()  # names for the message
    if bad:
        raise ConflictError(", ".join(str(r[0]) for r in bad))
    return facts


def fact_tiers(tagged: DataFrame, explicit: DataFrame, excluded: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, ``via`` and ``n_values``: members of tags but for the excluded, unless named explicitly.

    A key with several tag values and no explicit one is a conflict: its value is null and ``n_values`` says how many."""
    by_tag = tagged.join(excluded.select(key), key, "left_anti").groupBy(key).agg(F.min(value).alias("__tag"), F.count_distinct(value).alias("n_values"))
    own = explicit.groupBy(key).agg(F.max(value).alias("__own"))
    joined = by_tag.join(own, key, "full_outer")
    single = F.when(F.col("n_values") == 1, F.col("__tag"))
    via = F.when(F.col("__own").isNotNull() & F.col("__tag").isNotNull(), "override").when(F.col("__own").isNotNull(), "explicit").when(F.col("n_values") > 1, "conflict").otherwise("tag")
    return joined.select(key, F.coalesce("__own", single).alias(value), via.alias("via"), F.coalesce("n_values", F.lit(0)).alias("n_values"))
