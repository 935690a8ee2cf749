"""Names to ids: one prioritised cascade, its ambiguities, and the checks that two tables cover each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidates(asked: DataFrame, levels: Sequence[Column], name: str = "name") -> DataFrame:
    """``asked`` once for each level: ``level`` (from 0) and ``key``, the name to look up; null keys are left out."""
    keys = F.array(*(F.struct(F.lit(i).alias("level"), k.alias("key")) for i, k in enumerate(levels)))
    return asked.select(name, F.inline(keys)).where(F.col("key").isNotNull()).distinct()


def priority_join(asked: DataFrame, levels: Sequence[Column], names: DataFrame, name: str = "name", unique: bool = False) -> DataFrame:
    """name, level, n_ids, id: the ids (of ``names``: key, id) found at the first level that finds any.

    With ``unique``, a level is only taken if it finds exactly one id, as long as a later one may; ``id`` is null where no level
    is taken.  One join serves all levels, and the best level is chosen by a map-side aggregate."""
    asked = asked.select(name).distinct()
    found = candidates(asked, levels, name).join(names.select("key", "id").distinct(), "key").select(name, "level", "id").distinct()
    counted = found.groupBy(name, "level").agg(F.count("*").alias("n_ids"))
    best = (counted.where("n_ids = 1") if unique else counted).groupBy(name).agg(F.min(F.struct("level", "n_ids")).alias("b")).select(name, F.col("b.level").alias("level"), F.col("b.n_ids").alias("n_ids"))
    return asked.join(best.join(found, [name, "level"]), name, "left").select(name, "level", "n_ids", "id")


def ambiguous(names: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    """Names with several ids: n_ids, the smallest and the largest, and all of them in order (of these names alone)."""
    many = names.groupBy(*by).agg(F.count_distinct(id_col).alias("n_ids"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).where("n_ids > 1")
    ids = names.join(many.select(*by), list(by), "left_semi").groupBy(*by).agg(F.array_sort(F.collect_set(id_col)).alias("ids"))
    return many.join(ids, list(by))


def reused(names: DataFrame, by: Sequence[str], id_col: str, page: str) -> DataFrame:
    """Names with several pages and several ids."""
    return names.groupBy(*by).agg(F.count_distinct(page).alias("n_pages"), F.count_distinct(id_col).alias("n_ids")).where("n_pages > 1 and n_ids > 1")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and ``side``: matched, left_only or right_only."""
    joined = left.select(key).distinct().withColumn("__l", F.lit(True)).join(right.select(key).distinct().withColumn("__r", F.lit(True)), key, "full_outer")
    return joined.select(key, F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").otherwise("matched").alias("side"))


def unattributed(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``found`` whose key ``known`` lacks."""
    return found.join(known.select(key), key, "left_anti")


def members(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``found`` whose key ``known`` has."""
    return found.join(known.select(key), key, "left_semi")


def reverse_edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges that exist in both directions (loops are left out)."""
    swapped = edges.select(F.col(dst).alias(src), F.col(src).alias(dst))
    return edges.where(F.col(src) != F.col(dst)).join(swapped, [src, dst], "left_semi")


def best_of(pairs: DataFrame, by: Sequence[str], value: str, level: str = "level", unique: bool = True) -> DataFrame:
    """by, level and value of the best level of candidate rows (the smallest; with ``unique``, the smallest that has one distinct
    value alone).  Null levels are no candidates."""
    counted = pairs.where(F.col(level).isNotNull()).groupBy(*by, level).agg(F.count_distinct(value).alias("__n"), F.min(value).alias(value))
    if unique:
        return counted.where("__n = 1").groupBy(*by).agg(F.min(level).alias(level), F.min_by(value, level).alias(value))
    best = counted.groupBy(*by).agg(F.min(level).alias(level))
    return pairs.select(*by, level, value).distinct().join(best, [*by, level])


def by_routes(asked: DataFrame, routes: Sequence[tuple[str, Column]], known: DataFrame, name: str = "name") -> DataFrame:
    """name, route, id, n_ids and tried: the first route (name, key) that ``known`` (key, id) has, how many ids it finds there (an
    ambiguous one has no id), and the routes tried until then; null keys are no attempt."""
    keys = [k for _, k in routes]
    labels = F.array(*(F.lit(r) for r, _ in routes))
    found = candidates(asked, keys, name).join(known.select("key", "id").distinct(), "key").groupBy(name, "level").agg(F.count_distinct("id").alias("n_ids"), F.min("id").alias("id"))
    best = found.groupBy(name).agg(F.min(F.struct("level", "n_ids", "id")).alias("b"))
    tried = F.filter(F.transform(F.array(*(F.struct(F.lit(i).alias("i"), k.isNotNull().alias("some")) for i, k in enumerate(keys))), lambda x: F.when(x["some"] & (x["i"] <= F.coalesce("b.level", F.lit(len(keys)))), F.get(labels, x["i"]))), lambda x: x.isNotNull())
    out = asked.distinct().join(best, name, "left")
    return out.select(name, F.get(labels, F.col("b.level")).alias("route"), F.when(F.col("b.n_ids") == 1, F.col("b.id")).alias("id"), F.col("b.n_ids").alias("n_ids"), tried.alias("tried"))


def registries_of(rows: DataFrame, key: str, registry: str, rank: str, name: str) -> DataFrame:
    """key, part, registries and names: the registries of an id in their order.  Where the names in the first one share none with
    those in the others, the id is two entities: ``part`` 0 is the first registry's, 1 that of the others."""
    each = rows.groupBy(key, rank, registry).agg(F.array_sort(F.collect_set(name)).alias("__names"))
    by = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(registry).alias("registry"), F.col("__names").alias("names")))).alias("r"))
    first, rest = F.get("r", F.lit(0)), F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0)))
    other = F.array_sort(F.array_distinct(F.flatten(F.transform(rest, lambda x: x["names"]))))
    split = (F.size(rest) > 0) & (F.size(first["names"]) > 0) & (F.size(other) > 0) & ~F.arrays_overlap(first["names"], other)
    whole = F.array(F.struct(F.lit(0).alias("part"), F.col("r").alias("r")))
    two = F.array(F.struct(F.lit(0).alias("part"), F.array(first).alias("r")), F.struct(F.lit(1).alias("part"), rest.alias("r")))
    made = by.select(key, F.inline(F.when(split, two).otherwise(whole)))
    return made.select(key, "part", F.transform("r", lambda x: x["registry"]).alias("registries"), F.array_sort(F.array_distinct(F.flatten(F.transform("r", lambda x: x["names"])))).alias("names"))


def parents_by_title(pages: DataFrame, title: str, parent: str, key: str, seq: str) -> DataFrame:
    """key, title, parent_id and missing: the parent named by a title; of pages of one title the last counts.  ``missing`` is a
    parent that no page has."""
    ids = pages.groupBy(F.col(title).alias("__t")).agg(F.max_by(key, seq).alias("parent_id"))
    return pages.join(ids, F.col(parent) == F.col("__t"), "left").select(key, title, "parent_id", (F.col(parent).isNotNull() & F.col("parent_id").isNull()).alias("missing"))


def existence(rows: DataFrame, key: str, checks: Sequence[tuple[str, DataFrame]], otherwise: str) -> DataFrame:
    """key and class: the first of the checks (label, table with the key) that knows the key."""
    made, label = rows.select(key).distinct(), F.lit(otherwise)
    for i, (_, known) in enumerate(checks):
        made = made.join(known.select(key).distinct().withColumn(f"__{i}", F.lit(True)), key, "left")
    for i, (name, _) in reversed(list(enumerate(checks))):
        label = F.when(F.col(f"__{i}"), name).otherwise(label)
    return made.select(key, label.alias("class"))


def sole(memberships: DataFrame, key: str, group: str, at_most: bool = False) -> DataFrame:
    """key and its one group; raises for keys with several, and unless ``at_most`` for those with none (a null group)."""
    counted = memberships.groupBy(key).agg(F.count_distinct(group).alias("__n"), F.min(group).alias(group))
    bad = counted.where("__n > 1" if at_most else "__n <> 1").select(key).orderBy(key).limit(5).collect()  # names for the message
    if bad:
        raise ValueError(f"not one {group}: " + ", ".join(str(r[0]) for r in bad))
    return counted.select(key, group)


def edge_flags(producers: DataFrame, output: str, source: str, method: str, count: str, acquired: Sequence[str]) -> DataFrame:
    """The producers (of one input each) with flags: ``acquisition`` by method; ``round_trip``, that the reverse is a producer too;
    ``unpacking``, that it gives several of what packs into its input; ``refining``, that it is smelting."""
    back = producers.select(F.col(output).alias("__s"), F.col(source).alias("__o")).distinct().withColumn("__back", F.lit(True))
    made = producers.join(back, (F.col(output) == F.col("__o")) & (F.col(source) == F.col("__s")) & (F.col("__o") != F.col("__s")), "left")
    again = F.coalesce(F.col("__back"), F.lit(False))
    return made.select(*producers.columns, F.col(method).isin(*acquired).alias("acquisition"), again.alias("round_trip"), (again & (F.col(count) > 1)).alias("unpacking"), (F.col(method) == "smelting").alias("refining"))
