"""Sections of entities: nested places and their items, where things are found, drops by block, curated parts attached."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested_items(rows: DataFrame, place: str, container: str, fields: Sequence[str], chance: str, name: str) -> DataFrame:
    """place and containers: an array of (container, items), items by falling chance, then name, then the other fields."""
    item = F.struct((-F.col(chance)).alias("__order"), *(F.col(c) for c in dict.fromkeys([name, *fields, chance])))
    one = rows.groupBy(place, container).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[c].alias(c) for c in [*fields, chance]))).alias("items"))
    return one.groupBy(place).agg(F.array_sort(F.collect_list(F.struct(container, "items"))).alias("containers"))


def found_in(producers: DataFrame, sources: DataFrame, output: str, source: str, families: Sequence[str]) -> DataFrame:
    """output and found: the distinct references of the first family (in that order) that a source of the output is of, in the
    order of their first producer.  ``producers`` has seq; ``sources`` has the source, family and reference."""
    order = F.array_position(F.array(*map(F.lit, families)), F.col("family"))
    each = producers.join(sources, source).withColumn("__rank", order).where("__rank > 0")
    refs = each.groupBy(output, "__rank", "family", "reference").agg(F.min("seq").alias("seq"))
    by = refs.groupBy(output, "__rank", "family").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reference"))), lambda x: x["reference"]).alias("found"))
    return by.groupBy(output).agg(F.min_by(F.struct("family", "found"), "__rank").alias("b")).select(output, "b.family", "b.found")


def ordered_distinct(rows: DataFrame, key: str, value: str, seq: str, note: Column | None = None) -> DataFrame:
    """key, values: the distinct values of a key in the order they came first, and the first note that is not null."""
    first = rows.groupBy(key, value).agg(F.min(seq).alias("__seq"), *([F.min(F.when(note.isNotNull(), F.struct(F.col(seq), note.alias("note")))).alias("__n")] if note is not None else []))
    lists = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__seq", value))), lambda x: x[value]).alias("values"), *([F.min("__n")["note"].alias("note")] if note is not None else []))
    return lists


def attached(entities: DataFrame, parts: DataFrame, key: str, may: Column, tier: str) -> tuple[DataFrame, DataFrame]:
    """The entities with the section of ``parts`` (key, section) and its tier where ``may`` allows it, and the parts that found
    no such entity, with the reason."""
    joined = parts.join(entities.withColumn("__may", may), key, "left")
    ok = F.coalesce(F.col("__may"), F.lit(False))
    rejects = joined.where(~ok).select(key, "section", F.when(F.col("__may").isNull(), "no such entity").otherwise("not allowed").alias("reason"))
    good = joined.where(ok).select(key, "section", F.lit(tier).alias("tier"))
    return entities.join(good, key, "left"), rejects


def registry_counts(rows: DataFrame, registry: str, icon: Column) -> DataFrame:
    """registry, total, iconed and missing."""
    return rows.groupBy(registry).agg(F.count("*").alias("total"), F.count_if(icon.isNotNull()).alias("iconed"), F.count_if(icon.isNull()).alias("missing"))


def others(rows: DataFrame, key: str, group: str) -> DataFrame:
    """key and others: the members of its group but for itself."""
    sets = rows.groupBy(group).agg(F.array_sort(F.collect_set(key)).alias("__all"))
    return rows.join(sets, group).select(key, group, F.array_except("__all", F.array(key)).alias("others"))


def collected(rows: DataFrame, key: str, lists: str) -> DataFrame:
    """key and the sorted union of its lists."""
    return rows.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(lists)))).alias(lists))


def last_notes(rows: DataFrame, notes: DataFrame, keys: Sequence[str], note: str, seq: str) -> DataFrame:
    """The rows with the last note of their keys, null where there is none."""
    last = notes.groupBy(*keys).agg(F.max_by(note, seq).alias(note))
    return rows.join(last, list(keys), "left")


def section_facts(rows: DataFrame, key: str, places: str, items: str) -> DataFrame:
    """key, how many places (an array) its section has, and how many distinct items they hold (an array within each)."""
    held = F.array_distinct(F.flatten(F.transform(places, lambda p: p[items])))
    return rows.select(key, F.size(places).alias("n_places"), F.size(held).alias("n_items"))


def borrowed(rows: DataFrame, known: DataFrame, key: str, icon: str, lender: str) -> DataFrame:
    """key and icon: its own, or that of the entity it borrows from; raises where neither has one."""
    own = known.select(F.col(key).alias("__k"), F.col(icon).alias("__own"))
    lent = known.select(F.col(key).alias("__l"), F.col(icon).alias("__lent"))
    made = rows.select(key, lender).join(own, F.col(key) == F.col("__k"), "left").join(lent, F.col(lender) == F.col("__l"), "left").select(key, F.coalesce("__own", "__lent").alias(icon))
    bad = made.where(F.col(icon).isNull()).select(key).orderBy(key).limit(5).collect()  # names for the message
    if bad:
        raise ValueError("no icon: " + ", ".join(str(r[0]) for r in bad))
    return made


def merged(names: DataFrame, alias_rows: DataFrame, section_rows: DataFrame, overrides: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row an entity: its fields with their tiers (A from ``names``, C from ``overrides``), its aliases by strength and name, and its
    sections in their slots.  Each part is aggregated by the key on its own and joined once."""
    from . import merge

    base = merge.tiered([("A", names), ("C", overrides)], key, fields)
    one = merge.aliases(alias_rows, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "alias"))), lambda x: x["alias"]).alias("aliases"))
    two = merge.sections(section_rows, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "kind"))), lambda x: x["kind"]).alias("sections"))
    return base.join(one, key, "left").join(two, key, "left")


def write_reports(reports: dict[str, DataFrame], at: str) -> None:
    """Each report as a folder of JSON below ``at``; a report of an earlier build is replaced."""
    for name, df in reports.items():
        df.write.mode("overwrite").json(f"{at.rstrip('/')}/{name}")
