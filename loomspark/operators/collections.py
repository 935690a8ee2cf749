"""Declarative collections: a rule names its members, columns and order are compiled to DataFrame plans."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number_text
from ..session import written
from .ordered import numbered


class EmptyCollection(ValueError):
    """A rule without members."""


class ManifestError(ValueError):
    """A manifest that is not one."""


RULES = ("kind", "list", "tag", "component", "section", "method")


def manifests(documents: Sequence[str]) -> dict[str, dict]:
    """Specs by name of JSON documents ({"id", "rule": {kind of rule: value}, "sort", "columns"}); raises on an unknown rule, on several,
    on an empty list, on unknown fields and on two of one name."""
    out: dict[str, dict] = {}
    for text in documents:
        made = json.loads(text)
        rule = made.get("rule")
        if not isinstance(made.get("id"), str) or not isinstance(rule, dict) or len(rule) != 1 or not set(rule) <= set(RULES):
            raise ManifestError(f"no id, or not one known rule: {text[:80]}")
        if set(made) - {"id", "rule", "sort", "descending", "columns", "aliases"} or rule.get("list") == [] or made["id"] in out:
            raise ManifestError(f"unknown fields, an empty list, or a second {made['id']}")
        out[made["id"]] = {k: v for k, v in made.items() if k != "id"}
    return out


def entities_of(specs: Mapping[str, Mapping], entities: DataFrame, facts: Mapping[str, DataFrame]) -> DataFrame:
    """collection, n_members, members (ids in the order of the collection) and its aliases.  Raises for a collection without members, and
    where a list names an id that is no entity."""
    for name, spec in specs.items():
        if "list" in spec["rule"]:
            known = {r.id for r in entities.where(F.col("id").isin(list(spec["rule"]["list"]))).select("id").collect()}  # as many as the list
            if missing := sorted(set(spec["rule"]["list"]) - known):
                raise EmptyCollection(f"{name} lists what is no entity: {missing[:5]}")
    rows = resolve(specs, entities, facts, strict=True)
    by = rows.groupBy("collection").agg(F.count("*").alias("n_members"), F.transform(F.array_sort(F.collect_list(F.struct("sort_key", "id"))), lambda x: x["id"]).alias("members"))
    alias = F.coalesce(*(F.when(F.col("collection") == n, F.array(*map(F.lit, s["aliases"]))) for n, s in specs.items() if s.get("aliases")), F.array().cast("array<string>"))
    return by.withColumn("aliases", alias)


def members(rule: Mapping, entities: DataFrame, facts: Mapping[str, DataFrame]) -> DataFrame:
    """Ids of the entities (columns id, kind, name) that a rule picks.

    Rules: {'kind': k}, {'list': [ids]}, {'tag': t}, {'component': c}, {'section': s}, {'method': m}.  The last four read
    facts[rule] with the columns id and value."""
    ((what, value),) = rule.items()
    if what == "kind":
        return entities.where(F.col("kind") == value).select("id")
    if what == "list":
        return entities.where(F.col("id").isin(list(value))).select("id")
    if what in ("tag", "component", "section", "method"):
        return entities.join(facts[what].where(F.col("value") == value).select("id"), "id", "left_semi").select("id")
    raise ValueError(f"unknown rule {what}")


def resolve(specs: Mapping[str, Mapping], entities: DataFrame, facts: Mapping[str, DataFrame], strict: bool = False) -> DataFrame:
    """collection, id, name, sort_key of all specs ({'rule': ..., 'sort': 'name' or a column}); with ``strict`` an empty one raises."""
    out = None
    for name, spec in specs.items():
        picked = members(spec["rule"], entities, facts).select(F.lit(name).alias("collection"), "id")
        sort = spec.get("sort", "name")
        rows = picked.join(entities, "id").select("collection", "id", "name", F.lower(F.col(sort).cast("string")).alias("sort_key"))
        if strict and rows.isEmpty():
            raise EmptyCollection(name)
        out = rows if out is None else out.unionByName(rows)
    return out


#: Facts that columns may show.  Of sections: the section, its attribute, and how it is shown ('plain', 'percent', 'time' of
#: ticks, 'operations' of ticks, 'reference'); of loot: what is counted; of producers: the field and the method.
SECTION_FACTS = {
    "food.nutrition": ("FoodInfo", "nutrition", "plain"), "food.saturation": ("FoodInfo", "saturation", "plain"), "enchant.maxLevel": ("EnchantInfo", "max_level", "plain"), "compost.chance": ("CompostInfo", "chance", "percent"), "fuel.burnTime": ("FuelInfo", "burn_time", "time"),
    "fuel.operations": ("FuelInfo", "burn_time", "operations"), "profession.workstation": ("ProfessionInfo", "workstation", "reference"), "profession.tradeCount": ("ProfessionInfo", "trade_count", "plain"),
}
LOOT_FACTS = {"chest.containers": "containers", "chest.items": "items"}
OBTAIN_FACTS = {"obtain.chance": ("chance", "bartering"), "obtain.stackRange": ("range", "bartering"), "obtain.perAttempt": ("attempt", "bartering")}
OTHER_FACTS = ("obtain.foundIn",)


def _shown(number: Column, text: Column, how: Column) -> Column:
    ticks = lambda n: number_text(F.round(number / n, 2))
    plain = F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))
    of_number = F.when(how == "percent", F.concat(plain, F.lit("%"))).when(how == "time", F.concat(ticks(20), F.lit("s"))).when(how == "operations", ticks(200)).otherwise(number_text(F.round(number, 2)))
    return F.when(number.isNotNull(), of_number).when(how == "percent", F.concat(text, F.lit("%"))).when(how == "time", F.concat(text, F.lit("s"))).otherwise(text)


def fact_values(keys: Sequence[str], sections: DataFrame, loot: DataFrame, producers: DataFrame, found_in: DataFrame) -> DataFrame:
    """id, fact, text and ref of all facts that are asked for: each family of facts is read once, in one aggregate.

    ``sections``: id, section, attr, number, text, ref (one row an attribute; of several sections of one type the first by ``seq``);
    ``loot``: id, container, item; ``producers``: id, method, chance, per_attempt, count, count_max; ``found_in``: id, text, ref.
    A reference where the fact is no reference, or the other way round, raises.  Producers without odds show nothing."""
    unknown = [k for k in keys if k not in SECTION_FACTS and k not in LOOT_FACTS and k not in OBTAIN_FACTS and k not in OTHER_FACTS]
    if unknown:
        raise ManifestError(f"unknown facts: {unknown}")
    none = F.lit(None).cast("string")
    parts = [found_in.where(F.lit("obtain.foundIn" in keys)).select("id", F.lit("obtain.foundIn").alias("fact"), "text", "ref")]
    asked = [(k, *SECTION_FACTS[k]) for k in keys if k in SECTION_FACTS]
    if asked:
        spec = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(a, ("fact", "section", "attr", "how"), strict=True))) for a in asked))
        first = sections.where(F.col("section").isin(*{a[1] for a in asked})).groupBy("id", "section", "attr").agg(F.min_by(F.struct("number", "text", "ref"), "seq").alias("v"))
        met = first.withColumn("s", F.explode(F.filter(spec, lambda x: (x["section"] == F.col("section")) & (x["attr"] == F.col("attr")))))
        how, is_ref = F.col("s.how"), F.col("v.ref").isNotNull()
        wrong = is_ref != (how == "reference")
        text = F.when(wrong & (is_ref | F.col("v.number").isNotNull() | F.col("v.text").isNotNull()), F.raise_error(F.concat(F.lit("a reference and a value are mixed up in "), F.col("s.fact"))).cast("string")).when(~is_ref, _shown(F.col("v.number"), F.col("v.text"), how))
        parts.append(met.select("id", "s.fact", text.alias("text"), F.col("v.ref").alias("ref")))
    counted = [k for k in keys if k in LOOT_FACTS]
    if counted:
        n = loot.groupBy("id").agg(F.count_distinct("container").alias("containers"), F.count_distinct("item").alias("items"))
        parts.append(n.select("id", F.inline(F.array(*(F.struct(F.lit(k).alias("fact"), F.col(LOOT_FACTS[k]).cast("string").alias("text"), none.alias("ref")) for k in counted)))))
    odds = [k for k in keys if k in OBTAIN_FACTS]
    if odds:
        by = producers.where(F.col("chance").isNotNull() & F.col("method").isin(*{OBTAIN_FACTS[k][1] for k in odds})).groupBy("id", "method").agg(F.sum("chance").alias("chance"), F.coalesce(F.sum("per_attempt"), F.lit(0.0)).alias("attempt"), F.min("count").alias("least"), F.max(F.coalesce("count_max", "count")).alias("most"))
        least, most = F.col("least").cast("string"), F.col("most").cast("string")
        shown = {"chance": F.concat(F.format_string("%.3f", F.col("chance") * 100), F.lit("%")), "attempt": F.format_string("%.3f", F.col("attempt")), "range": F.when(least == most, least).otherwise(F.concat(least, F.lit("-"), most))}
        made = F.array(*(F.struct(F.lit(k).alias("fact"), F.lit(OBTAIN_FACTS[k][1]).alias("m"), shown[OBTAIN_FACTS[k][0]].alias("text"), none.alias("ref")) for k in odds))
        parts.append(by.withColumn("s", F.explode(made)).where("s.m = method").select("id", "s.fact", "s.text", "s.ref"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.where("text is not null or ref is not null")


def tables_of(specs: Mapping[str, Mapping], entities: DataFrame, facts: Mapping[str, DataFrame], values: DataFrame) -> DataFrame:
    """collection, place, id, name, values and refs (by fact) of the members of all specs, whose ``columns`` name facts.

    ``sort`` is 'name' or one of the columns, ``descending`` turns it.  By a fact, numbers (a trailing % or s is dropped) come first, in
    their direction, then other texts, then members without it, always up; what is equal goes by name, then by id."""
    rows = None
    for name, spec in specs.items():
        sort = spec.get("sort", "name")
        if sort != "name" and sort not in spec.get("columns", ()):
            raise ManifestError(f"{name} is sorted by {sort}, which is no column of it")
        picked = members(spec["rule"], entities, facts)
        one = picked.select(F.lit(name).alias("collection"), "id", F.lit(sort).alias("__sort"), F.lit(bool(spec.get("descending"))).alias("__down"), F.array(*map(F.lit, spec.get("columns", ()))).cast("array<string>").alias("__columns"))
        rows = one if rows is None else rows.unionByName(one)
    named = written(rows.join(entities.select("id", "name"), "id"), "members")
    cells = named.select("collection", "id", F.explode("__columns").alias("fact")).join(values, ["id", "fact"])
    lists = cells.groupBy("collection", "id").agg(F.map_from_entries(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("fact", "text")))).alias("values"), F.map_from_entries(F.collect_list(F.when(F.col("ref").isNotNull(), F.struct("fact", "ref")))).alias("refs"))  # as many as columns
    empty = F.create_map().cast("map<string,string>")
    full = named.join(lists, ["collection", "id"], "left").withColumns({"values": F.coalesce("values", empty), "refs": F.coalesce("refs", empty)})
    raw, by_name = F.try_element_at("values", F.col("__sort")), F.col("__sort") == "name"
    number = F.regexp_replace(F.regexp_replace(raw, "%$", ""), "s$", "").try_cast("double")
    bucket = F.when(by_name, 0).when(F.coalesce(raw, F.lit("")) == "", 2).when(number.isNotNull(), 0).otherwise(1)
    sign = F.when(F.col("__down"), -1.0).otherwise(1.0)
    keyed = full.withColumns({"__b": bucket, "__n": F.when(by_name | (bucket != 0), 0.0).otherwise(sign * number), "__t": F.when(~by_name & (bucket == 1), F.lower(raw)).otherwise(F.lower("name"))})
    placed = numbered(keyed, ["collection"], ["__b", "__n", "__t", "id"], "__up")
    n = placed.groupBy("collection").agg(F.count("*").alias("__all"))
    place = F.when(by_name & F.col("__down"), F.col("__all") + 1 - F.col("__up")).otherwise(F.col("__up"))
    return placed.join(n, "collection").select("collection", place.alias("place"), "id", "name", "values", "refs")
