"""Facts of the world: drops by level, trades, biomes, structures, enchantments, placements, harvests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FactError(ValueError):
    """A fact that cannot be read."""


def ratio(value: Column) -> tuple[Column, Column]:
    """(numerator, denominator) of an exact ratio, "1/40" or a whole number."""
    top = F.regexp_extract(value, r"^(-?\d+)(?:/(\d+))?$", 1).try_cast("long")
    return top, F.coalesce(F.regexp_extract(value, r"^(-?\d+)(?:/(\d+))?$", 2).try_cast("long"), F.when(top.isNotNull(), F.lit(1)))


LEVEL = "struct<min:int,max:int,average:string,dropchance:string,distribution:map<string,string>>"


def drop_levels(rows: DataFrame, key: Sequence[str], levels: str, most: int = 3) -> DataFrame:
    """key, level, least, most, average and chance (exact, as numerator and denominator) and the distribution's sum, which is 1 where it
    is whole.  Raises for levels outside 0 to ``most``."""
    made = rows.select(*key, F.explode(F.from_json(levels, f"map<string,{LEVEL}>")).alias("level", "l")).withColumn("level", F.col("level").try_cast("int"))
    if not made.where(F.col("level").isNull() | ~F.col("level").between(0, most)).isEmpty():
        raise FactError(f"a level outside 0 to {most}")
    (a, b), (c, d) = ratio(F.col("l.average")), ratio(F.col("l.dropchance"))
    share = F.aggregate(F.transform(F.map_values("l.distribution"), lambda x: ratio(x)[0] / ratio(x)[1]), F.lit(0.0), lambda s, x: s + x)
    return made.select(*key, "level", F.col("l.min").alias("least"), F.col("l.max").alias("most"), a.alias("average_n"), b.alias("average_d"), c.alias("chance_n"), d.alias("chance_d"), F.round(share, 9).alias("share"))


def drop_notes(rows: DataFrame, key: Sequence[str], notes: str, mine: str, other: str) -> DataFrame:
    """key, place and text of the notes of a map by number, in the order of the numbers.  A note is flat or split by edition: then
    the side ``mine`` counts, and one that only the ``other`` edition has is none.  An empty list is no notes."""
    side = "struct<name:string,content:string>"
    parsed = F.from_json(F.when(~F.col(notes).startswith("["), F.col(notes)), f"map<string,struct<name:string,content:string,{mine}:{side},{other}:{side}>>")
    entries = F.transform(F.map_entries(parsed), lambda e: F.struct(F.coalesce(e["key"].try_cast("int"), F.lit(0)).alias("n"), e["key"].alias("k"), F.coalesce(e["value"]["content"], e["value"][mine]["content"]).alias("text")))
    ordered = F.filter(F.array_sort(entries), lambda e: F.trim(F.coalesce(e["text"], F.lit(""))) != "")
    return rows.select(*key, F.posexplode(ordered).alias("place", "e")).select(*key, "place", F.trim("e.text").alias("text"))


def probability(text: Column) -> tuple[Column, Column]:
    """(low, high) of "67%" and of "50%-67%"; nulls where it is neither."""
    shape = r"^\s*(\d+(?:\.\d+)?)\s*%(?:\s*[-–]\s*(\d+(?:\.\d+)?)\s*%)?\s*$"
    low = F.regexp_extract(text, shape, 1).try_cast("double") / 100
    return low, F.coalesce(F.regexp_extract(text, shape, 2).try_cast("double") / 100, low)


def trades(rows: DataFrame, key: Sequence[str], wanted: Sequence[tuple[str, str]], given: tuple[str, str], chance: str) -> tuple[DataFrame, DataFrame]:
    """key, side ('wanted' or 'given'), place, item, least, most, low and high of the trades that can happen, and the ledger of the
    others.  A quantity is one where none is said; a quantity without an item is nothing."""
    from ..functions.text import int_range

    low, high = probability(F.col(chance))
    reason = F.when(F.col(given[0]).isNull(), "gives nothing").when(low.isNull(), "no probability").when(high == 0, "never happens")
    made = rows.withColumn("__why", reason)
    sides = [("wanted", i, *w) for i, w in enumerate(wanted)] + [("given", 0, *given)]
    one = lambda side, place, item, n: F.when(F.col(item).isNotNull(), F.struct(F.lit(side).alias("side"), F.lit(place).alias("place"), F.col(item).alias("item"), F.coalesce(int_range(F.col(n))[0], F.lit(1)).alias("least"), F.coalesce(int_range(F.col(n))[1], F.lit(1)).alias("most")))
    each = made.where("__why is null").select(*key, low.alias("low"), high.alias("high"), F.inline(F.array_compact(F.array(*(one(*s) for s in sides)))))
    return each, made.where("__why is not null").select(*key, F.col("__why").alias("reason"))


def precipitation(falls: Column, temperature: Column) -> Column:
    return F.when(~falls, "none").when(temperature < 0.15, "snow").otherwise("rain")


def spawners(rows: DataFrame, by: Sequence[str], weight: str, least: str, most: str) -> DataFrame:
    """by (the last of which is the mob), weight, least, most and share of all weights of the others of ``by``, in the order of
    falling weight within them (``place``)."""
    from .odds import share_of
    from .ordered import numbered

    group = list(by[:-1])
    made = rows.groupBy(*by).agg(F.sum(weight).alias("weight"), F.min(least).alias("least"), F.max(most).alias("most"))
    placed = numbered(made.withColumn("__w", -F.col("weight")), group, ["__w", by[-1]], "place").drop("__w")
    return share_of(placed, group, F.col("weight").cast("double"), "share")


def siblings(sets: DataFrame, structures: DataFrame, key: str, group: str) -> DataFrame:
    """key, group and sibling: the other members of each set that a structure is in; one row with none where it is alone."""
    other = sets.select(F.col(group), F.col(key).alias("sibling"))
    both = structures.select(key).join(sets, key).join(other, group).where(F.col(key) != F.col("sibling"))
    return structures.select(key).join(both, key, "left").select(key, group, "sibling")


# The rarity of an enchantment by its weight.
RARITY = ((10, "common"), (5, "uncommon"), (2, "rare"), (1, "very rare"))


def rarity(weight: Column) -> Column:
    chain = None
    for w, name in RARITY:
        chain = F.when(weight >= w, name) if chain is None else chain.when(weight >= w, name)
    return chain


def anchor(kind: Column, value: Column, bottom: Column, height: Column) -> Column:
    """Height of an anchor: absolute, above the bottom, or below the top."""
    return F.when(kind == "absolute", value).when(kind == "above_bottom", bottom + value).when(kind == "below_top", bottom + height - 1 - value)


def band(low: Column, high: Column, bottom: Column, height: Column, trapezoid: Column) -> Column:
    """least, most (held within the world) and peak (the floor of the middle of the unheld band) of a placement."""
    top = bottom + height - 1
    held = lambda y: F.least(F.greatest(y, bottom), top)
    return F.struct(held(low).alias("least"), held(high).alias("most"), F.when(trapezoid, F.floor((low + high) / 2)).alias("peak"))


def rate(modifiers: Column) -> Column:
    """tries (product of counts) and chance (product of 1 / rarity, null without any) of the modifiers (kind, n) before the first that
    places."""
    at = F.array_position(F.transform(modifiers, lambda m: m["kind"].isin("in_square", "height_range", "biome")), F.lit(True))
    before = F.when(at > 0, F.slice(modifiers, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(modifiers)
    product = lambda kind, f: F.aggregate(F.filter(before, lambda m: m["kind"] == kind), F.lit(1.0), lambda s, m: s * f(m["n"].cast("double")))
    return F.struct(product("count", lambda n: n).alias("tries"), F.when(F.exists(before, lambda m: m["kind"] == "rarity"), product("rarity", lambda n: 1 / n)).alias("chance"))


def harvest(tags: DataFrame, block: str, tools: Sequence[str], tiers: Sequence[str]) -> DataFrame:
    """block, tools (in their declared order) and tier (the highest) of the tags that blocks are in; the first tier where none is named."""
    tool, tier = (F.array(*map(F.lit, x)) for x in (tools, tiers))
    by = tags.groupBy(block).agg(F.collect_set(F.when(F.array_contains(tool, F.col("tag")), F.col("tag"))).alias("__t"), F.max(F.nullif(F.array_position(tier, F.col("tag")), F.lit(0))).alias("__r"))
    return by.select(block, F.array_sort("__t", lambda a, b: (F.array_position(tool, a) - F.array_position(tool, b)).cast("int")).alias("tools"), F.get(tier, F.coalesce("__r", F.lit(1)).cast("int") - 1).alias("tier"))


def food(rows: DataFrame, key: str, doc: str) -> DataFrame:
    """key, nutrition and saturation (to two places) of the items that have the component, and whether they are always edible."""
    made = rows.select(key, F.from_json(F.get_json_object(doc, "$.food"), "nutrition int, saturation double, can_always_eat boolean").alias("f")).where("f is not null")
    return made.select(key, "f.nutrition", F.round("f.saturation", 2).alias("saturation"), F.coalesce("f.can_always_eat", F.lit(False)).alias("always"))


def generation(rows: DataFrame, by: Sequence[str], dimension: str, biome: str) -> DataFrame:
    """Of each block and dimension (``by``): least, most, tries (of veins without a chance), surface (of all), n_biomes, whole (all biomes
    of the dimension), veins in the order of their heights, and peak: that of all veins that have one, if they agree and span the whole
    height.  ``rows`` has vein, least, most, peak, tries, chance and surface."""
    biomes = rows.groupBy(dimension).agg(F.count_distinct(biome).alias("__all"))
    peaked = F.col("peak").isNotNull()
    agree = (F.min("peak") == F.max("peak")) & (F.min(F.when(peaked, F.col("least"))) == F.min("least")) & (F.max(F.when(peaked, F.col("most"))) == F.max("most"))
    made = rows.groupBy(*by).agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.sum(F.when(F.col("chance").isNull(), F.col("tries"))).alias("tries"), F.bool_and("surface").alias("surface"),
        F.count_distinct(biome).alias("n_biomes"), F.array_sort(F.collect_set(F.struct("least", "most", "vein"))).alias("veins"), F.when(agree, F.min("peak")).alias("peak"),
    )
    return made.join(biomes, dimension).withColumn("whole", F.col("n_biomes") == F.col("__all")).drop("__all")


def spawn_overrides(rows: DataFrame, key: str, overrides: str) -> DataFrame:
    """key, category, mobs and suppressed of a map of categories to lists of mobs: an empty list suppresses the category."""
    made = rows.select(key, F.explode(F.from_json(overrides, "map<string,array<struct<type:string>>>")).alias("category", "m"))
    return made.select(key, "category", F.transform("m", lambda x: x["type"]).alias("mobs"), (F.size("m") == 0).alias("suppressed"))
