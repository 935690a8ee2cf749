"""Recipe documents to producers: dispatch by type, ingredients, grids, and a ledger of what is skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Recipe types with the fields of their ingredients, and the station of those that have one.
FIELDS = {
    "crafting_shaped": (),
    "crafting_shapeless": (),
    "smelting": ("ingredient",),
    "blasting": ("ingredient",),
    "smoking": ("ingredient",),
    "campfire_cooking": ("ingredient",),
    "stonecutting": ("ingredient",),
    "smithing_transform": ("template", "base", "addition"),
    "crafting_transmute": ("input", "material"),
    "crafting_dye": ("target", "dye"),
    "crafting_special_firework_star_fade": ("target", "dye"),
    "crafting_special_firework_star": ("fuel", "dye"),
    "crafting_imbue": ("source", "material"),
    "crafting_decorated_pot": ("back", "left", "right", "front"),
}
STATIONS = {"smelting": "furnace", "blasting": "blast_furnace", "smoking": "smoker", "campfire_cooking": "campfire", "stonecutting": "stonecutter"}
COOKING = ("smelting", "blasting", "smoking", "campfire_cooking")
NAMED_SKIPS = ("smithing_trim",)
_VALUES = sorted({f for fields in FIELDS.values() for f in fields})
SCHEMA = "type string, pattern array<string>, key map<string,string>, ingredients array<string>, result struct<id:string,count:int>, " + ", ".join(f"{v} string" for v in _VALUES)
INPUT = "array<struct<value:string,count:int>>"


def bare(name: Column) -> Column:
    """A name without its namespace."""
    return F.regexp_replace(name, "^[a-z0-9_.-]+:", "")


def _literals(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def classified(recipes: DataFrame, key: str = "recipe_id", doc: str = "doc") -> DataFrame:
    """key, d (the document), type and skip: why a recipe is no producer, null where it is one.  The first reason holds."""
    made = recipes.select(key, F.from_json(doc, SCHEMA).alias("d")).withColumn("type", bare(F.col("d.type")))
    named = F.col("d.result.id").isNotNull()
    skip = (
        F.when(F.col("d").isNull() | F.col("type").isNull(), "no document or type")
        .when((F.col("type") == "crafting_transmute") & ~named, "the result is derived from the input")
        .when(bare(F.col(key)).startswith("dye_white_"), "bleaches what is made otherwise")
        .when(F.col("type") == "brewing", "brewing is read elsewhere")
        .when(F.col("type").isin(*NAMED_SKIPS), "no shape of items")
        .when(~F.col("type").isin(*FIELDS) & F.col("type").startswith("crafting_special_"), "no list of ingredients")
        .when(~F.col("type").isin(*FIELDS), "unhandled recipe type")
        .when(~named | (F.coalesce("d.result.count", F.lit(1)) < 1), "no result")
    )
    return made.withColumn("skip", skip)


def _symbols(pattern: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.array_join(pattern, ""), ""), lambda c: (c != " ") & (c != ""))))


def shaped_inputs(pattern: Column, key: Column) -> Column:
    """An input for each symbol of the pattern, in order, with the number of its cells."""
    cells = F.split(F.array_join(pattern, ""), "")
    return F.transform(_symbols(pattern), lambda s: F.struct(F.element_at(key, s).alias("value"), F.size(F.filter(cells, lambda c: c == s)).cast("int").alias("count")))


def grid(pattern: Column) -> Column:
    """Number of the input of each cell, row by row, null where empty; short rows are filled up."""
    width = F.array_max(F.transform(pattern, lambda r: F.length(r)))
    at = lambda r, i: F.nullif(F.array_position(_symbols(pattern), F.substring(F.rpad(r, width, " "), i, F.lit(1))), F.lit(0)) - 1
    return F.flatten(F.transform(pattern, lambda r: F.transform(F.sequence(F.lit(1), width), lambda i: at(r, i))))


def producers(recipes: DataFrame, key: str = "recipe_id", doc: str = "doc") -> DataFrame:
    """key, method, station, output, count, inputs (value, count), grid, width and height of what is no skip."""
    made = classified(recipes, key, doc).where("skip is null")
    one = lambda *names: F.array(*(F.struct(F.col(f"d.{n}").alias("value"), F.lit(1).alias("count")) for n in names))
    shaped = F.col("type") == "crafting_shaped"
    inputs = F.when(shaped, shaped_inputs(F.col("d.pattern"), F.col("d.key")))
    inputs = inputs.when(F.col("type") == "crafting_shapeless", F.transform("d.ingredients", lambda v: F.struct(v.alias("value"), F.lit(1).alias("count"))))
    for kind, fields in FIELDS.items():
        if fields:
            inputs = inputs.when(F.col("type") == kind, one(*fields))
    method = F.when(F.col("type").isin(*COOKING), "smelting").otherwise("crafting")
    width = F.when(shaped, F.array_max(F.transform("d.pattern", lambda r: F.length(r))))
    return made.select(
        key, method.alias("method"), F.element_at(_literals(STATIONS), F.col("type")).alias("station"), bare(F.col("d.result.id")).alias("output"), F.coalesce("d.result.count", F.lit(1)).alias("count"),
        inputs.alias("inputs"), F.when(shaped, grid(F.col("d.pattern"))).alias("grid"), width.alias("width"), F.when(shaped, F.size("d.pattern")).alias("height"),
    )


def resolve_ingredient(value: Column, dye: Column) -> Column:
    """item, tag, members and mixed of one ingredient: an id, a ``#tag``, or a list of ids, of which the first in order stands for
    all (of a dye recipe, the white one alone).  A list that holds a tag is ``mixed``: nobody knows which rule it follows."""
    listed = value.startswith("[")
    names = F.array_sort(F.array_distinct(F.transform(F.from_json(value, "array<string>"), bare)))
    white = F.get(F.filter(names, lambda n: n.startswith("white_")), F.lit(0))
    mixed = listed & F.exists(F.from_json(value, "array<string>"), lambda n: n.startswith("#"))
    item = F.when(listed, F.when(dye & white.isNotNull(), white).otherwise(F.get(names, F.lit(0)))).when(~value.startswith("#"), bare(value))
    tag = F.when(~listed & value.startswith("#"), bare(F.substring(value, 2, 1 << 20)))
    return F.struct(F.when(~mixed, item).alias("item"), tag.alias("tag"), F.when(listed & ~mixed & ~(dye & white.isNotNull()), names).alias("members"), F.coalesce(mixed, F.lit(False)).alias("mixed"))


def inputs(made: DataFrame, tags: DataFrame, key: str = "recipe_id") -> DataFrame:
    """key, slot, item, tag, count, members and mixed: equal ingredients of a recipe are one, at the place of the first, with the
    sum of their counts.  ``tags`` (tag, member) is a closure; the members of each tag are gathered once."""
    each = made.select(key, bare(F.col(key)).startswith("dye_").alias("dye"), F.posexplode("inputs").alias("pos", "i"))
    each = each.select(key, "pos", F.col("i.count").alias("count"), resolve_ingredient(F.col("i.value"), F.col("dye")).alias("r")).select(key, "pos", "count", "r.*")
    one = each.groupBy(key, "item", "tag", "mixed").agg(F.min("pos").alias("slot"), F.sum("count").cast("int").alias("count"), F.min_by("members", "pos").alias("members"))
    of_tag = tags.groupBy("tag").agg(F.array_sort(F.collect_set("member")).alias("of_tag"))
    return one.join(of_tag, "tag", "left").select(key, "slot", "item", "tag", "count", F.coalesce("of_tag", "members").alias("members"), "mixed")
