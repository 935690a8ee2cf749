"""Brewing: pages of ingredients read section by section, and the producers that follow from what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.editions import of_first_edition
from ..functions.markup import named_argument, whole_cells
from ..functions.text import strip_markup
from ..session import written
from .ordered import scope_fills

#: Base potions by the heading of their row, the ingredient whose row is no effect, and ids.
BASES = {"Awkward potion": "awkward", "Mundane potion": "mundane", "Thick potion": "thick"}
WEAKENER = "Fermented Spider Eye"
BOTTLE, SPLASH, LINGERING, GUNPOWDER, BREATH = "minecraft:glass_bottle", "minecraft:splash_potion", "minecraft:lingering_potion", "minecraft:gunpowder", "minecraft:dragon_breath"
REDSTONE, GLOWSTONE = "minecraft:redstone", "minecraft:glowstone_dust"
LEAST_BASES, LEAST_EFFECTS = 3, 10
_LATER = r"(?i)\{\{\s*upcoming\b[^}]*\}\}"


def section(text: Column, title: str, level: int) -> Column:
    """What stands below a heading up to the next one of its level or above; null without the heading."""
    marks = "=" * level
    found = F.regexp_extract(text, rf"(?ms)^{marks} {title} {marks}\s*$.*?(?=^={{1,{level}}}[^=\n][^\n]*?={{1,{level}}}\s*$|\z)", 0)
    return F.nullif(found, F.lit(""))


def edition_scopes(lines: DataFrame, group: list[str], order: list[str], line: str) -> DataFrame:
    """``edition`` and ``reached`` of every line of pages of any length: regions and blocks are filled down in ranges of rows, each with
    what resets it.  (``functions.editions.scoped`` does the same within one value.)"""
    from ..functions.editions import classified, own_mark, verdict

    rows = written(lines.withColumn("__c", classified(F.col(line))).withColumn("__said", F.when(F.col("__c.kind") == "line", own_mark(F.col(line)))), "lines")
    kind, edition = F.col("__c.kind"), F.col("__c.edition")
    blocks = scope_fills(rows, group, order, {"__region": (kind == "region", kind == "rule", edition), "__block": (kind == "block", kind.isin("region", "rule", "unmarked"), edition)})
    v = verdict(kind, F.col("__c.edition"), F.col("__said"), F.col("__region"), F.col("__block"))
    return blocks.select(*lines.columns, v["edition"].alias("edition"), v["reached"].alias("reached"))


def read_pages(pages: DataFrame, key: str, text: str, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of brewing pages: recipes (key, kind 'base' or 'effect', ingredient, result), corruptions (key, effect, becomes), unbrewable (key,
    name), and a ledger (key, reason) of pages that could not be read, which give nothing else.

    ``items`` (name, id) are the ingredients that are known.  Effects have a row each, whose cell of what they become may span
    rows and name both editions; ingredients marked as upcoming are left out."""
    plain = F.regexp_replace(F.col(text), "(?s)<!--.*?-->", "")
    parts = {"effects": section(plain, "Effect ingredients", 3), "bases": section(plain, "Base potions", 3), "finish": section(plain, "Splash and lingering potions", 4), "unbrewable": section(plain, "Un-brewable potions", 3)}
    cut = written(pages.select(key, *(c.alias(n) for n, c in parts.items())).withColumn("cells", whole_cells(F.col("effects"))), "brewing")
    known = items.groupBy("name").agg(F.min("id").alias("ingredient"))

    rows = cut.select(key, F.inline("cells")).where("row > 0").groupBy(key, "row").agg(*(F.max(F.when(F.col("col") == i, F.col("text"))).alias(n) for i, n in ((0, "name"), (2, "effect"), (3, "becomes"))), F.max(F.col("text").rlike(_LATER)).alias("later"))
    shown = rows.where("not later").select(key, strip_markup(F.regexp_replace("name", r"\{\{anchor\|[^}]*\}\}", "")).alias("name"), strip_markup(F.col("effect")).alias("result"), of_first_edition(F.col("becomes")).alias("becomes"))
    effects = written(shown.join(known, "name", "left"), "effects")

    blocks = cut.select(key, F.explode(F.split(F.regexp_extract("bases", r"(?s)\{\|.*?\n\|\}", 0), r"(?m)^\|-\s*$")).alias("block"))
    head = strip_markup(F.element_at(F.split(F.regexp_extract("block", r"(?m)^!\s*(.*)$", 1), "<br>"), -1))
    kinds = F.map_from_arrays(F.array(*map(F.lit, BASES)), F.array(*map(F.lit, BASES.values())))
    based = blocks.withColumn("result", F.try_element_at(kinds, head)).where("result is not null").withColumn("input", named_argument(F.col("block"), "brewing stand", "Input"))
    each = based.select(key, "result", F.explode_outer(F.split("input", ";")).alias("name")).withColumn("name", F.trim("name"))
    bases = written(each.where(F.col("name").isNull() | ((F.col("name") != "") & ~F.col("name").rlike(_LATER))).join(known, "name", "left"), "bases")

    link = r"\[\[(?:[^\]|]*\|)?([^\]]+)\]\](?:\{\{only\|([^}]+)\}\})?"
    names = F.zip_with(F.regexp_extract_all("unbrewable", F.lit(link), F.lit(1)), F.regexp_extract_all("unbrewable", F.lit(link), F.lit(2)), lambda n, e: F.struct(strip_markup(n).alias("name"), F.lower(F.trim(F.get(F.split(e, "\\|"), F.lit(0)))).alias("edition")))
    unbrewable = written(cut.select(key, F.inline(F.filter(names, lambda n: (n["name"] != "") & ~n["edition"].isin("bedrock", "be")))).select(key, "name"), "unbrewable")

    is_effect = F.col("name") != WEAKENER
    counts = effects.groupBy(key).agg(F.sum(is_effect.cast("int")).alias("n_effects"), F.sum((~is_effect).cast("int")).alias("n_weak")).join(bases.groupBy(key).agg(F.count("name").alias("n_bases")), key, "full").join(unbrewable.groupBy(key).agg(F.count("*").alias("n_names")), key, "full")
    met, number = cut.join(counts, key, "left"), lambda c: F.coalesce(F.col(c), F.lit(0))
    says = lambda word: F.contains(F.lower("finish"), F.lit(word))
    faults = [
        *((F.col(n).isNull(), f"no section: {n}") for n in parts),
        (F.col("effects").isNotNull() & F.col("cells").isNull(), "broken table: effects"),
        (F.col("effects").isNotNull() & (number("n_weak") == 0), f"no row: {WEAKENER}"),
        ((number("n_effects") < LEAST_EFFECTS) | (number("n_bases") < LEAST_BASES), "too few recipes"),
        (~says("gunpowder") | ~says("dragon"), "no ingredient of the container steps"),
        (F.col("unbrewable").isNotNull() & (number("n_names") == 0), "no unbrewable potion"),
    ]
    whole = met.select(key, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in faults)))).alias("reason"))
    strange = effects.where("ingredient is null").select(key, F.concat(F.lit("unknown ingredient: "), "name").alias("reason")).union(bases.where("ingredient is null").select(key, F.when(F.col("name").isNull(), "no input of a base potion").otherwise(F.concat(F.lit("unknown ingredient: "), "name"))))
    ledger = written(whole.union(strange).distinct(), "ledger")
    bad = ledger.select(key).distinct()
    fine = lambda df: df.join(bad, key, "left_anti")
    recipes = effects.select(key, F.when(is_effect, "effect").otherwise("base").alias("kind"), "ingredient", F.when(is_effect, F.col("result")).otherwise("weakness").alias("result")).union(bases.select(key, F.lit("base"), "ingredient", "result"))
    corruptions = effects.where((F.col("becomes") != "") & (F.lower("becomes") != "none")).select(key, F.col("result").alias("effect"), "becomes").distinct()
    return fine(recipes), fine(corruptions), fine(unbrewable), ledger


def potion_path(effect: Column) -> Column:
    """The registry's path of an effect's name, where it is regular."""
    return F.replace(F.lower(effect), F.lit(" "), F.lit("_"))


def producers(recipes: DataFrame, corruptions: DataFrame, key: str, potions: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, output, method, ingredient, input and source of all that can be brewed; and key, name and path of what the registry does not
    hold.

    ``potions`` (path) is the registry, ``paths`` (name, path) the irregular names.  Water is filled into bottles.  Corruption holds for
    the plain, long and strong kinds that both sides have.  Every potion can be made a splash potion, which is one real item; from
    it, and not from what is drunk, lingering potions are made."""
    known = potions.select("path").distinct()
    item = lambda c: F.concat(F.lit("minecraft:potion/"), c)
    odd = paths.groupBy("name").agg(F.min("path").alias("__path"))

    def row(df: DataFrame, output: Column, ingredient: Column | str | None, source: Column, given: Column, method: str = "brewing") -> DataFrame:
        first = F.lit(ingredient).cast("string") if ingredient is None or isinstance(ingredient, str) else ingredient
        return df.select(key, output.alias("output"), F.lit(method).alias("method"), first.alias("ingredient"), given.alias("input"), source.alias("source"))

    asked = recipes.join(odd, F.col("result") == F.col("name"), "left").withColumn("path", F.when(F.col("kind") == "base", F.col("result")).otherwise(F.coalesce("__path", potion_path(F.col("result"))))).select(key, "kind", "ingredient", "result", "path")
    held = asked.join(known, "path", "left_semi")
    lost = asked.join(known, "path", "left_anti").select(key, F.col("result").alias("name"), "path").distinct()
    made = row(held, item(F.col("path")), F.col("ingredient"), F.concat_ws("/", F.lit("brewing"), "kind", "path"), item(F.when(F.col("kind") == "base", "water").otherwise("awkward")))

    pages = recipes.select(key).distinct()
    eyes = recipes.where("kind = 'base' and result = 'weakness'").select(key, F.col("ingredient").alias("eye"))
    named = lambda df, c: df.join(odd, F.col(c) == F.col("name"), "left").withColumn(c, F.coalesce("__path", potion_path(F.col(c)))).drop("name", "__path")
    both = named(named(corruptions, "effect"), "becomes").join(eyes, key).withColumn("p", F.explode(F.array(F.lit(""), F.lit("long_"), F.lit("strong_")))).select(key, "eye", F.concat("p", "effect").alias("from"), F.concat("p", "becomes").alias("to"))
    both = both.join(known.withColumnRenamed("path", "from"), "from", "left_semi").join(known.withColumnRenamed("path", "to"), "to", "left_semi")
    made = made.union(row(both, item(F.col("to")), F.col("eye"), F.concat_ws("/", F.lit("brewing/corruption"), "to", "from"), item(F.col("from"))))

    of_all = pages.join(known, how="cross")  # the registry of one game for each page
    made = made.union(row(of_all.where("path = 'water'"), item(F.col("path")), None, F.lit("brewing/equipment/water_bottle"), F.lit(BOTTLE), "filling"))
    for prefix, ingredient in (("long", REDSTONE), ("strong", GLOWSTONE)):
        more = known.where(F.startswith("path", F.lit(f"{prefix}_"))).select(F.expr(f"substring(path, {len(prefix) + 2})").alias("path"))
        one = of_all.where(~F.startswith("path", F.lit("long_")) & ~F.startswith("path", F.lit("strong_"))).join(more, "path", "left_semi")
        made = made.union(row(one, item(F.concat(F.lit(f"{prefix}_"), "path")), ingredient, F.concat_ws("/", F.lit(f"brewing/modifier/{prefix}"), "path"), item(F.col("path"))))
    made = made.union(row(of_all, F.lit(SPLASH), GUNPOWDER, F.concat_ws("/", F.lit("brewing/container/splash"), "path"), item(F.col("path"))))
    return made.union(row(pages, F.lit(LINGERING), BREATH, F.lit("brewing/container/lingering"), F.lit(SPLASH))), lost


def uncovered(made: DataFrame, key: str, potions: DataFrame) -> DataFrame:
    """key and path of the potions of the registry that nothing makes."""
    every = made.select(key).distinct().join(potions.select("path").distinct(), how="cross")  # the registry of one game for each page
    there = made.select(key, F.regexp_extract("output", "^minecraft:potion/(.*)$", 1).alias("path")).distinct()
    return every.join(there, [key, "path"], "left_anti")
