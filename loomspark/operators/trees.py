"""Trees of producers as they are shown: repeated parts point to where they stand first, near-identical producers are one card.

A walk that remembers what it has drawn seems to need one task a tree, from left to right.  It does not: what is remembered
is an item with the depth that is left, and nodes with as much depth left are those of one level.  So trees grow level by level,
all roots at once, and the node of an item whose place comes first in its level is the one the others point to."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ordered import declared, numbered

#: Ways to come by an item that are no manufacture; the order of cooking stations; members that stand for a tag if it
#: has them; what a name that is no plain material begins or ends with.
ACQUIRED = ("trade", "chest_loot", "block_drop", "mob_loot", "brushing", "harvesting", "shearing", "fishing", "bartering", "gift", "world_generation")
COOKING = ("furnace", "blast_furnace", "smoker", "campfire")
REPRESENTATIVES = ("minecraft:oak_planks", "minecraft:oak_log", "minecraft:iron_ingot")


def bare(name: Column) -> Column:
    """An id without its namespace."""
    return F.regexp_replace(name, "^[a-z0-9_-]+:", "")


def _has(name: Column, item: Column) -> Column:
    return F.coalesce(F.array_contains(name, item), F.lit(False))


def with_references(roots: DataFrame, producers: DataFrame, inputs: DataFrame, depth: int = 4) -> DataFrame:
    """root, path, depth, producer, item, tag, stub and reference of all nodes below the roots (column ``item``).

    ``producers``: output, producer, seq (their order within an output); ``inputs``: producer, slot (from 0), item or tag.  ``path`` is
    root.producers.i.inputs.j..., where i counts the producers that are drawn.  A producer all of whose inputs are above it
    already is not drawn; else such an input is a leaf (stub 'repeat'), as is a tag.  An item that stands in its tree with as
    much depth left, further to the front, is not drawn again (stub 'shown', ``reference`` is that place).  At ``depth`` nodes
    are cut (stub 'expandable'), but a root never is."""
    made = _with_slots(producers.select("output", "producer", "seq"), "producer", inputs.select("producer", "slot", "item", "tag"))
    first = roots.select(F.col("item").alias("root")).distinct()
    out = level = written(first.select("root", F.lit("root").alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("producer"), F.col("root").alias("item"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("stub"), F.lit(None).cast("string").alias("reference"), F.array("root").alias("way"), F.array().cast("array<int>").alias("at")), "tree")
    for d in range(1, max(depth, 1) + 1):
        each = _drawn(level.where("tag is null and stub is null"), made, "producer", ["at"])
        place = F.concat("at", F.array(F.col("k"), F.col("slot")))
        kind = F.when(_has(F.col("way"), F.col("item")), "repeat").when(F.col("tag").isNull() & F.lit(depth - d <= 0), "expandable")
        nodes = written(each.select("root", F.col("path"), F.lit(d).alias("depth"), "producer", "item", "tag", kind.alias("stub"), "way", place.alias("at")), "nodes")
        shown = nodes.where("tag is null and stub is null").groupBy("root", "item").agg(F.min_by("path", "at").alias("reference"))
        met = nodes.join(shown, ["root", "item"], "left").withColumn("reference", F.when(F.col("stub").isNull() & F.col("tag").isNull() & (F.col("reference") != F.col("path")), F.col("reference")))
        way = F.when(F.col("item").isNull() | F.col("stub").isNotNull(), F.col("way")).otherwise(F.concat("way", F.array("item")))
        level = written(met.select("root", "path", "depth", "producer", "item", "tag", F.when(F.col("reference").isNotNull(), "shown").otherwise(F.col("stub")).alias("stub"), "reference", way.alias("way"), "at"), "tree")
        out = out.unionByName(level)
    return out.select("root", "path", "depth", "producer", "item", "tag", "stub", "reference")


def _with_slots(producers: DataFrame, key: str, inputs: DataFrame) -> DataFrame:
    """Producers with an array of their inputs in order: a recipe has as many as its grid has cells."""
    gathered = inputs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot", *(c for c in inputs.columns if c not in (key, "slot"))))).alias("inputs"))
    kind = gathered.schema["inputs"].dataType.simpleString()
    return written(producers.join(gathered, key, "left").withColumn("inputs", F.coalesce("inputs", F.array().cast(kind))), "producers")


def _drawn(level: DataFrame, made: DataFrame, key: str, more: Sequence[str] = ()) -> DataFrame:
    """A row for each input of each producer that is drawn below the nodes of a level: root, path (of the input), way, k (which of
    the drawn producers of its node), the producer and the input's columns."""
    above = level.select("root", F.col("path").alias("__path"), "way", "item", *more)
    grown = above.join(made.withColumnRenamed("output", "item"), "item").drop("item")
    kept = grown.where(~((F.size("inputs") > 0) & F.forall("inputs", lambda i: _has(F.col("way"), i["item"]))))
    counted = numbered(kept, ["root", "__path"], ["seq", key], "__k")
    k = (F.col("__k") - 1).cast("int")
    return counted.select("root", "__path", "way", *more, key, k.alias("k"), F.inline("inputs")).withColumn("path", F.concat(F.col("__path"), F.lit(".producers."), F.col("k").cast("string"), F.lit(".inputs."), F.col("slot").cast("string"))).drop("__path")


def flagged(producers: DataFrame, inputs: DataFrame) -> DataFrame:
    """The producers with what readers are told apart by.

    ``acquisition``: by method, or the smelting of an ore; ``storage``: one block becomes several of what that block is packed from;
    ``nuggets``: several nuggets become one of what they are broken from; ``dye``: by the name of the source."""
    firsts = inputs.groupBy("producer").agg(F.count("*").alias("__n"), F.min_by(F.struct("item", "tag", F.coalesce("count", F.lit(1)).alias("count")), "slot").alias("__in"))
    rows = producers.join(firsts, "producer", "left").withColumn("__c", F.coalesce("count", F.lit(1)))
    alone = rows.where((F.col("method") == "crafting") & (F.col("__n") == 1) & F.col("__in.item").isNotNull())
    back = alone.groupBy(F.col("output").alias("__of"), F.col("__in.item").alias("__from")).agg(F.max("__in.count").alias("__takes"), F.max("__c").alias("__gives"))
    met = rows.join(back, (F.col("__in.item") == F.col("__of")) & (F.col("output") == F.col("__from")), "left")
    one = (F.col("method") == "crafting") & (F.col("__n") == 1) & F.col("__in.tag").isNull()
    name = bare(F.col("__in.item"))
    storage = one & (F.col("__in.count") == 1) & (F.col("__c") > 1) & F.endswith(name, F.lit("_block")) & (F.col("__takes") > 1)
    nuggets = one & (F.col("__in.count") > 1) & (F.col("__c") == 1) & F.endswith(name, F.lit("_nugget")) & (F.col("__gives") > 1)
    ore = bare(F.coalesce("__in.item", "__in.tag"))
    smelt = (F.col("method") == "smelting") & (F.endswith(ore, F.lit("_ore")) | F.startswith(ore, F.lit("raw_")) | (ore == "ancient_debris"))
    dye = F.contains("source", F.lit(":dye_")) | F.startswith("source", F.lit("dye_"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    return met.select(*producers.columns, sure(F.col("method").isin(*ACQUIRED) | sure(smelt)).alias("acquisition"), sure(storage).alias("storage"), sure(nuggets).alias("nuggets"), sure(dye).alias("dye"))


class Cards(NamedTuple):
    """``cards``: card, producer, output, top, seq, method, station, stations, count, grid, width, height; ``slots``: card, slot, item, tag,
    count, child (what hangs below) and first (the first slot of the card with that child); ``alternatives``: card, slot, member, at."""

    cards: DataFrame
    slots: DataFrame
    alternatives: DataFrame


def cards(producers: DataFrame, inputs: DataFrame, members: DataFrame, representatives: Sequence[str] = REPRESENTATIVES) -> Cards:
    """What a tree draws for each output: at the root (``top``) and below it.

    ``producers``: output, producer, seq, method, station, count, source, grid, width, height; ``inputs``: producer, slot, item, tag,
    count; ``members``: producer, slot, place, member (of tags and of lists of alternatives).  Acquisition is not drawn; storage and
    nuggets only at the root.  Dyeing comes last where there is a craft without, storage last of all.  The smelting of one
    yield is one card, of all its stations and ingredients (a tag goes before items); then, slot by slot, cards that
    differ in that slot alone are one card, whose slot has the members of all."""
    rows = flagged(producers, inputs).where(~F.col("acquisition")).withColumn("top", F.explode(F.array(F.lit(True), F.lit(False)))).where(F.col("top") | ~(F.col("storage") | F.col("nuggets")))
    plain = rows.groupBy("output", "top").agg(F.max((F.col("method") == "crafting") & ~F.col("dye")).alias("__base"))
    rows = rows.join(plain, ["output", "top"]).withColumn("key", F.array(F.col("storage").cast("long"), (F.col("__base") & F.col("dye")).cast("long"), F.col("seq").cast("long")))
    rows = written(rows.withColumn("card", F.concat(F.when(F.col("top"), "^").otherwise("_"), F.col("producer"))).withColumn("stations", F.when(F.col("station").isNotNull(), F.array("station")).otherwise(F.array().cast("array<string>"))).drop("acquisition", "storage", "nuggets", "dye", "__base", "source"), "cards")
    of = rows.select("card", "producer")
    slots = written(of.join(inputs.select("producer", "slot", "item", "tag", F.coalesce("count", F.lit(1)).alias("count")), "producer").drop("producer"), "slots")
    others = written(of.join(members.select("producer", "slot", F.array(F.col("place").cast("long")).alias("at"), "member"), "producer").select("card", "slot", "member", "at"), "alternatives")
    rows, slots, others = _one_smelt(rows, slots, others)
    width = slots.agg(F.max("slot")).first()[0]
    for slot in range(0 if width is None else width + 1):
        rows, slots, others = _one_differs(rows, slots, others, slot)

    material = bare(F.col("member"))
    is_plain = ~(F.startswith(material, F.lit("stripped_")) | F.endswith(material, F.lit("_wood")) | F.endswith(material, F.lit("_hyphae")))
    some = others.groupBy("card", "slot").agg(F.max(is_plain).alias("__some"))
    kept = written(others.join(some, ["card", "slot"]).where(is_plain | ~F.col("__some")).drop("__some"), "alternatives")
    known = [F.max(F.when(F.col("member") == r, F.col("member"))) for r in representatives]
    stands = kept.groupBy("card", "slot").agg(F.coalesce(*known, F.min_by("member", "at")).alias("__stands"))
    whole = slots.join(stands, ["card", "slot"], "left").withColumn("child", F.when(F.col("tag").isNotNull(), F.col("__stands")).otherwise(F.col("item"))).drop("__stands")
    first = whole.groupBy("card", "child").agg(F.min("slot").alias("first"))
    whole = whole.join(first, ["card", "child"], "left").select("card", "slot", "item", "tag", "count", "child", "first")
    placed = numbered(rows.drop("seq"), ["output", "top"], ["key", "card"], "seq").drop("key")
    return Cards(written(placed, "cards"), written(whole, "slots"), kept)


def _one_smelt(rows: DataFrame, slots: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    smelts = rows.where("method = 'smelting'").withColumn("count", F.coalesce("count", F.lit(1)))
    by = ["output", "top", "count"]
    kinds = smelts.where("station is not null").groupBy(*by, "station").agg(F.lit(1)).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(declared(F.col("station"), COOKING).alias("o"), F.col("station").alias("s")))).alias("__st"))
    lead = smelts.groupBy(*by).agg(F.min_by("card", "key").alias("__lead")).join(kinds, by, "left")
    group = written(smelts.select("card", "key", *by).join(lead, by).select("card", "key", "__lead", F.transform("__st", lambda x: x["s"]).alias("__stations")), "smelts")
    if group.isEmpty():
        return rows, slots, others
    firsts = group.join(slots.where("slot = 0"), "card")
    tagged = firsts.where("tag is not null").groupBy("__lead").agg(F.min_by(F.struct("card", "item", "tag", "count"), "key").alias("__t"))
    items = firsts.where("tag is null and item is not null").groupBy("__lead", "item").agg(F.min("key").alias("at"))
    many = items.groupBy("__lead").agg(F.count("*").alias("__n"), F.min_by("item", "at").alias("__i"))
    made = written(group.select("__lead").distinct().join(tagged, "__lead", "left").join(many, "__lead", "left").withColumnRenamed("__lead", "card").withColumn("__new", F.col("__t").isNotNull() | (F.coalesce("__n", F.lit(0)) > 1)), "smelts")
    gone = group.where("card <> __lead").select("card")
    stations = group.select(F.col("__lead").alias("card"), "__stations").distinct()
    left = rows.join(gone, "card", "left_anti").join(stations, "card", "left").withColumn("stations", F.coalesce("__stations", "stations")).drop("__stations")
    own = slots.join(gone, "card", "left_anti").join(made, "card", "left")
    new = F.coalesce("__new", F.lit(False))
    own = own.where(~new | (F.col("slot") == 0))
    turned = own.select("card", "slot", F.when(new & F.col("__t").isNotNull(), F.col("__t.item")).when(new, F.col("__i")).otherwise(F.col("item")).alias("item"), F.when(new & F.col("__t").isNotNull(), F.col("__t.tag")).otherwise(F.col("tag")).alias("tag"), F.when(new & F.col("__t").isNotNull(), F.col("__t.count")).otherwise(F.col("count")).alias("count"))
    of_tag = others.where("slot = 0").join(made.where("__t is not null").select(F.col("card").alias("__to"), F.col("__t.card").alias("card")), "card").select(F.col("__to").alias("card"), "slot", "member", "at")
    of_items = items.join(made.where("__t is null and __n > 1").select(F.col("card").alias("__lead")), "__lead").select(F.col("__lead").alias("card"), F.lit(0).alias("slot"), F.col("item").alias("member"), "at")
    stay = others.join(gone, "card", "left_anti").join(made.where("__new").select("card"), "card", "left_anti")
    return written(left, "cards"), written(turned, "slots"), written(stay.unionByName(of_tag).unionByName(of_items), "alternatives")


def _one_differs(rows: DataFrame, slots: DataFrame, others: DataFrame, slot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cards that are alike but for one slot become one; the first of them leads."""
    apart = lambda c: F.when(F.col("slot") != slot, F.col(c)).alias(c)
    like = slots.groupBy("card").agg(F.array_sort(F.collect_list(F.struct("slot", apart("item"), apart("tag"), apart("count")))).alias("__rest"), F.max(F.col("slot") == slot).alias("__has"))
    same = F.to_json(F.struct("output", "top", "method", F.coalesce("station", F.lit("")).alias("station"), F.coalesce("count", F.lit(1)).alias("count"), F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"), "grid", "__rest"), {"ignoreNullFields": "false"})
    keyed = written(rows.join(like.where("__has"), "card").select("card", "key", F.unhex(F.sha2(same, 256)).alias("__like")), "alike")
    leads = keyed.groupBy("__like").agg(F.min_by("card", "key").alias("__lead"), F.count("*").alias("__n")).where("__n > 1")
    group = written(keyed.join(leads, "__like").select("card", "key", "__lead"), "alike")
    if group.isEmpty():
        return rows, slots, others
    here = others.where(F.col("slot") == slot)
    listed = group.join(here, "card").select("__lead", "member", F.concat("key", "at").alias("at"))
    bare_ = group.join(here.select("card").distinct(), "card", "left_anti").join(slots.where((F.col("slot") == slot) & F.col("item").isNotNull()), "card").select("__lead", F.col("item").alias("member"), F.col("key").alias("at"))
    every = written(listed.unionByName(bare_).groupBy("__lead", "member").agg(F.min("at").alias("at")).withColumnRenamed("__lead", "card"), "alternatives")
    many = written(every.groupBy("card").agg(F.count("*").alias("__n"), F.min_by("member", "at").alias("__i")).where("__n > 1"), "alike")
    gone = group.where("card <> __lead").select("card")
    turned = slots.join(gone, "card", "left_anti").join(many, "card", "left").withColumn("item", F.when((F.col("slot") == slot) & F.col("__i").isNotNull(), F.col("__i")).otherwise(F.col("item"))).drop("__n", "__i")
    stay = others.join(gone, "card", "left_anti").join(many.select("card").withColumn("slot", F.lit(slot)), ["card", "slot"], "left_anti")
    new = every.join(many.select("card"), "card").select("card", F.lit(slot).alias("slot"), "member", "at")
    return written(rows.join(gone, "card", "left_anti"), "cards"), written(turned, "slots"), written(stay.unionByName(new), "alternatives")


def card_tree(roots: DataFrame, made: Cards, depth: int = 4, top: bool = True) -> DataFrame:
    """root, path, depth, card, item, tag, count, stub and reference of all nodes below the roots (column ``item``), drawn by cards.

    As ``with_references``, but a tag grows through what stands for it; a slot whose item stands in an earlier slot of the same card
    points to it (stub 'shown') if it has more below: only one card of a node is seen at a time, so no other place would
    be in sight; a node that is cut at ``depth`` is 'expandable' only if there is more.  Without ``top`` the roots are stubs that are
    gone on with: nothing that is drawn only at the root, and ``way`` (if ``roots`` has it) is what stands above them."""
    below = made.cards.where(~F.col("top")).select(F.col("output").alias("child")).distinct().withColumn("__more", F.lit(True))
    drawn = {t: _with_slots(made.cards.where(F.col("top") == t).select("output", "card", "seq"), "card", made.slots) for t in (True, False)}
    way = F.array_union("way", F.array("item")) if "way" in roots.columns else F.array("item")
    none = F.lit(None).cast("string")
    first = roots.select(F.col("item").alias("root"), F.lit("root").alias("path"), F.lit(0).alias("depth"), none.alias("card"), "item", none.alias("tag"), F.lit(1).alias("count"), way.alias("way"), F.lit(True).alias("grows")).distinct()
    if not top and depth <= 0:
        cut = first.join(below.withColumnRenamed("child", "item"), "item", "left")
        return cut.select("root", "path", "depth", "card", "item", "tag", "count", F.when(F.col("__more"), "expandable").alias("stub"), none.alias("reference"))
    level = written(first.withColumn("stub", none).withColumn("reference", none), "tree")
    out = level
    for d in range(1, max(depth, 1) + 1):
        each = _drawn(level.where("grows"), drawn[top and d == 1], "card").join(below, "child", "left")
        is_tag, again, more = F.col("tag").isNotNull(), _has(F.col("way"), F.col("child")), F.coalesce("__more", F.lit(False))
        leaf = again | F.col("child").isNull() | (is_tag & F.lit(depth - d + 1 <= 0))
        cut = ~leaf & F.lit(depth - d <= 0)
        shown = ~leaf & ~cut & (F.col("slot") > F.col("first")) & more
        stub = F.when(again, "repeat").when(cut & more, "expandable").when(shown, "shown")
        place = F.regexp_replace("path", "[0-9]+$", "")
        level = written(
            each.select("root", "path", F.lit(d).alias("depth"), "card", F.col("child").alias("item"), "tag", "count", F.when(leaf, F.col("way")).otherwise(F.concat("way", F.array("child"))).alias("way"), (~leaf & ~cut & ~shown).alias("grows"), stub.alias("stub"), F.when(shown, F.concat(place, F.col("first").cast("string"))).alias("reference")),
            "tree",
        )
        out = out.unionByName(level)
    return out.select("root", "path", "depth", "card", "item", "tag", "count", "stub", "reference")
