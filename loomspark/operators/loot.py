"""Loot tables: the walk over nested entries, odds, conditions, counts, and producers of what they give."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .odds import per_attempt
from .recipes import bare

# Entries that hold others, and the notes of the two tools that gate a drop.
CONTAINERS = ("alternatives", "group", "sequence")
SILK, SHEARS = "silk touch", "shears"
ENTRY = "type string, name string, weight double, condition string, modifier string, children array<string>"
POOL = f"array<struct<rolls:string,condition:string,entries:array<struct<{ENTRY}>>>>"
LOOSE = "array<struct<rolls:string,condition:string,entries:array<string>>>"
RANGE = "type string, min double, max double"
# Bytes of distinct chains of conditions with a gate, and of distinct modifiers, up to which they are broadcast.
FEW = 8 << 20


class LootError(ValueError):
    """A table that cannot be read as one."""


def _number_or_range(value: Column) -> tuple[Column, Column]:
    """A value as a number and as a range, of which one is null.  Only what can be one is parsed: a failure costs as much as an
    exception."""
    isobject = value.startswith("{")
    return F.when(~isobject, value.try_cast("double")), F.from_json(F.when(isobject, value), RANGE)


def mean_of(number: Column, r: Column) -> Column:
    """Mean of a number or of a uniform range; null for every other provider."""
    kind = bare(r["type"])
    return F.coalesce(number, F.when(kind.isNull() | (kind == "uniform"), (r["min"] + r["max"]) / 2))


def count_of(modifiers: Column) -> Column:
    """The count, a number or a range, of the first ``set_count`` among the modifiers (one or a list)."""
    listed = F.when(modifiers.startswith("["), F.from_json(modifiers, "array<string>")).otherwise(F.array(modifiers))
    kind = lambda m: bare(F.coalesce(F.get_json_object(m, "$.type"), F.get_json_object(m, "$.function")))
    return F.get_json_object(F.get(F.filter(listed, lambda m: kind(m) == "set_count"), F.lit(0)), "$.count")


def with_counts(df: DataFrame) -> DataFrame:
    """count_min and count_max by the modifier: 1 at least; 1 where there is no ``set_count``."""
    number, r = _number_or_range(F.col("__count"))
    made = df.withColumn("__count", count_of(F.col("modifier"))).withColumns({"__number": number, "__r": r})
    whole = lambda x: F.when(x.isNotNull(), F.greatest(F.floor(x).cast("int"), F.lit(1)))
    number, r = whole(F.col("__number")), F.col("__r")
    least = F.coalesce(number, whole(r["min"]), F.lit(1))
    return made.withColumns({"count_min": least, "count_max": F.coalesce(number, F.greatest(whole(r["max"]), least), least)}).drop("__count", "__number", "__r")


def gates(conditions: DataFrame, predicates: DataFrame) -> DataFrame:
    """condition and gate of each distinct condition: the note of its first term that asks for silk touch or for shears.

    A condition is an object, ``all_of`` several, or the name of one of ``predicates`` (name, doc); so may be its terms."""
    named = predicates.select(bare(F.col("name")).alias("__name"), F.col("doc").alias("__doc"))

    def resolved(df: DataFrame, name: str) -> DataFrame:
        joined = df.join(named, bare(F.col(name)) == F.col("__name"), "left")
        return joined.withColumn(name, F.when(F.col(name).startswith("{"), F.col(name)).otherwise(F.col("__doc"))).drop("__name", "__doc")

    one = resolved(conditions.select("condition", F.col("condition").alias("term")).where("condition is not null").distinct(), "term")
    many = bare(F.get_json_object("term", "$.type")) == "all_of"
    terms = F.when(many, F.coalesce(F.from_json(F.get_json_object("term", "$.terms"), "array<string>"), F.array("term"))).otherwise(F.array("term"))
    each = resolved(one.select("condition", F.posexplode(terms).alias("pos", "term")), "term")
    tool = bare(F.get_json_object("term", "$.type")) == "match_tool"
    asked = F.from_json(F.get_json_object("term", "$.predicate.enchantments"), "array<struct<enchantments:string,levels:struct<min:double>>>")
    items = F.get_json_object("term", "$.predicate.items")
    note = F.when(tool & F.exists(asked, lambda e: (bare(e["enchantments"]) == "silk_touch") & (e["levels"]["min"] >= 1)), SILK).when(tool & bare(F.regexp_replace(items, r'^\["|"\]$', "")).eqNullSafe(F.lit("shears")), SHEARS)
    return each.withColumn("gate", note).where("gate is not null").groupBy("condition").agg(F.min_by("gate", "pos").alias("gate"))


def entries(tables: DataFrame, key: str = "table", doc: str = "doc", most: int = 8, keep: Sequence[str] = ()) -> DataFrame:
    """All entries of the tables, written: key and the columns to ``keep``, path (pool and places, joined by dots), kind, above (the
    conditions of the pool and of all entries down to this one), item, modifier, chance and rolls.  Each document is parsed once; a
    level holds only what lies in containers of the one above.  Raises if entries nest deeper than ``most``."""
    kept = [key, *keep]
    weight = lambda e: F.when(e["weight"] >= 1, F.floor(e["weight"])).otherwise(1).cast("long")
    number, r = _number_or_range(F.coalesce("p.rolls", F.lit("1")))
    text = tables.select(*kept, F.get_json_object(doc, "$.pools").alias("text")).withColumn("all", F.from_json("text", POOL))
    # an entry that is no object costs the whole list: such documents alone are parsed entry by entry
    loose = F.transform(F.from_json("text", LOOSE), lambda p: F.struct(p["rolls"].alias("rolls"), p["condition"].alias("condition"), F.transform(p["entries"], lambda e: F.from_json(e, ENTRY)).alias("entries")))
    whole = F.when(F.col("all").isNull() | F.exists("all", lambda p: p["entries"].isNull()), loose).otherwise(F.col("all"))
    pools = text.select(*kept, F.posexplode(whole).alias("pool", "p")).withColumns({"number": number, "r": r})
    total = F.aggregate("p.entries", F.lit(0).cast("long"), lambda s, e: s + weight(e))  # once a pool, not once an entry
    pool = F.struct(F.col("pool").cast("string").alias("path"), F.array("p.condition").alias("above"), mean_of(F.col("number"), F.col("r")).alias("rolls"), total.alias("total"))
    first = pools.select(*kept, pool.alias("in"), "p.entries").select(*kept, "in", F.posexplode("entries").alias("place", "e"))

    def made(level: DataFrame) -> DataFrame:
        e = level.select(*kept, F.concat_ws(".", "in.path", "place").alias("path"), bare(F.col("e.type")).alias("kind"), F.array_compact(F.concat("in.above", F.array("e.condition"))).alias("above"), "in.rolls", "in.total", "e")
        chance = F.when(F.col("e.condition").isNull() & F.col("rolls").isNotNull(), weight(F.col("e")) / F.col("total"))
        columns = {"item": bare(F.col("e.name")), "modifier": F.col("e.modifier"), "chance": chance, "rolls": F.when(chance.isNotNull(), F.col("rolls"))}
        inside = F.when(F.col("kind").isin(*CONTAINERS), F.col("e.children"))
        return written(e.select(*kept, "path", "kind", "above", *(F.when(F.col("kind") == "item", c).alias(n) for n, c in columns.items()), inside.alias("children")), "loot")

    levels = [made(first)]
    for _ in range(most):
        within = F.struct("path", "above", F.lit(None).cast("double").alias("rolls"), F.lit(None).cast("long").alias("total"))
        below = levels[-1].where("children is not null").select(*kept, within.alias("in"), F.posexplode("children").alias("place", "c"))
        levels.append(made(below.select(*kept, "in", "place", F.from_json("c", ENTRY).alias("e"))))
        if levels[-1].isEmpty():
            break
    else:
        if not levels[-1].where("children is not null").isEmpty():
            raise LootError(f"entries nested deeper than {most}")
    return reduce(DataFrame.unionByName, levels).drop("children")


def leaves_of(nodes: DataFrame, predicates: DataFrame) -> DataFrame:
    """The entries that name an item, with count_min, count_max, per_attempt, and gate: that of the first condition above them that
    has one.

    Chains of conditions and modifiers are few texts on many leaves, so each is read once.  Both are counted: few are broadcast; else
    chains meet the leaves by a shuffle, and each leaf's modifier is read where it stands."""
    items = nodes.where("kind = 'item'").drop("kind")
    each = written(items.select("above").distinct(), "chains").select("above", F.posexplode("above").alias("at", "condition"))
    by = written(each.join(gates(each.select("condition"), predicates), "condition").groupBy("above").agg(F.min_by("gate", "at").alias("gate")), "gates")
    texts = written(items.select("modifier").where("modifier is not null").distinct(), "modifiers")
    few = lambda df, text: (df.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0) <= FEW
    found = items.join(F.broadcast(by) if few(by, F.array_join("above", "")) else by.hint("merge"), "above", "left").drop("above")
    if few(texts, F.col("modifier")):
        one = F.lit(1)
        found = found.join(F.broadcast(with_counts(texts)), "modifier", "left").withColumns({c: F.coalesce(c, one) for c in ("count_min", "count_max")})
    else:
        found = with_counts(found)
    return found.drop("modifier").withColumn("per_attempt", per_attempt(F.col("chance"), F.col("rolls"), F.col("count_min"), F.col("count_max")))


def others_of(nodes: DataFrame) -> DataFrame:
    """The ledger of entries that name no single item and hold no others."""
    rest = nodes.where(~F.col("kind").isin("item", *CONTAINERS))
    return rest.withColumnRenamed("kind", "entry_type").drop("above", "item", "modifier", "chance", "rolls")


def walk(tables: DataFrame, predicates: DataFrame, key: str = "table", doc: str = "doc", most: int = 8, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """All leaves of the tables, and the ledger of entries that name no single item.

    Leaves: key, the columns to ``keep``, path (pool and places, joined by dots), item, count_min, count_max, gate, chance, rolls,
    per_attempt.  The gate of an entry holds for all below it.  Odds are those of an unconditioned entry directly in a pool whose
    rolls are a number: its weight over that of all direct entries of the pool, of whatever type.  Raises if entries nest deeper
    than ``most``."""
    nodes = entries(tables, key, doc, most, keep)
    return leaves_of(nodes, predicates), others_of(nodes)


def readable(tables: DataFrame, read: Sequence[str], skipped: Sequence[str], methods: Mapping[str, str], key: str = "table", doc: str = "doc") -> DataFrame:
    """The tables of the families (second part of the path) that are read, with their method by type; raises on an unknown
    family or type, as that would lose its tables.  They are written, so that no document is made again for what follows."""
    made = tables.withColumn("family", F.element_at(F.split(key, "/"), 2)).where(~F.col("family").isin(*skipped))
    kinds = F.create_map(*[F.lit(x) for pair in methods.items() for x in pair])
    made = written(made.withColumn("method", F.try_element_at(kinds, bare(F.get_json_object(doc, "$.type")))), "tables")
    bad = made.where(~F.col("family").isin(*read) | F.col("method").isNull()).select(key).orderBy(key).limit(5).collect()  # names for the message
    if bad:
        raise LootError("unknown family or type: " + ", ".join(str(r[0]) for r in bad))
    return made


def drop_producers(drops: DataFrame, names: DataFrame, notes: str = "notes") -> tuple[DataFrame, DataFrame]:
    """Producers (source, output, chance) of drops (source, item, chance, notes), and the ledger of the others.  ``names`` has name and
    id.  A name with one id is that item; else the links in the notes are, if every one of them has one id."""
    one = names.groupBy(F.lower("name").alias("name")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("name", "id")
    links = F.regexp_extract_all(F.coalesce(F.col(notes), F.lit("")), F.lit(r"\[\[([^\[\]|]+)"), F.lit(1))
    rows = drops.withColumn("__own", F.lower("item")).withColumn("__links", links)
    rows = rows.join(one.select(F.col("name").alias("__own"), F.col("id").alias("__id")), "__own", "left")
    linked = rows.where("__id is null and size(__links) > 0").select("source", "item", "chance", F.size("__links").alias("need"), F.explode("__links").alias("link"))
    found = linked.join(one, F.lower(F.trim("link")) == F.col("name"))
    whole = found.groupBy("source", "item", "chance", "need").agg(F.count("link").alias("n"), F.collect_set("id").alias("ids")).where("n = need")
    own = rows.where("__id is not null").select("source", F.col("__id").alias("output"), "chance")
    made = own.unionByName(whole.select("source", F.explode("ids").alias("output"), "chance"))
    lost = rows.where("__id is null").select("source", "item", "chance").join(whole.select("source", "item", "chance"), ["source", "item", "chance"], "left_anti")
    return made, lost


def trade_producers(sides: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, output, count and inputs (item and count, in order) of trades as ``facts.trades`` gives them, of those alone all of whose
    sides have a known name."""
    known = sides.join(names.groupBy(F.col("name").alias("item")).agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).where("n = 1"), "item", "left")
    by = known.groupBy(key).agg(F.bool_and(F.col("id").isNotNull()).alias("whole"), F.max(F.when(F.col("side") == "given", F.struct("id", "least"))).alias("g"), F.array_sort(F.collect_list(F.when(F.col("side") == "wanted", F.struct("place", "id", "least")))).alias("w"))
    return by.where("whole and g is not null").select(key, F.col("g.id").alias("output"), F.col("g.least").alias("count"), F.transform("w", lambda x: F.struct(x["id"].alias("item"), x["least"].alias("count"))).alias("inputs"))
