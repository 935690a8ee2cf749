"""Documents of a data pack whose shape depends on what they are, as VARIANT columns: tags, biomes, structures and their sets, features.

``files`` has key (the pack), path and doc (JSON).  A document that can't be read as what its folder says gives no row, but one in the
ledger (key, path, reason); the other documents of the pack are not held up by it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .facts import precipitation
from .graph import closure

#: The namespace of names without one, folders, the tags of the dimensions, where biomes say what spawns.
NAMESPACE = "minecraft"
BIOMES, STRUCTURES, SETS, FEATURES = "worldgen/biome/", "worldgen/structure/", "worldgen/structure_set/", "worldgen/feature/"
DIMENSIONS = {"overworld": "is_overworld", "nether": "is_nether", "end": "is_end"}
SPAWNS = "$.attributes['minecraft:gameplay/natural_mob_spawns'].argument"
_ID = r"^[a-z0-9_.-]+:(?!.*(?:^|/)\.{1,2}(?:/|$))[a-z0-9_.-]+(?:/[a-z0-9_.-]+)*$"


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(_part(v, path))


def text_at(v: Column, path: str) -> Column:
    """A text there, null where anything else stands."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def whole_at(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "BIGINT", F.try_variant_get(v, path, "long"))


def number_at(v: Column, path: str) -> Column:
    return F.when(_kind(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double"))


def truth_at(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def list_at(v: Column, path: str) -> Column:
    return F.when(_kind(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def fields_at(v: Column, path: str) -> Column:
    return F.when(_kind(v, path).startswith("OBJECT"), F.try_variant_get(v, path, "map<string,variant>"))


def namespaced(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(":")), name).otherwise(F.concat(F.lit(f"{NAMESPACE}:"), name))


class Read(NamedTuple):
    """Documents of a folder: key, path, id and v (VARIANT); and the ledger of those that are no JSON object."""

    rows: DataFrame
    faults: DataFrame


def read(files: DataFrame, folder: str) -> Read:
    inside = files.where(F.startswith("path", F.lit(folder)) & F.endswith("path", F.lit(".json"))).select("key", "path", namespaced(F.expr(f"substring(path, {len(folder) + 1}, length(path) - {len(folder) + 5})")).alias("id"), F.try_parse_json("doc").alias("v"))
    good = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return Read(inside.where(good), inside.where(~good).select("key", "path", F.lit("no JSON object").alias("reason")))


def tag_members(files: DataFrame, registry: str) -> tuple[DataFrame, DataFrame]:
    """key, tag and id of all members of the tags of a registry, references followed to any depth; and the ledger, with path the tag's.

    An optional reference to a tag that the pack does not hold is left out before anything is followed; a required one is a fault, as are
    names that are no resource id, documents of another shape, and tags that reach themselves.  A tag that reaches a fault has no
    members, and a row of its own in the ledger; all others are whole."""
    docs, bad = read(files, f"tags/{registry}/")
    docs = written(docs.withColumn("values", list_at(F.col("v"), "$.values")), "tags")
    entry = docs.where("values is not null").select("key", "path", F.col("id").alias("tag"), F.explode("values").alias("e"))
    name, needed = F.coalesce(text_at(F.col("e"), "$"), text_at(F.col("e"), "$.id")), F.coalesce(truth_at(F.col("e"), "$.required"), F.lit(True))
    named = entry.select("key", "path", "tag", name.alias("name"), needed.alias("needed"), F.startswith(name, F.lit("#")).alias("refers"), namespaced(F.trim(F.regexp_replace(name, "^#", ""))).alias("id"))
    named = written(named.withColumn("sound", F.coalesce(F.col("id").rlike(_ID), F.lit(False))), "entries")
    held = docs.select("key", F.col("id")).withColumn("held", F.lit(True))
    refs = written(named.where("refers and sound").join(held, ["key", "id"], "left").where("needed or held"), "references")

    lost = refs.where("held is null").select("key", "path", "tag", F.concat(F.lit("no such tag: "), "id").alias("reason"))
    odd = named.where("not sound").select("key", "path", "tag", F.concat(F.lit("no resource id: "), F.coalesce("name", F.lit("null"))).alias("reason"))
    shape = docs.where("values is null").select("key", "path", F.col("id").alias("tag"), F.lit("no list of values").alias("reason"))
    node = lambda c: F.to_json(F.struct("key", F.col(c).alias("t")))
    steps = refs.where("held").select(node("tag").alias("s"), node("id").alias("d"))
    reach = closure(steps, "s", "d") if not steps.isEmpty() else steps.withColumn("depth", F.lit(0))
    keys = docs.select("key", "path", F.col("id").alias("tag"), node("id").alias("n"))
    turns = keys.join(reach.where("s = d"), F.col("n") == F.col("s")).select("key", "path", "tag", F.lit("it reaches itself").alias("reason"))
    own = written(lost.unionByName(odd).unionByName(shape).unionByName(turns).distinct(), "faults")
    nodes = own.select(node("tag").alias("d")).distinct()
    above = reach.join(nodes, "d").select(F.col("s").alias("n")).distinct()
    spoiled = keys.join(above, "n").select("key", "path", "tag", F.lit("it reaches a tag with a fault").alias("reason"))
    faults = own.unionByName(spoiled.join(own.select("key", "tag"), ["key", "tag"], "left_anti"))
    whole = keys.join(faults.select("key", "tag").distinct(), ["key", "tag"], "left_anti")
    plain = named.where("sound and not refers").select(node("tag").alias("d"), "id")
    below = whole.select("key", "tag", F.col("n").alias("d")).union(whole.join(reach, F.col("n") == F.col("s")).select("key", "tag", "d"))
    return below.join(plain, "d").select("key", "tag", "id").distinct(), faults.select("key", "path", "reason").unionByName(bad)


def dimensions(members: DataFrame) -> DataFrame:
    """key, id and dimension of the biomes of the dimensions' tags."""
    rows = members.withColumn("dimension", F.coalesce(*(F.when(F.col("tag") == f"{NAMESPACE}:{t}", F.lit(d)) for d, t in DIMENSIONS.items())))
    return rows.where("dimension is not null").select("key", "id", "dimension").distinct()


class World(NamedTuple):
    """What a folder holds: rows (one a document), parts (rows within them) and the ledger."""

    rows: DataFrame
    parts: DataFrame
    faults: DataFrame


def _ledger(docs: DataFrame, faults: list[tuple[Column, str]], more: DataFrame, bad: DataFrame) -> DataFrame:
    own = docs.select("key", "path", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for c, r in faults)))).alias("reason"))
    return written(own.unionByName(more).unionByName(bad).distinct(), "ledger")


def biomes(files: DataFrame, members: DataFrame) -> World:
    """Rows: key, id, dimension (null where no tag has it), temperature, modifier, downfall, falls ('rain', 'snow', 'none'), probability.
    Parts: key, id, category, mob, weight, least, most and total (of the category's weights); the entries of one mob are one, entries
    without a whole weight or a group size (a number, or a pair of a uniform provider) are left out; and the costs of mobs as
    rows with category 'cost', energy and charge."""
    docs, bad = read(files, BIOMES)
    v = F.col("v")
    docs = written(docs.select("key", "path", "id", "v", number_at(v, "$.temperature").alias("temperature"), text_at(v, "$.temperature_modifier").alias("modifier"), number_at(v, "$.downfall").alias("downfall"), truth_at(v, "$.has_precipitation").alias("wet"), number_at(v, "$.creature_spawn_probability").alias("probability"), fields_at(v, f"{SPAWNS}.spawns_by_category").alias("spawns"), fields_at(v, f"{SPAWNS}.spawn_costs").alias("costs")).drop("v"), "biomes")
    of = dimensions(members).groupBy("key", "id").agg(F.count("*").alias("n"), F.min("dimension").alias("dimension"))
    several = docs.join(of.where("n > 1"), ["key", "id"]).select("key", "path", F.lit("in more than one dimension").alias("reason"))
    faults = _ledger(docs, [(F.col(c).isNull(), f"no {n}") for c, n in (("temperature", "temperature"), ("downfall", "downfall"), ("wet", "precipitation"), ("spawns", "spawns"))], several, bad)
    fine = docs.join(faults.select("key", "path").distinct(), ["key", "path"], "left_anti")
    rows = fine.join(of, ["key", "id"], "left").select("key", "id", "dimension", "temperature", "modifier", "downfall", precipitation(F.col("wet"), F.col("temperature")).alias("falls"), "probability")
    e = F.col("e")
    each = fine.select("key", "id", F.explode("spawns").alias("category", "l")).select("key", "id", "category", F.explode(list_at(F.col("l"), "$")).alias("e"))
    size = F.when(whole_at(e, "$.count").isNotNull(), F.struct(whole_at(e, "$.count").alias("least"), whole_at(e, "$.count").alias("most"))).otherwise(F.struct(whole_at(e, "$.count.min_inclusive").alias("least"), whole_at(e, "$.count.max_inclusive").alias("most")))
    sized = each.select("key", "id", "category", namespaced(text_at(e, "$.type")).alias("mob"), whole_at(e, "$.weight").alias("weight"), size.alias("g")).where("mob is not null and weight is not null and g.least is not null and g.most is not null")
    merged = written(sized.groupBy("key", "id", "category", "mob").agg(F.sum("weight").alias("weight"), F.min("g.least").alias("least"), F.max("g.most").alias("most")), "spawns")
    totals = merged.groupBy("key", "id", "category").agg(F.sum("weight").alias("total"))
    cost = fine.select("key", "id", F.explode("costs").alias("mob", "c"))
    costs = cost.select("key", "id", F.lit("cost").alias("category"), namespaced(F.col("mob")).alias("mob"), number_at(F.col("c"), "$.energy_budget").alias("energy"), number_at(F.col("c"), "$.charge").alias("charge")).where("energy is not null or charge is not null")
    parts = merged.join(totals, ["key", "id", "category"]).unionByName(costs, allowMissingColumns=True)
    return World(rows, parts, faults)


def structures(files: DataFrame, members: DataFrame) -> World:
    """Rows: key, id, type, step, dimension, set_id, n_biomes and placement (kind, then what its kind has).  Parts: key, id, part
    ('biome', 'spawn', 'suppressed', 'sibling') and what it has: name, category, weight, least and most.

    Biomes are an id, a tag, or a list of both.  A structure needs biomes of exactly one dimension and a set that places it (the
    last by name, where several do); a category of spawn overrides without entries is suppressed."""
    sets, bad_sets = read(files, SETS)
    v, p, s = F.col("v"), "$.placement", F.col("s")
    kind = text_at(v, f"{p}.type")
    spread = F.struct(kind.alias("kind"), whole_at(v, f"{p}.spacing").alias("spacing"), whole_at(v, f"{p}.separation").alias("separation"), text_at(v, f"{p}.spread_type").alias("spread_type"), number_at(v, f"{p}.frequency").alias("frequency"), text_at(v, f"{p}.exclusion_zone.other_set").alias("other_set"), whole_at(v, f"{p}.exclusion_zone.chunk_count").alias("chunk_count"), whole_at(v, f"{p}.count").alias("n"), whole_at(v, f"{p}.distance").alias("distance"), whole_at(v, f"{p}.spread").alias("spread"), text_at(v, f"{p}.preferred_biomes").alias("preferred"), whole_at(v, f"{p}.salt").alias("salt"))
    sets = written(sets.select("key", "path", F.col("id").alias("set_id"), spread.alias("placement"), list_at(v, "$.structures").alias("members")), "sets")
    q = lambda *names: F.coalesce(*(F.when(F.col(f"placement.{n}").isNull(), F.lit(True)) for n in names), F.lit(False))
    random_, rings = F.col("placement.kind") == "minecraft:random_spread", F.col("placement.kind") == "minecraft:concentric_rings"
    of_sets = _ledger(sets, [(F.coalesce(~random_ & ~rings, F.lit(True)), "unknown placement"), (random_ & q("spacing", "separation"), "no spacing or separation"), (rings & q("n", "distance", "spread", "preferred"), "no count, distance, spread or biomes"), (F.col("members").isNull(), "no list of structures")], bad_sets.limit(0), bad_sets)
    good_sets = sets.join(of_sets.select("key", "path").distinct(), ["key", "path"], "left_anti")
    listed = good_sets.select("key", "set_id", "placement", F.explode("members").alias("s")).select("key", "set_id", "placement", namespaced(text_at(s, "$.structure")).alias("id"), whole_at(s, "$.weight").alias("weight")).where("id is not null and weight is not null")
    listed = written(listed, "listed")
    placed = listed.groupBy("key", "id").agg(F.max_by(F.struct("set_id", "placement"), "set_id").alias("of"))

    docs, bad = read(files, STRUCTURES)
    docs = written(docs.select("key", "path", "id", text_at(v, "$.type").alias("type"), text_at(v, "$.step").alias("step"), F.coalesce(list_at(v, "$.biomes"), F.when(text_at(v, "$.biomes").isNotNull(), F.array(_part(v, "$.biomes")))).alias("biomes"), fields_at(v, "$.spawn_overrides").alias("overrides")), "structures")
    names = docs.select("key", "id", F.explode("biomes").alias("b")).select("key", "id", text_at(F.col("b"), "$").alias("name")).where("name is not null").withColumn("is_tag", F.startswith("name", F.lit("#"))).withColumn("name", namespaced(F.regexp_replace("name", "^#", "")))
    of_tags = names.where("is_tag").join(members.select("key", F.col("tag").alias("name"), F.col("id").alias("biome")), ["key", "name"]).select("key", "id", "biome")
    held = written(of_tags.union(names.where("not is_tag").select("key", "id", "name")).distinct(), "held")
    unknown = names.where("is_tag").join(members.select("key", F.col("tag").alias("name")).distinct(), ["key", "name"], "left_anti")
    lost = docs.select("key", "path", "id").join(unknown.select("key", "id", "name"), ["key", "id"]).select("key", "path", F.concat(F.lit("no such tag: "), "name").alias("reason"))
    by_world = held.join(dimensions(members).withColumnRenamed("id", "biome"), ["key", "biome"]).groupBy("key", "id").agg(F.count_distinct("dimension").alias("n"), F.min("dimension").alias("dimension"))
    met = written(docs.join(by_world, ["key", "id"], "left").join(placed, ["key", "id"], "left"), "structures")
    faults = _ledger(met, [(F.col("type").isNull(), "no type"), (F.col("step").isNull(), "no step"), (F.col("biomes").isNull(), "no biomes"), (F.coalesce("n", F.lit(0)) != 1, "not in exactly one dimension"), (F.col("of").isNull(), "no set places it")], lost, bad)
    fine = written(met.join(faults.select("key", "path").distinct(), ["key", "path"], "left_anti"), "structures")
    counts = held.groupBy("key", "id").agg(F.count("*").alias("n_biomes"))
    rows = fine.join(counts, ["key", "id"]).select("key", "id", "type", "step", "dimension", F.col("of.set_id").alias("set_id"), "n_biomes", F.col("of.placement").alias("placement"))

    ids = fine.select("key", "id")
    cats = fine.select("key", "id", F.explode("overrides").alias("category", "o")).withColumn("spawns", list_at(F.col("o"), "$.spawns")).where("spawns is not null")
    e = F.col("e")
    spawns = cats.select("key", "id", "category", F.explode("spawns").alias("e")).select("key", "id", F.lit("spawn").alias("part"), namespaced(text_at(e, "$.type")).alias("name"), "category", whole_at(e, "$.weight").alias("weight"), whole_at(e, "$.minCount").alias("least"), whole_at(e, "$.maxCount").alias("most")).where("name is not null and weight is not null and least is not null and most is not null")
    quiet = cats.where("size(spawns) = 0").select("key", "id", F.lit("suppressed").alias("part"), "category")
    # siblings are read off the sets: the others of the set that places a structure
    mates = fine.select("key", "id", F.col("of.set_id").alias("set_id")).join(listed.select("key", "set_id", F.col("id").alias("name"), "weight"), ["key", "set_id"]).where("name <> id").select("key", "id", F.lit("sibling").alias("part"), "name", "weight")
    biomes_ = ids.join(held, ["key", "id"]).select("key", "id", F.lit("biome").alias("part"), F.col("biome").alias("name"))
    parts = spawns.unionByName(quiet, allowMissingColumns=True).unionByName(mates, allowMissingColumns=True).unionByName(biomes_, allowMissingColumns=True)
    return World(rows, parts, faults.unionByName(of_sets))


def placed_blocks(files: DataFrame) -> World:
    """Rows: key, id, type and vein (size of an ore).  Parts: key, id, place and block of what features put down.  Where that stands
    depends on the type; what places several blocks by a rule, and other types, name none."""
    docs, bad = read(files, FEATURES)
    v = F.col("v")

    def state(path: str) -> Column:
        return F.coalesce(text_at(v, path), text_at(v, f"{path}.id"))

    def provider(path: str) -> Column:
        return F.when(_part(v, f"{path}.type").isNull(), state(path))

    kind = F.col("type")
    ore = kind.isin("minecraft:ore", "minecraft:scattered_ore")
    targets = F.transform(list_at(v, "$.targets"), lambda t: F.coalesce(text_at(t, "$.state"), text_at(t, "$.state.id")))
    one = F.when(kind == "minecraft:simple_block", provider("$.to_place")).when(kind == "minecraft:disk", provider("$.state_provider")).when(kind == "minecraft:block_blob", state("$.state"))
    docs = docs.withColumn("type", text_at(v, "$.type"))
    made = written(docs.select("key", "path", "id", "type", F.when(ore, whole_at(v, "$.size")).alias("vein"), F.when(ore, targets).when(one.isNotNull(), F.array(one)).alias("blocks")), "features")
    faults = _ledger(made, [(F.col("type").isNull(), "no type")], bad.limit(0), bad)
    fine = made.where("type is not null")
    parts = fine.select("key", "id", F.posexplode(F.array_compact("blocks")).alias("place", "block"))
    return World(fine.select("key", "id", "type", "vein"), parts, faults)
