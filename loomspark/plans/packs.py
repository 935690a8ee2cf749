"""Data packs: one a supplier, with tags, biomes, structures and features whose documents differ in shape."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import world
from ..session import spread
from ..sources.tables import table
from .registry import query

_T, _B, _S, _SS, _F = "tags/worldgen/biome/", "worldgen/biome/", "worldgen/structure/", "worldgen/structure_set/", "worldgen/feature/"


def _biome(temperature: object, wet: object, spawns: object, **more: object) -> dict:
    return {"temperature": temperature, "downfall": 0.5, "has_precipitation": wet, "attributes": {"minecraft:gameplay/natural_mob_spawns": {"argument": {"spawns_by_category": spawns, "spawn_costs": {"cow": {"energy_budget": 0.1, "charge": 1}, "odd": 3}}}}} | more


# documents by path; N stands for a number of the pack
_PACK = {
    f"{_T}is_overworld.json": {"values": ["#minecraft:cold", "plains", {"id": "#more", "required": False}, {"id": "#minecraft:gone", "required": False}]},
    f"{_T}cold.json": {"values": ["minecraft:snowy_N", {"id": "minecraft:ice", "required": True}]},
    f"{_T}is_nether.json": {"replace": False, "values": ["minecraft:wastes"]},
    f"{_T}is_end.json": {"values": []},
    f"{_T}lost.json": {"values": ["#minecraft:nowhere", "plains"]},
    f"{_T}above_lost.json": {"values": ["#lost"]},
    f"{_T}ring/a.json": {"values": ["#ring/b"]},
    f"{_T}ring/b.json": {"values": ["#minecraft:ring/a", "plains"]},
    f"{_T}odd.json": {"values": ["Not An Id"]},
    f"{_T}shape.json": {"values": "plains"},
    f"{_T}list.json": [1],
    f"{_B}snowy_N.json": _biome(-0.5, True, {"creature": [{"type": "cow", "weight": 8, "count": 4}, {"type": "minecraft:cow", "weight": 2, "count": {"type": "minecraft:uniform", "min_inclusive": 1, "max_inclusive": 5}}, {"type": "wolf", "weight": 5, "count": 1}, {"type": "fox", "weight": 5, "count": True}, {"type": "fox", "weight": "5", "count": 1}, "x"], "monster": []}, temperature_modifier="frozen"),
    f"{_B}plains.json": _biome(0.8, True, {"creature": [{"type": "pig", "weight": 10, "count": {"min_inclusive": 2, "max_inclusive": 3}}], "misc": 5}, creature_spawn_probability=0.07),
    f"{_B}wastes.json": _biome(2, False, {}),
    f"{_B}void.json": _biome(0.5, False, {}),
    f"{_B}bad.json": _biome("hot", "yes", None),
    f"{_SS}villages.json": {"placement": {"type": "minecraft:random_spread", "spacing": 32, "separation": 8, "frequency": 0.5, "exclusion_zone": {"other_set": "x", "chunk_count": 10}, "salt": 7}, "structures": [{"structure": "minecraft:village", "weight": 2}, {"structure": "camp", "weight": 3}, {"structure": "odd", "weight": "3"}, 1]},
    f"{_SS}rings.json": {"placement": {"type": "minecraft:concentric_rings", "count": 128, "distance": 32, "spread": 3, "preferred_biomes": "#minecraft:cold"}, "structures": [{"structure": "minecraft:fort", "weight": 1}, {"structure": "both", "weight": 1}]},
    f"{_SS}badset.json": {"placement": {"type": "minecraft:random_spread", "spacing": 32}, "structures": [{"structure": "minecraft:alone", "weight": 1}]},
    f"{_S}village.json": {"type": "minecraft:jigsaw", "step": "surface", "biomes": "#minecraft:cold", "spawn_overrides": {"monster": {"spawns": [{"type": "pillager", "weight": 1, "minCount": 1, "maxCount": 2}, {"type": "x", "weight": 1, "minCount": 1}]}, "creature": {"spawns": []}, "ambient": 3}},
    f"{_S}camp.json": {"type": "minecraft:camp", "step": "surface", "biomes": "plains"},
    f"{_S}fort.json": {"type": "minecraft:fort", "step": "underground", "biomes": ["#is_nether", "minecraft:wastes", 5]},
    f"{_S}both.json": {"type": "minecraft:both", "step": "surface", "biomes": ["wastes", "#cold"]},
    f"{_S}alone.json": {"type": 5, "step": "surface", "biomes": "#minecraft:lost"},
    f"{_F}ore.json": {"type": "minecraft:ore", "size": 9, "targets": [{"state": "minecraft:iron_ore"}, {"state": {"id": "minecraft:deep_iron", "properties": {"a": "1"}}}, {"state": 3}, 4]},
    f"{_F}bush.json": {"type": "minecraft:simple_block", "to_place": {"id": "minecraft:bush_N"}},
    f"{_F}many.json": {"type": "minecraft:simple_block", "to_place": {"type": "minecraft:weighted", "id": "x"}},
    f"{_F}disk.json": {"type": "minecraft:disk", "state_provider": "minecraft:sand"},
    f"{_F}blob.json": {"type": "minecraft:block_blob", "state": {"id": "minecraft:mossy"}, "size": 4},
    f"{_F}tree.json": {"type": "minecraft:tree", "state": "minecraft:log"},
    f"{_F}none.json": {"size": 3},
    "recipe/x.json": {"type": "no part of it"},
}


def _files(spark: SparkSession, at: str) -> DataFrame:
    pack = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(json.dumps(d)).alias("doc")) for p, d in _PACK.items()), F.struct(F.lit(f"{_B}torn.json").alias("path"), F.lit("{").alias("doc")))
    each = spread(table(spark, at, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("key"), F.inline(pack))
    own = lambda c: F.replace(c, F.lit("_N"), F.concat(F.lit("_"), (F.col("key") % 5).cast("string")))
    return each.select("key", own(F.col("path")).alias("path"), own(F.col("doc")).alias("doc"))


def _rows(columns: str, *rows: tuple) -> str:
    """Stated rows for each pack, N its number."""
    lit = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else f"({v})::double" if isinstance(v, float) else str(v)
    said = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    text = [c for i, c in enumerate(columns.split(", ")) if any(isinstance(r[i], str) for r in rows)]
    return f"select s_suppkey as key, {', '.join(f'replace({c}, ' + chr(39) + '_N' + chr(39) + ', ' + chr(39) + '_' + chr(39) + f' || s_suppkey % 5) as {c}' if c in text else c for c in columns.split(', '))} from supplier, (values {said}) v({columns})"


@query(_rows("tag, id", *((f"minecraft:{t}", f"minecraft:{i}") for t, i in (("is_overworld", "snowy_N"), ("is_overworld", "ice"), ("is_overworld", "plains"), ("cold", "snowy_N"), ("cold", "ice"), ("is_nether", "wastes")))))
def tag_members(spark: SparkSession, at: str) -> DataFrame:
    """Tags whose references are followed; optional ones may lead nowhere."""
    return world.tag_members(_files(spark, at), "worldgen/biome")[0]


@query(_rows("path, reason", *((f"{_T}{p}.json", r) for p, r in (("lost", "no such tag: minecraft:nowhere"), ("above_lost", "it reaches a tag with a fault"), ("ring/a", "it reaches itself"), ("ring/b", "it reaches itself"), ("odd", "no resource id: Not An Id"), ("shape", "no list of values"), ("list", "no JSON object")))))
def tag_faults(spark: SparkSession, at: str) -> DataFrame:
    return world.tag_members(_files(spark, at), "worldgen/biome")[1]


def _members(spark: SparkSession, at: str) -> DataFrame:
    return world.tag_members(_files(spark, at), "worldgen/biome")[0]


@query(_rows("id, dimension, temperature, modifier, downfall, falls, probability", ("minecraft:snowy_N", "overworld", -0.5, "frozen", 0.5, "snow", None), ("minecraft:plains", "overworld", 0.8, None, 0.5, "rain", 0.07), ("minecraft:wastes", "nether", 2.0, None, 0.5, "none", None), ("minecraft:void", None, 0.5, None, 0.5, "none", None)))
def extract_biomes(spark: SparkSession, at: str) -> DataFrame:
    return world.biomes(_files(spark, at), _members(spark, at)).rows


@query(_rows("id, category, mob, weight, least, most, total, energy, charge", ("minecraft:snowy_N", "creature", "minecraft:cow", 10, 1, 5, 15, None, None), ("minecraft:snowy_N", "creature", "minecraft:wolf", 5, 1, 1, 15, None, None), ("minecraft:plains", "creature", "minecraft:pig", 10, 2, 3, 10, None, None),
             *((f"minecraft:{b}", "cost", "minecraft:cow", None, None, None, None, 0.1, 1.0) for b in ("snowy_N", "plains", "wastes", "void"))))
def biome_spawns(spark: SparkSession, at: str) -> DataFrame:
    return world.biomes(_files(spark, at), _members(spark, at)).parts


@query(_rows("id, type, step, dimension, set_id, n_biomes, kind, spacing, frequency, other_set, n, preferred", ("minecraft:village", "minecraft:jigsaw", "surface", "overworld", "minecraft:villages", 2, "minecraft:random_spread", 32, 0.5, "x", None, None),
             ("minecraft:camp", "minecraft:camp", "surface", "overworld", "minecraft:villages", 1, "minecraft:random_spread", 32, 0.5, "x", None, None), ("minecraft:fort", "minecraft:fort", "underground", "nether", "minecraft:rings", 1, "minecraft:concentric_rings", None, None, None, 128, "#minecraft:cold")))
def extract_structures(spark: SparkSession, at: str) -> DataFrame:
    rows = world.structures(_files(spark, at), _members(spark, at)).rows
    return rows.select("key", "id", "type", "step", "dimension", "set_id", "n_biomes", *(f"placement.{c}" for c in ("kind", "spacing", "frequency", "other_set", "n", "preferred")))


@query(_rows("id, part, name, category, weight, least, most", ("minecraft:village", "biome", "minecraft:snowy_N", None, None, None, None), ("minecraft:village", "biome", "minecraft:ice", None, None, None, None), ("minecraft:village", "spawn", "minecraft:pillager", "monster", 1, 1, 2), ("minecraft:village", "suppressed", None, "creature", None, None, None),
             ("minecraft:village", "sibling", "minecraft:camp", None, 3, None, None), ("minecraft:camp", "sibling", "minecraft:village", None, 2, None, None), ("minecraft:camp", "biome", "minecraft:plains", None, None, None, None), ("minecraft:fort", "biome", "minecraft:wastes", None, None, None, None), ("minecraft:fort", "sibling", "minecraft:both", None, 1, None, None)))
def structure_parts(spark: SparkSession, at: str) -> DataFrame:
    return world.structures(_files(spark, at), _members(spark, at)).parts


@query(_rows("id, type, vein, place, block", ("minecraft:ore", "minecraft:ore", 9, 0, "minecraft:iron_ore"), ("minecraft:ore", "minecraft:ore", 9, 1, "minecraft:deep_iron"), ("minecraft:bush", "minecraft:simple_block", None, 0, "minecraft:bush_N"), ("minecraft:many", "minecraft:simple_block", None, None, None), ("minecraft:disk", "minecraft:disk", None, 0, "minecraft:sand"), ("minecraft:blob", "minecraft:block_blob", None, 0, "minecraft:mossy"), ("minecraft:tree", "minecraft:tree", None, None, None)))
def worldgen_blocks(spark: SparkSession, at: str) -> DataFrame:
    made = world.placed_blocks(_files(spark, at))
    return made.rows.join(made.parts, ["key", "id"], "left")


@query(_rows("path, reason", *((f"{_B}bad.json", r) for r in ("no temperature", "no precipitation", "no spawns")), (f"{_B}torn.json", "no JSON object"), (f"{_S}both.json", "not in exactly one dimension"), (f"{_SS}badset.json", "no spacing or separation"), (f"{_F}none.json", "no type"),
             *((f"{_S}alone.json", r) for r in ("no type", "not in exactly one dimension", "no set places it", "no such tag: minecraft:lost"))))
def pack_faults(spark: SparkSession, at: str) -> DataFrame:
    """The ledgers of all folders."""
    files, members = _files(spark, at), _members(spark, at)
    return world.biomes(files, members).faults.unionByName(world.structures(files, members).faults).unionByName(world.placed_blocks(files).faults)
