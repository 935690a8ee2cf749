"""Whole wiki pages: climate tables, edition scopes, brewing and effect pages; pages are made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import editions
from ..operators import brewing as brews, noise
from ..session import spread
from ..sources.tables import table
from .registry import query

_CLIMATE = """== Biomes ==
=== Overworld ===
'''Temperature''' has levels; the ranges from level 0 to level 4 are: -1.0~-0.45, -0.45~-0.15, -0.15~0.2, 0.2~0.55, 0.55~1.0.
'''Humidity''' too: from level 0 to level 4 are: -1.0~-0.35, -0.35~-0.1, -0.1~0.1, 0.1~0.3, 0.3~1.0.
'''Continentalness''':
* If -1.2~-1.05: Mushroom fields
* If -1.05~-0.455: Deep oceans
* If -0.455~-0.19: Oceans
* If -0.19~-0.11: Coast
* If -0.11~0.03: Near-inland
* If 0.03~0.3: Mid-inland
* If 0.3~1.0: Far-inland
'''Erosion''': from level 0 to level 6 are: -1.0~-0.78, -0.78~-0.375, -0.375~-0.2225, -0.2225~0.05, 0.05~0.45, 0.45~0.55, 0.55~1.0.
'''PV''' is made of weirdness:
* If -1.0~-0.85: Valleys
* If 0.2~0.7: High
* If 0.7~1.0: Peaks
'''Depth''' says:
{| class=a
! Depth
! More
! Biomes
|-
| D=0 || N/A || All surface biomes {{BiomeLink|B}}
|-
| D=0.2~0.9 || N/A || {{BiomeLink|A}}<ref>{{BiomeLink|C}}</ref>
|-
| D=1.1 || E<0
and more || {{BiomeLink|B}} {{BiomeLink|U}}
|}
{| class=b
! T !! Oceans !! Deep oceans !! Mushroom fields
|-
| T{{=}}0 || colspan=2 | {{BiomeLink|A}} || rowspan=5 | {{BiomeLink|C}}
|-
| T{{=}}1 || {{BiomeLink|A}} || {{BiomeLink|B}}
|-
| T=2 || {{BiomeLink|A}} || none
|-
| T=3 || none || none
|-
| T=4 || none || none
|}
{| class=other
! Not a climate
|-
| {{BiomeLink|A}}
|}
{|
! Erosion
! PV
! Coast !! Near-inland !! Mid-inland !! Far-inland
|-
| E=0 || Valleys || {{BiomeLink|A}} || {{BiomeLink|A}} || Middle biomes (T<4)<br>{{BiomeLink|B}} || Middle biomes（T<4）
|-
| E=1 || Valleys || {{BiomeLink|A}} || {{BiomeLink|A}} || Shattered biomes || Middle biomes (T<4)
|-
| E=2 || High~Peaks || colspan=4 | {{BiomeLink|A}} (W<0)<br/>{{BiomeLink|C}} (W>0)
|}
By the '''beach biomes''':
{|
! T !! Biome
|-
| T=0 || {{BiomeLink|A}}
|-
| T=1~4 || {{BiomeLink|B}}
|}
'''Badland biomes'''
{|
! H !! Biome
|-
| H=0~2 || {{BiomeLink|C}}
|}
'''Middle biomes'''
{|
! H !! T=0 !! T=1 !! T=2 !! T=3 !! T=4
|-
| H=0 || {{BiomeLink|A}} (W<0)<br>{{BiomeLink|B}} (other) || x || x || x || {{BiomeLink|Odd one}}
|}
PLATEAU'''Shattered biomes'''
{|
! H !! T=0~1 !! T=2 !! T=3 !! T=4
|-
| H=0~1 || {{BiomeLink|B}} || x || x || x
|-
| H=2 || x || x || x || {{BiomeLink|A}}
|}
=== Nether ===
{|
! Depth
|-
| none
|}
"""
_PLATEAU = "'''Plateau biomes''' of the upcoming version\n{|\n! H !! a !! b !! c !! d !! e\n|-\n| H=0 || x || x || x || x || {{BiomeLink|A}}\n|}\n" + "words " * 80 + "'''Plateau biomes'''\n{|\n! H !! a !! b !! c !! d !! e\n|-\n| H=0 || {{BiomeLink|C}} || x || x || x || x\n|}\n"


def _climate_pages(spark: SparkSession, at: str) -> DataFrame:
    """One page a supplier; every tenth lacks the table of plateaus, every tenth the legend of humidity."""
    k = F.col("s_suppkey")
    text = F.replace(F.lit(_CLIMATE), F.lit("PLATEAU"), F.when(k % 10 == 3, "").otherwise(_PLATEAU))
    for i, letter in enumerate("ABC"):
        text = F.replace(text, F.lit(f"BiomeLink|{letter}}}"), F.concat(F.lit("BiomeLink|Biome "), ((k + i) % 7).cast("string"), F.lit("}")))
    text = F.replace(text, F.lit("BiomeLink|U}"), F.concat(F.lit("BiomeLink|Unknown "), (k % 3).cast("string"), F.lit("}")))
    text = F.when(k % 10 == 4, F.replace(text, F.lit("'''Humidity'''"), F.lit("Humidity"))).otherwise(text)
    return spread(table(spark, at, "supplier"), "s_suppkey").select("s_suppkey", text.alias("text"))


def _biomes(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """Display names, and the registry."""
    own = table(spark, at, "supplier").select(F.concat(F.lit("minecraft:biome_"), (F.col("s_suppkey") % 7).cast("string")).alias("id")).distinct()
    odd = own.agg(F.min("id").alias("id")).select(F.lit("ODD ONE").alias("name"), "id")
    return odd, own


# biome, sibling (letters), route, group, temperature, humidity, continentalness, erosion, weirdness, pv, depth, requirement, condition, t, h, e, c levels, pv band
_SET = """(values
 ('A', null, 'depth', null, null, null, null, null, null, null, '0.2~0.9', null, null, null, null, null, null, null), ('B', null, 'depth', null, null, null, null, null, null, null, '1.1', 'E<0, and more', null, null, null, null, null, null),
 ('A', null, 'non_inland', null, 'T=0 (-1.0~-0.45)', null, 'Oceans, Deep oceans (-1.05~-0.19)', null, null, null, null, null, null, '0', null, null, '1,2', null),
 ('A', null, 'non_inland', null, 'T=1 (-0.45~-0.15)', null, 'Oceans (-0.455~-0.19)', null, null, null, null, null, null, '1', null, null, '2', null), ('B', null, 'non_inland', null, 'T=1 (-0.45~-0.15)', null, 'Deep oceans (-1.05~-0.455)', null, null, null, null, null, null, '1', null, null, '1', null),
 ('A', null, 'non_inland', null, 'T=2 (-0.15~0.2)', null, 'Oceans (-0.455~-0.19)', null, null, null, null, null, null, '2', null, null, '2', null), ('C5', null, 'non_inland', null, 'T=0-4 (-1.0~1.0)', null, 'Mushroom fields (-1.2~-1.05)', null, null, null, null, null, null, '0,1,2,3,4', null, null, '0', null),
 ('A', 'C', 'direct_inland', null, null, null, 'Coast to Near-inland (-0.19~0.03)', 'E=0-1 (-1.0~-0.375)', null, 'Valleys (-1.0~-0.85)', null, null, null, null, null, '0,1', '3,4', 'Valleys'), ('B', null, 'direct_inland', null, null, null, 'Mid-inland (0.03~0.3)', 'E=0 (-1.0~-0.78)', null, 'Valleys (-1.0~-0.85)', null, null, null, null, null, '0', '5', 'Valleys'),
 ('A', 'C', 'direct_inland', null, null, null, 'Coast to Far-inland (-0.19~1.0)', 'E=2 (-0.375~-0.2225)', null, 'High~Peaks (0.2~1.0)', null, null, 'W<0', null, null, '2', '3,4,5,6', 'High~Peaks'), ('C', 'A', 'direct_inland', null, null, null, 'Coast to Far-inland (-0.19~1.0)', 'E=2 (-0.375~-0.2225)', null, 'High~Peaks (0.2~1.0)', null, null, 'W>0', null, null, '2', '3,4,5,6', 'High~Peaks'),
 ('A', null, 'group', 'Beach biomes', 'T=0 (-1.0~-0.45)', 'Any', null, null, null, null, null, null, null, '0', '0,1,2,3,4', null, null, null), ('B', null, 'group', 'Beach biomes', 'T=1~4 (-0.45~1.0)', 'Any', null, null, null, null, null, null, null, '1,4', '0,1,2,3,4', null, null, null), ('C', null, 'group', 'Badland biomes', 'T=4 (0.55~1.0)', 'H=0~2 (-1.0~0.1)', null, null, null, null, null, null, null, '4', '0,2', null, null, null),
 ('A', 'B', 'group', 'Middle biomes', 'T=0 (-1.0~-0.45)', 'H=0 (-1.0~-0.35)', null, null, 'W<0', null, null, null, null, '0', '0', null, null, null), ('B', 'A', 'group', 'Middle biomes', 'T=0 (-1.0~-0.45)', 'H=0 (-1.0~-0.35)', null, null, null, null, null, null, 'other', '0', '0', null, null, null), ('O', null, 'group', 'Middle biomes', 'T=4 (0.55~1.0)', 'H=0 (-1.0~-0.35)', null, null, null, null, null, null, null, '4', '0', null, null, null),
 ('C', null, 'group', 'Plateau biomes', 'T=0 (-1.0~-0.45)', 'H=0 (-1.0~-0.35)', null, null, null, null, null, null, null, '0', '0', null, null, null), ('B', null, 'group', 'Shattered biomes', 'T=0~1 (-1.0~-0.15)', 'H=0~1 (-1.0~-0.1)', null, null, null, null, null, null, null, '0,1', '0,1', null, null, null), ('A', null, 'group', 'Shattered biomes', 'T=4 (0.55~1.0)', 'H=2 (-0.1~0.1)', null, null, null, null, null, null, null, '4', '2', null, null, null),
 ('ABO', null, 'group_terrain', 'Middle biomes', null, null, 'Mid-inland to Far-inland (0.03~1.0)', 'E=0 (-1.0~-0.78)', null, 'Valleys (-1.0~-0.85)', null, null, 'T<4', null, null, '0', '5,6', 'Valleys'), ('ABO', null, 'group_terrain', 'Middle biomes', null, null, 'Far-inland (0.3~1.0)', 'E=1 (-0.78~-0.375)', null, 'Valleys (-1.0~-0.85)', null, null, 'T<4', null, null, '1', '6', 'Valleys'),
 ('AB', null, 'group_terrain', 'Shattered biomes', null, null, 'Mid-inland (0.03~0.3)', 'E=1 (-0.78~-0.375)', null, 'Valleys (-1.0~-0.85)', null, null, null, null, null, '1', '5', 'Valleys')
 ) v(who, mate, route, grp, temperature, humidity, continentalness, erosion, weirdness, pv, depth, requirement, condition, t_levels, h_levels, e_levels, c_bands, pv_band)"""


@query(f"""with p as (select s_suppkey, s_suppkey k from supplier where s_suppkey % 10 not in (3, 4)), l as (select *, 1 as copies from {_SET}), r as (select l.*, substr(who, i, 1) w from l, range(1, 4) x(i) where who <> 'C5' and i <= length(who) union all select l.*, 'C' from l, range(5) where who = 'C5'),
 b as (select s_suppkey, r.*, case w when 'O' then 'odd' else 'minecraft:biome_' || (k + ascii(w) - 65) % 7 end biome, case when mate is not null then 'minecraft:biome_' || (k + ascii(mate) - 65) % 7 end sibling from p, r),
 m as (select s_suppkey, case biome when 'odd' then (select min('minecraft:biome_' || s_suppkey % 7) from supplier) else biome end biome, sibling, route, grp, temperature, humidity, continentalness, erosion, weirdness, pv, depth, requirement, condition, t_levels, h_levels, e_levels, c_bands, pv_band, biome = 'odd' odd from b)
 select * exclude (odd) from m where route <> 'group_terrain' union all select distinct on (s_suppkey, biome, grp, e_levels, c_bands) * exclude (odd) from m where route = 'group_terrain'""")
def noise_placements(spark: SparkSession, at: str) -> DataFrame:
    """Placements of biomes by the climate tables of all pages."""
    tables, _ = noise.located(_climate_pages(spark, at), "s_suppkey", "text")
    placed, _ = noise.placements(tables, "s_suppkey", *_biomes(spark, at))
    return placed.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("t_levels", "h_levels", "e_levels", "c_bands")})


@query("select s_suppkey, case s_suppkey % 10 when 3 then 'no table: plateau' else 'no legend: humidity' end missing from supplier where s_suppkey % 10 in (3, 4)")
def noise_missing(spark: SparkSession, at: str) -> DataFrame:
    """What pages lack."""
    return noise.located(_climate_pages(spark, at), "s_suppkey", "text")[1]


@query("select s_suppkey, 'Unknown ' || s_suppkey % 3 as name from supplier where s_suppkey % 10 not in (3, 4)")
def noise_unknown(spark: SparkSession, at: str) -> DataFrame:
    """Links of the tables that name no known biome."""
    tables, _ = noise.located(_climate_pages(spark, at), "s_suppkey", "text")
    return noise.placements(tables, "s_suppkey", *_biomes(spark, at))[1]


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ---- editions

_FIELD = (
    ("Normal: {{hp|5}}", None, "no scope"), ("'''In {{JE}}:'''", "first", "own marker"), ("{{hp|X}}", "first", "inherited region"), ("'''Baby in {{BE}}:'''", "second", "own marker"), ("Easy and Normal: {{hp|1}}", "second", "inherited block"),
    ("Easy, Normal, and Hard:", "second", "inherited block"), ("{{drop|item|Meal}}{{only|be|ee|short=1}}", "second", "own marker"), ("'''Adult:'''", "first", "inherited region"), ("X blocks (tall)", "first", "inherited region"), ("'''{{IN|Bedrock}}:''' {{needs testing}}", "second", "own marker"),
    ("{{JE}} or {{BE}} both:", None, "unparseable heading"), ("5{{je}} {{be}}", "second", "inherited region"), ("<hr>", None, "no scope"), ("X", None, "no scope"), ("'''Bedrock:'''", "second", "own marker"), ("'''While jumping:'''{{only|java|short=1}}", "first", "own marker"), ("X", "first", "inherited block"),
    ("'''Ranged:''' (ignores [[armor]])", "second", "inherited region"), ("X<ref>{{BE}}</ref>", "second", "inherited region"),
)
_FIELD_SQL = ", ".join("({}, '{}', {}, '{}')".format(i, line.replace("'", "''"), "null" if e is None else f"'{e}'", r) for i, (line, e, r) in enumerate(_FIELD))


@query(f"select p_partkey, i as place, replace(line, 'X', p_name) as line, edition, reached from part, (values {_FIELD_SQL}) f(i, line, edition, reached)")
def edition_scopes(spark: SparkSession, at: str) -> DataFrame:
    """Lines of a field with headings of all kinds, scoped as rows."""
    made = spread(table(spark, at, "part"), "p_partkey").select("p_partkey", F.posexplode(F.transform(F.array(*(F.lit(x[0]) for x in _FIELD)), lambda x: F.replace(x, F.lit("X"), F.col("p_name")))).alias("place", "line"))
    return brews.edition_scopes(made, ["p_partkey"], ["place"], "line")


@query(f"select p_partkey, i as place, replace(line, 'X', p_name) as line, edition, reached from part, (values {_FIELD_SQL}) f(i, line, edition, reached)")
def edition_fields(spark: SparkSession, at: str) -> DataFrame:
    """The same within one value, its lines at breaks, rules and list marks."""
    text = F.lit("<br>".join(x[0] for x in _FIELD[:6]) + "\n* " + "\n\n*".join(x[0] for x in _FIELD[6:12]) + "<hr/>" + "<br />".join(x[0] for x in _FIELD[13:]))
    lines = editions.scoped(editions.field_lines(F.replace(text, F.lit("X"), F.col("p_name"))))
    return spread(table(spark, at, "part"), "p_partkey").select("p_partkey", F.posexplode(lines).alias("place", "s")).select("p_partkey", "place", "s.*")


# ---- brewing

_EFFECTS = (
    ("Sugar", "Speed", 'rowspan="2" | [[Slowness]]'), ("Rabbit's Foot", "Jump Boost", None), ("Glistering Melon Slice", "Instant Health", "rowspan=2 | [[Instant Damage]]"), ("Spider Eye", "Poison", None),
    ("Blaze Powder", "Strength", "None{{only|java|short=1}}<br>[[Weakness]]{{only|bedrock|short=1}}"), ("Golden Carrot", "Night Vision", "[[Invisibility]]"), ("Fermented Spider Eye", "Weakness", "None"),
    ("Magma Cream", "Fire Resistance", "rowspan=6 | None"), ("Ghast Tear", "Regeneration", None), ("Pufferfish", "Water Breathing", None), ("Ice Ball{{upcoming|1}}", "Chilled", None), ("Phantom Membrane", "Slow Falling", None), ("Cobweb", "Mystery N", None),
)
_BREWING = (
    'intro\n=== Effect ingredients ===\n{| class="wikitable"\n|-\n! Name\n! Icon\n! Effect\n! Effect when corrupted\n'
    + "".join(f"|-\n!{{{{anchor|x}}}}[[{n.split('{')[0]}]]{n[len(n.split('{')[0]):]}\n|{{{{Slot|{n.split('{')[0]}}}}}\n|[[{e}]]\n" + (f"| {c}\n" if c else "") for n, e, c in _EFFECTS)
    + "|}\n=== Base potions ===\n{| class=b\n! Name\n! Recipe\n! Effects\n"
    + "".join(f"|-\n!{{{{Inventory slot|x}}}}<br>{b} potion\n|{{{{Brewing Stand\n |Input= {i}\n<!-- no -->\n |Output2= Water Bottle\n }}}}\n| None\n" for b, i in (("Awkward", "Nether Wart"), ("Mundane", "Sugar; Redstone Dust; Ice Ball{{upcoming|2}}"), ("Thick", "Glowstone Dust"), ("Other", "Nothing")))
    + "|}\n==== Splash and lingering potions ====\nBy adding gunpowder and dragon's breath.\n=== Un-brewable potions ===\nThe [[uncraftable potion]], [[potion of Luck]]{{only|java|short=JE}} and [[potion of Decay|''potion of Decay'']]{{only|bedrock|short=BE}}.\n== End ==\n[[no potion]]"
)
_ITEMS = ("Sugar", "Rabbit's Foot", "Glistering Melon Slice", "Spider Eye", "Blaze Powder", "Golden Carrot", "Fermented Spider Eye", "Magma Cream", "Ghast Tear", "Pufferfish", "Phantom Membrane", "Cobweb", "Nether Wart", "Redstone Dust", "Glowstone Dust")
_POTIONS = ("water", "awkward", "mundane", "thick", "weakness", "swiftness", "slowness", "leaping", "healing", "harming", "poison", "strength", "night_vision", "invisibility", "fire_resistance", "regeneration", "water_breathing", "slow_falling", "long_swiftness", "long_slowness", "strong_healing", "strong_harming", "long_poison", "luck")


def _brewing_pages(spark: SparkSession, at: str) -> DataFrame:
    """One page a supplier: every tenth has lost an ingredient of the container steps, every tenth names an unknown one."""
    k = F.col("s_suppkey")
    text = F.replace(F.lit(_BREWING), F.lit("Mystery N"), F.concat(F.lit("Mystery "), (k % 3).cast("string")))
    text = F.when(k % 10 == 3, F.replace(text, F.lit("gunpowder"), F.lit("TNT"))).when(k % 10 == 4, F.replace(text, F.lit("[[Sugar]]"), F.lit("[[Odd Dust]]"))).otherwise(text)
    return table(spark, at, "supplier").select("s_suppkey", text.alias("text"))


def _read_brewing(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    items = spark.createDataFrame([(n, "minecraft:" + n.lower().replace("'", "").replace(" ", "_")) for n in _ITEMS], "name string, id string")
    return brews.read_pages(_brewing_pages(spark, at), "s_suppkey", "text", items)


_PAGES_SQL = "(select s_suppkey, s_suppkey % 3 as odd from supplier where s_suppkey % 10 not in (3, 4))"
_RECIPES_SQL = "(values " + ", ".join(f"('{k}', 'minecraft:{i}', '{r}')" for k, i, r in (
    *(("effect" if n != "Fermented Spider Eye" else "base", n.lower().replace("'", "").replace(" ", "_"), e if n != "Fermented Spider Eye" else "weakness") for n, e, _ in _EFFECTS if "{" not in n),
    ("base", "nether_wart", "awkward"), ("base", "sugar", "mundane"), ("base", "redstone_dust", "mundane"), ("base", "glowstone_dust", "thick"))) + ") r(kind, ingredient, result)"


@query(f"select s_suppkey, kind, ingredient, replace(result, 'Mystery N', 'Mystery ' || odd) as result from {_PAGES_SQL}, {_RECIPES_SQL}")
def brewing_recipes(spark: SparkSession, at: str) -> DataFrame:
    return _read_brewing(spark, at)[0]


@query(f"select s_suppkey, effect, becomes from {_PAGES_SQL}, (values ('Speed', 'Slowness'), ('Jump Boost', 'Slowness'), ('Instant Health', 'Instant Damage'), ('Poison', 'Instant Damage'), ('Night Vision', 'Invisibility')) c(effect, becomes)")
def brewing_corruptions(spark: SparkSession, at: str) -> DataFrame:
    """What effects turn into: cells over several rows, and one for two editions."""
    return _read_brewing(spark, at)[1]


@query(f"select s_suppkey, name, reason from {_PAGES_SQL}, (values ('uncraftable potion', null), ('potion of Luck', null)) n(name, reason) union all select s_suppkey, null, case s_suppkey % 10 when 3 then 'no ingredient of the container steps' else 'unknown ingredient: Odd Dust' end from supplier where s_suppkey % 10 in (3, 4)")
def brewing_rest(spark: SparkSession, at: str) -> DataFrame:
    """Potions that can't be brewed, and why pages could not be read."""
    _, _, names, ledger = _read_brewing(spark, at)
    return names.withColumn("reason", F.lit(None).cast("string")).unionByName(ledger.withColumn("name", F.lit(None).cast("string")))


_PATHS = {"Speed": "swiftness", "Jump Boost": "leaping", "Instant Health": "healing", "Instant Damage": "harming"}
_PATHS_SQL = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in _PATHS.items()) + ") x(name, path)"
_KNOWN_SQL = "(values " + ", ".join(f"('{p}')" for p in _POTIONS) + ") k(path)"


@query(f"""with p as {_PAGES_SQL}, k as (from {_KNOWN_SQL}), r as (select kind, ingredient, case kind when 'base' then result else coalesce(x.path, lower(replace(result, ' ', '_'))) end path from {_RECIPES_SQL} left join {_PATHS_SQL} on x.name = result),
 c(a, b) as (values ('swiftness', 'slowness'), ('leaping', 'slowness'), ('healing', 'harming'), ('poison', 'harming'), ('night_vision', 'invisibility')), m as (select 'minecraft:potion/' as m)
 select s_suppkey, m || path as output, 'brewing' as method, ingredient, m || case kind when 'base' then 'water' else 'awkward' end as input, 'brewing/' || kind || '/' || path as source from p, r, m where path in (from k)
 union all select s_suppkey, m || t || b, 'brewing', 'minecraft:fermented_spider_eye', m || t || a, 'brewing/corruption/' || t || b || '/' || t || a from p, m, c, (values (''), ('long_'), ('strong_')) l(t) where t || a in (from k) and t || b in (from k)
 union all select s_suppkey, m || 'water', 'filling', null, 'minecraft:glass_bottle', 'brewing/equipment/water_bottle' from p, m
 union all select s_suppkey, m || t || path, 'brewing', i, m || path, 'brewing/modifier/' || rtrim(t, '_') || '/' || path from p, m, k, (values ('long_', 'minecraft:redstone'), ('strong_', 'minecraft:glowstone_dust')) l(t, i) where t || path in (from k)
 union all select s_suppkey, 'minecraft:splash_potion', 'brewing', 'minecraft:gunpowder', m || path, 'brewing/container/splash/' || path from p, m, k
 union all select s_suppkey, 'minecraft:lingering_potion', 'brewing', 'minecraft:dragon_breath', 'minecraft:splash_potion', 'brewing/container/lingering' from p""")
def brewing(spark: SparkSession, at: str) -> DataFrame:
    """All that can be brewed, by the recipes of each page."""
    recipes, corruptions, _, _ = _read_brewing(spark, at)
    return brews.producers(recipes, corruptions, "s_suppkey", *_registry(spark))[0]


def _registry(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([(p,) for p in _POTIONS], "path string"), spark.createDataFrame(list(_PATHS.items()), "name string, path string")


@query(f"select s_suppkey, 'luck' as path, null as name from {_PAGES_SQL} union all select s_suppkey, 'mystery_' || odd, 'Mystery ' || odd from {_PAGES_SQL}")
def brewing_uncovered(spark: SparkSession, at: str) -> DataFrame:
    """Potions that nothing makes, and effects that are no potion."""
    recipes, corruptions, _, _ = _read_brewing(spark, at)
    made, lost = brews.producers(recipes, corruptions, "s_suppkey", *_registry(spark))
    open_ = brews.uncovered(made, "s_suppkey", _registry(spark)[0])
    return open_.withColumn("name", F.lit(None).cast("string")).unionByName(lost)
