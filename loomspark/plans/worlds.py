"""Facts of the world, bound to the driver's tables with SQL beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts
from ..sources.tables import table
from .registry import query


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("select p_partkey, l as level, l as least, p_size + l as most, 1 average_n, p_size + 1 average_d, 2 + l chance_n, 1 chance_d, 1.0 as share from part, range(0, 3) t(l)")
def drop_levels(spark: SparkSession, at: str) -> DataFrame:
    size = F.col("p_size")
    level = lambda n: _text(f'"{n}": {{"min": {n}, "max": ', size + n, ', "average": "1/', size + 1, f'", "dropchance": "{2 + n}", "distribution": {{"0": "1/4", "1": "3/4"}}}}')
    rows = table(spark, at, "part").select("p_partkey", F.concat(F.lit("{"), F.concat_ws(", ", level(0), level(1), level(2)), F.lit("}")).alias("levels"))
    return facts.drop_levels(rows, ["p_partkey"], "levels")


@query("select p_partkey, unnest(range(0, 2)) place, unnest([p_name, 'ninth ' || p_size]) as text from part where p_size % 3 <> 0")
def drop_notes(spark: SparkSession, at: str) -> DataFrame:
    note = _text('{"10": {"name": "n", "first": {"content": "ninth ', F.col("p_size"), '"}, "second": {"content": "x"}}, "9": {"name": "a", "content": " ', F.col("p_name"), '"}, "2": {"second": {"content": "only there"}}, "3": {"content": " "}}')
    rows = table(spark, at, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "[]").otherwise(note).alias("notes"))
    return facts.drop_notes(rows, ["p_partkey"], "notes", "first", "second")


def _trades(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    size = F.col("p_size")
    chance = F.when(size % 4 == 0, "0%").when(size % 4 == 1, _text(size, "%")).when(size % 4 == 2, _text(size, "%–", size + 10, "%")).otherwise("100%")
    rows = table(spark, at, "part").select("p_partkey", F.col("p_name").alias("a"), _text(size, "-", size + 2).alias("an"), F.when(size % 5 == 0, F.col("p_brand")).alias("b"), F.lit("3").alias("bn"), F.when(size % 7 > 0, F.col("p_type")).alias("c"), F.lit(None).cast("string").alias("cn"), chance.alias("p"))
    return facts.trades(rows, ["p_partkey"], [("a", "an"), ("b", "bn")], ("c", "cn"), "p")


TRADE_SQL = "(select *, round(case p_size % 4 when 3 then 1.0 else p_size / 100.0 end, 9) low, round(case p_size % 4 when 3 then 1.0 when 2 then (p_size + 10) / 100.0 else p_size / 100.0 end, 9) high from part where p_size % 4 <> 0 and p_size % 7 > 0)"


@query(f"select p_partkey, low, high, 'wanted' side, 0 place, p_name item, p_size as least, p_size + 2 as most from {TRADE_SQL} union all select p_partkey, low, high, 'wanted', 1, p_brand, 3, 3 from {TRADE_SQL} where p_size % 5 = 0 union all select p_partkey, low, high, 'given', 0, p_type, 1, 1 from {TRADE_SQL}")
def trades(spark: SparkSession, at: str) -> DataFrame:
    return _trades(spark, at)[0].withColumns({"low": F.round("low", 9), "high": F.round("high", 9)})


@query("select p_partkey, case when p_size % 7 = 0 then 'gives nothing' else 'never happens' end reason from part where p_size % 4 = 0 or p_size % 7 = 0")
def trade_rejects(spark: SparkSession, at: str) -> DataFrame:
    return _trades(spark, at)[1]


@query("select p_partkey, case when p_size % 2 = 0 then 'none' when p_size < 15 then 'snow' else 'rain' end falls from part")
def precipitation(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "part").select("p_partkey", facts.precipitation(F.col("p_size") % 2 == 1, F.col("p_size") / 100).alias("falls"))


@query("""with s as (select l_suppkey, l_returnflag, l_partkey, sum(l_quantity) weight, min(l_linenumber) least, max(l_linenumber) most from lineitem group by 1, 2, 3)
 select *, row_number() over (partition by l_suppkey, l_returnflag order by -weight, l_partkey) place, round(weight / sum(weight) over (partition by l_suppkey, l_returnflag), 9) as share from s""")
def spawners(spark: SparkSession, at: str) -> DataFrame:
    return facts.spawners(table(spark, at, "lineitem"), ["l_suppkey", "l_returnflag", "l_partkey"], "l_quantity", "l_linenumber", "l_linenumber").withColumn("share", F.round("share", 9))


@query("select a.n_name, b.n_regionkey, b.n_name sibling from nation a left join nation b on a.n_regionkey = b.n_regionkey and b.n_name <> a.n_name and a.n_nationkey % 4 <> 0 and b.n_nationkey % 4 <> 0")
def structure_siblings(spark: SparkSession, at: str) -> DataFrame:
    n = table(spark, at, "nation")
    return facts.siblings(n.where("n_nationkey % 4 <> 0").select("n_name", "n_regionkey"), n, "n_name", "n_regionkey")


@query("select p_partkey, case when p_size % 12 >= 10 then 'common' when p_size % 12 >= 5 then 'uncommon' when p_size % 12 >= 2 then 'rare' when p_size % 12 = 1 then 'very rare' end rarity from part")
def enchantment_rarity(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "part").select("p_partkey", facts.rarity(F.col("p_size") % 12).alias("rarity"))


@query("""with a as (select p_partkey, case p_size % 3 when 0 then -70 - p_size when 1 then -64 + p_size else 319 - p_size end lo, 300 + p_size hi, p_size from part)
 select p_partkey, least(greatest(lo, -64), 319) as least, least(hi, 319) as most, case when p_size % 2 = 0 then cast(floor((lo + hi) / 2.0) as bigint) end peak, cast(p_size % 4 as double) tries, case when p_size % 5 = 0 then 0.25 end chance from a""")
def placements(spark: SparkSession, at: str) -> DataFrame:
    """Bands and rates of placements; what stands behind the first that places does not count."""
    size, bottom, height = F.col("p_size"), F.lit(-64), F.lit(384)
    kind = F.when(size % 3 == 0, "absolute").when(size % 3 == 1, "above_bottom").otherwise("below_top")
    low = facts.anchor(kind, F.when(size % 3 == 0, -70 - size).otherwise(size), bottom, height)
    high = facts.anchor(F.lit("absolute"), 300 + size, bottom, height)
    one = lambda k, n: F.struct(F.lit(k).alias("kind"), n.cast("int").alias("n"))
    modifiers = F.concat(F.array(one("count", size % 4)), F.when(size % 5 == 0, F.array(one("rarity", F.lit(4)))).otherwise(F.array().cast("array<struct<kind:string,n:int>>")), F.array(one("in_square", F.lit(0)), one("count", F.lit(9))))
    return table(spark, at, "part").select("p_partkey", facts.band(low, high, bottom, height, size % 2 == 0).alias("b"), facts.rate(modifiers).alias("r")).select("p_partkey", "b.*", "r.*")


@query("""with t as (select l_partkey, case l_suppkey % 6 when 0 then 'axe' when 1 then 'pickaxe' when 2 then 'stone' when 3 then 'iron' when 4 then 'hoe' else 'other' end tag from lineitem)
 select l_partkey, coalesce(concat_ws(',', max(case tag when 'pickaxe' then tag end), max(case tag when 'axe' then tag end), max(case tag when 'hoe' then tag end)), '') tools, case when bool_or(tag = 'iron') then 'iron' when bool_or(tag = 'stone') then 'stone' else 'wooden' end tier from t group by 1""")
def block_harvest(spark: SparkSession, at: str) -> DataFrame:
    k = F.col("l_suppkey") % 6
    tags = table(spark, at, "lineitem").select("l_partkey", F.when(k == 0, "axe").when(k == 1, "pickaxe").when(k == 2, "stone").when(k == 3, "iron").when(k == 4, "hoe").otherwise("other").alias("tag"))
    return facts.harvest(tags, "l_partkey", ["pickaxe", "axe", "hoe"], ["wooden", "stone", "iron"]).withColumn("tools", F.array_join("tools", ","))


@query("select p_partkey, p_size nutrition, round(p_size / 8.0, 2) saturation, p_size % 2 = 0 as always from part where p_size % 3 = 0 and p_size % 8 in (0, 2, 4, 6)")
def food_facts(spark: SparkSession, at: str) -> DataFrame:
    size = F.col("p_size")
    doc = F.when((size % 3 == 0) & (size % 2 == 0), _text('{"food": {"nutrition": ', size, ', "saturation": ', size / 8, F.when(size % 2 == 0, ', "can_always_eat": true').otherwise(""), "}}")).otherwise('{"other": 1}')
    return facts.food(table(spark, at, "part").select("p_partkey", doc.alias("doc")), "p_partkey", "doc")


@query("""with r as (select l_partkey, l_returnflag, l_suppkey % 10 biome, l_linenumber vein, l_linenumber as least, l_linenumber + cast(l_quantity as int) as most, case when l_tax > 0.04 then l_linenumber % 2 end peak, l_linenumber tries, case when l_discount > 0.05 then 0.5 end chance, l_quantity > 5 surface from lineitem),
 d as (select l_returnflag, count(distinct biome) n from r group by 1), g as (select l_partkey, l_returnflag, min(least) as least, max(most) as most, sum(tries) filter (where chance is null) tries, bool_and(surface) surface, count(distinct biome) n_biomes,
 case when min(peak) = max(peak) and min(least) filter (where peak is not null) = min(least) and max(most) filter (where peak is not null) = max(most) then min(peak) end peak from r group by 1, 2),
 v as (select l_partkey, l_returnflag, string_agg(least || '-' || most || ':' || vein, ',' order by least, most, vein) veins from (select distinct l_partkey, l_returnflag, least, most, vein from r) group by 1, 2)
 select g.*, veins, n_biomes = n whole from g join v using (l_partkey, l_returnflag) join d using (l_returnflag)""")
def extract_generation(spark: SparkSession, at: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    rows = table(spark, at, "lineitem").select("l_partkey", "l_returnflag", (F.col("l_suppkey") % 10).alias("biome"), n.alias("vein"), n.alias("least"), (n + q).alias("most"), F.when(F.col("l_tax") > 0.04, n % 2).alias("peak"), n.alias("tries"), F.when(F.col("l_discount") > 0.05, 0.5).alias("chance"), (F.col("l_quantity") > 5).alias("surface"))
    made = facts.generation(rows, ["l_partkey", "l_returnflag"], "l_returnflag", "biome")
    return made.withColumn("veins", F.array_join(F.transform("veins", lambda v: F.concat(v["least"].cast("string"), F.lit("-"), v["most"].cast("string"), F.lit(":"), v["vein"].cast("string"))), ","))


@query("select p_partkey, unnest(['monster', 'water']) category, unnest([p_name || ',' || p_brand, '']) mobs, unnest([false, true]) suppressed from part")
def spawn_overrides(spark: SparkSession, at: str) -> DataFrame:
    doc = _text('{"monster": [{"type": "', F.col("p_name"), '"}, {"type": "', F.col("p_brand"), '"}], "water": []}')
    rows = table(spark, at, "part").select("p_partkey", doc.alias("doc"))
    return facts.spawn_overrides(rows, "p_partkey", "doc").withColumn("mobs", F.array_join("mobs", ","))
