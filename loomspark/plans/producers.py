"""Recipes, loot, trees of producers: documents are made of the driver's tables, the SQL says what must come out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, loot, recipes
from ..session import spread
from ..sources.tables import table
from .registry import query


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ---- recipes


def recipe_documents(spark: SparkSession, at: str) -> DataFrame:
    """recipe_id and doc, of nine kinds."""
    k, size = F.col("p_partkey"), F.col("p_size")
    tag, result = _text("#t", size % 6), _text('"result": {"id": "ns:made', k, '", "count": ', 1 + size % 4, "}")
    docs = [
        _text('{"type": "ns:crafting_shaped", "pattern": ["#X#", " X"], "key": {"#": "', tag, '", "X": "ns:i', k % 50, '"}, ', result, "}"),
        _text('{"type": "crafting_shapeless", "ingredients": ["i', k % 7, '", "ns:i', k % 7, '", ["white_b", "a', size, '", "white_b"], "', tag, '"], ', result, "}"),
        _text('{"type": "ns:smelting", "ingredient": "', tag, '", ', result, "}"),
        _text('{"type": "ns:stonecutting", "ingredient": ["z", "ns:y"], "result": {"id": "made', k, '"}}'),
        _text('{"type": "smithing_transform", "template": "t", "base": "', tag, '", "addition": "t", ', result, "}"),
        _text('{"type": "ns:crafting_transmute", "input": "', tag, '", "material": "m", "result": {}}'),
        _text('{"type": "ns:brewing", ', result, "}"),
        _text('{"type": "ns:crafting_special_map", ', result, "}"),
        _text('{"type": "ns:odd", ', result, "}"),
    ]
    doc = F.lit(None).cast("string")
    for i, d in enumerate(docs):
        doc = F.when(k % 9 == i, d).otherwise(doc)
    prefix = F.when(k % 27 == 1, "ns:dye_").when(k % 27 == 3, "dye_white_").otherwise("ns:r")
    return table(spark, at, "part").select(F.concat(prefix, k.cast("string")).alias("recipe_id"), doc.alias("doc"))


RECIPES_SQL = "(select *, (case p_partkey % 27 when 1 then 'ns:dye_' when 3 then 'dye_white_' else 'ns:r' end) || p_partkey recipe_id, p_partkey % 9 kind from part)"
TAGS_SQL = "(select 't' || n_regionkey tag, n_name member from nation union select 't5', n_name from nation where n_regionkey < 2)"


def item_tags(spark: SparkSession, at: str) -> DataFrame:
    """tag and member: the closure of tags over nations, of which the last names two others."""
    n = table(spark, at, "nation").select(_text("t", F.col("n_regionkey")).alias("s"), F.concat(F.lit("="), F.col("n_name")).alias("d"))
    more = spark.range(2).select(F.lit("t5"), _text("t", F.col("id")))
    found = graph.closure(n.union(more), "s", "d", acyclic=True)
    return found.where(F.startswith("d", F.lit("="))).select(F.col("s").alias("tag"), F.substring("d", 2, 1 << 20).alias("member"))


@query(f"""select recipe_id, case kind when 2 then 'smelting' else 'crafting' end as method, case kind when 2 then 'furnace' when 3 then 'stonecutter' end station, 'made' || p_partkey as output,
 case kind when 3 then 1 else 1 + p_size % 4 end as count, case kind when 0 then '0,1,0,,1,' end grid, case kind when 0 then 3 end width, case kind when 0 then 2 end height
 from {RECIPES_SQL} where kind < 5 and p_partkey % 27 <> 3""")
def extract_recipes(spark: SparkSession, at: str) -> DataFrame:
    made = recipes.producers(recipe_documents(spark, at))
    cells = F.array_join(F.transform("grid", lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",")
    return made.select("recipe_id", "method", "station", "output", "count", cells.alias("grid"), "width", "height")


@query(f"""select recipe_id, case when p_partkey % 27 = 3 then 'bleaches what is made otherwise' else case kind when 5 then 'the result is derived from the input' when 6 then 'brewing is read elsewhere' when 7 then 'no list of ingredients' else 'unhandled recipe type' end end reason
 from {RECIPES_SQL} where kind >= 5 or p_partkey % 27 = 3""")
def skipped_recipes(spark: SparkSession, at: str) -> DataFrame:
    return recipes.classified(recipe_documents(spark, at)).where("skip is not null").select("recipe_id", F.col("skip").alias("reason"))


@query(f"""with r as (select * from {RECIPES_SQL} where kind < 5 and p_partkey % 27 <> 3), i as (
 select recipe_id, 0 slot, null item, 't' || p_size % 6 tag, 2 as count, null members from r where kind = 0 union all select recipe_id, 1, 'i' || p_partkey % 50, null, 2, null from r where kind = 0
 union all select recipe_id, 0, 'i' || p_partkey % 7, null, 2, null from r where kind = 1 union all select recipe_id, 3, null, 't' || p_size % 6, 1, null from r where kind = 1
 union all select recipe_id, 2, case when p_partkey % 27 = 1 then 'white_b' else 'a' || p_size end, null, 1, case when p_partkey % 27 <> 1 then 'a' || p_size || ',white_b' end from r where kind = 1
 union all select recipe_id, 0, null, 't' || p_size % 6, 1, null from r where kind = 2 union all select recipe_id, 0, 'y', null, 1, 'y,z' from r where kind = 3
 union all select recipe_id, 0, 't', null, 2, null from r where kind = 4 union all select recipe_id, 1, null, 't' || p_size % 6, 1, null from r where kind = 4),
 t as (select tag, string_agg(member, ',' order by member) of_tag from {TAGS_SQL} group by 1)
 select recipe_id, slot, item, i.tag, i.count, coalesce(of_tag, members) members from i left join t on t.tag = i.tag""")
def recipe_inputs(spark: SparkSession, at: str) -> DataFrame:
    found = recipes.inputs(recipes.producers(recipe_documents(spark, at)), item_tags(spark, at))
    return found.select("recipe_id", "slot", "item", "tag", "count", F.array_join("members", ",").alias("members"))


# ---- loot

SILK_DOC = '{"type": "ns:match_tool", "predicate": {"enchantments": [{"enchantments": "ns:silk_touch", "levels": {"min": 1}}]}}'
METHODS = {"block": "block_drop", "chest": "chest_loot"}


def loot_tables(spark: SparkSession, at: str) -> DataFrame:
    """table and doc: one for each order, one pool of its lines; every fourth line is a container, some are no item."""

    def entry(x: Column) -> Column:
        n, qty = x["l_linenumber"], x["l_quantity"].cast("int")
        part, supplier = x["l_partkey"].cast("string"), x["l_suppkey"].cast("string")
        shears = F.when(x["l_returnflag"] == "R", F.lit(', "condition": "shears"')).otherwise("")
        count = F.when(x["l_tax"] > 0.04, _text('{"type": "ns:uniform", "min": ', n, ', "max": ', n + 2, "}")).otherwise(n.cast("string"))
        item = _text('{"type": "ns:item", "name": "ns:p', part, '", "weight": ', qty, ', "modifier": [{"type": "other"}, {"type": "ns:set_count", "count": ', count, "}]", shears, "}")
        nested = _text('{"type": "ns:alternatives"', shears, ', "children": [{"type": "item", "name": "s', supplier, '", "condition": ', SILK_DOC, '}, {"type": "ns:group", "children": [{"type": "item", "name": "ns:p', part, '", "modifier": {"type": "set_count", "count": {"min": 0, "max": 2}}}]}]}')
        return F.when(n % 4 == 3, nested).when((n % 4 == 2) & (qty > 40), F.lit('{"type": "ns:tag", "name": "x"}')).otherwise(item)

    # lines are dealt out as they are, not as texts: of a few MB of them come many of documents
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_tax"]
    lines = spread(table(spark, at, "lineitem").select("l_orderkey", *columns), "l_orderkey")
    pools = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("lines")).select("l_orderkey", F.array_join(F.transform("lines", entry), ", ").alias("entries"))
    k = F.col("l_orderkey")
    rolls = F.when(k % 3 == 0, F.lit('{"type": "ns:uniform", "min": 1, "max": 3}')).when(k % 3 == 1, F.lit("2")).otherwise(F.lit('{"type": "ns:binomial", "n": 3, "p": 0.5}'))
    gate = F.when(k % 7 == 0, _text(', "condition": {"type": "ns:all_of", "terms": ["ns:rain", "silk"]}')).otherwise("")
    doc = F.concat(F.lit('{"type": "ns:'), F.when(k % 2 == 0, "block").otherwise("chest"), F.lit('", "pools": [{"rolls": '), rolls, gate, F.lit(', "entries": ['), F.col("entries"), F.lit("]}]}"))
    family = F.when(k % 11 == 0, "entities").when(k % 2 == 0, "blocks").otherwise("chests")
    return pools.select(_text("loot/", family, "/", k).alias("table"), doc.alias("doc"))


def loot_predicates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ns:silk", SILK_DOC), ("ns:shears", '{"type": "match_tool", "predicate": {"items": ["ns:shears"]}}'), ("ns:rain", '{"type": "weather"}')], "name string, doc string")


LINES_SQL = """(select *, 'loot/' || (case when l_orderkey % 11 = 0 then 'entities' when l_orderkey % 2 = 0 then 'blocks' else 'chests' end) || '/' || l_orderkey "table", row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_tax) - 1 place,
 cast(l_quantity as int) qty, case when l_linenumber % 4 = 3 then 'nested' when l_linenumber % 4 = 2 and cast(l_quantity as int) > 40 then 'tag' else 'item' end kind,
 case when l_orderkey % 7 = 0 then 'silk touch' when l_returnflag = 'R' then 'shears' end gate0, case l_orderkey % 3 when 2 then null else 2.0 end r0 from lineitem)"""
LEAVES_SQL = f"""(with l as (select *, cast(sum(case kind when 'item' then greatest(qty, 1) else 1 end) over (partition by l_orderkey) as double) total from {LINES_SQL}), x as (
 select "table", l_orderkey, '0.' || place path, 'p' || l_partkey item, l_linenumber count_min, case when l_tax > 0.04 then l_linenumber + 2 else l_linenumber end count_max, gate0 gate, case when l_returnflag <> 'R' and r0 is not null then greatest(qty, 1) / total end chance, r0 from l where kind = 'item'
 union all select "table", l_orderkey, '0.' || place || '.0', 's' || l_suppkey, 1, 1, coalesce(gate0, 'silk touch'), null, null from l where kind = 'nested'
 union all select "table", l_orderkey, '0.' || place || '.1.0', 'p' || l_partkey, 1, 2, gate0, null, null from l where kind = 'nested')
 select "table", l_orderkey, path, item, count_min, count_max, gate, chance, case when chance is not null then r0 end rolls, chance * r0 * (count_min + count_max) / 2 per_attempt from x)"""


@query(f'select "table", path, item, count_min, count_max, gate, round(chance, 9) chance, rolls, round(per_attempt, 9) per_attempt from {LEAVES_SQL}')
def loot_walk(spark: SparkSession, at: str) -> DataFrame:
    leaves, _ = loot.walk(loot_tables(spark, at), loot_predicates(spark))
    return leaves.select("table", "path", "item", "count_min", "count_max", "gate", F.round("chance", 9).alias("chance"), "rolls", F.round("per_attempt", 9).alias("per_attempt"))


@query(f"""select "table", '0.' || place path, 'tag' entry_type from {LINES_SQL} where kind = 'tag'""")
def loot_skipped(spark: SparkSession, at: str) -> DataFrame:
    return loot.others_of(loot.entries(loot_tables(spark, at)))


@query(f"""select "table" source_id, path, case when l_orderkey % 2 = 0 then 'block_drop' else 'chest_loot' end as method, item as output, count_min as count, case when l_orderkey % 2 = 0 then cast(l_orderkey as varchar) end input, gate note,
 round(chance, 9) chance, case when chance is not null then count_max end count_max from {LEAVES_SQL} where l_orderkey % 11 <> 0""")
def extract_loot(spark: SparkSession, at: str) -> DataFrame:
    """Producers of all tables of the families that are read; that of a block names the block."""
    tables = loot.readable(loot_tables(spark, at), ["blocks", "chests"], ["entities"], METHODS)
    leaves, _ = loot.walk(tables, loot_predicates(spark), keep=["method"])
    block = F.when(F.col("method") == "block_drop", F.element_at(F.split("table", "/"), -1))
    return leaves.select(F.col("table").alias("source_id"), "path", "method", F.col("item").alias("output"), F.col("count_min").alias("count"), block.alias("input"), F.col("gate").alias("note"), F.round("chance", 9).alias("chance"), F.when(F.col("chance").isNotNull(), F.col("count_max")).alias("count_max"))


# ---- trees of producers

EDGES_SQL = """e as (select 'n' || n_nationkey as output, n_nationkey || '-' || k producer, slot, case when slot < 2 then 'n' || (case slot when 0 then n_nationkey * 3 + k + 1 else n_nationkey * 5 + k * 7 + 2 end) % 25 end item, case when slot = 2 then 't' || k end tag
 from nation, range(2) a(k), range(3) b(slot) where n_nationkey % 6 <> 5 and not (slot = 2 and n_nationkey % 2 = 0))"""


def made_of(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """Producers and inputs: two producers for most nations, of two items and at times a tag."""
    n, k, slot = F.col("n_nationkey"), F.col("k"), F.col("slot")
    e = table(spark, at, "nation").where(n % 6 != 5).select(n, F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("producer", _text(n, "-", k)).withColumn("output", _text("n", n))
    item = F.when(slot == 0, n * 3 + k + 1).otherwise(n * 5 + k * 7 + 2) % 25
    inputs = e.select("producer", n, "k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot")).where((slot < 2) | (n % 2 == 1))
    return e.select("output", "producer"), inputs.select("producer", "slot", F.when(slot < 2, _text("n", item)).alias("item"), F.when(slot == 2, _text("t", k)).alias("tag"))


def _tree_sql(depth: int, roots: str = "select 'n' || n_nationkey as item, ['n' || n_nationkey] as way from nation") -> str:
    return f"""with recursive {EDGES_SQL}, p as (select output, producer, list(item order by slot) items, bool_or(tag is not null) tagged from e group by all), roots as ({roots}),
 t as (select item root, '' path, 0 as depth, item, null::varchar tag, way, false again from roots union all
 select t.root, case t.path when '' then '' else t.path || '/' end || e.producer || '.' || e.slot, t.depth + 1, e.item, e.tag, case when e.item is null or list_contains(t.way, e.item) then t.way else list_append(t.way, e.item) end, coalesce(list_contains(t.way, e.item), false)
 from t join p on p.output = t.item and t.tag is null and not t.again and t.depth < {depth} and (p.tagged or not list_has_all(t.way, list_filter(p.items, lambda x: x is not null))) join e on e.producer = p.producer),
 o as (select root, path, depth, item, tag, case when again then 'repeat' when depth = {depth} and item in (select output from e) then 'expandable' end stub from t)"""


@query(_tree_sql(4) + " select * from o")
def producer_tree(spark: SparkSession, at: str) -> DataFrame:
    roots = table(spark, at, "nation").select(_text("n", F.col("n_nationkey")).alias("item"))
    return graph.producer_tree(roots, *made_of(spark, at), depth=4).drop("way")


@query(_tree_sql(3) + " select root, max(depth) as depth, count(*) n_nodes from o group by 1")
def tree_depths(spark: SparkSession, at: str) -> DataFrame:
    roots = table(spark, at, "nation").select(_text("n", F.col("n_nationkey")).alias("item"))
    return graph.tree_depths(graph.producer_tree(roots, *made_of(spark, at), depth=3))


@query(_tree_sql(2) + " select * from o")
def tree_truncated(spark: SparkSession, at: str) -> DataFrame:
    """The tree of depth 3 cut at 2 is the tree of depth 2, but that only what has nodes below is a stub there."""
    roots = table(spark, at, "nation").select(_text("n", F.col("n_nationkey")).alias("item"))
    made = graph.producer_tree(roots, *made_of(spark, at), depth=3)
    return graph.truncated(made, 2).drop("way")


@query(_tree_sql(2, "select distinct item, [output, item] as way from e where item <> output and item in (select output from e)") + " select distinct * from o")
def tree_expanded(spark: SparkSession, at: str) -> DataFrame:
    """Below all stubs of the trees of depth 1."""
    roots = table(spark, at, "nation").select(_text("n", F.col("n_nationkey")).alias("item"))
    tree = graph.producer_tree(roots, *made_of(spark, at), depth=1)
    return graph.expanded(tree, *made_of(spark, at), depth=2).drop("way").distinct()
