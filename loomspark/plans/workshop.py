"""Trees as readers see them: suppliers are items in rings of twenty, and what they are made of follows from their place in a ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collections, trees
from ..session import spread
from ..sources.tables import table
from .registry import query

_W = "w as (select s_suppkey k, s_suppkey // 20 * 20 b, s_suppkey % 20 j from supplier)"


def _ring(spark: SparkSession, at: str) -> DataFrame:
    k = F.col("s_suppkey")
    return spread(table(spark, at, "supplier"), "s_suppkey").select(k.alias("k"), F.floor(k / 20).cast("long").alias("b"), (k % 20).alias("j")).withColumn("b", F.col("b") * 20)


def _item(place: Column) -> Column:
    """The item at a place of the ring."""
    return F.concat(F.lit("s"), (F.col("b") + place % 20).cast("string"))


def _id(end: str) -> Column:
    return F.concat(F.col("k").cast("string"), F.lit(end))


# ---- with references

_REFS = f"""{_W}, e as (select 's' || k as output, k || '-' || p producer, p seq, slot, case slot when 0 then 's' || (b + (3 * j + 1 + p) % 20) when 1 then 's' || (b + (5 * j + 7 * p + 2) % 20) end item, case slot when 2 then 't' || p end tag
  from w, range(2) x(p), range(3) y(slot) where j % 7 <> 6 and (slot < 2 or j % 2 = 1)),
 p as (select output, producer, seq, list({{'slot': slot, 'item': item, 'tag': tag}} order by slot) ins from e group by 1, 2, 3)"""


@query(f"""with recursive {_REFS}, t as (
  select 's' || k root, 'root' path, 0 as depth, null::varchar producer, 's' || k item, null::varchar tag, null::varchar stub, null::varchar reference, ['s' || k] way, []::bigint[] as pos from w
  union all
  select root, path, depth, producer, item, tag, case when first <> path then 'shown' else kind end, case when first <> path then first end, case when kind is null and tag is null then list_append(way, item) else way end, pos from (
   select *, case when kind is null and tag is null then first_value(path) over (partition by root, item, kind is null and tag is null order by pos) end first from (
    select root, path || '.producers.' || n || '.inputs.' || i.slot path, depth, producer, i.item item, i.tag tag, case when list_contains(way, i.item) then 'repeat' when i.tag is null and depth = 4 then 'expandable' end kind, way, list_concat(pos, [n, i.slot]) as pos from (
     select root, path, depth, producer, way, pos, n, unnest(ins) i from (
      select t.root, t.path, t.depth + 1 as depth, p.producer, t.way, t.pos, p.ins, row_number() over (partition by t.root, t.path order by p.seq) - 1 n from t join p on p.output = t.item
      where t.tag is null and t.stub is null and t.depth < 4 and len(list_filter(p.ins, lambda x: x.item is null or not list_contains(t.way, x.item))) > 0)))))
 select root, path, depth, producer, item, tag, stub, reference from t""")
def producer_tree_refs(spark: SparkSession, at: str) -> DataFrame:
    """The trees of all items to depth 4; what stands in a tree with as much depth left is not drawn again."""
    w, slot, p = _ring(spark, at), F.col("slot"), F.col("p")
    made = w.where("j % 7 <> 6").withColumn("p", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("producer", F.concat_ws("-", F.col("k").cast("string"), p.cast("string")))
    inputs = made.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(2)))).where((slot < 2) | (F.col("j") % 2 == 1))
    item = F.when(slot == 0, _item(3 * F.col("j") + 1 + p)).when(slot == 1, _item(5 * F.col("j") + 7 * p + 2))
    inputs = inputs.select("producer", "slot", item.alias("item"), F.when(slot == 2, F.concat(F.lit("t"), p.cast("string"))).alias("tag"))
    return trees.with_references(w.select(_item(F.col("j")).alias("item")), made.select(_item(F.col("j")).alias("output"), "producer", p.alias("seq")), inputs, depth=4)


# ---- by cards


def _recipes(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Producers, inputs and members of all items: two crafts that differ in a slot, smelting at two stations, a tag, dyeing, trade,
    and for some a block that packs them."""
    w, j = _ring(spark, at), F.col("j")
    block = F.concat(_item(j), F.lit("_block"))
    no = F.lit(None).cast("string")
    row = lambda end, seq, method, station, count, source, *inputs, output=None, where="true": (end, seq, method, station, count, source, inputs, output, where)
    kinds = [
        row("e", 0, "crafting", None, 2, "ns:dye_x", (F.lit("dye"), None, 1), (_item(3 * j + 2), None, 1)),
        row("b1", 1, "smelting", "smoker", None, "ns:cook", (_item(j + 5), None, 1)),
        row("b2", 2, "smelting", "furnace", 1, "ns:cook", (_item(j + 9), None, None)),
        row("a1", 3, "crafting", None, None, "ns:x", (_item(3 * j + 1), None, 1), (_item(5 * j + 2), None, 2)),
        row("a2", 4, "crafting", None, 1, "ns:y", (_item(3 * j + 1), None, None), (_item(7 * j + 3), None, 2)),
        row("c", 5, "crafting", None, 3, "ns:x", (no, "ns:t", 1), (_item(2 * j + 1), None, 1)),
        row("d", 6, "trade", None, 1, "ns:x", (_item(j + 1), None, 1)),
        row("f", 7, "crafting", None, 9, "ns:x", (block, None, 1), where="j % 5 = 0"),
        row("g", 8, "crafting", None, 1, "ns:x", (_item(j), None, 9), output=block, where="j % 5 = 0"),
    ]
    producers = inputs = None
    for end, seq, method, station, count, source, ins, output, where in kinds:
        rows = w.where("j % 7 <> 6").where(where)
        one = rows.select((_item(j) if output is None else output).alias("output"), _id(end).alias("producer"), F.lit(seq).alias("seq"), F.lit(method).alias("method"), F.lit(station).cast("string").alias("station"), F.lit(count).cast("int").alias("count"), F.lit(source).alias("source"), F.lit(None).cast("array<int>").alias("grid"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
        producers = one if producers is None else producers.unionByName(one)
        for slot, (item, tag, n) in enumerate(ins):
            its = rows.select(_id(end).alias("producer"), F.lit(slot).alias("slot"), item.alias("item"), F.lit(tag).cast("string").alias("tag"), F.lit(n).cast("int").alias("count"))
            inputs = its if inputs is None else inputs.unionByName(its)
    listed = w.where("j % 7 <> 6").select(_id("c").alias("producer"), F.lit(0).alias("slot"), F.posexplode(F.array(F.concat(F.lit("ns:stripped_"), _item(j)), _item(2 * j + 1))).alias("place", "member"))
    return producers, inputs, listed


# the cards as they must come out: two crafts are one, the two ways of smelting too; dyeing last, but for the block
_CARDS = f"""{_W}, v as (select k, j, 's' || k as output, lambda_x as top from w, (values (true), (false)) l(lambda_x) where j % 7 <> 6),
 c as (
  select case when top then '^' else '_' end || k || 'b1' card, output, top, 1 as seq, 'smelting' as method, 'furnace,smoker' stations, [{{'slot': 0, 'item': 's' || (k // 20 * 20 + (j + 5) % 20), 'tag': null::varchar, 'count': 1, 'child': 's' || (k // 20 * 20 + (j + 5) % 20), 'members': 's' || (k // 20 * 20 + (j + 5) % 20) || ',s' || (k // 20 * 20 + (j + 9) % 20)}}] ins from v
  union all select case when top then '^' else '_' end || k || 'a1', output, top, 2, 'crafting', '', [{{'slot': 0, 'item': 's' || (k // 20 * 20 + (3 * j + 1) % 20), 'tag': null, 'count': 1, 'child': 's' || (k // 20 * 20 + (3 * j + 1) % 20), 'members': null}}, {{'slot': 1, 'item': 's' || (k // 20 * 20 + (5 * j + 2) % 20), 'tag': null, 'count': 2, 'child': 's' || (k // 20 * 20 + (5 * j + 2) % 20), 'members': 's' || (k // 20 * 20 + (5 * j + 2) % 20) || ',s' || (k // 20 * 20 + (7 * j + 3) % 20)}}] from v
  union all select case when top then '^' else '_' end || k || 'c', output, top, 3, 'crafting', '', [{{'slot': 0, 'item': null, 'tag': 'ns:t', 'count': 1, 'child': 's' || (k // 20 * 20 + (2 * j + 1) % 20), 'members': 's' || (k // 20 * 20 + (2 * j + 1) % 20)}}, {{'slot': 1, 'item': 's' || (k // 20 * 20 + (2 * j + 1) % 20), 'tag': null, 'count': 1, 'child': 's' || (k // 20 * 20 + (2 * j + 1) % 20), 'members': null}}] from v
  union all select case when top then '^' else '_' end || k || 'e', output, top, 4, 'crafting', '', [{{'slot': 0, 'item': 'dye', 'tag': null, 'count': 1, 'child': 'dye', 'members': null}}, {{'slot': 1, 'item': 's' || (k // 20 * 20 + (3 * j + 2) % 20), 'tag': null, 'count': 1, 'child': 's' || (k // 20 * 20 + (3 * j + 2) % 20), 'members': null}}] from v
  union all select '^' || k || 'f', output, top, 5, 'crafting', '', [{{'slot': 0, 'item': output || '_block', 'tag': null, 'count': 1, 'child': output || '_block', 'members': null}}] from v where top and j % 5 = 0
  union all select case when top then '^' else '_' end || k || 'g', output || '_block', top, 1, 'crafting', '', [{{'slot': 0, 'item': output, 'tag': null, 'count': 9, 'child': output, 'members': null}}] from v where j % 5 = 0)"""


@query(f"with {_CARDS}, x as (select card, output, top, seq, method, stations, unnest(ins) i from c) select card, output, top, seq, method, stations, i.slot as slot, i.item as item, i.tag as tag, i.count as count, i.child as child, i.members as members from x")
def producer_cards(spark: SparkSession, at: str) -> DataFrame:
    """What the trees draw for each item, at the root and below it."""
    made = trees.cards(*_recipes(spark, at))
    members = made.alternatives.groupBy("card", "slot").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "member"))), lambda x: x["member"]), ",").alias("members"))
    return made.cards.join(made.slots.drop("first").withColumnRenamed("count", "n"), "card").join(members, ["card", "slot"], "left").select("card", "output", "top", "seq", "method", F.array_join("stations", ",").alias("stations"), "slot", "item", "tag", F.col("n").alias("count"), "child", "members")


def _tree_sql(roots: str, depth: int, top: str) -> str:
    return f"""with recursive {_CARDS}, more as (select distinct output from c where not top), t as (
  select item root, 'root' path, 0 as depth, null::varchar card, item, null::varchar tag, 1 as count, null::varchar stub, null::varchar reference, way, true grows from ({roots})
  union all
  select root, path || '.inputs.' || slot, depth, card, child, tag, n, case when again then 'repeat' when not leaf and depth >= {depth} and has then 'expandable' when shown then 'shown' end, case when shown then path || '.inputs.' || first end, case when leaf then way else list_append(way, child) end, not leaf and not depth >= {depth} and not shown from (
   select *, not leaf and depth < {depth} and slot > first and has shown from (
    select root, path, depth, card, i.slot slot, i.child child, i.tag tag, i.count n, way, list_contains(way, i.child) again, list_contains(way, i.child) leaf, i.child in (select output from more) has, list_position(list_transform(ins, lambda x: x.child), i.child) - 1 first from (
     select root, path || '.producers.' || (row_number() over (partition by root, path order by seq) - 1) path, depth, card, way, ins, ins as every from (
      select t.root, t.path, t.depth + 1 as depth, c.card, t.way, c.ins, c.seq from t join c on c.output = t.item and c.top = (t.depth = 0 and {top})
      where t.grows and t.depth < {depth} and len(list_filter(c.ins, lambda x: x.item is null or not list_contains(t.way, x.item))) > 0)), unnest(every) u(i))))
 select root, path, depth, card, item, tag, count, stub, reference from t"""


@query(_tree_sql("select 's' || k item, ['s' || k] way from w", 3, "true"))
def obtain_tree_web(spark: SparkSession, at: str) -> DataFrame:
    """The trees of all items to depth 3 as a reader sees them."""
    return trees.card_tree(_ring(spark, at).select(_item(F.col("j")).alias("item")), trees.cards(*_recipes(spark, at)), depth=3)


@query(_tree_sql("select 's' || k item, ['s' || (b + (j + 1) % 20), 's' || k] way from w", 2, "false"))
def obtain_stubs_web(spark: SparkSession, at: str) -> DataFrame:
    """Each item as a stub below its neighbour, gone on with to depth 2."""
    roots = _ring(spark, at).select(_item(F.col("j")).alias("item"), F.array(_item(F.col("j") + 1)).alias("way"))
    return trees.card_tree(roots, trees.cards(*_recipes(spark, at)), depth=2, top=False)


# ---- collections with columns

_MANIFESTS = (
    '{"id": "food", "rule": {"component": "food"}, "sort": "food.nutrition", "descending": true, "columns": ["food.nutrition", "food.saturation", "compost.chance"]}',
    '{"id": "fuel", "rule": {"section": "FuelInfo"}, "sort": "fuel.burnTime", "columns": ["fuel.burnTime", "fuel.operations"]}',
    '{"id": "barter", "rule": {"method": "bartering"}, "sort": "obtain.chance", "descending": true, "columns": ["obtain.chance", "obtain.stackRange", "obtain.perAttempt"]}',
    '{"id": "jobs", "rule": {"kind": "small"}, "sort": "name", "descending": true, "columns": ["profession.workstation", "profession.tradeCount"]}',
)
_NUMBER = lambda x: f"case when {x} = floor({x}) then floor({x})::bigint::varchar else rtrim(printf('%.2f', {x}), '0') end"


@query(f"""with e as (select p_partkey k, 'p' || p_partkey id, p_name as name, p_size s from part), o as (select l_partkey k, sum(l_discount) chance, sum(l_tax) attempt, min(l_linenumber) least, max(case when l_quantity > 25 then cast(l_quantity as int) else l_linenumber end) most from lineitem where l_returnflag = 'R' and l_linestatus = 'O' group by 1),
 c as (
  select 'food' as collection, id, name, row_number() over (order by -s, lower(name), id) place, 'food.nutrition=' || s || ';food.saturation=' || {_NUMBER("s * 0.3::double")} || case when s % 4 = 0 then ';compost.chance=' || s || '%' else '' end as cells from e where s % 2 = 0
  union all select 'fuel', id, name, row_number() over (order by s, lower(name), id), 'fuel.burnTime=' || {_NUMBER("s * 50 / 20.0::double")} || 's;fuel.operations=' || {_NUMBER("s * 50 / 200.0::double")} from e where s % 5 = 0
  union all select 'barter', id, name, row_number() over (order by case when chance is null then 2 else 0 end, case when chance is null then 0 else -printf('%.3f', chance * 100)::double end, lower(name), id), case when chance is null then '' else 'obtain.chance=' || printf('%.3f', chance * 100) || '%;obtain.stackRange=' || case when least = most then least || '' else least || '-' || most end || ';obtain.perAttempt=' || printf('%.3f', attempt) end from e left join o using (k) where k in (select l_partkey from lineitem where l_returnflag = 'R')
  union all select 'jobs', id, name, row_number() over (order by lower(name) desc, id desc), 'profession.tradeCount=' || s || ';profession.workstation=@p' || (k % 7) from e where s < 10)
 select collection, id, name, place, cells from c""")
def collection_tables(spark: SparkSession, at: str) -> DataFrame:
    """Members of four manifests of different rules, with their columns, in their order."""
    part, lines, size = spread(table(spark, at, "part"), "p_partkey"), table(spark, at, "lineitem"), F.col("p_size")
    id_ = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    entities = part.select(id_.alias("id"), F.when(size < 10, "small").otherwise("large").alias("kind"), F.col("p_name").alias("name"))
    none = F.lit(None)
    attr = lambda section, name, number=none, ref=none: F.struct(F.lit(section).alias("section"), F.lit(name).alias("attr"), number.cast("double").alias("number"), none.cast("string").alias("text"), ref.cast("string").alias("ref"))
    rows = F.array(attr("FoodInfo", "nutrition", size), attr("FoodInfo", "saturation", size * F.lit(0.3)), attr("FuelInfo", "burn_time", size * 50), attr("ProfessionInfo", "trade_count", size), attr("ProfessionInfo", "workstation", ref=F.concat(F.lit("p"), (F.col("p_partkey") % 7).cast("string"))))
    sections = part.select(id_.alias("id"), F.lit(0).alias("seq"), F.inline(F.concat(rows, F.when(size % 4 == 0, F.array(attr("CompostInfo", "chance", size))).otherwise(F.slice(rows, 1, 0)))))
    id_line = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    producers = lines.where("l_returnflag = 'R'").select(id_line.alias("id"), F.lit("bartering").alias("method"), F.when(F.col("l_linestatus") == "O", F.col("l_discount")).alias("chance"), F.col("l_tax").alias("per_attempt"), F.col("l_linenumber").alias("count"), F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("int")).alias("count_max"))
    specs = collections.manifests(_MANIFESTS)
    facts = {"component": part.where(size % 2 == 0).select(id_.alias("id"), F.lit("food").alias("value")), "section": part.where(size % 5 == 0).select(id_.alias("id"), F.lit("FuelInfo").alias("value")), "method": producers.select("id", F.col("method").alias("value")).distinct()}
    asked = sorted({c for s in specs.values() for c in s["columns"]})
    loot, found = entities.select("id", F.col("kind").alias("container"), F.col("name").alias("item")), entities.select("id", none.cast("string").alias("text"), none.cast("string").alias("ref"))
    made = collections.tables_of(specs, entities, facts, collections.fact_values(asked, sections, loot, producers, found))
    texts = F.transform(F.map_entries("values"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    refs = F.transform(F.map_entries("refs"), lambda e: F.concat(e["key"], F.lit("=@"), e["value"]))
    cells = F.concat(texts, refs)
    order = {c: i for i, c in enumerate(["food.nutrition", "food.saturation", "compost.chance", "fuel.burnTime", "fuel.operations", "obtain.chance", "obtain.stackRange", "obtain.perAttempt", "profession.tradeCount", "profession.workstation"])}
    rank = lambda x: F.array_position(F.array(*map(F.lit, order)), F.substring_index(x, "=", 1))
    return made.select("collection", "id", "name", "place", F.array_join(F.array_sort(cells, lambda a, b: (rank(a) - rank(b)).cast("int")), ";").alias("cells"))
