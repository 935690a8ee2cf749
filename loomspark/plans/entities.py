"""References, merged entities and producers of drops and trades, bound to the driver's tables with SQL beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..operators import loot, ordered, resolve, sections
from ..sources.tables import table
from . import worlds
from .registry import query


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("""with r as (select p_size, case when p_type = 'PROMO' then 0 when p_brand like '%3' then 1 else 2 end as level, p_name || '|' || p_partkey page from part)
 select p_size, split_part(min(case when level = m then page end), '|', 1) as name, m as level from (select *, min(level) over (partition by p_size) m from r) group by p_size, m""")
def structure_pages(spark: SparkSession, at: str) -> DataFrame:
    """The page of an id: of the preferred kind, else of the special case, else the first of all."""
    level = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_brand").like("%3"), 1).otherwise(2)
    rows = table(spark, at, "part").select("p_size", level.alias("level"), _text(F.col("p_name"), "|", F.col("p_partkey")).alias("page"))
    best = rows.groupBy("p_size").agg(F.min(F.struct("level", "page")).alias("b"))
    return best.select("p_size", F.element_at(F.split("b.page", "\\|"), 1).alias("name"), F.col("b.level").alias("level"))


@query("""with n as (select 'item/' || s_name as key, s_suppkey as id from supplier where s_suppkey % 3 = 0 union all select 'block/' || s_name, s_suppkey + 1000 from supplier where s_suppkey % 2 = 0 union all select 'title/' || s_name, s_suppkey + 2000 from supplier where s_suppkey % 5 = 0),
 c as (select s_name as name, i as level, p || s_name as key from supplier, (values (0, 'item/'), (1, 'block/'), (2, 'title/')) t(i, p)), f as (select name, level, id from c join n using (key)), b as (select name, min(level) as level from f group by 1)
 select s_name as name, b.level, f.id from supplier left join b on b.name = s_name left join f on f.name = b.name and f.level = b.level""")
def registry_refs(spark: SparkSession, at: str) -> DataFrame:
    """A name in the first registry that has it, else in title case."""
    s = table(spark, at, "supplier")
    k = F.col("s_suppkey")
    name = lambda p: F.concat(F.lit(p), "s_name")
    names = s.where(k % 3 == 0).select(name("item/").alias("key"), k.alias("id")).union(s.where(k % 2 == 0).select(name("block/"), k + 1000)).union(s.where(k % 5 == 0).select(name("title/"), k + 2000))
    asked = s.select(F.col("s_name").alias("name"))
    levels = [F.concat(F.lit("item/"), "name"), F.concat(F.lit("block/"), "name"), F.concat(F.lit("title/"), F.col("name"))]
    return resolve.priority_join(asked, levels, names).select("name", "level", "id")


@query("select n_name, case n_nationkey % 4 when 0 then 'long_' when 1 then 'strong_' when 2 then '' end || lower(n_name) as ref from nation where n_nationkey % 4 < 3 and not (n_nationkey % 4 = 1 and n_nationkey > 12)")
def variant_refs(spark: SparkSession, at: str) -> DataFrame:
    """A qualifier names the form of a potion; a form that is not known has no reference."""
    n, k = table(spark, at, "nation"), F.col("n_nationkey")
    asked = n.select("n_name", F.when(k % 4 == 0, "extended").when(k % 4 == 1, "enhanced").when(k % 4 == 2, "plain").otherwise("odd").alias("qualifier"))
    forms = spark.createDataFrame([("extended", "long_"), ("enhanced", "strong_"), ("plain", "")], "qualifier string, prefix string")
    known = n.select(F.lower("n_name").alias("ref")).union(n.select(F.concat(F.lit("long_"), F.lower("n_name")))).union(n.where(k <= 12).select(F.concat(F.lit("strong_"), F.lower("n_name"))))
    return asked.join(F.broadcast(forms), "qualifier").select("n_name", F.concat("prefix", F.lower("n_name")).alias("ref")).join(known, "ref", "left_semi").select("n_name", "ref")


@query("select e.event_id, n.note from events e left join (select user_id, event_type, arg_max(event_id, event_id) note from events where event_id % 3 = 0 group by 1, 2) n on n.user_id = e.user_id and n.event_type = e.event_type")
def spawn_notes(spark: SparkSession, at: str) -> DataFrame:
    e = table(spark, at, "events").select("event_id", "user_id", "event_type")
    return sections.last_notes(e, e.where("event_id % 3 = 0").withColumn("note", F.col("event_id")), ["user_id", "event_type"], "note", "event_id").select("event_id", "note")


@query("select l_orderkey, count(distinct l_linestatus) n_places, count(distinct l_partkey) n_items from lineitem group by 1")
def section_facts(spark: SparkSession, at: str) -> DataFrame:
    lines = table(spark, at, "lineitem").select("l_orderkey", "l_linestatus", "l_partkey", "l_quantity").distinct()
    made = sections.nested_items(lines, "l_orderkey", "l_linestatus", ["l_partkey"], "l_quantity", "l_partkey")
    keys = F.transform("containers", lambda c: F.struct(F.transform(c["items"], lambda x: x["l_partkey"]).alias("keys")))
    return sections.section_facts(made.select("l_orderkey", keys.alias("containers")), "l_orderkey", "containers", "keys")


@query("select c_custkey, case when c_custkey % 3 = 0 then 'n' || c_nationkey else 'c' || c_custkey end icon from customer")
def borrowed_icons(spark: SparkSession, at: str) -> DataFrame:
    c, k = table(spark, at, "customer"), F.col("c_custkey")
    own = c.where(k % 3 != 0).select(_text("c", k).alias("id"), _text("c", k).alias("icon"))
    lent = table(spark, at, "nation").select(_text("n", F.col("n_nationkey")).alias("id"), _text("n", F.col("n_nationkey")).alias("icon"))
    rows = c.select(_text("c", k).alias("id"), _text("n", F.col("c_nationkey")).alias("lender"))
    return sections.borrowed(rows, own.union(lent), "id", "icon", "lender").select(F.substring("id", 2, 20).cast("long").alias("c_custkey"), "icon")


@query("""with a as (select user_id, event_type alias, max(event_id % 3) r from events group by 1, 2), s as (select user_id, event_type kind, min(event_id) slot from events where event_id % 2 = 0 group by 1, 2), n as (select user_id, min(event_id) as first_id, max(event_id) as last_id from events group by 1)
 select n.user_id, case when n.user_id % 4 = 0 then -1 else first_id end first_id, case when n.user_id % 4 = 0 then 'C' else 'A' end first_id_tier, last_id, 'A' last_id_tier, x.aliases, y.sections
 from n left join (select user_id, string_agg(alias, ',' order by -r, alias) aliases from a group by 1) x using (user_id) left join (select user_id, string_agg(kind, ',' order by slot) sections from s group by 1) y using (user_id)""")
def merge_entities(spark: SparkSession, at: str) -> DataFrame:
    e = table(spark, at, "events")
    names = e.groupBy("user_id").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    aliases = e.select("user_id", F.col("event_type").alias("alias"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("rank"))
    parts = e.where("event_id % 2 = 0").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.lit(False).alias("front"), "value")
    overrides = names.where("user_id % 4 = 0").select("user_id", F.lit(-1).cast("long").alias("first_id"))
    made = sections.merged(names, aliases, parts, overrides, "user_id", ["first_id", "last_id"])
    return made.withColumns({"aliases": F.array_join("aliases", ","), "sections": F.array_join("sections", ",")})


FLAGS_SQL = "(select distinct l_partkey % 40 o, l_suppkey % 40 s, l_linenumber c, case when l_returnflag = 'R' then 'smelting' when l_returnflag = 'A' then 'trading' else 'crafting' end m from lineitem)"


@query(f"select o, s, c, m, m in ('trading', 'fishing') acquisition, exists (select 1 from {FLAGS_SQL} b where b.o = a.s and b.s = a.o and a.o <> a.s) round_trip, c > 1 and exists (select 1 from {FLAGS_SQL} b where b.o = a.s and b.s = a.o and a.o <> a.s) unpacking, m = 'smelting' refining from {FLAGS_SQL} a")
def producer_flags(spark: SparkSession, at: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "smelting").when(F.col("l_returnflag") == "A", "trading").otherwise("crafting")
    edges = table(spark, at, "lineitem").select((F.col("l_partkey") % 40).alias("o"), (F.col("l_suppkey") % 40).alias("s"), F.col("l_linenumber").alias("c"), kind.alias("m")).distinct()
    return resolve.edge_flags(edges, "o", "s", "m", "c", ["trading", "fishing"])


@query("select p_partkey, p_brand, row_number() over (partition by p_brand order by p_size % 7 = 0, p_name like 'red%', p_partkey) place from part qualify place <= 30")
def flags_last(spark: SparkSession, at: str) -> DataFrame:
    """A stable sort that puts flagged rows last, one flag after the other."""
    part = table(spark, at, "part")
    order = ordered.last_if([F.col("p_size") % 7 == 0, F.col("p_name").like("red%")], "p_partkey")
    return ordered.top_k(part, ["p_brand"], order, 30, "place").select("p_partkey", "p_brand", "place")


@query("select p_partkey, m mob, i as item, p_size % 2 = 0 tamed from part, (values ('Cow'), ('Goat')) a(m), (values ('Wheat'), ('Hay')) b(i) union all select p_partkey, p_name, 'Seeds', false from part")
def breeding(spark: SparkSession, at: str) -> DataFrame:
    """Each mob of a row of a wiki table with each of its items; a mark at the mob says that it must be tamed."""
    mark = F.when(F.col("p_size") % 2 == 0, "<br>(must be tamed)").otherwise("")
    wiki = _text("{|\n! Mob !! Items\n|-\n| [[Cow]] [[Goat]]", mark, " || {{x}} [[Wheat]], [[Hay|bale]]\n|-\n| [[", F.col("p_name"), "]] || [[Seeds]]\n|}")
    cells = table(spark, at, "part").select("p_partkey", F.inline(markup.table_cells(wiki))).where("not header")
    by = cells.groupBy("p_partkey", "row").agg(F.max(F.when(F.col("col") == 0, F.col("text"))).alias("mobs"), F.max(F.when(F.col("col") == 1, F.col("text"))).alias("items"))
    links = lambda c: F.regexp_extract_all(c, F.lit(r"\[\[([^\[\]|]+)"), F.lit(1))
    return by.select("p_partkey", F.explode(links("mobs")).alias("mob"), "items", F.col("mobs").contains("tamed").alias("tamed")).select("p_partkey", "mob", F.explode(links("items")).alias("item"), "tamed")


DROPS_SQL = "(select p_partkey source, case when p_size % 3 = 0 then lower((select min(n_name) from nation)) else 'what ' || p_size end item, p_size / 50.0 chance, p_size % 3 kind, p_size % 2 odd from part)"


def _drops(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    n, size = table(spark, at, "nation"), F.col("p_size")
    names = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    first = n.agg(F.min("n_name").alias("a"), F.max("n_name").alias("z"))  # one row
    item = F.when(size % 3 == 0, F.lower("a")).otherwise(_text("what ", size))
    notes = F.when(size % 3 == 1, F.concat(F.lit("see [["), "a", F.lit("]] and [["), "z", F.lit("|it]]"), F.when(size % 2 == 1, " or [[Nowhere]]").otherwise("")))
    return loot.drop_producers(table(spark, at, "part").join(F.broadcast(first), how="cross").select(F.col("p_partkey").alias("source"), item.alias("item"), (size / 50).alias("chance"), notes.alias("notes")), names)


@query(f"select source, (select arg_min(n_nationkey, n_name) from nation) as output, chance from {DROPS_SQL} where kind = 0 union all select source, unnest([(select arg_min(n_nationkey, n_name) from nation), (select arg_max(n_nationkey, n_name) from nation)]), chance from {DROPS_SQL} where kind = 1 and odd = 0")
def drop_producers(spark: SparkSession, at: str) -> DataFrame:
    return _drops(spark, at)[0]


@query(f"select source, item, chance from {DROPS_SQL} where kind = 2 or kind = 1 and odd = 1")
def drop_rejects(spark: SparkSession, at: str) -> DataFrame:
    return _drops(spark, at)[1]


@query(f"""with n as (select p_name as name from part group by 1 having min(p_partkey) % 2 = 0), i as (select p_name as name, min(p_partkey) as id from part where p_name in (select name from n) group by 1 union all select distinct p_brand, -1 from part union all select distinct p_type, -2 from part)
 select t.p_partkey, -2 as output, 1 as count, a.id || 'x' || p_size || case when p_size % 5 = 0 then ',-1x3' else '' end inputs from {worlds.TRADE_SQL} t join i a on a.name = t.p_name""")
def trade_producers(spark: SparkSession, at: str) -> DataFrame:
    part = table(spark, at, "part")
    items = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).where("id % 2 = 0")
    names = items.union(part.select("p_brand", F.lit(-1)).distinct()).union(part.select("p_type", F.lit(-2)).distinct())
    made = loot.trade_producers(worlds._trades(spark, at)[0], names, "p_partkey")
    return made.withColumn("inputs", F.array_join(F.transform("inputs", lambda x: F.concat_ws("x", x["item"].cast("string"), x["count"].cast("string"))), ","))
