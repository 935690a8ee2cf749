"""Names, registries, icons and sections, bound to the driver's tables with SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered, resolve, sections
from ..sources.tables import table
from .registry import query

ROWS_SQL = "(select p_partkey // 3 as id, p_size % 3 as registry, p_brand as name, p_partkey as row_id from part)"


def _rows(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "part").select(F.floor(F.col("p_partkey") / 3).alias("id"), (F.col("p_size") % 3).alias("registry"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("row_id"))


@query(f"""with r as {ROWS_SQL}, a as (select distinct id, id % 3 as want, 'Brand#' || (1 + id % 5) as slug from r), c as (
 select a.id, 0 as level, row_id from a join r on a.id = r.id and registry = want union all select a.id, 1, row_id from a join r on a.id = r.id and registry = want and name = slug
 union all select a.id, 2, row_id from a join r on a.id = r.id and name = slug union all select a.id, 3, row_id from a join r on a.id = r.id),
 k as (select id, level, min(row_id) row_id from c group by 1, 2 having count(distinct row_id) = 1)
 select a.id, b.level, b.row_id from a left join (select id, min(level) as level, arg_min(row_id, level) row_id from k group by 1) b on a.id = b.id""")
def own_row(spark: SparkSession, at: str) -> DataFrame:
    """The row of an id: the only one of its registry, else the one of its slug there, else of its slug anywhere, else the only one."""
    rows = _rows(spark, at)
    asked = rows.select("id", (F.col("id") % 3).alias("want"), F.concat(F.lit("Brand#"), (1 + F.col("id") % 5).cast("string")).alias("slug")).distinct()
    both = asked.join(rows, "id")
    here, slug = F.col("registry") == F.col("want"), F.col("name") == F.col("slug")
    levels = F.filter(F.array(F.when(here, 0), F.when(here & slug, 1), F.when(slug, 2), F.lit(3)), lambda x: x.isNotNull())
    best = resolve.best_of(both.select("id", "row_id", F.explode(levels).alias("level")), ["id"], "row_id")
    return asked.select("id").join(best, "id", "left").select("id", "level", "row_id")


@query(f"""with r as {ROWS_SQL}, e as (select id, registry, list_sort(list(distinct name)) as names from r group by 1, 2), f as (select *, min(registry) over (partition by id) first from e),
 g as (select id, list(registry order by registry) rs, flatten(list(names) filter (where registry = first)) n0, flatten(list(names) filter (where registry <> first)) n1 from f group by 1),
 h as (select *, len(rs) > 1 and not list_has_any(n0, n1) as two from g),
 o as (select id, 0 as part, case when two then rs[1:1] else rs end rs, case when two then n0 else list_distinct(list_concat(n0, coalesce(n1, []))) end ns from h union all select id, 1, rs[2:], list_distinct(n1) from h where two)
 select id, part, array_to_string(rs, ',') registries, array_to_string(list_sort(ns), ',') as names from o""")
def registries_of_id(spark: SparkSession, at: str) -> DataFrame:
    made = resolve.registries_of(_rows(spark, at), "id", "registry", "registry", "name")
    return made.select("id", "part", F.array_join(F.transform("registries", lambda x: x.cast("string")), ",").alias("registries"), F.array_join("names", ",").alias("names"))


@query("""with a as (select distinct p_name || ' ' || p_size as name, p_name base, p_size from part), k as (select distinct 'full:' || p_name || ' ' || p_size as key, p_partkey as id from part where p_size < 10 union select 'base:' || p_name, 5 from part where p_name like 'red%' union select 'size:' || p_size, p_size * 100 from part where p_size > 30),
 c as (select name, 0 as level, 'full:' || name as key from a union all select name, 1, 'base:' || base from a where p_size % 2 = 0 union all select name, 2, 'size:' || p_size from a),
 f as (select name, level, count(distinct id) n_ids, min(id) as id from c join k using (key) group by 1, 2), b as (select name, min(level) as level from f group by 1)
 select a.name, case b.level when 0 then 'full' when 1 then 'base' when 2 then 'size' end route, case when n_ids = 1 then id end as id, n_ids,
 'full' || case when p_size % 2 = 0 and coalesce(b.level, 9) >= 1 then ',base' else '' end || case when coalesce(b.level, 9) >= 2 then ',size' else '' end tried from a left join b on a.name = b.name left join f on f.name = b.name and f.level = b.level""")
def icon_routes(spark: SparkSession, at: str) -> DataFrame:
    part = table(spark, at, "part")
    asked = part.select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"), F.col("p_name").alias("base"), "p_size").distinct()
    known = part.where("p_size < 10").select(F.concat(F.lit("full:"), "p_name", F.lit(" "), F.col("p_size").cast("string")).alias("key"), F.col("p_partkey").alias("id"))
    known = known.union(part.where("p_name like 'red%'").select(F.concat(F.lit("base:"), "p_name"), F.lit(5))).union(part.where("p_size > 30").select(F.concat(F.lit("size:"), F.col("p_size").cast("string")), F.col("p_size") * 100))
    routes = [("full", F.concat(F.lit("full:"), "name")), ("base", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("base:"), "base"))), ("size", F.concat(F.lit("size:"), F.col("p_size").cast("string")))]
    return resolve.by_routes(asked, routes, known).withColumn("tried", F.array_join("tried", ","))


@query("""with p as (select event_id, 't' || (event_id % 50) title, case when event_id % 3 > 0 then 't' || (event_id % 75) end parent from events), i as (select title, max(event_id) id from p group by 1)
 select event_id, p.title, i.id parent_id, parent is not null and i.id is null missing from p left join i on i.title = p.parent""")
def parent_titles(spark: SparkSession, at: str) -> DataFrame:
    name = lambda n: F.concat(F.lit("t"), (F.col("event_id") % n).cast("string"))
    pages = table(spark, at, "events").select("event_id", name(50).alias("title"), F.when(F.col("event_id") % 3 > 0, name(75)).alias("parent"))
    return resolve.parents_by_title(pages, "title", "parent", "event_id", "event_id")


@query("select p_partkey, case when p_partkey in (select l_partkey from lineitem where l_quantity > 49) then 'mob' when p_partkey in (select l_partkey from lineitem where l_returnflag = 'R') then 'undecided' else 'neither' end as class from part")
def entity_classes(spark: SparkSession, at: str) -> DataFrame:
    lines = table(spark, at, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_returnflag")
    return resolve.existence(table(spark, at, "part"), "p_partkey", [("mob", lines.where("l_quantity > 49")), ("undecided", lines.where("l_returnflag = 'R'"))], "neither")


@query("select s_suppkey, min(n_regionkey) n_regionkey from supplier join nation on s_nationkey = n_nationkey group by 1")
def sole_region(spark: SparkSession, at: str) -> DataFrame:
    """Each supplier's one region; several would raise."""
    both = table(spark, at, "supplier").join(table(spark, at, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return resolve.sole(both, "s_suppkey", "n_regionkey")


@query("""with c as (select l_orderkey, l_linestatus, string_agg(l_partkey || ':' || l_quantity, ',' order by -l_quantity, l_partkey) items from (select distinct l_orderkey, l_linestatus, l_partkey, l_quantity from lineitem) group by 1, 2)
 select l_orderkey, string_agg(l_linestatus || '=' || items, ';' order by l_linestatus) containers from c group by 1""")
def chest_loot(spark: SparkSession, at: str) -> DataFrame:
    lines = table(spark, at, "lineitem").select("l_orderkey", "l_linestatus", "l_partkey", "l_quantity").distinct()
    made = sections.nested_items(lines, "l_orderkey", "l_linestatus", ["l_partkey"], "l_quantity", "l_partkey")
    items = lambda c: F.array_join(F.transform(c["items"], lambda x: F.concat_ws(":", x["l_partkey"].cast("string"), x["l_quantity"].cast("string"))), ",")
    return made.select("l_orderkey", F.array_join(F.transform("containers", lambda c: F.concat(c["l_linestatus"], F.lit("="), items(c))), ";").alias("containers"))


@query("""with e as (select l_partkey, case when l_suppkey % 3 = 0 then 'chest' when l_suppkey % 3 = 1 then 'loot' else 'other' end family, 's' || l_suppkey // 6 as reference, min(l_orderkey * 100 + l_linenumber) seq from lineitem group by 1, 2, 3),
 k as (select l_partkey, min(case family when 'chest' then 1 when 'loot' then 2 end) r from e group by 1)
 select l_partkey, family, string_agg(reference, ',' order by seq, reference) as found from e join k using (l_partkey) where case family when 'chest' then 1 when 'loot' then 2 end = r group by 1, 2""")
def obtain_found_in(spark: SparkSession, at: str) -> DataFrame:
    lines = table(spark, at, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    k = F.col("s_suppkey")
    sources = table(spark, at, "supplier").select(k.alias("l_suppkey"), F.when(k % 3 == 0, "chest").when(k % 3 == 1, "loot").otherwise("other").alias("family"), F.concat(F.lit("s"), F.floor(k / 6).cast("string")).alias("reference"))
    return sections.found_in(lines, sources, "l_partkey", "l_suppkey", ["chest", "loot"]).withColumn("found", F.array_join("found", ","))


@query("""with f as (select l_partkey, l_suppkey, min(l_orderkey * 100 + l_linenumber) seq from lineitem group by 1, 2), n as (select l_partkey, arg_min('tool ' || l_linestatus, l_orderkey * 100 + l_linenumber) note from lineitem where l_returnflag = 'R' group by 1)
 select f.l_partkey, string_agg(l_suppkey, ',' order by seq, l_suppkey) drops, any_value(note) note from f left join n on n.l_partkey = f.l_partkey group by 1""")
def block_drops(spark: SparkSession, at: str) -> DataFrame:
    lines = table(spark, at, "lineitem").withColumn("seq", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    note = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("tool "), "l_linestatus"))
    made = sections.ordered_distinct(lines, "l_partkey", "l_suppkey", "seq", note)
    return made.select("l_partkey", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("drops"), "note")


@query("select d.doc_id, case when lang is not null then quality end section, case when lang is not null and l.doc_id is not null then 'B' end tier from documents d left join labels l on l.doc_id = d.doc_id")
def attached_sections(spark: SparkSession, at: str) -> DataFrame:
    docs, parts = table(spark, at, "documents").select("doc_id", "lang"), table(spark, at, "labels").select("doc_id", F.col("quality").alias("section"))
    return sections.attached(docs, parts, "doc_id", F.col("lang").isNotNull(), "B")[0].drop("lang")


@query("select l.doc_id, l.quality section, case when d.doc_id is null then 'no such entity' else 'not allowed' end reason from labels l left join documents d on l.doc_id = d.doc_id where d.lang is null or d.lang = 'en'")
def attach_rejects(spark: SparkSession, at: str) -> DataFrame:
    docs, parts = table(spark, at, "documents").select("doc_id", "lang"), table(spark, at, "labels").select("doc_id", F.col("quality").alias("section"))
    return sections.attached(docs, parts, "doc_id", F.col("lang").isNotNull() & (F.col("lang") != "en"), "B")[1]


@query("select p_brand, count(*) total, count(*) filter (where p_size % 4 <> 0) iconed, count(*) filter (where p_size % 4 = 0) missing from part group by 1")
def registry_counts(spark: SparkSession, at: str) -> DataFrame:
    return sections.registry_counts(table(spark, at, "part"), "p_brand", F.when(F.col("p_size") % 4 != 0, F.col("p_name")))


@query("select a.n_name, a.n_regionkey, coalesce(string_agg(b.n_name, ',' order by b.n_name), '') as others from nation a left join nation b on a.n_regionkey = b.n_regionkey and a.n_name <> b.n_name group by 1, 2")
def exclusive_others(spark: SparkSession, at: str) -> DataFrame:
    return sections.others(table(spark, at, "nation").select("n_name", "n_regionkey"), "n_name", "n_regionkey").withColumn("others", F.array_join("others", ","))


@query("select l_orderkey, string_agg(x, ',' order by x) levels from (select distinct l_orderkey, unnest([l_linenumber, l_linenumber + 2]) x from lineitem) group by 1")
def collected_levels(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "lineitem").select("l_orderkey", F.array("l_linenumber", F.col("l_linenumber") + 2).alias("levels"))
    return sections.collected(rows, "l_orderkey", "levels").withColumn("levels", F.array_join(F.transform("levels", lambda x: x.cast("string")), ","))


@query("""with k as (select event_id, user_id, event_type, case event_type when 'signup' then 0 when 'click' then 1 when 'purchase' then 2 else 999 end r from events)
 select event_id, user_id, row_number() over (partition by user_id order by r, event_type, event_id) place from k""")
def level_rank(spark: SparkSession, at: str) -> DataFrame:
    """Levels in their declared order, unknown ones last by name, equal ones as they came."""
    made = table(spark, at, "events").select("event_id", "user_id", "event_type", ordered.declared(F.col("event_type"), ["signup", "click", "purchase"]).alias("r"))
    return ordered.numbered(made, ["user_id"], ["r", "event_type", "event_id"], "place").select("event_id", "user_id", "place")
