"""Each operator bound to the driver's tables, with the same in DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import collections, emit, gate, graph, merge, odds, ordered, resolve, rows, search
from ..session import spread
from ..sources.tables import RowQuery, json_field, resolve_titles, table
from . import entities as _entities_, gates as _gates, markup as _markup, names as _names, packs as _packs, pages as _pages, producers as _producers, workshop as _workshop, worlds as _worlds  # noqa: F401
from .registry import ORACLES, QUERIES, query  # noqa: F401


def part_name() -> Column:
    return F.concat_ws(" ", "p_brand", "p_name", F.col("p_size").cast("string"))


NAME_SQL = "p_brand || ' ' || p_name || ' ' || p_size"


# ---- odds and aggregates


@query("select l_orderkey, l_partkey, l_suppkey, l_quantity, round(l_quantity / nullif(sum(l_quantity) over (partition by l_orderkey), 0), 9) chance from lineitem")
def pool_odds(spark: SparkSession, at: str) -> DataFrame:
    entries = table(spark, at, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return odds.pool_odds(entries, ["l_orderkey"], "l_quantity").withColumn("chance", F.round("chance", 9))


@query("select l_partkey, round(sum(c * (1 + q) / 2), 5) expected, count(*) n from (select l_partkey, l_quantity q, l_quantity / nullif(sum(l_quantity) over (partition by l_orderkey), 0) c from lineitem) group by 1")
def expected_yield(spark: SparkSession, at: str) -> DataFrame:
    entries = table(spark, at, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    made = odds.pool_odds(entries, ["l_orderkey"], "l_quantity")
    each = odds.per_attempt(F.col("chance"), F.lit(1), F.lit(1), F.col("l_quantity"))
    return made.groupBy("l_partkey").agg(F.round(F.sum(each), 5).alias("expected"), F.count("*").alias("n"))


@query("""with o as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) rn from orders)
 select o_custkey, count(*) n_rows, arg_min(o_orderkey, rn) first_id, arg_max(o_orderkey, rn) last_id, string_agg(o_orderkey, ',' order by rn) filter (where rn <= 3) firsts from o group by 1""")
def group_index(spark: SparkSession, at: str) -> DataFrame:
    made = odds.group_index(table(spark, at, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", 3)
    return made.withColumn("firsts", F.array_join(F.transform("firsts", lambda x: x.cast("string")), ","))


@query("select c.c_custkey, o.o_orderkey, row_number() over (partition by c.c_custkey order by o.o_orderdate, o.o_orderkey) place from customer c join orders o on o.o_custkey = c.c_custkey")
def group_order(spark: SparkSession, at: str) -> DataFrame:
    joined = table(spark, at, "customer").select("c_custkey").join(table(spark, at, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate"), "c_custkey")
    return ordered.numbered(joined, ["c_custkey"], ["o_orderdate", "o_orderkey"], "place").drop("o_orderdate")


@query("select user_id, event_type, round(sum(value), 4) amount, round(sum(value) / nullif(sum(sum(value)) over (partition by user_id), 0), 7) share from events group by 1, 2")
def spawn_share(spark: SparkSession, at: str) -> DataFrame:
    sums = table(spark, at, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("amount"))
    return odds.share_of(sums, ["user_id"], F.col("amount"), "share").select("user_id", "event_type", F.round("amount", 4).alias("amount"), F.round("share", 7).alias("share"))


@query("select event_type, count(*) n from events group by 1")
def method_counts(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select l_partkey, l_returnflag, min(l_quantity) lowest, max(l_quantity) highest, sum(case when l_discount = 0 then l_linenumber end) tries, bool_and(l_tax > 0) always, count(distinct l_suppkey) n_members from lineitem group by 1, 2")
def generation_scope(spark: SparkSession, at: str) -> DataFrame:
    return odds.scope(table(spark, at, "lineitem"), ["l_partkey", "l_returnflag"], "l_quantity", F.col("l_linenumber"), F.when(F.col("l_discount") != 0, F.col("l_discount")), F.col("l_tax") > 0, "l_suppkey")


@query("select o_custkey, case when min(o_orderstatus) = max(o_orderstatus) then min(o_orderstatus) end agreed from orders group by 1")
def agreed_value(spark: SparkSession, at: str) -> DataFrame:
    return odds.agreed(table(spark, at, "orders"), ["o_custkey"], F.col("o_orderstatus"))


@query("select p_partkey, level, 1 + 11 * (level - 1) min_cost, 21 + 11 * (level - 1) max_cost from (select p_partkey, unnest(range(1, p_size + 1)) level from part)")
def level_costs(spark: SparkSession, at: str) -> DataFrame:
    return odds.level_costs(table(spark, at, "part"), "p_partkey", "p_size", F.lit(1), F.lit(11), F.lit(20))


@query("select l_orderkey, cast(floor((min(l_linenumber) - max(l_linenumber) - sum(l_linenumber)) / 2) as bigint) middle from lineitem group by 1")
def floor_middle(spark: SparkSession, at: str) -> DataFrame:
    made = table(spark, at, "lineitem").groupBy("l_orderkey").agg((F.min("l_linenumber") - F.max("l_linenumber")).alias("a"), (-F.sum("l_linenumber")).alias("b"))
    return made.select("l_orderkey", odds.middle(F.col("a"), F.col("b")).alias("middle"))


# ---- sources, row classification, text


@query("select p_partkey, p_name, p_size from part where p_size > 10 and p_brand = 'Brand#2' order by p_size desc, p_partkey limit 5000 offset 3")
def row_query(spark: SparkSession, at: str) -> DataFrame:
    q = RowQuery(("p_partkey", "p_name", "p_size")).where("p_size", ">", 10).where("p_brand", "Brand#2").order_by("p_size", True).order_by("p_partkey").limit(5000).offset(3)
    return q.over(table(spark, at, "part"))


REASONS = "case when text is null then 'no text' when lang is null then 'no language' when lang <> 'en' then 'other language' when n_chars < 500 then 'short' end"


@query(f"select doc_id, {REASONS} reject_reason from documents")
def classify_split(spark: SparkSession, at: str) -> DataFrame:
    rules = [("no text", F.col("text").isNull()), ("no language", F.col("lang").isNull()), ("other language", F.col("lang") != "en"), ("short", F.col("n_chars") < 500)]
    return rows.classify(table(spark, at, "documents"), rules).select("doc_id", "reject_reason")


@query("""select p_partkey, case when p_size % 5 = 0 then 'no edition' when p_size % 5 = 1 then 'other edition' when p_size % 5 = 2 then 'never happens' when p_type = 'PROMO' then 'other page' end reject_reason from part""")
def edition_filter(spark: SparkSession, at: str) -> DataFrame:
    """Rows of one edition: by a JSON key that is absent, or there for the other alone, and by a chance of nothing; the first holds."""
    k = F.col("p_size") % 5
    doc = F.when(k == 0, "{}").when(k == 1, '{"second": {"p": 1}}').when(k == 2, '{"first": {"p": 0}, "second": {"p": 1}}').otherwise('{"first": {"p": 0.5}}')
    has = lambda name: F.get_json_object("doc", f"$.{name}").isNotNull()
    rules = [("no edition", ~has("first") & ~has("second")), ("other edition", ~has("first")), ("never happens", json_field(F.col("doc"), "$.first.p", "double") == 0), ("other page", F.col("p_type") == "PROMO")]
    return rows.classify(table(spark, at, "part").withColumn("doc", doc), rules).select("p_partkey", "reject_reason")


@query("select event_id, cast(json_extract(props, '$.k') as int) k from events")
def json_column(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "events").select("event_id", json_field(F.col("props"), "$.k", "int").alias("k"))


@query("select min(doc_id) doc_id, count(*) n_rows, count(distinct source) n_kinds from documents group by text")
def first_wins_dedup(spark: SparkSession, at: str) -> DataFrame:
    return rows.first_of_text(table(spark, at, "documents").select("text", "doc_id", "source"), "text", ["doc_id"], F.col("source")).select("doc_id", "n_rows", "n_kinds")


@query("select p_brand, p_type, coalesce(max(case when p_size = 7 then p_name end), min(p_name)) p_name from part group by 1, 2")
def representative_page(spark: SparkSession, at: str) -> DataFrame:
    return rows.representative(table(spark, at, "part"), ["p_brand", "p_type"], "p_name", F.col("p_size") == 7)


STRIP = "html"
for _p in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->", "<[^>]*>"):
    STRIP = f"regexp_replace({STRIP}, '{_p}', ' ', 'g')"
STRIP = rf"trim(regexp_replace({STRIP}, '[ \t\n\r\f]+', ' ', 'g'))"


@query(f"select page_id, {STRIP} text from pages")
def strip_tags(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query("select page_id, unnest(range(0, len(h))) place, unnest(h) href from (select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) h from pages)")
def page_links(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "pages").select("page_id", F.posexplode(text.hrefs(F.col("html"))).alias("place", "href"))


@query("select p_partkey, case when p_size % 3 = 2 then null else p_size end least, case p_size % 3 when 0 then p_size when 1 then p_size + 4 end most from part")
def int_range(spark: SparkSession, at: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    said = F.when(F.col("p_size") % 3 == 0, size).when(F.col("p_size") % 3 == 1, F.concat_ws("–", size, (F.col("p_size") + 4).cast("string"))).otherwise(F.concat(F.lit("about "), size))
    least, most = text.int_range(said)
    return table(spark, at, "part").select("p_partkey", least.alias("least"), most.alias("most"))


@query("select p_partkey, unnest(range(1, 4)) variant, unnest([p_name, p_brand, p_type]) item, p_size from part")
def packed_variants(spark: SparkSession, at: str) -> DataFrame:
    packed = table(spark, at, "part").select("p_partkey", F.concat_ws("; ", "p_name", "p_brand", "p_type").alias("item"), F.col("p_size").cast("string").alias("p_size"))
    made = rows.variants(packed, ["item", "p_size"])
    return made.select("p_partkey", "variant", "item", F.col("p_size").cast("int").alias("p_size"))


@query("select p_partkey, i // 3 as row, i % 3 as col, substr(' #X# X# XX', 1 + i, 1) symbol, 3 height, 3 width from part, range(9) t(i) where substr(' #X# X# XX', 1 + i, 1) <> ' '")
def recipe_grid(spark: SparkSession, at: str) -> DataFrame:
    shaped = table(spark, at, "part").select("p_partkey", F.array(F.lit(" #X"), F.lit("# X"), F.lit("# X")).alias("pattern"))
    return rows.trimmed(rows.grid_cells(shaped, "pattern", ["p_partkey"]), ["p_partkey"])


@query("select 'k' || n_nationkey title, case when n_nationkey + 3 < 25 and n_nationkey % 5 < 2 then 'k' || (case when (n_nationkey + 1) % 5 < 2 and n_nationkey % 5 = 0 then n_nationkey + 2 else n_nationkey + 1 end) when n_nationkey % 5 < 2 then 'k' || (case when n_nationkey % 5 = 0 then n_nationkey + 2 else n_nationkey + 1 end) else 'k' || n_nationkey end final from nation")
def title_rewrites(spark: SparkSession, at: str) -> DataFrame:
    n = table(spark, at, "nation")
    name = lambda c: F.concat(F.lit("k"), c.cast("string"))
    rewrites = n.where(F.col("n_nationkey") % 5 < 2).select(name(F.col("n_nationkey")).alias("from"), name(F.col("n_nationkey") + 1).alias("to"))
    return resolve_titles(n.select(name(F.col("n_nationkey")).alias("title")), rewrites).select("title", "final")


# ---- names


@query(f"select {NAME_SQL} as name, count(distinct p_partkey) n_ids, min(p_partkey) first_id, max(p_partkey) last_id, string_agg(distinct p_partkey, ',' order by p_partkey) ids from part group by 1 having n_ids > 1")
def ambiguous_names(spark: SparkSession, at: str) -> DataFrame:
    found = resolve.ambiguous(table(spark, at, "part").withColumn("name", part_name()), ["name"], "p_partkey")
    return found.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("select p_brand || ' ' || p_name as name, count(distinct p_type) n_pages, count(distinct p_partkey) n_ids from part group by 1 having n_pages > 1 and n_ids > 1")
def reused_names(spark: SparkSession, at: str) -> DataFrame:
    return resolve.reused(table(spark, at, "part").withColumn("name", F.concat_ws(" ", "p_brand", "p_name")), ["name"], "p_partkey", "p_type")


ASKED_SQL = f"(select distinct case p_size % 3 when 0 then 'Enchanted ' || {NAME_SQL} when 1 then {NAME_SQL} || ' (item)' else {NAME_SQL} end as name from part union select s_name from supplier union select 'no such name')"
NAMES_SQL = f"(select {NAME_SQL} as key, p_partkey as id from part union select s_name, s_suppkey + 1000000000 from supplier)"


def _cascade(unique: bool) -> str:
    best = "where n_ids = 1" if unique else ""
    return f"""with asked as {ASKED_SQL}, names as {NAMES_SQL},
 cand as (select name, 0 as level, name as key from asked union select name, 1, replace(name, 'Enchanted ', '') from asked where starts_with(name, 'Enchanted ') union select name, 2, replace(name, ' (item)', '') from asked where ends_with(name, ' (item)')),
 found as (select distinct name, level, id from cand join names using (key)), cnt as (select name, level, count(*) n_ids from found group by all),
 best as (select name, min(level) as level from cnt {best} group by 1)
 select a.name, b.level, c.n_ids, f.id from asked a left join (best b join cnt c using (name, level) join found f using (name, level)) on a.name = b.name"""


def _asked(spark: SparkSession, at: str) -> tuple[DataFrame, list[Column], DataFrame]:
    part, supplier = table(spark, at, "part").withColumn("name", part_name()), table(spark, at, "supplier")
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Enchanted "), "name")).when(F.col("p_size") % 3 == 1, F.concat("name", F.lit(" (item)"))).otherwise(F.col("name"))
    asked = part.select(said.alias("name")).union(supplier.select("s_name")).union(spark.range(1).select(F.lit("no such name")))
    names = part.select(F.col("name").alias("key"), F.col("p_partkey").alias("id")).union(supplier.select("s_name", F.col("s_suppkey") + 1_000_000_000))
    levels = [F.col("name"), F.when(F.startswith("name", F.lit("Enchanted ")), F.replace("name", F.lit("Enchanted "), F.lit(""))), F.when(F.endswith("name", F.lit(" (item)")), F.replace("name", F.lit(" (item)"), F.lit("")))]
    return asked, levels, names


@query(_cascade(False))
def resolve_name(spark: SparkSession, at: str) -> DataFrame:
    return resolve.priority_join(*_asked(spark, at))


@query(_cascade(True))
def resolve_name_unique(spark: SparkSession, at: str) -> DataFrame:
    return resolve.priority_join(*_asked(spark, at), unique=True)


@query("select coalesce(a.l_partkey, r.l_partkey) l_partkey, case when r.l_partkey is null then 'left_only' when a.l_partkey is null then 'right_only' else 'matched' end side from (select distinct l_partkey from lineitem where l_returnflag = 'A') a full join (select distinct l_partkey from lineitem where l_returnflag = 'R') r on a.l_partkey = r.l_partkey")
def reconcile(spark: SparkSession, at: str) -> DataFrame:
    lines = table(spark, at, "lineitem")
    return resolve.reconcile(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), "l_partkey")


@query("select coalesce(a.l_partkey, r.l_partkey) l_partkey, case when r.l_partkey is null then 'left_only' when a.l_partkey is null then 'right_only' else 'matched' end side from (select distinct l_partkey from lineitem where l_returnflag = 'A') a full join (select distinct l_partkey from lineitem where l_returnflag = 'R') r on a.l_partkey = r.l_partkey")
def reconcile_full(spark: SparkSession, at: str) -> DataFrame:
    """Over all rows of both flags."""
    lines = table(spark, at, "lineitem")
    return resolve.reconcile(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), "l_partkey")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def reference_check(spark: SparkSession, at: str) -> DataFrame:
    return resolve.unattributed(table(spark, at, "documents").select("doc_id"), table(spark, at, "labels"), "doc_id")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def known_members(spark: SparkSession, at: str) -> DataFrame:
    return resolve.members(table(spark, at, "customer").select("c_custkey"), table(spark, at, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


EDGES_SQL = "(select distinct o_custkey src, l_suppkey dst from lineitem join orders on l_orderkey = o_orderkey)"


def _edges(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "lineitem").join(table(spark, at, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


@query(f"with e as {EDGES_SQL} select src, dst from e a where src <> dst and exists (select 1 from e b where b.src = a.dst and b.dst = a.src)")
def reverse_edge(spark: SparkSession, at: str) -> DataFrame:
    return resolve.reverse_edges(_edges(spark, at), "src", "dst")


# ---- merge


@query("""select d.doc_id, case when d.lang is null or l.quality = 0 then 'und' else d.lang end lang, case when d.lang is null or l.quality = 0 then 'C' else 'A' end lang_tier,
 coalesce(l.quality, case when d.n_chars is not null then cast(d.n_chars % 2 as int) end) quality, case when l.quality is not null then 'B' when d.n_chars is not null then 'A' end quality_tier
 from documents d left join labels l on l.doc_id = d.doc_id""")
def tier_merge(spark: SparkSession, at: str) -> DataFrame:
    docs, labels = table(spark, at, "documents"), table(spark, at, "labels")
    a = docs.select("doc_id", "lang", (F.col("n_chars") % 2).cast("int").alias("quality"))
    poor = docs.select("doc_id", "lang").join(labels, "doc_id", "left").where("lang is null or quality = 0").select("doc_id", F.lit("und").alias("lang"))
    return merge.tiered([("A", a), ("B", labels.select("doc_id", "quality")), ("C", poor)], "doc_id", ["lang", "quality"])


@query("""with tags as (select p_partkey, p_size // 10 v from part where p_brand <> 'Brand#2' and p_size < 30 union all select p_partkey, 9 from part where p_brand <> 'Brand#2' and p_name like 'red%'),
 own as (select p_partkey, 77 v from part where p_type = 'PROMO' and p_size > 20), t as (select p_partkey, min(v) v, count(distinct v) n from tags group by 1)
 select coalesce(t.p_partkey, own.p_partkey) p_partkey, coalesce(own.v, case when n = 1 then t.v end) burn, case when own.v is not null and t.v is not null then 'override' when own.v is not null then 'explicit' when n > 1 then 'conflict' else 'tag' end via, coalesce(n, 0) n_values from t full join own on t.p_partkey = own.p_partkey""")
def fact_tiers(spark: SparkSession, at: str) -> DataFrame:
    part = table(spark, at, "part")
    tagged = part.where("p_size < 30").select("p_partkey", F.floor(F.col("p_size") / 10).alias("burn")).union(part.where("p_name like 'red%'").select("p_partkey", F.lit(9)))
    explicit = part.where("p_type = 'PROMO' and p_size > 20").select("p_partkey", F.lit(77).cast("long").alias("burn"))
    return merge.fact_tiers(tagged, explicit, part.where("p_brand = 'Brand#2'"), "p_partkey", "burn")


@query("""with r as (select user_id, event_type, event_id, event_type = 'error' f, value from events)
 select user_id, event_type kind, coalesce(min(case when f then -event_id end), min(event_id)) slot, arg_max(value, event_id) value from r group by 1, 2""")
def section_slots(spark: SparkSession, at: str) -> DataFrame:
    made = table(spark, at, "events").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("front"), "value")
    return merge.sections(made, "user_id")


@query("select user_id, event_type alias, min(event_id) seq, max(cast(floor(value) as bigint) % 3) as rank from events group by 1, 2")
def merged_aliases(spark: SparkSession, at: str) -> DataFrame:
    made = table(spark, at, "events").select("user_id", F.col("event_type").alias("alias"), F.col("event_id").alias("seq"), (F.floor("value") % 3).alias("rank"))
    return merge.aliases(made, "user_id")


# ---- order


@query("select l_orderkey, min(l_linenumber) as first, max(l_linenumber) as last, count(*) n from (select l_orderkey, l_linenumber, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) g from (select distinct l_orderkey, l_linenumber from lineitem)) group by l_orderkey, g")
def islands(spark: SparkSession, at: str) -> DataFrame:
    return ordered.islands(table(spark, at, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("select event_id, user_id, nullif(last_value(case event_type when 'signup' then event_id when 'error' then -1 end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), -1) as scope from events")
def scope_fill(spark: SparkSession, at: str) -> DataFrame:
    events = table(spark, at, "events").select("event_id", "user_id", "ts", "event_type")
    return ordered.scope_fill(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "error", F.col("event_id"), "scope").select("event_id", "user_id", "scope")


VALUE_SQL = "case p_size % 4 when 0 then p_size || '%' when 1 then p_size || 's' when 2 then p_name else ' ' end"


@query(f"""with v as (select p_brand, p_partkey, {VALUE_SQL} as value from part), k as (select *, try_cast(regexp_replace(regexp_replace(trim(value), '%$', ''), 's$', '') as double) num from v),
 b as (select *, case when num is not null then 0 when trim(value) <> '' then 1 else 2 end bucket from k)
 select p_brand, p_partkey, value, row_number() over (partition by p_brand order by bucket, num desc nulls last, case when bucket = 1 then lower(value) end desc nulls last, p_partkey) as rank from b qualify rank <= 50""")
def mixed_sort(spark: SparkSession, at: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    value = F.when(F.col("p_size") % 4 == 0, F.concat(size, F.lit("%"))).when(F.col("p_size") % 4 == 1, F.concat(size, F.lit("s"))).when(F.col("p_size") % 4 == 2, F.col("p_name")).otherwise(F.lit(" "))
    rows_ = table(spark, at, "part").select("p_brand", "p_partkey", value.alias("value"))
    return ordered.top_k(rows_, ["p_brand"], [*ordered.mixed_order(F.col("value"), descending=True), F.col("p_partkey")], 50)


@query("select kind || '-' || ((rn - 1) // 200) shard, count(*) n_rows from (select event_type kind, row_number() over (partition by event_type order by event_id) rn from events) group by 1")
def shards(spark: SparkSession, at: str) -> DataFrame:
    return emit.shard_sizes(table(spark, at, "events").select("event_type", "event_id"), "event_type", ["event_id"])


@query("select l_partkey, l_returnflag, l_quantity, min(l_orderkey) first_l_orderkey, count(*) copies from lineitem group by 1, 2, 3")
def producer_dedup(spark: SparkSession, at: str) -> DataFrame:
    return emit.unique_in_order(table(spark, at, "lineitem"), ["l_partkey", "l_returnflag", "l_quantity"], ["l_orderkey"])


# ---- graphs

TAGS_SQL = "(select distinct 'r' || n_regionkey s, 'n' || n_nationkey d from nation union select 'n' || c_nationkey, 'c' || c_custkey from customer)"


def _tags(spark: SparkSession, at: str) -> DataFrame:
    n, c = table(spark, at, "nation"), table(spark, at, "customer")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return n.select(name("r", "n_regionkey").alias("s"), name("n", "n_nationkey").alias("d")).union(c.select(name("n", "c_nationkey"), name("c", "c_custkey")))


@query(f"with recursive e as {TAGS_SQL}, t as (select s, d, 1 as depth from e union all select t.s, e.d, t.depth + 1 from t join e on t.d = e.s) select s, d, min(depth) as depth from t group by 1, 2")
def tag_closure(spark: SparkSession, at: str) -> DataFrame:
    return graph.closure(_tags(spark, at), "s", "d", acyclic=True)


TURNS_SQL = "(select conv_id || ':' || turn node, lag(conv_id || ':' || turn) over (partition by conv_id order by turn) parent, conv_id, role from conversations)"


def _turns(spark: SparkSession, at: str) -> DataFrame:
    turns = table(spark, at, "conversations").select("conv_id", "turn", "role", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node"))
    return ordered.previous(turns, ["conv_id"], ["turn"], F.col("node"), "parent")


@query(f"with recursive e as {TURNS_SQL}, t as (select node, 0 as depth, cast(node as varchar) path from e where parent is null union all select e.node, t.depth + 1, t.path || '/' || e.node from t join e on e.parent = t.node) select node, depth, path from t")
def ancestry(spark: SparkSession, at: str) -> DataFrame:
    return graph.ancestry(_turns(spark, at), "node", "parent")


FOREST_SQL = "(select 'r' || r_regionkey node, null parent, r_regionkey as g, r_name label from region union all select 'n' || n_nationkey, 'r' || n_regionkey, 0, n_name from nation union all select 'c' || c_custkey, 'n' || c_nationkey, 0, c_name from customer)"


@query(f"with recursive e as (select *, case when parent is null then lpad(cast(g as varchar), 6, '0') else '' end || lower(label) || chr(1) || node own from {FOREST_SQL}), t as (select node, 0 as depth, own sort_path from e where parent is null union all select e.node, t.depth + 1, t.sort_path || chr(2) || e.own from t join e on e.parent = t.node) select node, depth, sort_path from t")
def forest(spark: SparkSession, at: str) -> DataFrame:
    r, n, c = (table(spark, at, t) for t in ("region", "nation", "customer"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = r.select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").alias("g"), F.col("r_name").alias("label"))
    nodes = nodes.union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey"), F.lit(0), "n_name")).union(c.select(name("c", "c_custkey"), name("n", "c_nationkey"), F.lit(0), "c_name"))
    return graph.forest(nodes, "node", "parent", F.col("g"), F.col("label"))


RING_SQL = "(select distinct s_suppkey s, s_suppkey // 20 * 20 + p d from (select s_suppkey, unnest([(3 * (s_suppkey % 20) + 1) % 20, (5 * (s_suppkey % 20) + 2) % 20]) p from supplier))"


@query(f"""with recursive e as {RING_SQL}, t as (select s root, s node, 0 as depth, [s] way, false again from (select distinct s from e) union all
 select t.root, e.d, t.depth + 1, list_append(t.way, e.d), list_contains(t.way, e.d) from t join e on e.s = t.node where not t.again and t.depth < 4)
 select root, node, depth, array_to_string(way, '>') path, case when again then 'repeat' when depth = 4 and node in (select s from e) then 'expandable' end stub from t""")
def obtain_tree(spark: SparkSession, at: str) -> DataFrame:
    """Suppliers in rings of twenty, each made of two others, to depth 4."""
    k = F.col("s_suppkey")
    place = F.explode(F.array((3 * (k % 20) + 1) % 20, (5 * (k % 20) + 2) % 20))
    edges = table(spark, at, "supplier").select(k.alias("s"), place.alias("p")).select("s", (F.floor(F.col("s") / 20).cast("long") * 20 + F.col("p")).alias("d"))
    return graph.bounded_tree(edges, edges, "s", "d", depth=4)


@query()
def obtain_tree_full(spark: SparkSession, at: str) -> DataFrame:
    """To the depth of the reference; tests hold it against brute force."""
    edges = _nation_edges(spark, at)
    return graph.bounded_tree(edges, edges, "s", "d", depth=4)


def _nation_edges(spark: SparkSession, at: str) -> DataFrame:
    l, o, c, s = (table(spark, at, t) for t in ("lineitem", "orders", "customer", "supplier"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("s"), F.col("s_nationkey").alias("d")).distinct()


# ---- search

ALIAS_SQL = f"""(with f as (select p_partkey as id, lower({NAME_SQL}) as name, regexp_split_to_array(lower({NAME_SQL}), '[ _/#]+') p from part),
 g as (select id, name, array_to_string(p, ' ') alias, 3 as strength from f union all select id, name, array_to_string(p, '_'), 3 from f union all select id, name, unnest(p), 1 from f)
 select id, alias, max(strength) as strength from g where alias <> '' and alias <> name group by 1, 2)"""
ASK = ("brand#2", "red", "ring 1", "blue_box_4", "small", "nothing like it")
ASK_SQL = "(values " + ", ".join(f"('{a}')" for a in ASK) + ") q(query)"


def _entities(spark: SparkSession, at: str) -> DataFrame:
    return spread(table(spark, at, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), part_name().alias("name"))


def _asks(spark: SparkSession, words: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "query string")


@query(f"select id, alias, strength from {ALIAS_SQL}")
def aliases(spark: SparkSession, at: str) -> DataFrame:
    return search.aliases(_entities(spark, at))


@query(f"""with e as (select p_partkey as id, {NAME_SQL} as name from part), t as (select id, lower(name) txt, 9 as strength from e union all select id, alias, strength from {ALIAS_SQL}),
 h as (select query, id, case when txt = query then 0 when starts_with(txt, query) then 1 else 2 end tier, strength from t, {ASK_SQL} where contains(txt, query)),
 b as (select query, id, tier, strength from h qualify row_number() over (partition by query, id order by tier, strength desc) = 1)
 select query, b.id, tier, strength, row_number() over (partition by query order by tier, strength desc, length(name), b.id) as rank from b join e using (id) qualify rank <= 10""")
def search_rank(spark: SparkSession, at: str) -> DataFrame:
    e = _entities(spark, at)
    return search.ranked(_asks(spark, ASK), e, search.aliases(e))


KINDS_SQL = """(select p_partkey k, case p_size % 5 when 0 then 'effect' when 1 then 'item' when 2 then 'enchantment' when 3 then 'profession' else 'mob' end kind, lower(replace(p_name, ' ', '_')) || '_' || p_size as p, p_size s from part)"""


@query(f"""with e as (select 'ns:' || case kind when 'item' then 'potion/' when 'mob' then 'entity_type/' else '' end || p || k id, kind, case kind when 'item' then 'potion/' when 'mob' then 'entity_type/' else '' end || p || k as path, p || k bare, replace(p || k, '_', ' ') as spaced, s, k from {KINDS_SQL}),
 g as (select id, spaced, path alias, 4 as strength from e union all select id, spaced, replace(path, '_', ' '), 4 from e union all select id, spaced, unnest(regexp_split_to_array(path, '[_/]')), 1 from e
  union all select id, spaced, unnest([bare, spaced]), 4 from e where kind = 'mob' union all select id, spaced, 'potion of ' || spaced, 2 from e where kind = 'effect' union all select id, spaced, unnest(['potion of ' || spaced, spaced || ' potion']), 4 from e where kind = 'item'
  union all select id, spaced, path || ' ' || unnest(['1', 'i', '2', 'ii', '3', 'iii', '4', 'iv', '5', 'v']), 1 from e where kind = 'enchantment' union all select id, spaced, unnest(['villager ' || spaced, spaced || ' villager']), 4 from e where kind = 'profession'
  union all select id, spaced, unnest(['the stand villager', 'villager the stand']), 2 from e where kind = 'profession' and k % 2 = 0 union all select id, spaced, 'short ' || s, 3 from e where s < 20)
 select id, alias, max(strength) as strength from g where alias <> '' and alias <> spaced group by 1, 2""")
def kind_aliases(spark: SparkSession, at: str) -> DataFrame:
    """Aliases by kind: levels, cross-links, potions, professions and their workstations, curated ones."""
    size = F.col("p_size")
    kind = F.when(size % 5 == 0, "effect").when(size % 5 == 1, "item").when(size % 5 == 2, "enchantment").when(size % 5 == 3, "profession").otherwise("mob")
    bare = F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_"), size.cast("string"), F.col("p_partkey").cast("string"))
    e = spread(table(spark, at, "part"), "p_partkey").withColumns({"kind": kind, "bare": bare})
    e = e.withColumn("id", F.concat(F.lit("ns:"), F.when(F.col("kind") == "item", "potion/").when(F.col("kind") == "mob", "entity_type/").otherwise(""), "bare"))
    station = F.when(F.col("p_partkey") % 2 == 0, "ns:The_stand").otherwise("ns:")
    entities = e.select("id", "kind", F.initcap(F.replace("bare", F.lit("_"), F.lit(" "))).alias("name"), station.alias("workstation"))
    curated = e.where(size < 20).select("id", F.concat(F.lit(" Short "), size.cast("string")).alias("alias"))
    return search.kind_aliases(entities, curated)


TYPOS = ("rde widget", "smal", "brnad", "bix", "blue rng")
TYPO_SQL = "(values " + ", ".join(f"('{a}')" for a in TYPOS) + ") q(query)"


@query(f"""with w as (select distinct p_partkey as id, unnest(regexp_split_to_array(lower({NAME_SQL}), '[ _/#]+')) word from part), t as (select distinct query, unnest(string_split(query, ' ')) term from {TYPO_SQL}),
 p as (select term, word from (select distinct word from w where word <> ''), (select distinct term from t) where damerau_levenshtein(term, word) <= 1)
 select t.query, w.id from t join p using (term) join w using (word) group by t.query, w.id having count(distinct term) = (select count(*) from t u where u.query = t.query)""")
def search_fuzzy(spark: SparkSession, at: str) -> DataFrame:
    return search.fuzzy(_asks(spark, TYPOS), _entities(spark, at))


KIND_SQL = "case p_type when 'PROMO' then 'mob' when 'STANDARD' then 'item' when 'ECONOMY' then 'block' when 'SMALL' then 'entity' else 'structure' end"
SEARCHES = ("brand#2 red ring 1", "red", "ring 1", "brand", "rde rign", "brand_2_small_box_7")
SEARCHES_SQL = "(values " + ", ".join(f"('{a}')" for a in SEARCHES) + ") q(query)"


@query(f"""with e as (select p_partkey as id, {NAME_SQL} as name, {KIND_SQL} kind from part), t as (select id, lower(name) txt, true is_name, false is_phrase from e union all select id, alias, false, strength = 3 from {ALIAS_SQL}),
 h as (select query, id, case when txt = query then 0 when starts_with(txt, query) then 1 else 2 end tier, is_name, is_phrase from t, {SEARCHES_SQL} where contains(txt, query)),
 b as (select * from h where not is_name or tier < 2 qualify row_number() over (partition by query, id order by tier, is_name desc, is_phrase desc) = 1),
 w as (select distinct id, unnest(regexp_split_to_array(lower(name), '[ _/#]+')) word from e), u as (select distinct query, unnest(string_split(query, ' ')) term from {SEARCHES_SQL}),
 p as (select term, word from (select distinct word from w where word <> ''), (select distinct term from u) where damerau_levenshtein(term, word) <= 1),
 f as (select u.query, w.id from u join p using (term) join w using (word) group by u.query, w.id having count(distinct term) = (select count(*) from u v where v.query = u.query)),
 o as (select * from b union all select query, id, 3, true, false from f where (query, id) not in (select query, id from b))
 select query, o.id, tier, is_name, is_phrase, row_number() over (partition by query order by tier, not (tier = 0 and kind = 'item' and (is_name or is_phrase)), not is_name, not is_phrase, case kind when 'mob' then 0 when 'item' then 1 when 'block' then 2 when 'structure' then 7 else 10 end, length(name), o.id) as rank from o join e using (id) qualify rank <= 10""")
def search_web(spark: SparkSession, at: str) -> DataFrame:
    kind = F.when(F.col("p_type") == "PROMO", "mob").when(F.col("p_type") == "STANDARD", "item").when(F.col("p_type") == "ECONOMY", "block").when(F.col("p_type") == "SMALL", "entity").otherwise("structure")
    e = spread(table(spark, at, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), part_name().alias("name"), kind.alias("kind"))
    return search.searched(_asks(spark, SEARCHES), e, search.aliases(e))


@query(f"""with a as {ALIAS_SQL}, t as (select query, id, min((case when alias = query then 0 when starts_with(alias, query) then 1 else 2 end, -strength)) m from a, {ASK_SQL} where contains(alias, query) or contains(query, alias) group by 1, 2),
 w as (select distinct query, unnest(regexp_split_to_array(query, '[ _]+')) word from {ASK_SQL}), s as (select query, id, max(strength) as strength from a join w on contains(alias, word) group by 1, 2 having count(distinct word) = (select count(*) from w v where v.query = w.query))
 select query, id, m[1] tier, -m[2] as strength from t union all select query, id, 3, strength from s where (query, id) not in (select query, id from t)""")
def search_candidates(spark: SparkSession, at: str) -> DataFrame:
    return search.candidates_of(_asks(spark, ASK), search.aliases(_entities(spark, at)))


# ---- collections

SPECS = {
    "promo": {"rule": {"kind": "PROMO"}},
    "chosen": {"rule": {"list": [1, 2, 3, 5, 8]}, "sort": "id"},
    "tagged": {"rule": {"tag": "Brand#2"}},
    "component": {"rule": {"component": "large"}, "sort": "id"},
    "section": {"rule": {"section": "R"}},
    "method": {"rule": {"method": 1}},
}


@query("""with e as (select p_partkey as id, p_type kind, p_name as name from part), m as (select 'promo' collection, id from e where kind = 'PROMO' union all select 'chosen', id from e where id in (1, 2, 3, 5, 8)
 union all select 'tagged', p_partkey from part where p_brand = 'Brand#2' union all select 'component', p_partkey from part where p_size > 40
 union all select 'section', id from e where id in (select l_partkey from lineitem where l_returnflag = 'R') union all select 'method', id from e where id in (select l_partkey from lineitem where l_linenumber = 1))
 select collection, id, name, case when collection in ('chosen', 'component') then cast(id as varchar) else lower(name) end sort_key from m join e using (id)""")
def collection_members(spark: SparkSession, at: str) -> DataFrame:
    part, lines = table(spark, at, "part"), table(spark, at, "lineitem")
    entities = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"))
    facts = {
        "tag": part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("value")),
        "component": part.where("p_size > 40").select(F.col("p_partkey").alias("id"), F.lit("large").alias("value")),
        "section": lines.select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("value")),
        "method": lines.select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("value")),
    }
    return collections.resolve(SPECS, entities, facts)


@query("""with m as (select 'asia' collection, c_custkey as id, lower(c_name) sort_key from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2 union all select 'some', c_custkey, lower(c_name) from customer where c_custkey in (1, 2, 3))
 select collection, count(*) n_members, min(id) first_id, arg_min(id, (sort_key, id)) first_member, case collection when 'asia' then 'east,far' else '' end aliases from m group by 1""")
def collection_entities(spark: SparkSession, at: str) -> DataFrame:
    """Manifests whose tags are closures: a region's customers by way of its nations."""
    specs = collections.manifests(['{"id": "asia", "rule": {"tag": "r2"}, "aliases": ["east", "far"]}', '{"id": "some", "rule": {"list": [1, 2, 3]}}'])
    entities = table(spark, at, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"))
    closed = graph.closure(_tags(spark, at), "s", "d", acyclic=True).where(F.startswith("d", F.lit("c")))
    tags = closed.select(F.substring("d", 2, 20).cast(entities.schema["id"].dataType).alias("id"), F.col("s").alias("value"))
    made = collections.entities_of(specs, entities, {"tag": tags})
    return made.select("collection", "n_members", F.array_min("members").alias("first_id"), F.get("members", F.lit(0)).alias("first_member"), F.array_join("aliases", ",").alias("aliases"))


# ---- gate

SNAP = "(select 'total' metric, count(*) as value from {t} union all select 'field:lang', count(lang) from {t} union all select 'field:source', count(source) from {t} union all select 'field:text', count(text) from {t} union all select 'kind:' || coalesce(lang, 'none'), count(*) from {t} group by lang)"
FIRST_SQL = "(select * from documents qualify row_number() over (partition by text order by doc_id) = 1)"


def _first_texts(docs: DataFrame) -> DataFrame:
    """The first document of each text; of the text itself only whether there is one."""
    return rows.first_of_text(docs.withColumn("has_text", F.col("text").isNotNull()), "text", ["doc_id"]).withColumn("text", F.when(F.col("has_text"), F.lit("")))


def _snapshots(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, at, "documents").select("doc_id", "text", "lang", "source")
    return gate.snapshot(docs, "lang", ["lang", "source", "text"]), gate.snapshot(_first_texts(docs), "lang", ["lang", "source", "text"])


@query(f"select metric, value from {SNAP.format(t='documents')}")
def snapshot(spark: SparkSession, at: str) -> DataFrame:
    return _snapshots(spark, at)[0]


@query(f"""select b.metric, b.value before, coalesce(n.value, 0) after, greatest(b.value - coalesce(n.value, 0), 0) dropped,
 case when b.value > 0 and coalesce(n.value, 0) = 0 then 'vanished' when 100 * (b.value - coalesce(n.value, 0)) > 5 * b.value and b.value - coalesce(n.value, 0) >= 3 then 'dropped' else 'pass' end verdict
 from {SNAP.format(t='documents')} b left join {SNAP.format(t=FIRST_SQL)} n on n.metric = b.metric""")
def regression_gate(spark: SparkSession, at: str) -> DataFrame:
    return gate.regression(*_snapshots(spark, at))


@query(f"""with b as (select doc_id, lang from documents where n_chars > 300), a as (select doc_id, lang from {FIRST_SQL}),
 r as (select coalesce(b.lang, a.lang, 'none') kind, (b.doc_id is not null)::int b, (a.doc_id is not null)::int a from b full join a on a.doc_id = b.doc_id)
 select coalesce(kind, '(total)') kind, sum(b)::bigint before, sum(a)::bigint after, (sum(a) - sum(b))::bigint net, sum(a * (1 - b))::bigint added, sum(b * (1 - a))::bigint removed from r group by rollup (kind)""")
def diff(spark: SparkSession, at: str) -> DataFrame:
    docs = table(spark, at, "documents").select("doc_id", "text", "lang", "n_chars")
    return gate.diff(docs.where("n_chars > 300"), _first_texts(docs), "doc_id", "lang")


@query(f"select case when r is null then 'kept' when r = 'other language' then 'expected' when r = 'short' then 'expected' else 'failure' end as \"group\", count(*) n from (select {REASONS} r from documents) group by 1")
def reject_groups(spark: SparkSession, at: str) -> DataFrame:
    r = F.col("reject_reason")
    return gate.references(classify_split(spark, at), "reject_reason", [("kept", r.isNull()), ("expected", r.isin("other language", "short"))])


@query("select 'size' as \"check\", count(*) filter (where not coalesce(p_size between 1 and 45, false)) n_failed from part union all select 'price', count(*) filter (where not coalesce(p_retailprice > 0, false)) from part union all select 'brand', count(*) filter (where not coalesce(p_brand like 'Brand#%', false)) from part")
def conformance(spark: SparkSession, at: str) -> DataFrame:
    return gate.constraints(table(spark, at, "part"), [("size", F.col("p_size").between(1, 45)), ("price", F.col("p_retailprice") > 0), ("brand", F.col("p_brand").like("Brand#%"))])
