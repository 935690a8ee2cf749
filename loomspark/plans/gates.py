"""Gate, reports, index and sources, bound to the driver's tables with SQL beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, emit, gate
from ..sources import tables as sources
from ..sources.tables import table
from ..session import run_dir, spread
from .registry import query

# ---- gate

SNAPSHOT_SQL = """(select 'total' family, 'total' as name, count(*) as value from {t} union all select 'icons', 'icons', count(source) from {t} union all select 'required', 'doc_id', count(doc_id) from {t} union all select 'required', 'lang', count(lang) from {t}
 union all select 'optional', 'source', count(source) from {t} union all select 'optional', 'text', count(text) from {t} union all select 'kind', coalesce(lang, 'none'), count(*) from {t} group by lang
 union all select 'section', x, count(*) from (select unnest(case when n_chars > 5000 then ['any', 'long'] else ['any'] end) x from {t}) group by x union all select 'producers', 'producers', count(*) from {p})"""
AFTER_SQL = "(select * from documents where doc_id % 3 <> 0 and n_chars <= 5000)"


def _build(docs: DataFrame, producers: DataFrame) -> DataFrame:
    types = F.when(F.col("n_chars") > 5000, F.array(F.lit("any"), F.lit("long"))).otherwise(F.array(F.lit("any")))
    return gate.build_snapshot(docs.withColumn("types", types), "lang", ["doc_id", "lang"], ["source", "text"], "types", producers, "source")


@query(f"select * from {SNAPSHOT_SQL.format(t='documents', p='labels')}")
def build_snapshot(spark: SparkSession, at: str) -> DataFrame:
    return _build(table(spark, at, "documents"), table(spark, at, "labels"))


@query(f"""with b as {SNAPSHOT_SQL.format(t='documents', p='labels')}, a as {SNAPSHOT_SQL.format(t=AFTER_SQL, p='(select * from labels where doc_id % 40 <> 0)')},
 j as (select b.family, b.name, b.value before, coalesce(a.value, 0) after, (select value from b where family = 'total') tb, (select value from a where family = 'total') ta from b left join a on a.family = b.family and a.name = b.name)
 select family, name, before, after, case when family in ('kind', 'section') and before > 0 and after = 0 then 'vanished' when family = 'kind' and 100 * (before - after) > 5 * before and before - after >= 3 then 'dropped'
 when family in ('total', 'producers', 'icons') and 100 * (before - after) > 5 * before then 'dropped' when family = 'required' and (ta = 0 or after < ta) then 'incomplete'
 when family = 'optional' and 100.0 * before / tb - 100.0 * after / ta > 5.0 then 'less covered' else 'pass' end verdict from j""")
def gate_checks(spark: SparkSession, at: str) -> DataFrame:
    docs, labels = table(spark, at, "documents"), table(spark, at, "labels")
    return gate.gate_checks(_build(docs, labels), _build(docs.where("doc_id % 3 <> 0 and n_chars <= 5000"), labels.where("doc_id % 40 <> 0")))


CHECKS_SQL = "(select cast(p_partkey as varchar) as key, unnest(list_filter([case when not coalesce(p_size between 1 and 45, false) then '/size' end, case when not coalesce(p_retailprice > 0, false) then '/price' end, case when not coalesce(p_brand like 'Brand#_', false) then '/brand/0' end], lambda x: x is not null)) pointer from part)"


def _conformance(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    checks = [("/size", F.col("p_size").between(1, 45)), ("/price", F.col("p_retailprice") > 0), ("/brand/0", F.col("p_brand").like("Brand#_"))]
    return gate.failures(table(spark, at, "part"), "part", "p_partkey", checks)


@query(f"select 'part' document, key, pointer from {CHECKS_SQL} order by key, pointer limit 20")
def conformance_failures(spark: SparkSession, at: str) -> DataFrame:
    """The first failures, as a report names them."""
    return _conformance(spark, at)[0]


@query(f"select greatest(count(*) - 20, 0) truncated from {CHECKS_SQL}")
def conformance_truncated(spark: SparkSession, at: str) -> DataFrame:
    return _conformance(spark, at)[1]


@query("""with b as (select doc_id, source from documents where n_chars > 300), a as (select doc_id, source from documents where doc_id % 2 = 0),
 r as (select 'added' change, doc_id, source from a where doc_id not in (select doc_id from b) union all select 'removed', doc_id, source from b where doc_id not in (select doc_id from a)),
 n as (select *, row_number() over (partition by change order by doc_id) place, count(*) over (partition by change) total from r)
 select change, place, coalesce(source, '?') || ' (' || doc_id || ')' as line from n where place <= 50 union all select distinct change, 51, '... and ' || (total - 50) || ' more' from n where total > 50""")
def change_lists(spark: SparkSession, at: str) -> DataFrame:
    docs = table(spark, at, "documents").select("doc_id", "source", "n_chars")
    return gate.change_lists(docs.where("n_chars > 300"), docs.where("doc_id % 2 = 0"), "doc_id", "source")


# ---- sinks


@query("select p_partkey, '{\"p_name\":\"' || p_name || '\",\"p_partkey\":' || p_partkey || case when p_size > 40 then '' else ',\"size\":' || p_size end || '}' as row from part")
def search_index(spark: SparkSession, at: str) -> DataFrame:
    part = table(spark, at, "part").withColumn("size", F.when(F.col("p_size") <= 40, F.col("p_size")))
    return emit.search_index(part, "p_partkey", ["p_name", "size"])


@query("select s_suppkey source, case when s_suppkey % 5 = 0 then 'curated' when s_suppkey % 2 = 0 then 'loot' else 'chest' end family from supplier")
def merged_sources(spark: SparkSession, at: str) -> DataFrame:
    s = table(spark, at, "supplier").select(F.col("s_suppkey").alias("source"))
    layer = lambda df, name: df.withColumn("family", F.lit(name))
    return emit.merged_sources([layer(s, "chest"), layer(s.where("source % 2 = 0"), "loot"), layer(s.where("source % 5 = 0"), "curated")])


@query("select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 place, l_partkey, l_quantity from lineitem")
def graph_round_trip(spark: SparkSession, at: str) -> DataFrame:
    """Producers to a graph by output and back."""
    lines = table(spark, at, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("seq"), "l_partkey", "l_quantity")
    return emit.from_graph(emit.as_graph(lines, "l_orderkey", "seq"), "l_orderkey", "l_partkey bigint, l_quantity double")


@query("select 1 schema_version, '26' as version, 'abc' as ref, '2026-01-01T00:00:00Z' built_at, count(*) n_rows from documents")
def build_manifest(spark: SparkSession, at: str) -> DataFrame:
    counts = table(spark, at, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return emit.manifest(spark, "26", "abc", "2026-01-01T00:00:00Z", counts)


@query("select p_brand icon, case when p_brand like '%1' then null else p_brand || '.png' end title, count(*) uses from part where p_size > 3 group by 1")
def icon_titles(spark: SparkSession, at: str) -> DataFrame:
    part = table(spark, at, "part").select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_brand")).alias("icon"))
    files = part.where("icon is not null and icon not like '%1'").select("icon", F.concat("icon", F.lit(".png")).alias("title")).distinct()
    known, unknown = emit.icon_titles(part, files, "p_partkey", "icon")
    return known.unionByName(unknown.select("icon", F.lit(None).cast("string").alias("title"), "uses"))


# ---- sources


@query("select n_regionkey source, row_number() over (partition by n_regionkey order by n_nationkey) - 1 place, n_name as name, case when n_nationkey % 2 = 0 then n_nationkey end as id from nation")
def answer_rows(spark: SparkSession, at: str) -> DataFrame:
    """Rows of answers, one document a region; a field that is null is left out there."""
    row = F.struct(F.col("n_nationkey").alias("at"), F.struct(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("id")).alias("row"))
    answers = table(spark, at, "nation").groupBy(F.col("n_regionkey").alias("source")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"]).alias("rows"))).alias("payload"))
    return sources.answer_rows(answers, "name string, id int")


ASKED_SQL = "(select 'k' || n_nationkey title, 'k' || case when n_nationkey % 5 = 0 then n_nationkey + 2 when n_nationkey % 5 = 1 then n_nationkey + 1 else n_nationkey end final, n_nationkey from nation)"


def _pages(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = table(spark, at, "nation")
    name = lambda c: F.concat(F.lit("k"), c.cast("string"))
    rewrites = n.where(F.col("n_nationkey") % 5 < 2).select(name(F.col("n_nationkey")).alias("from"), name(F.col("n_nationkey") + 1).alias("to"))
    return n.select(name(F.col("n_nationkey")).alias("title")), rewrites, n.where("n_nationkey % 5 = 2 or n_nationkey % 2 = 0").select(name(F.col("n_nationkey")).alias("title"), F.col("n_name").alias("extract"))


@query(f"select a.title, a.final, n_name extract from {ASKED_SQL} a join nation n on a.final = 'k' || n.n_nationkey where n.n_nationkey % 5 = 2 or n.n_nationkey % 2 = 0")
def page_extracts(spark: SparkSession, at: str) -> DataFrame:
    return sources.joined_back(*_pages(spark, at))[0].select("title", "final", "extract")


@query(f"select a.title, 'no such page' reason from {ASKED_SQL} a join nation n on a.final = 'k' || n.n_nationkey where not (n.n_nationkey % 5 = 2 or n.n_nationkey % 2 = 0)")
def page_misses(spark: SparkSession, at: str) -> DataFrame:
    return sources.joined_back(*_pages(spark, at))[1]


RELEASES = '{"latest": {"release": "26.2"}, "versions": [{"id": "26.3-pre", "type": "snapshot"}, {"id": "26.2", "type": "release"}, {"id": "26.1", "type": "release"}]}'


def _releases(spark: SparkSession) -> DataFrame:
    return sources.release_order(spark.createDataFrame([(RELEASES,)], "doc string"))


RELEASES_SQL = "(select 'v' || s_suppkey as version, case when s_suppkey % 3 = 0 then 'snapshot' else 'release' end kind, row_number() over (order by s_suppkey desc) - 1 as position from supplier)"


def _listed(spark: SparkSession, at: str) -> DataFrame:
    """The list document of all suppliers as versions, newest first; two of three are releases."""
    k = F.col("s_suppkey")
    one = F.struct((-k).alias("o"), F.struct(F.concat(F.lit("v"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "snapshot").otherwise("release").alias("type")).alias("v"))
    latest = F.struct(F.concat(F.lit("v"), F.max(F.when(k % 3 != 0, k)).cast("string")).alias("release"))
    doc = F.to_json(F.struct(latest.alias("latest"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["v"]).alias("versions")))
    return sources.release_order(table(spark, at, "supplier").agg(doc.alias("doc")))


@query(f"select version, kind, position from {RELEASES_SQL}")
def release_order(spark: SparkSession, at: str) -> DataFrame:
    return _listed(spark, at)


@query("select n_name, case n_nationkey % 3 when 0 then '26.2' when 1 then '26.1' else '1.0' end verified_for, n_nationkey % 3 <> 0 stale from nation")
def stale_curated(spark: SparkSession, at: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    rows = table(spark, at, "nation").select("n_name", F.when(k == 0, "26.2").when(k == 1, "26.1").otherwise("1.0").alias("verified_for"))
    return sources.stale(rows, _releases(spark).where("kind = 'release'"), "26.2").select("n_name", "verified_for", "stale")


@query(f"""with r as (select * from {RELEASES_SQL} where kind = 'release'), c as (select 'v' || c_custkey % 120 as version from customer)
 select c.version, (select version from r order by position limit 1) as current, position > (select min(position) from r) as owed from c left join r on r.version = c.version""")
def rebuild_owed(spark: SparkSession, at: str) -> DataFrame:
    """Builds of customers; some are of versions that the list of releases does not have."""
    built = table(spark, at, "customer").select(F.concat(F.lit("v"), (F.col("c_custkey") % 120).cast("string")).alias("version"))
    return gate.rebuild_owed(built, _listed(spark, at).where("kind = 'release'"))


@query("select x reference, string_agg(s_suppkey, ',' order by s_suppkey) sources from (select distinct s_suppkey, unnest(['r' || s_nationkey, 'all' || s_suppkey % 2]) x from supplier) group by 1")
def curated_by_reference(spark: SparkSession, at: str) -> DataFrame:
    refs = F.array(F.concat(F.lit("r"), F.col("s_nationkey").cast("string")), F.concat(F.lit("all"), (F.col("s_suppkey") % 2).cast("string")))
    made = sources.by_reference(table(spark, at, "supplier").select("s_suppkey", refs.alias("refs")), "s_suppkey", "refs")
    return made.select("reference", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("select doc_id as name, case when doc_id % 7 = 0 then 'absent' else 'corrupt' end reason from documents where text is not null and (doc_id % 7 = 0 or doc_id % 11 = 0)")
def cache_misses(spark: SparkSession, at: str) -> DataFrame:
    """Objects by their digest: some were never stored, others were harmed."""
    docs = table(spark, at, "documents").where("text is not null")
    unique = F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text").cast("binary")
    rows = docs.select(F.col("doc_id").alias("name"), F.sha2(unique, 256).alias("sha256"), unique.alias("content"))
    stored = rows.where("name % 7 <> 0").select("sha256", F.when(F.col("name") % 11 == 0, F.lit(b"harmed")).otherwise(F.col("content")).alias("content"))
    return sources.checked_objects(rows.select("name", "sha256"), stored)[1].select("name", "reason")


@query("select p_partkey as name, case p_partkey % 4 when 1 then 'signature' when 2 then 'size' else 'digest' end reason from part where p_partkey % 4 > 0")
def image_failures(spark: SparkSession, at: str) -> DataFrame:
    good = F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), F.col("p_name").cast("binary"))
    k = F.col("p_partkey") % 4
    files = table(spark, at, "part").select(F.col("p_partkey").alias("name"), F.when(k == 1, F.col("p_name").cast("binary")).otherwise(good).alias("content"), (F.octet_length(good) + F.when(k == 2, 1).otherwise(0)).alias("size"), F.when(k == 3, "0").otherwise(F.sha1(good)).alias("sha1"))
    return sources.image_failures(files, b"\x89PNG\r\n\x1a\n")


@query("""with e as (select 'p' || p_partkey id, p_name as name, 'k' || p_size % 3 kind, case when p_size % 3 = 2 then 'k9' else 'k' || p_size % 3 end later, p_partkey k from part),
 a as (select distinct kind || '-' || (row_number() over (partition by kind order by id) - 1) // 200 as shard, kind from e), b as (select id, name, later, later || '-' || (row_number() over (partition by later order by id) - 1) // 200 as shard from e)
 select 'shard' as part, shard as name, count(*) n_rows, sum(strlen('{"id":"' || id || '","kind":"' || later || '","name":"' || name || '"}') + 1)::bigint n_bytes from b group by shard
 union all select 'removed', kind || '-' || (n - 1) // 200, count(*), 0 from (select kind, row_number() over (partition by kind order by id) n from e) where kind = 'k2' group by 2
 union all select 'index', 'index', count(*), sum(strlen('{"id":"' || id || '","name":"' || name || '"}') + 1)::bigint from e
 union all select 'graph', 'graph', count(distinct l_partkey), null from lineitem union all select 'manifest', 'manifest', 1, null""")
def emitted_build(spark: SparkSession, at: str) -> DataFrame:
    """The report of the second of two builds: all parts, of which one kind has another name."""
    folder = f"{run_dir(spark)}/build-{uuid.uuid4().hex}"
    part, size = table(spark, at, "part"), F.col("p_size") % 3
    kind = F.concat(F.lit("k"), size.cast("string"))
    producers = table(spark, at, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("output"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("seq"), F.col("l_returnflag").alias("method"))
    producers = spread(producers, "output").distinct()  # both steps on them go by output
    for k in (kind, F.when(size == 2, "k9").otherwise(kind)):
        entities = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), k.alias("kind"), F.col("p_name").alias("name"))
        report = build.emit_build(entities, producers, folder, "1", "id", "kind", ["id"], ["name"], "output", "seq")
    return report.withColumn("n_bytes", F.when(~F.col("part").isin("graph", "manifest"), F.col("n_bytes")))
