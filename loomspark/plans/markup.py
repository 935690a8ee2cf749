"""Wiki text and display texts: marked-up texts are made of the part table, the SQL says what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text
from ..session import spread
from ..sources.tables import table
from .registry import query


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _wiki() -> Column:
    return _text("<!-- gone -->'''", F.col("p_name"), "''' is  [[", F.col("p_brand"), "|the brand]] of [[", F.col("p_brand"), "]]\n<small>(", F.col("p_size"), ")</small><ref name='x'>no <b>note</b></ref><ref name=y /> 5<sup>[<i>until</i>]</sup> &amp; ​more {{ItemLink|Bow}}[[File:a.png|16px|[[b]]]][[Category:Items]]: ''so''")


@query("select p_partkey, p_name || ' is the brand of ' || p_brand || ' (' || p_size || ') 5 & more {{ItemLink|Bow}}: so' text, p_name || ' is [[' || p_brand || '|the brand]] of [[' || p_brand || ']] (' || p_size || ') 5 & more {{ItemLink|Bow}}: so' linked from part")
def strip_markup(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "part").select("p_partkey", text.strip_markup(_wiki()).alias("text"), text.strip_markup(_wiki(), keep_links=True).alias("linked"))


@query("select p_partkey, p_name || ', in all: ' || p_brand || ', size ' || p_size || case when p_size % 2 = 0 then '. And the end' else ' and the end' end as text from part")
def flatten_lists(spark: SparkSession, at: str) -> DataFrame:
    end = F.when(F.col("p_size") % 2 == 0, "And the end").otherwise("and the end")
    return table(spark, at, "part").select("p_partkey", text.flattened(_text(F.col("p_name"), ", in all:\n* [[", F.col("p_brand"), "]]\n* size ", F.col("p_size"), "<br>", end)).alias("text"))


@query("select p_partkey, unnest(range(0, 3)) place, unnest([split_part(p_brand, '#', 1), 'File:x.png', p_name]) target from part")
def wiki_links(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "part").select("p_partkey", F.posexplode(text.wiki_links(_text("a [[", F.col("p_brand"), "|b]] [[File:x.png]] and [[ ", F.col("p_name"), "#part]]"))).alias("place", "target"))


@query("select p_partkey, unnest(range(0, 3)) place, unnest([p_name, p_brand, 'of ' || p_size]) line from part")
def display_lines(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "part").select("p_partkey", F.posexplode(text.display_lines(_text(F.col("p_name"), "<br/>\n\n* ", F.col("p_brand"), "\n:# of ", F.col("p_size"), "<BR>"))).alias("place", "line"))


@query("""select p_partkey, unnest(['Item', 'in']) as name, unnest(['[[a|' || p_name || ']];{{in|x}} y', 'be']) args, unnest([cast(p_size as varchar), null]) size, unnest(['', 'k=v']) rest from part""")
def template_fields(spark: SparkSession, at: str) -> DataFrame:
    """Top-level templates around each part's fields, with nested ones and links inside."""
    wiki = _text("text {{Item|[[a|", F.col("p_name"), "]]|size = ", F.col("p_size"), "|{{in|x}} y}} end {{in|be|k=v}} {{open|")
    made = spread(table(spark, at, "part"), "p_partkey").select("p_partkey", F.explode(markup.find_templates(wiki)).alias("t"))
    rest = F.array_join(F.transform(F.filter(F.map_entries("t.named"), lambda e: e["key"] != "size"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return made.select("p_partkey", "t.name", F.array_join("t.args", ";").alias("args"), F.try_element_at("t.named", F.lit("size")).alias("size"), rest.alias("rest"))


@query("""with c as (select p_partkey, unnest([{'row': 0, 'col': 0, 'text': 'Head', 'header': true}, {'row': 0, 'col': 1, 'text': 'Head', 'header': true}, {'row': 1, 'col': 0, 'text': p_name, 'header': false}, {'row': 1, 'col': 1, 'text': p_brand, 'header': false}, {'row': 2, 'col': 0, 'text': p_name, 'header': false}, {'row': 2, 'col': 1, 'text': '[[x|' || p_size || ']]', 'header': false}]) c from part)
 select p_partkey, c.row as row, c.col as col, c.text as text, c.header as header from c""")
def wiki_table(spark: SparkSession, at: str) -> DataFrame:
    """A table with a cell over two columns and one over two rows; it must be whole."""
    wiki = _text('before {| class="x"\n! colspan="2" | Head\n|-\n| rowspan=2 | ', F.col("p_name"), "\n| ", F.col("p_brand"), "\n|-\n| [[x|", F.col("p_size"), "]]\n|} after")
    return spread(table(spark, at, "part"), "p_partkey").select("p_partkey", F.inline(markup.table_cells(wiki, strict=True)))


@query("select p_partkey, case p_size % 4 when 0 then 'first' when 1 then 'second' when 2 then 'second' end edition, p_name || ':' || case p_size % 4 when 3 then ' {{hp|5}}' else '' end as line, case when p_size % 4 = 3 then null else p_name || ':' end heading from part")
def edition_markers(spark: SparkSession, at: str) -> DataFrame:
    mark = F.when(F.col("p_size") % 4 == 0, "{{only|java|short=1}}").when(F.col("p_size") % 4 == 1, "{{BE}}").when(F.col("p_size") % 4 == 2, "{{in|x|Education}}").otherwise(" {{hp|5}}")
    line = F.concat(F.col("p_name"), F.lit(":"), mark)
    return table(spark, at, "part").select("p_partkey", text.inline_edition(line).alias("edition"), text.strip_editions(line).alias("line"), text.heading_core(line).alias("heading"))


@query("select p_partkey, p_name as item, case when p_size % 3 > 0 then p_size else 1 end as count, case when p_size % 3 = 2 then 'by ' || p_brand end note from part")
def parse_output(spark: SparkSession, at: str) -> DataFrame:
    said = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, _text(" ", F.col("p_name"), " ,", F.col("p_size"))).otherwise(_text(F.col("p_name"), ", ", F.col("p_size"), "[by ", F.col("p_brand"), "] "))
    return table(spark, at, "part").select("p_partkey", text.parse_output(said).alias("o")).select("p_partkey", "o.item", "o.count", "o.note")


@query("""select p_partkey, replace(p_name, ' ', '-') || '-' || p_size sprite, 'https://x/w/' || replace(p_name, ' ', '_') url, case when p_size % 2 = 0 then p_size / 2 || '' else p_size / 2 || '' end ignored,
 case when p_size % 5 = 0 then null else '"' || p_name || '" & <' || p_size || '>' end clean from part""".replace("case when p_size % 2 = 0 then p_size / 2 || '' else p_size / 2 || '' end ignored,", ""))
def small_texts(spark: SparkSession, at: str) -> DataFrame:
    """Sprite ids, page addresses, cleaned texts (numbered references too)."""
    raw = F.when(F.col("p_size") % 5 == 0, " — ").otherwise(_text("  &quot;", F.col("p_name"), "&#34; &amp; &lt;", F.col("p_size"), "&gt; "))
    return table(spark, at, "part").select("p_partkey", text.sprite_id(_text("ns:", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), "_", F.col("p_size"))).alias("sprite"), text.wiki_url("https://x/w/", F.col("p_name")).alias("url"), text.clean_text(markup.unescape_all(raw)).alias("clean"))


@query("""select p_partkey, case when p_size % 4 = 0 then '' || p_size // 4 when p_size % 2 = 0 then p_size // 4 || '.5' else p_size // 4 || case p_size % 4 when 1 then '.25' else '.75' end end number,
 case when p_size = 50 then '2' when p_size * 4 % 100 = 0 then '' || p_size * 4 // 100 else '' || rtrim(printf('%.2f', p_size * 0.04), '0') end seconds_,
 case when p_size % 3 = 0 then '' || p_size else p_size || '-' || (p_size + 2) end as range_,
 case when p_size >= 40 then null when p_size < 1 then '<0.1%' when p_size < 4 then printf('%.1f', p_size * 2.5) || '%' else cast(floor(p_size / 40.0::double * 100 + 0.5) as int) || '%' end odds_ from part""")
def display_numbers(spark: SparkSession, at: str) -> DataFrame:
    """Numbers without trailing zeros, seconds of ticks, ranges, chances of producers."""
    odds = text.producer_odds(F.col("p_size") / 40, F.lit(1), F.lit(2), F.col("p_size") / 40)
    made = table(spark, at, "part")
    number, seconds = text.number_text(F.col("p_size") / 4), text.number_text(text.seconds_of_ticks(F.col("p_size") * 4 / 5))
    return made.select("p_partkey", number.alias("number"), seconds.alias("seconds_"), text.range_text(F.col("p_size"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).otherwise(F.col("p_size") + 2)).alias("range_"), odds["chance"].alias("odds_"))


@query("select p_partkey, unnest(range(0, 2)) place, unnest(['Easy', null]) label, unnest(['{{hp|' || p_size || '}}', p_name]) as value, unnest([p_size::double, null]) points, 1.5 + p_size height from part")
def infobox_fields(spark: SparkSession, at: str) -> DataFrame:
    field = _text("'''Easy:''' {{hp|1|", F.col("p_size"), "}}<br>* [[x|", F.col("p_name"), "]]<!-- no -->")
    made = table(spark, at, "part").select("p_partkey", "p_size", F.posexplode(markup.field_lines(F.regexp_replace(field, r"hp\|1\|", "hp|"))).alias("place", "f"))
    size = markup.sizes(_text("Adult:<br>Height: ", F.col("p_size") + 1.5, " blocks<br>Width: 0.6 blocks"))
    return made.select("p_partkey", "place", "f.label", "f.value", F.get(markup.points(F.col("f.value")), F.lit(0)).alias("points"), size["height"].alias("height"))


@query("select p_partkey, 'Tag Of ' || upper(p_type[1]) || lower(p_type[2:]) || ' Logs' as tag, case p_size % 3 when 0 then 'Potion of Night Vision' when 1 then 'Potion of Night Vision (extended)' else 'Potion of Night Vision II' end potion from part")
def labels_of_ids(spark: SparkSession, at: str) -> DataFrame:
    variant = F.when(F.col("p_size") % 3 == 0, "night_vision").when(F.col("p_size") % 3 == 1, "long_night_vision").otherwise("strong_night_vision")
    return table(spark, at, "part").select("p_partkey", text.tag_label(_text("#ns:tag_of_", F.col("p_type"), "/logs")).alias("tag"), text.variant_label(F.lit("Potion"), variant).alias("potion"))


def _page() -> Column:
    size = F.col("p_size")
    kind = F.when(size % 2 == 0, "good").otherwise("bad")
    return _text("{{Infobox effect|category = ", kind, "|image = [[File:a.png]]}}\n[[File:b.png|thumb]]\n'''", F.col("p_name"), "''' is a [[thing|kind]] of ", F.col("p_brand"), ".<ref>x</ref>\n\nMore of it.\n== Causes ==\n{| class=t\n! Cause !! Level\n|-\n| rowspan=\"2\" | [[", F.col("p_name"), "]] || 1\n|-\n| ", size, "\n|}\n=== Ores ===\n{|\n! Ore !! Height\n|-\n| ", F.col("p_type"), " || ", size, "\n|}\n== Notes ==\nnone")


@query("select p_partkey, case when p_size % 2 = 0 then 'good' else 'bad' end category, p_name || ' is a kind of ' || p_brand || '.' as first from part")
def effect_pages(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "part").select("p_partkey", markup.named_argument(_page(), "infobox effect", "category").alias("category"), markup.first_paragraph(_page()).alias("first"))


@query("select p_partkey, unnest(range(0, 4)) place, unnest([0, 2, 3, 2]) as level, unnest([null, 'Causes', 'Ores', 'Notes']) title from part")
def page_sections(spark: SparkSession, at: str) -> DataFrame:
    made = table(spark, at, "part").select("p_partkey", F.posexplode(markup.page_sections(_page())).alias("place", "s"))
    return made.select("p_partkey", "place", "s.level", "s.title")


@query("select p_partkey, unnest(['Cause', 'Cause', 'Ore']) as role, unnest([p_name, p_name, p_type]) as name, unnest(['1', cast(p_size as varchar), cast(p_size as varchar)]) as value from part")
def tables_by_role(spark: SparkSession, at: str) -> DataFrame:
    """Rows of all tables of a page, with the role that the first heading of their table says; spans are filled."""
    each = spread(table(spark, at, "part"), "p_partkey").select("p_partkey", F.posexplode(markup.wiki_tables(_page())).alias("n", "t"))
    cells = each.select("p_partkey", "n", F.inline(markup.table_cells(F.col("t"), strict=True)))
    role = cells.where("header and col = 0").select("p_partkey", "n", F.col("text").alias("role"))
    values = cells.where("not header").groupBy("p_partkey", "n", "row").agg(F.max(F.when(F.col("col") == 0, F.col("text"))).alias("name"), F.max(F.when(F.col("col") == 1, F.col("text"))).alias("value"))
    return values.join(role, ["p_partkey", "n"]).select("p_partkey", "role", text.strip_markup(F.col("name")).alias("name"), "value")
