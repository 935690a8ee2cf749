"""Where biomes are placed: the climate tables of a world generation page, found by what they say, joined and collapsed to ranges.

Pages that lack a table or a legend give no placement, but a row in the ledger for each thing that is missing; other pages are not
held up by them.  Joins and grouping are per page, so any number of pages (versions, languages, worlds) are read side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import whole_cells
from ..session import spread, written

#: Roles of tables in page order, groups of biomes (each has the table of the role below it), columns of the inland
#: table, which are the last four of seven bands, and the headings of the shattered table, whose first two levels are one.
ROLES = ("depth", "non_inland", "inland", "beach", "badland", "middle", "plateau", "shattered")
GROUPS = ("Beach biomes", "Badland biomes", "Middle biomes", "Plateau biomes", "Shattered biomes")
INLAND = ("Coast", "Near-inland", "Mid-inland", "Far-inland")
FIRST_INLAND_BAND = 3
SHATTERED_T = ("T=0~1 (-1.0~-0.15)", "T=2 (-0.15~0.2)", "T=3 (0.2~0.55)", "T=4 (0.55~1.0)")
SHATTERED_H = ("H=0~1 (-1.0~-0.1)", "H=2 (-0.1~0.1)", "H=3 (0.1~0.3)", "H=4 (0.3~1.0)")

_TABLE = r"(?s)\{\|.*?\n\|\}"
_COLUMNS = {"route": "string", "grp": "string", "temperature": "string", "humidity": "string", "continentalness": "string", "erosion": "string", "weirdness": "string", "pv": "string", "depth": "string", "requirement": "string", "condition": "string", "t_levels": "array<int>", "h_levels": "array<int>", "e_levels": "array<int>", "c_bands": "array<int>", "pv_band": "string"}


def overworld(text: Column) -> Column:
    """The section === Overworld === below == Biomes, up to the next heading of its level or above; null if there is none."""
    at = F.instr(text, "== Biomes")
    below = F.when(at > 0, F.substr(text, at)).otherwise(text)
    found = F.regexp_extract(below, r"(?ms)^={3}\s*Overworld\s*={3}.*?(?=^={2,3}[^=][^\n]*?={2,3}|\z)", 0)
    return F.nullif(found, F.lit(""))


def legend(section: Column) -> Column:
    """The ranges of temperature, humidity and erosion levels, and name and range of the bands of continentalness and of peaks, from
    the prose; what is not found is null."""

    def levels(name: str) -> Column:
        said = F.regexp_extract(section, rf"(?s)'''{name}'''.*?from level 0 to level (\d+) are:\s*([^\n]+)", 2)
        return F.when(said != "", F.transform(F.split(said, ","), lambda x: F.regexp_replace(F.trim(x), r"\.+$", "")))

    def bands(part: Column) -> Column:
        rule = r"\*\s*If\s+([-\d.~]+):\s*([^\n]+)"
        both = F.zip_with(F.regexp_extract_all(part, F.lit(rule), F.lit(2)), F.regexp_extract_all(part, F.lit(rule), F.lit(1)), lambda n, r: F.struct(F.trim(n).alias("name"), F.trim(r).alias("range")))
        return F.when(F.size(both) > 0, both)

    before = F.when(F.instr(section, "'''Erosion'''") > 0, F.get(F.split(section, "'''Erosion'''"), F.lit(0)))
    peaks = F.nullif(F.regexp_extract(section, "(?s)'''PV'''(.*?)'''Depth'''", 1), F.lit(""))
    return F.struct(levels("Temperature").alias("temperature"), levels("Humidity").alias("humidity"), levels("Erosion").alias("erosion"), bands(before).alias("bands"), bands(peaks).alias("peaks"))


def located(pages: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """key, legend, role and cells of the tables of whole pages; and key and missing: what a page lacks.

    A table claims a role by its heading, or by the name of a group in bold in the prose before it; tables without a role are
    left alone.  Of several tables of a role those marked as upcoming do not count."""
    cut = written(pages.select(key, overworld(F.col(text)).alias("section")).withColumn("legend", legend(F.col("section"))), "sections")
    leads, tables = F.split("section", _TABLE), F.regexp_extract_all("section", F.lit(_TABLE), F.lit(0))
    each = cut.select(key, F.posexplode(F.zip_with(F.slice(leads, 1, F.size(tables)), tables, lambda a, b: F.struct(a.alias("lead"), b.alias("table")))).alias("n", "t")).select(key, "n", "t.*")
    head = F.array_join(F.slice(F.split("table", r"(?m)^\|-"), 1, 2), "|-")
    lead = F.lower("lead")
    claims = [head.rlike(r"(?m)^!\s*Depth\b"), F.contains(head, F.lit("Mushroom fields")) & F.contains(head, F.lit("Oceans")), head.rlike(r"(?m)^!\s*Erosion\b") & head.rlike(r"(?m)^!\s*PV\b")]
    claims += [F.contains(lead, F.lit(f"'''{g.lower()}'''")) for g in GROUPS]
    upcoming = F.substring(lead, -400, 400).rlike("upcoming") | F.lower(head).rlike("upcoming")
    roles = F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in zip(claims, ROLES, strict=True))))
    rows = each.select(key, "n", "table", F.explode(roles).alias("role"), upcoming.alias("later"))
    best = rows.groupBy(key, "role").agg(F.count("*").alias("n_all"), F.sum(F.when(F.col("later"), 0).otherwise(1)).alias("n_now"), F.min_by("table", F.struct("later", "n")).alias("table"))
    asked = spread(cut.select(key, "legend", (F.col("section").isNull()).alias("__none"), F.explode(F.array(*map(F.lit, ROLES))).alias("role")), key, "role")
    # what is joined by page grows with the pages, and its files are small for what they hold: no broadcast, here and below
    met = asked.join(best.hint("merge"), [key, "role"], "left").withColumn("cells", whole_cells(F.when((F.col("n_all") == 1) | (F.col("n_now") == 1), F.col("table"))))
    met = written(met.drop("table"), "tables")
    why = F.when(F.col("n_all").isNull(), F.concat(F.lit("no table: "), "role")).when((F.col("n_all") > 1) & (F.col("n_now") != 1), F.concat(F.when(F.col("n_now") > 1, F.col("n_now")).otherwise(F.lit(0)).cast("string"), F.lit(" tables: "), "role")).when(F.col("cells").isNull(), F.concat(F.lit("broken table: "), "role"))
    of_tables = met.where("not __none").select(key, why.alias("missing")).where("missing is not null")
    parts = [F.when(F.col(f"legend.{n}").isNull(), F.lit(f"no legend: {n}")) for n in ("temperature", "humidity", "erosion", "bands", "peaks")]
    of_legend = cut.select(key, F.explode(F.array_compact(F.when(F.col("section").isNull(), F.array(F.lit("no section"))).otherwise(F.array(*parts)))).alias("missing"))
    lacking = written(of_tables.unionByName(of_legend), "ledger")
    whole = met.join(lacking.select(key).distinct(), key, "left_anti")
    return whole.select(key, "legend", "role", "cells"), lacking


def _plain(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(cell, r"(?s)<ref\b[^>]*>.*?</ref>", ""), r"<ref\b[^>]*/>", ""))


def _links(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\{\{BiomeLink\|([^|}]+)"), F.lit(1)), lambda x: F.trim(x))


def _items(cell: Column) -> Column:
    """kind ('biome' or 'group'), name and condition of each line of a cell; a condition stands in brackets at the end."""
    end = r"[\x{FF08}(]([^\x{FF09})]+)[\x{FF09})]\s*$"
    lines = F.filter(F.transform(F.split(_plain(cell), r"<br\s*/?>|\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_replace(x, end, "")).alias("base"), F.nullif(F.trim(F.regexp_extract(x, end, 1)), F.lit("")).alias("condition")))

    def item(p: Column) -> Column:
        biome = F.get(_links(p["base"]), F.lit(0))
        group = F.coalesce(*(F.when(F.contains(F.lower(p["base"]), F.lit(g.lower())), F.lit(g)) for g in GROUPS))
        return F.struct(F.when(biome.isNotNull(), "biome").when(group.isNotNull(), "group").alias("kind"), F.coalesce(biome, group).alias("name"), p["condition"].alias("condition"))

    return F.filter(F.transform(parts, item), lambda i: i["kind"].isNotNull())


def runs(values: Column) -> Column:
    """first and last of each run of whole numbers in a small array."""
    own = F.array_sort(F.array_distinct(values))
    ends = lambda step: F.filter(own, lambda x: ~F.array_contains(own, x + step))
    return F.zip_with(ends(-1), ends(1), lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def _edge(ranges: Column, at: Column, end: int) -> Column:
    """The lower (0) or upper (-1) end of a range; empty beyond the list."""
    return F.coalesce(F.element_at(F.split(F.get(ranges, at), "~"), 1 if end == 0 else -1), F.lit(""))


def _said(label: Column, low: Column, high: Column) -> Column:
    return F.when((low != "") & (high != ""), F.concat(label, F.lit(" ("), low, F.lit("~"), high, F.lit(")"))).otherwise(label)


def _one(label: Column, ranges: Column, at: Column) -> Column:
    found = F.coalesce(F.get(ranges, at), F.lit(""))
    return F.when(found != "", F.concat(label, F.lit(" ("), found, F.lit(")"))).otherwise(label)


def _level(letter: str, ranges: Column, at: Column) -> Column:
    return F.concat(F.lit(f"{letter}="), at.cast("string"), F.lit(" ("), F.get(ranges, at), F.lit(")"))


def _shaped(df: DataFrame, key: str, route: str, **columns: Column | str) -> DataFrame:
    given = {"route": F.lit(route)} | columns
    return df.select(key, "role", "row", "col", "name", "other", *(F.coalesce(F.col(given[c]) if isinstance(given[c], str) else given[c]).cast(t).alias(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in _COLUMNS.items()))


def placements(tables: DataFrame, key: str, names: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, biome, sibling and the columns of each placement of ``located`` tables; and key and name of links to no known biome.

    ``names`` (name, id) are display names, ``registry`` (id) all biomes; a name that is in neither counts as the id that it spells.
    ``sibling`` is the biome that shares its cell, under another condition.  The terrain of a group (by the inland table) is joined
    to the biomes of the group (by its own table); neighbouring columns and rows of one condition become a range."""
    cells = written(tables.select(key, "legend", "role", F.inline("cells")).where("row > 0"), "cells")
    heads = cells.where("col = 0").select(key, "role", "row", F.col("text").alias("head"))
    body = cells.where("col > 0").join(heads.hint("merge"), [key, "role", "row"])
    temperature, humidity = F.col("legend.temperature"), F.col("legend.humidity")
    none = F.lit(None).cast("string")

    deep = cells.where("role = 'depth'").groupBy(key, "role", "row").agg(*(F.max(F.when(F.col("col") == i, F.col("text"))).alias(n) for i, n in enumerate(("head", "more", "text"))))
    deep = deep.where(~F.contains(F.lower(_plain(F.col("text"))), F.lit("surface biomes"))).select("*", F.lit(2).alias("col"), F.explode(_links(_plain(F.col("text")))).alias("name"), none.alias("other"))
    more = F.when(~_plain(F.col("more")).isin("", "N/A"), F.replace(_plain(F.col("more")), F.lit("\n"), F.lit(", ")))
    by_depth = _shaped(deep, key, "depth", depth=F.trim(F.replace("head", F.lit("D="), F.lit(""))), requirement=more)

    sea = body.where("role = 'non_inland' and col <= 3 and not (col = 2 and right > 1)").select("*", F.explode(_links(_plain(F.col("text")))).alias("name"), none.alias("other"))
    own = F.coalesce(F.nullif(F.regexp_extract("head", r"T(?:\{\{=\}\}|=)(\d+)", 1), F.lit("")).cast("int"), F.col("row") - 1)
    all_t, both = F.col("down") >= 5, (F.col("col") == 1) & (F.col("right") == 2)
    at_sea = _shaped(
        sea, key, "non_inland", temperature=F.when(all_t, "T=0-4 (-1.0~1.0)").otherwise(_level("T", temperature, own)), t_levels=F.when(all_t, F.array(*map(F.lit, range(5)))).otherwise(F.array(own)),
        continentalness=F.when(both, "Oceans, Deep oceans (-1.05~-0.19)").when(F.col("col") == 1, "Oceans (-0.455~-0.19)").when(F.col("col") == 2, "Deep oceans (-1.05~-0.455)").otherwise("Mushroom fields (-1.2~-1.05)"),
        c_bands=F.when(both, F.array(F.lit(1), F.lit(2))).otherwise(F.array(3 - F.col("col"))),
    )

    land = body.where("role = 'inland' and col between 2 and 5").withColumn("e", F.trim(F.replace("head", F.lit("E="), F.lit(""))).cast("int"))
    pvs = cells.where("role = 'inland' and col = 1").select(key, "row", F.col("text").alias("pv_name"))
    land = written(land.join(pvs.hint("merge"), [key, "row"]).select(key, "legend", "row", "col", "e", "pv_name", _items(F.col("text")).alias("items")), "inland")
    lines = land.select(key, "legend", "e", "pv_name", (F.col("col") - 2).alias("c"), F.inline("items"))
    same = [key, "kind", "name", "pv_name", "condition"]
    across = lines.groupBy(*same, "e").agg(F.first("legend").alias("legend"), runs(F.collect_set("c")).alias("r")).select(*same, "legend", "e", F.inline("r"))
    down = across.groupBy(*same, "first", "last").agg(F.first("legend").alias("legend"), runs(F.collect_set("e")).alias("r")).select(*same, "legend", F.col("first").alias("c0"), F.col("last").alias("c1"), F.inline("r"))
    erosion, bands, peaks = F.col("legend.erosion"), F.transform("legend.bands", lambda b: b["range"]), F.map_from_entries(F.transform("legend.peaks", lambda b: F.struct(b["name"], b["range"])))
    e0, e1, c0, c1 = (F.col(c) for c in ("first", "last", "c0", "c1"))
    title = F.array(*map(F.lit, INLAND))
    e_text = F.when(e0 == e1, _one(F.concat(F.lit("E="), e0.cast("string")), erosion, e0)).otherwise(_said(F.concat(F.lit("E="), e0.cast("string"), F.lit("-"), e1.cast("string")), _edge(erosion, e0, 0), _edge(erosion, e1, -1)))
    b0, b1 = c0 + FIRST_INLAND_BAND, c1 + FIRST_INLAND_BAND
    c_text = F.when(c0 == c1, _one(F.get(title, c0), bands, b0)).when((c0 == 0) & (c1 == 3), "Coast to Far-inland (-0.19~1.0)").otherwise(_said(F.concat(F.get(title, c0), F.lit(" to "), F.get(title, c1)), _edge(bands, b0, 0), _edge(bands, b1, -1)))
    of = lambda n, otherwise: F.coalesce(F.try_element_at(peaks, F.lit(n)), F.lit(otherwise))
    end = lambda c, i: F.element_at(F.split(c, "~"), i)
    pv = F.col("pv_name")
    pv_text = F.when(F.try_element_at(peaks, pv).isNotNull(), F.concat(pv, F.lit(" ("), F.try_element_at(peaks, pv), F.lit(")"))).when(pv == "High~Peaks", F.concat(pv, F.lit(" ("), end(of("High", "0.2~0.7"), 1), F.lit("~"), end(of("Peaks", "0.7~1.0"), -1), F.lit(")"))).otherwise(pv)
    # ranges of a condition are kept apart from the biome that they are for: a biome's own, or those of a group
    ranges = written(down.withColumns({"role": F.lit("inland"), "row": F.lit(0), "col": F.lit(0), "other": none, "erosion": e_text, "continentalness": c_text, "pv": pv_text, "e_levels": F.sequence(e0, e1), "c_bands": F.sequence(b0, b1)}), "terrain")
    columns = {c: c for c in ("erosion", "continentalness", "pv", "condition", "e_levels", "c_bands")} | {"pv_band": "pv_name"}
    direct = _shaped(ranges.where("kind = 'biome'"), key, "direct_inland", **columns)
    terrain = _shaped(ranges.where("kind = 'group'"), key, "group_terrain", grp="name", **columns)

    level = F.col("row") - 1
    numbers = F.transform(F.regexp_extract_all("head", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    raw = lambda letter: F.trim(F.replace("head", F.lit(f"{letter}="), F.lit("")))

    def of_head(letter: str, ranges: Column) -> Column:
        first, last = F.get(numbers, F.lit(0)), F.element_at(numbers, -1)
        return F.when(F.size(numbers) == 1, _level(letter, ranges, first)).otherwise(F.concat(F.lit(f"{letter}="), raw(letter), F.lit(" ("), _edge(ranges, first, 0), F.lit("~"), _edge(ranges, last, -1), F.lit(")")))

    pairs = F.array(F.array(F.lit(0), F.lit(1)), *(F.array(F.lit(i)) for i in (2, 3, 4)))
    c = F.col("col") - 1
    shapes = [
        ("beach", "Beach biomes", 1, of_head("T", temperature), F.lit("Any"), numbers, F.array(*map(F.lit, range(5)))),
        ("badland", "Badland biomes", 1, F.lit("T=4 (0.55~1.0)"), of_head("H", humidity), F.array(F.lit(4)), numbers),
        ("middle", "Middle biomes", 5, _level("T", temperature, c), _level("H", humidity, level), F.array(c), F.array(level)),
        ("plateau", "Plateau biomes", 5, _level("T", temperature, c), _level("H", humidity, level), F.array(c), F.array(level)),
        ("shattered", "Shattered biomes", 4, F.get(F.array(*map(F.lit, SHATTERED_T)), c), F.get(F.array(*map(F.lit, SHATTERED_H)), level), F.get(pairs, c), F.get(pairs, level)),
    ]
    grouped = None
    for role, group, width, t, h, t_levels, h_levels in shapes:
        found = body.where((F.col("role") == role) & (F.col("col") <= width)).withColumn("items", F.filter(_items(F.col("text")), lambda i: i["kind"] == "biome"))
        each = found.select(key, "legend", "role", "row", "col", "head", "items", F.posexplode("items").alias("i", "item"))
        other = F.when(F.size("items") == 2, F.get("items", 1 - F.col("i"))["name"])
        condition = F.col("item.condition")
        weird = F.contains(condition, F.lit("W<")) | F.contains(condition, F.lit("W>"))
        one = _shaped(each.withColumns({"name": F.col("item.name"), "other": other}), key, "group", grp=F.lit(group), temperature=t, humidity=h, t_levels=t_levels, h_levels=h_levels, weirdness=F.when(weird, condition), condition=F.when(~weird, condition))
        grouped = one if grouped is None else grouped.unionByName(one)
    grouped = written(grouped, "grouped")

    twos = land.select(key, "row", "col", F.filter("items", lambda i: i["kind"] == "biome").alias("b")).where("size(b) = 2")
    shared = twos.select(key, "row", "col", F.inline(F.array(F.struct(F.col("b")[0]["name"].alias("name"), F.col("b")[1]["name"].alias("mate")), F.struct(F.col("b")[1]["name"].alias("name"), F.col("b")[0]["name"].alias("mate")))))

    plain = written(by_depth.unionByName(at_sea).unionByName(direct).unionByName(grouped), "placements")
    asked = plain.select("name").union(grouped.select("other")).union(shared.select("mate")).where("name is not null").distinct()
    known = names.join(registry, "id", "left_semi").groupBy(F.lower("name").alias("__lower")).agg(F.min("id").alias("__id"))
    spelled = registry.select(F.col("id").alias("__spelled"))
    ids = written(asked.join(known, F.lower("name") == F.col("__lower"), "left").join(spelled, F.concat(F.lit("minecraft:"), F.replace(F.lower("name"), F.lit(" "), F.lit("_"))) == F.col("__spelled"), "left").select("name", F.coalesce("__id", "__spelled").alias("biome")), "biomes")
    unknown = plain.select(key, "name").join(ids.where("biome is null"), "name").select(key, "name").distinct()
    sure = ids.where("biome is not null")
    mates = shared.join(sure, "name").join(sure.select(F.col("name").alias("mate"), F.col("biome").alias("__mate")), "mate").groupBy(key, "biome").agg(F.max_by("__mate", F.struct("row", "col")).alias("__shared"))
    placed = plain.join(sure, "name").join(sure.select(F.col("name").alias("other"), F.col("biome").alias("__other")), "other", "left").join(mates.hint("merge"), [key, "biome"], "left")
    sibling = F.when(F.col("route") == "direct_inland", F.col("__shared")).otherwise(F.col("__other"))
    first = placed.select(key, "biome", sibling.alias("sibling"), *_COLUMNS)
    members = first.where("route = 'group'").select(key, "biome", "grp").distinct()
    below = terrain.drop("role", "row", "col", "name", "other").join(members.hint("merge"), [key, "grp"]).select(key, "biome", none.alias("sibling"), *_COLUMNS)
    return first.unionByName(below), unknown
