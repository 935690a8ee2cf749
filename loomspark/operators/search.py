"""Aliases and tiered fuzzy search of stated queries over all entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import declared, top_k

#: Strengths of an alias: the whole phrase, a curated one, a part of the name.
PHRASE, CURATED, SEGMENT = 3, 2, 1
#: Queries that are broadcast.
FEW = 1000


def aliases(entities: DataFrame, key: str = "id", name: str = "name", curated: DataFrame | None = None) -> DataFrame:
    """key, alias, strength: the strongest of each alias that is not the name itself."""
    folded = F.lower(F.col(name))
    parts = F.split(folded, "[ _/#]+")
    given = F.concat(F.array(F.struct(F.array_join(parts, " ").alias("alias"), F.lit(PHRASE).alias("strength")), F.struct(F.array_join(parts, "_").alias("alias"), F.lit(PHRASE).alias("strength"))), F.transform(parts, lambda p: F.struct(p.alias("alias"), F.lit(SEGMENT).alias("strength"))))
    rows = entities.select(key, folded.alias("__name"), F.inline(given))
    if curated is not None:
        rows = rows.unionByName(entities.select(key, folded.alias("__name")).join(curated.select(key, F.lower("alias").alias("alias")), key).select(key, "__name", "alias", F.lit(CURATED).alias("strength")))
    return rows.where("alias <> '' and alias <> __name").groupBy(key, "alias").agg(F.max("strength").alias("strength"))


#: Strengths of the aliases of entities by kind, and the levels of an enchantment.
WHOLE, GIVEN, CROSS, PIECE = 4, 3, 2, 1
LEVELS = ("i", "ii", "iii", "iv", "v")


def kind_aliases(entities: DataFrame, curated: DataFrame) -> DataFrame:
    """id, alias and strength of entities (id, kind, name, workstation): the strongest of each alias that is not the name itself.

    The path of an id as it is and with spaces (WHOLE), its pieces (PIECE); curated (id, alias) shorthand (GIVEN); for an effect "potion
    of ..." (CROSS), for a potion that and "... potion" (WHOLE), for an enchantment every level in digits and numerals (PIECE), for a
    profession "villager ..." both ways (WHOLE) and the same of its workstation (CROSS)."""
    kind, path = F.col("kind"), F.element_at(F.split("id", ":", 2), -1)
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    some = lambda strength, *aliases: F.transform(F.array(*aliases), lambda a: F.struct(a.alias("alias"), F.lit(strength).alias("strength")))
    pieces = lambda c: F.transform(F.filter(F.split(c, "[_/]"), lambda x: x != ""), lambda a: F.struct(a.alias("alias"), F.lit(PIECE).alias("strength")))
    none = F.slice(some(PIECE, path), 1, 0)
    only = lambda condition, found: F.when(F.coalesce(condition, F.lit(False)), found).otherwise(none)
    bare, potion = F.regexp_replace(path, "^entity_type/", ""), spaced(F.regexp_replace(path, "^potion/", ""))
    station = F.trim(spaced(F.element_at(F.split("workstation", ":", 2), -1)))
    levels = some(PIECE, *(F.concat(path, F.lit(f" {x}")) for i, roman in enumerate(LEVELS, 1) for x in (i, roman)))
    given = F.concat(
        some(WHOLE, path, spaced(path)), pieces(path),
        only(F.startswith(path, F.lit("entity_type/")), F.concat(some(WHOLE, bare, spaced(bare)), pieces(bare))),
        only(kind == "effect", some(CROSS, F.concat(F.lit("potion of "), spaced(path)))),
        only((kind == "item") & F.startswith(path, F.lit("potion/")), some(WHOLE, F.concat(F.lit("potion of "), potion), F.concat(potion, F.lit(" potion")))),
        only(kind == "enchantment", levels),
        only(kind == "profession", some(WHOLE, F.concat(F.lit("villager "), spaced(path)), F.concat(spaced(path), F.lit(" villager")))),
        only((kind == "profession") & (station != ""), some(CROSS, F.concat(station, F.lit(" villager")), F.concat(F.lit("villager "), station))),
    )
    rows = entities.select("id", F.lower("name").alias("__name"), F.inline(given))
    own = entities.select("id", F.lower("name").alias("__name")).join(curated.select("id", "alias"), "id").select("id", "__name", "alias", F.lit(GIVEN).alias("strength"))
    cleaned = rows.unionByName(own).withColumn("alias", F.lower(F.trim("alias")))
    return cleaned.where("alias <> '' and alias <> __name").groupBy("id", "alias").agg(F.max("strength").alias("strength"))


def tier(query: Column, text: Column, reverse: bool = False) -> Column:
    """0 for an equal text, 1 for a prefix, 2 for a part (with ``reverse``, also for a text that is part of the query), else null."""
    part = F.contains(text, query)
    return F.when(text == query, 0).when(F.startswith(text, query), 1).when(part | F.contains(query, text) if reverse else part, 2)


def _holding(texts: DataFrame, asked: DataFrame, few: int) -> DataFrame:
    """Texts (column text) joined with the queries (__q) they hold.  Up to ``few`` queries, which are counted, are broadcast and looked
    for in each text; more are joined by their letters with all parts of a text that are as long as a query."""
    if asked.limit(few + 1).count() <= few:
        return texts.join(F.broadcast(asked), F.contains("text", F.col("__q")))
    sizes = sorted(r[0] for r in asked.select(F.length("__q")).distinct().where("length(__q) > 0").collect())  # as many as lengths of a query
    none = F.array().cast("array<string>")
    part = lambda n: F.when(F.length("text") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i: F.substring("text", i, F.lit(n)))).otherwise(none)
    parts = F.flatten(F.array(*map(part, sizes))) if sizes else none
    return texts.select("*", F.explode(F.array_distinct(parts)).alias("__q")).join(asked, "__q")


def ranked(queries: DataFrame, entities: DataFrame, alias_rows: DataFrame, k: int = 10, key: str = "id", name: str = "name", few: int = FEW) -> DataFrame:
    """query, key, tier, strength, rank: the best ``k`` of each query (column query).

    Order: tier, then names before aliases and stronger aliases first, shorter names, smaller ids."""
    texts = entities.select(key, F.lower(F.col(name)).alias("text"), F.lit(9).alias("strength")).unionByName(alias_rows.select(key, F.col("alias").alias("text"), "strength"))
    hit = _holding(texts, queries.select("query", F.lower("query").alias("__q")), few).withColumn("tier", tier(F.col("__q"), F.col("text")))
    best = hit.groupBy("query", key).agg(F.min(F.struct("tier", -F.col("strength"))).alias("b"))
    named = best.join(entities.select(key, F.length(name).alias("__len")), key)
    made = named.select("query", key, F.col("b.tier").alias("tier"), (-F.col("b.col2")).alias("strength"), "__len")
    return top_k(made, ["query"], [F.col("tier"), F.col("strength").desc(), F.col("__len"), F.col(key)], k).drop("__len")


# Kinds from the most useful one on, where nothing else tells two results apart.
KINDS = ("mob", "item", "block", "effect", "enchantment", "profession", "biome", "structure", "collection", "advancement", "entity")


def searched(queries: DataFrame, entities: DataFrame, alias_rows: DataFrame, k: int = 10, key: str = "id", name: str = "name", kind: str = "kind", few: int = FEW) -> DataFrame:
    """query, key, tier, is_name, is_phrase, rank: the best ``k`` of each query as a reader sees them.

    Tiers: 0 equal, 1 prefix, 2 part of an alias (not of a name), 3 all terms within one edit of a word of the name.  Within a
    tier: in tier 0 items that are matched by their name or a whole-phrase alias come first (a total order in place of the rule
    for pairs of an item and a mob of one name); then names before aliases, whole-phrase aliases before others, kinds in their
    order, shorter names, smaller ids."""
    asked = queries.select("query", F.lower(F.trim("query")).alias("__q")).where("__q <> ''")
    names = entities.select(key, F.lower(F.col(name)).alias("text"), F.lit(True).alias("is_name"), F.lit(False).alias("is_phrase"))
    others = alias_rows.select(key, F.col("alias").alias("text"), F.lit(False).alias("is_name"), (F.col("strength") == PHRASE).alias("is_phrase"))
    hit = _holding(names.unionByName(others), asked, few).withColumn("tier", tier(F.col("__q"), F.col("text"))).where("not is_name or tier < 2")
    best = hit.groupBy("query", key).agg(F.min(F.struct("tier", (~F.col("is_name")).alias("a"), (~F.col("is_phrase")).alias("b"))).alias("m"))
    found = best.select("query", key, "m.tier", (~F.col("m.a")).alias("is_name"), (~F.col("m.b")).alias("is_phrase"))
    near = fuzzy(queries.where(F.trim("query") != ""), entities, key, name).join(found.select("query", key), ["query", key], "left_anti")
    both = found.unionByName(near.select("query", key, F.lit(3).alias("tier"), F.lit(True).alias("is_name"), F.lit(False).alias("is_phrase")))
    made = both.join(entities.select(key, F.length(name).alias("__len"), F.col(kind).alias("__kind")), key)
    concept = (F.col("tier") == 0) & (F.col("__kind") == "item") & (F.col("is_name") | F.col("is_phrase"))
    order = [F.col("tier"), (~concept), (~F.col("is_name")), (~F.col("is_phrase")), declared(F.col("__kind"), KINDS), F.col("__len"), F.col(key)]
    return top_k(made, ["query"], order, k).drop("__len", "__kind")


def candidates_of(queries: DataFrame, alias_rows: DataFrame, key: str = "id", few: int = FEW) -> DataFrame:
    """query, key, tier and strength by the other rule: tier 2 holds both ways, and tier 3 is all words of the query within the
    aliases of a key.  For small alias tables: short aliases are part of very many queries."""
    asked = queries.select("query", F.lower("query").alias("__q"))
    if asked.limit(few + 1).count() > few:
        raise ValueError(f"more than {few} queries")
    hit = alias_rows.join(F.broadcast(asked), tier(F.col("__q"), F.col("alias"), reverse=True).isNotNull())
    best = hit.groupBy("query", key).agg(F.min(F.struct(tier(F.col("__q"), F.col("alias"), reverse=True).alias("tier"), (-F.col("strength")).alias("s"))).alias("m"))
    found = best.select("query", key, "m.tier", (-F.col("m.s")).alias("strength"))
    words = asked.select("query", F.explode(F.array_distinct(F.filter(F.split("__q", "[ _]+"), lambda w: w != ""))).alias("word"))
    need = words.groupBy("query").agg(F.count("*").alias("need"))
    some = alias_rows.join(F.broadcast(words), F.contains("alias", F.col("word"))).groupBy("query", key).agg(F.count_distinct("word").alias("n"), F.max("strength").alias("strength"))
    loose = some.join(F.broadcast(need), "query").where("n = need").join(found.select("query", key), ["query", key], "left_anti")
    return found.unionByName(loose.select("query", key, F.lit(3).alias("tier"), "strength"))


def close(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or swap of neighbours at most."""
    n = F.length(a)
    swap = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    return (F.levenshtein(a, b, 1) >= 0) | ((n == F.length(b)) & (n > 1) & swap)


def neighbours(word: Column) -> Column:
    """The word, and the word without each of its letters: two words within one edit share one of these."""
    n = F.length(word)
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))))


def fuzzy(queries: DataFrame, entities: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """query, key: entities of which every term of the query is close to a word.  Distinct words and terms meet by what is left of
    them without a letter, and only the matches are joined with the entities; no side is compared with all of the other."""
    terms = queries.select("query", F.explode(F.array_distinct(F.split(F.lower("query"), " +"))).alias("term"))
    need = terms.groupBy("query").agg(F.count("*").alias("need"))
    words = entities.select(key, F.explode(F.array_distinct(F.split(F.lower(F.col(name)), "[ _/#]+"))).alias("word")).where("word <> ''")
    left = words.select("word").distinct().select("word", F.explode(neighbours(F.col("word"))).alias("__part"))
    right = terms.select("term").distinct().select("term", F.explode(neighbours(F.col("term"))).alias("__part"))
    pairs = left.join(right, "__part").select("word", "term").distinct().where(close(F.col("term"), F.col("word")))
    found = words.join(pairs, "word").join(terms, "term").select("query", key, "term").distinct()
    return found.groupBy("query", key).agg(F.count("*").alias("n")).join(need, "query").where("n = need").select("query", key)
