"""Text and markup functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\r\\f]+"
#: The character references that display texts use.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it: an expression that stands in another several
    times is evaluated as often where functions of arrays are about, and by steps that multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)


def clean_text(text: Column) -> Column:
    """Unescaped and trimmed; empty texts and a lone dash are null."""
    made = F.trim(unescape(text))
    return F.when((made == "") | (made == "—"), None).otherwise(made)


def int_range(text: Column) -> tuple[Column, Column]:
    """``5``, ``0-5`` and ``0–5`` as (least, most); nulls where the text is none of these."""
    shape = r"^\s*(\d+)(?:\s*[-–]\s*(\d+))?\s*$"
    least = F.regexp_extract(text, shape, 1).try_cast("int")
    return least, F.coalesce(F.regexp_extract(text, shape, 2).try_cast("int"), least)


def strip_tags(html: Column) -> Column:
    """The text of a page: script and style blocks, comments and tags out, white space collapsed."""
    for pattern in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->", "<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(html, SPACE, " "))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


#: What goes with its content, in this order: comments, references, footnotes, files, categories.
_GONE = ("(?s)<!--.*?-->", "(?is)<ref\\b[^>]*/>", "(?is)<ref\\b[^>]*>.*?</ref>", "(?is)<sup\\b[^>]*>.*?</sup>", "(?is)\\[\\[ *(?:file|image):(?:[^\\[\\]]|\\[\\[[^\\[\\]]*\\]\\])*\\]\\]", "(?i)\\[\\[ *category:[^\\]]*\\]\\]")


def strip_markup(text: Column, keep_links: bool = False) -> Column:
    """Wiki markup to plain text on one line.  Comments, references, footnotes, files and categories go with their content;
    of other tags and of emphasis the content stays; links become their labels (or stay); templates stay as they are."""
    for pattern in _GONE:
        text = F.regexp_replace(text, pattern, "")
    if not keep_links:
        text = F.regexp_replace(F.regexp_replace(text, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), r"\[\[([^\[\]|]*)\]\]", "$1")
    text = F.regexp_replace(F.regexp_replace(text, "</?[a-zA-Z][^>]*>", ""), "'{2,5}", "")
    text = unescape(F.regexp_replace(text, r"[\x{200b}-\x{200d}\x{2060}\x{feff}]", ""))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def flattened(text: Column) -> Column:
    """A paragraph with list marks as running prose: the first item follows its introduction, the others a comma."""
    lines = F.split(F.regexp_replace(text, "(?i)<br[ /]*>", "\n"), "\n")
    listed = F.transform(lines, lambda x: F.struct(x.rlike(r"^\s*[*#]").alias("item"), strip_markup(F.regexp_replace(x, r"^\s*[*#:;]+\s*", "")).alias("t")))
    between = lambda s, x: F.when(s["t"] == "", "").when(s["item"] & x["item"], ", ").when(s["item"] & s["t"].rlike(r"[^.!?:;,]$") & x["t"].rlike(r"^\p{Lu}"), ". ").otherwise(" ")
    first = F.struct(F.lit(False).alias("item"), F.lit("").alias("t"))
    return F.aggregate(F.filter(listed, lambda x: x["t"] != ""), first, lambda s, x: F.struct(x["item"].alias("item"), F.concat(s["t"], between(s, x), x["t"]).alias("t")))["t"]


# How templates name the two editions, and the words of difficulty.
FIRST_EDITION = ("java", "je", "java edition")
SECOND_EDITION = ("bedrock", "be", "bedrock edition", "ee", "education", "education edition")
DIFFICULTY = ("easy", "normal", "hard", "and")
_CALL = r"\{\{[^{}]*\}\}"


def edition_of(template: Column) -> Column:
    """'first', 'second' or null: the edition that a template without nesting names ({{je}}, {{in|bedrock}}, {{only|java|be}})."""
    has = lambda asked, tokens: F.arrays_overlap(asked, F.array(*map(F.lit, tokens)))
    said = lambda asked: F.when(has(asked, FIRST_EDITION), "first").when(has(asked, SECOND_EDITION), "second")
    last = lambda args: F.slice(args, F.greatest(F.size(args), F.lit(1)), 1)

    def named(parts: Column) -> Column:
        name, args = F.get(parts, F.lit(0)), F.filter(F.slice(parts, 2, 99), lambda x: ~x.contains("="))
        return F.when(name.isin("je", "be"), said(F.array(name))).when(name == "in", let(args, lambda a: said(last(a)))).when(name == "only", let(args, said))

    return let(F.transform(F.split(F.regexp_replace(template, r"^\{\{|\}\}$", ""), "\\|"), lambda x: F.lower(F.trim(x))), named)


def inline_edition(line: Column) -> Column:
    """The edition of the last template of a line that names one."""
    named = F.filter(F.transform(F.regexp_extract_all(line, F.lit(_CALL), F.lit(0)), edition_of), lambda x: x.isNotNull())
    return F.get(named, F.size(named) - 1)


def strip_editions(line: Column) -> Column:
    """The line without the templates that name an edition; others stay."""
    calls = F.regexp_extract_all(line, F.lit(_CALL), F.lit(0))
    kept = lambda gaps: F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(calls, lambda c, i: F.concat(F.when(edition_of(c).isNull(), c).otherwise(""), F.get(gaps, i + 1))), ""))
    return let(F.split(line, _CALL), kept)


def heading_core(line: Column) -> Column:
    """What a heading line says: without a trailing aside in brackets, templates glued to its end and the bold mark; null if it
    does not end in a colon then, or if it is only words of difficulty."""
    core = F.regexp_replace(F.trim(line), r"\s*\([^()]*\)\s*$", "")
    core = F.regexp_replace(core, rf"(?:(?<=\S){_CALL})+$", "")
    core = F.rtrim(F.regexp_replace(core, "'{3}$", ""))
    words = F.split(F.lower(F.regexp_replace(core, "[',:]", "")), r"\s+")
    only = F.forall(words, lambda w: w.isin(*DIFFICULTY))
    return F.when(core.endswith(":") & ~only, core)


def parse_output(text: Column) -> Column:
    """item, count (1 where none is said) and note of ``item, count [note]``; null where there is no item."""
    shape = r"^(.+?)(?:\s*,\s*(\d+))?(?:\s*\[([^\]]*)\])?$"
    said = F.trim(text)
    item = F.trim(F.regexp_extract(said, shape, 1))
    made = F.struct(clean_text(item).alias("item"), F.coalesce(F.regexp_extract(said, shape, 2).try_cast("int"), F.lit(1)).alias("count"), clean_text(F.regexp_extract(said, shape, 3)).alias("note"))
    return F.when(item != "", made)


def sprite_id(name: Column) -> Column:
    """An id without its namespace, hyphens for underscores."""
    return F.replace(F.element_at(F.split(name, ":", 2), -1), F.lit("_"), F.lit("-"))


def tag_label(tag: Column) -> Column:
    """A tag for people: ``ns:logs_that_burn/dark`` is "Logs That Burn Dark"."""
    return F.initcap(F.regexp_replace(F.element_at(F.split(F.regexp_replace(tag, "^#", ""), ":", 2), -1), "[_/]", " "))


def variant_label(kind: Column, variant: Column) -> Column:
    """"Kind of Variant", with the long and strong ones marked."""
    base = F.initcap(F.replace(F.regexp_replace(variant, "^(long|strong)_", ""), F.lit("_"), F.lit(" ")))
    mark = F.when(variant.startswith("long_"), " (extended)").when(variant.startswith("strong_"), " II").otherwise("")
    return F.concat(kind, F.lit(" of "), base, mark)


def display_lines(text: Column) -> Column:
    """Lines on line breaks, <br> and list marks; blank ones are left out."""
    lines = F.split(F.regexp_replace(text, "(?i)<br[ /]*>", "\n"), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^[ ]*[*#:;]+", ""))), lambda x: x != "")


def wiki_links(text: Column) -> Column:
    """Targets of [[target|label]] links."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]|#]+)"), F.lit(1)), lambda x: F.trim(x))


def wiki_url(base: str, page: Column) -> Column:
    """Spaces become underscores; nothing else is encoded."""
    return F.concat(F.lit(base), F.replace(page, F.lit(" "), F.lit("_")))


def display_name(path: Column) -> Column:
    return F.initcap(F.replace(F.element_at(F.split(path, "[:/]"), -1), F.lit("_"), F.lit(" ")))


def number_text(value: Column, places: int = 2) -> Column:
    """Decimal text without trailing zeros."""
    made = F.format_string(f"%.{places}f", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(made, "(\\.\\d*?)0+$", "$1"), "\\.$", "")


def seconds_of_ticks(ticks: Column) -> Column:
    return ticks / F.lit(20.0)


def odds_text(chance: Column) -> Column:
    """A chance in words: a share of 100 from one percent on, else one in how many."""
    return F.when(chance.isNull(), None).when(chance >= 0.01, F.concat(number_text(chance * 100), F.lit("%"))).when(chance > 0, F.concat(F.lit("1 in "), F.round(1 / chance).cast("long").cast("string"))).otherwise("0%")


def range_text(least: Column, most: Column) -> Column:
    """``a-b``, or one number where both are equal; null where the least is."""
    return F.when(most.isNull() | (least == most), number_text(least)).otherwise(F.concat(number_text(least), F.lit("-"), number_text(most)))


def producer_odds(chance: Column, least: Column, most: Column, rate: Column) -> Column:
    """chance, count and rate of a producer as texts: a certain one has no chance, one item no count, what is certain and fixed
    no rate; less than a thousandth is said to be so."""
    certain, fixed = chance >= 1, least == most
    said = F.when(certain, None).when(chance < 0.001, "<0.1%").when(chance < 0.1, F.concat(F.format_string("%.1f", chance * 100), F.lit("%"))).otherwise(F.concat(F.format_string("%.0f", chance * 100), F.lit("%")))
    count = F.when(~fixed, F.concat_ws("-", least.cast("string"), most.cast("string"))).when(least > 1, least.cast("string"))
    each = F.when(~(certain & fixed), F.when(rate < 0.1, F.format_string("%.2f", rate)).otherwise(F.format_string("%.1f", rate)))
    return F.when(chance.isNotNull() & most.isNotNull(), F.struct(said.alias("chance"), count.alias("count"), each.alias("rate")))


def newest_first(position: Column, baseline: Column) -> Column:
    """Whether a release (by its place in the list, newest first) is older than the baseline's."""
    return position > baseline
