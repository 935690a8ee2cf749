"""Which edition a line of a field belongs to: headings classified, scopes carried from line to line.

A heading that only names an edition opens a region, which lasts until the next one or a rule; a heading with an edition and words of
its own opens a block, which lasts until the next heading of any kind; any other line may carry a mark for itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIFFICULTY, edition_of, let, strip_editions, strip_markup

#: Words that join, the line of a rule, and how a verdict was come by.
JOINING = ("in", "the", "on", "for")
RULE = "<hr>"
OWN, BLOCK, REGION, NONE, UNCLEAR = "own marker", "inherited block", "inherited region", "no scope", "unparseable heading"

_CALL = r"\{\{[^{}]*\}\}"
# what may stand after the colon of a heading: templates glued to it, and a placeholder
_AFTER = rf"(?i)(?:(?<=\S){_CALL}|\s*\{{\{{\s*needs testing\s*(?:\|[^{{}}]*)?\}}\}}|\s+$)+$"


def field_lines(text: Column) -> Column:
    """Lines of a field at line breaks, <br> and <hr> (kept as a line), without list marks; blank ones go."""
    broken = F.regexp_replace(F.regexp_replace(text, "(?i)<br[ /]*>", "\n"), "(?i)<hr[ /]*>", f"\n{RULE}\n")
    return F.filter(F.transform(F.split(broken, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*", ""))), lambda x: x != "")


def _cleared(line: Column) -> Column:
    """Without comments and references."""
    return F.trim(F.regexp_replace(line, r"(?is)<!--.*?-->|<ref\b[^>/]*/>|<ref\b[^>]*>.*?</ref>", ""))


def _editions(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(_CALL), F.lit(0)), edition_of), lambda x: x.isNotNull()))


def _simple(words: Column, known: tuple[str, ...]) -> Column:
    return F.forall(words, lambda w: F.lower(F.regexp_replace(w, ",", "")).isin("", *known))


def classified(line: Column) -> Column:
    """kind ('region', 'block', 'unmarked', 'unparseable', 'line' or 'rule'), edition and label of a line."""
    no = F.lit(None).cast("string")
    said = lambda kind, edition=no, label=no: F.struct(F.lit(kind).alias("kind"), edition.alias("edition"), label.alias("label"))

    def heading(found: Column, words: Column) -> Column:
        one = F.get(found, F.lit(0))
        named = F.when(F.size(words) == 1, F.when(F.lower(words[0]) == "java", "first").when(F.lower(words[0]) == "bedrock", "second"))
        label = F.array_join(words, " ")
        return (
            F.when(F.size(found) > 1, said("unparseable", label=label)).when(one.isNull() & named.isNotNull(), said("region", named))
            .when(one.isNull() & _simple(words, DIFFICULTY), said("line")).when(one.isNull(), said("unmarked", label=label)).when(F.size(words) == 0, said("region", one)).otherwise(said("block", one, label))
        )

    def words(core: Column) -> Column:
        return F.filter(F.split(F.trim(F.regexp_replace(strip_markup(strip_editions(core)), r":\s*$", "")), r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*JOINING))

    def of(bare: Column) -> Column:
        core = F.rtrim(F.regexp_replace(F.rtrim(F.regexp_replace(bare, _AFTER, "")), "'{3}$", ""))
        # only what ends in a colon is looked at further
        return let(core, lambda c: F.when(F.endswith(c, F.lit(":")), let(F.struct(_editions(bare).alias("found"), words(c).alias("words")), lambda x: heading(x["found"], x["words"]))).when(c.isNotNull(), said("line")))

    return F.when(F.trim(line) == RULE, said("rule")).when(line.isNotNull(), let(F.regexp_replace(_cleared(line), r"\s*\([^()]*\)\s*$", ""), of)).otherwise(said("unmarked"))


def own_mark(line: Column) -> Column:
    """The one edition that the templates of a line name; null for none or several."""
    return let(_editions(_cleared(line)), lambda found: F.when(F.size(found) == 1, found[0]))


def verdict(kind: Column, edition: Column, own: Column, region: Column, block: Column) -> Column:
    """edition and reached of a line, given the scopes that hold there."""
    mark = F.when(kind.isin("region", "block"), edition).when(kind == "line", own)
    plain = kind.isin("line", "unmarked")
    reached = F.when(kind == "unparseable", UNCLEAR).when(mark.isNotNull(), OWN).when(plain & block.isNotNull(), BLOCK).when(plain & region.isNotNull(), REGION).otherwise(NONE)
    return F.struct(F.coalesce(mark, F.when(plain, F.coalesce(block, region))).alias("edition"), reached.alias("reached"))


def scoped(lines: Column) -> Column:
    """line, edition and reached of each line of one field, in order."""
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("region"), none.alias("block"), F.array().cast("array<struct<line:string,edition:string,reached:string>>").alias("out"))
    each = F.transform(lines, lambda x: let(classified(x), lambda c: F.struct(x.alias("line"), c.alias("c"), F.when(c["kind"] == "line", own_mark(x)).alias("own"))))

    def step(s: Column, x: Column) -> Column:
        kind, edition = x["c"]["kind"], x["c"]["edition"]
        region = F.when(kind == "region", edition).when(kind != "rule", s["region"])
        block = F.when(kind == "block", edition).when(kind.isin("line", "unparseable"), s["block"])
        v = verdict(kind, edition, x["own"], region, block)
        row = F.struct(x["line"].alias("line"), v["edition"].alias("edition"), v["reached"].alias("reached"))
        return F.struct(region.alias("region"), block.alias("block"), F.concat(s["out"], F.array(row)).alias("out"))

    return F.aggregate(each, start, step)["out"]


def of_first_edition(text: Column) -> Column:
    """What a field says for the first edition: its lines without those of the other, joined by semicolons."""
    kept = F.filter(scoped(field_lines(text)), lambda x: F.coalesce(x["edition"], F.lit("first")) == "first")
    said = F.transform(kept, lambda x: strip_markup(strip_editions(x["line"])))
    return F.array_join(F.filter(said, lambda x: x != ""), "; ")
