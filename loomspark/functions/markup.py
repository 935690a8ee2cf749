"""Nested markup, where a column expression can't count depth: templates and tables, as Arrow functions of whole batches."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import display_lines, strip_markup

TEMPLATE = "array<struct<name:string,args:array<string>,named:map<string,string>>>"
CELLS = "array<struct<row:int,col:int,text:string,header:boolean>>"
SPANNED = "array<struct<row:int,col:int,text:string,header:boolean,down:int,right:int>>"
_TOKEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")


def templates(text: str) -> list[dict]:
    """Top-level templates of a text: name, positional and named arguments, cut at bars outside of nested ones."""
    out, depth, links, start, cuts = [], 0, 0, 0, []
    for m in _TOKEN.finditer(text):
        t = m.group()
        if t == "{{":
            if not depth:
                start, cuts, links = m.end(), [], 0
            depth += 1
        elif t == "}}" and depth:
            depth -= 1
            if not depth:
                edges = [start, *(c + 1 for c in cuts)]
                parts = [text[a:b].strip() for a, b in zip(edges, [*cuts, m.start()], strict=True)]
                named = dict(p.split("=", 1) for p in parts[1:] if re.match(r"[\w \-]+=", p))
                args = [p for p in parts[1:] if not re.match(r"[\w \-]+=", p)]
                out.append({"name": parts[0], "args": args, "named": {k.strip(): v.strip() for k, v in named.items()}})
        elif t == "[[":
            links += 1
        elif t == "]]":
            links = max(0, links - 1)
        elif t == "|" and depth == 1 and not links:
            cuts.append(m.start())
    return out


def grid(text: str) -> list[dict]:
    """Cells of the first wiki table; row and column spans are filled in."""
    m = re.search(r"(?s)\{\|(.*?)\|\}", text)
    cells: list[dict] = []
    if not m:
        return cells
    taken: set[tuple[int, int]] = set()
    row = -1
    for block in re.split(r"\n\|-[^\n]*", "\n" + m.group(1).split("\n", 1)[-1]):
        found = re.findall(r"(?:\n|(?<=\n))([!|])(?!\})((?:(?!\n[!|]).)*)", "\n" + block.strip("\n"), re.S)
        if not found:
            continue
        row, col = row + 1, 0
        for mark, line in found:
            for cell in re.split(r"\|\||!!", line):
                attributes, bar, body = cell.partition("|")
                if not bar or "[[" in attributes or "{{" in attributes:
                    attributes, body = "", cell
                down, right = (int(x.group(1)) if (x := re.search(rf'{k}\s*=\s*"?(\d+)', attributes)) else 1 for k in ("rowspan", "colspan"))
                while (row, col) in taken:
                    col += 1
                for r in range(row, row + down):
                    for c in range(col, col + right):
                        taken.add((r, c))
                        cells.append({"row": r, "col": c, "text": body.strip(), "header": mark == "!", "down": down, "right": right})
                col += right
    return sorted(cells, key=lambda c: (c["row"], c["col"]))


class TableError(ValueError):
    """A table whose cells collide or leave holes."""


def checked(cells: list[dict]) -> list[dict]:
    """The cells, or TableError where two share a place or a row is shorter than another."""
    places = [(c["row"], c["col"]) for c in cells]
    if len(set(places)) < len(places):
        raise TableError("two cells in one place")
    widths: dict[int, int] = {}
    for row, _ in places:
        widths[row] = widths.get(row, 0) + 1
    if len(set(widths.values())) > 1:
        raise TableError("rows of different lengths")
    return cells


def _find_templates(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else templates(t))


def _table_cells(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else grid(t))


def _checked_cells(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else checked(grid(t)))


def _whole_cells(text: pd.Series) -> pd.Series:
    def whole(t: str | None) -> list[dict] | None:
        try:
            return None if t is None else checked(grid(t))
        except TableError:
            return None

    return text.map(whole)


def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def find_templates(text: Column) -> Column:
    return F.pandas_udf(_find_templates, TEMPLATE)(text)


def table_cells(text: Column, strict: bool = False) -> Column:
    """Cells of the first table; ``strict`` raises where they collide or leave holes."""
    return F.pandas_udf(_checked_cells if strict else _table_cells, CELLS)(text)


def whole_cells(text: Column) -> Column:
    """Cells of the first table with the rows and columns that each spans; null where they collide or leave holes."""
    return F.pandas_udf(_whole_cells, SPANNED)(text)


def unescape_all(text: Column) -> Column:
    """All character references, numbered ones too, where ``text.unescape`` knows the common ones."""
    return F.pandas_udf(_unescape, "string")(text)


def field_lines(text: Column) -> Column:
    """label and value of each line of an infobox field: "Label: value", markup taken out, templates kept; no colon, no label."""
    shape = r"^(?:([^:{}]+):\s*)?(.*)$"
    part = lambda x, i: F.regexp_extract(strip_markup(x), shape, i)
    made = F.transform(display_lines(text), lambda x: F.struct(F.nullif(part(x, 1), F.lit("")).alias("label"), part(x, 2).alias("value")))
    return F.filter(made, lambda f: f["value"] != "")


def points(value: Column) -> Column:
    """Numbers of ``{{hp|20}}`` and of ``{{hp|4|8}}`` (the last one counts), as doubles."""
    calls = F.regexp_extract_all(value, F.lit(r"\{\{hp\|([^{}]*)\}\}"), F.lit(1))
    return F.filter(F.transform(calls, lambda c: F.element_at(F.split(c, "\\|"), -1).try_cast("double")), lambda x: x.isNotNull())


def sizes(value: Column) -> Column:
    """height and width in "Height: 1.95 blocks ... Width: 0.6 blocks"."""
    of = lambda name: F.regexp_extract(value, rf"(?i){name}:\s*([0-9.]+)", 1).try_cast("double")
    return F.struct(of("height").alias("height"), of("width").alias("width"))


HEADING = r"(?m)^(={2,6})[ \t]*(.+?)[ \t]*\1[ \t]*$"


def page_sections(text: Column) -> Column:
    """level, title and body of each section of a page in order; what stands before the first heading has level 0 and no title."""
    marks = F.regexp_extract_all(text, F.lit(HEADING), F.lit(1))
    titles = F.regexp_extract_all(text, F.lit(HEADING), F.lit(2))
    made = F.transform(F.split(text, HEADING), lambda b, i: F.struct(F.coalesce(F.length(F.get(marks, i - 1)), F.lit(0)).alias("level"), F.get(titles, i - 1).alias("title"), F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")).alias("body")))
    return F.filter(made, lambda s: (s["level"] > 0) | (s["body"] != ""))


def first_paragraph(text: Column) -> Column:
    """The first line of prose as plain text: no template, table, list, heading or file."""
    lines = F.transform(F.split(F.regexp_replace(text, "(?s)<!--.*?-->", ""), "\n"), lambda x: F.trim(x))
    prose = F.filter(lines, lambda x: ~x.rlike(r"^(?:$|[{|}=*#:;!]|(?i:\[\[(?:file|image|category):[^\]]*\]\]$))"))
    return strip_markup(F.get(prose, F.lit(0)))


def wiki_tables(text: Column) -> Column:
    """The tables of a page in order (tables within tables end the outer one)."""
    return F.regexp_extract_all(text, F.lit(r"(?s)\{\|.*?\n\|\}"), F.lit(0))


def named_argument(text: Column, template: str, name: str) -> Column:
    """An argument of the first template of that name (templates within it are its own)."""
    found = F.filter(find_templates(text), lambda t: F.lower(t["name"]) == template.lower())
    return F.try_element_at(F.get(found, F.lit(0))["named"], F.lit(name))
