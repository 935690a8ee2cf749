"""Bounded recursive traversal as joins, one round a level, each round a written table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written


class CycleError(ValueError):
    """A node that reaches itself where that is no result."""


def closure(edges: DataFrame, src: str, dst: str, most: int = 64, acyclic: bool = False) -> DataFrame:
    """src, dst, depth: all that each node reaches, with the fewest steps.  Raises if that takes more than ``most``, and with
    ``acyclic`` if a node reaches itself."""
    step = edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d")).distinct()
    front = step.select(F.col("__s").alias(src), F.col("__d").alias(dst), F.lit(1).alias("depth"))
    seen = written(front, "closure")
    front = seen
    for depth in range(2, most + 2):
        more = front.join(step, front[dst] == step["__s"]).select(src, F.col("__d").alias(dst)).distinct()
        front = written(more.join(seen.select(src, dst), [src, dst], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if front.isEmpty():
            return check_acyclic(seen, src, dst) if acyclic else seen
        if depth > most:
            break
        seen = seen.unionByName(front)
    raise CycleError(f"more than {most} steps")


def check_acyclic(reached: DataFrame, src: str, dst: str) -> DataFrame:
    if not reached.where(F.col(src) == F.col(dst)).isEmpty():
        raise CycleError("a node reaches itself")
    return reached


def ancestry(parents: DataFrame, node: str, parent: str) -> DataFrame:
    """node, depth (of a root: 0) and path (ids from the root, joined by /), by doubling: as many rounds as the depth has binary
    digits.  Raises on a cycle, on a parent that is no node, and on a node with two parents."""
    rows = parents.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.lit(0).alias("depth"), F.col(node).cast("string").alias("path"))
    rows = written(rows, "ancestry")
    total = rows.count()
    if rows.select("node").distinct().count() < total:
        raise CycleError("a node with two parents")
    for _ in range(total.bit_length() + 1):
        if rows.where("up is not null").isEmpty():
            return rows.select(F.col("node").alias(node), "depth", "path")
        above = rows.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__depth"), F.col("path").alias("__path"))
        joined = rows.where("up is not null").join(above, "up").select("node", F.col("__up").alias("up"), (F.col("depth") + F.col("__depth") + 1).alias("depth"), F.concat_ws("/", "__path", "path").alias("path"))
        rows = written(rows.where("up is null").unionByName(joined), "ancestry")
        if rows.count() < total:
            raise CycleError("a parent that is no node")
    raise CycleError("nodes without a way from a root")


def forest(nodes: DataFrame, node: str, parent: str, group: Column, label: Column, most: int = 64) -> DataFrame:
    """node, depth and sort_path: ordering by it is the preorder of the forest, roots by ``group`` then ``label``,
    children by ``label``.  Raises like ``ancestry``."""
    rows = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.concat(F.when(F.col(parent).isNull(), F.lpad(group.cast("string"), 6, "0")).otherwise(F.lit("")), F.lower(label), F.lit("\x01"), F.col(node).cast("string")).alias("own"))
    level = written(rows.where("parent is null").select("node", F.lit(0).alias("depth"), F.col("own").alias("sort_path")), "forest")
    out, reached = level, level.count()
    for depth in range(1, most + 1):
        up = level.select(F.col("node").alias("parent"), F.col("sort_path").alias("above"))
        level = written(rows.join(up, "parent").select("node", F.lit(depth).alias("depth"), F.concat_ws("\x02", "above", "own").alias("sort_path")), "forest")
        n = level.count()
        if not n:
            break
        out, reached = out.unionByName(level), reached + n
    if reached != rows.count():
        raise CycleError("nodes without a way from a root")
    return out.withColumnRenamed("node", node)


def bounded_tree(roots: DataFrame, edges: DataFrame, src: str, dst: str, depth: int = 4) -> DataFrame:
    """root, node, depth, path (joined by >) and stub of all ways from the roots.

    A node that is on its own way already ends it (``stub`` = 'repeat'); at ``depth`` a node that has edges
    is cut off (``stub`` = 'expandable')."""
    steps = edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d")).distinct()
    level = written(roots.select(F.col(src).alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("way"), F.lit(False).alias("again")), "tree")
    out = level
    for d in range(1, depth + 1):
        grown = level.where("not again").join(steps, F.col("node") == F.col("__s"))
        level = written(grown.select("root", F.col("__d").alias("node"), F.lit(d).alias("depth"), F.concat("way", F.array("__d")).alias("way"), F.array_contains("way", F.col("__d")).alias("again")), "tree")
        out = out.unionByName(level)
    inner = steps.select(F.col("__s").alias("node")).distinct().withColumn("__more", F.lit(True))
    stub = F.when(F.col("again"), "repeat").when((F.col("depth") == depth) & F.col("__more"), "expandable")
    return out.join(inner, "node", "left").select("root", "node", "depth", F.array_join(F.transform("way", lambda x: x.cast("string")), ">").alias("path"), stub.alias("stub"))


def producer_tree(roots: DataFrame, producers: DataFrame, inputs: DataFrame, depth: int = 4) -> DataFrame:
    """root, path, depth, item, tag and stub of all that the roots (column item) are made of.

    ``producers`` has output and producer; ``inputs`` has producer, slot, item and tag (one of the two null).  ``path`` names
    the producers and slots from the root.  A tag is a leaf; an item on its own way ends it (stub 'repeat'), and a producer
    all of whose inputs do so is left out; at ``depth`` an item that has producers is cut off (stub 'expandable'), but a root
    never is.  ``roots`` may have ``way`` (array of items already above), to go on below a stub."""
    gathered = inputs.groupBy("producer").agg(F.array_sort(F.collect_list(F.struct("slot", "item", "tag"))).alias("inputs"))
    made = written(producers.select("output", "producer").join(gathered, "producer", "left").select("output", "producer", F.coalesce("inputs", F.array().cast("array<struct<slot:int,item:string,tag:string>>")).alias("inputs")), "producers")
    way = F.array_union("way", F.array("item")) if "way" in roots.columns else F.array("item")
    level = written(roots.select(F.col("item").alias("root"), F.lit("").alias("path"), F.lit(0).alias("depth"), "item", F.lit(None).cast("string").alias("tag"), way.alias("way"), F.lit(False).alias("again")).distinct(), "tree")
    out = level
    for d in range(1, max(depth, 1) + 1):
        grown = level.where("tag is null and not again").join(made, F.col("item") == F.col("output")).select("root", "path", "way", "producer", "inputs")
        kept = grown.where(~((F.size("inputs") > 0) & F.forall("inputs", lambda i: F.coalesce(F.array_contains("way", i["item"]), F.lit(False)))))
        each = kept.select("root", "path", "way", "producer", F.inline("inputs"))
        again = F.coalesce(F.array_contains("way", F.col("item")), F.lit(False))
        path = F.concat_ws("/", F.nullif("path", F.lit("")), F.concat_ws(".", "producer", "slot"))
        level = written(each.select("root", path.alias("path"), F.lit(d).alias("depth"), "item", "tag", F.when(F.col("item").isNull() | again, F.col("way")).otherwise(F.concat("way", F.array("item"))).alias("way"), again.alias("again")), "tree")
        out = out.unionByName(level)
    known = producers.select(F.col("output").alias("item")).distinct().withColumn("__more", F.lit(True))
    stub = F.when(F.col("again"), "repeat").when((F.col("depth") == max(depth, 1)) & F.col("__more"), "expandable")
    return out.join(known, "item", "left").select("root", "path", "depth", "item", "tag", stub.alias("stub"), "way")


def tree_depths(tree: DataFrame) -> DataFrame:
    """root, the depth of its tree, and its number of nodes."""
    return tree.groupBy("root").agg(F.max("depth").alias("depth"), F.count("*").alias("n_nodes"))


def truncated(tree: DataFrame, depth: int) -> DataFrame:
    """The tree cut at a depth: what had more below becomes a stub."""
    tops = tree.where(F.col("depth") == depth + 1).select("root", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("path")).distinct().withColumn("__more", F.lit(True))
    kept = tree.where(F.col("depth") <= depth).join(tops, ["root", "path"], "left")
    return kept.select("root", "path", "depth", "item", "tag", F.coalesce("stub", F.when(F.col("__more"), "expandable")).alias("stub"), "way")


def expanded(tree: DataFrame, producers: DataFrame, inputs: DataFrame, depth: int = 4) -> DataFrame:
    """The trees below the stubs that were cut off, each with the items above it as its way; ``root`` is the item of the stub."""
    return producer_tree(tree.where("stub = 'expandable'").select("item", "way"), producers, inputs, depth)
