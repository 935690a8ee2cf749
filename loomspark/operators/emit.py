"""What goes out: producers by output, the search index, sharded JSON that is checked before it is swapped in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .gate import passed
from .ordered import shards


def unique_in_order(rows: DataFrame, columns: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """One row for each distinct value of ``columns``, the first by ``seq``; ``copies`` counts them.  Aggregated map-side."""
    order = F.struct(*seq)
    return rows.groupBy(*columns).agg(F.min(order).alias("__first"), F.count("*").alias("copies")).select(*columns, *(F.col(f"__first.{s}").alias(f"first_{s}") for s in seq), "copies")


def shard_sizes(df: DataFrame, kind: str, order: Sequence[str], size: int = 200) -> DataFrame:
    return shards(df, kind, order, size).groupBy("shard").agg(F.count("*").alias("n_rows"))


def write_sharded(df: DataFrame, at: str, kind: str, order: Sequence[str], verdicts: DataFrame | None = None, size: int = 200) -> DataFrame:
    """Write JSON, one folder a shard, after the gate has passed; shards of an earlier build go with the overwrite.

    Rows are written by their shard, keys in the order of the columns' names."""
    if verdicts is not None:
        passed(verdicts)
    made = written(shards(df, kind, order, size), "shards")
    cols = sorted(c for c in df.columns)
    made.select(*cols, "shard").repartition("shard").sortWithinPartitions("shard", *order).write.mode("overwrite").partitionBy("shard").json(at)
    return made


def search_index(entities: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row of the index for each entity: its key, and its fields under their short names, as far as they are set (JSON leaves
    nulls out)."""
    return entities.select(key, F.to_json(F.struct(*(F.col(f) for f in sorted([key, *fields])))).alias("row"))


def merged_sources(layers: Sequence[DataFrame], key: str = "source") -> DataFrame:
    """The sources of several layers (the same columns): of one key the last layer's counts."""
    union = None
    for i, df in enumerate(layers):
        one = df.withColumn("__layer", F.lit(i))
        union = one if union is None else union.unionByName(one)
    rest = [c for c in layers[0].columns if c != key]
    return union.groupBy(key).agg(F.max_by(F.struct(*rest), "__layer").alias("__s")).select(key, "__s.*")


def as_graph(producers: DataFrame, output: str, seq: str) -> DataFrame:
    """output and producers: a JSON array of its producers in order, with sorted keys."""
    cols = sorted(c for c in producers.columns if c not in (output, seq))
    one = producers.groupBy(output).agg(F.sort_array(F.collect_list(F.struct(F.col(seq), F.struct(*cols).alias("p")))).alias("__l"))
    return one.select(output, F.to_json(F.transform("__l", lambda x: x["p"])).alias("producers"))


def from_graph(graph: DataFrame, output: str, schema: str) -> DataFrame:
    """The producers of such a graph again, with their place."""
    made = graph.select(output, F.posexplode(F.from_json("producers", f"array<struct<{schema}>>")).alias("place", "p"))
    return made.select(output, "place", "p.*")


def manifest(spark, version: str, ref: str, built_at: str, counts: DataFrame) -> DataFrame:
    """One row: what was built, of what, when, and how many rows it has."""
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).select(F.lit(1).alias("schema_version"), F.lit(version).alias("version"), F.lit(ref).alias("ref"), F.lit(built_at).alias("built_at"), "n_rows")


def read_sharded(spark, at: str, schema: str, version: int = 1, known: int = 1, shards: Sequence[str] = ()) -> DataFrame:
    """Shards of a build of a schema version that is known; named shards alone are read (the folder is the partition)."""
    if version != known:
        raise ValueError(f"schema version {version}, not {known}")
    df = spark.read.schema(schema + ", shard string").json(at)
    return df.where(F.col("shard").isin(*shards)) if shards else df


def icon_titles(entities: DataFrame, icons: DataFrame, key: str, icon: str) -> tuple[DataFrame, DataFrame]:
    """icon and title of every icon in use, each once, and the icons that no file is known for, with the entities that use them."""
    used = entities.where(F.col(icon).isNotNull()).groupBy(icon).agg(F.count("*").alias("uses"), F.min(key).alias("first_use"))
    joined = used.join(icons.groupBy(icon).agg(F.min("title").alias("title")), icon, "left")
    return joined.where("title is not null").select(icon, "title", "uses"), joined.where("title is null").select(icon, "uses", "first_use")
