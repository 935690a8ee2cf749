"""A build goes out in two phases: it is staged in a folder of its own, checked there, and then becomes the current one at once.

    at/CURRENT                the name of the folder that readers use, replaced in one step
    at/builds/<name>/...      entities (a folder a shard), counts (rows and bytes of each shard), index, graph, manifest

A run that stops anywhere before the swap leaves readers the build that they had; what it staged is removed by the next run."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, written
from .emit import as_graph, search_index
from .gate import GateError, constraints, gate_checks, passed
from .ordered import shards

#: The version of the documents' shape that this library writes and reads.
SCHEMA_VERSION = 1


class BuildError(ValueError):
    """A build that must not be written, or can't be read."""


def _fs(spark: SparkSession, at: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    return jvm, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, at: str) -> list[str]:
    _, path, fs = _fs(spark, at)
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def _bytes(spark: SparkSession, at: str) -> int:
    _, path, fs = _fs(spark, at)
    return sum(x.getLen() for x in fs.listStatus(path) if not x.getPath().getName().startswith(("_", ".")))


def current(spark: SparkSession, at: str) -> str | None:
    """The folder of the build that readers use."""
    _, path, fs = _fs(spark, f"{at}/CURRENT")
    if not fs.exists(path):
        return None
    return f"{at}/builds/{spark.read.text(f'{at}/CURRENT').first()[0]}"


def swap(spark: SparkSession, at: str, name: str) -> None:
    """Make a staged build the current one: a small file is written aside and renamed over the old one."""
    jvm, aside, fs = _fs(spark, f"{at}/.CURRENT-{name}")
    out = fs.create(aside, True)
    out.write(bytearray(name.encode()))
    out.close()
    _, target, _ = _fs(spark, f"{at}/CURRENT")
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(files.makeQualified(aside), files.makeQualified(target), over)


def validated(baseline: DataFrame | None, snapshot: DataFrame, references: DataFrame, conformance: DataFrame, allow: bool = False) -> DataFrame:
    """metric, before, after and verdict of the three checks of a build: what it lost against the last one (``gate_checks``), references
    that lead nowhere (``references``: group, n; the group 'failure' must be empty), and documents out of shape (``conformance``: check,
    n_failed).  A loss may be ``allow``ed; the others may not."""
    lost = gate_checks(baseline, snapshot, allow=allow).select(F.concat_ws(":", F.lit("regression"), "family", "name").alias("metric"), F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"), F.when(F.col("verdict") == "allowed", "pass").otherwise(F.col("verdict")).alias("verdict"))
    nowhere = references.where("group = 'failure'").select(F.lit("references:failure").alias("metric"), F.lit(0).cast("long").alias("before"), F.col("n").cast("long").alias("after"), F.when(F.col("n") > 0, "failed").otherwise("pass").alias("verdict"))
    shape = conformance.select(F.concat_ws(":", F.lit("conformance"), "check").alias("metric"), F.lit(0).cast("long").alias("before"), F.col("n_failed").cast("long").alias("after"), F.when(F.col("n_failed") > 0, "failed").otherwise("pass").alias("verdict"))
    return lost.unionByName(nowhere).unionByName(shape)


def _counted(spark: SparkSession, build: str) -> DataFrame:
    """shard, n_rows and n_bytes of what is staged."""
    return spark.read.text(f"{build}/entities").groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("value") + 1).alias("n_bytes"))


def _counts(spark: SparkSession, build: str) -> DataFrame:
    """The counts that a build has of its shards, so that not all of its files are listed and read again; of builds without them, anew."""
    return spark.read.schema("shard string, n_rows long, n_bytes long").parquet(f"{build}/counts") if "counts" in _listed(spark, build) else _counted(spark, build)


def emit_build(
    entities: DataFrame, producers: DataFrame, at: str, version: str, key: str, kind: str, order: Sequence[str], fields: Sequence[str], output: str, seq: str,
    snapshot: Callable[[DataFrame], DataFrame] | None = None, references: DataFrame | None = None, checks: Sequence[tuple[str, Column]] = (), allow: bool = False, size: int = 200,
) -> DataFrame:
    """Write a build and return its report: part ('shard', 'removed', 'index', 'graph', 'manifest'), name, n_rows and n_bytes.

    ``snapshot`` makes what is compared with the current build (its own is kept beside it), ``references`` and ``checks`` are as in
    ``validated``; without them there is nothing to fail there.  Nothing that readers see changes until all is written and
    has passed.  An empty table of entities, or a size below 1, is refused before anything is written."""
    spark = entities.sparkSession
    if size < 1:
        raise BuildError(f"shards of {size} rows")
    if entities.isEmpty():
        raise BuildError("a build without entities")
    before = current(spark, at)
    name = uuid.uuid4().hex
    here = f"{at}/builds/{name}"

    numbered = written(shards(entities, kind, order, size), "shards")
    columns = sorted(entities.columns)
    # a shard of few bytes is a folder and a file all the same: they are dealt out by number, and moved by the tasks that made them
    values = spread(numbered.select("shard", F.to_json(F.struct(*columns)).alias("value"), *order), "shard").sortWithinPartitions("shard", *order)
    values.select("shard", "value").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("shard").text(f"{here}/entities")
    search_index(entities, key, fields).select(F.col("row").alias("value")).write.text(f"{here}/index")
    as_graph(producers, output, seq).write.json(f"{here}/graph")
    _counted(spark, here).write.parquet(f"{here}/counts")
    counts = _counts(spark, here)
    told = counts.agg(F.sum("n_rows").alias("n_entities"), F.count("*").alias("n_shards")).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(version).alias("version"), "n_entities", "n_shards")
    told.coalesce(1).write.json(f"{here}/manifest")

    baseline = spark.read.parquet(f"{before}/snapshot") if before and "snapshot" in _listed(spark, before) else None
    nothing = spark.createDataFrame([], "family string, name string, value long")
    taken = snapshot(entities) if snapshot else nothing
    taken.select("family", "name", F.col("value").cast("long").alias("value")).write.parquet(f"{here}/snapshot")
    where = references if references is not None else spark.createDataFrame([], "group string, n long")
    shape = constraints(entities, checks) if checks else spark.createDataFrame([], "check string, n_failed long")
    verdicts = validated(baseline, spark.read.parquet(f"{here}/snapshot"), where, shape, allow)
    staged = told.select("n_entities").first()[0]
    if staged != entities.count():
        raise GateError(f"{staged} of {entities.count()} entities are staged")
    passed(verdicts)

    old = _counts(spark, before).select("shard", "n_rows").join(counts, "shard", "left_anti") if before else counts.select("shard", "n_rows").limit(0)
    removed = written(old.select(F.lit("removed").alias("part"), F.col("shard").alias("name"), F.col("n_rows"), F.lit(0).cast("long").alias("n_bytes")), "removed")
    files = spark.createDataFrame([(p, p, spark.read.text(f"{here}/{p}").count(), _bytes(spark, f"{here}/{p}")) for p in ("index", "graph", "manifest")], "part string, name string, n_rows long, n_bytes long")
    report = written(counts.select(F.lit("shard").alias("part"), F.col("shard").alias("name"), "n_rows", "n_bytes").unionByName(removed).unionByName(files), "report")
    swap(spark, at, name)
    clean(spark, at)
    return report


def clean(spark: SparkSession, at: str) -> list[str]:
    """Remove all builds but the current one (older ones, and what stopped runs have staged); their names."""
    now = current(spark, at)
    gone = [n for n in _listed(spark, f"{at}/builds") if not now or not now.endswith(n)]
    for n in gone:
        _, path, fs = _fs(spark, f"{at}/builds/{n}")
        fs.delete(path, True)
    for n in _listed(spark, at):
        if n.startswith(".CURRENT-"):
            _, path, fs = _fs(spark, f"{at}/{n}")
            with contextlib.suppress(Exception):  # another run's, just renamed
                fs.delete(path, False)
    return gone


def read_build(spark: SparkSession, at: str, part: str, schema: str, shards: Sequence[str] = ()) -> DataFrame:
    """A part ('entities', 'index', 'graph', 'manifest') of the current build, whose own manifest must say a version that is known;
    of entities named shards alone are read (a shard is a folder)."""
    here = current(spark, at)
    if not here:
        raise BuildError(f"no build in {at}")
    said = spark.read.schema("schema_version int").json(f"{here}/manifest").first()
    if said is None or said[0] != SCHEMA_VERSION:
        raise BuildError(f"schema version {said and said[0]}, not {SCHEMA_VERSION}")
    if part != "entities":
        return spark.read.schema(schema).json(f"{here}/{part}")
    rows = spark.read.text(f"{here}/entities")
    rows = rows.where(F.col("shard").isin(*shards)) if shards else rows
    return rows.select(F.from_json("value", schema).alias("e"), "shard").select("e.*", "shard")
