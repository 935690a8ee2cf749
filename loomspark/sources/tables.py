"""Named tables, conjunctive row queries over them, polymorphic JSON columns, curated documents, archives."""

from __future__ import annotations

import io
import operator
import re
import tarfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
MOST = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class RowQuery:
    """select, conjunctive where, order, limit (5000 at most) and offset over one table; every step gives a new query."""

    fields: tuple[str, ...]
    filters: tuple[tuple[str, str, object], ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    rows: int | None = None
    skip: int = 0
    names: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        for n in (*self.fields, *(f for f, _, _ in self.filters), *(f for f, _ in self.order)):
            if not NAME.fullmatch(n):
                raise ValueError(f"not a column name: {n!r}")
        if not self.fields or self.rows is not None and not 0 < self.rows <= MOST or self.skip < 0:
            raise ValueError("no columns, or a limit or offset out of range")

    def where(self, name: str, *condition: object) -> RowQuery:
        op, value = condition if len(condition) == 2 else ("=", condition[0])
        if op not in OPS:
            raise ValueError(f"unknown comparison {op!r}")
        return replace(self, filters=(*self.filters, (name, op, value)))

    def order_by(self, name: str, descending: bool = False) -> RowQuery:
        return replace(self, order=(*self.order, (name, descending)))

    def limit(self, rows: int) -> RowQuery:
        return replace(self, rows=rows)

    def offset(self, skip: int) -> RowQuery:
        return replace(self, skip=skip)

    def over(self, df: DataFrame) -> DataFrame:
        """The plan: filters and columns reach the scan."""
        for name, op, value in self.filters:
            df = df.where(OPS[op](F.col(name), F.lit(value)))
        if self.order:
            df = df.orderBy(*(F.col(n).desc() if d else F.col(n).asc() for n, d in self.order))
        df = df.offset(self.skip) if self.skip else df
        return (df.limit(self.rows) if self.rows is not None else df).select(*self.fields)


def json_field(doc: Column, path: str, kind: str = "string") -> Column:
    """A value inside a JSON column; null where it is absent or of another kind."""
    return F.get_json_object(doc, path).try_cast(kind)


def curated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A curated document with an explicit schema; what does not parse is kept in ``_corrupt`` for the ledger."""
    return spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def resolve_titles(asked: DataFrame, rewrites: DataFrame, hops: int = 4) -> DataFrame:
    """title, final, n_hops: rewrites (from, to) are followed ``hops`` times at most; a longer way ends in null."""
    out = asked.select("title", F.col("title").alias("final"), F.lit(0).alias("n_hops"))
    step = rewrites.groupBy("from").agg(F.max("to").alias("to"))
    for _ in range(hops):
        joined = out.join(step, out["final"] == step["from"], "left")
        out = joined.select("title", F.coalesce("to", "final").alias("final"), (F.col("n_hops") + F.col("to").isNotNull().cast("int")).alias("n_hops"))
    more = out.join(step, out["final"] == step["from"], "left")
    return more.select("title", F.when(F.col("to").isNull(), F.col("final")).alias("final"), "n_hops")


def archive_members(spark: SparkSession, path: str, prefixes: Sequence[str] = (), most_bytes: int = 256 << 20) -> DataFrame:
    """archive, member, content of the files in tar.gz archives, one task an archive, for the ``prefixes`` below its one root.
    Refuses absolute and climbing names, several roots, doubles, and members over ``most_bytes`` in all."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                rows, roots, total, seen = [], set(), 0, set()
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                    for m in tar:
                        root, _, rest = m.name.partition("/")
                        roots.add(root)
                        if m.name.startswith("/") or ".." in m.name.split("/") or len(roots) > 1 or rest in seen and m.isfile():
                            raise ValueError(f"{at}: refused member {m.name}")
                        if not m.isfile() or prefixes and not rest.startswith(tuple(prefixes)):
                            continue
                        seen.add(rest)
                        total += m.size
                        if total > most_bytes:
                            raise ValueError(f"{at}: over {most_bytes} bytes")
                        rows.append((at, rest, tar.extractfile(m).read()))
                yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, member string, content binary")


def verified(files: DataFrame, digests: DataFrame) -> DataFrame:
    """Files (name, content) whose content has the digest that ``digests`` (name, sha256) states; others are misses."""
    return files.join(digests, "name").where(F.sha2("content", 256) == F.col("sha256")).drop("sha256")


def has_signature(content: Column, signature: bytes) -> Column:
    return F.substring(content, 1, len(signature)) == F.lit(bytearray(signature))


class AnswerError(ValueError):
    """An answer that is not one of rows."""


def answer_rows(answers: DataFrame, schema: str, payload: str = "payload", source: str = "source") -> DataFrame:
    """source, place and the fields of each row of the answers ({"rows": [...]}); a field that is left out is null.  Raises for an
    answer with an error or without rows, which is no empty table."""
    made = answers.select(source, F.from_json(payload, f"error string, rows array<struct<{schema}>>").alias("a"))
    bad = made.where(F.col("a.error").isNotNull() | F.col("a.rows").isNull()).select(source, "a.error").orderBy(source).limit(5).collect()  # names for the message
    if bad:
        raise AnswerError("; ".join(f"{r[0]}: {r[1] or 'no rows'}" for r in bad))
    return made.select(source, F.posexplode("a.rows").alias("place", "r")).select(source, "place", "r.*")


def joined_back(asked: DataFrame, rewrites: DataFrame, answers: DataFrame, hops: int = 4) -> tuple[DataFrame, DataFrame]:
    """What was answered, by the title that was asked for, and the ledger of titles without an answer, with the reason."""
    to = resolve_titles(asked, rewrites, hops)
    both = to.join(answers.withColumnRenamed("title", "final").withColumn("__found", F.lit(True)), "final", "left")
    misses = both.where("__found is null").select("title", F.when(F.col("final").isNull(), "the rewrites lead nowhere").otherwise("no such page").alias("reason"))
    return both.where("__found").drop("__found"), misses


class LoopError(ValueError):
    """Rewrites that do not end."""


def refuse_loops(resolved: DataFrame) -> DataFrame:
    """The titles that ``resolve_titles`` gave, or LoopError if the way of one did not end."""
    bad = resolved.where("final is null").select("title").orderBy("title").limit(5).collect()  # names for the message
    if bad:
        raise LoopError(", ".join(r[0] for r in bad))
    return resolved


def release_order(manifest: DataFrame, doc: str = "doc") -> DataFrame:
    """version, kind and position (0 is the newest) of the releases of a list document; raises if what it calls the latest is no
    release."""
    made = manifest.select(F.from_json(doc, "latest struct<release:string>, versions array<struct<id:string,type:string>>").alias("d"))
    listed = made.select("d.latest.release", F.posexplode("d.versions").alias("position", "v")).select("release", "position", F.col("v.id").alias("version"), F.col("v.type").alias("kind"))
    if listed.where("version = release and kind = 'release'").isEmpty():
        raise ValueError("the latest release is not in the list of releases")
    return listed.select("version", "kind", "position")


def stale(curated_rows: DataFrame, releases: DataFrame, current: str) -> DataFrame:
    """The curated rows (with verified_for, a version) and whether they were checked for an older release than the current one;
    a version that is not in the list is stale."""
    at = releases.select(F.col("version").alias("verified_for"), "position")
    now = releases.where(F.col("version") == current).select(F.col("position").alias("__now"))  # one row
    return curated_rows.join(at, "verified_for", "left").join(F.broadcast(now), how="cross").withColumn("stale", F.coalesce(F.col("position") > F.col("__now"), F.lit(True))).drop("position", "__now")


def by_reference(sources: DataFrame, key: str, references: str) -> DataFrame:
    """Each reference of a source (an array) with the keys of its sources, in order."""
    each = sources.select(key, F.explode(references).alias("reference"))
    return each.groupBy("reference").agg(F.array_sort(F.collect_set(key)).alias("sources"))


def checked_objects(wanted: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the wanted (name, sha256), those that the store (sha256, content) holds unharmed, and the misses: absent or corrupt."""
    joined = wanted.join(stored.select("sha256", "content"), "sha256", "left")
    good = F.col("content").isNotNull() & (F.sha2("content", 256) == F.col("sha256"))
    return joined.where(good), joined.where(~good).select("name", "sha256", F.when(F.col("content").isNull(), "absent").otherwise("corrupt").alias("reason"))


def image_failures(files: DataFrame, signature: bytes) -> DataFrame:
    """name and reason of the files (name, content, size, sha1) that are not what was promised; the first reason holds."""
    why = F.when(~has_signature(F.col("content"), signature), "signature").when(F.octet_length("content") != F.col("size"), "size").when(F.sha1("content") != F.col("sha1"), "digest")
    return files.select("name", why.alias("reason")).where("reason is not null")
