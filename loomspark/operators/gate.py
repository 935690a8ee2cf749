"""Snapshots of a build, the difference of two, and the checks that stop a worse one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A build that may not go out."""


def snapshot(df: DataFrame, kind: str, fields: Sequence[str]) -> DataFrame:
    """metric, value: the total, one count a kind, and how many rows have each field.  One pass and one row a kind."""
    by = df.groupBy(kind).agg(F.count("*").alias("n"), *(F.count(f).alias(f"__{f}") for f in fields))
    kinds = by.select(F.concat(F.lit("kind:"), F.coalesce(F.col(kind), F.lit("none"))).alias("metric"), F.col("n").alias("value"))
    totals = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *(F.coalesce(F.sum(f"__{f}"), F.lit(0)).alias(f"field:{f}") for f in fields))
    names = ["total", *(f"field:{f}" for f in fields)]
    return totals.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names)))).unionByName(kinds)


def regression(baseline: DataFrame, new: DataFrame, percent: int = 5, least: int = 3, required: Sequence[str] = ()) -> DataFrame:
    """metric, before, after, dropped and verdict ('pass', or what is wrong) for each metric of the baseline.

    A drop fails if 100 * dropped > percent * before and at least ``least`` are lost (whole numbers, no rounding); a kind
    may not vanish; fields in ``required`` must be present in all rows."""
    joined = baseline.select("metric", F.col("value").alias("before")).join(new.select("metric", F.col("value").alias("after")), "metric", "left").withColumn("after", F.coalesce("after", F.lit(0)))
    total = new.where("metric = 'total'").select(F.col("value").alias("__total"))  # one row
    joined = joined.join(F.broadcast(total), how="left") if required else joined
    dropped = F.greatest(F.col("before") - F.col("after"), F.lit(0))
    chain = F.when((F.col("before") > 0) & (F.col("after") == 0), "vanished")
    if required:
        chain = chain.when(F.col("metric").isin([f"field:{f}" for f in required]) & (F.col("after") < F.col("__total")), "incomplete")
    verdict = chain.when((F.col("before") > 0) & (100 * dropped > percent * F.col("before")) & (dropped >= least), "dropped").otherwise("pass")
    return joined.select("metric", "before", "after", dropped.alias("dropped"), verdict.alias("verdict"))


def diff(before: DataFrame, after: DataFrame, key: str, kind: str) -> DataFrame:
    """kind, before, after, net, added, removed for each kind and, as '(total)', all."""
    both = before.select(F.col(key).alias("__b"), F.col(kind).alias("__bk")).join(after.select(F.col(key).alias("__a"), F.col(kind).alias("__ak")), F.col("__b") == F.col("__a"), "full_outer")
    rows = both.select(F.coalesce("__bk", "__ak", F.lit("none")).alias("kind"), F.col("__b").isNotNull().cast("int").alias("b"), F.col("__a").isNotNull().cast("int").alias("a"))
    sums = rows.rollup("kind").agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.sum(F.col("a") * (1 - F.col("b"))).alias("added"), F.sum(F.col("b") * (1 - F.col("a"))).alias("removed"))
    return sums.select(F.coalesce("kind", F.lit("(total)")).alias("kind"), "before", "after", (F.col("after") - F.col("before")).alias("net"), "added", "removed")


def references(rejects: DataFrame, reason: str, benign: Sequence[tuple[str, Column]]) -> DataFrame:
    """``group`` and count of rejected rows: the first benign group that holds, or 'failure'."""
    chain = F.lit("failure")
    for name, rule in reversed(benign):
        chain = F.when(rule, name).otherwise(chain)
    return rejects.select(chain.alias("group")).groupBy("group").agg(F.count("*").alias("n"))


def constraints(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """check, n_failed: how many rows break each; a check that is null is broken."""
    made = df.agg(*(F.coalesce(F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)), F.lit(0)).alias(n) for n, c in checks))
    return made.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("n_failed")) for n, _ in checks))))


def passed(verdicts: DataFrame, allow: bool = False) -> DataFrame:
    """``verdicts`` again, or GateError with the first failures in it."""
    bad = verdicts.where("verdict <> 'pass'").orderBy("metric").limit(20).collect()  # a report of at most 20 lines
    if bad and not allow:
        raise GateError("; ".join(f"{r.metric}: {r.verdict} ({r.before} to {r.after})" for r in bad))
    return verdicts


def build_snapshot(df: DataFrame, kind: str, required: Sequence[str], optional: Sequence[str], sections: str, producers: DataFrame, icon: str) -> DataFrame:
    """family, name and value of all that the gate compares: total, kinds, coverage of required and optional fields, section types
    (an array column), producers and icons."""
    by = df.groupBy(kind).agg(F.count("*").alias("total"), F.count(icon).alias("icons"), *(F.count(f).alias(f"__{f}") for f in (*required, *optional)))
    kinds = by.select(F.lit("kind").alias("family"), F.coalesce(F.col(kind), F.lit("none")).alias("name"), F.col("total").alias("value"))
    fields = [("total", "total", "total"), ("icons", "icons", "icons"), *(("required", f, f"__{f}") for f in required), *(("optional", f, f"__{f}") for f in optional)]
    sums = by.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in dict.fromkeys(c for _, _, c in fields)))
    whole = sums.select(F.inline(F.array(*(F.struct(F.lit(a).alias("family"), F.lit(n).alias("name"), F.col(f"`{c}`").alias("value")) for a, n, c in fields))))
    types = df.select(F.explode(sections).alias("name")).groupBy("name").agg(F.count("*").alias("value")).select(F.lit("section").alias("family"), "name", "value")
    made = producers.agg(F.count("*").alias("value")).select(F.lit("producers").alias("family"), F.lit("producers").alias("name"), "value")
    return whole.unionByName(kinds).unionByName(types).unionByName(made)


def gate_checks(baseline: DataFrame | None, new: DataFrame, percent: int = 5, least: int = 3, points: float = 5.0, allow: bool = False) -> DataFrame:
    """family, name, before, after, verdict of every check; of ``allow``ed failures the verdict is 'allowed'.

    Drops are compared in whole numbers (100 * lost > percent * before).  Total, producers and icons may not drop by more than
    that, a kind not unless it loses ``least`` at least; kinds and sections may not vanish; a required field covers all rows;
    an optional one loses at most ``points`` percent points.  Without a baseline there is nothing to check."""
    if baseline is None:
        return new.where("false").select("family", "name", F.col("value").alias("before"), F.col("value").alias("after"), F.lit("pass").alias("verdict"))
    totals = baseline.where("family = 'total'").select(F.col("value").alias("__b")).join(new.where("family = 'total'").select(F.col("value").alias("__a")), how="cross")  # one row each
    both = baseline.select("family", "name", F.col("value").alias("before")).join(new.select("family", "name", F.col("value").alias("after")), ["family", "name"], "left").withColumn("after", F.coalesce("after", F.lit(0)))
    both = both.join(F.broadcast(totals), how="cross")
    lost = F.col("before") - F.col("after")
    fell = (F.col("before") > 0) & (100 * lost > percent * F.col("before"))
    share = lambda n, total: F.when(total > 0, 100.0 * n / total).otherwise(0.0)
    gone = (F.col("before") > 0) & (F.col("after") == 0)
    family = F.col("family")
    verdict = (
        F.when(family.isin("kind", "section") & gone, "vanished")
        .when((family == "kind") & fell & (lost >= least), "dropped")
        .when(family.isin("total", "producers", "icons") & fell, "dropped")
        .when((family == "required") & ((F.col("__a") == 0) | (F.col("after") < F.col("__a"))), "incomplete")
        .when((family == "optional") & (share(F.col("before"), F.col("__b")) - share(F.col("after"), F.col("__a")) > points), "less covered")
    )
    return both.select("family", "name", "before", "after", F.when(verdict.isNotNull(), F.lit("allowed") if allow else verdict).otherwise("pass").alias("verdict"))


def failures(df: DataFrame, document: str, key: str, checks: Sequence[tuple[str, Column]], most: int = 20) -> tuple[DataFrame, DataFrame]:
    """document, key and pointer of the first ``most`` broken constraints (pointer, condition; null is broken), and how many more there
    are: a report, whose limit is what it is for."""
    found = df.select(F.lit(document).alias("document"), F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(p)) for p, c in checks)))).alias("pointer"))
    shown = found.orderBy("key", "pointer").limit(most)
    return shown, found.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("truncated"))


def change_lists(before: DataFrame, after: DataFrame, key: str, name: str, most: int = 50) -> DataFrame:
    """change ('added', 'removed'), place and line of the ids of one table alone: the first ``most`` and then how many more."""
    from .ordered import numbered

    sides = [("added", after, before), ("removed", before, after)]
    rows = None
    for change, here, there in sides:
        alone = here.join(there.select(key), key, "left_anti").select(F.lit(change).alias("change"), F.col(key).alias("__id"), F.col(name).cast("string").alias("__name"))
        rows = alone if rows is None else rows.unionByName(alone)
    n = numbered(rows, ["change"], ["__id"], "place")
    lines = n.where(F.col("place") <= most).select("change", "place", F.concat(F.coalesce("__name", F.lit("?")), F.lit(" ("), F.col("__id").cast("string"), F.lit(")")).alias("line"))
    more = n.groupBy("change").agg(F.count("*").alias("n")).where(F.col("n") > most).select("change", F.lit(most + 1).cast("long").alias("place"), F.concat(F.lit("... and "), (F.col("n") - most).cast("string"), F.lit(" more")).alias("line"))
    return lines.withColumn("place", F.col("place").cast("long")).unionByName(more)


def rebuild_owed(manifest: DataFrame, releases: DataFrame) -> DataFrame:
    """version, current and owed: whether the built version stands below the current one in the list of releases (position 0 is the
    newest); null where the list does not have it."""
    listed = manifest.join(releases.select("version", "position"), "version", "left")
    current = releases.agg(F.min_by("version", "position").alias("current"), F.min("position").alias("__p"))  # one row
    return listed.join(F.broadcast(current), how="cross").select("version", "current", (F.col("position") > F.col("__p")).alias("owed"))
