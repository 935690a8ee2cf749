"""Row classification with a reject ledger, first-wins dedup, representatives, packed variants, grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASON = "reject_reason"


def classify(df: DataFrame, rules: Sequence[tuple[str, Column]], reason: str = REASON) -> DataFrame:
    """The first rule that holds names why a row is rejected; null where none does.  A rule that is null does not hold."""
    chain = reduce(lambda c, r: c.when(r[1], F.lit(r[0])) if c is not None else F.when(r[1], F.lit(r[0])), rules, None)
    return df.withColumn(reason, F.lit(None).cast("string") if chain is None else chain)


def split(df: DataFrame, rules: Sequence[tuple[str, Column]], reason: str = REASON) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and the ledger of the others with their reasons."""
    made = classify(df, rules, reason)
    return made.where(F.col(reason).isNull()).drop(reason), made.where(F.col(reason).isNotNull())


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], conflict: Column | None = None) -> DataFrame:
    """One row a key, the first by ``order`` (the last of which must be unique), with ``n_rows`` and ``n_kinds``, the
    number of distinct values of ``conflict``.  Aggregated map-side, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    counts = [F.count("*").alias("n_rows")] + ([F.count_distinct(conflict).alias("n_kinds")] if conflict is not None else [])
    made = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"), *counts)
    return made.select(*keys, *(F.col(f"__first.{c}").alias(c) for c in rest), "n_rows", *(["n_kinds"] if conflict is not None else []))


def first_of_text(df: DataFrame, text: str, order: Sequence[str], conflict: Column | None = None) -> DataFrame:
    """``first_wins`` for a key of long texts: 256 bits of the text move in its place, and it is left out of the result."""
    made = df.withColumn("__digest", F.sha2(text, 256)).drop(text)
    return first_wins(made, ["__digest"], order, conflict).drop("__digest")


def representative(df: DataFrame, keys: Sequence[str], value: str, preferred: Column) -> DataFrame:
    """The value of a preferred row of each group if there is one, else the smallest."""
    return df.groupBy(*keys).agg(F.coalesce(F.max(F.when(preferred, F.col(value))), F.min(value)).alias(value))


def variants(df: DataFrame, columns: Sequence[str], mark: str = ";") -> DataFrame:
    """One row for each of the values packed into ``columns``, numbered by ``variant`` from 1.  A column of one value holds for
    all variants; ``ragged`` marks the rows (left whole) in which the numbers of values do not agree."""
    parts = {c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), mark), lambda v: F.trim(v)) for c in columns}
    made = df.select("*", *(p.alias(f"__{c}") for c, p in parts.items()))
    n = F.greatest(F.lit(1), *(F.size(f"__{c}") for c in columns))
    fits = reduce(Column.__and__, [(F.size(f"__{c}") == 1) | (F.size(f"__{c}") == n) for c in columns])
    made = made.withColumn("ragged", ~fits).select("*", F.explode(F.sequence(F.lit(1), F.when(fits, n).otherwise(F.lit(1)))).alias("variant"))
    pick = lambda c: F.when(F.col("ragged"), F.col(c)).when(F.size(f"__{c}") == 1, F.element_at(f"__{c}", 1)).otherwise(F.element_at(f"__{c}", F.col("variant")))
    return made.select(*(pick(c).alias(c) if c in columns else F.col(c) for c in df.columns), "variant", "ragged")


def grid_cells(df: DataFrame, pattern: str, key: Sequence[str]) -> DataFrame:
    """key, row, col, symbol of the occupied cells of an array of strings (a shaped pattern; blanks are empty)."""
    lines = df.select(*key, F.posexplode(pattern).alias("row", "__line"))
    cells = lines.select(*key, "row", F.posexplode(F.split("__line", "")).alias("col", "symbol"))
    return cells.where(F.trim("symbol") != "")


def trimmed(cells: DataFrame, key: Sequence[str]) -> DataFrame:
    """The cells moved to the corner of their bounding box, with its height and width.  Boxes are as many as keys: by the size of their
    files Spark takes them (or the cells) for small enough to broadcast, so the join says that it is none of these."""
    box = cells.groupBy(*key).agg(F.min("row").alias("__r"), F.min("col").alias("__c"), (F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"))
    return cells.join(box.hint("merge"), list(key)).select(*key, (F.col("row") - F.col("__r")).alias("row"), (F.col("col") - F.col("__c")).alias("col"), "symbol", "height", "width")


def prefer(values: Column, keep) -> Column:
    """The array's values that ``keep`` holds for, or all of them where it holds for none."""
    some = F.filter(values, keep)
    return F.when(F.size(some) > 0, some).otherwise(values)
