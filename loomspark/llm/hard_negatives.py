"""Hard negatives by one-dimensional distance keys: an index on (pivot, distance), searched in growing annuli.

Vectors become integers (floor(``scale`` x)); a score is an inner product.  Each vector v is augmented by sqrt(M**2 - |v|**2), M the
largest norm, and a query by 0: then distance**2 = |q|**2 + M**2 - 2 score, so the nearest rows are those of the highest scores.
Pivots are chosen by farthest-first from ``SAMPLE`` rows (those of the smallest hash of their id); every row of the table is in the
index: stored sorted by (nearest pivot, distance to it), in blocks of ``BLOCK`` rows with the ends of their key interval.

A search asks, for each query, the blocks whose interval meets [d - r, d + r] around the query's own distance d to their pivot:
all others are farther than r by the triangle inequality.  Then r grows, and only what is new is read.  A query is done when its
last wanted distance (or the distance of the lowest score it may still use) is within r: that bound certifies its results, ties
included.  Queries go in blocks too, so a task multiplies a block of rows by a block of queries; who meets whom is a join of
two small tables of intervals, and what is kept of each meeting is a few rows a query.

Scores are exact: products in doubles where they are below 2**53, in Python's integers where not.  Distances carry a slack far above
their rounding.  A score that is returned and passes 64 bits raises.

Defined cases: rows without an id, a label or a vector, or with a null or non-finite component take no part; shorter vectors count
as padded with zeros; rows that repeat take a place each, as rows of their own, but an anchor that repeats wholly is answered once,
and rows with an anchor's id are never its positives or negatives; an anchor without positives, or a positive without negatives,
gives no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows that pivots are chosen from, pivots at most, rows of a block of the index, queries of a block.
SAMPLE, PIVOTS, BLOCK, QUERIES = 4096, 32, 512, 256
#: Relative slack of distances; how the radius grows while a query lacks results; rounds of growth before it takes in all.
SLACK, GROWTH, ROUNDS = 1e-7, 1.5, 4
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_QUERY = "qid binary, id long, label long, v array<double>, norm double, ceilings array<long>, floors array<long>, before double, r double"


def prepared(rows: DataFrame, id_col: str, vector: str, label: Column, scale: int) -> DataFrame:
    """id, label, v (integers as doubles) and norm (squared) of the rows that take part."""
    kept = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector).isNotNull())
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    # from 2**53 on doubles are whole, and longs may not hold them
    whole = F.transform(x, lambda c: F.when(F.abs(c * scale) < 2.0**53, F.floor(c * scale).cast("double")).otherwise(c * scale))
    made = kept.where(sound).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))
    return made.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """List arrays as the rows of a matrix, padded with zeros."""
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    n = np.diff(offsets)
    out = np.zeros((len(n), width))
    if out.size and (n == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width).astype(np.float64)
    at = np.repeat(np.arange(len(n)), n)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)] = values[offsets[0] : offsets[-1]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows whose components are integers."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)))
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).dot(whole(b).T)


class Pivots:
    """Pivots of augmented vectors, and distances to them."""

    def __init__(self, vectors: np.ndarray, largest: float):
        self.largest = largest  # squared
        self.at = vectors
        self.tail = np.sqrt(np.maximum(0.0, largest - (vectors**2).sum(1)))

    @classmethod
    def chosen(cls, sample: np.ndarray, largest: float, most: int) -> Pivots:
        """Farthest first, beginning at the first row; equal vectors are chosen once."""
        every, picked = cls(sample, largest), [0]
        least = every.one(sample, every.tail, 0)
        while len(picked) < min(most, len(sample)) and least.max() > 0:
            picked.append(int(least.argmax()))
            least = np.minimum(least, every.one(sample, every.tail, picked[-1]))
        return cls(sample[picked], largest)

    def one(self, v: np.ndarray, tail: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt(((v - self.at[k]) ** 2).sum(1) + (tail - self.tail[k]) ** 2)

    def rows(self, v: np.ndarray) -> np.ndarray:
        """Distances of data rows to all pivots."""
        tail = np.sqrt(np.maximum(0.0, self.largest - (v**2).sum(1)))
        return np.stack([self.one(v, tail, k) for k in range(len(self.at))], 1)

    def queries(self, v: np.ndarray) -> np.ndarray:
        """Distances of queries, whose augmented component is 0."""
        return np.stack([self.one(v, np.zeros(len(v)), k) for k in range(len(self.at))], 1)

    def slack(self) -> float:
        return SLACK * (1.0 + np.sqrt(self.largest))


def _meet(b: pa.RecordBatch, pivots: Pivots, width: int, best: int, same: bool) -> pa.RecordBatch | None:
    """A block of queries and one of rows: what each query takes in anew."""
    pivot, low, high = (b.column(k)[0].as_py() for k in range(3))
    members, slack = b.column(7).flatten(), pivots.slack()
    q = matrix(members.field("v"), width)
    d = np.abs(pivots.one(q, np.zeros(len(q)), pivot))
    reach = lambda r: (low <= d + r + slack) & (high >= d - r - slack)
    before, r = members.field("before").to_numpy(), members.field("r").to_numpy()
    new = np.flatnonzero(reach(r) & ~((before >= 0) & reach(before)))
    if not len(new):
        return None
    ids, labels = (np.frombuffer(b.column(k)[0].as_py(), "<i8") for k in (3, 4))
    kind = np.float64 if b.column(6)[0].as_py() else np.float32
    vectors = np.frombuffer(b.column(5)[0].as_py() or b"", kind).reshape(len(ids), width).astype(np.float64)
    scores = products(q[new], vectors)
    own_ids, own_labels = members.field("id").to_numpy()[new][:, None], members.field("label").to_numpy()[new][:, None]
    open_ = (own_ids != ids[None, :]) & ((own_labels == labels[None, :]) == same)
    qids, out = members.field("qid").take(pa.array(new)), []
    ceilings, floors = (members.field(c).take(pa.array(new)).to_pylist() for c in ("ceilings", "floors"))
    for t in range(max(map(len, ceilings))):
        top = np.array([c[t] if t < len(c) else _LOW for c in ceilings], dtype=scores.dtype if scores.dtype == object else np.int64)[:, None]
        low_s = np.array([c[t] if t < len(c) else _HIGH for c in floors], dtype=scores.dtype if scores.dtype == object else np.int64)[:, None]
        fits = open_ & np.asarray(scores <= top, bool) & np.asarray(scores >= low_s, bool)
        row, col = np.nonzero(fits)
        if not len(row):
            continue
        found = scores[row, col]
        if found.dtype == object:
            order = np.array(sorted(range(len(row)), key=lambda k: (row[k], -found[k], ids[col[k]])))
        else:
            order = np.lexsort((ids[col], -found, row))
        row, col, found = row[order], col[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < best
        out.append((row[keep], np.full(keep.sum(), t, np.int32), pa.array([int(s) for s in found[keep]], pa.int64()), ids[col[keep]]))
    if not out:
        return None
    column = lambda k: np.concatenate([x[k] for x in out])
    return pa.RecordBatch.from_arrays([qids.take(pa.array(column(0))), pa.array(column(1)), pa.concat_arrays([x[2] for x in out]), pa.array(column(3))], names=["qid", "target", "score", "id"])


class Index:
    """The stored blocks, and what is needed to search them."""

    def __init__(self, rows: DataFrame):
        """``rows``: as ``prepared`` makes them, written (they are read several times)."""
        first = rows.agg(F.max("norm").alias("largest"), F.max(F.size("v")).alias("width")).first()
        self.empty = first["largest"] is None
        if self.empty:
            return
        self.width = width = first["width"]
        held = rows.orderBy(F.xxhash64("id"), "id", "label", F.xxhash64("v")).limit(SAMPLE).select("v").toArrow()
        sample = matrix(held["v"].combine_chunks(), width)
        self.pivots = pivots = Pivots.chosen(sample, float(first["largest"]), PIVOTS)
        self.near = self._spacing(sample)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = pivots.rows(matrix(b.column(2), width))
                nearest = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest]), b.column(0), b.column(1), b.column(2)], names=["pivot", "d", "id", "label", "v"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            name, made = TaskContext.get().partitionId() << 32, 0
            for b in batches:
                pivot = b.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
                for a, z in ((i, min(i + BLOCK, z)) for a, z in zip(edges[:-1], edges[1:], strict=True) for i in range(a, z, BLOCK)):
                    v, d = matrix(b.column(4).slice(a, z - a), width), b.column(1).slice(a, z - a).to_numpy()
                    small = np.float32 if np.abs(v).max(initial=0) <= 1 << 24 else np.float64
                    ids, labels = (b.column(k).slice(a, z - a).to_numpy().astype("<i8").tobytes() for k in (2, 3))
                    yield pa.RecordBatch.from_pydict({"block": [name | made], "pivot": pa.array([int(pivot[a])], pa.int32()), "low": [float(d[0])], "high": [float(d[-1])], "ids": [ids], "labels": [labels], "vectors": [v.astype(small).tobytes()], "wide": [small is np.float64]})
                    made += 1

        keyed = rows.select("id", "label", "v").mapInArrow(assign, "pivot int, d double, id long, label long, v array<double>")
        dealt = keyed.repartitionByRange("pivot", "d", "id").sortWithinPartitions("pivot", "d", "id")
        self.blocks = common.written(dealt.mapInArrow(common.released(pack), "block long, pivot int, low double, high double, ids binary, labels binary, vectors binary, wide boolean"), "distance-blocks")

    def _spacing(self, sample: np.ndarray) -> float:
        """Where a search begins: the median distance of some of the sample, as queries, to their nearest of the rest."""
        some = sample[:64]
        norms = (some**2).sum(1)
        best = np.partition((some @ sample.T).astype(float), -min(2, len(sample)), 1)[:, -min(2, len(sample))]
        return float(np.median(np.sqrt(np.maximum(0.0, norms + self.pivots.largest - 2 * best)))) + self.pivots.slack()

    def distance(self, norm: Column, score: Column) -> Column:
        """Distance of a score to a query of this squared norm, with the slack."""
        return F.sqrt(F.greatest(F.lit(0.0), norm + F.lit(self.pivots.largest) - 2 * score.cast("double"))) + F.lit(self.pivots.slack())

    def everything(self, norm: Column) -> Column:
        """A radius that takes in all rows."""
        return 2 * (F.sqrt(norm) + F.lit(float(np.sqrt(self.pivots.largest)))) + F.lit(2 * self.pivots.slack())

    def met(self, queries: DataFrame, best: int, same: bool) -> DataFrame:
        """qid, target, score and id of the ``best`` rows for each query and target within what its radius takes in anew."""
        pivots, width, slack = self.pivots, self.width, self.pivots.slack()

        def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                members = b.column(1)
                for i in range(len(b)):
                    own = members.slice(i, 1).flatten()
                    d, r = pivots.queries(matrix(own.field("v"), width)), own.field("r").to_numpy()[:, None] + slack
                    n = len(pivots.at)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array((d - r).min(0)), pa.array((d + r).max(0))], names=["group", "pivot", "least", "most"])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(len(b)):
                    got = _meet(b.slice(i, 1), pivots, width, best, same)
                    if got is not None:
                        yield got

        pivots_only = self.blocks.select("block", "pivot", "low", "high")
        packed = common.written(queries.groupBy("group").agg(F.collect_list(F.struct(*(c.split()[0] for c in _QUERY.split(", ")))).alias("members")), "query-blocks")
        asked = packed.mapInArrow(spans, "group string, pivot int, least double, most double")
        pairs = asked.join(pivots_only, "pivot").where((F.col("low") <= F.col("most")) & (F.col("high") >= F.col("least"))).select("group", "block")
        work = pairs.join(self.blocks, "block").join(packed, "group").select("pivot", "low", "high", "ids", "labels", "vectors", "wide", "members")
        return work.mapInArrow(common.released(scan), "qid binary, target int, score long, id long")

    def search(self, queries: DataFrame, best: int, same: bool, name: str) -> DataFrame:
        """qid, target, place, score and id: the first ``best`` rows for each query and target.

        ``queries``: group (a block of queries), qid, id, label, v, norm, r (where to begin), ceilings and floors (scores of each
        target that count).  ``same``: whether rows of the query's label are sought, or of others."""
        place = Window.partitionBy("qid", "target").orderBy(F.desc("score"), F.asc("id"))
        todo, found = queries.withColumn("before", F.lit(-1.0)), None
        for turn in range(ROUNDS + 2):
            new = self.met(todo, best, same)
            every = new if found is None else found.select("qid", "target", "score", "id").unionByName(new)
            found = common.written(every.withColumn("place", F.row_number().over(place)).where(F.col("place") <= best), f"{name}-{turn}")
            last = found.where(F.col("place") == best).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("target", "score"))).alias("last"))  # a few a query
            # the floor of a target rises to the last score that is held: rows below it can't enter
            held = todo.join(last, "qid", "left")
            floors = F.transform("floors", lambda f, t: F.greatest(f, F.coalesce(F.element_at("last", t.cast("int")), f)))
            held = held.withColumn("floors", floors).drop("last")
            least = F.array_min("floors")
            wide = F.lit(turn >= ROUNDS - 1)
            need = F.when(least > _LOW, self.distance(F.col("norm"), least)).when(wide, self.everything(F.col("norm"))).otherwise(F.least(F.col("r") * GROWTH, self.everything(F.col("norm"))))
            open_ = held.withColumn("need", F.least(need, self.everything(F.col("norm")))).where(F.col("need") > F.col("r"))
            todo = common.written(open_.withColumn("before", F.col("r")).withColumn("r", F.col("need")).drop("need"), f"{name}-open")
            if todo.isEmpty():
                break
        return found


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 5, least: int = 80, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchors`` is a condition on the prepared rows (id, label, v).  The positives of an anchor are the first rows of its label by
    score, then id; the negatives of both are the first rows of other labels with a score of at least ``least`` percent of the
    positive's, and no more than it."""
    spark = common.session_of(rows)
    common.tidy(spark)
    base = common.written(prepared(rows, id_col, vector, F.col(label) if isinstance(label, str) else label, scale), "vectors")
    index = Index(base)
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index.empty:
        return spark.createDataFrame([], shape)
    pivots, width = index.pivots, index.width

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = pivots.queries(matrix(b.column(0), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], names=[*b.schema.names, "pivot", "d"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, done = TaskContext.get().partitionId(), 0
        for b in batches:
            at = (done + np.arange(len(b))) // QUERIES
            done += len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f"{name}-{x}" for x in at])], names=[*b.schema.names, "group"])

    once = base.where(anchors).groupBy("id", "label", "v").agg(F.first("norm").alias("norm"))
    named = once.select("v", "id", "label", "norm", F.unhex(F.md5(F.to_json(F.struct("id", "label", "v")))).alias("qid"))
    kinds = "v array<double>, id long, label long, norm double, qid binary, pivot int, d double"
    dealt = named.mapInArrow(near, kinds).repartitionByRange("pivot", "d", "qid").sortWithinPartitions("pivot", "d", "qid")
    asked = common.written(dealt.mapInArrow(group, kinds + ", group string").drop("pivot", "d"), "anchors")

    free = asked.withColumn("r", F.lit(index.near)).withColumn("ceilings", F.array(F.lit(_HIGH))).withColumn("floors", F.array(F.lit(_LOW)))
    found = index.search(free, positives, True, "positives")
    # scores below zero leave no score between a part of them and them; a floor is the least whole score of that part
    useful = found.where(F.col("score") >= 0)
    targets = useful.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("targets"))
    part = lambda s: F.ceil(s.cast("decimal(19,0)") * least / F.lit(100).cast("decimal(3,0)")).cast("long")
    bound = asked.join(targets, "qid").withColumn("ceilings", F.transform("targets", lambda t: t["score"])).withColumn("floors", F.transform("targets", lambda t: part(t["score"])))
    bound = common.written(bound.withColumn("r", F.least(index.distance(F.col("norm"), F.array_min("ceilings")), index.everything(F.col("norm")))), "targets")
    hard = index.search(bound.drop("targets"), negatives, False, "negatives")
    answers = hard.join(bound.select("qid", F.col("id").alias("anchor_id"), "targets"), "qid").withColumn("t", F.col("targets")[F.col("target")])
    return answers.select("anchor_id", F.col("t.id").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("t.score").alias("positive_score"), F.col("score").alias("negative_score"))
