"""The two phases of a build: what is refused, what a stopped run leaves, what readers see."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from loomspark.operators import build, gate

SHAPE = "id string, kind string, name string, icon string"


def rows(spark, n, kinds="ab", icon="i"):
    return spark.createDataFrame([(f"e{i:03}", kinds[i % len(kinds)], f"Name {i}", icon) for i in range(n)], SHAPE)


def emit(spark, at, entities, **more):
    producers = spark.createDataFrame([("e000", 1, "m"), ("e000", 0, "k"), ("e001", 0, "m")], "output string, seq int, method string")
    return {(r.part, r.name): r for r in build.emit_build(entities, producers, at, "1.0", "id", "kind", ["id"], ["name"], "output", "seq", **more).collect()}


def snapshot(df):
    by = df.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("value")).select(F.lit("kind").alias("family"), "name", "value")
    return by.unionByName(df.agg(F.count("*").alias("value")).select(F.lit("total").alias("family"), F.lit("total").alias("name"), "value"))


def seen(spark, at):
    return sorted(r.id for r in build.read_build(spark, at, "entities", SHAPE).collect())


def test_build_and_readers(spark, tmp_path):
    at = str(tmp_path)
    with pytest.raises(build.BuildError):
        build.read_build(spark, at, "index", "id string")
    report = emit(spark, at, rows(spark, 25), size=5)
    assert {k: (r.n_rows, r.n_bytes) for k, r in report.items() if k[0] == "shard"} == {("shard", f"{k}-{i}"): (n, n * len('{"icon":"i","id":"e000","kind":"a","name":"Name 0"}\n') + x) for k, i, n, x in (("a", 0, 5, 0), ("a", 1, 5, 5), ("a", 2, 3, 3), ("b", 0, 5, 0), ("b", 1, 5, 5), ("b", 2, 2, 2))}
    assert report["index", "index"].n_rows == 25 and report["graph", "graph"].n_rows == 2 and report["manifest", "manifest"].n_bytes > 0
    assert seen(spark, at) == [f"e{i:03}" for i in range(25)]
    assert build.read_build(spark, at, "entities", SHAPE, shards=["a-1", "b-2"]).count() == 7
    assert build.read_build(spark, at, "manifest", "version string, n_shards int").first() == ("1.0", 6)
    again = emit(spark, at, rows(spark, 9, "a"), size=5)
    assert {n for p, n in again if p == "removed"} == {"a-2", "b-0", "b-1", "b-2"}
    assert seen(spark, at) == [f"e{i:03}" for i in range(9)] and len(list((tmp_path / "builds").iterdir())) == 1


@pytest.mark.parametrize("gone", ["entities", "counts"])
def test_shards_are_dealt_out_and_counted_once(spark, tmp_path, gone):
    # before, one task wrote all shards of a small table, and the next build listed and read all of their files again
    at = str(tmp_path)
    emit(spark, at, rows(spark, 25), size=5)
    here = next((tmp_path / "builds").iterdir())
    assert len({f.name[:10] for f in (here / "entities").glob("*/part-*")}) > 1
    shutil.rmtree(here / gone)  # a build without counts is one of before
    again = emit(spark, at, rows(spark, 9, "a"), size=5)
    assert {(n, r.n_rows) for (p, n), r in again.items() if p == "removed"} == {("a-2", 3), ("b-0", 5), ("b-1", 5), ("b-2", 2)}


@pytest.mark.parametrize("broken", ["regression", "references", "conformance", "allowed"])
def test_gate_of_three_checks(spark, tmp_path, broken):
    at = str(tmp_path)
    emit(spark, at, rows(spark, 40), snapshot=snapshot)
    less = rows(spark, 20)
    failing = {
        "regression": {"entities": less},
        "references": {"entities": rows(spark, 40), "references": spark.createDataFrame([("failure", 1), ("known", 5)], "group string, n long")},
        "conformance": {"entities": rows(spark, 40, icon=None), "checks": [("icon", F.col("icon").isNotNull())]},
        "allowed": {"entities": less, "allow": True, "references": spark.createDataFrame([("known", 5)], "group string, n long"), "checks": [("name", F.col("name") != "")]},
    }[broken]
    if broken == "allowed":
        emit(spark, at, snapshot=snapshot, **failing)
        assert len(seen(spark, at)) == 20
        return
    with pytest.raises(gate.GateError, match=broken):
        emit(spark, at, snapshot=snapshot, **failing)
    assert len(seen(spark, at)) == 40
    emit(spark, at, rows(spark, 41), snapshot=snapshot)  # what was staged in vain goes
    assert len(seen(spark, at)) == 41 and len(list((tmp_path / "builds").iterdir())) == 1


def test_stopped_between_stage_and_swap(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    emit(spark, at, rows(spark, 10))

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(build, "swap", stop)
    with pytest.raises(KeyboardInterrupt):
        emit(spark, at, rows(spark, 30))
    assert len(seen(spark, at)) == 10 and len(list((tmp_path / "builds").iterdir())) == 2
    monkeypatch.undo()
    emit(spark, at, rows(spark, 30))
    assert len(seen(spark, at)) == 30 and len(list((tmp_path / "builds").iterdir())) == 1


def test_refused(spark, tmp_path):
    at = str(tmp_path)
    for bad in ({"entities": rows(spark, 3).limit(0)}, {"entities": rows(spark, 3), "size": 0}):
        with pytest.raises(build.BuildError):
            emit(spark, at, **bad)
    assert not list(tmp_path.iterdir())
    emit(spark, at, rows(spark, 3))
    folder = next((tmp_path / "builds").iterdir()) / "manifest"
    for f in folder.glob("part-*"):
        f.write_text('{"schema_version": 2}\n')
    for f in folder.glob(".*.crc"):
        f.unlink()
    with pytest.raises(build.BuildError, match="version 2"):
        build.read_build(spark, at, "entities", SHAPE)
