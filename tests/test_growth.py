"""What must not grow with the rows: repeated expressions, tasks that stay few, tables brought to the driver."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from loomspark.functions import editions
from loomspark.operators import loot, noise, ordered, rows
from loomspark.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_a_line_is_classified_by_each_expression_once(spark):
    # before, the expression held its parts again wherever it named them: over a thousand patterns for a line
    made = spark.createDataFrame([("'''In {{JE}}:'''",), (None,)], "line string").select(editions.classified(F.col("line")).alias("c"))
    assert plan(made, "analyzed").count("regexp") < 60
    assert [tuple(r.c) for r in made.collect()] == [("region", "first", None), ("unmarked", None, None)]


def test_what_ranges_carry_over_is_no_row_a_group(spark, monkeypatch):
    # before, every group of a range was joined back by a shuffle; only groups that go on in the next range say anything
    df = spark.range(3000).selectExpr("id div 3 as g", "id", "if(id % 7 = 0, 'a', if(id % 11 = 0, 'b', null)) as kind")
    dealt, n = [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    join = ordered._with_earlier
    monkeypatch.setattr(ordered, "_with_earlier", lambda within, earlier, group, carried: dealt.append(earlier.where(F.col(carried).isNotNull()).count()) or join(within, earlier, group, carried))
    k = F.col("kind")
    got = ordered.scope_fills(df, ["g"], ["id"], {"x": (k == "a", k == "b", F.col("id")), "y": (k == "b", F.lit(False), F.col("id"))})
    assert dealt[0] < n
    want, last = {}, {}
    for i in range(3000):
        x, y = last.get(i // 3, (None, None))
        a, b = i % 7 == 0, i % 11 == 0 and i % 7
        x, y = i if a else None if b else x, i if b else y
        want[i] = last[i // 3] = (x, y)
    assert {r.id: (r.x, r.y) for r in got.collect()} == want
    assert {r.id: r.n for r in ordered.numbered(df, ["g"], ["id"]).collect()} == {i: i % 3 + 1 for i in range(3000)}


def test_boxes_of_grids_are_not_broadcast(spark):
    # before, a million boxes of a table of 5 MB went through the driver
    cells = rows.grid_cells(spark.createDataFrame([(1, [" #X", "# X"]), (2, [" A"])], "k long, pattern array<string>"), "pattern", ["k"])
    made = rows.trimmed(cells, ["k"])
    assert sorted(map(tuple, made.collect())) == [(1, 0, 1, "#", 2, 3), (1, 0, 2, "X", 2, 3), (1, 1, 0, "#", 2, 3), (1, 1, 2, "X", 2, 3), (2, 0, 0, "A", 1, 1)]
    assert "Broadcast" not in plan(made)


@pytest.mark.parametrize("name", ["wiki_table", "template_fields", "edition_fields", "aliases"])
def test_rows_of_a_small_file_are_dealt_out(spark, name):
    # before, one task did all the work of a file of a few MB
    assert queries.QUERIES[name](spark, SF).rdd.getNumPartitions() > 1


def test_tables_of_pages_are_read_by_many_tasks(spark, monkeypatch):
    tasks, write = {}, noise.written
    monkeypatch.setattr(noise, "written", lambda df, name: tasks.update({name: df.rdd.getNumPartitions()}) or write(df, name))
    queries.QUERIES["noise_missing"](spark, SF)
    assert min(tasks["sections"], tasks["tables"]) > 1


def test_tables_of_pages_do_not_go_through_the_driver(spark, monkeypatch):
    plans, write = {}, noise.written
    monkeypatch.setattr(noise, "written", lambda df, name: plans.update({name: plan(df)}) or write(df, name))
    queries.QUERIES["noise_placements"](spark, SF)
    assert "BroadcastHashJoin" not in plans["tables"] + plans["inland"] + plans["grouped"]


@pytest.fixture
def loot_writes(monkeypatch):
    """Tasks of each table that the loot operators write."""
    tasks, write = [], loot.written
    monkeypatch.setattr(loot, "written", lambda df, name: tasks.append((name, df.rdd.getNumPartitions())) or write(df, name))
    return tasks


def test_leaves_of_loot_need_no_shuffle(spark, loot_writes):
    # before, two tasks parsed all documents, and all leaves were dealt out by their conditions, which are a few texts, and by path
    got = queries.QUERIES["loot_walk"](spark, SF)
    assert loot_writes[0] == ("loot", int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert "Exchange hashpartitioning" not in plan(got) and "SortMergeJoin" not in plan(got)


@pytest.mark.parametrize("few", [loot.FEW if hasattr(loot, "FEW") else 0, -1])
def test_odd_entries_and_modifiers_of_loot(spark, monkeypatch, few):
    # conditions and modifiers that are too many to broadcast give the same, as does a list with what is no object
    monkeypatch.setattr(loot, "FEW", few)
    doc = '{"pools": [{"rolls": {"min": 1, "max": 3}, "condition": "shears", "entries": [5, {"type": "item", "name": "a", "weight": 3, "modifier": ["x", {"function": "set_count", "count": 2}]}, {"type": "group", "children": ["x", {"type": "item", "name": "b", "condition": "silk", "modifier": {"type": "set_count", "count": {"min": 0, "max": 2}}}]}]}, {"entries": [{"type": "item", "name": "c"}]}]}'
    names = spark.createDataFrame([("shears", '{"type": "match_tool", "predicate": {"items": "ns:shears"}}')], "name string, doc string")
    leaves, _ = loot.walk(spark.createDataFrame([("t", doc)], "table string, doc string"), names)
    assert sorted(map(tuple, leaves.select("path", "item", "count_min", "count_max", "gate", "chance", "rolls").collect())) == [("0.1", "a", 2, 2, "shears", 0.6, 2.0), ("0.2.1", "b", 1, 2, "shears", None, None), ("1.0", "c", 1, 1, None, 1.0, 1.0)]


def test_documents_of_loot_are_made_once(spark, loot_writes):
    # before, they were made once for the check of families, once for the walk and once more for a join with their method
    got = queries.QUERIES["extract_loot"](spark, SF)
    assert [n for n, _ in loot_writes][:2] == ["tables", "loot"] and loot_writes[0][1] > 1
    assert "collect_list" not in plan(got) and "SortMergeJoin" not in plan(got)


def test_entries_that_are_skipped_need_no_conditions(spark, loot_writes):
    # before, the documents were those of two tasks
    queries.QUERIES["loot_skipped"](spark, SF)
    assert {n for n, _ in loot_writes} == {"loot"} and loot_writes[0][1] > 1
