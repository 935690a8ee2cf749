"""Cases that the queries on the driver's tables do not meet: what must raise, empty and null input, hot groups, written output."""

from __future__ import annotations

import io
import json
import random
import tarfile

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from loomspark import session
from loomspark.functions import markup, text
from loomspark.operators import collections, emit, facts, gate, graph, loot, merge, odds, ordered, recipes, resolve, rows, search
from loomspark.sources import tables


def frame(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_closure_raises_on_a_cycle(spark):
    edges = frame(spark, "s string, d string", ("a", "b"), ("b", "c"), ("c", "a"))
    assert graph.closure(edges, "s", "d").count() == 9
    with pytest.raises(graph.CycleError):
        graph.closure(edges, "s", "d", acyclic=True)
    with pytest.raises(graph.CycleError):
        graph.closure(frame(spark, "s int, d int", *((i, i + 1) for i in range(8))), "s", "d", most=3)


def test_ancestry(spark):
    chain = frame(spark, "n int, p int", (0, None), *((i, i - 1) for i in range(1, 300)))
    got = {r.n: (r.depth, r.path) for r in graph.ancestry(chain, "n", "p").collect()}
    assert got[299] == (299, "/".join(map(str, range(300)))) and got[0] == (0, "0") and len(got) == 300
    for bad in ([(1, 2), (2, 1)], [(0, None), (1, 7)], [(0, None), (1, 0), (1, None)]):
        with pytest.raises(graph.CycleError):
            graph.ancestry(frame(spark, "n int, p int", *bad), "n", "p")
    with pytest.raises(graph.CycleError):
        graph.forest(frame(spark, "n string, p string", ("a", "b"), ("b", "a")), "n", "p", F.lit(1), F.col("n"))


def test_title_loops_raise(spark):
    asked = frame(spark, "title string", ("a",), ("x",))
    loop = frame(spark, "from string, to string", ("a", "b"), ("b", "a"))
    with pytest.raises(tables.LoopError):
        tables.refuse_loops(tables.resolve_titles(asked, loop))
    assert tables.refuse_loops(tables.resolve_titles(asked, loop.where("false"))).count() == 2
    _, misses = tables.joined_back(asked, loop, frame(spark, "title string, extract string", ("x", "y")))
    assert [tuple(r) for r in misses.collect()] == [("a", "the rewrites lead nowhere")]


def test_answers_raise(spark):
    for payload in ('{"error": "no"}', '{"other": 1}', "not json"):
        with pytest.raises(tables.AnswerError):
            tables.answer_rows(frame(spark, "source string, payload string", ("s", payload)), "a int")
    assert tables.answer_rows(frame(spark, "source string, payload string", ("s", '{"rows": []}')), "a int").count() == 0
    with pytest.raises(ValueError):
        tables.release_order(frame(spark, "doc string", ('{"latest": {"release": "x"}, "versions": [{"id": "x", "type": "snapshot"}]}',)))


def test_curated_and_archives(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": 1, "name": "a"}, {"id": 2}]))
    got = tables.curated(spark, str(tmp_path / "c.json"), "id int, name string").select("id", "name").collect()
    assert sorted((r.id, r.name) for r in got) == [(1, "a"), (2, None)]

    def archive(name, members):
        with tarfile.open(tmp_path / name, "w:gz") as tar:
            for path, content in members:
                info = tarfile.TarInfo(path)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        return str(tmp_path / name)

    good = archive("good.tar.gz", [("root/data/a.json", b"1"), ("root/data/b.json", b"22"), ("root/other/c", b"3")])
    assert sorted((r.member, bytes(r.content)) for r in tables.archive_members(spark, good, ["data/"]).collect()) == [("data/a.json", b"1"), ("data/b.json", b"22")]
    for name, members in {"climb": [("root/../x", b"1")], "roots": [("a/x", b"1"), ("b/x", b"1")], "double": [("a/x", b"1"), ("a/x", b"2")]}.items():
        with pytest.raises(PythonException):
            tables.archive_members(spark, archive(f"{name}.tar.gz", members)).collect()
    with pytest.raises(PythonException):
        tables.archive_members(spark, good, most_bytes=2).collect()
    ok = tables.verified(frame(spark, "name string, content binary", ("a", b"x"), ("b", b"y")), frame(spark, "name string, sha256 string", ("a", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), ("b", "0")))
    assert [r.name for r in ok.collect()] == ["a"]


def test_loot_raises(spark):
    names = frame(spark, "name string, doc string", ("none", "{}"))
    deep = '{"type": "item", "name": "x"}'
    for _ in range(12):
        deep = '{"type": "group", "children": [' + deep + "]}"
    made = frame(spark, "table string, doc string", ("loot/chests/a", '{"type": "chest", "pools": [{"entries": [' + deep + "]}]}"), ("loot/chests/b", '{"type": "chest"}'))
    with pytest.raises(loot.LootError):
        loot.walk(made, names)
    assert loot.walk(made, names, most=20)[0].count() == 1
    for bad in (("loot/unknown/a", '{"type": "chest"}'), ("loot/chests/a", '{"type": "odd"}')):
        with pytest.raises(loot.LootError):
            loot.readable(frame(spark, "table string, doc string", bad), ["chests"], [], {"chest": "c"})


def test_recipes(spark):
    made = frame(spark, "recipe_id string, doc string", ("a", "not json"), ("b", '{"type": "smelting", "ingredient": ["#t", "x"], "result": {"id": "y"}}'), ("c", '{"type": "smelting", "ingredient": "x", "result": {"id": "y", "count": 0}}'), ("d", '{"type": "smithing_trim"}'))
    assert {r.recipe_id: r.skip for r in recipes.classified(made).collect()} == {"a": "no document or type", "b": None, "c": "no result", "d": "no shape of items"}
    one = recipes.inputs(recipes.producers(made), frame(spark, "tag string, member string", ("t", "m"))).collect()
    assert [(r.recipe_id, r.item, r.mixed) for r in one] == [("b", None, True)]


def test_facts(spark):
    with pytest.raises(facts.FactError):
        facts.drop_levels(frame(spark, "k int, l string", (1, '{"4": {"min": 1}}')), ["k"], "l")
    assert resolve.sole(frame(spark, "k int, g int", (1, 2), (2, None)), "k", "g", at_most=True).count() == 2
    for rows_ in ([(1, 2), (1, 3)], [(1, None)]):
        with pytest.raises(ValueError):
            resolve.sole(frame(spark, "k int, g int", *rows_), "k", "g")
    assert frame(spark, "a int", (-63,)).select(odds.middle(F.lit(-1), F.lit(-62))).first()[0] == -32


def test_gate_before_anything_is_written(spark, tmp_path):
    df = frame(spark, "id int, kind string, name string", *((i, "ab"[i % 2], f"n{i}") for i in range(450)))
    at = str(tmp_path / "out")
    bad = frame(spark, "metric string, before long, after long, verdict string", ("total", 9, 1, "dropped"))
    with pytest.raises(gate.GateError):
        emit.write_sharded(df, at, "kind", ["id"], verdicts=bad)
    assert not (tmp_path / "out").exists()
    emit.write_sharded(df, at, "kind", ["id"], verdicts=bad.where("verdict = 'pass'"))
    folders = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert folders == ["shard=a-0", "shard=a-1", "shard=b-0", "shard=b-1"]
    lines = [json.loads(x) for p in sorted((tmp_path / "out" / "shard=a-0").glob("*.json")) for x in p.read_text().splitlines()]
    assert [x["id"] for x in lines] == list(range(0, 400, 2)) and list(lines[0]) == ["id", "kind", "name"]
    emit.write_sharded(df.where("id < 10"), at, "kind", ["id"])
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["shard=a-0", "shard=b-0"]
    read = emit.read_sharded(spark, at, "id int, kind string, name string", shards=["b-0"])
    assert sorted(r.id for r in read.collect()) == [1, 3, 5, 7, 9]
    with pytest.raises(ValueError):
        emit.read_sharded(spark, at, "id int", version=2)
    assert gate.passed(bad, allow=True).count() == 1
    assert gate.gate_checks(None, frame(spark, "family string, name string, value long", ("total", "total", 1))).count() == 0


def test_ordered_in_hot_groups(spark):
    r = random.Random(1)
    made = [("hot", i, r.choice("ab.")) for i in range(500)] + [(None, i, "a") for i in range(3)] + [("one", 1, ".")]
    df = frame(spark, "g string, n int, m string", *made).repartition(4)
    got = {(x.g, x.n): (x.k, x.before) for x in ordered.previous(ordered.numbered(df, ["g"], ["n"], "k"), ["g"], ["n"], F.col("m"), "before").collect()}
    want = {}
    for g in ("hot", None, "one"):
        rows_ = sorted((n, m) for h, n, m in made if h == g)
        want |= {(g, n): (i + 1, rows_[i - 1][1] if i else None) for i, (n, _) in enumerate(rows_)}
    assert got == want
    assert ordered.numbered(df.limit(0), ["g"], ["n"]).count() == 0


def test_small_operators(spark):
    good, ledger = rows.split(frame(spark, "a int", (1,), (2,), (None,)), [("null", F.col("a").isNull()), ("two", F.col("a") == 2)])
    assert [r.a for r in good.collect()] == [1] and sorted(r.reject_reason for r in ledger.collect()) == ["null", "two"]
    kept = frame(spark, "v array<int>", ([1, 2, 3],), ([4, 5],)).select(rows.prefer(F.col("v"), lambda x: x < 3).alias("v")).collect()
    assert sorted(r.v for r in kept) == [[1, 2], [4, 5]]
    ragged = rows.variants(frame(spark, "a string, b string", ("x;y", "1;2;3"), ("x; y", "1")), ["a", "b"]).collect()
    assert sorted((r.a, r.b, r.variant, r.ragged) for r in ragged) == [("x", "1", 1, False), ("x;y", "1;2;3", 1, True), ("y", "1", 2, False)]
    made = odds.pool_odds(frame(spark, "p int, w double, ok boolean", (1, 1.0, True), (1, 3.0, False), (2, 0.0, True)), ["p"], "w", F.col("ok")).collect()
    assert sorted((r.p, r.w, r.chance) for r in made if r.chance is not None) == [(1, 1.0, 0.25)] and len(made) == 3
    with pytest.raises(collections.EmptyCollection):
        collections.resolve({"none": {"rule": {"kind": "x"}}}, frame(spark, "id int, kind string, name string", (1, "y", "n")), {}, strict=True)
    index = odds.group_index(frame(spark, "k int, o int, v string", (1, 3, "c"), (1, 1, "a"), (1, 2, "b")), "k", ["o"], "v", 2).first()
    assert (index.n_rows, index.first_id, index.last_id, index.firsts) == (3, "a", "c", ["a", "b"])
    facts_ = merge.fact_tiers(frame(spark, "k int, v int", (1, 1), (1, 2), (2, 3)), frame(spark, "k int, v int"), frame(spark, "k int"), "k", "v")
    with pytest.raises(merge.ConflictError):
        merge.refuse_conflicts(facts_, "k")
    assert merge.refuse_conflicts(facts_.where("k = 2"), "k").count() == 1
    base = frame(spark, "metric string, value long", ("total", 10), ("field:a", 10))
    new = frame(spark, "metric string, value long", ("total", 10), ("field:a", 9))
    assert {r.metric: r.verdict for r in gate.regression(base, new, required=["a"]).collect()} == {"total": "pass", "field:a": "incomplete"}


def test_search_in_both_ways(spark):
    e = frame(spark, "id int, name string, kind string", (1, "Chicken", "mob"), (2, "Raw Chicken", "item"), (3, "Oak Log", "block"), (4, "Straße", "item"))
    alias = search.aliases(e, curated=frame(spark, "id int, alias string", (3, "Wood"))).unionByName(frame(spark, "id int, alias string, strength int", (2, "chicken", 3)))
    asked = frame(spark, "query string", ("chicken",), ("wood",), ("",), ("oka log",))
    for few in (10, 0):
        got = [tuple(r) for r in search.searched(asked, e, alias, few=few).select("query", "rank", "id", "tier").collect()]
        assert sorted(got) == [("chicken", 1, 2, 0), ("chicken", 2, 1, 0), ("oka log", 1, 3, 3), ("wood", 1, 3, 0)]
        ranked = search.ranked(asked.where("query <> ''"), e, alias, few=few).collect()
        assert sorted((r.query, r.id) for r in ranked) == [("chicken", 1), ("chicken", 2), ("wood", 3)]
    words = frame(spark, "a string, b string", ("abc", "acb"), ("abc", "ab"), ("abc", "abcd"), ("abc", "axc"), ("abc", "cab"), ("a", ""), ("ab", "ba"))
    assert [r[0] for r in words.select(search.close(F.col("a"), F.col("b"))).collect()] == [True, True, True, True, False, True, True]


def test_tables_and_templates(spark):
    cells = frame(spark, "t string", ("{|\n| a || rowspan=2 | b\n|-\n| c\n|}",), ("no table",), (None,)).select(markup.table_cells(F.col("t"), strict=True).alias("c")).collect()
    assert [(c.row, c.col, c.text) for c in cells[0].c] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "b")] and cells[1].c == [] and cells[2].c is None
    with pytest.raises(PythonException):
        frame(spark, "t string", ("{|\n| a || b\n|-\n| c\n|}",)).select(markup.table_cells(F.col("t"), strict=True)).collect()
    assert markup.templates("{{a|b={{c|d}}|[[e|f]]|g}} {{h") == [{"name": "a", "args": ["[[e|f]]", "g"], "named": {"b": "{{c|d}}"}}]


@pytest.mark.parametrize(
    "raw,want",
    [("'''Regular:'''", "Regular:"), ("''x''", "x"), ("[[File:W (e).png|16px]] W:", "W:"), ("<small>(baby only)</small>", "(baby only)"), ('P<ref group="n" name="p">C.</ref>', "P"), ("0.3<!--W: 0.24-->", "0.3"), ("[[Tipped Arrow|A of S]]", "A of S"), ("[[Peaceful]] mode", "Peaceful mode"), ("o&#39; E", "o' E"), ("a   b\n\nc", "a b c"), ("{{ItemLink|Bow}}: ", "{{ItemLink|Bow}}:"), ('55<sup class="n">[<i>u</i>]</sup> b', "55 b"), ("56 b[[Category:U]]", "56 b"), ("55​/56", "55/56"), (None, None), ("", "")],
)
def test_strip_markup(spark, raw, want):
    assert frame(spark, "t string", (raw,)).select(text.strip_markup(F.col("t"))).first()[0] == want


def test_number_texts(spark):
    made = frame(spark, "x double", (0.0,), (7.2,), (0.35,), (12.0,), (1 / 3,)).select(text.number_text(F.col("x")).alias("t"), text.odds_text(F.col("x") / 100).alias("o")).collect()
    assert [r.t for r in made] == ["0", "7.2", "0.35", "12", "0.33"] and made[0].o == "0%" and made[3].o == "12%" and made[2].o == "1 in 286"
    assert frame(spark, "p int", (3,)).select(text.newest_first(F.col("p"), F.lit(2))).first()[0]
    assert frame(spark, "p string", ("ns:block/oak_log",)).select(text.display_name(F.col("p"))).first()[0] == "Oak Log"


def test_written_tables_go(spark):
    from pathlib import Path

    made = session.written(frame(spark, "a int", (1,)), "x")
    at = Path(session.run_dir(spark).removeprefix("file://"))
    assert made.count() == 1 and any(at.iterdir())
    session.clear(spark)
    assert not at.exists()
    assert session.written(frame(spark, "a int", (1,)), "x").count() == 1


def test_reports_and_icons(spark, tmp_path):
    from loomspark.operators import sections

    report = frame(spark, "id int, reason string", (1, "a"), (2, "b"))
    sections.write_reports({"rejects": report}, str(tmp_path))
    sections.write_reports({"rejects": report.where("id = 1")}, str(tmp_path))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "rejects")).select("id", "reason").collect()] == [(1, "a")]
    with pytest.raises(ValueError):
        sections.borrowed(frame(spark, "id string, lender string", ("a", "b")), frame(spark, "id string, icon string", ("c", "x")), "id", "icon", "lender")


def test_manifests(spark):
    good = '{"id": "a", "rule": {"list": [1, 9]}}'
    assert collections.manifests([good]) == {"a": {"rule": {"list": [1, 9]}}}
    for bad in ([good, good], ['{"id": "a"}'], ['{"id": "a", "rule": {"odd": 1}}'], ['{"id": "a", "rule": {"list": []}}'], ['{"id": "a", "rule": {"kind": "x", "tag": "y"}}'], ['{"id": "a", "rule": {"kind": "x"}, "odd": 1}']):
        with pytest.raises(collections.ManifestError):
            collections.manifests(bad)
    with pytest.raises(collections.EmptyCollection):
        collections.entities_of(collections.manifests([good]), frame(spark, "id int, kind string, name string", (1, "k", "n")), {})
