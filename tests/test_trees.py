"""Trees against a walk from left to right, on random graphs."""

from __future__ import annotations

import random

import pytest

from loomspark.operators import trees

P = "output string, producer string, seq long, method string, station string, count int, source string, grid array<int>, width int, height int"
I = "producer string, slot int, item string, tag string, count int"  # noqa: E741
M = "producer string, slot int, place int, member string"


def graph(seed: int, items: int = 9, n: int = 26):
    """Random producers: cycles, diamonds, tags, alternatives, storage, nuggets, dyes, smelting at several stations."""
    r = random.Random(seed)
    name = lambda: f"ns:{r.choice('abcdefghi'[:items])}"
    producers, inputs, members = [], [], []
    for k in range(n):
        out, p = name(), f"p{k:02}"
        method = r.choice(["crafting"] * 4 + ["smelting"] * 2 + ["stonecutting", "trade"])
        source = r.choice(["ns:x", "ns:dye_red", "dye_white", "ns:y"])
        producers.append((out, p, k * 7 % n, method, r.choice([None, *trees.COOKING[::-1], "zeta"]) if method == "smelting" else None, r.choice([None, 1, 2]), source, r.choice([None, [0, 1]]), r.choice([None, 2]), None))
        for slot in range(1 if method == "smelting" else r.randrange(4)):
            if r.random() < 0.25:
                inputs.append((p, slot, None, f"t{r.randrange(3)}", r.choice([None, 1, 2])))
                for place, m in enumerate(r.sample(["ns:a", "ns:b", "ns:stripped_c", "ns:d_wood", "minecraft:oak_log", "minecraft:iron_ingot", "ns:e"], r.randrange(4))):
                    members.append((p, slot, place, m))
            else:
                inputs.append((p, slot, r.choice([name(), name(), "ns:iron_ore"]) if method == "smelting" else name(), None, r.choice([None, 1, 1, 3])))
                if r.random() < 0.2:
                    members += [(p, slot, i, m) for i, m in enumerate([inputs[-1][2], name() + "_x"])]
    for m in "ab":  # what packs and unpacks
        for p, out, item, c, takes in ((f"q{m}", f"ns:{m}", f"ns:{m}_block", 9, 1), (f"r{m}", f"ns:{m}_block", f"ns:{m}", 1, 9), (f"s{m}", f"ns:{m}", f"ns:{m}_nugget", None, 9), (f"u{m}", f"ns:{m}_nugget", f"ns:{m}", 9, None)):
            producers.append((out, p, 100 + len(producers), "crafting", None, c, "ns:pack", None, None, None))
            inputs.append((p, 0, item, None, takes))
    return producers, inputs, members


def by_output(producers):
    out = {}
    for p in sorted(producers, key=lambda p: p[2]):
        out.setdefault(p[0], []).append(p)
    return out


def walk_references(root, producers, inputs, depth):
    """The rules, from left to right with one memory."""
    of, slots, rows, seen = by_output(producers), {}, [], {}
    for p, s, item, tag, _ in sorted(inputs, key=lambda x: x[:2]):
        slots.setdefault(p, []).append((s, item, tag))

    def node(item, left, way, path, d, producer, top=False):
        if left <= 0 and not top:
            return rows.append((root, path, d, producer, item, None, "expandable", None))
        if (item, left) in seen:
            return rows.append((root, path, d, producer, item, None, "shown", seen[item, left]))
        seen[item, left] = path
        rows.append((root, path, d, producer, item, None, None, None))
        k = 0
        for p in of.get(item, ()):
            ins = slots.get(p[1], [])
            if ins and all(i is not None and i in way for _, i, _ in ins):
                continue
            for s, i, t in ins:
                at = f"{path}.producers.{k}.inputs.{s}"
                if t is not None:
                    rows.append((root, at, d + 1, p[1], None, t, None, None))
                elif i in way:
                    rows.append((root, at, d + 1, p[1], i, None, "repeat", None))
                else:
                    node(i, left - 1, way | {i}, at, d + 1, p[1])
            k += 1

    node(root, depth, {root}, "root", 0, None, True)
    return rows


@pytest.mark.parametrize("seed,depth", [(1, 4), (2, 3), (3, 5), (4, 0), (5, 1)])
def test_references(spark, seed, depth):
    producers, inputs, _ = graph(seed)
    roots = sorted({p[0] for p in producers} | {"ns:none"})
    got = trees.with_references(spark.createDataFrame([(r,) for r in roots + roots[:2]], "item string"), spark.createDataFrame(producers, P), spark.createDataFrame(inputs, I), depth)
    want = [x for r in roots for x in walk_references(r, producers, inputs, depth)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    if depth >= 3:
        at = {(x[0], x[1]): x for x in want}
        shown = [x for x in want if x[7]]
        assert shown and all(at[x[0], x[7]][4] == x[4] and at[x[0], x[7]][6] is None for x in shown)  # references lead to what is drawn


def bare(x):
    return x.split(":", 1)[-1]


class Reader:
    """Cards and trees as a reader's walk makes them: lists, in order, one item at a time."""

    def __init__(self, producers, inputs, members):
        self.of, self.ins = by_output(producers), {}
        mb = {}
        for p, s, _, m in sorted(members, key=lambda x: x[:3]):
            mb.setdefault((p, s), []).append(m)
        for p, s, item, tag, c in sorted(inputs, key=lambda x: x[:2]):
            self.ins.setdefault(p, []).append({"i": item, "t": tag, "c": c or 1, "mb": mb.get((p, s), [])})

    def one(self, p):
        ins = self.ins.get(p[1], [])
        return ins[0] if len(ins) == 1 and ins[0]["i"] else None

    def storage(self, p):
        x = self.one(p)
        return bool(p[3] == "crafting" and x and not x["t"] and x["c"] == 1 and (p[5] or 1) > 1 and x["i"].endswith("_block") and any(q[3] == "crafting" and (y := self.one(q)) and y["i"] == p[0] and y["c"] > 1 for q in self.of.get(x["i"], [])))

    def nuggets(self, p):
        x = self.one(p)
        return bool(p[3] == "crafting" and x and not x["t"] and x["c"] > 1 and (p[5] or 1) == 1 and x["i"].endswith("_nugget") and any(q[3] == "crafting" and (y := self.one(q)) and y["i"] == p[0] and (q[5] or 1) > 1 for q in self.of.get(x["i"], [])))

    def listed(self, item, top):
        out = []
        for p in self.of.get(item, []):
            ore = p[3] == "smelting" and (x := self.ins[p[1]][0]) and (bare(x["i"] or x["t"]).endswith("_ore") or bare(x["i"] or x["t"]).startswith("raw_"))
            if p[3] in trees.ACQUIRED or ore or (not top and (self.storage(p) or self.nuggets(p))):
                continue
            out.append(p)
        dye = lambda p: ":dye_" in p[6] or p[6].startswith("dye_")
        if any(p[3] == "crafting" and not dye(p) for p in out):
            out.sort(key=dye)
        return sorted(out, key=self.storage)

    def cards(self, item, top):
        ps, made, done = self.listed(item, top), [], set()
        for p in ps:
            ins = [dict(x) for x in self.ins.get(p[1], [])]
            if p[3] != "smelting":
                made.append((p, ins, [p[4]] if p[4] else []))
                continue
            if (p[5] or 1) in done:
                continue
            done.add(p[5] or 1)
            group = [q for q in ps if q[3] == "smelting" and (q[5] or 1) == (p[5] or 1)]
            stations = sorted({q[4] for q in group if q[4]}, key=lambda s: (trees.COOKING.index(s) if s in trees.COOKING else 9, s))
            firsts = [self.ins[q[1]][0] for q in group]
            tagged = [x for x in firsts if x["t"]]
            items = list(dict.fromkeys(x["i"] for x in firsts if not x["t"]))
            if tagged:
                ins = [dict(tagged[0])]
            elif len(items) > 1:
                ins = [{**ins[0], "i": items[0], "mb": items}]
            made.append((p, ins, stations))
        for s in range(max((len(x[1]) for x in made), default=0)):
            groups = {}
            for n, (p, ins, st) in enumerate(made):
                key = n if len(ins) <= s else (p[3], p[4] or "", p[5] or 1, p[8] or 0, p[9] or 0, str(p[7]), str([(x["i"], x["t"], x["c"]) if j != s else "*" for j, x in enumerate(ins)]))
                groups.setdefault(key, []).append((p, ins, st))
            made = []
            for same in groups.values():
                p, ins, st = same[0]
                if len(same) > 1:
                    every = list(dict.fromkeys(m for _, x, _ in same for m in (x[s]["mb"] or ([x[s]["i"]] if x[s]["i"] else []))))
                    if len(every) > 1:
                        ins = ins[:s] + [{**ins[s], "i": every[0], "mb": every}] + ins[s + 1 :]
                made.append((p, ins, st))
        return made

    @staticmethod
    def plain(members):
        kept = [m for m in members if not (bare(m).startswith("stripped_") or bare(m).endswith("_wood") or bare(m).endswith("_hyphae"))]
        return kept or members

    def child(self, x):
        if not x["t"]:
            return x["i"]
        mb = self.plain(x["mb"])
        return next((r for r in trees.REPRESENTATIVES if r in mb), mb[0] if mb else None)

    def tree(self, root, depth, top=True, above=()):
        rows = []

        def node(item, left, way, seen, path, d, card, tag, count, is_top):
            row = lambda stub=None, ref=None: rows.append((root, path, d, card, item, tag, count, stub, ref))
            if left <= 0 and not is_top:
                return row("expandable" if self.listed(item, False) else None)
            if (item, left) in seen and self.listed(item, is_top):
                return row("shown", seen[item, left])
            seen[item, left] = path
            row()
            k = 0
            for p, ins, _ in self.cards(item, is_top):
                if ins and all(x["i"] is not None and x["i"] in way for x in ins):
                    continue
                own, name = dict(seen), ("^" if is_top else "_") + p[1]
                for s, x in enumerate(ins):
                    c, at = self.child(x), f"{path}.producers.{k}.inputs.{s}"
                    if c is None or c in way or (x["t"] and left <= 0):
                        rows.append((root, at, d + 1, name, c, x["t"], x["c"], "repeat" if c in way else None, None))
                    else:
                        node(c, left - 1, way | {c}, own, at, d + 1, name, x["t"], x["c"], False)
                k += 1

        node(root, depth, {root, *above}, {}, "root", 0, None, None, 1, top)
        return rows


@pytest.mark.parametrize("seed", range(6))
def test_cards_and_their_trees(spark, seed):
    producers, inputs, members = graph(seed, items=6 + seed % 3, n=30)
    reader = Reader(producers, inputs, members)
    made = trees.cards(spark.createDataFrame(producers, P), spark.createDataFrame(inputs, I), spark.createDataFrame(members, M))
    want, want_members = [], []
    for item in reader.of:
        for top in (True, False):
            for n, (p, ins, st) in enumerate(reader.cards(item, top), 1):
                card = ("^" if top else "_") + p[1]
                want.append((card, item, top, n, tuple(st), tuple((s, x["i"], x["t"], x["c"], reader.child(x)) for s, x in enumerate(ins))))
                want_members += [(card, s, *reader.plain(x["mb"])) for s, x in enumerate(ins) if x["mb"]]
    slots = {}
    for x in sorted(made.slots.collect(), key=lambda x: (x.card, x.slot)):
        slots.setdefault(x.card, []).append((x.slot, x.item, x.tag, x["count"], x.child))
    got = [(x.card, x.output, x.top, x.seq, tuple(x.stations), tuple(slots.get(x.card, ()))) for x in made.cards.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    listed = {}
    for x in sorted(made.alternatives.collect(), key=lambda x: x.at):
        listed.setdefault((x.card, x.slot), []).append(x.member)
    assert sorted((*k, *v) for k, v in listed.items()) == sorted(want_members)
    assert len(got) < 2 * sum(p[3] not in trees.ACQUIRED for p in producers)

    roots = sorted(reader.of)
    for depth in (3, 1, 0) if seed < 2 else (4,):
        got = trees.card_tree(spark.createDataFrame([(r,) for r in roots], "item string"), made, depth)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(x) for r in roots for x in reader.tree(r, depth))
    above = [(r, roots[:k]) for k, r in enumerate(roots)]
    for depth in (2, 0):
        got = trees.card_tree(spark.createDataFrame(above, "item string, way array<string>"), made, depth, top=False)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(x) for r, w in above for x in reader.tree(r, depth, False, w))
