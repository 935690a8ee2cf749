from __future__ import annotations

import re
from collections import defaultdict

import xxhash

from loomspark.llm import line_dedup

from . import data


def chunks(text, modulus=3):
    lines, starts = text.split("\n"), []
    hashes = [xxhash.xxh64(line.encode(), seed=42).intdigest() for line in lines]
    for i, h in enumerate(hashes):
        before = hashes[i - 1]
        h ^= (before << 1 | before >> 63) & ((1 << 64) - 1)
        signed = h - (1 << 64) if h >> 63 else h
        if i == 0 or signed % modulus == 0:
            starts.append(i)
    return lines, list(zip(starts, starts[1:] + [len(lines)], strict=True))


def brute(rows):
    """Rows that repeat wholly are one document."""
    owners = defaultdict(set)
    for i, t, *_ in rows:
        if t is not None:
            lines, spans = chunks(t)
            for a, b in spans:
                body = "\n".join(lines[a:b])
                if b - a >= 2 and re.search(r"[^ \t\n\x0b\f\r]", body):
                    owners[body].add(((i is not None, i or 0), a, t))
    for i, t, *_ in rows:
        if t is None:
            yield i, None, 0, 0
            continue
        lines, spans = chunks(t)
        kept, gone = [], 0
        for a, b in spans:
            found = owners.get("\n".join(lines[a:b]))
            if found and len(found) > 1 and min(found)[:2] != ((i is not None, i or 0), a):
                gone += b - a
            else:
                kept += lines[a:b]
        yield i, "\n".join(kept), len(lines), gone


def key(r):
    return (r[0] is not None, r[0] or 0)


def test_same_as_brute_force(spark):
    got = line_dedup.deduplicate(data.table(spark)).select("doc_id", "text", "n_lines", "n_removed")
    want = sorted(brute(data.rows()), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert sum(r[3] for r in want) > 20


def test_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = line_dedup.deduplicate(docs).select("doc_id", "text", "n_lines", "n_removed")
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_clashing_names_and_empty_tables(spark):
    docs = data.table(spark, extra=True)
    out = line_dedup.deduplicate(docs)
    assert out.columns == [*docs.columns] and out.count() == docs.count()
    assert line_dedup.deduplicate(docs.limit(0)).count() == 0


def brute_runs(rows, words=50):
    """Numbers of the lines in runs of two lines or more, or in single lines of ``words`` words, that an earlier
    place has, by comparing all pairs of places; knows nothing of chunks or hashes."""
    docs = sorted({((i is not None, i or 0), t) for i, t in rows if t is not None})
    places = [(k, n, d, t.split("\n")) for d, (k, t) in enumerate(docs) for n in range(len(t.split("\n")))]
    gone = defaultdict(set)
    for k, n, d, lines in places:
        for k2, n2, d2, other in places:
            if (k2, n2) >= (k, n):
                continue
            length = 0
            while n + length < len(lines) and n2 + length < len(other) and lines[n + length] == other[n2 + length] and (d != d2 or n2 + length < n):
                length += 1
            if length >= 2 and any(map(str.strip, lines[n : n + length])) or length == 1 and len(lines[n].split()) >= words:
                gone[docs[d]] |= set(range(n, n + length))
    return {(k, t): (t, gone[k, t]) for k, t in docs}


def test_windows_same_as_all_pairs(spark):
    long = " ".join(f"long{i}" for i in range(50))
    passage = "first of it\nsecond of it\nthird of it"
    made = [f"a\n{passage}\nb", f"c\n{passage}\nd", "e\nsecond of it\nthird of it\nf", f"g\n{long}\nh", f"i\n{long}\nj", f"{long} more\nk", long.rsplit(" ", 1)[0] + "\nl", "m\nm\nm\nm\nm", "n\n\no\n\np", "q\n\no\n\nr", " \n\n \ns", " \n\n \nt", "third of it\nfirst of it"]
    rows = [(i, t) for i, t in enumerate(made)] + [(100 + r[0] if r[0] is not None else None, r[1]) for r in data.rows()]
    got = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), windows=True).collect()
    assert len(got) == len(rows)
    want = brute_runs(rows)
    whole = defaultdict(list)
    for i, t in rows:
        whole[i].append(t)
    for r in got:
        t = whole[r.doc_id][0]
        if t is None:
            assert r.text is None
            continue
        gone = want[(r.doc_id is not None, r.doc_id or 0), t][1]
        kept = [x for n, x in enumerate(t.split("\n")) if n not in gone]
        assert [x for x in r.text.split("\n") if x.strip()] == [x for x in kept if x.strip()]
        assert r.n_lines == t.count("\n") + 1 and len(kept) == r.n_lines - r.n_removed
    by = {r.doc_id: r.text for r in got}
    assert by[1] == "c\nd" and by[2] == "e\nf" and by[4] == "i\nj" and by[12] == made[12] and by[7] == "m\nm"


def test_queries_use_windows(spark, tmp_path):
    import corpus_pipeline
    from loomspark.llm import queries

    rows = [(i, f"alone {i}\n{' '.join(['word'] * 60)}\nend {i}", "en", "s", 400) for i in range(2)]
    docs = spark.createDataFrame(rows, data.SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id, r.n_removed) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()) == [(0, 0), (1, 1)]
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()}[1] == "alone 1\nend 1"
