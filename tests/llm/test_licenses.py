from __future__ import annotations

import math
import random
import re

from loomspark.llm import licenses as L

FILES = [
    ("a/LICENSE", "Released under the MIT License."),
    ("a/x.py", "print(1)\nsomething else"),
    ("a/b/y.py", "code"),
    ("a/b/z.py", "// Licensed under the Apache License, Version 2.0.\ncode"),
    ("a/b/c/d.py", None),
    ("q/r/s.py", ""),
    ("top.py", "Licensed under CC BY-SA 4.0.\nReleased under the ISC License."),
    ("loose.py", "the license of this is unclear"),
    (None, "Released under the MIT License."),
    (None, "nothing"),
    ("a/x.py", "print(1)\nsomething else"),
    ("m/COPYING", "This file is subject to the terms of the\nMozilla Public License, v. 2.0."),
    ("m/n.c", "x " * 20000),
]


def brute(files, templates, least):
    df, n = {}, len(files)
    for _, t in files:
        for term in set(re.findall(L.TERM, (t or "").lower())):
            df[term] = df.get(term, 0) + 1
    known = {t for x in templates.values() for t in re.findall(L.TERM, x.lower())}
    weight = lambda t: math.log((n + 1) / ((df.get(t, 0) if t in known else 0) + 1)) + 1

    def vector(text):
        v = {}
        for t in re.findall(L.TERM, text.lower()):
            v[t] = v.get(t, 0) + weight(t)
        return v

    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = []
    for path, t in files:
        units = (t or "").split("\n") + ([t or ""] if path and re.search(L.LICENCE_FILE, path) else [])
        found = []
        for k, u in enumerate(units):
            v = vector(u)
            for name, x in templates.items():
                y = vector(x)
                c = round(sum(v.get(t, 0) * w for t, w in y.items()) / (norm(v) * norm(y)), 9) if v else 0
                if c >= least:
                    found.append((-c, k, name))
        own.append(min(found) if found else None)
    dirs = {}
    for (path, _), o in zip(files, own, strict=True):
        if o and path:
            d = path.rpartition("/")[0]
            mark = (not re.search(L.LICENCE_FILE, path), path, o[2])
            dirs[d] = min(dirs.get(d, mark), mark)
    for (path, _), o in zip(files, own, strict=True):
        if o:
            yield path, o[2], -o[0], "own", path
            continue
        d = path.rpartition("/")[0] if path else None
        while d is not None and d not in dirs:
            d = d.rpartition("/")[0] if d else None
        yield (path, None, None, None, None) if d is None else (path, dirs[d][2], None, "inherited", d)


def test_same_as_brute_force(spark):
    files = spark.createDataFrame([(p, t, 1, "u") for p, t in FILES], "path string, text string, key int, license string")
    got = L.scan(files).collect()
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[0], r[1], r[3], r[4]))
    got, want = sorted(map(tuple, got), key=order), sorted(brute(FILES, L.TEMPLATES, 0.8), key=order)
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert all(a[2] is b[2] or abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, want, strict=True))
    assert {r[3] for r in got} == {"own", "inherited", None}
    assert L.scan(files.limit(0)).count() == 0


def test_wrapped_embedded_and_whole_files(spark):
    full = L.full_texts()
    found = {
        "wrap.c": ("/* Licensed under the Apache License,\n * Version 2.0.\n */\nint x;", "Apache-2.0"),
        "three.c": ("# This work is licensed under\n# the GNU General Public\n# License, version 3.\ncode", "GPL-3.0"),
        "more.py": ("This file is released under the MIT License, see it for more.", "MIT"),
        "author.py": ("Copyright (c) 2021 A. Author. Released under the MIT License.", "MIT"),
        "LICENSE": ("MIT License\n\nCopyright (c) 2021 A. Author\n" + full["MIT"], "MIT"),
        "head.py": ("# " + full["ISC"].replace("\n", "\n# ") + "\n" + "code of it\n" * 900, "ISC"),
        "COPYING": (full["GPL-3.0"], "GPL-3.0"),
        "AGPL/COPYING": (full["AGPL-3.0"], "AGPL-3.0"),
        "spdx.rs": ("// SPDX-License-Identifier: MIT\nfn main() {}", "MIT"),
        "spdx.go": ("// code\n// SPDX-License-Identifier: BSD-3-Clause\npackage x", "BSD-3-Clause"),
        "other.go": ("// SPDX-License-Identifier: Zlib\npackage x", None),
        "bsd.txt": ("Copyright 2020 Someone. All rights reserved.\n\n" + full["BSD-3-Clause"], "BSD-3-Clause"),
        "apache.txt": (full["Apache-2.0"], "Apache-2.0"),
        "prose.txt": ("the author of this file has a license to drive and sees it for more", None),
    }
    rows = [(f"alone/{i}/{p}", t) for i, (p, (t, _)) in enumerate(found.items())]
    rows += [(f"rest/{i}.txt", " ".join(("see", "for", "file", "the", "this", "it", "more", "of", "a")[: 2 + i % 8]) + f" own{i}") for i in range(100)]
    got = {r.path: r for r in L.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for i, (p, (_, license)) in enumerate(found.items()):
        r = got[f"alone/{i}/{p}"]
        assert (r.license, r.via) == (license, "own" if license else None), (p, r)
    assert all(r.license is None for p, r in got.items() if p.startswith("rest/"))


def test_frequencies_of_all_terms(spark):
    rows = [(str(i), "see it see" if i % 2 else "other") for i in range(10)]
    df, n = L.frequencies(spark.createDataFrame(rows, "path string, text string"), "text")
    assert n == 10 and {r.term: (r.df, round(r.w, 9)) for r in df.collect()} == {t: (5, round(math.log(11 / 6) + 1, 9)) for t in ("see", "it", "other")}


def every_candidate(text, file, lengths, heads):
    """(kind, candidate's terms) of a text, told from its definition."""
    terms = lambda t: re.findall(L.TERM, t.lower())
    lines, all_ = text.split("\n"), terms(text)
    for k in (1, 2, 3):
        yield from (("short", terms(" ".join(lines[i : i + k]))) for i in range(len(lines) - k + 1))
    yield from (("short", terms(x)) for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])|\n\s*\n", text))
    if file:
        yield "short", all_
    for m in lengths:
        yield from (("short", all_[i : i + m]) for i in range(len(all_) - m + 1))
    yield from (("full", all_[:m]) for m in {len(all_), *heads})


def test_query_as_brute_force(spark, tmp_path):
    """op9_license_scan over lines, windows of terms, and full texts: all candidates against all templates."""
    from loomspark.llm import queries

    r, full, short = random.Random(4), L.full_texts(), L.TEMPLATES | L.TAGS
    filler = lambda n: " ".join(r.choice("the this file is of under version license terms work and more words see public general red blue".split()) for _ in range(n))
    texts = [None, "", filler(30), full["MIT"], "# " + full["ISC"].replace("\n", "\n# ") + "\n" + filler(200), full["AGPL-3.0"], full["GPL-3.0"], filler(40) + "\n\n" + full["BSD-3-Clause"][:900]]
    for name in list(short)[::2]:
        words = short[name].split()
        cut = r.randrange(1, len(words)) if len(words) > 1 else 0
        texts.append(filler(8) + "\n" + " ".join(words[:cut]) + "\n * " + " ".join(words[cut:]) + "\n" + filler(9))
        texts.append(filler(20) + " " + " ".join(words).upper() + " " + filler(20) + ". Then more.")
        texts.append(filler(3) + " " + " ".join(words[:-1]) + " " + filler(3))
    rows = [(i, t, r.choice(["de", "en", None]), r.choice(["a", "b"]), 1) for i, t in enumerate(texts)] + [(900 + i, filler(25 + i), "fr", "a", 1) for i in range(60)]
    rows += [rows[8], rows[8]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in queries.op9_license_scan(spark, str(tmp_path)).collect()}

    n, df = len(rows), {}
    for row in rows:
        for t in set(re.findall(L.TERM, (row[1] or "").lower())):
            df[t] = df.get(t, 0) + 1
    w = lambda t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1

    def vector(terms):
        v = {}
        for t in terms:
            v[t] = v.get(t, 0) + w(t)
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = {"short": {k: vector(re.findall(L.TERM, t.lower())) for k, t in short.items()}, "full": {k: vector(re.findall(L.TERM, t.lower())) for k, t in full.items()}}
    lengths, heads = ({len(re.findall(L.TERM, t.lower())) for t in x.values()} for x in (short, full))
    own = {}
    for i, text, *_ in rows:
        best = (0.0, None)
        for kind, terms in every_candidate(text or "", False, lengths, heads) if text else ():
            v = vector(terms) if terms else {}
            for name, x in vectors[kind].items():
                c = round(sum(v.get(t, 0.0) * y for t, y in x.items()), 9)
                if c >= (1 - 1e-6 if name.startswith("tag:") else 0.8) and c > best[0]:
                    best = (c, name.removeprefix("tag:"))
        own[i] = best
        assert (got[i].via == "own") == (best[1] is not None), (i, best, got[i])
        if best[1]:
            assert abs(got[i].score - best[0]) < 1e-6 and (got[i].license == best[1] or abs(best[0] - 1) < 1e-6), (i, best, got[i])
    assert sum(x[1] is not None for x in own.values()) > 20 and own[5][1] == "AGPL-3.0" and own[6][1] == "GPL-3.0"
    # the rest inherit within their source and language, the smallest path first
    for i, _, lang, source, _ in rows:
        if got[i].via != "own":
            near = sorted(f"{s}/{la or 'none'}/{j}.txt" for j, _, la, s, _ in rows if own[j][1] and (s, la) == (source, lang))
            if near:
                j = int(near[0].rsplit("/", 1)[1][:-4])
                assert (got[i].via, got[i].license) == ("inherited", got[j].license)


def test_many_key_terms_in_a_long_text(spark):
    """A megabyte with 10,000 key terms: work grows with positions."""
    import time

    long = " ".join("license mit apache version released" if i % 8 == 0 else f"word{i % 977} other things said here" for i in range(30_000))
    files = spark.createDataFrame([("a/long.txt", long + "\nReleased under the MIT License."), ("a/b.txt", "x")], "path string, text string")
    assert len(long) > 900_000 and len(re.findall("license", long)) > 3_000
    began = time.time()
    got = {r.path: r for r in L.scan(files).collect()}
    assert got["a/long.txt"].via == "own" and time.time() - began < 60
