import hashlib
import math
import re
from collections import Counter

import pytest

from gridsight.llm import licences, sharding


def brute(files, threshold=licences.THRESHOLD):
    vocabulary = set().union(*(licences.terms(t) for x in licences.TEMPLATES.values() for t in x))
    found = []
    for path, text in files:
        text = text or ""
        units = list(dict.fromkeys([*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text]))
        found.append([t for t in map(licences.terms, units) if vocabulary & set(t)])
    n = sum(map(len, found))
    df = Counter(t for units in found for u in units for t in u if t in vocabulary)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocabulary}
    other = math.log((1 + n) / 2) + 1 if n else 1.0

    def match(unit):
        length = math.sqrt(sum((k * idf[t]) ** 2 if t in idf else k * other ** 2 for t, k in unit.items()))
        best = []
        for name, texts in licences.TEMPLATES.items():
            for text in texts:
                w = {t: k * idf[t] for t, k in licences.terms(text).items()}
                dot = sum(k * idf[t] * w[t] for t, k in unit.items() if t in w)
                best.append((-round(dot / length / math.sqrt(sum(x * x for x in w.values())), 6), name))
        return min(best)

    own = {}
    for (path, _), units in zip(files, found):
        good = [m for m in map(match, units) if -m[0] >= threshold]
        own[path] = min(good) if good else None
    spoken = {}
    for path, m in own.items():
        if m and path is not None and re.search(licences.LICENCE_FILE, path.rpartition("/")[2]):
            place = path.rpartition("/")[0]
            spoken[place] = min(spoken.get(place, (m, path)), (m, path))
    out = {}
    for path, m in own.items():
        by = path
        if not m and path is not None:
            place = path.rpartition("/")[0]
            while True:
                if place in spoken:
                    m, by = spoken[place]
                    break
                if not place:
                    break
                place = place.rpartition("/")[0]
        out[path] = (m[1], -m[0], by) if m else None
    return out


def test_licences_match_brute_force(spark, sf_dir):
    mit, gpl = "Released under the MIT License.", licences.TEMPLATES["GPL-3.0"][0]
    files = [("LICENSE", mit), ("a/x.py", "code"), ("a/COPYING.txt", "text\n\n" + gpl), ("a/b/c/y.py", None),
             ("a/b/z.py", "# " + licences.TEMPLATES["Apache-2.0"][0] + "\ncode"), ("p/q", ""), (None, "zz"),
             ("s/NOTICE", "nothing here"), ("s/t", "mit mit mit mit und mit"), ("s/u", "license " * 50)]
    files += [(f"docs/{r.source}/{r.doc_id}", r.text) for r in
              spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(files)
    got = {r.path: r for r in licences.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got.keys() == want.keys()
    for path, w in want.items():
        r = got[path]
        if w is None:
            assert (r.licence, r.score, r.licensed_by) == (None, None, None), path
        else:
            assert (r.licence, r.licensed_by) == (w[0], w[2]) and abs(r.score - w[1]) < 2e-6, path
    assert got["a/b/c/y.py"].licensed_by == "a/COPYING.txt" and got["p/q"].licensed_by == "LICENSE"


def test_stated_licences_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.licence for r in licences.op7_licence_scan(spark, "/root/testdata/sf0.01").collect()}
    stated = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
              "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
              "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for r in docs:
        for line, name in stated.items():
            if line in r.text.split("\n"):
                assert got[r.doc_id] == name


def wrapped(text, mark="", width=72):
    import textwrap
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def gnu_header(name, version, colon=":", mark=" * "):
    body = [f"This program is free software{colon} you can redistribute it and/or modify it under the terms of the "
            f"{name} as published by the Free Software Foundation{colon[-1]} either version {version} of the "
            "License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
            "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the "
            f"{name} for more details.",
            f"You should have received a copy of the {name} along with this program.  If not, see "
            "<https://www.gnu.org/licenses/>."]
    return f"{mark}Copyright (C) 2015 Some Body\n{mark}\n" + f"\n{mark}\n".join(wrapped(b, mark) for b in body)


def test_standard_texts_and_headers(spark, sf_dir):
    owner = "Copyright (c) 2014, The Regents of Somewhere\nAll rights reserved.\n\n"
    clauses = licences._BSD_2.split(" Redistributions ")
    start = "\n\n".join(wrapped(x) for x in [
        clauses[0], "1. Redistributions " + clauses[1], "2. Redistributions " + clauses[2]])
    third = wrapped("3. Neither the name of the Regents nor the names of its contributors may be used to endorse or "
                    "promote products derived from this software without specific prior written permission.")
    end = wrapped(licences._BSD_END)
    code = "\n\nint main(void) {\n  return compute_all_values(argc, argv);\n}\n" * 20
    gnu, affero = "GNU General Public License", "GNU Affero General Public License"
    terms_of = ("\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but "
                "changing it is not allowed.\n\n                            Preamble\n\n")
    want = {
        "bsd2": ("BSD-2-Clause", f"{owner}{start}\n\n{end}\n"),
        "bsd3": ("BSD-3-Clause", f"{owner}{start}\n\n{third}\n\n{end}\n"),
        "bsd3.c": ("BSD-3-Clause", f"{owner}{start}\n\n{third}\n\n{end}{code}"),
        "gpl2.c": ("GPL-2.0", f"/*\n{gnu_header(gnu, 2, ';')}\n */{code}"),
        "gpl3.py": ("GPL-3.0", gnu_header(gnu, 3, mark="# ") + code),
        "gpl3.txt": ("GPL-3.0", gnu_header(gnu, 3, mark="") + code),
        "agpl.py": ("AGPL-3.0", gnu_header(affero, 3, mark="# ") + code),
        "lgpl.c": ("LGPL-3.0", gnu_header("GNU Lesser General Public License", 3) + code),
        "gpl2": ("GPL-2.0", f"      GNU GENERAL PUBLIC LICENSE\n        Version 2, June 1991{terms_of}"
                            "The licenses for most software are designed to take away your freedom.\n"),
        "gpl3": ("GPL-3.0", f"      GNU GENERAL PUBLIC LICENSE\n        Version 3, 29 June 2007{terms_of}"
                            "The GNU General Public License is a free, copyleft license for\nsoftware.\n"),
        "agpl": ("AGPL-3.0", f"    GNU AFFERO GENERAL PUBLIC LICENSE\n       Version 3, 19 November 2007{terms_of}"),
        "isc": ("ISC", f"ISC License\n\n{owner}{wrapped(licences._ISC)}\n\n{wrapped(licences._ISC_END)}\n"),
        "mit": ("MIT", f"{owner}{wrapped(licences._MIT)}\n\n{wrapped(licences._MIT_END)}\n"),
        "apache.js": ("Apache-2.0", owner + wrapped(licences._APACHE) + code),
        "epl.java": ("EPL-2.0", owner + wrapped(licences.TEMPLATES["EPL-2.0"][1]) + code),
        "free.c": ("Unlicense", wrapped(licences._UNLICENSE) + "\n\n" + wrapped(licences._UNLICENSE_END)),
        "mine": ("Proprietary", owner + code), "none": (None, code),
    }
    files = [(path, text) for path, (_, text) in want.items()]
    files += [(f"docs/{r.doc_id}", r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.path: r.licence for r in licences.scan(
        spark.createDataFrame(files, "path string, text string")).collect()}
    assert {path: got[path] for path in want} == {path: name for path, (name, _) in want.items()}


def test_fill_matches_turns():
    names, slots = [f"n{i}" for i in range(7)], 101
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    orders = [[(number(f"offset:{n}") + j * (number(f"skip:{n}") % (slots - 1) + 1)) % slots for j in range(slots)]
              for n in names]
    owner = {}
    while len(owner) < slots:
        for shard, order in enumerate(orders):
            free = next((s for s in order if s not in owner), None)
            if free is not None:
                owner[free] = shard
    assert sharding.fill(names, slots) == [owner[s] for s in range(slots)]


def test_shares_and_moves():
    names = sharding.shard_names()
    full = sharding.fill(names, sharding.SLOTS)
    counts = Counter(full)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill(names[:-1], sharding.SLOTS)
    moved = sum(a != b for a, b in zip(full, fewer) if a != len(names) - 1)
    assert moved < 0.1 * sharding.SLOTS


def test_bad_tables():
    for names, slots in ((["a"], 100), ([], 7), (["a"] * 8, 7)):
        with pytest.raises(ValueError):
            sharding.fill(names, slots)
