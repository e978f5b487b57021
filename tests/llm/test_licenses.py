import math
import random
import re
from collections import Counter

from tallywood.llm import licenses as L

APACHE, MIT = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."


def test_headers_files_and_inheritance(spark):
    rows = [
        ("a/LICENSE", APACHE), ("a/x.txt", "no word of it"), ("a/b/y.txt", "text\n  # " + MIT + "\nmore"), ("a/b/c/z.txt", "nothing"), ("a/b/c/d/COPYING", MIT), ("a/b/c/d/LICENSE.md", MIT), ("a/b/c/d/NOTICE", APACHE),
        ("a/b/c/d/e/w.txt", ""), ("ab/v.txt", None), ("top.txt", "x"), (None, MIT), ("a/q.txt", "the licensed version of the story was not released under any public roof at all by the old man"),
        ("a/x.txt", "no word of it"), ("g/long.txt", "word " * 60_000 + "\nAll rights reserved."), ("g/two.txt", APACHE + "\n\n" + MIT),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "path string, text string, License int")
    got = L.scan(df)
    assert got.columns == ["path", "text", "own_license", "cosine", "license", "inherited_from"]
    out = {r.path: (r.own_license, r.license, r.inherited_from) for r in got.collect()}
    assert got.count() == len(rows)
    assert out["a/LICENSE"] == ("Apache-2.0", "Apache-2.0", None)
    assert out["a/x.txt"] == (None, "Apache-2.0", "a")
    assert out["a/b/y.txt"] == ("MIT", "MIT", None)
    assert out["a/b/c/z.txt"] == (None, "Apache-2.0", "a")
    assert out["a/b/c/d/e/w.txt"] == (None, "MIT", "a/b/c/d")
    assert out["a/q.txt"] == (None, "Apache-2.0", "a")
    assert out["ab/v.txt"] == out["top.txt"] == out[None] == (None, None, None)
    assert out["g/long.txt"][0] == "proprietary" and out["g/two.txt"][0] == "Apache-2.0"
    assert L.scan(df.limit(0)).count() == 0


def test_every_template_matches_itself(spark):
    df = spark.createDataFrame([(f"f{i}", t) for i, (_, t) in enumerate(L.TEMPLATES)], "path string, text string")
    of = {}
    for n, t in L.TEMPLATES:
        of.setdefault(t, set()).add(n)
    for r in L.scan(df).collect():
        assert r.own_license in of[r.text] and r.cosine == 1.0, r


def test_real_headers_and_files(spark):
    own = lambda name: [x for n, x in L.TEMPLATES if n == name and "SPDX" not in x]
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + "\n\n".join(x.replace(", ", ",\n") for x in own("MIT")[:3])
    bsd3 = "Copyright (c) 2019, The Authors\nAll rights reserved.\n\n" + "\n\n".join(own("BSD-3-Clause")[:5])
    bsd2 = "Copyright (c) 2019, The Authors\nAll rights reserved.\n\n" + "\n\n".join(own("BSD-2-Clause")[:4])
    cases = [
        ("Apache-2.0", "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0"),
        ("GPL-3.0", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."),
        ("GPL-2.0", " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version."),
        ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MIT", "// SPDX-License-Identifier: MIT"), ("proprietary", "Copyright 2021 Some Firm. All rights reserved."),
        ("MIT", mit), ("BSD-3-Clause", bsd3), ("BSD-2-Clause", bsd2), ("LGPL-2.1", own("LGPL-2.1")[0].replace("; ", ";\n")), ("ISC", "ISC License\n\nCopyright (c) 2020, X\n\n" + own("ISC")[0]),
        ("Unlicense", own("Unlicense")[0]), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/"),
        (None, "The old license to fish was kept with permission of the town, without any warranty of luck."), (None, "He redistributed the copyright notices among the many people who had come to see them."),
    ]
    df = spark.createDataFrame([(str(i), x) for i, (_, x) in enumerate(cases)], "path string, text string")
    got = {int(r.path): r.own_license for r in L.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == [n for n, _ in cases]


def plain_cosine(unit):
    """The best cosine of a unit to any template, by the definition."""
    rows, idf, unknown = L.weights(L.TEMPLATES)
    mine = {t: f * idf.get(t, unknown) for t, f in L.terms(unit).items()}
    size = math.sqrt(sum(x * x for x in mine.values()))
    dots = Counter()
    for template, _, term, w in rows:
        dots[template] += mine.get(term, 0.0) * w
    return round(max(dots.values()) / size, 4) if size else 0.0


def test_no_unit_that_reaches_the_threshold_is_dropped(spark):
    r = random.Random(10)
    words = [w for _, t in L.TEMPLATES for w in t.split()]
    made = [" ".join(r.choice(words) if r.random() < share else r.choice(["sea", "wind", "and", "it", "x1"]) for _ in range(r.randint(1, 30))) for share in (0.2, 0.5, 0.8, 1.0) for _ in range(60)]
    sentences = [s for _, t in L.TEMPLATES for s in re.split(r"[.;][ \t]+", t)]
    bare = [s for s in sentences if not re.search(r"(?i)licen|copyright|warrant|permission|distribut|rights", s)]
    assert any(0.6 <= plain_cosine(s) < 1 for s in bare)
    units = sorted({" ".join(u.replace("\n", " ").split()) for u in made + sentences})
    units = [u for u in units if not re.search(r"[.;][ \t]", u)]
    df = spark.createDataFrame([(str(i), u) for i, u in enumerate(units)], "path string, text string")
    got = {int(x.path): x.cosine for x in L.scan(df).collect()}
    for i, u in enumerate(units):
        want = plain_cosine(u)
        assert (got[i] is None) == (want < 0.6), (u, want, got[i])
        assert got[i] is None or abs(got[i] - want) <= 1e-4 or got[i] < want  # the named license may have another cosine
