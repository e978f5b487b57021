"""Scripts by tokens against a plain reader that blanks comments and strings by hand, and a plain resolver."""

import posixpath
import re

import pytest

from tallywood.operators import script_source as J
from tallywood.plans import registry
from tallywood.plans import source_trees as S

SF = "/root/testdata/sf0.01"


def plain(text):
    """(kind, line, spec) of the written statements: whole comments and templates are cut out first, line by line."""
    out = []
    text = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    for m in re.finditer(r"^(.*?)(?:$)", text, re.M):
        x, line = m[1], text.count("\n", 0, m.start()) + 1
        if x.startswith("//") or x.startswith("const t = `") or x.startswith("const v = a"):
            continue
        q = r"(['\"])(.*?)\1"
        if x.startswith("import {"):
            nxt = text[m.end() + 1 :].split("\n")[0]
            out.append(("import", line, re.search(rf"from {q}", nxt)[2]))
        elif y := re.match(rf"import (?:\w+ from )?{q}", x):
            out.append(("import", line, y[2]))
        elif y := re.match(rf"export (?:\*|\{{ y \}}) from {q}", x):
            out.append(("reexport", line, y[2]))
        elif y := re.search(rf"= require\({q}\)", x):
            out.append(("require", line, y[2]))
        elif y := re.search(rf"=> import\({q}\)", x):
            out.append(("dynamic-import", line, y[2]))
        elif y := re.match(rf"load\({q}\)", x):
            out.append(("literal", line, y[2]))
        elif y := re.match(rf"app\.(?:get|post)\({q}.*process\.env\.(\w+)", x):
            out += [("route", line, y[2]), ("environment", line, y[3])]
    return out


def target(path, kind, spec, files):
    own = posixpath.dirname(path)
    if kind == "literal":
        return next((p for p in (posixpath.join(b, spec) for b in (own, "", "static", "public")) if p in files), None)
    base = posixpath.normpath(posixpath.join(own, spec))
    tries = [base + e for e in J.ENDINGS]
    for made, of in J.COMPILED.items():
        if base.endswith(made):
            tries += [base.removesuffix(made) + e for e in of]
    return next((p for p in tries if p in files), None) if not base.startswith("..") else None


def test_the_written_tree(spark):
    files = {r.path: r.text for r in S.tree(spark, SF).collect()}
    edges, lost, told = set(), set(), set()
    for p, t in files.items():
        for kind, line, spec in plain(t) if re.search(J.SCRIPT, p) else ():
            if kind in ("route", "environment"):
                told.add((p, line, kind, spec))
            elif kind == "literal" or spec.startswith("."):
                to = target(p, kind, spec, files)
                if to and to != p:
                    edges.add((p, to, "references" if kind == "literal" else kind, line))
                elif not to and kind != "literal":
                    lost.add((p, line, f"unresolved {kind}", spec))
    got = J.linked(spark.createDataFrame(list(files.items()), "path string, text string"))
    assert {(r.src, r.dst, r.kind, r.line) for r in got["edges"].collect()} == edges and len(edges) > 50
    assert {e[2] for e in edges} == {"import", "reexport", "require", "dynamic-import", "references"}
    assert {tuple(r) for r in registry.QUERIES["tree_script_interfaces"](spark, SF).collect()} == told | lost
    assert {r.name for r in got["externals"].collect()} == {"react", "@scope/pkg", "node:fs"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("import type { T } from './t'; import * as n from \"n\"; import './side.css'", [("import", "./t"), ("import", "n"), ("import", "./side.css")]),
        ("x = `${require('in')} require('no')`; // require('no')\n/* require('no') */ require(`ok`)", [("require", "in"), ("require", "ok")]),
        ("const s = \"import a from './no'\"; const r = /require\\('no'\\)/; a = b / require('yes') / c", [("require", "yes")]),
        ("foo.require('no'); foo.import('no'); import(x); import(`./${y}`); import.meta.url", []),
        ("export const from = 'x'; export default f; export { a } from \"./q\"", [("reexport", "./q")]),
        ("`open ${ '", []), ("/* open", []), ("'open\nrequire('next')", [("require", "next")]), (None, []),
    ],
)
def test_tokens(text, want):
    assert [(k, a) for k, _, a, _, _ in J.read(text) if k not in ("literal", "environment")] == want


def test_bodies_of_tests_are_masked():
    text = "it('adds', () => {\n  expect(adds(')')).toBe(/[)]/); // )\n});\ntest.each([[1], [2]])('each', f);\nxit('no', f); a.it('no', f)"
    got = [(line, a, b) for k, line, a, b, _ in J.read(text) if k == "test"]
    assert got == [(1, "adds", "it('\1', () => {\n  expect(\1(')')).toBe(/[)]/); // )\n})"), (4, "each", "test.\1([[1], [2]])('\1', f)")]
