"""Maps against a plain reader by patterns, on written maps and on odd ones."""

import re

from tallywood.operators import maps as M
from tallywood.plans import map_files as Q
from tallywood.plans import registry

SF = "/root/testdata/sf0.001"


def half(text, marks):
    i, j = text.find(marks[0]), text.find(marks[1])
    return text[i + len(marks[0]) : j] if 0 <= i < j else ""


def plain(text):
    ids = set(re.findall(r"^\|[ \t]*`([^`\n]+)`[ \t]*\|", half(text, M.DERIVED), re.M))
    found = {}
    for part in re.split(r"^###[ \t]+", half(text, M.AUTHORED).replace("\r\n", "\n"), flags=re.M)[1:]:
        head, _, body = part.partition("\n")
        head = head.strip().strip("`")
        m = re.match(r"(?i)pattern:\s*(\S+)?", head)
        id = ("pattern:" + m[1] if m[1] else None) if m else (head.split() or [None])[0]
        if not id:
            continue
        fields, key = {}, None
        for line in body.split("\n"):
            if m := re.match(r"-\s*([a-z_]+)\s*:\s*(.*)$", line):
                key, fields[m[1]] = m[1], m[2].strip()
            elif not line.strip():
                key = None
            elif key and line[0] in " \t":
                fields[key] = (fields[key] + " " + line.strip()).strip()
        found[id] = fields
    return ids, found


def test_written_maps(spark):
    texts, derived = Q.written_maps(spark, SF)
    by_path = {r.path: r.text for r in texts.collect()}
    made = {(r.path, r.id): r for r in derived.collect()}
    ids = {(r.path, r.id) for r in M.derived_ids(texts).collect()}
    own = {(r.path, r.id): r.fields for r in M.authored_entries(texts).collect()}
    want = {p: plain(t) for p, t in by_path.items()}
    assert ids == {(p, i) for p, (x, _) in want.items() for i in x}
    assert own == {(p, i): f for p, (_, x) in want.items() for i, f in x.items()} and any(i.startswith("pattern:") for _, i in own)
    got = {(r.path, r.id): r for r in registry.QUERIES["map_entries"](spark, SF).collect()}
    assert set(got) == set(made) | {k for k in own if not k[1].startswith("pattern:")}
    for k, r in got.items():
        f = own.get(k, {})
        word = re.match(r"\s*([A-Za-z]+)\s*(?:$|[(:]|\s[-–—])", f.get("face", ""))
        said = word[1].lower() if word and word[1].lower() in M.FACES else None
        assert r.face == (said or (made[k].face if k in made else "unclassified")) and r.is_derived == (k in made)
        assert r.grade == (f.get("grade", "").strip().upper() or None) and r.note == ("route" if k in made else "mapped by hand")
    new = {r.path: r for r in M.written(texts, M.derived_tables(derived)).collect()}
    for p, t in by_path.items():
        i, j = t.find(M.DERIVED[0]), t.find(M.DERIVED[1])
        assert new[p].refused == (not 0 <= i < j)
        if new[p].refused:
            assert new[p].text == t
            continue
        a, b = t[: i + len(M.DERIVED[0])], t[j:]
        assert new[p].text.startswith(a) and new[p].text.endswith(b) and ("\r\n" in t) == ("\r\n" in new[p].text)
        assert plain(new[p].text) == ({x for q, x in made if q == p}, plain(t)[1])
    rows = registry.QUERIES["maps_written"](spark, SF).collect()
    assert {r.path: r.n_ids for r in rows if not r.refused} == {p: sum(q == p for q, _ in made) for p in by_path if not new[p].refused}


def test_null_and_empty_maps(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", M.DERIVED[1] + M.DERIVED[0])], "path string, text string")
    none = spark.createDataFrame([], "path string, block string")
    assert M.derived_ids(df).count() == M.authored_entries(df).count() == 0
    assert {(r.path, r.text, r.refused) for r in M.written(df, none).collect()} == {("a", None, True), ("b", "", True), ("c", M.DERIVED[1] + M.DERIVED[0], True)}


def test_maps_are_made_and_read_a_few_at_a_time(spark, monkeypatch):
    import pyarrow as pa
    from tallywood.operators import maps as M

    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(1000)]})
    parts = list(M.few_rows(iter([batch])))
    assert max(p.num_rows for p in parts) <= 64 and [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    made = spark.range(1000).selectExpr("CAST(id AS STRING) AS path", f"concat('{M.AUTHORED[0]}\\n### a', id, '\\n{M.AUTHORED[1]}') AS text").coalesce(1)
    sizes = M.authored_entries(made).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert sum(x.n for x in sizes) == 1000
