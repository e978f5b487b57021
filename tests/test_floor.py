"""The guard against a plain one that compares two dictionaries of files, line by line."""

import difflib
import re
from collections import Counter, defaultdict

from tallywood.functions import text as T
from tallywood.operators import floor as G
from tallywood.plans import source_trees as S

SF = "/root/testdata/sf0.001"
NUMBER = re.compile(T.NUMBER)


def segments(key):
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", key.rpartition(".")[2])}


def ways(line):
    """(value, key, way) of each number of a line."""
    found, out = list(NUMBER.finditer(line)), []
    for n, m in enumerate(found):
        before = line[found[n - 1].end() if n else 0 : m.start()]
        after = line[m.end() : found[n + 1].start() if n + 1 < len(found) else len(line)]
        key = (re.search(r"([A-Za-z_][\w.-]*)\W{0,3}$", before) or [None, ""])[1]
        left, right = re.search(r"([<>=!]=?)\s*$", before), re.search(r"^\s*([<>=!]=?)", after)
        left, right = left[1] if left else "", right[1] if right else ""
        way = None
        if left in ("==", "!=") or right in ("==", "!="):
            out.append((float(m[0]), key, None))
            continue
        if re.search("[<>]", left):
            way = "up" if left[0] == "<" else "down"
        elif re.search("[<>]", right):
            way = "up" if right[0] == ">" else "down"
        else:
            up, down = bool(segments(key) & set(T.CEILINGS)), bool(segments(key) & set(T.FLOORS))
            way = "up" if up and not down else "down" if down and not up else None
        out.append((float(m[0]), key, way))
    return out


def is_test(p):
    named = re.search(r"(?:^|/)tests?/", p) or re.search(r"(?:^|/)(?:test_[^/]*|[^/]*_test|[^/]*\.(?:test|spec)|conftest)\.[a-z]+$", p)
    return bool(re.search(r"\.(?:py|js|jsx|ts|tsx|mjs|cjs)$", p) and named and not re.search(r"(?:^|/)(?:conftest|__init__|setup)\.py$", p)) or p.endswith("_test.go")


def is_ci(p):
    return p.startswith(".github/workflows/") or p.endswith("package.json")


def is_config(p):
    return p.rpartition("/")[2] in G.CONFIG_FILES


def steps(p, text):
    if p.endswith("package.json"):
        pairs = [(i, m, x) for i, x in enumerate(text.split("\n"), 1) if (m := re.match(r'\s*"([\w:.-]+)"\s*:\s*"([^"]*)"', x))]
        return [(i, m[1], x.strip()) for i, m, x in pairs if set(re.split(r"[\W_]+", m[1])) & set(G.CHECKERS) and not re.match(r"[^A-Za-z]|[a-z]+:", m[2])]
    out = []
    for i, x in enumerate(text.split("\n"), 1):
        if not x.strip() or x.strip().startswith("#"):
            continue
        m = re.match(rf"[\s-]*({'|'.join(G.STEP_KEYS)})\b:?\s(.*)", x)
        if not m and not (re.match(r"\s*-\s", x) and not re.match(r"\s*-\s+[\w.-]+:(?:\s|$)", x)):
            continue
        check = next((w for w in re.findall(r"\w+", (m[2] if m else x).lower()) if w in G.CHECKERS), None)
        if check:
            out.append((i, f"{m[1] if m else '-'}:{check}", x.strip()))
    return out


def analyze(p, old, new, out):
    ol, nl = old.split("\n"), new.split("\n")
    add = lambda kind, line, at_base, what, detail=None: out.append((kind, p, line, at_base, what, detail))
    scope = {"code": not re.search(G.PROSE, p), "ci": is_ci(p), "config": is_config(p), "ci or config": is_ci(p) or is_config(p)}
    for kind, rule, pattern, where in G.RULES:
        if scope[where]:
            have = Counter(x.strip() for x in ol if re.search(pattern, x) and x.strip())
            for i, x in enumerate(nl, 1):
                if x.strip() and re.search(pattern, x):
                    if have[x.strip()]:
                        have[x.strip()] -= 1
                    else:
                        add(kind, i, False, x.strip(), rule)
    if is_test(p):
        ot, nt = G._tests(p, old), G._tests(p, new)
        o, n = Counter(t[1] for t in ot), Counter(t[1] for t in nt)
        fresh, left = [t for t in nt if n[t[1]] > o[t[1]]], Counter({k: o[k] - n[k] for k in o if o[k] > n[k]})
        lost = []
        for line, name, body in ot:
            if left[name] > 0:
                left[name] -= 1
                twin = next((t for t in fresh if t[2] == body), None)
                if twin:
                    fresh.remove(twin)
                else:
                    lost.append((line, name))
        names = [t[1] for t in fresh]
        hint = "; new here: " + ", ".join(names[:3]) + (f" +{len(names) - 3} more" if len(names) > 3 else "") if names else ""
        for line, name in lost:
            add("test removed", line, True, name, f"{len(ot)} -> {len(nt)}{hint}")
        count = lambda lines: sum(len(re.findall(G.ASSERTION, x)) for x in lines if not re.match(r"\s*(?:#|//|\*|/\*)", x))
        if count(nl) < count(ol):
            add("assertions dropped", None, False, f"{count(ol)} -> {count(nl)}")
    if is_ci(p):
        have = Counter(k for _, k, _ in steps(p, new))
        for i, k, said in steps(p, old):
            if have[k]:
                have[k] -= 1
            else:
                add("step removed", i, True, said, k)
    if is_config(p):
        lists = []
        for lines in (ol, nl):
            found = defaultdict(lambda: [0, set()])
            for i, x in enumerate(lines, 1):
                if m := re.match(rf"\s*[\"']?({'|'.join(G.COLLECTING)})[\"']?\s*[=:]\s*(\S.*)$", x):
                    found[m[1]] = [i, found[m[1]][1] | set(re.findall(r"[^\s,\"'\[\]()]+", m[2]))]
            lists.append(found)
        for key, (_, had) in lists[0].items():
            if key in lists[1] and had - lists[1][key][1]:
                add("tests excluded", lists[1][key][0], False, f"{key} no longer lists {', '.join(sorted(had - lists[1][key][1]))}")
    if is_ci(p) or is_config(p):
        have, words = Counter(x.strip() for x in nl), set(re.findall(r"[\w.-]+", new))
        for i, x in enumerate(ol, 1):
            key = next((k for _, k, w in ways(x.strip()) if w == "down"), None)
            if key is None:
                continue
            if have[x.strip()]:
                have[x.strip()] -= 1
            elif key not in words:
                add("threshold loosened", i, True, f"{x.strip()} -> (removed)")
    if (is_test(p) or is_ci(p) or is_config(p)) and old and new:
        ol, nl = old.splitlines(), new.splitlines()
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, ol, nl, autojunk=False).get_opcodes():
            used = set()
            for i in range(i1, i2) if tag == "replace" else ():
                bare = NUMBER.sub("#", ol[i]).strip()
                j = next((j for j in range(j1, j2) if j not in used and NUMBER.sub("#", nl[j]).strip() == bare and "#" in bare), None)
                if j is None:
                    continue
                used.add(j)
                if any(w == "up" and b > a or w == "down" and b < a for (a, _, _), (b, _, w) in zip(ways(ol[i].strip()), ways(nl[j].strip()), strict=True)):
                    add("threshold loosened", j + 1, False, f"{ol[i].strip()} -> {nl[j].strip()}")


def plain(base, now):
    out, moved, free = [], {}, sorted(p for p in now if p not in base)
    for p in sorted(p for p in base if p not in now):
        m = next((q for q in free if now[q] == base[p]), None)
        if m:
            free.remove(m)
        job = lambda x: (is_ci(x), is_config(x))
        if is_test(p):
            if not m or not is_test(m):
                out.append(("test file renamed away" if m else "test file deleted", p, None, True, m or p, None))
        elif not m or job(m) != job(p):
            analyze(p, base[p], "", out)
    for p in free:
        analyze(p, "", now[p], out)
    for p in base.keys() & now.keys():
        if base[p] != now[p]:
            analyze(p, base[p], now[p], out)
    return out


def compare(spark, base, now):
    df = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    got = Counter(tuple(r) for r in G.findings(df(base), df(now), *S.floor_conditions()).collect())
    want = Counter(plain(base, now))
    assert not got - want and not want - got, (list((got - want))[:4], list((want - got))[:4])
    return want


def test_the_written_states(spark):
    base, now = ({r.path: r.text for r in S.checks(spark, "/root/testdata/sf0.01", state).collect()} for state in ("base", "now"))
    want = compare(spark, base, now)
    assert {k[0] for k in want} == {r[0] for r in G.RULES} | {"test file deleted", "test file renamed away", "test removed", "assertions dropped", "step removed", "threshold loosened"}
    assert sum(want.values()) > 400


def test_pairs_moves_and_twins(spark):
    t = "tests/test_a.py"
    base = {
        t: "def test_a():\n    assert x < 5\n\ndef test_b():\n    assert f(timeout=3)\n\ndef test_c():\n    assert f(timeout=3)\n", "w/pyproject.toml": "fail_under = 90\nmax_retries = 2\nother = 1\ntestpaths = ['a', 'b']\n",
        ".github/workflows/w.yml": "- run: pytest -q\n- run: ruff\n", "tests/test_gone.py": "def test_x(): assert 1\n", "tests/test_away.py": "def test_y(): assert 1\n", "tests/test_kept.py": "def test_z(): assert 1\n", "a.bin": "a\0b", "docs/x.md": "a",
    }
    now = {
        t: "def test_a():\n    assert x < 7\n\ndef test_new():\n    assert f(timeout=3)\n", "w/pyproject.toml": "fail_under = 80\nmax_retries = 1\nother = 9\ntestpaths = ['a']\n", ".github/workflows/w.yml": "- run: ruff --fix\n\n- run: pytest -x -q || true\n",
        "misc/away.txt": "def test_y(): assert 1\n", "tests/test_named.py": "def test_z(): assert 1\n", "a.bin": "a\0c", "docs/x.md": "a # noqa",
    }
    want = {k[:1] + k[4:5] for k in compare(spark, base, now)}
    assert want == {
        ("threshold loosened", "assert x < 5 -> assert x < 7"), ("threshold loosened", "fail_under = 90 -> fail_under = 80"), ("test removed", "test_c"), ("assertions dropped", "3 -> 2"), ("tests excluded", "testpaths no longer lists b"),
        ("step softened", "- run: pytest -x -q || true"), ("test file deleted", "tests/test_gone.py"), ("test file renamed away", "misc/away.txt"),
    }


def test_nothing_and_notes(spark):
    empty = spark.createDataFrame([], "path string, text string")
    assert G.findings(empty, empty, *S.floor_conditions()).count() == 0
    one = spark.createDataFrame([("tests/test_q.py", "x\0"), ("b.py", "y" * 50), ("c.py", None)], "path string, text string")
    assert {tuple(r) for r in G.notes(one, empty, most=20).collect()} == {("tests/test_q.py", "no text"), ("b.py", "counted, but not aligned")}
    assert G.findings(one, empty, *S.floor_conditions()).count() == 0


def test_files_of_any_length_are_aligned(spark):
    rows = lambda bound: "".join(f"# {i} {'filled ' * 150}\n" for i in range(600)) + f"def test_a():\n    assert x < {bound}\n" + "".join(f"# {i} {'more ' * 200}\n" for i in range(600))
    steps = lambda least: f"jobs:\n  min_rate: {least}\n" + f"# {'a b ' * 400_000}\n"
    base = {"tests/test_long.py": rows(5), ".github/workflows/long.yml": steps(9)}
    now = {"tests/test_long.py": rows(7), ".github/workflows/long.yml": steps(3)}
    assert min(map(len, [*base.values(), *now.values()])) > 1 << 20
    want = {k[:2] + k[4:5] for k in compare(spark, base, now)}
    assert want == {("threshold loosened", "tests/test_long.py", "assert x < 5 -> assert x < 7"), ("threshold loosened", ".github/workflows/long.yml", "min_rate: 9 -> min_rate: 3")}


def test_a_line_of_many_numbers(spark):
    said = lambda last: "{" + ", ".join(f'"max_{i}": {i if i < 19_999 else last}' for i in range(20_000)) + "}\n"
    want = compare(spark, {"app/package.json": said(1)}, {"app/package.json": said(2)})
    assert [k[0] for k in want] == ["threshold loosened"]


def test_keys_before_numbers(spark):
    lines = ["max-9", "max - 9", "a.b-c = 9", "9 9", "x__y('9", "x    9", "a1 b2. 9", "é9", "--min_a.  9", "9max 9", "", "max\r9"]
    want = [(re.search(r"([A-Za-z_](?a:[\w.-])*)(?a:\W){0,3}$", x[: x.rfind("9")]) or [None, ""])[1] for x in lines]
    rows = spark.createDataFrame([(i, x[: x.rfind("9")]) for i, x in enumerate(lines)], "i int, before string")
    assert [r.k for r in rows.select("i", G.key_before(rows.before).alias("k")).orderBy("i").collect()] == want
