"""JavaScript and TypeScript files by their tokens: references, routes, environment names and tests, in Arrow batches.

A text is read once from left to right into tokens, so what stands in comments, strings, templates or regular
expressions is never taken for code. Facts of a file are found by itself; where they lead is decided by joins. A null text
is empty, and a text that ends inside a string or comment is read to its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCRIPT = r"\.(?:js|jsx|ts|tsx|mjs|cjs|mts|cts)$"
FACTS = "path string, at int, kind string, line int, a string, b string, c string"
VERBS = ("get", "post", "put", "patch", "delete")


class Token(NamedTuple):
    """kind: word, number, sign, string, template, regex; a template's text is its words, with a NUL for each inner expression."""

    kind: str
    text: str
    start: int
    end: int


_START = re.compile(r"\s+|//[^\n]*|/\*(?:.*?\*/|.*)", re.S)
_WORD = re.compile(r"#?[^\W\d][\w$]*|\$[\w$]*")
_NUMBER = re.compile(r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d+)n?")
_SIGN = re.compile(r"=>|\.\.\.|\?\.|[=!]==?|[<>]=|&&|\|\||\?\?|.", re.S)
_PLAIN = re.compile(r"[^\\\n'\"]*")
#: After these words an expression begins, so a slash opens a regular expression.
BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    _tokens(text, 0, out, False)
    return out


def _string(text: str, at: int) -> tuple[str, int]:
    quote, i, got = text[at], at + 1, []
    while i < len(text) and text[i] != quote and text[i] != "\n":
        step = 2 if text[i] == "\\" else 1
        got.append(text[i + 1 : i + 2] if step == 2 else text[i])
        i += step
    return "".join(got), min(i + 1, len(text))


def _template(text: str, at: int, out: list[Token]) -> int:
    """Adds the template at a backquote, then the tokens of its inner expressions; gives its end."""
    i, got, place = at + 1, [], len(out)
    out.append(Token("template", "", at, at))
    while i < len(text) and text[i] != "`":
        if text.startswith("${", i):
            got.append("\0")
            i = _tokens(text, i + 2, out, True)
        else:
            step = 2 if text[i] == "\\" else 1
            got.append(text[i + step - 1 : i + step])
            i += step
    end = min(i + 1, len(text))
    out[place] = Token("template", "".join(got), at, end)
    return end


def _regex(text: str, at: int) -> int:
    """The end of the regular expression at a slash, or at itself where none is closed on the line."""
    i, inside = at + 1, False
    while i < len(text) and text[i] != "\n":
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif c == "/" and not inside:
            return re.compile(r"[a-z]*").match(text, i + 1).end()
        i += 1
    return at


def _tokens(text: str, at: int, out: list[Token], inner: bool) -> int:
    depth, n = 0, len(text)
    while at < n:
        if m := _START.match(text, at):
            at = m.end()
            continue
        c = text[at]
        if c in "'\"":
            got, end = _string(text, at)
            out.append(Token("string", got, at, end))
        elif c == "`":
            end = _template(text, at, out)
        elif m := _WORD.match(text, at):
            end = m.end()
            out.append(Token("word", m[0], at, end))
        elif m := _NUMBER.match(text, at):
            end = m.end()
            out.append(Token("number", m[0], at, end))
        else:
            last = out[-1] if out else None
            value = last is None or last.kind == "sign" and last.text not in ")]}" or last.kind == "word" and last.text in BEFORE_VALUE
            end = _regex(text, at) if c == "/" and value else at
            if end > at:
                out.append(Token("regex", text[at:end], at, end))
            else:
                m = _SIGN.match(text, at)
                end = m.end()
                if inner and c == "}" and depth == 0:
                    return end
                depth += (c == "{") - (c == "}")
                out.append(Token("sign", m[0], at, end))
        at = end
    return n


def closing(t: Sequence[Token], i: int) -> int:
    """The place of the bracket that closes the one at i, or the last place."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, []
    for k in range(i, len(t)):
        if t[k].kind == "sign":
            if t[k].text in pairs:
                depth.append(pairs[t[k].text])
            elif depth and t[k].text == depth[-1]:
                depth.pop()
                if not depth:
                    return k
    return len(t) - 1


def _literal(t: Token) -> str | None:
    return t.text if t.kind == "string" or t.kind == "template" and "\0" not in t.text else None


def read(text: str | None) -> list[tuple[str, int, str | None, str | None, str | None]]:
    """(kind, line, a, b, c): import, reexport, require, dynamic-import and literal (spec), route (route, verb), environment
    (name), test (name, body with the name masked)."""
    text = (text or "").removeprefix("﻿")
    t, rows = tokens(text), []
    word = lambda i: t[i].text if 0 <= i < len(t) and t[i].kind == "word" else None
    sign = lambda i: t[i].text if 0 <= i < len(t) and t[i].kind == "sign" else None
    told = lambda i: _literal(t[i]) if 0 <= i < len(t) else None
    starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def add(kind: str, i: int, a: str, b: str | None = None, c: str | None = None) -> None:
        import bisect

        rows.append((kind, bisect.bisect_right(starts, t[i].start), a, b, c))

    used = set()
    for i in range(len(t)):
        w, member = word(i), sign(i - 1) in (".", "?.")
        if w in ("import", "export") and not member and sign(i + 1) not in ("(", "."):
            if w == "import" and told(i + 1) is not None:
                add("import", i, told(i + 1))
                used.add(i + 1)
                continue
            k = i + 1  # a clause of names ends at its from
            while k < len(t) and (word(k) not in (None, "from") or sign(k) in ("{", "}", ",", "*") or word(k) == "from" and told(k + 1) is None):
                k += 1
            if word(k) == "from" and told(k + 1) is not None:
                add("import" if w == "import" else "reexport", i, told(k + 1))
                used.add(k + 1)
        elif w in ("import", "require") and not member and sign(i + 1) == "(" and told(i + 2) is not None and sign(i + 3) in (")", ","):
            add("require" if w == "require" else "dynamic-import", i, told(i + 2))
            used.add(i + 2)
        elif w in VERBS and member and word(i - 2) in ("app", "router") and sign(i + 1) == "(" and told(i + 2) is not None:
            add("route", i, told(i + 2), w.upper())
        elif w == "env" and member and word(i - 2) == "process":
            if sign(i + 1) == "." and word(i + 2):
                add("environment", i, word(i + 2))
            elif sign(i + 1) == "[" and told(i + 2) is not None:
                add("environment", i, told(i + 2))
        elif w in ("it", "test") and not member:
            k = i + 1
            while sign(k) == "." and word(k + 1):
                k += 2
                if sign(k) == "(" and word(k - 1) == "each":
                    k = closing(t, k) + 1
            if sign(k) == "(" and told(k + 1) is not None:
                end = t[closing(t, k)].end
                add("test", i, told(k + 1), text[t[i].start : end].replace(told(k + 1), "\1"))
    for i, x in enumerate(t):
        v = _literal(x)
        if i not in used and v and len(v) < 200 and re.match(r"(?:\.{0,2}/)?[\w-][\w./-]*\.[A-Za-z]\w*\Z", v):
            add("literal", i, v)
    return rows


def facts(files: DataFrame) -> DataFrame:
    """path, at, kind, line, a, b, c of all script files (see read)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ")[0] for f in FACTS.split(",")]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            rows = [(path, i, *x) for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, x in enumerate(read(text))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.filter(F.col("path").rlike(SCRIPT)).select("path", "text").mapInArrow(run, FACTS)


# What a relative reference may leave out, in the order in which it is tried.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
#: A compiled file is asked for where its source lies.
COMPILED = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}


def linked(files: DataFrame, stage=None) -> dict[str, DataFrame]:
    """edges (src, dst, kind, line), unresolved (path, spec, kind, line) and externals (name, n_files) of a tree (path, text).

    A relative reference leads to the first file that exists: as written, with an ending, as a folder's index, or at the
    source of a compiled name. A bare one is a package's, named by its first part, or its first two after an @. String
    constants that name a file (beside it, at the root, or below static or public) are references and never unresolved.
    """
    from .code import joined_path
    from .graph import cut
    from .python_source import beneath, first_existing, folder

    stage = stage or cut
    known = stage(facts(files)).withColumnRenamed("a", "spec")
    paths, key = stage(files.select("path").distinct()), ["path", "at", "kind", "line", "spec"]
    asked = known.filter("kind IN ('import', 'reexport', 'require', 'dynamic-import')").select(*key)
    near = asked.filter(F.col("spec").rlike(r"^\.{1,2}(?:/|$)")).withColumn("base", joined_path(folder(F.col("path")), F.regexp_replace("spec", r"[?#].*$", "")))
    stem, ending = F.regexp_replace("base", r"\.\w+$", ""), F.regexp_extract("base", r"(\.\w+)$", 1)
    sources = F.lit(None)
    for made, of in COMPILED.items():
        sources = F.when(ending == made, F.array(*[F.concat(stem, F.lit(e)) for e in of])).otherwise(sources)
    tries = F.concat(F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat(F.col("base"), e)), F.coalesce(sources, F.array().cast("array<string>")))
    found = near.join(first_existing(near.filter("base IS NOT NULL"), tries, paths, ["path", "at"]), ["path", "at"], "left")
    literal = known.filter("kind = 'literal'").select(*key)
    plain = F.regexp_replace("spec", r"^\.?/", "")
    named = first_existing(literal, F.array(*[beneath(b, plain) for b in (folder(F.col("path")), F.lit(""), F.lit("static"), F.lit("public"))]), paths, ["path", "at", "line"])
    edges = found.filter("target IS NOT NULL").select(F.col("path").alias("src"), F.col("target").alias("dst"), "kind", "line").unionByName(named.select(F.col("path").alias("src"), F.col("target").alias("dst"), F.lit("references").alias("kind"), "line"))
    bare = asked.filter(~F.col("spec").rlike(r"^(?:\.{1,2}(?:/|$)|/|[a-z]+://)"))
    name = F.regexp_extract("spec", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    return {
        "facts": known,
        "edges": edges.filter("src <> dst"),
        "unresolved": found.filter("target IS NULL").select("path", "spec", "kind", "line"),
        "externals": bare.groupBy(name.alias("name")).agg(F.count_distinct("path").alias("n_files")),
    }
