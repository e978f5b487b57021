"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grades, in order of strength.
GRADES = ("DRIVEN", "TESTED", "ASSERTED", "UNKNOWN")


def slug(text: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends; ``unnamed`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "unnamed").otherwise(F.coalesce(s, F.lit("unnamed")))


def route_slug(path: Column) -> Column:
    return F.when(path == "/", "root").otherwise(slug(path))


def page_route(stem: Column) -> Column:
    """A page's route by its stem: a last ``index`` stands for its folder."""
    return F.concat(F.lit("/"), F.regexp_replace(stem, "(^|/)index$", ""))


def longest_fixed(route: Column, parameter: str = r"\{[^}]*\}|:[A-Za-z_]+|\[[^\]]*\]") -> Column:
    """The longest part of a route between parameters; of equally long ones the first."""
    parts = F.split(route, parameter)
    ranked = F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("i"), p.alias("p")))
    return F.array_max(ranked)["p"]


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, that holds the character at offset, from 0."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def line_count(text: Column) -> Column:
    """Lines, the last one also if no newline ends it."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1))


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for name, endings in (("python", ("py", "pyi")), ("javascript", ("js", "jsx", "mjs", "cjs")), ("typescript", ("ts", "tsx", "mts", "cts")), ("markdown", ("md", "mdx", "markdown")), ("html", ("html", "htm")), ("json", ("json",)), ("css", ("css", "scss"))):
        out = F.when(ext.isin(*endings), name).otherwise(out)
    return out


def kind(path: Column, text: Column) -> Column:
    """code, prose or data; a first line that names an interpreter wins over the ending."""
    return F.when(text.startswith("#!"), "code").when(language(path).isin("python", "javascript", "typescript"), "code").when(path.rlike(r"(?i)\.(sh|bash|rb|go|rs|java|c|h|cpp|php|pl)$"), "code").when(path.rlike(r"(?i)\.(md|mdx|markdown|txt|rst)$"), "prose").otherwise("data")


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(h != "", h)


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` parts; null where it is absolute, has a ``..`` part or nothing left."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    bad = path.startswith("/") | F.array_contains(parts, "..")
    return F.when(~bad & (F.size(parts) > 0), F.concat_ws("/", parts))


#: A number with sign and exponent; digits inside a name are none.
NUMBER = r"(?<![\w.])[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})")), lambda x: x.cast("double"))


def skeleton(text: Column) -> Column:
    """The text with ``#`` for every number."""
    return F.regexp_replace(text, NUMBER, "#")


def segments(name: Column) -> Column:
    """Lower-case words of an identifier's last dotted part: capitals begin a word, digits are one by themselves."""
    words = F.regexp_extract_all(F.substring_index(name, ".", -1), F.lit("([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"))
    return F.transform(words, F.lower)


#: Names of bounds from above and from below: the first are looser when they grow, the others when they fall.
CEILINGS = ("allowance", "budget", "cap", "ceiling", "max", "retries", "timeout", "tolerance", "upper")
FLOORS = ("coverage", "floor", "lower", "min", "quorum", "required", "under")


def direction(key: Column, before: Column, after: Column) -> Column:
    """Which way of a number is looser: up, down or null.

    A comparison on either side tells it (``x < 5`` and ``5 > x`` bound x from above), and one for equality
    leaves it open. Without any, the words of the key do, unless they name bounds of both kinds.
    """
    left, right = F.regexp_extract(before, r"([<>=!]=?)\s*$", 1), F.regexp_extract(after, r"^\s*([<>=!]=?)", 1)
    sign = F.substring(F.when(left.rlike("[<>]|[=!]="), left).otherwise(F.translate(right, "<>", "><")), 1, 1)
    exact = left.isin("==", "!=") | right.isin("==", "!=")
    held = lambda words: F.arrays_overlap(segments(key), F.array(*map(F.lit, words)))
    named = F.when(held(CEILINGS) & ~held(FLOORS), "up").when(held(FLOORS) & ~held(CEILINGS), "down")
    return F.when(exact, F.lit(None)).when(sign == "<", "up").when(sign == ">", "down").otherwise(named)


def blob_id(body: Column) -> Column:
    """The id that git gives a file of these bytes."""
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.length(body).cast("string")).cast("binary"), F.unhex(F.lit("00")), body))


def tokens(text: Column, stop: tuple[str, ...]) -> Column:
    """The set of words of three letters or more, less stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9-]{2,})"))), F.array(*[F.lit(x) for x in stop]))


def excerpt(text: Column, most: int = 160) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def metric(raw: Column) -> tuple[Column, Column]:
    """(number, kind): a text with a dot as a float, else as a whole number, else kept as text."""
    dotted = raw.try_cast("double")
    whole = raw.try_cast("long")
    num = F.when(raw.contains("."), dotted).otherwise(whole.cast("double"))
    return num, F.when(num.isNull(), "text").when(raw.contains("."), "float").otherwise("int")


def face(note: Column, known: tuple[str, ...] = ("user", "dev")) -> Column:
    """The first word before a dash, bracket or colon, if it is a known face."""
    word = F.lower(F.trim(F.regexp_extract(note, r"^\s*([A-Za-z]+)\s*(?:[-(:]|$)", 1)))
    return F.when(word.isin(*known), word)


def region(lo: Column, hi: Column, declared: Column, around: int = 30) -> tuple[Column, Column]:
    """A pointer's own span if it declares one, else the lines around it, from 1."""
    return F.when(declared, lo).otherwise(F.greatest(F.lit(1), lo - around)), F.when(declared, hi).otherwise(lo + around)


def judgment(p: Column) -> tuple[Column, Column]:
    """(band, near a bound)."""
    return F.when(p < 0.3, "low").when(p < 0.7, "torn").otherwise("high"), F.least(F.abs(p - 0.3), F.abs(p - 0.7)) <= 0.08


def later_day(a: Column, b: Column) -> Column:
    """Whether a's first ten characters are a later day than b's."""
    return F.substring(a, 1, 10).try_cast("date") > F.substring(b, 1, 10).try_cast("date")


def generated(path: Column, text: Column) -> Column:
    """Why a file counts as generated, or null: its name, its folder, or a line of more than 2,000 characters."""
    widest = F.array_max(F.transform(F.split(F.regexp_replace(text, "data:[a-z/+;-]+base64,[A-Za-z0-9+/=]+", ""), "\n"), lambda x: F.length(x)))
    return F.when(path.rlike(r"(?:\.min\.|\.bundle\.|\.lock$|-lock\.)"), "name").when(path.rlike(r"(?:^|/)(?:vendor|third_party|node_modules|dist)/"), "vendored").when(widest > 2000, "long line")


# Four different predicates for "is a test"; they aren't one.
def test_in_graph(path: Column) -> Column:
    return path.rlike(r"\.(?:py|js|jsx|ts|tsx|mjs|cjs)$") & (path.rlike(r"(?:^|/)tests?/") | path.rlike(r"(?:^|/)(?:test_[^/]*|[^/]*_test|[^/]*\.(?:test|spec)|conftest)\.[a-z]+$"))


def test_in_map(path: Column) -> Column:
    return path.rlike(r"(?:^|/)(?:tests?|__tests__)/|\.(?:test|spec)\.")


def test_in_scan(path: Column) -> Column:
    return path.rlike(r"(?i)(?:^|/)(?:tests?|__tests__|fixtures|e2e)/|\.(?:test|spec)\.|(?:^|[/_])selftest")


def test_in_guard(path: Column) -> Column:
    return test_in_graph(path) & ~path.rlike(r"(?:^|/)(?:conftest|__init__|setup)\.py$")


def is_ci(path: Column) -> Column:
    """Whether a path is that of a file which tells a build service what to run."""
    return path.rlike(r"(?:^|/)\.github/workflows/[^/]+\.ya?ml$|(?:^|/)(?:\.gitlab-ci\.yml|azure-pipelines\.yml|Jenkinsfile|\.travis\.yml)$|(?:^|/)\.circleci/config\.yml$")


def in_scope(path: Column, globs: str) -> Column:
    """Whether a comma-separated list of globs holds a path: as a whole, below any folder, or after a slash."""
    out = F.lit(False)
    for g in filter(None, (x.strip() for x in globs.split(","))):
        body = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in r"\.+()[]{}^$|" else c for c in g)
        out = out | path.rlike(f"^(?:.*/)?{body}$") | F.concat(F.lit("/"), path).rlike(f"^{body}$")
    return out


def is_binary(content: Column) -> Column:
    """A NUL among the first 8,192 bytes."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, 8192)), "(..)", "$1 ")) > 0


def text_of(content: Column) -> Column:
    """Bytes as text: UTF-8 with replacement, no byte-order mark, lines ended by newlines alone."""
    return F.regexp_replace(F.regexp_replace(F.decode(content, "UTF-8"), "^\\uFEFF", ""), "\r\n", "\n")
