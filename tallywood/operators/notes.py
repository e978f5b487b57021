"""What prose and configuration say: phrases, pointers to lines, fenced blocks, set-apart spans, collected paths, deployments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of quote marks, and words after which a description says what it is asked for.
QUOTES = (('"', '"'), ("“", "”"), ("'", "'"), ("‘", "’"))
CUES = ("ask for", "asks for", "invokes", "mentions", "request", "requests", "say", "says", "types", "wants")
POINTER = r"(?<![\w./-])([\w][\w./-]*):(\d+)(?:-(\d+))?(?:\s+@([0-9a-f]{7,40}))?(?![\w:])"
JOINED = r"""(?:\b(?:os\.path|posixpath|ntpath|path)\.join\(\s*(?:[\w.()]+\s*,)?|\.joinpath\(|\b[\w.()]+\s*/)\s*((?:["'][^"'\n]{1,200}["']\s*[,/]?\s*)+)"""
NEVER_SHARED = ["and", "skill", "skills", "the"]
FENCE = r"^\s*(?:```|~~~)"


def phrases(text: Column, cues: Sequence[str] = CUES) -> Column:
    """The distinct phrases, sorted and in lower case, of 3 to 60 characters, that a description names: what stands in quotes
    on one line, /commands, and what follows one of cues up to the end of its clause. A null text has none.

    A clause ends at a stop, a bracket, a line's end, and before or, nor and and.
    """
    t = F.coalesce(text, F.lit(""))
    quoted = [F.regexp_extract_all(t, F.lit(f"{a}([^{a}{b}\n]+){b}"), F.lit(1)) for a, b in QUOTES]
    commands = F.filter(F.split(t, r"[\s,.;:()\"'“”]+"), lambda w: w.rlike("^/[a-z][a-z0-9-]+$"))
    clauses = F.split(t, r"[,.;:()\n]|\s(?:or|nor|and)\s")
    said = F.transform(clauses, lambda c: F.regexp_extract(c, rf"(?i)\b(?:{'|'.join(cues)})\s+([A-Za-z0-9].*)$", 1))
    found = F.transform(F.concat(*quoted, commands, said), lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x).between(3, 60))))


def name_hit(a: Column, b: Column, jaccard: Column, phrase: Column, long: int = 5) -> Column:
    """Whether two hyphenated names are of one kind: equal, one of more than long characters within the other, or two parts
    shared where jaccard is 0.05 or more or a phrase is shared."""
    parts = F.array_except(F.array_intersect(F.split(a, "-"), F.split(b, "-")), F.array(*map(F.lit, NEVER_SHARED)))
    return (a == b) | ((F.length(a) > long) & b.contains(a)) | ((F.length(b) > long) & a.contains(b)) | ((F.size(parts) >= 2) & ((jaccard >= 0.05) | phrase))


def host_like(token: Column, number: Column, endings: Sequence[str]) -> Column:
    """Whether token, with a port-sized number, is a dotted lower-case name that ends as a host may."""
    dotted = token.rlike(r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+$")
    return dotted & F.length(number).between(2, 5) & F.substring_index(token, ".", -1).isin(*endings)


def pointers(texts: DataFrame, files: DataFrame, id: str = "id", text: str = "text", path: str = "path", endings: Sequence[str] = ("com", "dev", "io", "local", "net", "org", "test")) -> DataFrame:
    """(id, path, first, last, stamp, there): each path:N, path:N-M or either with @stamp of the texts, repeats once.

    A token counts if it names a file, has a folder, or has an extension and is not like a host.
    """
    each = F.regexp_extract_all(F.col(text), F.lit(POINTER), F.lit(0))
    tokens = texts.select(id, F.explode(each).alias("p"))
    group = lambda n: F.regexp_extract("p", POINTER, n)
    tokens = tokens.select(id, group(1).alias("path"), group(2).alias("n"), group(3).alias("m"), group(4).alias("stamp"))
    met = tokens.join(files.select(F.col(path).alias("path")).distinct().withColumn("there", F.lit(True)), "path", "left")
    shaped = F.col("path").contains("/") | (F.col("path").rlike(r"\.[A-Za-z]\w*$") & ~host_like(F.col("path"), F.col("n"), endings))
    there = F.coalesce("there", F.lit(False))
    last = F.when(F.col("m") == "", F.col("n")).otherwise(F.col("m")).cast("long")
    return met.filter(there | shaped).select(id, "path", F.col("n").cast("long").alias("first"), last.alias("last"), F.nullif("stamp", F.lit("")).alias("stamp"), there.alias("there")).distinct()


def opens_block(lines: DataFrame, file: str, line: str, text: str) -> DataFrame:
    """lines with opens: whether the next line of the file that isn't blank opens a fenced block."""
    w = Window.partitionBy(file).orderBy(line).rowsBetween(1, Window.unboundedFollowing)
    fence = F.when(F.col(text).rlike(r"\S"), F.col(text).rlike(FENCE))
    return lines.withColumn("opens", F.coalesce(F.first(fence, ignorenulls=True).over(w), F.lit(False)))


def fixture_spans(lines: DataFrame, file: str, line: str, text: str, pragma: str, bare_within: int = 10) -> DataFrame:
    """(file, first, last): the spans that a pragma sets apart; its first group is -begin, -end or empty.

    A begin runs to the next end or the end of the file, later begins within count as nothing, and a bare pragma among the
    first bare_within lines takes the whole file. Only lines with the pragma are sorted.
    """
    ends = lines.groupBy(file).agg(F.max(line).alias("n"))
    marks = lines.filter(F.col(text).rlike(pragma)).select(file, F.col(line).alias("at"), F.regexp_extract(text, pragma, 1).alias("mark"))
    before = Window.partitionBy(file).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    spans = marks.withColumn("turn", F.coalesce(F.count_if(F.col("mark") == "-end").over(before), F.lit(0)))
    only = lambda m: F.min(F.when(F.col("mark") == m, F.col("at")))
    spans = spans.groupBy(file, "turn").agg(only("-begin").alias("first"), only("-end").alias("last")).filter("first IS NOT NULL")
    whole = marks.filter((F.col("mark") == "") & (F.col("at") <= bare_within)).select(file).distinct()
    some = spans.join(whole, file, "left_anti").select(file, "first", "last").unionAll(whole.select(file, F.lit(1).alias("first"), F.lit(None).alias("last")))
    return some.join(ends, file).select(file, F.col("first").cast("long").alias("first"), F.coalesce("last", "n").cast("long").alias("last"))


def collected_paths(lines: DataFrame, file: str, line: str, text: str, keys: Sequence[str]) -> DataFrame:
    """(file, key, line, entries): the entries that lines ``key = a, "b"`` list, with the first such line of a key."""
    form = rf"^\s*\"?({'|'.join(keys)})\"?\s*[=:]\s*(\S.*)$"
    entry = F.regexp_extract_all(F.regexp_extract(text, form, 2), F.lit(r"([^\s,\"'\[\]]+)"), F.lit(1))
    found = lines.filter(F.col(text).rlike(form)).select(file, F.regexp_extract(text, form, 1).alias("key"), F.col(line).alias("line"), F.explode_outer(entry).alias("e"))
    return found.groupBy(file, "key").agg(F.min("line").alias("line"), F.array_sort(F.collect_set("e")).alias("entries"))


def deployments(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, what) of Procfile processes, Dockerfiles with their ports, and workflows.

    files: path, text. A workflow without a name has that of its file.
    """
    base = F.substring_index("path", "/", -1)
    lines = files.filter(base == "Procfile").select("path", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    form = r"^([A-Za-z0-9_-]+)\s*:\s*(\S+)"
    processes = lines.filter(F.col("l").rlike(form)).select("path", (F.col("i") + 1).alias("line"), F.lit("process").alias("kind"), F.regexp_extract("l", form, 1).alias("name"), F.regexp_extract("l", form, 2).alias("what"))
    ports = F.transform(F.regexp_extract_all("text", F.lit(r"(?im)^[ \t]*EXPOSE[ \t]+([^\n#]+)"), F.lit(1)), lambda x: F.trim(x))
    images = files.filter(base == "Dockerfile").select("path", F.lit(1).alias("line"), F.lit("image").alias("kind"), F.lit("dockerfile").alias("name"), F.array_join(ports, ", ").alias("what"))
    flows = files.filter(F.col("path").rlike(r"(?:^|/)\.github/workflows/[^/]+\.ya?ml$"))
    own = F.regexp_replace(F.trim(F.regexp_extract("text", r"(?m)^name[ \t]*:[ \t]*([^\n]+)$", 1)), r"^['\"]+|['\"]+$", "")
    name = F.when(own != "", own).otherwise(F.regexp_replace(base, r"\.ya?ml$", ""))
    flows = flows.select("path", F.lit(1).alias("line"), F.lit("workflow").alias("kind"), name.alias("name"), F.trim(F.regexp_extract("text", r"(?m)^on[ \t]*:[ \t]*([^\n]*)$", 1)).alias("what"))
    return processes.unionByName(images).unionByName(flows)


def line_difference(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and side: the lines that only the stored block has, and those that only the fresh one has, each once."""
    a, b = stored.select(*keys).distinct(), fresh.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("stored")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("fresh")))


def joined_paths(lines: DataFrame, files: DataFrame, file: str = "file", text: str = "text", path: str = "path") -> DataFrame:
    """(file, path): the paths that code joins from literal parts after at most one unknown one, and that end one file's path.

    Parts are read line by line. A path that several files end with is left out.
    """
    calls = lines.select(file, F.explode(F.regexp_extract_all(text, F.lit(JOINED), F.lit(1))).alias("c"))
    parts = F.transform(F.regexp_extract_all("c", F.lit("[\"']([^\"'\n]+)[\"']"), F.lit(1)), lambda x: F.regexp_replace(x, "^/+|/+$", ""))
    named = calls.select(file, F.array_join(parts, "/").alias("tail")).distinct()
    steps = F.split("path", "/")
    tails = files.select(F.col(path).alias("path")).withColumn("tail", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, -n, n), "/"))))
    one = tails.groupBy("tail").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1")
    return named.join(one, "tail").select(file, "path")


def capped(rows: DataFrame, group: str, order: Sequence[str], most: int = 400) -> DataFrame:
    """The first rows of each group, most of them, and truncated: whether it has more."""
    w = Window.partitionBy(group).orderBy(*order)
    first = rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)
    sizes = rows.groupBy(group).agg((F.count(F.lit(1)) > most).alias("truncated"))
    return first.join(sizes, group)


def hits_apart(hits: DataFrame, texts: DataFrame, in_tests: Column, owner: str, file: str, text: str) -> DataFrame:
    """hits with apart: whether they stand in a test that the text of their owner doesn't name."""
    names = texts.select(owner, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\w-]+(?:\.[\w-]+)+)"), F.lit(1)))).alias("name"), F.lit(True).alias("told")).distinct()
    return hits.withColumn("name", F.substring_index(file, "/", -1)).join(names, [owner, "name"], "left").withColumn("apart", in_tests & F.col("told").isNull()).drop("name", "told")
