"""License scan (operator 10): sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A template is a paragraph of a licence's text or notice, or a line that names it (license_texts). A file's
units are its lines, their sentences and its paragraphs (lines up to a blank one), so wrapped headers and whole licence
files are compared too; whole texts are read. Terms are lower-cased runs of letters and digits, joined by
dots or hyphens inside; STOP words carry no weight. The inverse document frequency is that over the
templates, ln((1 + n) / (1 + df)) + 1, so a term no template has weighs most. A unit's cosine to any template is at
most the share of its known terms in its length; units in which that is below the threshold are dropped where the
text is read, before any shuffle, and no other unit is.

A unit matches a template at a cosine of threshold or more, and speaks for the licence of its best match, or for
all of them if licences share a text. A file's license is that with the largest sum of such cosines of lines and
paragraphs (ties: of sentences, then the first name in the alphabet), but one that only reserves rights
("proprietary") comes last; the file's cosine is the best one of that license.

Files called LICENSE, LICENCE, COPYING or NOTICE, whatever follows, speak for their directory: the
license most of them match (ties: first name). A file without a license of its own inherits that of the
nearest directory above it that has one, by joins of each directory's ancestors.

Defined results: null and empty texts match nothing; a null path inherits nothing; rows of equal path
are one file and get one result; a path without a slash lies in the directory ''; columns of any name but those
added pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, small, without
from .license_texts import TEMPLATES

STOP = ("a", "all", "and", "are", "by", "for", "form", "in", "is", "of", "or", "the", "this", "to", "under", "use", "with", "without", "work")
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
NAMED = r"^(?:LICEN[CS]E|COPYING|NOTICE)"
def terms(text: str) -> Counter:
    return Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP)


def reaching(idf: dict[str, float], unknown: float, threshold: float):
    """A function from a unit's text to whether its known terms let a cosine reach threshold."""
    least = (threshold - 1e-4) ** 2
    most_known, least_unknown = max(idf.values(), default=0.0) ** 2, unknown**2
    find = re.compile(TERM).findall
    stop = frozenset(STOP)

    def reaches(unit: str) -> bool:
        said = find(unit)
        known = [t for t in said if t in idf]
        # quick bounds: known terms are all one term, unknown ones are all different
        if not known or most_known * len(known) ** 2 * (1 - least) < least * least_unknown * (len(said) - len(known) - len([t for t in said if t in stop])):
            return False
        mine = sum((f * idf[t]) ** 2 for t, f in Counter(known).items())
        other = sum(f * f for t, f in Counter(said).items() if t not in idf and t not in stop) * unknown**2
        return mine >= least * (mine + other)

    return reaches


def units(texts: DataFrame, idf: dict[str, float], unknown: float, threshold: float) -> DataFrame:
    """(path, line, whole) of texts (path, text in lower case): each text's distinct lines, sentences and paragraphs that can reach threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reaches = reaching(idf, unknown, threshold)
        for b in batches:
            rows: list[tuple[str, str, bool]] = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = set(text.split("\n"))
                whole = lines | set(re.split(r"\n[ \t\r]*\n", text))
                parts = {s for x in lines for s in re.split(r"[.;][ \t]+", x)}
                good = {u for u in whole | parts if reaches(u)}
                rows += [(path, u, True) for u in whole & good] + [(path, u, False) for u in parts & good]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.bool_()), strict=True)], names=["path", "line", "whole"])

    return texts.mapInArrow(run, "path string, line string, whole boolean")


def weights(templates: Sequence[tuple[str, str]]) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(number, license, term, weight of unit length by inverse document frequency), frequencies' logs, that of an unknown term."""
    counts = [(n, terms(t)) for n, t in templates]
    df = Counter(t for _, c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + k)) + 1 for t, k in df.items()}
    rows = []
    for i, (name, c) in enumerate(counts):
        size = math.sqrt(sum((f * idf[t]) ** 2 for t, f in c.items()))
        rows += [(i, name, t, f * idf[t] / size) for t, f in sorted(c.items())]
    return rows, idf, math.log(1 + len(counts)) + 1


def own_licenses(files: DataFrame, path: str, text: str, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """(path, license, cosine) of each file that has one."""
    spark = files.sparkSession
    rows, idf, unknown = weights(templates)
    texts = files.filter(F.col(f"`{path}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{path}`").alias("path"), F.lower(F.col(f"`{text}`")).alias("text"))
    lines = cut(units(texts, idf, unknown, threshold))  # texts are read once
    tf = lines.distinct().select("path", F.xxhash64("line", "whole").alias("line"), "whole", F.explode(F.regexp_extract_all("line", F.lit(f"({TERM})"))).alias("term")).filter(~F.col("term").isin(*STOP))
    tf = tf.groupBy("path", "line", "whole", "term").agg(F.count(F.lit(1)).alias("f"))
    # as many rows as the templates have terms
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    vectors = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, w double"))
    weighed = tf.join(known, "term", "left").withColumn("x", F.col("f") * F.coalesce("idf", F.lit(unknown)))
    sizes = weighed.groupBy("path", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"), F.sum(F.when(F.col("idf").isNotNull(), F.col("x") * F.col("x"))).alias("mine"))
    # the cosine to any template is at most the share of the known terms
    sizes = sizes.filter(F.sqrt("mine") >= (threshold - 1e-4) * F.col("size")).select("path", "line", "size")
    dots = weighed.join(sizes, ["path", "line"]).join(vectors, "term").groupBy("path", "line", "whole", "template", "license").agg((F.sum(F.col("x") * F.col("w")) / F.first("size")).alias("cosine"))
    cosines = dots.withColumn("cosine", F.round("cosine", 4)).filter(F.col("cosine") >= threshold)
    # a unit speaks for the licences it is nearest to; a list is no longer than the licences are many
    near = cosines.groupBy("path", "line", "whole", "license").agg(F.max("cosine").alias("cosine")).groupBy("path", "line", "whole").agg(F.collect_list(F.struct("cosine", "license")).alias("c"))
    said = near.select("path", "whole", F.explode(F.filter("c", lambda x: x["cosine"] == F.array_max("c")["cosine"])).alias("c"))
    best = said.groupBy("path", F.col("c.license").alias("license")).agg(*[F.round(F.sum(F.when(F.col("whole") == w, F.col("c.cosine")).otherwise(0.0)), 4).alias(n) for n, w in (("all", True), ("more", False))], F.max("c.cosine").alias("cosine"))
    order = F.struct((F.col("license") == "proprietary").alias("p"), (-F.col("all")).alias("s"), (-F.col("more")).alias("t"), "license", "cosine")
    return best.groupBy("path").agg(F.min(order).alias("m")).select("path", "m.license", "m.cosine")


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """files with own_license, cosine, license and inherited_from (a directory, or null); columns of these names are replaced."""
    base = without(files, ["own_license", "cosine", "license", "inherited_from"])
    d, up, lic = free(base, "dir", "up", "dir_license")
    own = own_licenses(base, path, text, templates, threshold)
    folder = F.when(F.col(f"`{path}`").contains("/"), F.regexp_replace(F.col(f"`{path}`"), "/[^/]*$", "")).when(F.col(f"`{path}`").isNotNull(), "")
    named = own.filter(F.regexp_extract("path", r"([^/]*)$", 1).rlike(NAMED)).withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(""))
    spoken = named.groupBy("dir", "license").agg(F.count(F.lit(1)).alias("n")).groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("m")).select("dir", F.col("m.license").alias("dir_license"))
    dirs = base.select(folder.alias("dir")).filter("dir IS NOT NULL").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.concat_ws("/", F.slice(steps, 1, k)).alias("up")))).alias("a")).select("dir", "a.depth", "a.up").distinct()
    nearest = above.join(spoken.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "dir_license")).alias("m")).select(F.col("dir").alias(d), F.col("m.up").alias(up), F.col("m.dir_license").alias(lic))
    # as long as there are directories: broadcast if short, else a written table, so that a hot directory can be split
    nearest = small(cut(nearest))
    mine, key, own_license, cosine = free(base, "mine", "key", "own", "cos")
    found = base.withColumn(mine, folder).join(own.select(F.col("path").alias(key), F.col("license").alias(own_license), F.col("cosine").alias(cosine)), F.col(f"`{path}`") == F.col(key), "left")
    found = found.join(nearest, F.col(mine) == F.col(d), "left")
    return found.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.col(own_license).alias("own_license"),
        F.col(cosine).alias("cosine"),
        F.coalesce(own_license, lic).alias("license"),
        F.when(F.col(own_license).isNull(), F.col(up)).alias("inherited_from"),
    )
