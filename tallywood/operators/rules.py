"""Scanning text by a table of rules, line by line, with gates by context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern in the subset that Java and RE2 share. scope: any line, or only lines under no heading of warnings."""

    category: str
    label: str
    pattern: str
    scope: str = "any"


RULES = (
    Rule("contact", "mail address", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+"),
    Rule("contact", "phone number", r"\+?[0-9][0-9() -]{7,}[0-9]"),
    Rule("secret", "long digit run", r"[0-9]{12,}"),
    Rule("secret", "key or token", r"(?:api|secret|token|key|AKIA)[A-Za-z_-]*[ :=]+[A-Za-z0-9_/+-]{12,}"),
    Rule("license", "license line", r"[Ll]icen[cs]e"),
    Rule("license", "rights reserved", r"[Rr]ights reserved"),
    Rule("noise", "repeated mark", r"[!*$%&#]{2,}", "prose"),
    Rule("noise", "capitals", r"[A-Z]{6,}", "prose"),
    Rule("insult", "insult", r"(?:idiot|moron|clown|worthless|stupid|loser)", "affirmed"),
)


def lines(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, line, body): every line, from 1."""
    return df.select(id, F.posexplode(F.split(text, "\n")).alias("line", "body")).withColumn("line", (F.col("line") + 1).cast("long"))


def matching(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rows with an entry for each rule that matches: category, label, scope and all its matches.

    All rules stand in one projection, so a line is read once; only matches are exploded.
    """
    hits = [F.struct(F.lit(r.category).alias("category"), F.lit(r.label).alias("label"), F.lit(r.scope).alias("scope"), F.regexp_extract_all("body", F.lit(f"({r.pattern})")).alias("matches")) for r in rules]
    found = F.filter(F.array(*hits), lambda h: F.size(h["matches"]) > 0)
    return rows.select(*rows.columns, F.explode(found).alias("h")).select(*rows.columns, "h.*")


def flags(rows: DataFrame, of: list[str], most: int = 120) -> DataFrame:
    """One row for each (of, category, label): the matches joined, cut to most characters, and their number.

    A line's matches are in the row already, so nothing is shuffled.
    """
    return rows.select(*of, "category", "label", F.substring(F.array_join("matches", " | "), 1, most).alias("match"), F.size("matches").cast("long").alias("n"))


def gated(rows: DataFrame, id: str) -> DataFrame:
    """Matches with the reason that covers them, or none.

    A rule of scope prose is covered on a line whose marks say it is a table or heading; one of scope
    affirmed where a word before the match in its clause denies it. A match is judged by itself: a
    line is flagged if one of its matches isn't covered.
    """
    one = rows.withColumn("match", F.explode("matches"))
    before = F.substring("body", F.lit(1), F.position("match", "body") - 1)
    clause = F.regexp_extract(before, r"([^.,;:!?]*)$", 1)
    why = F.when((F.col("scope") == "prose") & F.col("body").contains(" | "), "table").when((F.col("scope") == "affirmed") & clause.rlike(r"(?i)(?:^|[^a-z])(?:not|no|never|nicht|pas|non)(?:[^a-z]|$)"), "denied")
    return one.select(id, "line", "category", "label", "match", why.alias("why"))


def hits(pattern: str, text: Column) -> Column:
    """Matches of a pattern, not lines; the pattern must compile, else this raises at once."""
    import re

    re.compile(pattern)
    return F.regexp_count(text, F.lit(pattern))


def with_context(rows: DataFrame, id: str, heading: str = r"^#+ ") -> DataFrame:
    """Lines with the heading they stand under, whether a fence is open, and the line before that isn't blank."""
    w = Window.partitionBy(id).orderBy("line")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("body").rlike(r"^(?:```|~~~)")
    return rows.withColumns(
        {
            "heading": F.last(F.when(F.col("body").rlike(heading), F.col("body")), ignorenulls=True).over(upto),
            "fenced": F.sum(F.when(fence, 1).otherwise(0)).over(before) % 2 == 1,
            "before": F.last(F.when(F.trim("body") != "", F.col("body")), ignorenulls=True).over(before),
        }
    )
