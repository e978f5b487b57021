"""Quality rules as one projection (operator 3): a table of thresholds over length, symbol, stop-word
and line ratios, compiled into built-in expressions; no user function is evaluated.

Defined results: a null text counts as empty; without words all counts and ratios are 0 and the text
fails; repeated rows are judged alike; measures take the whole text, however long.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, without

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: The commonest short words of the languages expected; a text of prose holds many of them.
STOP_WORDS = tuple(
    "a al an and are as at au aux be but by con das de del den der des die du ein eine el elle en es est et for from "
    "für have in is ist it la las le les los mit nicht not of on or par para por pour que qui se sich sie sur that the "
    "this to un und une was which with y zu".split()
)
#: (measure, least, most): a text is kept if every measure lies between; None is no bound.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 12.0),
    ("symbols_per_word", None, 0.1),
    ("exclamations_per_word", None, 0.2),
    ("stop_words_per_word", 0.05, None),
    ("dup_lines_per_line", None, 0.4),
)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three that occur twice or more.

    The windows' hashes are sorted with their positions, so equal ones are neighbours; the positions of
    those are sorted again, and each window adds the words that the next one doesn't begin with.
    """
    n = F.size(words)
    windows = F.slice(F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))), 1, F.greatest(n - 2, F.lit(0)))

    def repeated(s: Column) -> Column:
        twin = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        return F.sort_array(F.filter(F.transform(s, lambda x, i: F.when(twin(x, i), x["i"])), lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b)

    return let(let(F.sort_array(windows), repeated), covered)


def measures(df: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """df with the struct column out: counts and ratios of the column text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(r"([^\x20\x09-\x0D]+)"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_exclamations"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )

    def per(a: Column, b: Column) -> Column:
        return a.cast("double") / F.greatest(b, F.lit(1)).cast("double")

    base = without(df, [out])
    counted = base.withColumn("__counts", counts)
    c = lambda name: F.col(f"__counts.{name}")
    return counted.select(
        *[F.col(f"`{x}`") for x in base.columns],
        F.struct(
            *[c(x).alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words")],
            c("lines.n").alias("n_lines"),
            c("lines.dup").alias("n_dup_lines"),
            per(c("word_chars"), c("n_words")).alias("mean_word_chars"),
            per(c("n_symbols"), c("n_words")).alias("symbols_per_word"),
            per(c("n_exclamations"), c("n_words")).alias("exclamations_per_word"),
            per(c("n_stop_words"), c("n_words")).alias("stop_words_per_word"),
            per(c("lines.dup"), c("lines.n")).alias("dup_lines_per_line"),
        ).alias(out),
    )


def verdict(rules: Sequence[tuple[str, float | None, float | None]] = RULES, of: str = "quality") -> Column:
    """Whether the measures in the struct column of keep within every rule."""
    tests = [F.col(f"{of}.{m}") >= lo for m, lo, _ in rules if lo is not None] + [F.col(f"{of}.{m}") <= hi for m, _, hi in rules if hi is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def judged(df: DataFrame, text: str = "text", rules: Sequence[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """df with the counts, base_failed and kept; columns of these names are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = without(df, [*names, "base_failed", "kept", "__q"])
    failed = (F.col("__q.n_words") < 50) | (100 * F.col("__q.n_repeat_words") > 50 * F.col("__q.n_words"))
    return measures(base, text, "__q").select(*[F.col(f"`{x}`") for x in base.columns], *[F.col(f"__q.{x}").alias(x) for x in names], failed.alias("base_failed"), (~failed & verdict(rules, "__q")).alias("kept"))
