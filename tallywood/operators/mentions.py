"""Matches of a rule table, each judged at its own place: what applies there, and what excuses a mere mention.

All rules stand in one projection over lines with their context (rules.with_context), so a line is read once. A match's place is
told by the pieces of the line around all matches of its rule, so of two equal matches on a line each is judged by what stands before
it. Only matches leave the row. A null text has no line; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .rules import Rule

#: Our own rules, in the part of patterns that Java and RE2 share. A rule of scope any is never excused; affirmed, unquoted, prose
#: (outside fences), code (in code or fences), fetched (where something is fetched on the line or the one before) and remote
#: (where no local host is named) say where a rule applies and what excuses a match.
TABLE = (
    Rule("network", "download into a shell", r"(?:curl|wget)[^|]*[|] *(?:sudo +)?(?:ba|z|da)?sh\b"),
    Rule("network", "download", r"\b(?:curl|wget|Invoke-WebRequest) +[-a-zA-Z'\"h]", "affirmed"),
    Rule("network", "data sent", r"\b(?:requests|httpx|axios)[.](?:post|put|patch)[(]", "code"),
    Rule("network", "socket", r"\bsocket[.](?:socket|create_connection)[(]", "code"),
    Rule("network", "shell to a port", r"/dev/tcp/|\bnc +-[a-z]*e\b"),
    Rule("network", "bare address", r"https?://[0-9]{1,3}(?:[.][0-9]{1,3}){3}", "remote"),
    Rule("network", "paste or tunnel", r"\b(?:pastebin|ngrok|webhook[.]site|requestbin)\b", "unquoted"),
    Rule("execution", "evaluated text", r"\b(?:eval|exec)[(]", "code"),
    Rule("execution", "shell call", r"shell *= *True|\bos[.](?:system|popen)[(]", "code"),
    Rule("execution", "decoded and run", r"base64 +(?:-d|-D|--decode)[^|]*[|]"),
    Rule("execution", "fetched and run", r"\bchmod +[+]x\b|\b(?:bash|sh|python3?) +[A-Za-z0-9_./-]+[.](?:sh|py)\b", "fetched"),
    Rule("execution", "unpickled", r"\b(?:pickle|marshal)[.]loads?[(]|\byaml[.]load[(]", "code"),
    Rule("deletion", "removed by force", r"\brm +-[a-zA-Z]*(?:rf|fr)\b", "affirmed"),
    Rule("deletion", "history rewritten", r"git +push +(?:[^ ]+ +)*(?:--force|-f)\b|git +reset +--hard", "affirmed"),
    Rule("deletion", "disk written", r"\bmkfs\b|\bdd +if="),
    Rule("deletion", "table dropped", r"(?i)\bdrop +(?:table|database|schema)\b", "affirmed"),
    Rule("permission", "as root", r"\bsudo +[a-z]", "affirmed"),
    Rule("permission", "open to all", r"\bchmod +(?:-R +)?0?777\b", "affirmed"),
    Rule("permission", "checks off", r"--no-verify\b|\bverify *= *False\b|StrictHostKeyChecking=no", "affirmed"),
    Rule("permission", "questions off", r"--dangerously-[a-z-]+|--yes-to-all\b|--trust-all\b", "affirmed"),
    Rule("secret", "private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("secret", "cloud key", r"\bAKIA[0-9A-Z]{16}\b"),
    Rule("secret", "key or token", r"(?:api|secret|token|key)[A-Za-z_-]*[ :=]+[A-Za-z0-9_/+-]{12,}"),
    Rule("secret", "key files", r"~/[.](?:ssh|aws|gnupg)\b|\bid_(?:rsa|ed25519)\b", "affirmed"),
    Rule("secret", "settings read", r"(?:cat|source|open[(]) *['\"]?[.]env\b", "affirmed"),
    Rule("secret", "long digit run", r"[0-9]{12,}"),
    Rule("contact", "mail address", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z.]+"),
    Rule("contact", "phone number", r"[+]?[0-9][0-9() -]{7,}[0-9]"),
    Rule("override", "rules set aside", r"(?i)\b(?:ignore|disregard|forget) +(?:all +|any +)?(?:previous|earlier|prior) +(?:instructions|rules|orders)", "affirmed"),
    Rule("override", "kept from the user", r"(?i)\b(?:without telling|hide this from|keep this from) +(?:the +)?user", "unquoted"),
    Rule("override", "another role", r"(?i)\byou are now (?:a|an|in)\b", "unquoted"),
    Rule("override", "hidden characters", r"[\x{200B}-\x{200F}\x{2060}]"),
    Rule("license", "license line", r"[Ll]icen[cs]e"),
    Rule("license", "rights reserved", r"[Rr]ights reserved"),
    Rule("noise", "repeated mark", r"[!*$%&#]{2,}", "prose"),
    Rule("noise", "capitals", r"[A-Z]{6,}", "prose"),
    Rule("insult", "insult", r"(?:idiot|moron|clown|worthless|stupid|loser)", "affirmed"),
    Rule("install", "package installed", r"\b(?:pip3?|npm|cargo|gem|brew) +install +[-a-z@.]", "affirmed"),
    Rule("install", "action not pinned", r"uses: *[A-Za-z0-9_./-]+@(?:main|master)\b", "code"),
    Rule("install", "startup changed", r"~/[.](?:bashrc|zshrc|profile)\b|\bcrontab +-", "affirmed"),
)
DENIED = r"(?i)(?:^|[^a-z])(?:not|no|never|without|avoid|nicht|nie|pas|sans|non|sin|n't)(?:[^a-z]|$)"
WARNS = r"(?i)^#+ .*(?:avoid|never|don't|do not|anti-?pattern|pitfall|bad|wrong|warning)"
FETCH = r"(?i)\b(?:curl|wget|download|fetch|clone)"
LOCAL = r"(?:127[.]0[.]0[.]1|0[.]0[.]0[.]0|localhost|192[.]168[.]|10[.][0-9]+[.])"
QUOTE = r"[\"`“”«»]"


def found(rows: DataFrame, table: tuple[Rule, ...] = TABLE) -> DataFrame:
    """rows (…, body) with a row for each match: category, label, scope, nth (from 1), match and offset (characters before it)."""
    entries = []
    for r in table:
        matches, pieces = F.regexp_extract_all("body", F.lit(f"({r.pattern})")), F.split("body", r.pattern, -1)
        entries.append(F.when(F.col("body").rlike(r.pattern), F.struct(F.lit(r.category).alias("category"), F.lit(r.label).alias("label"), F.lit(r.scope).alias("scope"), matches.alias("ms"), pieces.alias("ps"))))
    hit = rows.select(*rows.columns, F.explode(F.array_compact(F.array(*entries))).alias("h")).select(*rows.columns, "h.*")
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
    each = hit.select(*rows.columns, "category", "label", "scope", "ms", "ps", F.posexplode("ms").alias("i", "match"))
    offset = length(F.slice("ps", F.lit(1), F.col("i") + 1)) + length(F.slice("ms", F.lit(1), F.col("i")))
    return each.select(*rows.columns, "category", "label", "scope", (F.col("i") + 1).alias("nth"), "match", offset.alias("offset"))


def applies(is_code: Column) -> Column:
    """Whether a match's scope holds where it stands."""
    s, fenced = F.col("scope"), F.coalesce("fenced", F.lit(False))
    near = F.col("body").rlike(FETCH) | F.coalesce(F.col("before").rlike(FETCH), F.lit(False))
    return F.when(s == "code", fenced | is_code).when(s == "prose", ~fenced & ~is_code).when(s == "fetched", near).when(s == "remote", ~F.col("body").rlike(LOCAL)).otherwise(True)


def excuse() -> Column:
    """Why a match is a mention only, or null: the heading it stands under warns (heading), its line is a row of a table (table), it
    stands in quotes (quoted), its clause denies it before (denied). The line that names no heading's list is its own."""
    said = F.substring(F.col("body"), F.lit(1), F.col("offset"))
    clause = F.regexp_extract(said, r"([^.,;:!?]*)$", 1)
    quoted = F.regexp_count(said, F.lit(QUOTE)) % 2 == 1
    s = F.col("scope")
    return (
        F.when(s == "any", F.lit(None).cast("string")).when(F.coalesce(F.col("heading").rlike(WARNS), F.lit(False)), "heading").when(F.col("body").rlike(r"^ *[|].*[|] *$") | F.col("body").contains(" | "), "table")
        .when(s.isin("affirmed", "unquoted") & quoted, "quoted").when((s == "affirmed") & clause.rlike(DENIED), "denied")
    )


def judged(texts: DataFrame, id: str, text: str = "text", is_code: Column | None = None, table: tuple[Rule, ...] = TABLE) -> DataFrame:
    """(id, line, category, label, nth, match, offset, why): every match that applies; why is null where nothing excuses it."""
    rows = rules.with_context(rules.lines(texts, id, text), id)
    if is_code is not None:
        rows = rows.join(texts.select(id, is_code.alias("is_code")), id)
    else:
        rows = rows.withColumn("is_code", F.lit(False))
    return found(rows, table).filter(applies(F.col("is_code"))).select(id, "line", "category", "label", "nth", "match", "offset", excuse().alias("why"))


def flagged(judged: DataFrame, id: str, most: int = 120) -> DataFrame:
    """(id, line, category, label, n, mentions, match): a line's flags, its matches that nothing excuses joined and cut to most
    characters; a line all of whose matches are mentions has n = 0."""
    open_, shown = F.col("why").isNull(), F.struct("nth", "match")
    each = judged.groupBy(id, "line", "category", "label").agg(F.count_if(open_).alias("n"), F.count_if(~open_).alias("mentions"), F.array_sort(F.collect_list(F.when(open_, shown)))["match"].alias("m"))
    return each.select(id, "line", "category", "label", "n", "mentions", F.substring(F.array_join("m", " | "), 1, most).alias("match"))
