"""Operator 8, URL filters by pattern rules indexed by their rarest literal token, in DataFrame functions only.

Rules are a table of texts in the usual syntax of filter lists: `*` any characters, `^` a separator or the end, `|` at
an end the start or end of the URL, `||` at the start the start of the host or of one of its labels, `@@` in front an
allowing rule; all else is literal, in any letter case. The regular expression and the literal tokens (runs of letters
and digits that the URL must contain whole) are derived from the rule. The tokens' frequency is counted over all URLs,
and a rule is filed under its rarest one, or under the empty token, which every URL has, where it has none. A URL
fetches the rules filed under its own tokens, and only those run their regular expression. Path rules (host with
subdomains, path prefix, longest wins) are tried first; they are few, written out as expressions.

Cases: a null URL, or one without "://", has empty host and path, fits no path rule, and a null one no pattern rule
either, and is allowed; equal rows are judged alike; two rules that fit a URL: an allowing rule wins over a blocking
one; null and empty rules fit nothing; empty tables give no rules or no rows; other columns pass through, but columns
that have the names of the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged

#: Fixed values: (host, path, verdict); the longest rule that fits decides.
PATH_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Pattern rules, where no table of them is given.
PATTERN_RULES = """
||casino-
||casino.
-casino.
/casino/
||poker-
||poker.
-poker.
^viagra^
-viagra-
||free-bets.
||cheap-pills.
||spam-farm.
||ads-track.
||doubleclick.*^
://*/ads/
/pixel.gif^
/pixel.png^
||xxx.
||xxx-
crack-keygen
keygen-crack
@@/responsible-gambling
""".split()

#: Rules up to this many are broadcast to the URLs; more are joined by shuffle. And rows, and bytes, of URLs that a
#: pattern fits, which are broadcast to all of them.
BROADCAST_RULES, BROADCAST_URLS, BROADCAST_BYTES = 100_000, 1_000_000, 64 << 20

#: What the syntax's signs stand for.
HOST_START = "^[a-z][a-z0-9+.-]*://([^/?#]*[.])?"
SEPARATOR = "([^a-z0-9_.%-]|$)"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def path_rule(host: Column, path: Column, rules=PATH_RULES) -> tuple[Column, Column]:
    """The rule (like org/) and verdict of the longest host, then path, that fits; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """The runs of letters and digits of a URL, and the empty token."""
    return F.array_distinct(F.concat(F.split(F.lower(url), "[^a-z0-9]+"), F.array(F.lit(""))))


def rule_table(spark: SparkSession, rules=PATTERN_RULES) -> DataFrame:
    return spark.createDataFrame([(r,) for r in rules], "pattern string")


def parsed(rules: DataFrame) -> DataFrame:
    """pattern, tokens, regex over the lower-cased URL, pattern_verdict of rules (pattern)."""
    body = F.regexp_replace(F.lower("pattern"), "^@@", "")
    middle = F.regexp_replace(F.regexp_replace(body, "^[|]{1,2}", ""), "[|]$", "")
    literal = F.regexp_replace(middle, r"([\\.+?$(){}\[\]|])", r"\\$1")
    signs = F.replace(F.replace(F.replace(literal, F.lit("*"), F.lit("\0")), F.lit("^"), F.lit(SEPARATOR)), F.lit("\0"), F.lit(".*"))
    start = F.when(body.startswith("||"), HOST_START).when(body.startswith("|"), "^").otherwise("")
    regex = F.concat(F.lit("(?s)"), start, signs, F.when(body.endswith("|"), "$").otherwise(""))
    # A run at an end of the rule, or beside a star, may be part of a longer one of the URL.
    tokens = F.array_distinct(F.regexp_extract_all(body, F.lit("(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), F.lit(1)))
    verdict = F.when(F.col("pattern").startswith("@@"), "allow").otherwise("block")
    return rules.where(F.length(middle) > 0).select("pattern", tokens.alias("tokens"), regex.alias("regex"), verdict.alias("pattern_verdict")).distinct()


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Parsed rules with the token they are filed under: of their literal tokens, the one in the fewest URLs."""
    filed = rules.withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
    wanted = filed.select("token").where("token <> ''").distinct()
    seen = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).join(_small(wanted, rules), "token").groupBy("token").agg(F.count("*").alias("n"))
    least = filed.join(_small(seen, rules), "token", "left").groupBy("pattern").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return rules.drop("tokens").join(least, "pattern")


def _small(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Broadcast, if the rule table's size, counted here, is under the bound."""
    return F.broadcast(df) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else df


def judge(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, pattern and verdict added; pages has a column url, rules a column pattern."""
    pages = pages.drop(*[c for c in pages.columns if c.lower() in ("host", "path", "rule", "pattern", "verdict", "_found")])
    rules = staged(parsed(rule_table(pages.sparkSession) if rules is None else rules), "rules")
    urls = pages.select("url").where(F.col("url").isNotNull())
    index = staged(rule_index(urls, rules), "rule-index")
    candidates = urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token")).join(_small(index, rules), "token")
    fitting = candidates.where(F.expr("rlike(lower(url), regex)")).groupBy("url").agg(F.min(F.struct(F.col("pattern_verdict"), F.col("pattern"))).alias("_found"))
    fitting = staged(fitting, "fitting")
    rows, size = fitting.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("url")), F.lit(0))).first()
    fitting = F.broadcast(fitting) if rows <= BROADCAST_URLS and size <= BROADCAST_BYTES else fitting
    # Rows without a URL don't meet in one task.
    found = pages.where(F.col("url").isNotNull()).join(fitting, "url", "left")
    none = pages.where(F.col("url").isNull()).withColumn("_found", F.lit(None).cast(fitting.schema["_found"].dataType))
    host, path = host_path(F.col("url"))
    rule, verdict = path_rule(F.col("host"), F.col("path"))
    judged = found.select(*pages.columns, "_found").unionByName(none).withColumns({"host": host, "path": path}).withColumn("rule", rule)
    return judged.withColumns({"verdict": F.coalesce(verdict, F.col("_found.pattern_verdict"), F.lit("allow")), "pattern": F.col("_found.pattern")}).drop("_found")
