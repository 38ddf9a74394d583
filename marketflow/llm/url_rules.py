"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch the rules whose expressions then run.

A rule's literal tokens are words every URL it fits must hold, as delimited tokens. Of these the rarest over the given URLs is
its index key. A URL is cut into its tokens, the tokens are joined with the index, and only the fetched rules' regular
expressions are run. Rules without a literal token are fetched by every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``name`` as reported, ``verdict``, the expression, its literal tokens, and ``listed`` for a listed host and path.

    Of the rules that fit a URL the listed ones win over the others, then the longest name, then the last by name.
    ``on`` is the text the expression reads: ``host_path`` (``//`` host path) or ``url`` (the whole URL, lower-cased).
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = False
    on: str = "host_path"


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def host_rule(name: str, verdict: str) -> Rule:
    """A listed rule ``host/path``: its host and all subdomains, paths that start with the rule's.

    The host's labels are literal tokens; so are the path's words but for the last, which a longer word may continue.
    """
    host, _, path = name.partition("/")
    words = re.findall(TOKEN, host)
    inner = re.findall(TOKEN, path.rpartition("/")[0])
    exact = path == path.lower()  # paths keep their case, tokens do not
    return Rule(name, verdict, rf"^//(?:[^/]*\.)?{_escaped(host)}/{_escaped(path)}", tuple(dict.fromkeys(words + (inner if exact else []))), True)


# The listed hosts and paths.
LISTED = [
    host_rule("com/", "allow"),
    host_rule("example.com/en/", "block"),
    host_rule("www.example.com/en/", "allow"),
    host_rule("net/es/", "block"),
    host_rule("net/fr/", "block"),
]
# Rules of the method: expressions over the host and path or the whole URL, each with a literal token to be found by;
# alternatives are rules of their own, so that no rule runs on a URL without its literal.
PATTERNS = [
    Rule("spam host", "block", r"^//(?:[^/]*[.-])?spam(?:[.-][^/]*)?(?:/|$)", ("spam",)),
    Rule("pills host", "block", r"^//(?:[^/]*[.-])?pills(?:[.-][^/]*)?(?:/|$)", ("pills",)),
    Rule("casino host", "block", r"^//(?:[^/]*[.-])?casino(?:[.-][^/]*)?(?:/|$)", ("casino",)),
    Rule("xxx host", "block", r"^//(?:[^/]*[.-])?xxx(?:[.-][^/]*)?(?:/|$)", ("xxx",)),
    Rule("porn host", "block", r"^//(?:[^/]*[.-])?porn(?:[.-][^/]*)?(?:/|$)", ("porn",)),
    Rule("login page", "block", r"^//[^/]*/(?:.*/)?login(?:[/.]|$)", ("login",)),
    Rule("signin page", "block", r"^//[^/]*/(?:.*/)?signin(?:[/.]|$)", ("signin",)),
    Rule("tracking pixel", "block", r"/pixel\.gif(?:[?#]|$)", ("pixel", "gif"), on="url"),
    Rule("session in query", "block", r"[?&]phpsessid=", ("phpsessid",), on="url"),
]
RULES = [*LISTED, *PATTERNS]
DEFAULT = "allow"


def parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty without ``://`` or for null."""
    after = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit(TOKEN), F.lit(0)))


def index(urls: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """One row per rule: its columns and ``key``, the rarest of its literal tokens over ``urls(url)``; empty without any.

    Only tokens of rules are counted; ties go to the alphabetically first token.
    """
    rules = list(rules)
    spark = urls.sparkSession
    rows = [(r.name, r.verdict, r.pattern, list(r.tokens), r.listed, r.on) for r in rules]
    table = spark.createDataFrame(rows, "rule string, verdict string, pattern string, tokens array<string>, listed boolean, reads string")
    wanted = table.select("rule", F.explode("tokens").alias("token"))
    seen = urls.select(F.explode(tokens(F.col("url"))).alias("token"))
    counts = seen.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    ranked = wanted.join(counts, "token", "left").select("rule", F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token").alias("t"))
    keys = ranked.groupBy("rule").agg(F.min("t")["token"].alias("key"))
    return table.join(keys, "rule", "left").select("rule", "verdict", "pattern", "listed", "reads", F.coalesce("key", F.lit("")).alias("key"))


def judge(pages: DataFrame, rules: Iterable[Rule] = tuple(RULES), default: str = DEFAULT) -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``url``, ``host``, ``path``, ``rule`` (a listed one, else null), ``verdict``, ``reason``.

    ``reason`` names the deciding rule, listed or not; without one the verdict is ``default``. Each different URL is judged
    once, whatever its number of rows; a null URL has empty parts and the default verdict. The rule table has the size of the
    rule list, and the join's strategy is left to the planner, which knows it. Every row is kept.
    """
    pages = pages.select("page_id", "url")
    urls = pages.select("url").filter("url is not null").distinct()
    rule_index = index(urls, rules)
    host, path = parts(F.col("url"))
    split = urls.select("url", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("tokens"))
    fetched = split.select("url", "host", "path", F.explode(F.concat("tokens", F.array(F.lit("")))).alias("key")).join(rule_index, "key")
    reads = F.when(F.col("reads") == "url", F.lower("url")).otherwise(F.concat(F.lit("//"), "host", "path"))
    fits = fetched.withColumn("read", reads).filter(F.expr("read rlike pattern"))
    best = F.max(F.struct("listed", F.length("rule").alias("length"), "rule", "verdict"))
    decided = fits.groupBy("url").agg(best.alias("best"))
    own_host, own_path = parts(F.col("url"))
    return pages.join(decided, "url", "left").select(
        "page_id", "url", own_host.alias("host"), own_path.alias("path"),
        F.when(F.col("best.listed"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.col("best.rule").alias("reason"),
    )
