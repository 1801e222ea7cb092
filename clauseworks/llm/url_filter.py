"""URL filter: pattern rules found by their rarest literal token.

A rule is a regular expression with a verdict. Each rule is filed under that one of its literal tokens which the
fewest URLs hold; a URL's tokens fetch the rules filed under them, and only those run. Host rules (``com/en/``)
are such patterns over host and path; the longest that fits decides. Where none fits, a pattern that allows goes
before one that blocks, and a URL that no pattern fits is allowed.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is allowed; repeated
rows are judged each; an empty table gives an empty result; a rule without a whole literal token is tried on
every URL; of rules of equal length that fit, the greater by code point counts; a URL of any length is read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseworks.llm.common import ascii_lower


#: Rules, of some hundred bytes each, that may be broadcast.
MAX_BROADCAST = 50_000


@dataclass(frozen=True)
class Rule:
    """``rule``: its name; ``regex``: over host and path; ``tokens``: whole tokens of every URL that it fits."""

    rule: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    by_host: bool


def host_rule(verdict: str, rule: str) -> Rule:
    """``com/en/``: that host and all below it, if the path starts so."""
    host, slash, rest = rule.partition("/")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    tail = re.escape(slash + rest) if slash else r"(?=/|$)"
    whole = re.findall("[a-z0-9]+", host)
    # in the path a token is whole where the rule itself goes on after it, and no upper-case letter is in it
    whole += [m[0] for m in re.finditer(r"(?<![A-Za-z0-9])[a-z0-9]+(?=[\x21-\x7e])(?![A-Za-z0-9])", slash + rest)]
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{tail}", tuple(dict.fromkeys(whole)), True)


def pattern_rule(verdict: str, words: str) -> Rule:
    """``free-bets``: these words, in this order and joined so, as a whole label of the host."""
    tokens = tuple(re.findall("[a-z0-9]+", words))
    return Rule(words, verdict, rf"^(?:[^/]*\.)?{re.escape(words)}(?:\.|/|$)", tokens, False)


# The rules that the query's contract names, then labels of unwanted hosts.
HOST_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BLOCKED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
RULES = (*(host_rule(*r) for r in HOST_RULES), *(pattern_rule("block", w) for w in BLOCKED_LABELS))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern): one row a page."""
    spark = pages.sparkSession
    # so many rules, which the driver holds already, go to every executor; more are joined by shuffling
    few = len(rules) <= MAX_BROADCAST
    sent = F.broadcast if few else lambda df: df
    schema = "rule string, verdict string, regex string, tokens array<string>, by_host boolean"
    book = spark.createDataFrame([(r.rule, r.verdict, r.regex, list(r.tokens), r.by_host) for r in rules], schema)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("place", F.concat("host", "path"))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("place"), F.lit("[a-z0-9]+"), 0))
    # how many URLs hold each token that a rule has: one row a token of the rules
    wanted = book.select(F.explode("tokens").alias("token")).distinct()
    held = urls.select(F.explode(tokens).alias("token")).join(sent(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    filed = book.select("*", F.explode_outer("tokens").alias("token")).join(held, "token", "left")
    filed = filed.groupBy("rule", "verdict", "regex", "by_host").agg(
        F.min(F.struct(F.coalesce(F.col("df"), F.lit(0)).alias("df"), "token")).alias("rarest")
    )
    # a rule without tokens is filed under the empty token, which every URL asks for
    index = filed.select("rule", "verdict", "regex", "by_host", F.coalesce(F.col("rarest.token"), F.lit("")).alias("token"))
    if few:
        index = spark.createDataFrame(index.collect(), index.schema)
    asked = urls.withColumn("row_id", F.monotonically_increasing_id()).withColumn(
        "token", F.explode(F.concat(F.array(F.lit("")), tokens))
    )
    tried = asked.join(sent(index), "token", "left")
    fits = F.rlike("place", "regex")
    found = tried.groupBy("row_id", "page_id", "host", "path").agg(
        F.max(F.when(F.col("by_host") & fits, F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("own"),
        F.min(F.when(~F.col("by_host") & fits, F.struct("verdict", "rule"))).alias("pattern"),
    )
    return found.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "pattern.verdict", F.lit("allow")).alias("verdict"), F.col("pattern.rule").alias("pattern"),
    )


SQL = r"""
WITH u AS (SELECT row_number() OVER () AS row_id, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
q AS (SELECT *, split_part(rule, '/', 1) AS r_host, substr(rule, strpos(rule, '/')) AS r_path FROM r),
m AS (SELECT row_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u, q
      WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY row_id),
b(label) AS (VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')),
n AS (SELECT row_id, min(label) AS pattern FROM u, b WHERE list_contains(string_split(host, '.'), label) GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern
FROM u LEFT JOIN m USING (row_id) LEFT JOIN n USING (row_id)
"""
