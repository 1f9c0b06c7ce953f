"""Operator 10: URL rules found by their rarest literal token.

A rule is either host and path ("net/", "example.com/de/": a host with all its subdomains,
and a path prefix) or a pattern ("||ads.", "/banner/"). Every rule is compiled to one expression and to
the literal tokens that any URL it fits must hold. The rule is filed under the rarest of
them, by how many distinct URLs hold the token. A URL's tokens fetch the rules filed under
them, and only those run their expression. Of the rules that fit, the longest wins, then
block before allow, then the smaller text.

Null and malformed URLs (no "://") have an empty host and path and no rule. Repeated rows
are judged alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.llm.registry import query, table
from chaintrail.operators.skew import broadcast_checked

#: Fixed rules of the query.
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: What the method itself blocks: hosts and paths that serve advertising or tracking.
PATTERN_RULES = [
    ("block", "||ad."), ("block", "||ads."), ("block", "||adserver."), ("block", "||banners."),
    ("block", "||track."), ("block", "||tracker."), ("block", "||tracking."), ("block", ".doubleclick."),
    ("block", "/adserver/"), ("block", "/banner/"), ("block", "/banners/"), ("block", "/popunder/*.js|"),
]


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str
    regex: str
    #: Whole tokens of every URL the rule fits.
    tokens: tuple[str, ...]
    is_host: bool


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[^A-Za-z0-9]+", text.lower()) if t]


def host_rule(verdict: str, text: str) -> Rule:
    """`host/path`: fits the host and its subdomains, where the URL's path starts with the path."""
    host, slash, path = text.partition("/")
    regex = rf"(^|\.){re.escape(host.lower())} {re.escape(slash + path)}"
    # the last piece of a path may be the beginning of a longer token
    whole = _tokens(host) + [t for t in _tokens(path[: path.rfind("/") + 1])]
    return Rule(verdict, text, regex, tuple(whole), True)


def pattern_rule(verdict: str, text: str) -> Rule:
    """Literal text with || (start of the host or of a subdomain), | (start or end), * and ^ (a separator).

    Letters fit in either case. A token counts as whole if separators stand on both of its sides.
    """
    signs = {"||": r"(^|\.)", "*": ".*", "^": r"([^\w%.-]|$)"}
    regex, whole, edge = "", [], False
    parts = re.findall(r"\|\||[|*^]|[A-Za-z0-9]+|.", text)
    for i, part in enumerate(parts):
        if part == "|":
            regex += "^" if i == 0 else "$"
        elif part.isalnum():
            after = i + 1 < len(parts) and parts[i + 1] != "*"
            whole += [part.lower()] if edge and after else []
            regex += re.escape(part)
        else:
            regex += signs.get(part, re.escape(part))
        edge = part != "*" and not part.isalnum()
    if not whole:
        raise ValueError(f"no whole token in {text!r}")
    return Rule(verdict, text, f"(?i){regex}", tuple(whole), False)


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, with A-Z folded."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_index(spark: SparkSession, rules: list[Rule], tokens: DataFrame) -> DataFrame:
    """(token, verdict, rule, regex, is_host, length): each rule under its rarest token.

    `tokens` has one row per distinct URL and token; only counts of tokens that rules name
    come to the driver, where the rules are.
    """
    named = sorted({t for r in rules for t in r.tokens})
    known = broadcast_checked(spark.createDataFrame([(t,) for t in named], "token string"), len(named))
    counts = {r.token: r["count"] for r in tokens.join(known, "token").groupBy("token").count().collect()}
    rows = []
    for r in rules:
        rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
        rows.append((rarest, r.verdict, r.text, r.regex, r.is_host, len(r.text)))
    schema = "token string, rule_verdict string, rule_text string, regex string, is_host boolean, length int"
    return spark.createDataFrame(rows, schema)


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (of host rules), verdict, matched (any rule's text)."""
    spark = pages.sparkSession
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = rows.where("host <> '' OR path <> ''").select("host", "path").distinct()
    pieces = F.array_distinct(F.split(F.lower(F.concat("host", F.lit(" "), "path")), "[^a-z0-9]+"))
    tokens = urls.select("host", "path", F.explode(pieces).alias("token")).where("token <> ''")
    index = rule_index(spark, rules, tokens)
    found = tokens.join(broadcast_checked(index, len(rules)), "token")
    found = found.where(F.expr("concat(host, ' ', path) rlike regex"))
    order = F.struct(
        F.col("is_host").cast("int").alias("host_first"), "length", (F.col("rule_verdict") == "block").alias("blocks"), "rule_text"
    )
    best = found.groupBy("host", "path").agg(F.max(order).alias("best"))
    best = best.select(
        F.col("host").alias("h"), F.col("path").alias("p"),
        F.when(F.col("best.host_first") == 1, F.col("best.rule_text")).alias("rule"),
        F.when(F.col("best.blocks"), "block").otherwise("allow").alias("verdict"),
        F.col("best.rule_text").alias("matched"),
    )
    out = rows.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), "matched")


_ORACLE = """
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
q AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM p),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM q)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host, '(^|\\.)(ads?|adserver|banners|track(er|ing)?)\\.') OR host LIKE '%.doubleclick.%'
              OR regexp_matches(lower(path), '/(adserver|banners?)/|/popunder/.*\\.js$') THEN 'block' ELSE 'allow' END AS verdict
FROM r"""


@query("op10_url_rules", _ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [host_rule(*r) for r in HOST_RULES] + [pattern_rule(*r) for r in PATTERN_RULES]
    return judge(table(spark, sf_dir, "pages"), rules).drop("matched")
