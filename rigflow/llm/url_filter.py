"""URL filter: pattern rules indexed by their rarest literal token [native].

A rule is a regular expression with an action, the literal tokens that every url it fits must
hold, and a length (the longest fitting rule wins, then the smaller name).  Token counts over
the urls choose each rule's rarest token; that token indexes the rule.  A url is cut into its
tokens, the tokens fetch candidate rules from the index, and only those run their expression.

The index is one map, computed by Spark as a scalar subquery for each block of at most
``BLOCK`` rules, so what a task holds is bounded and a longer list only adds blocks.  Urls are
never exploded or shuffled: a host with a third of all urls costs nothing extra.

Defined results: null or a url without "://" has empty host and path, fits no host rule, and
is judged by the pattern rules, else allowed; equal urls are judged alike; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigflow.llm.common import ascii_lower
from rigflow.session import materialize

BLOCK = 5_000


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    pattern: str          # on host and path, host in lower case; a path is empty or starts with "/"
    tokens: tuple         # literal runs of [a-z0-9] that each fitting url holds as whole tokens
    length: int = 0       # 0 for pattern rules: any host rule wins over them


def host_rule(action: str, host: str, path: str) -> Rule:
    """The host and its subdomains, where the url's path starts with ``path``."""
    literal = re.findall("[a-z0-9]+", host)
    # a path's last run may go on in the url, so only runs that the path closes are whole tokens
    literal += re.findall("[a-z0-9]+(?=[^A-Za-z0-9])", path) if path == path.lower() else []
    return Rule(host + path, action, rf"^([^/]*\.)?\Q{host}{path}\E", tuple(dict.fromkeys(literal)), len(host + path))


#: Fixed values of the query: host rules, then patterns for advertising and tracking hosts.
RULES = [
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
]
PATTERNS = [
    Rule("ads", "block", r"^([^/]*[^a-z0-9/])?ads([^a-z0-9]|$)", ("ads",)),
    Rule("track", "block", r"^([^/]*[^a-z0-9/])?track([^a-z0-9]|$)", ("track",)),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _tokens(seen: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(seen), "[^a-z0-9]+"), lambda t: t != ""))


def _rule_frame(spark, rules: list[Rule]) -> DataFrame:
    rows = [F.struct(F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"),
                     F.array(*[F.lit(t) for t in r.tokens]).alias("tokens"), F.lit(r.length).alias("length")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _index(frame: DataFrame, seen: DataFrame) -> DataFrame:
    """One row, one map: rarest token -> rules.  ``seen``: token, n over the urls."""
    ranked = frame.withColumn("token", F.explode("tokens")).join(seen, "token", "left")
    rarest = ranked.groupBy("name", "action", "pattern", "length").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rare"))
    lists = rarest.groupBy(F.col("rare.token").alias("token")).agg(F.collect_list(F.struct("length", "name", "action", "pattern")).alias("rules"))
    return lists.agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("index"))


def url_filter(urls: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``urls`` (url, and anything else) with host, path, rule and verdict."""
    spark = urls.sparkSession
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.name!r} has no literal token to be indexed by")
    host, path = host_and_path(F.col("url"))
    base = urls.withColumns({"host": host, "path": path})
    text = F.concat("host", "path")
    names = F.array(*[F.lit(t) for t in sorted({t for r in rules for t in r.tokens})]) if rules else F.array().cast("array<string>")
    # the tokens that rules have are few: their counts are summed within each task first
    seen = base.select(F.explode(F.array_intersect(_tokens(text), names)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    seen, _ = materialize(seen, "url-tokens")
    blocks = [f"_index{at}" for at in range(0, len(rules), BLOCK)]
    # (a subquery must be a column before a lambda may use it)
    base = base.withColumns({name: _index(_rule_frame(spark, rules[k * BLOCK:(k + 1) * BLOCK]), seen).scalar() for k, name in enumerate(blocks)})
    fetched = [F.flatten(F.filter(F.transform(_tokens(text), F.col(name).__getitem__), lambda x: x.isNotNull())) for name in blocks]
    if not fetched:
        return base.withColumns({"rule": F.lit(None).cast("string"), "pattern": F.lit(None).cast("string"), "verdict": F.lit(default)})
    fitting = F.filter(F.concat(*fetched), lambda r: F.rlike(text, r["pattern"]))
    # the longest, then the smaller name
    best = F.try_element_at(F.array_sort(fitting, lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"]).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)), F.lit(1))
    base = base.withColumn("_best", best).drop(*blocks)
    return base.withColumns({
        "rule": F.when(F.col("_best.length") > 0, F.col("_best.name")),
        "pattern": F.when(F.col("_best.length") == 0, F.col("_best.name")),
        "verdict": F.coalesce("_best.action", F.lit(default))}).drop("_best")


def op1_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, RULES + PATTERNS).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
listed(action, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (
  SELECT p.host, p.path, max_by(l.rule_host || l.rule_path, length(l.rule_host || l.rule_path)) AS rule,
         max_by(l.action, length(l.rule_host || l.rule_path)) AS action
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN listed l
    ON (p.host = l.rule_host OR ends_with(p.host, '.' || l.rule_host)) AND starts_with(p.path, l.rule_path)
  GROUP BY p.host, p.path)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.action, CASE WHEN regexp_matches(p.host, '(^|[^a-z0-9])(ads|track)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fit f ON f.host = p.host AND f.path = p.path
"""
