"""URL filter: pattern rules indexed by their rarest literal token.

A rule is `host/path`: it fits its host and all subdomains if the path of the url starts with the rule's path; `*` stands
for any run of characters, and a rule that starts with `*` may begin anywhere.  Every rule is turned into one regular
expression over host + path and filed under one literal token that any fitting url must contain; of its tokens that is
the one which the fewest urls have.  A rule without such a token is filed by the rarest four characters in a row that it
demands.  The tokens of a url, and its runs of four characters under which a rule can be filed, fetch the rules, and only
those are run.

Cases: a null url, or one without `://`, has an empty host and path; only a rule without any literal can fit it.
Rules without four literal characters in a row or a token are tried on every url.  Repeated urls are judged once and give one row each.
An empty table gives no rows, an empty rule list lets every url take the default.  Of several fitting rules the longest
wins, then the first in text order.  Columns of the input other than the id and the url are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicspark.llm.registry import ascii_lower, query, table

# The rules asked for, (action, rule).
SITE_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
# The method's own rules, asked when no site rule fits.
PATTERN_RULES = [
    ("block", "*-pills.*"),
    ("block", "*adult-*"),
    ("block", "*.adult.*"),
    ("block", "*-bets.*"),
    ("block", "*casino*/*"),
    ("block", "*.porn.*"),
]
MAX_BROADCAST_RULES = 50_000
_TOKEN = re.compile(r"[a-z0-9]+")
_GRAM = "~"           # no token of letters and digits starts like this
_EDGE = re.compile(r"[^a-z0-9*]")


def rule_regex(rule: str) -> str:
    """The regular expression of a rule over host + path."""
    body = "".join("[\\s\\S]*" if part == "*" else re.escape(part) for part in re.split(r"(\*)", rule) if part)
    return "^" + ("" if rule.startswith("*") else "(?:[^/]*\\.)?") + body


def rule_tokens(rule: str) -> list[str]:
    """Runs of letters and digits that stand whole in every fitting url: both ends are set by the rule itself."""
    low, found = rule.lower(), []
    for m in _TOKEN.finditer(low):
        start_fixed = m.start() == 0 or _EDGE.match(low[m.start() - 1])
        end_fixed = m.end() < len(low) and _EDGE.match(low[m.end()])
        if start_fixed and end_fixed and low[m.start():m.end()].isascii():
            found.append(m.group())
    return sorted(set(found))


def rule_grams(rule: str) -> list[str]:
    """Marked runs of four characters that stand in every fitting url, in whatever token."""
    low = "".join(c.lower() if c.isascii() else c for c in rule)
    return sorted({_GRAM + part[i:i + 4] for part in low.split("*") for i in range(len(part) - 3)})


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column, grams: list[str]) -> Column:
    """Distinct tokens of a url and those of `grams` in it; the empty one stands for rules without a literal."""
    low = ascii_lower(F.concat(host, path))
    found = F.array_union(F.array_distinct(F.split(low, "[^a-z0-9]+")), F.array(F.lit("")))
    if not grams:
        return found
    runs = F.transform(F.regexp_extract_all(low, F.lit("(?s)(?=(.{4}))"), F.lit(1)), lambda g: F.concat(F.lit(_GRAM), g))
    return F.array_union(found, F.filter(runs, lambda g: g.isin(grams)))


def literals(rule: str) -> list[str]:
    """What a rule can be filed under."""
    return rule_tokens(rule) or rule_grams(rule)


def rule_index(spark: SparkSession, sites: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """One row per rule: the token it is filed under, its regular expression and what it says."""
    rows = [(kind, action, rule, rule_regex(rule), literals(rule)) for kind, action, rule in rules]
    listed = spark.createDataFrame(rows, "kind string, action string, rule string, regex string, tokens array<string>")
    words = listed.select("kind", "action", "rule", "regex", F.explode("tokens").alias("token"))
    counted = words.select("token").distinct()
    if len(rules) <= MAX_BROADCAST_RULES:
        counted = F.broadcast(counted)
    use = (sites.select(F.explode("tokens").alias("token")).join(counted, "token").groupBy("token")
           .agg(F.count("*").alias("n")))
    best = (words.join(use, "token", "left").groupBy("kind", "action", "rule", "regex")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
            .select("kind", "action", "rule", "regex", F.col("least.token").alias("token")))
    anywhere = listed.where(F.size("tokens") == 0).select("kind", "action", "rule", "regex", F.lit("").alias("token"))
    return best.unionByName(anywhere)


def url_verdicts(urls: DataFrame, site_rules: list[tuple[str, str]], pattern_rules: list[tuple[str, str]],
                 id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (the site rule that fits best, or null), pattern (likewise), verdict."""
    spark = urls.sparkSession
    host, path = url_parts(F.col(url_col))
    pages = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rules = [("site", *r) for r in site_rules] + [("pattern", *r) for r in pattern_rules]
    grams = sorted({x for _, _, rule in rules for x in literals(rule) if x.startswith(_GRAM)})
    sites = pages.select("host", "path").distinct().withColumn("tokens", url_tokens(F.col("host"), F.col("path"), grams))
    index = rule_index(spark, sites, rules)
    if len(rules) <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    found = (sites.select("host", "path", F.explode("tokens").alias("token")).join(index, "token")
             .where(F.regexp_like(F.concat("host", "path"), F.col("regex"))))

    def best(kind: str) -> Column:
        key = F.struct((-F.length("rule")).alias("len"), F.col("rule"), F.col("action"))
        return F.min(F.when(F.col("kind") == kind, key))

    chosen = (found.groupBy("host", "path").agg(best("site").alias("s"), best("pattern").alias("p"))
              .select("host", "path", F.col("s.rule").alias("rule"), F.col("p.rule").alias("pattern"),
                      F.coalesce("s.action", "p.action").alias("action")))
    return (pages.join(chosen, ["host", "path"], "left")
            .select(id_col, "host", "path", "rule", "pattern", F.coalesce("action", F.lit(default)).alias("verdict")))


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = ", ".join(f"('{kind}', '{a}', '{r}', '{rule_regex(r)}')"
                      for kind, listed in (("site", SITE_RULES), ("pattern", PATTERN_RULES)) for a, r in listed)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
              FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(kind, action, rule, regex) AS (VALUES {rules}),
sites AS (SELECT DISTINCT host, path FROM parts),
fit AS (SELECT s.host, s.path, r.*, row_number() OVER (PARTITION BY s.host, s.path, r.kind ORDER BY length(r.rule) DESC, r.rule) AS rn
        FROM sites s JOIN rules r ON regexp_matches(s.host || s.path, r.regex)),
best AS (SELECT host, path, max(CASE WHEN kind = 'site' THEN rule END) AS rule, max(CASE WHEN kind = 'pattern' THEN rule END) AS pattern,
                coalesce(max(CASE WHEN kind = 'site' THEN action END), max(CASE WHEN kind = 'pattern' THEN action END)) AS action
         FROM fit WHERE rn = 1 GROUP BY host, path)
SELECT p.page_id, p.host, p.path, b.rule, b.pattern, coalesce(b.action, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path"""


@query("op4_url_filter", _sql())
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), SITE_RULES, PATTERN_RULES)
