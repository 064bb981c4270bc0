"""Secret scan with an incremental blob ledger.

Every version of every path is addressed by the hash of its content.  The ledger says which pairs of blob and rule version
have been scanned and what they gave; only the pairs it lacks are scanned, once per blob whatever its number of paths, and
the findings of old and new pairs are joined back to all paths.  Offsets come from the pieces between the matches: the
lengths of pieces and matches, summed in order, are the code point positions.

Cases: a null text is an empty one; empty texts give no spans.  Repeated rows, and equal texts under other paths, share one
scan and give one row each.  Null paths and versions are paths and versions like any other, and a path may have several texts.
An empty table gives an empty result and an empty ledger.  Spans of one kind never overlap;
spans of different kinds may, and come in order of start, then kind.  Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from topicspark.llm.registry import query, table, text_of
from topicspark.session import Scratch


@dataclass(frozen=True)
class Rule:
    """Matches of `regex` whose `group` has at least `least` characters; a changed rule needs a new version."""

    kind: str
    version: int
    regex: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns asked for.
BASE_RULES = [
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, "[0-9a-f]+", 0, 16),
]
# Formats of public token kinds, found beside the base rules.
MORE_RULES = [
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
]
RULES = BASE_RULES + MORE_RULES
# Texts without a long run have no long match; asking for the run first is far cheaper than listing every short match.
_NEEDS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[^A-Za-z]", "access": "AKIA[A-Z0-9]{14}", "hex": "[0-9a-f]{16}",
          "github": "gh[pousr]_[A-Za-z0-9]{36}", "jwt": r"eyJ[A-Za-z0-9_-]+\."}


def _may_match(rule: Rule) -> Column:
    """False only for texts in which the rule finds nothing."""
    return F.col("text").rlike(_NEEDS.get(rule.kind, rule.regex))


def versions_of(docs: DataFrame, path: str = "doc_id", text: str = "text", version: str | None = None) -> DataFrame:
    """path, version, text, blob (content address)."""
    return docs.select(F.col(path).alias("path"), (F.col(version) if version else F.lit(0)).cast("long").alias("version"),
                       text_of(text).alias("text")).withColumn("blob", F.sha2("text", 256))


def pending(versions: DataFrame, rules: list[Rule], ledger: DataFrame | None) -> DataFrame:
    """blob, and the rules it has not been scanned with."""
    blobs = versions.select("blob").distinct()
    todo = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        out = blobs.withColumn("todo", todo)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        out = (blobs.join(seen, "blob", "left")
               .withColumn("todo", F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>"))))
               .where(F.size("todo") > 0))
    return out.select("blob", "todo")


def _pieces(rule: Rule) -> Column:
    """Lengths of what precedes each match, of the match, and of the group that is judged."""
    text, regex = F.col("text"), F.lit(rule.regex)
    wanted = F.array_contains("todo", rule.name) & _may_match(rule)
    groups = F.regexp_extract_all(text, regex, F.lit(rule.group))
    lists = F.arrays_zip(F.transform(F.split(text, rule.regex, -1), F.length).alias("before"),
                         F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length).alias("size"),
                         F.transform(groups, F.length).alias("judged"))
    none = F.array().cast("array<struct<before:int,size:int,judged:int>>")
    return F.struct(F.lit(rule.name).alias("rule"), F.when(wanted, lists).otherwise(none).alias("pieces"))


def scan(versions: DataFrame, todo: DataFrame, rules: list[Rule]) -> DataFrame:
    """blob, rule, start, end of every finding of the pairs in `todo`.

    A text that no rule can match stays where it is: its pairs are found empty without it.
    """
    # by content address: one row of each blob, whatever its paths and versions, which may be null
    hopeful = versions.where(reduce(lambda a, b: a | b, [_may_match(r) for r in rules], F.lit(False)))
    texts = hopeful.select("blob", "text").dropDuplicates(["blob"]).join(todo, "blob")
    rows = (texts.select("blob", F.explode(F.array(*[_pieces(r) for r in rules])).alias("r"))
            .where(F.size("r.pieces") > 0).select("blob", "r.rule", F.posexplode("r.pieces").alias("k", "p")))
    w = Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("p.before") + F.coalesce("p.size", F.lit(0))).over(w)
    least = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.least))])
    return (rows.select("blob", "rule", (end - F.col("p.size")).alias("start"), end.alias("end"), "p.judged")
            .where(F.col("judged") >= least[F.col("rule")])
            .select("blob", "rule", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))


def new_entries(todo: DataFrame, found: DataFrame) -> DataFrame:
    """Ledger rows of the pairs just scanned: blob, rule, spans (empty where nothing was found)."""
    in_blob = found.groupBy("blob").agg(F.collect_list(F.struct("rule", "start", "end")).alias("found"))
    rows = todo.join(in_blob, "blob", "left").select("blob", F.explode("todo").alias("rule"), "found")
    of_rule = F.filter("found", lambda f: f["rule"] == F.col("rule"))
    spans = F.array_sort(F.transform(of_rule, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))))
    return rows.select("blob", "rule", F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def blob_spans(rules: list[Rule], ledger: DataFrame) -> DataFrame:
    """blob, spans: every finding of the given rules in the ledger, in order of start, then rule."""
    found = (ledger.where(F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0))
             .select("blob", "rule", F.inline("spans")).distinct())
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    span = F.struct("start", order[F.col("rule")].alias("order"), F.substring_index("rule", "@", 1).alias("kind"), "end")
    return found.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan_blobs(versions: DataFrame, rules: list[Rule], ledger: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(blob, spans) of every blob with a finding, and the new ledger rows; both are tables in the checkpoint folder.

    The findings come from the ledger rows as written, new and old.
    """
    steps = Scratch(versions.sparkSession, "secrets")
    todo = pending(versions, rules, ledger)
    fresh = steps.save(new_entries(todo, scan(versions, todo, rules)), "ledger")
    rows = fresh if ledger is None else fresh.unionByName(ledger.select("blob", "rule", "spans"))
    return steps.save(blob_spans(rules, rows), "spans"), fresh


def scan_paths(versions: DataFrame, rules: list[Rule] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, version, blob, spans) of every path, and the rows to append to the ledger.

    Paths of any number share the scan of their blob.  A blob with very many paths is a skewed key of the last join; the
    findings are written first, so that the join reads two plain shuffles and adaptive execution can split the hot one.
    """
    spans, fresh = scan_blobs(versions, rules, ledger)
    paths = versions.select("path", "version", "blob").join(spans, "blob", "left")
    none = F.array().cast(spans.schema["spans"].dataType)
    return paths.withColumn("spans", F.coalesce("spans", none)), fresh


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every run of overlapping or touching spans replaced by one mark; `spans` in order of start."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        first = (acc["at"] == 0) & (acc["out"] == "")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when((s["start"] > acc["at"]) | first, fresh).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def without_secrets(docs: DataFrame, rules: list[Rule] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with all their columns, every found secret replaced by a mark."""
    spans, _ = scan_blobs(versions_of(docs, path, text), rules, None)
    rows = docs.select(F.sha2(text_of(text), 256).alias("blob"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(spans, "blob", "left")
    clean = F.when(F.size("spans") > 0, redacted(F.col("row")[text], F.col("spans"))).otherwise(F.col("row")[text])
    return out.select(*[(clean if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        regex = r.regex.replace("'", "''")
        parts.append(f"""SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, {r.least} AS least,
    list_transform(string_split_regex(text, '{regex}'), lambda x: length(x)) AS before,
    list_transform(regexp_extract_all(text, '{regex}', 0), lambda x: length(x)) AS size,
    list_transform(regexp_extract_all(text, '{regex}', {r.group}), lambda x: length(x)) AS judged FROM t""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
k AS (SELECT *, unnest(range(1, len(size) + 1)) AS k FROM m),
s AS (SELECT doc_id, ord, kind, list_sum(before[1:k]) + coalesce(list_sum(size[1:k - 1]), 0) AS s, size[k] AS n
      FROM k WHERE judged[k] >= least),
spans AS (SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access,
                 count(*) FILTER (WHERE ord = 2) AS n_hex,
                 string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, ord) FILTER (WHERE ord < 3) AS base,
                 string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, ord) AS spans
          FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN spans USING (doc_id)"""


@query("op2_secret_scan", _sql())
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, _ = scan_paths(versions_of(table(spark, sf_dir, "documents")))
    base = F.filter("spans", lambda s: s["order"] < len(BASE_RULES))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return paths.select(F.col("path").alias("doc_id"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))
