"""Quality rules: a learned decision list over text statistics, written as ordered Spark conditions.

Sequential covering: a rule is grown as a conjunction of thresholds that separates rejected from kept labelled documents
(best FOIL gain per step), pruned on held-back rows, and accepted if it is precise there; the documents it covers are
taken away and the next rule is grown.  Every step counts labels per (statistic, threshold bin) with one aggregation;
only those counts reach the driver.  The result is a list of rules, each a list of (statistic, ">=" or "<", value).

Bound: the rules are learned from at most `MAX_TRAIN` labelled rows (those whose hashed ids come first); statistics,
conditions and verdicts are computed for every row and its whole text.

Cases: a null text counts as one without words; a document without words has ratios 0 and fails the base rule.
No labels, labels of one value only, or an empty table give an empty list, so that only the base rule rejects.  Repeated
ids keep one row each; an id with several labels counts with its smallest.  Input columns other than the id and the text
do not matter and may have any name.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicspark.llm.registry import let, query, table, text_of

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
FEATURES = ["words", "word_length", "symbols_per_word", "repeat_share", "dup_line_share", "upper_share", "bangs_per_word",
            "digits_per_word"]
MAX_TRAIN = 20_000
BINS = 40
MAX_RULES = 8
MAX_CONDITIONS = 4
MIN_PRECISION = 0.95
MIN_COVER = 5

Rule = list[tuple[str, str, float]]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    # hashed windows with their places, in order of the hash: equal windows are neighbours
    windows = F.sort_array(F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i"))))

    def covered(ws: Column) -> Column:
        again = F.filter(F.transform(ws, lambda x, k: F.when(
            ((k > 0) & (x["h"] == F.get(ws, k - 1)["h"])) | (x["h"] == F.get(ws, k + 1)["h"]), x["i"])),
            lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))

    return F.when(F.size(words) >= 3, let(windows, covered)).otherwise(0)


def text_stats(text: Column) -> Column:
    """Struct of counts of a whole text."""
    def n(regex: str) -> Column:
        return F.regexp_count(text, F.lit(regex)).cast("long")

    by_words = let(F.filter(F.split(text, SPACE), lambda w: w != ""),
                   lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"),
                                       F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                                       _repeat_words(ws).cast("long").alias("n_repeat_words")))
    by_lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
                   lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"),
                                       (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    return F.struct(by_words.alias("w"), by_lines.alias("l"),
                    n(SYMBOLS).alias("n_symbols"), n(r"\p{Lu}").alias("n_upper"), n("!").alias("n_bangs"), n("[0-9]").alias("n_digits"))


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds a struct column `_stats` with the counts of the whole text."""
    c = F.col("_counts")
    return docs.withColumn("_counts", text_stats(text_of(text_col))).withColumn("_stats", F.struct(
        c["w"]["n_words"].alias("n_words"), c["w"]["word_chars"].alias("word_chars"), c["w"]["n_repeat_words"].alias("n_repeat_words"), c["l"]["n_lines"].alias("n_lines"),
        c["l"]["n_dup_lines"].alias("n_dup_lines"),
        *[c[k].alias(k) for k in ("n_symbols", "n_upper", "n_bangs", "n_digits")])).drop("_counts")


def base_failed(s) -> Column:
    """Fewer than 50 words, or more than half of the words in repeated 3-word windows."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def feature(s, name: str) -> Column:
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return {
        "words": s["n_words"].cast("double"),
        "word_length": s["word_chars"] / words,
        "symbols_per_word": s["n_symbols"] / words,
        "repeat_share": s["n_repeat_words"] / words,
        "dup_line_share": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        "upper_share": s["n_upper"] / F.greatest(s["word_chars"], F.lit(1)),
        "bangs_per_word": s["n_bangs"] / words,
        "digits_per_word": s["n_digits"] / words,
    }[name].cast("double")


def condition(rule: Rule, value) -> Column:
    """A rule as one Spark condition; `value` gives the column of a statistic."""
    tests = [value(f) >= F.lit(t) if op == ">=" else value(f) < F.lit(t) for f, op, t in rule]
    return reduce(lambda a, b: a & b, tests)


def first_rule(rules: list[Rule], s) -> Column:
    """Number of the first rule that rejects (from 1), null if none does."""
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        out = F.when(condition(rules[i - 1], lambda f: feature(s, f)), i).otherwise(out)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Statistics, label, a prune flag and the base verdict of at most `max_rows` labelled documents."""
    picked = (labels.where("quality IS NOT NULL").groupBy(F.col(id_col).alias("_id"))
              .agg(F.min("quality").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))       # the documented bound makes it safe to broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    stats = with_stats(rows, "_text")
    return stats.select(base_failed(F.col("_stats")).alias("base_failed"), (F.col("_y") == 0).cast("int").alias("bad"), (F.abs(F.xxhash64("_id", F.lit(1))) % 3 == 0).alias("prune"),
                        *[feature(F.col("_stats"), f).alias(f) for f in FEATURES])


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """A conjunction that covers few good documents, one condition at a time; `rows` have binned statistics."""
    rule: Rule = []
    while len(rule) < MAX_CONDITIONS:
        left = rows.where(condition(rule, F.col)) if rule else rows
        counts = (left.select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin")
                  .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect())   # statistics x bins
        by = {name: [(0, 0)] * (len(cuts[name]) + 1) for name in FEATURES}
        for r in counts:
            by[FEATURES[r["f"]]][r["bin"]] = (r["p"], r["n"])
        p0, n0 = (sum(x[k] for x in by[FEATURES[0]]) for k in (0, 1))
        if not p0 or not n0:
            break
        best = (0.0, None)
        for name in FEATURES:
            for j, cut in enumerate(cuts[name]):
                for op, part in (("<", by[name][: j + 1]), (">=", by[name][j + 1:])):
                    p, n = sum(x[0] for x in part), sum(x[1] for x in part)
                    gain = _gain(p, n, p0, n0)
                    if p >= MIN_COVER and gain > best[0] + 1e-9:
                        best = (gain, (name, op, cut))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, float, int]:
    """Drops last conditions while that does not lower (p - n) / (p + n) on the held-back rows."""
    cells = [F.sum(F.when(condition(rule[:k], F.col), v).otherwise(0)).alias(f"{w}{k}")
             for k in range(1, len(rule) + 1) for w, v in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]
    seen = rows.agg(*cells).first()

    def worth(k: int) -> float:
        p, n = seen[f"p{k}"] or 0, seen[f"n{k}"] or 0
        return (p - n) / (p + n) if p + n else -1.0

    keep = len(rule)
    for k in range(len(rule) - 1, 0, -1):
        if worth(k) >= worth(keep):
            keep = k
    p, n = seen[f"p{keep}"] or 0, seen[f"n{keep}"] or 0
    return rule[:keep], (p / (p + n) if p + n else 0.0), p


def learn(rows: DataFrame) -> list[Rule]:
    """The ordered rules; `rows` as from training_rows, read once per step, so they should be written or cached."""
    quantiles = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(f, quantiles, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(found[f] or [])) for f in FEATURES}
    binned = rows.withColumn("bins", F.array(*[
        sum([(F.col(f) >= F.lit(c)).cast("int") for c in cuts[f]], F.lit(0)) for f in FEATURES]))
    rules: list[Rule] = []
    left = binned
    while len(rules) < MAX_RULES:
        rule = _grow(left.where(~F.col("prune")), cuts)
        if not rule:
            break
        rule, precision, covered = _prune(left.where("prune"), rule)
        if precision < MIN_PRECISION or covered < MIN_COVER:
            break
        rules.append(rule)
        left = left.where(~condition(rule, F.col))
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, id_col: str = "doc_id",
               text_col: str = "text") -> list[Rule]:
    rows = training_rows(docs, labels, max_rows, id_col, text_col).cache()
    try:
        return learn(rows.where(~F.col("base_failed")))
    finally:
        rows.unpersist()


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Adds `_stats`, `_base_failed`, `_rule` (the first that rejects, or null) and `_kept`."""
    out = with_stats(docs, text_col)
    out = out.withColumn("_base_failed", base_failed(F.col("_stats"))).withColumn("_rule", first_rule(rules, F.col("_stats")))
    return out.withColumn("_kept", ~F.col("_base_failed") & F.col("_rule").isNull())


def keeps(rules: list[Rule], text_col: str = "text") -> Column:
    """Condition on a text: the base rule and the learned rules let it pass."""
    def verdict(c: Column) -> Column:
        s = {"n_words": c["w"]["n_words"], "n_repeat_words": c["w"]["n_repeat_words"], "word_chars": c["w"]["word_chars"],
             "n_lines": c["l"]["n_lines"], "n_dup_lines": c["l"]["n_dup_lines"],
             **{k: c[k] for k in ("n_symbols", "n_upper", "n_bangs", "n_digits")}}
        return ~base_failed(s) & first_rule(rules, s).isNull()

    return let(text_stats(text_of(text_col)), verdict)


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_from(docs, table(spark, sf_dir, "labels"))
    out = judged(docs, rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[F.col("_stats")[n].alias(n) for n in names], F.col("_base_failed").alias("base_failed"),
                      F.col("_kept").alias("kept"), F.col("_rule").alias("rule"))
