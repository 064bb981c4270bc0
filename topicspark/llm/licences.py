"""Licence scan with a positional index of rare licence words.

Every phrase of the templates is filed under its rarest word (highest IDF over all files) with that word's offset: the
postings.  A file is split once; its places of filed words are looked up in the postings by a join, and only phrases fetched
that way are compared, by the words around the place.  A phrase of more than `PIECE` words has a posting for each piece, and
its pieces are intersected by the start they agree on.  A label is given if all its mandatory phrases stand.  Templates are
rows of tables, so neither the work on a file nor the expressions grow with their number, only with the places that meet them.

Cases: a null text has no words; a file without filed words has no places, empty labels and score 0.  Overlapping
places count, equal texts share their findings and repeated rows each give a row, an empty table gives no rows, without
templates nothing is found.  Null ids are ids like any other.  Words are counted from 0 over the whole text, however long;
a place keeps no more words around it than the longest phrase piece filed under its word.  A template has a phrase and a
phrase a word.  Other columns of the input are not read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicspark.llm.registry import let, query, table, text_of
from topicspark.llm.stages import Steps

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = 12                       # words of a phrase under one posting
MAX_BROADCAST_POSTINGS = 50_000  # of at most PIECE words each


@dataclass(frozen=True)
class Template:
    """A label and the phrases that must all stand in a file."""

    label: str
    phrases: tuple[str, ...]


# The phrases asked for.
BASE = [Template("gpl", ("gnu general public license",)), Template("apache", ("apache license",)),
        Template("cc-by", ("cc by",)), Template("mit", ("mit license",))]
# Further public licences by their characteristic phrases.
MORE = [
    Template("bsd", ("redistribution and use in source and binary forms",)),
    Template("lgpl", ("gnu lesser general public license",)),
    Template("agpl", ("gnu affero general public license",)),
    Template("mpl", ("mozilla public license",)),
    Template("epl", ("eclipse public license",)),
    Template("boost", ("boost software license",)),
    Template("isc", ("permission to use copy modify and or distribute this software", "provided that the above copyright notice")),
    Template("unlicense", ("free and unencumbered software", "released into the public domain")),
    Template("mit", ("permission is hereby granted free of charge", "without restriction")),
    Template("apache", ("licensed under the apache license", "version 2 0")),
]
TEMPLATES = BASE + MORE


@dataclass(frozen=True)
class Posting:
    """A piece of a phrase under its rarest word: offsets of that word and of the piece are those in the phrase."""

    word: str
    phrase: int
    piece: int
    at: int
    first: int
    words: list[str]


def phrases_of(templates: list[Template]) -> list[list[str]]:
    return [list(p) for p in sorted({tuple(phrase.split()) for t in templates for phrase in t.phrases})]


def words_of(text_col: str = "text") -> Column:
    """Words of a text in lower case, with an empty one at an end where a separator stands."""
    # the Kelvin sign is the one letter beyond A-Z whose lower case is ASCII alone; another letter in its place keeps it apart
    return F.split(F.lower(F.replace(text_of(text_col), F.lit("\u212a"), F.lit("\u017f"))), SEPARATORS, -1)


def document_frequencies(files: DataFrame, phrases: list[list[str]], text_col: str = "text") -> dict[str, int]:
    """Number of files with each word of the phrases; as many numbers as they have words."""
    words = sorted({w for p in phrases for w in p})
    seen = files.select(F.explode(F.array_distinct(F.filter(words_of(text_col), lambda w: w.isin(words)))).alias("w"))
    n = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: n.get(w, 0) for w in words}


def postings(phrases: list[list[str]], frequencies: dict[str, int]) -> list[Posting]:
    """Each piece under its rarest word; of equally rare ones the first in text order, then in the phrase."""
    out = []
    for i, p in enumerate(phrases):
        for first in range(0, len(p), PIECE):
            piece = p[first:first + PIECE]
            k = min(range(len(piece)), key=lambda k: (frequencies[piece[k]], piece[k], k))
            out.append(Posting(piece[k], i, first // PIECE, first + k, first, piece))
    return out


def with_places(files: DataFrame, filed: list[Posting], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, places `(i, w, lo, near)` of filed words, blob (content address, null without places).

    `near` are the words from `lo` on that a phrase under the word can cover.
    """
    before: dict[str, int] = {}
    after: dict[str, int] = {}
    for p in filed:
        before[p.word] = max(before.get(p.word, 0), p.at - p.first)
        after[p.word] = max(after.get(p.word, 0), p.first + len(p.words) - 1 - p.at)
    words = sorted({w for p in filed for w in p.words})
    reach = F.from_json(F.lit(json.dumps({w: {"b": before[w], "a": after[w]} for w in sorted(before)})), "map<string,struct<b:int,a:int>>")

    def found(ws: Column) -> Column:
        skip = (F.get(ws, F.lit(0)) == "").cast("int")
        tail = ((F.size(ws) > 1) & (F.get(ws, F.size(ws) - 1) == "")).cast("int")

        def place(i: Column, w: Column, r: Column) -> Column:
            lo = F.greatest(i - r["b"], F.lit(0))
            near = F.transform(F.slice(ws, lo + 1, i + r["a"] + 1 - lo), lambda x: F.when(x.isin(words), x))
            return F.struct((i - skip).alias("i"), w.alias("w"), (lo - skip).alias("lo"), near.alias("near"))

        places = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(list(before)), let(F.element_at(reach, w), lambda r: place(i, w, r)))),
                          lambda x: x.isNotNull())
        return F.struct((F.size(ws) - skip - tail).cast("long").alias("n_words"), places.alias("places"))

    rows = files.select(F.col(id_col), text_of(text_col).alias("_text"), let(words_of(text_col), found).alias("_found"))
    return rows.select(id_col, "_found.n_words", "_found.places",
                       F.when(F.size("_found.places") > 0, F.sha2("_text", 256)).alias("blob"))


def phrase_places(rows: DataFrame, phrases: list[list[str]], filed: list[Posting]) -> DataFrame:
    """blob, phrase, start, n, matched: how many of the n words of a fetched phrase stand where it would start."""
    spark = rows.sparkSession
    index = spark.createDataFrame([(p.word, p.phrase, p.piece, p.at, p.first, p.words, len(phrases[p.phrase])) for p in filed],
                                  "w string, phrase int, piece int, at int, first int, words array<string>, n int")
    if len(filed) <= MAX_BROADCAST_POSTINGS:
        index = F.broadcast(index)
    fetched = rows.where("blob IS NOT NULL").select("blob", F.inline("places")).join(index, "w")
    start = F.col("i") - F.col("at")
    same = F.filter(F.transform("words", lambda w, k: w == F.get("near", start + F.col("first") + k - F.col("lo"))), lambda x: x)
    # files of one content give the same rows: counted once, before they travel
    pieces = (fetched.select("blob", "phrase", "piece", "n", start.alias("start"), F.size(same).alias("same"))
              .groupBy("blob", "phrase", "start", "piece", "n").agg(F.max("same").alias("same")))
    return pieces.groupBy("blob", "phrase", "start", "n").agg(F.sum("same").cast("int").alias("matched"))


def licence_labels(files: DataFrame, templates: list[Template], base: list[Template], id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """id, n_words, places of base phrases and their first and last start, labels, score.

    The score is 1 with a label; else half of the largest share of a fetched phrase's words that stand at their places.
    """
    spark, steps = files.sparkSession, Steps(files.sparkSession, "licences")
    phrases = phrases_of(templates)
    filed = postings(phrases, document_frequencies(files, phrases, text_col))
    rows = steps.save(with_places(files, filed, id_col, text_col), "places")

    number = {" ".join(p): i for i, p in enumerate(phrases)}
    of = [sorted({number[" ".join(f.split())] for f in t.phrases}) for t in templates]
    needs = spark.createDataFrame([(j, t.label, t in base, len(of[j]), i) for j, t in enumerate(templates) for i in of[j]],
                                  "template int, label string, base boolean, wanted int, phrase int")
    # a phrase of two base templates has its places counted with each
    times = needs.where("base").groupBy("phrase").agg(F.count("*").alias("times"))
    full = F.col("matched") == F.col("n")
    found = phrase_places(rows, phrases, filed).groupBy("blob", "phrase").agg(
        F.count_if(full).alias("places"), F.min(F.when(full, F.col("start"))).alias("first"),
        F.max(F.when(full, F.col("start"))).alias("last"), F.max(F.col("matched") / F.col("n")).alias("share"))
    found = steps.save(found, "found")
    based = F.col("times").isNotNull()
    spots = found.join(times, "phrase", "left").groupBy("blob").agg(
        F.sum(F.col("places") * F.coalesce("times", F.lit(0))).alias("n_base"), F.min(F.when(based, F.col("first"))).alias("first_word"),
        F.max(F.when(based, F.col("last"))).alias("last_word"), F.max("share").alias("share"))
    given = (found.where("places > 0").join(needs, "phrase").groupBy("blob", "template", "label", "base", "wanted")
             .agg(F.count("*").alias("got")).where("got = wanted"))
    labels = given.groupBy("blob").agg(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
                                       F.array_sort(F.collect_set("label")).alias("labels"))
    of_blob = spots.join(labels, "blob", "left")

    def out(rows: DataFrame, *cols: Column) -> DataFrame:
        names = ["n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        return rows.select(F.col(id_col), "n_words", *[c.alias(n) for c, n in zip(cols, names)])

    none, no_place = F.lit(""), F.lit(None).cast("long")
    labelled = F.coalesce(F.size("labels") > 0, F.lit(False))
    hit = out(rows.where("blob IS NOT NULL").join(of_blob, "blob"),
              F.col("n_base").cast("long"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
              F.coalesce(F.array_join("base_labels", ","), none), F.coalesce(F.array_join("labels", ","), none),
              F.round(F.when(labelled, 1.0).otherwise(F.col("share") / 2), 6))
    rest = out(rows.where("blob IS NULL"), F.lit(0).cast("long"), no_place, no_place, none, none, F.lit(0.0))
    return hit.unionByName(rest)


def _sql() -> str:
    phrases, upper = phrases_of(TEMPLATES), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    number = {" ".join(p): i for i, p in enumerate(phrases)}
    words = ", ".join(f"({i}, {k}, '{w}')" for i, p in enumerate(phrases) for k, w in enumerate(p))
    lengths = ", ".join(f"({i}, {len(p)})" for i, p in enumerate(phrases))
    needs = ", ".join(f"({j}, '{t.label}', {j < len(BASE)}, {len(t.phrases)}, {number[p]})"
                      for j, t in enumerate(TEMPLATES) for p in t.phrases)
    return f"""
WITH t AS (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{SEPARATORS}') AS raw
           FROM documents),
d AS (SELECT doc_id, list_filter(raw, lambda w: w <> '') AS ws FROM t),
vocab(i, k, w) AS (VALUES {words}), len(i, n) AS (VALUES {lengths}), needs(j, label, base, n, i) AS (VALUES {needs}),
tok AS (SELECT doc_id, u.p - 1 AS p, u.w FROM (SELECT doc_id, unnest(list_zip(range(1, len(ws) + 1), ws)) AS z FROM d),
        LATERAL (SELECT z[1] AS p, z[2] AS w) u WHERE u.w IN (SELECT w FROM vocab)),
df AS (SELECT v.w, count(DISTINCT tok.doc_id) AS n FROM (SELECT DISTINCT w FROM vocab) v LEFT JOIN tok ON v.w = tok.w GROUP BY v.w),
filed AS (SELECT i, k FROM vocab JOIN df USING (w) QUALIFY row_number() OVER (PARTITION BY i ORDER BY df.n, w, k) = 1),
st AS (SELECT doc_id, v.i, tok.p - v.k AS s, count(*) AS m, any_value(len.n) AS n
       FROM tok JOIN vocab v USING (w) JOIN len ON v.i = len.i JOIN filed ON v.i = filed.i
       GROUP BY doc_id, v.i, tok.p - v.k HAVING bool_or(v.k = filed.k)),
lab AS (SELECT doc_id, j, label, base FROM (SELECT DISTINCT doc_id, i FROM st WHERE m = n) JOIN needs USING (i)
        GROUP BY doc_id, j, label, base, n HAVING count(*) = n),
labs AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels FROM lab GROUP BY doc_id),
places AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word
           FROM st JOIN (SELECT DISTINCT i FROM needs WHERE base) USING (i) WHERE m = n GROUP BY doc_id),
share AS (SELECT doc_id, max(m / n) / 2 AS part FROM st GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, round(CASE WHEN labels IS NOT NULL THEN 1e0 ELSE coalesce(part, 0e0) END, 6) AS score
FROM d LEFT JOIN labs USING (doc_id) LEFT JOIN places USING (doc_id) LEFT JOIN share USING (doc_id)"""


@query("op9_licence_scan", _sql())
def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_labels(table(spark, sf_dir, "documents"), TEMPLATES, BASE)
