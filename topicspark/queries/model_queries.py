"""Counts, rankings, likelihoods and trainers over the `documents` corpus."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from topicspark.functions.random import draw_category, near_one_array, uniform
from topicspark.functions.scalars import learning_rate
from topicspark.functions.vectors import literal_vector, vec_normalise, vec_sum
from topicspark.operators import blocks, counts, likelihood, ranking
from topicspark.operators.corpus import minibatches
from topicspark.plans import cvb0, gibbs, infer, online_vb, scvb0
from topicspark.plans.minibatch import blend_model, only_words, parameter_totals, start_model, topic_words
from topicspark.queries.base import (ASSIGNED, BOW, DT, K, ORACLES, POSITIONS, SEED, TOKENS, TW, VOCAB, batches, corpus,
                                     dig, near_one_sql, query, r_sql, rounded, table, u_sql, vocabulary_size)
from topicspark.session import Scratch
from topicspark.sources import exports, snapshots
from topicspark.streaming import online as stream


def _assigned(spark, d, seed=SEED):
    return counts.assign_uniform(corpus(spark, d).bow, K, seed)


# -- counts and rankings -----------------------------------------------------------------------------------------------

@query("gibbs_init_counts", f"WITH {TW} SELECT topic, word_id, n FROM tw")
def gibbs_init_counts(spark, d):
    return counts.topic_word_counts(_assigned(spark, d))


@query("gibbs_init_doc_topics", f"WITH {DT} SELECT doc_id, topic, n FROM dt")
def gibbs_init_doc_topics(spark, d):
    return counts.doc_topic_counts(_assigned(spark, d))


@query("topic_totals", f"WITH {TW} SELECT topic, CAST(sum(n) AS BIGINT) AS n FROM tw GROUP BY topic")
def topic_totals(spark, d):
    return counts.topic_totals(counts.topic_word_counts(_assigned(spark, d)))


@query("topic_in_docs", f"WITH {ASSIGNED} SELECT doc_id, count(*) FILTER (WHERE topic = 2) AS n FROM assigned GROUP BY doc_id")
def topic_in_docs(spark, d):
    return counts.topic_count_in_docs(_assigned(spark, d), 2)


@query("dense_counts", f"WITH {TW}, g AS (SELECT CAST(unnest(range({K})) AS INTEGER) AS topic, word_id FROM vocab) "
                       "SELECT topic, word_id, coalesce(n, 0) AS n FROM g LEFT JOIN tw USING (topic, word_id)")
def dense_counts(spark, d):
    """Every topic x word cell, zeros included; each word makes its own K cells."""
    grid = corpus(spark, d).vocab.select("word_id", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("topic"))
    tw = counts.topic_word_counts(_assigned(spark, d))
    return grid.join(tw, ["topic", "word_id"], "left").select("topic", "word_id", F.coalesce("n", F.lit(0)).alias("n"))


_RANKED = (TW + ", ranked AS (SELECT topic, word_id, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word_id) "
                "AS rank FROM tw), best AS MATERIALIZED (SELECT * FROM ranked WHERE rank <= 10), top AS (SELECT topic, "
                "CAST(rank AS INTEGER) AS rank, word_id, term, n FROM best JOIN vocab USING (word_id))")


def _top(spark, d, n=10):
    tw = counts.topic_word_counts(_assigned(spark, d)).withColumnRenamed("n", "value")
    return ranking.top_terms(tw, corpus(spark, d).vocab, n, K)


@query("top_words", f"WITH {_RANKED} SELECT topic, rank, word_id, term, n FROM top")
def top_words(spark, d):
    return _top(spark, d).withColumnRenamed("value", "n")


@query("top_words_rows", f"WITH {_RANKED} SELECT topic, string_agg(term, ',' ORDER BY rank) AS words FROM top GROUP BY topic")
def top_words_rows(spark, d):
    return ranking.topic_rows(_top(spark, d))


_WIDE = ", ".join(f"max(CASE WHEN topic = {k} THEN term END) AS topic_{k}" for k in range(K))


@query("top_words_wide", f"WITH {_RANKED} SELECT rank, {_WIDE} FROM top GROUP BY rank")
def top_words_wide(spark, d):
    return ranking.topic_columns(_top(spark, d), K)


@query("ranking_file",
       f"WITH {_RANKED}, w AS (SELECT rank, {_WIDE} FROM top GROUP BY rank) SELECT CAST(rank AS BIGINT) AS row, "
       + " || ".join(f"topic_{k} || ','" for k in range(K)) + " AS line FROM w UNION ALL SELECT 0, "
       + " || ".join(f"'Topic ' || (SELECT min(topic) FROM top WHERE topic = {k}) || ','" for k in range(K)))
def ranking_file(spark, d):
    return exports.ranking_file_lines(ranking.topic_columns(_top(spark, d), K), K)


@query("topic_row_file", f"WITH {_RANKED} SELECT CAST(topic AS BIGINT) AS row, topic || ',' || "
                         "string_agg(term, ',' ORDER BY rank) AS line FROM top GROUP BY topic")
def topic_row_file(spark, d):
    return exports.topic_row_lines(ranking.topic_rows(_top(spark, d)))


_WORD_LINE = " || ',' || ".join(f"count(*) FILTER (WHERE topic = {k})" for k in range(K))


@query("word_topic_csv", f"WITH {ASSIGNED} SELECT CAST(word_id AS BIGINT) AS row, '\"' || max(term) || '\",' || {_WORD_LINE} "
                         "AS line FROM assigned JOIN vocab USING (word_id) GROUP BY word_id")
def word_topic_csv(spark, d):
    """The topic-word counts with one labelled line per word, so that a line has K numbers whatever the vocabulary."""
    tw = counts.topic_word_counts(_assigned(spark, d))
    m = tw.select(F.col("word_id").cast("long").alias("row"), F.col("topic").alias("col"),
                  F.col("n").cast("double").alias("value"))
    labels = corpus(spark, d).vocab.select(F.col("word_id").cast("long").alias("row"), F.col("term").alias("label"))
    return exports.labelled_lines(m, labels, K, rows=labels)


@query("doc_topic_csv", f"WITH {ASSIGNED} SELECT doc_id AS row, {_WORD_LINE} AS line FROM documents LEFT JOIN assigned USING (doc_id) GROUP BY doc_id")
def doc_topic_csv(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row"))
    dt = counts.doc_topic_counts(_assigned(spark, d))
    return exports.matrix_lines(dt.select(F.col("doc_id").alias("row"), F.col("topic").alias("col"),
                                          F.col("n").cast("double").alias("value")), K, integer=True, rows=docs)


@query("merge_rows", f"WITH {BOW}, {POSITIONS} SELECT CAST(doc_pos // 64 % {K} AS INTEGER) AS topic, word_id, "
                     "CAST(sum(freq) AS BIGINT) AS value FROM bow JOIN pos USING (doc_id) GROUP BY 1, 2")
def merge_rows(spark, d):
    """Sparse rows of all minibatches added up, the minibatch number standing in for the topic."""
    b = batches(spark, d, 2)
    placed = minibatches(b.docs.select("doc_id", "doc_pos"), 64)
    rows = b.bow.drop("batch_id").join(placed, "doc_id").select(
        (F.col("batch_id") % K).alias("topic"), "word_id", F.col("freq").alias("value"))
    return counts.merge_sparse_rows(rows)


_OTHER = (", second AS (SELECT word_id, CAST(floor(" + u_sql(SEED + 1, "doc_id", "word_id", "occ")
          + f" * {K}) AS INTEGER) AS topic FROM assigned)")


@query("adlda_merge", f"WITH {ASSIGNED}{_OTHER} SELECT topic, word_id, count(*) AS n FROM second GROUP BY topic, word_id")
def adlda_merge(spark, d):
    """Global counts plus the sum of local minus global, checked against a count of the new topics alone."""
    before, after = _assigned(spark, d), _assigned(spark, d, SEED + 1)
    return counts.apply_deltas(counts.topic_word_counts(before), counts.block_deltas(before, after)).select(
        "topic", "word_id", F.col("n").cast("long").alias("n"))


# -- likelihood and hyper-parameters -----------------------------------------------------------------------------------

_A, _B = 0.1, 0.01
_VB = f"(SELECT count(*) FROM vocab) * {_B}e0"
_TOPIC_LL = (f"SELECT topic, lgamma({_VB}) - lgamma(sum(n) + {_VB}) + sum(lgamma(n + {_B}e0) - lgamma({_B}e0)) AS ll "
             "FROM tw GROUP BY topic")
_DOC_LL = (f"SELECT doc_id, lgamma({K * _A}e0) - lgamma(sum(n) + {K * _A}e0) + sum(lgamma(n + {_A}e0) - lgamma({_A}e0)) "
           "AS ll FROM dt GROUP BY doc_id")
_BOTH = TW + ", dt AS (SELECT doc_id, topic, count(*) AS n FROM assigned GROUP BY doc_id, topic)"


@query("loglik_topic", f"WITH {TW} SELECT topic, {r_sql('ll', 3)} AS loglik FROM ({_TOPIC_LL})")
def loglik_topic(spark, d):
    tw = counts.topic_word_counts(_assigned(spark, d))
    return likelihood.topic_loglik(tw, vocabulary_size(spark, d), _B).withColumn("loglik", rounded("loglik", 3))


@query("loglik_doc", f"WITH {DT} SELECT doc_id, {r_sql('ll', 5)} AS loglik FROM ({_DOC_LL})")
def loglik_doc(spark, d):
    dt = counts.doc_topic_counts(_assigned(spark, d))
    return likelihood.doc_loglik(dt, [_A] * K).withColumn("loglik", rounded("loglik", 5))


@query("loglik_total", f"WITH {_BOTH} SELECT {r_sql(f'(SELECT sum(ll) FROM ({_TOPIC_LL})) + (SELECT sum(ll) FROM ({_DOC_LL}))', 2)} AS loglik")
def loglik_total(spark, d):
    assigned = Scratch(spark, "loglik").save(_assigned(spark, d), "assigned")
    total = likelihood.total_loglik(counts.topic_word_counts(assigned), counts.doc_topic_counts(assigned),
                                    vocabulary_size(spark, d), [_A] * K, _B)
    return total.withColumn("loglik", rounded("loglik", 2))


_ALPHA = [0.1, 0.2, 0.3, 0.4]
_ALPHA_CASE = "CASE topic " + " ".join(f"WHEN {k} THEN {a}e0" for k, a in enumerate(_ALPHA)) + " END"


@query("alpha_step",
       f"WITH {DT}, x AS (SELECT topic, n, {_ALPHA_CASE} AS a FROM dt), num AS (SELECT topic, max(a) AS a, "
       f"sum({dig('n + a')} - {dig('a')}) AS num FROM x GROUP BY topic), den AS (SELECT sum({dig(f'n + {sum(_ALPHA)}e0')} - "
       f"{dig(f'{sum(_ALPHA)}e0')}) AS den FROM (SELECT doc_id, sum(n) AS n FROM dt GROUP BY doc_id)) "
       f"SELECT topic, {r_sql('a * num / den', 8)} AS alpha FROM num, den")
def alpha_step(spark, d):
    dt = counts.doc_topic_counts(_assigned(spark, d))
    return likelihood.alpha_step(dt, _ALPHA).withColumn("alpha", rounded("alpha", 8))


@query("beta_step",
       f"WITH {TW}, t AS (SELECT topic, sum({dig(f'n + {_B}e0')} - {dig(f'{_B}e0')}) AS num, sum(n) AS n FROM tw GROUP BY "
       f"topic) SELECT {r_sql(f'{_B}e0 * sum(num) / ((SELECT count(*) FROM vocab) * sum({dig(f'n + {_VB}')} - {dig(_VB)}))', 9)} "
       "AS beta FROM t")
def beta_step(spark, d):
    tw = counts.topic_word_counts(_assigned(spark, d))
    return likelihood.beta_step(tw, vocabulary_size(spark, d), _B).withColumn("beta", rounded("beta", 9))


_N_STEPS = 5


def _alpha_steps_sql() -> str:
    """Wide rows al0 .. al5, each from the counts of counts."""
    out = (", dl AS (SELECT doc_id, sum(n) AS n FROM dt GROUP BY doc_id), hd AS MATERIALIZED (SELECT n, count(*) AS times FROM dl GROUP BY n), "
           "hc AS MATERIALIZED (SELECT topic, n, count(*) AS times FROM dt GROUP BY topic, n), "
           "al0 AS (SELECT " + ", ".join(f"{a}e0 AS a{k}" for k, a in enumerate(_ALPHA)) + ")")
    total = " + ".join(f"a{k}" for k in range(K))
    for i in range(_N_STEPS):
        num = ", ".join(f"(SELECT sum(times * ({dig(f'n + a{k}')} - {dig(f'a{k}')})) FROM hc, al{i} WHERE topic = {k}) AS num{k}" for k in range(K))
        out += (f", q{i} AS MATERIALIZED (SELECT {num}, (SELECT sum(times * ({dig(f'n + {total}')} - {dig(f'({total})')})) FROM hd, al{i}) AS den), "
                f"al{i + 1} AS MATERIALIZED (SELECT " + ", ".join(f"a{k} * num{k} / den AS a{k}" for k in range(K)) + f" FROM al{i}, q{i})")
    return out


@query("alpha_steps", f"WITH {DT}{_alpha_steps_sql()} " + " UNION ALL ".join(
    f"SELECT CAST({k} AS INTEGER) AS topic, {r_sql(f'a{k}', 8)} AS alpha FROM al{_N_STEPS}" for k in range(K)))
def alpha_steps(spark, d):
    """Five fixed-point steps from one pass over the counts."""
    alpha = likelihood.alpha_steps(counts.doc_topic_counts(_assigned(spark, d)), _ALPHA, _N_STEPS, Scratch(spark, "alpha-steps"))
    return spark.createDataFrame(list(enumerate(alpha)), "topic int, alpha double").withColumn("alpha", rounded("alpha", 8))


def _beta_steps_sql() -> str:
    out = (", tz AS (SELECT topic, sum(n) AS n FROM tw GROUP BY topic), hc AS MATERIALIZED (SELECT n, count(*) AS times FROM tw GROUP BY n), "
           f"v AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS v FROM vocab), b0 AS (SELECT {_B}e0 AS b)")
    for i in range(_N_STEPS):
        out += (f", s{i} AS MATERIALIZED (SELECT (SELECT sum(times * ({dig('n + b')} - {dig('b')})) FROM hc, b{i}) AS num, "
                f"(SELECT sum({dig('n + v * b')} - {dig('(v * b)')}) FROM tz, v, b{i}) AS den), "
                f"b{i + 1} AS MATERIALIZED (SELECT b * num / (v * den) AS b FROM b{i}, s{i}, v)")
    return out


@query("beta_steps", f"WITH {TW}{_beta_steps_sql()} SELECT {r_sql('b', 9)} AS beta FROM b{_N_STEPS}")
def beta_steps(spark, d):
    tw = counts.topic_word_counts(_assigned(spark, d))
    beta = likelihood.beta_steps(tw, vocabulary_size(spark, d), _B, _N_STEPS, Scratch(spark, "beta-steps"))
    return spark.createDataFrame([(beta,)], "beta double").withColumn("beta", rounded("beta", 9))


# -- starting values and joins -----------------------------------------------------------------------------------------

_WORD_PARAMS = ", lam AS (SELECT word_id, " + ", ".join(
    f"{near_one_sql(SEED, 'word_id', str(k))} AS l{k}" for k in range(K)) + " FROM vocab)"


def _long_sql(prefix: str, digits: int, keys: str, source: str, name: str = "value") -> str:
    """Wide columns prefix0..prefix{K-1} as (topic, value) rows."""
    return " UNION ALL ".join(
        f"SELECT {keys}, CAST({k} AS INTEGER) AS topic, {r_sql(f'{prefix}{k}', digits)} AS {name} FROM {source}" for k in range(K))


@query("start_params", f"WITH {VOCAB}{_WORD_PARAMS} {_long_sql('l', 9, 'word_id', 'lam')}")
def start_params(spark, d):
    model = start_model(corpus(spark, d).vocab, K, SEED, "hash")
    return topic_words(model).withColumn("value", rounded("value", 9))


@query("gamma_start", f"WITH {VOCAB} SELECT word_id, CAST({K} AS INTEGER) AS n_positive, true AS near_one FROM vocab")
def gamma_start(spark, d):
    """Sampled starting values: all positive, and within ten standard deviations of their mean."""
    model = start_model(corpus(spark, d).vocab, K, SEED, "gamma")
    return model.select("word_id", F.size(F.filter("params", lambda x: x > 0)).alias("n_positive"),
                        F.forall("params", lambda x: F.abs(x - 1) < 1).alias("near_one"))


@query("word_params_of_docs", f"WITH {BOW}{_WORD_PARAMS} SELECT doc_id, " + ", ".join(
    f"{r_sql(f'sum(freq * l{k})', 5)} AS s{k}" for k in range(K)) + " FROM bow JOIN lam USING (word_id) GROUP BY doc_id")
def word_params_of_docs(spark, d):
    """Parameter rows joined to the words of every document and summed."""
    c = corpus(spark, d)
    joined = counts.join_words(c.bow, start_model(c.vocab, K, SEED, "hash"))
    return joined.groupBy("doc_id").agg(*[rounded(F.sum(F.col("freq") * F.col("params")[k]), 5).alias(f"s{k}")
                                          for k in range(K)])


# -- CVB0 --------------------------------------------------------------------------------------------------------------

_PHI0 = (BOW + ", raw AS (SELECT doc_id, word_id, " + ", ".join(
    f"{u_sql(SEED, 'doc_id', 'word_id', str(k))} AS u{k}" for k in range(K)) + " FROM bow), p0 AS (SELECT doc_id, word_id, "
    + ", ".join(f"u{k} / ({' + '.join(f'u{j}' for j in range(K))}) AS p{k}" for k in range(K)) + " FROM raw)")
_CA, _CB = 0.01, 0.01


def _cvb0_sums(i: int) -> str:
    cols = ", ".join(f"sum(p{k}) AS {{0}}{k}" for k in range(K))
    return (f", w{i} AS (SELECT word_id, {cols.format('w')} FROM p{i} GROUP BY word_id), "
            f"d{i} AS (SELECT doc_id, {cols.format('d')} FROM p{i} GROUP BY doc_id), "
            f"t{i} AS (SELECT {', '.join(f'sum(p{k}) AS t{k}' for k in range(K))} FROM p{i})")


def _cvb0_sweep(i: int) -> str:
    vb = f"(SELECT count(*) FROM vocab) * {_CB}e0"
    raw = ", ".join(f"({_CA}e0 + d{k} - p{k}) * ({_CB}e0 + w{k} - p{k}) / ({vb} + t{k} - p{k}) AS r{k}" for k in range(K))
    total = " + ".join(f"r{k}" for k in range(K))
    return (_cvb0_sums(i) + f", r{i} AS (SELECT doc_id, word_id, {raw} FROM p{i} JOIN w{i} USING (word_id) JOIN d{i} "
            f"USING (doc_id), t{i}), p{i + 1} AS (SELECT doc_id, word_id, "
            + ", ".join(f"r{k} / ({total}) AS p{k}" for k in range(K)) + f" FROM r{i})")


def _topic_cells(df, key, col, digits, name="value"):
    return df.select(key, F.posexplode(col).alias("topic", name)).withColumn(name, rounded(name, digits))


def _cvb0_start(spark, d):
    """The packed start of a run, in a folder of this call alone: other results may still be read."""
    cfg, bow = cvb0.CVB0(K, _CA, _CB, seed=SEED, init="hash"), corpus(spark, d).bow
    tables = blocks.BlockTables(Scratch(spark, "cvb0-once"), cvb0.n_blocks(bow.count(), cfg))
    return cfg, tables, cvb0.start_state(bow, cfg, tables)


def _cvb0_first(spark, d):
    """The packed start as plain files."""
    return _cvb0_start(spark, d)[1].release("phi/0")


@query("cvb0_init", f"WITH {_PHI0}{_cvb0_sums(0)} {_long_sql('w', 6, 'word_id', 'w0')}")
def cvb0_init(spark, d):
    return _topic_cells(cvb0.word_sums(_cvb0_first(spark, d), K), "word_id", "params", 6)


@query("cvb0_init_docs", f"WITH {_PHI0}{_cvb0_sums(0)} {_long_sql('d', 6, 'doc_id', 'd0')}")
def cvb0_init_docs(spark, d):
    return _topic_cells(cvb0.doc_sums(_cvb0_first(spark, d)), "doc_id", "n_dk", 6)


def _cvb0_once(spark, d):
    """What a sweep from the packed start needs: the start, the words of its blocks, and the word and topic sums."""
    cfg, tables, state = _cvb0_start(spark, d)
    in_blocks = tables.scratch.save(cvb0.words_of_blocks(state), "block_words")
    by_word = tables.scratch.save(cvb0.word_sums(state, K), "by_word")
    return cfg, tables, state, in_blocks, by_word, parameter_totals(by_word, K)


@query("cvb0_sweep", f"WITH {_PHI0}{_cvb0_sweep(0)} {_long_sql('p', 5, 'doc_id, word_id', 'p1')}")
def cvb0_sweep(spark, d):
    """Every responsibility after one synchronous sweep."""
    cfg, tables, _, in_blocks, by_word, totals = _cvb0_once(spark, d)
    phi = cvb0.responsibilities(tables.release("phi/0"), in_blocks, [(by_word, totals)], vocabulary_size(spark, d), cfg, tables)
    return (phi.select("doc_id", "word_id", F.posexplode("phi").alias("topic", "value"))
            .withColumn("value", rounded("value", 5)))


@query("cvb0_sweep_docs", f"WITH {_PHI0}{_cvb0_sweep(0)}{_cvb0_sums(1)} {_long_sql('d', 5, 'doc_id', 'd1')}")
def cvb0_sweep_docs(spark, d):
    cfg, tables, state, in_blocks, by_word, totals = _cvb0_once(spark, d)
    tables.save(cvb0.sweep(state, in_blocks, by_word, totals, vocabulary_size(spark, d), cfg, tables), "phi/1")
    tables.drop("phi/0")
    return _topic_cells(cvb0.doc_sums(tables.release("phi/1")), "doc_id", "n_dk", 5)


_CVB0_LL = (f"{_PHI0}{_cvb0_sweep(0)}{_cvb0_sweep(1)}{_cvb0_sums(2)}")
_LGB = f"lgamma({_CB}e0)"


@query("cvb0_loglik",
       f"WITH {_CVB0_LL}, v AS (SELECT (SELECT count(*) FROM vocab) * {_CB}e0 AS vb), "
       f"a AS (SELECT sum({' + '.join(f'lgamma(w{k} + {_CB}e0) - {_LGB}' for k in range(K))}) AS x FROM w2), "
       f"b AS (SELECT {' + '.join(f'lgamma(vb) - lgamma(t{k} + vb)' for k in range(K))} AS x FROM t2, v), "
       f"c AS (SELECT sum(lgamma({K * _CA}e0) - lgamma({' + '.join(f'd{k}' for k in range(K))} + {K * _CA}e0) + "
       f"{' + '.join(f'lgamma(d{k} + {_CA}e0) - lgamma({_CA}e0)' for k in range(K))}) AS x FROM d2) "
       f"SELECT CAST(2 AS INTEGER) AS t, {r_sql('a.x + b.x + c.x', 2)} AS loglik FROM a, b, c")
def cvb0_loglik(spark, d):
    """The likelihood after two synchronous sweeps of the fit."""
    fit = cvb0.fit(corpus(spark, d).bow, vocabulary_size(spark, d), cvb0.CVB0(K, _CA, _CB, 2, SEED, init="hash"))
    return fit.metrics.where("t = 2").select("t", rounded("value", 2).alias("loglik"))


# -- online VB ---------------------------------------------------------------------------------------------------------

_VA, _VE, _STEPS = 0.1, 0.05, 3
_TAU0, _KAPPA = 4.0, 0.7


def _vb_estep_sql(t: int, steps: int, where: str, alpha: list[float] = [_VA] * K) -> str:
    """CTEs from the wide model lam{t}: E log beta, `steps` fixed-point steps for the documents chosen by `where`, the
    statistics ss{t} and the documents' scores sc{t}."""
    n = range(K)
    total = ", ".join(f"sum(l{k}) AS s{k}" for k in n)
    out = (f", tot{t} AS (SELECT {total} FROM lam{t}), e{t} AS (SELECT word_id, "
           + ", ".join(f"{dig(f'l{k}')} - {dig(f's{k}')} AS e{k}" for k in n) + f" FROM lam{t}, tot{t}), "
           f"w{t} AS (SELECT doc_id, word_id, freq, {', '.join(f'e{k}' for k in n)} FROM bow JOIN batch USING (doc_id) "
           f"JOIN e{t} USING (word_id) WHERE {where}), g{t}_0 AS (SELECT doc_id, "
           + ", ".join(f"{near_one_sql(SEED, 'doc_id', str(k))} AS g{k}" for k in n)
           + f" FROM (SELECT DISTINCT doc_id FROM w{t}))")
    g_sum = " + ".join(f"g{k}" for k in n)
    for i in range(steps + 1):
        out += (f", th{t}_{i} AS (SELECT doc_id, " + ", ".join(f"{dig(f'g{k}')} - {dig(g_sum)} AS h{k}" for k in n)
                + f" FROM g{t}_{i}), r{t}_{i} AS (SELECT doc_id, word_id, freq, "
                + ", ".join(f"exp(e{k} + h{k}) AS r{k}" for k in n) + f" FROM w{t} JOIN th{t}_{i} USING (doc_id)), "
                f"n{t}_{i} AS (SELECT doc_id, word_id, freq, {' + '.join(f'r{k}' for k in n)} AS z, "
                + ", ".join(f"freq * r{k} / ({' + '.join(f'r{j}' for j in n)} + 1e-100) AS n{k}" for k in n)
                + f" FROM r{t}_{i})")
        if i < steps:
            out += (f", g{t}_{i + 1} AS (SELECT doc_id, "
                    + ", ".join(f"{alpha[k]}e0 + sum(n{k}) AS g{k}" for k in n) + f" FROM n{t}_{i} GROUP BY doc_id)")
    prior = " + ".join(f"({alpha[k]}e0 - g{k}) * h{k} + lgamma(g{k}) - lgamma({alpha[k]}e0)" for k in n)
    out += (f", ss{t} AS (SELECT word_id, {', '.join(f'sum(n{k}) AS ss{k}' for k in n)} FROM n{t}_{steps - 1} GROUP BY word_id)"
            f", sc{t} AS (SELECT doc_id, words + {prior} + lgamma({sum(alpha)}e0) - lgamma({g_sum}) AS score, n_tokens "
            f"FROM g{t}_{steps} JOIN th{t}_{steps} USING (doc_id) JOIN (SELECT doc_id, sum(freq * ln(z)) AS words, "
            f"sum(freq) AS n_tokens FROM n{t}_{steps} GROUP BY doc_id) USING (doc_id))")
    return out


def _vb_mstep_sql(t: int) -> str:
    rho = f"pow({_TAU0}e0 + {t}, -{_KAPPA}e0)"
    scale = f"(SELECT CAST(count(*) AS DOUBLE) FROM documents) / (SELECT count(*) FROM batch WHERE batch_id = {t})"
    return (f", lam{t + 1} AS (SELECT word_id, " + ", ".join(
        f"(1e0 - {rho}) * l{k} + {rho} * ({_VE}e0 + {scale} * coalesce(ss{k}, 0e0)) AS l{k}" for k in range(K))
        + f" FROM lam{t} LEFT JOIN ss{t} USING (word_id))")


def _vb_bound_sql(t: int) -> str:
    """ln perplexity of minibatch t under the model before its update."""
    n = range(K)
    cells = " + ".join(f"({_VE}e0 - l{k}) * e{k} + lgamma(l{k}) - lgamma({_VE}e0)" for k in n)
    tops = " + ".join(f"lgamma({_VE}e0 * (SELECT count(*) FROM vocab)) - lgamma(s{k})" for k in n)
    s, dd = f"(SELECT count(*) FROM batch WHERE batch_id = {t})", "(SELECT CAST(count(*) AS DOUBLE) FROM documents)"
    return (f"SELECT CAST({t} AS INTEGER) AS t, -((SELECT sum(score) FROM sc{t}) * {dd} / {s} + (SELECT sum({cells}) FROM lam{t} "
            f"JOIN e{t} USING (word_id)) + (SELECT {tops} FROM tot{t})) * {s} / ({dd} * (SELECT sum(n_tokens) FROM sc{t})) AS x")


def _vb_start(parts: int) -> str:
    lam = _WORD_PARAMS.replace("lam AS", "lam0 AS")
    return (f"{BOW}, {POSITIONS}, batch AS (SELECT doc_id, CAST(doc_pos // (SELECT (count(*) + {parts - 1}) // {parts} "
            f"FROM documents) AS INTEGER) AS batch_id FROM pos){lam}")


_ONE = _vb_start(1) + _vb_estep_sql(0, _STEPS, "batch_id = 0")
_TWO_PASSES = (_vb_start(2) + _vb_estep_sql(0, 2, "batch_id = 0") + _vb_mstep_sql(0)
               + _vb_estep_sql(1, 2, "batch_id = 1") + _vb_mstep_sql(1))


def _vb(max_iter=_STEPS, alpha=_VA, **more):
    return online_vb.OnlineVB(K, alpha, _VE, _TAU0, _KAPPA, max_iter, 0.0, SEED, "hash", **more)


def _vb_docs(spark, d):
    """The E-step of the whole corpus under the starting model, per document."""
    c = corpus(spark, d)
    scratch = Scratch(spark, "vb-step")
    model = scratch.save(start_model(c.vocab, K, SEED, "hash"), "model")
    return online_vb.document_posteriors(c.bow, model, parameter_totals(model, K), _vb(), scratch, "estep")


def _vb_words(spark, d):
    """The same, per word."""
    c = corpus(spark, d)
    scratch = Scratch(spark, "vb-step")
    model = scratch.save(start_model(c.vocab, K, SEED, "hash"), "model")
    return online_vb.word_statistics(c.bow, model, parameter_totals(model, K), _vb(), scratch, "estep")


@query("log_expectation", f"WITH {_ONE} {_long_sql('e', 6, 'word_id', 'e0')}")
def log_expectation(spark, d):
    model = start_model(corpus(spark, d).vocab, K, SEED, "hash")
    return _topic_cells(online_vb.log_expectation(model, parameter_totals(model, K)), "word_id", "elog", 6)


@query("vb_estep", f"WITH {_ONE} {_long_sql('g', 4, 'doc_id', f'g0_{_STEPS}')}")
def vb_estep(spark, d):
    return _topic_cells(_vb_docs(spark, d), "doc_id", "vec", 4)


@query("vb_doc_bound", f"WITH {_ONE} SELECT doc_id, {r_sql('score', 3)} AS score, CAST(n_tokens AS BIGINT) AS n_tokens FROM sc0")
def vb_doc_bound(spark, d):
    return _vb_docs(spark, d).select("doc_id", rounded("score", 3).alias("score"), "n_tokens")


@query("vb_score_sum", f"WITH {_ONE} SELECT {r_sql('sum(score)', 2)} AS score, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM sc0")
def vb_score_sum(spark, d):
    return counts.merge_scores(_vb_words(spark, d)).select(rounded("score", 2).alias("score"), "n_tokens")


@query("vb_suffstats", f"WITH {_ONE} {_long_sql('ss', 4, 'word_id', 'ss0')}")
def vb_suffstats(spark, d):
    return _topic_cells(only_words(_vb_words(spark, d)), "word_id", "ss", 4)


@query("vb_estep_joined", f"WITH {_ONE} {_long_sql('g', 4, 'doc_id', f'g0_{_STEPS}')}")
def vb_estep_joined(spark, d):
    """The same E-step by joins and aggregates only, the way documents too long for one task are handled."""
    c = corpus(spark, d)
    scratch = Scratch(spark, "vb-joined")
    model = scratch.save(start_model(c.vocab, K, SEED, "hash"), "model")
    start = c.bow.select("doc_id").distinct().select("doc_id", near_one_array(SEED, K, "doc_id").alias("gamma"))
    elog = online_vb.log_expectation(model, parameter_totals(model, K))
    docs = online_vb.joined_e_step(c.bow, elog, start, [_VA] * K, _STEPS, 0.0, scratch, "estep")[1]
    return _topic_cells(docs, "doc_id", "vec", 4)


@query("vb_mstep", f"WITH {_ONE}{_vb_mstep_sql(0)} {_long_sql('l', 4, 'word_id', 'lam1')}")
def vb_mstep(spark, d):
    fit = online_vb.fit(batches(spark, d, 1), corpus(spark, d).vocab, _vb(bound=False))
    return _topic_cells(fit.model, "word_id", "params", 4)


@query("vb_perplexity", f"WITH {_TWO_PASSES}, b AS ({_vb_bound_sql(0)} UNION ALL {_vb_bound_sql(1)}) "
                        f"SELECT t, {r_sql('x', 6)} AS log_perplexity FROM b")
def vb_perplexity(spark, d):
    fit = online_vb.fit(batches(spark, d, 2), corpus(spark, d).vocab, _vb(2))
    return fit.metrics.select("t", rounded(F.log("value"), 6).alias("log_perplexity"))


@query("vb_fit", f"WITH {_TWO_PASSES} {_long_sql('l', 4, 'word_id', 'lam2')}")
def vb_fit(spark, d):
    """Two minibatches in order."""
    fit = online_vb.fit(batches(spark, d, 2), corpus(spark, d).vocab, _vb(2, bound=False))
    return _topic_cells(fit.model, "word_id", "params", 4)


@query("vb_snapshots", f"WITH {_TWO_PASSES} " + " UNION ALL ".join(
    f"SELECT CAST({t} AS INTEGER) AS t, topic, word_id, value FROM ({_long_sql('l', 4, 'word_id', f'lam{t}')})" for t in range(3)))
def vb_snapshots(spark, d):
    """All model versions of a run that keeps its snapshots, the run being continued once from a snapshot."""
    base = Scratch(spark, "vb-snapshots").base
    b, words = batches(spark, d, 2), corpus(spark, d).vocab
    snapshots.write_model(start_model(words, K, SEED, "hash"), f"{base}/model", 0)
    online_vb.fit(b, words, _vb(2, bound=False), snapshots=base)
    cells = snapshots.read_all_versions(spark, f"{base}/model").select("t", "word_id", F.posexplode("params").alias("topic", "value"))
    return cells.withColumn("value", rounded("value", 4))


@query("stream_fit", f"WITH {_TWO_PASSES} {_long_sql('l', 4, 'word_id', 'lam2')}")
def stream_fit(spark, d):
    """The two minibatches arrive as files of a stream; the model equals that of the batch run."""
    b, scratch, files = batches(spark, d, 2), Scratch(spark, "stream"), 4      # a minibatch arrives in that many files
    for t in range(b.n_batches):
        docs = b.bow.where(F.col("batch_id") == t).groupBy("doc_id").agg(
            F.sort_array(F.collect_list(F.struct("word_id", "freq"))).alias("x"))
        arrived = (b.docs.where(F.col("batch_id") == t).select("doc_id").join(docs, "doc_id", "left")
                   .select("doc_id", F.coalesce("x.word_id", F.array().cast("array<int>")).alias("words"),
                           F.coalesce("x.freq", F.array().cast("array<int>")).alias("freqs")))
        arrived.repartition(files).write.mode("append").parquet(scratch.path("in"))
    run = stream.train_stream(stream.document_stream(spark, scratch.path("in"), files), corpus(spark, d).vocab,
                              b.n_words, b.n_docs, _vb(2, bound=False), scratch.path("run"), scratch.path("checkpoint"))
    run.awaitTermination()
    return _topic_cells(stream.fitted_model(spark, scratch.path("run")), "word_id", "params", 4)


def _all_g(alpha: list[float]) -> str:
    """gamma of every document; alpha without words."""
    cells = ", ".join(f"coalesce(g{k}, {alpha[k]}e0) AS g{k}" for k in range(K))
    return f", g_all AS (SELECT doc_id, {cells} FROM documents LEFT JOIN g0_{_STEPS} USING (doc_id))"


@query("doc_topics", f"WITH {_ONE}{_all_g([_VA] * K)} {_long_sql('g', 4, 'doc_id', 'g_all')}")
def doc_topics(spark, d):
    """Document topics under a fixed model, alpha for a document without words."""
    c = corpus(spark, d)
    model = Scratch(spark, "doc-topics").save(start_model(c.vocab, K, SEED, "hash"), "model")
    theta = infer.doc_topics(c.bow, model, _vb(), vocabulary_size(spark, d), documents=table(spark, d, "documents"))
    return _topic_cells(theta, "doc_id", "theta", 4)


_VAS = [0.05, 0.1, 0.2, 0.4]
_ONE_ALPHA = _vb_start(1) + _vb_estep_sql(0, _STEPS, "batch_id = 0", _VAS)


@query("doc_topics_alpha", f"WITH {_ONE_ALPHA}{_all_g(_VAS)} {_long_sql('g', 4, 'doc_id', 'g_all')}")
def doc_topics_alpha(spark, d):
    """The same with an alpha per topic, as a stored or learned one is."""
    c = corpus(spark, d)
    model = Scratch(spark, "doc-topics").save(start_model(c.vocab, K, SEED, "hash"), "model")
    theta = infer.doc_topics(c.bow, model, _vb(alpha=_VAS), vocabulary_size(spark, d), documents=table(spark, d, "documents"))
    return _topic_cells(theta, "doc_id", "theta", 4)


@query("vb_estep_alpha", f"WITH {_ONE_ALPHA} SELECT doc_id, {r_sql('score', 3)} AS score FROM sc0")
def vb_estep_alpha(spark, d):
    """The bound of every document with an alpha per topic."""
    c = corpus(spark, d)
    scratch = Scratch(spark, "vb-alpha")
    model = scratch.save(start_model(c.vocab, K, SEED, "hash"), "model")
    docs = online_vb.document_posteriors(c.bow, model, parameter_totals(model, K), _vb(alpha=_VAS), scratch, "estep")
    return docs.select("doc_id", rounded("score", 3).alias("score"))


@query("doc_topic_shares", f"WITH {DT}, s AS (SELECT doc_id, sum(n) AS c FROM dt GROUP BY doc_id) SELECT doc_id, topic, "
                           f"{r_sql('n / c', 6)} AS value FROM dt JOIN s USING (doc_id)")
def doc_topic_shares(spark, d):
    theta = infer.counted_doc_topics(counts.doc_topic_counts(_assigned(spark, d)), K)
    return _topic_cells(theta.select("doc_id", vec_normalise(F.col("theta")).alias("theta")), "doc_id", "theta",
                        6).where("value > 0")


# -- SCVB0 -------------------------------------------------------------------------------------------------------------

_RHO = "pow(10e0 + 0, -0.9e0)"


@query("scvb0_global",
       f"WITH {TW}{_WORD_PARAMS}, c AS (SELECT word_id, " + ", ".join(
           f"sum(CASE WHEN topic = {k} THEN n ELSE 0 END) AS c{k}" for k in range(K)) + " FROM tw GROUP BY word_id), "
       "b AS (SELECT word_id, " + ", ".join(
           f"(1e0 - {_RHO}) * l{k} + {_RHO} * 2.5e0 * coalesce(c{k}, 0) AS l{k}" for k in range(K))
       + f" FROM lam LEFT JOIN c USING (word_id)) {_long_sql('l', 5, 'word_id', 'b')}")
def scvb0_global(spark, d):
    """The global update, with the counts of uniform topics as the minibatch statistics."""
    model = start_model(corpus(spark, d).vocab, K, SEED, "hash")
    ss = counts.array_form(counts.topic_word_counts(_assigned(spark, d)), K, "n").withColumnRenamed("values", "ss")
    return _topic_cells(blend_model(model, ss, K, learning_rate(0, 1.0, 10.0, 0.9), 2.5), "word_id", "params", 5)


_WORD_TOTALS = f"WITH {BOW} SELECT word_id, CAST(sum(freq) AS BIGINT) AS n FROM bow GROUP BY word_id"


@query("scvb0_invariants", _WORD_TOTALS)
def scvb0_invariants(spark, d):
    """Statistics of a whole pass summed over topics: every word must get its own number of tokens."""
    c, b = corpus(spark, d), batches(spark, d, 1)
    model = Scratch(spark, "scvb0").save(start_model(c.vocab, K, SEED, "gamma"), "model")
    cfg = scvb0.SCVB0(K, max_iter=1, seed=SEED)
    stats = scvb0.document_pass(c.bow, model, parameter_totals(model, K), b.n_words, cfg, b.n_tokens)
    return only_words(stats).select("word_id", F.round(vec_sum(F.col("ss"))).cast("long").alias("n"))


def _scvb0_pass_sql(t: int, sweeps: int, where: str = "true") -> str:
    """CTEs from the wide model lam{t}: the tokens of the documents chosen by `where`, folded in order; N_theta in nt{t} and the
    statistics of the last sweep in ss{t}.  An element holds a token's weights, rate and document length; the accumulator N_theta."""
    n, names = range(K), "abcdefgh"[:K]
    vb = f"(SELECT count(*) FROM vocab) * {_SB}e0"
    raw = [f"(acc.{x} + {_SA}e0) * tok.{x}" for x in names]
    phi = [f"({r}) / ({' + '.join(raw)} + 1e-100)" for r in raw]
    step = ", ".join(f"{x} := acc.{x} * (1e0 - tok.r) + tok.r * tok.z * {p}" for x, p in zip(names, phi))
    return (f", tot{t} AS (SELECT {', '.join(f'sum(l{k}) AS s{k}' for k in n)} FROM lam{t}), "
            f"wt{t} AS (SELECT word_id, {', '.join(f'({_SB}e0 + l{k}) / ({vb} + s{k}) AS w{k}' for k in n)} FROM lam{t}, tot{t}), "
            f"tk{t} AS (SELECT doc_id, word_id, {', '.join(f'w{k}' for k in n)}, row_number() OVER (PARTITION BY doc_id ORDER BY word_id, occ) - 1 "
            f"AS j, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, word_id, unnest(range(freq)) AS occ FROM bow JOIN batch "
            f"USING (doc_id) WHERE {where}) JOIN wt{t} USING (word_id)), "
            f"el{t} AS (SELECT doc_id, list(struct_pack({', '.join(f'{x} := w{k}' for k, x in enumerate(names))}, "
            f"r := greatest(0e0, 10e0 * pow(1000e0 + s * n + j, -0.9e0)), z := CAST(n AS DOUBLE), last := s = {sweeps - 1}, "
            f"p := CAST([] AS DOUBLE[][])) ORDER BY s, j) AS toks FROM tk{t}, (SELECT unnest(range({sweeps})) AS s) GROUP BY doc_id), "
            f"fo{t} AS MATERIALIZED (SELECT doc_id, list_reduce(toks, lambda acc, tok: struct_pack({step}, r := 0e0, z := 0e0, last := false, "
            f"p := CASE WHEN tok.last THEN list_append(acc.p, [{', '.join(phi)}]) ELSE acc.p END), struct_pack("
            + ", ".join(f"{x} := {near_one_sql(SEED, 'doc_id', str(k))}" for k, x in enumerate(names))
            + f", r := 0e0, z := 0e0, last := false, p := CAST([] AS DOUBLE[][]))) AS f FROM el{t}), "
            f"nt{t} AS (SELECT doc_id, {', '.join(f'f.{x} AS g{k}' for k, x in enumerate(names))} FROM fo{t}), "
            f"ss{t} AS (SELECT word_id, {', '.join(f'sum(p[{k + 1}]) AS ss{k}' for k in n)} FROM (SELECT doc_id, "
            f"unnest(f.p) AS p, unnest(range(len(f.p))) AS j FROM fo{t}) JOIN tk{t} USING (doc_id, j) GROUP BY word_id)")


def _scvb0_update_sql(t: int) -> str:
    rho = f"pow(10e0 + {t}, -0.9e0)"
    scale = f"(SELECT CAST(sum(freq) AS DOUBLE) FROM bow) / (SELECT count(*) FROM tk{t})"
    return (f", lam{t + 1} AS (SELECT word_id, " + ", ".join(
        f"(1e0 - {rho}) * l{k} + {rho} * {scale} * coalesce(ss{k}, 0e0) AS l{k}" for k in range(K))
        + f" FROM lam{t} LEFT JOIN ss{t} USING (word_id))")


_SA, _SB = 0.01, 0.01
_SCVB0_TWO = (_vb_start(2) + _scvb0_pass_sql(0, 2, "batch_id = 0") + _scvb0_update_sql(0)
              + _scvb0_pass_sql(1, 2, "batch_id = 1") + _scvb0_update_sql(1))


def _scvb0_two(spark, d, base=None):
    return scvb0.fit(batches(spark, d, 2), corpus(spark, d).vocab, scvb0.SCVB0(K, _SA, _SB, max_iter=1, seed=SEED, init="hash"), base)


@query("scvb0_fit", f"WITH {_SCVB0_TWO} {_long_sql('l', 4, 'word_id', 'lam2')}")
def scvb0_fit(spark, d):
    """The model after two minibatches, each with one burn-in sweep, token by token."""
    return _topic_cells(_scvb0_two(spark, d).model, "word_id", "params", 4)


@query("scvb0_versions", f"WITH {_SCVB0_TWO} " + " UNION ALL ".join(
    f"SELECT CAST({t} AS INTEGER) AS t, topic, word_id, value FROM ({_long_sql('l', 4, 'word_id', f'lam{t}')})" for t in range(3)))
def scvb0_versions(spark, d):
    """The values of all model versions of a run that keeps its snapshots."""
    base = Scratch(spark, "scvb0-versions").base
    _scvb0_two(spark, d, base)
    cells = snapshots.read_all_versions(spark, f"{base}/model").select("t", "word_id", F.posexplode("params").alias("topic", "value"))
    return cells.withColumn("value", rounded("value", 4))


def _scvb0_quality_sql(t: int) -> str:
    """Log-likelihood per token of minibatch t under N_theta and the model before its update."""
    n = range(K)
    prob = " + ".join(f"(g{k} + {_SA}e0) * w{k}" for k in n)
    total = " + ".join(f"(g{k} + {_SA}e0)" for k in n)
    return (f"SELECT CAST({t} AS INTEGER) AS t, -sum(freq * ln(({prob}) / ({total}))) / sum(freq) AS x "
            f"FROM bow JOIN nt{t} USING (doc_id) JOIN wt{t} USING (word_id)")


@query("scvb0_quality", f"WITH {_SCVB0_TWO}, q AS ({_scvb0_quality_sql(0)} UNION ALL {_scvb0_quality_sql(1)}) "
                        f"SELECT t, 'perplexity' AS kind, {r_sql('x', 6)} AS log_value FROM q")
def scvb0_quality(spark, d):
    """Perplexity of each minibatch under the model that has not seen it yet."""
    rows = _scvb0_two(spark, d).metrics.where(F.col("kind") == "perplexity")
    return rows.select("t", "kind", rounded(F.log("value"), 6).alias("log_value"))


@query("scvb0_doc_topics", f"WITH {_vb_start(1)}{_scvb0_pass_sql(0, 3)} {_long_sql('g', 4, 'doc_id', 'nt0')}")
def scvb0_doc_topics(spark, d):
    """N_theta of every document after three sweeps over its tokens in order."""
    c = corpus(spark, d)
    model = Scratch(spark, "scvb0-docs").save(start_model(c.vocab, K, SEED, "hash"), "model")
    cfg = scvb0.SCVB0(K, _SA, _SB, max_iter=2, seed=SEED, init="hash")
    return _topic_cells(infer.doc_topics(c.bow, model, cfg, vocabulary_size(spark, d)), "doc_id", "theta", 4)


_RHO_1 = "pow(11e0, -0.9e0)"


@query("scvb0_snapshots",
       f"WITH {BOW}{_WORD_PARAMS}, c AS (SELECT CAST(sum(freq) AS DOUBLE) AS c FROM bow), z AS (SELECT "
       f"sum({' + '.join(f'l{k}' for k in range(K))}) AS x FROM lam), one AS (SELECT (1e0 - {_RHO}) * x + {_RHO} * c AS x "
       f"FROM z, c), two AS (SELECT (1e0 - {_RHO_1}) * x + {_RHO_1} * c AS x FROM one, c) "
       + " UNION ALL ".join(f"SELECT CAST({t} AS INTEGER) AS t, {r_sql('x', 2)} AS mass FROM {n}"
                            for t, n in enumerate(("z", "one", "two"))))
def scvb0_snapshots(spark, d):
    """All versions of a run that keeps its snapshots: each step moves the expected counts towards the corpus size."""
    base = Scratch(spark, "scvb0-snapshots").base
    scvb0.fit(batches(spark, d, 2), corpus(spark, d).vocab, scvb0.SCVB0(K, max_iter=1, seed=SEED, init="hash"), base)
    versions = snapshots.read_all_versions(spark, f"{base}/model")
    return versions.groupBy("t").agg(rounded(F.sum(vec_sum(F.col("params"))), 2).alias("mass"))


@query("scvb0_doc_lengths", f"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens FROM tok GROUP BY doc_id")
def scvb0_doc_lengths(spark, d):
    """The tokens visited in each document by the counted pass."""
    c, b = corpus(spark, d), batches(spark, d, 1)
    model = Scratch(spark, "scvb0").save(start_model(c.vocab, K, SEED, "hash"), "model")
    cfg = scvb0.SCVB0(K, max_iter=0, seed=SEED)
    return scvb0.document_pass(c.bow, model, parameter_totals(model, K), b.n_words, cfg, b.n_tokens,
                               per_document=True).select("doc_id", "n_tokens")


# -- Gibbs -------------------------------------------------------------------------------------------------------------

def _gibbs(spark, d, **more):
    return gibbs.fit(corpus(spark, d).bow, vocabulary_size(spark, d), gibbs.Gibbs(K, seed=SEED, **more))


_DRAW = (TW + ", dt AS (SELECT doc_id, topic, count(*) AS n FROM assigned GROUP BY doc_id, topic), "
         "wk AS (SELECT word_id, " + ", ".join(f"coalesce(sum(n) FILTER (WHERE topic = {k}), 0) AS w{k}" for k in range(K))
         + " FROM tw GROUP BY word_id), dk AS (SELECT doc_id, "
         + ", ".join(f"coalesce(sum(n) FILTER (WHERE topic = {k}), 0) AS d{k}" for k in range(K))
         + " FROM dt GROUP BY doc_id), z AS (SELECT " + ", ".join(f"sum(w{k}) AS z{k}" for k in range(K)) + " FROM wk), "
         "pr AS (SELECT doc_id, word_id, occ, " + ", ".join(
             f"(w{k} + {_CB}e0) * (d{k} + {_CA}e0) / (z{k} + (SELECT count(*) FROM vocab) * {_CB}e0) AS p{k}" for k in range(K))
         + f", {u_sql(SEED + 2, 'doc_id', 'word_id', 'occ')} AS u FROM assigned JOIN wk USING (word_id) JOIN dk USING (doc_id), z)")
_CUM = [" + ".join(f"p{j}" for j in range(k + 1)) for k in range(K)]


@query("categorical_draw", f"WITH {_DRAW} SELECT doc_id, word_id, occ, CAST("
       + " + ".join(f"CASE WHEN {c} < u * ({_CUM[-1]}) THEN 1 ELSE 0 END" for c in _CUM[:-1]) + " AS INTEGER) AS topic FROM pr")
def categorical_draw(spark, d):
    """One draw per token from the collapsed Gibbs weights of the starting counts."""
    a = Scratch(spark, "draw").save(_assigned(spark, d), "assigned")
    words = counts.array_form(counts.topic_word_counts(a), K, "n").withColumnRenamed("values", "w")
    docs = infer.counted_doc_topics(counts.doc_topic_counts(a), K).withColumnRenamed("theta", "n_d")
    found = {r["topic"]: float(r["n"]) for r in counts.topic_totals(counts.topic_word_counts(a)).collect()}     # one row per topic
    base = literal_vector([found.get(k, 0.0) + vocabulary_size(spark, d) * _CB for k in range(K)])
    rows = a.drop("topic").join(words, "word_id").join(docs, "doc_id")
    weights = F.array(*[(F.col("w")[k] + _CB) * (F.col("n_d")[k] + _CA) / base[k] for k in range(K)])
    u = uniform(portable=True)(SEED + 2, "doc_id", "word_id", "occ")
    return rows.select("doc_id", "word_id", "occ", draw_category(weights, u, K).alias("topic"))


@query("adlda_invariants", _WORD_TOTALS)
def adlda_invariants(spark, d):
    """Counts after two sweeps summed over topics: every word must keep its number of tokens."""
    fit = _gibbs(spark, d, n_sweeps=2, metrics_every=99)
    return fit.topic_word.groupBy("word_id").agg(F.sum("n").alias("n"))


@query("adlda_doc_invariants", f"WITH {TOKENS} SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id")
def adlda_doc_invariants(spark, d):
    fit = _gibbs(spark, d, n_sweeps=2, metrics_every=99, n_blocks=3)
    return fit.doc_topic.groupBy("doc_id").agg(F.sum("n").alias("n"))


def _frozen_sweep_sql(t: int, source: str, out: str) -> str:
    """One sweep over the tokens `source(doc_id, word_id, occ, topic)`: word counts as they are before it, the counts of a
    document folded over its tokens in order.  An element holds a token's word weights, old topic and draw; the accumulator the
    document's counts and the list of new topics."""
    n, names = range(K), "abcdefgh"[:K]
    own = [f"CASE WHEN topic = {k} THEN 1 ELSE 0 END" for k in n]
    weight = [f"(w{k} - {own[k]} + b) / (z{k} - {own[k]} + v * b)" for k in n]
    left = [f"(acc.{x} - CASE WHEN tok.o = {k} THEN 1 ELSE 0 END)" for k, x in enumerate(names)]
    raw = [f"({left[k]} + {_A}e0) * tok.{x}" for k, x in enumerate(names)]
    cum = [" + ".join(raw[:k + 1]) for k in n]
    new = "(" + " + ".join(f"CASE WHEN {c} < tok.u * ({cum[-1]}) THEN 1 ELSE 0 END" for c in cum[:-1]) + ")"
    step = ", ".join(f"{x} := {left[k]} + CASE WHEN {new} = {k} THEN 1e0 ELSE 0e0 END" for k, x in enumerate(names))
    rest = "o := CAST(0 AS INTEGER), u := 0e0"
    return (f", kw{t} AS (SELECT word_id, {', '.join(f'count(*) FILTER (WHERE topic = {k}) AS w{k}' for k in n)} FROM {source} GROUP BY word_id), "
            f"kz{t} AS MATERIALIZED (SELECT {', '.join(f'sum(w{k}) AS z{k}' for k in n)} FROM kw{t}), "
            f"kd{t} AS (SELECT doc_id, {', '.join(f'CAST(count(*) FILTER (WHERE topic = {k}) AS DOUBLE) AS d{k}' for k in n)} FROM {source} GROUP BY doc_id), "
            f"kt{t} AS MATERIALIZED (SELECT doc_id, word_id, occ, topic, row_number() OVER (PARTITION BY doc_id ORDER BY word_id, occ) - 1 AS j "
            f"FROM {source}), ke{t} AS (SELECT doc_id, list(struct_pack({', '.join(f'{x} := {weight[k]}' for k, x in enumerate(names))}, "
            f"o := topic, u := {u_sql(SEED, str(t), 'doc_id', 'j')}, p := CAST([] AS INTEGER[])) ORDER BY j) AS toks "
            f"FROM kt{t} JOIN kw{t} USING (word_id), kz{t}, {_HYPER} GROUP BY doc_id), "
            f"kf{t} AS MATERIALIZED (SELECT doc_id, list_reduce(toks, lambda acc, tok: struct_pack({step}, {rest}, p := list_append(acc.p, {new})), "
            f"struct_pack({', '.join(f'{x} := d{k}' for k, x in enumerate(names))}, {rest}, p := CAST([] AS INTEGER[]))) AS f "
            f"FROM ke{t} JOIN kd{t} USING (doc_id)), "
            f"{out} AS MATERIALIZED (SELECT doc_id, word_id, occ, f.p[j + 1] AS topic FROM kf{t} JOIN kt{t} USING (doc_id))")


_HYPER = f"(SELECT {_B}e0 AS b, CAST((SELECT count(*) FROM vocab) AS DOUBLE) AS v)"
_FROZEN = (ASSIGNED.replace(", assigned AS (", ", assigned AS MATERIALIZED (") + _frozen_sweep_sql(1, "assigned", "after1")
           + _frozen_sweep_sql(2, "after1", "after2"))


@query("gibbs_fit", f"WITH {_FROZEN} SELECT topic, word_id, count(*) AS n FROM after2 GROUP BY topic, word_id")
def gibbs_fit(spark, d):
    """Topic-word counts after two sweeps with the word counts frozen in each, by portable draws."""
    fit = _gibbs(spark, d, n_sweeps=2, init="hash", schedule="frozen", metrics_every=99)
    return fit.topic_word.select("topic", "word_id", "n")


@query("adlda_docs", f"WITH {_FROZEN} SELECT doc_id, topic, count(*) AS n FROM after2 GROUP BY doc_id, topic")
def adlda_docs(spark, d):
    """Document-topic counts of the same sweeps in five blocks, merged after each."""
    fit = _gibbs(spark, d, n_sweeps=2, init="hash", schedule="frozen", metrics_every=99, n_blocks=5)
    return fit.doc_topic.select("doc_id", "topic", "n")


@query("gibbs_top_words", f"WITH {_FROZEN}, tw AS (SELECT topic, word_id, count(*) AS n FROM after2 GROUP BY topic, word_id), ranked AS ("
       "SELECT topic, word_id, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word_id) AS rank FROM tw) "
       "SELECT topic, CAST(rank AS INTEGER) AS rank, word_id, term, n FROM ranked JOIN vocab USING (word_id) WHERE rank <= 100")
def gibbs_top_words(spark, d):
    fit = _gibbs(spark, d, n_sweeps=2, init="hash", schedule="frozen", metrics_every=99)
    top = ranking.top_terms(fit.topic_word.withColumnRenamed("n", "value"), corpus(spark, d).vocab, 100, K)
    return top.withColumnRenamed("value", "n")


@query("cvb0_block_fit", f"WITH {BOW} SELECT word_id, count(*) AS n FROM bow GROUP BY word_id")
def cvb0_block_fit(spark, d):
    """In-place sweeps per block; the expected counts of a word must add up to the documents that hold it."""
    fit = cvb0.fit(corpus(spark, d).bow, vocabulary_size(spark, d),
                   cvb0.CVB0(K, n_sweeps=1, seed=SEED, schedule="block"))
    return fit.word_topic.select("word_id", F.round(vec_sum(F.col("params"))).cast("long").alias("n"))


# -- snapshots ---------------------------------------------------------------------------------------------------------

@query("keyed_output", f"WITH {DT} SELECT topic, CAST(sum(n) AS BIGINT) AS n FROM dt GROUP BY topic")
def keyed_output(spark, d):
    """Document and word counts written to one output split by kind; one kind is read back."""
    scratch, a = Scratch(spark, "keyed"), _assigned(spark, d)
    docs = counts.doc_topic_counts(a).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "topic", "n")
    words = counts.topic_word_counts(a).select(F.lit("word").alias("kind"), F.col("word_id").cast("long").alias("id"),
                                               "topic", "n")
    snapshots.write_by_kind(docs.unionByName(words), scratch.path("out"))
    return snapshots.read_kind(spark, scratch.path("out"), "doc").groupBy("topic").agg(F.sum("n").alias("n"))


@query("topic_text_snapshot", f"WITH {VOCAB}{_WORD_PARAMS} {_long_sql('l', 9, 'word_id', 'lam')}")
def topic_text_snapshot(spark, d):
    """A model written as text, in runs of words per topic, and read from all part files."""
    scratch = Scratch(spark, "topic-text")
    snapshots.write_topic_runs(start_model(corpus(spark, d).vocab, K, SEED, "hash"), scratch.path("model"))
    return snapshots.read_topic_runs(spark, scratch.path("model")).withColumn("value", rounded("value", 9))


@query("alpha_snapshot", ORACLES["alpha_step"])
def alpha_snapshot(spark, d):
    """Alpha after a step, stored as one row of parameters and as json, and read back."""
    scratch, steps = Scratch(spark, "alpha"), alpha_step(spark, d).orderBy("topic").collect()   # one row per topic
    snapshots.write_params(spark, scratch.path("params"), [r["alpha"] for r in steps], beta=_B)
    stored = snapshots.read_alpha(spark, scratch.path("params"), K)
    snapshots.write_alpha_json(spark, scratch.path("json"), stored)
    back = snapshots.read_alpha_json(spark, scratch.path("json"))
    return spark.createDataFrame(list(enumerate(back)), "topic int, alpha double")


@query("vector_snapshot", f"WITH {TW} SELECT topic, CAST(sum(n) AS DOUBLE) AS value FROM tw GROUP BY topic")
def vector_snapshot(spark, d):
    scratch = Scratch(spark, "vector")
    totals = counts.topic_totals(counts.topic_word_counts(_assigned(spark, d)))
    snapshots.write_vector_text(totals.select("topic", F.col("n").cast("double").alias("value")), scratch.path("n_z"))
    return snapshots.read_vector_text(spark, scratch.path("n_z"))


@query("training_metrics", f"WITH {_TWO_PASSES}, b AS ({_vb_bound_sql(0)} UNION ALL {_vb_bound_sql(1)}) "
                           f"SELECT t, 'perplexity' AS kind, {r_sql('x', 6)} AS log_value FROM b")
def training_metrics(spark, d):
    """Metric rows of a run that stopped after its first step and was continued, appended to a table and read back."""
    scratch, b, words = Scratch(spark, "metrics"), batches(spark, d, 2), corpus(spark, d).vocab
    online_vb.fit(replace(b, n_batches=1), words, _vb(2), snapshots=scratch.path("run"))
    fit = online_vb.fit(b, words, _vb(2), snapshots=scratch.path("run"))
    snapshots.append_metrics(fit.metrics, scratch.path("metrics"))
    return spark.read.parquet(scratch.path("metrics")).select("t", "kind", rounded(F.log("value"), 6).alias("log_value"))


@query("matrix_csv", f"WITH {TW}, l AS (SELECT word_id, " + " || ',' || ".join(
    f"CAST(CAST(coalesce(sum(CASE WHEN topic = {k} THEN n END), 0) AS BIGINT) AS VARCHAR) || '.0'" for k in range(K))
       + " AS line FROM tw GROUP BY word_id) SELECT line, count(*) AS n FROM l GROUP BY line")
def matrix_csv(spark, d):
    """A double matrix written as csv, one line per word, and its lines read back and counted."""
    scratch = Scratch(spark, "matrix-csv")
    tw = counts.topic_word_counts(_assigned(spark, d))
    m = tw.select(F.col("word_id").cast("long").alias("row"), F.col("topic").alias("col"), F.col("n").cast("double").alias("value"))
    exports.write_matrix_csv(m, K, scratch.path("csv"))
    return spark.read.text(scratch.path("csv")).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("hyper_parameter_file", f"WITH s AS ({ORACLES['alpha_step']}), b AS ({ORACLES['beta_step']}) "
       "SELECT CAST(topic AS INTEGER) AS place, alpha AS value FROM s UNION ALL SELECT -1, beta FROM b")
def hyper_parameter_file(spark, d):
    """Alpha and beta after a step, written as two lines and read back."""
    scratch = Scratch(spark, "hyper")
    steps = alpha_step(spark, d).orderBy("topic").collect()                                    # one row per topic
    exports.write_hyper_parameters(spark, [r["alpha"] for r in steps], beta_step(spark, d).first()["beta"], scratch.path("file"))
    many = F.size(F.split("value", ",")) > 1
    cells = spark.read.text(scratch.path("file")).select(many.alias("many"), F.posexplode(F.split("value", ",")).alias("pos", "x"))
    return cells.select(F.when(F.col("many"), F.col("pos")).otherwise(-1).cast("int").alias("place"),
                        F.col("x").cast("double").alias("value"))


@query("keyed_output_by_name", f"WITH {TW} SELECT topic, CAST(sum(n) AS BIGINT) AS n FROM tw GROUP BY topic")
def keyed_output_by_name(spark, d):
    """Counts of two kinds written as json below one folder, of which one kind is read back by its file name."""
    scratch, a = Scratch(spark, "named"), _assigned(spark, d)
    counts.topic_word_counts(a).select("topic", "n").write.json(scratch.path("out/words"))
    counts.doc_topic_counts(a).select(F.to_csv(F.struct("topic", "n")).alias("value")).write.text(scratch.path("out/docs"))
    lines = snapshots.read_named_files(spark, scratch.path("out"), ".json")
    row = F.from_json("value", "topic int, n long")
    return lines.select(row.alias("r")).groupBy("r.topic").agg(F.sum("r.n").alias("n"))
