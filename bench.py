"""Times the headline jobs on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line.

The corpus is built once and timed as its own entry; the trainers start from it.  `BENCH_COMPARE=1` also times the
online LDA that ships with Spark on the same corpus (outside the total).
"""

from __future__ import annotations

import json
import os
import sys
import time

import pyspark
from pyspark.sql import functions as F

from topicspark.operators import counts, likelihood, ranking
from topicspark.operators.corpus import minibatches, with_position
from topicspark.plans import cvb0, gibbs, infer, online_vb, scvb0
from topicspark.plans.minibatch import prepare_batches
from topicspark.session import Scratch, get_spark
from topicspark.sources.raw import corpus_from_text

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
K, N_BATCHES, SEED = 20, 4, 3


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = get_spark("bench", f"local[{CPUS}]", CPUS, {
        "spark.driver.memory": "20g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        # tables of a few megabytes still deserve one task per core
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.files.openCostInBytes": "65536", "spark.sql.files.maxPartitionBytes": "16m"})
    spark.sparkContext.setLogLevel("ERROR")
    noop(spark.range(0, 1000, 1, CPUS).mapInPandas(lambda it: it, "id long"))     # start the Python workers
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    times, extra = {}, {}

    def timed(name, fn):
        start = time.time()
        out = fn()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
        return out

    c = timed("corpus_build", lambda: corpus_from_text(docs))
    n_words = c.vocabulary_size()
    n_docs = docs.count()
    n_tokens = c.bow.agg(F.sum("freq")).first()[0]

    def top():
        assigned = counts.assign_uniform(c.bow, K, SEED, portable=False)
        tw = counts.topic_word_counts(assigned).withColumnRenamed("n", "value")
        noop(ranking.topic_rows(ranking.top_terms(tw, c.vocab, 30)))

    def scores():
        assigned = c.scratch.save(counts.assign_uniform(c.bow, K, SEED, portable=False), "assigned")
        tw, dt = counts.topic_word_counts(assigned), counts.doc_topic_counts(assigned)
        noop(likelihood.total_loglik(tw, dt, n_words, [0.1] * K, 0.01))
        noop(likelihood.alpha_step(dt, [0.1] * K))
        noop(likelihood.beta_step(tw, n_words, 0.01))

    timed("top_words", top)
    timed("likelihood_and_parameter_steps", scores)
    timed("minibatch_assignment", lambda: noop(minibatches(with_position(docs.select("doc_id"), Scratch(spark)), 64)))
    b = timed("prepare_batches",
              lambda: prepare_batches(c.bow, n_words, -(-n_docs // N_BATCHES), Scratch(spark, "bench"), docs))
    vb = online_vb.OnlineVB(K, tau0=16.0, seed=SEED)
    vb_fit = timed("online_vb_pass", lambda: online_vb.fit(b, c.vocab, vb))
    extra["online_vb_perplexity"] = [v for _, _, v in vb_fit.history]
    timed("doc_topics", lambda: noop(infer.doc_topics(c.bow, vb_fit.model, vb, n_words)))
    timed("scvb0_pass", lambda: scvb0.fit(b, c.vocab, scvb0.SCVB0(K, max_iter=5, seed=SEED)))
    fit = timed("adlda_3_sweeps", lambda: gibbs.fit(c.bow, n_words, gibbs.Gibbs(K, n_sweeps=3, seed=SEED, metrics_every=3)))
    extra["adlda_loglik"] = fit.history[-1][2]
    fit = timed("cvb0_block_2_sweeps",
                lambda: cvb0.fit(c.bow, n_words, cvb0.CVB0(K, n_sweeps=2, seed=SEED, schedule="block")))
    extra["cvb0_block_loglik"] = fit.history[-1][2]
    fit = timed("cvb0_sync_2_sweeps", lambda: cvb0.fit(c.bow, n_words, cvb0.CVB0(K, n_sweeps=2, seed=SEED)))
    extra["cvb0_sync_loglik"] = fit.history[-1][2]
    rates = {n: round(n_tokens / times[k]) for n, k in (("online_vb", "online_vb_pass"), ("scvb0", "scvb0_pass"))}
    rates["adlda_per_sweep"] = round(3 * n_tokens / times["adlda_3_sweeps"])
    if os.environ.get("BENCH_COMPARE"):
        from pyspark.ml.clustering import LDA
        from pyspark.ml.linalg import SparseVector, VectorUDT
        make = F.udf(lambda i, v: SparseVector(n_words, i, [float(x) for x in v]), VectorUDT())
        rows = c.bow.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("word_id", "freq"))).alias("t"))
        data = c.scratch.save(rows.select("doc_id", make("t.word_id", "t.freq").alias("features")).repartition(CPUS),
                              "features")
        start = time.time()
        LDA(k=K, maxIter=N_BATCHES, optimizer="online", subsamplingRate=1.0 / N_BATCHES, seed=SEED).fit(data)
        extra["spark_ml_online_lda_sec"] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "topic_model_jobs_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": SF_DIR.rstrip("/").split("sf")[-1], "topics": K, "vocabulary": n_words, "documents": n_docs,
        "tokens": n_tokens, "minibatches": N_BATCHES, "cpus": CPUS, "spark": pyspark.__version__,
        "tokens_per_sec": rates, **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
