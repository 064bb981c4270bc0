import math
from dataclasses import replace

import numpy as np
import pytest

from tests import loops
from pyspark.sql import functions as F

from topicspark.operators.kernels import keyed_stream, keyed_uniform
from topicspark.operators import blocks, counts, likelihood, ranking
from topicspark.plans import cvb0, gibbs, infer, online_vb, scvb0
from topicspark.plans.minibatch import parameter_totals, prepare_batches, start_model, summary
from topicspark.queries import model_queries  # noqa: F401
from topicspark.queries.base import QUERIES
from topicspark.session import Scratch

BOW = "doc_id long, word_id int, freq int"


def frame(spark, docs):
    return spark.createDataFrame(loops.bow_rows(docs), BOW)


def words(spark, n):
    return spark.range(n).selectExpr("cast(id as int) as word_id", "concat('w', id) as term")


def dense(model, n_words):
    rows = {r["word_id"]: r["params"] for r in model.collect()}
    return np.array([rows[w] for w in range(n_words)])


@pytest.mark.parametrize("batch", [4, 2, 3, 10])
def test_online_vb_equals_loop(spark, scratch, batch):
    docs = loops.tiny_corpus()
    cfg = online_vb.OnlineVB(2, alpha=0.3, eta=0.2, tau0=2.0, max_iter=30, tol=1e-4, seed=5, init="hash")
    batches = prepare_batches(frame(spark, docs), 6, batch, scratch)
    assert batches.n_batches == math.ceil(4 / batch)
    fit = online_vb.fit(batches, words(spark, 6), cfg)
    lam, history = loops.online_vb(docs, 6, 2, batch, 0.3, 0.2, 2.0, 0.7, 30, 1e-4, 5)
    np.testing.assert_allclose(dense(fit.model, 6), lam, rtol=1e-9)
    np.testing.assert_allclose([v for _, _, v in fit.history], history, rtol=1e-9)


@pytest.mark.parametrize("init", ["hash", "gamma"])
def test_joined_e_step_equals_kernel(spark, scratch, init):
    docs = loops.planted(30)
    bow = frame(spark, docs)
    model = scratch.save(start_model(words(spark, 100), 5, 3, "hash"), "m")
    totals = parameter_totals(model, 5)
    alpha = [0.1, 0.2, 0.05, 0.3, 0.15]
    cfg = online_vb.OnlineVB(5, alpha=alpha, max_iter=6, tol=1e-3, seed=3, init=init, tokens_per_block=300)
    cut = online_vb.OnlineVB(5, alpha=alpha, max_iter=6, tol=1e-3, seed=3, init=init, max_doc_terms=15)
    ss, ss2 = (online_vb.word_statistics(bow, model, totals, c, scratch, f"words-{c.max_doc_terms}") for c in (cfg, cut))
    out, out2 = (online_vb.document_posteriors(bow, model, totals, c, scratch, f"docs-{c.max_doc_terms}")
                 for c in (cfg, cut))
    one, two = summary(ss), summary(ss2)
    assert one["n_tokens"] == two["n_tokens"] == 30 * 40
    np.testing.assert_allclose(one["score"], two["score"], rtol=1e-9)
    a = {r["word_id"]: r["ss"] for r in ss.collect()}
    b = {r["word_id"]: r["ss"] for r in ss2.collect()}
    assert a.keys() == b.keys()
    for w in a:
        np.testing.assert_allclose(a[w], b[w], rtol=1e-8, atol=1e-10)
    x = {r["doc_id"]: (r["score"], r["n_tokens"], r["vec"]) for r in out.collect()}
    y = {r["doc_id"]: (r["score"], r["n_tokens"], r["vec"]) for r in out2.collect()}
    assert x.keys() == y.keys() and len(x) == 30
    for d in x:
        assert x[d][1] == y[d][1]
        np.testing.assert_allclose(x[d][0], y[d][0], rtol=1e-8)
        np.testing.assert_allclose(x[d][2], y[d][2], rtol=1e-8)


def test_empty_document_counts_in_the_batch_but_adds_nothing(spark, scratch):
    docs = loops.tiny_corpus()
    listed = spark.createDataFrame([(d,) for d in range(5)], "doc_id long")
    batches = prepare_batches(frame(spark, docs), 6, 5, scratch, listed)
    assert (batches.n_docs, batches.n_batches) == (5, 1)
    cfg = online_vb.OnlineVB(2, tau0=1.0, init="hash", max_iter=5)
    fit = online_vb.fit(batches, words(spark, 6), cfg)
    assert np.isfinite(dense(fit.model, 6)).all()


def test_online_vb_continues_from_a_snapshot(spark, scratch, tmp_path):
    batches = prepare_batches(frame(spark, loops.planted(40)), 100, 10, scratch)
    cfg = online_vb.OnlineVB(3, tau0=2.0, max_iter=10, init="hash", bound=False)
    whole = dense(online_vb.fit(batches, words(spark, 100), cfg, snapshots=str(tmp_path / "a")).model, 100)
    base = str(tmp_path / "b")
    online_vb.fit(batches, words(spark, 100), cfg, snapshots=base)
    Scratch(spark, base=base).drop("model/t=000004")
    Scratch(spark, base=base).drop("model/t=000003")
    again = online_vb.fit(batches, words(spark, 100), cfg, snapshots=base)
    np.testing.assert_allclose(dense(again.model, 100), whole, rtol=1e-10)
    memory = online_vb.fit(batches, words(spark, 100), cfg)
    np.testing.assert_allclose(dense(memory.model, 100), whole, rtol=1e-10)


def test_online_vb_finds_planted_topics(spark, scratch):
    docs = loops.planted()
    batches = prepare_batches(frame(spark, docs), 100, 50, scratch)
    cfg = online_vb.OnlineVB(5, alpha=0.1, eta=0.1, tau0=1.0, kappa=0.5, max_iter=50, seed=2)
    first = online_vb.fit(batches, words(spark, 100), cfg)
    values = [v for _, _, v in first.history]
    assert values[-1] < values[0]


def test_scvb0_equals_loop(spark, scratch):
    docs = loops.tiny_corpus()
    bow = frame(spark, docs)
    model = scratch.save(start_model(words(spark, 6), 2, 9, "hash"), "m")
    lam = dense(model, 6)
    cfg = scvb0.SCVB0(2, alpha=0.2, beta=0.1, max_iter=3, seed=9, init="hash")
    got = {r["doc_id"]: r["theta"] for r in infer.doc_topics(bow, model, cfg, 6).collect()}
    batches = prepare_batches(bow, 6, 4, scratch)
    nxt, rows = scvb0.update(bow, batches.docs, model, 0, 28, 6, cfg, scratch)
    nxt = dense(nxt, 6)
    ss, loglik = np.zeros_like(lam), 0.0
    for d, w in docs.items():
        theta, stats = loops.scvb0_document(w, lam, lam.sum(axis=0), 0.2, 0.1, 6, 9, d, 3, cfg.theta_rate)
        np.testing.assert_allclose(got[d], theta, rtol=1e-10)
        for v, x in stats.items():
            ss[v] += x
        share = (theta + 0.2) / (theta + 0.2).sum()
        loglik += sum(n * np.log(share @ ((lam[v] + 0.1) / (lam.sum(axis=0) + 0.6))) for v, n in w.items())
    total = sum(sum(w.values()) for w in docs.values())
    assert [(t, kind) for t, kind, _ in rows] == [(0, "loglik"), (0, "perplexity"), (0, "rho")]
    np.testing.assert_allclose([x for _, _, x in rows], [loglik, np.exp(-loglik / total), 10.0 ** -0.9], rtol=1e-10)
    assert abs(ss.sum() - total) < 1e-9
    rho = 10.0 ** -0.9
    np.testing.assert_allclose(nxt, (1 - rho) * lam + rho * 28 / total * ss, rtol=1e-10)


def test_scvb0_does_not_depend_on_blocks_and_holds_every_token(spark, scratch):
    docs = {0: {0: 50, 1: 7, 2: 1}, 1: {1: 3}, 2: {2: 30, 3: 30, 4: 30}}
    bow = frame(spark, docs)
    model = scratch.save(start_model(words(spark, 5), 3, 1, "hash"), "m")
    cfg = scvb0.SCVB0(3, max_iter=2, init="hash", tokens_per_block=20)
    args = (bow, model, parameter_totals(model, 3), 5, cfg, 151)
    whole = (bow, model, parameter_totals(model, 3), 5, scvb0.SCVB0(3, max_iter=2, init="hash"), 151)
    one, many = ({r["doc_id"]: r["vec"] for r in scvb0.document_pass(*a, per_document=True).collect()} for a in (whole, args))
    for d in one:
        np.testing.assert_allclose(one[d], many[d], rtol=1e-12)
    rows = scvb0.document_pass(*args).collect()
    assert abs(sum(sum(r["ss"]) for r in rows) - 151) < 1e-9
    assert sum(r["n_tokens"] for r in rows) == 151
    docs_out = {r["doc_id"]: r["n_tokens"] for r in scvb0.document_pass(*args, per_document=True).collect()}
    assert docs_out == {0: 58, 1: 3, 2: 90}
    theta = infer.doc_topics(bow, model, cfg, 5).collect()
    assert sorted(r["doc_id"] for r in theta) == [0, 1, 2]


def test_scvb0_finds_planted_words(spark, scratch):
    docs = loops.planted()
    batches = prepare_batches(frame(spark, docs), 100, 50, scratch)
    fit = scvb0.fit(batches, words(spark, 100), scvb0.SCVB0(5, max_iter=5, seed=4))
    tokens = sum(sum(w.values()) for w in docs.values())
    assert fit.n_steps == 4
    quality = [v for _, kind, v in fit.history if kind == "perplexity"]
    assert len(quality) == 4 and quality[-1] < quality[0]
    total = sum(parameter_totals(fit.model, 5))
    keep = np.prod([1 - (10.0 + t) ** -0.9 for t in range(4)])
    np.testing.assert_allclose(total, keep * sum(dense(start_model(words(spark, 100), 5, 4, "gamma"), 100).ravel())
                               + (1 - keep) * tokens, rtol=1e-9)


def phi_start(docs, k, seed):
    out = {}
    for d, ws in docs.items():
        for w in ws:
            raw = np.array([loops.uniform(seed, d, w, t) for t in range(k)])
            out[d, w] = raw / raw.sum()
    return out


def collected(phi):
    return {(r["doc_id"], r["word_id"]): np.array(r["phi"]) for r in phi.collect()}


@pytest.mark.parametrize("schedule", ["sync", "block"])
def test_cvb0_equals_loop(spark, schedule):
    docs = loops.tiny_corpus()
    cfg = cvb0.CVB0(3, alpha=0.1, beta=0.2, n_sweeps=2, seed=11, init="hash", schedule=schedule, order="serial", n_blocks=1)
    fit = cvb0.fit(frame(spark, docs), 6, cfg)
    phi = phi_start(docs, 3, 11)
    for _ in range(2):
        phi = (loops.cvb0_sweep_sync(phi, docs, 6, 3, 0.1, 0.2) if schedule == "sync" else
               loops.cvb0_sweep_in_place(phi, docs, 6, 3, 0.1, 0.2, lambda d, w: 1.0))
    got = collected(fit.phi)
    assert got.keys() == phi.keys()
    for key in phi:
        np.testing.assert_allclose(got[key], phi[key], rtol=1e-9)
    n_kw, n_dk = np.zeros((3, 6)), np.zeros((4, 3))
    for (d, w), p in phi.items():
        n_kw[:, w] += p
        n_dk[d] += p
    assert abs(fit.history[-1][2] - loops.loglik(n_kw, n_dk, [0.1] * 3, 0.2)) < 1e-7


def test_cvb0_block_with_frequencies_and_many_blocks(spark):
    docs = loops.tiny_corpus()
    cfg = cvb0.CVB0(2, n_sweeps=1, seed=3, init="hash", schedule="block", order="serial", n_blocks=1, weight="freq")
    got = collected(cvb0.fit(frame(spark, docs), 6, cfg).phi)
    want = loops.cvb0_sweep_in_place(phi_start(docs, 2, 3), docs, 6, 2, 0.01, 0.01, lambda d, w: docs[d][w])
    for key in want:
        np.testing.assert_allclose(got[key], want[key], rtol=1e-9)
    cfg = cvb0.CVB0(2, n_sweeps=1, seed=3, schedule="block", n_blocks=2)
    long_fit = cvb0.fit(frame(spark, docs), 6, cfg)
    total = sum(sum(r["params"]) for r in long_fit.word_topic.collect())
    assert abs(total - sum(len(w) for w in docs.values())) < 1e-9


@pytest.mark.parametrize("every,n_sweeps", [(2, 5), (2, 4), (3, 2), (1, 3)])
def test_cvb0_goes_through_sweeps_again(spark, monkeypatch, every, n_sweeps):
    from topicspark.operators import kernels
    monkeypatch.setattr(cvb0, "STORE_EVERY", every)
    monkeypatch.setattr(kernels, "_CELLS_AT_ONCE", 20)
    docs, found = loops.tiny_corpus(), {}
    for init in ("hash", "random"):
        cfg = cvb0.CVB0(3, alpha=0.1, beta=0.2, n_sweeps=n_sweeps, seed=11, init=init, n_blocks=2)
        fit = cvb0.fit(frame(spark, docs), 6, cfg)
        phi = phi_start(docs, 3, 11) if init == "hash" else collected(
            cvb0.fit(frame(spark, docs), 6, cvb0.CVB0(3, n_sweeps=0, seed=11, n_blocks=2)).phi)
        for _ in range(n_sweeps):
            phi = loops.cvb0_sweep_sync(phi, docs, 6, 3, 0.1, 0.2)
        got = collected(fit.phi)
        assert got.keys() == phi.keys()
        for key in phi:
            np.testing.assert_allclose(got[key], phi[key], rtol=1e-9)
        n_kw, n_dk = np.zeros((3, 6)), np.zeros((4, 3))
        for (d, w), p in phi.items():
            n_kw[:, w] += p
            n_dk[d] += p
        assert abs(fit.history[-1][2] - loops.loglik(n_kw, n_dk, [0.1] * 3, 0.2)) < 1e-7
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("topicspark_")]


def test_cvb0_sums_need_no_stored_responsibilities(spark, scratch):
    from topicspark.operators import blocks
    cfg = cvb0.CVB0(3, init="hash")
    tables = blocks.BlockTables(scratch, 4)
    state = cvb0.start_state(frame(spark, loops.planted(30)), cfg, tables)
    in_blocks, by_word = scratch.save(cvb0.words_of_blocks(state), "w"), scratch.save(cvb0.word_sums(state, 3), "b")
    after = tables.save(cvb0.sweep(state, in_blocks, by_word, parameter_totals(by_word, 3), 100, cfg, tables), "phi/1")
    for table in (state, after):
        assert table.agg(F.sum(F.length("phi")).alias("n")).first()["n"] == 0
    assert after.agg(F.sum(F.size("words")).alias("n")).first()["n"] == 0 and cvb0.doc_sums(after).count() == cvb0.doc_sums(state).count()
    tables.drop_all()


def test_cvb0_blocks_follow_from_the_corpus():
    cfg = cvb0.CVB0(4)
    assert [cvb0.n_blocks(n, cfg) for n in (1, 250_001, 20_000_000, 300_000_000)] == [1, 2, 32, 100]
    assert cvb0.n_blocks(20_000_000, cvb0.CVB0(4, schedule="block")) == 80 and cvb0.n_blocks(9, cvb0.CVB0(4, n_blocks=3)) == 3


def test_cvb0_sweep_moves_no_responsibilities(spark, scratch):
    from topicspark.operators import blocks
    cfg = cvb0.CVB0(3, init="hash")
    tables = blocks.BlockTables(scratch, 4)
    state = cvb0.start_state(frame(spark, loops.planted(30)), cfg, tables)
    assert len(state.select("block").distinct().collect()) == 4
    in_blocks = scratch.save(cvb0.words_of_blocks(state), "w")
    by_word = scratch.save(cvb0.word_sums(state, 3), "b")
    after = cvb0.sweep(state, in_blocks, by_word, parameter_totals(by_word, 3), 100, cfg, tables)
    plan = after._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("Bucketed: true" in line for line in plan)
    assert not any("Exchange" in line and ("doc_id" in line or "phi" in line) for line in plan)
    sums = cvb0.word_sums(tables.save(after, "phi/1"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "phi:" not in sums                      # the scan reads the sums of the blocks alone


def test_cvb0_queries_leave_no_tables_in_the_catalog(spark, tmp_path):
    spark.createDataFrame([(i, "some words of " + "abc"[i % 3]) for i in range(9)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    before = {t.name for t in spark.catalog.listTables()}
    for name in ("cvb0_init", "cvb0_init_docs", "cvb0_sweep", "cvb0_sweep_docs"):
        assert QUERIES[name](spark, str(tmp_path)).count() > 0
    assert not {t.name for t in spark.catalog.listTables() if t.name.startswith("topicspark_")} - before


def test_cvb0_likelihood_rises(spark):
    fit = cvb0.fit(frame(spark, loops.planted(60)), 100, cvb0.CVB0(5, n_sweeps=6, schedule="block", n_blocks=4))
    values = [v for _, _, v in fit.history]
    assert values[-1] > values[0]


def tokens_of(docs):
    return {d: [w for w in sorted(ws) for _ in range(ws[w])] for d, ws in docs.items()}


def test_gibbs_one_block_equals_serial_chain(spark):
    docs = loops.planted(12, length=15)
    cfg = gibbs.Gibbs(4, n_sweeps=2, seed=6, init="hash", n_blocks=1, schedule="serial")
    fit = gibbs.fit(frame(spark, docs), 100, cfg)
    tokens = tokens_of(docs)
    z = {d: [min(3, int(4 * loops.uniform(6, d, w, o))) for w in sorted(ws) for o in range(ws[w])]
         for d, ws in docs.items()}
    for t in (1, 2):
        draw = lambda d, i, s=keyed_stream(6, t, 0): keyed_uniform(s, np.array([d]), i)[0]
        z = loops.gibbs_serial(tokens, z, 100, 4, 0.1, 0.01, draw, 1)
    got = {r["doc_id"]: (r["words"], r["topics"]) for r in fit.state.collect()}
    for d in docs:
        assert got[d][0] == tokens[d]
        assert got[d][1] == z[d]


def test_frozen_gibbs_does_not_depend_on_blocks(spark):
    docs = loops.planted(25)
    got = []
    for n_blocks, init in ((1, "random"), (4, "random"), (1, "hash"), (4, "hash")):
        cfg = gibbs.Gibbs(4, n_sweeps=2, seed=3, n_blocks=n_blocks, schedule="frozen", init=init)
        got.append(sorted((r["doc_id"], r["words"], r["topics"]) for r in gibbs.fit(frame(spark, docs), 100, cfg).state.collect()))
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[2]


def test_frozen_gibbs_cuts_large_blocks_to_pieces(spark):
    bow = frame(spark, loops.planted(12))
    states = []
    for size in (None, 50):
        fit = gibbs.fit(bow, 100, gibbs.Gibbs(4, n_sweeps=1, seed=3, n_blocks=2, schedule="frozen", init="hash", tokens_per_block=size))
        states.append((fit.state.select("block").distinct().count(),
                       sorted((r["doc_id"], tuple(r["words"]), tuple(r["topics"])) for r in fit.state.collect())))
    assert states[0][0] <= 2 < states[1][0] and states[0][1] == states[1][1]


def test_parameter_steps_reach_a_fixed_point(spark, scratch):
    assigned = counts.assign_uniform(frame(spark, loops.planted(15)), 3, 4)
    tw, dt = counts.topic_word_counts(assigned), counts.doc_topic_counts(assigned)
    alpha, beta = [0.1, 0.2, 0.3], 0.05
    for _ in range(3):
        alpha = [r["alpha"] for r in sorted(likelihood.alpha_step(dt, alpha).collect(), key=lambda r: r["topic"])]
        beta = likelihood.beta_step(tw, 100, beta).first()["beta"]
    np.testing.assert_allclose(likelihood.alpha_steps(dt, [0.1, 0.2, 0.3], 3, scratch), alpha, rtol=1e-9)
    np.testing.assert_allclose(likelihood.beta_steps(tw, 100, 0.05, 3, scratch), beta, rtol=1e-9)


@pytest.mark.parametrize("schedule", ["serial", "lockstep"])
def test_gibbs_blocks_keep_totals(spark, schedule):
    docs = loops.planted(40)
    cfg = gibbs.Gibbs(5, n_sweeps=3, seed=2, n_blocks=3, schedule=schedule)
    fit = gibbs.fit(frame(spark, docs), 100, cfg)
    n_tokens = sum(sum(w.values()) for w in docs.values())
    assert fit.topic_word.agg({"n": "sum"}).first()[0] == n_tokens
    by_doc = {}
    for r in fit.doc_topic.collect():
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["n"]
    assert by_doc == {d: sum(w.values()) for d, w in docs.items()}
    by_word = {}
    for r in fit.topic_word.collect():
        by_word[r["word_id"]] = by_word.get(r["word_id"], 0) + r["n"]
    want = {}
    for ws in docs.values():
        for w, n in ws.items():
            want[w] = want.get(w, 0) + n
    assert by_word == want


def test_gibbs_keeps_a_long_document_whole(spark):
    docs = {0: {w: 5 for w in range(40)}, 1: {3: 2}, 2: {7: 1, 9: 4}}
    cfg = gibbs.Gibbs(3, n_sweeps=2, seed=2, tokens_per_block=60)
    fit = gibbs.fit(frame(spark, docs), 40, cfg)
    rows = fit.state.collect()
    assert sorted(r["doc_id"] for r in rows) == [0, 1, 2]
    assert sum(len(r["words"]) for r in rows) == 207
    assert fit.topic_word.agg({"n": "sum"}).first()[0] == 207


def test_gibbs_finds_planted_topics_and_steps_parameters(spark):
    docs = loops.planted(100)
    cfg = gibbs.Gibbs(5, n_sweeps=24, seed=1, n_blocks=4, sweeps_per_merge=2, optimise_from=20, optimise_every=2,
                      metrics_every=8)
    fit = gibbs.fit(frame(spark, docs), 100, cfg)
    values = [v for _, _, v in fit.history]
    assert values[-1] > values[0]
    assert len(set(fit.alpha)) > 1 and fit.beta != 0.01
    top = ranking.top_n(fit.topic_word.withColumnRenamed("n", "value"), 10).collect()
    pure = 0
    for t in range(5):
        groups = [r["word_id"] // 20 for r in top if r["topic"] == t]
        pure += max(groups.count(g) for g in set(groups)) >= 8
    assert pure >= 3


def test_merge_equals_recount(spark):
    docs = loops.planted(20)
    bow = frame(spark, docs)
    before = counts.assign_uniform(bow, 4, 1)
    after = counts.assign_uniform(bow, 4, 2)
    merged = counts.apply_deltas(counts.topic_word_counts(before), counts.block_deltas(before, after))
    want = counts.topic_word_counts(after)
    assert merged.exceptAll(want.select(merged.columns)).count() == 0
    assert want.select(merged.columns).exceptAll(merged).count() == 0


def test_likelihood_and_parameter_steps_equal_loops(spark):
    from topicspark.functions.special import np_digamma
    docs = loops.planted(15)
    assigned = counts.assign_uniform(frame(spark, docs), 3, 4)
    tw, dt = counts.topic_word_counts(assigned), counts.doc_topic_counts(assigned)
    n_kw, n_dk = np.zeros((3, 100)), np.zeros((15, 3))
    for r in tw.collect():
        n_kw[r["topic"], r["word_id"]] = r["n"]
    for r in dt.collect():
        n_dk[r["doc_id"], r["topic"]] = r["n"]
    alpha = [0.1, 0.2, 0.3]
    got = likelihood.total_loglik(tw, dt, 100, alpha, 0.05).first()["loglik"]
    assert abs(got - loops.loglik(n_kw, n_dk, alpha, 0.05)) < 1e-6
    got = [r["alpha"] for r in sorted(likelihood.alpha_step(dt, alpha).collect(), key=lambda r: r["topic"])]
    den = (np_digamma(n_dk.sum(axis=1) + 0.6) - np_digamma(0.6)).sum()
    want = [a * (np_digamma(n_dk[:, k] + a) - np_digamma(a)).sum() / den for k, a in enumerate(alpha)]
    np.testing.assert_allclose(got, want, rtol=1e-9)
    got = likelihood.beta_step(tw, 100, 0.05).first()["beta"]
    num = (np_digamma(n_kw + 0.05) - np_digamma(0.05)).sum()
    den = 100 * (np_digamma(n_kw.sum(axis=1) + 5.0) - np_digamma(5.0)).sum()
    np.testing.assert_allclose(got, 0.05 * num / den, rtol=1e-9)


def test_doc_topics_of_each_model_kind(spark, scratch):
    docs = loops.tiny_corpus()
    bow = frame(spark, docs)
    model = scratch.save(start_model(words(spark, 6), 2, 5, "hash"), "m")
    cfg = online_vb.OnlineVB(2, alpha=0.3, max_iter=30, tol=1e-4, seed=5, init="hash")
    got = {r["doc_id"]: r["theta"] for r in infer.doc_topics(bow, model, cfg, 6).collect()}
    lam = dense(model, 6)
    for d, w in docs.items():
        np.testing.assert_allclose(got[d], loops.e_step(w, lam, 0.3, 5, d, 30, 1e-4)[0], rtol=1e-9)
    share = infer.doc_topics(bow, model, cfg, 6, normalise=True).collect()
    assert all(abs(sum(r["theta"]) - 1) < 1e-12 for r in share)
    dt = counts.doc_topic_counts(counts.assign_uniform(bow, 2, 1))
    theta = {r["doc_id"]: sum(r["theta"]) for r in infer.counted_doc_topics(dt, 2).collect()}
    assert theta == {d: float(sum(w.values())) for d, w in docs.items()}


def test_block_count_bounds_tokens_and_cells():
    assert blocks.block_count(10_000_000, 5, 1000) == 10_000
    assert blocks.block_count(10, 5, 1000) == 1
    assert blocks.block_count(1_000_000, 20) == 4
    assert blocks.block_count(1_000_000, 1000) == 50


def test_draws_depend_on_their_keys_alone():
    stream = keyed_stream(3, 1, 0)
    together = keyed_uniform(stream, np.array([5, -7, 9]), 4)
    assert [keyed_uniform(stream, np.array([d]), 4)[0] for d in (5, -7, 9)] == together.tolist()
    many = np.concatenate([keyed_uniform(stream, np.arange(2000), p) for p in range(20)])
    assert abs(many.mean() - 0.5) < 0.01 and abs(many.var() - 1 / 12) < 0.003 and len(set(many)) == len(many)


def test_one_alpha_per_topic_is_checked():
    with pytest.raises(ValueError):
        online_vb.OnlineVB(3, alpha=[0.1, 0.2]).alpha_vec
    assert cvb0.CVB0(2, alpha=[0.1, 0.2]).alpha_vec == [0.1, 0.2] and scvb0.SCVB0(2, alpha=0.5).alpha_vec == [0.5, 0.5]


def test_a_continued_run_has_all_metrics_and_the_same_settings(spark, scratch, tmp_path):
    batches = prepare_batches(frame(spark, loops.tiny_corpus()), 6, 2, scratch)
    cfg = online_vb.OnlineVB(2, alpha=0.3, max_iter=5, seed=5, init="hash")
    whole = online_vb.fit(batches, words(spark, 6), cfg)
    base = str(tmp_path / "run")
    online_vb.fit(replace(batches, n_batches=1), words(spark, 6), cfg, snapshots=base)
    again = online_vb.fit(batches, words(spark, 6), cfg, snapshots=base)
    assert [h[:2] for h in again.history] == [h[:2] for h in whole.history] and len(again.history) == 2
    np.testing.assert_allclose([h[2] for h in again.history], [h[2] for h in whole.history], rtol=1e-12)
    with pytest.raises(ValueError):
        online_vb.fit(batches, words(spark, 6), replace(cfg, seed=6), snapshots=base)


def test_documents_without_words_get_alpha(spark, scratch):
    bow = frame(spark, loops.tiny_corpus())
    listed = spark.createDataFrame([(d,) for d in (0, 1, 2, 3, 77)], "doc_id long")
    model = scratch.save(start_model(words(spark, 6), 2, 5, "hash"), "m")
    cfg = online_vb.OnlineVB(2, alpha=[0.3, 0.7], max_iter=3, seed=5, init="hash")
    got = {r["doc_id"]: r["theta"] for r in infer.doc_topics(bow, model, cfg, 6, documents=listed).collect()}
    assert sorted(got) == [0, 1, 2, 3, 77] and got[77] == [0.3, 0.7]
    counted = infer.counted_doc_topics(counts.doc_topic_counts(counts.assign_uniform(bow, 2, 1)), 2, documents=listed)
    assert {r["doc_id"]: r["theta"] for r in counted.collect()}[77] == [0.0, 0.0]


def test_lockstep_gibbs_cuts_large_blocks_to_pieces(spark, tmp_path):
    docs = loops.planted(40)
    n_tokens = sum(sum(w.values()) for w in docs.values())
    bow, size = frame(spark, docs), n_tokens // 7
    for schedule, want in (("lockstep", 9), ("frozen", 9), ("serial", 3)):
        cfg = gibbs.Gibbs(5, n_sweeps=2, seed=2, n_blocks=3, schedule=schedule, tokens_per_block=size)
        state, n_blocks = gibbs.start_state(bow, cfg, Scratch(spark, base=str(tmp_path / schedule)))
        assert n_blocks == want and state.agg(F.max("block")).first()[0] >= 3 * (want > 3)
        fit = gibbs.fit(bow, 100, cfg)
        by_doc = {r["doc_id"]: r["n"] for r in fit.doc_topic.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
        assert by_doc == {d: sum(w.values()) for d, w in docs.items()}


def test_cvb0_sweeps_in_place_store_no_responsibilities_they_can_make_again(spark, monkeypatch):
    from topicspark.operators import blocks
    stored, save = [], blocks.BlockTables.save

    def saved(self, df, name):
        out = save(self, df, name)
        stored.append((name, out.agg(F.sum(F.length("phi"))).first()[0]))
        return out

    monkeypatch.setattr(blocks.BlockTables, "save", saved)
    docs, fits = loops.planted(30), {}
    for few in (32, 2):                                # blocks of the table: each of the five in-place blocks, or several of them in one
        monkeypatch.setattr(cvb0, "SYNC_BLOCKS", few)
        for n_sweeps in (1, 3):
            cfg = cvb0.CVB0(3, n_sweeps=n_sweeps, seed=4, schedule="block", n_blocks=5)
            assert cvb0.n_table_blocks(9_999, cfg) == min(5, few) and cvb0.n_blocks(9_999, cfg) == 5
            fit = cvb0.fit(frame(spark, docs), 100, cfg)
            fits[few, n_sweeps] = collected(fit.phi), {r["word_id"]: r["params"] for r in fit.word_topic.collect()}, fit.history
            sizes, stored[:] = dict(stored), []
            assert sizes["phi/0"] == sizes[f"phi/{n_sweeps}"] == 0 and (n_sweeps == 1 or sizes["phi/2"] > 0)
    for n_sweeps in (1, 3):
        (phi, sums, history), (other, other_sums, other_history) = fits[32, n_sweeps], fits[2, n_sweeps]
        assert phi.keys() == other.keys() and sums.keys() == other_sums.keys()
        for key in phi:
            np.testing.assert_allclose(phi[key], other[key], rtol=1e-9)
        for word in sums:
            np.testing.assert_allclose(sums[word], other_sums[word], rtol=1e-9)
            np.testing.assert_allclose(sums[word], sum(p for (_, w), p in phi.items() if w == word), rtol=1e-9)
        np.testing.assert_allclose([v for _, _, v in history], [v for _, _, v in other_history], rtol=1e-9)


def test_kernels_draw_what_spark_draws(spark):
    from topicspark.functions.random import fast_u01
    from topicspark.operators.kernels import fast_draws
    docs = [0, 7, -3, 2**62 + 1, -2**63, 2**63 - 1, None]
    words = [0, 1, 99, 2**31 - 1]
    rows = spark.createDataFrame([(d, w) for d in docs for w in words], "doc_id long, word_id int")
    ids, missing = np.array([d or 0 for d in docs]), np.array([d is None for d in docs])
    which, word = np.repeat(np.arange(len(docs)), len(words)), np.tile(np.array(words, np.int32), len(docs))
    for seed in (1, -5, 2**40):
        drawn = rows.select("doc_id", "word_id", *[fast_u01(seed, "doc_id", "word_id", F.lit(k)).alias(f"u{k}") for k in range(3)]).collect()
        want = {(r["doc_id"], r["word_id"]): [r["u0"], r["u1"], r["u2"]] for r in drawn}
        got = fast_draws(seed, ids, missing, which[:, None], word[:, None], np.arange(3))
        assert got.tolist() == [want[d, w] for d in docs for w in words]


def test_gibbs_starts_from_the_draws_of_single_tokens(spark, tmp_path):
    bow = spark.createDataFrame([(d, w, f) for d in (0, -4, 2**60, None) for w, f in ((0, 3), (5, 1), (7, 12))], BOW)
    state, _ = gibbs.start_state(bow, gibbs.Gibbs(6, seed=3), Scratch(spark, base=str(tmp_path)))
    want = counts.assign_uniform(bow, 6, 3, portable=False).collect()
    want = sorted((str(r["doc_id"]), r["word_id"], r["occ"], r["topic"]) for r in want)
    got = [(str(r["doc_id"]), w, r["words"][:j].count(w), k) for r in state.collect() for j, (w, k) in enumerate(zip(r["words"], r["topics"]))]
    assert sorted(got) == want
