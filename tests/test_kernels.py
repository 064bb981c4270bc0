"""The numpy kernels on their own, without Spark."""

import hashlib
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from topicspark.operators import kernels as q


def chi_square_fits(observed, expected):
    """Within five standard deviations of the chi-square distribution's mean."""
    use = expected > 5
    value = ((observed[use] - expected[use]) ** 2 / expected[use]).sum()
    return value < use.sum() + 5 * math.sqrt(2 * use.sum())


def test_sparse_draw_has_the_distribution_of_the_dense_one():
    rng = np.random.default_rng(1)
    k, n = 200, 60_000
    for _ in range(3):
        n_dk = np.where(rng.random((2, k)) < 0.05, rng.integers(1, 9, (2, k)), 0).astype(float)
        n_kw = np.where(rng.random((3, k)) < 0.1, rng.integers(1, 30, (3, k)), 0).astype(float)
        n_k = n_kw.sum(axis=0) + rng.integers(0, 500, k)
        alpha = rng.random(k) * 0.2
        doc_topics = q.TopicLists(*np.nonzero(n_dk), 2, k, np.full(2, 9))
        word_topics = q.TopicLists(*np.nonzero(n_kw), 3, k, np.full(3, 9))
        doc_topics.add(np.array([0, 1]), np.array([7, 7]))             # topics that weigh nothing, or did not
        word_topics.add(np.array([2, 2, 0]), np.array([3, 3, 5]))
        docs, words = rng.integers(0, 2, n), rng.integers(0, 3, n)
        got = q.sparse_draw(n_dk, n_kw, n_k, alpha, 0.05, 40.0, docs, words, doc_topics, word_topics, rng.random(n))
        for d in range(2):
            for w in range(3):
                here = (docs == d) & (words == w)
                p = (n_dk[d] + alpha) * (n_kw[w] + 0.05) / (n_k + 40.0)
                assert chi_square_fits(np.bincount(got[here], minlength=k), here.sum() * p / p.sum())


def test_topic_lists_hold_every_topic_once():
    rng = np.random.default_rng(2)
    held = rng.random((20, 50)) < 0.1
    lists = q.TopicLists(*np.nonzero(held), 20, 50, np.full(20, 40))
    for _ in range(10):
        rows, topics = rng.integers(0, 20, 4), rng.integers(0, 50, 4)
        lists.add(rows, topics)
        held[rows, topics] = True
    order = rng.permutation(20)
    owner, topics, begin = lists.of(order)
    for i, row in enumerate(order):
        mine = topics[owner == i]
        assert sorted(mine) == np.flatnonzero(held[row]).tolist() and (begin[i] == np.flatnonzero(owner == i)[:1]).all()


def gibbs_block(n_docs, length, k, seed=1):
    rng = np.random.default_rng(seed)
    words, topics = rng.integers(0, 300, (n_docs, length)), rng.integers(0, min(k, 10), (n_docs, length))
    n_kw = np.zeros((300, k), int)
    np.add.at(n_kw, (words.ravel(), topics.ravel()), 1)
    right = pa.table({"word_id": pa.array(np.arange(300), pa.int32()), "topics": pa.array([np.flatnonzero(r) for r in n_kw], pa.list_(pa.int32())),
                      "ns": pa.array([r[r > 0] for r in n_kw], pa.list_(pa.int64()))})
    left = pa.table({"block": pa.array([0] * n_docs, pa.int32()), "doc_id": pa.array(np.arange(n_docs)),
                     "words": pa.array(list(words), pa.list_(pa.int32())), "topics": pa.array(list(topics), pa.list_(pa.int32()))})
    return left, right, n_kw.sum(axis=0)


def test_sparse_and_dense_sweeps_agree_in_distribution():
    """The share of tokens that change their topic, and the topic totals, over many seeds."""
    left, right, totals = gibbs_block(30, 12, 30)
    out = {}
    for sparse_from in (1, 1000):
        sums = []
        for seed in range(60):
            kernel = q.gibbs_kernel(30, [0.1] * 30, 0.05, 300, totals, seed, 1, "lockstep", sparse_from=sparse_from)
            got = kernel(left, right)["topics"].combine_chunks().flatten().to_numpy()
            sums.append(np.append(np.bincount(got, minlength=30), (got != left["topics"].combine_chunks().flatten().to_numpy()).sum()))
        out[sparse_from] = np.array(sums)
    a, b = out.values()
    error = np.sqrt((a.var(axis=0) + b.var(axis=0)) / len(a)) + 0.02
    assert (np.abs(a.mean(axis=0) - b.mean(axis=0)) < 5 * error).all()


def test_a_token_costs_its_topics_in_use():
    import time
    seconds = {}
    for k in (64, 1000):
        left, right, totals = gibbs_block(300, 60, k)
        kernel = q.gibbs_kernel(k, [0.1] * k, 0.01, 300, totals, 1, 1, "lockstep")
        kernel(left, right)
        start = time.perf_counter()
        kernel(left, right)
        seconds[k] = time.perf_counter() - start
    assert seconds[1000] < 4 * seconds[64]


def test_keyed_gamma_is_gamma():
    keys = np.arange(20_000)
    x = q.keyed_gamma(5, keys, 5)
    assert abs(x.mean() - 1) < 0.002 and abs(x.std() - 0.1) < 0.002
    few = q.keyed_gamma(5, keys[100:103], 5)
    assert np.array_equal(few, x[100:103])                              # of seed, key and column alone
    ordered = np.sort(x.ravel())
    other = np.sort(np.random.default_rng(3).gamma(100.0, 0.01, 400_000))
    ks = np.abs(np.searchsorted(other, ordered) / len(other) - np.arange(len(ordered)) / len(ordered)).max()
    assert ks < 1.63 * math.sqrt(1 / len(ordered) + 1 / len(other))
    assert abs(np.corrcoef(x[:-1, 0], x[1:, 0])[0, 1]) < 0.03 and abs(np.corrcoef(x[:, 0], x[:, 1])[0, 1]) < 0.03


@pytest.mark.parametrize("order", ["sync", "lockstep", "serial"])
def test_phi_rows_of_any_piece_size_hold_the_same(monkeypatch, order):
    rng = np.random.default_rng(4)
    doc = np.repeat(np.arange(5), [1, 9, 3, 30, 2])
    word = np.concatenate([np.sort(rng.choice(40, n, replace=False)) for n in (1, 9, 3, 30, 2)])
    phi = rng.random((45, 3))
    phi /= phi.sum(axis=1, keepdims=True)
    weight = rng.integers(1, 4, 45).astype(float)
    words = np.unique(word)
    right = pa.table({"word_id": pa.array(words.astype(np.int32)), "params": q._lists(rng.random((len(words), 3)) * 20 + 5, 3)})
    outs = []
    for piece in (4096, 4):
        monkeypatch.setattr(q, "PIECE", piece)
        monkeypatch.setattr(q, "_CELLS_AT_ONCE", 12)
        rows = q._phi_rows(7, doc, word, weight, phi)
        assert max(map(len, rows["words"].to_pylist())) <= piece and rows["block"].to_pylist() == [7] * rows.num_rows
        new = q.cvb0_kernel(3, [0.1] * 3, 0.01, 40, [90.0] * 3, order)(rows.take(pa.array(rng.permutation(rows.num_rows))), right)
        n_dk = {d: v for d, v in zip(new["doc_id"].to_pylist(), new["n_dk"].to_pylist()) if v}
        sums = np.frombuffer(b"".join(new["sums"].to_pylist())).reshape(-1, 3)
        outs.append((q._doubles(new["phi"], 3), [n_dk[d] for d in range(5)], sums))
        np.testing.assert_allclose(sums.sum(axis=1).sum(), weight.sum())
        assert [w for row in new["sum_words"].to_pylist() for w in row] == words.tolist()
    for a, b in zip(*outs):
        np.testing.assert_allclose(a, b)


def test_a_block_of_pairs_is_packed_in_little_more_than_its_words_and_weights(monkeypatch):
    monkeypatch.setattr(q, "_CELLS_AT_ONCE", 20_000)
    rng = np.random.default_rng(6)
    doc, word = np.repeat(np.arange(1000), 300), np.tile(np.arange(300), 1000).astype(np.int32)
    order = rng.permutation(len(doc))
    rows = pa.table({"block": pa.array(np.full(len(doc), 7, np.int32)), "doc_id": pa.array(doc[order]), "word_id": pa.array(word[order]),
                     "weight": pa.array(np.ones(len(doc), np.int32))})
    q.pack_drawn(2, 5)(rows.slice(0, 10))
    tracemalloc.start()
    try:
        packed = q.pack_drawn(2, 5)(rows)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40 * len(doc)
    assert packed["words"].combine_chunks().flatten().to_numpy().tolist() == word.tolist()
    assert packed["doc_id"].to_pylist() == list(range(1000)) and set(packed["weights"].combine_chunks().flatten().to_pylist()) == {1.0}


def test_e_step_does_not_depend_on_parts(monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(d, w, int(rng.integers(1, 4))) for d in range(40) for w in sorted(rng.choice(50, int(rng.integers(1, 30)), replace=False))]
    left = pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("doc_id", pa.int64()), ("word_id", pa.int32()), ("freq", pa.int32())))})
    right = pa.table({"word_id": pa.array(np.arange(50, dtype=np.int32)), "params": q._lists(rng.random((50, 4)) + 0.1, 4)})
    outs = []
    for cells in (10 ** 9, 100, 1):
        monkeypatch.setattr(q, "_CELLS_OF_A_PART", cells)
        kernel = q.vb_kernel(4, [0.1] * 4, [30.0] * 4, 3, "gamma", 50, 1e-3)
        docs = q.vb_kernel(4, [0.1] * 4, [30.0] * 4, 3, "gamma", 50, 1e-3, True)(left, right)
        words = kernel(left, right)
        outs.append((q._matrix(words, "ss", 4), q._matrix(docs, "vec", 4), words["score"].to_numpy(), docs["score"].to_numpy()))
    for other in outs[1:]:
        for a, b in zip(outs[0], other):
            np.testing.assert_allclose(a, b, rtol=1e-9)


@pytest.mark.parametrize("schedule", ["frozen", "lockstep"])
def test_long_documents_give_the_same_as_loops_and_as_steps(monkeypatch, schedule):
    rng = np.random.default_rng(8)
    sizes = np.array([70, 3, 12, 40, 9])
    offsets = np.append(0, np.cumsum(sizes))
    words, topics = rng.integers(0, 20, sizes.sum()), rng.integers(0, 3, sizes.sum())
    n_kw = np.zeros((20, 3), np.int64)
    np.add.at(n_kw, (words, topics), 1)
    left = pa.table({"block": np.zeros(5, np.int32), "doc_id": np.arange(5), "words": q._ragged(words.astype(np.int32), offsets),
                     "topics": q._ragged(topics.astype(np.int32), offsets)})
    ends = np.arange(21) * 3
    right = pa.table({"word_id": np.arange(20, dtype=np.int32), "topics": q._ragged(np.tile(np.arange(3, dtype=np.int32), 20), ends),
                      "ns": q._ragged(n_kw.ravel(), ends)})
    outs = []
    for cells, part in ((0, 200_000), (7, 200_000), (7, 30), (48, 30), (10**6, 200_000)):
        monkeypatch.setattr(q, "_CELLS_OF_A_STEP", cells)
        monkeypatch.setattr(q, "_CELLS_OF_A_PART", part)
        kernel = q.gibbs_kernel(3, [0.1, 0.2, 0.3], 0.01, 20, n_kw.sum(axis=0).tolist(), 5, 2, schedule, 2, schedule == "frozen")
        outs.append(kernel(left, right)["topics"].to_pylist())
    assert all(x == outs[0] for x in outs) and outs[0] != left["topics"].to_pylist()


def test_portable_draws_are_those_of_md5():
    rng = np.random.default_rng(9)
    prefixes = ["7", "7:-3", "7:" + str(2**63 - 1), "7:nan"]
    which, first, second = rng.integers(0, 4, 40_000), rng.integers(0, 10**6, 40_000), rng.integers(0, 12, 40_000)
    want = [hashlib.md5(f"{prefixes[p]}:{a}:{b}".encode()).digest()[:4] for p, a, b in zip(which, first, second)]
    want = np.frombuffer(b"".join(want), ">u4") / 2**32
    assert np.array_equal(q.md5_draws(prefixes, which, first, second), want)
    long = ["7" * 50]                                                    # no room for the padding: one by one
    assert q.md5_draws(long, np.zeros(1, int), first[:1], second[:1])[0] == int.from_bytes(
        hashlib.md5(f"{long[0]}:{first[0]}:{second[0]}".encode()).digest()[:4], "big") / 2**32
