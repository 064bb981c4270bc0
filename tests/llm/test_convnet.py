import tracemalloc

import numpy as np
import pytest
from edges import TEXTS, edge_docs

from topicspark.llm import convnet as q


def texts(n, rng):
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna"]
    for i in range(n):
        good = i % 3 != 0
        yield i, " ".join(rng.choice(words) + ("" if good else "$$$") for _ in range(rng.integers(5, 400))), int(good)


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 480, 481, 5_000):
        raw = bytes(np.random.default_rng(n).integers(1, 255, n, np.uint8))
        data, seen = q.chunks_of(raw)
        assert data.shape == seen.shape and data.shape[1] == q.CHUNK
        assert set(raw) <= set(data.reshape(-1).tolist())
        if n >= q.CHUNK:
            assert data[-1].tobytes() == raw[-q.CHUNK:] and data[0].tobytes() == raw[:q.CHUNK]
    _, seen = q.chunks_of(b"abcdefghijklmnop" * 2)
    assert seen[0, :16 + q.SEEN - 1].sum() == 0 and seen[0, 16 + q.SEEN - 1:32].all()


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = q.Net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, seen = rng.integers(0, 256, (6, q.CHUNK)).astype(np.uint8), rng.integers(0, 2, (6, q.CHUNK)).astype(np.uint8)
    text, y = np.array([0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        act = np.maximum(net.pooled(net.windows(data, seen))[0], 0) @ net.p["out"] + net.p["base"]
        z = np.bincount(text, act) / np.bincount(text)
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    grads = net.gradients(data, seen, text, y)
    for name, g in grads.items():
        flat = net.p[name].reshape(-1)
        for i in rng.integers(0, flat.size, 5):
            was, h = flat[i], 1e-4
            flat[i] = was + h
            up = loss()
            flat[i] = was - h
            down = loss()
            flat[i] = was
            assert np.reshape(g, -1)[i] == pytest.approx((up - down) / (2 * h), abs=2e-4)


def test_held_out_accuracy(spark):
    rows = list(texts(400, np.random.default_rng(5)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    net = q.train(docs, labels)
    got = q.scored(docs, net).withColumn("held_out", q.held_out(q.F.col("doc_id"))).collect()
    held = [(r["score"] >= 0.5) == bool(rows[r["doc_id"]][2]) for r in got if r["held_out"]]
    assert len(held) > 50 and np.mean(held) > 0.95


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    net = q.train(docs, labels)
    assert {r["score"] for r in q.scored(docs, net).collect()} == {0.5}
    got = q.scored(docs, q.Net()).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((i for i, _ in TEXTS), key=repr)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert q.scored(docs.limit(0), net).count() == 0


def test_score_equals_a_plain_loop():
    net = q.Net()
    for raw in (b"", b"short", bytes(range(256)) * 3, b"the same line again\n" * 60):
        data = raw + b"\0" * max(0, q.CHUNK - len(raw))
        seen = [int(i + 1 >= q.SEEN and i < len(raw) and raw.find(raw[i + 1 - q.SEEN:i + 1]) < i + 1 - q.SEEN) for i in range(len(data))]
        ends, logits = len(data) - q.CHUNK, []
        for start in [*range(0, ends, q.STEP), ends]:
            best = np.full(q.FILTERS, -np.inf)
            for at in range(start, start + q.CHUNK - q.WIDTH + 1, q.STRIDE):
                x = np.concatenate([[*net.p["embed"][data[i]], seen[i]] for i in range(at, at + q.WIDTH)])
                best = np.maximum(best, x @ net.p["filters"])
            logits.append(np.maximum(best + net.p["bias"], 0) @ net.p["out"] + net.p["base"][0])
        assert net.score(raw) == pytest.approx(1 / (1 + np.exp(-np.mean(logits))), abs=1e-5)


def test_blocks_and_windows_do_not_change_marks(monkeypatch):
    rng = np.random.default_rng(2)
    raw = bytes(rng.integers(97, 99, 40_000, np.uint8)) + b"once more " * 300
    data, seen = q.chunks_of(raw)
    monkeypatch.setattr(q, "_BLOCK", 3)
    assert all(np.array_equal(a, b) for a, b in zip(q.chunks_of(raw), (data, seen)))
    monkeypatch.setattr(q, "WINDOW", 500)
    a, b = bytes(rng.integers(1, 255, 300, np.uint8)), bytes(rng.integers(1, 255, 900, np.uint8))
    _, near = q.chunks_of(a + a)
    assert near[-1, -200:].all() and not q.chunks_of(a + b + a)[1][-1, -200:].all()


def test_a_very_long_text_needs_bounded_memory():
    raw = np.random.default_rng(3).integers(1, 255, 24_000_000, np.uint8).tobytes()
    tracemalloc.start()
    assert 0 <= q.Net().score(raw) <= 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_training_bytes_bound_whole_texts(spark):
    docs = spark.createDataFrame([(i, "x" * (100 + 1_000 * (i == 3))) for i in range(30)] + [(None, "y")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1)], "doc_id bigint, quality int")
    learnt = {r[0] for r in labels.where(~q.held_out(q.F.col("doc_id"))).collect()}
    got = q.training_rows(docs, labels, 1_000, 1_000, "doc_id", "text")
    assert len(got) == 10 and {i for i, _ in got} <= learnt - {3}
    assert len(q.training_rows(docs, labels, 1_000, 10_000, "doc_id", "text")) == len(learnt)


def test_gradients_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    net = q.Net()
    data, seen = rng.integers(0, 256, (9, q.CHUNK)).astype(np.uint8), rng.integers(0, 2, (9, q.CHUNK)).astype(np.uint8)
    args = (data, seen, np.array([0, 0, 1, 2, 2, 2, 2, 3, 3]), np.array([1.0, 0.0, 1.0, 0.0]))
    whole = net.gradients(*args)
    monkeypatch.setattr(q, "_TRAIN_BLOCK", 2)
    for name, g in net.gradients(*args).items():
        np.testing.assert_allclose(g, whole[name], rtol=1e-4, atol=1e-7)
