import math

import numpy as np

from topicspark.llm import whitening as q

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, h1 string, id string, weight string, salt string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, *["x"] * 5) for i, v in rows], SCHEMA)


def planted(seed=1, n=300, d=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.arange(1, d + 1)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(400)] + [(2000 + i, rows[i % 5][1]) for i in range(50)]
    return rows + [(None, rows[3][1]), (7, rows[3][1]), (3000, None), (3001, [1.0, None] + [0.0] * (d - 2)),
                   (3002, [math.nan] + [0.0] * (d - 1)), (3003, [math.inf] + [0.0] * (d - 1)), (3004, [])]


def by_hand(rows, count=False, components=4):
    good = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    weights = {}
    for _, x in good:
        weights[x] = weights.get(x, 0) + 1 if count else 1
    xs, w = np.array(list(weights), float), np.array(list(weights.values()))
    n, total = int(w.sum()), [int(s) for s in (xs * w[:, None]).sum(axis=0)]
    mean = np.array(total) / n
    cov = ((xs - mean) * w[:, None]).T @ (xs - mean) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in good:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, total))
        for k in range(components):
            out.append((i, k + 1, n, deviation, float((np.array(x) - mean) @ vectors[:, k] / math.sqrt(values[k])), values[k] / np.trace(cov)))
    return out


def same(got, want):
    key = lambda r: (repr(r[0]), r[1], abs(r[4]))
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for k in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in side if r[1] == k]) for side in (got, want))
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-10)


def test_against_numpy(spark):
    rows = planted()
    for weights in ("one", "count"):
        got = q.whiten(frame(spark, rows).repartition(7), weights=weights).collect()
        same(got, by_hand(rows, weights == "count"))
        assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_hot_keys_lose_no_row(spark, monkeypatch):
    monkeypatch.setattr(q, "_HOT_KEYS", 10)
    monkeypatch.setattr(q.join_back, "__defaults__", (5,))
    rows = planted(2, 40)
    same(q.whiten(frame(spark, rows).repartition(3)).collect(), by_hand(rows))


def test_whole_numbers_of_any_size(spark):
    rows = [(i, [float(np.float32(v)) for v in (3e12 * i, -1e12 * i * i, 7.0)]) for i in range(5)]
    got = q.whiten(frame(spark, rows), components=1).collect()
    xs = [[math.floor(256 * c) for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*xs)]
    want = {i: sum((5 * c - s) ** 2 for c, s in zip(x, total)) for i, x in enumerate(xs)}
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: v if v < 2 ** 63 else None for i, v in want.items()}


def test_edges(spark):
    assert q.whiten(frame(spark, []), 4).count() == 0
    assert q.whiten(frame(spark, [(1, [0.5, 1.5]), (2, [0.5, 1.5])])).count() == 0        # one distinct vector: nothing to whiten
    flat = q.whiten(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 9                        # rank one
    mixed = [(i, [float(i % 3), float(i)]) for i in range(12)] + [(100 + i, [float(i * i)]) for i in range(4)]
    got = q.whiten(frame(spark, mixed)).collect()
    assert len(got) == 12 * 2 + 4 and {r["n"] for r in got if r["vec_id"] >= 100} == {4}
    row = got[0].asDict()
    assert [type(row[c]) for c in ("component", "n", "deviation", "whitened")] == [int, int, int, float]


def test_registered_query(spark, tmp_path):
    rows = planted(3, 60)
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    same(q.op12_whitening(spark, str(tmp_path)).collect(), by_hand(rows))
