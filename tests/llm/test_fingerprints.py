import collections
import hashlib

import numpy as np
from edges import TEXTS, edge_docs

from topicspark.llm import fingerprints as q


def likeness(a, b):
    a, b = (collections.Counter(t.lower().split()) for t in (a, b))
    return sum((a & b).values()) / sum((a | b).values())


def test_collisions_estimate_generalised_jaccard():
    rng = np.random.default_rng(3)
    sampler = q.Sampler(512)
    errors = []
    for _ in range(40):
        words = [f"w{i}" for i in rng.integers(0, 60, 200)]
        cut = rng.integers(0, 200)
        a, b = " ".join(words), " ".join(words[:cut] + [f"v{i}" for i in rng.integers(0, 60, 200 - cut)])
        x, y = sampler.signatures([a, b])
        errors.append(q.likeness(x, y) - likeness(a, b))
    assert abs(np.mean(errors)) < 0.015 and np.sqrt(np.mean(np.square(errors))) < 0.03


def test_table_holds_quantiles_of_gamma():
    x = q._gamma_table()
    u = (np.arange(len(x)) + 0.5) / len(x)
    assert np.all(np.diff(x) > 0) and np.allclose(1 - (1 + x) * np.exp(-x), u, atol=1e-9)


def test_a_signature_depends_on_the_text_alone():
    sampler = q.Sampler(64)
    texts = [t or "" for _, t in TEXTS]
    together = sampler.signatures(texts)
    for t, row in zip(texts, together):
        assert np.array_equal(sampler.signatures([t])[0], row)
    assert q.as_string(sampler.signatures([" "])[0]) == ""


def test_successors(spark, monkeypatch):
    monkeypatch.setattr(q, "_DOCS_PER_RANGE", 7)
    monkeypatch.setattr(q, "_BATCH_TEXTS", 3)
    texts = [(i * 3, f"text {i} " + " ".join(f"w{(i * k) % 17}" for k in range(i % 9 * 10))) for i in range(60)]
    texts += [(200, None), (201, ""), (202, "é" * 50), (203, dict(TEXTS)[5])]
    docs = edge_docs(spark, texts).repartition(5)
    got = {r["doc_id"]: r for r in q.with_next(docs).collect()}
    assert len(got) == len(texts)
    sampler = q.Sampler(q.SAMPLES)
    for (i, t), (_, after) in zip(texts, texts[1:] + texts[:1]):
        t, after, r = t or "", after or "", got[i]
        edit = q.edited(t, after)
        x, y, z = sampler.signatures([t, edit, after])
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (q.as_string(x), q.as_string(y))
        assert (r["near_edited"], r["near_next"]) == (q.likeness(x, y), q.likeness(x, z))
    plain = {r["doc_id"]: r["fingerprint"] for r in q.fingerprints(docs).collect()}
    assert plain == {i: r["fingerprint"] for i, r in got.items()}


def test_edges(spark):
    docs = edge_docs(spark)
    got = q.with_next(docs).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((i for i, _ in TEXTS), key=repr)
    one = q.with_next(edge_docs(spark, [(4, "alone here")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(4, 1.0)]
    assert q.with_next(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_split_and_copies_counted(spark, monkeypatch):
    monkeypatch.setattr(q, "_DOCS_PER_RANGE", 100)
    rows = [(None, f"text {i % 500} of no id") for i in range(1_000)] + [(None, "copy " * 50)] * 2_000 + [(7, "a b c d")] * 3 + [(8, "z b c e")]
    docs = edge_docs(spark, rows).repartition(9)
    sizes = [r["n"] for r in q.in_order(docs, "doc_id", "text").groupBy("part").agg(q.F.sum("copies").alias("n"), q.F.count("*").alias("rows"))
             .select("rows", q.F.col("rows").alias("n")).collect()]
    assert len(sizes) > 5 and max(sizes) < 600
    got = q.with_next(docs).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows)
    copies = [r for r in got if r["n_chars"] == 250]
    assert len(copies) == 2_000 and sum(r["near_next"] == 1 for r in copies) >= 1_999
    assert sorted(r["near_next"] == 1 for r in got if r["doc_id"] == 7) == [False, True, True]
    own = hashlib.sha256(q.edited("a b c d", "a b c d").encode()).hexdigest()
    assert [r["edited_sha256"] == own for r in got if r["doc_id"] == 7].count(True) == 2
