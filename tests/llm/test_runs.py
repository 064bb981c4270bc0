import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from edges import LONG, TEXTS, edge_docs

from topicspark.llm import runs as q

TABLE = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def runs_by_hand(words):
    """Every stretch of equal words q apart, kept if q is its smallest period."""
    n, out = len(words), []
    for period in range(1, n // 3 + 1):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            length = j + period - i
            if j > i and length >= max(24, 3 * period):
                part = words[i:i + length]
                if not any(all(a == b for a, b in zip(part, part[p:])) for p in range(1, period)):
                    out.append((i, length, period))
            i = j + 1
    return sorted(out)


def row_by_hand(doc_id, text, planted=True):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (n, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def periodic_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = []
        while len(words) < rng.randrange(30, 500):
            root = [f"w{rng.randrange(rng.choice([1, 2, 3, 40]))}" for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 31, 33, 64, 65]))]
            piece = root * rng.randrange(1, 6)
            words += piece[:len(piece) - rng.randrange(min(len(piece), 4))]
        yield words


def test_runs_of_a_batch_equal_those_by_hand():
    for seed in range(6):
        texts = list(periodic_texts(seed)) + [[], ["a"], ["a"] * 23, ["a"] * 24, ["a", "b"] * 12, ["a", "b"] * 11]
        ids = {}
        numbers = [np.array([ids.setdefault(w, len(ids)) for w in t], np.int64) for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = q.find_runs(np.concatenate(numbers), bounds)
        for words, runs in zip(texts, got):
            assert runs == runs_by_hand(words), words


def test_nested_runs():
    words = (["a"] * 30 + ["b"]) * 4 + ["c"] + ["x", "y"] * 20
    got = q.find_runs(q.numbered([w.encode() for w in words]), np.array([0, len(words)]))[0]
    assert got == runs_by_hand(words) and (0, 124, 31) in got and (0, 30, 1) in got


def test_fibonacci_word():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    words = list(b)
    assert q.find_runs(q.numbered([w.encode() for w in words]), np.array([0, len(words)]))[0] == runs_by_hand(words)


def test_registered_query(spark, tmp_path):
    rng = random.Random(5)
    texts = [(i, " ".join(words)) for i, words in enumerate(periodic_texts(9))]
    texts += [(100 + i, " ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(0, 120)))) for i in range(150)]
    texts += [t for t in TEXTS if t[1] != LONG] + [(9000, "a b c " * 30 + "\x1c \x85" * 9), (9001, "é\x0bé\x0cé\r\n" * 20)]
    edge_docs(spark, texts).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = q.op13_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", *TABLE]
    key = lambda r: tuple(map(repr, r))
    want = sorted(((i, *row_by_hand(i, t)) for i, t in texts), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert any(r[2] for r in want) and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in want)


def test_general_operator(spark):
    docs = edge_docs(spark, [(1, "go " * 30 + "home"), (2, None), (None, "a b c"), (3, LONG)])
    got = {r["doc_id"]: r for r in q.word_runs(docs).collect()}
    assert got[1]["collapsed"] == "go home" and [tuple(r) for r in got[1]["runs"]] == [(0, 30, 1)]
    assert got[2]["n_words"] == 0 and got[2]["runs"] == [] and got[2]["start"] is None and got[None]["collapsed"] == "a b c"
    period = q.find_runs(q.numbered(LONG.encode().split()), np.array([0, len(LONG.split())]))[0]
    assert [tuple(r) for r in got[3]["runs"]] == period
    assert q.word_runs(docs.limit(0)).count() == 0
