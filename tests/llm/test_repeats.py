import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from edges import TEXTS, edge_docs

from topicspark.llm import repeats as q


def by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = q.runs_of(gone)
        out.append((len(r), bytes(np.frombuffer(r, np.uint8)[~gone]), [(a, b + 1) for a, b in zip(edges[::2], edges[1::2])]))
    return out


def test_windows_equal_those_by_hand():
    rng = random.Random(3)
    for _ in range(600):
        length, letters = rng.choice([1, 2, 3, 5, 8, 9, 17, 40]), rng.choice([b"a", b"ab", b"abcd", bytes(range(97, 123))])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 4))]
        contents = [b"".join(rng.choice(base)[rng.randint(0, 20):] for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 8))]
        weights = [rng.choice([1, 1, 1, 2, 5]) for _ in contents]
        seen = collections.Counter()
        for c, w in zip(contents, weights):
            for i in range(len(c) - length + 1):
                seen[c[i:i + length]] += w
        want = [[seen[c[i:i + length]] > 1 for i in range(len(c) - length + 1)] for c in contents]
        assert [f.tolist() for f in q.repeated_windows(contents, weights, length)] == want


def test_every_window_lies_in_one_region_and_equal_windows_share_the_anchor():
    rng = random.Random(5)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") if rng.random() < .5 else rng.choice(b"abcdefgh") for _ in range(rng.randint(0, 300))) for _ in range(4)]
        texts += [texts[0][20:] + texts[1], b"a" * 100]
        seen, anchors = collections.Counter(), {}
        for t, s, n, a, _ in zip(*q.regions(texts, 40, 8)):
            for j in range(s, s + n):
                seen[(t, j)] += 1
                assert anchors.setdefault(texts[t][j:j + 40], a) == a
        assert len(seen) == sum(max(0, len(x) - 39) for x in texts) and set(seen.values()) <= {1}


def test_a_very_long_text_in_parts_has_every_window_once():
    raw = bytes(range(256)) * 10
    parts = q.long_text_parts(raw, 200, 500)
    places = [a + i for a, p in parts for i in range(len(p) - 199)]
    assert sorted(places) == list(range(len(raw) - 199)) and all(raw[a:a + len(p)] == p for a, p in parts)


def corpus(rng):
    passages = ["".join(rng.choice("abcdefghij klmnoé") for _ in range(rng.randint(150, 500))) for _ in range(5)]
    texts = []
    for i in range(60):
        parts = ["".join(rng.choice("abcdefghij klmnoé") for _ in range(rng.randint(0, 600))) for _ in range(2)]
        texts.append((i, parts[0] + (rng.choice(passages) if i % 2 else "") + parts[1]))
    return texts + [(100, "z" * 900), (101, "ab " * 300), (102, texts[0][1]), (103, texts[0][1]), (104, None), (105, ""), (106, "y" * 200)]


@pytest.mark.parametrize("hot", [4_096, 1])
def test_texts_equal_those_by_hand(spark, monkeypatch, hot):
    monkeypatch.setattr(q, "HOT_REGIONS", hot)
    texts = corpus(random.Random(1))
    got = {r["row"]["doc_id"]: r for r in q.without_repeats(edge_docs(spark, texts).repartition(3)).collect()}
    assert len(got) == len(texts)
    for (i, _), (n, kept, spans) in zip(texts, by_hand([t for _, t in texts], q.LENGTH)):
        r = got[i]
        assert (r["n_bytes"], bytes(r["kept"]), [(x["start"], x["end"]) for x in r["spans"]]) == (n, kept, spans), i


def test_edges(spark):
    docs = edge_docs(spark)
    got = q.without_repeats(docs, as_text=True).collect()
    want = by_hand([t for _, t in TEXTS], q.LENGTH)
    key = lambda x: (repr(x[0]), x[1], x[2])
    assert (sorted(((r["row"]["doc_id"], r["n_bytes"], r["kept"]) for r in got), key=key)
            == sorted(((i, n, kept.decode("utf-8", "ignore")) for (i, _), (n, kept, _) in zip(TEXTS, want)), key=key))
    assert set(got[0]["row"].asDict()) == set(docs.columns) - {"text"}
    assert q.without_repeats(docs.limit(0)).count() == 0


def test_repeated_rows_take_linear_time(spark):
    """Many rows of one text, under one id and without any, cost about what as many different texts cost."""
    import time
    text = " ".join(f"word{i * 7919 % 10_007}" for i in range(400))
    seconds = {}
    for name, rows in (("different", [(i, f"{i} {text[:1000]} {i * 31} {text[1000:]}") for i in range(1500)]),
                       ("one id", [(7, text)] * 1500), ("null ids", [(None, text)] * 1500)):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        start = time.time()
        got = q.without_repeats(docs).select("row.doc_id", "n_bytes", F.length("kept").alias("left"), F.size("spans").alias("spans")).collect()
        seconds[name] = time.time() - start
        assert len(got) == 1500
        if name != "different":
            assert {tuple(r) for r in got} == {(rows[0][0], len(text), 0, 1)}
    assert max(seconds["one id"], seconds["null ids"]) < 3 * seconds["different"] + 5, seconds
