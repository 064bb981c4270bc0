import random

import numpy as np
import pytest
from edges import LONG, TEXTS, edge_docs

from topicspark.llm import neardup as q


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def by_hand(texts):
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng, n):
    """Groups of near copies around the threshold, exact copies, short texts, and texts that share half."""
    texts, vocabulary = [], [f"w{i}" for i in range(3_000)]
    for g in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 8, 30, 200, 400]))]
        shared = [rng.choice(vocabulary) for _ in range(len(base))]
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0, 0.01, 0.03, 0.05, 0.1]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        for _ in range(rng.randint(0, 3)):
            texts.append(" ".join(shared + [rng.choice(vocabulary) for _ in range(len(base))]))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_equal_all_pairs(spark):
    texts = near_copies(random.Random(8), 60) + [(5_000, ""), (5_001, None), (5_002, "A b"), (5_003, "a  B"), (5_004, LONG),
                                                 (5_005, LONG.upper() + " end"), (5_006, "a\x0bb c\x0cd e"), (5_007, "a b c d e")]
    got = {r["doc_id"]: r for r in q.near_duplicates(edge_docs(spark, texts)).collect()}
    want = by_hand(texts)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


@pytest.mark.parametrize("edits, block", [(6, 400_000), (9, 400_000), (9, 9_000)])
def test_many_near_copies_of_one_text(spark, monkeypatch, edits, block):
    """Copies of which all, or hardly any, reach the likeness; in one block and in many."""
    monkeypatch.setattr(q, "BLOCK_SHINGLES", block)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(250):
        copy = list(base)
        for _ in range(rng.randint(edits, 2 * edits)):
            copy[rng.randrange(300)] = f"x{rng.randrange(10_000)}"
        texts.append((i, " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in q.near_duplicates(edge_docs(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in by_hand(texts).items()}


def test_estimate_is_unbiased():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        n, both = 400, rng.integers(0, 401)
        x = rng.integers(0, 1 << 63, 2 * n - both, np.uint64)
        a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n:]]))
        ra, rb = q.registers([a, b])
        errors.append(q.estimate(ra, rb, n, n) - both / (2 * n - both))
    assert abs(np.mean(errors)) < 0.015 and np.max(np.abs(errors)) < q.ESTIMATE_SLACK


def test_joining_links_are_enough_and_no_more():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(50, 101)], rng.integers(0, 1 << 60, rng.integers(1, 30)).astype(np.uint64)]))
            for _ in range(60)]
    both = q.intersections(sets[:20], sets[20:])
    assert all(both[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets[:20]) for j, b in enumerate(sets[20:]))
    ids, left = list(range(60)), [i < 20 for i in range(60)]
    links = q.joining_links(ids, ids, sets, left)
    true = [(i, j) for i in range(20) for j in range(20, 60) if q.linked(sets[i], sets[j])]
    assert set(links) <= set(true)

    def parts(pairs):
        root = list(range(60))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return [find(i) == find(j) for i in range(60) for j in range(60)]

    assert parts(links) == parts(true) and len(links) < 60


def test_one_of_each(spark):
    docs = edge_docs(spark)
    out = q.one_of_each(docs)
    assert out.columns == docs.columns
    ids = sorted((r["doc_id"] for r in out.collect()), key=repr)
    # 12 repeats 11; 6 stands twice; both rows without an id stay, their texts differ
    assert ids == sorted([i for i in {i for i, _ in TEXTS} if i not in (12, None)] + [None, None], key=repr)
    assert q.one_of_each(docs.limit(0)).count() == 0


def test_ids_with_several_texts(spark):
    """Every text is compared, under whatever id it stands: rows are held against a comparison of all pairs of texts."""
    rng = random.Random(5)
    texts = [t for _, t in near_copies(rng, 25)]
    rows = [(rng.randrange(40), t) for t in texts] + [(rng.randrange(40), t) for t in rng.sample(texts, 30)]
    rows += [(0, t) for t in texts[:30]] + [(100 + i, t) for i, t in enumerate(texts[:30])] + [(0, None), (0, ""), (0, ""), (1, " "), (None, texts[0])]
    distinct = sorted({t for i, t in rows if i is not None}, key=repr)
    part = {distinct[k]: root for k, (_, root) in by_hand(list(enumerate(distinct))).items()}
    least = {}
    for i, t in rows:
        if i is not None and shingles(t):
            least[part[t]] = min(least.get(part[t], i), i)
    want = [(i, len(shingles(t)), least[part[t]] if i is not None and shingles(t) else i) for i, t in rows]
    got = q.near_duplicates(edge_docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)

    left = [(r["doc_id"], r["text"]) for r in q.one_of_each(edge_docs(spark, rows)).collect()]
    in_parts = [(i, t) for i, t in left if i is not None and shingles(t)]
    assert sorted((part[t], i) for i, t in in_parts) == sorted(least.items()) and set(left) <= set(rows)
    assert sorted(set(left) - set(in_parts), key=repr) == sorted([(0, None), (0, ""), (1, " "), (None, texts[0])], key=repr)
    assert len(left) == len(in_parts) + 4


def test_edges(spark):
    got = q.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r["component_id"] is None) == (r["doc_id"] is None) and (r["kept"] or r["doc_id"] == 12)


def test_links_through_null_ids(spark):
    words = [f"w{i}" for i in range(100)]

    def text(changed):
        return " ".join("x" + w if i in changed else w for i, w in enumerate(words))

    # each text is near to the next one only
    texts = [text(set(range(0, k, 10))) for k in (0, 30, 50)]
    chain = [shingles(t) for t in texts]
    near = [100 * len(a & b) >= 75 * len(a | b) for a, b in (chain[:2], chain[1:], chain[::2])]
    assert near == [True, True, False]
    rows = [(9, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2]), (None, "only without an id, but " * 9), (4, None)]
    rows += [(None, "many rows of one text without an id")] * 500
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in q.near_duplicates(edge_docs(spark, rows)).collect()), key=repr)
    assert got == sorted([(9, 3, False), (3, 3, True), (4, 4, True)] + [(None, None, True)] * 503, key=repr)
    left = [r["doc_id"] for r in q.one_of_each(edge_docs(spark, rows)).collect()]
    assert sorted(left, key=repr) == [3, 4, None, None, None]
