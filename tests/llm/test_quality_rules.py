import collections
import re

from edges import TEXTS, edge_docs
from topicspark.llm import quality_rules as q

WORD = r"[^\x20\x09-\x0D]+"


def by_hand(text):
    words = re.findall(WORD, text)
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    again = {j for k in range(len(words) - 2) if seen[tuple(words[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again)}


def test_counts_equal_those_by_hand(spark):
    more = [(20, "a a a a a"), (21, "a b c a b c"), (22, "x\x0by\x0cz\u00a0w\n\n x \n x\nx"), (23, "#*$%&|<> |")]
    docs = edge_docs(spark, TEXTS + more)
    got = [r for r in q.with_stats(docs.select("doc_id", "text")).collect()]
    assert len(got) == len(TEXTS) + len(more)
    for r in got:
        for k, v in by_hand(r["text"] or "").items():
            assert r["_stats"][k] == v, (k, (r["text"] or "")[:40])


def labelled(spark, n=600):
    good = [(i, " ".join(f"w{(i * 37 + k * k) % 9973}" for k in range(80))) for i in range(n)]
    bad = [(n + i, " ".join(f"w{(i * 41 + k * k * 3) % 9967}$$$" for k in range(80))) for i in range(n // 4)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id bigint, quality int")
    return docs, labels


def test_rules_are_learned_and_reject(spark):
    docs, labels = labelled(spark)
    rules = q.learn_from(docs, labels)
    assert rules and all(f in q.FEATURES and op in ("<", ">=") for r in rules for f, op, _ in r)
    kept = {r["doc_id"] for r in q.judged(docs, rules).where("_kept").collect()}
    right = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(kept ^ right) < 10
    assert {r["doc_id"] for r in docs.where(q.keeps(rules)).collect()} == kept


def test_labels_that_teach_nothing(spark):
    docs, labels = labelled(spark, 40)
    assert q.learn_from(docs, labels.where("quality = 1")) == []
    assert q.learn_from(docs, labels.limit(0)) == []
    assert q.learn_from(docs.limit(0), labels) == []


def test_edges(spark):
    docs = edge_docs(spark)
    assert docs.where(q.keeps([])).columns == docs.columns
    kept = sorted(r["doc_id"] for r in docs.where(q.keeps([])).collect())
    assert kept == []        # LONG repeats its windows, all others are short or repeat
    assert q.judged(docs.select("doc_id", "text").limit(0), []).count() == 0
