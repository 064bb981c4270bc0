import random
import re

from edges import TEXTS, edge_docs
from topicspark.llm import licences as q

MORE = [(30, "GNU general-public License; the gnu general public license v3"), (31, "cc by cc by. CC-BY"), (32, "xmit license mit\u00e9 license"),
        (33, "by cc"), (34, "Permission to use, copy, modify, and/or distribute this software"),
        (35, "permission to use copy modify and or distribute this software provided that the above copyright notice"),
        (36, "apache " * 1000 + "license"), (37, "GNU Lesser General Public License")]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def starts(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]


def test_places_and_labels_equal_those_by_hand(spark):
    texts = [(i, t) for i, t in TEXTS + MORE if i is not None] + [(40, "mit licen\u017fe"), (41, "cc by, \u212annown; c\u212a by")]
    got = q.licence_labels(edge_docs(spark, texts), q.TEMPLATES, q.BASE).collect()
    assert len(got) == len(texts)
    for r in got:
        words = words_of(dict(texts)[r["doc_id"]] or "")
        places = sorted(p for t in q.BASE for f in t.phrases for p in starts(words, f))
        has = lambda ts: ",".join(sorted({t.label for t in ts if all(starts(words, f) for f in t.phrases)}))
        assert (r["n_words"], r["n_base"]) == (len(words), len(places)), r["doc_id"]
        assert (r["first_word"], r["last_word"]) == ((places[0], places[-1]) if places else (None, None))
        assert (r["base_labels"], r["labels"]) == (has(q.BASE), has(q.TEMPLATES))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) == bool(r["labels"])


def by_hand(text, templates):
    words = words_of(text or "")
    return ",".join(sorted({t.label for t in templates if all(starts(words, f) for f in t.phrases)}))


def test_many_templates_with_long_phrases_are_fetched_by_a_join(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 30 + ["of"] * 20
    templates = [q.Template(f"t{i}", tuple(" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 14, 40]))) for _ in range(rng.choice([1, 1, 2]))))
                 for i in range(500)]
    texts = []
    for i in range(60):
        words = rng.choices(vocabulary, k=200)
        for t in rng.sample(templates, 3):
            for f in t.phrases:
                at = rng.randrange(150)
                words[at:at] = f.split()
                if rng.random() < 0.3:
                    words[at + len(f.split()) - 1] = "x"
        texts.append((i, "; ".join(words)))
    texts += [(None, texts[0][1]), (None, texts[1][1]), (0, texts[0][1]), (70, "the " * 3000)]
    found = q.licence_labels(edge_docs(spark, texts), templates, templates[:9])
    got = sorted(((r["doc_id"], r["labels"], r["base_labels"], r["n_base"]) for r in found.collect()), key=repr)

    def places(text):
        return sum(len(starts(words_of(text), f)) for t in templates[:9] for f in set(t.phrases))

    assert got == sorted(((i, by_hand(t, templates), by_hand(t, templates[:9]), places(t)) for i, t in texts), key=repr)
    assert sum(bool(g[1]) for g in got) > 40


def test_places_meet_the_postings_by_word(spark):
    phrases = q.phrases_of(q.TEMPLATES)
    filed = q.postings(phrases, {w: len(w) for p in phrases for w in p})
    rows = q.with_places(edge_docs(spark), filed)
    plan = q.phrase_places(rows, phrases, filed)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*w#\d+ = w#\d+", plan)
    assert {(p.phrase, p.piece) for p in filed} == {(i, 0) for i in range(len(phrases))}


def test_equal_rows_and_null_ids(spark):
    texts = [(7, "the MIT license")] * 300 + [(None, "the MIT license")] * 300 + [(None, None)] * 3
    got = q.licence_labels(edge_docs(spark, texts), q.TEMPLATES, q.BASE).groupBy("doc_id", "labels", "n_base", "first_word").count().collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(7, "mit", 1, 1, 300), (None, "mit", 1, 1, 300), (None, "", 0, None, 3)], key=repr)


def test_empty_table_and_no_templates(spark):
    assert [r["labels"] for r in q.licence_labels(edge_docs(spark, [(1, "mit license")]), [], []).collect()] == [""]

    assert q.licence_labels(edge_docs(spark).limit(0), q.TEMPLATES, q.BASE).count() == 0
