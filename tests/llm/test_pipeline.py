"""Every stage of the pipeline, and its end, against a plain version of the same work."""

import re
import zlib
from array import array
from pathlib import Path

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from edges import edge_docs  # noqa: E402
from test_neardup import by_hand as components_by_hand  # noqa: E402
from test_quality_rules import by_hand as counts_by_hand  # noqa: E402
from test_repeats import by_hand as cut_by_hand  # noqa: E402
from test_secrets import by_hand as secrets_by_hand  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from topicspark.llm import quality_rules, repeats  # noqa: E402

SF = "/root/testdata/sf0.001"


def features(text):
    c = counts_by_hand(text)
    words, lines = max(c["n_words"], 1), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"words": c["n_words"], "word_length": c["word_chars"] / words, "symbols_per_word": c["n_symbols"] / words,
            "repeat_share": c["n_repeat_words"] / words, "dup_line_share": c["n_dup_lines"] / max(len(lines), 1),
            "upper_share": sum(x.isupper() for x in text) / max(c["word_chars"], 1), "bangs_per_word": text.count("!") / words,
            "digits_per_word": len(re.findall("[0-9]", text)) / words}


def passes(text, rules):
    c, f = counts_by_hand(text), features(text)
    if c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]:
        return False
    return not any(all((f[n] >= v) if op == ">=" else (f[n] < v) for n, op, v in rule) for rule in rules)


def redacted_by_hand(text):
    gone = [False] * len(text)
    for a, _, b in secrets_by_hand(text):
        gone[a:b] = [True] * (b - a)
    return re.sub("\0+", "[SECRET]", "".join("\0" if g else c for c, g in zip(text, gone)))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stages_and_run_equal_the_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.learn_from(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    rest = {r["doc_id"]: (r["lang"], r["source"]) for r in docs.collect()}
    plain = [
        lambda t: {i: x for i, x in t.items() if passes(x, rules)},
        lambda t: {i: t[i] for i, (_, c) in components_by_hand(list(t.items())).items() if i == c},
        lambda t: dict(zip(t, [kept.decode("utf-8", "ignore") for _, kept, _ in cut_by_hand(list(t.values()), repeats.LENGTH)])),
        lambda t: {i: redacted_by_hand(x) for i, x in t.items()},
    ]
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        columns = docs.columns
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        want = plain[k](want)
        rows = docs.collect()
        assert docs.columns == columns
        assert {r["doc_id"]: r["text"] for r in rows} == want
        assert len(rows) == len(want) and all((r["lang"], r["source"], r["n_chars"]) == (*rest[r["doc_id"]], len(r["text"])) for r in rows)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by = {}
    for r in cp.run(spark, SF).collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by.keys() == want.keys()
    for i, text in want.items():
        ids, at = library.encode(text, add_special_tokens=False).ids + [cp.END_ID], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            part = array("I", ids[at:at + r["length"]]).tobytes()
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)


def test_edges(spark, tmp_path):
    docs = edge_docs(spark)
    spark.createDataFrame([(5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
