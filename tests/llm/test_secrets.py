import hashlib
import re

from edges import TEXTS, edge_docs, rows_by
from topicspark import session
from topicspark.llm import secrets as s

MORE = [(20, "token=password:abcdefghijklmnop"), (21, "AKIA" + "Z" * 13), (22, "é😀 AKIA" + "Z" * 14 + " 0123456789abcdef"),
        (23, "a" * 15 + "g" + "a" * 16), (24, "API_KEY : \"abc/def+ghi=jkl\" secret='shortone' Token=0123456789abcdef0123"),
        (25, "xghp_" + "a1" * 20 + " -----BEGIN RSA PRIVATE KEY-----"), (26, "0123456789abcdef 0123456789abcdef")]


def by_hand(text):
    out = []
    for k, r in enumerate(s.RULES):
        for m in re.finditer(r.regex, text):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), k, r.kind, m.end()))
    return [(a, kind, b) for a, _, kind, b in sorted(out)]


def test_spans_equal_those_by_hand(spark):
    texts = TEXTS + MORE
    paths, _ = s.scan_paths(s.versions_of(edge_docs(spark, texts)))
    got = sorted(((r["path"], [(x["start"], x["kind"], x["end"]) for x in r["spans"]]) for r in paths.collect()), key=repr)
    assert got == sorted(((i, by_hand(t or "")) for i, t in texts), key=repr)


def test_only_unseen_pairs_are_scanned(spark):
    docs = edge_docs(spark, MORE)
    versions = s.versions_of(docs)
    paths, entries = s.scan_paths(versions)
    ledger = spark.createDataFrame(entries.collect(), entries.schema)
    assert ledger.count() == len(MORE) * len(s.RULES)
    assert s.pending(versions, s.RULES, ledger).count() == 0
    again, fresh = s.scan_paths(versions, s.RULES, ledger)
    assert fresh.count() == 0
    assert rows_by(again, "path", "spans") == rows_by(paths, "path", "spans")
    newer = [s.Rule("hex", 2, "[0-9a-f]+", 0, 15) if r.kind == "hex" else r for r in s.RULES]
    todo = s.pending(versions, newer, ledger)
    assert {tuple(r["todo"]) for r in todo.collect()} == {("hex@2",)}
    found, _ = s.scan_paths(versions, newer, ledger)
    spans = {r["path"]: [x["kind"] for x in r["spans"]] for r in found.collect()}
    assert spans[23] == ["hex", "hex"] and "access" in spans[22]


def test_query_and_redaction_write_the_ledger(spark, tmp_path, monkeypatch):
    """A row for each pair of blob and rule version, empty ones too; with that table a second scan has nothing to do."""
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(tmp_path / "shared"))
    docs = edge_docs(spark, TEXTS + MORE)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    s.op2_secret_scan(spark, str(tmp_path))
    s.without_secrets(docs)
    folders = list((tmp_path / "shared").glob("secrets-*/ledger"))
    assert len(folders) == 2
    texts = {t or "" for _, t in TEXTS + MORE}
    versions = s.versions_of(docs)
    want = rows_by(s.scan_paths(versions)[0], "path", "spans")
    for folder in folders:
        ledger = spark.read.parquet(str(folder))
        got = {(r["blob"], r["rule"]): [(x["start"], x["end"]) for x in r["spans"]] for r in ledger.collect()}
        assert ledger.count() == len(got) == len(texts) * len(s.RULES)
        for t in texts:
            for r in s.RULES:
                assert got[hashlib.sha256(t.encode()).hexdigest(), r.name] == [(a, b) for a, kind, b in by_hand(t) if kind == r.kind]
        again, fresh = s.scan_paths(versions, s.RULES, ledger)
        assert fresh.count() == 0 and rows_by(again, "path", "spans") == want


def test_history_is_scanned_once_per_blob(spark):
    rows = [("a", 1, "AKIA" + "Q" * 16), ("a", 2, "clean"), ("b", 1, "AKIA" + "Q" * 16)]
    versions = s.versions_of(spark.createDataFrame(rows, "path string, n bigint, text string"), "path", "text", "n")
    assert s.pending(versions, s.RULES, None).count() == 2
    found, _ = s.scan_paths(versions)
    assert sorted((r["path"], r["version"], len(r["spans"])) for r in found.collect()) == [("a", 1, 1), ("a", 2, 0), ("b", 1, 1)]


def test_null_paths_and_versions(spark):
    """A secret under a null id alone, one shared with a real id, and an id with two texts."""
    alone, shared, other = "AKIA" + "N" * 16, "é AKIA" + "S" * 16, "token=abcdefghijklmnop"
    rows = [(None, 1, alone), (None, 1, shared), (5, 1, shared), (6, None, other), (6, None, shared), (6, 1, "clean"),
            (None, None, "hex 0123456789abcdef"), (7, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, n bigint, text string")
    paths, entries = s.scan_paths(s.versions_of(docs, version="n"))
    got = [(r["path"], r["version"], [(x["start"], x["kind"], x["end"]) for x in r["spans"]]) for r in paths.collect()]
    assert sorted(got, key=repr) == sorted(((i, n, by_hand(t or "")) for i, n, t in rows), key=repr)
    assert entries.where("size(spans) > 0").count() == 4
    clean = sorted(((r["doc_id"], r["text"]) for r in s.without_secrets(docs).collect()), key=repr)
    mark = {alone: "[SECRET]", shared: "é [SECRET]", other: "[SECRET]", "hex 0123456789abcdef": "hex [SECRET]"}
    assert clean == sorted(((i, mark.get(t, t)) for i, _, t in rows), key=repr)


def test_redaction(spark):
    docs = edge_docs(spark, TEXTS + MORE)
    out = s.without_secrets(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, t in TEXTS + MORE:
        if i is not None and t is not None:
            gone = [False] * len(t)
            for a, _, b in by_hand(t):
                gone[a:b] = [True] * (b - a)
            want = re.sub("\0+", "[SECRET]", "".join("\0" if g else c for c, g in zip(t, gone)))
            assert got[i] == want
    assert got[1] is None
    assert s.without_secrets(docs.limit(0)).count() == 0


def test_query_digest(spark, tmp_path):
    edge_docs(spark, MORE).write.parquet(str(tmp_path / "documents.parquet"))
    for r in s.op2_secret_scan(spark, str(tmp_path)).collect():
        spans = [(k, a, b) for a, k, b in by_hand(dict(MORE)[r["doc_id"]])]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for k, _, _ in spans) for x in ("assign", "access", "hex"))


def test_texts_without_findings_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "nothing here"), (2, "AKIA" + "B" * 20), (3, "AKIA" + "B" * 20), (4, None)], "doc_id long, text string")
    v = s.versions_of(docs)
    found = s.scan(v, s.pending(v, s.RULES, None), s.RULES)
    assert [(r["rule"], r["start"], r["end"]) for r in found.collect()] == [("access@1", 0, 24)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("RLIKE") > plan.rindex("first(text")              # the filter stands below the exchange by content address
    everything = s.new_entries(s.pending(v, s.RULES, None), found)
    assert everything.count() == 3 * len(s.RULES)                  # and yet every pair of blob and rule is in the ledger
