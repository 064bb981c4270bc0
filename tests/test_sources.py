import json

import numpy as np
import pyarrow as pa
import pytest

from topicspark.functions import scalars
from topicspark.functions.special import digamma, lgamma, np_digamma, np_lgamma
from topicspark.operators import corpus, indexing, matrix, ranking
from topicspark.plans import gibbs, infer, online_vb
from topicspark.plans.minibatch import prepare_batches, start_model
from topicspark.queries import model_queries, text_queries  # noqa: F401
from topicspark.queries.base import QUERIES
from topicspark.session import Scratch, scratch_root
from topicspark.sources import exports, raw, snapshots, text
from topicspark.streaming import online as stream
from tests import loops

from pyspark.sql import functions as F


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_vocabulary_lines_keep_order_and_repeats(spark, scratch, tmp_path):
    path = write(tmp_path / "in" / "vocab.txt", "zeta\nalpha\r\nzeta\n\nbeta\n")
    got = pairs(text.read_vocabulary(spark, path, scratch), "word_id", "term")
    assert got == [(0, "zeta"), (1, "alpha"), (2, "zeta"), (3, ""), (4, "beta")]


def test_line_numbers_follow_files_and_splits(spark, tmp_path):
    for i in range(3):
        write(tmp_path / "in" / f"part-{i}.txt", "".join(f"{i}-{j}\n" for j in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = pairs(text.read_vocabulary(spark, str(tmp_path / "in"), Scratch(spark, base=str(tmp_path / "s"))),
                    "word_id", "term")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(500 * i + j, f"{i}-{j}") for i in range(3) for j in range(500)]


@pytest.mark.parametrize("policy, freq", [("sum", 7), ("last", 5), ("presence", 1)])
def test_repeated_word_numbers(spark, scratch, tmp_path, policy, freq):
    path = write(tmp_path / "in" / "c.dat", "d1 3 0:2 7:1 0:5\nd2 0\n")
    docs = text.read_documents(spark, path, scratch)
    assert pairs(docs.select("doc_id", "doc_name"), "doc_id", "doc_name") == [(0, "d1"), (1, "d2")]
    assert pairs(text.bag_of_words(docs, policy), "doc_id", "word_id", "freq") == [(0, 0, freq), (0, 7, 1)]
    assert pairs(text.token_length(docs), "doc_id", "n_tokens") == [(0, 8), (1, 0)]
    assert text.file_row_count(spark, path) == 2


def test_positions_come_after_the_blank_line_filter(spark, scratch, tmp_path):
    path = write(tmp_path / "in" / "c.dat", "a 1 0:1\n\nx\nb 1 1:2\n  c   1\t2:3  \n")
    docs = text.read_documents(spark, path, scratch)
    assert pairs(docs, "doc_id", "doc_name") == [(0, "a"), (1, "b"), (2, "c")]
    assert pairs(text.bag_of_words(docs), "doc_id", "word_id", "freq") == [(0, 0, 1), (1, 1, 2), (2, 2, 3)]


def test_unknown_word_numbers_are_set_apart(spark):
    bow = spark.createDataFrame([(0, 0, 1), (0, 9, 2), (1, 1, 1)], "doc_id long, word_id int, freq int")
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "word_id int, term string")
    good, bad = corpus.reject_unknown_words(bow, vocab)
    assert (good.count(), pairs(bad, "word_id", "freq")) == (2, [(9, 2)])


def test_matrix_and_vector_files(spark, scratch, tmp_path):
    m = text.read_matrix(spark, write(tmp_path / "in" / "m.txt", "1 2.5 3\n4 5 -6e-1\n"), scratch)
    assert pairs(m, "row", "col", "value") == [(0, 0, 1.0), (0, 1, 2.5), (0, 2, 3.0), (1, 0, 4.0), (1, 1, 5.0), (1, 2, -0.6)]
    v = text.read_vector(spark, write(tmp_path / "in2" / "v.txt", "3\n1.5\n"), scratch)
    assert pairs(v, "idx", "value") == [(0, 3.0), (1, 1.5)]


def test_corpus_from_text(spark, scratch):
    docs = spark.createDataFrame([(4, "The cat, the DOG"), (9, "Été! the"), (11, "12 34")], "doc_id long, text string")
    c = raw.corpus_from_text(docs, scratch=scratch)
    assert pairs(c.vocab, "word_id", "term", "df") == [(0, "cat", 1), (1, "dog", 1), (2, "the", 2), (3, "été", 1)]
    assert pairs(c.bow, "doc_id", "word_id", "freq") == [(4, 0, 1), (4, 1, 1), (4, 2, 2), (9, 2, 1), (9, 3, 1)]
    assert pairs(raw.corpus_from_text(docs, min_df=2, scratch=Scratch(spark)).vocab, "term") == [("the",)]


def test_dense_index_is_dense_and_ordered(spark, scratch):
    ids = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 100003 as id").repartition(5)
    got = indexing.dense_index(ids, ["id"], "n", scratch).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(5000))
    assert [r["id"] for r in got] == sorted(r["id"] for r in got)


def test_a_huge_frequency_is_expanded_in_runs(spark):
    bow = spark.createDataFrame([(0, 3, 25_001), (1, 3, 1), (1, 4, 0)], "doc_id long, word_id int, freq int")
    out = corpus.expand_tokens(bow)
    assert out.count() == 25_002
    assert out.where("doc_id = 0").agg(F.count_distinct("occ"), F.max("occ")).first()[:] == (25_001, 25_000)


def test_document_blocks_cover_all_documents(spark):
    for n_docs, n_blocks in [(10, 3), (8, 8), (5, 8), (100, 1), (1, 1)]:
        docs = spark.range(n_docs).select(F.col("id"), corpus.block_of(F.col("id"), n_docs, n_blocks).alias("b"))
        got = [r["b"] for r in docs.orderBy("id").collect()]
        assert got == sorted(got) and min(got) == 0 and max(got) <= n_blocks - 1
        assert len(got) == n_docs


def test_estimated_corpus_size_uses_the_first_documents_only(spark):
    lengths = spark.range(250).select(F.col("id").alias("doc_pos"), F.when(F.col("id") < 100, 4).otherwise(99).alias("n_tokens"))
    assert corpus.corpus_tokens_estimate(lengths).first()["n_tokens"] == 1000.0
    assert corpus.corpus_tokens_estimate(lengths.where("doc_pos < 7")).first()["n_tokens"] == 28.0


def test_ranking_ties_short_groups_and_large_n(spark):
    cells = spark.createDataFrame([(0, 5, 2.0), (0, 1, 2.0), (0, 3, 9.0), (1, 2, 1.0)], "topic int, word_id int, value double")
    assert pairs(ranking.top_n(cells, 2), "topic", "rank", "word_id") == [(0, 1, 3), (0, 2, 1), (1, 1, 2)]
    many = spark.range(5000).select((F.col("id") % 2).cast("int").alias("topic"), F.col("id").cast("int").alias("word_id"),
                                    (F.col("id") % 97).cast("double").alias("value"))
    got = ranking.top_n(many, 1500)
    want = many.toPandas().sort_values(["topic", "value", "word_id"], ascending=[True, False, True]).groupby("topic").head(1500)
    assert pairs(got, "topic", "word_id") == sorted(zip(want["topic"], want["word_id"]))


def test_special_functions_are_accurate(spark):
    import math
    xs = [0.01, 0.1, 0.5, 1.0, 1.5, 2.0, 7.3, 40.0, 1e4, 1e7]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", digamma(F.col("x")).alias("d"), lgamma(F.col("x")).alias("l"))
    for r in df.collect():
        assert abs(r["l"] - math.lgamma(r["x"])) <= 1e-10 * max(1.0, abs(r["l"]))
        h = 1e-5 * max(1.0, r["x"])
        if r["x"] >= 0.5:
            assert abs(r["d"] - (math.lgamma(r["x"] + h) - math.lgamma(r["x"] - h)) / (2 * h)) < 1e-5
        assert abs(r["d"] - np_digamma(r["x"])) < 1e-11
        assert abs(r["l"] - np_lgamma(r["x"])) <= 1e-12 * max(1.0, abs(r["l"]))
    assert abs(np_digamma(1.0) + 0.5772156649015329) < 1e-11


def test_strip_xml_handles_null(spark):
    df = spark.createDataFrame([("a\x00b\tc",), (None,), ("x\U0001F600y",)], "s string")
    assert [r[0] for r in df.select(scalars.strip_xml(F.col("s"))).collect()] == ["ab\tc", "", "xy"]


def test_model_text_and_parquet_snapshots(spark, tmp_path):
    model = spark.createDataFrame([(0, [1.0, 2.5]), (2, [5.0, 6.0]), (1, [3.0, 4.0])], "word_id int, params array<double>")
    base = str(tmp_path / "m")
    snapshots.write_model(model, base, 3)
    snapshots.write_model(model.limit(1), base, 3)
    snapshots.write_model(model, base, 4)
    assert snapshots.read_model(spark, base, 3).count() == 1
    assert snapshots.read_all_versions(spark, base).where("t = 4").count() == 3
    snapshots.write_topic_text(model, str(tmp_path / "text"))
    lines = [f.read_text() for f in (tmp_path / "text").glob("part-*")]
    parsed = dict(line.split("\t") for part in lines for line in part.splitlines())
    assert {k: json.loads(v) for k, v in parsed.items()} == {"0": [1.0, 3.0, 5.0], "1": [2.5, 4.0, 6.0]}
    assert pairs(snapshots.read_topic_text(spark, str(tmp_path / "text")), "topic", "word_id", "value") == [
        (0, 0, 1.0), (0, 1, 3.0), (0, 2, 5.0), (1, 0, 2.5), (1, 1, 4.0), (1, 2, 6.0)]


def test_topic_text_has_one_line_per_topic(spark, tmp_path):
    model = spark.range(2500).selectExpr("cast(id as int) word_id", "array(id + 0.5D, id * 2D) params")
    path = str(tmp_path / "text")
    snapshots.write_topic_text(model, path)
    assert sorted(line.split("\t")[0] for line in content(tmp_path / "text")) == ["0", "1"]
    got = pairs(snapshots.read_topic_text(spark, path), "topic", "word_id", "value")
    assert got == [(0, w, w + 0.5) for w in range(2500)] + [(1, w, w * 2.0) for w in range(2500)]


def test_topic_runs_are_bounded_and_ordered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "RUN", 1000)
    monkeypatch.setattr(snapshots, "LINE_WORDS", 2499)
    model = spark.range(2500).selectExpr("cast(id as int) word_id", "array(id + 0.5D, id * 2D) params")
    path = str(tmp_path / "runs")
    snapshots.write_topic_runs(model, path)
    lines = [line.split("\t") for f in sorted((tmp_path / "runs").glob("part-*")) for line in f.read_text().splitlines()]
    assert [(int(k), int(w), len(json.loads(v))) for k, w, v in lines] == [
        (k, w, n) for k in (0, 1) for w, n in ((0, 1000), (1000, 1000), (2000, 500))]
    got = pairs(snapshots.read_topic_runs(spark, path), "topic", "word_id", "value")
    assert got == [(0, w, w + 0.5) for w in range(2500)] + [(1, w, w * 2.0) for w in range(2500)]
    with pytest.raises(ValueError, match="write_topic_runs"):
        snapshots.write_topic_text(model, str(tmp_path / "text"))


def test_alpha_is_stored_and_has_an_explicit_default(spark, tmp_path):
    snapshots.write_params(spark, str(tmp_path / "p"), [0.1, 0.2], beta=0.01, eta=0.5)
    assert snapshots.read_alpha(spark, str(tmp_path / "p"), 2) == [0.1, 0.2]
    assert snapshots.read_alpha(spark, str(tmp_path / "none"), 3, default=0.01) == [0.01] * 3
    with pytest.raises(Exception):
        snapshots.read_alpha(spark, str(tmp_path / "none"), 3)
    snapshots.write_alpha_json(spark, str(tmp_path / "j"), [0.25, 3.0])
    assert snapshots.read_alpha_json(spark, str(tmp_path / "j")) == [0.25, 3.0]


def test_keyed_output_and_named_files(spark, tmp_path):
    rows = spark.createDataFrame([("lambda", 1), ("perp", 2), ("lambda", 3)], "kind string, v int")
    snapshots.write_by_kind(rows, str(tmp_path / "k"))
    assert pairs(snapshots.read_kind(spark, str(tmp_path / "k"), "lambda"), "v") == [(1,), (3,)]
    write(tmp_path / "f" / "lambda-0", "a\n")
    write(tmp_path / "f" / "sub" / "lambda-1", "b\n")
    write(tmp_path / "f" / "alpha-0", "c\n")
    assert pairs(snapshots.read_named_files(spark, str(tmp_path / "f"), "lambda"), "value") == [("a",), ("b",)]


def content(path):
    return [line for f in sorted(path.glob("part-*")) for line in f.read_text().splitlines()]


def test_exports(spark, tmp_path):
    m = spark.createDataFrame([(0, 1, 2.0), (2, 0, 7.0), (1, 1, 1.0)], "row long, col int, value double")
    exports.write_matrix_csv(m, 2, str(tmp_path / "a"), integer=True)
    assert content(tmp_path / "a") == ["0,2", "0,1", "7,0"]
    labels = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "row long, label string")
    exports.write_labelled_csv(m, labels, 2, str(tmp_path / "b"))
    assert content(tmp_path / "b") == ['"x",0,2', '"y",0,1', '"z",7,0']
    more = labels.union(spark.createDataFrame([(3, "w")], labels.schema))
    exports.write_labelled_csv(m, more, 2, str(tmp_path / "b0"))
    assert content(tmp_path / "b0") == ['"x",0,2', '"y",0,1', '"z",7,0']
    exports.write_labelled_csv(m, more, 2, str(tmp_path / "b1"), rows=more)
    assert content(tmp_path / "b1") == ['"x",0,2', '"y",0,1', '"z",7,0', '"w",0,0']
    exports.write_matrix_csv(m, 2, str(tmp_path / "c"))
    assert content(tmp_path / "c") == ["0.0,2.0", "0.0,1.0", "7.0,0.0"]
    wide = spark.createDataFrame([(1, "p", "q"), (2, "r", None)], "rank int, topic_0 string, topic_1 string")
    exports.write_ranking_file(wide, 2, str(tmp_path / "d"))
    assert content(tmp_path / "d") == ["Topic 0,Topic 1,", "p,q,", "r,,"]
    rows = spark.createDataFrame([(1, "a,b"), (0, "c")], "topic int, words string")
    exports.write_topic_rows(rows, str(tmp_path / "e"))
    assert content(tmp_path / "e") == ["0,c", "1,a,b"]
    docs = spark.createDataFrame([(3, [1.0, 0.5]), (1, [0.0, 2.0])], "doc_id long, theta array<double>")
    exports.write_doc_topics(docs, str(tmp_path / "f"))
    assert content(tmp_path / "f") == ["0.0,2.0", "1.0,0.5"]
    exports.write_hyper_parameters(spark, [0.1, 0.2], 0.01, str(tmp_path / "g"))
    assert content(tmp_path / "g") == ["0.1,0.2", "0.01"]


def test_matrix_functions_equal_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(0.2, 3.0, (4, 5))
    m = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(4) for j in range(5)], "row long, col int, value double")

    def back(df):
        out = np.zeros((4, 5))
        for r in df.collect():
            out[r["row"], r["col"]] = r["value"]
        return out

    np.testing.assert_allclose(back(matrix.normalise(m, "row")), a / a.sum(1, keepdims=True))
    np.testing.assert_allclose(back(matrix.normalise(m, "col")), a / a.sum(0))
    np.testing.assert_allclose(back(matrix.softmax_rows(m)), np.exp(a) / np.exp(a).sum(1, keepdims=True))
    np.testing.assert_allclose(back(matrix.dirichlet_expectation(m, "row")), np_digamma(a) - np_digamma(a.sum(1))[:, None])
    v = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([1, 2, 3, 4])], "vec long, idx int, value double")
    assert [r["value"] for r in matrix.flip_cumsum(v).orderBy("idx").collect()] == [4.0, 7.0, 9.0, 0.0]
    arrays = {r["row"]: r["values"] for r in matrix.to_arrays(m.where("col <> 2"), 5).collect()}
    assert arrays[1][2] == 0.0 and arrays[1][4] == a[1, 4]


def test_scratch_folder_is_the_configured_one(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before:
        assert scratch_root(spark) == before
        assert Scratch(spark, "x").base.startswith(before)
    else:
        assert scratch_root(spark)


def test_stream_equals_batch_run_and_survives_a_restart(spark, scratch, tmp_path):
    docs = loops.planted(30)
    bow = spark.createDataFrame(loops.bow_rows(docs), "doc_id long, word_id int, freq int")
    words = spark.range(100).selectExpr("cast(id as int) as word_id")
    batches = prepare_batches(bow, 100, 10, scratch)
    cfg = online_vb.OnlineVB(3, tau0=2.0, max_iter=5, init="hash")
    want = {r["word_id"]: r["params"] for r in online_vb.fit(batches, words, cfg).model.collect()}
    folder = str(tmp_path / "in")
    run, mark = str(tmp_path / "run"), str(tmp_path / "mark")
    for t in range(3):
        part = batches.bow.where(f"batch_id = {t}").groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.struct("word_id", "freq"))).alias("x"))
        part.select("doc_id", F.col("x.word_id").alias("words"), F.col("x.freq").alias("freqs")) \
            .coalesce(1).write.mode("append").parquet(folder)
        if t != 1:          # the second and third file are taken by one restart of the query
            q = stream.train_stream(stream.document_stream(spark, folder), words, 100, 30, cfg, run, mark)
            q.awaitTermination()
    got = {r["word_id"]: r["params"] for r in stream.fitted_model(spark, run).collect()}
    for w in want:
        np.testing.assert_allclose(got[w], want[w], rtol=1e-9)


def test_more_topics_than_are_spelled_out(spark, scratch):
    from topicspark.plans import cvb0
    docs = loops.tiny_corpus()
    bow = spark.createDataFrame(loops.bow_rows(docs), "doc_id long, word_id int, freq int")
    fit = cvb0.fit(bow, 6, cvb0.CVB0(70, n_sweeps=1, init="hash", seed=2))
    start = {}
    for d, ws in docs.items():
        for w in ws:
            u = np.array([loops.uniform(2, d, w, t) for t in range(70)])
            start[d, w] = u / u.sum()
    want = loops.cvb0_sweep_sync(start, docs, 6, 70, 0.01, 0.01)
    for r in fit.phi.collect():
        np.testing.assert_allclose(r["phi"], want[r["doc_id"], r["word_id"]], rtol=1e-9)
    assert start_model(spark.range(3).withColumnRenamed("id", "word_id"), 70, 1, "hash").count() == 3
    g = gibbs.fit(bow, 6, gibbs.Gibbs(70, n_sweeps=1))
    assert infer.counted_doc_topics(g.doc_topic, 70).count() == 4


def test_repeated_and_missing_ids_are_one_document_each(spark, scratch):
    rows = [(1, "a b a"), (1, "b c"), (2, None), (3, ""), (None, "a d"), (None, "d"), (4, "12 34")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    c = raw.corpus_from_text(docs, scratch=scratch)
    terms = {r["word_id"]: r["term"] for r in c.vocab.collect()}
    got = sorted(((r["doc_id"], terms[r["word_id"]], r["freq"]) for r in c.bow.collect()), key=repr)
    assert got == sorted([(1, "a", 2), (1, "b", 2), (1, "c", 1), (None, "a", 1), (None, "d", 2)], key=repr)
    assert {r["term"]: r["df"] for r in c.vocab.collect()} == {"a": 2, "b": 1, "c": 1, "d": 1}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("topicspark_")]
    empty = raw.corpus_from_text(docs.limit(0), scratch=Scratch(spark))
    assert empty.vocab.count() == 0 and empty.bow.count() == 0


def exchanged(df):
    """The columns of every exchange of a plan."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_packed_rows_stay_in_their_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(raw, "TERMS_PER_BLOCK", 40)
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + (i * j) % 26)}" for j in range(20))) for i in range(300)], "doc_id long, text string")
    packed, tables = raw.counted(docs, scratch)
    vocab = scratch.save(raw.build_vocabulary(packed, scratch), "v")
    bow = raw.encode(packed, vocab, tables)
    plan = bow._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and not any("terms" in line or "doc_id" in line for line in exchanged(bow))
    want = {(i, f"w{chr(97 + (i * j) % 26)}") for i in range(300) for j in range(20)}
    terms = {r["word_id"]: r["term"] for r in vocab.collect()}
    assert {(r["doc_id"], terms[r["word_id"]]) for r in bow.collect()} == want


def test_a_batch_of_documents_is_counted_in_bounded_pieces(monkeypatch):
    words = [["b", "a", "b"], [], None, ["c"] * 7, ["a", "c"], ["d"], [], ["a"] * 3]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, None, 5, 6, 7, 8]), pa.array(words, pa.list_(pa.string()))], ["doc_id", "words"])
    monkeypatch.setattr(raw.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 2})())
    monkeypatch.setattr(raw, "TERMS_PER_BLOCK", 2)
    seen = []
    for most in (1000, 3):
        monkeypatch.setattr(raw, "WORDS_AT_ONCE", most)
        parts = list(raw._count_rows([batch, batch.slice(1, 4)]))
        rows = [r for part in parts for r in part.to_pylist()]
        seen.append([(r["block"], r["doc_id"], sorted(zip(r["terms"], r["freqs"]))) for r in rows])
        assert most == 1000 or max(sum(sum(f) for f in part.column("freqs").to_pylist()) for part in parts) <= 7   # a long document is whole
        assert most == 1000 or len(parts) > 4
    assert seen[0] == seen[1] and [x[1] for x in seen[0]] == [1, None, 5, 6, 8, None, 5]


def test_documents_are_handed_over_in_batches_of_bounded_bytes(spark, scratch, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), b.column(0).slice(0, 1), pa.array([[]], pa.list_(pa.string())),
                                              pa.array([[b.num_rows]], pa.list_(pa.int32()))], ["block", "doc_id", "terms", "freqs"])

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 100).alias("text")).repartition(8, "doc_id")
    monkeypatch.setattr(raw, "_count_rows", sizes)
    monkeypatch.setattr(raw, "BYTES_AT_ONCE", 100_000)
    packed, tables = raw.counted(docs, scratch)
    got = [(r["block"], r["freqs"][0]) for r in packed.collect()]
    tables.drop_all()
    assert sum(n for _, n in got) == 4000 and max(size for size, _ in got) < 120_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_words_in_place_meet_their_numbers_by_document(spark, scratch):
    rows = [(1, "b a b é Z"), (2, None), (3, "12"), (4, "z y z x x z"), (5, "a b"), (5, "c a"), (None, "q a"), (7, "only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    c = raw.corpus_from_text(docs, scratch=scratch)
    number = {r["term"]: r["word_id"] for r in c.vocab.collect()}
    placed = raw.words_in_place(docs, c)
    got = {r["doc_id"]: list(zip(r["words"], r["places"] or range(len(r["words"])))) for r in placed.collect()}
    want = {}
    for d, text in rows:
        found = [(number[w], p) for p, w in enumerate((text or "").lower().split()) if w.isalpha()]
        want[d] = sorted(want.get(d, []) + found, key=lambda x: (x[1], x[0]))
    assert got == {d: x for d, x in want.items() if x}
    single = raw.words_in_place(docs.where("doc_id in (1, 2, 3, 4, 7)"), c)
    assert not any("term" in line for line in exchanged(single))


def test_a_corpus_without_some_terms_is_refused(spark, scratch):
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not hold every term"):
        raw.words_in_place(docs, raw.corpus_from_text(docs, min_df=2, scratch=scratch)).collect()


def test_words_of_a_file_are_added_up_where_their_document_lies(spark, scratch):
    rows = [(d, f"d{d}", [(d % 3, 1, 0), (d % 3, 2, 1), (5, 1, 2)]) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, doc_name string, pairs array<struct<word_id:int,freq:int,pos:int>>")
    bag = text.bag_of_words(docs)
    assert [line for line in exchanged(bag) if "hashpartitioning(doc_id" in line] == exchanged(bag) and len(exchanged(bag)) == 1
    assert sorted(map(tuple, bag.collect())) == sorted((d, w, n) for d in range(20) for w, n in ((d % 3, 3), (5, 1)))


def test_full_splits_are_dealt_to_several_buckets(spark, scratch):
    rows = [(i, f"word{'abcdefgh'[i % 8]} same same") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id")
    packed, tables = raw.counted(docs, scratch)
    assert tables.n_buckets == 8 * (128 << 20) // raw.BYTES_PER_BUCKET
    vocab = raw.build_vocabulary(packed, scratch)
    bow = raw.encode(packed, vocab, tables).join(vocab, "word_id").select("doc_id", "term", "freq").collect()
    tables.drop_all()
    assert sorted(map(tuple, bow)) == sorted([(i, f"word{'abcdefgh'[i % 8]}", 1) for i in range(80)] + [(i, "same", 2) for i in range(80)])


def test_estimate_splits_the_first_documents_only(spark):
    from topicspark.operators.corpus import tokens_estimate_from_text
    docs = spark.createDataFrame([(i * 3, "x " * (i % 7) if i % 5 else None) for i in range(1000)], "doc_id long, text string")
    seen = spark.sparkContext.accumulator(0)

    def words(text):
        def count(t):
            seen.add(1)
            return len((t or "").split())
        return F.udf(count, "int")(text)

    got = tokens_estimate_from_text(docs, words).first()["n_tokens"]
    assert seen.value == 100 and abs(got - 1000 * sum(i % 7 if i % 5 else 0 for i in range(100)) / 100) < 1e-9
    assert abs(tokens_estimate_from_text(docs, raw.n_words_of).first()["n_tokens"] - got) < 1e-9
    assert tokens_estimate_from_text(docs.limit(0), raw.n_words_of).first()["n_tokens"] is None


def test_a_step_reads_only_its_files(spark, scratch):
    from topicspark.plans.minibatch import prepare_batches
    bow = spark.createDataFrame([(i, i % 5, 1) for i in range(40)], "doc_id long, word_id int, freq int")
    b = prepare_batches(bow, 5, 8, scratch)
    for part in (b.docs, b.bow):
        here = part.where("batch_id = 2")
        files = here.select(F.input_file_name()).distinct().collect()
        assert files and all("batch_id=2" in r[0] for r in files) and here.count() == 8
        assert "PartitionFilters: [isnotnull(batch_id" in here._jdf.queryExecution().executedPlan().toString()


def test_catalog_entries_go_with_their_tables(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of {'abc'[i % 3]}") for i in range(9)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = {t.name for t in spark.catalog.listTables()}
    made = [QUERIES[name](spark, str(tmp_path)) for name in ("bow", "vocab", "vocab_min_df")]
    assert not {t.name for t in spark.catalog.listTables()} - before
    assert [df.count() for df in made] == [36, 6, 3]
