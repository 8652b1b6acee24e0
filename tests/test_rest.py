"""Statistics, text, classifier, sources, streaming and the query catalog."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, rows, vectors
from vecspark.catalog import ORACLE, QUERIES
from vecspark.functions import text as X
from vecspark.functions.sketcher import Fed, Sketcher
from vecspark.functions.vectors import get_metric
from vecspark.operators import classify as C
from vecspark.operators import generate as G
from vecspark.operators import kmeans as K
from vecspark.operators import stats as A
from vecspark.operators import textvec as V
from vecspark.sources import io
from vecspark.streaming import clusters as T


# ---- statistics -------------------------------------------------------------------------------

@pytest.mark.parametrize("d", [3, 40])
def test_centroid_and_spread_forms(spark, d):
    rng = np.random.default_rng(d)
    x, w, g = rng.normal(size=(90, d)), rng.uniform(1, 2, 90), rng.integers(0, 3, 90)
    df = spark.createDataFrame([(i, x[i].tolist(), float(w[i]), int(g[i])) for i in range(90)],
                               "id bigint, vec array<double>, weight double, g int").repartition(4)
    got = rows(A.weighted_centroid(df, "g"), "g")
    sd = rows(A.cluster_spread(df, "g"), "g")
    for i in range(3):
        m = g == i
        assert np.allclose(got["vec"][i], (x[m] * w[m, None]).sum(0) / w[m].sum())
        assert np.isclose(got["weight"][i], w[m].sum())
        assert np.isclose(sd["spread"][i], x[m].std(0).mean())
    one = A.weighted_centroid(df).first()
    assert np.allclose(one["vec"], (x * w[:, None]).sum(0) / w.sum())
    assert np.isclose(A.total_sq_radius(df).first()[0], ((x - (x * 1).mean(0)) ** 2).sum())


def test_quartiles_with_one_crowded_group(spark):
    rng = np.random.default_rng(2)
    v = {"big": np.append(rng.normal(size=500), np.full(300, 0.25)), "small": rng.normal(size=7), "one": np.array([3.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in xs] + [("none", None)],
                               "k string, x double").repartition(5)
    got = rows(A.summary_quartiles(df, "x", "k"), "k").set_index("k")
    for k, xs in v.items():
        assert np.allclose(got.loc[k, [f"q{i}" for i in range(5)]].astype(float), np.quantile(xs, [0, .25, .5, .75, 1]))
    assert np.isclose(A.summary_quartiles(df, "x").first()["q2"], np.median(np.concatenate(list(v.values()))))
    near = rows(A.summary_quartiles(df, "x", "k", accuracy=10000), "k").set_index("k")
    assert abs(near.loc["big", "q1"] - got.loc["big", "q1"]) < 0.05


def test_label_ids_follow_first_appearance(spark):
    df = spark.createDataFrame([(5, "a"), (1, "c"), (3, "b"), (9, "c")], "id bigint, label string")
    assert [r["label"] for r in A.label_ids(df, "label").orderBy("label_id").collect()] == ["c", "b", "a"]


def test_summary_truncates_each_weight(spark):
    c = K.centroid_frame(spark, [0, 1], [[0.0], [1.0]], [2.9, 3.9])
    assert A.summarize_centroids(c).first()["points"] == 5


def test_counts_keep_empty_clusters(spark):
    c = K.centroid_frame(spark, [0, 1], [[0.0], [100.0]], [0, 0])
    assert rows(A.cluster_counts(vectors(spark, [[0.1], [0.2]]), c), "centroid_id")["n"].tolist() == [2, 0]


@pytest.mark.parametrize("small", [3, 1 << 14])
def test_quartiles_by_counting(spark, small, monkeypatch):
    """Ties, steep values, a null group, groups of one and two rows; the plan has no range exchange."""
    monkeypatch.setattr(A, "SMALL_CELL", small)
    monkeypatch.setattr(A, "BINS", 8)
    rng = np.random.default_rng(9)
    v = {"a": rng.normal(size=400), "b": np.repeat([1.0, 2.0, 5.0], 90), "c": 10.0 ** rng.uniform(-40, 40, 200), None: rng.integers(0, 9, 77) * 1.0,
         "one": np.array([3.5]), "two": np.array([-1.0, 4.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in xs] + [("a", None), ("none", None)], "k string, x double").repartition(5)
    got = {r.k: r for r in A.summary_quartiles(df, "x", "k").collect()}
    assert set(got) == set(v)
    for k, xs in v.items():
        want = np.quantile(xs, [0, 0.25, 0.5, 0.75, 1])
        assert np.allclose([got[k][f"q{i}"] for i in range(5)], want, rtol=1e-12) and got[k].n == len(xs)
    out = A.summary_quartiles(df, "x", "k")
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString().lower()
    far = A.summary_quartiles(df.union(spark.createDataFrame([("a", float("inf"))], df.schema)), "x", "k")
    assert {r.k: r.q4 for r in far.collect()}["a"] == float("inf")
    assert A.summary_quartiles(df.limit(0), "x", "k").collect() == []


# ---- text -------------------------------------------------------------------------------------

def test_word_counts(spark):
    docs = [(1, "birch oak oak, birch; oak\nelm"), (2, ""), (3, "oak's oak's\noak's oak's"), (4, None), (5, "elm")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc_id"], r["term"]): r["tf"] for r in V.term_freq(df).collect()}
    assert got == {(1, "birch"): 2, (1, "oak"): 3, (1, "elm"): 1, (3, "oak's"): 4, (5, "elm"): 1}


MESSAGE = ("From: A B: c\nSubject: Hello World\nX-Other: skip\n\nIn article <1> you\n> quoted text\n"
           "someone writes:\n|>\n|> more\nBody it's 3.5 a/b Ünïcode\n")


def message(spark, **kw):
    df = spark.createDataFrame([(1, MESSAGE)], "doc_id bigint, text string")
    words = X.tokenize_message(X.parse_message("text", ["subject", "FROM"], **kw))
    return {r["term"] for r in V.term_freq(df, words).collect()}


def test_message_parsing(spark):
    head, body = {"a", "b:", "c", "hello", "world"}, {"body", "it", "s", "3.5", "a/b", "ünïcode"}
    assert message(spark) == head | body
    assert message(spark, strict=True) == head | body | {"more"}
    assert message(spark, include_quotes=True) >= {"in", "article", "quoted", "someone", "writes:"}
    df = spark.createDataFrame([(1, "subject: x\nno blank line")], "doc_id bigint, text string")
    assert df.select(X.parse_message("text", ["subject"])).first()[0] == " x"


def test_codes_and_scorers(spark):
    for bad in ("", "lix", "lic ", "zic"):
        if bad != "lix":
            with pytest.raises(ValueError):
                X.parse_code(bad)
    with pytest.raises(ValueError):
        X.get_scorer("none")
    df = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["term"]): r["val"] for r in V.tfidf(df, lambda tf, d, n: tf * 100 + d * 10 + n).collect()}
    assert got == {(1, "a"): 223.0, (1, "b"): 113.0, (2, "a"): 123.0, (2, "c"): 113.0}
    log = {(r["doc_id"], r["term"]): r["val"] for r in V.tfidf(df, "log").collect()}
    assert log[(1, "b")] == 0 and log[(1, "a")] > 0


def test_hashed_vectors_dense_and_long_agree(spark):
    df = spark.createDataFrame([(1, "subject: a b\n\nc d d"), (2, "")], "doc_id bigint, text string")
    for code in ("lic", "tix", "sxx"):
        long = V.hashed_vectors(df, code, 16, headers=["subject"]).collect()
        dense = {r["doc_id"]: np.array(r["vec"]) for r in V.hashed_vectors(df, code, 16, headers=["subject"], dense=True).collect()}
        want = np.zeros(16)
        for r in long:
            want[r["bucket"]] = r["val"]
        assert np.allclose(dense[1], want) and not dense[2].any() and len(dense[2]) == 16
    unit = np.array([r["val"] for r in V.hashed_vectors(df, "txc", 16).collect()])
    assert np.isclose((unit ** 2).sum(), 1)


def test_salted_dictionary_join(spark, monkeypatch):
    df = spark.createDataFrame([(i, "the w%d" % (i % 5)) for i in range(50)], "doc_id bigint, text string")
    want = rows(V.tfidf(df))
    monkeypatch.setattr(V, "TERM_BYTES", 1 << 40)
    assert rows(V.tfidf(df)).equals(want)


def test_only_common_terms_are_broadcast(spark, monkeypatch):
    """Neither a large dictionary nor copies of it, one a lane, may reach the driver, however small they look when stored."""
    df = spark.createDataFrame([(i, "the of w%d w%d" % (i, i + 1)) for i in range(400)], "doc_id bigint, text string")
    want = rows(V.tfidf(df))
    monkeypatch.setattr(V, "HEAD_BYTES", 1000)
    got = V.tfidf(df)
    assert rows(got).equals(want)
    plan = V.tfidf(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "sequence(" not in plan
    terms = V.session.materialize(V.doc_freq(df))
    common = V.join_terms(V.session.materialize(V.term_freq(df)), terms).filter("df > 100").groupBy("term").count().collect()
    assert {r["term"]: r["count"] for r in common} == {"the": 400, "of": 400}


def test_terms_are_counted_some_documents_at_a_time(monkeypatch):
    """An Arrow batch of very many words is not counted at once."""
    words = [["a", "b", "a"], None, [], ["c"] * 7, ["a", "c"], ["b"] * 2]
    batch = V.pa.RecordBatch.from_arrays([V.pa.array(range(6)), V.pa.array(words)], names=["doc_id", "words"])
    whole = V.pa.Table.from_batches(V._count_terms([batch])).to_pylist()
    monkeypatch.setattr(V, "COUNT_WORDS", 4)
    parts = list(V._count_terms([batch]))
    assert len(parts) == 3 and V.pa.Table.from_batches(parts).to_pylist() == whole
    assert {(r["doc_id"], r["term"]): r["tf"] for r in whole} == {(0, "a"): 2, (0, "b"): 1, (3, "c"): 7, (4, "a"): 1, (4, "c"): 1, (5, "b"): 2}


def test_sparse_projection_keeps_lengths(spark):
    df = spark.createDataFrame([(i, j, float((i * j) % 7 + 1)) for i in range(20) for j in range(40)],
                               "doc_id bigint, dim int, val double")
    got = rows(V.reduce_sparse(df, 60, 3), "doc_id")
    norm2 = df.groupBy("doc_id").agg(F.sum(F.col("val") ** 2).alias("n")).orderBy("doc_id").toPandas()["n"]
    ratio = np.array([(np.array(v) ** 2).sum() for v in got["vec"]]) / 60 / norm2
    assert abs(ratio.mean() - 1) < 0.2


# ---- classifier -------------------------------------------------------------------------------

def test_classifier(spark, tmp_path):
    pts = G.axis_blobs(spark, 4, 60, 60, 3, 6.0, 0.5, seed=1).withColumn("name", F.concat(F.lit("b"), "blob"))
    centers = A.label_means(pts, "name")
    model, labels = C.train_on_distances(pts, "name", centers, max_iter=30)
    scored = C.score(model, pts, "name", labels, centers).persist()
    report = C.accuracy_report(scored).first()
    assert report["accuracy"] > 0.98 and report["mean_log_likelihood"] < 0
    assert all(abs(sum(r["scores"]) - 1) < 1e-9 for r in scored.limit(5).collect())
    C.save_model(model, str(tmp_path / "m"))
    again = C.score(C.load_model(str(tmp_path / "m")), pts, "name", labels, centers)
    assert rows(again.select("id", "predicted")).equals(rows(scored.select("id", "predicted")))
    assert C.confusion(scored).agg(F.sum("n")).first()[0] == 240
    assert C.confusion_matrix(scored, [0, 1, 2, 3]).count() == 4
    assert C.evaluate(scored, "accuracy") == report["accuracy"]


# ---- sources ----------------------------------------------------------------------------------

def test_text_tree(spark, tmp_path):
    for sub, name, body in (("a", "1", "x\ny"), ("a/deep", "2", ""), ("b", "3", "z")):
        os.makedirs(tmp_path / sub, exist_ok=True)
        (tmp_path / sub / name).write_text(body)
    got = io.read_text_tree(spark, str(tmp_path)).select(X.label_from_path("path").alias("l"), "text").collect()
    assert {(r["l"], r["text"]) for r in got} == {("a", "x\ny"), ("deep", ""), ("b", "z")}


def test_sample_text(spark, tmp_path):
    lines = ["# made by hand", "2 3", "0 1", "2 3", "4 5", "0 0", "0 1", "1 0", "1 1"]
    (tmp_path / "s.txt").write_text("\n".join(lines) + "\n")
    got = rows(io.read_sample_text(spark, str(tmp_path / "s.txt")), "kind", "id")
    assert got["kind"].tolist() == ["centre"] * 4 + ["point"] * 3
    assert got["vec"][6].tolist() == [4, 5] and got["vec"][3].tolist() == [1, 1]


def test_reference_format_round_trip(spark, tmp_path):
    pts = G.hypercube_points(spark, 2, 50)
    io.write_sample_text(pts, G.hypercube_corners(spark, 2), 2, str(tmp_path / "t"))
    got = rows(io.read_sample_text(spark, str(tmp_path / "t")), "kind", "id")
    assert (got["kind"] == "point").sum() == 50 and (got["kind"] == "centre").sum() == 4
    want = rows(pts, "id")["vec"]
    assert all(np.array_equal(a, b) for a, b in zip(got[got["kind"] == "point"]["vec"], want))


def test_matrix_market_and_csv(spark, tmp_path):
    df = vectors(spark, [[0.0, 1.5], [2.0, 0.0], [0.0, 0.0]], [10, 20, 30])
    io.to_matrix_market(df, str(tmp_path / "mm"))
    head = [r[0] for r in spark.read.text(str(tmp_path / "mm/header")).collect()]
    assert head == ["%%MatrixMarket matrix coordinate real general", "3 2 2"]
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "mm/entries")).collect()) == ["1 2 1.5", "2 1 2.0"]
    io.write_dense_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["x0", "x1"]


def test_export_projects_above_three(spark):
    c = G.hypercube_corners(spark, 4)
    flat = io.export_points(G.hypercube_points(spark, 4, 8), c, 4)
    assert {len(r["vec"]) for r in flat.collect()} == {3} and flat.count() == 24
    keep = io.export_points(G.hypercube_points(spark, 2, 8), G.hypercube_corners(spark, 2), 2)
    assert {len(r["vec"]) for r in keep.collect()} == {2}


# ---- streaming --------------------------------------------------------------------------------

def test_stream_clusters(spark, tmp_path):
    pts = G.hypercube_points(spark, 3, 4000).select("id", "vec")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    pts.repartition(3).write.parquet(src)

    def stream():
        return spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(src)

    q = T.write_latest(T.cluster_stream(stream(), 60, shards=2, seed=1), out, str(tmp_path / "log"), available_now=True)
    q.awaitTermination()
    now = T.read_latest(spark, out)
    assert abs(now.agg(F.sum("weight")).first()[0] - 4000) < 1e-9
    c = K.ball_kmeans(now, 8, 20, seed=2)
    assert sorted(rows(c)["weight"]) == [500.0] * 8

    pts.limit(0).write.mode("append").parquet(src)
    vectors(spark, [[0.0, 0.0, 0.0]] * 100, range(5000, 5100)).write.mode("append").parquet(src)
    T.write_latest(T.cluster_stream(stream(), 60, shards=2, seed=1), out, str(tmp_path / "log"),
                   available_now=True).awaitTermination()
    assert abs(T.read_latest(spark, out).agg(F.sum("weight")).first()[0] - 4100) < 1e-9


def test_stream_snapshots(spark, tmp_path):
    """The folder stays as large as two snapshots over 20 batches, and a replayed batch writes the same rows."""
    src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    rng = np.random.default_rng(6)
    mat = np.repeat(rng.normal(size=(8, 2)) * 9, 125, axis=0) + rng.normal(size=(1000, 2)) * 0.1
    for k in range(20):
        part = vectors(spark, mat[rng.permutation(1000)[:50]], [7] * 25 + list(range(k * 50, k * 50 + 25)))  # one id again and again
        part.coalesce(1).write.mode("append").parquet(src)
    stream = lambda: T.cluster_stream(spark.readStream.schema("id bigint, vec array<double>").option("maxFilesPerTrigger", 1)
                                      .parquet(src), 12, shards=3, seed=1)
    T.write_latest(stream(), out, log, available_now=True).awaitTermination()
    folders = sorted(f for f in os.listdir(out) if not f.startswith("."))
    assert folders == ["batch=18", "batch=19"] and not [f for f in os.listdir(out) if f.startswith(".fresh")]
    said = lambda: sorted((r.id, tuple(r.vec), r.weight) for r in T.read_latest(spark, out).collect())
    now = said()
    assert abs(sum(w for _, _, w in now) - 1000) < 1e-9 and len({i >> 40 for i, _, _ in now}) == 3
    os.remove(f"{log}/commits/19")  # as if the run had ended before the last batch was committed
    if os.path.exists(f"{log}/commits/.19.crc"):
        os.remove(f"{log}/commits/.19.crc")
    T.write_latest(stream(), out, log, available_now=True).awaitTermination()
    assert said() == now
    assert T.read_latest(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("kind", ["in order", "mixed", "repeated, some null"])
def test_rows_of_a_batch_are_sorted_in_runs(monkeypatch, tmp_path, kind):
    """what a task sorts of a micro-batch is bounded: runs go to disk and are merged a few rows at a time, in the order of
    id, draw and arrival; a sketch fed so is the one that takes all rows at once."""
    rng, n = np.random.default_rng(9), 3000
    ids = {"in order": np.arange(n), "mixed": rng.permutation(n)}.get(kind, rng.integers(0, 40, n))
    whole = pd.DataFrame({"id": ids, "vec": list(rng.normal(size=(n, 3))), "weight": rng.random(n), "u": rng.integers(0, 5, n) / 5})
    if kind.startswith("repeated"):
        whole["id"] = whole["id"].astype(float).where(whole["id"] % 7 > 0)
    want = whole.sort_values(["id", "u"], kind="stable")
    once = Sketcher(20, 0.1, get_metric("euclidean"))
    once.add(np.stack(want["vec"].to_numpy()), want["weight"].to_numpy(), want["u"].to_numpy())
    monkeypatch.setattr(T, "READ_ROWS", 16)
    for run, most in ((1 << 20, n), (8000, 16 * 25)):
        monkeypatch.setattr(T, "RUN_BYTES", run)
        folder = tmp_path / str(run)
        folder.mkdir()
        fed, pieces = Fed(20, 0.1, get_metric("euclidean")), []
        for part in T._in_order((whole.iloc[i:i + 100] for i in range(0, n, 100)), str(folder)):
            pieces.append(part)
            fed.feed(*part)
        fed.finish()
        vecs, weights, u = (np.concatenate(x) for x in zip(*pieces))
        assert np.array_equal(vecs, np.stack(want["vec"].to_numpy())) and np.array_equal(u, want["u"]) and np.array_equal(weights, want["weight"])
        assert max(len(p[1]) for p in pieces) <= most and bool(os.listdir(folder)) == (run == 8000)
        assert np.array_equal(fed.vecs, once.vecs) and np.array_equal(fed.weights, once.weights) and fed.cutoff == once.cutoff and fed.n_seen == n
    with pytest.raises(ValueError):
        list(T._in_order(iter([whole.head(5).assign(vec=None)]), str(tmp_path)))


def test_stream_assign(spark, tmp_path):
    pts = G.hypercube_points(spark, 3, 100).select("id", "vec")
    pts.write.parquet(str(tmp_path / "in"))
    s = T.assign_stream(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in")), G.hypercube_corners(spark, 3))
    q = (s.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "id")
    assert (got["centroid_id"] == got["id"] % 8).all()


# ---- catalog ----------------------------------------------------------------------------------

QUICK = ["knn_exact", "knn_projection", "knn_lsh", "ball_kmeans_step_untrimmed", "seed_kmeanspp", "label_means",
         "tfidf", "hashed_vectors_lic", "summary_quartiles", "sign_hash64", "sample_text_round_trip", "stream_assign"]


@pytest.mark.parametrize("name", sorted(ORACLE) if os.environ.get("VECSPARK_ALL_QUERIES") else QUICK)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = rows(QUERIES[name](spark, SF)), con.execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    want = want[cols].sort_values(cols, ignore_index=True)
    got = got[cols].sort_values(cols, ignore_index=True)
    assert len(got) == len(want) and all(got[c].equals(want[c].astype(got[c].dtype)) for c in cols)


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 2500
    assert set(entry.oracle_sql()) <= set(entry.queries())
