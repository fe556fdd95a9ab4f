"""Operators on hand-made rows."""

import collections
import datetime as dt
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from karstwell.operators import chunking as C
from karstwell.operators import cluster as K
from karstwell.operators import ingest as I
from karstwell.operators import joins as J
from karstwell.operators import research as R
from karstwell.operators import search as S
from karstwell.operators import stats as A
from karstwell.streaming import live as L


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- search ----------------------------------------------------------------------------------------------------------------


def test_elbow(spark):
    def elbow_of(scores):
        df = spark.createDataFrame(list(enumerate(map(float, scores))), "chunk_id long, score double")
        return S.elbow(df, "score").select("elbow").distinct().collect()[0][0]

    assert elbow_of([1, 2]) is None
    assert elbow_of([3, 3, 3]) is None
    assert elbow_of([4, 3, 2, 1]) is None
    assert elbow_of([100, 99, 10, 9, 8]) == 2


def test_threshold_polarity(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0], 2), (1, [1.0, 0.1], 2), (2, [0.0, 1.0], 2), (3, [1.0], 1)], "chunk_id long, embedding array<float>, dims int")
    assert [r[0] for r in rows(S.neighbours(e, 0, max_distance=0.5).select("chunk_id"))] == [1]
    assert [r[0] for r in rows(S.neighbours(e, 0, min_similarity=0.5).select("chunk_id"))] == [1]
    assert S.neighbours(e, 77).count() == 0


def test_multi_hop_reaches_two_hops(spark):
    points = {1: 0.0, 2: 10.0, 3: 20.0, 4: 25.0, 5: 3.0, 6: 5.0, 7: 7.0, 8: 8.0}
    import math

    e = spark.createDataFrame([(i, [math.cos(math.radians(a)), math.sin(math.radians(a))], 2, 0.3 + i / 100) for i, a in points.items()], "chunk_id long, embedding array<float>, dims int, r double")
    got = S.multi_hop(e, [1.0, 0.0], F.col("r"), page_size=20)
    assert {r["chunk_id"] for r in got.collect()} == set(points)
    assert got.first()["chunk_id"] == 8
    assert S.multi_hop(e, [1.0, 0.0], F.col("r"), page_size=2, offset=2).count() == 2
    assert S.multi_hop(e, [1.0, 0.0], F.col("r"), page_size=9, threshold=0.36).count() == 3


def test_fusion(spark):
    s = spark.createDataFrame([(1, 0, 0.9), (2, 1, 0.8)], "chunk_id long, position long, similarity double")
    r = spark.createDataFrame([(2, 0), (3, 1)], "chunk_id long, position long")
    got = {x["chunk_id"]: (x["search_type"], round(x["combined_score"], 6)) for x in S.fuse(s, r, 0.6).collect()}
    assert got == {1: ("semantic", round((0.3 + 0.63) * 0.6, 6)), 2: ("hybrid", round((0.15 + 0.56) * 0.6 + 0.4, 6)), 3: ("regex", 0.2)}


def test_rerank_keeps_scores(spark):
    r = spark.createDataFrame([(1, 0.5), (2, 0.4)], "chunk_id long, rerank_score double")
    assert rows(S.apply_rerank(r, spark.createDataFrame([(2, 0.9)], "chunk_id long, score double")).select("chunk_id", "rerank_score")) == [(1, 0.5), (2, 0.9)]


# -- joins and dedup ---------------------------------------------------------------------------------------------------------


def chunk_rows(spark, *items):
    return spark.createDataFrame([(i, 1, *x) for i, x in enumerate(items, 1)], "chunk_id long, file_id long, start_line int, end_line int, code string, chunk_type string, language string")


def test_dedup_ties_and_languages(spark):
    c = chunk_rows(spark, (1, 3, "same", "function", "go"), (5, 7, "same ", "struct", "go"), (9, 9, " ", "block", "go"), (1, 2, "v", "block", "vue"), (3, 4, "v", "block", "vue"))
    assert [r[0] for r in rows(J.dedup_chunks(c).select("chunk_id"))] == [1, 4, 5]


def test_nested_block_goes(spark):
    c = chunk_rows(spark, (1, 9, "def f():\n  if x:\n    y", "function", "py"), (2, 3, "if x:\n    y", "block", "py"), (20, 21, "if x:\n    y", "block", "py"))
    assert [r[0] for r in rows(J.without_nested_blocks(c).select("chunk_id"))] == [1, 3]


def test_overlap_equals_three_way_or(spark):
    pairs = [(a, b, c, d) for a in range(1, 6) for b in range(a, 6) for c in range(1, 6) for d in range(c, 6)]
    df = spark.createDataFrame(pairs, "a int, b int, c int, d int")
    ours = F.expr("a <= d AND b >= c")
    theirs = F.expr("(a BETWEEN c AND d) OR (b BETWEEN c AND d) OR (a <= c AND b >= d)")
    assert df.where(ours != theirs).count() == 0


def test_embedding_duplicates(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, 7, "p", "m", None), (2, 7, "p", "m", t), (3, 7, "p", "m", t), (4, 7, "p", "n", None), (5, 7, "p", "n", None)], "embedding_id long, chunk_id long, provider string, model string, created_at timestamp")
    assert [r[0] for r in rows(J.dedup_embeddings(e).select("embedding_id"))] == [3, 5]


def test_conflicts(spark):
    f = spark.createDataFrame([(1, "x is not set", ["A"]), (2, "x is set", ["a "]), (3, "x has 3", ["b"]), (4, "x has 5", ["B"]), (5, "x has 5", ["b"])], "fact_id long, statement string, entities array<string>")
    assert rows(J.conflicts(f)) == [("a", 1, 2, "negation"), ("b", 3, 4, "numbers"), ("b", 3, 5, "numbers")]


def test_merge_keeps_base_on_ties(spark):
    b = spark.createDataFrame([(1, 0.5, "b"), (2, 0.5, "b")], "chunk_id long, score double, o string")
    n = spark.createDataFrame([(1, 0.5, "n"), (2, 0.6, "n"), (3, 0.1, "n")], "chunk_id long, score double, o string")
    assert rows(J.merge_lists(b, n).select("chunk_id", "o")) == [(1, "b"), (2, "n"), (3, "n")]


# -- ingest -----------------------------------------------------------------------------------------------------------------


def test_diff_hunks(spark):
    two = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n a\n+b\n@@ -9 +10,2 @@\n-c\n+d\n+e"
    gone = "--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-x"
    only_deleted = "--- a/z\n+++ b/z\n@@ -1,2 +1,1 @@\n a\n-b"
    d = spark.createDataFrame([(1, two), (2, gone), (3, only_deleted)], "diff_id long, diff string")
    assert rows(I.diff_hunks(d)) == [(1, "x", 1, 1, 2, "a\nb"), (1, "x", 2, 10, 11, "d\ne")]


def test_commit_range():
    assert I.commit_range(commit="abc") == "abc^..abc" and I.commit_range(last=3) == "HEAD~3..HEAD" and I.commit_range() is None
    with pytest.raises(ValueError):
        I.commit_range(commit="a", last=1)


def test_write_batch(spark, tmp_path):
    files = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "file_id long, path string")
    chunks = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "file_id long, chunk_id long")
    emb = spark.createDataFrame([(10, 2), (20, 2), (30, 2)], "chunk_id long, dims int")
    new = (spark.createDataFrame([(2, "b")], files.schema), spark.createDataFrame([(2, 21)], chunks.schema), spark.createDataFrame([(21, 3)], emb.schema))
    for _ in range(2):  # a second run of the same batch changes nothing
        I.write_batch(str(tmp_path), files, chunks, emb, new_files=new[0], new_chunks=new[1], new_embeddings=new[2], deleted=files.where("path = 'a'"))
        f, c, e = I.read_store(spark, str(tmp_path))
        assert rows(f.select("file_id")) == [(2,), (3,)]
        assert rows(c.select("chunk_id")) == [(21,), (30,)]
        assert rows(e.select("chunk_id", "dims")) == [(21, 3), (30, 2)]


def test_a_torn_transaction_leaves_the_store_as_it_was(spark, tmp_path):
    files = spark.createDataFrame([(1, "a")], "file_id long, path string")
    chunks = spark.createDataFrame([(1, 10)], "file_id long, chunk_id long")
    emb = spark.createDataFrame([(10, 2)], "chunk_id long, dims int")
    with pytest.raises(FileNotFoundError):
        I.read_store(spark, str(tmp_path))
    first = I.write_store(str(tmp_path), files, chunks, emb)
    bad = emb.withColumn("dims", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        I.write_store(str(tmp_path), files.limit(0), chunks.limit(0), bad)
    assert I.current_version(spark, str(tmp_path)) == first and [x.count() for x in I.read_store(spark, str(tmp_path))] == [1, 1, 1]
    held = I.read_store(spark, str(tmp_path))
    I.write_store(str(tmp_path), files.limit(0), chunks, emb)
    assert held[0].count() == 1 and I.read_store(spark, str(tmp_path))[0].count() == 0  # a reader keeps its version


def test_ids_out_of_range_are_an_error(spark):
    good = spark.createDataFrame([(3, 5), (0, 0)], "f long, p long").select(I.packed_id(F.col("f"), F.col("p")))
    assert rows(good) == [(0,), (3 * 2**24 + 5,)]
    for f, p in ((1, 2**24), (2**39, 1), (-1, 1)):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([(f, p)], "f long, p long").select(I.packed_id(F.col("f"), F.col("p"))).collect()


def test_long_hunks_are_split(spark):
    body = [f"+line {i} " + "x" * 90 for i in range(300)] + ["+" + "y" * 25_000, "+end"]
    diff = "\n".join(["diff --git a/f b/f", "--- a/f", "+++ b/f", "@@ -1,0 +7,302 @@", *body])
    got = I.diff_hunks(spark.createDataFrame([(1, diff)], "diff_id long, diff string")).orderBy("start_line").collect()
    assert "\n".join(r["code"] for r in got) == "\n".join(x[1:] for x in body)
    assert got[0]["start_line"] == 7 and got[-1]["end_line"] == 7 + 301
    assert all(b["start_line"] == a["end_line"] + 1 for a, b in zip(got, got[1:]))
    assert all(len(r["code"]) <= 10_000 or "\n" not in r["code"] for r in got)
    (whole,) = I.diff_hunks(spark.createDataFrame([(1, diff)], "diff_id long, diff string"), most=None).collect()
    assert (whole["start_line"], whole["end_line"], whole["code"]) == (7, 7 + 301, "\n".join(x[1:] for x in body))


def test_hunks_by_their_counts(spark):
    diff = "--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n a\n--- sql\n+++ more\n b\n--- a/y\n+++ b/y\n@@ -1 +1,2 @@\n c\n+d"
    got = I.diff_hunks(spark.createDataFrame([(1, diff), (2, None)], "diff_id long, diff string"))
    assert rows(got) == [(1, "x", 1, 1, 3, "a\n++ more\nb"), (1, "y", 2, 1, 2, "c\nd")]


def test_mixed_lengths_are_an_error(spark):
    e = spark.createDataFrame([(1, "p", "m", [1.0, 2.0])], "chunk_id long, provider string, model string, embedding array<float>")
    with pytest.raises(Exception, match="mixed lengths"):
        I.upsert_embeddings(e, e, 3).collect()


def test_scan(spark, tmp_path):
    from karstwell.sources.scan import scan_files

    for name, content in {"src/a.py": b"x = 1", "src/b.bin": b"\0\1", "node_modules/c.py": b"", "Makefile": b"all:", "src/d.log": b"l", "src/big.json": b"1" * 30_000}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    got = scan_files(spark, str(tmp_path), exclude=["**/node_modules/**"], ignore=["*.log"])
    assert rows(got.select("path", "language", "skip_reason")) == [("Makefile", "makefile", None), ("src/a.py", "python", None), ("src/b.bin", "unknown", "binary"), ("src/big.json", "json", "large_config")]
    assert [r[0] for r in rows(scan_files(spark, str(tmp_path), include=["src/*.py"]).select("path"))] == ["src/a.py"]


# -- chunking ---------------------------------------------------------------------------------------------------------------


def test_paragraphs(spark):
    text = "short\n\n" + "a" * 60 + "\n" + "b" * 3 + "\n \n\n" + "c" * 50
    f = spark.createDataFrame([(1, text)], "file_id long, text string")
    assert [(r["name"], r["start_line"], r["end_line"]) for r in C.paragraphs(f).orderBy("start_line").collect()] == [("paragraph_3", 3, 4), ("paragraph_7", 7, 7)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ;{}\n,", max_size=9000), st.integers(1, 50))
def test_split_keeps_everything(text, start):
    lines = text.count("\n") + 1
    parts = C.split_chunk("n", text, start, start + lines - 1)
    if len(parts) > 1:
        # halves by lines lose the line end between them, cuts lose nothing
        assert "".join("".join(p[1] for p in parts).split()) == "".join(text.split())
    assert all(C.fits(p[1]) or len(p[1]) <= 2 * C.MIN_CHARS for p in parts)
    assert all(start <= p[2] <= p[3] <= start + lines - 1 for p in parts)


def test_emergency_split_names_and_places():
    parts = C.split_chunk("x", "a" * 1000 + ";" + "b" * 1000, 1, 1)
    assert [p[0] for p in parts] == ["x_part1", "x_part2"] and parts[0][1].endswith(";")
    assert len(C.split_chunk("x", "a" * 20_000, 1, 1)) > 10


def test_cast_merging():
    comments = [("c1", "# one", 1, 1, "COMMENT"), ("c2", "# two", 2, 2, "COMMENT"), ("c3", "# far", 40, 40, "COMMENT")]
    assert [(r[0], r[2], r[3]) for r in C.chunk_file(comments)] == [("c1_c2", 1, 2), ("c3", 40, 40)]
    nested = [("class", "class A", 1, 20, "DEFINITION"), ("m", "def m", 3, 5, "DEFINITION")]
    assert [r[0] for r in C.merge_greedily(nested)] == ["class", "m"]
    mixed = [("c", "# doc", 1, 1, "COMMENT"), ("f", "def f", 2, 3, "DEFINITION")]
    assert C.merge_greedily(mixed) == [("f", "# doc\ndef f", 1, 3, "DEFINITION")]
    assert len(C.merge_greedily([("c", "# doc", 1, 1, "COMMENT"), ("f", "def f", 3, 4, "DEFINITION")])) == 2


def test_boundaries():
    py = ["import x", "", "def f():", "    a", "    b", "", "def g():", "    c"]
    assert C.Boundaries("\n".join(py), "a.py").widened(5, 5, "") == (3, 6)
    assert C.Boundaries("\n".join(py), "a.py").widened(5, 5, "function") == (2, 8)
    assert C.Boundaries("\n".join(py), "a.py").widened(0, 5, "") == (0, 0)
    js = ["function f(a) {", "  if (a) {", "    b", "  }", "}", "x"]
    assert C.Boundaries("\n".join(js), "a.js").widened(1, 1, "") == (1, 5)
    assert C.Boundaries("\n".join(js), "a.js").widened(3, 3, "") == (3, 3)  # upwards only opening braces: nothing to widen to


def slow_boundaries(lines, start, end, kind, path):
    """The rule of ``Boundaries``, line by line."""
    if not 1 <= start <= end <= len(lines):
        return 0, 0
    if kind in C.WHOLE_KINDS:
        return max(1, start - 3), min(len(lines), end + 3)
    first, last = start - 1, end - 1
    top, bottom = first, last
    above = [i for i in range(first, 0, -1) if i > first - 200]
    below = range(last + 1, min(len(lines), last + 200))
    if path.endswith(".py"):
        for i in above[1:]:
            if re.match(r"\s*(async def|def|class) ", lines[i]):
                top = i
                break
            if not lines[i].strip() and lines[i + 1].strip():
                break
        indent = lambda x: len(x) - len(x.lstrip())
        deeper = [i for i in below if lines[i].strip() and indent(lines[i]) <= indent(lines[top])]
        bottom = deeper[0] - 1 if deeper else min(len(lines) - 1, last + 50)
    elif path.endswith(".js"):
        for i in above:
            if "{" in lines[i] and sum(x.count("}") - x.count("{") for x in lines[i : first + 1]) > 0:
                heads = [j for j in range(i, max(0, i - 10), -1) if "(" in lines[j] and (")" in lines[j] or j < i)]
                if heads and heads[0] != first:
                    top = heads[0]
                    break
        for i in range(top + 1, min(len(lines), last + 200)):
            if "}" in lines[i] and sum(x.count("{") - x.count("}") for x in lines[top : i + 1]) == 0:
                bottom = i
                break
    return top + 1, min(bottom, top + 300) + 1


LINE = st.sampled_from(["", "  ", "def f(x):", "  def g():", "class A:", "    return 1", "  x = 2", "f(a) {", "}", "} else {", "  }", "if (a", "b) {", "c;", "{ }", "  h();"])


@settings(max_examples=300, deadline=None)
@given(st.lists(LINE, min_size=1, max_size=40), st.integers(1, 40), st.integers(0, 6), st.sampled_from(["", "function", "block"]), st.sampled_from(["a.py", "a.js", "a.txt"]))
def test_boundaries_brute_force(lines, start, more, kind, path):
    found = C.Boundaries("\n".join(lines), path)
    assert found.widened(start, start + more, kind) == slow_boundaries(lines, start, start + more, kind, path)


def test_boundaries_of_long_files():
    rng = np.random.default_rng(1)
    for path in ("a.py", "a.js"):
        lines = [["", "def f():", "  x(", "    y)", "{", "}"][k] for k in rng.integers(0, 6, 900)]
        found = C.Boundaries("\n".join(lines), path)
        for start in (1, 2, 199, 200, 201, 450, 890):
            assert found.widened(start, start + 3, "") == slow_boundaries(lines, start, start + 3, "", path)


def test_token_batches_preserve_rows(spark):
    df = spark.createDataFrame([(1, i, 3) for i in range(10)] + [(2, 0, 99), (2, 1, 1)], "k long, o long, tokens int")
    got = C.token_batches(df, by="k", order="o", max_tokens=9, max_rows=2)
    assert [r["batch"] for r in got.where("k = 1").orderBy("o").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert [r["batch"] for r in got.where("k = 2").orderBy("o").collect()] == [0, 1]


def test_sql_detection(spark):
    df = spark.createDataFrame([("SELECT a, b FROM t WHERE x = 1",), ("select one from us",), ("from a to b",)], "x string")
    assert [r[0] for r in df.select(C.sql_concept(F.col("x"))).collect()] == ["block", None, None]


# -- statistics ---------------------------------------------------------------------------------------------------------------


def test_metrics(spark):
    ranked = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "b"), ("q2", 1, "x"), ("q2", 2, "y"), ("q2", 3, "c")], "query_id string, rank int, path string")
    relevant = spark.createDataFrame([("q1", "a"), ("q2", "c"), ("q3", "z")], "query_id string, path string")
    per = A.query_metrics(ranked, relevant, [1, 5])
    row = A.aggregate_metrics(per, [1, 5]).first()
    assert row["mrr_hits"] == pytest.approx((1 + 1 / 3) / 2) and row["mrr"] == pytest.approx((1 + 1 / 3) / 3)
    assert row["recall_5"] == pytest.approx(2 / 3) and row["precision_1"] == pytest.approx(1 / 3)
    assert row["ndcg_5"] == pytest.approx((1 + 0.5) / 3)


def test_p95_index(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)], "x double")
    assert tuple(A.latency_stats(df, "x").first()) == (10.5, 10.5, 19.0, 20.0)


def test_regression_and_p():
    # scipy.stats.linregress(range(6), [1, 2, 2, 4, 5, 5.5]) gives p = 0.00068456 (computed by hand from t = 9.7014)
    assert A.t_test_p(0.9857142857, 0.1016, 6) == pytest.approx(0.000631, abs=1e-4)
    assert A.t_test_p(0.0, 1.0, 10) == pytest.approx(1.0)
    assert A.t_test_p(2.228, 1.0, 12) == pytest.approx(0.05, abs=2e-4)


def test_diagnosis(spark):
    df = spark.createDataFrame([(i, 100.0 + 10 * i + (i % 2), 5) for i in range(12)], "batch_index long, latency_ms double, chunk_count int")
    assert A.diagnose(df)["degradation_detected"] is True
    assert A.diagnose(df.limit(3))["regression"] is None


def test_cluster_quality_bounds(spark):
    same = spark.createDataFrame([(a, a) for a in "aabbcc"], "truth string, predicted string")
    assert [round(x, 9) for x in A.cluster_quality(same).first()] == [1.0] * 6


# -- clusters -----------------------------------------------------------------------------------------------------------------


def test_clusters(spark):
    pts = spark.createDataFrame([(i, [float(i // 5), 1.0], 10_000) for i in range(10)], "vec_id long, embedding array<float>, tokens long")
    assert K.kmeans(pts, 50).count() == 10
    with pytest.raises(ValueError):
        K.kmeans(pts.limit(0), 3)
    sizes = [r[0] for r in K.bounded_clusters(pts, "vec_id", 15_000, 50_000).groupBy("cluster_id").agg(F.sum("tokens")).select("sum(tokens)").collect()]
    assert sum(sizes) == 100_000 and max(sizes) <= 50_000
    lonely = spark.createDataFrame([(1, [1.0, 0.0], -1), (2, [0.0, 1.0], -1)], "vec_id long, embedding array<float>, label int")
    assert {r["label"] for r in K.reassign_outliers(lonely, "vec_id").collect()} == {0}
    same = spark.createDataFrame([(i, [1.0, 1.0], 10_000 + i) for i in range(9)], "vec_id long, embedding array<float>, tokens long")  # can't be bisected
    dealt = K.bounded_clusters(same, "vec_id", 15_000, 35_000).groupBy("cluster_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in dealt) == 9 and max(r["t"] for r in dealt) <= 35_000


@pytest.mark.parametrize("held", [1 << 19, 4 * 60])
def test_bounded_clusters_of_many_points(spark, monkeypatch, held):
    """All bounds hold, copies and a far point included, in few jobs, whether tasks or jobs do the halving."""
    monkeypatch.setattr(K, "HELD", held)
    rng = np.random.default_rng(1)
    vectors = [*rng.normal(size=(1200, 4)).round(4).tolist(), *[[5.0, 5.0, 5.0, 5.0]] * 300, [1e6, 0.0, 0.0, 0.0]]
    pts = spark.createDataFrame([(i, v, 1000, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, tokens int, other string")
    sc = spark.sparkContext
    sc.setJobGroup("bounded", "bounded clusters")
    try:
        got = K.bounded_clusters(pts.repartition(3), "vec_id", 15_000, 50_000)
        found = got.collect()
        jobs = len(sc.statusTracker().getJobIdsForGroup("bounded"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got.columns == [*pts.columns, "cluster_id"]
    assert sorted((r["vec_id"], tuple(r["embedding"]), r["tokens"], r["other"]) for r in found) == [(i, tuple(v), 1000, "x") for i, v in enumerate(vectors)]
    sizes = collections.Counter(r["cluster_id"] for r in found)
    assert 15 <= min(sizes.values()) and max(sizes.values()) <= 50 and len(sizes) < 75
    # near points are together: the squares within clusters are a small part of all
    inner = {c: np.array([r["embedding"] for r in found if r["cluster_id"] == c and r["vec_id"] < 1200]) for c in sizes}
    assert sum(((x - x.mean(axis=0)) ** 2).sum() for x in inner.values() if len(x)) < 0.35 * 4 * 1200
    assert jobs < (40 if held > 1000 else 500)


def test_bounded_clusters_refuse_odd_vectors(spark):
    for v in (None, [], [1.0], [1.0, None], [1.0, float("nan")]):
        pts = spark.createDataFrame([(1, [1.0, 2.0], 10), (2, v, 10)], "vec_id long, embedding array<double>, tokens long")
        with pytest.raises(ValueError):
            K.bounded_clusters(pts, "vec_id", 5, 15)
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, tokens long")
    assert K.bounded_clusters(none, "vec_id", 5, 15).columns == ["vec_id", "embedding", "tokens", "cluster_id"]


def test_spanning_tree():
    x = np.random.default_rng(0).normal(size=(40, 3))
    a, b, w = K._spanning(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    order = sorted((d[i, j], i, j) for i in range(40) for j in range(i))
    sets, want = K._Sets(), 0.0
    for v, i, j in order:
        if sets.find(i) != sets.find(j):
            sets.root[sets.find(i)] = sets.find(j)
            want += v
    assert w.sum() == pytest.approx(want) and len(a) == 39


def test_density_clusters(spark, monkeypatch):
    rng = np.random.default_rng(3)
    blobs = [(10 * k + c + rng.normal(scale=0.3, size=2)) for k, c in ((0, np.array([0, 0])), (1, np.array([0, 5])), (2, np.array([5, 0]))) for _ in range(30)]
    noise = [np.array([200.0 + 100 * i, -300.0]) for i in range(6)]  # farther from all than the blobs are from each other
    rows_ = [(i, [float(v) for v in p]) for i, p in enumerate([*blobs, *noise])]
    pts = spark.createDataFrame([*rows_, (900, None), (901, [])], "vec_id long, embedding array<double>")
    want = None
    for cell, edges in ((512, 1 << 20), (16, 1 << 20), (16, 200)):  # however the trees are cut up
        monkeypatch.setattr(K, "CELL", cell)
        monkeypatch.setattr(K, "EDGES", edges)
        got = dict(map(tuple, K.density_clusters(pts, "vec_id", min_cluster_size=10).select("vec_id", "label").collect()))
        want = want or got
        assert got == want
    assert all(sum(want[i] == 30 * k for i in range(30 * k, 30 * k + 30)) >= 27 for k in range(3))
    assert want[900] == want[901] == -1 and all(want[90 + i] == -1 for i in range(6))
    assert K.density_clusters(pts.limit(0), "vec_id", min_cluster_size=5).count() == 0
    with pytest.raises(ValueError):
        K.density_clusters(pts, "vec_id", min_cluster_size=5, most=10)


def test_average_linkage_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(25, 4))
    got = dict(map(tuple, K.average_linkage(spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g long, vec_id long, embedding array<double>"), "g", "vec_id", 0.6).collect()))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(25)]
    while len(groups) > 1:
        far, a, b = min((np.mean([1 - u[i] @ u[j] for i in p for j in q]), m, n) for m, p in enumerate(groups) for n, q in enumerate(groups) if m < n)
        if far >= 0.6:
            break
        groups[a] += groups.pop(b)
    assert got == {i: min(g) for g in groups for i in g}


# -- research -----------------------------------------------------------------------------------------------------------------


def test_line_coverage_and_exploration(spark):
    r = spark.createDataFrame([("a", 1, 5), ("a", 3, 8), ("a", 20, 20), ("b", 1, 90)], "path string, start_line int, end_line int")
    assert rows(R.line_coverage(r)) == [("a", 9), ("b", 90)]
    c = spark.createDataFrame([("a", 2, 4), ("a", 7, 9), ("b", 200, 201), ("c", 1, 1)], "path string, start_line int, end_line int")
    assert rows(R.unexplored(c, r)) == [("a", 7, 9), ("c", 1, 1)]


def test_budget(spark):
    f = spark.createDataFrame([(1, "x" * 4000), (2, "y" * 4000), (3, "z" * 4000)], "file_id long, text string")
    got = R.within_budget(f, ["file_id"], 1600).select("file_id", F.length("content"), "is_cut").collect()
    assert [tuple(r) for r in got] == [(1, 4000, False), (2, 2400, True)]


def test_gap_selection(spark):
    def pick(scores):
        df = spark.createDataFrame(list(enumerate(map(float, scores))), "gap_id long, score double")
        return [r[0] for r in rows(R.select_gaps(df).select("gap_id"))]

    assert pick([5]) == [0]
    assert pick([0, 0, 0]) == [0]
    # the elbow is the third; the cut is before it
    assert pick([10, 9, 8, 1, 0.5]) == [0, 1]


def test_entities_keep_first_casing(spark):
    f = spark.createDataFrame([(1, ["Redis "]), (2, ["redis", "X"])], "fact_id long, entities array<string>")
    assert rows(R.entity_index(f)) == [("redis", "Redis ", 2), ("x", "X", 1)]


# -- live -----------------------------------------------------------------------------------------------------------------


def events(spark, *items):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, p, k, base + dt.timedelta(seconds=s)) for i, (p, k, s) in enumerate(items)], "seq long, path string, event_type string, ts timestamp")


SEQUENCE = [("a", "modified", 0.0), ("a", "modified", 1.0), ("a", "modified", 2.1), ("a", "deleted", 2.2), ("a", "modified", 2.3), ("b", "modified", 0.5), ("a", "modified", 4.2)]


def test_suppression(spark):
    # the second is dropped and does not prolong the window, so the third passes
    assert [r[0] for r in rows(L.suppress_duplicates(events(spark, *SEQUENCE)).select("seq"))] == [0, 2, 3, 4, 5]


def test_suppression_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    batch = events(spark, *SEQUENCE)
    batch.write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = L.suppress_duplicates_stream(stream).writeStream.format("memory").queryName("suppressed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("suppressed").select("seq")) == rows(L.suppress_duplicates(batch).select("seq"))


def test_debounce(spark):
    got = L.debounced(events(spark, ("a", "m", 0.0), ("a", "m", 0.3), ("a", "m", 0.7), ("a", "m", 1.3), ("b", "m", 0.1)), 0.5)
    assert rows(got.select("path", "events")) == [("a", 1), ("a", 3), ("b", 1)]


def test_priority_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark, ("a", "embed", 0), ("a", "change", 1), ("b", "delete", 2)).coalesce(1).write.parquet(src)
    seen = []
    stream = spark.readStream.schema("seq long, path string, event_type string, ts timestamp").parquet(src)
    L.apply_stream(stream, lambda df, epoch: seen.extend(r["event_type"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert seen == ["delete", "change", "embed"]


def test_generations(spark):
    m = spark.createDataFrame([("delete", "a", 1, 1), ("change", "a", 2, 2), ("delete", "b", 3, 3), ("delete", "b", 3, 4)], "operation string, path string, generation long, seq long")
    assert [r[0] for r in rows(L.without_stale_deletes(m).select("seq"))] == [2, 3, 4]
    assert rows(L.coalesced(m)) == [("change", "a", 2, 2), ("delete", "a", 1, 1), ("delete", "b", 3, 3)]


def test_windowed_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    batch = events(spark, ("a", "m", 0.0), ("a", "m", 0.3), ("a", "m", 5.0), ("b", "m", 100.0), ("z", "m", 9000.0))
    batch.write.parquet(src)

    def drain(make, name):
        stream = spark.readStream.schema(batch.schema).parquet(src)
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    # append mode emits what the watermark has passed: all but the last event's window
    got = rows(drain(lambda s: L.debounced_stream(s, 0.5, "1 minute"), "sessions").select("path", "events"))
    assert got == [("a", 1), ("a", 2), ("b", 1)]
    peaks = drain(lambda s: L.pressure_stream(s, 30, 30), "pressure").groupBy("path").agg(F.max("events").alias("n"))
    assert rows(peaks) == [("a", 3), ("b", 1)]


def test_admission_and_state(spark):
    e = events(spark, ("src/a", "m", 0), ("node_modules/b", "m", 1))
    assert [r[0] for r in rows(L.admitted(e, ["**/node_modules/**"]).select("path"))] == ["src/a"]
    assert [r["state"] for r in L.pressure(events(spark, *[("a", "m", i / 10) for i in range(25)])).orderBy("seq").collect()][18:20] == ["normal", "elevated"]


def test_snapshots(spark):
    b = spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 5), ("c", 1.0, 5)], "path string, mtime double, size int")
    a = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 5), ("d", 1.0, 1)], "path string, mtime double, size int")
    assert rows(L.snapshot_diff(b, a)) == [("b", "modified"), ("c", "deleted"), ("d", "created")]


def test_numbered_is_a_total_order(spark):
    df = spark.createDataFrame([((i * 7919) % 1000, i) for i in range(1000)], "k long, v long")
    got = S.numbered(df, [F.col("k").desc(), F.col("v")], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1000)) and [r["k"] for r in got] == sorted((r["k"] for r in got), reverse=True)
    assert S.numbered(df.limit(0), [F.col("k")], "n").count() == 0
