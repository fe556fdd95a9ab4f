"""Queries read whole texts and tables: what lies behind a prefix, a filter or the first round is in the result."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from karstwell.plans.registry import QUERIES, SQL


@pytest.fixture
def run(spark, tmp_path):
    """Runs a query on documents made of the texts; ids count from 1."""

    def of(name, *texts):
        rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts, 1)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        return QUERIES[name](spark, str(tmp_path)).collect()

    return of


def test_ordered_distinct_reads_whole_texts(run):
    texts = [" ".join(f"W{i % 150}" for i in range(400)), "a B a b", ""]
    want = {i: list(dict.fromkeys(t.lower().split(" "))) for i, t in enumerate(texts, 1)}
    assert {r["doc_id"]: r["words"] for r in run("d11_ordered_distinct", *texts)} == want


def test_template_references_of_whole_texts(run):
    texts = ["alpha " + "- " * 150 + "beta gamma_1 alpha", "beta x", "gamma_1"]
    got = {r["file_id"]: (r["script_references"], r["undefined_references"]) for r in run("j19_template_references", *texts)}
    assert got == {1: (3, 0), 2: (1, 1), 3: (1, 0)}


def test_row_rules_of_every_line(run):
    got = {r["chunk_id"] - (1 << 24): r["fault"] for r in run("f21_row_rules", "\n".join("abcdefghijklmno"))}
    assert got == {1: "start_line", 2: "start_line", 3: None, 4: None, 5: None, 6: None, 7: "end_line", 8: "order", 9: "order", 10: "order", 11: "order", 12: "order", 13: "order", 14: "end_line", 15: "order"}


LONG = "# " * 60 + "100%_[x]\\ Whole text\n" + "word " * 40 + "end"


def test_escape_like_of_whole_texts(run):
    got = {r["doc_id"]: r["escaped"] for r in run("f5_escape_like", LONG, "a_b")}
    assert got == {1: re.sub(r"([\\%_\[])", r"\\\1", LONG), 2: r"a\_b"}


def test_slug_of_whole_texts(run):
    got = {r["doc_id"]: r["slug"] for r in run("n1_slug", LONG, "#" * 99, "A b", "#" * 70 + "x")}
    assert got == {1: "100-x-whole-text-word-wo", 2: "topic", 3: "a-b", 4: "x"}


def test_verbosity_of_whole_texts(run):
    got = {r["doc_id"]: r["text"] for r in run("n11_verbosity", LONG + " It's worth noting that this stays.", "short", "")}
    assert got == {1: f"|{LONG[:100]}|{LONG[100:]} this stays.", 2: "|short|", 3: "||"}


def test_fact_id_of_whole_texts(run):
    got = {r["doc_id"]: r["fact_id"] for r in run("n18_fact_id", LONG, LONG + ".")}
    assert got == {i: hashlib.sha256(f"{t}:src0:{i}".encode()).hexdigest()[:12] for i, t in ((1, LONG), (2, LONG + "."))}


def brute_hops(vectors, score, rounds):
    """The search from vector 1 in plain Python; also the number of rounds that brought rows."""
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    near = lambda i, n, but: sorted((c for c in unit if c not in but), key=lambda c: (-float(unit[c] @ unit[i]), c))[:n]
    best = lambda: sorted(held, key=lambda c: (-score(c), c))[:5]
    held, n = set(near(1, 30, ())), 0
    while n < rounds:
        top = best()
        if len(held) >= 500 or sum(score(c) > 0 for c in top) < 5:
            break
        new = {c for i in top for c in near(i, 20 if n else 30, (i,))} - held
        if not new:
            break
        held |= set(sorted(new)[: 500 - len(held)])
        n += 1
        # a score by id never drops
        if score(best()[-1]) < 0.3:
            break
    return [(c, score(c)) for c in sorted(held, key=lambda c: (-score(c), c))[:10]], n


def test_multi_hop_goes_on_after_the_first_round(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=8).astype("float32").astype(float) for i in range(600)}
    rows = [(i, v.tolist(), i % 3) for i, v in vectors.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r["chunk_id"], r["rerank_score"]) for r in QUERIES["v14_multi_hop"](spark, str(tmp_path)).collect()]
    want, rounds = brute_hops(vectors, lambda c: c * 37 % 101 / 100, 10**9)
    assert rounds > 1 and want != brute_hops(vectors, lambda c: c * 37 % 101 / 100, 1)[0]
    assert got == want


@pytest.fixture
def equals(spark, tmp_path):
    """Whether a query on documents (text, source) gives the rows of its SQL."""

    def of(name, *documents):
        rows = [(i, t, "en", s, len(t or "")) for i, t, s in documents]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        df = QUERIES[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.sql(SQL[name])
        got = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=str)
        assert got and got == sorted(want.fetchall(), key=str)

    return of


def test_hunks_of_whole_documents(equals):
    """Long hunks, lines that look like headers, repeated ids, no text, no source."""
    long = "\n".join(f"line {i} " + "x" * 90 for i in range(300))
    equals("s21_diff_hunks", (1, long, "a"), (2, "++ b/x\n-- a/y\n@@ -1 +1 @@\n++ b/z", "a"), (3, "one", "a"), (3, "two\r\n\n", "b"), (4, None, "a"), (5, "x", None), (6, "", "a"))


def test_points_of_all_lines(equals):
    """Third lines that look like items, white space of all kinds, other line ends, repeated items and ids."""
    odd = ["a", "- b", "121.220 c", "\t- d", "  7) e", "* f", "\t", "g\r", "1. h", "i\u2028j", "\u00a0k\u3000", "1.5", "a", "\u00a0", "l\u0085"]
    equals("n30_points", (1, "\n".join(odd), "a"), (2, "\n".join(odd * 3 + ["1. z"] * 9), "a"), (3, "\n".join(odd[3:]), "a"), (4, "", "a"), (5, None, "a"), (6, "x\ny", None), (7, "x", "a"), (7, "x\nz", "b"))
