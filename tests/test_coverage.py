"""Parsers, discovery, the vector index, live queues and exploration on hand-made rows."""

import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from karstwell.functions import arrow_text as A
from karstwell.operators import discovery as D
from karstwell.operators import index as X
from karstwell.operators import parsing
from karstwell.operators import research as R
from karstwell.operators import search as S
from karstwell.streaming import live as L


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- parsers ----------------------------------------------------------------------------------------------------------------

PYTHON = '''"""Doc."""
import os
from a.b import c, d as e

# one
# two
X = 1
Y = 2

@deco
def f(a):
    # inside
    return a

class A(B):
    z = 1

    async def g(self):
        pass

print(f)
'''


def test_python_concepts():
    got = parsing.parse(PYTHON, "python")
    assert got == [
        ("block_1", "BLOCK", 1, 1), ("os", "IMPORT", 2, 2), ("a.b: c, e", "IMPORT", 3, 3), ("comment_5", "COMMENT", 5, 6), ("block_7", "BLOCK", 7, 8), ("f", "DEFINITION", 10, 13),
        ("comment_12", "COMMENT", 12, 12), ("A", "DEFINITION", 15, 19), ("A.g", "DEFINITION", 18, 19), ("block_21", "BLOCK", 21, 21),
    ]
    assert parsing.parse("def broken(:\n\nx", "python") == parsing.paragraphs("def broken(:\n\nx") == [("paragraph_1", "BLOCK", 1, 1), ("paragraph_3", "BLOCK", 3, 3)]


BRACES = """// head
#include <x.h>
import y;

int main(int argc,
         char** argv) {
  char c = '{'; /* } */
  if (c) { return 1; }
  return "}";
}

let k = 1;
class Foo extends Bar { a() {} }
export const go = (x) => {
  x
};
"""


def test_braced_concepts():
    assert parsing.parse(BRACES, "cpp") == [
        ("comment_1", "COMMENT", 1, 1), ("#include <x.h>", "IMPORT", 2, 2), ("import y", "IMPORT", 3, 3), ("main", "DEFINITION", 5, 10), ("block_12", "BLOCK", 12, 12),
        ("Foo", "DEFINITION", 13, 13), ("go", "DEFINITION", 14, 16),
    ]
    assert [c[0] for c in parsing.parse("a {\n\nb", "go")] == ["paragraph_1", "paragraph_3"]  # never closed


def test_other_concepts():
    assert parsing.parse("intro\n# A\ntext\n## B #\n```\n# no\n```", "markdown") == [("preamble", "BLOCK", 1, 1), ("A", "DEFINITION", 2, 3), ("B", "DEFINITION", 4, 7), ("code_5", "BLOCK", 5, 7)]
    assert parsing.parse('{"a": "x, {", "b":\n [1,\n 2]}', "json") == [("b", "DEFINITION", 1, 3), ("a", "DEFINITION", 1, 1)]
    assert parsing.parse("[1,\n{}]", "json") == [("item_1", "DEFINITION", 1, 1), ("item_2", "DEFINITION", 2, 2)] and parsing.parse("}{", "json") == [("paragraph_1", "BLOCK", 1, 1)]
    assert parsing.parse("a: 1\nb:\n  c: 2\n\n", "yaml") == [("a", "DEFINITION", 1, 1), ("b", "DEFINITION", 2, 3)]
    assert parsing.parse('x = 1\n[t]\ny = 2\n[[u]]\nz = 3', "toml") == [("block_1", "BLOCK", 1, 1), ("t", "DEFINITION", 2, 3), ("u", "DEFINITION", 4, 5)]
    assert parsing.parse("SELECT 1;\n\nCREATE TABLE IF NOT EXISTS t (\n a INT);", "sql") == [("statement_1", "BLOCK", 1, 1), ("t", "DEFINITION", 3, 4)]
    for language in [*parsing.PARSERS, None, "unknown"]:
        assert parsing.parse("", language) == [] or language in ("makefile", "yaml", "toml")
        assert all(1 <= a <= b <= 3 for _, _, a, b in parsing.parse("x: {\n}\n", language))


def test_parse_files(spark):
    got = rows(parsing.parse_files(spark.createDataFrame([(1, "python", "x = 1\n"), (2, None, "a\n\nb"), (3, "json", None), (4, "python", "  \n")], "file_id long, language string, text string")))
    assert got == [(1, "block_1", "BLOCK", "x = 1", 1, 1), (2, "paragraph_1", "BLOCK", "a", 1, 1), (2, "paragraph_3", "BLOCK", "b", 3, 3)]


def test_parameters():
    assert A.parameters('[{"name": "a", "type": "int"}, "b", {"type": "x"}, 3]') == [{"name": "a", "type": "int"}, {"name": "b", "type": None}]
    assert A.parameters('["a: int", "b"]') == [{"name": "a", "type": "int"}, {"name": "b", "type": None}] and A.parameters("no") == []


# -- discovery ---------------------------------------------------------------------------------------------------------------


def test_backends_agree(spark, tmp_path):
    for name in ("src/a.py", "src/deep/b.py", "src/node_modules/c.py", "docs/d.md", "e.log", "f.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("*.log\n")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    options = {"include": ["**/*.py", "docs/**"], "exclude": ["**/deep/**"]}
    want = [("docs/d.md",), ("f.py",), ("src/a.py",)]
    for backend in ("auto", "git", "scan"):
        assert rows(D.discover(spark, str(tmp_path), backend=backend, ignore=["*.log"], **options)) == want
    assert rows(D.discover(spark, str(tmp_path), backend="git")) == [(".gitignore",), ("docs/d.md",), ("f.py",), ("src/a.py",), ("src/deep/b.py",)]
    with pytest.raises(ValueError):
        D.discover(spark, str(tmp_path), backend="x")


# -- index ----------------------------------------------------------------------------------------------------------------


def test_index_reads_few_lists(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 6)) * 4
    x = np.concatenate([c + rng.normal(size=(40, 6)) for c in centres])
    table = [(i, [float(a) for a in v], 6) for i, v in enumerate(x)] + [(900, [0.0] * 6, 6), (901, None, 6)]
    e = spark.createDataFrame(table, "chunk_id long, embedding array<float>, dims int")
    X.build_index(e, f"{tmp_path}/i", lists=8)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = 0
    for q in (3, 100, 200, 310):
        best = set(np.argsort(-(u @ u[q]))[:10].tolist())
        few = X.search_index(spark, f"{tmp_path}/i", x[q].tolist(), size=10, probes=3)
        assert "PartitionFilters: [" in few._jdf.queryExecution().toString() and few.count() == 10
        found += len(best & {r["chunk_id"] for r in few.collect()})
        every = X.search_index(spark, f"{tmp_path}/i", x[q].tolist(), size=10, probes=99).collect()
        assert {r["chunk_id"] for r in every} == best and every[0]["chunk_id"] == q
    assert found >= 36
    X.build_index(e.limit(0), f"{tmp_path}/none")
    assert X.search_index(spark, f"{tmp_path}/none", [1.0] * 6, size=3).count() == 0


# -- symbols ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [0, 1000])
def test_symbols_of_any_characters(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW_SYMBOLS", few)
    code = ["x = foo-bar + $y", "foo", "foobar", "a -> b", "a->b", "$y", "foo.bar", "", "-> foo-bar", "$$"]
    c = spark.createDataFrame([(i, "p", i, t, "own") for i, t in enumerate(code)], "chunk_id long, path string, start_line int, code string, symbol string")
    import re

    symbols = ["foo", "foo-bar", "$y", "->", "bar", "$$", "none", ""]
    asked = spark.createDataFrame([(s,) for s in symbols] + [(None,)], "symbol string")
    got = {(r["symbol"], r["chunk_id"]) for r in S.search_by_symbols(c, asked, per_symbol=99).collect()}
    guard = lambda s: ("\\b" if re.match(r"\w", s) else r"(?:^|\W)") + re.escape(s) + ("\\b" if re.search(r"\w$", s) else r"(?:\W|$)")
    assert got == {(s, i) for s in symbols if s for i, t in enumerate(code) if re.search(guard(s), t)}
    assert len(S.search_by_symbols(c, asked, per_symbol=1).collect()) == len({s for s, _ in got})


# -- live ----------------------------------------------------------------------------------------------------------------


def test_delete_batches(spark):
    kinds = ["delete"] * 5 + ["change"] + ["delete"] * 2 + ["embed"] * 2 + ["delete"]
    df = spark.createDataFrame([(10 * i, k) for i, k in enumerate(kinds)], "seq long, operation string")
    got = {r["seq"]: r["batch"] for r in L.delete_batches(df, most=2).collect()}
    assert [got[10 * i] for i in range(11)] == [0, 0, 2, 2, 4, None, 6, 6, None, None, 10]
    assert L.delete_batches(df.limit(0)).count() == 0


def test_overflow(spark):
    a = spark.createDataFrame([("q", 1, 5), ("q", 2, 9), ("q", 3, 2), ("q", 9, 30), ("r", 1, 10)], "queue string, tick long, events long")
    assert rows(L.overflow_bursts(a, capacity=10, drained=2)) == [("q", 1, 2, 2, 2), ("q", 2, 9, 9, 20)]


def test_retries_and_follow_ups(spark):
    f = spark.createDataFrame([("a", i, 0) for i in range(7)], "path string, seq long, z long").select("path", "seq", F.timestamp_seconds("z").alias("ts"))
    got = L.retries(f).orderBy("seq").collect()
    assert [r["delay"] for r in got] == [pytest.approx(0.1 * 2**i) for i in range(5)] + [None, None] and got[6]["due"] is None
    t = lambda x: F.timestamp_seconds(x)
    c = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("a", 7, 3), ("a", 20, 4), ("b", 5, 5)], "path string, at int, generation long").select("path", t("at").alias("ts"), "generation")
    p = spark.createDataFrame([("a", 1, 10), ("a", 30, 40), ("b", 6, 9)], "path string, s int, e int").select("path", t("s").alias("started"), t("e").alias("finished"))
    assert [(r["path"], r["generation"]) for r in L.follow_ups(c, p).collect()] == [("a", 3)]


# -- exploration -----------------------------------------------------------------------------------------------------------


def test_breadth_first(spark):
    f = spark.createDataFrame([(1, 10 + i, i) for i in range(5)] + [(14, 1, 9), (14, 20, 1), (13, 20, 5), (20, 30, 1)], "node long, next long, score int")
    got = rows(R.breadth_first(spark.createDataFrame([(1,), (1,)], "node long"), f, levels=3))
    assert got == [(1, 0), (12, 1), (13, 1), (14, 1), (20, 2), (30, 3)]


def test_explore_depth_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    e = spark.createDataFrame([(i, v.tolist(), 5) for i, v in enumerate(x)], "chunk_id long, embedding array<double>, dims int")
    files = spark.createDataFrame([(i, f"f{i % 7}") for i in range(60)], "chunk_id long, path string")
    score = {i: float((i * 13) % 11) for i in range(0, 30)}
    covered = spark.createDataFrame(list(score.items()), "chunk_id long, score double")
    got = [(r["path"], r["query"], r["chunk_id"]) for r in R.explore_depth(e, files, covered, files_kept=2, queries=2, size=3).collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = {p: np.mean([s for i, s in score.items() if i % 7 == p]) for p in range(7)}
    seen, want = set(score), []
    for p in sorted(mean, key=lambda p: (-mean[p], f"f{p}"))[:2]:
        for n, q in enumerate(sorted((i for i in score if i % 7 == p), key=lambda i: (-score[i], i))[:2], 1):
            near = sorted((i for i in range(60) if i not in seen), key=lambda i: (-(u[i] @ u[q]), i))[:3]
            seen |= set(near)
            want += [(f"f{p}", n, i) for i in near]
    assert got == want


def test_tree_lines_are_the_tree(spark):
    paths = ["src/a/x.py", "src/a/y.py", "src/b.py", "doc/z.md", "one"]
    df = spark.createDataFrame([("g", p) for p in paths] + [("h", "k/l")], "group string, path string")
    lines = R.file_tree_lines(df).where("group = 'g'").orderBy("node").collect()
    assert "\n".join(r["line"] for r in lines) == A.file_tree(paths)


def test_rerank_in_batches(spark):
    d = spark.createDataFrame([(i, "the thing" if i % 3 == 0 else None) for i in range(10)], "doc_id long, text string")
    got = R.rerank_in_batches(d, S.term_overlap("the thing", F.col("text")), key="doc_id", order=["doc_id"], size=4).orderBy("doc_id").collect()
    assert [r["batch"] for r in got] == [0] * 4 + [1] * 4 + [2] * 2 and [r["rerank_score"] for r in got] == [1.0 if i % 3 == 0 else 0.0 for i in range(10)]
