"""Text, path and vector functions against values computed by hand."""

import json

import pytest
from pyspark.sql import functions as F

from karstwell import schemas
from karstwell.functions import arrow_text as A
from karstwell.functions import paths as P
from karstwell.functions import text as X
from karstwell.functions import vectors as V


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


@pytest.mark.parametrize("given, want", [(None, None), ("", None), ("   ", None), ("src", "src/"), ("src/lib", "src/lib/"), (".github", ".github/"), ("/repo_a", "repo_a/"), ("repo_a/", "repo_a/"), ("a/b.py", "a/b.py"), (".eslintrc.js", ".eslintrc.js")])
def test_normalize_filter(given, want):
    assert P.normalize_filter(given) == want


@pytest.mark.parametrize("bad", ["../x", "~x", "a*", "a?", "[a]", "a\nb"])
def test_forbidden_filters(bad):
    with pytest.raises(ValueError):
        P.normalize_filter(bad)


def test_escape_like():
    assert P.escape_like("a%b_c\\d[e'") == "a\\%b\\_c\\\\d\\[e'"


def test_path_predicate(spark):
    rows = ["src/lib/a.py", "my_src/a.py", "src/module.py", "src/module.py.bak", "a_b/c"]
    assert values(spark, rows, P.in_path(F.col("x"), "src")) == [True, False, True, True, False]
    assert values(spark, rows, P.in_path(F.col("x"), "module.py")) == [False, False, True, False, False]
    assert values(spark, ["a/axb/c", "a/a_b/c"], P.in_path(F.col("x"), "a_b")) == [False, True]


def test_globs(spark):
    assert P.summarize_globs(["**/*.py", "*.TS", "**/Makefile", "src/**/x?.c"]) == ({".py", ".ts"}, {"Makefile"}, ["src/**/x?.c"])
    assert P.include_prefixes(["src/a/*.py", "lib/**"]) == ["lib", "src/a"]
    assert P.include_prefixes(["src/*.py", "**/x"]) == []
    rows = ["a/b.py", "Makefile", "src/q/x1.c", "src/x1.c", "src/q/xx1.c"]
    assert values(spark, rows, P.included(F.col("x"), ["**/*.py", "**/Makefile", "src/**/x?.c"])) == [True, True, True, True, False]
    assert values(spark, ["a/node_modules/b", "a/b.min.js", "a/b.js"], P.excluded(F.col("x"), ["**/node_modules/**", "*.min.js"])) == [True, True, False]


def test_gitignore_last_match_wins(spark):
    rules = ["# comment", "*.log", "!keep.log", "/build/", "docs/**/tmp"]
    rows = ["a/x.log", "a/keep.log", "build/x", "a/build/x", "docs/a/b/tmp", "x.txt"]
    assert values(spark, rows, P.ignored(F.col("x"), rules)) == [True, False, True, False, True, False]


def test_content_and_slugs(spark):
    assert values(spark, ["\r\n a\r\nb \t\n"], X.normalize_content(F.col("x"))) == ["a\nb"]
    assert values(spark, ["  Hello, World! ", "***", "Über äx"], X.slug(F.col("x"))) == ["hello-world", "topic", "über-äx"]
    assert values(spark, ["abc-def ghi"], X.slug(F.col("x"), max_length=4)) == ["abc"]
    assert values(spark, ["a/b", ""], X.scope_label(F.col("x"))) == ["a_b", "root"]
    assert values(spark, ["**Bold** rest", "Name: text", "one - two", "x" * 90, " "], X.heading_from_point(F.col("x"))) == ["Bold", "Name", "one", "x" * 77 + "...", "Point of Interest"]
    assert values(spark, ["f_part1_part12", "part1"], X.strip_parts(F.col("x"))) == ["f", "part1"]


def test_tokens_and_warnings(spark):
    rows = ["", "ab", "a" * 12]
    assert values(spark, rows, X.llm_tokens(F.col("x"))) == [0, 1, 3]
    assert values(spark, rows, X.chunk_tokens(F.col("x"))) == [0, 1, 4]
    got = values(spark, ["you should specify about 10 items", "x" * 4400], X.quality_warnings(F.col("x"), 500))
    assert got == [["placeholder: should specify", "vague"], ["citation_density", "verbose"]]
    assert values(spark, ["a [3] b [1] c [3][9]"], X.invalid_citations(F.col("x"), F.array(F.lit(1)))) == [[3, 9]]
    assert values(spark, ["Please note that it works\n\n\n\nyes"], X.remove_verbosity(F.col("x"))) == ["it works\n\nyes"]
    assert values(spark, [" Likely ", "??", None], X.confidence(F.col("x"))) == ["likely", "uncertain", "uncertain"]


def test_fences(spark):
    assert values(spark, ["no", "```x````"], X.fence(F.col("x"))) == ["```", "`````"]


def test_vectors(spark):
    rows = [([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.dot(a, b), V.cosine(a, b), V.euclidean(a, b), V.norm(a)).collect()
    assert [tuple(r) for r in got] == [(50.0, 1.0, 5.0, 5.0), (0.0, 0.0, 1.0, 0.0), (-1.0, -1.0, 2.0, 1.0), (0.0, 0.0, 5**0.5, 1.0)]
    assert df.select(V.cosine_literal(a, [3.0, 4.0])).first()[0] == pytest.approx(1.0)
    assert df.select(V.unit(a)).first()[0] == [0.6, 0.8]
    with pytest.raises(Exception, match="shorter"):
        df.select(V.shorten(a, 3)).collect()


def test_specificity_and_rules(spark):
    assert values(spark, ["function", "struct", "STRUCTURE", "block", "what"], schemas.specificity(F.col("x"))) == [4, 4, 0, 1, -1]
    df = spark.createDataFrame([(1, 2, "x"), (0, 2, "x"), (3, 2, "x"), (1, 1, "")], "s int, e int, c string")
    assert [r[0] for r in df.select(schemas.chunk_faults(F.col("s"), F.col("e"), F.col("c"))).collect()] == [None, "start_line", "order", "code"]


def test_citation_functions():
    assert A.sort_citations("a [11][2][1] b [5]") == "a [1][2][11] b [5]"
    assert A.linkify("see [1] `[2]`\n```\n[3]\n```\n[4](x)") == "see [[1]](#ref-1) `[2]`\n```\n[3]\n```\n[4](x)"
    assert A.cited_refs("[10] [2]\n```\n[3]\n```") == ["2", "10"]
    # one after the other from the largest: 2 becomes 1, which then becomes 3
    assert A.remap_citations("[2] and [1]", {"a": 1, "b": 2}, {"a": 3, "b": 1}) == "[3] and [3]"
    assert A.paths_to_urls("see a.md, xa.md and a.md-b", {"a.md": "U"}) == "see U, xa.md and a.md-b"
    assert A.strip_references("body\n\n---\n\n## Sources\nx\n## Next\ny") == "body\n\n## Next\ny"


def test_sources_block():
    block = "├── src/\n\t├── [1] a.py (L1-2)\n\t└── lib/\n\t\t└── [2] b.py"
    assert A.flatten_sources(block) == ["- [1] `src/a.py` (L1-2)", "- [2] `src/lib/b.py`"]
    assert A.cited_references("uses [2]", block) == ["- [2] `src/lib/b.py`"]
    with pytest.raises(ValueError):
        A.cited_references("x", "nothing")
    assert A.file_tree(["b/c.py", "a.py", "b/d/e.py"]) == "├── a.py\n└── b/\n    ├── c.py\n    └── d/\n        └── e.py"


def test_json_functions():
    assert A.json_objects('Here:\n```json\n[{"a": 1}, 2]\n```') == [{"a": 1}]
    assert A.json_objects("no") == [] and A.json_objects('x [{"a": 1}] y') == [{"a": 1}]
    assert A.json_text('x ```json\n{"a": 1}\n``` y') == '{"a": 1}' and A.json_text(" ") is None
    assert A.parameter_names('"a, b"') == ["a", "b"] and A.parameter_names('"a, 1x"') == ["a, 1x"]
    assert A.parameter_names('[{"name": "p", "type": "int"}, " q ", 3]') == ["p", "q"] and A.parameter_names("3") == []
    assert A.json_depth('{"a": [1, {"b": 2}]}') == (3, 4) and A.json_depth("{") is None


def test_facts():
    assert A.parse_fact({"statement": "s", "source": "a.py", "location": "L3-L5"}, ["a.py"])["end_line"] == 5
    assert A.parse_fact({"statement": "s", "file_path": "a.py", "start_line": 2}, [])["end_line"] == 2
    assert A.parse_fact({"statement": "s", "source": "a.py", "location": "Intro"}, [])["source_section"] == "Intro"
    assert A.parse_fact({"statement": "s", "source": "https://x"}, ["a", "b"]) is None
    assert A.parse_fact({"statement": " "}, []) is None and A.parse_fact({"statement": "s", "source": "a"}, []) is None


def test_web():
    page = '<div><a class="result__a" href="http://x">T &amp; t</a><a class="result__snippet">S</a></div><form><input type="hidden" name="s" value="10"><input type="submit" value="Next"></form>'
    assert A.web_results(page) == [{"title": "T & t", "url": "http://x", "snippet": "S"}]
    assert A.next_page(page) == {"s": "10"} and A.next_page("<p>") is None
    assert A.html_to_markdown("<h2>Hi</h2><script>x</script><p>a <b>b</b> <a href='u'>l</a></p><ul><li>1<li>2</ul>") == "## Hi\n\na **b** [l](u)\n\n* 1\n* 2"


def test_ids():
    assert A.chunk_id(1, "a\r\nb ") == A.chunk_id(1, "a\nb") != A.chunk_id(2, "a\nb")
    assert A.chunk_id(1, "a", "BLOCK") != A.chunk_id(1, "a", "DEFINITION")
    assert A.xxh3_hex("") == "2d06800538d394c2"
    assert json.loads(json.dumps(A.chunk_id(3, "x"))) == A.chunk_id(3, "x")
