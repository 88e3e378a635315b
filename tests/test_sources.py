"""Languages, ignore patterns, frontends and scans."""

import fnmatch

import pytest
from pyspark.sql import functions as F

from graftline.sources import files, ignore
from graftline.sources.frontends import parse
from graftline.sources.languages import detect_language, in_directory_scan
from graftline.sources.tree import rows


def kinds(source, language):
    return [(r[5], r[8]) for r in rows(parse(source, language), source, 1)]


def test_language_by_suffix(spark):
    df = spark.createDataFrame([("a/b.PY",), ("x.tsx",), ("noext",), ("d.ir/file",), ("m.markdown",), (None,)], "path string")
    got = [(r[0], r[1], r[2]) for r in df.select("path", detect_language(), in_directory_scan()).collect()]
    assert got == [("a/b.PY", "python", False), ("x.tsx", "tsx", True), ("noext", None, False), ("d.ir/file", None, False), ("m.markdown", "markdown", True), (None, None, None)]


@pytest.mark.parametrize(
    "pattern,path,is_dir,hit",
    [
        ("*.pyc", "test.pyc", False, True), ("node_modules/", "node_modules", True, True), ("node_modules/", "node_modules.txt", False, False),
        ("build/", "build/nested/file.js", False, True), ("build/", "src/main.js", False, False), ("node_modules", "node_modules/pkg/index.js", False, True),
        ("node_modules", "src/main.js", False, False), ("**/*.py", "src/utils/test.py", False, True), ("build/**", "build/output/test.py", False, True),
        ("/test.py", "test.py", False, True), ("/test.py", "src/test.py", False, False), ("!keep.py", "keep.py", False, False), ("[ab]?.go", "b1.go", False, True),
    ],
)
def test_ignore_matrix(spark, pattern, path, is_dir, hit):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(ignore.matches(pattern, F.col("p"), is_dir)).first()[0] is hit


def test_globs_agree_with_fnmatch(spark):
    globs = ["*.py", "a?c", "[!x]*", "src/*", "*", "a.b"]
    names = ["a.py", "abc", "xyz", "src/a/b", "a.b", "aXb", "line\n.py"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    for g in globs:
        assert [r[0] for r in df.select(F.col("p").rlike("(?s)^" + ignore.glob_regex(g) + r"\z")).collect()] == [fnmatch.fnmatchcase(n, g) for n in names], g


def test_null_path_is_never_ignored(spark):
    df = spark.createDataFrame([(None,)], "p string")
    assert df.select(ignore.ignored(F.col("p"), ["*", "a/", "**"])).first()[0] is False


def test_directory_rules_anti_join(spark):
    f = spark.createDataFrame([(1, "r", "vendor/a.py"), (2, "r", "src/a.py"), (3, "q", "vendor/a.py"), (4, "r", None)], "id int, repo string, rel_path string")
    rules = spark.createDataFrame([("r", "", "vendor/"), ("r", "", None), ("r", "src", "x")], "repo string, base string, pattern string")
    assert sorted(r[0] for r in ignore.drop_by_directory(f, rules, "repo").collect()) == [2, 3, 4]


def test_scan_directory_with_ignore_file(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name in ("a.py", "src/b.py", "src/b.gen.py", "c.PY", "d.txt"):
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / "src" / ".scanignore").write_text("# no\n\n*.gen.py\n")
    got = sorted(r[0] for r in files.scan(spark, str(tmp_path)).select("rel_path").collect())
    assert got == ["a.py", "src/b.py"]
    assert [r[0] for r in files.scan(spark, str(tmp_path / "c.PY")).select("language").collect()] == ["python"]
    assert files.scan(spark, str(tmp_path / "missing")).count() == 0


def test_parse_errors_are_kept_apart(spark):
    df = spark.createDataFrame([(1, "python", b"def f(:\n"), (2, "python", b"x = 1\n"), (3, "cobol", b"x"), (4, "python", None)], "file_id long, language string, source binary")
    n = files.parse_files(df)
    assert sorted(r[0] for r in n.filter("parse_error is not null").select("tree_id").collect()) == [1, 3]
    assert sorted(r[0] for r in files.parsed(n).select("tree_id").distinct().collect()) == [2, 4]


def test_python_with_errors_keeps_its_tree(spark):
    good = "import os\n\n\n@cached\ndef f(a, b=1):\n    # adds\n    return a + b\n"
    bad = good + "\n\nclass C:\n    def g(self):\n        x = = 1\n        return x\n\n    def h(self, (a)):\n        return 1\n\n\ny = (1,\ndef k():\n    return 2\n"
    df = spark.createDataFrame([(1, "python", good.encode()), (2, "python", bad.encode()), (3, "python", b"def f(:\n"), (4, "python", b"a = 1\0\n")], "file_id long, language string, source binary")
    n = files.parse_files(df, tolerant=True)
    assert n.filter("parse_error is not null").count() == 0
    got = {i: [(r["kind"], r["text"]) for r in n.filter(f"tree_id = {i}").orderBy("seq").collect()] for i in (1, 2, 3, 4)}
    sound = len(got[1])
    assert got[2][1:sound] == got[1][1:]
    names = [(r["kind"], r["text"]) for r in n.filter("tree_id = 2 and field = 'name'").orderBy("seq").collect()]
    assert names == [("identifier", x) for x in "fCghk"]
    assert [t for k, t in got[2] if k == "ERROR"] == ["x = = 1", "(self, (a)):", "y = (1,"]
    assert ("return_statement", "return x") in got[2] and got[3][0] == ("module", "def f(:\n") and "assignment" in dict(got[4])


def test_python_tree_has_signature_leaves():
    got = kinds("def f(a, b=1):\n    return a + b\n", "python")
    assert [k for k, _ in got][:6] == ["module", "function_definition", "def", "identifier", "parameters", "("]


def test_pre_order_intervals():
    src = "class A {\n  f(x) { return [1, {a: 2}]; }\n}\n"
    got = rows(parse(src, "javascript"), src, 7)
    for r in got:
        inside = [q for q in got if r[1] < q[1] <= r[3]]
        assert all(r[11] <= q[11] and q[12] <= r[12] for q in inside)
        assert r[7] == sum(q[2] == r[1] for q in got)


@pytest.mark.parametrize("language,source,kind", [
    ("go", "package a\nfunc (t *T) f(x int) int {\n  return x\n}\n", "method_declaration"), ("rust", "fn f(x: i64) -> i64 {\n    x\n}\n", "function_item"),
    ("java", "public class A {\n  public int f(int x) {\n    return x;\n  }\n}\n", "method_declaration"), ("css", ".a { color: red; }\n", "rule_set"),
    ("sql", "SELECT a FROM t;\n", "select"), ("yaml", "a:\n  b: 1\n", "block_mapping_pair"), ("bash", "f() {\n  echo 1\n}\n", "function_definition"),
    ("kotlin", "fun f(x: Int): Int {\n  return x\n}\n", "function_declaration"), ("html", "<html><head><title>x</title></head></html>", "start_tag"),
    ("astro", "---\nconst a = 1;\n---\n<div>x</div>\n", "frontmatter_js_block"), ("markdown", "# T\n\n```py\nx = 1\n```\n", "fenced_code_block"),
])
def test_frontends_give_their_kinds(language, source, kind):
    assert kind in [k for k, _ in kinds(source, language)]


def test_text_nodes(spark):
    df = spark.createDataFrame([(1, "a b\nc\n\n  \nd"), (2, ""), (3, None)], "doc_id long, text string")
    got = [tuple(r) for r in files.text_nodes(df).orderBy("tree_id", "seq").select("tree_id", "seq", "parent_seq", "end_seq", "kind", "start_line", "end_line").collect()]
    assert [g[4] for g in got if g[0] == 1] == ["document", "paragraph", "line", "word", "word", "line", "word", "paragraph", "line", "word"]
    assert [g for g in got if g[0] == 2] == [(2, 0, None, 0, "document", 1, 1)]
    one = {g[1]: g for g in got if g[0] == 1}
    assert one[0][3] == 9 and one[1][3] == 6 and one[2][3] == 4 and one[7][3] == 9 and one[7][5:] == (5, 5)
