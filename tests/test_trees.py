"""Results of the per-tree operators against those over the node table."""

from __future__ import annotations

from pyspark.sql import functions as F

from graftline.operators import inspect, regions, rules, shingles, trees
from graftline.sources import files as sources

MD = "# T\n\n```python\nimport os\ndef f(a):\n    b = a\n    return b\n```\n\ntext\n\n```nope\nx\n```\n"
CODE = {
    "python": "﻿﻿ import os\n\ndef f(a, é):\r\n    '''doc'''\n    # c\n    if TYPE_CHECKING:\n        pass\n    return g(a, 'x\ty', é)\n\nclass C(B):\n    def f(self):\n        return [1, self.a → 2]\n",
    "javascript": "import x from 'y';\nexport function a(x) {\n  const y = (p) => {\n    return p + 1;\n  };\n\treturn `t`;\n}\nclass K { m() { return [1, 2]; } }\n",
    "go": "package m\n\nimport \"fmt\"\n\n// c\nfunc F(a int) int {\n\tb := a + 1\n\treturn b\n}\n\ntype T struct {\n\tx int\n}\n",
    "java": "import a.B;\nclass C {\n  /* c */\n  int m(int a) {\n    return a + 1;\n  }\n}\n",
    "rust": "use a::b;\n#[x]\nfn f<'a>(s: &'a str) -> u8 {\n  println!(\"{}\", s);\n  let t = 1;\n  t\n}\n",
    "sql": "create table t (a int);\n-- c\nselect a, b from t where a = 1 and\n a in (select a\n from u\n);\n",
    "html": "<html><head>\n<title>x</title>\n</head><body a='1'>\n<!-- c -->\n<p>t</p>\n</body></html>\n",
    "css": "a, .b { color: red; }\n@media x {\n .c {\n  top: 1px;\n }\n}\n",
    "markdown": MD,
    "yaml": "a: 1\nb:\n  - &x c\n  - *x\n",
    "bash": "f() {\n  # c\n  if [ -z \"$A\" ]; then\n    echo 'x'\n  fi\n}\n",
}


def table(spark):
    data = [(i, f"p{i}", x, t.encode() + (b"\xff = 1\n" if x == "python" else b"")) for i, (x, t) in enumerate(CODE.items())]
    data += [(90, "p90", "python", None), (91, "p91", "unknown", b"x"), (92, "p92", "go", b"")]
    return spark.createDataFrame(data, "file_id long, path string, language string, source binary")


def test_transformed_files_equal_the_view_over_nodes(spark):
    f = table(spark)
    for name in ("default", "loose", "none"):
        rs = rules.build_rules(name)
        n = sources.parsed(sources.parse_files(f, tolerant=True, texts=rules.text_kinds(rs))).join(f.select(F.col("file_id").alias("tree_id"), F.col("language").alias("shingle_language")), "tree_id")
        want = sorted(map(tuple, inspect.transformed_source(n, rs, f.select("file_id", "source")).collect()))
        got = sorted(map(tuple, trees.transformed_files(f, rs, rules.text_kinds(rs)).collect()))
        assert got == want and len(got) > 20


def test_the_view_of_all_files_shuffles_no_nodes(spark, tmp_path):
    from graftline.plans.catalog import QUERIES

    f = table(spark).select("file_id", F.lit(1).alias("run_id"), F.col("path").alias("rel_path"), F.concat("path", F.lit(".py")).alias("path"), "source", F.current_timestamp().alias("ingested_at"))
    f.write.parquet(str(tmp_path / "source_files.parquet"))
    df = QUERIES["t2_transformed_source"](spark, str(tmp_path))
    assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_regions_and_shingles_equal_those_over_nodes(spark):
    """As the pipeline found them over the node table: regions, trees, shingles, first lines."""
    from graftline.functions.expressions import base_hash
    from graftline.operators import verify
    from graftline.plans.pipeline import detect_files
    from graftline.settings import Settings

    again = spark.createDataFrame([(95, "p1", "javascript", b"\n" + CODE["javascript"].encode()), (96, "p1", "javascript", CODE["javascript"].encode())], table(spark).schema)
    f = table(spark).unionByName(again).filter("language <> 'unknown'")
    for name in ("default", "loose"):
        rs = rules.build_rules(name)
        nodes = sources.parsed(sources.parse_files(f, tolerant=True, texts=rules.text_kinds(rs))).localCheckpoint()
        found = regions.at_least(regions.extract(nodes, f.select("file_id", "path", "language"), rs), 2)
        # files of one path and lines: the choice between them is left open, so only distinct ones compare
        inner = regions.injections(found, nodes)
        more = sources.parsed(sources.parse_files(inner.select(F.col("region_id").alias("file_id"), "language", "source", "line_offset"), tolerant=True, texts=rules.text_kinds(rs)))
        found = regions.with_injections(found, inner, more).localCheckpoint()
        sh = shingles.shingle_regions(nodes.unionByName(more), found, rs, 3)
        got = detect_files(f, Settings(ruleset=name, min_lines=2))
        cols = ["region_id", "path", "language", "shingle_language", "region_type", "region_name", "start_line", "end_line", "root_seq", "end_seq", "start_byte", "end_byte", "inject"]
        assert sorted(map(str, found.select(cols).collect())) == sorted(map(str, got.regions.select(cols).collect()))
        cols = ["region_id", "seq", "content", "start_line", "end_line"]
        want = sorted(map(tuple, sh.select(cols).collect()))
        assert want == sorted(map(tuple, got.shingles.select(cols).collect())) and len(want) > 200
        lines = lambda d: sorted(map(str, d.collect()))
        assert lines(verify.signature_lines(found.filter("path <> 'p1'"), f)) == lines(got.regions.filter("path <> 'p1'").select("region_id", "signature"))
        sets = sh.groupBy("region_id").agg(F.array_sort(F.collect_set(base_hash("content"))).alias("h"), F.count(F.lit(1)).alias("n"))
        raw = trees.found(f.filter("file_id not in (95, 96)"), rs, rules.text_kinds(rs), 3, 2).filter("size(contents) > 0")
        raw = raw.select(F.xxhash64("path", "start_line", "end_line").alias("region_id"), F.array_sort(F.array_distinct(F.transform("contents", trees.print_hash))).alias("h"), F.size("contents").cast("long").alias("n"))
        assert set(lines(raw.join(found.filter("path <> 'p1'"), "region_id", "left_semi"))) == set(lines(sets.join(found.filter("path <> 'p1'"), "region_id", "left_semi")))
        assert got.stages["shingle"][0] == len(want)


def test_low_bits_rule_out_no_pair_that_reaches_the_threshold(spark):
    import random

    from graftline.functions.expressions import jaccard_estimate
    from graftline.operators import lsh

    rng = random.Random(4)
    sigs = []
    for i in range(60):
        sig = [rng.randrange(2**31 - 1) for _ in range(128)] if i % 10 == 0 else [v if rng.random() < 0.8 - i % 10 / 20 else rng.randrange(2**31 - 1) for v in sigs[i - i % 10][1]]
        sigs.append((i, sig))
    s = spark.createDataFrame(sigs + [(60, sigs[0][1][:64]), (61, [None, *sigs[0][1][1:]])], "region_id long, sig array<long>").select("region_id", "sig", lsh._low_bits(128).alias("bits"))
    p = s.toDF("a", "sa", "x").crossJoin(s.toDF("b", "sb", "y")).filter("a < b")
    got = p.select("a", "b", (jaccard_estimate("sa", "sb") >= 0.64).alias("near"), lsh._can_agree(F.col("x"), F.col("y"), 128, 0.64).alias("fits")).collect()
    assert all(r["fits"] for r in got if r["near"]) and any(r["near"] for r in got)
    assert sum(not r["fits"] for r in got) > 0.8 * len(got)
