"""Rules, shingles, signatures, groups, verification and reports on small fixtures."""

import json
import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graftline.functions import expressions as X
from graftline.operators import diff, lsh, minhash, regions, report, rules, shingles, verify
from graftline.operators.components import connected_components
from graftline.plans.pipeline import detect_files
from graftline.settings import Settings
from graftline.sources import files as sources

FILES = "file_id long, path string, language string, source binary"
TWO = b"def first(rows):\n    out = 0\n    for row in rows:\n        if row > 10:\n            out += row\n    return out\n\n\ndef second(items):\n    acc = 0\n    for item in items:\n        if item > 10:\n            acc += item\n    return acc\n"


def groups_of(spark, files, **kw):
    df = spark.createDataFrame(files, FILES)
    d = detect_files(df, Settings(**kw))
    out = defaultdict(list)
    for r in d.members.join(d.regions.select("region_id", "path", "start_line", "end_line"), "region_id").collect():
        out[r["group_id"]].append((r["path"], r["start_line"], r["end_line"]))
    return sorted(sorted(v) for v in out.values()), d


def test_renamed_clone_needs_anonymised_names(spark):
    js = b"function alpha(x) {\n  const y = x + 1;\n  log(y);\n  return y * 2;\n}\n\nfunction beta(x) {\n  const y = x + 1;\n  log(y);\n  return y * 2;\n}\n"
    one = [(1, "a.js", "javascript", js)]
    for name, n in (("default", 1), ("loose", 1), ("none", 0)):
        got, _ = groups_of(spark, one, ruleset=name, similarity=1.0)
        assert len(got) == n, name


def test_loose_groups_renamed_locals(spark):
    got, d = groups_of(spark, [(1, "p.py", "python", TWO)], ruleset="loose", similarity=0.9)
    assert got == [[("p.py", 1, 6), ("p.py", 9, 14)]]
    assert d.groups.first()["similarity"] == 1.0
    assert [s[0] for s in d.stage_table()] == ["parse", "extract", "shingle", "minhash", "lsh", "verify"]


def test_min_lines_and_empty_input(spark):
    got, _ = groups_of(spark, [(1, "p.py", "python", b"def a():\n    return 1\n\ndef b():\n    return 1\n")], similarity=0.5)
    assert got == []
    got, d = groups_of(spark, [], similarity=0.5)
    assert got == [] and d.stages["minhash"][0] == 0


def test_injected_code_keeps_the_files_language(spark):
    md = b"# T\n\n```python\n" + TWO + b"```\n"
    got, d = groups_of(spark, [(1, "g.md", "markdown", md), (2, "p.py", "python", TWO)], similarity=0.5)
    r = d.regions.filter("region_type = 'code_block'").first()
    assert (r["language"], r["shingle_language"], r["start_line"]) == ("markdown", "python", 3)
    # the same code gives the same shingles
    c = d.shingles.join(d.regions.select("region_id", "region_type"), "region_id")
    inside = {x[0] for x in c.filter("region_type = 'code_block'").select("content").collect()}
    alone = {x[0] for x in c.filter("region_type = 'function_definition'").select("content").collect()}
    assert len(inside & alone) > 0.8 * len(alone)


def test_rule_counts_and_sets():
    assert len(rules.region_rules()) == 48
    assert len(rules.ruleset("unknown")) == len(rules.ruleset("none")) == 48
    assert len(rules.ruleset("default")) == 48 + 59 - 15
    assert len(rules.ruleset("loose")) == 48 + 116 - 27
    added = rules.build_rules("none", additional={"go": ["b", "a"]})
    assert [r.name for r in added[-2:]] == ["a", "b"]
    assert all(r.action is rules.Action.EXTRACT for r in rules.build_rules("loose", excluded={"css": ["rule_set"]}))
    assert not any(r.params.get("region_type") == "rule_set" for r in rules.build_rules("loose", excluded={"css": ["rule_set"]}))
    assert rules.parse_region_specs(["Py:a,b", "py:b,c"]) == {"py": ("a", "b", "c")}
    with pytest.raises(ValueError):
        rules.parse_region_specs(["py:"])
    with pytest.raises(ValueError):
        rules.load_rules({"rulesets": {"a": {"extends": "b"}, "b": {"extends": "a"}}})
    got = rules.load_rules({"rulesets": {"a": {"rules": [{"name": "n", "languages": ["go"], "kinds": ["x"], "action": "remove"}]}, "b": {"extends": "a"}}})
    assert [r.name for r in got] == ["n", "n"]


def test_name_anonymised_truth_table():
    assert rules.anonymises_name(rules.ruleset("default"), "python", "function_definition")
    assert rules.anonymises_name(rules.ruleset("default"), "javascript", "function")
    assert not rules.anonymises_name(rules.ruleset("none"), "javascript", "function")
    assert not rules.anonymises_name(rules.ruleset("default"), "css", "rule_set")


def tree(rng, n):
    """A random tree as node tuples (seq, parent, kind, text)."""
    parents = [None] + [rng.randrange(i) for i in range(1, n)]
    kids = defaultdict(list)
    for i, p in enumerate(parents):
        if p is not None:
            kids[p].append(i)
    order, stack = [], [(0, None)]
    while stack:
        x, up = stack.pop()
        seq = len(order)
        order.append((seq, up, rng.choice("abcd"), rng.choice("xyz"), len(kids[x])))
        stack += [(k, seq) for k in reversed(kids[x])]
    return order


def test_shingles_match_a_recursive_walk(spark):
    rng = random.Random(3)
    rs = [rules.Rule("r", ("*",), rules.Match(("d",)), rules.Action.REMOVE), rules.Rule("v", ("*",), rules.Match(("a",)), rules.Action.ANONYMIZE, {"prefix": "VAR"}), rules.Rule("t", ("*",), rules.Match(("b",)), rules.Action.REPLACE_TYPE, {"token": "<B>"})]
    data, want = [], Counter()
    for t in range(12):
        nodes = tree(rng, 25)
        ends = {s: s for s, *_ in nodes}
        for s, up, *_ in reversed(nodes):
            if up is not None:
                ends[up] = max(ends[up], ends[s])
        data += [(t, s, up, ends[s], 1, k, None, n, x, s + 1, s + 1, 0, 0, t, "any") for s, up, k, x, n in nodes]
        seen: dict = {}
        kids = defaultdict(list)
        by = {s: (k, x, n) for s, _, k, x, n in nodes}
        for s, up, *_ in nodes:
            kids[up].append(s)

        def walk(s, path):
            k, x, n = by[s]
            if k == "d":
                return
            if k == "a":
                seen.setdefault(x, len(seen) + 1)
                rep = f"a(VAR_{seen[x]})"
            else:
                rep = ("<B>" if k == "b" else k) + (f"({x})" if n == 0 else "")
            path = [*path, rep]
            if len(path) >= 3:
                want[(t, "→".join(path[-3:]), s + 1)] += 1
            for c in kids[s]:
                walk(c, path)

        walk(0, [])
    df = spark.createDataFrame(data, sources.NODE_SCHEMA + ", region_id long, shingle_language string")
    got = shingles.path_kgrams(shingles.normalised(shingles.with_parents(df), rs), 3)
    assert Counter((r["region_id"], r["content"], r["start_line"]) for r in got.collect()) == want
    with pytest.raises(ValueError):
        shingles.path_kgrams(df, 0)


def test_later_rules_win_per_slot(spark):
    rs = [rules.Rule("n", ("*",), rules.Match(("i",)), rules.Action.ANONYMIZE), rules.Rule("f", ("*",), rules.Match(("i",), text=("eq", "f")), rules.Action.REPLACE_VALUE, {"value": "FUNC"})]
    rows = [(1, i, 0 if i else None, 3 if not i else i, 1, "i" if i else "root", None, 0 if i else 3, x, 1, 1, 0, 0, 1, "x") for i, x in enumerate(["", "f", "g", "f"])]
    df = spark.createDataFrame(rows, sources.NODE_SCHEMA + ", region_id long, shingle_language string")
    got = [r[0] for r in shingles.normalised(shingles.with_parents(df), rs).orderBy("seq").select("rep").collect()]
    # the overwritten name still takes its number
    assert got == ["root", "i(FUNC)", "i(VAR_2)", "i(FUNC)"]


def test_values_and_rendering(spark):
    df = spark.createDataFrame([("a→b\n\tc",), ("x" * 60,), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(X.leaf_value("t"), X.render(F.lit("k"), X.leaf_value("t"))).collect()]
    assert got[0] == ("a->b\\n\\tc", "k(a->b\\n\\tc)") and len(got[1][0]) == 50 and got[2][1] == got[3][1] == "k"


def test_region_dedup_prefers_explicit_types(spark):
    df = spark.createDataFrame([("p", 1, 5, "block", 1), ("p", 1, 5, "function", 2), ("p", 1, 5, "class", 3), ("p", 2, 5, "block", 4), ("p", 2, 5, "pair", 5)], "path string, start_line int, end_line int, region_type string, n int")
    assert sorted(r["n"] for r in regions.deduplicated(df, ["n"]).collect()) == [2, 4]


def test_fence_languages(spark):
    df = spark.createDataFrame([("py title=x",), ("YML",), ("",), ("brainfog",), ("  js  ",)], "i string")
    assert [r[0] for r in df.select(regions.fence_language("i")).collect()] == ["python", "yaml", "", "", "javascript"]


def test_signatures_equal_the_definition(spark):
    import hashlib

    data = [(1, 0, "a"), (1, 1, "b"), (1, 1, "b"), (1, 2, "a"), (2, 0, "é→"), (3, 0, None), (4, 0, None), (4, 1, "z")]
    df = spark.createDataFrame(data, "region_id long, seq int, content string")
    got = {r["region_id"]: r for r in minhash.signatures(df).collect()}
    p = X.P
    for rid, contents in ((1, "ab"), (2, ["é→"]), (4, "z")):
        h = [int.from_bytes(hashlib.md5(c.encode()).digest()[:4], "big") % p for c in contents]
        assert got[rid]["sig"] == [min((x * a + b) % p for x in h) for a, b in X.coefficients()]
    assert got[1]["shingle_count"] == 3 and got[3]["sig"] == [] and got[3]["shingle_count"] == 0
    assert X.coefficients(1) == [(48271 * 20231 % p, 48271 * (48271 * 20231 % p) % p)]


def test_band_shapes():
    for t, s in lsh.SHAPES.items():
        assert lsh.band_shape(t, 128, 0.005) == s


def test_group_mean_equals_all_pairs(spark):
    rng = random.Random(5)
    sig = {i: [rng.randrange(3) for _ in range(128)] for i in range(9)}
    group = {i: i % 2 for i in sig}
    m = spark.createDataFrame([(g, i) for i, g in group.items()], "group_id long, region_id long")
    s = spark.createDataFrame(list(sig.items()), "region_id long, sig array<long>")
    for r in lsh.group_means(m, s).collect():
        ids = [i for i in sig if group[i] == r["group_id"]]
        pairs = [(a, b) for a in ids for b in ids if a < b]
        want = sum(sum(x == y for x, y in zip(sig[a], sig[b])) / 128 for a, b in pairs) / len(pairs)
        assert r["similarity"] == pytest.approx(want)


def test_links_join_what_all_pairs_join(spark):
    #: a1 in p, a2 in q; b1 nested in a1, b2 in r: only a2-b1 makes one group of the four
    near = [1] * 120 + [2] * 8
    cases = [[(1, "p", 1, 20, 1), (2, "q", 1, 20, 1), (3, "p", 5, 9, 2), (4, "r", 1, 9, 2)]]
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(2, 8)
        spots = [(rng.choice("pq" if rng.random() < 0.5 else "p"), s := rng.randrange(12), s + rng.randrange(10)) for _ in range(n)]
        cases.append([(i + 1, *x, rng.randrange(1, 3)) for i, x in enumerate(spots)])
    rows = [(k * 100 + i, f"{k}{p}", s, e, [k * 1000 + v for v in ([1] * 128 if t == 1 else near)]) for k, c in enumerate(cases) for i, p, s, e, t in c]
    x = spark.createDataFrame([r[:4] for r in rows], "region_id long, path string, start_line int, end_line int")
    s = spark.createDataFrame([(r[0], r[4]) for r in rows], "region_id long, sig array<long>")
    found = [tuple(r)[:2] for r in lsh.links(s, x, Settings()).collect()]
    place = {r[0]: r[1:4] for r in rows}
    apart = lambda a, b: place[a][0] != place[b][0] or place[a][1] > place[b][2] or place[b][1] > place[a][2]
    assert all(a < b and apart(a, b) for a, b in found) and len(found) == len(set(found))
    pairs = [(a, b) for a in place for b in place if a < b and a // 100 == b // 100 and apart(a, b)]

    def joined(edges):
        root = {i: i for e in edges for i in e}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    got = joined(found)
    assert got == joined(pairs) and got[1] == got[2] == got[3] == got[4] == 1


def test_union_find_takes_every_match(spark, tmp_path):
    from graftline.plans.catalog import QUERIES

    rows = [([1, 2], 0.97), ([3, 2], 97.0), ([4, 5, 3], 0.99), ([7, 6], 0.5), ([9, 8], None), ([None, 10, 9], 0.6), ([11], 1.0), (None, 1.0)]
    spark.createDataFrame(rows, "regions array<long>, similarity double").write.parquet(str(tmp_path / "similar_groups.parquet"))
    got = dict(map(tuple, QUERIES["l7_union_find"](spark, str(tmp_path)).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6, 8: 8, 9: 8, 10: 8}


def test_overlapping_regions_form_no_edge(spark):
    s = spark.createDataFrame([(i, [1] * 128) for i in (1, 2, 3)] + [(4, [])], "region_id long, sig array<long>")
    r = spark.createDataFrame([(1, "p", 1, 5), (2, "p", 4, 9), (3, "q", 1, 5), (4, "q", 7, 9)], "region_id long, path string, start_line int, end_line int")
    assert {tuple(x)[:2] for x in lsh.links(s, r, Settings()).collect()} == {(1, 3), (2, 3)}
    assert {(x["region_id"], x["n_links"]) for x in lsh.link_counts(s, r, Settings()).collect()} == {(1, 1), (2, 1), (3, 2)}
    assert {(x["region_id"], x["n_candidates"]) for x in lsh.candidate_counts(s, 0.5).collect()} == {(1, 2), (2, 2), (3, 2)}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(500, x) for x in range(501, 540)] + [(7, 7), (None, 3)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_take_the_broadcast_path(spark, monkeypatch):
    from graftline import runtime

    monkeypatch.setattr(runtime, "KEY_ROWS", 10)
    left = spark.range(3000).select(F.when(F.col("id") < 1500, 1).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    assert runtime.skew_join(left, right, ["k"]).count() == 3000


@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
@settings(max_examples=60, deadline=None)
def test_ordered_ratio_is_difflibs(a, b):
    want = 0.0 if not a or not b else SequenceMatcher(None, a, b, autojunk=False).ratio()
    assert verify.ordered_ratio(a, b) == want


def test_verified_groups_equal_all_pairs(spark):
    rng = random.Random(2)
    lists = {i: [rng.choice("abcdef") for _ in range(rng.randrange(0, 9))] for i in range(8)}
    lists[7] = lists[6] = lists[5]
    reg = spark.createDataFrame([(i, f"p{i}", 1, 9, "function_definition", "python", 1) for i in lists], "region_id long, path string, start_line int, end_line int, region_type string, language string, tree_id long")
    sh = spark.createDataFrame([(i, k, c) for i, l in lists.items() for k, c in enumerate(l)], "region_id long, seq int, content string")
    m = spark.createDataFrame([(0, i) for i in lists], "group_id long, region_id long")
    got = verify.verified(m, verify.content_lists(sh), reg).first()
    pairs = [(a, b) for a in lists for b in lists if a < b]
    # copies share one class, whose pairs are taken in the order of its least member
    rep = {i: min(j for j in lists if lists[j] == lists[i]) for i in lists}
    want = sum(verify.ordered_ratio(*(lists[x] for x in sorted((rep[a], rep[b])))) for a, b in pairs) / len(pairs)
    assert got["size"] == 8 and got["similarity"] == pytest.approx(want)


def test_lookup_by_start_line_takes_the_last(spark):
    reg = spark.createDataFrame([(1, "p", 1, 3), (2, "p", 1, 9), (3, "p", 4, 9)], "region_id long, path string, start_line int, end_line int")
    l = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "region_id long, contents array<string>")
    assert dict(map(tuple, verify.looked_up(l, reg).collect())) == {1: ["b"], 2: ["b"], 3: None}


def test_report_summary_and_sarif(spark, tmp_path):
    reg = spark.createDataFrame([(1, "a.py", "python", "function", "f", 1, 10), (2, "b[x].go", "go", "function", "g", 1, 4), (3, "a.py", "python", "class", "C", 20, 24)], "region_id long, path string, language string, region_type string, region_name string, start_line int, end_line int")
    g = spark.createDataFrame([(1, 2, 0.9)], "group_id long, size long, similarity double")
    m = spark.createDataFrame([(1, 1), (1, 2)], "group_id long, region_id long")
    got = {r["language"]: tuple(r)[1:] for r in report.language_summary(reg, g, m).collect()}
    assert got == {"python": (1, 1, 10), "go": (1, 0, 4), "total": (2, 1, 14)}
    lines = [r["line"] for r in report.display_lines(g, m, reg).orderBy("ordinal").collect()]
    assert lines == ["Similar group (90.0%): 2 regions", "  a.py [1:10] (10 lines) f(function)", "  b[x].go [1:4] (4 lines) g(function)"]
    out = report.write_sarif(report.sarif_results(g, m, reg), str(tmp_path / "x.sarif"))
    log = json.load(open(out))
    res = log["runs"][0]["results"]
    assert log["version"] == "2.1.0" and len(res) == 1 and res[0]["level"] == "warning" and res[0]["relatedLocations"][0]["id"] == 1
    assert res[0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "endLine": 10}
    empty = json.loads(report.write_sarif(report.sarif_results(g.limit(0), m, reg)))
    assert empty["runs"][0]["results"] == []


def test_diffs():
    assert diff.opcodes(["a", "b"], ["a", "c"]) == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 2)]
    assert diff.side_by_side(["a", "b"], ["a", "c", "d"], 23) == ["a            a", "b          | c", "           > d"]


def test_settings():
    assert Settings().lsh_threshold == 0.5 and Settings.for_cli().similarity == 1.0
    assert Settings.from_env({"SHINGLE_K": "4"}).k == 4
    with pytest.raises(ValueError):
        Settings.for_cli(4)
    with pytest.raises(ValueError):
        Settings(k=0)


def test_cli(spark, tmp_path, capsys):
    from graftline.cli import main

    (tmp_path / "p.py").write_bytes(TWO)
    assert main(["list-ruleset", "none", "--language", "go"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert main(["--ruleset", "loose", "detect", str(tmp_path), "--similarity", "90", "--fail", "--diff", "--verbose"], spark) == 1
    out = capsys.readouterr().out
    assert "Similar group (100.0%): 2 regions" in out and "total\t1\t1\t12" in out
    assert main(["detect", str(tmp_path), "--similarity", "3"], spark) == 2
    assert main(["inspect", str(tmp_path / "p.py")], spark) == 0
    assert "identifier(FUNC)" in capsys.readouterr().out


def test_examples_queries_run(spark):
    from graftline.plans.catalog import QUERIES, SQL

    assert set(SQL) <= set(QUERIES)
    assert QUERIES["s10_parse_path"](spark, "").count() == 5


def test_transformed_source_keeps_columns_and_indentation(spark):
    from graftline.operators import inspect
    from graftline.operators.rules import build_rules
    from graftline.sources import files as sources

    text = "import os\n\ndef f(a):\n    if a:\n\treturn 'x'\n    return a\n".replace("\n\treturn", "\n        return")
    df = spark.createDataFrame([(1, "python", text.encode()), (2, "python", b"x = '\xff'\n")], "file_id long, language string, source binary")
    n = sources.parsed(sources.parse_files(df, tolerant=True)).withColumn("shingle_language", F.lit("python"))
    got = {(r["tree_id"], r["line"]): r["text"] for r in inspect.transformed_source(n, build_rules("default"), df.select("file_id", "source")).collect()}
    assert got[1, 3].startswith("def FUNC") and got[1, 4].startswith("    if") and got[1, 5].startswith("        return") and (1, 1) not in got and (2, 1) in got
    both = {(r["tree_id"], r["line"]): (r["source"], r["text"]) for r in inspect.comparison(n, build_rules("default"), df.select("file_id", "source")).collect()}
    assert both[1, 1] == ("import os", None) and both[1, 6][0] == "    return a"


def test_rules_of_languages_follow_those_for_all(spark):
    from graftline.operators import shingles
    from graftline.operators.rules import Action, Match, Rule

    late = [Rule("own", ("go",), Match(("word",)), Action.REPLACE_VALUE, {"value": "OWN"}), Rule("all", ("*",), Match(("word",)), Action.REPLACE_VALUE, {"value": "ALL"})]
    n = spark.createDataFrame([(1, 0, 0, 0, "word", "x", "go"), (2, 0, 0, 0, "word", "x", "java")], "region_id long, seq int, end_seq int, n_children int, kind string, text string, shingle_language string")
    assert {r["region_id"]: r["rep"] for r in shingles.normalised(n, late).collect()} == {1: "word(OWN)", 2: "word(ALL)"}


def test_rules_from_a_mapping_state_whole_patterns():
    from graftline.operators.rules import load_rules, parse_rule

    spec = {"name": "n", "languages": ["go"], "kinds": ["identifier"], "action": "anonymize", "parent": ["call"], "grandparent": ["block"], "field": "name", "text": ["match", "^x"], "has": ["call", "y"], "params": {"prefix": "P"}}
    r = parse_rule(spec)
    assert (r.match.parent, r.match.grandparent, r.match.field, r.match.text, r.match.has, r.params) == (("call",), ("block",), "name", ("match", "^x"), ("call", "y"), {"prefix": "P"})
    for bad in ({**spec, "text": ["like", "x"]}, {**spec, "odd": 1}, {**spec, "has": ["call"]}, {k: v for k, v in spec.items() if k != "kinds"}):
        with pytest.raises(ValueError):
            parse_rule(bad)
    with pytest.raises(ValueError):
        load_rules({"rulesets": {"a": {"extends": "b"}, "b": {"extends": "a"}}})
    with pytest.raises(ValueError):
        load_rules({"rulesets": {"a": {"extends": "none"}}}, "a")


def test_ranked_numbers_all_rows(spark):
    from graftline.runtime import ranked

    rng = random.Random(4)
    rows = [(i, rng.randrange(20) / 20) for i in range(300)]
    got = {r["k"]: r["place"] for r in ranked(spark.createDataFrame(rows, "k long, s double"), [F.desc("s"), F.col("k")]).collect()}
    assert got == {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


def test_bucket_pairs_and_overlaps_against_brute_force(spark):
    from graftline.operators.pairing import bucket_pairs, overlapping

    rng = random.Random(6)
    at = [(i, rng.randrange(6)) for i in range(60)] + [(i, 9) for i in range(25)]
    want = {(a, b) for a, x in at for b, y in at if x == y and a < b}
    assert {tuple(r) for r in bucket_pairs(spark.createDataFrame(at, "region_id long, bucket long"), block=4).collect()} == want
    r = [(i, rng.choice("pq"), s := rng.randrange(1, 300), s + rng.choice([0, 3, 70, 200])) for i in range(80)] + [(90, None, 1, 9), (91, "p", None, 4), (92, "p", 9, 3)]
    want = {(a, b) for a, p, s, e in r[:80] for b, q, t, f in r[:80] if a < b and p == q and s <= f and t <= e}
    assert {tuple(x) for x in overlapping(spark.createDataFrame(r, "region_id long, path string, start_line int, end_line int")).collect()} == want


def test_every_kind_has_its_name_check(spark):
    """However many kinds of regions there are, and without a language."""
    from graftline.operators.rules import ruleset
    from graftline.operators.verify import names_checked

    rows = [("python", "function"), ("go", "class"), ("java", "class"), (None, "method"), ("x" * 9, "function"), ("python", "heading"), ("python", None)]
    df = spark.createDataFrame(rows, "language string, region_type string")
    assert [r[0] for r in df.select(names_checked(ruleset("default"))).collect()] == [False, True, False, True, True, False, False]


def test_small_graphs_are_joined_by_one_task_and_large_ones_by_rounds(spark, monkeypatch):
    from graftline.operators import components

    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame(pairs, "a long, b long")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    want = sorted(map(tuple, connected_components(df).collect()))
    assert jobs() - before <= 12
    for few in (0, 30):
        monkeypatch.setattr(components, "FEW_EDGES", few)
        assert sorted(map(tuple, connected_components(df).collect())) == want
    least = dict(want)
    assert all(least[a] == least[b] <= min(a, b) for a, b in pairs if a != b) and least[1040] == 1000


def test_content_lists_keep_the_least_content_of_a_place(spark):
    rows = [(1, 0, "b"), (1, 0, "a"), (1, 0, "a"), (1, 1, "a"), (1, 2, None), (2, 5, "z"), (1, 3, "c"), (1, 3, "c")]
    got = dict(map(tuple, verify.content_lists(spark.createDataFrame(rows, "region_id long, seq int, content string")).collect()))
    assert got == {1: ["a", "a", "c"], 2: ["z"]}
