"""Hand-written source, leaks, mixtures and truncation on small fixtures."""

import random
import re
from collections import defaultdict
from datetime import datetime

import pytest

from graftline.llm import handwritten, leak, mixture, truncation

T = datetime(2024, 1, 1)
FILES = "file_id long, repo_name string, path string, source binary, ingested_at timestamp, reason string"
HAND = b"def f(a):\n    return a + 1\n\n\nclass C:\n    pass\n"
ROWS = b"export const t = [\n" + b"".join(b'  {"a": %d, "b": "x%d", "c": null},\n' % (i, i) for i in range(40)) + b"];\n"
FAMILY = b"".join(b"def get_a_%d():\n    return slots[%d]\n\n" % (i, i * 7) for i in range(20))
MIN = b"".join(b"function a%s(b){const c=d(e,%d);if(f>%d){return g;}}" % (b"xyz"[i % 3 : i % 3 + 1], i, i) for i in range(40))


def test_reasons(spark):
    cases = [
        (1, "r", "/s/r/src/a.py", HAND, None), (2, "r", "/s/r/deps/a.py", HAND, "ignored directory"), (3, "q", "/s/q/deps/a.py", HAND, None),
        (4, "q", "/s/q/x/Node_Modules/y/a.js", HAND, "third-party directory"), (5, "q", "/s/q/a.py", b"# Code generated by x. DO NOT EDIT.\n" + HAND, "generated by its own words"),
        (6, "q", "/s/q/a.py", b"# This module used to be generated by hand; DO NOT EDIT lightly was the old rule\n" + HAND, None),
        (7, "q", "/s/q/a.py", HAND + b"# <auto-generated> x </auto-generated>\n", "generated by its own words"), (8, "q", "/s/q/a.js", MIN, "minified"),
        (9, "q", "/s/q/a_pb2.py", HAND, "generated by its path"), (10, "q", "/s/q/generated/a.py", HAND, "generated by its path"), (11, "q", "/s/q/generated_reports/a.py", HAND, None),
        (12, "q", "/s/q/t.js", ROWS, "data blob"), (13, "q", "/s/q/f.py", FAMILY, "generated family"), (14, "q", "/s/q/b.js", b"// foolib release 1.2, redistributed with its own licence\nlet a = 1;\n", "vendored by its own words"),
        (15, "q", "/s/q/b.js", b"// not vendored: written here (see notes\nlet a = 1;\n", None), (16, "q", "/s/q/b.py", b'HEAD = "Code generated by x. DO NOT EDIT."\n' + HAND, None),
        (17, None, None, None, None), (18, "none", "/s/none/a.py", b"", None), (19, "r", "a.py", HAND * 400, None), (20, "r", "/s/r/lib/third/a.py", HAND, "ignored directory"),
        (21, "q", "/s/q/one.py", b"X = '" + b"a" * 700 + b"'\n" + HAND * 3, None),
    ]
    rows = [(i, r, p, s, T, "junk") for i, r, p, s, _ in cases] + [(1, "r", "/s/r/vendor/a.py", HAND, datetime(2023, 1, 1), "junk"), (2, "r", "/s/r/deps/a.py", HAND, T, "junk")]
    conf = spark.createDataFrame([("r", ["deps", "/lib/third/", None, " "], 1), ("r", ["deps"], 1), ("q", None, 1), ("none", [], 1), (None, ["src"], 1)], "name string, ignore_dirs array<string>, cluster int")
    got = {x["file_id"]: x["reason"] for x in handwritten.judged(spark.createDataFrame(rows, FILES), conf).collect()}
    assert got == {i: why for i, *_, why in cases}
    assert handwritten.judged(spark.createDataFrame([], FILES), conf).count() == 0


def test_one_long_literal_is_a_blob(spark):
    octets = b"table = b'" + b"".join(b"\\x%02x" % (i * 37 % 256) for i in range(600)) + b"'\n"
    base64 = b'export const font = "' + b"d09GMgABAAAAAB" * 150 + b'";\n'
    notes = b'"""Adds one.\n\n' + b"Every caller passes a number and gets the next one.\n" * 30 + b'"""\n' + HAND
    cases = {1: ("a.py", octets, "data blob"), 2: ("a.ts", base64, "data blob"), 3: ("b.py", notes, None), 4: ("c.py", b"X = b'ab'\n", None)}
    rows = [(i, "q", f"/s/q/{p}", s, T, "junk") for i, (p, s, _) in cases.items()]
    conf = spark.createDataFrame([], "name string, ignore_dirs array<string>, cluster int")
    got = {x["file_id"]: x["reason"] for x in handwritten.judged(spark.createDataFrame(rows, FILES), conf).collect()}
    assert got == {i: why for i, (_, _, why) in cases.items()}


def test_clusters_convict_their_members(spark):
    """Pooled figures judge: among blobs under one mask a file with a share of 0.86 is one
    too, alone it is none; a repository's family is generated without numbers or marks."""
    table = lambda n, k: b"TABLE = [\n" + b"".join(b"    %d, %d, %d,\n" % (i * k, i + k, i) for i in range(n)) + b"]\n"
    family = lambda n, w: b"".join(b"def get_%s_%s(self):\n    return self.slots[%d]\n" % (w, b"abcdefghijklmnopqrstuvwxyz"[i : i + 1], i * 7) for i in range(n))
    conf = spark.createDataFrame([], "name string, ignore_dirs array<string>, cluster int")
    together = [(i, "q", f"/s/q/t{i}.py", table(60 + i, i + 2), T, "junk") for i in range(1, 5)]
    together += [(20 + i, "q", f"/s/q/f{i}.py", family(20, b"pqrs"[i : i + 1]), T, "junk") for i in range(3)]
    got = {x["file_id"]: x for x in handwritten.judged(spark.createDataFrame(together, FILES), conf).collect()}
    assert {i: got[i]["reason"] for i in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "data blob")
    assert {i: got[i]["reason"] for i in (20, 21, 22)} == dict.fromkeys((20, 21, 22), "generated family")
    assert got[1]["cluster"] == got[4]["cluster"] and got[20]["family_files"] == 3
    # the same masked shingles, but names beside the numbers
    named = b"TABLE = [\n" + b"    1, 2, 3,\n" * 40 + b"]\n" + b"OTHER = [\n" + b"    x, y,\n" * 9 + b"]\n"
    plain = b"TABLE = [\n" + b"    1, 2, 3,\n" * 400 + b"]\n" + b"OTHER = [\n" + b"    x, y,\n" * 9 + b"]\n"
    rows = [(1, "q", "/s/q/a.py", named, T, "junk"), (2, "r", "/s/r/b.py", plain, T, "junk")]
    both = {x["file_id"]: x["reason"] for x in handwritten.judged(spark.createDataFrame(rows, FILES), conf).collect()}
    alone = {x["file_id"]: x["reason"] for x in handwritten.judged(spark.createDataFrame(rows[:1], FILES), conf).collect()}
    assert both == {1: "data blob", 2: "data blob"} and alone == {1: None}


def test_masked_clusters_join_renamed_files(spark):
    a = b"".join(b"def f%d(x):\n    y = g(x, %d)\n    return y\n" % (i, i) for i in range(6))
    b = a.replace(b"y", b"zed").replace(b"g(", b"other(")
    c = b"class K:\n    def m(self):\n        return [i for i in range(10) if i]\n" * 3
    df = spark.createDataFrame([(i, *handwritten.look(s)) for i, s in ((1, a), (2, b), (3, c), (4, c), (5, b""))], handwritten.FEATURES)
    got = dict(map(tuple, handwritten.masked_clusters(df.select("file_id", "tokens")).collect()))
    assert got[1] == got[2] == 1 and got[3] == got[4] == 3 and got[5] == 5


def words(t):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", t or "")]


def leak_brute(docs, items, n=12):
    own = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            own[tuple(w[k : k + n])].add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - n + 1) for i in own.get(tuple(w[k : k + n]), ())}


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 40)))) for i in range(20)] + [(30, None), (31, ""), (32, "short one")]
    items.append((33, items[0][1]))
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 50))]
        if d % 3 == 0:
            src = words(items[rng.randrange(20)][1])
            a = rng.randrange(len(src))
            w[len(w) // 2 : len(w) // 2] = src[a : a + rng.randrange(8, 30)]
        docs.append((d, rng.choice([" ", ", ", "\n> ", "--é"]).join(x.upper() if rng.random() < 0.3 else x for x in w)))
    docs += [(100, None), (101, ""), (102, " ".join(vocab * 3000) + " " + items[1][1])]
    dd = spark.createDataFrame([(*x, "junk") for x in docs] + [(*docs[0], "junk")], "doc_id long, text string, item_id string")
    ii = spark.createDataFrame([(i, "t", t, 1) for i, t in items], "item_id long, task string, text string, doc_id int")
    want = leak_brute(docs, items)
    assert set(map(tuple, leak.leaked(dd, ii).collect())) == want
    # beyond the automaton's bound, joins of windows give the same passages
    scanned = set(map(tuple, leak.passages(dd, ii).collect()))
    assert set(map(tuple, leak.passages(dd, ii, automaton_chars=100).collect())) == scanned
    by = dict(docs)
    texts = dict(items)
    for p in leak.passages(dd, ii).collect():
        got = words(by[p["doc_id"]][p["start_char"] : p["end_char"]])
        assert len(got) == p["n_words"] >= 12 and " ".join(got) in " ".join(words(texts[p["item_id"]]))
    report = {r["item_id"]: r["n_documents"] for r in leak.leak_report(dd, ii).collect()}
    assert report == {i: len({d for d, j in want if j == i}) for i, _ in items}
    assert leak.leaked(dd.limit(0), ii).count() == 0 and leak.leaked(dd, ii.limit(0)).count() == 0


@pytest.mark.parametrize("rate,cap", [(0.2, 1), (1.0, 3), (2.7, 3), (3.0, 3), (0.0, 2), (5.5, 20), (800, 1000), (2999.5, 3000), (40.0, 100_000), (2.0, 0)])
def test_cut_poisson_has_the_rate_as_mean(rate, cap):
    base, cdf = mixture.cut_poisson(rate, cap)
    assert base + len(cdf) <= cap and cdf == sorted(cdf) and all(0 < x < 1 for x in cdf)
    assert base + sum(1 - x for x in cdf) == pytest.approx(min(rate, cap), abs=1e-6)


def test_plan_is_bounded_by_the_scarcest_source():
    got = {(m, s): r for m, s, _, _, r, *_ in mixture.plan([("a", 1000), ("b", 100)], [("x", "a", 0.5, 1), ("x", "b", 0.5, 3), ("x", "gone", 0.1, 2)])}
    assert got == {("x", "a"): pytest.approx(0.3), ("x", "b"): 3.0, ("x", "gone"): 0.0}


def test_mixture_reaches_shares(spark):
    docs = [(i, "a b c d e", "Small-Src " if i % 10 == 0 else "big", 1) for i in range(600)]
    docs += [(900, None, "big", 1), (901, "x", None, 1), (902, "", "big", 1), (903, "lone", "other", 1), (904, "word " * 3000, "small_src", 1)]
    dd = spark.createDataFrame(docs, "doc_id long, text string, source string, u int")
    tt = spark.createDataFrame([("m", "small_src", 0.5, 4), ("m", "big", 0.5, 2), ("n", "big", 1.0, 1), ("n", "void", None, None)], "mix_name string, source string, target_share double, max_repeats int")
    rows, report = mixture.mixture(dd.filter("doc_id <> 904"), tt)
    got = [tuple(r)[:5] for r in rows.collect()]
    rep = {(r["mix_name"], r["source"]): r for r in report.collect()}
    assert abs(rep["m", "small_src"]["actual_share"] - 0.5) < 0.06 and rep["m", "small_src"]["rate"] == 4.0
    assert rep["n", "big"]["actual_share"] == 1.0 and rep["n", "big"]["copies"] == 540 and rep["n", "void"]["tokens"] == 0
    per = defaultdict(int)
    for mix, _, doc, copy, source in got:
        per[mix, doc] += 1
        assert source in ("small_src", "big") and doc < 900
    assert max(v for (m, d), v in per.items() if d % 10) <= 2 and all(v == 4 for (m, d), v in per.items() if d % 10 == 0)
    assert len(set(got)) == len(got)
    # drawn again, the same copies come out
    assert sorted(tuple(r)[:5] for r in mixture.mixture(dd.filter("doc_id <> 904"), tt)[0].collect()) == sorted(got)
    assert mixture.mixture(dd.limit(0), tt)[0].count() == 0 and mixture.mixture(dd, tt.limit(0))[0].count() == 0
    n = {r["doc_id"]: r["n_tokens"] for r in mixture.with_tokens(dd.select("doc_id", "text")).collect()}
    assert n[0] == 5 and n[900] == 0 and n[904] > 2999


def test_length_hazards_find_the_limit(spark):
    rng = random.Random(1)
    rows = [("s", min(rng.randrange(20, 900), 512 if rng.random() < 0.4 else 10_000)) for _ in range(1500)] + [("t", rng.randrange(20, 900)) for _ in range(1500)]
    h = truncation.length_hazards(spark.createDataFrame(rows, "source string, n int"))
    assert {tuple(r) for r in truncation.significant_lengths(h).collect()} == {("s", 512)}
    assert truncation.significant_lengths(h.limit(0)).count() == 0


SENTENCE = "The quick table holds many rows and the old one is about twice as large. "


def test_truncation_verdicts(spark):
    rng = random.Random(2)
    whole = [(i, SENTENCE * rng.randrange(1, 5) + rng.choice(["\n\nThanks in advance", "\ncheers", "\n\nhth", SENTENCE.strip()]), "a" if i % 2 else "b") for i in range(300)]
    cut = [(1000 + i, (SENTENCE * 9)[:333], "a") for i in range(30)]
    odd = [
        (2000, SENTENCE + "You need to", True), (2001, SENTENCE + "\n```\nx = f(1)\n", True), (2002, SENTENCE + "\n```\nx = f(1)\n```", False), (2003, SENTENCE + "\n\nregards, the table rows", False),
        (2004, "- open the table\n- hold the rows", False), (2005, "nope", False), (2006, "use --old-table instead", False), (2007, SENTENCE + "https://x.invalid/a/b-1", False),
        (2008, SENTENCE + "[notes](https://x.invalid/a", True), (2009, SENTENCE + "It is large and the old rows hold many [..]", True), (2010, SENTENCE + "<pre><code>x = f(1)", True),
        (2011, SENTENCE + "<pre><code>x = f(1)</code></pre>", False), (2012, SENTENCE + "It holds the rows, ", True), (2013, SENTENCE + "    \n\n    total = table(rows, 1)", False), (2014, "> " + SENTENCE.strip(), False),
        (2015, SENTENCE * 3000 + "And the old", True),
    ]
    rows = [(i, t, s, 9) for i, t, s in whole + cut] + [(i, t, "c", 9) for i, t, _ in odd] + [(3000, None, "a", 9), (3001, "  \n", None, 9), (3002, SENTENCE, None, 9), (2000, odd[0][1], "c", 9)]
    got = truncation.judged(spark.createDataFrame(rows, "doc_id long, text string, source string, body int"))
    by = {r["doc_id"]: r for r in got.collect()}
    assert not [i for i, *_ in whole if by[i]["truncated"]]
    assert all(by[i]["truncated"] and by[i]["at_limit"] for i, *_ in cut)
    assert {i: by[i]["truncated"] for i, *_ in odd} == {i: want for i, _, want in odd}
    assert 3000 not in by and 3001 not in by and not by[3002]["truncated"]
    rates = {r["source"]: (r["n_truncated"], r["n_at_limit"]) for r in truncation.source_rates(got).collect()}
    assert rates["a"] == (30, 30) and rates["b"] == (0, 0)
    assert truncation.judged(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
