"""Components, near-duplicates, frequencies, set joins and shared spans against brute force
on small fixtures, with the edge cases that the docstrings define."""

import random
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pytest

from graftline.llm import components, frequency, near, setjoin, sketch, spans

REGIONS = "region_id long, path string, start_line int, end_line int, junk string"
SHINGLES = "region_id long, seq int, content string, tokens string, n long"


def classes(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def jaccard(a, b):
    return len(a & b) / len(a | b)


# ------------------------------------------------------------------ components
def test_components_of_chains_hubs_and_repeats(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(35)] + [(i + 1, i) for i in range(100, 150)] + [(900, i) for i in range(800, 860)]
    rows = [(a, b, 1.0) for a, b in edges] * 2 + [(None, 4, 0.0), (5, None, 0.0), (3, 3, 0.0)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(rows, "u long, v long, m double")).collect()))
    assert got == classes([e for e in edges if e[0] != e[1]])


def test_components_of_strings_and_of_nothing(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b")], "u string, v string")
    assert dict(map(tuple, components.connected_components(df).collect())) == {"a": "a", "b": "a", "c": "a"}
    assert components.connected_components(df.limit(0)).count() == 0


def test_components_with_hot_nodes(spark, monkeypatch):
    from graftline import runtime

    monkeypatch.setattr(runtime, "KEY_ROWS", 20)
    edges = [(1, i) for i in range(2, 1500)] + [(3000 + i, 4000 + i) for i in range(30)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == classes(edges)


def test_match_rows(spark):
    groups = spark.createDataFrame(
        [
            (1, [1, 2], 0.8, 9), (2, [2, 3], 85.0, 9), (3, [4, 5], 0.79, 9), (4, [4, 5], None, 9), (5, [6, 6, None], 1.0, 9), (6, None, 1.0, 9), (7, [7, 99], 1.0, 9),
            (8, [8, 9, 10], 1.0, 9), (8, [8, 9, 10], 1.0, 9), (9, [4, 5], float("nan"), 9), (10, [], 1.0, 9), (11, [1, 3], 60.0, 9),
        ],
        "group_id long, regions array<long>, similarity double, component long",
    )
    regions = spark.createDataFrame([(i, "p", 1, 2, "x") for i in range(1, 11)] + [(1, "p", 1, 2, "x"), (None, "p", 1, 2, "x")], REGIONS)
    assert dict(map(tuple, components.consolidate(groups, regions).collect())) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8}
    assert components.consolidate(groups.limit(0), regions).count() == 0
    assert components.consolidate(groups, regions.limit(0)).count() == 0


# ------------------------------------------------------------------ sketches
def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**62), 2**62, 60)
    errors = []
    for share in (0.3, 0.5, 0.7, 0.9):
        k = int(60 * share)
        b = np.concatenate([a[:k], rng.integers(-(2**62), 2**62, 60 - k)])
        s = sketch.fast_sketch(np.concatenate([a, b]), np.repeat([0, 1], 60), 2, 512)
        assert not (s == sketch.EMPTY).any()
        errors.append(abs((s[0] == s[1]).mean() - k / (120 - k)))
    assert max(errors) < 0.09


def test_sketch_of_repeats_single_and_empty_sets():
    v = np.array([5, 5, 5, 7], np.int64)
    s = sketch.fast_sketch(v, np.array([0, 0, 1, 2]), 4, 64)
    assert (s[0] == s[1]).all() and not (s[0] == s[2]).any() and (s[3] == sketch.EMPTY).all()
    # the order of tokens and batches does not matter
    t = sketch.fast_sketch(v[::-1].copy(), np.array([2, 1, 0, 0]), 4, 64)
    assert (s == t).all()


# ------------------------------------------------------------------ near-duplicates
def near_fixture(rng):
    sets, places = {}, {}
    rid = 0
    for f in range(25):
        base = [f"t{rng.randrange(400)}" for _ in range(rng.randrange(6, 40))]
        for _ in range(rng.randrange(1, 5)):
            s = list(base)
            for _ in range(rng.randrange(0, 6)):
                s[rng.randrange(len(s))] = f"t{rng.randrange(400)}"
            rid += 1
            sets[rid] = s
            a = rng.randrange(1, 40)
            places[rid] = (f"p{rng.randrange(4)}", a, a + rng.randrange(0, 30))
    return sets, places


def near_brute(sets, places):
    s = {r: frozenset(x for x in v if x is not None) for r, v in sets.items()}
    s = {r: x for r, x in s.items() if len(x) >= 8}
    links = []
    for a in s:
        for b in s:
            if a < b and jaccard(s[a], s[b]) >= 0.7 - 1e-9:
                p, q = places.get(a), places.get(b)
                if not (p and q and p[0] == q[0] and p[1] <= q[2] and q[1] <= p[2]):
                    links.append((a, b))
    return classes(links)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    sets, places = near_fixture(rng)
    # exact copies in one path, overlapping and not, and without a region row
    same = [f"s{i}" for i in range(12)]
    for rid, place in ((900, ("z", 1, 9)), (901, ("z", 5, 12)), (902, ("z", 20, 29)), (903, ("z", 8, 22)), (910, ("y", 1, 9)), (911, ("y", 3, 9))):
        sets[rid], places[rid] = (same if rid < 910 else [f"u{i}" for i in range(12)]), place
    sets[920] = sets[921] = [f"w{i}" for i in range(9)]
    sets[930] = [None] * 9
    rows = [(r, i, c, "x", 1) for r, v in sets.items() for i, c in enumerate(v)]
    sh = spark.createDataFrame(rows + rows[:50] + [(None, 1, "q", "x", 1)], SHINGLES)
    reg = spark.createDataFrame([(r, *p, "x") for r, p in places.items()] * 2, REGIONS)
    got = dict(map(tuple, near.near_duplicates(sh, reg).collect()))
    assert got == near_brute(sets, places)
    assert 910 not in got and got[920] == 920


def test_near_duplicates_of_one_big_family(spark):
    rng = random.Random(9)
    base = [f"t{i}" for i in range(60)]
    sets = {}
    for r in range(150):
        s = list(base)
        s[rng.randrange(60)] = f"x{r}"
        sets[r] = s
    sh = spark.createDataFrame([(r, i, c, "x", 1) for r, v in sets.items() for i, c in enumerate(v)], SHINGLES)
    reg = spark.createDataFrame([(r, f"p{r}", 1, 2, "x") for r in sets], REGIONS)
    assert set(near.near_duplicates(sh, reg).collect()) == {(r, 0) for r in sets}
    assert near.near_duplicates(sh.limit(0), reg).count() == 0


# ------------------------------------------------------------------ frequencies
def test_frequencies_against_counters(spark):
    rng = random.Random(2)
    rows = [(r, s, rng.choice(["hot"] * 6 + ["a", "b", "", None] + [f"v{r}_{s}"])) for r in range(60) for s in range(rng.randrange(0, 9))]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows + rows[:40] + [(None, 1, "hot"), (61, 0, None)]], SHINGLES)
    n_rows, recs = Counter(), defaultdict(set)
    for r, _, c in rows:
        if c is not None:
            n_rows[c] += 1
            recs[c].add(r)
    got = {x["content"]: (x["n_rows"], x["n_records"]) for x in frequency.value_frequencies(df, heavy=3).collect()}
    assert got == {c: (n, len(recs[c])) for c, n in n_rows.items()}
    total = len({r for r, *_ in rows} | {61})
    marks = {x["content"]: x["mark"] for x in frequency.marked(df).collect()}
    assert marks == {c: "rare" if len(v) == 1 else "common" if len(v) >= 0.05 * total else None for c, v in recs.items()}
    assert frequency.marked(df.limit(0)).count() == 0


# ------------------------------------------------------------------ set joins
def test_set_join_against_all_pairs(spark):
    rng = random.Random(7)
    right = {r: frozenset(f"t{rng.randrange(300)}" for _ in range(rng.randrange(5, 40))) | {"hot"} for r in range(200)}
    left = {}
    for i in range(30):
        src = sorted(right[rng.randrange(200)])
        left[i] = frozenset(rng.sample(src, max(1, int(len(src) * rng.uniform(0.4, 1))))) | {f"n{k}" for k in range(rng.randrange(0, 6))}
    lists = spark.createDataFrame([(i, "x", [*v, None, next(iter(v))], 3) for i, v in left.items()] + [(77, None, None, 0), (78, None, [], 0)], "list_id long, size string, shingles array<string>, shingle_count int")
    sh = spark.createDataFrame([(r, i, c, "x", 1) for r, v in right.items() for i, c in enumerate(v)], SHINGLES)
    want = {(i, r) for i, a in left.items() for r, b in right.items() if len(a) >= 8 and len(b) >= 8 and jaccard(a, b) >= 0.5 - 1e-9}
    got = setjoin.lists_to_regions(lists, sh).collect()
    assert {(x[0], x[1]) for x in got} == want and len(got) == len(want)
    assert all(x[2] == pytest.approx(jaccard(left[x[0]], right[x[1]]), abs=1e-6) for x in got)
    # small nodes and forced splitting give the same pairs
    assert {(x[0], x[1]) for x in setjoin.lists_to_regions(lists, sh, small=2).collect()} == want
    assert setjoin.lists_to_regions(lists.limit(0), sh).count() == 0
    assert setjoin.lists_to_regions(lists, sh.limit(0)).count() == 0


def test_set_self_join(spark):
    rng = random.Random(8)
    base = [frozenset(f"t{rng.randrange(200)}" for _ in range(20)) for _ in range(12)]
    sets = {i: frozenset(rng.sample(sorted(base[i % 12]), 14)) for i in range(48)}
    sh = spark.createDataFrame([(r, i, c, "x", 1) for r, v in sets.items() for i, c in enumerate(v)], SHINGLES)
    want = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.5 - 1e-9}
    got = setjoin.similar_pairs(near.token_sets(sh), None, 0.5)
    assert {(x["a"], x["b"]) for x in got.collect()} == want


def test_set_join_splits_as_deep_as_needed(spark):
    """Many records share most tokens, so that three levels leave large nodes."""
    rng = random.Random(9)
    core = [f"c{i}" for i in range(12)]
    sets = {i: frozenset(core) | frozenset(f"t{rng.randrange(400)}" for _ in range(18)) for i in range(150)}
    sets |= {200 + i: sets[i] | {f"x{i}"} for i in range(20)} | {300: sets[5], 301: sets[5]}
    sh = spark.createDataFrame([(r, i, c, "x", 1) for r, v in sets.items() for i, c in enumerate(v)], SHINGLES)
    want = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.6 - 1e-9}
    got = setjoin.similar_pairs(near.token_sets(sh), None, 0.6, small=3)
    assert sorted((x["a"], x["b"]) for x in got.collect()) == sorted(want)
    rows = {(r["id"], r["node"]) for r in setjoin._split(near.token_sets(sh).withColumnRenamed("region_id", "id"), None, 0.6, [1, 2]).collect()}
    assert len(rows) > 2 * len(sets)


def test_trees_follow_the_recall():
    assert setjoin.trees_for(0.9, 1) == 3 and setjoin.trees_for(0.99999, 3) == 25


# ------------------------------------------------------------------ shared spans
def span_brute(sources, k=8):
    lines, own = {}, defaultdict(set)
    for f, s in sources.items():
        ls = (s or b"").split(b"\n")
        if ls[-1] == b"":
            ls.pop()
        lines[f] = [x[:-1] if x.endswith(b"\r") else x for x in ls]
        for i in range(len(lines[f]) - k + 1):
            own[tuple(lines[f][i : i + k])].add(f)
    out = set()
    for f, ls in lines.items():
        hit = [False] * (len(ls) + 1)
        for i in range(len(ls) - k + 1):
            if len(own[tuple(ls[i : i + k])]) > 1:
                hit[i : i + k] = [True] * k
        i = 0
        while i < len(ls):
            j = i
            while j < len(ls) and hit[j]:
                j += 1
            if j > i:
                out.add((f, i + 1, j))
            i = max(j, i + 1)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_spans_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [b"line %d" % i for i in range(40)]
    blocks = [[rng.choice(pool) for _ in range(rng.randrange(8, 20))] for _ in range(6)]
    src = {}
    for f in range(14):
        ls = []
        for _ in range(rng.randrange(0, 5)):
            ls += rng.choice(blocks) if rng.random() < 0.6 else [rng.choice(pool) + b" %d" % rng.randrange(9) for _ in range(rng.randrange(1, 12))]
        src[f] = rng.choice([b"\n", b"\r\n"]).join(ls) + rng.choice([b"", b"\n"])
    src[50] = src[51] = b"same\n" * 30
    src[60] = b"".join(b"\xff\xfe%d\n" % i for i in range(9)) * 2
    src[70], src[71] = None, b""
    t = datetime(2024, 1, 1)
    rows = [(f, s, t, 5) for f, s in src.items()] + [(1, b"old\n" * 20, datetime(2023, 1, 1), 5), (2, src[2], t, 5), (80, b"only\n" * 20, None, 5)]
    src[80] = b"only\n" * 20
    df = spark.createDataFrame(rows, "file_id long, source binary, ingested_at timestamp, pos int")
    got = spans.shared_spans(df)
    assert {tuple(r) for r in got.collect()} == span_brute(src)


def test_shared_shares_and_empty_tables(spark):
    s = b"".join(b"l%d\n" % i for i in range(10))
    df = spark.createDataFrame([(1, s + b"x\n" * 10, None), (2, s, None), (3, b"a\n", None)], "file_id long, source binary, ingested_at timestamp")
    reg = spark.createDataFrame([(10, 1, 6, 15), (11, 3, 1, 1)], "region_id long, tree_id long, start_line int, end_line int")
    f, r = spans.shared_share(df, reg, spans.shared_spans(df))
    assert {x["file_id"]: (x["shared_lines"], x["share"]) for x in f.collect()} == {1: (10, 0.5), 2: (10, 1.0), 3: (0, 0.0)}
    assert {x["region_id"]: x["share"] for x in r.collect()} == {10: 0.5, 11: 0.0}
    assert spans.shared_spans(df.limit(0)).count() == 0


# ------------------------------------------------------------------ pairs inside buckets
def bucket_fixture(rng):
    """Classes alike, in three buckets, of which many pairs are near and many just not."""
    base = [rng.sample(range(10_000), 60) for _ in range(3)]
    sets = {i: sorted({*rng.sample(base[i % 3], 60 - rng.randrange(6)), *(rng.randrange(10_000) for _ in range(rng.randrange(6)))}) for i in range(240)}
    return sets, [(rng.randrange(2) if i % 5 else 7, i, len(t), i % 50 or -i) for i, t in sets.items()]


@pytest.mark.parametrize("size", [8000, 40])
def test_near_pairs_inside_buckets_against_all_pairs(spark, size, monkeypatch):
    from graftline.llm import buckets

    sets, rows = bucket_fixture(random.Random(3))
    monkeypatch.setattr(buckets, "PAIRS", 50)
    n, weight = Counter(b for b, *_ in rows), Counter()
    for b, _, s, _ in rows:
        weight[b] += s
    df = spark.createDataFrame([(*r, n[r[0]], weight[r[0]]) for r in rows], "bucket long, cls long, size int, comp long, n long, weight long")
    split = buckets.cells(df, df.n, df.weight, group_rows=size).join(spark.createDataFrame(list(sets.items()), "cls long, tokens array<long>"), "cls")
    cols = ["bucket", "cell", "cross", "side", "cls", "size", "comp", "tokens"]
    table = split.select(*cols).orderBy("bucket", "cell", "size").toArrow()
    whole = buckets.near_in_cells(0.8, 0)
    want = {(a, b) for x, a, _, c in rows for y, b, _, d in rows if x == y and a < b and c != d and jaccard(set(sets[a]), set(sets[b])) >= 0.8 - 1e-9}
    for step in (7, 5000):
        got = [tuple(p.values()) for batch in whole(iter(table.combine_chunks().to_batches(step))) for p in batch.to_pylist()]
        assert set(got) == want and len(got) == len(want) and len(want) > 500


def test_last_look_shuffles_tokens_by_bucket_and_not_by_pair(spark):
    """Sets alike but not near share buckets; no pair of them is joined with its tokens."""
    sets = {i: [*range(100), *(1000 * (i + 1) + k for k in range(14))] for i in range(20)}
    sets[20] = [*sets[19][:-1], 5]
    cls = spark.createDataFrame([(i, len(t), sorted(set(t)), "a", "b") for i, t in sets.items()], "cls long, size int, tokens array<long>, lo string, hi string")
    pairs = near.near_class_pairs(cls, 0.9, 16, 2, words=4)
    assert {(r["a"], r["b"], r["strong"]) for r in pairs.collect()} == {(19, 20, True)}
    assert "array_intersect" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_sources_are_read_before_the_latest_delivery_is_picked(spark):
    """The latest delivery counts; sources are read below the shuffle that picks it."""
    from graftline.llm import handwritten

    rows = [(i % 30, "r", f"/s/{i}.py", b"def f%d():\n    return %d\n" % (i, i), datetime(2024, 1, 1 + i // 30), "x") for i in range(60)]
    df = spark.createDataFrame(rows, "file_id long, repo_name string, path string, source binary, ingested_at timestamp, tokens string")
    figures = handwritten._figures(df)
    assert {r["file_id"]: r["path"] for r in figures.collect()} == {i: f"/s/{i + 30}.py" for i in range(30)}
    plan = figures._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("MapInArrow") and plan.count("MapInArrow") == 1
