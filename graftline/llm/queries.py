"""Queries of the training-data operators and, where SQL can state them over whole
tables, their SQL. Every query runs its operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.llm import components, frequency, handwritten, leak, mixture, near, parsing, setjoin, spans, truncation
from graftline.runtime import cut, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.judged(read(spark, d, "source_files"), read(spark, d, "repo_configs")).filter("reason is not null").select("file_id")


@query
def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Files per repository and reason."""
    j = handwritten.judged(read(spark, d, "source_files"), read(spark, d, "repo_configs"))
    return j.groupBy("repo_name", F.coalesce("reason", F.lit("hand-written")).alias("reason")).agg(F.count(F.lit(1)).alias("n_files"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.consolidate(read(spark, d, "similar_groups"), read(spark, d, "regions"))


@query
def p2_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Members per group, with the files they lie in."""
    r = read(spark, d, "regions").select("region_id", "tree_id").distinct()
    g = components.consolidate(read(spark, d, "similar_groups"), read(spark, d, "regions"))
    return g.join(r, "region_id").groupBy("component_id").agg(F.countDistinct("region_id").alias("n_regions"), F.countDistinct("tree_id").alias("n_files"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_duplicates(read(spark, d, "shingles"), read(spark, d, "regions"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked(read(spark, d, "shingles")).filter("mark is not null").select("content", "mark")


@query
def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct content with its rows, its regions and its mark, if any."""
    return frequency.marked(read(spark, d, "shingles")).select("content", "n_rows", F.col("n_records").alias("n_regions"), "mark")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.checked(read(spark, d, "source_files")).filter("n_errors > 0").select("file_id")


@query
def p5_repository_rates(spark: SparkSession, d: str) -> DataFrame:
    """Invalid files per repository and language, next to what the scan reported."""
    return parsing.repository_rates(read(spark, d, "source_files"), read(spark, d, "perf_results"))


@query
def p5_language_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Valid files per language."""
    return parsing.acceptance(read(spark, d, "source_files"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.lists_to_regions(read(spark, d, "reference_lists"), read(spark, d, "shingles")).select("list_id", "region_id")


@query
def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with their similarity."""
    return setjoin.lists_to_regions(read(spark, d, "reference_lists"), read(spark, d, "shingles"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(read(spark, d, "source_files"))


@query
def p7_file_share(spark: SparkSession, d: str) -> DataFrame:
    """Of every file, how many of its lines other files share."""
    f = read(spark, d, "source_files")
    return spans.shared_share(f, read(spark, d, "regions"), cut(spans.shared_spans(f)))[0]


@query
def p7_region_share(spark: SparkSession, d: str) -> DataFrame:
    """Of every region, how many of its lines other files share."""
    f = read(spark, d, "source_files")
    return spans.shared_share(f, read(spark, d, "regions"), cut(spans.shared_spans(f)))[1]


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked(read(spark, d, "documents"), read(spark, d, "eval_items"))


@query
def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Where the passages stand in the original texts."""
    return leak.passages(read(spark, d, "documents"), read(spark, d, "eval_items"))


@query
def p8_item_report(spark: SparkSession, d: str) -> DataFrame:
    """Of every item, how many documents hold a passage of it."""
    return leak.leak_report(read(spark, d, "documents"), read(spark, d, "eval_items"))


@query
def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixed and shuffled copies, with their texts."""
    return mixture.Mixture(read(spark, d, "documents"), read(spark, d, "mix_targets")).copies()


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, next to the shares wanted."""
    return mixture.Mixture(read(spark, d, "documents"), read(spark, d, "mix_targets")).report()


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(read(spark, d, "documents")).filter("truncated").select("doc_id").distinct()


@query
def p10_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.source_rates(truncation.judged(read(spark, d, "documents")))


_COMPONENTS = """
und as (select u as x, v as y from link union select v, u from link),
walk as (select x as node, x as seen from und union select w.node, u.y from walk w join und u on u.x = w.seen),
comp as (select node, min(seen) as component from walk group by node)
"""
_MATCHES = f"""
with recursive g as (select row_number() over () as id, list_distinct(list_filter(regions, lambda x: x is not null)) as ms, case when similarity > 1 then similarity / 100 else similarity end as s from similar_groups where similarity is not null and not isnan(similarity)),
m as (select id, unnest(ms) as r from g where s >= 0.8),
k as (select m.id, m.r from m where r in (select region_id from regions)),
link as (select distinct a.r as u, k.r as v from (select id, min(r) as r from k group by id) a join k using (id) where a.r <> k.r),
{_COMPONENTS}
"""
_SETS = "(select distinct region_id, content from shingles where content is not null)"
_OVERLAP = f"""
s as (select region_id, content, count(*) over (partition by region_id) as n from {_SETS}),
l as (select list_id, content, count(*) over (partition by list_id) as n from (select distinct list_id, unnest(shingles) as content from reference_lists) where content is not null),
p as (select list_id, region_id, count(*) as i, any_value(l.n) as nl, any_value(s.n) as ns from l join s using (content) where l.n >= 8 and s.n >= 8 group by list_id, region_id)
"""
_MARKED = f"""
with t as (select count(distinct region_id) as t from shingles),
r as (select content, count(*) as n_rows from (select distinct region_id, seq, content from shingles where content is not null) group by content),
f as (select content, count(*) as n_regions from {_SETS} group by content)
select content, n_rows, n_regions, case when n_regions = 1 then 'rare' when n_regions >= 0.05 * t then 'common' end as mark from f join r using (content), t
"""

#: Lines as bytes in hexadecimal with a blank before each, shared lines, and their runs.
_SHARED = """
with f as (select file_id, string_split(regexp_replace(hex(source), '(..)', ' \\1', 'g'), ' 0A') as p
  from (select *, row_number() over (partition by file_id order by ingested_at desc nulls last) as n from source_files) where n = 1),
l as (select file_id, case when p is null then [] else list_transform(case when p[-1] = '' then p[1:len(p) - 1] else p end, lambda x: regexp_replace(x, ' 0D$', '')) end as ls from f),
ln as (select file_id, unnest(range(1, len(ls) + 1)) as pos, unnest(ls) as x from l),
g as (select file_id, pos, md5(string_agg(x, '|') over w) as h, count(*) over w as n from ln window w as (partition by file_id order by pos rows between current row and 7 following)),
s as (select distinct file_id, pos + unnest(range(0, 8)) as pos from g where n = 8 and h in (select h from g where n = 8 group by h having count(distinct file_id) > 1)),
r as (select file_id, pos, pos - row_number() over (partition by file_id order by pos) as run from s)
"""
_GRAMS = """
with d as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') as w, string_split_regex(text, '[A-Za-z0-9]+') as gap from documents where text is not null),
e as (select distinct item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) as w from eval_items where text is not null),
dw as (select doc_id, i, sum(before) over o + sum(size) over o - size as start, size from (select doc_id, unnest(range(1, len(w) + 1)) as i, length(unnest(w)) as size, length(unnest(gap[1:len(w)])) as before from d) window o as (partition by doc_id order by i)),
dg as (select doc_id, unnest(range(1, len(w) - 10)) as i, unnest(list_transform(range(1, len(w) - 10), lambda i: lower(array_to_string(list_slice(w, i, i + 11), ' ')))) as g from d where len(w) > 11),
eg as (select item_id, unnest(range(1, len(w) - 10)) as j, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) as g from e where len(w) > 11),
hit as (select distinct doc_id, item_id, i, i - j as diagonal from dg join eg using (g)),
isle as (select *, i - row_number() over (partition by doc_id, item_id, diagonal order by i) as isle from hit),
p as (select distinct doc_id, item_id, x, y from (select doc_id, item_id, min(i) as x, max(i) + 11 as y from isle group by doc_id, item_id, diagonal, isle))
"""

#: The plain SQL of those queries that SQL can state over whole tables.
SQL: dict[str, str] = {
    "p2_found": _MATCHES + "select node as region_id, component as component_id from comp",
    "p2_group_sizes": _MATCHES + "select component as component_id, count(distinct region_id) as n_regions, count(distinct tree_id) as n_files from comp join regions r on r.region_id = node group by component",
    "p3_found": f"""
with recursive s as (select region_id, content, count(*) over (partition by region_id) as n from {_SETS}),
i as (select a.region_id as u, b.region_id as v, count(*) as i, any_value(a.n) as na, any_value(b.n) as nb from s a join s b on a.content = b.content and a.region_id < b.region_id where a.n >= 8 and b.n >= 8 group by 1, 2),
r as (select distinct region_id, path, start_line, end_line from regions),
link as (select u, v from i left join r x on x.region_id = u left join r y on y.region_id = v where i >= 0.7 * (na + nb - i) - 1e-9
  and not coalesce(x.path = y.path and x.start_line <= y.end_line and y.start_line <= x.end_line, false)),
{_COMPONENTS}
select node as region_id, component as group_id from comp""",
    "p4_found": f"select content, mark from ({_MARKED}) where mark is not null",
    "p4_frequencies": _MARKED,
    "p6_found": f"with {_OVERLAP} select list_id, region_id from p where i >= 0.5 * (nl + ns - i)",
    "p6_pairs": f"with {_OVERLAP} select list_id, region_id, round(i / (nl + ns - i), 6) as similarity from p where i >= 0.5 * (nl + ns - i)",
    "p7_found": _SHARED + "select file_id, min(pos)::int as start_line, max(pos)::int as end_line from r group by file_id, run",
    "p7_file_share": _SHARED + "select l.file_id, len(ls)::int as n_lines, coalesce(n, 0) as shared_lines, round(coalesce(n / len(ls), 0.0), 6) as share from l left join (select file_id, count(*) as n from s group by file_id) using (file_id)",
    "p7_region_share": _SHARED + ", g2 as (select distinct region_id, tree_id, start_line, end_line from regions) select region_id, end_line - start_line + 1 as n_lines, count(pos) as shared_lines, round(count(pos) / (end_line - start_line + 1), 6) as share from g2 left join s on file_id = tree_id and pos between start_line and end_line group by region_id, start_line, end_line",
    "p8_passages": _GRAMS + "select p.doc_id, item_id, a.start::int as start_char, (b.start + b.size)::int as end_char, (y - x + 1)::int as n_words from p join dw a on a.doc_id = p.doc_id and a.i = x join dw b on b.doc_id = p.doc_id and b.i = y",
    "p8_item_report": _GRAMS + "select item_id, task, coalesce(n, 0) as n_documents, coalesce(w, 0)::int as longest_words from (select distinct item_id, task from eval_items) left join (select item_id, count(distinct doc_id) as n, max(y - x + 1) as w from p group by item_id) using (item_id)",
    "p8_found": """
with d as (select doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) as w from documents),
e as (select item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) as w from eval_items),
dg as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) as g from d),
eg as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) as g from e)
select distinct doc_id, item_id from dg join eg using (g)""",
}
