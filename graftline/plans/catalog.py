"""Registered queries of the core operators, each with DuckDB SQL where SQL can state it.

Keys start with the operator's identifier. Every query runs over its whole tables.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions import expressions as X
from graftline.operators import diff, inspect, lsh, minhash, pairing, regions, report, rules, shingles, trees, verify
from graftline.operators.components import connected_components
from graftline.plans.pipeline import detect, detect_files
from graftline.runtime import cut, latest, ranked, read, settled
from graftline.settings import Settings
from graftline.sources import files as sources
from graftline.sources import ignore
from graftline.sources.languages import BY_SUFFIX, GRAMMARS, detect_language, grammar, in_directory_scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SETTINGS = Settings()
EXAMPLES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "examples")


#: Digests of the example files in the order of their names.
EXAMPLE_DIGESTS = (
    "4b246c549f8acf401a074ff7fad9c7d7",
    "5fd89b2e51640c4df3242b11ae5fb9da",
    "c09fa34a262eee675bf065346f32c88c",
    "23118a2c50964acdf1468120a37b62cc",
    "8250fe544743edd8d07cea68bef885f0",
)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def files_table(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "source_files").select("file_id", "path", "rel_path", "repo_name").distinct()


def regions_table(spark: SparkSession, d: str) -> DataFrame:
    """Regions without redeliveries."""
    return read(spark, d, "regions").select("region_id", "path", "language", "region_type", "region_name", "start_line", "end_line", "tree_id", "root_seq", "end_seq", "shingle_language").distinct()


def signature_table(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "signatures").select("region_id", "sig").distinct()


FILES = "(select distinct file_id, path, rel_path, repo_name from source_files)"
REGIONS = "(select distinct region_id, path, language, region_type, region_name, start_line, end_line, tree_id from regions)"
SIGS = "(select distinct region_id, sig from signatures)"
SUFFIX = r"regexp_extract(path, '(\.[^./]+)$', 1)"
CASES = "case lower(" + SUFFIX + ") " + " ".join(f"when '{s}' then '{x}'" for s, x in BY_SUFFIX.items()) + " end"


# ------------------------------------------------------------------ sources
@query(f"select file_id, {CASES} as detected from {FILES}")
def s1_language_detect(spark: SparkSession, d: str) -> DataFrame:
    return files_table(spark, d).select("file_id", detect_language().alias("detected"))


@query("select * from (values ('config.yaml', 67::bigint, '%s'), ('guide.md', 253, '%s'), ('page.html', 181, '%s'), ('shapes.py', 580, '%s'), ('totals.js', 323, '%s')) t(rel_path, length, md5)" % EXAMPLE_DIGESTS)
def s2_read_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the example files, read whole."""
    return sources.read_binary(spark, EXAMPLES).select(ignore.relative(F.col("path"), F.lit(EXAMPLES)).alias("rel_path"), "length", F.md5("source").alias("md5"))


@query()
def s3_parse_source(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of every source file by kind and language."""
    f = sources.scan_table(read(spark, d, "source_files"))
    n = sources.parsed(sources.parse_files(f, tolerant=True, texts=frozenset())).join(f.select(F.col("file_id").alias("tree_id"), "language"), "tree_id")
    return n.groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"select distinct {CASES} as language, case {CASES} when 'jsx' then 'javascript' else {CASES} end as grammar from {FILES}")
def s4_grammar_alias(spark: SparkSession, d: str) -> DataFrame:
    assert GRAMMARS == {"jsx": "javascript"}
    return files_table(spark, d).select(detect_language().alias("language")).distinct().select("language", grammar().alias("grammar"))


@query(f"select file_id, {SUFFIX} in ({', '.join(repr(s) for s in BY_SUFFIX)}) as scanned from {FILES}")
def s6_directory_scan_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Directory scans compare suffixes with regard to case, unlike the detection."""
    return files_table(spark, d).select("file_id", in_directory_scan().alias("scanned"))


@query()
def s9_parse_errors(spark: SparkSession, d: str) -> DataFrame:
    """Files that do not parse are kept apart with their error."""
    return sources.parse_files(sources.scan_table(read(spark, d, "source_files"))).filter("parse_error is not null").select(F.col("tree_id").alias("file_id"), "parse_error")


@query()
def s10_parse_path(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the example directory per file."""
    f = sources.scan(spark, EXAMPLES)
    n = sources.parsed(sources.parse_files(f, tolerant=True)).groupBy(F.col("tree_id").alias("file_id")).agg(F.count(F.lit(1)).alias("n_nodes"))
    return f.join(n, "file_id").select("rel_path", "language", "n_nodes")


@query(f"""
with r as (select *, row_number() over (partition by file_id order by ingested_at desc nulls last) as n from source_files)
select file_id, path, rel_path, {CASES} as language, md5(source) as md5 from r where n = 1 and {CASES} is not null""")
def s13_table_source(spark: SparkSession, d: str) -> DataFrame:
    """The table of files as a source: the latest delivery of each, with its language."""
    return sources.scan_table(read(spark, d, "source_files")).select("file_id", "path", "rel_path", "language", F.md5(F.coalesce("source", F.lit(b""))).alias("md5"))


# ------------------------------------------------------------------ ignore filters
PATTERNS = ["!src", "tests/", "/src/*_1*.py", "*.min.js", "**/vendor/*", "docs/**", "node_modules", "[ab]*.go"]
_NAME = r"regexp_extract(rel_path, '([^/]*)$', 1)"


@query(f"""
select file_id, coalesce(starts_with(rel_path, 'tests/'), false) as directory,
  coalesce(regexp_full_match(rel_path, 'src/.*_1.*\\.py'), false) as anchored,
  coalesce(regexp_full_match(rel_path, '.*\\.min\\.js'), false) as simple,
  coalesce(regexp_full_match(rel_path, '.*/vendor/.*') or regexp_full_match(rel_path, '.*vendor/.*'), false) as double_star,
  coalesce(starts_with(rel_path, 'docs'), false) as double_star_end,
  coalesce(list_contains(string_split(rel_path, '/'), 'node_modules'), false) as component,
  coalesce(regexp_full_match({_NAME}, '[ab].*\\.go') or regexp_full_match(rel_path, '[ab].*\\.go')
    or list_bool_or(list_transform(string_split(rel_path, '/'), lambda x: regexp_full_match(x, '[ab].*\\.go'))), false) as class_glob,
  false as negated
from {FILES}""")
def i1_patterns(spark: SparkSession, d: str) -> DataFrame:
    """One column per kind of pattern."""
    rel = F.col("rel_path")
    names = ["negated", "directory", "anchored", "simple", "double_star", "double_star_end", "component", "class_glob"]
    return files_table(spark, d).select("file_id", *[ignore.matches(p, rel).alias(n) for n, p in zip(names, PATTERNS)])


@query(f"""
with r as (select distinct name, trim(both '/' from d) as d from (select name, unnest(ignore_dirs) as d from repo_configs) where d is not null and trim(d) <> '')
select file_id from {FILES} f
where not exists (select 1 from r where r.name = f.repo_name and (list_contains(string_split(f.rel_path, '/'), r.d) or starts_with(f.rel_path, r.d || '/')))
  and not coalesce(regexp_matches(rel_path, '^src/(.*/)?[^/]*_1[^/]*[.]py$') or regexp_matches(rel_path, '^lib/.*_2.*[.]go$') or regexp_matches(rel_path, '(^|/)tests(/|$)|(^|/)engine/'), false)""")
def i7_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    """Files that the ignore files of their directories leave: the repositories' own
    directories at the root, and globs that hold below a folder or everywhere."""
    name = F.trim(F.regexp_replace("d", "^/+|/+$", ""))
    own = read(spark, d, "repo_configs").select(F.col("name").alias("repo_name"), F.explode("ignore_dirs").alias("d")).filter("d is not null and trim(d) <> ''")
    own = own.select("repo_name", F.lit("").alias("base"), F.when(F.contains(name, F.lit("/")), F.concat(name, F.lit("/"))).otherwise(name).alias("pattern"))
    below = spark.createDataFrame([("src", "*_1*.py"), ("lib", "/*_2*.go"), ("", "tests"), ("", "**/engine/*"), ("", "!src"), ("", " ")], "base string, pattern string").withColumn("_all", F.lit(1))
    left = ignore.drop_by_directory(files_table(spark, d), own, "repo_name")
    return ignore.drop_by_directory(left.withColumn("_all", F.lit(1)), below, "_all").select("file_id")


@query(f"select file_id from {FILES} where not coalesce(starts_with(rel_path, 'tests/') or regexp_full_match(rel_path, '.*\\.min\\.js') or list_contains(string_split(rel_path, '/'), 'node_modules'), false)")
def i8_should_ignore(spark: SparkSession, d: str) -> DataFrame:
    return files_table(spark, d).filter(~ignore.ignored(F.col("rel_path"), ignore.parse_list("tests/, *.min.js,, node_modules"))).select("file_id")


@query(f"select file_id, case when starts_with(path, '/srv/scan/' || repo_name || '/') then substr(path, length('/srv/scan/' || repo_name || '/') + 1) end as rel from {FILES}")
def i9_relative_path(spark: SparkSession, d: str) -> DataFrame:
    return files_table(spark, d).select("file_id", ignore.relative(F.col("path"), F.concat(F.lit("/srv/scan/"), "repo_name")).alias("rel"))


# ------------------------------------------------------------------ regions
def _extracted(spark: SparkSession, d: str, name: str = "default") -> tuple[DataFrame, DataFrame, DataFrame, list]:
    f = sources.scan_table(read(spark, d, "source_files"))
    rs = rules.build_rules(name)
    nodes = cut(sources.parsed(sources.parse_files(f, tolerant=True, texts=rules.text_kinds(rs))))
    return f, nodes, regions.extract(nodes, f, rs), rs


@query()
def r2_extract_regions(spark: SparkSession, d: str) -> DataFrame:
    """All regions of the source files."""
    return _extracted(spark, d)[2].select("region_id", "path", "language", "region_type", "region_name", "start_line", "end_line")


_PARAGRAPHS = r"""
with l as (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null)),
b as (select *, not regexp_matches(line, '[^ \t\n\x0B\f\r]') as blank from l),
s as (select *, case when not blank and coalesce(lag(blank) over (partition by doc_id order by i), true) then 1 else 0 end as first from b),
g as (select *, sum(first) over (partition by doc_id order by i) as para from s where not blank),
"""


@query(_PARAGRAPHS.rstrip(",\n") + " select doc_id, min(i)::int as start_line, max(i)::int as end_line from g group by doc_id, para")
def r5_text_regions(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of the documents as regions with 1-based lines."""
    return sources.text_nodes(read(spark, d, "documents")).filter("kind = 'paragraph'").select(F.col("tree_id").alias("doc_id"), "start_line", "end_line")


@query()
def r6_injections(spark: SparkSession, d: str) -> DataFrame:
    """Fenced code of the documents, read as Markdown, by language, with its lines."""
    f = read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("doc_id").cast("string").alias("path"), F.lit("markdown").alias("language"), F.col("text").alias("source")).filter("source is not null")
    nodes = cut(sources.parsed(sources.parse_files(f, tolerant=True)))
    found = regions.extract(nodes, f, rules.build_rules("none"))
    return regions.injections(found, nodes).select(F.col("path").cast("long").alias("doc_id"), "language", "line_offset", F.length("source").alias("n_chars"))


_EXPLICIT = ", ".join(repr(x) for x in regions.EXPLICIT)


@query(f"select region_id, region_type from (select *, row_number() over (partition by path, start_line, end_line order by (case when region_type in ({_EXPLICIT}) then 0 else 1 end), region_id) as n from {REGIONS}) where n = 1")
def r10_region_dedup(spark: SparkSession, d: str) -> DataFrame:
    return regions.deduplicated(regions_table(spark, d), ["region_id"]).select("region_id", "region_type")


@query(f"select region_type, count(*) as n_regions from {REGIONS} group by region_type order by n_regions desc, region_type limit 10")
def r11_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent region types."""
    return regions.type_histogram(regions_table(spark, d))


@query(f"select region_id from {REGIONS} where end_line - start_line + 1 >= 5")
def r12_min_lines(spark: SparkSession, d: str) -> DataFrame:
    return regions.at_least(regions_table(spark, d), SETTINGS.min_lines).select("region_id")


_INFO = r"regexp_extract(line, '^ {0,3}```+\s*(.*)$', 1)"
_ALIAS = "case w " + " ".join(f"when '{a}' then '{b}'" for a, b in regions.FENCE_ALIASES.items()) + " else w end"


@query(f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null),
w as (select doc_id, lower(string_split(trim(regexp_replace({_INFO}, '\\s+', ' ', 'g')), ' ')[1]) as w from l where regexp_matches(line, '^ {{0,3}}```')),
a as (select doc_id, {_ALIAS} as x from w)
select doc_id, case when x in ({', '.join(repr(x) for x in rules.ALL)}) then x else '' end as language, count(*) as n from a group by all""")
def r13_fence_language(spark: SparkSession, d: str) -> DataFrame:
    """Languages that fence lines of the documents name."""
    l = read(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.col("line").rlike(r"^ {0,3}```"))
    info = F.regexp_extract("line", r"^ {0,3}```+\s*(.*)$", 1)
    return l.select("doc_id", regions.fence_language(info).alias("language")).groupBy("doc_id", "language").agg(F.count(F.lit(1)).alias("n"))


#: What each language's regions are, written out once more by hand.
_KINDS = """python=function_definition class_definition;javascript=function method_definition class_declaration;typescript=function method_definition class_declaration;
jsx=function method_definition class_declaration jsx_expression;tsx=function method_definition class_declaration jsx_expression;go=function_declaration method_declaration type_declaration;
java=method_declaration class_declaration;kotlin=function_declaration class_declaration;bash=function_definition if_statement while_statement;css=rule_set media_statement keyframes_statement;
sql=create_table select insert delete;yaml=block_mapping_pair block_sequence;rust=function_item impl_item struct_item enum_item trait_item macro_definition;
html=head body;markdown=heading code_block;astro=frontmatter template"""


@query(f"select split_part(x, '=', 1) as language, unnest(string_split(split_part(x, '=', 2), ' ')) as region_type from (select unnest(string_split(replace('{_KINDS}', chr(10), ''), ';')) as x)")
def r14_extraction_listing(spark: SparkSession, d: str) -> DataFrame:
    t = rules.rules_table(spark, rules.region_rules())
    return t.select(F.explode("languages").alias("language"), F.col("params")["region_type"].alias("region_type")).distinct()


# ------------------------------------------------------------------ rules and shingles over text trees
_R = rules.Rule
_M = rules.Match
_X = rules.Action.EXTRACT
TEXT_REGIONS = [
    _R("paragraphs", ("*",), _M(("paragraph",)), _X, {"region_type": "paragraph"}),
    _R("lines", ("text",), _M(("line",), parent=("paragraph",), grandparent=("document",)), _X, {"region_type": "line"}),
    _R("quotes", ("text", "go"), _M(("line",), text=("match", r"^> ")), _X, {"region_type": "section"}),
    _R("other languages", ("go",), _M(("line",)), _X, {"region_type": "body"}),
    _R("other parents", ("text",), _M(("line",), parent=("document",)), _X, {"region_type": "body"}),
]
TEXT_RULES = [
    _R("quoted lines", ("*",), _M(("line",), text=("match", r"^> ")), rules.Action.REMOVE),
    _R("words", ("*",), _M(("word",), text=("match", r"^[A-Z]")), rules.Action.ANONYMIZE, {"prefix": "NAME"}),
    _R("numbers", ("*",), _M(("word",), text=("match", r"^[0-9]+$")), rules.Action.REPLACE_VALUE, {"value": "<NUM>"}),
    _R("paragraphs", ("*",), _M(("paragraph",)), rules.Action.REPLACE_TYPE, {"token": "<PAR>"}),
]


def _text(spark: SparkSession, d: str) -> DataFrame:
    n = sources.text_nodes(read(spark, d, "documents")).withColumn("region_id", F.col("tree_id")).withColumn("shingle_language", F.lit("text"))
    return shingles.with_parents(n)


def _text_regions(spark: SparkSession, d: str, found: list) -> tuple[DataFrame, DataFrame]:
    """Nodes of the documents, whose capitalised words are identifiers, and their regions."""
    n = sources.text_nodes(read(spark, d, "documents"))
    n = n.withColumn("kind", F.when((F.col("kind") == "word") & F.col("text").rlike("^[A-Z]"), "identifier").otherwise(F.col("kind")))
    f = read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("doc_id").cast("string").alias("path"), F.lit("text").alias("language"))
    return n, regions.extract(n, f, found)


_WORDS = _PARAGRAPHS + r"""
w as (select doc_id, para, i, line, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as k from (select *, regexp_extract_all(line, '[^ \t\n\x0B\f\r]+') as ws from g)),
"""
_NAME_OF = "coalesce(list_filter(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+'), lambda x: regexp_matches(x, '^[A-Z]'))[1], 'anonymous')"


@query(_PARAGRAPHS + f"""
c as (select doc_id, 'paragraph' as region_type, 'anonymous' as region_name, min(i) as s, max(i) as e, 1 as k from g group by doc_id, para
  union all select doc_id, 'line', {_NAME_OF}, i, i, 2 from g
  union all select doc_id, 'section', {_NAME_OF}, i, i, 0 from g where regexp_matches(line, '^> ')),
o as (select *, row_number() over (partition by doc_id, s, e order by k) as n from c)
select doc_id, region_type, region_name, s::int as start_line, e::int as end_line from o where n = 1""")
def r1_text_regions(spark: SparkSession, d: str) -> DataFrame:
    """R1 to R4, R9 and R10 over the documents' trees: rules by language, parent and text,
    names, and one region per range, where an explicit type beats others."""
    r = _text_regions(spark, d, TEXT_REGIONS)[1]
    return r.select(F.col("path").cast("long").alias("doc_id"), "region_type", "region_name", "start_line", "end_line")


_VAL = "left(replace(replace(replace({}, '→', '->'), chr(10), '\\n'), chr(9), '\\t'), 50)"


@query(_PARAGRAPHS.rstrip(",\n") + " select doc_id, i::int as line_no, " + _VAL.format("line") + " as value from g")
def n3_leaf_value(spark: SparkSession, d: str) -> DataFrame:
    """Values as leaves have them, for every line of the documents."""
    n = sources.text_nodes(read(spark, d, "documents")).filter("kind = 'line'")
    return n.select(F.col("tree_id").alias("doc_id"), F.col("start_line").alias("line_no"), X.leaf_value("text").alias("value"))


@query(_WORDS.rstrip(",\n") + " select doc_id, count(*) as n_words from w where not regexp_matches(line, '^> ') group by doc_id")
def n1_subtree_removal(spark: SparkSession, d: str) -> DataFrame:
    """Words left after quoted lines went with all below them."""
    n = _text(spark, d).withColumns(shingles.compile_rules(TEXT_RULES))
    return shingles.without_removed(n).filter("kind = 'word'").groupBy(F.col("tree_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_words"))


@query(_WORDS + r"""
c as (select doc_id, word, min(i * 1000000 + k) as first from w where not regexp_matches(line, '^> ') and regexp_matches(word, '^[A-Z]') group by doc_id, word)
select doc_id, word, dense_rank() over (partition by doc_id order by first) as number from c""")
def n2_anonymize(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of anonymised words by first visit in each document."""
    n = shingles.numbered_names(shingles.without_removed(_text(spark, d).withColumns(shingles.compile_rules(TEXT_RULES))))
    return n.filter("anon is not null").select(F.col("tree_id").alias("doc_id"), F.col("text").alias("word"), F.col("number").cast("long").alias("number")).distinct()


@query(_WORDS + r"""
c as (select doc_id, word, dense_rank() over (partition by doc_id order by min(i * 1000000 + k)) as number from w where not regexp_matches(line, '^> ') and regexp_matches(word, '^[A-Z]') group by doc_id, word),
v as (select w.doc_id, case when regexp_matches(w.word, '^[0-9]+$') then '<NUM>' when c.number is not null then 'NAME_' || c.number else """ + _VAL.format("w.word") + r""" end as value
  from w left join c on c.doc_id = w.doc_id and c.word = w.word where not regexp_matches(line, '^> ')),
u as (select doc_id, 'word(' || value || ')' as rep from v union all select doc_id, 'line' from g where not regexp_matches(line, '^> ')
  union all select doc_id, '<PAR>' from (select distinct doc_id, para from g) union all select doc_id, 'document' from documents where text is not null)
select doc_id, rep, count(*) as n from u group by all""")
def e9_apply_rules(spark: SparkSession, d: str) -> DataFrame:
    """Representations of all nodes under a ruleset."""
    n = shingles.normalised(_text(spark, d), TEXT_RULES)
    return n.groupBy(F.col("tree_id").alias("doc_id"), "rep").agg(F.count(F.lit(1)).alias("n"))


@query(_WORDS + r"""
x as (select doc_id, i, 'paragraph→line→word(' || """ + _VAL.format("word") + r""" || ')' as content from w
  union all select doc_id, i, 'document→paragraph→line' from g)
select doc_id, content, count(*) as n, min(i)::int as first_line, max(i)::int as last_line from x group by all""")
def n5_path_kgrams(spark: SparkSession, d: str) -> DataFrame:
    """Vertical 3-grams of the documents' trees."""
    n = shingles.normalised(_text(spark, d), [])
    return shingles.path_kgrams(n, SETTINGS.k).groupBy(F.col("region_id").alias("doc_id"), "content").agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


@query(_WORDS + r"""
v0 as (select * from w where not regexp_matches(line, '^> ')),
c as (select doc_id, para, word, dense_rank() over (partition by doc_id, para order by min(i * 1000000 + k)) as number from v0 where regexp_matches(word, '^[A-Z]') group by doc_id, para, word),
v as (select v0.doc_id, v0.para, v0.i, v0.k, '<PAR>→line→' || case when c.number is not null then 'identifier(NAME_' || c.number else 'word(' || case when regexp_matches(v0.word, '^[0-9]+$') then '<NUM>' else """ + _VAL.format("v0.word") + r""" end end || ')' as content
  from v0 left join c using (doc_id, para, word)),
p as (select doc_id, para, min(i)::int as start_line from g group by doc_id, para)
select doc_id, p.start_line, count(*) as n_shingles, sum(i)::bigint as lines, md5(string_agg(content, chr(10) order by i, k)) as digest from v join p using (doc_id, para) group by doc_id, para, p.start_line""")
def n7_text_shingles(spark: SparkSession, d: str) -> DataFrame:
    """Shingles of every paragraph under a ruleset, in order, with their lines (N5 to N8):
    names are numbered anew in each region, and its root has no parent there."""
    own = [_R("words", ("text",), _M(("identifier",)), rules.Action.ANONYMIZE, {"prefix": "NAME"}) if r.action is rules.Action.ANONYMIZE else r for r in TEXT_RULES]
    n, found = _text_regions(spark, d, TEXT_REGIONS[:1])
    s = shingles.shingle_regions(n, cut(found), own, SETTINGS.k).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_shingles"), F.sum("start_line").alias("lines"), F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("s"))
    s = s.join(found.select("region_id", F.col("path").cast("long").alias("doc_id"), "start_line"), "region_id")
    return s.select("doc_id", "start_line", "n_shingles", "lines", F.md5(F.array_join(F.transform("s", lambda x: x["content"]), "\n")).alias("digest"))


@query()
def n8_region_shingles(spark: SparkSession, d: str) -> DataFrame:
    """Shingles of all extracted regions under the default rules."""
    f, nodes, found, rs = _extracted(spark, d)
    return shingles.shingle_regions(nodes, cut(found), rs, SETTINGS.k).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_shingles"), F.count_distinct("content").alias("n_contents"))


@query("select region_id, md5(string_agg(content, chr(10) order by seq)) as digest, count(*) as n from (select distinct region_id, seq, content from shingles where content is not null) group by region_id")
def n9_content_list(spark: SparkSession, d: str) -> DataFrame:
    l = verify.content_lists(read(spark, d, "shingles"))
    return l.select("region_id", F.md5(F.array_join("contents", "\n")).alias("digest"), F.size("contents").cast("long").alias("n"))


#: How many rules remove, replace a type, replace a value and anonymise in the loose set,
#: by language, written out by hand; what the JavaScript relatives share counts for each.
_LOOSE = "python 6 3 3 1,javascript 2 2 3 1,typescript 2 2 3 1,tsx 2 2 3 1,jsx 2 2 3 1,go 3 2 5 2,java 2 0 3 1,kotlin 2 0 3 1,bash 1 2 4 0,css 1 2 2 0,html 2 1 2 0,sql 1 1 1 1,yaml 1 0 2 0,astro 1 0 2 0,rust 8 2 5 1"


@query(f"""
with x as (select string_split(unnest(string_split('{_LOOSE}', ',')), ' ') as v),
n as (select v[1] as language, unnest(['remove', 'replace_node_type', 'replace_value', 'anonymize']) as action, unnest(v[2:5])::bigint as n_rules from x),
e as (select split_part(x, '=', 1) as language, string_split(split_part(x, '=', 2), ' ') as t from (select unnest(string_split(replace('{_KINDS}', chr(10), ''), ';')) as x))
select * from n where n_rules > 0 union all select language, 'extract_region', len(t) + case when language = 'markdown' then 1 else 0 end from e""")
def g12_rule_listing(spark: SparkSession, d: str) -> DataFrame:
    """Rules of the loose ruleset by language and action."""
    t = rules.rules_table(spark, rules.ruleset("loose")).select(F.explode("languages").alias("language"), "action")
    return t.groupBy("language", "action").agg(F.count(F.lit(1)).alias("n_rules"))


@query("""
select * from (values ('filtered', 'remove', 5::bigint), ('filtered', 'replace_value', 2), ('filtered', 'extract_region', 1),
  ('added', 'extract_region', 50), ('excluded', 'extract_region', 47), ('specified', 'extract_region', 1), ('specified', 'remove', 2)) t(name, action, n_rules)""")
def b7_build_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules left by filters, additions and exclusions."""
    cases = {
        "filtered": rules.build_rules("default", region_filters=rules.parse_region_specs(["Python:function_definition"])),
        "added": rules.build_rules("none", additional={"go": ["if_statement", "for_statement"]}),
        "excluded": rules.build_rules("loose", excluded={"css": ["rule_set"]}),
    }
    spec = {"rulesets": {"base": {"rules": [{"name": "notes", "languages": ["go"], "kinds": ["comment"], "action": "remove"}, {"name": "heads", "languages": ["*"], "kinds": ["line"], "parent": ["paragraph"], "action": "extract_region"}]}, "own": {"extends": "base", "rules": [{"name": "marks", "languages": ["go"], "kinds": ["identifier"], "field": "name", "text": ["eq", "x"], "action": "remove"}]}}}
    cases["specified"] = rules.load_rules(spec, "own")
    rows = [(k, r.action.value) for k, rs in cases.items() for r in rs]
    return spark.createDataFrame(rows, "name string, action string").groupBy("name", "action").agg(F.count(F.lit(1)).alias("n_rules"))


# ------------------------------------------------------------------ signatures and banding
_AB = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(X.coefficients()))


@query(f"""
with c as (select distinct region_id, (('0x' || substr(md5(content), 1, 8))::bigint) % {X.P} as h from shingles where content is not null),
v as (select region_id, i, min((h * a + b) % {X.P}) as m from c, (values {_AB}) t(i, a, b) group by region_id, i)
select region_id, md5(string_agg(m::varchar, ',' order by i)) as digest from v group by region_id""")
def m1_minhash(spark: SparkSession, d: str) -> DataFrame:
    s = minhash.signatures(read(spark, d, "shingles")).filter(F.size("sig") > 0)
    return s.select("region_id", F.md5(F.array_join(F.col("sig").cast("array<string>"), ",")).alias("digest"))


@query(f"""
with n as (select region_id, count(*) as n from (select distinct region_id, seq from shingles where content is not null) group by region_id),
s as (select region_id, max(shingle_count) as c, max(len(sig)) as l from signatures group by region_id)
select n.region_id, n.n as counted, s.c::bigint as stated, coalesce(s.l, 0) > 0 as signed from n left join s using (region_id)""")
def m2_signature_counts(spark: SparkSession, d: str) -> DataFrame:
    """Shingle counts, which keep repeats, next to the counts stated."""
    n = minhash.signatures(read(spark, d, "shingles")).filter("shingle_count > 0").select("region_id", F.col("shingle_count").cast("long").alias("counted"))
    s = read(spark, d, "signatures").groupBy("region_id").agg(F.max("shingle_count").cast("long").alias("stated"), F.max(F.size("sig")).alias("l"))
    return n.join(s, "region_id", "left").select("region_id", "counted", "stated", (F.coalesce("l", F.lit(0)) > 0).alias("signed"))


@query(f"""
with p as (select distinct regions[1] as a, regions[2] as b from similar_groups where len(regions) = 2 and regions[1] is not null and regions[2] is not null)
select a, b, round(case when len(x.sig) = 0 or len(y.sig) = 0 then 0.0 else len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / greatest(len(x.sig), len(y.sig)) end, 6) as estimate
from p join {SIGS} x on x.region_id = a join {SIGS} y on y.region_id = b""")
def m3_jaccard_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Estimated similarity of the pairs that earlier runs matched."""
    g = read(spark, d, "similar_groups").filter((F.size("regions") == 2) & (F.array_size(F.array_compact("regions")) == 2))
    p = g.select(F.col("regions")[0].alias("a"), F.col("regions")[1].alias("b")).distinct()
    return lsh.estimated(p, signature_table(spark, d)).select("a", "b", F.round("estimate", 6).alias("estimate"))


_B, _ROWS = lsh.shape(SETTINGS.lsh_threshold)
_BAND = f"""
reg as {REGIONS},
s as (select region_id, sig from {SIGS} where len(sig) >= {_B * _ROWS}),
rep as (select region_id, min(region_id) over (partition by sig) as rep from {SIGS} where len(sig) > 0),
band as (select region_id, unnest(range(0, {_B})) as band, sig from s),
key as (select region_id, band, md5(array_to_string(list_slice(sig, band * {_ROWS} + 1, band * {_ROWS} + {_ROWS}), ',')) as bucket from band),
cand as (select distinct x.region_id as a, y.region_id as b from key x join key y on x.band = y.band and x.bucket = y.bucket and x.region_id < y.region_id),
est as (select a, b, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 128.0 as estimate from cand join s x on x.region_id = a join s y on y.region_id = b),
edge as (select e.a, e.b, e.estimate from est e join reg x on x.region_id = a join reg y on y.region_id = b
  where estimate >= {SETTINGS.pair_threshold} and not (x.path = y.path and x.start_line <= y.end_line and y.start_line <= x.end_line)),
"""


@query(f"with {_BAND} o as (select band, bucket, count(*) as n from key group by all) select band::int as band, bucket, n from o")
def l2_band_buckets(spark: SparkSession, d: str) -> DataFrame:
    k = lsh.bands(signature_table(spark, d), _B, _ROWS)
    return k.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_BAND} u as (select a as x from cand union all select b from cand), n as (select x, count(*) as n from u group by x) select region_id, rep, coalesce(n, 0) as n_candidates from s join rep using (region_id) left join n on x = region_id")
def l3_candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of every region: its class, and how many other regions share a bucket
    with it, over all regions."""
    return lsh.candidate_counts(signature_table(spark, d), SETTINGS.lsh_threshold)


@query(f"""
select distinct x.region_id as a, y.region_id as b from {REGIONS} x join {REGIONS} y on x.path = y.path and x.region_id < y.region_id and x.start_line <= y.end_line and y.start_line <= x.end_line""")
def l4_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one file's regions that share a line, so can be no pair."""
    return pairing.overlapping(regions_table(spark, d))


@query(f"with {_BAND} u as (select a as x from edge union all select b from edge) select region_id, rep, count(*) as n_links from u join rep on x = region_id group by region_id, rep")
def l5_edges(spark: SparkSession, d: str) -> DataFrame:
    """Similar regions that share no line: each region's class and its number of pairs,
    over all regions (L3 to L5)."""
    return lsh.link_counts(signature_table(spark, d), regions_table(spark, d), SETTINGS)


_COMP = """
und as (select a as x, b as y from edge union select b, a from edge),
walk as (select x as node, x as seen from und union select w.node, u.y from walk w join und u on u.x = w.seen),
comp as (select node as region_id, min(seen) as group_id from walk group by node),
"""


@query(f"with recursive {_BAND} {_COMP} o as (select * from comp) select region_id, group_id from o")
def l7_components(spark: SparkSession, d: str) -> DataFrame:
    """Regions and the group that pairs join them into."""
    return lsh.groups(lsh.links(signature_table(spark, d), regions_table(spark, d), SETTINGS))


_MEAN = f"""
posn as (select group_id, i, v, count(*) as n from (select group_id, unnest(range(1, 129)) as i, unnest(sig) as v from comp join {SIGS} using (region_id)) group by all),
agree as (select group_id, sum(n * (n - 1) / 2) as agree from posn group by group_id),
size as (select group_id, count(*) as size from comp group by group_id),
mean as (select group_id, size, agree / (size * (size - 1) / 2.0 * 128) as similarity from size join agree using (group_id)),
"""


@query(f"with recursive {_BAND} {_COMP} {_MEAN} o as (select * from mean) select group_id, size, round(similarity, 6) as similarity from o")
def l9_group_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean estimate over all member pairs of each group, found without forming pairs."""
    sig = signature_table(spark, d)
    m = lsh.groups(lsh.links(sig, regions_table(spark, d), SETTINGS))
    return lsh.group_means(m, sig).select("group_id", "size", F.round("similarity", 6).alias("similarity"))


@query(f"with recursive {_BAND} {_COMP} {_MEAN} o as (select * from mean where similarity >= {SETTINGS.pair_threshold} and size >= 2) select group_id, size, round(similarity, 6) as similarity, row_number() over (order by round(similarity, 6) desc, group_id)::int as place from o")
def l12_ranked_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups that pass the group filter, by falling similarity."""
    g, _ = lsh.similar_groups(signature_table(spark, d), regions_table(spark, d), SETTINGS)
    g = g.select("group_id", "size", F.round("similarity", 6).alias("similarity"))
    return ranked(g, [F.desc("similarity"), F.col("group_id")])


@query(f"select s.region_id from {SIGS} s join {REGIONS} r using (region_id) where r.end_line - r.start_line + 1 >= 5")
def l13_long_signatures(spark: SparkSession, d: str) -> DataFrame:
    r = lsh.long_enough(regions_table(spark, d), SETTINGS.min_lines)
    return signature_table(spark, d).join(r.select("region_id"), "region_id", "left_semi").select("region_id")


@query(f"with recursive {_BAND} {_COMP} {_MEAN} o as (select * from mean where similarity >= {SETTINGS.pair_threshold}) select coalesce(sum(size * (size - 1) // 2), 0)::bigint as candidate_pairs from o")
def l14_candidate_pair_count(spark: SparkSession, d: str) -> DataFrame:
    """Pairs inside the candidate groups."""
    return lsh.candidate_pair_count(lsh.similar_groups(signature_table(spark, d), regions_table(spark, d), SETTINGS)[0])


# ------------------------------------------------------------------ verification
@query()
def v1_ordered_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Ordered ratio of the pairs that earlier runs matched."""
    g = read(spark, d, "similar_groups").filter((F.size("regions") == 2) & (F.array_size(F.array_compact("regions")) == 2))
    p = g.select(F.col("regions")[0].alias("a"), F.col("regions")[1].alias("b")).distinct()
    l = verify.content_lists(read(spark, d, "shingles"))
    j = p.join(l.toDF("a", "la"), "a").join(l.toDF("b", "lb"), "b")
    return j.select("a", "b", F.round(verify.ratio("la", "lb"), 6).alias("ratio"))


@query(f"""
with l as (select region_id, md5(string_agg(content, chr(10) order by seq)) as digest from (select distinct region_id, seq, content from shingles where content is not null) group by region_id),
r as (select region_id, path, start_line, end_line, digest from {REGIONS} join l using (region_id)),
last as (select path, start_line, arg_max(digest, end_line::bigint * 1000000000 + region_id) as digest from r group by all)
select r.region_id, last.digest from {REGIONS} r left join last using (path, start_line)""")
def v2_region_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Regions that start on one line share the last one's list (V2, V3)."""
    l = verify.looked_up(verify.content_lists(read(spark, d, "shingles")), regions_table(spark, d))
    return l.select("region_id", F.md5(F.array_join("contents", "\n")).alias("digest"))


@query(f"""
select ruleset, language, region_type, ruleset <> 'none' and case region_type when 'class' then language in ('python', 'javascript', 'typescript', 'tsx', 'jsx', 'java', 'kotlin')
  else language in ('python', 'javascript', 'typescript', 'tsx', 'jsx', 'go') end as anonymised
from (select unnest(['none', 'default', 'loose']) as ruleset), (select split_part(unnest(string_split(replace('{_KINDS}', chr(10), ''), ';')), '=', 1) as language), (select unnest(['function', 'class', 'method']) as region_type)""")
def v5_name_anonymised(spark: SparkSession, d: str) -> DataFrame:
    """Whether a ruleset hides names of functions, classes and methods (V4, V5)."""
    rows = [(n, x, t, rules.anonymises_name(rules.build_rules(n), x, t)) for n in ("none", "default", "loose") for x in rules.ALL for t in verify.GATED]
    return spark.createDataFrame(rows, "ruleset string, language string, region_type string, anonymised boolean")


#: Bytes in hexadecimal with a blank before each, so that lines can be cut at line feeds.
LATEST = "(select file_id, source from (select *, row_number() over (partition by file_id order by ingested_at desc nulls last) as n from source_files) where n = 1)"
HEX = "regexp_replace(hex(source), '(..)', ' \\1', 'g')"


@query(f"""
with f as (select file_id, string_split({HEX}, ' 0A') as ls from {LATEST} where source is not null)
select region_id, replace(regexp_replace(regexp_replace(ls[start_line], '^( (20|09|0B|0C|0D))+', ''), '( (20|09|0B|0C|0D))+$', ''), ' ', '') as signature
from {REGIONS} left join f on file_id = tree_id""")
def v6_signature_lines(spark: SparkSession, d: str) -> DataFrame:
    """First source line of each region, stripped, as hexadecimal bytes."""
    return _signatures(spark, d).select("region_id", F.hex(F.encode("signature", "ISO-8859-1")).alias("signature"))


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    return verify.signature_lines(regions_table(spark, d), latest(read(spark, d, "source_files").select("file_id", "source", "ingested_at"), ["file_id"], "ingested_at"))


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = regions_table(spark, d)
    g, m = lsh.similar_groups(settled(signature_table(spark, d)), r, SETTINGS)
    return settled(g), settled(m), r


@query()
def v9_verified_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups with their mean ordered ratio, penalties and the final filter."""
    g, m, r = _groups(spark, d)
    f = latest(read(spark, d, "source_files").select("file_id", "source", "ingested_at"), ["file_id"], "ingested_at")
    v = verify.verified(m, verify.content_lists(read(spark, d, "shingles")), r, verify.signature_lines(r, f), rules.build_rules(SETTINGS.ruleset))
    return v.filter(F.col("similarity") >= SETTINGS.similarity).select("group_id", "size", F.round("similarity", 6).alias("similarity"))


_KEPT = f"kept as (select * from mean where similarity >= {SETTINGS.pair_threshold} and size >= 2), mem as (select comp.* from comp join kept using (group_id)),"


@query(f"with recursive {_BAND} {_COMP} {_MEAN} {_KEPT} o as (select group_id, count(*) as size from mem join {REGIONS} using (region_id) group by group_id having min(end_line - start_line + 1) >= 5) select group_id, size from o")
def v11_group_min_lines(spark: SparkSession, d: str) -> DataFrame:
    g, m, r = _groups(spark, d)
    return verify.long_groups(m, r, SETTINGS.min_lines)


# ------------------------------------------------------------------ pipeline and reports
@query()
def pipeline_detect(spark: SparkSession, d: str) -> DataFrame:
    """P1 to P7 over the table of source files: verified groups."""
    f = detect_files(sources.scan_table(read(spark, d, "source_files")), SETTINGS)
    return f.groups.select("group_id", "size", F.round("similarity", 6).alias("similarity"))


@query()
def pipeline_examples(spark: SparkSession, d: str) -> DataFrame:
    """P7 over a directory: the example files."""
    f = detect(spark, EXAMPLES, Settings(similarity=0.5))
    return f.groups.select("size", F.round("similarity", 6).alias("similarity"))


@query(f"""
with recursive {_BAND} {_COMP} {_MEAN} {_KEPT}
f as (select language, count(distinct path) as n_files from reg group by language),
m as (select mem.group_id, reg.* from mem join reg using (region_id)),
l as (select language, sum(end_line - start_line + 1) as n_lines from m group by language),
o as (select group_id, language, row_number() over (partition by group_id order by path, start_line, end_line, region_id) as k from m),
g as (select language, count(*) as n_groups from o where k = 1 group by language),
per as (select f.language, n_files, coalesce(n_groups, 0) as n_groups, coalesce(n_lines, 0)::bigint as n_lines from f left join l using (language) left join g using (language))
select * from per union all select 'total', (select count(distinct path) from reg), sum(n_groups)::bigint, sum(n_lines)::bigint from per""")
def g4_language_summary(spark: SparkSession, d: str) -> DataFrame:
    """Files, groups and similar lines per language, and a total."""
    g, m, r = _groups(spark, d)
    return report.language_summary(r, g, m)


@query(f"with recursive {_BAND} {_COMP} {_MEAN} {_KEPT} o as (select group_id, avg(end_line - start_line + 1) as mean_lines from mem join reg using (region_id) group by group_id) select group_id, round(similarity, 6) as similarity, round(mean_lines, 6) as mean_lines from o join kept using (group_id)")
def g5_display_order(spark: SparkSession, d: str) -> DataFrame:
    g, m, r = _groups(spark, d)
    return report.display_order(g, m, r).select("group_id", F.round("similarity", 6).alias("similarity"), F.round("mean_lines", 6).alias("mean_lines"))


@query(f"""
with recursive {_BAND} {_COMP} {_MEAN} {_KEPT}
o as (select group_id, reg.*, row_number() over (partition by group_id order by path, start_line, end_line, region_id) - 1 as ordinal from mem join reg using (region_id))
select group_id, -1 as ordinal, printf('Similar group (%.1f%%): %d regions', similarity * 100, size) as line from kept
union all select group_id, ordinal::int, printf('  %s [%d:%d] (%d lines) %s(%s)', path, start_line, end_line, end_line - start_line + 1, coalesce(region_name, 'null'), region_type) from o""")
def g6_group_display(spark: SparkSession, d: str) -> DataFrame:
    g, m, r = _groups(spark, d)
    return report.display_lines(g, m, r)


@query(f"with recursive {_BAND} {_COMP} {_MEAN} {_KEPT} o as (select group_id, min(path) as path from mem join reg using (region_id) group by group_id having min(path) = max(path)) select group_id, path from o")
def g7_self_similar(spark: SparkSession, d: str) -> DataFrame:
    g, m, r = _groups(spark, d)
    return report.self_similar(m, r)


@query(f"select language, string_agg(distinct region_type, ',' order by region_type) as types from {REGIONS} group by language")
def g10_types_used(spark: SparkSession, d: str) -> DataFrame:
    return regions.types_used(regions_table(spark, d))


@query(f"""
with recursive {_BAND} {_COMP} {_MEAN} {_KEPT}
o as (select group_id, reg.*, row_number() over (partition by group_id order by path, start_line, end_line, region_id) as k from mem join reg using (region_id))
select group_id, case when similarity >= 0.95 then 'error' when similarity >= 0.85 then 'warning' else 'note' end as level, printf('%d similar regions (%.1f%%)', size, similarity * 100) as message,
  max(path) filter (where k = 1) as uri, max(start_line) filter (where k = 1)::varchar as start_line, (size - 1)::int as n_related,
  max(region_type || ': ' || coalesce(region_name, 'null')) filter (where k = 2) as second, max(end_line) filter (where k = 2)::varchar as second_end, size::varchar as group_size
from o join kept using (group_id) group by group_id, size, similarity""")
def k2_sarif_results(spark: SparkSession, d: str) -> DataFrame:
    """One SARIF result per group as JSON, read again field by field (K2 to K4)."""
    g, m, r = _groups(spark, d)
    at = lambda path: F.get_json_object("result", path)
    place = "physicalLocation"
    return report.sarif_results(g, m, r).select(
        "group_id", at("$.level").alias("level"), at("$.message.text").alias("message"), at(f"$.locations[0].{place}.artifactLocation.uri").alias("uri"), at(f"$.locations[0].{place}.region.startLine").alias("start_line"),
        F.json_array_length(at("$.relatedLocations")).alias("n_related"), at("$.relatedLocations[0].message.text").alias("second"), at(f"$.relatedLocations[0].{place}.region.endLine").alias("second_end"), at("$.properties.groupSize").alias("group_size"))


@query("select group_id, case when s >= 0.95 then 'error' when s >= 0.85 then 'warning' else 'note' end as level from (select distinct group_id, case when similarity > 1 then similarity / 100 else similarity end as s from similar_groups where similarity is not null)")
def k4_level(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity"))
    return read(spark, d, "similar_groups").filter("similarity is not null").select("group_id", s.alias("similarity")).distinct().select("group_id", X.sarif_level().alias("level"))


@query()
def d2_line_diff(spark: SparkSession, d: str) -> DataFrame:
    """Line opcodes between the first two members of every group."""
    g, m, r = _groups(spark, d)
    f = latest(read(spark, d, "source_files").select("file_id", "source", "ingested_at"), ["file_id"], "ingested_at")
    x = diff.group_diffs(m, r, f)
    return x.select("group_id", "a", "b", "identical", F.size("ops").alias("n_ops"))


@query(f"""
with recursive {_BAND} {_COMP} {_MEAN} {_KEPT}
o as (select group_id, reg.*, row_number() over (partition by group_id order by path, start_line, end_line, region_id) as k from mem join reg using (region_id)),
f as (select file_id, string_split({HEX}, ' 0A') as ls from {LATEST}),
t as (select group_id, k, region_id, list_slice(ls, start_line, end_line) as x from o left join f on file_id = tree_id where k <= 2)
select x.group_id, x.region_id as a, y.region_id as b, x.x = y.x as identical from t x join t y on x.group_id = y.group_id and x.k = 1 and y.k = 2""")
def d3_identical(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first two members of every group have the same lines."""
    g, m, r = _groups(spark, d)
    f = latest(read(spark, d, "source_files").select("file_id", "source", "ingested_at"), ["file_id"], "ingested_at")
    return diff.group_diffs(m, r, f).select("group_id", "a", "b", "identical")


@query()
def d4_char_highlight(spark: SparkSession, d: str) -> DataFrame:
    """Character opcodes of replaced line pairs."""
    g, m, r = _groups(spark, d)
    f = latest(read(spark, d, "source_files").select("file_id", "source", "ingested_at"), ["file_id"], "ingested_at")
    text = diff.region_lines(r, f)
    x = diff.group_diffs(m, r, f).select("group_id", "a", "b", F.explode("ops").alias("op")).filter("op.tag = 'replace' and op.i2 - op.i1 = op.j2 - op.j1")
    x = x.join(text.toDF("a", "la"), "a").join(text.toDF("b", "lb"), "b").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("op.i2") - F.col("op.i1") - 1)))
    x = x.select("group_id", (F.col("op.i1") + F.col("k")).alias("line"), F.get("la", F.col("op.i1") + F.col("k")).alias("x"), F.get("lb", F.col("op.j1") + F.col("k")).alias("y"))
    return x.select("group_id", "line", F.size(diff.char_opcodes("x", "y")).alias("n_ops"))


@query(_WORDS + r"""
c as (select doc_id, word, dense_rank() over (partition by doc_id order by min(i * 1000000 + k)) as number from w where regexp_matches(word, '^[A-Z]') group by doc_id, word),
v as (select w.doc_id, w.i, count(*) as n, count(c.number) filter (where not regexp_matches(w.word, '^[0-9]+$')) as named from w left join c on c.doc_id = w.doc_id and c.word = w.word group by all)
select doc_id, i::int as line, n, named from v""")
def t1_tokens_by_line(spark: SparkSession, d: str) -> DataFrame:
    """Words shown per line, where a removed line's words are still shown."""
    n = sources.text_nodes(read(spark, d, "documents")).withColumn("shingle_language", F.lit("text"))
    t = inspect.tokens_by_line(n, TEXT_RULES)
    count = lambda p: F.size(F.regexp_extract_all("tokens", F.lit(p), 0)).cast("long")
    t = t.select(F.col("tree_id").alias("doc_id"), "line", count(r"(?:^| )word\(").alias("n"), count(r"(?:^| )word\(NAME_\d+\)(?= |$)").alias("named"))
    return t.filter("n > 0")


@query()
def t2_transformed_source(spark: SparkSession, d: str) -> DataFrame:
    """Every source file's lines as the loose rules leave them."""
    f = sources.scan_table(read(spark, d, "source_files"))
    loose = rules.build_rules("loose")
    return trees.transformed_files(f, loose, rules.text_kinds(loose)).withColumnRenamed("tree_id", "file_id")


@query("""
with recursive g as (select list_filter(regions, lambda x: x is not null) as m from similar_groups where regions is not null),
e as (select distinct list_min(m) as a, unnest(m) as b from g), und as (select a as x, b as y from e where a <> b union select b, a from e where a <> b),
walk as (select x as node, x as seen from und union select w.node, u.y from walk w join und u on u.x = w.seen) select node, min(seen) as component from walk group by node""")
def l7_union_find(spark: SparkSession, d: str) -> DataFrame:
    """Components of all matches of earlier runs, whatever their similarity: each row's
    members are linked to its least one."""
    g = read(spark, d, "similar_groups").select(F.array_compact("regions").alias("m"))
    e = g.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).filter("a <> b").distinct()
    return connected_components(e)
