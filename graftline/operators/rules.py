"""Rules as data: which nodes form regions, and how nodes are normalised.

A pattern is a kind set with optional conditions on the parent, the grandparent, a field,
the node's own text or a descendant; it compiles to one boolean Column over the node
table. Equal patterns share one column, and rules of the four JavaScript relatives, which
would repeat, are compiled once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.sources.languages import SUFFIXES


class Action(str, Enum):
    REMOVE = "remove"
    REPLACE_TYPE = "replace_node_type"
    REPLACE_VALUE = "replace_value"
    ANONYMIZE = "anonymize"
    EXTRACT = "extract_region"


@dataclass(frozen=True)
class Match:
    """A node pattern. ``has`` names (kind, text pattern) of a descendant that must exist;
    ``text`` is (operator, argument) with match, eq or not_eq."""

    kinds: tuple[str, ...]
    parent: tuple[str, ...] = ()
    grandparent: tuple[str, ...] = ()
    field: str | None = None
    text: tuple[str, str] | None = None
    has: tuple[str, str] | None = None

    def column(self) -> Column:
        """The pattern over node columns, with parent_kind, grandparent_kind and, where
        ``has`` is used, an array ``inner`` of the descendants' kinds and texts."""
        c = F.col("kind").isin(*self.kinds)
        if self.parent:
            c = c & F.col("parent_kind").isin(*self.parent)
        if self.grandparent:
            c = c & F.col("grandparent_kind").isin(*self.grandparent)
        if self.field:
            c = c & (F.col("field") == self.field)
        if self.text:
            op, arg = self.text
            t = F.col("text")
            c = c & {"match": t.rlike(arg), "eq": t == arg, "not_eq": t != arg}[op]
        if self.has:
            kind, pattern = self.has
            c = c & F.exists(F.coalesce("inner", F.array().cast("array<struct<kind:string,text:string>>")), lambda x: (x["kind"] == kind) & x["text"].rlike(pattern))
        return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Rule:
    name: str
    languages: tuple[str, ...]
    match: Match
    action: Action
    params: Mapping[str, str] = field(default_factory=dict, hash=False)
    inject: str | None = None
    content: str | None = None

    def for_language(self, language: str) -> bool:
        return "*" in self.languages or language in self.languages


JS = ("javascript", "typescript", "tsx", "jsx")
ALL = tuple(SUFFIXES)


def _drop(name, langs, kinds, **m):
    return Rule(name, langs, Match(tuple(kinds.split()), **m), Action.REMOVE)


def _value(name, langs, kinds, value, **m):
    return Rule(name, langs, Match(tuple(kinds.split()), **m), Action.REPLACE_VALUE, {"value": value})


def _type(name, langs, kinds, token, **m):
    return Rule(name, langs, Match(tuple(kinds.split()), **m), Action.REPLACE_TYPE, {"token": token})


def _anon(name, langs, kinds, prefix="VAR", **m):
    return Rule(name, langs, Match(tuple(kinds.split()), **m), Action.ANONYMIZE, {"prefix": prefix})


#: Node kinds, tokens and prefixes of each language's rules, in order.
DEFAULTS: dict[str, list[Rule]] = {
    "python": [
        _drop("imports", ("python",), "import_statement import_from_statement future_import_statement"),
        _drop("type-checking blocks", ("python",), "if_statement", has=("attribute", r"TYPE_CHECKING$")),
        _drop("type variables", ("python",), "assignment", has=("call", r"^([\w.]+\.)?TypeVar\w*\(")),
        _drop("comments", ("python",), "comment"),
        _drop("docstrings", ("python",), "string", parent=("module", "block")),
        _value("function names", ("python",), "identifier", "FUNC", parent=("function_definition",), field="name"),
        _value("class names", ("python",), "identifier", "CLASS", parent=("class_definition",), field="name"),
    ],
    "javascript": [
        _drop("imports and exports", JS, "import_statement export_statement"),
        _drop("comments", JS, "comment hash_bang_line"),
        _value("function names", JS, "identifier property_identifier", "FUNC", parent=("function_declaration", "method_definition"), field="name"),
        _value("class names", ("javascript", "jsx"), "identifier", "CLASS", parent=("class_declaration",)),
        _value("class names", ("typescript", "tsx"), "type_identifier", "CLASS", parent=("class_declaration",)),
    ],
    "go": [
        _drop("imports", ("go",), "import_declaration"),
        _drop("package clause", ("go",), "package_clause"),
        _drop("comments", ("go",), "comment"),
        _value("function names", ("go",), "identifier", "FUNC", parent=("function_declaration",), field="name"),
        _value("method names", ("go",), "field_identifier", "METHOD", parent=("method_declaration",), field="name"),
        _value("type names", ("go",), "type_identifier", "TYPE", parent=("type_spec",), grandparent=("type_declaration",), field="name"),
    ],
    "java": [
        _drop("imports", ("java",), "import_declaration"),
        _drop("comments", ("java",), "line_comment block_comment"),
        _value("method names", ("java",), "identifier", "METHOD", parent=("method_declaration",), field="name"),
        _value("class names", ("java",), "identifier", "CLASS", parent=("class_declaration",), field="name"),
    ],
    "kotlin": [
        _drop("imports and package", ("kotlin",), "import_header package_header"),
        _drop("comments", ("kotlin",), "line_comment multiline_comment"),
        _value("function names", ("kotlin",), "simple_identifier", "FUNC", parent=("function_declaration",)),
        _value("class names", ("kotlin",), "type_identifier", "CLASS", parent=("class_declaration",)),
    ],
    "bash": [
        _drop("comments", ("bash",), "comment"),
        _value("function names", ("bash",), "word", "FUNC", parent=("function_definition",), field="name"),
        _value("variables", ("bash",), "variable_name", "<VAR>"),
    ],
    "css": [_drop("comments", ("css",), "comment"), _value("selectors", ("css",), "class_name id_name tag_name", "SEL")],
    "html": [_drop("comments", ("html",), "comment")],
    "sql": [_drop("comments", ("sql",), "comment marginalia"), _anon("identifiers", ("sql",), "identifier object_reference")],
    "yaml": [_drop("comments", ("yaml",), "comment")],
    "markdown": [],
    "astro": [_drop("comments", ("astro",), "comment")],
    "rust": [
        _drop("use declarations", ("rust",), "use_declaration"),
        _drop("extern crates", ("rust",), "extern_crate_declaration"),
        _drop("lifetimes", ("rust",), "lifetime", text=("not_eq", "'static")),
        _drop("line comments", ("rust",), "line_comment"),
        _drop("block comments", ("rust",), "block_comment"),
        _drop("attributes", ("rust",), "attribute_item inner_attribute_item"),
        _value("function names", ("rust",), "identifier", "FUNC", parent=("function_item",), field="name"),
        _value("type names", ("rust",), "type_identifier", "TYPE", parent=("struct_item", "enum_item", "trait_item", "type_item", "union_item"), field="name"),
    ],
}
#: What loose adds, and whether the default rules stand first or last there.
LOOSE: dict[str, tuple[str, list[Rule]]] = {
    "python": ("last", [
        _drop("string content", ("python",), "string_content"),
        _anon("identifiers", ("python",), "identifier"),
        _value("literals", ("python",), "string integer float true false none", "<LIT>"),
        _type("operators", ("python",), "binary_operator boolean_operator comparison_operator unary_operator", "<OP>"),
        _type("types", ("python",), "type", "<T>"),
        _type("collections", ("python",), "list dictionary tuple set", "<COLL>"),
    ]),
    "javascript": ("last", [
        _anon("identifiers", JS, "identifier property_identifier"),
        _value("literals", JS, "string number template_string", "<LIT>"),
        _type("collections", JS, "array object", "<COLL>"),
        _type("expressions", JS, "binary_expression unary_expression update_expression assignment_expression ternary_expression", "<EXP>"),
    ]),
    "go": ("first", [
        _value("strings", ("go",), "interpreted_string_literal raw_string_literal", "<STR>"),
        _value("numbers", ("go",), "int_literal float_literal imaginary_literal rune_literal", "<NUM>"),
        _anon("identifiers", ("go",), "identifier"),
        _anon("field identifiers", ("go",), "field_identifier", "FIELD"),
        _type("binary expressions", ("go",), "binary_expression", "<BINOP>"),
        _type("unary expressions", ("go",), "unary_expression", "<UNOP>"),
    ]),
    "java": ("first", [
        _anon("identifiers", ("java",), "identifier"),
        _value("literals", ("java",), "string_literal decimal_integer_literal decimal_floating_point_literal null_literal", "<LIT>"),
    ]),
    "kotlin": ("last", [
        _anon("identifiers", ("kotlin",), "simple_identifier interpolated_identifier"),
        _value("literals", ("kotlin",), "string_literal string_content integer_literal real_literal boolean_literal null_literal", "<LIT>"),
    ]),
    "bash": ("first", [
        _value("strings", ("bash",), "string raw_string string_content", "<STR>"),
        _value("numbers", ("bash",), "number", "<NUM>"),
        _type("commands", ("bash",), "command command_name", "<CMD>"),
        _type("expressions", ("bash",), "binary_expression unary_expression", "<EXP>"),
    ]),
    "css": ("first", [
        _value("literals", ("css",), "string_value integer_value float_value color_value plain_value", "<LIT>"),
        _type("properties", ("css",), "property_name", "<PROP>"),
        _type("features", ("css",), "feature_name", "<FEAT>"),
    ]),
    "html": ("first", [
        _type("tags", ("html",), "element tag_name", "<TAG>"),
        _value("attributes", ("html",), "attribute_name", "<ATTR>"),
        _value("attribute values", ("html",), "attribute_value", "<VAL>"),
        _drop("text", ("html",), "text"),
    ]),
    "sql": ("first", [_value("literals", ("sql",), "literal", "<LIT>"), _type("expressions", ("sql",), "binary_expression unary_expression", "<EXP>")]),
    "yaml": ("first", [
        _value("scalars", ("yaml",), "integer_scalar float_scalar boolean_scalar double_quote_scalar single_quote_scalar block_scalar", "<LIT>"),
        _value("anchors and aliases", ("yaml",), "anchor_name alias_name", "<REF>"),
    ]),
    "markdown": ("first", []),
    "astro": ("first", [_value("tags", ("astro",), "tag_name", "<TAG>"), _value("attributes", ("astro",), "attribute_name", "<ATTR>")]),
    "rust": ("last", [
        _drop("macro names", ("rust",), "identifier scoped_identifier", parent=("macro_invocation",)),
        _drop("string content", ("rust",), "string_content"),
        _anon("identifiers", ("rust",), "identifier", text=("not_eq", "static")),
        _value("strings", ("rust",), "string_literal raw_string_literal char_literal", "<STR>"),
        _value("numbers", ("rust",), "integer_literal float_literal", "<NUM>"),
        _value("booleans", ("rust",), "boolean_literal", "<BOOL>"),
        _type("binary expressions", ("rust",), "binary_expression", "<BINOP>"),
        _type("unary expressions", ("rust",), "unary_expression", "<UNOP>"),
    ]),
}
#: Fixed values: (label, kinds) of the regions of each language.
REGIONS: dict[str, list[tuple[str, str]]] = {
    "python": [("function_definition", "function_definition"), ("class_definition", "class_definition")],
    "javascript": [("function", "function_declaration function_expression arrow_function"), ("method_definition", "method_definition"), ("class_declaration", "class_declaration")],
    "go": [(k, k) for k in ("function_declaration", "method_declaration", "type_declaration")],
    "java": [(k, k) for k in ("method_declaration", "class_declaration")],
    "kotlin": [(k, k) for k in ("function_declaration", "class_declaration")],
    "bash": [(k, k) for k in ("function_definition", "if_statement", "while_statement")],
    "css": [(k, k) for k in ("rule_set", "media_statement", "keyframes_statement")],
    "sql": [(k, k) for k in ("create_table", "select", "insert", "delete")],
    "yaml": [(k, k) for k in ("block_mapping_pair", "block_sequence")],
    "rust": [(k, k) for k in ("function_item", "impl_item", "struct_item", "enum_item", "trait_item", "macro_definition")],
}
REGIONS["jsx"] = REGIONS["typescript"] = REGIONS["tsx"] = REGIONS["javascript"]


def region_rules() -> list[Rule]:
    """The 48 extraction rules."""
    out: list[Rule] = []

    def add(lang: str, label: str, match: Match, **kw) -> None:
        out.append(Rule(label, (lang,), match, Action.EXTRACT, {"region_type": label}, **kw))

    for lang in ALL:
        for label, kinds in REGIONS.get(lang, []):
            add(lang, label, Match(tuple(kinds.split())))
        if lang in ("jsx", "tsx"):
            add(lang, "jsx_expression", Match(("jsx_expression",), parent=("jsx_element",)))
        if lang == "html":
            for tag in ("head", "body"):
                add(lang, tag, Match(("element",), has=("start_tag", rf"^<{tag}[\s>]")))
        if lang == "markdown":
            add(lang, "heading", Match(("atx_heading", "setext_heading", "section")))
            add(lang, "code_block", Match(("fenced_code_block",)), inject="*", content="code_fence_content")
            add(lang, "code_block", Match(("indented_code_block",)))
        if lang == "astro":
            add(lang, "frontmatter", Match(("frontmatter",)), inject="typescript", content="frontmatter_js_block")
            add(lang, "template", Match(("element",), parent=("document",)))
    return out


def _family(lang: str) -> str:
    return "javascript" if lang in JS else lang


def _once(rules: Iterable[Rule]) -> list[Rule]:
    seen, out = set(), []
    for r in rules:
        key = (r.languages, r.match, r.action, tuple(sorted(r.params.items())), r.inject)
        if key not in seen:
            seen.add(key)
            out.append(r)
    return out


def ruleset(name: str) -> list[Rule]:
    """``none``, ``default`` or ``loose``; unknown names mean ``none``. Repeated rules of
    the JavaScript relatives appear once."""
    rules = region_rules()
    if name in ("default", "loose"):
        for lang in ALL:
            base = DEFAULTS[_family(lang)]
            if name == "default":
                rules += base
            else:
                place, more = LOOSE[_family(lang)]
                rules += [*base, *more] if place == "first" else [*more, *base]
    return _once(rules)


def build_rules(name: str, region_filters: Mapping[str, Iterable[str]] | None = None, additional: Mapping[str, Iterable[str]] | None = None, excluded: Mapping[str, Iterable[str]] | None = None) -> list[Rule]:
    """A ruleset with filters, then additional regions, then exclusions. Any exclusion
    leaves only the extraction rules that it does not name; the normalisation rules go."""
    rules = ruleset(name)
    if region_filters:
        rules = [r for r in rules if any(r.for_language(x) for x in region_filters) and (r.action is not Action.EXTRACT or any(r.for_language(x) and r.params["region_type"] in set(ts) for x, ts in region_filters.items()))]
    for lang, kinds in (additional or {}).items():
        rules += [Rule(k, (lang,), Match((k,)), Action.EXTRACT, {"region_type": k}) for k in sorted(kinds)]
    if excluded:
        rules = [r for r in rules if r.action is Action.EXTRACT and not any(r.for_language(x) and r.params["region_type"] in set(ts) for x, ts in excluded.items())]
    return rules


_SPEC = re.compile(r"^\s*([A-Za-z_+#-]+)\s*:\s*(.*?)\s*$")


def parse_region_specs(specs: Iterable[str]) -> dict[str, tuple[str, ...]]:
    """``lang:n1,n2`` specifications; languages are lowered, repeats merge."""
    out: dict[str, list[str]] = {}
    for s in specs:
        m = _SPEC.match(s)
        names = [n.strip() for n in m[2].split(",") if n.strip()] if m else []
        if not names:
            raise ValueError(f"expected LANGUAGE:TYPE[,TYPE...], not {s!r}")
        have = out.setdefault(m[1].lower(), [])
        have += [n for n in names if n not in have]
    return {k: tuple(v) for k, v in out.items()}


#: What a rule in a mapping may state; the rest is a mistake.
_REQUIRED, _OPTIONAL = ("name", "languages", "kinds", "action"), ("parent", "grandparent", "field", "text", "has", "params", "inject", "content")


def parse_rule(spec: Mapping) -> Rule:
    """A rule from a mapping: name, languages, kinds and action, and if wanted the node's
    parent and grandparent kinds, its field, ``text`` as [operator, argument], ``has`` as
    [kind, pattern], parameters, and the language and content kind of an injection."""
    missing = [k for k in _REQUIRED if k not in spec]
    if missing:
        raise ValueError(f"rule lacks {', '.join(missing)}")
    unknown = [k for k in spec if k not in (*_REQUIRED, *_OPTIONAL)]
    if unknown:
        raise ValueError(f"rule states unknown {', '.join(unknown)}")
    for k in ("text", "has"):
        if k in spec and len(spec[k]) != 2:
            raise ValueError(f"{k} takes two values")
    if "text" in spec and spec["text"][0] not in ("match", "eq", "not_eq"):
        raise ValueError(f"unknown text operator {spec['text'][0]!r}")
    pair = lambda k: tuple(spec[k]) if k in spec else None
    match = Match(tuple(spec["kinds"]), tuple(spec.get("parent", ())), tuple(spec.get("grandparent", ())), spec.get("field"), pair("text"), pair("has"))
    return Rule(spec["name"], tuple(spec["languages"]), match, Action(spec["action"]), dict(spec.get("params", {})), spec.get("inject"), spec.get("content"))


def load_rules(spec: Mapping, name: str | None = None) -> list[Rule]:
    """Rules from a mapping of rulesets, of all of them or of the one named; ``extends``
    puts another ruleset's rules before a ruleset's own."""

    def one(name: str, path: tuple[str, ...]) -> list[Rule]:
        if name in path:
            raise ValueError("rulesets extend in a circle: " + " > ".join((*path, name)))
        if name not in spec["rulesets"]:
            raise ValueError(f"unknown ruleset {name!r}")
        body = spec["rulesets"][name]
        rules = one(body["extends"], (*path, name)) if body.get("extends") else []
        return rules + [parse_rule(r) for r in body.get("rules", [])]

    return [r for n in ([name] if name else spec["rulesets"]) for r in one(n, ())]


def text_kinds(rules: Iterable[Rule]) -> frozenset[str]:
    """Kinds whose text the rules read even where they are inner nodes."""
    out: set[str] = set()
    for r in rules:
        if r.match.text or r.action is Action.ANONYMIZE or (r.inject and not r.content):
            out |= set(r.match.kinds)
        out |= {r.match.has[0]} if r.match.has else set()
        out |= {r.content} if r.content else set()
    return frozenset(out)


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.name, list(r.languages), r.action.value, list(r.match.kinds), list(r.match.parent), r.match.field, *(r.match.text or (None, None)), dict(r.params), r.inject) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, name string, languages array<string>, action string, kinds array<string>, parent array<string>, field string, text_op string, text_arg string, params map<string,string>, inject string")


_FUNCTIONS = ("function_declaration", "function_definition", "function_expression", "arrow_function", "method_definition")
_CLASSES = ("class_declaration", "class_definition")
_NAMES = {"identifier", "property_identifier", "type_identifier", "field_identifier"}


def anonymises_name(rules: list[Rule], language: str, region_type: str) -> bool:
    """Whether a rule replaces the name of such regions, so that names cannot tell them
    apart."""
    if region_type in ("function", "method") or region_type in _FUNCTIONS:
        holders = set(_FUNCTIONS)
    elif region_type == "class" or region_type in _CLASSES:
        holders = set(_CLASSES)
    else:
        return False
    return any(r.action is Action.REPLACE_VALUE and r.for_language(language) and _NAMES & set(r.match.kinds) and holders & set(r.match.parent) for r in rules)
