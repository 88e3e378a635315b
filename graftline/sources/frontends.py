"""Frontends: source text to a syntax tree with conventional node kinds.

Python uses the standard library's grammar; HTML its parser; Markdown and YAML are read by
line structure; the bracket languages share one scanner that nests brackets, cuts
statements and names them by their heads.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize
from bisect import bisect_left
from html.parser import HTMLParser

from graftline.sources.tree import Node

# ---------------------------------------------------------------- Python
#: Grammar classes and the node kinds they are shown as.
_PY = {
    "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Return": "return_statement",
    "Delete": "delete_statement", "Assign": "assignment", "AugAssign": "augmented_assignment", "AnnAssign": "assignment", "For": "for_statement",
    "AsyncFor": "for_statement", "While": "while_statement", "If": "if_statement", "With": "with_statement", "AsyncWith": "with_statement", "Match": "match_statement",
    "Raise": "raise_statement", "Try": "try_statement", "TryStar": "try_statement", "Assert": "assert_statement", "Import": "import_statement",
    "ImportFrom": "import_from_statement", "Global": "global_statement", "Nonlocal": "nonlocal_statement", "Pass": "pass_statement", "Break": "break_statement",
    "Continue": "continue_statement", "BoolOp": "boolean_operator", "NamedExpr": "named_expression", "BinOp": "binary_operator", "UnaryOp": "unary_operator",
    "Lambda": "lambda", "IfExp": "conditional_expression", "Dict": "dictionary", "Set": "set", "ListComp": "list_comprehension", "SetComp": "set_comprehension",
    "DictComp": "dictionary_comprehension", "GeneratorExp": "generator_expression", "Await": "await", "Yield": "yield", "YieldFrom": "yield", "Compare": "comparison_operator",
    "Call": "call", "Attribute": "attribute", "Subscript": "subscript", "Starred": "list_splat", "List": "list", "Tuple": "tuple", "ExceptHandler": "except_clause",
}


def parse_python(source: str) -> Node:
    tree = ast.parse(source)
    starts = [0]
    for x in source.split("\n"):
        starts.append(starts[-1] + len(x) + 1)
    raw = source.split("\n")

    def at(line: int, col: int) -> int:
        text = raw[line - 1]
        return starts[line - 1] + (col if text.isascii() else len(text.encode()[:col].decode("utf-8", "ignore")))

    toks: list[Node] = []
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        if t.type in (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER) or not t.string:
            continue
        a, b = starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1]
        toks.append(_py_leaf(t, a, b))
    opens, closes, stack = [], {}, []
    for n in toks:
        if n.kind == "(":
            opens.append(n.start)
            stack.append(n.start)
        elif n.kind == ")" and stack:
            closes[stack.pop()] = n.end
    defs = [t.start for t in toks if t.kind == "def"]

    def paren(after: int, end: int, kind: str, kids: list[Node]) -> Node | None:
        k = bisect_left(opens, after)
        if k == len(opens) or opens[k] >= end or opens[k] not in closes:
            return None
        i, j = opens[k], closes[opens[k]]
        return Node(kind, i, j, [x for x in kids if i <= x.start and x.end <= j])

    def build(n: ast.AST) -> list[Node]:
        kids: list[Node] = []
        for name, value in ast.iter_fields(n):
            values = value if isinstance(value, list) else [value]
            subs = [k for v in values if isinstance(v, ast.AST) for k in build(v)]
            if name in ("body", "orelse", "finalbody") and isinstance(value, list) and subs and not isinstance(n, ast.Module):
                subs = [Node("block", subs[0].start, subs[-1].end, subs, "body" if name == "body" else "alternative")]
            kids += subs
        kids.sort(key=lambda k: (k.start, -k.end))
        if isinstance(n, ast.Expr):
            return kids if isinstance(n.value, ast.Constant) else [Node("expression_statement", at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset), kids)]
        kind = _PY.get(type(n).__name__)
        if kind is None or not hasattr(n, "lineno"):
            return kids
        a, b = at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset)
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            k = bisect_left(defs, a)
            head = defs[k] if k < len(defs) else a
            p = paren(head, b, "parameters", kids)
            kids = [k for k in kids if not (p and p.start <= k.start and k.end <= p.end)] + ([p] if p else [])
        if isinstance(n, ast.Call):
            p = paren(at(n.func.end_lineno, n.func.end_col_offset), b, "argument_list", kids)
            kids = [k for k in kids if not (p and p.start <= k.start and k.end <= p.end)] + ([p] if p else [])
        return [Node(kind, a, b, sorted(kids, key=lambda k: k.start))]

    root = Node("module", 0, len(source), [k for s in tree.body for k in build(s)])
    hang(root, toks)
    return root


def hang(root: Node, toks: list[Node]) -> None:
    """Put each token under the deepest node that holds it, in one sweep per node: both the
    tokens and a node's children are in order."""
    todo = [(root, toks)]
    while todo:
        cur, own = todo.pop()
        kids = sorted(cur.kids, key=lambda k: (k.start, -k.end))
        mine: list[Node] = []
        below: dict[int, list[Node]] = {}
        i = 0
        for t in own:
            while i < len(kids) and kids[i].end < t.end:
                i += 1
            k = i
            while k < len(kids) and kids[k].start <= t.start and (kids[k].end < t.end or (kids[k].start == t.start and kids[k].end == t.end and not kids[k].kids and kids[k].kind == t.kind)):
                k += 1
            if k < len(kids) and kids[k].start <= t.start and t.end <= kids[k].end and kids[k].kind not in ("string", "identifier"):
                below.setdefault(k, []).append(t)
            else:
                mine.append(t)
        if cur.kind in ("function_definition", "class_definition") and not any(k.field == "name" for k in kids):
            name = next((t for t in mine if t.kind == "identifier"), None)
            if name is not None:
                name.field = "name"
        cur.kids = sorted([*kids, *mine], key=lambda k: (k.start, -k.end)) if mine else kids
        todo += [(kids[k], v) for k, v in below.items()]


#: Tokens of a source that the grammar may not take, and words that begin a
#: statement and stand in no expression, so that they end one whose bracket is left open.
_PY_LEX = re.compile(
    r"(?P<STRING>[bBrRuUfFtT]{0,2}(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))|(?P<COMMENT>\#[^\n]*)"
    r"|(?P<NUMBER>\d[\w.]*)|(?P<NAME>[^\W\d]\w*)|(?P<NL>\n)|(?P<JOIN>\\\n)|(?P<OP>->|:=|\*\*|//|[-+*/%&|^<>=!]=|\S)", re.S)  # fmt: skip
_PY_STARTS = frozenset("def class import return while try with raise pass del assert break continue global nonlocal".split())
_PY_CLAUSES = frozenset("elif else except finally case".split())
_PY_HEADS = {"def": "function_definition", "class": "class_definition", "for": "for_statement", "while": "while_statement", "if": "if_statement", "with": "with_statement", "try": "try_statement", "match": "match_statement"}
_UNSOUND = (SyntaxError, ValueError, RecursionError, tokenize.TokenError)


def parse_python_tolerant(source: str) -> Node:
    """The tree of a source with errors. Statements that parse have the tree they have in
    a sound file; of others the header is read by its words and the suite is gone through
    in the same way, and what remains is an ``ERROR`` node over its tokens."""
    source = source.replace("\0", " ")
    try:
        return parse_python(source)
    except _UNSOUND:
        pass
    lines: list[list[Node]] = []
    words: list[list[str]] = []
    depth, fresh = 0, True
    for m in _PY_LEX.finditer(source):
        kind, s = m.lastgroup, m[0]
        if kind == "JOIN":
            continue
        if kind == "NL":
            fresh = fresh or not depth
            continue
        first = not source[source.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
        if depth and first and (s in _PY_STARTS or re.match(r"async\s+def\b", source[m.start() : m.start() + 20])):
            depth, fresh = 0, True
        if fresh:
            lines.append([])
            words.append([])
            fresh = False
        lines[-1].append(_py_leaf(tokenize.TokenInfo(getattr(tokenize, kind), s, (0, 0), (0, 0), ""), m.start(), m.end()))
        words[-1].append(s)
        depth = max(0, depth + (s in ("(", "[", "{")) - (s in (")", "]", "}")))

    def indent(i: int) -> int:
        a = lines[i][0].start
        return len(source[source.rfind("\n", 0, a) + 1 : a].expandtabs(8))

    def sound(i: int, j: int, tail: str = "") -> list[Node] | None:
        a = source.rfind("\n", 0, lines[i][0].start) + 1
        head = "if 1:\n" if indent(i) else ""
        try:
            root = parse_python(head + source[a : lines[j - 1][-1].end] + tail)
        except _UNSOUND:
            return None
        kids = root.kids
        if head:
            kids = next((k for k in root.kids[0].kids if k.kind == "block"), Node("block", 0, 0)).kids
            kids += [k for k in [*root.kids[0].kids[2:], *root.kids[1:]] if k.kind == "comment"]
        todo = list(kids)
        while todo:
            n = todo.pop()
            n.start, n.end = n.start + a - len(head), n.end + a - len(head)
            todo += n.kids
        return sorted(kids, key=lambda k: k.start)

    def suite(i: int, j: int) -> list[Node]:
        out: list[Node] = []
        while i < j:
            comment, last = lines[i][0].kind == "comment", i
            k = q = i + 1
            while q < j and not comment:
                if lines[q][0].kind != "comment":
                    if not (indent(q) > indent(i) or (indent(q) == indent(i) and (words[q][0] in _PY_CLAUSES or (words[i][0] == "@" and words[last][0] == "@")))):
                        break
                    k, last = q + 1, q
                q += 1
            out += [lines[i][0]] if comment else (sound(i, k) or broken(i, k))
            i = k
        return out

    def broken(i: int, j: int) -> list[Node]:
        parts = [i, *[k for k in range(i + 1, j) if indent(k) <= indent(i) and lines[k][0].kind != "comment"], j]
        out: list[Node] = []
        for a, b in zip(parts, parts[1:]):
            word = next((w for w in words[a] if w != "async"), "")
            body = suite(a + 1, b)
            node = None
            if got := sound(a, a + 1, " pass") if word in _PY_HEADS and words[a][-1] == ":" and word not in ("try", "match") else None:
                node = got[0]
                node.kids = [k for k in node.kids if k.kind != "block"]
            elif word in _PY_HEADS:
                at = words[a].index(word) + 1
                rest = lines[a][at:]
                if word in ("def", "class") and rest and rest[0].kind == "identifier":
                    rest[0].field = "name"
                    at += 1
                error = Node("ERROR", lines[a][at].start, lines[a][-1].end, lines[a][at:]) if lines[a][at:] else None
                node = Node(_PY_HEADS[word], lines[a][0].start, lines[a][-1].end, [*lines[a][:at], *([error] if error else [])])
            elif word in _PY_CLAUSES and out and b > a + 1:
                out[-1].kids += lines[a]
                node = out.pop()
            else:
                got = sound(a, a + 1)
                out += got or [Node("ERROR", lines[a][0].start, lines[a][-1].end, lines[a])]
                out += body
                continue
            if body:
                node.kids.append(Node("block", body[0].start, body[-1].end, body, "alternative" if word in _PY_CLAUSES else "body"))
            node.end = max(k.end for k in node.kids)
            out.append(node)
        return out

    return Node("module", 0, len(source), suite(0, len(lines)))


def _py_leaf(t: tokenize.TokenInfo, a: int, b: int) -> Node:
    s = t.string
    if t.type == tokenize.NAME:
        kind = {"True": "true", "False": "false", "None": "none"}.get(s) or (s if keyword.iskeyword(s) else "identifier")
    elif t.type == tokenize.NUMBER:
        kind = "float" if re.search(r"[.eEjJ]", s) and not s.lower().startswith("0x") else "integer"
    elif t.type == tokenize.STRING:
        m = re.match(r"[A-Za-z]*(\"\"\"|'''|\"|')", s)
        q = len(m[1])
        kids = [Node("string_start", a, a + m.end()), Node("string_content", a + m.end(), b - q), Node("string_end", b - q, b)]
        return Node("string", a, b, [k for k in kids if k.end > k.start])
    elif t.type == tokenize.COMMENT:
        kind = "comment"
    else:
        kind = "string_content" if tokenize.tok_name[t.type].endswith("_MIDDLE") else s
    return Node(kind, a, b)


# ---------------------------------------------------------------- bracket languages
_LEX = re.compile(
    r"(?P<ws>\s+)|(?P<line>//[^\n]*|\#![^\n\[]*)|(?P<hash>\#[^\n]*)|(?P<dash>--[^\n]*)|(?P<block>/\*.*?\*/)"
    r"|(?P<str>\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<num>\d[\w.]*)|(?P<life>'[A-Za-z_]\w*)"
    r"|(?P<id>[A-Za-z_$\x80-￿][\w$]*)|(?P<op>=>|->|::|&&|\|\||==|!=|<=|>=|\+\+|--|[-+*/%&|^]=|:=|.)", re.S)  # fmt: skip
#: Fixed values: (head word, node kind) by language; the first head word found names it.
_HEADS = {
    "javascript": "function function_declaration|class class_declaration|import import_statement|export export_statement|const lexical_declaration|let lexical_declaration|var variable_declaration|if if_statement|for for_statement|while while_statement|do do_statement|return return_statement|throw throw_statement|try try_statement|switch switch_statement|break break_statement|continue continue_statement|interface interface_declaration|type type_alias_declaration|enum enum_declaration",
    "java": "import import_declaration|package package_declaration|class class_declaration|interface interface_declaration|enum enum_declaration|if if_statement|for for_statement|while while_statement|do do_statement|return return_statement|throw throw_statement|try try_statement|switch switch_statement",
    "go": "import import_declaration|package package_clause|func function_declaration|type type_declaration|var var_declaration|const const_declaration|if if_statement|for for_statement|return return_statement|switch expression_switch_statement|go go_statement|defer defer_statement",
    "rust": "use use_declaration|fn function_item|impl impl_item|struct struct_item|enum enum_item|trait trait_item|union union_item|type type_item|mod mod_item|const const_item|static static_item|macro_rules macro_definition|let let_declaration|if if_expression|for for_expression|while while_expression|loop loop_expression|match match_expression|return return_expression",
    "kotlin": "import import_header|package package_header|fun function_declaration|class class_declaration|interface class_declaration|object object_declaration|val property_declaration|var property_declaration|if if_expression|for for_statement|while while_statement|return jump_expression",
    "css": "@media media_statement|@keyframes keyframes_statement|@import import_statement",
    "sql": "create create_table|select select|insert insert|delete delete|update update|with select",
}
_HEADS["typescript"] = _HEADS["tsx"] = _HEADS["jsx"] = _HEADS["javascript"]
_MODIFIERS = set("public private protected static final abstract async export default pub unsafe extern open data override suspend inline internal declare synchronized native".split())
_LEAF = {
    "javascript": ("identifier", "number", "string", "comment", "comment"), "java": ("identifier", "decimal_integer_literal", "string_literal", "line_comment", "block_comment"),
    "go": ("identifier", "int_literal", "interpreted_string_literal", "comment", "comment"), "rust": ("identifier", "integer_literal", "string_literal", "line_comment", "block_comment"),
    "kotlin": ("simple_identifier", "integer_literal", "string_literal", "line_comment", "multiline_comment"), "css": ("plain_value", "integer_value", "string_value", "comment", "comment"),
    "sql": ("identifier", "literal", "literal", "comment", "marginalia"), "bash": ("word", "number", "string", "comment", "comment"),
}
for _x in ("typescript", "tsx", "jsx"):
    _LEAF[_x] = _LEAF["javascript"]
_KEYWORDS = set("if else for while do return throw try catch finally switch case default break continue new in of range select where from into values and or not null true false var let const function func fn class struct enum trait impl interface type import package export this self super void int long double float boolean char string pub use mod match loop as fun val object when is then fi done elif esac".split())
_BLOCK_KIND = {"javascript": "statement_block", "java": "block", "go": "block", "rust": "block", "kotlin": "function_body", "css": "block", "sql": "block"}


def _leaves(source: str, lang: str) -> list[Node]:
    name, num, string, line, block = _LEAF[lang]
    out: list[Node] = []
    for m in _LEX.finditer(source):
        kind, s, a, b = m.lastgroup, m[0], m.start(), m.end()
        if kind == "ws":
            continue
        if kind == "hash" and lang in ("css", "rust", "javascript", "typescript", "tsx", "jsx"):
            out.append(Node("#", a, a + 1))
            out += [Node(n.kind, n.start + a + 1, n.end + a + 1, [Node(k.kind, k.start + a + 1, k.end + a + 1) for k in n.kids]) for n in _leaves(s[1:], lang)]
            continue
        if kind == "dash" and lang != "sql":
            out += [Node(c, a + i, a + i + 1) for i, c in enumerate(s[:2])]
            out += [Node(n.kind, n.start + a + 2, n.end + a + 2, n.kids) for n in _leaves(s[2:], lang)]
            continue
        if kind in ("line", "hash", "dash"):
            out.append(Node(line, a, b))
        elif kind == "block":
            out.append(Node(block, a, b))
        elif kind == "str":
            inner = [Node("string_content", a + 1, b - 1)] if lang in ("rust", "kotlin", "bash") and b - a > 2 else []
            out.append(Node("template_string" if s[0] == "`" and num == "number" else string, a, b, inner))
        elif kind == "num":
            out.append(Node({"int_literal": "float_literal", "integer_literal": "float_literal", "decimal_integer_literal": "decimal_floating_point_literal"}.get(num, num) if re.match(r"\d+\.\d", s) else num, a, b))
        elif kind == "life":
            out.append(Node("lifetime" if lang == "rust" else name, a, b))
        elif kind == "id":
            out.append(Node(s.lower() if lang == "sql" and s.lower() in _KEYWORDS else s if s in _KEYWORDS and lang != "css" else name, a, b))
        else:
            out.append(Node(s, a, b))
    return out


def _nest(leaves: list[Node], source: str, lang: str) -> list[Node]:
    """Brackets become nodes; those never closed end with the source."""
    top: list[Node] = []
    stack: list[tuple[list[Node], Node]] = []
    cur = top
    for n in leaves:
        if n.kind in ("(", "[", "{"):
            g = Node({"(": "argument_list", "[": "array", "{": "block"}[n.kind], n.start, n.end, [n])
            cur.append(g)
            stack.append((cur, g))
            cur = g.kids
        elif n.kind in (")", "]", "}") and stack and stack[-1][1].kids[0].kind == {")": "(", "]": "[", "}": "{"}[n.kind]:
            cur.append(n)
            cur, g = stack.pop()
            g.end = n.end
        else:
            cur.append(n)
            for _, g in stack:
                g.end = max(g.end, n.end)
    return top


def _shape(items: list[Node], source: str, lang: str, inside: str) -> list[Node]:
    """Cut a list of nodes into statements and name them."""
    out: list[Node] = []
    cur: list[Node] = []

    def flush() -> None:
        if cur:
            out.append(_statement(list(cur), source, lang, inside))
            cur.clear()

    for i, n in enumerate(items):
        if n.kind in ("comment", "line_comment", "block_comment", "multiline_comment", "marginalia") and not cur:
            out.append(n)
            continue
        if n.kind in ("{", "}") :
            flush()
            out.append(n)
            continue
        cur.append(n)
        nxt = items[i + 1] if i + 1 < len(items) else None
        word = source[nxt.start : nxt.end] if nxt is not None else ""
        gap = source[n.end : nxt.start] if nxt is not None else ""
        if n.kind == ";" or (n.kind == "block" and word not in ("else", "catch", "finally", "while", ")", ",", ".", ";", "=>")) or (lang in ("go", "kotlin") and "\n" in gap and n.kind not in (",", ".", "(", "=", "+", "&&", "||")):
            flush()
    flush()
    return out


def _statement(items: list[Node], source: str, lang: str, inside: str) -> Node:
    text = lambda n: source[n.start : n.end]
    heads = dict(x.split(" ") for x in _HEADS.get(lang, "").split("|") if x)
    words = [n for n in items if n.kind not in ("#", "array")]
    first = next((n for n in words if text(n) not in _MODIFIERS), words[0] if words else items[0])
    lead = (text(first).lower() if lang == "sql" else text(first)).split("!")[0]
    if lang == "css" and lead == "@" and len(words) > 1:
        lead = "@" + text(words[1])
    kind = heads.get(lead, "expression_statement")
    if text(items[0]) == "export" and lang in ("javascript", "typescript", "tsx", "jsx"):
        kind = "export_statement"
    call = next((i for i, n in enumerate(items) if n.kind == "argument_list"), None)
    blocks = [n for n in items if n.kind == "block"]
    if kind == "expression_statement" and blocks and call and inside == "class" and items[call - 1].kind in ("identifier", "simple_identifier"):
        kind = "method_definition" if lang in ("javascript", "typescript", "tsx", "jsx") else "method_declaration"
    if lang == "java" and inside == "class" and call and kind == "expression_statement":
        kind = "method_declaration"
    if lang == "java" and kind == "expression_statement":
        kind = next((heads[text(n)] for n in items if text(n) in ("class", "interface", "enum")), kind)
    if lang == "go" and kind == "function_declaration" and len(items) > 1 and items[1].kind == "argument_list":
        kind = "method_declaration"
    if lang == "css" and kind == "expression_statement":
        kind = "rule_set" if blocks else "declaration"
    if lang == "rust" and items[0].kind == "#" and len(items) > 1 and items[1].kind == "array":
        attr = Node("attribute_item", items[0].start, items[1].end, items[:2])
        rest = items[2:]
        return Node("source_item", items[0].start, items[-1].end, [attr, _statement(rest, source, lang, inside)]) if rest else attr
    _name(items, kind, source, lang)
    for n in items:
        if n.kind == "block":
            member = "class" if kind in ("class_declaration", "interface_declaration", "impl_item", "trait_item", "object_declaration") else "rules" if lang == "css" and kind == "media_statement" else ""
            n.kids = _shape(n.kids, source, lang, member)
            n.kind = ("class_body" if member == "class" else _BLOCK_KIND.get({"typescript": "javascript", "tsx": "javascript", "jsx": "javascript"}.get(lang, lang), "block"))
        elif n.kind in ("argument_list", "array"):
            n.kids = _expressions(n.kids, source, lang)
            if n.kind == "argument_list" and kind in ("function_declaration", "method_definition", "method_declaration", "function_item") and call is not None and n is items[call if kind != "method_declaration" or lang != "go" else min(call + 2, len(items) - 1)]:
                n.kind = "formal_parameters" if lang != "go" else "parameter_list"
    return Node(kind, items[0].start, items[-1].end, _expressions(items, source, lang))


def _name(items: list[Node], kind: str, source: str, lang: str) -> None:
    """Mark the declared name and give it the grammar's kind."""
    if not re.search(r"function|class|method|_item|type_decl|struct|enum|trait|interface", kind):
        return
    ids = [n for n in items if n.kind in ("identifier", "simple_identifier", "plain_value", "word")]
    call = next((i for i, n in enumerate(items) if n.kind == "argument_list"), len(items))
    before = [n for n in items[:call] if n in ids]
    pick = ids[0] if ids else None
    if kind in ("method_declaration", "method_definition") and lang != "go" and before:
        pick = before[-1]
    if pick is None:
        return
    pick.field = "name"
    if kind == "method_definition":
        pick.kind = "property_identifier"
    elif lang == "go" and kind == "method_declaration":
        pick.kind = "field_identifier"
    elif (lang in ("typescript", "tsx", "rust", "kotlin") and re.search(r"class|struct|enum|trait|union|type_item|interface", kind)) or (lang == "go" and kind == "type_declaration"):
        pick.kind = "type_identifier"


def _expressions(items: list[Node], source: str, lang: str) -> list[Node]:
    """Arrow functions, calls and binary expressions in a list of nodes."""
    out: list[Node] = []
    for n in items:
        if n.kind in ("block",):
            n.kids = _shape(n.kids, source, lang, "")
            n.kind = "object" if out and source[out[-1].start : out[-1].end] in ("=", "(", ",", ":", "return") and lang in ("javascript", "typescript", "tsx", "jsx") else "block"
        elif n.kind in ("argument_list", "array") and n.kids and n.kids[0].kind in ("(", "["):
            n.kids = n.kids if any(k.kind in ("call_expression", "binary_expression") for k in n.kids) else _expressions(n.kids, source, lang)
        if n.kind == "argument_list" and out and out[-1].kind in ("identifier", "simple_identifier", "member_expression", "property_identifier") and out[-1].field != "name":
            f = out.pop()
            out.append(Node("call_expression", f.start, n.end, [f, n]))
        elif out and len(out) >= 2 and source[out[-1].start : out[-1].end] == "=>" and n.kind in ("block", "statement_block", "object", "call_expression", "identifier"):
            arrow, params = out.pop(), out.pop()
            out.append(Node("arrow_function", params.start, n.end, [params, arrow, n]))
        else:
            out.append(n)
    ops = {"+", "-", "*", "/", "%", "<", ">", "==", "!=", "<=", ">=", "&&", "||"}
    i = 1
    while i < len(out) - 1:
        a, o, b = out[i - 1 : i + 2]
        if o.kind in ops and not o.kids and a.kind not in ops and b.kind not in ops and a.kind not in ("(", "[", "{", ",", ";") and b.kind not in (")", "]", "}", ",", ";") and lang not in ("css",):
            out[i - 1 : i + 2] = [Node("binary_expression", a.start, b.end, [a, o, b])]
        else:
            i += 1
    return out


def parse_brackets(source: str, lang: str) -> Node:
    kids = _shape(_nest(_leaves(source, lang), source, lang), source, lang, "rules" if lang == "css" else "")
    root = {"javascript": "program", "typescript": "program", "tsx": "program", "jsx": "program", "java": "program", "sql": "program", "css": "stylesheet"}.get(lang, "source_file")
    return Node(root, 0, len(source), kids)


# ---------------------------------------------------------------- shell
def parse_bash(source: str) -> Node:
    root = Node("program", 0, len(source))
    stack = [root]
    at = 0
    for line in source.splitlines(keepends=True):
        s = line.strip()
        a = at + len(line) - len(line.lstrip())
        b = a + len(s)
        at += len(line)
        if not s:
            continue
        kids = [Node("comment", a, b)] if s.startswith("#") else [Node(n.kind, n.start + a, n.end + a, n.kids) for n in _leaves(s, "bash")]
        for x, y in zip(kids, kids[1:]):
            if x.kind == "$" and y.kind == "word":
                y.kind = "variable_name"
        if m := re.match(r"(function\s+)?([\w-]+)\s*\(\)\s*\{", s):
            name = next((k for k in kids if source[k.start : k.end] == m[2]), None)
            if name:
                name.field = "name"
            kind = "function_definition"
        elif re.match(r"if\b", s):
            kind = "if_statement"
        elif re.match(r"(while|until)\b", s):
            kind = "while_statement"
        elif re.match(r"for\b", s):
            kind = "for_statement"
        else:
            kind = ""
        closes = bool(re.match(r"(fi|done|esac)\b|\}$", s))
        if kind:
            node = Node(kind, a, b, kids)
            stack[-1].kids.append(node)
            if not re.search(r"(;\s*(fi|done)|\})\s*$", s):
                stack.append(node)
        elif closes and len(stack) > 1:
            stack[-1].kids += kids
            for n in stack[1:]:
                n.end = max(n.end, b)
            stack.pop()
        else:
            node = kids[0] if s.startswith("#") else Node("command", a, b, kids)
            stack[-1].kids.append(node)
        for n in stack[1:]:
            n.end = max(n.end, b)
    return root


# ---------------------------------------------------------------- YAML
def parse_yaml(source: str) -> Node:
    root = Node("stream", 0, len(source))
    stack: list[tuple[int, Node]] = [(-1, root)]
    at = 0
    for line in source.splitlines(keepends=True):
        s = line.strip()
        indent = len(line) - len(line.lstrip(" "))
        a, b = at + indent, at + indent + len(s)
        at += len(line)
        if not s:
            continue
        if s.startswith("#"):
            stack[-1][1].kids.append(Node("comment", a, b))
            continue
        item = s.startswith("- ") or s == "-"
        while stack[-1][0] > indent or (stack[-1][0] == indent and not (item and stack[-1][1].kind == "block_sequence")):
            stack.pop()
        if item:
            if stack[-1][1].kind != "block_sequence" or stack[-1][0] != indent:
                seq = Node("block_sequence", a, b)
                stack[-1][1].kids.append(seq)
                stack.append((indent, seq))
            node = Node("block_sequence_item", a, b, [Node("-", a, a + 1), *_yaml_value(source, a + 1, b)])
            stack[-1][1].kids.append(node)
        else:
            m = re.match(r"([^:#]+|\"[^\"]*\"):(\s|$)", s)
            if m:
                node = Node("block_mapping_pair", a, b, [Node("plain_scalar", a, a + len(m[1]), field="key"), *_yaml_value(source, a + m.end(), b)])
                stack[-1][1].kids.append(node)
                stack.append((indent, node))
            else:
                stack[-1][1].kids += _yaml_value(source, a, b)
        for _, n in stack[1:]:
            n.end = max(n.end, b)
    return root


def _yaml_value(source: str, a: int, b: int) -> list[Node]:
    s = source[a:b].strip()
    if not s:
        return []
    a = source.index(s[0], a)
    if s[0] in "&*":
        return [Node("anchor_name" if s[0] == "&" else "alias_name", a, a + len(s))]
    kind = "double_quote_scalar" if s[0] == '"' else "single_quote_scalar" if s[0] == "'" else "block_scalar" if s[0] in "|>" else "integer_scalar" if re.fullmatch(r"[+-]?\d+", s) else "float_scalar" if re.fullmatch(r"[+-]?\d*\.\d+", s) else "boolean_scalar" if s.lower() in ("true", "false", "yes", "no") else "plain_scalar"
    return [Node(kind, a, a + len(s))]


# ---------------------------------------------------------------- HTML
_VOID = set("area base br col embed hr img input link meta source track wbr".split())


class _Html(HTMLParser):
    def __init__(self, source: str, root: str):
        super().__init__(convert_charrefs=False)
        self.src = source
        self.starts = [0]
        for x in source.split("\n"):
            self.starts.append(self.starts[-1] + len(x) + 1)
        self.root = Node(root, 0, len(source))
        self.stack: list[tuple[str, Node]] = [("", self.root)]

    def here(self) -> int:
        line, col = self.getpos()
        return self.starts[line - 1] + col

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li") and self.stack[-1][0] == tag:
            self.stack.pop()
        a = self.here()
        raw = self.get_starttag_text() or ""
        b = a + len(raw)
        kids = [Node("<", a, a + 1), Node("tag_name", a + 1, a + 1 + len(tag))]
        for m in re.finditer(r"([^\s=<>\"'/]+)(\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", raw[1 + len(tag) :]):
            o = a + 1 + len(tag)
            parts = [Node("attribute_name", o + m.start(1), o + m.end(1))]
            if m[3]:
                parts.append(Node("attribute_value", o + m.start(3), o + m.end(3)))
            kids.append(Node("attribute", o + m.start(), o + m.end(), parts))
        kids.append(Node(">", b - 1, b))
        el = Node("element", a, b, [Node("start_tag", a, b, kids)])
        self.stack[-1][1].kids.append(el)
        for _, n in self.stack[1:]:
            n.end = max(n.end, b)
        if tag not in _VOID and not raw.endswith("/>"):
            self.stack.append((tag, el))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack[1:]):
            return
        a = self.here()
        b = self.src.find(">", a) + 1 or len(self.src)
        while self.stack[-1][0] != tag:
            self.stack.pop()
        _, el = self.stack.pop()
        el.kids.append(Node("end_tag", a, b, [Node("tag_name", a + 2, a + 2 + len(tag))]))
        el.end = b
        for _, n in self.stack[1:]:
            n.end = max(n.end, b)

    def _leaf(self, kind: str, n: int) -> None:
        a = self.here()
        if kind != "text" or self.src[a : a + n].strip():
            self.stack[-1][1].kids.append(Node(kind, a, a + n))
            for _, x in self.stack[1:]:
                x.end = max(x.end, a + n)

    def handle_data(self, data: str) -> None:
        self._leaf("text", len(data))

    def handle_comment(self, data: str) -> None:
        self._leaf("comment", len(data) + 7)


def parse_html(source: str, root: str = "document") -> Node:
    p = _Html(source, root)
    p.feed(source)
    p.close()
    return p.root


def parse_astro(source: str) -> Node:
    m = re.match(r"\s*---[ \t]*\n(.*?)\n?---[ \t]*(\n|$)", source, re.S)
    if not m:
        return parse_html(source)
    root = parse_html(re.sub(r"[^\n]", " ", m[0]) + source[m.end() :])
    root.end = len(source)
    a = source.index("---")
    root.kids.insert(0, Node("frontmatter", a, m.end() - len(m[2]), [Node("frontmatter_js_block", m.start(1), m.end(1))]))
    return root


# ---------------------------------------------------------------- Markdown
def parse_markdown(source: str) -> Node:
    root = Node("document", 0, len(source))
    open_: list[tuple[int, Node]] = []
    para: Node | None = None
    fence: tuple[str, Node, int] | None = None
    code: Node | None = None
    at = 0

    def add(n: Node) -> None:
        (open_[-1][1] if open_ else root).kids.append(n)
        for _, s in open_:
            s.end = max(s.end, n.end)

    for line in source.splitlines(keepends=True):
        a, b = at, at + len(line.rstrip("\r\n"))
        at += len(line)
        s = line.strip()
        if fence:
            mark, node, body = fence
            node.end = b
            if s.startswith(mark):
                if a > body:
                    node.kids.append(Node("code_fence_content", body, a))
                for _, x in open_:
                    x.end = max(x.end, b)
                fence = None
            continue
        if m := re.match(r"\s{0,3}(```+|~~~+)\s*(.*)$", line.rstrip("\r\n")):
            para = code = None
            node = Node("fenced_code_block", a, b, [Node("info_string", a + m.start(2), a + m.end(2))] if m[2].strip() else [])
            add(node)
            fence = (m[1], node, at)
            continue
        if m := re.match(r"(#{1,6})\s+\S", s):
            para = code = None
            level = len(m[1])
            while open_ and open_[-1][0] >= level:
                open_.pop()
            sec = Node("section", a, b)
            add(sec)
            open_.append((level, sec))
            sec.kids.append(Node("atx_heading", a, b))
            continue
        if para and re.fullmatch(r"=+|-{2,}", s):
            para.kind, para.end, para = "setext_heading", b, None
            continue
        if not s:
            para = None
            continue
        if re.match(r"( {4}|\t)", line) and not para:
            if code and not source[code.end : a].strip():
                code.end = b
            else:
                code = Node("indented_code_block", a, b)
                add(code)
            continue
        code = None
        if para:
            para.end = b
        else:
            para = Node("paragraph", a, b)
            add(para)
        for _, x in open_:
            x.end = max(x.end, b)
    if fence:
        fence[1].kids.append(Node("code_fence_content", fence[2], len(source)))
        fence[1].end = len(source)
    return root


def parse(source: str, language: str, tolerant: bool = False) -> Node:
    """The tree of a source; unknown languages raise, and Python with syntax errors unless
    the parse is ``tolerant``."""
    if language == "python":
        try:
            return parse_python(source)
        except SyntaxError:
            if not tolerant:
                raise
            return parse_python_tolerant(source)
    if language == "html":
        return parse_html(source)
    if language == "astro":
        return parse_astro(source)
    if language == "markdown":
        return parse_markdown(source)
    if language == "yaml":
        return parse_yaml(source)
    if language == "bash":
        return parse_bash(source)
    if language in _HEADS:
        return parse_brackets(source, language)
    raise ValueError(f"no frontend for {language!r}")
