"""Rules, regions and shingles of one tree at a time, inside the task that parses it: the
results that ``rules``, ``regions``, ``shingles`` and ``inspect`` have over the node table,
for whole runs that need no node afterwards. Rules are those of the built-in rulesets, whose
patterns mean the same to Python and to Java (``re.ASCII``)."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import partial
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.functions.expressions import ARROW, VALUE_LENGTH, P
from graftline.operators.regions import EXPLICIT, FENCE_ALIASES, NAME_KINDS
from graftline.operators.rules import Action, Rule
from graftline.runtime import spread
from graftline.sources.files import decoded
from graftline.sources.languages import SUFFIXES
from graftline.sources.tree import TEXT_KINDS, rows

SEQ, UP, END, DEPTH, KIND, FIELD, KIDS, TEXT, LINE, LAST, BYTE, STOP = range(1, 13)
_ERRORS = (ValueError, SyntaxError, RecursionError)
_PLAIN = (False, None, None, None, False)
#: what Java's dot passes by
_INSIDE = re.compile("^[^(]*\\(([^\n\r\u0085\u2028\u2029]*)\\)$")
#: Fingerprints that a worker remembers.
_REMEMBERED = 200_000


def _children(t: list[tuple], i: int) -> Iterator[tuple]:
    c = i + 1
    while c <= t[i][END]:
        yield t[c]
        c = t[c][END] + 1


def _value(text: str) -> str:
    return text.replace(ARROW, "->").replace("\n", "\\n").replace("\t", "\\t")[:VALUE_LENGTH]


class Rules:
    """The rules of one language: those for all languages first, each in order."""

    def __init__(self, rules: list[Rule], language: str | None):
        own = [(n, r) for n, r in enumerate(r for r in rules if r.action is Action.EXTRACT) if r.for_language(language)]
        self.regions: dict[str, list[tuple[int, Rule]]] = {}
        for n, r in own:
            for k in r.match.kinds:
                self.regions.setdefault(k, []).append((n, r))
        self.acting: dict[str, list[Rule]] = {}
        norm = [r for r in rules if r.action is not Action.EXTRACT]
        for r in [r for r in norm if "*" in r.languages] + [r for r in norm if "*" not in r.languages and language in r.languages]:
            for k in r.match.kinds:
                self.acting.setdefault(k, []).append(r)
        #: kinds whose rules look at more than kinds and fields
        self.deep = {k for k, rs in self.acting.items() if any(r.match.text or r.match.has for r in rs)}
        self.numbers = any(r.action is Action.ANONYMIZE for rs in self.acting.values() for r in rs)
        self.known: dict[tuple, tuple] = {}

    @staticmethod
    def matches(r: Rule, t: list[tuple], x: tuple, up: str | None, top: str | None) -> bool:
        m = r.match
        if (m.parent and up not in m.parent) or (m.grandparent and top not in m.grandparent) or (m.field and x[FIELD] != m.field):
            return False
        if m.text:
            op, arg = m.text
            if not (re.search(arg, x[TEXT], re.ASCII) if op == "match" else x[TEXT] == arg if op == "eq" else x[TEXT] != arg):
                return False
        return not m.has or any(c[KIND] == m.has[0] and re.search(m.has[1], c[TEXT], re.ASCII) for c in _children(t, x[SEQ]))

    def act(self, t: list[tuple], x: tuple) -> tuple:
        """(removed, name, value, prefix, numbered) of a node, as ``compile_rules`` has it."""
        rs = self.acting.get(x[KIND])
        if rs is None:
            return _PLAIN
        p = t[x[UP]] if x[UP] is not None else None
        up, top = p and p[KIND], t[p[UP]][KIND] if p and p[UP] is not None else None
        key = (x[KIND], up, top, x[FIELD])
        got = None if x[KIND] in self.deep else self.known.get(key)
        if got is None:
            removed, name, value, anon, numbered = _PLAIN
            for r in rs:
                if self.matches(r, t, x, up, top):
                    if r.action is Action.REMOVE:
                        removed = True
                    elif r.action is Action.REPLACE_TYPE:
                        name = r.params.get("token", "<NODE>")
                    elif r.action is Action.REPLACE_VALUE:
                        value, numbered = r.params.get("value", "<LIT>"), False
                    elif r.action is Action.ANONYMIZE:
                        anon, numbered = r.params.get("prefix", "VAR"), True
            got = (removed, name, value, anon, numbered)
            if x[KIND] not in self.deep:
                self.known[key] = got
        return got


def _shown(x: tuple, act: tuple, number: int | None) -> tuple[str, str | None]:
    """Name and value of a node."""
    _, name, value, anon, numbered = act
    if numbered:
        value = f"{anon}_{number}"
    elif value is None and not x[KIDS]:
        value = _value(x[TEXT])
    return (x[KIND] if name is None else name), value


def _surviving(t: list[tuple], acts: list[tuple], start: int, end: int, numbers: bool) -> Iterator[tuple[tuple, int | None]]:
    """The nodes of a subtree that no rule removes, with the numbers of their names."""
    seen: dict[str, dict[str, int]] = {}
    i = start
    while i <= end:
        a = acts[i]
        if a[0]:
            i = t[i][END] + 1
            continue
        number = None
        if numbers and a[3] is not None:
            own = seen.setdefault(a[3], {})
            number = own.setdefault(t[i][TEXT], len(own) + 1)
        yield t[i], number
        i += 1


def _rep(x: tuple, act: tuple, number: int | None) -> str:
    name, value = _shown(x, act, number)
    return f"{name}({value})" if value else name


class Tree:
    """A parsed source under the rules of its language."""

    def __init__(self, source: str, language: str, rules: Rules, texts: frozenset[str], line_offset: int = 0):
        from graftline.sources.frontends import parse

        self.rules = rules
        self.nodes = rows(parse(source, language, True), source, 0, line_offset, texts)
        self.acts = [rules.act(self.nodes, x) for x in self.nodes]
        self._grams: dict[int, str] = {}
        self._reps: list[str] | None = None

    def grams(self, start: int, k: int) -> Iterator[tuple[tuple, str]]:
        """``(node, content)`` of a region's shingles. Where no names are numbered, a node
        has one content in every region that holds it."""
        t, acts, numbers = self.nodes, self.acts, self.rules.numbers
        least = t[start][DEPTH] + k - 1
        if not numbers and self._reps is None:
            self._reps = [_rep(x, a, None) for x, a in zip(t, acts)]
        reps, known = ({}, {}) if numbers else (self._reps, self._grams)
        for x, number in _surviving(t, acts, start, t[start][END], numbers):
            i = x[SEQ]
            if numbers:
                reps[i] = _rep(x, acts[i], number)
            if x[DEPTH] >= least:
                got = known.get(i)
                if got is None:
                    path, at = [], i
                    for _ in range(k):
                        path.append(reps[at])
                        at = t[at][UP]
                    got = known[i] = ARROW.join(reversed(path))
                yield x, got

    def regions(self, min_lines: int) -> list[tuple[tuple, int, Rule, str]]:
        """(node, number of the rule, rule, name), one for each pair of lines."""
        best: dict[tuple, tuple] = {}
        for x in self.nodes:
            rs = self.rules.regions.get(x[KIND])
            if rs is None or x[LAST] - x[LINE] + 1 < min_lines:
                continue
            p = self.nodes[x[UP]] if x[UP] is not None else None
            up, top = p and p[KIND], self.nodes[p[UP]][KIND] if p and p[UP] is not None else None
            for n, r in rs:
                if Rules.matches(r, self.nodes, x, up, top):
                    rank = (r.params.get("region_type", "unknown") not in EXPLICIT, x[BYTE], x[STOP], n, x[SEQ])
                    at = (x[LINE], x[LAST])
                    if at not in best or rank < best[at][0]:
                        best[at] = (rank, x, n, r)
        name = lambda x: next((c[TEXT] for c in _children(self.nodes, x[SEQ]) if c[KIND] in NAME_KINDS), "anonymous")
        return [(x, n, r, name(x)) for _, x, n, r in best.values()]


def _fence_language(info: str) -> str:
    word = re.sub(r"\s+", " ", info, flags=re.ASCII).strip(" ").split(" ")[0].lower()
    word = FENCE_ALIASES.get(word, word)
    return word if word in SUFFIXES else ""


def _injected(tree: Tree, x: tuple, r: Rule, of, texts: frozenset[str]) -> tuple[Tree, str] | None:
    """The tree of a region's content in another language, and that language."""
    kids = list(_children(tree.nodes, x[SEQ]))
    first = next((c for c in kids if c[KIND] in ("code_fence_content", "frontmatter_js_block")), None)
    info = next((c[TEXT] for c in kids if c[KIND] == "info_string"), "")
    language = _fence_language(info) if r.inject == "*" else r.inject
    source = x[TEXT] if not r.content else first[TEXT] if first else ""
    if not language or not re.sub(r"\s", " ", source, flags=re.ASCII).strip(" "):
        return None
    try:
        return Tree(decoded(source.encode()), language, of(language), texts, (first or x)[LINE] - 1), language
    except _ERRORS:
        return None


_FOUND = "file_id long, path string, language string, n_nodes int, root_seq int, end_seq int, region_type string, region_name string, start_line int, end_line int, start_byte int, end_byte int, rule_no int, inject string, injected boolean, shingle_language string, signature string, contents array<long>"
_FOUND_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
_ROWS = "file_id long, region_start int, region_end int, seq int, content string, start_line int, end_line int"


def _batch(got: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _FOUND_TYPES[t]) for c, t in zip(zip(*got), kinds)], names=list(names))


def _finder(batches: Iterator[pa.RecordBatch], rules: list[Rule], texts: frozenset[str], k: int, min_lines: int, contents: bool) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6000))
    by: dict = {}
    of = lambda language: by.get(language) or by.setdefault(language, Rules(rules, language))
    prints: dict[str, int] = {}

    def fingerprint(content: str) -> int:
        got = prints.get(content)
        if got is None:
            if len(prints) >= _REMEMBERED:
                prints.clear()
            got = prints[content] = int.from_bytes(md5(content.encode()).digest()[:8], "big", signed=True)
        return got

    for b in batches:
        out: list[tuple] = []
        for file_id, path, language, source in zip(*(c.to_pylist() for c in b.columns)):
            try:
                tree = Tree(decoded(source), language, of(language), texts)
            except _ERRORS:
                continue
            if not contents:
                out.append((file_id, path, language, len(tree.nodes), *[None] * 14))
            raw = (source or b"").split(b"\n")
            first_line = lambda x: raw[x[LINE] - 1].decode("latin-1").strip(" \t\n\x0b\f\r") if source is not None and x[LINE] <= len(raw) else None  # noqa: B023, E731
            for x, n, r, name in tree.regions(min_lines):
                other = _injected(tree, x, r, of, texts) if r.inject else None
                own, root = (other[0], 0) if other else (tree, x[SEQ])
                if contents:
                    out += [(file_id, x[LINE], x[LAST], g[SEQ], c, g[LINE], g[LAST]) for g, c in own.grams(root, k)]
                else:
                    out.append((file_id, path, language, None, root, own.nodes[root][END], r.params.get("region_type", "unknown"), name, x[LINE], x[LAST], x[BYTE], x[STOP], n, r.inject, other is not None, other[1] if other else language, None if other else first_line(x), [fingerprint(c) for _, c in own.grams(root, k)]))
            if len(out) > 2000:
                yield _batch(out, _ROWS if contents else _FOUND)
                out = []
        if out:
            yield _batch(out, _ROWS if contents else _FOUND)


def found(files: DataFrame, rules: list[Rule], texts: frozenset[str], k: int, min_lines: int, contents: bool = False) -> DataFrame:
    """The regions of files ``(file_id, path, language, source)`` of at least ``min_lines``,
    one for each pair of lines of a file, those of another language's content with its tree.

    ``contents`` are the fingerprints of their shingles in order, the first 64 bits of md5,
    which ``base_hash`` shares; ``signature`` is the stripped first line, as in
    ``verify.signature_lines``; a row without ``root_seq`` has a file's number of nodes. With
    ``contents``, a row for each shingle and its text instead."""
    f = files.select("file_id", "path", "language", F.col("source").cast("binary").alias("source"))
    run = partial(_finder, rules=rules, texts=TEXT_KINDS | texts, k=k, min_lines=min_lines, contents=contents)
    return spread(f).mapInArrow(run, _ROWS if contents else _FOUND)


def print_hash(fingerprint: Column) -> Column:
    """``base_hash`` of a content by its fingerprint: of the first 32 bits."""
    return F.shiftrightunsigned(fingerprint, 32) % P


def _lines(tree: Tree) -> dict[int, list[tuple[int, int, str]]]:
    """By line, what ``transformed_source`` shows of each node."""
    alive = list(_surviving(tree.nodes, tree.acts, 0, len(tree.nodes) - 1, tree.rules.numbers))
    holders = {x[UP] for x, _ in alive}
    out: dict[int, list[tuple[int, int, str]]] = {}
    for x, number in alive:
        if x[SEQ] in holders:
            continue
        act = tree.acts[x[SEQ]]
        name, value = _shown(x, act, number)
        if x[KIDS]:
            shown = f"<{name}>"
        else:
            m = _INSIDE.match(f"{name}({value})" if value else name)
            shown = m[1] if m and m[1] else name
        out.setdefault(x[LINE], []).append((x[BYTE], x[SEQ], shown))
    return out


def _viewer(batches: Iterator[pa.RecordBatch], rules: list[Rule], texts: frozenset[str]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6000))
    by: dict = {}
    indent = re.compile(r"\s*", re.ASCII)
    for b in batches:
        ids, lines, texts_ = [], [], []
        for file_id, language, source in zip(*(c.to_pylist() for c in b.columns)):
            if language not in by:
                by[language] = Rules(rules, language)
            try:
                tree = Tree(decoded(source), language, by[language], texts)
            except _ERRORS:
                continue
            whole = (source or b"").decode("utf-8", "replace")
            ls = (whole[1:] if whole.startswith("\ufeff") else whole).replace("\r\n", "\n").split("\n")
            for line, shown in _lines(tree).items():
                ids.append(file_id)
                lines.append(line)
                texts_.append((indent.match(ls[line - 1])[0] if line <= len(ls) else "") + " ".join(s for _, _, s in sorted(shown)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32()), pa.array(texts_, pa.string())], names=["tree_id", "line", "text"])


def transformed_files(files: DataFrame, rules: list[Rule], texts: frozenset[str]) -> DataFrame:
    """``inspect.transformed_source`` of files ``(file_id, language, source)``."""
    f = files.select("file_id", "language", F.col("source").cast("binary").alias("source"))
    return spread(f).mapInArrow(partial(_viewer, rules=rules, texts=TEXT_KINDS | texts), "tree_id long, line int, text string")
