"""Syntax trees as rows: what every frontend builds and how it becomes ``nodes``."""

from __future__ import annotations

from bisect import bisect_right

NODE_SCHEMA = "tree_id long, seq int, parent_seq int, end_seq int, depth int, kind string, field string, n_children int, text string, start_line int, end_line int, start_byte int, end_byte int"
NODE_COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]


class Node:
    """A node over the characters ``start`` to ``end`` of its source."""

    __slots__ = ("kind", "start", "end", "kids", "field")

    def __init__(self, kind: str, start: int, end: int, kids: list[Node] | None = None, field: str | None = None):
        self.kind, self.start, self.end, self.kids, self.field = kind, start, end, kids or [], field


#: Kinds of inner nodes whose text the built-in rules, names or injections read.
TEXT_KINDS = frozenset("attribute call start_tag object_reference interpolated_identifier string info_string code_fence_content frontmatter_js_block lifetime".split())


def rows(root: Node, source: str, tree_id: int, line_offset: int = 0, texts: frozenset[str] | None = None) -> list[tuple]:
    """Pre-order rows of a tree, without recursion. With ``texts``, only leaves
    and these kinds carry their text, so that a source is not repeated at every level; what
    lies under another node can be cut out of the source by its bytes."""
    breaks = [i for i, c in enumerate(source) if c == "\n"]
    if source.isascii():
        pos = lambda i: i
    else:
        width = [0]
        for c in source:
            o = ord(c)
            width.append(width[-1] + (1 if o < 0x80 else 2 if o < 0x800 else 3 if o < 0x10000 else 4))
        pos = lambda i: width[min(i, len(source))]
    line = lambda i: bisect_right(breaks, i - 1) + 1 + line_offset
    out: list[list] = []
    stack: list[tuple[Node, int | None, int]] = [(root, None, 1)]
    while stack:
        node, parent, depth = stack.pop()
        seq = len(out)
        last = max(node.start, node.end - 1)
        out.append([tree_id, seq, parent, seq, depth, node.kind, node.field, len(node.kids), source[node.start : node.end] if texts is None or not node.kids or node.kind in texts else "", line(node.start), line(last), pos(node.start), pos(node.end)])
        stack += [(k, seq, depth + 1) for k in reversed(node.kids)]
    for r in reversed(out):
        if r[2] is not None:
            out[r[2]][3] = max(out[r[2]][3], r[3])
    return [tuple(r) for r in out]
