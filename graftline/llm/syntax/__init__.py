"""Recursive-descent parsers that accept or reject source files.

Statements descend recursively, expressions climb precedence, and after an error the
parser skips to the next statement (panic mode), so that all errors of a file are found.
"""

from __future__ import annotations

import codecs
import re
import sys
import threading
from collections.abc import Callable

from graftline.llm.syntax.base import Problem, SyntaxErrors

#: Bytes of stack for a deep source, of which only those used take memory, and frames that
#: one character can nest.
STACK, FRAMES = 1 << 29, 64
_CODING = re.compile(rb"^[ \t\f]*#.*?coding[:=][ \t]*([-\w.]+)")


def _parsers() -> dict[str, Callable]:
    from graftline.llm.syntax.css import parse_css
    from graftline.llm.syntax.golang import parse_go
    from graftline.llm.syntax.java import parse_java
    from graftline.llm.syntax.javascript import parse_javascript, parse_typescript
    from graftline.llm.syntax.python import parse_python
    from graftline.llm.syntax.rust import parse_rust

    return {"python": parse_python, "javascript": parse_javascript, "typescript": parse_typescript, "go": parse_go, "java": parse_java, "rust": parse_rust, "css": parse_css}


#: Suffixes, without regard to case, and the language each names.
SUFFIXES = {".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".go": "go", ".java": "java", ".rs": "rust", ".css": "css"}


def decoded(source: bytes, language: str) -> str:
    """The text of a source: by byte-order mark, by a declared encoding (Python), else
    UTF-8; other languages fall back to Latin-1 if no control byte stands in the text."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if source.startswith(mark):
            try:
                return source.decode("utf-8-sig" if name == "utf-8" else name)
            except UnicodeDecodeError as e:
                raise Problem(f"bytes that are not {name}", source[: e.start].count(b"\n") + 1) from None
    if b"\0" in source:
        raise Problem("null byte", source[: source.index(b"\0")].count(b"\n") + 1)
    name = "utf-8"
    if language == "python":
        for line in source.split(b"\n")[:2]:
            if m := _CODING.match(line):
                name = m[1].decode("ascii", "replace")
                break
            if line.strip() and not line.lstrip().startswith(b"#"):
                break
    try:
        return source.decode(name)
    except LookupError:
        raise Problem(f"unknown encoding {name}", 1) from None
    except UnicodeDecodeError as e:
        if language == "python" or re.search(rb"[\x00-\x08\x0e-\x1b\x7f]", source):
            raise Problem(f"bytes that are not {name}", source[: e.start].count(b"\n") + 1) from None
        return source.decode("latin-1")


def errors(source: bytes, language: str) -> list[tuple[int, str]]:
    """All syntax errors ``(line, cause)`` of a source, in order; none if it is valid."""
    try:
        return _errors(source, language)
    except RecursionError:
        return _deep(source, language)


def _deep(source: bytes, language: str) -> list[tuple[int, str]]:
    """``errors`` of a source nested beyond the recursion limit: once more in a thread with
    a large stack, under a limit that grows with the source, so that no depth exceeds it."""
    got: list = []

    def run() -> None:
        try:
            got.append(_errors(source, language))
        except BaseException as e:  # noqa: BLE001
            got.append(e)

    limit, stack = sys.getrecursionlimit(), threading.stack_size(STACK)
    try:
        sys.setrecursionlimit(max(limit, FRAMES * len(source) + limit))
        t = threading.Thread(target=run)
        t.start()
        t.join()
    finally:
        sys.setrecursionlimit(limit)
        threading.stack_size(stack)
    if isinstance(got[0], BaseException):
        raise got[0]
    return got[0]


def _errors(source: bytes, language: str) -> list[tuple[int, str]]:
    try:
        text = decoded(source, language)
        _parsers()[language](text)
    except SyntaxErrors as e:
        return e.found
    except Problem as e:
        return [(e.line, e.cause)]
    return []


def language_of(path: str | None) -> str | None:
    m = re.search(r"\.[^./]+$", path or "")
    return SUFFIXES.get(m[0].lower()) if m else None
