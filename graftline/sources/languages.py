"""Languages by file suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of each supported language.
SUFFIXES: dict[str, tuple[str, ...]] = {
    "astro": (".astro",), "bash": (".sh", ".bash"), "css": (".css",), "go": (".go",), "html": (".html", ".htm"),
    "java": (".java",), "javascript": (".js",), "jsx": (".jsx",), "kotlin": (".kt", ".kts"), "markdown": (".md", ".markdown"),
    "python": (".py",), "rust": (".rs",), "sql": (".sql",), "tsx": (".tsx",), "typescript": (".ts",), "yaml": (".yaml", ".yml"),
}
BY_SUFFIX = {s: lang for lang, suffixes in SUFFIXES.items() for s in suffixes}
#: Languages read with another language's grammar.
GRAMMARS = {"jsx": "javascript"}


def suffix(path: str = "path") -> Column:
    return F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1)


def detect_language(path: str = "path") -> Column:
    """The language of a path's suffix without regard to case, or null."""
    table = F.create_map(*[F.lit(x) for pair in BY_SUFFIX.items() for x in pair])
    return F.try_element_at(table, F.lower(suffix(path)))


def grammar(language: str | Column = "language") -> Column:
    c = F.col(language) if isinstance(language, str) else language
    out = c
    for alias, target in GRAMMARS.items():
        out = F.when(c == alias, target).otherwise(out)
    return out


def in_directory_scan(path: str = "path") -> Column:
    """Directory scans compare suffixes with regard to case."""
    return suffix(path).isin(*BY_SUFFIX)


def glob_filter() -> str:
    """Brace glob that prunes a directory listing to known suffixes."""
    return "*{" + ",".join(sorted(BY_SUFFIX)) + "}"
