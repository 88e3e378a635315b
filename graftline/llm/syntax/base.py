"""Tokens, the token cursor and panic-mode recovery shared by all parsers."""

from __future__ import annotations

import re

CLOSE = {"(": ")", "[": "]", "{": "}"}
_WORDED = frozenset(("op", "kw", "id"))


class Problem(Exception):
    """One syntax error."""

    def __init__(self, cause: str, line: int):
        super().__init__(f"line {line}: {cause}")
        self.cause, self.line = cause, line


class SyntaxErrors(Exception):
    """All errors of one file."""

    def __init__(self, found: list[tuple[int, str]]):
        super().__init__(str(found[0]))
        self.found = found


class Token:
    __slots__ = ("kind", "text", "line", "nl", "at", "mate", "end")

    def __init__(self, kind: str, text: str, line: int, nl: bool, at: int):
        self.kind, self.text, self.line, self.nl, self.at = kind, text, line, nl, at
        self.end = at + len(text)
        self.mate: int | None = None

    def __repr__(self) -> str:
        return f"{self.kind}:{self.text!r}@{self.line}"


def pair_brackets(tokens: list[Token]) -> None:
    """Give every bracket token the index of its partner, where it has one."""
    open_: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind == "op" and t.text in CLOSE:
            open_.append(i)
        elif t.kind == "op" and t.text in (")", "]", "}"):
            if open_ and CLOSE[tokens[open_[-1]].text] == t.text:
                j = open_.pop()
                t.mate, tokens[j].mate = j, i


def conflict_marker(text: str) -> int | None:
    """Line of a leftover merge-conflict marker at a line's start, if any."""
    m = re.search(r"(?m)^(<{7} |>{7} |={7}\r?$|\|{7} )", text)
    return text.count("\n", 0, m.start()) + 1 if m else None


class Cursor:
    """A position in the tokens; every parser derives from it."""

    def __init__(self, tokens: list[Token], last_line: int):
        self.toks, self._n = tokens, len(tokens)
        self.eof = Token("eof", "", last_line, True, 1 << 60)
        self.found: list[tuple[int, str]] = []
        pair_brackets(tokens)
        self.i = 0

    @property
    def i(self) -> int:
        return self._i

    @i.setter
    def i(self, at: int) -> None:
        #: the current token is read far more often than the position moves
        self._i = at
        self.cur = self.toks[at] if at < self._n else self.eof

    def ahead(self, n: int = 1) -> Token:
        at = self._i + n
        return self.toks[at] if at < self._n else self.eof

    def step(self) -> Token:
        t = self.cur
        self._i = at = self._i + 1
        self.cur = self.toks[at] if at < self._n else self.eof
        return t

    def at(self, *texts: str) -> bool:
        t = self.cur
        return t.text in texts and t.kind in _WORDED

    def accept(self, *texts: str) -> Token | None:
        t = self.cur
        return self.step() if t.text in texts and t.kind in _WORDED else None

    def expect(self, *texts: str) -> Token:
        t = self.cur
        if t.text in texts and t.kind in _WORDED:
            return self.step()
        raise self.fail("expected " + " or ".join(map(repr, texts)))

    def fail(self, what: str) -> Problem:
        t = self.cur
        seen = "the end of the file" if t.kind == "eof" else repr(t.text[:30])
        return Problem(f"{what}, found {seen}", t.line)

    def ident(self) -> Token:
        if self.cur.kind == "id":
            return self.step()
        raise self.fail("expected a name")

    def trying(self, f, *args):
        """Speculate: the result of ``f``, or None with the position restored."""
        at = self.i
        try:
            return f(*args)
        except Problem:
            self.i = at
            return None

    def commas(self, close: str, item, trailing: bool = True) -> None:
        """Items between commas up to ``close``, which is consumed."""
        while not self.at(close):
            item()
            if not self.accept(","):
                break
            if not trailing and self.at(close):
                raise self.fail("expected an item")
        self.expect(close)

    def recovering(self, statement, stops: tuple[str, ...] = ()) -> None:
        """Statements until a stop token; errors are recorded and skipped over."""
        while self.cur.kind != "eof" and not (stops and self.at(*stops)):
            at = self.i
            try:
                statement()
            except Problem as e:
                self.found.append((e.line, e.cause))
                self.i = max(self.i, at)
                self.panic(at)

    def panic(self, at: int) -> None:
        """Skip to behind the next ';', or to a line's first token, over whole brackets."""
        if self.i == at:
            self.i += 1
        while self.cur.kind != "eof":
            t = self.cur
            if t.text == ";" and t.kind == "op":
                self.i += 1
                return
            if t.nl and self.i > at:
                return
            self.i = t.mate + 1 if t.mate is not None and t.mate > self.i else self.i + 1

    def finish(self) -> None:
        if self.found:
            raise SyntaxErrors(self.found)


def scan(text: str, pattern: re.Pattern, keywords: frozenset, bad: str = "character that starts no token") -> list[Token]:
    """Tokens by a pattern with groups: nl, ws, com (skipped), id, num, str, op. A group
    named ``err_*`` is an error whose cause is the rest of its name."""
    out: list[Token] = []
    line, nl, i, n = 1, True, 0, len(text)
    while i < n:
        m = pattern.match(text, i)
        if not m:
            raise Problem(f"{bad}: {text[i]!r}", line)
        kind, s = m.lastgroup, m[0]
        if kind.startswith("err_"):
            raise Problem(kind[4:].replace("_", " "), line)
        if kind in ("ws", "com", "nl"):
            if "\n" in s or kind == "nl":
                nl = True
        else:
            if kind == "id" and s in keywords:
                kind = "kw"
            out.append(Token(kind, s, line, nl, i))
            nl = False
        line += s.count("\n")
        i = m.end()
    return out
