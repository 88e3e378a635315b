"""CSS: rules, at-rules, nested rules, selectors and declarations."""

from __future__ import annotations

import re

from graftline.llm.syntax.base import Cursor, Problem, Token, conflict_marker, scan

_NAME = r"-?(?:[A-Za-z_]|[^\x00-\x7f]|\\(?:[0-9a-fA-F]{1,6}\s?|[^\n0-9a-fA-F]))(?:[\w-]|[^\x00-\x7f]|\\(?:[0-9a-fA-F]{1,6}\s?|[^\n0-9a-fA-F]))*"
_TOKEN = re.compile(
    r"(?P<com>/\*.*?\*/|<!--|-->)|(?P<err_comment_without_end>/\*)|(?P<ws>[ \t\r\n\f]+)"
    r"|(?P<str>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<err_string_without_end>[\"'])"
    r"|(?P<url>url\(\s*(?![\"'])(?:\\.|[^\s\"'()\\])*\s*\))"
    r"|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:%|" + _NAME + r")?)"
    r"|(?P<hash>\#(?:[\w-]|[^\x00-\x7f]|\\.)+)|(?P<atw>@(?:--)?" + _NAME + r")"
    r"|(?P<id>--(?:[\w-]|[^\x00-\x7f]|\\.)*|" + _NAME + r")|(?P<op>::|[~|^$*]?=|\|\||[{}()\[\]:;,.>+~*!/&|<=%?-])", re.S)  # fmt: skip


class _Css(Cursor):
    def sheet(self) -> None:
        self.recovering(self.rule)

    def panic(self, at: int) -> None:
        while self.cur.kind != "eof":
            t = self.step()
            if t.text == "{" and t.kind == "op" and t.mate is not None:
                self.i = t.mate + 1
                return
            if t.text in (";", "}") and t.kind == "op":
                return

    def rule(self) -> None:
        if self.cur.kind == "atw":
            self.at_rule()
        elif self.accept(";"):
            pass
        else:
            self.selectors()
            self.block()

    def at_rule(self) -> None:
        name = self.step().text.lower()
        while not self.at("{", ";", "}") and self.cur.kind != "eof":
            self.component()
        if self.at("{"):
            if name.lstrip("@").endswith("keyframes"):
                self.step()
                while not self.at("}"):
                    self.commas_until_block()
                    self.block()
                self.step()
            elif name in ("@media", "@supports", "@layer", "@container", "@scope", "@document", "@starting-style", "@-moz-document"):
                self.block(rules=True)
            else:
                self.block()
        elif name in ("@media", "@supports", "@font-face", "@keyframes", "@page"):
            raise self.fail("expected '{'")
        elif self.cur.kind != "eof" and not self.at("}"):
            self.expect(";")
        elif self.cur.kind == "eof" and name not in ("@import", "@charset", "@namespace", "@layer"):
            raise self.fail("expected ';'")

    def commas_until_block(self) -> None:
        while True:
            t = self.cur
            if t.kind == "num" or (t.kind == "id" and t.text.lower() in ("from", "to", "cover", "contain", "entry", "exit")):
                self.step()
                if self.cur.kind == "num":
                    self.step()
            else:
                raise self.fail("expected a keyframe")
            if not self.accept(","):
                return

    def selectors(self) -> None:
        self.selector()
        while self.accept(","):
            self.selector()
        if not self.at("{"):
            raise self.fail("expected '{' or a selector")

    def selector(self) -> None:
        self.accept(">", "+", "~", "||")
        n = 0
        while True:
            if self.compound():
                n += 1
            elif self.at(">", "+", "~", "||") and n:
                self.step()
                if not self.compound():
                    raise self.fail("expected a selector")
            else:
                break
        if not n:
            raise self.fail("expected a selector")

    def compound(self) -> bool:
        t = self.cur
        if t.kind == "id" or self.at("*", "&"):
            self.step()
            if self.at("|"):
                self.step()
                if not (self.cur.kind == "id" or self.at("*")):
                    raise self.fail("expected a name")
                self.step()
        elif t.kind == "hash":
            self.step()
        elif self.at("."):
            self.step()
            if self.cur.kind != "id" or self.cur.at != t.end:
                raise self.fail("expected a class name")
            self.step()
        elif self.at("["):
            self.bracket()
        elif self.at(":", "::"):
            self.step()
            self.ident()
            if self.at("("):
                self.bracket()
        else:
            return False
        return True

    def bracket(self) -> None:
        t = self.step()
        close = {"(": ")", "[": "]", "{": "}"}[t.text]
        while not self.at(close):
            if self.cur.kind == "eof":
                raise self.fail(f"expected {close!r}")
            self.component()
        self.step()

    def component(self) -> None:
        if self.at("(", "[", "{"):
            self.bracket()
        elif self.at(")", "]", "}"):
            raise self.fail("bracket that was not opened")
        elif self.cur.kind == "eof":
            raise self.fail("expected a value")
        else:
            self.step()

    def block(self, rules: bool = False) -> None:
        self.expect("{")
        while not self.at("}"):
            if self.cur.kind == "eof":
                raise self.fail("expected '}'")
            if self.accept(";"):
                continue
            if self.cur.kind == "atw":
                self.at_rule()
            elif not rules and self.declaration():
                pass
            else:
                self.selectors()
                self.block()
        self.step()

    def declaration(self) -> bool:
        """A declaration, or False with the position restored if it reads as a rule."""
        if self.at("*") and self.ahead().kind == "id" and self.ahead(2).text == ":":
            self.step()
        if self.cur.kind != "id" or self.ahead().text != ":":
            if self.cur.kind == "id" and self.ahead().text not in ("{", ",", ".", ">", "+", "~", "::", "[", "*", "&") and self.ahead().kind not in ("id", "hash"):
                raise self.fail("expected a declaration")
            return False
        at, name = self.i, self.step().text
        self.step()
        custom = name.startswith("--")
        n = 0
        while not self.at(";", "}") and self.cur.kind != "eof":
            if self.at("{") and not custom:
                self.i = at
                return False
            if self.at(":", "::") and not custom and not name.lower().endswith("filter"):
                self.i = at
                return False
            self.component()
            n += 1
        if not n and not custom:
            raise self.fail("expected a value")
        if self.cur.kind == "eof":
            raise self.fail("expected '}'")
        self.accept(";")
        return True


def parse_css(text: str) -> None:
    if line := conflict_marker(text):
        raise Problem("leftover merge-conflict marker", line)
    toks: list[Token] = scan(text, _TOKEN, frozenset())
    p = _Css(toks, text.count("\n") + 1)
    p.sheet()
    p.finish()
