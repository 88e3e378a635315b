"""Go."""

from __future__ import annotations

import re

from graftline.llm.syntax.base import Cursor, Problem, Token, conflict_marker, scan

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_TOKEN = re.compile(
    r"(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<com>//[^\n]*|/\*.*?\*/)|(?P<err_comment_without_end>/\*)"
    r"|(?P<num>0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)"
    r"|(?P<str>\"(?:\\[^\n]|[^\"\\\n])*\"|`[^`]*`|'(?:\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)|[^'\\\n])')|(?P<err_string_without_end>[\"'`])"
    r"|(?P<id>[^\W\d]\w*)|(?P<op>\.\.\.|&\^=|<<=|>>=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|&\^|<<|>>|[-+*/%&|^]=|[-+*/%&|^<>=!~(){}\[\],;.:])", re.S)  # fmt: skip
_ENDERS = frozenset("break continue fallthrough return".split())


def tokenize(text: str) -> list[Token]:
    """Tokens with the semicolons that line ends insert."""
    raw = scan(text, _TOKEN, KEYWORDS)
    out: list[Token] = []
    for t in raw:
        if out and t.nl and _ends(out[-1]):
            out.append(Token("op", ";", out[-1].line, False, out[-1].end))
        if out and t.kind in ("id", "kw") and out[-1].kind == "num" and out[-1].end == t.at:
            raise Problem("number that runs into a name", t.line)
        out.append(t)
    if out and _ends(out[-1]):
        out.append(Token("op", ";", out[-1].line, False, out[-1].end))
    return out


def _ends(t: Token) -> bool:
    return t.kind in ("id", "num", "str") or (t.kind == "kw" and t.text in _ENDERS) or (t.kind == "op" and t.text in ("++", "--", ")", "]", "}"))


_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = ("=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^=")


class _Go(Cursor):
    #: below 0 in the head of if, for and switch, where a brace opens the block
    level = 0

    def semi(self) -> None:
        if self.at(")", "}"):
            return
        self.expect(";")

    def file(self) -> None:
        try:
            self.expect("package")
            self.ident()
            self.semi()
            while self.at("import"):
                self.step()
                self.group(self.import_spec)
                self.semi()
        except Problem as e:
            self.found.append((e.line, e.cause))
            self.panic(self.i)
        self.recovering(self.top)

    def panic(self, at: int) -> None:
        self.level = 0
        if self.i == at:
            self.i += 1
        while self.cur.kind != "eof" and not (self.at("func", "type", "var", "const") and self.cur.nl):
            self.i = self.cur.mate + 1 if self.cur.mate is not None and self.cur.mate > self.i else self.i + 1

    def group(self, spec) -> None:
        if self.accept("("):
            while not self.at(")"):
                spec()
                if not self.at(")"):
                    self.expect(";")
            self.step()
        else:
            spec()

    def import_spec(self) -> None:
        if self.cur.kind == "id":
            self.step()
        else:
            self.accept(".")
        if self.cur.kind != "str":
            raise self.fail("expected an import path")
        self.step()

    def top(self) -> None:
        if self.at("func"):
            self.step()
            if self.at("("):
                self.parameters()
            self.ident()
            if self.at("["):
                self.type_params()
            self.signature()
            if self.at("{"):
                self.block()
        elif self.at("type", "var", "const"):
            self.declaration()
        else:
            raise self.fail("expected a declaration")
        self.semi() if self.cur.kind != "eof" else None

    def declaration(self) -> None:
        w = self.step().text
        self.group({"type": self.type_spec, "var": self.var_spec, "const": self.const_spec}[w])

    def type_spec(self) -> None:
        self.ident()
        if self.at("[") and self.ahead().kind == "id" and self.ahead().text and self.ahead(2).text != "]":
            self.trying(self.type_params)
        self.accept("=")
        self.type()

    def var_spec(self) -> None:
        self.names()
        if not self.at("="):
            self.type()
        if self.accept("="):
            self.exprs()

    def const_spec(self) -> None:
        self.names()
        if not self.at("=", ";", ")"):
            self.type()
        if self.accept("="):
            self.exprs()

    def names(self) -> None:
        self.ident()
        while self.accept(","):
            self.ident()

    def type_params(self) -> bool:
        self.expect("[")

        def item() -> None:
            self.names()
            self.constraint()

        self.commas("]", item)
        return True

    def constraint(self) -> None:
        while True:
            self.accept("~")
            self.type()
            if not self.accept("|"):
                return

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif not self.at("{", ";", ")", ",", "}", "]", "=", ":=", ":", ".", "|") and self.cur.kind not in ("eof", "str"):
            self.type()

    def parameters(self) -> None:
        self.expect("(")

        def item() -> None:
            if self.accept("..."):
                self.type()
                return
            self.type()
            if not self.at(",", ")"):
                self.accept("...")
                self.type()

        self.commas(")", item)

    def type(self) -> None:
        t = self.cur
        if t.kind == "id":
            self.step()
            if self.accept("."):
                self.ident()
            if self.at("[") and self.ahead().text != "]" and self.cur.at == self.toks[self.i - 1].end:
                self.step()
                self.commas("]", self.type)
        elif self.accept("*"):
            self.type()
        elif self.accept("("):
            self.type()
            self.expect(")")
        elif self.accept("["):
            if not self.accept("]"):
                if not self.accept("..."):
                    self.expr()
                self.expect("]")
            self.type()
        elif self.accept("map"):
            self.expect("[")
            self.type()
            self.expect("]")
            self.type()
        elif self.accept("chan"):
            self.accept("<-")
            self.type()
        elif self.at("<-") and self.ahead().text == "chan":
            self.i += 2
            self.type()
        elif self.accept("func"):
            self.signature()
        elif self.accept("struct"):
            self.expect("{")
            while not self.at("}"):
                self.field()
                self.semi()
            self.step()
        elif self.accept("interface"):
            self.expect("{")
            while not self.at("}"):
                if self.cur.kind == "id" and self.ahead().text == "(":
                    self.step()
                    self.signature()
                else:
                    self.constraint()
                self.semi()
            self.step()
        else:
            raise self.fail("expected a type")

    def field(self) -> None:
        if self.at("*") or (self.cur.kind == "id" and (self.ahead().text in (";", "}", ".") or self.ahead().kind == "str")):
            self.type()
        else:
            self.names()
            self.type()
        if self.cur.kind == "str":
            self.step()

    def block(self) -> None:
        self.expect("{")
        level, self.level = self.level, 0
        self.statements("}")
        self.level = level
        self.step()

    def statements(self, *stops: str) -> None:
        while not self.at(*stops):
            if self.cur.kind == "eof":
                raise self.fail("expected '}'")
            self.statement()
            if not self.at(*stops):
                self.semi()

    def statement(self) -> None:
        t = self.cur
        if t.kind == "op":
            if t.text == ";":
                return
            if t.text == "{":
                self.block()
                return
        if t.kind == "kw":
            f = getattr(self, "s_" + t.text, None)
            if f:
                f()
                return
            if t.text in ("var", "const", "type"):
                self.declaration()
                return
        if t.kind == "id" and self.ahead().text == ":" and self.ahead().kind == "op":
            self.i += 2
            if not self.at("}"):
                self.statement()
            return
        self.simple()

    def simple(self, ranges: bool = False) -> bool:
        """A simple statement; true if it was the head of a range loop."""
        n, plain, call = 0, True, False
        while True:
            kind = self.expr()
            plain = plain and kind in ("id", "member")
            call = kind in ("call", "recv")
            n += 1
            if not self.accept(","):
                break
        if self.at("++", "--") and n == 1:
            if not plain:
                raise self.fail("step of something that is no target")
            self.step()
        elif self.at("<-") and n == 1:
            self.step()
            self.expr()
        elif self.at(*_ASSIGN):
            if not plain:
                raise self.fail("assignment to something that is no target")
            op = self.step().text
            if ranges and op in ("=", ":=") and self.accept("range"):
                self.expr()
                return True
            self.exprs()
        elif n > 1:
            raise self.fail("expected an assignment")
        elif not call and not self.level < 0:
            raise self.fail("expression that is no statement")
        return False

    def exprs(self) -> None:
        self.expr()
        while self.accept(","):
            self.expr()

    def head(self) -> None:
        """What stands between if or switch and its block."""
        level, self.level = self.level, -1
        if not self.at("{"):
            if not self.at(";"):
                self.simple()
            if self.accept(";") and not self.at("{"):
                self.simple()
        self.level = level

    def s_if(self) -> None:
        self.step()
        if self.at("{"):
            raise self.fail("expected a condition")
        self.head()
        self.block()
        if self.accept("else"):
            if self.at("if"):
                self.s_if()
            else:
                self.block()

    def s_for(self) -> None:
        self.step()
        level, self.level = self.level, -1
        if self.accept("range"):
            self.expr()
        elif not self.at("{"):
            ranged = False if self.at(";") else self.simple(True)
            if not ranged and self.accept(";"):
                if not self.at(";"):
                    self.simple()
                self.expect(";")
                if not self.at("{"):
                    self.simple()
        self.level = level
        self.block()

    def cases(self, select: bool = False) -> None:
        self.expect("{")
        level, self.level = self.level, 0
        while not self.at("}"):
            if self.accept("default"):
                pass
            else:
                self.expect("case")
                if select:
                    self.level = -1
                    self.simple()
                    self.level = 0
                else:
                    while True:
                        if self.trying(self.case_expr) is None:
                            self.type()
                        if not self.accept(","):
                            break
            self.expect(":")
            self.statements("case", "default", "}")
        self.level = level
        self.step()

    def case_expr(self) -> bool:
        self.expr()
        if not self.at(",", ":"):
            raise self.fail("expected ':'")
        return True

    def s_switch(self) -> None:
        self.step()
        self.head()
        self.cases()

    def s_select(self) -> None:
        self.step()
        self.cases(True)

    def s_return(self) -> None:
        self.step()
        if not self.at(";", "}"):
            self.exprs()

    def s_break(self) -> None:
        self.step()
        if self.cur.kind == "id":
            self.step()

    s_continue = s_break

    def s_goto(self) -> None:
        self.step()
        self.ident()

    def s_fallthrough(self) -> None:
        self.step()

    def s_go(self) -> None:
        self.step()
        if self.expr() != "call":
            raise self.fail("expected a call")

    s_defer = s_go

    def s_func(self) -> None:
        self.simple()

    def expr(self, least: int = 1) -> str:
        kind = self.unary()
        while self.cur.kind == "op" and (power := _BINARY.get(self.cur.text, 0)) >= least:
            self.step()
            self.expr(power + 1)
            kind = "other"
        return kind

    def unary(self) -> str:
        if self.at("<-"):
            self.step()
            self.unary()
            return "recv"
        if self.accept("*"):
            self.unary()
            return "member"
        if self.accept("+", "-", "!", "^", "&", "~"):
            self.unary()
            return "other"
        return self.primary()

    def primary(self) -> str:
        t = self.cur
        literal = False
        if t.kind == "id":
            self.step()
            kind, literal = "id", True
        elif t.kind in ("num", "str"):
            self.step()
            kind = "other"
        elif self.at("("):
            self.step()
            level, self.level = self.level, 0
            if self.trying(self.paren_expr) is None:
                self.type()
                self.expect(")")
            self.level = level
            kind = "member"
        elif self.at("func"):
            self.step()
            self.signature()
            kind = "other"
            if self.at("{"):
                self.block()
        elif self.at("[", "map", "chan", "struct", "interface"):
            self.type()
            kind, literal = "type", True
            if self.at("{"):
                self.composite()
                kind, literal = "other", False
        else:
            raise self.fail("expected an expression")
        while True:
            if self.accept("."):
                if self.accept("("):
                    if not self.accept("type"):
                        self.type()
                    self.expect(")")
                    kind = "other"
                else:
                    self.ident()
                    kind = "member"
            elif self.at("["):
                self.index()
                kind = "member"
            elif self.accept("("):
                level, self.level = self.level, 0
                self.commas(")", self.argument)
                self.level = level
                kind, literal = "call", False
            elif self.at("{") and literal and self.level >= 0:
                self.composite()
                kind, literal = "other", False
            else:
                return kind

    def paren_expr(self) -> bool:
        self.expr()
        self.expect(")")
        return True

    def argument(self) -> None:
        at = self.i
        try:
            self.expr()
        except Problem as e:
            self.i = at
            if self.trying(self.type_argument) is None:
                raise e
        self.accept("...")

    def type_argument(self) -> bool:
        self.type()
        if not self.at(",", ")"):
            raise self.fail("expected ')'")
        return True

    def index(self) -> None:
        self.expect("[")
        level, self.level = self.level, 0
        if self.trying(self.slice) is None:
            self.commas("]", self.type)
        self.level = level

    def slice(self) -> bool:
        if not self.at(":"):
            self.expr()
        while self.accept(":"):
            if not self.at(":", "]"):
                self.expr()
        if self.accept(","):
            self.commas("]", self.type)
        else:
            self.expect("]")
        return True

    def composite(self) -> None:
        self.expect("{")
        level, self.level = self.level, 0

        def value() -> None:
            self.composite() if self.at("{") else self.expr()

        def item() -> None:
            value()
            if self.accept(":"):
                value()

        self.commas("}", item)
        self.level = level


def parse_go(text: str) -> None:
    try:
        p = _Go(tokenize(text), text.count("\n") + 1)
        if p.cur.kind == "eof":
            return
        p.file()
        p.finish()
    except Problem:
        if line := conflict_marker(text):
            raise Problem("leftover merge-conflict marker", line) from None
        raise
