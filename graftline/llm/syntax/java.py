"""Java."""

from __future__ import annotations

import re

from graftline.llm.syntax.base import Cursor, Problem, Token, conflict_marker, scan

KEYWORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split())
_PRIMITIVE = frozenset("boolean byte char double float int long short".split())
_MODIFIERS = ("public", "protected", "private", "static", "abstract", "final", "native", "synchronized", "transient", "volatile", "strictfp", "default")
_TOKEN = re.compile(
    r"(?P<ws>[ \t\f\r\x1a]+)|(?P<nl>\n)|(?P<com>//[^\n]*|/\*.*?\*/)|(?P<err_comment_without_end>/\*)"
    r"|(?P<num>0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)"
    r"|(?P<str>\"\"\"[ \t\f]*\r?\n(?:\\.|[^\\])*?\"\"\"|\"(?:\\[^\n]|[^\"\\\n])*\"|'(?:\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.)|[^'\\\n])')|(?P<err_string_without_end>[\"'])"
    r"|(?P<id>(?:[^\W\d]|\$)[\w$]*)|(?P<op>\.\.\.|->|::|<<=|&&|\|\||\+\+|--|==|!=|<=|<<|[-+*/%&|^]=|[-+*/%&|^<>=!~?:(){}\[\],;.@])", re.S)  # fmt: skip
_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())


class _Java(Cursor):
    def operator(self) -> str:
        t = self.cur
        if t.kind not in ("op", "kw"):
            return ""
        if t.text != ">":
            return t.text
        s, k = ">", 1
        while self.ahead(k).kind == "op" and self.ahead(k).at == t.at + len(s) and len(s) < 4:
            nxt = self.ahead(k).text
            if nxt == ">":
                s += ">"
                k += 1
            elif nxt == "=":
                return s + "="
            else:
                break
        return s

    def unit(self) -> None:
        def top() -> None:
            if self.accept(";"):
                return
            if self.at("package", "import") or (self.at("@") and self.annotated_package()):
                w = self.step().text
                if w == "import":
                    self.accept("static")
                self.ident()
                while self.accept("."):
                    if w == "import" and self.accept("*"):
                        break
                    self.ident()
                self.expect(";")
                return
            if self.cur.text in ("module", "open") and self.ahead().kind == "id":
                self.module()
                return
            self.modifiers()
            if not self.type_declaration():
                raise self.fail("expected a class, interface, enum or record")

        self.recovering(top)

    def annotated_package(self) -> bool:
        at = self.i
        self.annotations()
        if self.at("package"):
            return True
        self.i = at
        return False

    def module(self) -> None:
        while not self.at("{"):
            if self.cur.kind == "eof":
                raise self.fail("expected '{'")
            self.step()
        if self.cur.mate is None:
            raise self.fail("expected '}'")
        self.i = self.cur.mate + 1

    def annotations(self) -> None:
        while self.at("@") and self.ahead().text != "interface":
            self.step()
            self.ident()
            while self.accept("."):
                self.ident()
            if self.accept("("):

                def item() -> None:
                    if self.cur.kind == "id" and self.ahead().text == "=":
                        self.i += 2
                    self.element()

                self.commas(")", item)

    def element(self) -> None:
        if self.at("@"):
            self.annotations()
        elif self.accept("{"):
            self.commas("}", self.element)
        else:
            self.conditional()

    def modifiers(self) -> bool:
        at = self.i
        while True:
            self.annotations()
            if self.at(*_MODIFIERS) and not (self.at("default") and self.ahead().text in (":", "->")) and not (self.at("synchronized") and self.ahead().text == "("):
                self.step()
            elif self.cur.text == "sealed" and self.ahead().kind in ("kw", "id") and self.cur.kind == "id":
                self.step()
            elif self.cur.text == "non" and self.ahead().text == "-" and self.ahead(2).text == "sealed":
                self.i += 3
            else:
                return self.i > at

    def type_declaration(self) -> bool:
        if self.accept("class"):
            self.ident()
            self.type_params()
            if self.accept("extends"):
                self.type()
            self.types_after("implements", "permits")
            self.class_body()
        elif self.at("interface") or (self.at("@") and self.ahead().text == "interface"):
            self.accept("@")
            self.step()
            self.ident()
            self.type_params()
            self.types_after("extends", "permits")
            self.class_body()
        elif self.accept("enum"):
            self.ident()
            self.types_after("implements")
            self.enum_body()
        elif self.cur.text == "record" and self.cur.kind == "id" and self.ahead().kind == "id" and self.ahead(2).text in ("(", "<"):
            self.step()
            self.ident()
            self.type_params()
            self.parameters()
            self.types_after("implements")
            self.class_body()
        else:
            return False
        return True

    def types_after(self, *words: str) -> None:
        while self.at(*words):
            self.step()
            self.type()
            while self.accept(","):
                self.type()

    def enum_body(self) -> None:
        self.expect("{")
        while not self.at(";", "}"):
            self.annotations()
            self.ident()
            if self.accept("("):
                self.arguments()
            if self.at("{"):
                self.class_body()
            if not self.accept(","):
                break
        if self.accept(";"):
            while not self.at("}"):
                self.member()
        self.expect("}")

    def class_body(self) -> None:
        self.expect("{")
        while not self.at("}"):
            if self.cur.kind == "eof":
                raise self.fail("expected '}'")
            self.member()
        self.step()

    def member(self) -> None:
        if self.accept(";"):
            return
        if self.at("static") and self.ahead().text == "{":
            self.step()
        if self.at("{"):
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.type_params()
        self.annotations()
        if self.cur.kind == "id" and self.ahead().text in ("(", "{"):
            self.step()
            if self.at("("):
                self.parameters()
                self.types_after("throws")
            self.block()
            return
        if not self.accept("void"):
            self.type()
        self.ident()
        if self.at("("):
            self.parameters()
            self.dims()
            self.types_after("throws")
            if self.accept("default"):
                self.element()
            if self.at("{"):
                self.block()
            else:
                self.expect(";")
            return
        self.declarators()
        self.expect(";")

    def declarators(self) -> None:
        """After the first name: dimensions, values and further names."""
        while True:
            self.dims()
            if self.accept("="):
                self.initializer()
            if not self.accept(","):
                return
            self.ident()

    def initializer(self) -> None:
        if self.accept("{"):
            self.commas("}", self.initializer)
        else:
            self.expr()

    def dims(self) -> None:
        while True:
            self.annotations()
            if self.at("[") and self.ahead().text == "]":
                self.i += 2
            else:
                return

    def parameters(self) -> None:
        self.expect("(")

        def item() -> None:
            self.modifiers()
            self.type()
            self.annotations()
            self.accept("...")
            if self.accept("this"):
                return
            self.variable()
            if self.accept("."):
                self.expect("this")
            self.dims()

        self.commas(")", item, trailing=False)

    def variable(self) -> None:
        if not self.accept("_"):
            self.ident()

    def type_params(self) -> None:
        if self.accept("<"):

            def item() -> None:
                self.annotations()
                self.ident()
                if self.accept("extends"):
                    self.type()
                    while self.accept("&"):
                        self.type()

            self.commas(">", item, trailing=False)

    def type(self) -> bool:
        self.annotations()
        if self.cur.kind == "kw" and self.cur.text in _PRIMITIVE:
            self.step()
        else:
            self.ident()
            self.type_args()
            while self.at(".") and (self.ahead().kind == "id" or self.ahead().text == "@"):
                self.step()
                self.annotations()
                self.ident()
                self.type_args()
        self.dims()
        return True

    def type_args(self) -> bool:
        if self.accept("<"):
            if self.accept(">"):
                return True

            def item() -> None:
                self.annotations()
                if self.accept("?"):
                    if self.accept("extends", "super"):
                        self.type()
                else:
                    self.type()

            self.commas(">", item, trailing=False)
        return True

    # statements
    def block(self) -> None:
        self.expect("{")
        while not self.at("}"):
            if self.cur.kind == "eof":
                raise self.fail("expected '}'")
            self.statement()
        self.step()

    def local(self) -> bool:
        """The type and name of a local variable, if they start here."""
        self.modifiers()
        self.type()
        self.variable()
        if not self.at("=", ";", ",", ":", "[", ")"):
            raise self.fail("expected ';'")
        return True

    def statement(self) -> None:
        t = self.cur
        if t.kind == "op":
            if t.text == "{":
                self.block()
                return
            if t.text == ";":
                self.step()
                return
        if t.kind == "kw":
            f = getattr(self, "s_" + t.text, None)
            if f and not (t.text == "synchronized" and self.ahead().text != "("):
                f()
                return
        if t.kind == "id" and self.ahead().text == ":":
            self.i += 2
            self.statement()
            return
        if t.text == "yield" and t.kind == "id" and self.ahead().text not in ("=", ".", "(", "[", "++", "--", "+=", "-="):
            self.step()
            self.expr()
            self.expect(";")
            return
        at = self.i
        if self.modifiers() or self.at("class", "interface", "enum") or (t.text == "record" and self.ahead().kind == "id"):
            if self.type_declaration():
                return
            self.i = at
            self.local()
        elif self.trying(self.local) is None:
            if self.expr() not in ("call", "assign"):
                raise self.fail("expression that is no statement")
            self.expect(";")
            return
        self.declarators()
        self.expect(";")

    def condition(self) -> None:
        self.expect("(")
        self.expr()
        self.expect(")")

    def s_if(self) -> None:
        self.step()
        self.condition()
        self.statement()
        if self.accept("else"):
            self.statement()

    def s_while(self) -> None:
        self.step()
        self.condition()
        self.statement()

    def s_do(self) -> None:
        self.step()
        self.statement()
        self.expect("while")
        self.condition()
        self.expect(";")

    def s_for(self) -> None:
        self.step()
        self.expect("(")
        if not self.at(";"):
            if self.trying(self.local):
                if self.accept(":"):
                    self.expr()
                    self.expect(")")
                    self.statement()
                    return
                self.declarators()
            else:
                self.expr()
                while self.accept(","):
                    self.expr()
        self.expect(";")
        if not self.at(";"):
            self.expr()
        self.expect(";")
        if not self.at(")"):
            self.expr()
            while self.accept(","):
                self.expr()
        self.expect(")")
        self.statement()

    def s_return(self) -> None:
        self.step()
        if not self.at(";"):
            self.expr()
        self.expect(";")

    def s_throw(self) -> None:
        self.step()
        self.expr()
        self.expect(";")

    def s_break(self) -> None:
        self.step()
        if self.cur.kind == "id":
            self.step()
        self.expect(";")

    s_continue = s_break

    def s_assert(self) -> None:
        self.step()
        self.expr()
        if self.accept(":"):
            self.expr()
        self.expect(";")

    def s_synchronized(self) -> None:
        self.step()
        self.condition()
        self.block()

    def s_try(self) -> None:
        self.step()
        n = 0
        if self.accept("("):
            n += 1
            while not self.at(")"):
                if self.trying(self.local):
                    self.expect("=")
                    self.expr()
                else:
                    self.expr()
                if not self.accept(";"):
                    break
            self.expect(")")
        self.block()
        while self.accept("catch"):
            n += 1
            self.expect("(")
            self.modifiers()
            self.type()
            while self.accept("|"):
                self.type()
            self.variable()
            self.expect(")")
            self.block()
        if self.accept("finally"):
            self.block()
        elif not n:
            raise self.fail("expected 'catch' or 'finally'")

    def s_switch(self) -> None:
        self.switch()
        if self.at(".") :
            self.postfix("call")
            self.expect(";")
        else:
            self.accept(";")

    def switch(self) -> None:
        self.expect("switch")
        self.condition()
        self.expect("{")
        while not self.at("}"):
            if self.accept("default"):
                pass
            else:
                self.expect("case")
                while True:
                    if not self.accept("default") and self.trying(self.case_pattern) is None:
                        self.conditional()
                    if not self.accept(","):
                        break
                if self.cur.text == "when" and self.cur.kind == "id":
                    self.step()
                    self.expr()
            if self.accept("->"):
                if self.at("{"):
                    self.block()
                elif self.at("throw"):
                    self.s_throw()
                else:
                    self.expr()
                    self.expect(";")
            else:
                self.expect(":")
                while not self.at("case", "default", "}"):
                    if self.cur.kind == "eof":
                        raise self.fail("expected '}'")
                    self.statement()
        self.step()

    def case_pattern(self) -> bool:
        self.pattern()
        if not (self.at(",", ":", "->") or self.cur.text == "when"):
            raise self.fail("expected ':'")
        return True

    def pattern(self) -> bool:
        self.modifiers()
        self.type()
        if self.accept("("):
            self.commas(")", self.pattern, trailing=False)
            if self.cur.kind == "id" and self.cur.text != "when":
                self.step()
        else:
            self.variable()
        return True

    # expressions
    def expr(self) -> str:
        if self.lambda_():
            return "other"
        kind = self.conditional()
        op = self.operator()
        if op in _ASSIGN:
            if kind not in ("id", "member"):
                raise self.fail("assignment to something that is no target")
            self.i += len(op) if op[0] == ">" else 1
            self.expr()
            return "assign"
        return kind

    def lambda_(self) -> bool:
        t = self.cur
        if (t.kind == "id" or t.text == "_") and self.ahead().text == "->":
            self.i += 2
        elif self.at("(") and t.mate is not None and t.mate + 1 < len(self.toks) and self.toks[t.mate + 1].text == "->":

            def names() -> bool:
                self.step()
                self.commas(")", self.variable, trailing=False)
                return True

            if self.trying(names) is None:
                self.parameters()
            self.expect("->")
        else:
            return False
        if self.at("{"):
            self.block()
        else:
            self.expr()
        return True

    def conditional(self) -> str:
        kind = self.binary(1)
        if self.accept("?"):
            self.expr()
            self.expect(":")
            if not self.lambda_():
                self.conditional()
            return "other"
        return kind

    def binary(self, least: int) -> str:
        kind = self.unary()
        while (power := _BINARY.get(op := self.operator(), 0)) >= least and power:
            self.i += len(op) if op[0] == ">" else 1
            if op == "instanceof":
                if self.trying(self.pattern) is None:
                    self.modifiers()
                    self.type()
            else:
                self.binary(power + 1)
            kind = "other"
        return kind

    def unary(self) -> str:
        if self.accept("++", "--"):
            if self.unary() not in ("id", "member"):
                raise self.fail("step of something that is no target")
            return "assign"
        if self.accept("+", "-", "!", "~"):
            self.unary()
            return "other"
        if self.at("(") and self.trying(self.cast):
            return "other"
        kind = self.postfix(self.primary())
        if self.at("++", "--"):
            if kind not in ("id", "member"):
                raise self.fail("step of something that is no target")
            while self.accept("++", "--"):
                pass
            return "assign"
        return kind

    def cast(self) -> bool:
        self.expect("(")
        primitive = self.cur.kind == "kw"
        self.type()
        primitive = primitive and self.toks[self.i - 1].kind == "kw"
        while self.accept("&"):
            self.type()
        self.expect(")")
        t = self.cur
        if self.lambda_():
            return True
        if not primitive and not (t.kind in ("id", "num", "str") or t.text in ("(", "!", "~") or (t.kind == "kw" and (t.text in ("this", "super", "new", "switch", "true", "false", "null", "void") or t.text in _PRIMITIVE))):
            raise self.fail("expected an expression")
        self.unary()
        return True

    def primary(self) -> str:
        t = self.cur
        if t.kind in ("num", "str"):
            self.step()
            return "other"
        if t.kind == "id":
            if self.ahead().text in ("<", "[") and self.trying(self.reference_type):
                return "other"
            self.step()
            return "id"
        if self.at("true", "false", "null", "this"):
            self.step()
            return "other"
        if self.accept("super"):
            if not self.at("(", ".", "::"):
                raise self.fail("expected '.'")
            return "other"
        if self.at("new"):
            return self.new()
        if self.at("switch"):
            self.switch()
            return "other"
        if t.kind == "kw" and (t.text in _PRIMITIVE or t.text == "void"):
            if not self.accept("void"):
                self.type()
            if not self.at("::"):
                self.expect(".")
                self.expect("class")
            return "other"
        if self.accept("("):
            kind = self.expr()
            self.expect(")")
            return kind if kind in ("id", "member") else "other"
        if self.at("@"):
            self.annotations()
            return self.primary()
        raise self.fail("expected an expression")

    def reference_type(self) -> bool:
        self.type()
        if self.at("::"):
            return True
        self.expect(".")
        self.expect("class")
        return True

    def new(self) -> str:
        self.expect("new")
        self.type_args()
        self.annotations()
        if self.cur.kind == "kw" and self.cur.text in _PRIMITIVE:
            self.step()
        else:
            self.ident()
            self.type_args()
            while self.accept("."):
                self.ident()
                self.type_args()
        if self.at("["):
            sized = False
            while self.at("["):
                self.step()
                if self.accept("]"):
                    continue
                self.expr()
                self.expect("]")
                sized = True
            if not sized:
                if not self.at("{"):
                    raise self.fail("expected '{'")
                self.initializer()
            return "other"
        self.expect("(")
        self.arguments()
        if self.at("{"):
            self.class_body()
        return "call"

    def arguments(self) -> None:
        self.commas(")", self.expr, trailing=False)

    def postfix(self, kind: str) -> str:
        if kind == "id" and self.at("("):
            self.step()
            self.arguments()
            kind = "call"
        elif self.at("(") and self.toks[self.i - 1].text in ("this", "super"):
            self.step()
            self.arguments()
            kind = "call"
        while True:
            if self.accept("."):
                self.type_args()
                if self.at("new"):
                    kind = self.new()
                elif self.accept("class", "this"):
                    kind = "other"
                elif self.accept("super"):
                    kind = "other"
                    if self.accept("("):
                        self.arguments()
                        kind = "call"
                else:
                    self.ident()
                    kind = "member"
                    if self.accept("("):
                        self.arguments()
                        kind = "call"
            elif self.at("[") :
                self.step()
                self.expr()
                self.expect("]")
                kind = "member"
            elif self.accept("::"):
                self.type_args()
                if not self.accept("new"):
                    self.ident()
                kind = "other"
            else:
                return kind


def parse_java(text: str) -> None:
    try:
        toks: list[Token] = scan(text, _TOKEN, KEYWORDS)
        for a, b in zip(toks, toks[1:]):
            if a.kind == "num" and b.kind in ("id", "kw") and a.end == b.at:
                raise Problem("number that runs into a name", a.line)
        p = _Java(toks, text.count("\n") + 1)
        p.unit()
        p.finish()
    except Problem:
        if line := conflict_marker(text):
            raise Problem("leftover merge-conflict marker", line) from None
        raise
