"""Rust."""

from __future__ import annotations

import re

from graftline.llm.syntax.base import Cursor, Problem, Token, conflict_marker

KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())
_TOKEN = re.compile(
    r"(?P<ws>[ \t\r\f\v]+)|(?P<nl>\n)|(?P<com>//[^\n]*)"
    r"|(?P<num>0x[0-9a-fA-F_]+(?:[ui](?:8|16|32|64|128|size))?|0o[0-7_]+(?:[ui]\w+)?|0b[01_]+(?:[ui]\w+)?|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[uif](?:8|16|32|64|128|size))?)"
    r"|(?P<str>[bc]?\"(?:\\(?:\r\n|.)|[^\"\\])*\"|b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|[nrt\\0'\"])|[^'\\\n\t\r])'|[bc]?r(?P<h>\#*)\".*?\"(?P=h))"
    r"|(?P<life>'(?:[^\W\d])\w*)|(?P<err_string_without_end>[\"'])"
    r"|(?P<id>(?:r\#)?[^\W\d]\w*)|(?P<op>\.\.\.|\.\.=|\.\.|::|->|=>|<<=|&&|\|\||==|!=|<=|<<|[-+*/%&|^]=|[-+*/%&|^<>=!~?:(){}\[\],;.@\#$])", re.S)  # fmt: skip


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    line, nl, i, n = 1, True, 0, len(text)
    if text.startswith("#!") and not text.startswith("#!["):
        i = text.find("\n") if "\n" in text else n
    while i < n:
        if text.startswith("/*", i):
            depth, j = 0, i
            while True:
                m = re.compile(r"/\*|\*/").search(text, j)
                if not m:
                    raise Problem("comment without end", line)
                depth += 1 if m[0] == "/*" else -1
                j = m.end()
                if not depth:
                    break
            nl = nl or "\n" in text[i:j]
            line += text.count("\n", i, j)
            i = j
            continue
        m = _TOKEN.match(text, i)
        if not m:
            raise Problem(f"character that starts no token: {text[i]!r}", line)
        kind, s = m.lastgroup, m[0]
        if kind == "h":
            kind = "str"
        if kind.startswith("err_"):
            raise Problem("string without end", line)
        if kind in ("ws", "nl", "com"):
            nl = nl or kind == "nl"
        else:
            if kind == "id" and s in KEYWORDS:
                kind = "kw"
            if out and kind in ("id", "kw") and out[-1].kind == "num" and out[-1].end == i:
                raise Problem("number that runs into a name", line)
            out.append(Token(kind, s, line, nl, i))
            nl = False
        line += s.count("\n")
        i = m.end()
    return out


_BINARY = {"=": 1, "+=": 1, "-=": 1, "*=": 1, "/=": 1, "%=": 1, "&=": 1, "|=": 1, "^=": 1, "<<=": 1, ">>=": 1, "..": 2, "..=": 2, "||": 3, "&&": 4, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "as": 12}
_BLOCKS = frozenset("if match loop while for unsafe block const async".split())


class _Rust(Cursor):
    #: true where a brace opens a block and no struct literal may stand
    bare = False

    def crate(self) -> None:
        while self.at("#") and self.ahead().text == "!":
            self.i += 1
            self.step()
            self.tree()
        self.recovering(self.item)

    def tree(self) -> None:
        """A delimited token tree."""
        if not self.at("(", "[", "{"):
            raise self.fail("expected a bracket")
        if self.cur.mate is None:
            raise self.fail("bracket that is never closed")
        self.i = self.cur.mate + 1

    def attributes(self) -> None:
        while self.at("#"):
            self.step()
            self.accept("!")
            if not self.at("["):
                raise self.fail("expected '['")
            self.tree()

    def operator(self) -> str:
        t = self.cur
        if t.kind not in ("op", "kw"):
            return ""
        if t.text != ">":
            return t.text
        s, k = ">", 1
        while self.ahead(k).kind == "op" and self.ahead(k).at == t.at + len(s) and len(s) < 3:
            nxt = self.ahead(k).text
            if nxt == ">" and len(s) == 1:
                s += ">"
                k += 1
            elif nxt == "=":
                return s + "="
            else:
                break
        return s

    def visibility(self) -> None:
        if self.accept("pub") and self.at("(") and self.ahead().text in ("crate", "self", "super", "in"):
            self.tree()

    # items
    def item(self) -> None:
        self.attributes()
        self.visibility()
        if not self.maybe_item():
            raise self.fail("expected an item")

    def maybe_item(self) -> bool:
        t = self.cur
        if t.kind == "id":
            if t.text == "union" and self.ahead().kind == "id":
                self.step()
                self.struct_rest()
                return True
            if t.text == "macro_rules" and self.ahead().text == "!":
                self.i += 2
                self.ident()
                brace = self.at("{")
                self.tree()
                if not brace:
                    self.expect(";")
                return True
            if t.text == "auto" and self.ahead().text == "trait":
                self.step()
                return self.maybe_item()
            if self.ahead().text in ("!", "::"):
                at = self.i
                if self.trying(self.macro_item):
                    return True
                self.i = at
            return False
        if t.kind != "kw":
            return False
        w = t.text
        if w == "use":
            self.step()
            self.use_tree()
            self.expect(";")
        elif w == "mod":
            self.step()
            self.ident()
            if not self.accept(";"):
                self.items()
        elif w == "struct":
            self.step()
            self.struct_rest()
        elif w == "enum":
            self.step()
            self.ident()
            self.generics()
            self.where()
            self.expect("{")

            def variant() -> None:
                self.attributes()
                self.visibility()
                self.ident()
                if self.at("{"):
                    self.fields()
                elif self.at("("):
                    self.tuple_fields()
                if self.accept("="):
                    self.expr()

            self.commas("}", variant)
        elif w == "type":
            self.step()
            self.ident()
            self.generics()
            if self.accept(":"):
                self.bounds()
            self.where()
            if self.accept("="):
                self.type()
            self.where()
            self.expect(";")
        elif w in ("const", "static") and not (w == "const" and self.ahead().text in ("fn", "unsafe", "extern", "async", "{")):
            self.step()
            self.accept("mut")
            if not self.at("_"):
                self.ident()
            else:
                self.step()
            self.expect(":")
            self.type()
            if self.accept("="):
                self.expr()
            self.expect(";")
        elif w == "trait" or (w == "unsafe" and self.ahead().text in ("trait", "auto")):
            self.accept("unsafe")
            if self.cur.text == "auto":
                self.step()
            self.expect("trait")
            self.ident()
            self.generics()
            if self.accept(":"):
                self.bounds()
            self.where()
            self.items()
        elif w == "impl" or (w == "unsafe" and self.ahead().text == "impl"):
            self.accept("unsafe")
            self.step()
            if self.at("<") and self.ahead().text != "<":
                self.generics()
            self.accept("const")
            self.accept("!")
            self.type()
            if self.accept("for"):
                self.type()
            self.where()
            self.items()
        elif w == "extern" and self.ahead().text == "crate":
            self.i += 2
            if not self.accept("self"):
                self.ident()
            if self.accept("as"):
                self.step()
            self.expect(";")
        elif w in ("extern", "unsafe") and self.foreign():
            pass
        elif self.function_head():
            self.function()
        else:
            return False
        return True

    def foreign(self) -> bool:
        k = 1 if self.at("unsafe") else 0
        if self.ahead(k).text != "extern":
            return False
        k += 2 if self.ahead(k + 1).kind == "str" else 1
        if self.ahead(k).text != "{":
            return False
        self.i += k
        self.items()
        return True

    def macro_item(self) -> bool:
        self.path()
        self.expect("!")
        if self.cur.kind == "id":
            self.step()
        brace = self.at("{")
        self.tree()
        if not brace:
            self.expect(";")
        return True

    def items(self) -> None:
        self.expect("{")
        while not self.at("}"):
            if self.cur.kind == "eof":
                raise self.fail("expected '}'")
            self.attributes()
            self.visibility()
            if self.cur.text == "default" and self.ahead().kind == "kw":
                self.step()
            if not self.maybe_item():
                raise self.fail("expected an item")
        self.step()

    def use_tree(self) -> None:
        self.accept("::")
        while True:
            if self.accept("*"):
                return
            if self.accept("{"):
                self.commas("}", self.use_tree)
                return
            if not self.accept("crate", "self", "super", "Self"):
                self.ident()
            if self.accept("as"):
                if not self.accept("_"):
                    self.ident()
                return
            if not self.accept("::"):
                return

    def struct_rest(self) -> None:
        self.ident()
        self.generics()
        self.where()
        if self.at("{"):
            self.fields()
            return
        if self.at("("):
            self.tuple_fields()
            self.where()
        self.expect(";")

    def fields(self) -> None:
        self.expect("{")

        def field() -> None:
            self.attributes()
            self.visibility()
            self.ident()
            self.expect(":")
            self.type()

        self.commas("}", field)

    def tuple_fields(self) -> None:
        self.expect("(")

        def field() -> None:
            self.attributes()
            self.visibility()
            self.type()

        self.commas(")", field)

    def function_head(self) -> bool:
        k = 0
        while self.ahead(k).text in ("const", "async", "unsafe", "extern", "safe") or (k and self.ahead(k).kind == "str"):
            k += 1
        return self.ahead(k).text == "fn" and self.ahead(k).kind == "kw"

    def function(self) -> None:
        while not self.accept("fn"):
            self.step()
        self.ident()
        self.generics()
        self.expect("(")

        def param() -> None:
            self.attributes()
            if self.trying(self.receiver):
                return
            if self.accept("..."):
                return
            self.pattern()
            self.expect(":")
            self.accept("...") or self.type()

        self.commas(")", param)
        if self.accept("->"):
            self.type()
        self.where()
        if not self.accept(";"):
            self.block()

    def receiver(self) -> bool:
        if self.accept("&"):
            if self.cur.kind == "life":
                self.step()
        self.accept("mut")
        self.expect("self")
        if self.accept(":"):
            self.type()
        if not self.at(",", ")"):
            raise self.fail("expected ','")
        return True

    def generics(self) -> None:
        if not self.accept("<"):
            return

        def param() -> None:
            self.attributes()
            if self.cur.kind == "life":
                self.step()
                if self.accept(":"):
                    self.bounds()
            elif self.accept("const"):
                self.ident()
                self.expect(":")
                self.type()
                if self.accept("="):
                    self.generic_value()
            else:
                self.ident()
                if self.accept(":"):
                    self.bounds()
                if self.accept("="):
                    self.type()

        self.commas(">", param)

    def generic_value(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.accept("-")
            self.step()

    def where(self) -> None:
        if not self.accept("where"):
            return
        while not self.at("{", ";", "="):
            if self.cur.kind == "life":
                self.step()
            else:
                self.for_lifetimes()
                self.type()
            self.expect(":")
            self.bounds()
            if not self.accept(","):
                break

    def for_lifetimes(self) -> None:
        if self.at("for") and self.ahead().text == "<":
            self.step()
            self.generics()

    def bounds(self) -> None:
        while not self.at(",", ">", "{", ";", "=", ")", "where"):
            if self.cur.kind == "life":
                self.step()
            elif self.at("use") and self.ahead().text == "<":
                self.step()
                self.generics()
            else:
                paren = self.accept("(")
                self.accept("?", "~")
                self.accept("const", "async")
                self.for_lifetimes()
                self.type_path()
                if paren:
                    self.expect(")")
            if not self.accept("+"):
                break

    # types
    def type(self, plus: bool = True) -> bool:
        if self.at("for"):
            self.for_lifetimes()
        if self.accept("&", "&&"):
            if self.cur.kind == "life":
                self.step()
            self.accept("mut")
            self.type(False)
        elif self.accept("*"):
            self.expect("const", "mut")
            self.type(False)
        elif self.accept("("):
            self.commas(")", self.type)
        elif self.accept("["):
            self.type()
            if self.accept(";"):
                self.expr()
            self.expect("]")
        elif self.accept("!", "_"):
            pass
        elif self.accept("impl", "dyn"):
            self.bounds()
        elif self.at("fn", "unsafe", "extern"):
            while not self.accept("fn"):
                if self.cur.kind == "eof":
                    raise self.fail("expected 'fn'")
                self.step()
            self.expect("(")

            def arg() -> None:
                self.attributes()
                if self.accept("..."):
                    return
                if (self.cur.kind == "id" or self.at("_")) and self.ahead().text == ":":
                    self.i += 2
                self.type()

            self.commas(")", arg)
            if self.accept("->"):
                self.type()
        else:
            self.type_path()
            if self.at("!"):
                self.step()
                self.tree()
            if plus and self.at("+"):
                self.step()
                self.bounds()
        return True

    def type_path(self) -> None:
        if self.at("<"):
            self.qualified()
        else:
            self.accept("::")
            self.segment(True)
        while self.accept("::"):
            self.segment(True)

    def qualified(self) -> None:
        self.expect("<")
        self.type()
        if self.accept("as"):
            self.type_path()
        self.expect(">")
        if not self.at("::"):
            raise self.fail("expected '::'")

    def segment(self, in_type: bool) -> None:
        if in_type and self.at("<"):
            self.generic_args()
            return
        if not self.accept("crate", "self", "super", "Self"):
            self.ident()
        if in_type:
            if self.at("<"):
                self.generic_args()
            elif self.at("("):
                self.step()
                self.commas(")", self.type)
                if self.accept("->"):
                    self.type(False)

    def generic_args(self) -> bool:
        self.expect("<")

        def arg() -> None:
            if self.cur.kind in ("life", "num", "str"):
                self.step()
            elif self.at("-", "{", "true", "false"):
                self.generic_value()
            else:
                self.type()
                if self.accept("="):
                    self.type()
                elif self.accept(":"):
                    self.bounds()

        self.commas(">", arg)
        return True

    def path(self) -> None:
        """A path in an expression: generic arguments stand behind '::'."""
        if self.at("<"):
            self.qualified()
        else:
            self.accept("::")
            self.segment(False)
        while self.at("::"):
            self.step()
            if self.at("<"):
                self.generic_args()
            else:
                self.segment(False)

    # patterns
    def pattern(self) -> bool:
        self.accept("|")
        self.one_pattern()
        while self.accept("|"):
            self.one_pattern()
        return True

    def literal(self) -> bool:
        at = self.i
        self.accept("-")
        if self.cur.kind in ("num", "str") or self.at("true", "false"):
            self.step()
            return True
        self.i = at
        return False

    def one_pattern(self) -> None:
        if self.literal():
            if self.accept("..=", "..", "..."):
                if not self.literal() and self.cur.kind in ("id", "kw") and not self.at("if"):
                    self.path()
            return
        if self.accept("..=", ".."):
            if not self.literal() and self.cur.kind == "id":
                self.path()
        elif self.accept("_"):
            pass
        elif self.accept("&", "&&"):
            self.accept("mut")
            self.one_pattern()
        elif self.accept("("):
            self.commas(")", self.pattern)
        elif self.accept("["):
            self.commas("]", self.pattern)
        elif self.at("box", "const") and self.ahead().text == "{":
            self.step()
            self.block()
        elif self.at("ref", "mut"):
            self.accept("ref")
            self.accept("mut")
            if not self.accept("self"):
                self.ident()
            if self.accept("@"):
                self.one_pattern()
        elif self.cur.kind == "id" and self.ahead().text == "@":
            self.i += 2
            self.one_pattern()
        else:
            self.path()
            if self.at("!"):
                self.step()
                self.tree()
            elif self.accept("("):
                self.commas(")", self.pattern)
            elif self.at("{"):
                self.step()

                def field() -> None:
                    self.attributes()
                    if self.accept(".."):
                        return
                    if self.cur.kind in ("id", "num") and self.ahead().text == ":":
                        self.i += 2
                        self.pattern()
                        return
                    self.accept("ref")
                    self.accept("mut")
                    self.ident()

                self.commas("}", field)
            elif self.accept("..=", "..", "..."):
                if not self.literal() and self.cur.kind in ("id", "kw") and not self.at("if", "in"):
                    self.path()

    # statements and expressions
    def block(self) -> None:
        self.expect("{")
        bare, self.bare = self.bare, False
        while not self.at("}"):
            if self.cur.kind == "eof":
                raise self.fail("expected '}'")
            self.statement()
        self.bare = bare
        self.step()

    def statement(self) -> None:
        if self.accept(";"):
            return
        self.attributes()
        if self.accept("let"):
            self.pattern()
            if self.accept(":"):
                self.type()
            if self.accept("="):
                self.expr()
                if self.accept("else"):
                    self.block()
            self.expect(";")
            return
        at = self.i
        if self.at("pub"):
            self.item()
            return
        if self.cur.kind == "kw" and self.cur.text not in ("self", "Self", "super", "crate", "unsafe", "async", "const", "extern") or self.function_head() or self.at("unsafe", "const", "extern"):
            if not (self.at("unsafe", "const") and self.ahead().text == "{") and self.maybe_item():
                return
            self.i = at
        elif self.cur.kind == "id" and self.cur.text in ("macro_rules", "union") and self.maybe_item():
            return
        kind = self.expr(statement=True)
        if self.accept(";") or kind == "block" or self.at("}"):
            return
        raise self.fail("expected ';'")

    def expr(self, least: int = 1, statement: bool = False) -> str:
        if self.at("..", "..=") :
            self.step()
            if self.starts():
                self.expr(3)
            return "other"
        kind = self.unary(statement)
        if statement and kind == "block":
            if not self.at(".", "?"):
                return kind
            kind = self.postfix(kind)
        while True:
            op = self.operator()
            power = _BINARY.get(op, 0)
            if not power or power < least:
                return kind
            self.i += len(op) if op[0] == ">" else 1
            if op == "as":
                self.type(False)
            elif power == 1:
                self.expr(1)
            elif power == 2:
                if self.starts():
                    self.expr(3)
            else:
                self.expr(power + 1)
                if power == 5 and _BINARY.get(self.operator(), 0) == 5:
                    raise self.fail("chained comparison")
            kind = "other"

    def starts(self) -> bool:
        t = self.cur
        if t.kind == "eof":
            return False
        if t.kind in ("id", "num", "str", "life"):
            return True
        if t.kind == "kw":
            return t.text not in ("else", "as", "in", "where")
        return t.text in ("(", "[", "&", "*", "-", "!", "|", "||", "::", "<", "&&") or (t.text == "{" and not self.bare)

    def unary(self, statement: bool = False) -> str:
        self.attributes()
        if self.accept("-", "!", "*"):
            self.unary()
            return "other"
        if self.accept("&", "&&"):
            if self.cur.text == "raw" and self.ahead().text in ("const", "mut"):
                self.i += 2
            else:
                self.accept("mut")
            self.unary()
            return "other"
        kind = self.primary()
        if statement and kind == "block":
            return kind
        return self.postfix(kind)

    def postfix(self, kind: str) -> str:
        while True:
            if self.accept("?"):
                kind = "other"
            elif self.accept("."):
                if self.accept("await"):
                    pass
                elif self.cur.kind == "num":
                    self.step()
                else:
                    self.ident()
                    if self.at("::"):
                        self.step()
                        self.generic_args()
                kind = "other"
            elif self.at("("):
                self.step()
                self.list(")")
                kind = "other"
            elif self.at("["):
                self.step()
                bare, self.bare = self.bare, False
                self.expr()
                self.bare = bare
                self.expect("]")
                kind = "other"
            else:
                return kind

    def list(self, close: str) -> None:
        bare, self.bare = self.bare, False
        self.commas(close, self.expr)
        self.bare = bare

    def head(self) -> None:
        """The condition of if, while and match."""
        bare, self.bare = self.bare, True
        self.chain()
        self.bare = bare

    def chain(self) -> None:
        if self.at("let"):
            while True:
                if self.accept("let"):
                    self.pattern()
                    self.expect("=")
                    self.expr(5)
                else:
                    self.expr(5)
                if not self.accept("&&", "||"):
                    return
        self.expr()
        while self.at("let"):
            self.chain()

    def primary(self) -> str:
        t = self.cur
        if t.kind in ("num", "str"):
            self.step()
            return "other"
        if t.kind == "life":
            self.step()
            self.expect(":")
            return self.primary()
        if t.kind == "kw":
            w = t.text
            if w in ("true", "false"):
                self.step()
                return "other"
            if w == "if":
                self.step()
                self.head()
                self.block()
                if self.accept("else"):
                    if self.at("if"):
                        self.primary()
                    else:
                        self.block()
                return "block"
            if w == "match":
                self.step()
                self.head()
                self.expect("{")
                bare, self.bare = self.bare, False
                while not self.at("}"):
                    if self.cur.kind == "eof":
                        raise self.fail("expected '}'")
                    self.attributes()
                    self.pattern()
                    if self.accept("if"):
                        self.chain()
                    self.expect("=>")
                    kind = self.expr(statement=True) if self.at("{") else self.expr()
                    if not self.accept(",") and kind != "block" and not self.at("}"):
                        raise self.fail("expected ','")
                self.bare = bare
                self.step()
                return "block"
            if w == "loop":
                self.step()
                self.block()
                return "block"
            if w == "while":
                self.step()
                self.head()
                self.block()
                return "block"
            if w == "for" and self.ahead().text != "<":
                self.step()
                self.pattern()
                self.expect("in")
                self.head()
                self.block()
                return "block"
            if w in ("unsafe", "const") and self.ahead().text == "{":
                self.step()
                self.block()
                return "block"
            if w == "async" and (self.ahead().text == "{" or (self.ahead().text == "move" and self.ahead(2).text == "{")):
                self.step()
                self.accept("move")
                self.block()
                return "block"
            if w in ("move", "async", "static", "for"):
                if w == "for":
                    self.for_lifetimes()
                while self.accept("move", "async", "static"):
                    pass
                return self.closure()
            if w == "return":
                self.step()
                if self.starts():
                    self.expr()
                return "other"
            if w == "break":
                self.step()
                if self.cur.kind == "life":
                    self.step()
                if self.starts() and not self.at("}"):
                    self.expr()
                return "other"
            if w == "continue":
                self.step()
                if self.cur.kind == "life":
                    self.step()
                return "other"
            if w == "let":
                self.chain()
                return "other"
            if w not in ("self", "Self", "super", "crate"):
                raise self.fail("expected an expression")
        if t.kind == "op":
            if t.text in ("|", "||"):
                return self.closure()
            if t.text == "(":
                self.step()
                self.list(")")
                return "other"
            if t.text == "[":
                self.step()
                bare, self.bare = self.bare, False
                if not self.at("]"):
                    self.expr()
                    if self.accept(";"):
                        self.expr()
                        self.expect("]")
                        self.bare = bare
                        return "other"
                    if not self.at("]"):
                        self.expect(",")
                self.commas("]", self.expr)
                self.bare = bare
                return "other"
            if t.text == "{":
                self.block()
                return "block"
            if t.text == "_":
                self.step()
                return "other"
            if t.text not in ("::", "<"):
                raise self.fail("expected an expression")
        if t.kind == "id" and t.text == "_":
            self.step()
            return "other"
        self.path()
        if self.at("!") and self.ahead().text in ("(", "[", "{"):
            self.step()
            brace = self.at("{")
            self.tree()
            return "block" if brace else "other"
        if self.at("{") and not self.bare and self.struct_ahead():
            self.step()

            def field() -> None:
                self.attributes()
                if self.accept(".."):
                    if not self.at("}"):
                        self.expr()
                    return
                if self.cur.kind == "num":
                    self.step()
                    self.expect(":")
                    self.expr()
                    return
                self.ident()
                if self.accept(":"):
                    self.expr()

            bare, self.bare = self.bare, False
            self.commas("}", field)
            self.bare = bare
        return "other"

    def struct_ahead(self) -> bool:
        a, b = self.ahead(1), self.ahead(2)
        return a.text in ("}", "..", "#") or (a.kind in ("id", "num") and b.text in (":", ",", "}"))

    def closure(self) -> str:
        if not self.accept("||"):
            self.expect("|")

            def param() -> None:
                self.attributes()
                self.one_pattern()
                if self.accept(":"):
                    self.type()

            self.commas("|", param)
        if self.accept("->"):
            self.type(False)
            self.block()
        else:
            self.expr()
        return "other"


def parse_rust(text: str) -> None:
    try:
        p = _Rust(tokenize(text), text.count("\n") + 1)
        p.crate()
        p.finish()
    except Problem:
        if line := conflict_marker(text):
            raise Problem("leftover merge-conflict marker", line) from None
        raise
