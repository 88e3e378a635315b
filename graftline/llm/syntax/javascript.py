"""JavaScript (scripts and modules) and TypeScript."""

from __future__ import annotations

import re

from graftline.llm.syntax.base import Cursor, Problem, Token, conflict_marker

KEYWORDS = frozenset("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split())
_TOKEN = re.compile(
    r"(?P<ws>[ \t\v\f\xa0﻿]+)|(?P<nl>\r\n|[\n\r  ])|(?P<com>//[^\n\r]*|/\*.*?\*/)|(?P<err_comment_without_end>/\*)"
    r"|(?P<num>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*n|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?))"
    r"|(?P<str>\"(?:\\(?:\r\n|.)|[^\"\\\n\r])*\"|'(?:\\(?:\r\n|.)|[^'\\\n\r])*')|(?P<err_string_without_end>[\"'])"
    r"|(?P<id>\#?(?:[^\W\d]|\$|\\u\{?[0-9a-fA-F]+\}?)(?:\w|\$|\\u\{?[0-9a-fA-F]+\}?|[‌‍])*)"
    r"|(?P<op>\.\.\.|=>|\*\*=|<<=|&&=|\|\|=|\?\?=|===|!==|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|[-+*/%&|^]=|[-+*/%&|^!~?:=<>(){}\[\],;.@])", re.S)  # fmt: skip
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_RUNS_ON = re.compile(r"[\w$]")
_VALUE_WORDS = frozenset(("this", "super", "null", "true", "false"))


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    line, nl, i, n = 1, True, 0, len(text)
    if text.startswith("#!"):
        i = text.find("\n") if "\n" in text else n
    parens: list[bool] = []
    closed_head = False
    while i < n:
        c = text[i]
        if c == "`":
            j, kind = _template(text, i, line), "tpl"
            out.append(Token("tpl", text[i:j], line, nl, i))
        elif c == "/" and not text.startswith(("//", "/*"), i) and _regex_here(out, closed_head) and (m := _REGEX.match(text, i)):
            j, kind = m.end(), "re"
            out.append(Token("re", m[0], line, nl, i))
        else:
            m = _TOKEN.match(text, i)
            if not m:
                raise Problem(f"character that starts no token: {c!r}", line)
            kind, s, j = m.lastgroup, m[0], m.end()
            if kind.startswith("err_"):
                raise Problem(kind[4:].replace("_", " "), line)
            if kind in ("ws", "nl", "com"):
                nl = nl or kind == "nl" or "\n" in s
                line += s.count("\n")
                i = j
                continue
            if kind == "num":
                if _RUNS_ON.match(text, j):
                    raise Problem("number that runs into a name", line)
                if s[0] == "0" and s[-1] == "n" and s[1:-1].isdigit():
                    raise Problem("big number with a leading zero", line)
            if kind == "id" and s in KEYWORDS and not (out and out[-1].text in (".", "?.") and out[-1].kind == "op"):
                kind = "kw"
            if s == "(" and kind == "op":
                parens.append(bool(out) and out[-1].kind == "kw" and out[-1].text in ("if", "while", "for", "with"))
            elif s == ")" and kind == "op":
                closed_head = parens.pop() if parens else False
            out.append(Token(kind, s, line, nl, i))
        if kind in ("tpl", "str"):
            line += text.count("\n", i, j)
        nl = False
        i = j
    return out


def _regex_here(out: list[Token], closed_head: bool) -> bool:
    if not out:
        return True
    t = out[-1]
    if t.kind in ("num", "str", "tpl", "re", "id"):
        return t.kind == "id" and t.text in ("yield", "await", "of")
    if t.kind == "kw":
        return t.text not in _VALUE_WORDS
    if t.text == ")":
        return closed_head
    return t.text not in ("]", "}", "++", "--")


def _template(text: str, i: int, line: int) -> int:
    """End of the template literal at ``i``; its substitutions are parsed."""
    j = i + 1
    while j < len(text):
        if text[j] == "\\":
            j += 2
        elif text[j] == "`":
            return j + 1
        elif text.startswith("${", j):
            k, depth = j + 2, 0
            while k < len(text):
                c = text[k]
                if c == "`":
                    k = _template(text, k, line)
                    continue
                if c in "\"'":
                    m = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S).match(text, k)
                    if m:
                        k = m.end()
                        continue
                if c == "}" and not depth:
                    break
                depth += (c == "{") - (c == "}")
                k += 1
            p = _Script(tokenize(text[j + 2 : k]), line, True)
            try:
                p.expression()
            except Problem as e:
                raise Problem(e.cause, line) from None
            if p.cur.kind != "eof":
                raise Problem("template substitution that does not end", line)
            j = k + 1
        else:
            j += 1
    raise Problem("template literal without end", line)


_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "as": 8, "satisfies": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_STRICT = frozenset(("id", "member", "pattern", "cover"))


class _Script(Cursor):
    #: whether the assignment to be read is a part of a literal
    literal = False
    #: whether the code to be read belongs to an asynchronous function
    awaits = False

    def __init__(self, tokens: list[Token], last: int, typed: bool):
        super().__init__(tokens, last)
        self.ts, self.no_in = typed, False
        self.functions = self.loops = self.switches = 0
        self.asynchronous = True
        self.ambient = False

    # helpers
    def operator(self) -> str:
        """The operator here; '>' tokens that touch are one operator."""
        t = self.cur
        if t.kind not in ("op", "kw", "id"):
            return ""
        if t.text != ">":
            return t.text
        s, k = ">", 1
        while self.ahead(k).kind == "op" and self.ahead(k).at == t.at + len(s) and len(s) < 4 and (self.ahead(k).text in (">", "=") or (self.ahead(k).text in ("==", "=>") and False)):
            s += self.ahead(k).text
            k += 1
            if s.endswith("="):
                break
        if self.ahead(k).kind == "op" and self.ahead(k).at == t.at + len(s) and self.ahead(k).text == "==" and s == ">":
            return ">"
        return s

    def skip_operator(self, op: str) -> None:
        self.i += len(op) if op[0] == ">" else 1

    def end(self) -> None:
        if self.accept(";") or self.at("}") or self.cur.kind == "eof" or self.cur.nl:
            return
        raise self.fail("expected ';'")

    def name(self) -> Token:
        """A property name without brackets."""
        if self.cur.kind in ("id", "kw"):
            return self.step()
        raise self.fail("expected a name")

    # statements
    def program(self) -> None:
        self.recovering(self.statement)

    def block(self) -> None:
        self.expect("{")
        while not self.at("}"):
            if self.cur.kind == "eof":
                raise self.fail("expected '}'")
            self.statement()
        self.step()

    def statement(self) -> None:
        t = self.cur
        if t.kind == "op":
            if t.text == "{":
                self.block()
                return
            if t.text == ";":
                self.step()
                return
            if t.text == "@":
                self.decorators()
                self.accept("export")
                self.accept("default")
                if self.ts:
                    self.accept("abstract")
                self.klass()
                return
        if t.kind == "kw":
            f = getattr(self, "s_" + t.text, None)
            if f:
                f()
                return
        if t.kind == "id":
            nxt = self.ahead()
            if t.text == "let" and (nxt.kind == "id" or nxt.text in ("[", "{")):
                self.step()
                self.declarations()
                self.end()
                return
            if t.text in ("using",) and nxt.kind == "id" and not nxt.nl and self.ahead(2).text == "=":
                self.step()
                self.declarations()
                self.end()
                return
            if t.text == "async" and nxt.text == "function" and not nxt.nl:
                self.step()
                self.function(True)
                return
            if nxt.text == ":" and nxt.kind == "op":
                self.i += 2
                self.statement()
                return
            if self.ts and self.ts_statement():
                return
        self.expression()
        self.end()

    def ts_statement(self) -> bool:
        t, nxt = self.cur, self.ahead()
        w = t.text
        if nxt.nl:
            return False
        if w == "interface" and nxt.kind == "id":
            self.step()
            self.ident()
            self.type_params()
            if self.accept("extends"):
                self.type()
                while self.accept(","):
                    self.type()
            self.object_type()
            return True
        if w == "type" and nxt.kind == "id":
            self.step()
            self.ident()
            self.type_params()
            self.expect("=")
            self.type()
            self.end()
            return True
        if w == "abstract" and nxt.text == "class":
            self.step()
            self.klass()
            return True
        if w in ("namespace", "module") and nxt.kind in ("id", "str"):
            self.step()
            if self.cur.kind == "str":
                self.step()
            else:
                self.ident()
                while self.accept("."):
                    self.ident()
            if self.at("{"):
                self.block()
            else:
                self.end()
            return True
        if w == "global" and nxt.text == "{":
            self.step()
            self.block()
            return True
        if w == "declare" and nxt.kind in ("id", "kw"):
            self.step()
            outer, self.ambient = self.ambient, True
            try:
                self.statement()
            finally:
                self.ambient = outer
            return True
        return False

    def s_var(self) -> None:
        self.step()
        self.declarations()
        self.end()

    def s_const(self) -> None:
        self.step()
        if self.ts and self.at("enum"):
            self.s_enum()
            return
        self.declarations(const=True)
        self.end()

    def declarations(self, const: bool = False, head: bool = False) -> int:
        n = 0
        while True:
            n += 1
            pattern = self.at("[", "{")
            self.binding()
            if self.ts:
                self.accept("!")
                if self.accept(":"):
                    self.type()
            if self.accept("="):
                self.assign()
            elif (const or pattern) and not head and not self.ambient:
                raise self.fail("expected '='")
            if not self.accept(","):
                return n

    def binding(self) -> None:
        if self.accept("["):
            while not self.at("]"):
                if self.accept(","):
                    continue
                self.accept("...")
                self.binding()
                if self.accept("="):
                    self.assign()
                if not self.at("]"):
                    self.expect(",")
            self.step()
        elif self.accept("{"):

            def item() -> None:
                if self.accept("..."):
                    self.binding()
                    return
                short = self.cur.kind == "id"
                self.property_name()
                if self.accept(":"):
                    self.binding()
                elif not short:
                    raise self.fail("expected ':'")
                if self.accept("="):
                    self.assign()

            self.commas("}", item)
        elif self.cur.kind == "id":
            self.step()
        else:
            raise self.fail("expected a name or a pattern")

    def s_enum(self) -> None:
        if not self.ts:
            raise self.fail("reserved word")
        self.step()
        self.ident()
        self.expect("{")

        def item() -> None:
            self.property_name()
            if self.accept("="):
                self.assign()

        self.commas("}", item)

    def s_function(self) -> None:
        self.function(True)

    def function(self, named: bool) -> None:
        awaits = self.i > 0 and self.toks[self.i - 1].text == "async"
        self.expect("function")
        self.accept("*")
        if self.cur.kind == "id":
            self.step()
        elif named:
            raise self.fail("expected a name")
        self.signature()
        self.body(awaits)

    def signature(self) -> None:
        self.type_params()
        self.expect("(")
        self.parameters()
        if self.ts and self.accept(":"):
            self.return_type()

    def parameters(self) -> None:
        def item() -> None:
            self.decorators()
            if self.ts:
                while self.cur.text in ("public", "private", "protected", "readonly", "override") and (self.ahead().kind == "id" or self.ahead().text in ("{", "[")):
                    self.step()
                if self.at("this") and self.ahead().text == ":":
                    self.i += 2
                    self.type()
                    return
            rest = self.accept("...")
            self.binding()
            if self.ts:
                self.accept("?")
                if self.accept(":"):
                    self.type()
            if self.accept("="):
                if rest:
                    raise self.fail("default of a rest parameter")
                self.assign()

        self.commas(")", item)

    def body(self, awaits: bool = False) -> None:
        """A function body; TypeScript overloads and ambient functions have none."""
        if self.ts and not self.at("{"):
            self.end()
            return
        state = self.loops, self.switches, self.no_in, self.awaits
        self.functions, self.loops, self.switches, self.no_in, self.awaits = self.functions + 1, 0, 0, False, awaits
        try:
            self.block()
        finally:
            self.functions -= 1
            self.loops, self.switches, self.no_in, self.awaits = state

    def s_class(self) -> None:
        self.klass()

    def klass(self, named: bool = True) -> None:
        self.expect("class")
        if self.cur.kind == "id" and self.cur.text not in ("implements",):
            self.step()
        elif named:
            raise self.fail("expected a name")
        self.type_params()
        if self.accept("extends"):
            self.unary_postfix()
            if self.ts and self.at("<"):
                self.type_args()
        if self.ts and self.cur.text == "implements":
            self.step()
            self.type()
            while self.accept(","):
                self.type()
        self.expect("{")
        built = 0
        while not self.at("}"):
            if self.cur.kind == "eof":
                raise self.fail("expected '}'")
            if not self.accept(";"):
                built += bool(self.member())
                if built > 1:
                    raise self.fail("second constructor")
        self.step()

    def member(self) -> bool | None:
        """A member of a class; true for a constructor with a body."""
        self.decorators()
        first = self.cur
        if self.cur.text == "static" and self.ahead().text == "{":
            self.step()
            self.block()
            return
        words = ("static", "async", "get", "set", "accessor") + (("public", "private", "protected", "readonly", "abstract", "override", "declare") if self.ts else ())
        while self.cur.text in words and self.cur.kind == "id":
            nxt = self.ahead()
            if nxt.text in ("(", "=", ";", "}", ":", "?", "!", "<", ",") and nxt.kind == "op":
                break
            if nxt.nl and self.cur.text not in ("static", "public", "private", "protected", "readonly", "abstract"):
                break
            self.step()
        self.accept("*")
        if self.ts and self.at("[") and self.ahead().kind == "id" and self.ahead(2).text == ":":
            self.index_signature()
            self.end()
            return
        self.property_name()
        if self.ts:
            self.accept("?", "!")
        if self.at("(") or (self.ts and self.at("<")):
            named = self.toks[self.i - 1]
            self.signature()
            whole = self.at("{")
            self.body()
            return whole and named.text == "constructor" and named.kind == "id" and first.text != "static"
        if self.ts and self.accept(":"):
            self.type()
        if self.accept("="):
            self.assign()
        self.end()

    def decorators(self) -> None:
        while self.accept("@"):
            if self.accept("("):
                self.expression()
                self.expect(")")
            else:
                self.name()
                while self.accept("."):
                    self.name()
                if self.accept("("):
                    self.arguments()

    def property_name(self) -> None:
        if self.cur.kind in ("id", "kw", "str", "num"):
            self.step()
        elif self.accept("["):
            outer, self.no_in = self.no_in, False
            self.assign()
            self.no_in = outer
            self.expect("]")
        else:
            raise self.fail("expected a property name")

    def condition(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def s_if(self) -> None:
        self.step()
        self.condition()
        self.statement()
        if self.accept("else"):
            self.statement()

    def loop_body(self) -> None:
        self.loops += 1
        try:
            self.statement()
        finally:
            self.loops -= 1

    def s_for(self) -> None:
        self.step()
        if self.cur.text == "await":
            self.step()
        self.expect("(")
        if not self.at(";"):
            self.no_in = True
            try:
                if self.at("var", "const") or (self.cur.text == "let" and (self.ahead().kind == "id" or self.ahead().text in ("[", "{"))):
                    self.step()
                    self.declarations(head=True)
                    kind = "id"
                else:
                    kind = self.expression()
            finally:
                self.no_in = False
            if self.cur.text == "of" or self.at("in"):
                if kind not in _STRICT:
                    raise self.fail("loop over something that is no target")
                self.step()
                self.expression()
                self.expect(")")
                self.loop_body()
                return
        self.expect(";")
        if not self.at(";"):
            self.expression()
        self.expect(";")
        if not self.at(")"):
            self.expression()
        self.expect(")")
        self.loop_body()

    def s_while(self) -> None:
        self.step()
        self.condition()
        self.loop_body()

    def s_do(self) -> None:
        self.step()
        self.loop_body()
        self.expect("while")
        self.condition()
        self.accept(";")

    def s_return(self) -> None:
        t = self.step()
        if not self.functions:
            raise Problem("'return' outside a function", t.line)
        if not self.at(";", "}") and self.cur.kind != "eof" and not self.cur.nl:
            self.expression()
        self.end()

    def jump(self, where: bool) -> None:
        t = self.step()
        if self.cur.kind == "id" and not self.cur.nl:
            self.step()
        elif not where:
            raise Problem(f"{t.text!r} outside a loop", t.line)
        self.end()

    def s_break(self) -> None:
        self.jump(bool(self.loops or self.switches))

    def s_continue(self) -> None:
        self.jump(bool(self.loops))

    def s_throw(self) -> None:
        self.step()
        if self.cur.nl:
            raise self.fail("expected an expression")
        self.expression()
        self.end()

    def s_try(self) -> None:
        self.step()
        self.block()
        if self.accept("catch"):
            if self.accept("("):
                self.binding()
                if self.ts and self.accept(":"):
                    self.type()
                self.expect(")")
            self.block()
            if self.accept("finally"):
                self.block()
        else:
            self.expect("finally")
            self.block()

    def s_switch(self) -> None:
        self.step()
        self.condition()
        self.expect("{")
        self.switches += 1
        try:
            while not self.accept("}"):
                if self.accept("default"):
                    self.expect(":")
                else:
                    self.expect("case")
                    self.expression()
                    self.expect(":")
                while not self.at("case", "default", "}"):
                    if self.cur.kind == "eof":
                        raise self.fail("expected '}'")
                    self.statement()
        finally:
            self.switches -= 1

    def s_with(self) -> None:
        self.step()
        self.condition()
        self.statement()

    def s_debugger(self) -> None:
        self.step()
        self.end()

    def s_import(self) -> None:
        if self.ahead().text in ("(", "."):
            self.expression()
            self.end()
            return
        self.step()
        if self.cur.kind == "str":
            self.step()
            self.attributes()
            return
        if self.ts and self.cur.text == "type" and (self.ahead().text in ("{", "*") or (self.ahead().kind == "id" and self.ahead().text != "from")):
            self.step()
        if self.cur.kind == "id":
            self.step()
            if self.ts and self.accept("="):
                self.expression()
                self.end()
                return
            if not self.accept(","):
                self.source()
                return
        if self.accept("*"):
            self.word("as")
            self.ident()
        else:
            self.expect("{")
            self.specifiers()
        self.source()

    def word(self, w: str) -> None:
        if self.cur.text != w or self.cur.kind != "id":
            raise self.fail(f"expected {w!r}")
        self.step()

    def specifiers(self) -> None:
        def item() -> None:
            if self.ts and self.cur.text == "type" and self.ahead().kind in ("id", "kw") and self.ahead().text != "as":
                self.step()
            if self.cur.kind == "str":
                self.step()
            else:
                self.name()
            if self.cur.text == "as" and self.cur.kind == "id":
                self.step()
                if self.cur.kind == "str":
                    self.step()
                else:
                    self.name()

        self.commas("}", item)

    def source(self) -> None:
        self.word("from")
        if self.cur.kind != "str":
            raise self.fail("expected a module name")
        self.step()
        self.attributes()

    def attributes(self) -> None:
        if (self.at("with") or self.cur.text == "assert") and self.ahead().text == "{":
            self.step()
            self.object()
        self.end()

    def s_export(self) -> None:
        self.step()
        if self.accept("default"):
            if self.at("function") or (self.cur.text == "async" and self.ahead().text == "function" and not self.ahead().nl):
                self.accept("async")
                self.function(False)
            elif self.at("class", "@"):
                self.decorators()
                self.klass(False)
            elif self.ts and self.cur.text in ("abstract", "interface") and self.ts_statement():
                pass
            else:
                self.assign()
                self.end()
            return
        if self.ts:
            if self.accept("="):
                self.expression()
                self.end()
                return
            if self.at("import"):
                self.s_import()
                return
            if self.cur.text == "type" and self.ahead().text in ("{", "*"):
                self.step()
            if self.cur.text == "as" and self.ahead().text == "namespace":
                self.i += 2
                self.ident()
                self.end()
                return
        if self.accept("*"):
            if self.cur.text == "as":
                self.step()
                self.name()
            self.source()
        elif self.accept("{"):
            self.specifiers()
            if self.cur.text == "from" and self.cur.kind == "id":
                self.source()
            else:
                self.end()
        elif self.at("var", "const", "function", "class", "enum", "@") or self.cur.text in ("let", "async") or (self.ts and self.cur.text in ("interface", "type", "abstract", "namespace", "module", "declare")):
            self.statement()
        else:
            raise self.fail("expected a declaration")

    # expressions
    def expression(self) -> str:
        kind = self.assign()
        while self.accept(","):
            self.assign()
            kind = "other"
        return kind

    def arrow_body(self, awaits: bool) -> None:
        self.expect("=>")
        if self.at("{"):
            self.body(awaits)
            return
        outer, self.awaits = self.awaits, awaits
        try:
            self.assign()
        finally:
            self.awaits = outer

    def arrow(self) -> bool:
        """An arrow function, if one starts here."""
        at, awaits = self.i, False
        if self.cur.text == "async" and self.cur.kind == "id" and not self.ahead().nl and (self.ahead().kind == "id" or self.ahead().text in ("(", "<")):
            self.step()
            awaits = True
        if self.cur.kind == "id" and self.ahead().text == "=>" and not self.ahead().nl:
            self.step()
            self.arrow_body(awaits)
            return True
        if self.ts and self.at("<"):

            def generic() -> bool:
                self.type_params()
                self.expect("(")
                self.parameters()
                if self.accept(":"):
                    self.return_type()
                if not self.at("=>"):
                    raise self.fail("expected '=>'")
                return True

            if self.trying(generic):
                self.arrow_body(awaits)
                return True
        if self.at("(") and self.cur.mate is not None:
            after = self.toks[self.cur.mate + 1] if self.cur.mate + 1 < len(self.toks) else self.eof
            if after.text == "=>" and after.kind == "op":
                self.step()
                self.parameters()
                self.arrow_body(awaits)
                return True
            if self.ts and after.text == ":":

                def typed() -> bool:
                    self.step()
                    self.parameters()
                    self.expect(":")
                    self.return_type()
                    if not self.at("=>"):
                        raise self.fail("expected '=>'")
                    return True

                if self.trying(typed):
                    self.arrow_body(awaits)
                    return True
        self.i = at
        return False

    def element(self) -> str:
        """A part of a literal, which may still turn out to be a pattern."""
        self.literal = True
        return self.assign()

    def assign(self) -> str:
        literal, self.literal = self.literal, False
        if self.cur.text == "yield" and self.cur.kind == "id" and self.functions and not self.ahead().text in ("=", ".", "=>"):
            self.step()
            self.accept("*")
            if not self.cur.nl and not self.at(")", "]", "}", ",", ";", ":") and self.cur.kind != "eof":
                self.assign()
            return "other"
        if self.arrow():
            return "other"
        kind = self.conditional()
        op = self.operator()
        if op in _ASSIGN:
            if kind not in _STRICT or (kind in ("pattern", "cover") and op != "="):
                raise self.fail("assignment to something that is no target")
            self.skip_operator(op)
            self.assign()
            return "other"
        if kind == "cover" and not literal and self.cur.text not in ("of", "in"):
            raise self.fail("default in a literal that is no pattern")
        return kind

    def conditional(self) -> str:
        kind = self.binary(1)
        if self.at("?"):
            self.step()
            outer, self.no_in = self.no_in, False
            self.assign()
            self.no_in = outer
            self.expect(":")
            self.assign()
            return "other"
        return kind

    def binary(self, least: int) -> str:
        if self.cur.kind == "id" and self.cur.text.startswith("#") and self.ahead().text == "in":
            self.step()
            kind = "other"
        else:
            kind = self.unary()
        while True:
            op = self.operator()
            power = _BINARY.get(op, 0)
            if power < least or not power or (op == "in" and self.no_in):
                return kind
            if op in ("as", "satisfies"):
                if not self.ts or self.cur.nl:
                    return kind
                self.step()
                if not self.accept("const"):
                    self.type()
                kind = "member" if kind in _STRICT else "other"
                continue
            self.skip_operator(op)
            self.binary(power if op == "**" else power + 1)
            kind = "other"

    def unary(self) -> str:
        t = self.cur
        if (t.kind == "op" and t.text in ("+", "-", "!", "~")) or (t.kind == "kw" and t.text in ("typeof", "void", "delete")):
            self.step()
            self.unary()
            return "other"
        if t.kind == "op" and t.text in ("++", "--"):
            self.step()
            if self.unary() not in ("id", "member"):
                raise self.fail("step of something that is no target")
            return "other"
        if t.kind == "id" and t.text == "await" and self.awaits:
            self.step()
            self.unary()
            return "other"
        if t.kind == "id" and t.text == "await" and not self.ahead().nl and (self.ahead().kind in ("id", "num", "str", "tpl", "re") or (self.ahead().kind == "kw" and self.ahead().text not in ("in", "instanceof")) or self.ahead().text in ("(", "[", "{", "!", "+", "-", "~")):
            self.step()
            self.unary()
            return "other"
        if self.ts and self.at("<"):

            def cast() -> bool:
                self.step()
                self.type()
                self.expect(">")
                self.unary()
                return True

            if self.trying(cast):
                return "other"
        kind = self.unary_postfix()
        if self.at("++", "--") and not self.cur.nl:
            if kind not in ("id", "member"):
                raise self.fail("step of something that is no target")
            self.step()
            return "other"
        return kind

    def unary_postfix(self) -> str:
        kind = self.new() if self.at("new") else self.primary()
        return self.postfix(kind, True)

    def postfix(self, kind: str, calls: bool) -> str:
        if kind == "cover" and self.at(".", "?.", "[", "("):
            raise self.fail("default in a literal that is no pattern")
        while True:
            if self.accept("."):
                self.name()
                kind = "member"
            elif self.at("?.") and calls:
                self.step()
                if self.accept("("):
                    self.arguments()
                elif self.accept("["):
                    self.inside("]")
                elif self.cur.kind != "tpl":
                    self.name()
                kind = "call"
                while self.at(".", "[", "(", "!"):
                    if self.accept("."):
                        self.name()
                    elif self.accept("["):
                        self.inside("]")
                    elif self.accept("("):
                        self.arguments()
                    elif self.ts and not self.cur.nl and self.at("!"):
                        self.step()
                    else:
                        break
            elif self.accept("["):
                self.inside("]")
                kind = "member"
            elif self.at("(") and calls:
                self.step()
                self.arguments()
                kind = "call"
            elif self.cur.kind == "tpl":
                self.step()
                kind = "call"
            elif self.ts and self.at("!") and not self.cur.nl:
                self.step()
                kind = kind if kind in ("id", "member") else "other"
            elif self.ts and calls and self.at("<") and self.trying(self.call_types):
                kind = "call" if not self.at("(") else kind
            else:
                return kind

    def call_types(self) -> bool:
        self.type_args()
        if not (self.at("(", ")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "}", "&&", "||", "??") or self.cur.kind in ("tpl", "eof") or self.cur.nl):
            raise self.fail("expected '('")
        return True

    def inside(self, close: str) -> None:
        outer, self.no_in = self.no_in, False
        self.expression()
        self.no_in = outer
        self.expect(close)

    def arguments(self) -> None:
        outer, self.no_in = self.no_in, False

        def item() -> None:
            self.accept("...")
            self.assign()

        self.commas(")", item)
        self.no_in = outer

    def new(self) -> str:
        self.expect("new")
        if self.accept("."):
            self.name()
            return "other"
        kind = self.new() if self.at("new") else self.primary()
        self.postfix(kind, False)
        if self.ts and self.at("<"):
            self.trying(self.type_args)
        if self.accept("("):
            self.arguments()
        return "call"

    def primary(self) -> str:
        t = self.cur
        if t.kind == "id":
            if t.text == "async" and self.ahead().text == "function" and not self.ahead().nl:
                self.step()
                self.function(False)
                return "other"
            self.step()
            return "member" if t.text.startswith("#") else "id"
        if t.kind in ("num", "str", "tpl", "re"):
            self.step()
            return "other"
        if t.kind == "kw":
            if t.text in ("this", "null", "true", "false"):
                self.step()
                return "other"
            if t.text == "super":
                self.step()
                if not self.at("(", ".", "["):
                    raise self.fail("expected '(' after super")
                return "other"
            if t.text == "function":
                self.function(False)
                return "other"
            if t.text == "class":
                self.klass(False)
                return "other"
            if t.text == "import":
                self.step()
                if self.accept("."):
                    self.name()
                else:
                    self.expect("(")
                    self.arguments()
                return "other"
        if t.kind == "op":
            if t.text == "(":
                self.step()
                outer, self.no_in = self.no_in, False
                kind = self.expression()
                self.no_in = outer
                self.expect(")")
                return kind if kind in ("id", "member") else "other"
            if t.text == "[":
                return self.array()
            if t.text == "{":
                return self.object()
            if t.text == "@":
                self.decorators()
                self.klass(False)
                return "other"
        raise self.fail("expected an expression")

    def array(self) -> str:
        self.step()
        outer, self.no_in = self.no_in, False
        kind = "pattern"
        while not self.at("]"):
            if self.accept(","):
                continue
            self.accept("...")
            if self.element() == "cover":
                kind = "cover"
            if not self.at("]"):
                self.expect(",")
        self.step()
        self.no_in = outer
        return kind

    def object(self) -> str:
        self.expect("{")
        outer, self.no_in = self.no_in, False
        kinds = set()

        def item() -> None:
            if self.accept("..."):
                kinds.add(self.element())
                return
            while self.cur.text in ("async", "get", "set") and self.cur.kind == "id" and not (self.ahead().kind == "op" and self.ahead().text in ("(", ",", ":", "}", "=", "<")):
                self.step()
            star = self.accept("*")
            short = self.cur.kind == "id"
            self.property_name()
            if self.at("(") or (self.ts and self.at("<")):
                self.signature()
                if not self.at("{"):
                    raise self.fail("expected '{'")
                self.body()
            elif self.accept(":") and not star:
                kinds.add(self.element())
            elif short and not star and self.accept("="):
                self.assign()
                kinds.add("cover")
            elif not short or star:
                raise self.fail("expected ':'")

        self.commas("}", item)
        self.no_in = outer
        return "cover" if "cover" in kinds else "pattern"

    # types
    def type_params(self) -> None:
        if not self.ts or not self.at("<"):
            return
        self.step()
        while not self.at(">"):
            while self.cur.text in ("const", "in", "out") and self.ahead().kind == "id":
                self.step()
            self.ident()
            if self.accept("extends"):
                self.type()
            if self.accept("="):
                self.type()
            if not self.accept(","):
                break
        self.expect(">")

    def type_args(self) -> bool:
        self.expect("<")
        while not self.at(">"):
            self.type()
            if not self.accept(","):
                break
        self.expect(">")
        return True

    def return_type(self) -> None:
        if self.cur.text == "asserts" and self.ahead().kind in ("id", "kw") and not self.ahead().nl and self.ahead().text not in ("is",):
            self.step()
            self.step()
            if self.cur.text == "is":
                self.step()
                self.type()
            return
        if (self.cur.kind == "id" or self.at("this")) and self.ahead().text == "is" and self.ahead().kind == "id" and not self.ahead().nl:
            self.i += 2
        self.type()

    def type(self) -> None:
        if self.function_type():
            return
        self.union()
        if self.at("extends") and not self.cur.nl:
            at = self.i
            self.step()
            if self.trying(self.conditional_type) is None:
                self.i = at

    def conditional_type(self) -> bool:
        if not self.function_type():
            self.union()
        self.expect("?")
        self.type()
        self.expect(":")
        self.type()
        return True

    def function_type(self) -> bool:
        def read() -> bool:
            if self.cur.text == "abstract":
                self.step()
            self.accept("new")
            self.type_params()
            self.expect("(")
            self.parameters()
            self.expect("=>")
            self.return_type()
            return True

        if self.at("<", "new") or (self.cur.text == "abstract" and self.ahead().text == "new"):
            return bool(self.trying(read))
        if self.at("(") and self.cur.mate is not None and self.cur.mate + 1 < len(self.toks) and self.toks[self.cur.mate + 1].text == "=>":
            return read()
        return False

    def union(self) -> None:
        self.accept("|", "&")
        self.type_operator()
        while self.accept("|", "&"):
            if not self.function_type():
                self.type_operator()

    def type_operator(self) -> None:
        while self.cur.text in ("keyof", "readonly", "unique", "infer") and self.cur.kind == "id" and (self.ahead().kind in ("id", "kw", "str", "num", "tpl") or self.ahead().text in ("(", "[", "{")):
            infer = self.step().text == "infer"
            if infer:
                self.ident()
                if self.at("extends"):
                    at = self.i
                    self.step()
                    if self.trying(self.infer_bound) is None:
                        self.i = at
                return
        self.postfix_type()

    def infer_bound(self) -> bool:
        self.type_operator()
        if self.at("?"):
            raise self.fail("conditional type")
        return True

    def postfix_type(self) -> None:
        t = self.cur
        if t.kind in ("str", "num", "tpl") or self.at("this", "null", "true", "false", "void"):
            self.step()
        elif self.accept("-"):
            if self.cur.kind != "num":
                raise self.fail("expected a number")
            self.step()
        elif self.accept("typeof"):
            if self.at("import"):
                self.import_type()
            else:
                self.name()
            while self.accept("."):
                self.name()
            if self.at("<") and not self.cur.nl:
                self.trying(self.type_args)
        elif self.at("import"):
            self.import_type()
        elif t.kind == "id":
            self.step()
            while self.accept("."):
                self.name()
            if self.at("<") and not self.cur.nl:
                self.type_args()
        elif self.accept("("):
            self.type()
            self.expect(")")
        elif self.accept("["):

            def item() -> None:
                self.accept("...")
                if self.cur.kind in ("id", "kw") and self.ahead().text == ":":
                    self.i += 2
                elif self.cur.kind in ("id", "kw") and self.ahead().text == "?" and self.ahead(2).text == ":":
                    self.i += 3
                self.type()
                self.accept("?")

            self.commas("]", item)
        elif self.at("{"):
            self.object_type()
        else:
            raise self.fail("expected a type")
        while self.at("[") and not self.cur.nl:
            self.step()
            if not self.accept("]"):
                self.type()
                self.expect("]")

    def import_type(self) -> None:
        self.step()
        self.expect("(")
        self.type()
        if self.accept(","):
            self.object()
        self.expect(")")
        while self.accept("."):
            self.name()
        if self.at("<"):
            self.type_args()

    def index_signature(self) -> None:
        self.expect("[")
        self.ident()
        self.expect(":")
        self.type()
        self.expect("]")
        self.expect(":")
        self.type()

    def object_type(self) -> None:
        self.expect("{")
        while not self.at("}"):
            if self.cur.kind == "eof":
                raise self.fail("expected '}'")
            self.type_member()
            if not self.accept(";", ",") and not self.at("}") and not self.cur.nl:
                raise self.fail("expected ';'")
        self.step()

    def type_member(self) -> None:
        if self.at("+", "-"):
            self.step()
        while self.cur.text in ("readonly", "get", "set", "static") and not (self.ahead().kind == "op" and self.ahead().text in (":", "?", "(", "<", ";", ",", "}")):
            self.step()
        if self.at("(", "<"):
            self.signature()
            return
        if self.at("new") and self.ahead().text in ("(", "<"):
            self.step()
            self.signature()
            return
        if self.at("["):
            if self.ahead().kind == "id" and self.ahead(2).text == ":":
                self.index_signature()
                return
            if self.ahead().kind == "id" and self.ahead(2).text == "in":
                self.i += 3
                self.type()
                if self.cur.text == "as":
                    self.step()
                    self.type()
                self.expect("]")
                self.accept("+", "-")
                self.accept("?")
                if self.accept(":"):
                    self.type()
                return
        self.property_name()
        self.accept("?")
        if self.at("(", "<"):
            self.signature()
        elif self.accept(":"):
            self.type()


def _parse(text: str, typed: bool) -> None:
    try:
        toks = tokenize(text)
        p = _Script(toks, text.count("\n") + 1, typed)
        p.program()
        p.finish()
    except Problem:
        if line := conflict_marker(text):
            raise Problem("leftover merge-conflict marker", line) from None
        raise


def parse_javascript(text: str) -> None:
    _parse(text, False)


def parse_typescript(text: str) -> None:
    _parse(text, True)
