"""Python 3: indentation, statements and expressions."""

from __future__ import annotations

import re

from graftline.llm.syntax.base import Cursor, Problem, Token, conflict_marker

KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_STR = r"(?:[rR][bB]?|[bB][rR]?|[uU])?"
_PLAIN = re.compile(
    r"(?P<ws>[ \t\f]+|\\\r?\n)|(?P<com>\#[^\n]*)|(?P<nl>\r?\n|\r)"
    r"|(?P<fstr>(?:[fFtT][rR]?|[rR][fFtT])(?:\"\"\"|'''|\"|'))"
    r"|(?P<str>" + _STR + r"(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\(?:\r\n|.)|[^\"\\\n])*\"|'(?:\\(?:\r\n|.)|[^'\\\n])*'))"
    r"|(?P<err_string_without_end>" + _STR + r"[\"'])"
    r"|(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    r"|(?P<id>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^]=|[-+*/%@&|^~<>=(){}\[\],:.;])", re.S)  # fmt: skip


def _fstring(text: str, i: int, line: int) -> int:
    """End of the f-string that starts at ``i``; its expressions are parsed."""
    m = re.compile(r"([A-Za-z]+)(\"\"\"|'''|\"|')").match(text, i)
    raw, quote = "r" in m[1].lower(), m[2]
    j = m.end()

    def body(j: int, spec: bool) -> int:
        while j < len(text):
            c = text[j]
            if not spec and text.startswith(quote, j):
                return j
            if spec and c == "}":
                return j
            if c == "\\" and not raw:
                if text.startswith("\\N{", j):
                    j = text.find("}", j) + 1 or len(text)
                else:
                    j += 2
            elif c == "\n" and len(quote) == 1:
                break
            elif c == "{" and not (text.startswith("{{", j) and not spec):
                j = field(j + 1)
            elif c == "{":
                j += 2
            elif c == "}" and text.startswith("}}", j):
                j += 2
            elif c == "}":
                raise Problem("single '}' in an f-string", line)
            else:
                j += 1
        raise Problem("string without end", line)

    def field(j: int) -> int:
        start, depth = j, 0
        while j < len(text):
            c = text[j]
            if c in "([{":
                depth += 1
            elif c in ")]}" and depth:
                depth -= 1
            elif not depth and (c in "}:" or (c == "!" and text[j + 1 : j + 2] != "=")):
                break
            if c in "\"'" and not text.startswith(quote, j):
                q = c * 3 if text.startswith(c * 3, j) else c
                k = text.find(q, j + len(q))
                if k < 0:
                    raise Problem("string without end", line)
                j = k + len(q)
                continue
            if c == "\n" and len(quote) == 1 and not depth:
                break
            if text.startswith(quote, j) and not depth and len(quote) == 1:
                break
            j += 1
        inner = text[start:j].strip()
        inner = re.sub(r"(?<![=!<>])=$", "", inner)
        if not inner:
            raise Problem("empty expression in an f-string", line)
        p = _Python([t for t in tokenize("(" + inner + ")") if t.kind != "nl"], line)
        p.lambda_ok = True
        try:
            p.paren()
        except Problem as e:
            raise Problem(e.cause, line) from None
        if p.cur.kind != "eof":
            raise Problem("expression in an f-string that does not end", line)
        if text[j : j + 1] == "!":
            m = re.compile(r"![rsa]\s*").match(text, j)
            if not m:
                raise Problem("unknown conversion in an f-string", line)
            j = m.end()
        if text[j : j + 1] == ":":
            j = body(j + 1, True)
        if text[j : j + 1] != "}":
            raise Problem("expected '}' in an f-string", line)
        return j + 1

    return body(j, False) + len(quote)


def tokenize(text: str) -> list[Token]:
    """Tokens with nl, indent and dedent, as the language reference has them."""
    out: list[Token] = []
    brackets: list[tuple[str, int]] = []
    levels, alts = [0], [0]
    i, line, n, fresh = 0, 1, len(text), True
    while i < n:
        if fresh and not brackets:
            m = re.compile(r"[ \t\f]*").match(text, i)
            j = m.end()
            if j >= n or text[j] in "#\r\n" or re.compile(r"\\\r?\n").match(text, j):
                i = j
                fresh = not (j < n and text[j] == "\\")
            else:
                col = alt = 0
                for c in m[0]:
                    col = 0 if c == "\f" else col // 8 * 8 + 8 if c == "\t" else col + 1
                    alt = 0 if c == "\f" else alt + 1
                known = [a for level, a in zip(levels, alts) if level == col]
                if (col > levels[-1] and alt <= alts[-1]) or (known and known[0] != alt):
                    raise Problem("tabs and blanks mixed in the indentation", line)
                if col > levels[-1]:
                    levels.append(col)
                    alts.append(alt)
                    out.append(Token("indent", "", line, True, j))
                while col < levels[-1]:
                    levels.pop()
                    alts.pop()
                    out.append(Token("dedent", "", line, True, j))
                if col != levels[-1]:
                    raise Problem("dedent that matches no outer level", line)
                i, fresh = j, False
            if i >= n:
                break
        m = _PLAIN.match(text, i)
        if not m:
            raise Problem(f"character that starts no token: {text[i]!r}", line)
        kind, s = m.lastgroup, m[0]
        if kind.startswith("err_"):
            raise Problem("string without end", line)
        if kind == "fstr":
            j = _fstring(text, i, line)
            out.append(Token("str", text[i:j], line, False, i))
            line += text.count("\n", i, j)
            i = j
            continue
        if kind == "nl":
            if not brackets:
                if out and out[-1].kind not in ("nl", "indent", "dedent"):
                    out.append(Token("nl", "", line, False, i))
                fresh = True
        elif kind not in ("ws", "com"):
            if kind == "num" and re.compile(r"\w").match(text, m.end()) and not re.compile(r"(and|or|if|else|in|is|for|not)\b").match(text, m.end()):
                raise Problem("number that runs into a name", line)
            if kind == "num" and re.fullmatch(r"0\d*[1-9]\d*", s):
                raise Problem("number with a leading zero", line)
            if s in "([{" and kind == "op":
                brackets.append((s, line))
            elif s in ")]}" and kind == "op":
                if not brackets or {"(": ")", "[": "]", "{": "}"}[brackets[-1][0]] != s:
                    raise Problem(f"{s!r} that was not opened", line)
                brackets.pop()
            out.append(Token("kw" if kind == "id" and s in KEYWORDS else kind, s, line, False, i))
        line += s.count("\n")
        i = m.end()
    if brackets:
        raise Problem(f"{brackets[-1][0]!r} that is never closed", brackets[-1][1])
    if out and out[-1].kind not in ("nl", "dedent"):
        out.append(Token("nl", "", line, False, n))
    out += [Token("dedent", "", line, True, n) for _ in levels[1:]]
    return out


#: binary operators by binding power
_BINARY = {"|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}
_AUGMENTED = ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=")


class _Python(Cursor):
    def __init__(self, tokens: list[Token], last: int):
        super().__init__(tokens, last)
        self.functions, self.loops = 0, 0

    def module(self) -> None:
        self.recovering(self.statement)

    def panic(self, at: int) -> None:
        if self.i == at:
            self.i += 1
        while self.cur.kind not in ("eof", "nl"):
            self.i += 1
        while self.cur.kind in ("nl", "dedent"):
            self.i += 1
        if self.cur.kind == "indent":
            depth = 0
            while self.cur.kind != "eof":
                depth += {"indent": 1, "dedent": -1}.get(self.cur.kind, 0)
                self.i += 1
                if not depth:
                    break

    # statements
    def statement(self) -> None:
        t = self.cur
        if t.kind == "indent":
            raise Problem("unexpected indent", t.line)
        if t.kind == "dedent":
            self.step()
            return
        if self.at("@"):
            while self.accept("@"):
                self.named()
                self.newline()
            if not self.at("def", "class", "async"):
                raise self.fail("expected a definition after a decorator")
        f = getattr(self, "s_" + self.cur.text, None) if self.cur.kind == "kw" else None
        if f:
            f()
        elif self.cur.kind == "id" and self.cur.text == "match" and self.trying(self.match_head):
            self.match_body()
        else:
            self.simple()

    def newline(self) -> None:
        if self.cur.kind == "nl":
            self.step()
        elif self.cur.kind != "eof":
            raise self.fail("expected the end of the line")

    def suite(self) -> None:
        self.expect(":")
        if self.cur.kind != "nl":
            self.simple()
            return
        self.step()
        if self.cur.kind != "indent":
            raise self.fail("expected an indented block")
        self.step()
        while self.cur.kind not in ("dedent", "eof"):
            self.statement()
        if self.cur.kind == "dedent":
            self.step()

    def simple(self) -> None:
        while True:
            self.small()
            if not self.accept(";"):
                break
            if self.cur.kind == "nl":
                break
        self.newline()

    def s_if(self) -> None:
        self.step()
        self.named()
        self.suite()
        while self.accept("elif"):
            self.named()
            self.suite()
        if self.accept("else"):
            self.suite()

    def loop(self) -> None:
        self.loops += 1
        try:
            self.suite()
        finally:
            self.loops -= 1
        if self.accept("else"):
            self.suite()

    def s_while(self) -> None:
        self.step()
        self.named()
        self.loop()

    def s_for(self) -> None:
        self.step()
        self.targets()
        self.expect("in")
        self.star_exprs()
        self.loop()

    def s_try(self) -> None:
        self.step()
        self.suite()
        n = 0
        while self.accept("except"):
            n += 1
            self.accept("*")
            if not self.at(":"):
                self.expr()
                while self.accept(","):
                    self.expr()
                if self.accept("as"):
                    self.ident()
            self.suite()
        if n and self.accept("else"):
            self.suite()
        if self.accept("finally"):
            self.suite()
        elif not n:
            raise self.fail("expected 'except' or 'finally'")

    def s_with(self) -> None:
        self.step()
        if not (self.at("(") and self.trying(self.with_paren)):
            self.with_item()
            while self.accept(","):
                self.with_item()
        self.suite()

    def with_paren(self) -> bool:
        self.expect("(")
        self.commas(")", self.with_item)
        if not self.at(":"):
            raise self.fail("expected ':'")
        return True

    def with_item(self) -> None:
        self.expr()
        if self.accept("as"):
            self.target(self.star_or_expr())

    def s_async(self) -> None:
        self.step()
        if not self.at("def", "for", "with"):
            raise self.fail("expected 'def', 'for' or 'with'")
        getattr(self, "s_" + self.cur.text)()

    def type_params(self) -> None:
        if self.accept("["):

            def one() -> None:
                self.accept("*", "**")
                self.ident()
                if self.accept(":"):
                    self.expr()
                if self.accept("="):
                    self.star_or_expr()

            self.commas("]", one)

    def s_def(self) -> None:
        self.step()
        self.ident()
        self.type_params()
        self.expect("(")
        self.parameters(")", True)
        if self.accept("->"):
            self.star_exprs()
        outer, self.loops = self.loops, 0
        self.functions += 1
        try:
            self.suite()
        finally:
            self.functions -= 1
            self.loops = outer

    def parameters(self, close: str, typed: bool) -> None:
        star = default = kwargs = False
        names: set[str] = set()

        def name() -> None:
            t = self.ident()
            if t.text in names:
                raise Problem(f"parameter {t.text!r} twice", t.line)
            names.add(t.text)
            if typed and self.accept(":"):
                self.star_or_expr()

        while not self.at(close):
            if kwargs:
                raise self.fail("parameter after **")
            if self.accept("**"):
                name()
                kwargs = True
            elif self.accept("*"):
                if star:
                    raise self.fail("second * in the parameters")
                star = True
                if not self.at(","):
                    name()
                elif self.ahead().text == close:
                    raise self.fail("expected a parameter after *")
            elif self.accept("/"):
                if star or not names:
                    raise self.fail("misplaced / in the parameters")
            else:
                name()
                if self.accept("="):
                    self.expr()
                    default = True
                elif default and not star:
                    raise self.fail("parameter without a default after one with it")
            if not self.accept(","):
                break
        self.expect(close)

    def s_class(self) -> None:
        self.step()
        self.ident()
        self.type_params()
        if self.accept("("):
            self.arguments()
        outer, self.functions, loops, self.loops = self.functions, 0, self.loops, 0
        try:
            self.suite()
        finally:
            self.functions, self.loops = outer, loops

    def match_head(self) -> bool:
        self.step()
        self.star_exprs()
        self.expect(":")
        if self.cur.kind != "nl" or self.ahead().kind != "indent" or self.ahead(2).text != "case":
            raise self.fail("expected a case")
        self.i += 2
        return True

    def match_body(self) -> None:
        while self.cur.kind != "dedent" and self.cur.kind != "eof":
            self.expect("case")
            self.patterns()
            if self.accept("if"):
                self.named()
            self.suite()
        if self.cur.kind == "dedent":
            self.step()

    def patterns(self) -> None:
        self.pattern()
        while self.accept(","):
            if self.at(":", "if"):
                break
            self.pattern()

    def pattern(self) -> None:
        if self.accept("*"):
            self.ident()
            return
        self.closed()
        while self.accept("|"):
            self.closed()
        if self.accept("as"):
            self.ident()

    def closed(self) -> None:
        t = self.cur
        if t.kind in ("num", "str") or self.at("-"):
            self.accept("-")
            if self.cur.kind not in ("num", "str"):
                raise self.fail("expected a number")
            while self.cur.kind in ("num", "str"):
                self.step()
            if self.accept("+", "-"):
                self.step()
        elif self.at("None", "True", "False"):
            self.step()
        elif self.accept("("):
            self.commas(")", self.pattern)
        elif self.accept("["):
            self.commas("]", self.pattern)
        elif self.accept("{"):

            def item() -> None:
                if self.accept("**"):
                    self.ident()
                    return
                self.closed()
                self.expect(":")
                self.pattern()

            self.commas("}", item)
        else:
            self.ident()
            while self.accept("."):
                self.ident()
            if self.accept("("):

                def arg() -> None:
                    if self.cur.kind == "id" and self.ahead().text == "=":
                        self.step()
                        self.step()
                    self.pattern()

                self.commas(")", arg)

    def small(self) -> None:
        t = self.cur
        if t.kind == "kw":
            if t.text in ("pass",):
                self.step()
                return
            if t.text in ("break", "continue"):
                self.step()
                if not self.loops:
                    raise Problem(f"{t.text!r} outside a loop", t.line)
                return
            if t.text == "return":
                self.step()
                if not self.functions:
                    raise Problem("'return' outside a function", t.line)
                if not self.at(";") and self.cur.kind not in ("nl", "eof"):
                    self.star_exprs()
                return
            if t.text == "raise":
                self.step()
                if not self.at(";") and self.cur.kind not in ("nl", "eof"):
                    self.expr()
                    if self.accept("from"):
                        self.expr()
                return
            if t.text in ("global", "nonlocal"):
                self.step()
                self.ident()
                while self.accept(","):
                    self.ident()
                return
            if t.text == "del":
                self.step()
                self.targets()
                return
            if t.text == "assert":
                self.step()
                self.expr()
                if self.accept(","):
                    self.expr()
                return
            if t.text == "import":
                self.step()
                self.dotted_as()
                while self.accept(","):
                    self.dotted_as()
                return
            if t.text == "from":
                self.from_import()
                return
        if t.kind == "id" and t.text == "type" and self.ahead().kind == "id":
            self.step()
            self.ident()
            self.type_params()
            self.expect("=")
            self.expr()
            return
        kind = self.star_exprs()
        if self.at(":") :
            if kind not in ("name", "member", "paren"):
                raise self.fail("annotation of something that is no target")
            self.step()
            self.expr()
            if self.accept("="):
                self.assigned()
        elif self.at(*_AUGMENTED):
            if kind not in ("name", "member", "paren"):
                raise self.fail("assignment to something that is no target")
            self.step()
            self.assigned()
        else:
            while self.at("="):
                self.target(kind)
                self.step()
                kind = self.assigned()

    def assigned(self) -> str:
        return self.yields() if self.at("yield") else self.star_exprs()

    def dotted_as(self) -> None:
        self.ident()
        while self.accept("."):
            self.ident()
        if self.accept("as"):
            self.ident()

    def from_import(self) -> None:
        self.step()
        dots = 0
        while self.accept(".", "..."):
            dots += 1
        if not self.at("import") or not dots:
            self.ident()
            while self.accept("."):
                self.ident()
        self.expect("import")
        if self.accept("*"):
            return

        def name() -> None:
            self.ident()
            if self.accept("as"):
                self.ident()

        if self.accept("("):
            if self.at(")"):
                raise self.fail("expected a name")
            self.commas(")", name)
        else:
            name()
            while self.accept(","):
                name()

    # targets
    def targets(self) -> None:
        """Targets of for and del: no comparison with ``in`` may be read."""
        while True:
            self.accept("*")
            self.target(self.binary(5))
            if not self.accept(","):
                return
            if self.at("in", ")", "]") or self.cur.kind == "nl":
                return

    def target(self, kind: str) -> None:
        if kind in ("name", "member", "paren", "list", "tuple", "star"):
            return
        raise self.fail("assignment to something that is no target")

    # expressions
    def star_exprs(self) -> str:
        kind = self.star_or_named()
        if self.at(","):
            while self.accept(","):
                if not self.starts():
                    break
                self.star_or_named()
            return "tuple" if True else kind
        return kind

    def starts(self) -> bool:
        t = self.cur
        return t.kind in ("id", "num", "str") or (t.kind == "op" and t.text in ("(", "[", "{", "-", "+", "~", "*", "...")) or (t.kind == "kw" and t.text in ("not", "lambda", "None", "True", "False", "await", "yield"))

    def star_or_named(self) -> str:
        if self.at("yield"):
            return self.yields()
        if self.accept("*"):
            self.binary(5)
            return "star"
        return self.named()

    def star_or_expr(self) -> str:
        if self.accept("*"):
            self.binary(5)
            return "star"
        return self.expr()

    def named(self) -> str:
        if self.cur.kind == "id" and self.ahead().text == ":=":
            self.step()
            self.step()
            self.expr()
            return "other"
        return self.expr()

    def yields(self) -> str:
        self.expect("yield")
        if self.accept("from"):
            self.expr()
        elif self.starts():
            self.star_exprs()
        return "other"

    def expr(self) -> str:
        if self.accept("lambda"):
            self.parameters(":", False)
            self.expr()
            return "other"
        kind = self.either()
        if self.accept("if"):
            self.either()
            self.expect("else")
            self.expr()
            return "other"
        return kind

    def either(self) -> str:
        """or, and, not and comparisons, then the binary operators."""
        kind = self.negation()
        while self.accept("or", "and"):
            self.negation()
            kind = "other"
        return kind

    def negation(self) -> str:
        if self.accept("not"):
            self.negation()
            return "other"
        kind = self.binary(5)
        while True:
            if self.accept("<", ">", "==", ">=", "<=", "!=", "in"):
                pass
            elif self.at("not") and self.ahead().text == "in":
                self.i += 2
            elif self.accept("is"):
                self.accept("not")
            else:
                return kind
            self.binary(5)
            kind = "other"

    def binary(self, least: int) -> str:
        kind = self.unary()
        while self.cur.kind == "op" and (power := _BINARY.get(self.cur.text, 0)) >= least:
            self.step()
            self.binary(power + 1)
            kind = "other"
        return kind

    def unary(self) -> str:
        if self.accept("-", "+", "~"):
            self.unary()
            return "other"
        waits = self.accept("await")
        kind = self.primary()
        if self.accept("**"):
            self.unary()
            return "other"
        return "other" if waits else kind

    def primary(self) -> str:
        kind = self.atom()
        while True:
            if self.accept("."):
                self.ident()
                kind = "member"
            elif self.accept("("):
                self.arguments()
                kind = "call"
            elif self.accept("["):
                if self.at("]"):
                    raise self.fail("expected an index")
                self.commas("]", self.subscript)
                kind = "member"
            else:
                return kind

    def subscript(self) -> None:
        if not self.at(":"):
            self.star_or_named()
        while self.accept(":"):
            if not self.at(":", ",", "]"):
                self.expr()

    def arguments(self) -> None:
        keyword = unpacked = False
        while not self.at(")"):
            if self.accept("**"):
                self.expr()
                unpacked = True
            elif self.accept("*"):
                self.expr()
                if unpacked:
                    raise self.fail("unpacked argument after **")
            elif self.cur.kind == "id" and self.ahead().text == "=":
                self.i += 2
                self.expr()
                keyword = True
            else:
                self.named()
                if self.at("for", "async"):
                    self.comprehension()
                elif keyword or unpacked:
                    raise self.fail("positional argument after a keyword argument")
            if not self.accept(","):
                break
        self.expect(")")

    def comprehension(self) -> None:
        while self.at("for", "async"):
            self.accept("async")
            self.expect("for")
            self.targets()
            self.expect("in")
            self.either()
            while self.accept("if"):
                self.either() if not (self.cur.kind == "id" and self.ahead().text == ":=") else self.named()

    def paren(self) -> str:
        self.expect("(")
        if self.accept(")"):
            return "tuple"
        kind = self.star_or_named()
        if self.at("for", "async"):
            self.comprehension()
            self.expect(")")
            return "other"
        if self.at(","):
            while self.accept(","):
                if self.at(")"):
                    break
                self.star_or_named()
            kind = "tuple"
        self.expect(")")
        return {"name": "paren", "member": "paren", "tuple": "tuple", "list": "list", "paren": "paren"}.get(kind, "other")

    def atom(self) -> str:
        t = self.cur
        if t.kind == "id":
            self.step()
            return "name"
        if t.kind == "num":
            self.step()
            return "other"
        if t.kind == "str":
            while self.cur.kind == "str":
                self.step()
            return "other"
        if t.kind == "kw" and t.text in ("None", "True", "False"):
            self.step()
            return "other"
        if t.kind == "op":
            if t.text == "...":
                self.step()
                return "other"
            if t.text == "(":
                return self.paren()
            if t.text == "[":
                self.step()
                if self.accept("]"):
                    return "list"
                self.star_or_named()
                if self.at("for", "async"):
                    self.comprehension()
                    self.expect("]")
                    return "other"
                if self.accept(","):
                    self.commas("]", self.star_or_named)
                else:
                    self.expect("]")
                return "list"
            if t.text == "{":
                self.braces()
                return "other"
        raise self.fail("expected an expression")

    def braces(self) -> None:
        self.step()
        if self.accept("}"):
            return
        first = True
        pairs = None
        while not self.at("}"):
            star = self.accept("*", "**")
            if star:
                self.binary(5)
                pair = star.text == "**"
            else:
                self.named()
                pair = bool(self.accept(":"))
                if pair:
                    self.expr()
            if pairs is not None and pair != pairs:
                raise self.fail("pairs and single items in one display")
            pairs = pair
            if first and self.at("for", "async"):
                if star:
                    raise self.fail("unpacking in a comprehension")
                self.comprehension()
                break
            first = False
            if not self.accept(","):
                break
        self.expect("}")


def parse_python(text: str) -> None:
    if text.startswith("﻿"):
        text = text[1:]
    try:
        toks = tokenize(text)
    except Problem:
        #: a marker explains an error; by itself, inside a string, it is none
        if line := conflict_marker(text):
            raise Problem("leftover merge-conflict marker", line) from None
        raise
    p = _Python(toks, text.count("\n") + 1)
    p.module()
    p.finish()
