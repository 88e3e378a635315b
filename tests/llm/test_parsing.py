"""The parsers accept valid code and reject broken code of each language."""

import glob
import os
import sys
import warnings
from datetime import datetime

import pytest

from graftline.llm import parsing, syntax

VALID = {
    "python": ["", "# only\n", "x = 1 if y else 2\n", "async def f(a, /, b: int = 1, *c, d=2, **e) -> None:\n    async with a as b, c:\n        await d\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': A(b=c)} | None: pass\n", "a: list[int] = [i for i in (1, 2) if i]\n", "print(f'{x!r:>{w}} {y=}')\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise\nfinally: pass\n", "@d\nclass C[T](B, k=1):\n    x = lambda *a, b=1: (yield)\n", "with (open(a) as b, c): pass\n", "x = [\n  1, # }\n]\n", "def f():\n\treturn '''\n<<<<<<< HEAD\n'''\n"],
    "javascript": ["", "/* ] */ export default class extends A { static #x = 1; get y() { return this.#x ?? 2; } *g() { yield* h(); } }", "const {a, b: [c = 1], ...d} = await e;", "for (const [k, v] of m) { if (/[/]\"x/.test(k)) continue; }", "let f = async (a, {b}) => ({...a, [b]: `${a + `${b}`}`});", "label: while (true) { break label }", "import a, {b as c} from 'x'; export * as d from 'y';", "x = a ? b : c ? d : e\ny++\n;[1].map(z => z)", "switch (a) { case 1: default: b(); }", "a?.b?.[c]?.(d); new A; new A.B(c)", "if (a) b(); else if (c) d()\nvar i = 0, j"],
    "typescript": ["function f<T extends A>(this: B, x?: T[], ...y: number[]): x is string { return x as any; }", "interface A<T> extends B { readonly [k: string]: T; m?(x: number): void; new (x: A): B }", "type F = (a: number) => void | { [K in keyof T]?: T[K] extends infer U ? U : never };", "abstract class C implements D { constructor(private readonly x: number) { super(); } declare y: string; abstract z(): void }", "enum E { A = 1, B }\ndeclare module 'x' { export const y: number }", "const x = <T,>(a: T): T => a!; let y = f<number>(1); const z = <any>w;", "export type { A } from './a'; import type B = require('b');", "const a: number[] = [1]; let t: [a: string, b?: number] = x satisfies T;"],
    "go": ["", "// c\n", "package a\n\nimport (\n\tb \"c\"\n\t. \"d\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T[K, V]) F(x ...int) (n int, err error) {\n\tfor i, v := range x {\n\t\tif y, ok := m[v]; !ok {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch z := t.(type) {\n\tcase nil, *T[K, V]:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase c <- 1:\n\t}\n\tgo func() { defer close(c) }()\n\treturn\n}\n", "package a\nvar x = []T{{1, 2}, {A: map[string]int{\"a\": 1}}}\nconst (\n\tA = iota\n\tB\n)\ntype I interface {\n\tM(int) string\n\t~int | E\n}\n"],
    "java": ["", "package a.b;\nimport static c.D.*;\n@A(x = {1, 2}) public abstract class C<T extends D & E> extends F<G<H>> implements I {\n  int[] a = {1, 2}, b[];\n  static { x(); }\n  C(int... y) throws Z { this.a = new int[]{1}; super(); }\n  <U> U m(final U u) { for (var v : w) { if (v instanceof String s && s.isEmpty()) continue; }\n    Runnable r = () -> { }; F<?> f = C::new; int k = (int) 1L >>> 2; return switch (u) { case A a when a.x() -> 1; case 1, 2 -> { yield 2; } default -> throw e; }; }\n}\nrecord R(int a) { R { } }\nenum E { A(1) { void m() { } }, B; int x; }\n@interface N { int v() default 1; }\n", "class A { String s = \"\"\"\n  text \" \"\"\"; void f() { try (var x = y()) { } catch (B | C e) { } finally { } do { } while (a); label: for (int i = 0, j = 1; i < j; i++) { } } }"],
    "rust": ["", "#![a]\nuse a::{b, c::*};\npub(crate) struct S<'a, T: B + 'a>(pub &'a T) where T: C;\nimpl<'a, T> D for S<'a, T> { type X = Y; const Z: u8 = 1; fn f(&mut self, x: impl Fn(u8) -> u8) -> Result<(), E> { let Some(y) = z else { return Ok(()) }; match y { A { b, .. } | C(b) if b > 1 => b?, 0..=9 => {} _ => loop { break 'a; } } for i in 0..n { v[i] += f::<u8>(i as usize, |a| a + 1)?; } if let Some(x) = y && z { } Ok(()) } }\nmacro_rules! m { ($x:expr) => { $x }; }\nenum E { A = 1, B { c: u8 }, D(u8) }\nasync unsafe extern \"C\" fn g() {}\n", "fn f() -> i64 { let a = S { b: 1, ..c }; let d = [0u8; 4]; let e = r#\"x\"#; if a < b { 1 } else { 2 } }\nstatic X: &str = \"a\";\ntrait T: U { fn m(&self) -> u8 { 1 } }\n"],
    "css": ["", "/* } */ .a > b:not(.c, #d)::before, e[f=\"g\"] { color: red !important; --x: {a: b}; --y:; background: url(data:a;b) } @media (min-width: 1px) { .a { b: c } }", "@import url('x');\n@font-face { a: b }\n@keyframes k { from { a: b } 50.5% { a: c } }\n.a { &:hover { b: c } > d { e: f } width: calc(1px + 2%) }", "@charset \"utf-8\"; :root{--a:1}"],
}
BROKEN = {
    "python": ["def f(:\n", "x = (1\n", "if a:\nb\n", "  x = 1\n", "404: Not Found\n", "print 'x'\n", "a = 'b\n", "return 1\n", "f(a=1, b)\n", "1 = x\n", "class A\n", "for x in y:\n\tif z:\n        pass\n", "<<<<<<< HEAD\nx = 1\n=======\n", "x = [1, 2)\n", "def f(a, a): pass\n", "x = 1 +\n", "f'{x'\n", "const x = 1;\n", "a b\n", "else: pass\n"],
    "javascript": ["function f( {", "const x = ;", "def f(x):\n    return x", "let a: number = 1;", "return 1;", "if (a { }", "a b", "'x", "`${a`", "<!DOCTYPE html>", "1 = a;", "export const;", "}", "import a.b;", "/* x", "for (a of b c", "oid sha256:9a6", "continue;", "class { }", "x = {a: 1, b}}"],
    "typescript": ["function f(x: ): void {}", "interface A { x: number", "const x: number[[] = 1;", "public class X { }", "from a import b", "type T = ;", "enum { A }", "let x = <T>;"],
    "go": ["func f() {}\n", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n", "package a\nfunc f() { a.b }\n", "package a\nfunc f() { x = }\n", "package a\nimport b\n", "package a\nfunc f() { for i := range { } }\n", "package a\nvar x = 'ab'\n", "package a\nfunc f(a int b int) {}\n"],
    "java": ["class A { int x = 1 }", "class A { void f() { a; } }", "class A { void f() { if (x } }", "use a::b;", "class A {", "int x = 1;", "class A { void f() { int = 1; } }", "class A { String s = \"x; }", "class A { void f() { foo(1,); } }", "class A { void f( { } }", "}"],
    "rust": ["fn f( {}", "let x = 1;", "fn f() { let x = ; }", "fn f() { a b }", "package a", "fn f() { x = [1, 2; }", "struct S { a u8 }", "fn f() -> { }", "use a::;", "fn f() { if x { }", "fn f() { a < b < c; }", "impl { }", "/* x", "fn f() { match x { 1 = 2 } }"],
    "css": [".a { color: red", ".a { color }", "} .a { }", "function f(a) { const b = 1; }", ".a { --x: var(--y; }", "404: Not Found", ". { }", "@media { .a { b c } }", ".a { b: c } >", "/* x", ".a { b: 'c }", "def f():\n    return x\n"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid_code_is_accepted(language):
    for s in VALID[language]:
        assert syntax.errors(s.encode(), language) == [], s


@pytest.mark.parametrize("language", BROKEN)
def test_broken_code_is_rejected(language):
    for s in BROKEN[language]:
        assert syntax.errors(s.encode(), language), s


def test_python_agrees_with_the_interpreter():
    here = os.path.dirname(os.__file__)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6000))
    for path in sorted(glob.glob(here + "/**/*.py", recursive=True))[::29][:60]:
        source = open(path, "rb").read()
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                compile(source, path, "exec")
                want = True
            except (SyntaxError, ValueError):
                want = False
        assert (not syntax.errors(source, "python")) is want, path


def test_cut_valid_code_never_crashes():
    for language, texts in VALID.items():
        for s in texts:
            for i in range(0, len(s), 7):
                syntax.errors(s[:i].encode(), language)
                syntax.errors((s[:i] + s[i + 2 :]).encode(), language)


def test_encodings_and_marks():
    assert not syntax.errors("﻿x = 1\r\n".encode(), "python")
    assert not syntax.errors("# -*- coding: latin-1 -*-\nx = 'é'\n".encode("latin-1"), "python")
    assert syntax.errors("x = 'é'\n".encode("latin-1"), "python")
    assert syntax.errors(b"# coding: no-such\n", "python")
    assert not syntax.errors("// é\nlet a = 1\n".encode("latin-1"), "javascript")
    assert not syntax.errors("let a = 1\n".encode("utf-16"), "javascript")
    assert syntax.errors(b"let a = 1\0", "javascript") == [(1, "null byte")]
    assert not syntax.errors(b"x = 1\n# >>>>>>> kept\n", "python")


def test_all_errors_are_found():
    got = syntax.errors(b"def f(a b):\n    pass\nx = 1\ny = = 2\nz = 3\nfor in a:\n    pass\n", "python")
    assert [line for line, _ in got] == [1, 4, 6]


def test_rates(spark):
    t = datetime(2024, 1, 1)
    deep = b"x = " + b"(" * 3000 + b"1" + b")" * 3000 + b"\n"
    rows = [(1, "r", 5, "a/b.PY", b"x = 1\n", t), (1, "r", 5, "a/b.PY", b"x = (\n", datetime(2023, 1, 1)), (2, "r", 5, "c.py", b"x = (\n", t), (3, "r", 6, "d.txt", b"(((", t), (4, "q", None, None, None, None), (5, "q", 7, "e.js", None, t), (6, "q", 7, "f.js", b"", None), (7, "q", 7, "g.py", deep, t)]
    df = spark.createDataFrame([(*x, "junk") for x in rows], "file_id long, repo_name string, run_id long, path string, source binary, ingested_at timestamp, n_errors string")
    got = {r["file_id"]: (r["parsed_as"], r["n_errors"] > 0) for r in parsing.checked(df).collect()}
    assert {k: got[k] for k in range(1, 7)} == {1: ("python", False), 2: ("python", True), 3: (None, False), 4: (None, False), 5: ("javascript", False), 6: ("javascript", False)}
    res = spark.createDataFrame([(5, "r", 9, 8, t), (5, "r", 9, 8, t), (6, "r", 1, None, t)], "run_id long, name string, src_files int, parse_succeeded int, ingested_at timestamp")
    rates = {(r["repo_name"], r["language"]): tuple(r)[2:] for r in parsing.repository_rates(df, res).collect()}
    assert rates["r", "python"] == (2, 1, 0.5, 10, 8) and rates["q", "javascript"] == (2, 0, 0.0, None, None)
    assert {r["language"]: r["rate"] for r in parsing.acceptance(df).collect()}["javascript"] == 1.0
    assert parsing.checked(df.limit(0)).count() == 0


@pytest.mark.parametrize("language, deep", [("python", "x = %s1%s"), ("javascript", "x = %s1%s;"), ("typescript", "x = %s1%s;"), ("go", "package p\nvar x = %s1%s"), ("java", "class A { int x = %s1%s; }"), ("rust", "fn f() { let x = %s1%s; }")])
def test_deep_nesting_is_judged(language, deep):
    source = deep % ("(" * 3000, ")" * 3000) + "\n"
    limit = sys.getrecursionlimit()
    assert syntax.errors(source.encode(), language) == []
    assert syntax.errors((source.replace("1", "1 1 +", 1)).encode(), language)
    assert syntax.errors((source + "\n)\n").encode(), language)
    assert sys.getrecursionlimit() == limit


#: Sources that only look like valid or broken ones.
NEARLY = {
    "javascript": (
        ["({a = 1} = x);", "[{a = 1}] = x;", "({b: {a = 1}} = x);", "for ({a = 1} of x) ;", "(({a = 1}) => a);", "async ({a = 1}) => { await\n x };", "var await = 1; await;", "class A { static constructor() {} constructor() {} }", "10n; 0n; 0x1n;", "x = {...{a}, b};"],
        ["({a = 1});", "f({a = 1});", "x = {a = 1};", "[{a = 1}].b;", "x => ({a = 1});", "08n;", "let f = async () => { await };", "class A { constructor() {} constructor() {} }"],
    ),
    "typescript": (["class A { constructor(a: string); constructor(a: any) {} }", "const f = async <T,>(x: T): Promise<T> => { return await x; };"], ["class A { constructor() {} constructor(a: any) {} }", "f({a = 1});"]),
    "python": (["{**a, **b}\n", "{a for a in b}\n", "{*a, b}\n", "{a: 1 for a in b}\n"], ["{**a for a in b}\n", "{*a for a in b}\n"]),
}


@pytest.mark.parametrize("language", NEARLY)
def test_nearly_valid_and_nearly_broken_code(language):
    good, bad = NEARLY[language]
    assert [s for s in good if syntax.errors(s.encode(), language)] == []
    assert [s for s in bad if not syntax.errors(s.encode(), language)] == []
    assert syntax.errors(b"x = " + b"[" * 3000, "javascript") and syntax.errors(b"x = " + b"[" * 3000 + b"\n", "python")
