import ast
import json
import random

import pytest

from lumenveil.llm.parse_errors import broken_files, diagnose, rejected, repairs
from lumenveil.llm.syntax import lexers
from lumenveil.llm.syntax.chart import Tokens, _guard
from lumenveil.llm.syntax.languages import LANGUAGES, language_of, parser, tokens
from lumenveil.llm.syntax.linear import LinearParser

GOOD = {
    "json": ['{"a": [1, -2.5e3, true, null], "b": {"c": "x\\n\\u00e9"}}', "[]", '"x"', "\ufeff{}"],
    "python": [
        "",
        "x = 1\n",
        "def f(a, *, b: int = 2, **kw) -> str:\n    '''<<<<<<< doc'''\n    return f\"{a!r:>{b}} {{}}\"\n\nclass A(B, metaclass=M):\n    x: int = 3\n\n    @property\n    async def g(self):\n        async with a as b, c:\n            yield await z\n",
        "match x:\n    case {'a': 1, **rest} if y:\n        pass\n    case [1, *_] | (2, 3):\n        pass\n",
        "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    ...\nfinally:\n    del a[1:2, ::3]\n",
        "lst = [i for i in range(3) if i if not i % 2]; d = {**a, 'k': (yield)}\nprint(*a, sep='')\nif (n := 10) > 5: pass\n",
        "x = (1 +\n  2)  # c\nlambda *a, k=1: (a, k)\ntype X[T] = list[T]\n",
        "\tif_ = 1\n".lstrip(),
    ],
    "javascript": [
        "",
        "const a = `x${b + `y${c}`}z`; let {d, e: [f = 1, ...g]} = h\nasync function* k() { for await (const x of y) yield* z }\n",
        "export default class extends A { static #p = 1; get x() { return this.#p } async *[Symbol.iterator]() {} static { f() } }",
        "if (a) b\nelse c\nlabel: for (;;) { break label }\nvar r = /[/]\\/x/g.test(s) ? 1 : a / b / c;",
        "import x, * as y from 'z'; import {a as b, default as c} from \"d\"; export * from 'q'; export {b}; export const m = async (p) => ({...p, q, 'r': 1, [s]() {}})\n",
        "a?.b?.[c]?.(d) ?? e\nnew Foo\ndo x++; while (x < 5)\ntry { } catch { } finally { }\nswitch (a) { case 1: case 2: b(); default: }\nx = function () {}\n;[1, 2].map(f)",
        "const SAMPLE = `\n<<<<<<< HEAD\n=======\n>>>>>>> x\n`;\n",
        "#!/usr/bin/env node\n'use strict'\nvar x = a ? b : c ? d : e, y = a => b => c\n",
    ],
    "typescript": [
        "import type { A } from './a'; export interface B<T extends object = {}> extends C<T>, D { readonly x?: number | null; [k: string]: unknown; m<U>(a: U): void; new (x: string): B<T> }",
        "abstract class S<T> implements I { private readonly m = new Map<string, Array<Promise<T>>>(); constructor(private a: string, public b?: number) { super() } protected abstract f(): void; static g = <T,>(x: T) => x }",
        "type K = keyof typeof obj; type F = (a: string, ...r: number[]) => x is string; type M = { readonly [P in keyof T]?: T[P] }; type C = A extends infer U ? U : never; let t: [a: string, b?: number];",
        "enum E { A = 1, B = 'x' } declare module 'x' { export function f(a: number): string } namespace N.O { export const x = 1 as const }\nlet v = (y as any)!.z satisfies Q; function isX(a: unknown): asserts a is X {}\n",
        "@Component({ selector: 'x' })\nexport class P { @Input() a!: string; get v(): number { return 1 } }\nconst f = async <T>(x: T): Promise<T> => { return x };\nexport type { A, B } from './c'",
        "function f(a: string): void\nfunction f(a: number): void\nfunction f(a: any) {}\nlet u: `a${string}` | undefined = a < b ? c : d",
    ],
    "java": [
        "package a.b;\nimport static x.Y.*;\n@A(value = {1, 2}, b = @C)\npublic sealed abstract class D<T extends E & F> extends G<? super T> implements H permits I {\n  private final Map<String, List<int[]>> m = new HashMap<>();\n  static { init(); }\n  D(int... a) throws X { this.m = null; }\n  <U> U f(final U u) { for (int i = 0, j = 1; i < j; i++) { } for (String s : l) continue; return (U) u; }\n}\n",
        "record P(int x, @N String y) { P { if (x < 0) throw new E(); } }\ninterface Q { default void a() { } int b(); }\nenum R { A(1) { void f() { } }, B; R() { } }\n@interface S { String value() default \"x\"; }\n",
        "class T { Object f(Object o) { return switch (o) { case Integer i when i > 0 -> i; case String s -> { yield s; } case null, default -> \"\"\"\n  text \"quoted\"\n  \"\"\"; }; }\n void g() { Runnable r = () -> { }; List<String> l = xs.stream().map(String::valueOf).collect(Collectors.toList()); try (var a = b(); c) { } catch (A | B e) { } finally { } int[] q = {1, 2}; q[0] += ~1 >>> 2; if (o instanceof String s && !s.isEmpty()) assert x : y; synchronized (this) { } do { } while (true); } }",
    ],
    "csharp": [
        "using System;\nusing static X.Y;\nglobal using Z = A.B<int>;\n".replace("global using Z = A.B<int>;\n", ""),
        "namespace A.B;\n[Serializable, C(1, D = 2)]\npublic sealed partial record class E<T>(int X, string? Y = null) : F<T>, G where T : class, new()\n{\n    public required string N { get; init; } = \"\";\n    public int this[int i] => _a[i];\n    public static E<T> operator +(E<T> a, E<T> b) => a;\n    event EventHandler? H;\n    ~E() { }\n    public E(int a) : this(a, \"\") { }\n}\n",
        "class A { async Task<int[]> F(params string[] x) { await foreach (var (a, b) in c) { } using var d = new E { F = 1, G = { 2, 3 } }; if (o is string { Length: > 3 and < 9 } s && x is not null) throw new X($\"a{b:N2}\"); return y switch { 1 or 2 => z, _ => default, }; } int P => _p ??= Q(out var r, ref s); void L() { int M(int n) => n * 2; var q = from x in y where x > 1 orderby x descending select new { x, x.Z }; lock (this) { } checked { } var t = (1, name: 2); t = (a, b); Func<int, int> f = static (int n) => n; var e = list[^1..]; string v = @\"c:\\\" + \"\"\"raw \"x\" \"\"\"; } }",
        "#if DEBUG\n#endif\nConsole.WriteLine(\"top\");\nint x = args.Length > 0 ? 1 : 2;\n",
    ],
    "go": [
        "package main\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[K comparable, V any] struct {\n\ta, b int `json:\"a\"`\n\t*E\n}\n\ntype I interface {\n\tM(int) (string, error)\n\t~int | ~string\n}\n\nfunc (t *T[K, V]) F(a, b int, c ...string) (n int, err error) {\n\tif v, ok := m[k]; ok && v > 1 {\n\t\treturn v, nil\n\t} else if x {\n\t}\n\tfor i := range xs {\n\t\tgo func() { ch <- <-d }()\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch t := x.(type) {\n\tcase int, []string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase d <- 1:\n\t}\n\ta, b = b, a\n\ty := []T{{1, 2}, {a: 3}}\n\tz := map[string]func(int) bool{\"k\": f}\n\tdefer s[1:2].Close()\n\treturn\n}\n\nvar raw = `\n<<<<<<< x\n`\n\nconst (\n\tA = iota\n\tB\n)\n",
        "package p",
    ],
    "yaml": [
        "",
        "a: 1\nb:\n  - x\n  - y: 2\n    z: [1, {q: r}, 'it''s']\nc: |\n  text: here\n   more\n\nd: >-\n  folded\ne: &x {f: g}\nh: *x\n",
        "--- \na: b\n...\n---\n- c\n- - d\n  - e\n---\n? complex\n: value\n",
        "key: value with colon-ish:text\nurl: http://a.b:80/c # comment\n\"quoted key\": \"multi\n  line\"\nempty:\nlist:\n- a\n-\n  b: c\n",
        "plain multi\nline scalar\n",
    ],
}
BAD = {
    "json": ["", "{'a': 1}", '{"a": 1,}', "[1 2]", '{"a"', "// x\n{}", '{"a": 01}', '{"a": NaN}', "{} {}"],
    "python": ["print 'x'\n", "def f(:\n  pass\n", "if x:\npass\n", "x = (1\n", "  x = 1\n", "a b\n", "x = “y”\n", "'''open\n", "try:\n    x\n", "<<<<<<< HEAD\n", "x = 08\n", "def f():\n    a\n  b\n"],
    "javascript": ["let = = 1", "function (", "import type { A } from 'a'", "const x: number = 1", "a b", "{\"a\": 1, \"b\": 2}", "x = `open", "}\n", "<<<<<<< HEAD\nx\n", "if (a {", "package x\n", "<!DOCTYPE html>\n<html></html>"],
    "typescript": ["interface A { b: ", "const x: = 1", "class A { constructor( }", "package a.b;\nclass C {}", "export function f() {", "=======\nx\n", "def f():\n  pass\n"],
    "java": ["class A {", "package a\nclass B {}", "class A { void f() { return 1 } }", "class A { int x = ; }", "public function x() {}", "class A { void f() { g(“x”); } }"],
    "csharp": ["class A { void F() { return 1 } }", "namespace A { class B {", "import java.util.Map;", "class A { int P { get; } = ; }", "class A {\n>>>>>>> x\n void F() { } }", "using System\nclass A {}"],
    "go": ["", "func f() {}", "package a\nfunc f() {", "package a\nimport \"x", "package a\nvar x = ", "package a\nfunc f() { if x { }", "package a;\nclass X {}", "package a\nx := 1\n"],
    "yaml": ["a: b: c\n", "a: [1, 2\n", "\"open\n", "a: 1\n b: 2\n", "- a\nb: c\n", "a:\n\t- b\n", "a: 1\n=======\nb: 2\n", "key: 'x\n", "a: %x\n", "{a: 1}}\n"],
}


@pytest.mark.parametrize("language", LANGUAGES)
def test_valid_texts_cost_nothing(language):
    p = parser(language)
    for text in GOOD[language]:
        t = tokens(language, text)
        stop = p.run(t)[0]
        assert stop < 0, (text, t.lines[min(stop, len(t.lines) - 1)], t.kinds[max(0, stop - 4) : stop + 2])
        assert p.repair(t).cost == 0


@pytest.mark.parametrize("language", LANGUAGES)
def test_invalid_texts_cost_something(language):
    for text in BAD[language]:
        assert rejected(language, text), text
        assert diagnose(language, text)[0] > 0


def test_agrees_with_the_languages_own_parsers():
    for text in GOOD["python"]:
        ast.parse(text)
    for text in GOOD["json"]:
        json.loads(text.lstrip("\ufeff"))


def test_kinds():
    whole = "function f(a) {\n  return [a, {b: 1}];\n}\n"
    assert diagnose("javascript", whole[:-6])[2] == "truncation"
    assert diagnose("javascript", whole + "<<<<<<< HEAD\n" + whole + "=======\n" + whole + ">>>>>>> b\n")[2] == "conflict"
    cost, _, kind, other, _ = diagnose("javascript", "package main\n\nfunc f() int {\n\treturn 1\n}\n")
    assert (kind, other) == ("mismatch", "go") and cost > 1
    cost, at_least, kind, _, lines = diagnose("java", "class A {\n  int f() { return 1 + ; }\n  int g() { return 2; }\n}\n")
    assert (cost, at_least, kind, lines) == (1, False, "local", [2])


def test_completion_is_the_least_number_of_tokens():
    assert parser("json").repair(tokens("json", '{"a": [1')).cost == 2
    assert parser("json").repair(tokens("json", '{"a":')).cost == 2


def test_repair_looks_beyond_the_nearest_edit():
    text = '{"a": [1, 2, "b": [1,2,3,4,5], "c": 3}'  # a bracket after 2; a comma for the colon only moves the error
    repair = parser("json").repair(tokens("json", text))
    assert (repair.cost, repair.complete, [e.action for e in repair.edits]) == (1, True, ["put"])


def test_repair_does_not_give_up():
    text = "[" + "1 1, " * 60 + "1]"
    assert diagnose("json", text)[:2] == (60, False)


def test_repair_is_the_least_of_all_edits():
    p = parser("json")
    terminals = sorted({t for row in p.net.terminal for t in row} - {"NEVER", "EOF"})

    def least(kinds, most):
        level = {tuple(kinds)}
        for cost in range(most + 1):
            if any(p.parses(Tokens([*row, ("EOF",)], [1] * (len(row) + 1), [False] * (len(row) + 1))) for row in level):
                return cost
            level = {
                row[:i] + middle + row[i + taken :]
                for row in level
                for i in range(len(row) + 1)
                for taken in (0, 1)
                for middle in [(), *[((t,),) for t in terminals]]
                if i + taken <= len(row)
            }
        return most + 1

    for text in ("", "1 1", "[1 2", "{1", "[}", "]{", ": 1", '{"a" 1', "[,]", '{"a": }', "1 , 2", "[1 2 3"):
        found = tokens("json", text)
        assert p.repair(found).cost == least(found.kinds[:-1], 2), text


def test_rejected_where_the_languages_own_parser_gives_up():
    assert rejected("json", "[" * 20_000)


def test_long_text():
    text = "const x = [\n" + "  0x1f, 0x2a, 0x3b,\n" * 20_000 + "];\n"
    assert parser("javascript").parses(tokens("javascript", text))


def test_language_names():
    assert [language_of(x) for x in (" TypeScript ", "C #", "yml", "rust", None, "")] == ["typescript", "csharp", "yaml", None, None, None]


SCHEMA = "file_id long, repo string, path string, language string, content string, ingested_at timestamp, digest string, broken boolean"


def test_operator_on_dirty_rows(spark):
    from datetime import datetime

    at = lambda d: datetime(2026, 1, d)
    rows = [
        (1, "r", "a.json", " JSON", "{}", at(1)),
        (2, "r", "b.json", "json", "{", at(1)),
        (2, "r", "b.json", "json", "{", at(2)),
        (3, "r", "c.py", None, "x = (", at(1)),
        (4, "r", "d.xyz", None, "((", at(1)),
        (5, None, "e.json", "Json", None, at(1)),
        (6, "r", None, "json", "", None),
        (7, "r", "g.rs", "rust", "fn (", at(1)),
        (None, "r", "h.json", "json", "{", at(1)),
        (8, "r", "i.json", "json", "{", at(1)),
    ]
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    got = {r["file_id"]: r["broken"] for r in broken_files(df).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False, 8: True}
    assert broken_files(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r["file_id"] for r in repairs(df).collect()} == {2, 3, 6, 8}


def mutated(text, seed):
    r = random.Random(seed)
    at = r.randrange(len(text) + 1)
    return text[:at] + r.choice(["", "(", "}", '"', "`", "/", "\n", " 1", "=", "<", "é", "\\"]) + text[at + r.choice([0, 1, 3]) :]


@pytest.mark.parametrize("language", LANGUAGES)
def test_tables_stop_where_the_chart_stops(language):
    p = parser(language)
    for k, text in enumerate([*GOOD[language], *BAD[language]]):
        for variant in [text, *[mutated(text, 100 * k + j) for j in range(12)]]:
            t = tokens(language, variant)
            assert p.stop(t) == p.run(t)[0], variant


def test_tables_start_afresh_when_full():
    p = parser("json")
    small = LinearParser(p, _guard, most=1)
    for text in (*GOOD["json"], *BAD["json"], "[[[1, {}], 2]]"):
        t = tokens("json", text)
        assert small.stop(t) == p.run(t)[0]


def test_lines_remembered_give_the_same_tokens():
    for language, lex in (("javascript", lambda t: lexers._javascript(t, None)[0]), ("python", lambda t: lexers._python(t, None)), ("json", lambda t: lexers._json(t, None))):
        for k, text in enumerate(t for t in [*GOOD[language], *BAD[language]] if not t.startswith("#!")):
            for variant in [text, *[mutated(text, 7 * k + j) for j in range(8)]]:
                a, b = tokens(language, variant), lex(lexers.clean(variant))
                assert (a.kinds, a.breaks) == (b.kinds, b.breaks), variant


def test_very_deep_texts():
    assert rejected("json", "[" * 200_000) and not rejected("json", "[" * 200_000 + "]" * 200_000)


def test_one_deleted_token_costs_one():
    for language in ("json", "python", "javascript", "go"):
        p = parser(language)
        for n, text in enumerate(GOOD[language]):
            whole = tokens(language, text)
            r = random.Random(n)
            for _ in range(4):
                at = r.randrange(len(whole.kinds))
                cut = Tokens(*[[x for i, x in enumerate(column) if i != at or len(whole.kinds) - 1 == at] for column in (whole.kinds, whole.lines, whole.breaks)])
                if not p.parses(cut):
                    assert p.repair(cut).cost == 1
