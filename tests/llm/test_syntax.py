from conftest import rows

from scanloom.llm.syntax import check, core

GOOD = {
    "python": ["", "# only a comment\n", "def f(a, *, b=1):\n    return [x for x in a if x]\r\n", "async def g():\n\tawait h()\n", "match x:\n    case [1, *_]: pass\n", "f'{a!r:>{w}}'\n"],
    "javascript": [
        "", "// x\n/* y */", "const a = require('./a');\nlet x = `a ${b + `c`.length} d`\nx.y?.z(1, ...r)\n", "export default [\n  [1,-2],[3,4],\n];", "(self.a=self.q||[]).push([[2],{468:function(e,t,n){e.x=!0;function k(e,t){return e+38*t}}}]);", "class A extends B { static #p = 1; get x() { return 1 } async *g() { yield* h() } constructor() { super() } }",
        "for (const [k, v] of Object.entries(o)) if (k) continue; else break\ndo { x++ } while (x < 3)\nlabel: for (;;) { break label }", "try { f() } catch { g() } finally { h() }\nswitch (a) { case 1: b(); break; default: c() }", "const f = async (a, {b = 1, ...c}, [d] = []) => ({ a, [b]: 1, 'x-y': 2, get z() { return 3 } })", "a = b\n++c\nvar r = /[/\\]]+/g.test(s) ? 1 : x / 2 / 3", "let v = function () { return }\n.call(this)", "import a, { b as c } from './m.js'\nexport { c }\nexport * from 'n'", "if (a) b(); else c();", "x = a ? b ? 1 : 2 : 3; y = a => b => c", "var a = 1, b\nreturn_ = typeof a === 'x' && !b || c ?? d",
    ],
    "typescript": ["interface A<T> extends B { x?: string; readonly y: number[]; f(a: T): void; [k: string]: any }\n", "export function f<T extends object>(a: Record<string, unknown>, b?: T): string | number { return (a as any).x! }", "type U = { [K in keyof T]?: T[K] } | 'a' | (() => void)\nenum E { A = 1, B }\ndeclare module 'x' { export const y: number }", "class C<T> implements D { constructor(private readonly a: string, public b = 1) {} abstract; f<K>(k: K): asserts k is K { } }", "let x: Map<string, Array<number>> = new Map<string, Array<number>>()\nconst y = <T,>(a: T) => a", "abstract class A { protected abstract f(): void }", "import type { A } from './a'\nlet t: [a: number, b?: string] = [1]"],
    "java": ["package a.b;\nimport static java.util.List.*;\n@A(x = 1, y = {2, 3})\npublic final class C<T extends D & E> extends F implements G<T> {\n static final int[] T = { 1, 2, };\n private Map<String, List<Integer>> m = new HashMap<>();\n public C(int... a) throws X { super(a); }\n static { i++; }\n <K> K f(final K k, int[] a) { for (int i = 0, j = 1; i < 3; i++) { if (a[i] > (int) k) continue; else break; }\n for (String s : m.keySet()) s.trim();\n try (var r = open()) { g(); } catch (A | B e) { throw e; } finally { }\n Runnable q = () -> { }; Function<A, B> z = x -> x.y(C::new); return (K) new Object() { int w; }; }\n}\nenum E { A(1) { }, B; int x; }\nrecord R(int a, String b) { }\ninterface I { default int f() { return 1; } int g(); }", "class A { int f(int x) { return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; } String s = \"\"\"\n a \"b\" c\n \"\"\"; }"],
    "c": ["#include <stdio.h>\n#define M(a) \\\n  ((a) + 1)\n#ifdef X\nstatic int x;\n#endif\ntypedef struct node { int a : 3; struct node *next, **p; } node_t;\nenum e { A = 1, B, };\nint (*fp)(int, char *);\nstatic const short t[] = { 1, -2, [3] = 4 };\nint main(int argc, char **argv) {\n  node_t n = { .a = 1 };\n  for (int i = 0; i < 3; i++) { if (i == 1) continue; else printf(\"%d\" \"x\", (int)n.a, sizeof(int)); }\n  do { *n.p = &n; n.next->a <<= 1; } while (0);\n  switch (argc) { case 1: case 2: break; default: goto end; }\nend:\n  return ((const int *)argv)[0] ? 1 : 0;\n}\n"],
    "cpp": ["#include <string>\nnamespace a::b {\ntemplate <typename T, int N = 3> class C : public D<T>, private E {\n public:\n  explicit C(int x) : D<T>(x), y_{x} {}\n  virtual ~C() = default;\n  bool operator==(const C &o) const noexcept { return y_ == o.y_; }\n private:\n  std::map<std::string, std::vector<int>> m_;\n  int y_ = 0;\n};\nauto f(std::size_t n, const std::string &s) -> int {\n  auto g = [&, n](int a) mutable { return a + n; };\n  for (const auto &x : m) { try { g(x->y()); } catch (const std::exception &e) { throw; } catch (...) { } }\n  auto p = std::make_unique<int>(3); delete q; int *r = new int[4];\n  return static_cast<int>(n) < 3 && !s.empty() ? 1 : 2;\n}\n}\nusing V = std::vector<int>;\nextern \"C\" { void h(void); }\n"],
}
BAD = {
    "python": ["def f(:\n", "print 'x'\n", "   1| def f():\n", "x = (1\n", "if a:\nb\n", "<<<<<<< HEAD\n", "a = 'x\n", "\0"],
    "javascript": ["let x = ;", "function f( { }", "{\"a\": 1, }", "const a", "id,a,b\n1,weekly one,3 4\n", "<!DOCTYPE html>\n<html></html>", "let x: number = 1", "a b", "x = {a:1", "f(a,,b)", "}", "package a.b;", "  1| let x = 1;", "a @@ ??", "if (a { }", "let s = 'x\n", "[section]\nname = the one\n"],
    "typescript": ["interface A { x: }", "let x: = 1", "function f(a: ): any { }", "<<<<<<< HEAD\nlet a = 1\n=======\n>>>>>>> x", "#include <a.h>\n", "public class A { }"],
    "java": ["class A { int x }", "class A { void f() { a(); }", "class A { void f() { int = 3; } }", "public class { }", "{\"x\": null}", "class A { void f() { if a { } } }", "let x = 1;", "class A { void f() { g(1 2); } }"],
    "c": ["int f( { }", "int x = ;", "namespace a { int x; }", "std::string s;", "int f(void) { return 1 }", "#if 1\nint x;\n", "# heading\n", "int f(void) { a(1,,2); }", "package a.b.c;"],
    "cpp": ["namespace a { int x;", "class A { int x; }", "int f() { for (;;) }", "int f() { std::; }", "def f():\n    pass\n", "int f() { x = (1; }"],
}


def test_valid_files_parse():
    for lang, texts in GOOD.items():
        for t in texts:
            assert check.parses(t, lang), (lang, t)
            assert check.parses(t.replace("\n", "\r\n"), lang), (lang, t)


def test_broken_files_do_not():
    for lang, texts in BAD.items():
        for t in texts:
            assert not check.parses(t, lang), (lang, t)


def test_cut_files_do_not_parse():
    text = GOOD["java"][0]
    assert not any(check.parses(text[:n], "java") for n in range(60, text.index("enum E") - 1, 7))


def test_foreign_languages_are_named():
    assert check.verdict(GOOD["java"][0], "python")[:2] == (False, "java")
    assert check.verdict(GOOD["cpp"][0], "c")[:2] == (False, "cpp")
    assert check.verdict("interface A { x: number }\nlet y: A = { x: 1 }\n", "javascript")[:2] == (False, "typescript")
    assert check.verdict("def f(a):\n    return a\n", "javascript")[:2] == (False, "python")
    assert check.verdict("id,a\n1,it's 2\n", "java")[:2] == (False, None)


def test_every_grammar_is_asked():
    for text in ("", "x = 1\n", "int x;\n", "let a = [1, 2]\nf(a)\n", "def f(:\n", "struct a { int b; };\n"):
        found = check.readers(text)
        assert set(found) == {k for k in check.LANGUAGES if check.parses(text, k)}
    assert check.verdict("let a = 1\n", "javascript") == (True, "javascript", check.readers("let a = 1\n")) and "typescript" in check.readers("let a = 1\n")


def test_check_syntax_table(spark):
    data = [(1, "r", "a.py", "x = 1", "v"), (2, "r", "a.py", "x = (", "v"), (3, None, "b.JS", "let a: number = 1", "v"), (4, "r", "c.txt", "???", "v"), (5, "r", None, "x", "v"), (6, "r", "d.c", None, "v"), (7, "r", "d.c", "", "v"), (2, "r", "a.py", "x = (", "v")]
    df = spark.createDataFrame(data, "file_id long, repo string, path string, content string, valid string")
    got = {r["file_id"]: (r["valid"], r["parses_as"], r["verdict"]) for r in check.check_syntax(df, "file_id", "path", "content").collect()}
    assert got == {1: (True, "python", "valid"), 2: (False, None, "corrupt"), 3: (False, "typescript", "wrong extension"), 4: (None, None, None), 5: (None, None, None), 6: (True, "c", "valid"), 7: (True, "c", "valid")}
    assert rows(check.check_syntax(df, "file_id", "path", "content", invalid_only=True).select("file_id")) == [(2,), (2,), (3,)]
    rates = rows(check.invalid_rates(df, "file_id", "repo", "path", "content"))
    assert ("r", "python", 2, 1, 0, 1, 0.5) in rates and ("r", "c", 2, 0, 0, 0, 0.0) in rates and (None, "javascript", 1, 1, 1, 0, 1.0) in rates
    assert check.check_syntax(df.limit(0), "file_id", "path", "content").count() == 0 and check.invalid_rates(df.limit(0), "file_id", "repo", "path", "content").count() == 0


def test_deep_and_long_texts_end():
    assert check.parses("x = " + "[" * 400 + "]" * 400, "javascript") and not check.parses("(" * 50_000 + ")" * 50_000, "javascript")
    assert check.parses("a" + "\n  .b(1)" * 3000 + "\n", "javascript")
    assert check.parses("class A { String s = " + ' + '.join(['"x"'] * 3000) + "; }", "java")
    assert not check.parses("int f() {" * 3000, "c")


def test_python_that_only_the_compiler_refuses_and_ranks_of_whole_texts():
    for text in ("return 1\n", "def f(a, a):\n    pass\n", "break\n"):
        assert not check.parses(text, "python"), text
    assert check.parses("def f(a):\n    for x in a:\n        break\n    return a\n", "python")
    text = "const a = 1;\n" + "a = 1;\n" * 4000 + "interface A { b: string; c: number; d: boolean; readonly e: any; }\n" * 20
    assert check.ranked(text)[0] == "typescript"


def test_depth_is_no_verdict():
    assert check.parses("x = " + "[" * 3000 + "]" * 3000, "javascript") and check.parses("x = " + "(" * 1500 + "1" + ")" * 1500 + ";", "javascript")
    assert check.parses("int f() { " + "{" * 2000 + "}" * 2000 + " }", "c") and not check.parses("int f() { " + "{" * 2000 + "}" * 1999 + " }", "c")
    chain = "x = " + "-" * 100_000 + "1"
    assert check.parses(chain, "python") is None and check.verdict(chain, "python")[:2] == (None, None)


def test_unjudged_files_are_no_broken_ones(spark):
    df = spark.createDataFrame([(1, "a.py", "x = " + "-" * 100_000 + "1"), (2, "a.py", "x = (")], "file_id long, path string, content string")
    assert rows(check.check_syntax(df, "file_id", "path", "content").select("file_id", "valid", "verdict")) == [(1, None, "not judged"), (2, False, "corrupt")]
    assert rows(check.check_syntax(df, "file_id", "path", "content", invalid_only=True).select("file_id")) == [(2,)]


def test_an_error_at_the_beginning_ends_a_foreign_parse():
    python = "import os\n" + "".join(f"def f{i}(a, b):\n    return g(a[{i}], {{'k': b + {i}}})\n" for i in range(500))
    java = "final class Table {\n  static final int[] T = {\n" + "".join(f"    {i}, {i + 1},\n" for i in range(2000)) + "  };\n}\n"
    assert check.verdict(python, "python") == (True, "python", ["python"])
    assert all(check.grammar(k).cut.text != python for k in check.LANGUAGES[1:])
    assert check.verdict(java, "java") == (True, "java", ["java"])
    assert [k for k in check.LANGUAGES[1:] if check.grammar(k).cut.text == java] == ["java"]


def test_no_beginning_of_a_valid_text_is_refuted(monkeypatch):
    monkeypatch.setattr(core, "STARTS", tuple(range(1, 200)))
    for lang, texts in GOOD.items():
        for t in texts:
            assert check.parses(t, lang, None, False), (lang, t)


def test_looking_at_the_beginning_changes_no_answer():
    texts = [x for table in (GOOD, BAD) for texts in table.values() for t in texts for x in (t, t[: len(t) // 2], t.replace("\n", "\r\n"), f"{t}\n" * 9)]
    texts += ["#!/usr/bin/env node\nlet a = `b ${c} d`\n" * n for n in (1, 9)] + ["let a = `x ${b(`y ${c}`)} z`\n" * 20, "a: `x ${'`'}`\n" * 20, "x = a + +b / c\n" * 20]
    for t in texts:
        for lang in check.LANGUAGES:
            assert check.parses(t, lang) == check.parses(t, lang, check.grammar("javascript"), False), (lang, t)
