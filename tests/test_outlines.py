import pytest

from ledgerloom.operators import scanners
from ledgerloom.plans.outlines import SOURCES


def kinds(parser, text, path="a.x"):
    found = scanners.scan(parser, text, path)
    return None if found is None else [(f"{s}-{e}", k) for s, e, k, _ in found[0]]


@pytest.mark.parametrize("parser", [p for p in SOURCES if p in scanners.SCANNERS])
def test_stated_values(parser):
    _, path, text, *want = SOURCES[parser]
    assert scanners.scan(parser, text, path) == (want[0], want[1], want[2], want[3])
    assert scanners.scan(parser, "~\n", path) is None and scanners.scan(parser, "", path) is None


@pytest.mark.parametrize("parser, mark, text", [("kotlin", "// @generated\n", "class A {\n}\n"), ("cpp", "// DO NOT EDIT\n", "struct A {\n};\n"), ("sql", "-- pg_dump\n", "CREATE TABLE a (\n);\n"), ("julia", "# Generated by x\n", "f() = 1\nstruct A end\n"), ("zig", "// auto-generated\n", "fn a() void {}\n")])
def test_generated_files_say_so(parser, mark, text):
    assert scanners.scan(parser, mark + text, "a.x")[1].endswith(" — generated, do not edit directly")
    assert "generated" not in scanners.scan(parser, text, "a.x")[1]


def test_notes():
    assert scanners.scan("typescript", "// @generated\nexport const a = 1\n", "a.ts")[1:] == ("TypeScript module — 1 exported symbol(s) — generated — do not edit directly", ["a"], "generated file — edit the generator, not this file")
    assert scanners.scan("go", "// Code generated by x. DO NOT EDIT.\npackage pb\n\ntype Foo struct{}\n", "a.go")[3] == "generated file — edit the generator, not this file"


def test_block_languages_show_forty_symbols_and_module_languages_all():
    assert len(scanners.scan("swift", "".join(f"struct A{i} {{\n}}\n" for i in range(60)), "a.swift")[2]) == 40
    assert len(scanners.scan("julia", "".join(f"const A{i} = 1\n" for i in range(60)), "a.jl")[2]) == 60
    assert len(scanners.scan("go", "package a\n" + "".join(f"func A{i}() {{}}\n" for i in range(60)), "a.go")[2]) == 60


@pytest.mark.parametrize(
    "parser, text, want",
    [
        ("go", "package a\n\nfunc Good() string { return \"ok\" }\n\nfunc Bad(\n", [("3-3", "func Good() string"), ("5-5", "func Bad()")]),
        ("go", "package a\n", [("1-1", "package a (no exported declarations)")]),
        ("go", "package a\ntype I interface {\n\tA()\n\tB(x int) error\n}\ntype F func()\ntype S []string\ntype A [3]int\ntype P = q.R\n", [("2-5", "type I interface (2 methods)"), ("6-6", "type F func type"), ("7-7", "type S slice type"), ("8-8", "type A array type"), ("9-9", "type P type")]),
        ("go", "package a\nfunc f(a []int, b [3]string, c map[string]interface{}, d chan int) (x, y bool) {\n}\n", [("2-3", "func f(a []int, b [...]string, c map[string]interface{}, ...) (bool)")]),
        ("go", "package a\nfunc g(int, *T, ...string) {}\nfunc h(a pkg.T[int], f func(x int) error) {}\n", [("2-2", "func g(int, *T, ...string)"), ("3-3", "func h(a pkg.T[int], f func(...))")]),
        ("kotlin", "class A(\n  val x: Int\n)\nfun f() = 1\n", [("1-3", "class A"), ("4-4", "fun f")]),
        ("swift", "class A\n{\n  func f() {}\n}\n", [("1-4", "class A — f")]),
        ("csharp", "record P(int X);\n", [("1-1", "record P")]),
        ("csharp", "class A {\n  string s = $\"{x}\";\n  string r = \"\"\"\n  class No {\n  \"\"\";\n  void F() { }\n}\n", [("1-7", "class A — F")]),
        ("cpp", "class A;\nstruct B { int x; };\nunion U {\n};\n", [("3-4", "union U")]),
        ("cpp", "typedef struct { int x; } P;\nstruct ns::Q {\n  Q(int);\n  operator bool();\n};\n", [("1-1", "struct P"), ("2-5", "struct Q — bool")]),
        ("scala", "class A {\n  def +(x: A) = 1\n  def a_! = 2\n}\n", [("1-4", "class A — a_!")]),
        ("php", "<?php\nclass A {\n  private $x = \"\n  } {\n  \";\n  function a() {}\n}\n", [("2-7", "class A — a")]),
        ("dart", "class A {\n  A();\n  A.named(int x);\n  void _go() {}\n  Foo get x { return y; }\n}\n", [("1-6", "class A — _go, x")]),
        ("julia", "if true\n  function f() end\nend\ng() = [1 for x in y]\nfunction h() end\n", [("1-5", "module a — h")]),
    ],
)
def test_cases(parser, text, want):
    assert kinds(parser, text) == want


@pytest.mark.parametrize("parser", list(scanners.SCANNERS))
def test_any_text_is_read(parser):
    for text in ("{", "}\n}\n", '"', "'", "/*", '"""', "class {", "class A", "(" * 500, "def", "module", "type", "\\", "R\"(", "<<<A", "@", "func", "package a\nfunc", "package a\ntype", "package a\nvar (", "é 日本 \0"):
        scanners.scan(parser, text, "a.x")
