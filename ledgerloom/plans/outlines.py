"""Outline queries: a small file of every format, made once for each supplier with a name of its own in it.

What the formats' rules give for these files is stated by hand as values; the SQL puts the supplier's name into them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outline, scanners
from .registry import _sql_text, _table, query

#: Parser: number of its operator, path, text, entries (start, end, kind, symbol), summary, symbols and notes. Zed and zed are followed by the supplier's key.
SOURCES = {
    'go': (
        1, 'auth.go',
        '// Package auth checks tokens. It is small.\npackage auth\n\nimport (\n\t"errors"\n\tt "time"\n)\n\n// ErrZed says so\nvar ErrZed, other = errors.New("}"), 1\n\nconst (\n\tA = iota\n\tB\n\tC\n\tD\n)\n\nconst hidden = 1\n\n// Zed holds it! More.\ntype Zed struct {\n\tX, Y int // both\n\tio.Reader\n\tf    func(a int) struct{ z int }\n}\n\ntype (\n\tids []int\n\tName = string\n)\ntype M map[string][]int // by name\n\n/* Get reads. */\nfunc (z *Zed) Get(ctx context.Context, a, b int, opts ...Option) (n int, err error) {\n\tif a > 0 {\n\t\treturn \'}\', nil\n\t}\n\treturn\n}\n\nfunc Map[T any](xs []T, f func(T) bool) <-chan map[string]*T { return nil }\nfunc (s Set[K]) has(K) bool\nfunc run() {}\n',
        [(4, 7, 'imports (2 packages)', ''), (10, 10, 'var ErrZed — ErrZed says so', ''), (12, 17, 'const A, B, C (+1 more)', ''), (22, 26, 'type Zed struct (4 fields) — Zed holds it!', ''), (28, 31, 'type Name', ''), (32, 32, 'type M map type — by name', ''), (35, 40, 'func (*Zed) Get(ctx context.Context, a int, b int, ...) (int, error) — Get reads.', ''), (42, 42, 'func Map(xs []T, f func(...)) chan map[string]*T', ''), (43, 43, 'func (Set[T]) has(K) bool', ''), (44, 44, 'func run()', '')],
        'Package auth checks tokens.', ['ErrZed', 'A', 'B', 'C', 'D', 'Zed', 'Name', 'M', 'func (*Zed) Get(ctx context.Context, a int, b int, ...) (int, error)', 'func Map(xs []T, f func(...)) chan map[string]*T'], '',
    ),
    'typescript': (
        2, 'a.ts',
        "import x from 'y'\nconst f = require('f')\n\nexport abstract class Zed {\n  m() { return '}' }\n}\nexport const k = 1\nfunction g() {\n}\nconst h = () => {\n  return 1\n}\nconst plain = 2\nexport default class {\n}\n",
        [(1, 2, 'imports', ''), (4, 6, 'export abstract class Zed', 'Zed'), (7, 7, 'export const k', 'k'), (8, 9, 'function g', 'g'), (10, 12, 'const h', 'h'), (14, 15, 'export default', '')],
        'TypeScript module — 4 exported symbol(s)', ['Zed', 'k', 'g', 'h'], '',
    ),
    'python': (
        3, 'm.py',
        '"""Doc."""\nimport os\nfrom a import b\n\n@dec\nclass Zed(B):\n    def f(self):\n        pass\n    async def g(self):\n        pass\n\ndef top():\n    return 1\n\nx = 1\n',
        [(2, 3, 'imports', None), (5, 11, 'class Zed — methods: f, g', None), (12, 15, 'def top', None)],
        'Doc.', ['Zed', 'top'], '',
    ),
    'rust': (
        4, 'l.rs',
        '//! Does things.\nuse a::b;\n\n#[derive(Debug)]\npub struct Zed {\n    x: u8,\n}\n\nimpl T for Zed {\n    fn f() {}\n}\npub(crate) fn g() -> u8 { 1 }\nmod m;\n',
        [(2, 2, 'use declarations', ''), (4, 7, 'pub struct Zed', 'Zed'), (9, 11, 'impl Zed', ''), (12, 12, 'pub fn g', 'g'), (13, 13, 'mod m', '')],
        'Does things.', ['Zed', 'g'], '',
    ),
    'json': (
        5, 'a.json',
        '{\n  "a": 1,\n  "b": {\n    "y": 1,\n    "x": 2\n  },\n  "Zed": [1, 2]\n}\n',
        [(1, 2, 'a: 1', 'a'), (2, 5, 'b: object {x, y}', 'b'), (6, 7, 'Zed: array[2]', 'Zed')],
        'JSON object — 3 top-level key(s): a, b, Zed', ['a', 'b', 'Zed'], '',
    ),
    'yaml': (
        6, 'k8s.yaml',
        'apiVersion: v1\nkind: Pod\n# note\nZed:\n  name: x\n  labels:\n    a: b\nlist:\n- one\n- two\n',
        [(1, 1, 'apiVersion', None), (2, 3, 'kind', None), (4, 7, 'Zed: {name, labels, a}', None), (8, 10, 'list: list[2]', None)],
        'YAML document — 4 top-level key(s)', ['apiVersion', 'kind', 'Zed', 'list'], '',
    ),
    'toml': (
        7, 'Cargo.toml',
        'top = 1\n\n[Zed]\nname = "x"\nversion = "1"\n\n[[bin]]\nname = "a"\n',
        [(1, 2, 'root: top', None), (3, 6, '[Zed] — name, version', None), (7, 8, '[[bin]] — name', None)],
        'Cargo package manifest', ['top', '[Zed]', '[[bin]]'], '',
    ),
    'dockerfile': (
        8, 'Dockerfile',
        '# c\nFROM --platform=x golang:1.24 AS zed\nRUN a\nRUN b\nCOPY . .\n\nFROM alpine\nCMD x\n',
        [(2, 6, 'FROM golang:1.24 AS zed — RUN, COPY', None), (7, 8, 'FROM alpine — CMD', None)],
        'Dockerfile — 2 stages', ['FROM golang:1.24 AS zed — RUN, COPY', 'FROM alpine — CMD'], '',
    ),
    'makefile': (
        9, 'Makefile',
        'X := 1\n.PHONY: build zed\nbuild: a\n\t# c\n\tgo build ./...\n\nzed:\n\tgo zed\ninclude y\n',
        [(3, 6, 'build (phony): go build ./...', None), (7, 8, 'zed (phony): go zed', None)],
        'Makefile — 2 target(s)', ['build', 'zed'], '',
    ),
    'shell': (
        10, 'x.sh',
        '#!/bin/bash\n# c\nzed() {\n  if x; then { y; }\n  fi\n}\nfunction one { echo; }\nzed\n',
        [(3, 6, 'zed', 'zed'), (7, 7, 'one', 'one')],
        'Shell script — 8 line(s), 2 function(s)', ['zed', 'one'], '',
    ),
    'hcl': (
        11, 'm.tf',
        'resource "aws_x" "zed" {\n  a = "}"\n}\nlocals {\n  t = <<EOT\n{\nEOT\n}\n',
        [(1, 3, 'resource aws_x.zed', 'resource aws_x.zed'), (4, 8, 'locals', 'locals')],
        'HCL — 1 resource, 1 locals', ['resource aws_x.zed', 'locals'], '',
    ),
    'proto': (
        12, 'p.proto',
        'package a.b;\nmessage Zed {\n  string x = 1; // }\n}\nservice S {\n  rpc Get (Zed) returns (Zed);\n  rpc Put (Zed) returns (Zed) {}\n}\n',
        [(2, 4, 'message Zed', 'message Zed'), (5, 8, 'service S — Get, Put', 'service S')],
        'package a.b — 1 message, 1 service', ['message Zed', 'service S'], '',
    ),
    'sql': (
        13, 's.sql',
        '-- c\nCREATE TABLE zed (\n  id int\n);\nCREATE UNIQUE INDEX i ON zed (id);\nCREATE FUNCTION f() RETURNS int AS $$\n select 1;\n$$ LANGUAGE sql;\n',
        [(2, 4, 'table zed', 'table zed'), (5, 5, 'index i on zed', 'index i on zed'), (6, 8, 'function f', 'function f')],
        'SQL — 1 table, 1 index, 1 function', ['table zed', 'index i on zed', 'function f'], '',
    ),
    'graphql': (
        14, 's.graphql',
        '# c\ntype Zed implements N {\n  x: Int # }\n}\nunion U =\n  | Zed\n  | B\nscalar Date\nextend type Zed { y: Int }\nquery { a }\nschema {\n  query: Q\n}\n',
        [(2, 4, 'type Zed', 'type Zed'), (5, 7, 'union U', 'union U'), (8, 8, 'scalar Date', 'scalar Date'), (9, 9, 'type Zed', 'type Zed'), (10, 10, 'query (anonymous #1)', 'query (anonymous #1)'), (11, 13, 'schema', 'schema')],
        'GraphQL — 2 types, 1 union, 1 scalar, 1 query, 1 schema', ['type Zed', 'union U', 'scalar Date', 'type Zed', 'query (anonymous #1)', 'schema'], '',
    ),
    'ruby': (
        15, 'a.rb',
        '# class No\nclass Zed < B\n  def self.make(x)\n    x.each do |y|\n      z\n    end\n  end\n  def ok? = true\n  def one; 1; end\n  T = <<~EOS\n    class Hidden\n  EOS\nend\n\nmodule M\nend\n',
        [(2, 13, 'class Zed — self.make, ok?, one', 'class Zed'), (15, 16, 'module M', 'module M')],
        'Ruby — 1 class, 1 module, 3 methods', ['class Zed', 'module M'], '',
    ),
    'kotlin': (
        16, 'Zed.kt',
        'package a\n/* class No {\n*/\nclass Zed(\n    val x: Int,\n) {\n    val c = \'{\'\n    fun one(): Int { return 1 }\n    suspend fun <T> List<T>.two() = "}"\n    companion object {\n        fun make() = Zed(1)\n    }\n    private fun String.three(): String {\n        fun inner() {}\n        return this\n    }\n}\n\ndata class Pair2(val a: Int)\nsealed class R {\n}\nenum class E { A, B }\nfun String.top(x: Int) = x\nfun main() {\n    val s = """\n    class Hidden {\n    """\n}\nobject O\n',
        [(4, 17, 'class Zed — one, List, companion.make, String.three', 'class Zed'), (19, 19, 'data class Pair2', 'data class Pair2'), (20, 21, 'sealed class R', 'sealed class R'), (22, 22, 'enum class E', 'enum class E'), (23, 23, 'fun String.top', 'fun String.top'), (24, 28, 'fun main', 'fun main'), (29, 29, 'object O', 'object O')],
        'Kotlin — 1 class, 1 data class, 1 sealed class, 1 enum class, 1 object, 2 funs, 4 methods', ['class Zed', 'data class Pair2', 'sealed class R', 'enum class E', 'fun String.top', 'fun main', 'object O'], '',
    ),
    'java': (
        17, 'A.java',
        'package a;\n/* class No {\n*/\n@X\npublic final class Zed {\n  // {\n  private int n = 1;\n  public int f(int x) {\n    return g(x);\n  }\n  static { h(); }\n  List<String> names() { return null; }\n}\ninterface B\n{\n  void m();\n}\n',
        [(5, 13, 'final class Zed — f, names', 'final class Zed'), (14, 17, 'interface B — m', 'interface B')],
        'Java — 1 final class, 1 interface, 3 methods', ['final class Zed', 'interface B'], '',
    ),
    'swift': (
        18, 'A.swift',
        'import X\n/* outer /* class No { */ } */\n@MainActor\npublic final class Zed: B {\n    let s = "}"\n    init(x: Int) {\n    }\n    @IBAction func go(_ x: Any) {\n        func inner() {}\n    }\n    deinit { }\n    static func make() -> Zed { Zed(x: 1) }\n}\nextension Zed\n    where T: P {\n    func more() {}\n}\nopen class Base {}\nenum E: String {\n    case a\n}\nfunc free() {}\n',
        [(4, 13, 'final class Zed — init, go, init, make', 'final class Zed'), (14, 17, 'extension Zed — more', 'extension Zed'), (18, 21, 'class Base', 'class Base')],
        'Swift — 1 class, 1 final class, 1 extension, 5 funcs', ['final class Zed', 'extension Zed', 'class Base'], '',
    ),
    'csharp': (
        19, 'A.cs',
        'using System;\nnamespace N.M\n{\n    [Serializable]\n    public sealed class Zed : IFoo\n    {\n        private readonly List<int> items = new();\n        public string Name { get; set; }\n        public Zed(int x) { }\n        public async Task<int> RunAsync(string s)\n        {\n            return s == @"{""" ? 1 : 2;\n        }\n        [HttpGet]\n        private static void Help() => Console.Write(\'}\');\n    }\n    /* class No { */\n    interface IFoo { }\n    public record struct P(int X);\n}\n',
        [(5, 16, 'sealed class Zed — List, Zed, RunAsync, Help', 'sealed class Zed')],
        'C# — 1 sealed class, 4 methods', ['sealed class Zed'], '',
    ),
    'cpp': (
        20, 'a.hpp',
        '#pragma once\n// class No {\nnamespace n {\nclass Fwd;\ntemplate <typename T>\nclass Zed : public B {\npublic:\n    Zed();\n    ~Zed();\n    virtual int size() const { return 1; }\n    void set(int x) {\n        if (x) { f(x); }\n    }\n    const char* raw = R"x(})" })x";\n};\n}\ntypedef struct {\n    int x;\n} Point;\ntypedef enum { A, B } Mode;\nenum class E : int\n{\n    A,\n};\nstruct S { int f(); };\nint main() { return 0; }\n',
        [(6, 15, 'class Zed — ~Zed, size, set', 'class Zed'), (17, 19, 'struct Point', 'struct Point'), (20, 20, 'enum Mode', 'enum Mode'), (21, 24, 'enum class E', 'enum class E')],
        'C/C++ — 1 class, 1 struct, 1 enum, 1 enum class, 3 methods', ['class Zed', 'struct Point', 'enum Mode', 'enum class E'], '',
    ),
    'scala': (
        21, 'A.scala',
        'package a\nimport b._\n/* /* class No { */ */\n@deprecated("x")\nsealed trait Zed {\n  def area: Double\n  protected def name_? : String = "}"\n}\ncase class P(x: Int)\ncase object Q extends Zed\nfinal class C\n  extends Zed {\n  def area = {\n    def inner = 1\n    inner\n  }\n}\nobject Main {\n  val s = """\n  class Hidden {\n  """\n  def main(a: Array[String]): Unit = {}\n}\n',
        [(5, 8, 'sealed trait Zed — area, name_?', 'sealed trait Zed'), (9, 9, 'case class P', 'case class P'), (10, 10, 'case object Q', 'case object Q'), (11, 17, 'final class C — area', 'final class C'), (18, 23, 'object Main — main', 'object Main')],
        'Scala — 1 final class, 1 case class, 1 object, 1 case object, 1 sealed trait, 4 defs', ['sealed trait Zed', 'case class P', 'case object Q', 'final class C', 'object Main'], '',
    ),
    'php': (
        22, 'A.php',
        '<?php\nnamespace A\\B;\nuse C\\D;\n// class No {\n#[Attr]\nabstract class Zed extends B\n    implements I\n{\n    private $s = \'a}\';\n    # function no() {}\n    public static function make(int $x): self {\n        return new self("{$x}");\n    }\n    abstract protected function run();\n    function text() {\n        return <<<\'EOT\'\nclass Hidden {\n    EOT;\n    }\n}\ninterface I {}\nfinal class F { function f() {} }\nfinal class G { }\nfunction free() { }\nenum E: string {\n}\n',
        [(6, 20, 'abstract class Zed — make, run, text', 'abstract class Zed'), (21, 26, 'interface I', 'interface I')],
        'PHP — 1 abstract class, 1 interface, 3 methods', ['abstract class Zed', 'interface I'], '',
    ),
    'dart': (
        23, 'a.dart',
        "import 'x.dart';\n/// class No {\n@immutable\nabstract class Zed<T> extends B\n    with M {\n  const Zed(this.x);\n  final int x = 1;\n  static Future<Map<String, List<int>>> load(String s) async {\n    return {'}': 1};\n  }\n  int get size => 1;\n  set size(int v) { }\n  @override\n  String toString() => '''\n  class Hidden {\n  ''';\n  Widget? build(BuildContext c) {\n    if (x) { y(); }\n  }\n}\nmixin M on B { void go() {} }\nextension on String { bool get blank => isEmpty; }\nextension Ext on List<int> {\n}\nsealed class S {}\nclass Alias = A with B;\nvoid main() {}\n",
        [(4, 20, 'abstract class Zed — size, size, toString, build', 'abstract class Zed'), (21, 24, 'mixin M', 'mixin M')],
        'Dart — 1 abstract class, 1 mixin, 4 methods', ['abstract class Zed', 'mixin M'], '',
    ),
    'elixir': (
        24, 'm.ex',
        'defmodule A.Zed do\n  @moduledoc """\n  def no do\n  """\n  use X\n  def f(x), do: x\n  def f(y) do\n    Enum.map(y, fn z -> z end)\n  end\n  defp g do\n    \'end\'\n  end\nend\ndefimpl P, for: A do\nend\n',
        [(1, 13, 'defmodule A.Zed — f, g', 'defmodule A.Zed'), (14, 15, 'defimpl P for A', 'defimpl P for A')],
        'Elixir — 1 module, 1 impl, 2 functions', ['defmodule A.Zed', 'defimpl P for A'], '',
    ),
    'lua': (
        25, 'm.lua',
        '--[[ function no() ]]\nlocal function zed(x)\n  for i = 1, 2 do local g = function() end end\nend\nM.h = function()\n  local s = [[ function q( ]]\nend\nfunction M:k() end\n',
        [(1, 8, 'module m — zed, M.h, M:k', '')],
        'Lua — m, 3 functions', ['module m'], '',
    ),
    'haskell': (
        26, 'M.hs',
        '{- a\n{- b -} data No = No -}\nmodule A.B where\nimport X\ndata Zed = Zed\nclass Eq a => C a where\n  m :: a\nf, g :: Int\nf = 1\n',
        [(1, 9, 'module A.B — Zed, C, f, g', '')],
        'Haskell — A.B, 2 types, 2 functions', ['type Zed', 'type C', 'fn f', 'fn g'], '',
    ),
    'r': (
        27, 'a.R',
        '# f <- function(no)\nsetClass(\'Zed\', representation(x = \'numeric\'))\nQ <- R6Class(\'Q\', list(\n  inner = function() 1\n))\nf <- function(x) {\n  g <- function(y) y\n}\nsetGeneric("area", function(s) 1)\n',
        [(1, 9, 'module a — Zed, Q, f, area', '')],
        'R — a, 2 classes, 2 functions', ['class Zed', 'class Q', 'fn f', 'fn area'], '',
    ),
    'ocaml': (
        28, 'm.ml',
        "(* let no = 1\n   (* *) *)\nopen X\nmodule Zed = Y\ntype 'a t = A\nlet rec f x = x\nlet _ = f 1\n  let inner = 2\nexception E\n",
        [(1, 9, 'module m — Zed, t, E, f', '')],
        'OCaml — m, 3 types, 1 function', ['type Zed', 'type t', 'type E', 'fn f'], '',
    ),
    'julia': (
        29, 'm.jl',
        '#= module No\n#= =# =#\nmodule Zed\nexport f\nabstract type Shape end\nend\nmutable struct P\n  x::Int\nend\nprimitive type Byte 8 end\nfunction Base.show(io, p)\n  s = """\n  function hidden()\n  """\n  for i in 1:2\n    a[end] = \'e\'\n  end\nend\nmacro m!(x) end\nconst K = 1\nf(x) = begin\n  function inner() end\nend\nstruct Q end\n',
        [(1, 24, 'module m — Zed, P, Byte, Q (+3)', '')],
        'Julia — m, 4 types, 3 functions', ['type Zed', 'type P', 'type Byte', 'type Q', 'fn Base.show', 'fn m!', 'fn K'], '',
    ),
    'clojure': (
        30, 'c.clj',
        '; (def no 1)\n(ns a.b (:require [x]))\n(defrecord Zed [a])\n(defn- f [x]\n  (def inner 1))\n(defmacro m [] "(")\n(defonce v 1)\n(def w 2)\n',
        [(1, 8, 'module a.b — Zed, f, m, v (+1)', '')],
        'Clojure — a.b, 1 type, 4 functions', ['type Zed', 'fn f', 'fn m', 'fn v', 'fn w'], '',
    ),
    'fsharp': (
        31, 'm.fs',
        '(* let no = 1 *)\nmodule A.B\nopen X\ntype Zed = A | B\nlet rec f x =\n  let inner = 1\n  x\nlet s = """\nlet hidden = 1\n"""\nlet inline g y = y\n',
        [(1, 11, 'module A.B — Zed, f, s, g', '')],
        'F# — A.B, 1 type, 3 functions', ['type Zed', 'fn f', 'fn s', 'fn g'], '',
    ),
    'erlang': (
        32, 'm.erl',
        '%% c\n-module(m).\n-record(zed, {a}).\n-type t() :: any().\nf() -> ok.\nf(A, {B, C}, "x,y") ->\n  g(A).\nf(A, B, C) -> 1.\n',
        [(1, 8, 'module m — zed, t, f/0, f/3', '')],
        'Erlang — m, 2 types, 2 functions', ['record zed', 'type t', 'fn f/0', 'fn f/3'], '',
    ),
    'zig': (
        33, 'src/m.zig',
        'const std = @import("std");\npub const Zed = struct {\n    pub fn inner() void {}\n};\nfn a() void {}\npub fn b() u8 { return 1; }\nexport fn c() void {}\nfn d() void {}\n',
        [(1, 8, 'module m — Zed, a, b, c (+1)', '')],
        'Zig — m, 1 type, 4 functions', ['type Zed', 'fn a', 'fn b', 'fn c', 'fn d'], '',
    ),
}


def _named(x: Column, key: Column) -> Column:
    for word in ("Zed", "zed"):
        x = F.replace(x, F.lit(word), F.concat(F.lit(word), key))
    return x


def _sql_named(x: str) -> str:
    return f"replace(replace({x}, 'Zed', 'Zed' || k), 'zed', 'zed' || k)"


def files(spark: SparkSession, sf_dir: str, parser: str) -> DataFrame:
    """The parser's file for every supplier, and one without structure beside each."""
    _, path, text, *_ = SOURCES[parser]
    key = F.col("s_suppkey").cast("string")
    s = _table(spark, sf_dir, "supplier")
    made = s.select(F.concat(key, F.lit("/" + path)).alias("path"), _named(F.lit(text), key).alias("text"))
    return made.union(s.select(F.concat(key, F.lit("/none/" + path)), F.lit("~\n")))


def _register(parser: str) -> None:
    number, path, _, entries, summary, symbols, notes = SOURCES[parser]
    native = parser in outline.OUTLINES
    values = ", ".join(f"({i}, {s}, {e}, {_sql_text(k)}, {_sql_text(name or '')})" for i, (s, e, k, name) in enumerate(entries, 1))
    sql = f"SELECT k || {_sql_text('/' + path)} AS path, ord, start_line, end_line, {_sql_named('kind')} AS kind" + (f", {_sql_named('symbol')} AS symbol" if not native else "")
    sql += f", {_sql_named(_sql_text(summary))} AS summary, {_sql_named(_sql_text('|'.join(symbols)))} AS symbols, {_sql_text(notes)} AS notes"
    sql += f" FROM (SELECT s_suppkey::VARCHAR AS k FROM supplier), (VALUES {values}) AS v(ord, start_line, end_line, kind, symbol)"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = files(spark, sf_dir, parser)
        if native:
            found = outline.outline(f, parser).select("path", "ord", "start_line", "end_line", "kind").join(outline.described(f, parser), "path")
        else:
            found = scanners.outline(f, parser)
        return found.withColumn("symbols", F.array_join("symbols", "|"))

    run.__name__ = f"f{number}_outline_{parser}"
    query(sql)(run)


for _parser in SOURCES:
    _register(_parser)
