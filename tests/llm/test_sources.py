"""Syntax checks and origins of source files on literal cases."""

import ast
import random

import pytest

from codelens.llm import origins, syntax
from codelens.llm.parsing.checker import language_of, valid
from codelens.llm.parsing.gll import Grammar

GOOD = {
    "a.c": ['#include <stdio.h>\nstatic int f(int a, char *b) { for (int i = 0; i < 3; i++) { if (a > 1) return a; else a--; } return 0; }\nstruct p { int x; } q = { .x = 1 };\n', "", "// only a comment\n", "typedef struct { int a[3]; } t;\nint main(void) { do { x(); } while (1); switch (x) { case 1: break; default: y(); } }"],
    "a.go": ['package a\n\nimport "log"\n\nfunc f(a int, b string) (int, error) {\n\tif x := g(a); x > 1 {\n\t\treturn x, nil\n\t} else {\n\t\tlog.Print("}")\n\t}\n\tm := map[string]int{"a": 1}\n\tfor i, v := range m {\n\t\t_ = v + i\n\t}\n\treturn a, nil\n}\n', "package a\nconst s = `\n<<<<<<< left\nfunc (\n`\n", "package a\ntype T struct {\n\tA int\n\tB []string\n}\nfunc (t *T) M() {}\n"],
    "a.rs": ['use a::{b, c};\nimpl T for S { pub fn f(&self, x: i64) -> i64 { let mut y = x + 1; for i in 0..3 { println!("{}", i); } if x > 1 { return 2; } match y { 1 => 2, _ => { 3 } } } }\n', "/* a /* b } */ c */\nfn main() { let c = '\"'; let s = r#\"}\"#; }", "pub static A: &[u32] = &[\n 1, 2,\n];"],
    "a.py": ["def f(a, *, b=1):\n    '''doc'''\n    if a:\n        return [x for x in a if x]\n    elif b: pass\n    else:\n        raise ValueError(f'{a}')\n", "try:\n    x = 1\nexcept* E as e:\n    pass\nfinally:\n    y()\n", "match x:\n    case [1, *rest] if rest: pass\n    case {'a': 1}: pass\n", "class A(B, metaclass=C):\n    x: int = 1\n    async def f(self): await g()\n"],
    "a.js": ['import { a } from "./a";\nexport function f(x, y) {\n  var r = /[({\\["\']/g;\n  const t = `\n=======\n{ ${1 + 2} (\n`;\n  if (x) return y\n  else { x++ }\n}\n', "var f=function(m){for(var M=0;M<2;M++)m+=m[M];return m};if(!d.p){d.t=[1,2]}a.b=c(d,!1)", "class A extends B { static x = 1; get y() { return this.#z } }\nlet { a, ...b } = c, g = async (x) => await x;\n"],
    "a.ts": ["export class A {\n  private x: number = 1;\n  constructor(readonly a: string) { super(); }\n  f(a: number, b?: string): Promise<Array<string>> { return b as any; }\n}\nexport const t: number[] = [\n 1, 2,\n];\ninterface I<T> extends J { a: T; f(x: T): void }\ntype U = A | { b: string };\n"],
    "A.java": ['package a.b;\nimport java.util.List;\npublic class A<T> extends B implements C {\n  @Override public int f(List<String> a, int... b) throws E { for (String s : a) { log.info("x"); } try { g(); } catch (E | F e) { } return a.size() > 1 ? 1 : 2; }\n}\n', "class Blob { static final int[] t = {\n 0x1, 0x2,\n}; }"],
    "a.cs": ["using System;\nnamespace A\n{\n  public class B : C\n  {\n    public int X { get; set; }\n    public int F(int a) { if (a > 1) { return a; } foreach (var x in y) { Console.WriteLine($\"{x}\"); } return 0; }\n  }\n}\n"],
    "a.rb": ["require 'json'\nclass A < B\n  def f(a, b)\n    28.times do |i|\n      x = a * 2 + i\n    end\n    if a > 1\n      puts \"x\"\n    else\n      return b\n    end\n    while a < 3\n      a = a + 1\n    end\n  end\nend\n", "x = <<~T\n  if this { (\nT\ny = [\n  1, 2,\n].freeze\n"],
    "a.sh": ['#!/bin/bash\nset -eu\nf() {\n  local a=$1 b=$2\n  if [ "$a" -gt 3 ]; then\n    echo "$(g "$a")"\n  else\n    x=$(( a + 1 ))\n  fi\n  for i in $(seq 1 3); do echo "$i"; done\n  while [ "$a" -lt 3 ]; do\n    a=$(( a + 1 ))\n  done\n}\ncat <<\'T\'\nif [ this {\nT\ncase "$1" in a|b) echo x ;; *) exit 1 ;; esac\narr=(\n 1 2\n)\n'],
}
BAD = ["{", "(a, b", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", "<!DOCTYPE html>\n<html><body><p>a</p></body></html>", "@@ -1,2 +1,2 @@\n-  x = (1\n+}\n"]


@pytest.mark.parametrize("path", GOOD)
def test_valid_sources(path):
    for text in GOOD[path]:
        assert valid(text.encode(), path, None) is True, text
        assert valid(("\ufeff" + text).replace("\n", "\r\n").encode(), path, None) is True, text


@pytest.mark.parametrize("path", GOOD)
def test_invalid_sources(path):
    body = GOOD[path][0]
    for bad in BAD:
        assert valid((body + "\n" + bad).encode(), path, None) is False, bad
    for end in (")", "}", "fi") if path == "a.sh" else (")", "}"):
        assert valid((body + "\n" + end + "\n").encode(), path, None) is False
    assert valid("\ufeff".encode("utf-16") + body.encode("utf-16"), path, None) is False
    numbered = "\n".join(f"{i:4}  {x}" for i, x in enumerate(body.split("\n"), 1))
    assert valid(numbered.encode(), path, None) is False
    other = GOOD["a.py" if path != "a.py" else "a.go"][0]
    if path not in ("a.sh",):
        assert valid(other.encode(), path, None) is False


def test_python_agrees_with_its_own_parser():
    rng = random.Random(7)
    pieces = ["if a:", "    b = 1", "else:", "def f(x):", "    return x", "x = (1, 2)", "    y", "for i in a:", "        z()", "try:", "except E:", "pass", "a = b if c else d", "print(*a, **b)", "lambda: 0", "x: int", "del a", "with a as b: pass", "@d", "class A: pass"]
    same = 0
    for _ in range(600):
        text = "\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5))) + "\n"
        try:
            compile(text, "x", "exec", ast.PyCF_ONLY_AST)
            want = True
        except SyntaxError:
            want = False
        assert valid(text.encode(), "a.py", None) is want, text
        same += want
    assert 20 < same < 580


def test_gll_handles_ambiguity_and_left_recursion():
    g = Grammar("S: S S | 'a' |\nT: T '+' T | n\nU: 'a' U 'b' |", {"n": "n"}, {})
    assert g.matches(("S", "T", "U"), "aaaa") == {"S"}
    assert g.matches(("S", "T", "U"), "n+n+n") == {"T"}
    assert g.matches(("S", "T", "U"), "aabb") == {"U"}
    assert g.matches(("S", "T", "U"), "") == {"S", "U"}


def test_check_of_rows(spark):
    rows = [(1, "r", "x/a.py", "Python", b"x = (", 1), (1, "r", "x/a.py", "Python", b"x = (", 1), (2, "r", "x/a.py", None, b"x = 1", 1), (3, None, "a.unknown", "cobol", b"??", 1), (4, "r", None, "go", None, 1), (5, "q", "a.rs", "", b"fn f() {}", 1)]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, path string, language string, content binary, rejected int")
    got = {r.file_id: (r.language, r.rejected) for r in syntax.check(df).collect()}
    assert got == {1: ("python", True), 2: ("python", False), 3: (None, None), 4: ("go", False), 5: ("rust", False)}
    assert {(r.repo, r.language, r.files, r.rejected) for r in syntax.rates(syntax.check(df)).collect()} == {("r", "python", 2, 1), ("r", "go", 1, 0), ("q", "rust", 1, 0)}
    assert syntax.check(df.limit(0)).collect() == []
    assert language_of("a/b.PY", "nonsense") == "python"


HAND = """
// note 0
function load(a, b) {
  const rest = b.filter((x) => x > a);
  if (!rest.length) {
    return null;
  }
  return rest[0] + a;
}

class Store {
  constructor(name) {
    this.name = name;
    this.items = new Map();
  }
  get(key) {
    while (!this.items.has(key)) {
      key = key.parent;
    }
    return this.items.get(key);
  }
}
export default new Store("main");
"""


def test_kinds():
    hand = "// Copyright (c) the acme contributors.\nimport x from 'y';\n" + HAND
    kind = lambda p, t: origins.kind_of(p, t.encode())
    assert kind("r/src/a.js", hand) is None
    assert kind("r/vendor/a.js", hand) == kind("r/node_modules/x/a.js", hand) == "vendored"
    assert kind("r/vendors/a.js", hand) is None and kind("r/generators/a.js", hand) is None and kind("r/third_party_x.js", hand) is None
    assert kind("r/a.js", "// Code generated by foo v1. DO NOT EDIT.\n" + hand) == "generated"
    assert kind("r/a.js", "// This file was automatically generated by foo; changes will be lost.\n" + hand) == "generated"
    assert kind("r/a.js", hand.replace("// note 0", "// @generated files are skipped by this\n// never DO NOT EDIT by hand")) is None
    assert kind("r/a.js", 'const banner = "/* auto-generated, do not edit */";\n' + hand) is None
    assert kind("r/a.js", "/*! vendored from foo@12ab */\n" + hand) == "vendored"
    assert kind("r/a.js", "var a=function(b){for(var c=0;c<9;c++)b+=b[c];return b};" * 40) == "minified"
    assert kind("r/a.js", "(function(modules) {\n  var cache = {};\n})({})") == "minified"
    assert kind("r/a.py", "T = [\n" + "\n".join("    " + ", ".join(str(i * j % 977) for j in range(12)) + "," for i in range(30)) + "\n]\n") == "data"
    assert kind("r/a.py", 'T = "' + "AbC9+/" * 200 + '"\n') == "data"
    assert kind("r/a_pb2.py", "\n".join(f"_F{i} = d.Find('x.f{i}', index={i})" for i in range(20))) == "generated"
    assert kind("r/a.py", "") is None and kind(None, hand) is None


SHAPES = ["def f{0}(a):\n    return g{1}(a, {2})", "x{0} = y{1} + {2}", "class C{0}:\n    size = {1}\n\n    def m{2}(self):\n        pass", "if a{0}:\n    b{1}()\nelse:\n    c{2}()", "for i in z{0}:\n    print(i, w{1})"]


def test_copies_in_many_repositories(spark):
    rng = random.Random(9)
    body = lambda: ("\n".join(rng.choice(SHAPES).format(*(rng.randrange(10**6) for _ in range(3))) for _ in range(40))).encode()
    shared, twice = body(), body()
    rows = [(i, f"repo{i}", f"repo{i}/src/x{i}.py", b"# repo0 - all rights reserved.\n" + shared, "k") for i in range(7)]
    rows += [(10 + i, f"repo{i}", f"repo{i}/y.py", twice, "k") for i in range(2)] + [(20 + i, "repo1", f"repo1/z{i}.py", body(), "k") for i in range(9)] + [(30, None, None, None, "k"), (31, "repo2", "repo2/e.py", b"", "k"), rows[1]]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, path string, content binary, kind string")
    got = {r.file_id: r.kind for r in origins.classify(df).collect()}
    assert got == dict.fromkeys(range(1, 7), "vendored")
    assert origins.classify(df.limit(0)).collect() == []
