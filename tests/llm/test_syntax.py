"""The syntax checker on snippets of each language and on whole modules."""

import ast
import glob
import os
import re
import warnings

import pytest

from codelens.llm.parsing.checker import Language, checker, valid
from codelens.llm.parsing.gll import Grammar

GOOD = {
    'rb': [
        'puts 1\n',
        'x = a * 2 + i\n',
        '28.times do |i|\n x = 1\nend\n',
        'if a > 1\n puts "x"\nelse\n return b\nend\n',
        'while a < 3\n a = a + 1\nend\n',
        'def f(a, b)\n a\nend\n',
        'class A < B\n def f\n 1\n end\nend\n',
        "require 'json'\n",
        '->(a) { }.call\n',
        'case x\nin {a:, b: 1}\n 2\nend\n',
        'case [1,2]\nin [a, b]\n a\nend\n',
        'x = <<~T\n if this { (\nT\ny = [\n 1, 2,\n].freeze\n',
        'a.map { |x| x + 1 }.each do |y|\n puts y\nend\n',
        'puts "a#{b["c"]}d"\n',
        'foo(a, b: 1, **c, &d)\n',
        'def x = 1\n',
        'a ||= {}\n',
        "raise Foo, 'x' unless y\n",
        'attr_reader :a, :b\n',
        'begin\n a\nrescue E => e\n b\nensure\n c\nend\n',
        'x = if a then b else c end\n',
        '@a, b = b, @a\n',
        'yield a, b\n',
        'a&.b\n',
        'puts [1, 2].sum\n',
        'private def x; end\n',
        'loop do\n break if x\nend\n',
        'x = y ? 1 : 2\n',
        'a = b.c d do |e|\n f\nend\n',
        'puts(<<~X)\n abc\nX\n',
        "h = { 'a' => 1, b: 2 }\n",
        'def self.x(a = 1, *b, c:, d: 2, **e, &f)\nend\n',
        '%w[a b].each(&:c)\n',
        'a =~ /x y/\n',
        'module A::B\nend\n',
        'expect(x).to eq 1\n',
        "it 'does' do\n  a\nend\n",
        'case x\nwhen 1, 2 then 3\nwhen A\n 4\nelse 5\nend\n',
        'a.b = c\n',
        'a[1] = 2\n',
        'return a, b\n',
        'x = a and b\n',
        'alias a b\n',
        'a += 1 while a < 3\n',
        'puts -x\n',
        'x = *a\n',
        'for i in 1..3 do puts i end\n',
        'def ==(o)\n a == o.a\nend\n',
        'class << self\n def x; end\nend\n',
        'a.each_with_index { |(k, v), i| p k }\n',
        'super\n',
        'a = b rescue c\n',
        'A.new(1).b\n',
        'if !a && b || c\n d\nelsif e\n f\nend\n',
        'a = [\n 1,\n 2\n]\n',
        'x.y(\n a,\n b\n)\n',
        'foo\n  .bar\n  .baz(1)\n',
        'x = -> { 1 }\ny = lambda do |a|\n a\nend\n',
        'def a\n b\nrescue StandardError, X => e\n c\nelse\n d\nend\n',
        "puts 'a' if a == 1 and not b\n",
        '%i[a b]\n',
        "$stderr.puts 'x'\n",
        'A = Struct.new(:a) do\n def x; end\nend\n',
        'until x do y end\n',
        'a <<= 1\n',
        'def a?; !@b; end\n',
    ],
    'sh': [
        'done_x=1\nwhile read x; do :; done | sort > x 2>&1 &\n',
        'while read l; do echo $l; done < <(ls)\n',
        '(cd /; ls)\n',
        'if [ -f x ]; then echo; fi\n',
        'case $1 in a) x;; *) y;; esac\n',
        'f() { echo "$(g "$a")"; }\n',
        'echo if then\n',
        'x=$(if true; then echo 1; fi)\n',
        'cat <<EOF | grep x\nabc (\nEOF\n',
        '[[ $a == b* ]] && c || d\n',
        'for i in a b; do x; done\n',
        'for ((i=0;i<3;i++)); do x; done\n',
        '(( x++ ))\n',
        'a=(1 2 3)\n',
        'x=1 y=2 cmd\n',
        'echo "${a[@]}" > /dev/null\n',
        'if x; then y; elif z; then w; else v; fi\n',
        "set -e; trap 'x' EXIT\n",
        'function f { x; }\n',
        '! grep x y\n',
        'a && { b; c; }\n',
        'echo $((1+2)) ${x:-y}\n',
        'case x in\n a|b)\n y\n ;;\nesac\n',
        'until x; do y; done\n',
        'export A="$(pwd)/x"\n',
        'local x="${1:?usage}"\n',
        'select x in a b; do y; done\n',
        'if (true); then x; fi\n',
        '{ (ls); }\n',
        'cmd <<< "$x"\n',
        'echo a \\\n  b\n',
        'exec 3>&1\n',
        '[ "$a" = "b" ] || exit 1\n',
        'tar -C "$d" -xf - | (cd x && y)\n',
    ],
    'py': [
        "f'{x!r:>{w}}'\n",
        'f"{x["a"]}"\n',
        'case = 1\nmatch = case\n',
        'match x:\n case A(x=1) | B():\n  pass\n',
        "print(*a, sep='')\n",
        'x = yield\n',
        'def f(a, /, b=1, *c, d, e=2, **g): pass\n',
        'lambda a, *b, c=1: (yield)\n',
        'with (a as b, c): pass\n',
        'async def f():\n async with a as b, c:\n  async for x in y: await z\n',
        'x: int\n',
        'def f[T: int](x: T) -> T: ...\n',
        'type X[T] = list[T]\n',
        'try:\n a\nexcept* E as e:\n b\n',
        'del a, b[1], (c, d)\n',
        'a, *b = c\n',
        'for x, in y: pass\nelse: pass\n',
        'a[1:2, ::3, *b]\n',
        "{**a, 'b': 1}\n",
        '@d(1)\n@e\nclass A(B, metaclass=C): pass\n',
        'if (n := 1) > 0: pass\n',
        'global a, b\n',
        'assert a, b\n',
        'from .. import a as b, c\n',
        'from .a.b import (c, d,)\n',
        'x = a if b else c\n',
        'raise A from b\n',
        'not a in b is not c\n',
        'f(x for x in y)\n',
        'f(a, *b, c=1, *d, **e)\n',
        'if a:\n\tb\n\tc\n',
    ],
    'js': [
        'with (a) {}\n',
        'const f = (a, {b, c = 1}, [d], ...e) => ({a});\n',
        'x = `a${b}c${`d${e}`}`;\n',
        'a?.b?.[c]?.(d);\n',
        'for (const x of y) z\n',
        'for await (const x of y) {}\n',
        'label: for (;;) { continue label }\n',
        "class A { #x = 1; static { y } get z() { return 1 } async *w() {} 'a' = 1; [b]() {} }\n",
        "export * from 'x'; export { a as default }; import b, * as c from 'y';\n",
        'var a = 1, b\nlet c\nd()\n',
        'if (a) b\nelse c\n',
        'return_ = function* () { yield* x }\n',
        'switch (a) { case 1: b; break; default: c }\n',
        'try { a } catch { b } finally { c }\n',
        'a = b\n++c\n',
        '({a, b} = c);\n',
        'new A().b(c)\n',
        'new.target\n',
        "import('x').then(y)\n",
        'async () => { await x }\n',
        'do x(); while (y)\n',
        'a => b => c\n',
        'var x = /[/]/g, y = a / b / c;\n',
        'x = a ? b : c ? d : e\n',
        'if (a) { } else if (b) { } else { }\n',
        'export default function () {}\n',
        'const App = () => <div className="a" {...b} c={d}>text {e} <F/></div>;\n',
        'x = <></>\n',
        'var let_ = {if: 1, class: 2, get a() { return 1 }, set a(b) {}, async c() {}, [d]: e, ...f}\n',
        'a.if.class\n',
        'throw new Error(`x`)\n',
    ],
    'tsx': [
        'const a = <T,>(x: T) => <B<C> d={x as any}>y</B>\n',
        'export const X: FC<P> = ({a}) => { return (<div>{a.map((b) => (<li key={b}>{b}</li>))}</div>); }\n',
    ],
    'ts': [
        'type P = { [K in keyof T]?: T[K] }\n',
        'type M = { -readonly [K in keyof T]-?: T[K] };\n',
        'namespace A.B { export const x = 1 }\n',
        "declare module 'x' { export function f(a: string): void; }\n",
        'function f(x: any): asserts x is string {}\n',
        'const f = <T,>(a: T) => a\n',
        "abstract class A<T extends B = C> extends D<T> implements E, F { private readonly x: number = 1; abstract y(): void; constructor(private a: string, public b?: number) { super() } static z = 1; get w(): string { return '' } [k: string]: any }\n",
        "enum A { B = 1, C, 'D' = 2 }\n",
        'let x = y as unknown as Z; let w = <any>v; a!.b!;\n',
        'function f(this: A, b?: string, ...c: number[]): b is string;\n',
        'type A = B extends infer C extends D ? E : F\n',
        "export type { A } from 'b'; import type { C } from 'd';\n",
        'let f: (a: string, b?: number) => void = g;\n',
        'type T = [a: string, b?: number, ...c: D[]]\n',
        "let x: typeof import('y');\n",
        '@Dec({a: 1}) export class A { @Input() b: string; }\n',
        'type A = `a${string}`\n',
        'const x = a satisfies B;\n',
        'export abstract class A {}\n',
        'declare global { interface Window { a: string } }\n',
        "let x: A['b'][]\n",
        'function f<const T extends readonly unknown[]>(x: T) {}\n',
        'export default interface A { b: string }\n',
        'for (const [a, b] of c.d<E>()) {}\n',
        'let u: unique symbol; type G = abstract new (...a: any) => any;\n',
        'const a = b < c, d = e > f;\n',
        'type U =\n  | A\n  | B;\n',
        "import a = require('b');\n",
        'class A { declare x: string; override y() {} accessor z = 1 }\n',
    ],
    'java': [
        'sealed interface A permits B, C {}\n',
        'class A { int f(int x) { return switch (x) { case 1 -> 2; case 2, 3 -> { yield 4; } default -> throw new E(); }; } }\n',
        'record P(int x, int y) { P { if (x < 0) throw new E(); } static int z = 1; }\n',
        'module a.b { requires transitive c.d; exports e to f, g; provides h with i; }\n',
        '@A(b = {1, 2}) class C {}\n',
        'class A { void f() { try (R r = g(); s) { } catch (E | F e) { } finally { } } }\n',
        'class A { Object o = (Runnable & Serializable) () -> {}; }\n',
        'class A<T extends B & C> { <U> A(U u) { this.<U>f(u); } int[] a = {1, 2}, b[]; int f(int... x)[] { return null; } }\n',
        'class A { void f() { if (o instanceof P(int x, var y) && x > 0) {} for (var i : l) {} int[][] a = new int[3][]; List<? super X> l = new ArrayList<>(); Runnable r = A::new; x = y ? z : w; } }\n',
        'enum E { A(1) { void f() {} }, B; E() {} E(int x) {} }\n',
        '@interface A { int x() default 1; String[] y() default {}; }\n',
        'class A { static { } { } synchronized void f() { synchronized (x) { } assert x : y; label: while (true) { break label; } do { } while (x); } }\n',
        'class A { void f() { switch (x) { case A: case B: y(); break; default: } switch (o) { case String s when s.isEmpty() -> a(); case null, default -> {} } } }\n',
        'interface A { default void f() {} private static int g() { return 1; } }\n',
        'non-sealed class A extends B {}\n',
        'class A { String s = """\n x "y"\n """; char c = \'\\\'\'; long l = 0xFFL; }\n',
        'class A { void f() { int x = (int) y; foo((a, b) -> a + b, c -> c); new B() { void g() {} }.h(); a.b().new C(); } }\n',
    ],
    'cs': [
        'var q = from x in xs where x > 1 orderby x descending select new { x, y = 1 };\n',
        'class A { public int this[int i] { get => a[i]; set { } } }\n',
        'class A { bool f(object o) => o is { X: > 1 and < 3, Y: null } or int; }\n',
        'class A { void f() { foreach (var (a, b) in c) { } (int x, int y) = z; var t = (1, 2); } }\n',
        'record P(int X, int Y);\n',
        'public record struct P(int X) { public int Y { get; init; } = 1; }\n',
        'namespace A;\nclass B { int? x = y?.z ?? w; string s = $"{a:F2} {b}"; }\n',
        'class A { int f(int x) => x switch { 1 => 2, > 3 and < 5 => 3, _ => throw new E() }; }\n',
        'class A { async Task<int> f() { await using var x = y; return await z; } }\n',
        'class A<T> where T : class, new() { public static A<T> operator +(A<T> a, A<T> b) => a; public static implicit operator int(A<T> a) => 1; ~A() {} event E e; delegate void D(int x); }\n',
        '[A, B(1, C = 2)] public class D { [E] int x; }\n',
        'class A { void f() { switch (x) { case 1: case 2: break; case string s when s.Length > 1: return; default: goto case 1; } for (int i = 0, j = 1; i < 3; i++, j--) { } using (var a = b) { } lock (x) { } try { } catch (E e) when (e.x) { } finally { } } }\n',
        'class A { A(int x) : base(x) { } int[] a = { 1, 2 }; int[,] b = new int[2, 3]; Func<int, int> f = x => x + 1; List<int> l = [1, 2, ..m]; }\n',
        'using A = B.C; using static D; global using E;\nConsole.WriteLine(1);\n',
        'class A { void f() { int local(int x) => x; if (o is not null) { } var a = b as C; x = y is int z ? z : 0; var (p, q) = r; foo(out var s, ref t, name: 1); } }\n',
        'class A { required public string B { get; set; } void f(params int[] x) { } unsafe int* p; string v = @"a""b"; }\n',
    ],
    'c': [
        'int x = _Generic(y, int: 1, default: 2);\n',
        'int f(void) { return (struct A){1}.x; }\n',
        'int f(a, b) int a; char *b; { return a; }\n',
        '[[nodiscard]] int f(void) { return nullptr == 0; }\n',
        'int f(int x) { switch (x) { case 1 ... 3: return 1; } return ({ int y = 1; y; }); }\n',
        'typedef int (*F)(int, char *);\nstruct A { int x : 3; union { int y; }; } a[2] = { [0] = { .x = 1 }, };\n',
        'static inline void f(const char *restrict s, ...) { for (;;) { if (s) continue; else break; } do { x++; } while (0); lab: goto lab; }\n',
        'int (*fs[3])(void), *p, **q;\nextern int a[];\n',
        '#ifdef A\nint f(int x) {\n#else\nint f(long x) {\n#endif\nreturn x; }\n',
        'enum E { A = 1, B, };\nunsigned long long x = 0xFFULL;\nvoid f(int n, int a[static n]) { sizeof(int); sizeof x; (void)n; }\n',
        'int main(int argc, char **argv) { printf("%d" PRId64 "x", (int)argc); return a ? b : c; }\n',
        'struct s *f(struct s *a) { return a->b.c[1]; }\n',
        '__attribute__((unused)) static int x;\nvoid (*signal(int sig, void (*func)(int)))(int);\n',
    ],
    'go': [
        'package a\nfunc f(x any) { switch v := x.(type) { case int: _ = v; default: } }\n',
        'package a\nfunc Map[T, U any](a []T, f func(T) U) []U { return nil }\ntype N interface { ~int | ~string; F(int) error }\n',
        'package a\nimport (\n\t"a"\n\tb "c"\n)\nvar x = map[string][]int{"a": {1, 2}}\nconst (\n\tA = iota\n\tB\n)\n',
        'package a\nfunc (s *S[T]) F(a, b int, c ...string) (x int, err error) {\n\tdefer func() { recover() }()\n\tgo f()\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\tcase c <- 1:\n\tdefault:\n\t}\nouter:\n\tfor i := 0; i < 3; i++ {\n\t\tcontinue outer\n\t}\n\tfor range c {\n\t}\n\tif x, ok := m[1]; ok {\n\t} else if y {\n\t} else {\n\t}\n\treturn\n}\n',
        'package a\ntype T struct {\n\tA int `json:"a"`\n\t*B\n\tC, D string\n}\nvar f = func(a int) int { return a }\nvar _ = []struct{ a int }{{1}, {2}}\nvar c chan<- int = make(chan int)\nvar g = T{A: 1}.A\n',
        'package a\nfunc f() {\n\tx := a.\n\t\tb().\n\t\tc()\n\ty := &T{}\n\tz := arr[1:2:3]\n\tw := x.(int)\n\tswitch {\n\tcase a > b, c:\n\t\tfallthrough\n\tdefault:\n\t}\n\tvar i interface{} = <-ch\n\t*p = 1\n\ti++\n}\n',
    ],
    'rs': [
        'macro_rules! m { ($x:expr) => { $x + 1 }; }\n',
        "fn f<'a, T: A + 'a>(x: &'a mut T) -> impl Iterator<Item = u8> + 'a where T: B { x.iter().map(|y| y + 1) }\n",
        'fn f() { let Some(x) = y else { return }; if let Some(a) = b && c { } match x { 1 | 2 => a, 3..=5 if z => { b } A { x, .. } => c, _ => d } }\n',
        'impl<T> A for B<T> { type C = D; const E: i32 = 1; fn f(&self) {} }\n',
        '#[derive(A)] pub struct B<T>(pub T, u8);\npub enum C { D, E(u8), F { x: u8 } = 2 }\n',
        "fn f() { let x = vec![1, 2]; let c = move || { 1 }; loop { break 'a 1; } 'a: while true { } for i in 0..n { } unsafe { *p } ; x as u8 as i32; a..b; ..; &mut x[..]; }\n",
        'async fn f() -> Result<(), Box<dyn E>> { g().await?; Ok(()) }\n',
        'pub(crate) use a::{b, c::*, d as e};\nextern "C" { fn g(x: *const u8); }\nstatic X: &str = r#"a"#;\nconst fn h() {}\n',
        'fn f(x: fn(i32) -> i32, y: &dyn Fn(u8) -> u8, [a, b]: [u8; 2]) { A::<B>::c(); <D as E>::f(); s.t.0.1; if x == (A { b: 1 }) {} }\n',
        "trait A: B + C where D: E { fn f(self: Box<Self>); type G<'a>: H where Self: 'a; }\n",
    ],
}
BAD = {
    'py': [
        'f(a=1, 2)\n',
        'f(**a, *b)\n',
        'def f(a=1, b): pass\n',
        '1 = x\n',
        'f() = 3\n',
        '{1: 2, 3}\n',
        'del 1\n',
        '"a" = 1\n',
        'f"{a"\n',
        'f"{a b}"\n',
        'if a:\n\tb\n        c\n',
        'assert 1, 2, 3\n',
        'x = (1, 2\n',
        'if a:\nb\n',
        'else: pass\n',
        'def f(*, **k): pass\n',
        'a + not b\n',
        'print x\n',
        'x = [1, 2\n',
        'try: a\n',
    ],
    'js': [
        'const x;',
        'try { }',
        '1 = x;',
        'if (a {',
        'function () {}',
        'a b',
        'class A { x y }',
        'let x = ;',
        'x = `${a b}`;',
        'return }',
        'for (;) {}',
        'case 1: x',
        '<<<<<<< HEAD',
    ],
    'ts': [
        'interface A { b c }',
        'let x: = 1;',
        'type A',
        'enum { }',
        '1 = x',
    ],
    'java': [
        'class A { f() { } }',
        'class A { void f() { 5; } }',
        'class A { int x = ; }',
        'class A { void f( { } }',
        'class A { try { } }',
        'void',
        'class A { void f() { try { } } }',
        'class A { void f() { else { } } }',
    ],
    'cs': [
        'class A { void f() { int x = ; } }',
        'class A { f() { } }',
        'class A {',
        'class A { void f() { try { } } }',
        'namespace { }',
    ],
    'c': [
        'int f( { }',
        'int x = ;',
        '#if A\nint x;\n',
        'if (a) b;',
        'int f() { else x; }',
        'int f() { return 1 }',
        '#endif\n',
    ],
    'go': [
        'package a\nfunc f( {}\n',
        'func f() {}\n',
        'package a\nx := 1\n',
        'package a\nfunc f() { if x\n{ } }\n',
        'package a\nvar x\n',
        'package a\nfunc f() { case 1: }\n',
    ],
    'rs': [
        'fn f( {}',
        'fn f() { let x = ; }',
        'struct A { b c }',
        'fn f() { match x { 1 2 } }',
        'let x = 1;',
    ],
    'rb': [
        'while a; when 1; end\n',
        'def f\n',
        'if a\n else\n else\nend\n',
        'end\n',
        'puts "#{a b c d(}"\n',
        'class a\nend end\n',
        'foo(\n',
        'x = = 1\n',
    ],
    'sh': [
        'x=$(if true; then)\n',
        'if a; then b\n',
        'case x in a) b\n',
        'done\n',
        'for i in a; do b\n',
        'fi\n',
        'f() {\n',
        'echo "$(g"\n',
        "echo 'a\n",
        '(a; b\n',
        'if a then b; fi\n',
        ')\n',
    ],
}


@pytest.mark.parametrize("ext", GOOD)
def test_valid_snippets(ext):
    assert [t for t in GOOD[ext] if valid(t.encode(), f"a.{ext}", None) is not True] == []


@pytest.mark.parametrize("ext", BAD)
def test_broken_snippets(ext):
    assert [t for t in BAD[ext] if valid(t.encode(), f"a.{ext}", None) is not False] == []


@pytest.mark.parametrize("n", [1, 12, 13, 100, 1000])
def test_same_rules_at_every_size(n):
    """Contents are judged alike however long they are, the broken member last or first."""
    for head, tail in (("interface P {", "}"), ("type P = {", "};")):
        fields = " ".join(f"field{i}: string;" for i in range(n))
        assert valid(f"{head} {fields} {tail}".encode(), "a.ts", None) is True
        assert valid(f"{head} {fields} a b c {tail}".encode(), "a.ts", None) is False
        assert valid(f"{head} a b c; {fields} {tail}".encode(), "a.ts", None) is False
    body = "".join(f"x{i} = f(x, {i});\n" for i in range(n))
    for ext, head, tail in (("js", "function f() {", "}"), ("c", "void f(int x) {", "}"), ("java", "class A { void f() {", "} }"), ("go", "package a\nfunc f() {\n", "}\n"), ("rs", "fn f() {", "}")):
        assert valid(f"{head}{body}{tail}".encode(), f"a.{ext}", None) is True, ext
        assert valid(f"{head}{body} ) {tail}".encode(), f"a.{ext}", None) is False, ext
        assert valid(f"{head}{body} if {tail}".encode(), f"a.{ext}", None) is False, ext
    lines = "".join(f"    x{i} = f(x, {i})\n" for i in range(n))
    assert valid(f"def f():\n{lines}".encode(), "a.py", None) is True
    assert valid(f"def f():\n{lines}    a b\n".encode(), "a.py", None) is False


@pytest.mark.parametrize("depth", [1, 30, 80])
def test_nested_statements(depth):
    assert valid(("if (a) {" * depth + "}" * depth).encode(), "a.js", None) is True
    assert valid(("if (a) b; else " * depth + "c;").encode(), "a.js", None) is True
    text = "".join("  " * i + f"if x{i}:\n" for i in range(min(depth, 90))) + "  " * min(depth, 90) + "pass\n"
    assert valid(text.encode(), "a.py", None) is True
    assert valid(("if x\n" * depth + "end\n" * depth).encode(), "a.rb", None) is True
    assert valid(("if x\n" * depth + "end\n" * (depth - 1)).encode(), "a.rb", None) is False


def test_prefixes_change_nothing():
    """With and without memoised prefixes the same texts are derived."""
    for name, ext in (("javascript", "js"), ("ruby", "rb"), ("rust", "rs"), ("bash", "sh")):
        g = checker(name).grammar
        islands, texts = g.islands, GOOD[ext] + BAD[ext]
        with_ = [valid(t.encode(), f"a.{ext}", None) for t in texts]
        checker(name).groups.clear()
        checker(name).fragments.clear()
        g.islands = frozenset()
        try:
            assert [valid(t.encode(), f"a.{ext}", None) for t in texts] == with_
        finally:
            g.islands = islands


def test_agrees_with_the_standard_library():
    warnings.simplefilter("ignore")
    other = []
    for p in sorted(glob.glob(os.path.dirname(os.__file__) + "/*.py")):
        content = open(p, "rb").read()
        try:
            ast.parse(content)
            want = True
        except SyntaxError:
            want = False
        if valid(content, p, None) is not want:
            other.append(p)
    assert other == []


def test_declared_encoding():
    assert valid("# coding: latin-1\nx = 'é'\n".encode("latin-1"), "a.py", None) is True
    assert valid("x = 'é'\n".encode("latin-1"), "a.py", None) is False
    assert valid(b"# coding: nonsense\nx = 1\n", "a.py", None) is False


@pytest.mark.parametrize("ext, head, tail", [("rb", "if a\n", "end\n"), ("sh", "if a; then\n", "fi\n")])
def test_blocks_of_words_are_prefixes_at_once(ext, head, tail, monkeypatch):
    """A nested statement is run over at once, not on each doubling of its prefixes."""
    run, seen, depth = Grammar._run, [], 30
    monkeypatch.setattr(Grammar, "_run", lambda self, starts, part, *rest: seen.append(part) or run(self, starts, part, *rest))
    calls = "".join(f"{head}b {', '.join('c' * (i + 1)) if ext == 'rb' else 'c ' * i}\n" for i in range(depth))
    assert Language({"rb": "ruby", "sh": "bash"}[ext]).valid(calls + tail * depth)
    assert len(seen) < 4 * depth


def test_outlines_change_nothing():
    """Where statements are thought to end decides on the prefixes only, however wrong it is."""
    for name, ext in (("ruby", "rb"), ("bash", "sh")):
        for blocks in (r"(x)|(x)|[;\n]", r"(\n)|(;)|i", r"(i)|([;\n])|s", r"()()\Z"):
            language = Language(name)
            language.grammar.blocks = re.compile(blocks)
            assert [language.valid(t) for t in GOOD[ext]] == [True] * len(GOOD[ext])
            assert [language.valid(t) for t in BAD[ext]] == [False] * len(BAD[ext])
