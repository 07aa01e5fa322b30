"""What is printed and parsed again is the same tree."""

import pytest

from factloom.sources.printer import print_source
from factloom.sources.syntax import Node, parse

CASES = [
    "import a, { b as c } from './x';\nimport * as n from 'm';\nimport './s';\nexport { c as d };\nexport * from './y';\nexport default f(1);\n",
    "@Entry @Component struct S extends V<T> { @State x: number = 1; static readonly y?: string; constructor(private a = 1, ...r: any[]) { super(a); } get z(): number { return this.x; } abstract q(): void; }",
    "namespace N { export function g<T>(x: T): T { return x; } export enum E { A = 1, B } interface I { f(a: string): void; (x: number): string; k: Map<string, number[]>; } type U = string | null; }",
    "for (let i = 0, j = 1; i < 10; i++) { if (i in o) { continue; } else if (!(a && b || c)) break; } for (const [k, v] of m.entries()) f(k)(v); for (const p in q) {} do { x -= 2 ** -1; } while (x);",
    "try { await g?.(1)?.[2].h!; } catch (e) { throw new Error(`a ${e.message} b`); } finally { delete o.p; } switch (x) { case 1: f(); break; default: g(); }",
    "const f = async (a: number, b?: string) => a + (b, 1) * 2; const o = { a, 'b-c': 1, d() { return 1; }, ...r }; let t = x ? y : z ?? w; t ||= typeof t === 'u' as any; let s = a >> 2 >>> 1 << 3; var r2 = /a[/]b/g.test(s);",
    "let c = class extends D { }; (function () { return (a, b); })(); new (f())(1); -x ** 2 ;" .replace("-x ** 2", "(-x) ** 2"),
]


def shape(x):
    if isinstance(x, Node):
        return (x.kind, x.name, shape(x.value), shape(x.kids), {k: shape(v) for k, v in x.extra.items()})
    if isinstance(x, (list, tuple)):
        return [shape(y) for y in x]
    return x


def normal(tree):
    """Single statements and blocks of one count as equal."""

    def fix(n):
        if not isinstance(n, Node):
            return
        if n.kind in ("if", "while", "do", "for", "for-of", "for-in"):
            bodies = range(1, len(n.kids)) if n.kind == "if" else [len(n.kids) - 1]
            for i in bodies:
                if n.kids[i].kind != "block":
                    n.kids[i] = Node("block", n.kids[i].line, kids=[n.kids[i]])
        for k in [*n.kids, n.value, *n.extra.values()]:
            fix(k)
        if isinstance(n.value, list):
            for k in n.value:
                fix(k)

    fix(tree)
    return shape(tree)


@pytest.mark.parametrize("code", CASES)
def test_round_trip(code):
    text = print_source(parse(code))
    assert normal(parse(text)) == normal(parse(code))
    assert print_source(parse(text)) == text
