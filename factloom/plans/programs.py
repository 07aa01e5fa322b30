"""Queries over parsed programs: source texts made of table rows, parsed, lowered and analysed.

Each supplier gives the files of one small program per topic, with its key for ``{k}``. What is expected of a topic stands beside its text, written
from the rules of the analysed language and not from this engine's results; :func:`golden` makes DuckDB SQL of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cfg, resolve, ssa, statements, structure
from ..sources.printer import print_files
from ..sources.project import Program, parse_files
from ..tables import durable
from . import analysis, checkers, inference, pointers, views

PROJECT = "shop"
#: Files that one task parses; their facts, some 40 kB a file, are sorted by table in its memory.
MOST_FILES = 2_000
#: topic: {file: text}
SOURCES = {
    "loop": {"loop{k}.ts": """
function f{k}(n) {
  let s = 0;
  for (let i = 0; i < n; i++) { if (i == 3) continue; s += i; }
  return s;
}"""},
    "label": {"label{k}.ts": """
function g{k}(m) {
  outer: while (m > 0) {
    do { m--; if (m == 7) break outer; } while (m > 5);
  }
  switch (m) { case 1: m = 10; break; case 2: m = 20; default: m = 30; }
  return m;
}"""},
    "pattern": {"pattern{k}.ts": """
function h{k}(p) {
  let [, b] = p;
  let {a: {c}, d = 2} = p;
  for (const [x, y] of p) { b = x; }
  const z = b && p.run();
  return z;
}"""},
    "types": {"types{k}.ts": """
class A{k} { x: number = 1; next(): A{k} { return this; } name(): string { return 'a'; } }
class B{k} extends A{k} { }
namespace N { export class C { z = 1; m(): number { return 1; } } export function make(): C { return new C(); } }
function id(): A{k} { return new A{k}(); }
function main() {
  let a = new B{k}();
  let b = a.next();
  let c = b.name();
  let d = b.x;
  let e = id();
  let f = N.make();
  let g = f.m();
  let h = 1 < 2;
  let i = 'q' + 1;
  let j = b;
  let ks = [1, 2];
  ks.forEach(v => { let w = v; });
  let l = new N.C();
  let m = a.x;
  let n = 2 * 3;
  let o = i && j;
  let u = p;
}"""},
    "calls": {
        "lib{k}.ts": """
export abstract class Base { abstract go(): void; run() { this.go(); } }
export class P extends Base { go() {} }
export class Q extends Base { go() {} }
export function help() { }
export namespace U { export function deep() { inner(); } function inner() { } export class W { z() { } } }""",
        "idx{k}.ts": """
export { P as R, help as aid } from './lib{k}';
export { U } from './lib{k}';""",
        "app{k}.ts": """
import { R, aid, U } from './idx{k}';
import * as L from './lib{k}';
function main() { let r = new R(); r.run(); aid(); U.deep(); let w = new U.W(); w.z(); let q = new L.Q(); }
function side() { L.help(); let cb = aid; cb(); }""",
    },
    "zero": {"zero{k}.ts": """
function none(): number { let z = 0; return z; }
function pass(q) { return q; }
function main() {
  let a;
  let b = a;
  let c = none();
  let d = 5 / c;
  let e = 1;
  let f = 6 / e;
  let g = pass(0);
  let h = pass(a);
  e = 0;
  let i = 7 % e;
  let j = b.x;
  let o = new Object();
  o.f = undefined;
  let l = o.f;
  a = 3;
  let m = a.y;
  b = h.w;
}"""},
    "ssa": {"ssa{k}.ts": """
function s{k}(c) {
  let i = 1;
  if (c > 0) { i = 2; }
  let j = i;
  while (j < 9) { j = j + i; }
  return j;
}"""},
    "text": {"text{k}.ts": """
import   {a as b}   from './x{k}'
export   class K{k}<T>   extends L   implements M { private  static y:number=1 ; constructor(p:string){super(p);this.z=p ?? 'n'}
 get v():number{return this.w*(1+2)} }
namespace S{k}{ export function f(...r:number[]):void{ for(const q of r)if(q>2)break; else continue } }
outer:for(let i=0;i<3;i++){ try{ g(i) }catch(e){ throw e }finally{ h() } }
const t = `n${1+{k}}m`, [u,,v=2] = w, o = {p, q: 1, ...r};
export { t as default }"""},
    "entity": {"entity{k}.ts": """
import D, { x as y } from './m';
import * as ns from 'lib/n';
export namespace O { export namespace I { export class C{k}<T> { private static readonly s: number = {k}; t?: string; constructor(a: number, b?: string) { } get g(): number { return 1; } async m(): void { } } } }
export default class E extends D implements F1, F2 { f = 1; static h; }
interface J { k(): void; }
enum G { R, S = 5 }
export const w = 1;
export { w as ww };"""},
    "state": {"state{k}.ets": """
@Component struct Child { @Prop label: string; build() { Text(this.label).fontSize(3) } }
@Builder function foot() { Row() { Text('foot') } }
@Entry @Component struct Main{k} {
  @State count: number = 0;
  @StorageLink('s') list: string[] = [];
  plain: number = 1;
  @BuilderParam slot: () => void;
  @Builder head() { Text('head ' + this.count) }
  build() {
    Column() {
      this.head()
      if (this.count > 3) { Text('many') } else { Button('add').onClick(() => { this.count++ }) }
      ForEach(this.list, (item: string) => { ListItem() { Child({ label: item }) } })
      Child({ label: 'a' }).width(this.plain)
      this.slot()
      foot()
    }.height(this.plain)
  }
}"""},
    "pointer": {"pointer{k}.ts": """
class Cell { held; static last; put(v) { this.held = v; } get() { return this.held; } }
class X { go() { return new Cell(); } }
class Y extends X { go() { let y = new Cell(); return y; } }
function same(v) { return v; }
function dead() { let d = new X(); d.go(); }
function main() {
  let c = new Cell();
  let x = new X();
  c.put(x);
  let g = c.get();
  let r = g.go();
  let y = new Y();
  let s = same(y);
  let t = s.go();
  Cell.last = y;
  let u = Cell.last;
}"""},
    "body": {"body{k}.ts": """
function b{k}(n, m) {
  let s = 0;
  while (n > 0) {
    if (n == 7) { break; }
    if (m) { s = s + n; } else { run(s); }
    n = n - m;
  }
  for (let i = 0; i < 3; i++) { if (i == m) continue; s = i; }
  switch (m) { case 1: s = 1; break; default: s = 2; }
  if (s < 4) { s = 5; }
  return s;
}"""},
    "global": {
        "glob{k}.ts": """
export let top = 1;
let low = 2;
export namespace V { export let inner = 3; let low = 4; export class H { static z = 1; m() { return low; } } }""",
        "user{k}.ts": """
import { top as t, V } from './glob{k}';
let own = t;""",
    },
    "local": {"local{k}.ts": """
class T { }
function main(p) {
  let a = p;
  let b = a;
  let c = b;
  let d = 5;
  let e = d;
  let f = c.g;
  let h = f;
  let i = new T(7);
  for (let j = 0; j < 3; j++) { while (p) { p = d; } }
  switch (d) { case 1: break; default: return; }
}"""},
}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DEFAULT = "@shop/%s{k}: _DEFAULT_CLASS"


def quoted(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"CAST({x} AS BIGINT)"


def golden(columns: list[str], rows: list[tuple]) -> str:
    """DuckDB SQL of ``rows`` for each supplier, with its key for ``{k}``."""
    texts = [any(isinstance(r[i], str) for r in rows) for i in range(len(columns))]
    take = ", ".join(f"replace(g.{c}, '{{k}}', CAST(s_suppkey AS VARCHAR)) AS {c}" if t else f"g.{c}" for c, t in zip(columns, texts))
    values = ",\n".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    return f"SELECT {take} FROM supplier CROSS JOIN (VALUES\n{values}\n) g({', '.join(columns)})"


def program_query(topic: str, columns: str, rows: list[tuple]):
    """Register a query over the program of ``topic`` that takes it as a :class:`Program`; ``rows`` are what it gives, by supplier."""

    def register(fn):
        def run(s: SparkSession, d: str) -> DataFrame:
            return fn(program_of(s, d, topic)).select(*columns.split())

        QUERIES[fn.__name__] = run
        ORACLES[fn.__name__] = golden(columns.split(), rows)
        return fn

    return register


def source_files(s: SparkSession, d: str, topic: str) -> DataFrame:
    """(path, code): the files of a topic's program for each supplier."""
    key = F.col("s_suppkey").cast("string")
    files = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("code")) for p, c in SOURCES[topic].items()])).alias("f")
    put = lambda c: F.replace(c, F.lit("{k}"), key)
    suppliers = s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey")
    # a small table of keys becomes large texts and far larger facts: its rows are dealt so that what a task makes of them is bounded
    n = suppliers.count() * len(SOURCES[topic])
    tasks = max(1, -(-n // MOST_FILES), min(s.sparkContext.defaultParallelism, n // 100))
    return suppliers.repartition(tasks, "s_suppkey").select("s_suppkey", files).select(put(F.col("f.path")).alias("path"), put(F.col("f.code")).alias("code"))


def program_of(s: SparkSession, d: str, topic: str) -> Program:
    return Program(parse_files(source_files(s, d, topic), PROJECT))


def named(p: Program) -> DataFrame:
    return p["method"].select("path", F.col("sig").alias("method_sig"), F.col("name").alias("method"))


def following(p: Program) -> DataFrame:
    """(path, method, text, next): each statement with those that may come after it."""
    s = durable(p["stmt"].join(named(p), ["path", "method_sig"]).where("method not like '%DEFAULT%' and method <> 'constructor'").withColumn("at", analysis.statement_number()), "stmts")
    key = F.concat_ws("\n", "path", "method_sig")
    edges = p["edge"].select(key.alias("method"), "src", "dst")
    pairs = cfg.next_statements(s.select(key.alias("method"), "block", "idx", F.col("at").alias("stmt")), edges)
    side = lambda n, t: s.select(key.alias("m"), F.col("at").alias(n), F.col("text").alias(t), F.col("path").alias(f"path_{n}"), F.col("method").alias(f"method_{n}"))
    both = pairs.withColumnRenamed("method", "m").join(side("stmt", "text"), ["m", "stmt"]).join(side("next", "after"), ["m", "next"])
    return both.select(F.col("path_stmt").alias("path"), F.col("method_stmt").alias("method"), "text", F.col("after").alias("next")).distinct()


def chain(path: str, method: str, *pairs: str) -> list[tuple]:
    """Rows of :func:`following` from ``a -> b -> c`` texts."""
    out = []
    for p in pairs:
        steps = p.split(" -> ")
        out += [(path, method, a, b) for a, b in zip(steps, steps[1:])]
    return out


@program_query("loop", "path method text next", chain(
    "loop{k}.ts", "f{k}",
    f"n = parameter0: unknown -> this = this: {DEFAULT % 'loop'} -> s = 0 -> i = 0 -> if i >= n -> if i != 3 -> goto -> i = i + 1 -> if i >= n -> return s",
    "if i != 3 -> s = s + i -> i = i + 1",
))
def program_loop(p):
    return following(p)


@program_query("label", "path method text next", chain(
    "label{k}.ts", "g{k}",
    f"m = parameter0: unknown -> this = this: {DEFAULT % 'label'} -> if m <= 0 -> m = m - 1 -> if m != 7 -> goto -> switch(m) {{1, 2, default}} -> m = 10 -> goto -> return m",
    "if m != 7 -> if m <= 5 -> m = m - 1", "if m <= 5 -> if m <= 0 -> switch(m) {1, 2, default} -> m = 20 -> m = 30 -> return m", "switch(m) {1, 2, default} -> m = 30",
))
def program_label(p):
    return following(p)


@program_query("pattern", "path method text next", chain(
    "pattern{k}.ts", "h{k}",
    f"p = parameter0: unknown -> this = this: {DEFAULT % 'pattern'} -> b = p[1] -> $temp0 = p.a -> c = $temp0.c -> $temp1 = p.d -> if $temp1 !== undefined -> $temp2 = 2 -> d = $temp2 -> $temp3 = lengthof p -> $temp4 = 0",
    "if $temp1 !== undefined -> $temp2 = $temp1 -> d = $temp2",
    "$temp4 = 0 -> if $temp4 >= $temp3 -> $temp5 = p[$temp4] -> x = $temp5[0] -> y = $temp5[1] -> b = x -> $temp4 = $temp4 + 1 -> if $temp4 >= $temp3 -> $temp6 = b -> if $temp6 == 0",
    "if $temp6 == 0 -> $temp6 = instanceinvoke p.<run>() -> z = $temp6 -> return z", "if $temp6 == 0 -> z = $temp6",
))
def program_pattern(p):
    return following(p)


A, B, C = "@shop/types{k}: A{k}", "@shop/types{k}: B{k}", "@shop/types{k}: N.C"
TYPES = {"a": B, "b": A, "c": "string", "d": "number", "e": A, "f": C, "g": "number", "h": "boolean", "i": "string", "j": A, "ks": "(number)[]", "l": C, "m": "number", "n": "number", "o": "boolean", "u": "unknown"}


@program_query("types", "path method name type", [("types{k}.ts", "main", n, t) for n, t in TYPES.items()] + [("types{k}.ts", "AnonymousFunc$main$0", n, "number") for n in "vw"])
def program_types(p):
    t = inference.infer_types(p).join(named(p), ["path", "method_sig"])
    return t.where("name <> 'this' and not startswith(name, '$') and (method = 'main' or method like 'Anonymous%')")


@program_query("types", "path typed locals resolved calls", [("types{k}.ts", 17, 18, 9, 10)])
def program_accuracy(p):
    # next, name, id, make, m and four constructors, one of them inherited, are the project's; forEach is not
    return inference.accuracy(p)


LIB, APP = "@shop/lib{k}: ", "@shop/app{k}: _DEFAULT_CLASS."
CALLS = [
    (APP + "main", LIB + "Base.run"), (APP + "main", LIB + "_DEFAULT_CLASS.help"), (APP + "main", LIB + "U._DEFAULT_CLASS.deep"), (APP + "main", LIB + "U.W.z"),
    (APP + "side", LIB + "_DEFAULT_CLASS.help"), (LIB + "Base.run", LIB + "P.go"), (LIB + "Base.run", LIB + "Q.go"), (LIB + "U._DEFAULT_CLASS.deep", LIB + "U._DEFAULT_CLASS.inner"),
]


@program_query("calls", "caller target", CALLS)
def program_cha(p):
    return analysis.call_graph(p)


@program_query("calls", "caller target", [c for c in CALLS if not c[0].endswith("side")])
def program_rta(p):
    entries = analysis.method_scopes(p).where("caller like '%.main'").select(F.col("caller").alias("method"))
    return analysis.call_graph(p, "rta", entries)


@program_query("calls", "caller n_callees callees", [
    (APP + "main", 4, "Base.run, U.W.z, U._DEFAULT_CLASS.deep, _DEFAULT_CLASS.help"), (APP + "side", 1, "_DEFAULT_CLASS.help"), (LIB + "Base.run", 2, "P.go, Q.go"), (LIB + "U._DEFAULT_CLASS.deep", 1, "U._DEFAULT_CLASS.inner"),
])
def program_callees(p):
    short = F.regexp_replace("target", "^.*: ", "")
    return analysis.call_graph(p).groupBy("caller").agg(F.count_distinct("target").alias("n_callees"), F.array_join(F.sort_array(F.collect_set(short)), ", ").alias("callees"))


@program_query("calls", "path scope kind name entity", [
    ("app{k}.ts", "@shop/app{k}: ", "class", "R", LIB + "P"), ("app{k}.ts", "@shop/app{k}: ", "function", "aid", LIB + "_DEFAULT_CLASS.help()"), ("app{k}.ts", "@shop/app{k}: ", "namespace", "U", LIB + "U"),
    ("app{k}.ts", "@shop/app{k}: ", "class", "U.W", LIB + "U.W"), ("app{k}.ts", "@shop/app{k}: ", "function", "U.deep", LIB + "U._DEFAULT_CLASS.deep()"), ("app{k}.ts", "@shop/app{k}: ", "function", "U.inner", LIB + "U._DEFAULT_CLASS.inner()"),
    *[("app{k}.ts", "@shop/app{k}: ", "class", "L." + c, LIB + c) for c in ("Base", "P", "Q", "U.W")], *[("app{k}.ts", "@shop/app{k}: ", "function", "L." + f, LIB + g) for f, g in (("help", "_DEFAULT_CLASS.help()"), ("U.deep", "U._DEFAULT_CLASS.deep()"), ("U.inner", "U._DEFAULT_CLASS.inner()"))],
    ("app{k}.ts", "@shop/app{k}: ", "namespace", "L.U", LIB + "U"), *[("app{k}.ts", "@shop/app{k}: ", "function", f, APP + f + "()") for f in ("main", "side")],
])
def program_names(p):
    return analysis.visible_entities(p).where("path like 'app%'")


@program_query("zero", "path method line name", [("zero{k}.ts", "main", 8, "c"), ("zero{k}.ts", "main", 14, "e")])
def program_zero_divisions(p):
    return checkers.zero_divisions(p).join(named(p), ["path", "method_sig"]).withColumn("line", F.col("line").cast("long"))


@program_query("zero", "path method line name", [("zero{k}.ts", "main", 15, "b"), ("zero{k}.ts", "main", 18, "o.f"), ("zero{k}.ts", "main", 21, "h")])
def program_undefined(p):
    return checkers.undefined_uses(p).join(named(p), ["path", "method_sig"]).withColumn("line", F.col("line").cast("long"))


@program_query("ssa", "path made uses", [
    ("ssa{k}.ts", "c#0", ""), ("ssa{k}.ts", "this#0", ""), ("ssa{k}.ts", "i#0", ""), ("ssa{k}.ts", "", "c#0"), ("ssa{k}.ts", "i#1", ""), ("ssa{k}.ts", "i#2", "i#0, i#1"), ("ssa{k}.ts", "j#0", "i#2"),
    ("ssa{k}.ts", "j#1", "j#0, j#2"), ("ssa{k}.ts", "", "j#1"), ("ssa{k}.ts", "j#2", "i#2, j#1"), ("ssa{k}.ts", "", "j#1"),
])
def program_ssa(p):
    m = F.xxhash64("path", "method_sig").alias("method")
    key = named(p).where("method like 's%'").select("path", m)
    edges = p["edge"].select(m, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    blocks = p["block"].select(m, F.col("block").cast("long").alias("block"))
    stmts = p["stmt"].select(m, F.col("block").cast("long").alias("block"), "idx", "def", "uses")
    done = ssa.to_ssa(edges, blocks, stmts).join(key, "method")
    return done.select("path", F.coalesce("def", F.lit("")).alias("made"), F.array_join(F.sort_array("uses"), ", ").alias("uses"))


@program_query("ssa", "path name line users", [
    ("ssa{k}.ts", "c", 2, 1), ("ssa{k}.ts", "i", 4, 2), ("ssa{k}.ts", "j", 6, 3),
])
def program_locals(p):
    s = p["stmt"].withColumnRenamed("method_sig", "method")
    last = statements.declaring_statements(s).join(s.select("path", "method", "block", "idx", "line"), ["method", "block", "idx"])
    users = statements.using_statements(s)
    both = last.join(users, ["method", "name"]).where("name <> 'this'")
    return both.select("path", "name", F.col("line").cast("long").alias("line"), F.size("users").cast("long").alias("users"))


TEXT = """import { a as b } from './x{k}';
export class K{k}<T> extends L implements M {
  private static y: number = 1;
  constructor(p: string) {
    super(p);
    this.z = p ?? 'n';
  }
  get v(): number {
    return this.w * (1 + 2);
  }
}
namespace S{k} {
  export function f(...r: number[]): void {
    for (const q of r) {
      if (q > 2) {
        break;
      } else {
        continue;
      }
    }
  }
}
outer:
for (let i = 0; i < 3; ++ i) {
  try {
    g(i);
  } catch (e) {
    throw e;
  } finally {
    h();
  }
}
const t = 'n' + (1 + {k}) + 'm', [u,,v=2] = w, o = { p: p, q: 1, ...r };
export { t as default };
"""


def program_print(s: SparkSession, d: str) -> DataFrame:
    """The text of each file, printed from its tree."""
    return print_files(source_files(s, d, "text"))


QUERIES["program_print"] = program_print
ORACLES["program_print"] = golden(["path", "text"], [("text{k}.ts", TEXT)])

E1 = "@shop/entity{k}: "
ENTITIES = [
    ("namespace", E1 + "O", "exported"), ("namespace", E1 + "O.I", "exported"), ("class", E1 + "O.I.C{k}", "class <T> exported"), ("class", E1 + "E", "class extends D implements F1, F2 exported default"), ("class", E1 + "J", "interface"), ("class", E1 + "G", "enum"),
    ("field", E1 + "O.I.C{k}.s", "private static readonly number"), ("field", E1 + "O.I.C{k}.t", "string"), ("field", E1 + "E.f", "unknown"), ("field", E1 + "E.h", "static unknown"), ("field", E1 + "G.R", "static number"), ("field", E1 + "G.S", "static number"),
    ("method", E1 + "O.I.C{k}.constructor(number, string)", "unknown"), ("method", E1 + "O.I.C{k}.Get-g()", "number"), ("method", E1 + "O.I.C{k}.m()", "async void"), ("method", E1 + "J.k()", "abstract void"), ("method", E1 + "E.constructor()", "unknown"),
    ("param", E1 + "O.I.C{k}.constructor(number, string)", "0 a number"), ("param", E1 + "O.I.C{k}.constructor(number, string)", "1 b string optional"),
    ("import", "D", "Identifier ./m"), ("import", "y", "NamedImports ./m x"), ("import", "ns", "NamespaceImport lib/n *"),
    ("export", "O", "namespace"), ("export", "E", "class default"), ("export", "w", "variables"), ("export", "ww", "NamedExports w"), ("export", "I", "namespace"), ("export", "C{k}", "class"),
]


@program_query("entity", "kind sig detail", ENTITIES)
def program_entities(p):
    flag = lambda c, word: F.when(F.col(c), F.lit(word))
    words = lambda *c: F.concat_ws(" ", *[F.when(x != "", x) for x in c])
    table = lambda t, sig, *c: p[t].select(F.lit(t).alias("kind"), F.col(sig).alias("sig"), words(*c).alias("detail"), *([F.col("name")] if t in ("class", "method") else []))
    join = lambda c, before="", after="": F.when(F.size(c) > 0, F.concat(F.lit(before), F.array_join(c, ", "), F.lit(after)))
    out = table("namespace", "sig", flag("is_exported", "exported"))
    own = "name not like '%DEFAULT%'"
    out = out.unionByName(table("class", "sig", F.col("origin"), join("type_params", "<", ">"), F.concat(F.lit("extends "), "super_name"), join("interfaces", "implements "), flag("is_exported", "exported"), F.when(F.array_contains("modifiers", "default"), F.lit("default"))).where(own).drop("name"))
    out = out.unionByName(table("field", "sig", F.array_join("modifiers", " "), F.col("type")))
    out = out.unionByName(table("method", "sig", F.array_join("modifiers", " "), flag("is_abstract", "abstract"), F.col("return_type")).where(own).drop("name"))
    out = out.unionByName(table("param", "method_sig", F.col("ord").cast("string"), F.col("name"), F.col("type"), flag("optional", "optional")))
    out = out.unionByName(table("import", "clause", F.col("kind"), F.col("from_spec"), F.col("name_before_as")))
    return out.unionByName(table("export", "clause", F.col("kind"), F.col("from_spec"), F.col("name_before_as"), F.when(F.col("is_default"), F.lit("default"))))


@program_query("entity", "text", [
    ("this.s = {k}".replace("this", "C{k}"),), ("this.t = undefined",), ("this.f = 1",), ("E.h = undefined",),
])
def program_field_values(p):
    return p["stmt"].where("kind = 'assign' and left_member is not null")


@program_query("entity", "scope name ord", [("O.I.C{k}", "t", 0), ("O.I.C{k}", "s", 1), ("E", "f", 0), ("E", "h", 1), ("G", "R", 0), ("G", "S", 1)])
def program_member_order(p):
    from pyspark.sql import Window

    # members of objects come before those of their class
    w = Window.partitionBy("class_sig").orderBy("is_static", "ord")
    return p["field"].select(F.regexp_replace("class_sig", "^.*: ", "").alias("scope"), "name", (F.row_number().over(w) - 1).cast("long").alias("ord"))


MAIN, CHILD = "@shop/state{k}: Main{k}.build()", "@shop/state{k}: Child.build()"


@program_query("state", "tree path", [
    ("Main{k}.build()", x) for x in (
        "Column", "Column/Builder", "Column/If", "Column/If/IfBranch", "Column/If/IfBranch", "Column/If/IfBranch/Text", "Column/If/IfBranch/Button", "Column/ForEach", "Column/ForEach/ListItem", "Column/ForEach/ListItem/ViewPU",
        "Column/__Common__", "Column/__Common__/ViewPU", "Column/BuilderParam", "Column/Builder",
    )
] + [("Child.build()", "Text"), ("Main{k}.head()", "Text"), ("_DEFAULT_CLASS.foot()", "Row"), ("_DEFAULT_CLASS.foot()", "Row/Text")])
def program_view_tree(p):
    return views.paths(p).select(F.regexp_replace("method_sig", "^.*: ", "").alias("tree"), F.array_join("path", "/").alias("path"))


@program_query("state", "component field n_nodes", [("Main{k}", "count", 3), ("Main{k}", "list", 1), ("Child", "label", 1)])
def program_view_states(p):
    return views.state_bindings(p).withColumn("component", F.regexp_replace("class_sig", "^.*: ", ""))


@program_query("state", "root held depth", [
    *[(r, r, 0) for r in ("Main{k}.build()", "Main{k}.head()", "Child.build()", "_DEFAULT_CLASS.foot()")], ("Main{k}.build()", "Main{k}.head()", 1), ("Main{k}.build()", "Child.build()", 1), ("Main{k}.build()", "_DEFAULT_CLASS.foot()", 1),
])
def program_view_parts(p):
    short = lambda c: F.regexp_replace(c, "^.*: ", "")
    return views.whole_trees(p).select(short("root").alias("root"), short("method_sig").alias("held"), F.col("depth").cast("long").alias("depth"))


@program_query("state", "kind name decorators", [
    ("class", "Child", "Component"), ("class", "Main{k}", "Entry,Component"), ("method", "foot", "Builder"), ("method", "head", "Builder"),
    ("field", "label", "Prop"), ("field", "count", "State"), ("field", "list", "StorageLink"), ("field", "slot", "BuilderParam"),
])
def program_decorators(p):
    out = None
    for t in ("class", "method", "field"):
        rows = views.decorated(p, t).select(F.lit(t).alias("kind"), "name", F.array_join("decorators", ",").alias("decorators"))
        out = rows if out is None else out.unionByName(rows)
    return out


@program_query("state", "field type", [("label", "Prop"), ("count", "State"), ("list", "StorageLink"), ("plain", "number"), ("slot", "() => void")])
def program_field_types(p):
    return views.field_types(p)


def program_decorators_in_text(s: SparkSession, d: str) -> DataFrame:
    """The decorators before names in source text."""
    names = F.explode(F.array(*[F.lit(x) for x in ("label", "count", "plain", "slot", "head")])).alias("name")
    found = F.coalesce(*[F.when(F.col("name") == n, F.array_join(views.decorators_in_text(F.col("code"), n), ",")) for n in ("label", "count", "plain", "slot", "head")])
    return source_files(s, d, "state").select("path", "code", names).select("path", "name", found.alias("decorators"))


QUERIES["program_decorators_in_text"] = program_decorators_in_text
ORACLES["program_decorators_in_text"] = golden(["path", "name", "decorators"], [("state{k}.ets", n, t) for n, t in (("label", "Prop"), ("count", "State"), ("plain", ""), ("slot", "BuilderParam"), ("head", "Builder"))])


PT, PM = "@shop/pointer{k}: ", "@shop/pointer{k}: _DEFAULT_CLASS."
POINTER_CALLS = [(PM + "main", PT + c) for c in ("Cell.constructor", "Cell.put", "Cell.get", "X.go", "Y.go", "_DEFAULT_CLASS.same")] + [(PT + "X.go", PT + "Cell.constructor"), (PT + "Y.go", PT + "Cell.constructor")]


def _entries(p: Program) -> DataFrame:
    return p["method"].where("name = 'main'").select(F.col("sig").alias("method_sig"))


@program_query("pointer", "caller target", POINTER_CALLS)
def program_pointer_calls(p):
    return pointers.pointer_analysis(p, _entries(p))["call_graph"]


@program_query("pointer", "method name class", [
    ("main", "c", "Cell"), ("main", "x", "X"), ("main", "g", "X"), ("main", "r", "Cell"), ("main", "y", "Y"), ("main", "s", "Y"), ("main", "t", "Cell"), ("main", "u", "Y"), ("same", "v", "Y"), ("put", "v", "X"), ("go", "y", "Cell"),
])
def program_points_to(p):
    done = pointers.pointer_analysis(p, _entries(p))["points_to"].where("ptr not like '\n%'")
    new = p["stmt"].where("op = 'new'").select(F.concat_ws("\n", "method_sig", F.col("block").cast("string"), F.col("idx").cast("string")).alias("obj"), F.col("member").alias("class"))
    sig, name = F.split("ptr", "\n")[0], F.split("ptr", "\n")[1]
    rows = done.select(sig.alias("method_sig"), name.alias("name"), "obj").where("name <> 'this' and not startswith(name, '$')").join(new, "obj")
    return rows.join(named(p), "method_sig").select("path", "method", "name", "class").distinct()


@program_query("pointer", "method", [(m,) for m in ("main", "put", "get", "go", "go", "same", "constructor")])
def program_pointer_reached(p):
    return pointers.pointer_analysis(p, _entries(p))["reached"].join(named(p), "method_sig")


@program_query("local", "name value", [
    ("a", "parameter"), ("b", "parameter"), ("c", "parameter"), ("d", "5"), ("e", "5"), ("f", "c.g"), ("h", "c.g"), ("i", "new T"),
])
def program_initial_values(p):
    s = p["stmt"].withColumnRenamed("method_sig", "method").withColumn("args", F.when(F.col("op") == "parameter", F.array(F.lit("parameter"))).when(F.col("op") == "field", F.array(F.concat_ws(".", F.get("args", F.lit(0)), "member"))).when(F.col("op") == "new", F.array(F.concat_ws(" ", F.lit("new"), "member"))).otherwise(F.col("args")))
    # p and d are given values again in the loop: the one that counts is the last, so only names with one are looked at
    once = s.where("not (def = 'p' and op = 'name')")
    return statements.initial_values(once).where("length(name) = 1 and name not in ('p', 'j')").select("name", F.get("args", F.lit(0)).alias("value"))


@program_query("local", "kind value", [("local", "h"), ("local", "f"), ("local", "c"), ("local", "b"), ("local", "a"), ("local", "p"), ("field", "c.g")])
def program_bound_values(p):
    s = p["stmt"].withColumnRenamed("method_sig", "method").where("not (def = 'p' and op = 'name')")
    return statements.bound_values(s).where("name = 'h'")


@program_query("local", "text number idx", [("$temp0 = new T", 9, 9), ("instanceinvoke $temp0.<constructor>(7)", 10, 10)])
def program_moved_calls(p):
    # the call is moved away by one statement and brought back
    s = p["stmt"].withColumnRenamed("method_sig", "method").where("method like '%main%'")
    away = s.withColumn("idx", F.when(F.col("member") == "constructor", F.col("idx") + 1).when(F.col("text") == "i = $temp0", F.col("idx") - 1).otherwise(F.col("idx")))
    back = statements.together(away)
    n = statements.numbered(back)
    return back.join(n, ["method", "block", "idx"]).where("op = 'new' or member = 'constructor'").select("text", F.col("number").cast("long").alias("number"), F.col("idx").cast("long").alias("idx"))


@program_query("local", "kind successors is_branch temporaries", [("if", 2, True, 0), ("switch", 2, True, 0), ("return_void", 0, False, 0), ("goto", 1, False, 0), ("assign", 1, False, 3), ("invoke", 1, False, 1)])
def program_statement_kinds(p):
    compound = statements.needs_temporary(F.col("op")) & F.col("kind").isin("assign", "invoke")
    by = p["stmt"].where("method_sig like '%main%'").groupBy("path", "kind", statements.is_branch(F.col("kind")).alias("is_branch"))
    return by.agg(F.max(statements.successor_count(F.col("kind"), F.col("args"))).cast("long").alias("successors"), F.sum(compound.cast("long")).alias("temporaries"))


@program_query("local", "text inside", [("if j >= 3", "if j >= 3"), ("p = d", "if p == 0"), ("if p == 0", "if p == 0"), ("j = j + 1", "if j >= 3")])
def program_inner_loops(p):
    edges, blocks, _ = (durable(x, "flow") for x in analysis.flow_graph(p))
    inner = statements.smallest_loops(cfg.loop_members(edges, blocks))
    first = p["stmt"].where("idx = 0").select(F.xxhash64("path", "method_sig").alias("method"), F.col("block").cast("long").alias("node"), "text")
    return inner.join(first, ["method", "node"]).join(first.select("method", F.col("node").alias("header"), F.col("text").alias("inside")), ["method", "header"])


@program_query("local", "text uses", [("d = 9", ""), ("a = q", "q"), ("b = a", "a")])
def program_changed_statements(p):
    """Uses of the parameter replaced by another name in one statement, and one put before another."""
    s = p["stmt"].withColumnRenamed("method_sig", "method").where("method like '%main%'")
    at = s.where("text = 'a = p'").select("method", "block", "idx")
    changed = statements.replace_uses(s, at.select("*", F.lit("p").alias("old"), F.lit("q").alias("new")))
    new = at.join(s, ["method", "block", "idx"]).withColumn("text", F.lit("d = 9")).withColumn("def", F.lit("d")).withColumn("uses", F.array().cast("array<string>")).withColumn("ord", F.lit(0)).select(*s.columns, "ord")
    done = statements.insert_before(changed, new)
    near = done.join(at.select("method", "block", F.col("idx").alias("from")), ["method", "block"]).where("idx between from and from + 2")
    text = F.concat(F.col("def"), F.lit(" = "), F.when(F.col("text") == "d = 9", "9").otherwise(F.get("args", F.lit(0))))
    return near.select(text.alias("text"), F.array_join("uses", ",").alias("uses"))


def shape(p: Program) -> tuple[DataFrame, DataFrame, DataFrame]:
    mine = named(p).where("method not like '%DEFAULT%'").select("path", "method_sig")
    return tuple(p[t].join(mine, ["path", "method_sig"], "left_semi") for t in ("block", "edge", "stmt"))


BODY = """s = 0;
while (n > 0) {
  if (n == 7) {
    break;
  }
  if (m) {
    s = s + n;
  } else {
    run(s);
  }
  n = n - m;
}
i = 0;
while (i < 3) {
  if (i != m) {
    s = i;
  }
  i = i + 1;
}
switch (m) {
  case 1:
    s = 1;
    break;
  default:
    s = 2;
    break;
}
if (s < 4) {
  s = 5;
}
return s;"""


@program_query("body", "path body", [("body{k}.ts", BODY)])
def program_bodies(p):
    return structure.bodies(*shape(p))


@program_query("body", "text kind", [
    ("if n <= 0", "while"), ("if n != 7", "if"), ("goto", "break"), ("if m == 0", "if_else"), ("if i >= 3", "for"), ("goto", "continue"), ("if i != m", "if_else"), ("if s >= 4", "if"), ("goto", "break"),
])
def program_block_kinds(p):
    last = p["stmt"].groupBy("path", "method_sig", F.col("block").cast("long").alias("block")).agg(F.max_by("text", "idx").alias("text"))
    return structure.block_types(*shape(p)).where("kind <> 'normal'").join(last, ["path", "method_sig", "block"])


@program_query("label", "text depth", [
    (f"m = parameter0: unknown", 0), ("if m <= 0", 1), ("m = m - 1", 2), ("goto", 3), ("if m <= 5", 3), ("switch(m) {1, 2, default}", 2), ("m = 10", 3), ("m = 20", 3), ("m = 30", 3), ("return m", 3),
])
def program_dominator_tree(p):
    first = p["stmt"].where("idx = 0").select("path", "method_sig", F.col("block").cast("long").alias("block"), "text")
    return structure.dominator_order(*shape(p)).join(first, ["path", "method_sig", "block"])


@program_query("global", "path scope name entity", [
    ("glob{k}.ts", "@shop/glob{k}: ", "top", "@shop/glob{k}: #top"), ("glob{k}.ts", "@shop/glob{k}: ", "low", "@shop/glob{k}: #low"), ("glob{k}.ts", "@shop/glob{k}: ", "V.inner", "@shop/glob{k}: V#inner"), ("glob{k}.ts", "@shop/glob{k}: ", "V.low", "@shop/glob{k}: V#low"),
    ("glob{k}.ts", "@shop/glob{k}: V", "top", "@shop/glob{k}: #top"), ("glob{k}.ts", "@shop/glob{k}: V", "low", "@shop/glob{k}: V#low"), ("glob{k}.ts", "@shop/glob{k}: V", "inner", "@shop/glob{k}: V#inner"), ("glob{k}.ts", "@shop/glob{k}: V", "V.inner", "@shop/glob{k}: V#inner"), ("glob{k}.ts", "@shop/glob{k}: V", "V.low", "@shop/glob{k}: V#low"),
    ("user{k}.ts", "@shop/user{k}: ", "own", "@shop/user{k}: #own"), ("user{k}.ts", "@shop/user{k}: ", "t", "@shop/glob{k}: #top"), ("user{k}.ts", "@shop/user{k}: ", "V.inner", "@shop/glob{k}: V#inner"), ("user{k}.ts", "@shop/user{k}: ", "V.low", "@shop/glob{k}: V#low"),
])
def program_variables(p):
    return analysis.visible_entities(p).where("kind = 'local'")


@program_query("global", "class_sig kind name entity", [
    *[("@shop/glob{k}: V.H", "variable", n, "@shop/glob{k}: " + e) for n, e in (("top", "#top"), ("low", "V#low"), ("inner", "V#inner"), ("V.inner", "V#inner"), ("V.low", "V#low"))],
    ("@shop/glob{k}: V.H", "field", "H.z", "@shop/glob{k}: V.H.z"), ("@shop/glob{k}: V.H", "field", "V.H.z", "@shop/glob{k}: V.H.z"),
])
def program_class_scope(p):
    return analysis.visible_from_class(p)


DOT = r"""digraph {
  subgraph "cluster_{a}" {
    label="{a}";
    n{x}_0 [label="this = this: @shop/loop{k}: _DEFAULT_CLASS\nreturn"];
  }
  subgraph "cluster_{b}" {
    label="{b}";
    n{y}_0 [label="n = parameter0: unknown\nthis = this: @shop/loop{k}: _DEFAULT_CLASS\ns = 0\ni = 0"];
    n{y}_1 [label="if i >= n"];
    n{y}_2 [label="if i != 3"];
    n{y}_3 [label="return s"];
    n{y}_4 [label="i = i + 1"];
    n{y}_5 [label="goto"];
    n{y}_6 [label="s = s + i"];
    n{y}_0 -> n{y}_1;
    n{y}_1 -> n{y}_2;
    n{y}_1 -> n{y}_3;
    n{y}_2 -> n{y}_5;
    n{y}_2 -> n{y}_6;
    n{y}_4 -> n{y}_1;
    n{y}_5 -> n{y}_4;
    n{y}_6 -> n{y}_4;
  }
}
"""


@program_query("loop", "path dot", [("loop{k}.ts", DOT)])
def program_dot(p):
    return analysis.dot(p)


# the nodes of a method are named after a digest of its signature
_HASHED = "substring(sha256(replace('{}', '{{k}}', CAST(s_suppkey AS VARCHAR))), 1, 24)"
_SIGS = [DEFAULT % "loop" + "._DEFAULT_METHOD()", DEFAULT % "loop" + ".f{k}(unknown)"]
ORACLES["program_dot"] = ORACLES["program_dot"].replace("replace(g.dot, '{k}', CAST(s_suppkey AS VARCHAR)) AS dot", "replace(replace(replace(replace(replace(g.dot, '{a}', '%s'), '{b}', '%s'), '{x}', %s), '{y}', %s), '{k}', CAST(s_suppkey AS VARCHAR)) AS dot" % (*_SIGS, *(_HASHED.format(x) for x in _SIGS)))


@program_query("pointer", "source target", [
    ("main.$temp0", "main.c"), ("main.$temp1", "main.x"), ("main.x", "put.v"), ("put.v", "#0.held"), ("#0.held", "get.$temp0"), ("get.$temp0", "main.g"), ("go.$temp0", "main.r"), ("main.$temp2", "main.y"), ("main.y", "same.v"), ("same.v", "main.s"), ("go.$temp0", "go.y"), ("go.y", "main.t"),
])
def program_pointer_flow(p):
    flow = pointers.pointer_analysis(p, _entries(p))["flow"]
    # the object whose field is meant is told by its class alone, there is one of each in main
    show = lambda c: F.when(F.startswith(c, F.lit("\n#")), F.concat(F.lit("#0."), F.regexp_extract(c, r"([^.]+)$", 1))).otherwise(F.concat_ws(".", F.regexp_extract(c, r"\.([A-Za-z_$0-9]+)\([^()]*\)\n", 1), F.split(c, "\n")[1]))
    return flow.select(F.regexp_extract("src", r"pointer(\d+)", 1).alias("k"), show(F.col("src")).alias("source"), show(F.col("dst")).alias("target")).distinct()


def sdk_fallback(s: SparkSession, d: str) -> DataFrame:
    """Names looked up in the project, then in an SDK: brands that a part of size 1 has, else one of any size."""
    p = s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("brand"), "p_partkey", "p_size")
    own, sdk = (t.groupBy("brand").agg(F.min("p_partkey").alias("found")) for t in (p.where("p_size = 1"), p.where("p_size > 5")))
    return resolve.fallback_lookup(p.select("brand").distinct(), own, sdk, "brand", "found")


QUERIES["sdk_fallback"] = sdk_fallback
ORACLES["sdk_fallback"] = "SELECT p_brand AS brand, coalesce(min(p_partkey) FILTER (p_size = 1), min(p_partkey) FILTER (p_size > 5)) AS found FROM part GROUP BY 1"


def program_own_methods(s: SparkSession, d: str) -> DataFrame:
    """Methods of the project's own files: libraries are taken for an SDK."""
    files = source_files(s, d, "calls")
    p = Program(parse_files(files, PROJECT), files.where("path like 'lib%'").select("path"))
    return p.own("method").where("name not like '%DEFAULT%'").select("path", "name")


QUERIES["program_own_methods"] = program_own_methods
ORACLES["program_own_methods"] = golden(["path", "name"], [("app{k}.ts", "main"), ("app{k}.ts", "side")])
