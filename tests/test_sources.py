"""Parsing, lowering and what follows from parsed projects."""

import pytest

from factloom.plans import analysis
from factloom.sources.lowering import facts_of
from factloom.sources.project import Program, decode_mappings, governing_packages, list_files, original_positions, parse_files, read_json5
from factloom.streaming import incremental

LIB = """
export abstract class Shape { abstract area(): number; name(): string { return "shape"; } }
export class Square extends Shape { side: number = 1; area(): number { return this.side * this.side; } }
export class Disc extends Shape { area(): number { return 3; } }
class Hidden {}
export { Hidden as Shown };
"""
MAIN = """
import { Shape, Square as Sq, Shown } from './lib';
function total(s: Shape): number {
  let i = 0;
  while (i < 3) { if (i == 1) { i += 2; } else { i++; } }
  return s.area() + i;
}
let q = new Sq();
total(q);
q.name();
let h = new Shown();
"""


def rows_of(code, table):
    return [r for t, r in facts_of("p", "m.ts", code) if t == table]


@pytest.fixture(scope="module")
def program(spark):
    files = spark.createDataFrame([("src/lib.ts", LIB), ("src/main.ts", MAIN), ("src/bad.ts", "class {{{")], "path string, code string")
    return Program(parse_files(files, "p"))


def test_names_and_errors(program):
    names = {(r.path, r.name): r.class_sig for r in analysis.class_names(program).collect()}
    assert names["src/main.ts", "Sq"] == "@p/src/lib: Square" and names["src/main.ts", "Shown"] == "@p/src/lib: Hidden"
    assert [r.path for r in program["error"].collect()] == ["src/bad.ts"]


def test_call_graphs(spark, program):
    cha = {(r.caller.split(": ")[1], r.target.split(": ")[1]) for r in analysis.call_graph(program).collect()}
    main = "_DEFAULT_CLASS._DEFAULT_METHOD"
    assert {("_DEFAULT_CLASS.total", "Square.area"), ("_DEFAULT_CLASS.total", "Disc.area"), (main, "_DEFAULT_CLASS.total"), (main, "Shape.name")} <= cha
    entry = spark.createDataFrame([("@p/src/main: " + main,)], "method string")
    rta = {(r.caller.split(": ")[1], r.target.split(": ")[1]) for r in analysis.call_graph(program, "rta", entry).collect()}
    assert rta < cha and ("_DEFAULT_CLASS.total", "Square.area") in rta and ("_DEFAULT_CLASS.total", "Disc.area") not in rta


def test_loop_needs_phi(program):
    assert "i" in {r.name for r in analysis.phi_functions(program).collect()}


def test_dot_and_listing(program):
    dots = {r.path: r.dot for r in analysis.dot(program).collect()}
    assert dots["src/main.ts"].startswith("digraph {") and dots["src/main.ts"].count("subgraph") == 2
    text = [r.line_text for r in analysis.listing(program).where("path = 'src/lib.ts'").orderBy("ord").collect()]
    assert "export class Square extends Shape" in text and "  side: number = 1" in text


def test_statements():
    texts = [r["text"] for r in rows_of("function f(a: number) { if (a < 2 && a) { return `x${a}`; } try { g(); } catch (e) { throw e; } finally { h(); } for (const k in o) { a ||= k; } switch (a) { case 1: break; default: b = a ? 1 : 2; } }", "stmt")]
    assert "if a >= 2" in texts and "if a == 0" in texts and "staticinvoke <h>()" in texts and "switch(a) {1, default}" in texts


def test_branch_order():
    edges = [(r["src"], r["dst"]) for r in rows_of("while (x) { y(); }", "edge")]
    assert edges == [(0, 1), (1, 2), (1, 3), (2, 1)]


def test_json5():
    assert read_json5("// c\n{a: 'x', \"b\": [1, -2.5, {c: true}], /* */ d: null,}") == {"a": "x", "b": ["1", "-2.5", {"c": True}], "d": None}
    assert read_json5("[1, {a: 2}]") == {"a": "2"} and read_json5("oops(") is None


def test_source_maps(spark, rows):
    assert decode_mappings("AAAA,IACE;;AAEF") == [(1, 0, 1, 0), (1, 4, 2, 2), (3, 0, 4, 0)]
    maps = spark.createDataFrame([("f", "AAAA,IACE")], "path string, mappings string")
    at = spark.createDataFrame([("f", 1, 1), ("f", 1, 9), ("f", 2, 0)], "path string, line int, col int")
    assert rows(original_positions(at, maps)) == [("f", 1, 1, 2, 2), ("f", 1, 9, 0, 0), ("f", 2, 0, 0, 0)]


def test_listing_and_packages(spark, rows, tmp_path):
    for p in ("a/x.ts", "a/b/y.ts", "node_modules/z.ts", "a/w.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("let a = 1")
    assert rows(list_files(spark, str(tmp_path), [".ts"]).select("path")) == [("a/b/y.ts",), ("a/x.ts",)]
    files = spark.createDataFrame([("a/b/y.ts",), ("c.ts",)], "path string")
    packs = spark.createDataFrame([("oh-package.json5",), ("a/b/oh-package.json5",)], "path string")
    assert rows(governing_packages(files, packs)) == [("a/b/y.ts", ["oh-package.json5", "a/b/oh-package.json5"]), ("c.ts", ["oh-package.json5"])]


def test_stream_parses_only_new_contents(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    (src / "a.ts").write_text("class A {}")
    for name in ("b.ts", "c.ts"):
        incremental.analyse_changes(incremental.watch(spark, str(src)), "p", str(out), str(tmp_path / "cp")).awaitTermination()
        (src / name).write_text("class A {}" if name == "b.ts" else "class C {}")
    assert spark.read.parquet(f"{out}/seen").count() == 1
    incremental.analyse_changes(incremental.watch(spark, str(src)), "p", str(out), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{out}/seen").count() == 2


def test_stream_keeps_equal_files_apart_and_follows_paths(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    for name in ("a.ts", "b.ts"):
        (src / name).write_text("class A {}")
    incremental.analyse_changes(incremental.watch(spark, str(src)), "p", str(out), str(tmp_path / "cp")).awaitTermination()
    classes = [r.path.rsplit("/", 1)[1] for r in spark.read.parquet(f"{out}/facts").where("table = 'class' and row like '%\"A\"%'").collect()]
    assert sorted(classes) == ["a.ts", "b.ts"] and spark.read.parquet(f"{out}/seen").count() == 1

    versions, out = tmp_path / "versions", tmp_path / "out2"
    for k, code in enumerate(["class A {}", "class B {}", "class A {}", "class A {}"]):
        spark.createDataFrame([("x.ts", code, code)], "path string, code string, hash string").write.mode("append").parquet(str(versions))
        stream = spark.readStream.schema("path string, code string, hash string").parquet(str(versions))
        incremental.analyse_changes(stream, "p", str(out), str(tmp_path / "cp2")).awaitTermination()
    got = spark.read.parquet(f"{out}/files").orderBy("batch").collect()
    assert [(r.path, r.hash, r.batch) for r in got] == [("x.ts", "class A {}", 0), ("x.ts", "class B {}", 1), ("x.ts", "class A {}", 2)]
    assert sorted({r.batch for r in spark.read.parquet(f"{out}/facts").collect()}) == [0, 1, 2]
