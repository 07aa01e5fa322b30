"""Parsing and lowering of what programs are made of, beyond the registered queries: labels, patterns, component bodies, statements."""

import pytest

from factloom.operators import statements
from factloom.plans import views
from factloom.sources.lowering import facts_of
from factloom.sources.project import Program, config_of, list_files, parse_files, read_config, sdk_files


def lowered(code, table="stmt"):
    rows = list(facts_of("p", "a.ts", code))
    assert not [r for t, r in rows if t == "error"], rows
    return [r for t, r in rows if t == table]


def texts(code):
    return [r["text"] for r in lowered(code)]


def test_labels_name_their_statement():
    code = "function f(a) { out: { if (a) { break out; } a = 1; } a = 2; x: for (;;) { y: for (;;) { continue x; } } }"
    edges = {(r["src"], r["dst"]) for r in lowered(code, "edge")}
    block = {r["text"]: r["block"] for r in lowered(code)}
    jump = next(r["block"] for r in lowered(code) if r["text"] == "goto")
    assert (jump, block["a = 2"]) in edges and (block["a = 1"], block["a = 2"]) in edges


@pytest.mark.parametrize(("code", "want"), [
    ("let [a, , b] = c;", ["a = c[0]", "b = c[2]"]),
    ("let {x: {y}, ...z} = c;", ["$temp0 = c.x", "y = $temp0.y", "z = c"]),
    ("[p.q, r] = s;", ["p.q = $temp0", "$temp0 = s[0]", "r = s[1]"]),
    ("const [h, ...t] = c;", ["h = c[0]", "t = instanceinvoke c.<slice>(1)"]),
])
def test_patterns(code, want):
    got = texts(code)
    assert all(w in got for w in want), got


def test_constants_are_no_names():
    uses = {u for r in lowered("function f() { let a = true; if (a == null) { a = undefined; } return false; }") for u in r["uses"]}
    assert uses == {"a"}


def test_logic_runs_its_right_side_only_when_asked():
    rows = lowered("function f(a, b) { let x = a && b; let y = a || g(); let z = a ?? g(); }")
    assert "x = a && b" in [r["text"] for r in rows]
    calls = [r["block"] for r in rows if "staticinvoke" in r["text"]]
    assert len(set(calls)) == 2 and 0 not in calls


def test_fields_get_values_in_every_class():
    got = texts("class A { static s = 1; t; } class B extends A { u = 2; constructor() { super(); } } interface I { v: number } enum E { W = 1 }")
    assert [t for t in got if ".s =" in t or ".t =" in t or ".u =" in t] == ["A.s = 1", "this.t = undefined", "this.u = 2"]


def test_compiled_and_written_components_give_one_tree():
    written = """struct M { @State n: number = 1; build() { Column() { Text('a' + this.n); if (this.n) { Row() { } } ForEach(this.xs, x => { Button() }) }.width(1) } }"""
    compiled = """class M extends ViewPU { initialRender() {
      this.observeComponentCreation((id, isInitialRender) => { Column.create(); Column.width(1); if (!isInitialRender) { Column.pop(); } });
      this.observeComponentCreation((id, isInitialRender) => { Text.create('a' + this.n); });
      Text.pop();
      this.observeComponentCreation((id, isInitialRender) => { If.create(); if (this.n) { this.ifElseBranchUpdateFunction(0, () => { this.observeComponentCreation(() => { Row.create(); }); Row.pop(); }); } });
      If.pop();
      this.observeComponentCreation((id, isInitialRender) => { ForEach.create(); const gen = _item => { const x = _item; this.observeComponentCreation(() => { Button.create(); }); Button.pop(); }; this.forEachUpdateFunction(id, this.xs, gen); });
      ForEach.pop();
      Column.pop(); } }"""
    shape = lambda code: [(r["parent"], r["name"], r["fields"]) for r in lowered(code, "view")]
    assert shape(written) == shape(compiled) == [(None, "Column", []), (0, "Text", ["n"]), (0, "If", ["n"]), (2, "IfBranch", []), (3, "Row", []), (0, "ForEach", ["xs"]), (5, "Button", [])]


def test_config_and_sdks(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"targetProjectName": "n", "etsSdkPath": "%s/sdk", "unread": 1, "otherSdks": [{"name": "o", "path": "%s/other"}]}' % (tmp_path, tmp_path))
    for d, f in (("sdk", "a.d.ts"), ("other", "b.d.ts"), ("other", "c.ts")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / f).write_text("declare class A { }")
    config = read_config(spark, f"file://{tmp_path}/c.json")
    assert config["targetProjectName"] == "n" and config["logPath"] == "" and "unread" not in config
    assert sorted((r.sdk, r.path) for r in sdk_files(spark, config).collect()) == [("ets", "a.d.ts"), ("o", "b.d.ts")]
    assert config_of("/x/shop/")["targetProjectName"] == "shop"
    assert list_files(spark, f"file://{tmp_path}/none", [".ts"]).collect() == []


def test_successors_can_be_set(spark):
    edges = spark.createDataFrame([("m", 0, 1, 0), ("m", 0, 2, 1)], "method string, src int, dst int, ord int")
    done = statements.set_successor(edges, spark.createDataFrame([("m", 0, 3, 1), ("m", 1, 2, 0)], edges.schema))
    assert sorted(map(tuple, done.collect())) == [("m", 0, 1, 0), ("m", 0, 3, 1), ("m", 1, 2, 0)]


def test_a_cycle_of_copies_has_no_initial_value(spark):
    rows = [("m", 0, 0, "a", "name", ["b"]), ("m", 0, 1, "b", "name", ["a"]), ("m", 0, 2, "c", "name", ["a"]), ("m", 0, 3, "d", "const", ["1"]), ("m", 0, 4, "e", "name", ["d"])]
    s = spark.createDataFrame(rows, "method string, block int, idx int, def string, op string, args array<string>")
    assert {r.name: r.args for r in statements.initial_values(s).collect()} == {"d": ["1"], "e": ["1"]}


def test_a_component_that_holds_itself_ends(spark):
    code = "struct A { build() { Column() { B() } } } struct B { build() { A() } }"
    files = spark.createDataFrame([("a.ets", code)], "path string, code string")
    got = {(r.root[-9:], r.method_sig[-9:], r.depth) for r in views.whole_trees(Program(parse_files(files, "p"))).collect()}
    assert got == {("A.build()", "A.build()", 0), ("A.build()", "B.build()", 1), ("B.build()", "B.build()", 0), ("B.build()", "A.build()", 1)}


def test_parsing_tasks_are_bounded(spark, monkeypatch):
    from factloom.plans import programs

    monkeypatch.setattr(programs, "MOST_FILES", 3)
    files = programs.source_files(spark, "/root/testdata/sf0.001", "calls")
    assert files.rdd.getNumPartitions() == -(-files.count() // 3) > 1
