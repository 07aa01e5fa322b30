"""Hand-written programs with known facts."""

from pyspark.sql import functions as F

from factloom.operators import callgraph as cg
from factloom.operators import cfg, ifds, pointsto, resolve, viewtree
from factloom.operators.cfg import Flow
from factloom.operators.fixpoint import Known, closure


def test_closure_on_a_cycle_terminates(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)], "src long, dst long")
    assert closure(edges).count() == 36


def test_known_rows_are_not_sent_to_the_driver(spark, rows):
    known = Known(spark.range(50).toDF("x"))
    known.add(spark.range(50).toDF("x"))
    left = known.unknown(spark.range(40, 60).toDF("x"))
    assert rows(left.select("x")) == [(i,) for i in range(50, 60)]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    known.close()


def test_dispatch(spark, rows):
    classes = spark.createDataFrame([("A", True), ("B", False), ("C", False), ("D", False)], "class_id string, is_abstract boolean")
    extends = spark.createDataFrame([("B", "A"), ("C", "A"), ("D", "A")], "sub string, sup string")
    methods = spark.createDataFrame([(c, "f") for c in "ABCD"], "class_id string, name string")
    sites = spark.createDataFrame([("main", "A", "f")], "caller string, recv string, callee string")
    entries = spark.createDataFrame([("main",)], "method string")
    edges = cg.cha_edges(classes, extends, methods, sites)
    assert rows(edges.select("target")) == [("B.f",), ("C.f",), ("D.f",)]
    allocs = spark.createDataFrame([("main", "B"), ("main", "C"), ("D.f", "D")], "caller string, class_id string")
    assert rows(cg.rta_edges(entries, edges, allocs)) == [("main", "B.f"), ("main", "C.f")]


def _diamond(spark):
    """40 callers of f on A and B, above 30 classes of which C0 to C9 stand below both."""
    classes = spark.createDataFrame([("A", True), ("B", True), *[(f"C{i}", False) for i in range(30)]], "class_id string, is_abstract boolean")
    extends = spark.createDataFrame([(f"C{i}", "A") for i in range(20)] + [(f"C{i}", "B") for i in range(30) if i < 10 or i >= 20], "sub string, sup string")
    methods = spark.createDataFrame([(f"C{i}", "f") for i in range(30)], "class_id string, name string")
    sites = spark.createDataFrame([(f"m{i}", r, "f") for i in range(40) for r in "AB" if i % 2 == 0 or r == "A"], "caller string, recv string, callee string")
    return cg.Dispatch.of(classes, extends, methods, sites)


def test_out_degree_by_groups_of_targets(spark, rows):
    d = _diamond(spark)
    assert rows(d.out_degree()) == sorted((f"m{i}", 30 if i % 2 == 0 else 20) for i in range(40))
    calls, members = d.groups("target")
    # 1,000 edges: three groups stand for them
    assert members.count() == 30 and calls.count() == 20 * 3 + 20 * 2 and members.select("g1", "g2").distinct().count() == 3


def test_edges_are_made_once_from_groups(spark, rows):
    d = _diamond(spark)
    assert rows(d.edges("target")) == sorted((f"m{i}", f"C{j}.f") for i in range(40) for j in range(30) if i % 2 == 0 or j < 20)
    # nothing is shuffled after the join that makes them
    plan = d.edges("target")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[: plan.index("Join")] and "Exchange" not in plan[: plan.index("Join")]


def test_reachability_by_groups_is_that_over_edges(spark, rows):
    classes = spark.createDataFrame([("A", True), *[(f"C{i}", False) for i in range(6)]], "class_id string, is_abstract boolean")
    extends = spark.createDataFrame([(f"C{i}", "A") for i in range(6)], "sub string, sup string")
    methods = spark.createDataFrame([(f"C{i}", n) for i in range(6) for n in "fg"], "class_id string, name string")
    sites = spark.createDataFrame([("main", "A", "f"), ("C1.f", "A", "g"), ("C2.f", "C3", "g"), ("C3.g", "C0", "f"), ("far", "C5", "g")], "caller string, recv string, callee string")
    entries = spark.createDataFrame([("main",)], "method string")
    # C3 is made by a method that is reached later than the call of it
    allocs = spark.createDataFrame([("main", "C1"), ("main", "C2"), ("C1.g", "C3"), ("far", "C5")], "caller string, class_id string")
    d, edges = cg.Dispatch.of(classes, extends, methods, sites), cg.cha_edges(classes, extends, methods, sites)
    assert rows(d.reachable(entries)) == rows(cg.cha_reachable(entries, edges))
    assert [rows(x) for x in d.rta(entries, allocs)] == [rows(x) for x in cg.rta(entries, edges, allocs)]
    assert rows(d.rta_edges(entries, allocs)) == rows(cg.rta_edges(entries, edges, allocs))
    assert ("C2.f", "C3.g") in rows(d.rta_edges(entries, allocs)) and ("main", "C0.f") not in rows(d.rta_edges(entries, allocs))


def test_diamond_dominators_and_loops():
    f = Flow([1, 2, 3, 4, 5], [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 4)])
    assert f.idom(3) == 0 and f.idom(4) == 3 and f.idom(0) is None
    assert {(f.nodes[x], f.nodes[y]) for x, y in f.frontier()} == {(2, 4), (3, 4), (4, 4), (5, 4)}
    assert {f.nodes[h]: {f.nodes[x] for x in b} for h, b in f.loops().items()} == {4: {4, 5}}


def test_phi_at_the_join(spark, rows):
    edges = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 3, 4)], "method long, src long, dst long")
    blocks = spark.createDataFrame([(1, b) for b in (1, 2, 3, 4)], "method long, block long")
    defs = spark.createDataFrame([(1, "i", 2), (1, "i", 3)], "method long, name string, block long")
    assert rows(cfg.phi_sites(defs, cfg.dominance_frontier(edges, blocks))) == [(1, "i", 4)]


def test_two_allocations_and_a_cycle_of_copies(spark, rows):
    allocs = spark.createDataFrame([("a", 1), ("a", 2)], "var string, obj long")
    copies = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    stores = spark.createDataFrame([("a", "f", "b")], "base string, field string, src string")
    loads = spark.createDataFrame([("b", "f", "c")], "base string, field string, dst string")
    got = rows(pointsto.points_to(allocs, copies, stores, loads).where("ptr in ('a', 'b', 'c')"))
    assert got == [(p, o) for p in "abc" for o in (1, 2)]


def test_facts_return_to_every_call_site(spark, rows):
    # 1 -> 2 (call 10) -> 3 (call 10) -> 4; 10 -> 11 generates fact 1
    normal = spark.createDataFrame([(1, 0, 2, 0), (10, 0, 11, 0), (10, 0, 11, 1)], "n long, d long, n2 long, d2 long")
    call = spark.createDataFrame([(2, 0, 10, 0), (3, 0, 10, 0)], "n long, d long, start long, d2 long")
    exits = spark.createDataFrame([(11, 10)], "exit long, start long")
    ret = spark.createDataFrame([(2, 11, 1, 3, 1), (3, 11, 1, 4, 1)], "n long, exit long, d long, n2 long, d2 long")
    through = spark.createDataFrame([(2, 0, 3, 0), (3, 0, 4, 0)], "n long, d long, n2 long, d2 long")
    seeds = spark.createDataFrame([(1, 0, 1, 0)], "s long, d0 long, n long, d long")
    for owner in (None, F.floor(F.col("n") / 10)):
        assert rows(ifds.facts_at(ifds.path_edges(seeds, normal, call, exits, ret, through, owner))) == [(11, 1), (3, 1), (4, 1)]


def test_flow_inside_methods_is_followed_once_and_not_in_every_round(spark, rows, monkeypatch):
    # a chain of calls 10 -> 20 -> 30 -> 40, the last of which makes fact 1 that returns through all
    normal = spark.createDataFrame([(40, 0, 41, 0), (40, 0, 41, 1)] + [(m + 1, d, m + 2, d) for m in (10, 20, 30) for d in (0, 1)], "n long, d long, n2 long, d2 long")
    call = spark.createDataFrame([(m, 0, m + 10, 0) for m in (10, 20, 30)], "n long, d long, start long, d2 long")
    exits = spark.createDataFrame([(12, 10), (22, 20), (32, 30), (41, 40)], "exit long, start long")
    ret = spark.createDataFrame([(10, 22, 1, 11, 1), (20, 32, 1, 21, 1), (30, 41, 1, 31, 1)], "n long, exit long, d long, n2 long, d2 long")
    through = spark.createDataFrame([(m, 0, m + 1, 0) for m in (10, 20, 30)], "n long, d long, n2 long, d2 long")
    seeds = spark.createDataFrame([(10, 0, 10, 0)], "s long, d0 long, n long, d long")
    calls, spread = [], ifds._spread
    monkeypatch.setattr(ifds, "_spread", lambda *a: calls.append(1) or spread(*a))
    got = rows(ifds.path_edges(seeds, normal, call, exits, ret, through, F.floor(F.col("n") / 10)))
    assert len(calls) == 1 and (10, 0, 12, 1) in got
    assert got == rows(ifds.path_edges(seeds, normal, call, exits, ret, through))


def test_names_in_sight_are_made_once_from_groups(spark, rows):
    # a root with two children, of which each has two; x2 stands below both children, and one entity climbs to the root
    scopes = spark.createDataFrame([("r", None, True), ("a", "r", True), ("b", "r", False), ("x1", "a", True), ("x2", "a", False), ("x2", "b", False), ("x3", "b", True)], "scope string, parent string, is_exported boolean")
    own = spark.createDataFrame([("x1", "n", "e1", True), ("x3", "n", "e3", True), ("x2", "n", "e2", True), ("a", "m", "e4", False)], "scope string, name string, entity string, is_exported boolean")
    df = resolve.visible_names(scopes, own)
    e1 = [(s, "n", "e1") for s in ("a", "b", "r", "x1", "x2", "x3")]
    assert rows(df) == sorted([*e1, *[(s, "n", "e3") for s in ("b", "x2", "x3")], ("x2", "n", "e2"), *[(s, "m", "e4") for s in ("a", "x1", "x2")]])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")]


def test_reexports_follow_aliases_and_end_on_cycles(spark, rows):
    imports = spark.createDataFrame([("a", "x"), ("c", "y")], "file string, name string")
    exports = spark.createDataFrame([("a", "x", None, "b", "z"), ("b", "z", "B.z", None, None), ("c", "y", None, "d", "y"), ("d", "y", None, "c", "y")], "file string, name string, entity string, from_file string, from_name string")
    assert rows(resolve.reexport_chase(imports, exports)) == [("a", "x", "B.z")]


def test_next_position(spark, rows):
    q = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "k long, at long")
    m = spark.createDataFrame([(1, 5, "a"), (1, 7, "b")], "k long, at long, v string")
    assert rows(resolve.next_position(q, m, "k", "at", "v")) == [(1, 5, "a"), (1, 9, None), (2, 1, None)]


def test_view_tree(spark, rows):
    tags = [("col", False), ("row", False), ("img", False), ("row", True), ("text", False), ("text", True), ("col", True)]
    df = spark.createDataFrame([(1, i, t, c) for i, (t, c) in enumerate(tags)], "tree long, pos int, tag string, is_close boolean")
    assert rows(viewtree.view_tree(df, ["img"]).select("pos", "depth", "parent_pos")) == [(0, 0, None), (1, 1, 0), (2, 2, 1), (4, 1, 0)]
