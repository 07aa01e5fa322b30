"""Single assignment form of small methods."""

from factloom.operators.ssa import rename, to_ssa


def test_one_phi_at_the_join():
    stmts = [(0, 0, "c", []), (1, 0, "i", ["c"]), (2, 0, "i", ["c"]), (3, 0, "j", ["i"])]
    out, phis = rename([0, 1, 2, 3], [(0, 1), (0, 2), (1, 3), (2, 3)], stmts)
    assert phis == [(3, "i#2", [(1, "i#0"), (2, "i#1")])] or phis == [(3, "i#2", [(1, "i#1"), (2, "i#0")])]
    assert out[-1] == (3, 0, "j#0", ["i#2"])


def test_a_loop_and_globals():
    stmts = [(0, 0, "i", []), (1, 0, None, ["i", "console"]), (2, 0, "i", ["i"]), (3, 0, None, ["i"])]
    out, phis = rename([0, 1, 2, 3], [(0, 1), (1, 2), (2, 1), (1, 3)], stmts)
    assert phis == [(1, "i#1", [(0, "i#0"), (2, "i#2")])]
    assert out == [(0, 0, "i#0", []), (1, 0, None, ["i#1", "console"]), (2, 0, "i#2", ["i#1"]), (3, 0, None, ["i#1"])]


def test_dead_names_get_no_phi():
    out, phis = rename([0, 1, 2, 3], [(0, 1), (0, 2), (1, 3), (2, 3)], [(1, 0, "x", []), (2, 0, "x", [])])
    assert phis == []


def test_every_definition_is_unique(spark):
    edges = spark.createDataFrame([(7, 0, 1), (7, 0, 2), (7, 1, 3), (7, 2, 3)], "method long, src long, dst long")
    blocks = spark.createDataFrame([(7, b) for b in range(4)], "method long, block long")
    stmts = spark.createDataFrame([(7, 1, 0, "i", []), (7, 2, 0, "i", []), (7, 3, 0, "j", ["i"])], "method long, block long, idx int, def string, uses array<string>")
    got = to_ssa(edges, blocks, stmts).collect()
    defs = [r["def"] for r in got if r["def"]]
    assert len(defs) == len(set(defs)) == 4 and [r.args for r in got if r.idx == -1][0].keys() == {1, 2}
