"""Queries over the smallest tables against their SQL."""

import duckdb
import pytest

from factloom.plans import queries as q
from factloom.plans.encoders import TABLES

SF = "/root/testdata/sf0.001"
QUICK = ["class_closure", "cha_edges", "stmt_next", "block_runs", "dominators", "idom", "dominance_frontier", "loop_members", "block_kinds", "def_use_local", "view_tree", "import_resolution", "ranked_lookup", "type_of_literals", "binop_types", "signature_render", "dot_lines", "member_overwrite", "source_order", "asof_sourcemap", "content_hash_changes", "conversation_def_use", "transpile_statistics"]
QUICK += ["def_use_global", "phi_sites", "cfg_reachable", "string_rules", "type_rules", "import_files", "governing_packages", "original_paths", "changed_files", "source_positions", "json5_values", "sdk_fallback"]
PROGRAMS = [n for n in q.queries() if n.startswith("program_")]
#: Whole-program analyses take tens of seconds each; one of a kind runs here, all of them in the driver's comparison.
SLOW = ["program_accuracy", "program_zero_divisions", "program_callees", "program_rta", "program_points_to", "program_pointer_reached", "program_pointer_flow", "program_undefined", "program_names"]
QUICK += [n for n in PROGRAMS if n not in SLOW]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(q.queries()) == set(q.oracle_sql())


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, db, name):
    df = q.queries()[name](spark, SF)
    got = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)
    rel = db.sql(q.oracle_sql()[name])
    at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
