"""The driver's tables as program facts: SQL that Spark and DuckDB both run.

Each fact table is a query over driver tables and other facts; :func:`with_facts` puts those a query needs before it, and
:func:`fact` gives one as a DataFrame.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

FACTS = {
    "f_class": """
        SELECT concat('R', CAST(r_regionkey AS STRING)) AS class_id, r_name AS name, true AS is_abstract FROM region
        UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), n_name, false FROM nation
        UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), s_name, false FROM supplier
        UNION ALL SELECT concat('C', CAST(c_custkey AS STRING)), c_name, false FROM customer""",
    "f_extends": """
        SELECT concat('N', CAST(n_nationkey AS STRING)) AS sub, concat('R', CAST(n_regionkey AS STRING)) AS sup FROM nation
        UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), concat('N', CAST(s_nationkey AS STRING)) FROM supplier
        UNION ALL SELECT concat('C', CAST(c_custkey AS STRING)), concat('N', CAST(c_nationkey AS STRING)) FROM customer""",
    "f_method": "SELECT DISTINCT concat('S', CAST(l_suppkey AS STRING)) AS class_id, p_brand AS name FROM lineitem JOIN part ON l_partkey = p_partkey",
    "f_line": """
        SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, p_brand, o_custkey, c_nationkey
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    # a customer's method calls the brands of its order lines; a supplier's method for a brand calls that of the line after
    "f_site": """
        SELECT DISTINCT concat('C', CAST(o_custkey AS STRING), '.main') AS caller, concat('N', CAST(c_nationkey AS STRING)) AS recv, p_brand AS callee FROM f_line
        UNION SELECT DISTINCT concat('S', CAST(a.l_suppkey AS STRING), '.', a.p_brand), concat('N', CAST(b.c_nationkey AS STRING)), b.p_brand
        FROM f_line a JOIN f_line b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
    "f_alloc": """
        SELECT DISTINCT concat('C', CAST(o_custkey AS STRING), '.main') AS caller, concat('S', CAST(l_suppkey AS STRING)) AS class_id FROM f_line WHERE l_returnflag = 'R'
        UNION SELECT DISTINCT concat('S', CAST(a.l_suppkey AS STRING), '.', a.p_brand), concat('S', CAST(b.l_suppkey AS STRING))
        FROM f_line a JOIN f_line b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE b.l_returnflag = 'R'""",
    "f_entry": "SELECT concat('C', CAST(c_custkey AS STRING), '.main') AS method FROM customer WHERE c_mktsegment = 'BUILDING'",
    "f_block": """
        SELECT o_custkey AS method, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS block, o_orderkey, o_orderpriority FROM orders""",
    "f_flow": """
        SELECT a.method, a.block AS src, b.block AS dst FROM f_block a JOIN f_block b ON a.method = b.method AND (
          b.block = a.block + 1 OR (a.o_orderpriority = '1-URGENT' AND b.block = a.block + 2) OR (a.o_orderpriority = '2-HIGH' AND b.block = a.block - 2))""",
    "f_stmt": """
        SELECT b.method, b.block, l.l_orderkey * 10 + l.l_linenumber AS stmt, CAST(l.l_linenumber AS BIGINT) AS idx, l.l_partkey % 8 AS name, l.l_linenumber % 2 = 1 AS is_def
        FROM f_block b JOIN lineitem l ON l.l_orderkey = b.o_orderkey""",
    "f_scope": """
        SELECT concat('R', CAST(r_regionkey AS STRING)) AS scope, CAST(NULL AS STRING) AS parent, true AS is_exported FROM region
        UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), concat('R', CAST(n_regionkey AS STRING)), n_nationkey % 2 = 0 FROM nation
        UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), concat('N', CAST(s_nationkey AS STRING)), s_acctbal > 0 FROM supplier""",
    "f_declared": """
        SELECT concat('S', CAST(s_suppkey AS STRING)) AS scope, concat('class', CAST(s_nationkey AS STRING)) AS name, concat('e', CAST(s_suppkey AS STRING)) AS entity, s_acctbal > 2000 AS is_exported FROM supplier
        UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), concat('class', CAST(n_nationkey AS STRING)), concat('n', CAST(n_nationkey AS STRING)), true FROM nation
        UNION ALL SELECT concat('R', CAST(r_regionkey AS STRING)), r_name, concat('r', CAST(r_regionkey AS STRING)), true FROM region""",
    "f_page": """
        SELECT page_id, url, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM pages""",
    "f_var": """
        SELECT l_orderkey, l_linenumber, l_returnflag, p_brand, concat(CAST(o_custkey AS STRING), '_', CAST(l_partkey % 8 AS STRING)) AS var, l_orderkey * 10 + l_linenumber AS obj FROM f_line""",
    "f_newobj": "SELECT var, obj FROM f_var WHERE l_returnflag = 'R'",
    "f_copy": "SELECT DISTINCT a.var AS src, b.var AS dst FROM f_var a JOIN f_var b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_linenumber > 2 AND a.var <> b.var",
    "f_store": "SELECT DISTINCT a.var AS base, a.p_brand AS field, b.var AS src FROM f_var a JOIN f_var b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2",
    "f_load": "SELECT DISTINCT a.var AS base, a.p_brand AS field, b.var AS dst FROM f_var a JOIN f_var b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 2 AND b.l_linenumber = 3",
    # inter-procedural dataflow: a method is a customer, its statements are its blocks, numbered custkey * 1000 + block
    "f_xstmt": """
        SELECT method, block, method * 1000 + block AS n, o_orderkey, o_orderpriority, c_nationkey, max(block) OVER (PARTITION BY method) AS last_block
        FROM f_block JOIN customer ON c_custkey = method""",
    # a call at a block goes down a binary tree of the nation's customers by rank, and from its leaves back to the first
    "f_rank": """
        SELECT method, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY method) AS rank, count(*) OVER (PARTITION BY c_nationkey) AS size
        FROM (SELECT DISTINCT method, c_nationkey FROM f_xstmt)""",
    "f_callee": """
        SELECT x.n, x.method, t.method * 1000 + 1 AS start FROM f_xstmt x JOIN f_rank r ON r.method = x.method
        JOIN f_rank t ON t.c_nationkey = r.c_nationkey AND t.rank = CASE WHEN 2 * r.rank + x.block % 2 <= r.size THEN 2 * r.rank + x.block % 2 ELSE 1 END
        WHERE x.o_orderpriority = '3-MEDIUM' AND x.block < x.last_block""",
    "f_name": "SELECT DISTINCT x.n, CAST(l_partkey % 8 + 1 AS BIGINT) AS d, l_linenumber % 2 = 1 AS is_gen FROM f_xstmt x JOIN lineitem ON l_orderkey = o_orderkey",
    "f_fact": "SELECT CAST(0 AS BIGINT) AS d UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8",
    "f_xedge": """
        SELECT a.n, b.n AS n2 FROM f_xstmt a JOIN f_xstmt b ON a.method = b.method AND (
          b.block = a.block + 1 OR (a.o_orderpriority = '1-URGENT' AND b.block = a.block + 2) OR (a.o_orderpriority = '2-HIGH' AND b.block = a.block - 2))""",
    "f_normal": """
        SELECT e.n, f.d, e.n2, f.d AS d2 FROM f_xedge e CROSS JOIN f_fact f LEFT JOIN (SELECT n, d FROM f_name WHERE NOT is_gen) k ON k.n = e.n AND k.d = f.d
          LEFT JOIN f_callee c ON c.n = e.n WHERE k.n IS NULL AND c.n IS NULL
        UNION SELECT e.n, CAST(0 AS BIGINT), e.n2, g.d FROM f_xedge e JOIN f_name g ON g.n = e.n AND g.is_gen LEFT JOIN f_callee c ON c.n = e.n WHERE c.n IS NULL""",
    "f_enter": "SELECT n, d, start, d AS d2 FROM f_callee CROSS JOIN f_fact WHERE d <= 4",
    "f_exit": "SELECT n AS exit, method * 1000 + 1 AS start FROM f_xstmt WHERE block = last_block",
    "f_ret": "SELECT c.n, x.exit, f.d, e.n2, f.d AS d2 FROM f_callee c JOIN f_exit x ON x.start = c.start JOIN f_xedge e ON e.n = c.n CROSS JOIN f_fact f WHERE f.d <= 4",
    "f_past": "SELECT c.n, f.d, e.n2, f.d AS d2 FROM f_callee c JOIN f_xedge e ON e.n = c.n CROSS JOIN f_fact f WHERE f.d = 0 OR f.d >= 5",
    "f_seed": "SELECT min(method) * 1000 + 1 AS s, CAST(0 AS BIGINT) AS d0, min(method) * 1000 + 1 AS n, CAST(0 AS BIGINT) AS d FROM f_xstmt GROUP BY c_nationkey",
}


def _needs(sql: str) -> list[str]:
    return [f for f in FACTS if re.search(rf"\b{f}\b", sql)]


def with_facts(sql: str, recursive: bool = False) -> str:
    """``sql`` behind the common table expressions of the facts it names, directly or through others."""
    need, todo = set(), _needs(sql)
    while todo:
        f = todo.pop()
        if f not in need:
            need.add(f)
            todo += _needs(FACTS[f])
    ctes = [f"{f} AS ({FACTS[f]})" for f in FACTS if f in need]
    body = sql.strip()
    if m := re.match(r"(?i)WITH\s+(RECURSIVE\s+)?", body):
        recursive = recursive or bool(m[1])
        ctes.append("\n" + body[m.end() :])
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """``query`` over the driver's tables in ``sf_dir`` and the facts."""
    whole = with_facts(query)
    # views are named after their folder too, so that two scale factors in one session do not meet
    mark = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
    for t in TABLES:
        if re.search(rf"\b{t}\b", whole):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"{t}_{mark}")
            whole = re.sub(rf"(\b(?:FROM|JOIN)\s+){t}\b", rf"\g<1>{t}_{mark}", whole)
    return spark.sql(whole)


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, f"SELECT * FROM {name}")
