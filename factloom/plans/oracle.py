"""DuckDB SQL for the engine's queries, over the same fact encoders."""

from __future__ import annotations

from .encoders import with_facts

DESC = "SELECT class_id AS anc, class_id AS des FROM f_class UNION SELECT r.anc, x.sub FROM r JOIN f_extends x ON x.sup = r.des"
CHA = """r AS (%s),
cha AS (SELECT DISTINCT s.caller, concat(m.class_id, '.', m.name) AS target, m.class_id FROM f_site s JOIN r ON r.anc = s.recv JOIN f_class c ON c.class_id = r.des AND NOT c.is_abstract
  JOIN f_method m ON m.class_id = r.des AND m.name = s.callee)""" % DESC
RTA = f"""WITH RECURSIVE {CHA},
st(kind, id) AS (SELECT 'm', method FROM f_entry),
f(kind, id) USING KEY (kind, id) AS (
  SELECT * FROM st UNION (
    SELECT 'c', a.class_id FROM recurring.f m JOIN f_alloc a ON m.kind = 'm' AND a.caller = m.id
    UNION SELECT 'm', e.target FROM recurring.f m JOIN cha e ON m.kind = 'm' AND e.caller = m.id JOIN recurring.f c ON c.kind = 'c' AND c.id = e.class_id))"""
REACH = "entry AS (SELECT DISTINCT method, CAST(1 AS BIGINT) AS block FROM f_block), rb AS (SELECT method, block FROM entry UNION SELECT e.method, e.dst FROM rb JOIN f_flow e ON e.method = rb.method AND e.src = rb.block)"
# what the entry still reaches when a block is taken out: a block dominates all else that is reached
DOM = f"""{REACH},
cut AS (SELECT x.method, x.block AS x, CAST(1 AS BIGINT) AS block FROM rb x WHERE x.block <> 1
  UNION SELECT c.method, c.x, e.dst FROM cut c JOIN f_flow e ON e.method = c.method AND e.src = c.block AND e.dst <> c.x),
dom AS (SELECT x.method, x.block AS dom, y.block AS node FROM rb x JOIN rb y ON x.method = y.method
  WHERE x.block = y.block OR x.block = 1 OR NOT EXISTS (SELECT 1 FROM cut c WHERE c.method = x.method AND c.x = x.block AND c.block = y.block))"""
DF = f"""{DOM},
pre AS (SELECT DISTINCT e.method, e.src, e.dst FROM f_flow e JOIN rb ON rb.method = e.method AND rb.block = e.src),
df AS (SELECT DISTINCT d.method, d.dom AS node, p.dst AS frontier FROM dom d JOIN pre p ON p.method = d.method AND p.src = d.node
  WHERE NOT EXISTS (SELECT 1 FROM dom q WHERE q.method = d.method AND q.dom = d.dom AND q.node = p.dst AND q.dom <> q.node))"""
LOOPS = f"""{DOM},
back AS (SELECT DISTINCT e.method, e.src AS t, e.dst AS h FROM f_flow e JOIN dom d ON d.method = e.method AND d.dom = e.dst AND d.node = e.src),
body AS (SELECT method, h AS header, h AS node FROM back UNION SELECT method, h, t FROM back
  UNION SELECT b.method, b.header, e.src FROM body b JOIN f_flow e ON e.method = b.method AND e.dst = b.node AND b.node <> b.header JOIN rb ON rb.method = e.method AND rb.block = e.src)"""
LOCAL = """SELECT method, block, stmt AS use, last_value(CASE WHEN is_def THEN stmt END IGNORE NULLS) OVER (PARTITION BY method, block, name ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def, name, is_def FROM f_stmt"""
PATHS = """WITH RECURSIVE ent AS (SELECT * FROM f_enter), ex AS (SELECT * FROM f_exit), rt AS (SELECT * FROM f_ret), step AS (SELECT * FROM f_normal UNION SELECT * FROM f_past),
p(s, d0, n, d) USING KEY (s, d0, n, d) AS (
  SELECT s, d0, n, d FROM f_seed UNION (
    SELECT p.s, p.d0, k.n2, k.d2 FROM recurring.p p JOIN step k ON k.n = p.n AND k.d = p.d
    UNION SELECT c.start, c.d2, c.start, c.d2 FROM recurring.p p JOIN ent c ON c.n = p.n AND c.d = p.d
    UNION SELECT p.s, p.d0, r.n2, r.d2 FROM recurring.p p JOIN ent c ON c.n = p.n AND c.d = p.d JOIN recurring.p q ON q.s = c.start AND q.d0 = c.d2
      JOIN ex x ON x.exit = q.n AND x.start = q.s JOIN rt r ON r.n = p.n AND r.exit = q.n AND r.d = q.d))"""
TREE = """WITH raw AS (SELECT page_id AS tree, regexp_extract_all(coalesce(html, ''), '<(/?[a-zA-Z][a-zA-Z0-9]*)', 1) AS t FROM pages),
tags AS (SELECT tree, unnest(range(0, len(t))) AS pos, unnest(t) AS raw FROM raw),
k AS (SELECT tree, pos, lower(regexp_replace(raw, '^/', '')) AS tag, starts_with(raw, '/') AS is_close FROM tags),
s AS (SELECT *, tag IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') AS alone FROM k),
n AS (SELECT *, coalesce(sum(CASE WHEN alone THEN 0 WHEN is_close THEN -1 ELSE 1 END) OVER (PARTITION BY tree ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM s),
v AS (SELECT a.tree, a.pos, a.tag, a.depth, (SELECT max(b.pos) FROM n b WHERE b.tree = a.tree AND b.pos < a.pos AND b.depth = a.depth - 1 AND NOT b.is_close AND NOT b.alone) AS parent_pos FROM n a WHERE NOT a.is_close)"""

ORACLES = {
    "class_closure": f"WITH RECURSIVE r AS ({DESC}) SELECT anc, des FROM r",
    "class_children_count": f"WITH RECURSIVE r AS ({DESC}) SELECT anc, count(*) AS n_classes FROM r GROUP BY 1",
    "cha_edges": f"WITH RECURSIVE {CHA} SELECT caller, target FROM cha",
    "cha_reachable": f"WITH RECURSIVE {CHA}, q AS (SELECT method FROM f_entry UNION SELECT e.target FROM q JOIN cha e ON e.caller = q.method) SELECT method FROM q",
    "rta_edges": f"{RTA} SELECT DISTINCT e.caller, e.target FROM cha e JOIN f m ON m.kind = 'm' AND m.id = e.caller JOIN f c ON c.kind = 'c' AND c.id = e.class_id",
    "rta_instantiated": f"{RTA} SELECT id AS class_id FROM f WHERE kind = 'c'",
    "callgraph_outdegree": f"WITH RECURSIVE {CHA} SELECT caller, count(DISTINCT target) AS n_targets FROM cha GROUP BY 1",
    "points_to": """WITH RECURSIVE co AS (SELECT * FROM f_copy), st AS (SELECT * FROM f_store), ld AS (SELECT * FROM f_load),
        p(ptr, obj) USING KEY (ptr, obj) AS (SELECT var, obj FROM f_newobj UNION (
          SELECT c.dst, p.obj FROM recurring.p p JOIN co c ON c.src = p.ptr
          UNION SELECT concat('#', CAST(b.obj AS STRING), '.', s.field), v.obj FROM recurring.p b JOIN st s ON s.base = b.ptr JOIN recurring.p v ON v.ptr = s.src
          UNION SELECT l.dst, v.obj FROM recurring.p b JOIN ld l ON l.base = b.ptr JOIN recurring.p v ON v.ptr = concat('#', CAST(b.obj AS STRING), '.', l.field)))
        SELECT ptr, obj FROM p""",
    "stmt_next": """WITH n AS (SELECT *, lead(stmt) OVER (PARTITION BY method, block ORDER BY idx) AS nx FROM f_stmt),
        fst AS (SELECT method, block, min_by(stmt, idx) AS stmt FROM f_stmt GROUP BY 1, 2)
        SELECT method, stmt, nx AS next FROM n WHERE nx IS NOT NULL
        UNION ALL SELECT n.method, n.stmt, fst.stmt FROM n JOIN f_flow e ON e.method = n.method AND e.src = n.block JOIN fst ON fst.method = e.method AND fst.block = e.dst WHERE n.nx IS NULL""",
    "block_runs": """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
        SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n_events, min(event_id) AS first_id FROM b GROUP BY 1, 2, 3""",
    "cfg_reachable": f"WITH RECURSIVE {REACH} SELECT method, block FROM rb",
    "dominators": f"WITH RECURSIVE {DOM} SELECT method, dom, node FROM dom",
    "idom": f"""WITH RECURSIVE {DOM}, n AS (SELECT method, node, count(*) AS n FROM dom GROUP BY 1, 2)
        SELECT d.method, d.node, max_by(d.dom, n.n) AS idom FROM dom d JOIN n ON n.method = d.method AND n.node = d.dom WHERE d.dom <> d.node GROUP BY 1, 2""",
    "dominance_frontier": f"WITH RECURSIVE {DF} SELECT method, node, frontier FROM df",
    "loop_members": f"WITH RECURSIVE {LOOPS} SELECT method, header, node FROM body",
    "block_kinds": f"""WITH RECURSIVE {LOOPS},
        e AS (SELECT DISTINCT method, src, dst FROM f_flow),
        lv AS (SELECT DISTINCT e.method, e.src AS block FROM e JOIN body b ON b.method = e.method AND b.node = e.src AND e.src <> b.header
          WHERE NOT EXISTS (SELECT 1 FROM body q WHERE q.method = e.method AND q.header = b.header AND q.node = e.dst)),
        o AS (SELECT method, src AS block, count(*) AS n FROM e GROUP BY 1, 2)
        SELECT b.method, b.block, CASE WHEN EXISTS (SELECT 1 FROM body q WHERE q.method = b.method AND q.header = b.block) THEN 'loop'
          WHEN EXISTS (SELECT 1 FROM e JOIN body q ON q.method = e.method AND q.header = e.dst AND q.node = e.src WHERE e.method = b.method AND e.src = b.block) THEN 'continue'
          WHEN lv.block IS NOT NULL THEN 'break' WHEN o.n > 1 THEN 'if' ELSE 'normal' END AS kind
        FROM (SELECT DISTINCT method, block FROM f_block) b LEFT JOIN lv ON lv.method = b.method AND lv.block = b.block LEFT JOIN o ON o.method = b.method AND o.block = b.block""",
    "def_use_local": f"SELECT method, block, use, def, name FROM ({LOCAL}) WHERE NOT is_def",
    "def_use_global": f"""WITH RECURSIVE loc AS ({LOCAL}), gen AS (SELECT method, block, name, max_by(stmt, idx) AS def FROM f_stmt WHERE is_def GROUP BY 1, 2, 3), e AS (SELECT * FROM f_flow),
        ent AS (SELECT g.method, e.dst AS block, g.name, g.def FROM gen g JOIN e ON e.method = g.method AND e.src = g.block
          UNION SELECT n.method, e.dst, n.name, n.def FROM ent n JOIN e ON e.method = n.method AND e.src = n.block
            WHERE NOT EXISTS (SELECT 1 FROM gen g WHERE g.method = n.method AND g.block = n.block AND g.name = n.name))
        SELECT method, use, def, name FROM loc WHERE NOT is_def AND def IS NOT NULL
        UNION ALL SELECT l.method, l.use, n.def, l.name FROM loc l JOIN ent n ON n.method = l.method AND n.block = l.block AND n.name = l.name WHERE NOT l.is_def AND l.def IS NULL""",
    "phi_sites": f"""WITH RECURSIVE {DF}, defs AS (SELECT DISTINCT method, name, block FROM f_stmt WHERE is_def),
        phi AS (SELECT d.method, d.name, f.frontier AS block FROM defs d JOIN df f ON f.method = d.method AND f.node = d.block
          UNION SELECT p.method, p.name, f.frontier FROM phi p JOIN df f ON f.method = p.method AND f.node = p.block)
        SELECT method, name, block FROM phi""",
    "ifds_path_edges": f"{PATHS} SELECT s, d0, n, d FROM p",
    "ifds_taint_report": f"{PATHS} SELECT DISTINCT p.n, p.d FROM p JOIN f_name k ON k.n = p.n AND k.d = p.d AND NOT k.is_gen WHERE p.d <> 0",
    "view_tree": f"{TREE} SELECT tree, pos, tag, depth, parent_pos FROM v",
    "view_tree_depth": f"{TREE} SELECT tree, count(*) AS n_nodes, max(depth) AS max_depth FROM v GROUP BY 1",
    "import_resolution": """WITH l AS (SELECT page_id, host, regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1) AS h FROM f_page),
        x AS (SELECT page_id, host, unnest(range(0, len(h))) AS ord, unnest(h) AS spec FROM l),
        t AS (SELECT host, path, min(page_id) AS target FROM f_page GROUP BY 1, 2)
        SELECT page_id, ord, spec, target FROM x LEFT JOIN t ON t.host = x.host AND t.path = x.spec""",
    "ranked_lookup": """WITH c AS (SELECT n.n_nationkey AS nation, m.name AS brand, CASE WHEN s_nationkey = n.n_nationkey THEN 1 WHEN o.n_regionkey = n.n_regionkey THEN 2 ELSE 3 END AS prio, s_suppkey AS suppkey
          FROM f_method m JOIN supplier ON m.class_id = concat('S', CAST(s_suppkey AS STRING)) JOIN nation o ON o.n_nationkey = s_nationkey CROSS JOIN nation n)
        SELECT nation, brand, prio, suppkey FROM c QUALIFY row_number() OVER (PARTITION BY nation, brand ORDER BY prio, suppkey) = 1""",
    "visible_classes": """WITH RECURSIVE sc AS (SELECT * FROM f_scope), ow AS (SELECT * FROM f_declared),
        up AS (SELECT scope, name, entity FROM ow WHERE is_exported UNION SELECT s.parent, u.name, u.entity FROM up u JOIN sc s ON s.scope = u.scope AND s.is_exported AND s.parent IS NOT NULL),
        here AS (SELECT scope, name, entity FROM ow UNION SELECT * FROM up),
        vis AS (SELECT * FROM here UNION SELECT s.scope, v.name, v.entity FROM vis v JOIN sc s ON s.parent = v.scope)
        SELECT scope, name, entity FROM vis""",
    "global_variables": """WITH RECURSIVE sc AS (SELECT * FROM f_scope), ow AS (SELECT * FROM f_declared),
        vis AS (SELECT scope, name, entity FROM ow UNION SELECT s.scope, v.name, v.entity FROM vis v JOIN sc s ON s.parent = v.scope
          WHERE NOT EXISTS (SELECT 1 FROM ow o WHERE o.scope = s.scope AND o.name = v.name))
        SELECT scope, name, entity FROM vis""",
    "type_of_literals": """SELECT event_id, json_extract_string(props, '$.k') AS literal,
        CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'unknown' WHEN regexp_full_match(json_extract_string(props, '$.k'), '-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') THEN 'number' ELSE 'unknown' END AS type,
        'string' AS name_type FROM events""",
    "binop_types": """WITH t AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'number' ELSE 'string' END AS l FROM events),
        p AS (SELECT l, lead(l) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM t),
        o AS (SELECT l, r, unnest(['+', '-', '<', '==', '&&', '??', '**', '>>']) AS op FROM p WHERE r IS NOT NULL)
        SELECT op, l, r, CASE WHEN op IN ('<', '==', '&&') THEN 'boolean' WHEN op = '+' AND (l = 'string' OR r = 'string') THEN 'string' WHEN op IN ('+', '-', '>>') AND l = 'number' AND r = 'number' THEN 'number'
          ELSE 'unknown' END AS type, count(*) AS n FROM o GROUP BY 1, 2, 3, 4""",
    "signature_render": """SELECT p_partkey, concat('@shop/', replace(p_name, ' ', '/'), ': ', p_brand, '.', p_name, '(',
        CASE WHEN string_split(p_type, ' ')[1] = 'number' THEN 'number' ELSE concat('number, ', string_split(p_type, ' ')[1]) END, ')') AS signature FROM part""",
    "dot_lines": """WITH e AS (SELECT DISTINCT method, src, dst FROM f_flow)
        SELECT method, concat('digraph m', CAST(method AS STRING), ' {', chr(10), string_agg(concat('  "m', CAST(method AS STRING), '_', CAST(src AS STRING), '" -> "m', CAST(method AS STRING), '_', CAST(dst AS STRING), '"'), chr(10) ORDER BY src, dst), chr(10), '}') AS dot
        FROM e GROUP BY 1""",
    "member_overwrite": "SELECT p_brand AS class, p_type AS member, max(p_partkey) AS p_partkey, max_by(p_size, p_partkey) AS p_size FROM part GROUP BY 1, 2",
    "source_order": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS position FROM lineitem",
    "asof_sourcemap": """WITH m AS (SELECT user_id, ts, min(event_id) AS mark FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
        SELECT e.event_id, e.user_id, m.mark FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN m ON m.user_id = e.user_id AND m.ts >= e.ts""",
    "content_hash_changes": "SELECT source, sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2",
    "conversation_def_use": """SELECT conv_id, use, def FROM (SELECT conv_id, turn AS use, role = 'user' AS is_def,
        last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def FROM conversations) WHERE NOT is_def""",
    "string_rules": """WITH p AS (SELECT *, string_split(p_name, ' ') AS w FROM part)
        SELECT p_partkey, array_to_string(w[1:2], chr(10)) AS first_lines, concat('/a/', CASE WHEN len(w) > 1 THEN concat(array_to_string(w[1:len(w) - 1], '/'), '/') ELSE '' END, 'x/', CAST(p_partkey AS VARCHAR)) AS path,
          concat(w[1], '|', CAST(p_partkey AS VARCHAR), '|m') AS parts, 0 AS no_parts, w[1] AS bracket_spaced, w[1] AS bracket, concat(CASE WHEN p_size % 2 = 0 THEN 'get ' ELSE 'set ' END, w[1]) AS accessor, p_size AS api, 9 AS no_api,
          CAST(list_sum(list_transform(string_split(p_brand, ''), lambda c: ord(c))) + 233 + 55357 + 56832 AS BIGINT) AS code_sum, sha256(p_type) AS hash, w[1] AS stem FROM p""",
    "type_rules": """WITH p AS (SELECT p_partkey, p_size, ['number', 'RegularExpression', 'Shop', 'never'][p_partkey % 4 + 1] AS t FROM part)
        SELECT p_partkey, ['>=', '<', '!==', '==', NULL][p_partkey % 5 + 1] AS negated, CASE t WHEN 'RegularExpression' THEN 'class RegExp' WHEN 'Shop' THEN 'ref Shop' ELSE t END AS "type",
          ['number', 'string', 'void', 'ArrayType'][p_partkey % 4 + 1] AS "keyword", concat('(', t, ')', repeat('[]', p_size % 3)) AS "array", CASE t WHEN 'number' THEN 'number' ELSE concat(t, '|number') END AS "either",
          ['0', concat(chr(39), chr(39)), 'false', 'null', 'undefined'][p_partkey % 5 + 1] AS "value", CASE t WHEN 'number' THEN 'number' ELSE 'unknown' END AS "element" FROM p""",
    "import_files": """WITH p AS (SELECT concat('src/a/f', CAST(p_partkey AS VARCHAR), '.ts') AS path, p_partkey % 6 AS k, string_split(p_name, ' ')[1] AS w FROM part)
        SELECT path, [concat('./', w), concat('../../lib/', w, '.ts'), concat('@ohos.', w), 'kit', concat('@shop/core/', w), w][k + 1] AS from_spec, ['own', 'own', 'system', 'sdk', 'dependency', 'unknown'][k + 1] AS kind,
          [concat('src/a/', w), concat('lib/', w), concat('@ohos.', w), 'kit', concat('libs/core/', w), NULL][k + 1] AS file FROM p""",
    "governing_packages": """SELECT concat('r', CAST(n_regionkey AS VARCHAR), '/n', CAST(n_nationkey AS VARCHAR), '/main.ts') AS path,
        concat('oh-package.json5', CASE WHEN n_regionkey % 2 = 0 THEN concat(',r', CAST(n_regionkey AS VARCHAR), '/oh-package.json5') ELSE '' END,
          CASE WHEN n_nationkey % 3 = 0 THEN concat(',r', CAST(n_regionkey AS VARCHAR), '/n', CAST(n_nationkey AS VARCHAR), '/oh-package.json5') ELSE '' END) AS packages FROM nation""",
    "original_paths": "SELECT concat('f', CAST(p_partkey AS VARCHAR), '.ts') AS path, concat('f', CAST(p_partkey AS VARCHAR), CASE WHEN p_size % 2 = 0 THEN '.ets' ELSE '.ts' END) AS original FROM part",
    "changed_files": "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 10 = 5",
    "overriding_methods": f"""WITH RECURSIVE r AS ({DESC}), b AS (SELECT DISTINCT class_id, concat(name, '(number)') AS sub_sig FROM f_method),
        d AS (SELECT class_id, sub_sig FROM b UNION SELECT x.sup, b.sub_sig FROM b JOIN f_extends x ON x.sub = b.class_id)
        SELECT d.class_id, d.sub_sig, b.class_id AS target FROM d JOIN r ON r.anc = d.class_id JOIN b ON b.class_id = r.des AND b.sub_sig = d.sub_sig""",
    "source_positions": """SELECT concat('f', CAST(s_suppkey AS VARCHAR)) AS path, g.* FROM supplier CROSS JOIN (VALUES (1, 0, 1, 1), (1, 4, 1, 1), (1, 5, 2, 3), (1, 11, 0, 0), (2, 2, 3, 4), (3, 1, 0, 0)) g(line, col, original_line, original_col)""",
    "json5_values": "SELECT p_partkey, p_brand AS name, CAST(p_size AS VARCHAR) AS size, concat(CAST(p_partkey AS VARCHAR), '.50') AS dep, 'true' AS on FROM part",
    "transpile_statistics": "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, max(length(props)) AS longest FROM events GROUP BY 1",
}


def oracle_sql() -> dict[str, str]:
    from .programs import ORACLES as programs

    return {**{k: with_facts(v) for k, v in ORACLES.items()}, **programs}
