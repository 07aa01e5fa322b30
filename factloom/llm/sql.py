"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP8 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS words FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(replace(t, '!', '')) AS n_exclaims,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    len(list_filter(words, lambda x: x IN (%STOP%))) AS n_stop,
    coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id IS NOT DISTINCT FROM cov.doc_id),
k AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.3 AND n_exclaims / n_words <= 0.5
  AND n_stop / n_words >= 0.02 AND n_dup_lines / greatest(len(lines), 1) <= 0.5 AS kept
FROM k
"""


def _stop_words() -> str:
    from .quality_rules import STOP_WORDS

    return ", ".join(f"'{x}'" for w in dict.fromkeys(STOP_WORDS) for x in (w, w.capitalize()))


OP1 = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w),
g AS (SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS win FROM p),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM d, (SELECT unnest(range(0, 35)) AS k)),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY 1)
SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (
  SELECT doc_id, CASE len(words) WHEN 0 THEN [] WHEN 1 THEN words
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w),
e AS (SELECT doc_id, unnest(shingles) AS g FROM s),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
c AS (SELECT a, min(b) AS component FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component AS component_id, doc_id = component AS kept FROM n JOIN c ON doc_id = a
"""

OP5 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ord FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, ord, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, k, s || chr(10) || lead(s) OVER o || chr(10) || lead(s, 2) OVER o AS win FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS n FROM w WHERE win IS NOT NULL) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, k + j AS k FROM r, (SELECT unnest(range(0, 3)) AS j)),
a AS (SELECT f.doc_id, f.ord, f.k, c.k IS NOT NULL AS gone FROM f LEFT JOIN c ON f.doc_id = c.doc_id AND f.k = c.k),
t AS (SELECT l.doc_id, count(a.k) AS n_lines, coalesce(count_if(a.gone), 0) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.ord) FILTER (WHERE a.gone IS NULL OR NOT a.gone) AS kept
      FROM l LEFT JOIN a ON l.doc_id = a.doc_id AND l.ord = a.ord GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM m
"""

OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
c AS (SELECT a, min(b) AS component FROM reach GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM both_ GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component AS component_id, vec_id = component AS kept FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN k ON vec_id = k.a
"""

# every source's turn at stopping at its cap: the level with all of lesser ratio stopped; the first that stays below its own cap holds
TARGETS = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY 1),
w AS (SELECT source, n, 3.0 * n AS cap, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
l AS (SELECT a.source, a.cap / a.w AS ratio, ((SELECT sum(n) FROM w) - coalesce((SELECT sum(b.cap) FROM w b WHERE b.cap / b.w < a.cap / a.w), 0)) / (SELECT sum(b.w) FROM w b WHERE b.cap / b.w >= a.cap / a.w) AS level FROM w a),
h AS (SELECT min_by(level, ratio) AS level FROM l WHERE level <= ratio)
SELECT d.doc_id, size, w.n AS source_size, round(least(cap, coalesce((SELECT level FROM h) * w.w, cap)), 3) AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
"""

ORACLES = {
    "mix_targets": TARGETS,
    "op1_substring_dedup": OP1,
    "op4_minhash_dedup": OP4,
    "op5_line_dedup": OP5,
    "op6_warc_captures": OP6,
    "op9_embedding_dedup": OP9,
    "op8_quality_rules": OP8.replace("%STOP%", _stop_words()),
}
