"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

_TOKEN = r"\[[^\]\r\n]{1,40}\][+-]?|\bm\s*/\s*z\b|\d+(?:\.\d+)?(?:-[a-z0-9]+)+|\d+(?:\.\d+)?|[a-z]+(?:[-''][a-z0-9]+)*"
_TOKENS = f"regexp_extract_all(translate(lower(text), '−–—／＋', '---/+'), '{_TOKEN}')"
_PRICES = """
SELECT l_orderkey * 10 + l_linenumber AS query_id, p_partkey, p_brand, l_extendedprice AS observed, p_retailprice AS reference
FROM lineitem JOIN part ON l_extendedprice BETWEEN p_retailprice - 0.6 AND p_retailprice + 0.6
WHERE abs(l_extendedprice - p_retailprice) <= 0.5 AND abs(l_extendedprice - p_retailprice) / greatest(abs(p_retailprice), 1e-12) * 1e6 <= 500
"""


def _score(family: tuple[str, ...], bonus: str) -> str:
    hits = " + ".join(f"CAST(regexp_matches(t, '(?i){p}') AS INTEGER)" for p in family)
    return f"round(least(1.0, ({hits}) / {float(len(family))} + {bonus}), 6)"


_FAMILIES = {
    "compound": (r"\bcompound(?:s)?\b", r"\bidentif(?:y|ied|ication)\b", r"\bmolecular formula\b", r"\bexact mass\b", r"\b(?:lc|uhplc|uplc)[-\s]?(?:ms|ms/ms)\b"),
    "fragment": (r"\bfragment(?:ation|s)?\b", r"\bproduct ion(?:s)?\b", r"\bdiagnostic ion(?:s)?\b", r"\bms\s*/\s*ms\b", r"\bcid\b"),
    "review": (r"\breview\b", r"\boverview\b", r"\bsummar(?:y|izes|ised)\b"),
    "supplementary": (r"\bsupplement(?:ary)?\b", r"\btable\s+s?\d+\b", r"\bretention time\b", r"\bobserved m\s*/\s*z\b", r"\bcalculated m\s*/\s*z\b"),
}


def _alignment() -> str:
    catalog = "CASE WHEN role = 'compound_catalog' THEN 0.15 ELSE 0.0 END"
    return f"""
WITH docs AS (
  SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' Review of product ions and compounds' ELSE '' END AS t,
         CASE doc_id % 3 WHEN 0 THEN 'review' WHEN 1 THEN 'compound_catalog' ELSE 'article_text' END AS role
  FROM documents)
SELECT doc_id, {_score(_FAMILIES["compound"], catalog)} AS compound_score, {_score(_FAMILIES["fragment"], catalog)} AS fragment_score,
       {_score(_FAMILIES["review"], "CASE WHEN role = 'review' THEN 0.25 ELSE 0.0 END")} AS review_score,
       {_score(_FAMILIES["supplementary"], "CASE WHEN role = 'compound_catalog' THEN 0.35 ELSE 0.0 END")} AS supplementary_score
FROM docs"""


#: The published patterns. Letters beyond ASCII become a word character that no class has, other such signs one that is none.
_RARE = r"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{M}\p{N}]', '#', 'g'), '[^\x00-\x7F]', '_', 'g') AS t FROM documents)
SELECT doc_id, 3.0::DOUBLE * len(regexp_extract_all(t, '\bC\d+H\d+(?:[A-Z][a-z]?\d*)*\b')) + 2.0::DOUBLE * len(regexp_extract_all(t, '(?i)\bm\s*/\s*z\b|\b\d+\.\d{3,}\b'))
  + 1.0::DOUBLE * len(regexp_extract_all(t, '\b[A-Z][A-Za-z]+(?:[- ][A-Za-z0-9]+){1,}\b'))
  + 0.5::DOUBLE * len(regexp_extract_all(t, '(?i)\b[A-Za-z]+(?:ine|ol|one|acid|oside|glycoside|glucoside|aglycone|ester|amide)s?\b')) AS score FROM t
"""


ORACLE_SQL = {
    "library_search": """
WITH raw AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(abs(unnest(embedding)) AS FLOAT) AS x FROM embeddings
), based AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS base FROM raw WHERE x > 0
), strong AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i DESC) AS r FROM based WHERE x >= base * CAST(0.05 AS FLOAT)
), peaks AS (SELECT vec_id, i, CAST(x AS DOUBLE) AS x FROM strong WHERE r <= 20
), norms AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM peaks GROUP BY 1
), spectra AS (SELECT vec_id, 200.0::DOUBLE + (vec_id % 50) * 0.0015::DOUBLE AS mz, label % 2 AS mode FROM embeddings
), pairs AS (
  SELECT q.vec_id AS query_id, l.vec_id AS library_id, abs(q.mz - l.mz) / abs(l.mz) * 1e6 AS ppm
  FROM spectra q JOIN spectra l ON q.mode = l.mode
  WHERE q.vec_id % 10 = 0 AND l.vec_id <> q.vec_id AND abs(q.mz - l.mz) <= least(0.0021, abs(q.mz) * 1e-5) AND abs(q.mz - l.mz) / abs(l.mz) * 1e6 <= 10.0
), scored AS (
  SELECT query_id, 'name' || (library_id % 40) AS name, lpad(CAST(library_id AS VARCHAR), 9, '0') AS source, ppm,
         sum(a.x * b.x) / any_value(na.n) / any_value(nb.n) AS score, CAST(count(*) AS INTEGER) AS matched_n
  FROM pairs JOIN peaks a ON a.vec_id = query_id JOIN peaks b ON b.vec_id = library_id AND a.i = b.i
  JOIN norms na ON na.vec_id = query_id JOIN norms nb ON nb.vec_id = library_id
  GROUP BY query_id, library_id, ppm
), best AS (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY score DESC, ppm, name, source) AS n FROM scored
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ppm, name, source) AS INTEGER) AS hit_rank FROM best WHERE n = 1)
SELECT query_id, name, source, hit_rank, matched_n, round(score, 5) AS score FROM ranked WHERE hit_rank <= 3
""",
    "bm25_topk": f"""
WITH queries(query_id, query) AS (VALUES ('q1', 'the and of ions'), ('q2', 'de la les'), ('q3', 'licensed under the GNU General Public License'), ('q4', 'und der die the the')),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(string_split(lower(query), ' ')) AS term FROM queries) GROUP BY 1, 2),
docs AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents),
totals AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs),
tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term) CROSS JOIN totals GROUP BY 1, 2),
ranked AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS "rank" FROM scored WHERE score > 0)
SELECT query_id, "rank", doc_id, round(score, 5) AS score FROM ranked WHERE "rank" <= 12
""",
    "token_stats": f"SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, CAST(len(list_distinct(tokens)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {_TOKENS} AS tokens FROM documents)",
    "band_join_ppm_da": f"SELECT query_id, p_partkey, round(abs(observed - reference), 4) AS error_da FROM ({_PRICES})",
    "best_hit_per_name": f"""
WITH hits AS (SELECT query_id, p_brand AS name, CAST(p_partkey AS VARCHAR) AS source, round(1 - abs(observed - reference), 4) AS score FROM ({_PRICES})),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(name) ORDER BY score DESC, name, source) AS n FROM hits),
ranked AS (SELECT query_id, name, source, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, source) AS INTEGER) AS hit_rank FROM best WHERE n = 1)
SELECT * FROM ranked WHERE hit_rank <= 2
""",
    "cosine_dense": """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(abs(e) AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id, round(least(1.0, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v))), 5) AS score
FROM x a JOIN x b ON b.vec_id = a.vec_id + 1
""",
    "q_values": """
WITH s AS (SELECT event_id AS i, value AS t, value * 0.5::DOUBLE + 10 AS dec FROM events),
u AS (SELECT i, t AS sc, 0 AS d FROM s UNION ALL SELECT i, dec, 1 FROM s),
c AS (SELECT *, sum(d) OVER (ORDER BY sc DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nd FROM u),
f AS (SELECT i, (1.0::DOUBLE + nd) / row_number() OVER (ORDER BY sc DESC, i) AS fdr, row_number() OVER (ORDER BY sc DESC, i) AS rk FROM c WHERE d = 0)
SELECT i AS event_id, round(least(1.0, min(fdr) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM f
""",
    "consensus_topn": """
WITH t AS (SELECT DISTINCT l_returnflag, l_linestatus, CAST(floor(l_quantity) AS BIGINT) AS fragment, l_partkey FROM lineitem),
s AS (SELECT l_returnflag, l_linestatus, fragment, count(*) AS support FROM t GROUP BY ALL),
n AS (SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS compounds FROM t GROUP BY ALL),
r AS (SELECT l_returnflag, l_linestatus, fragment, support, round(support / compounds, 6) AS fraction,
             row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY support DESC, fragment) AS support_rank
      FROM s JOIN n USING (l_returnflag, l_linestatus) WHERE support >= 20 AND support / compounds >= 0.02)
SELECT * FROM r WHERE support_rank <= 20
""",
    "fragment_specificity": """
WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'not_reported' END AS mode, p_retailprice AS mz, CASE WHEN p_size = 3 THEN '' ELSE p_brand END AS e FROM part),
k AS (SELECT * FROM p WHERE mode <> 'not_reported' AND e <> ''),
n AS (SELECT mode, count(DISTINCT e) AS universe FROM k GROUP BY 1),
c AS (SELECT a.p_partkey, count(DISTINCT b.e) AS n FROM k a JOIN k b ON a.mode = b.mode AND b.mz BETWEEN a.mz - 1.0 AND a.mz + 1.0 GROUP BY 1)
SELECT p.p_partkey, coalesce(c.n, 0) AS competitor_count, round(coalesce(c.n / universe, 0.0), 6) AS competitor_fraction,
  CASE WHEN p.mode = 'not_reported' THEN 'polarity_unresolved' WHEN e = '' THEN 'unassigned' WHEN c.n <= 1 THEN 'unique' WHEN c.n / universe <= 0.2 THEN 'low_sharing' ELSE 'shared' END AS status
FROM p LEFT JOIN c USING (p_partkey) LEFT JOIN n ON n.mode = p.mode
""",
    "link_audit": """
WITH f AS (SELECT o_orderkey AS id, 100.0::DOUBLE + (o_custkey % 3) * 0.01::DOUBLE AS mz, CASE o_orderstatus WHEN 'O' THEN 'positive' WHEN 'F' THEN 'negative' ELSE 'positive' END AS mode FROM orders),
s AS (SELECT l_orderkey AS id, 100.0::DOUBLE + (l_suppkey % 5) * 0.01::DOUBLE AS mz, CASE WHEN l_returnflag = 'A' THEN 'negative' ELSE '' END AS mode,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_extendedprice AS FLOAT) DESC, l_linenumber) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n
      FROM lineitem),
l AS (SELECT s.n, CASE WHEN f.mode <> 'positive' THEN 'other_polarity' WHEN s.id IS NULL THEN 'no_spectrum' WHEN s.mode = 'negative' THEN 'polarity_conflict'
        WHEN abs(s.mz - f.mz) > 0.0101 THEN 'mass_conflict' ELSE 'accepted' END AS step FROM f LEFT JOIN s ON s.id = f.id AND s.r = 1)
SELECT step, count(*) AS features, count(*) FILTER (WHERE n > 1) AS with_several_spectra FROM l GROUP BY 1
""",
    "anti_gap": """
SELECT c_custkey, kind FROM (SELECT c_custkey FROM customer) CROSS JOIN (VALUES ('F'), ('O'), ('P')) k(kind)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = kind)
""",
    "context_neighbours": """
WITH t AS (SELECT conv_id, turn, role, length(text) % 5 = 0 AS hit, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT a.conv_id, a.turn, a.role, bool_or(a.n = b.n) AS direct FROM t a JOIN t b ON a.conv_id = b.conv_id AND abs(a.n - b.n) <= 1 AND b.hit GROUP BY 1, 2, 3
""",
    "page_islands": """
WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events),
r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM d),
g AS (SELECT user_id, min(day) AS first_position, max(day) AS last_position, count(*) AS length FROM r GROUP BY user_id, run)
SELECT user_id, CAST(first_position AS INTEGER) AS first_position, CAST(last_position AS INTEGER) AS last_position, length,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_position) AS INTEGER) AS island FROM g
""",
    "ordered_merge": """
WITH f AS (SELECT user_id, event_type, min(event_id) AS e FROM events GROUP BY 1, 2),
u AS (SELECT user_id, string_agg(event_type, ';' ORDER BY e) AS kinds, min(e) AS event_id FROM f GROUP BY 1),
k AS (SELECT user_id, arg_min(event_type, event_id) AS kind FROM events WHERE value > 20 GROUP BY 1)
SELECT user_id, event_id, coalesce(kind, '') AS kind, kinds FROM u LEFT JOIN k USING (user_id)
""",
    "bfs_depth2": """
WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS t FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem),
w(node, depth) AS (SELECT 's' || s_suppkey, 0 FROM supplier WHERE s_suppkey <= 2 UNION SELECT e.t, w.depth + 1 FROM w JOIN e ON e.s = w.node WHERE w.depth < 2)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1
""",
    "division": """
SELECT DISTINCT o_custkey FROM orders a WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT o_orderstatus AS s FROM orders) WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = s))
""",
    "capped_combinations": """
WITH n AS (SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT a.r_name, a.n_name AS nation, s.segment, b.n_name AS other FROM n a CROSS JOIN (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE')) s(segment) JOIN n b ON a.r_name = b.r_name AND b.n_name > 'NATION_2')
SELECT *, count(*) OVER (PARTITION BY r_name) AS combination_count FROM c QUALIFY count(*) OVER (PARTITION BY r_name) <= 60
""",
    "formula_masses": """
SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '' ELSE 'C' || (p_size + 1) || 'H' || (p_size % 7 + 2) || CASE WHEN p_size % 3 = 0 THEN 'Cl' ELSE '' END || 'N' || (p_partkey % 40 + 2) END AS hill,
  CASE WHEN p_size % 10 <> 0 THEN round((p_size + 1) * 12.0::DOUBLE + (p_size % 7 + 2) * 1.00782503223::DOUBLE + CASE WHEN p_size % 3 = 0 THEN 34.968852682::DOUBLE ELSE 0 END + (p_partkey % 40 + 2) * 14.00307400443::DOUBLE, 6) END AS mass
FROM part
""",
    "chunk_documents": r"""
WITH RECURSIVE cut(doc_id, text, n, a0, stop) AS (
  SELECT doc_id, text, length(text), 0, CASE WHEN 1200 >= length(text) THEN length(text)
    WHEN regexp_matches(substr(text, 841, 360), '[ \n]') THEN 840 + length(regexp_extract(substr(text, 841, 360), '(?s)^(.*)[ \n]', 1)) ELSE 1200 END
  FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, n, nat, CASE WHEN nat + 1200 >= n THEN n
    WHEN regexp_matches(substr(text, nat + 841, 360), '[ \n]') THEN nat + 840 + length(regexp_extract(substr(text, nat + 841, 360), '(?s)^(.*)[ \n]', 1)) ELSE nat + 1200 END
  FROM (SELECT *, greatest(stop - 200, a0 + 1) AS nat FROM cut WHERE stop < n)
), piece AS (SELECT doc_id, a0, substr(text, a0 + 1, stop - a0) AS p FROM cut),
trimmed AS (SELECT doc_id, a0, a0 + length(p) - length(regexp_replace(p, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '')) AS char_start, regexp_replace(regexp_replace(p, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ''), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '') AS chunk_text FROM piece)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a0) AS INTEGER) AS chunk_number, CAST(char_start AS INTEGER) AS char_start, CAST(char_start + length(chunk_text) AS INTEGER) AS char_end, chunk_text
FROM trimmed WHERE chunk_text <> ''
""",
    "rebuilt_documents": r"SELECT doc_id, CAST(length(t) AS INTEGER) AS n_visible, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(text, '[\s\x0b]', '', 'g') AS t FROM documents WHERE regexp_matches(text, '\S'))",
    "evidence_alignment": _alignment(),
    "rare_terms": _RARE,
    "zero_filled_types": "SELECT t.event_type, count(e.event_id) AS count FROM (VALUES ('view'), ('click'), ('purchase'), ('refund_never')) t(event_type) LEFT JOIN events e USING (event_type) GROUP BY 1",
    "traceable_quotes": r"""
WITH d AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', '')
    ELSE array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN (i - 1) % 9 = 8 THEN 'Qqq' ELSE w END), ' ') END AS quote FROM documents),
n AS (SELECT *, trim(regexp_replace(quote, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) AS q, regexp_replace(translate(lower(quote), '−–—‐', '----'), '[\s\x0b\x{85}\p{Z}]+', '', 'g') AS plain,
    regexp_replace(translate(lower(text), '−–—‐', '----'), '[\s\x0b\x{85}\p{Z}]+', '', 'g') AS whole FROM d),
k AS (SELECT doc_id, lower(unnest(regexp_extract_all(quote, '[A-Za-z]+(?:[-''][A-Za-z0-9]+)*|\d+(?:\.\d+)?'))) AS t FROM d),
h AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z0-9]+)*|\d+(?:\.\d+)?'))) AS t FROM d),
s AS (SELECT k.doc_id, count(h.t) / count(*) AS share FROM k LEFT JOIN h USING (doc_id, t) GROUP BY 1)
SELECT doc_id, CASE WHEN coalesce(q, '') = '' THEN 'failed' WHEN contains(text, q) THEN 'exact' WHEN plain <> '' AND contains(whole, plain) THEN 'normalized' WHEN round(share, 4) > 0.75 THEN 'fuzzy' ELSE 'failed' END AS status
FROM n LEFT JOIN s USING (doc_id)
""",
    "network_expansion": """
SELECT * FROM (VALUES ('n0', 'A', 'known_match', '', 0), ('n1', 'B', 'fragment_supported_discover', 'class_consensus_pair', 1),
 ('n2', 'D', 'fragment_supported_discover', 'class_consensus_pair', 2), ('n3', 'D', 'candidate', 'failed', 2)) t(node_id, target_entity_id, annotation_status, fragment_gate_level, network_depth)
""",
    "formula_consensus": """
WITH c AS (SELECT p_brand AS entity_id, CASE p_size % 4 WHEN 0 THEN 'C6H12O6' WHEN 1 THEN 'H2O' WHEN 2 THEN 'NaCl' ELSE 'bad' END AS formula,
             CASE p_size % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS trust, p_partkey % 40 AS e, p_partkey AS ord FROM part),
g AS (SELECT entity_id, formula, count(DISTINCT e) AS evidence, max(trust) AS best, sum(trust) AS total, min(ord) AS first FROM c WHERE formula <> 'bad' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY evidence DESC, best DESC, total DESC, first) AS n, count(*) OVER (PARTITION BY entity_id) AS k FROM g)
SELECT entity_id, formula, k > 1 AS conflict FROM r WHERE n = 1
""",
    "learned_aliases": """
SELECT * FROM (VALUES ('e1', 'e2', 'series_prefix'), ('e3', 'e4', 'series_prefix'), ('e5', 'e6', 'series_prefix'), ('e8', 'e2', 'equivalent_name'),
 ('e9', 'e10', 'identifier_suffix')) t(entity_id, canonical_id, reason)
""",
    "diagnostic_claims": """
SELECT * FROM (VALUES ('betacyanin', '150.05', 'explicit_diagnostic', 'c1', 0.85::DOUBLE), ('betacyanin', '389.1', 'explicit_diagnostic', 'c1', 0.85),
 ('', '389.1', 'explicit_diagnostic', 'c2', 0.85), ('', '222.22', 'structural_mapping', 'c4', 0.75)) t(subclass, fragment_mz, diagnostic_evidence_type, evidence_ids, confidence)
""",
    "critic_verdicts": r"""
WITH c AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'no such words here' ELSE replace(substr(text, 3, 40), ' ', '  ') END AS quote,
             CASE WHEN doc_id % 3 <> 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'accept' ELSE 'review' END AS verdict FROM documents),
n AS (SELECT *, trim(regexp_replace(lower(quote), '\s+', ' ', 'g')) AS q, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM c),
f AS (SELECT *, q <> '' AND contains(t, q) AS traced FROM n)
SELECT CAST(doc_id AS VARCHAR) AS claim_id, coalesce(verdict, 'review') AS semantic_verdict,
  CASE WHEN traced THEN coalesce(verdict, 'review') WHEN verdict IS NOT NULL THEN 'reject' ELSE 'review' END AS final_verdict,
  CASE WHEN verdict IS NULL THEN 'not_assessed' ELSE 'explicit_report' END AS support_type,
  CASE WHEN traced THEN '' ELSE 'untraceable_evidence_quote' END AS reasons FROM f
""",
    "domain_verdicts": r"""
WITH c AS (SELECT doc_id AS claim_id, doc_id % 3 = 0 AS t, doc_id % 2 <> 0 AS ion,
  trim(regexp_replace(lower(CASE WHEN doc_id % 2 = 0 THEN 'Alpha' ELSE 'm/z 5' END || ' Beta ' || text), '[^a-z0-9]+', ' ', 'g')) AS h FROM documents),
m AS (SELECT *, CASE WHEN t AND ion THEN 'msms_fragmentation_not_entity_transformation' ELSE '' END AS shape FROM c),
x AS (SELECT *, CASE WHEN shape = '' THEN array_to_string(list_filter(['de la', 'the', 'und der'], lambda w: contains(h, w)), ';') ELSE '' END AS terms FROM m)
SELECT claim_id, CASE WHEN shape <> '' OR terms = '' THEN 'reject' ELSE 'pass' END AS verdict,
  CASE WHEN shape <> '' THEN shape WHEN terms = '' THEN 'domain_relevance_not_established' ELSE '' END AS reason_code, terms FROM x
""",
    "recovered_losses": """
WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_quantity AS q, l_suppkey % 5 AS off, l_returnflag AS f, l_partkey AS p FROM lineitem)
SELECT claim_id, CASE WHEN off < 3 AND f <> 'A' AND p % 4 <> 0 THEN 'recover' ELSE 'reject' END AS verdict, CASE WHEN off < 3 AND f <> 'A' AND p % 4 <> 0 THEN CAST(CAST(q + 200 AS INTEGER) AS VARCHAR) || '.5' ELSE '' END AS source_ion_mz FROM l
""",
}
