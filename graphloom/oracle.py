"""The same queries as DuckDB SQL over the driver's tables, written independently of the plans."""

from __future__ import annotations

# The wording that queries must give, stated here and not taken from the operators.
SYSTEM_TEXT = "You answer questions about one codebase, briefly and only from what it contains."
PROMPTS = {
    "discovery": [
        "Is there support for {}?",
        "Does this codebase offer {}?",
        "Can I find {} in this project?",
        "What does the project provide as {}?",
    ],
    "explain": [
        "What does {} do internally?",
        "Explain {}.",
        "Why does {} exist?",
        "Describe the {type} {}.",
    ],
    "howto": [
        "How do I use {}?",
        "Show me how to apply {}.",
        "What is the way to run {}?",
        "Give an example of {}.",
    ],
    "diagnostics": [
        "What raises {}?",
        "How can {} be resolved?",
        "Why do I see {}?",
        "In which cases does {} arise?",
    ],
}

GRAPH = r"""
raw AS (
  SELECT 'r:' || r_regionkey AS id, 'file' AS type, r_name AS name, '/' || r_name AS path, 'python' AS lang, '{"lines": ' || (r_regionkey + 10) || '}' AS properties, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, '' AS doc FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'class', n_name, '/nation/' || n_nationkey, 'java', '{"start_line": ' || n_nationkey || ', "end_line": ' || (n_nationkey + 5) || '}', n_nationkey, n_nationkey + 5, '' FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'function', c_name, '/customer/' || (c_custkey % 10), 'python', '{"start_line": ' || c_custkey || '}', c_custkey, NULL, '' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'class', s_name, NULL, NULL, '{}', NULL, NULL, '' FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, 'function', (['main_', '_', 'test_', 'run_', ''])[p_partkey % 5 + 1] || p_name, '/part/' || p_brand, 'cpp', '{"start_line": ' || p_size || ', "end_line": ' || (p_size + 3) || ', "public": true, "doc": "' || p_type || ' part", "tags": [1]}', p_size, p_size + 3, p_type || ' part' FROM part
  UNION ALL SELECT DISTINCT 'e:' || event_type, 'class', event_type, '/events', 'go', '{}', NULL::BIGINT, NULL::BIGINT, '' FROM events
  UNION ALL SELECT DISTINCT 't:' || conv_id || ':' || turn, 'concept', 'turn ' || turn, NULL, NULL, '{}', NULL::BIGINT, NULL::BIGINT, '' FROM conversations
  UNION ALL SELECT 'g:' || page_id, 'file', url, url, NULL, '{}', NULL, NULL, '' FROM pages),
calls AS (
  SELECT 'p:' || l_partkey AS source_id, 's:' || l_suppkey AS target_id, 'calls' AS relationship, 1.0::DOUBLE AS weight, '{"call_line": ' || arg_max(l_linenumber, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) || '}' AS properties
  FROM lineitem GROUP BY 1, 2),
pairs AS (SELECT DISTINCT event_type AS a, nx AS b FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NOT NULL),
edges AS (
  SELECT 'n:' || n_nationkey AS source_id, 'r:' || n_regionkey AS target_id, 'defined_in' AS relationship, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'defined_in', 1.0 FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'defined_in', 1.0 FROM supplier
  UNION ALL SELECT source_id, target_id, relationship, weight FROM calls
  UNION ALL SELECT 'e:' || a, 'e:' || b, 'calls', 1.0 FROM pairs
  UNION ALL SELECT DISTINCT 'c:' || user_id, 'e:error', 'throws', 1.0 FROM events WHERE event_type = 'error' AND user_id IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT DISTINCT 'g:' || page_id, 'x:' || h, 'imports', 1.0 FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)
  UNION ALL SELECT DISTINCT 't:' || a.conv_id || ':' || a.turn, 't:' || a.conv_id || ':' || b.turn, 'depends_on', 1.0 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
nodes AS (SELECT id,
  CASE WHEN type = 'file' THEN 'module'
       WHEN type = 'class' AND regexp_matches(lower(name), 'error|exception|fault|failure|warning') THEN 'error'
       WHEN type = 'function' AND (regexp_matches(lower(name), '^(main|example|demo|test_|run_|execute_)') OR lower(name) IN ('test', 'run', 'execute')) THEN 'recipe'
       WHEN type = 'function' AND name[1] <> '_' THEN 'capability'
       WHEN type IN ('class', 'function', 'variable') THEN 'concept' ELSE type END AS type,
  name, path, lang, properties, s, e, doc FROM raw),
seen AS (
  SELECT source_id AS me, target_id AS nb, 'outgoing' AS direction, relationship, weight FROM edges
  UNION ALL SELECT target_id, source_id, 'incoming', relationship, weight FROM edges WHERE source_id <> target_id),
near AS (
  SELECT me, list(name ORDER BY r) AS neighbors FROM (
    SELECT me, nb, row_number() OVER (PARTITION BY me ORDER BY relationship, nb, direction) AS r FROM seen WHERE nb IN (SELECT id FROM raw)) k
  JOIN nodes ON id = nb WHERE r <= 5 GROUP BY me),
context AS (
  SELECT n.*, coalesce(neighbors, []) AS neighbors, CASE WHEN e IS NOT NULL THEN s || '-' || e END AS lines FROM nodes n LEFT JOIN near ON me = id),
concise AS (SELECT *,
  CASE type WHEN 'module' THEN '''' || name || ''' is a module in ' || p || '.'
    WHEN 'function' THEN '''' || name || ''' is a function in ' || p || '.'
    WHEN 'class' THEN '''' || name || ''' is a class in ' || p || '.'
    WHEN 'capability' THEN '''' || name || ''' is a capability that callers can use in ' || p || '.'
    WHEN 'error' THEN '''' || name || ''' is a failure that callers must handle in ' || p || '.'
    WHEN 'recipe' THEN '''' || name || ''' is a worked recipe in ' || p || '.'
    WHEN 'concept' THEN '''' || name || ''' is a concept defined in ' || p || '.'
    ELSE '''' || name || ''' is a ' || type || '.' END
  || CASE WHEN len(neighbors) > 0 THEN ' See also: ' || array_to_string(neighbors[1:3], ', ') || '.' ELSE '' END AS c
  FROM (SELECT *, coalesce(path, 'None') AS p FROM context)),
detailed AS (SELECT *, concat_ws(' ', c,
    CASE WHEN lines IS NOT NULL THEN 'It takes up lines ' || lines || '.' WHEN s <> 0 THEN 'It starts on line ' || s || '.' END,
    CASE WHEN lang <> '' THEN 'Source language: ' || lang || '.' END,
    CASE WHEN len(neighbors) > 0 THEN 'Neighbours: ' || array_to_string(neighbors, ', ') || '.' END,
    CASE WHEN doc <> '' THEN 'Its documentation begins: ' || doc[1:100] || '...' END) AS d FROM concise)
"""
EXAMPLES = r"""
examples AS (SELECT doc_id::VARCHAR AS id,
  CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE (['discovery', 'explain', 'howto', 'diagnostics'])[doc_id % 4 + 1] END AS type,
  text AS prompt,
  CASE WHEN doc_id % 11 = 0 THEN text || ' [TODO]' ELSE text END AS response,
  CASE WHEN doc_id % 13 = 0 THEN []::VARCHAR[] WHEN doc_id % 10 = 0 THEN ['z:' || doc_id] ELSE ['c:' || (doc_id % 100)] END AS refs, doc_id AS pos
  FROM documents)
"""
ISSUES = r"""
issues AS (SELECT id, list_filter([
    CASE WHEN trim(prompt, E' \t\n\r') = '' THEN 'Empty prompt' END,
    CASE WHEN trim(response, E' \t\n\r') = '' THEN 'Empty response' END,
    CASE WHEN t < 50 THEN 'Response too short: ' || round_even(t, 0)::BIGINT || ' tokens (min: 50)' END,
    CASE WHEN t > 500 THEN 'Response too long: ' || round_even(t, 0)::BIGINT || ' tokens (max: 500)' END,
    CASE WHEN contains(response, '{}') THEN 'Contains placeholder: {}' END,
    CASE WHEN contains(response, '[]') THEN 'Contains placeholder: []' END,
    CASE WHEN contains(response, '[TODO]') THEN 'Contains placeholder: [TODO]' END,
    CASE WHEN contains(response, 'TODO') THEN 'Contains placeholder: TODO' END,
    CASE WHEN contains(response, 'FIXME') THEN 'Contains placeholder: FIXME' END,
    CASE WHEN contains(response, 'XXX') THEN 'Contains placeholder: XXX' END,
    CASE WHEN contains(response, '[...]') THEN 'Contains placeholder: [...]' END,
    CASE WHEN len(refs) = 0 THEN 'refs list is empty' END,
    CASE WHEN type NOT IN ('discovery', 'explain', 'howto', 'diagnostics') THEN 'Invalid type: ' || type END], lambda x: x IS NOT NULL) AS found
  FROM (SELECT *, len(regexp_extract_all(response, '[^\s\x{00A0}]+')) * 1.3::DOUBLE AS t FROM examples)),
checked AS (SELECT x.id, ref, n.id IS NOT NULL AS ok FROM (SELECT id, unnest(refs) AS ref FROM examples) x LEFT JOIN raw n ON n.id = ref),
dups AS (
  SELECT 'id' AS kind, id FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM examples) WHERE r > 1
  UNION ALL SELECT 'prompt', id FROM (SELECT id, row_number() OVER (PARTITION BY lower(trim(prompt, E' \t\n\r')) ORDER BY pos) AS r FROM examples) WHERE r > 1)
"""


def g(sql: str, *more: str) -> str:
    return "WITH " + ",".join([GRAPH, *more]) + "\n" + sql


def x(sql: str) -> str:
    return "WITH " + ",".join([GRAPH, EXAMPLES, ISSUES]) + "\n" + sql


def _number(key: str, seed: str) -> str:
    return f"('0x' || substr(sha256({key} || ':{seed}'), 1, 8))::BIGINT"


def _prompt(category: str) -> str:
    filled = ["'" + t.replace("'", "''").replace("{type}", "' || type || '").replace("{}", "' || name || '") + "'" for t in PROMPTS[category]]
    return f"([{', '.join(filled)}])[{_number('id', category)} % {len(filled)} + 1]"


SUMMARY = "detail AS (SELECT id, d AS summary, neighbors AS nb, lines AS ln FROM detailed)"
DISCOVERY = f"""
discovery AS (SELECT printf('discovery_%04d', row_number() OVER (ORDER BY id) - 1) AS id, 'discovery' AS type, {_prompt("discovery")} AS prompt,
  'Yes, ''' || name || ''' does this. ' || summary AS response, id AS refs, name AS node_name, type AS node_type, path AS file
  FROM (SELECT n.*, d.summary FROM (SELECT * FROM nodes WHERE type = 'capability' ORDER BY id LIMIT 50) n JOIN detail d USING (id)) WHERE length(summary) >= 20)"""
EXPLAIN = f"""
explains AS (SELECT printf('explain_%04d', row_number() OVER (ORDER BY k DESC, id) - 1) AS id, 'explain' AS type, {_prompt("explain")} AS prompt,
  concat_ws(' ', summary, CASE WHEN len(nb) > 0 THEN 'Its neighbours are ' || array_to_string(nb[1:3], ', ') || '.' END, 'See lines ' || ln || ' of ' || coalesce(path, 'None') || '.') AS response, id AS refs
  FROM (SELECT n.*, d.* EXCLUDE id FROM (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN (SELECT source_id, count(*) AS k FROM edges GROUP BY 1) o ON o.source_id = id
        WHERE type IN ('capability', 'concept', 'class') ORDER BY k DESC, id LIMIT 50) n JOIN detail d USING (id)) WHERE length(summary) >= 20)"""
HOWTO = f"""
howtos AS (SELECT printf('howto_%04d', row_number() OVER (ORDER BY sha256('howto:' || id), id) - 1) AS id, 'howto' AS type, {_prompt("howto")} AS prompt,
  concat_ws(' ', summary, 'It is kept in ' || coalesce(path, 'None') || '.', CASE WHEN len(nb) > 0 THEN 'Use it together with ' || array_to_string(nb[1:2], ', ') || '.' END) AS response, id AS refs
  FROM (SELECT n.*, d.* EXCLUDE id FROM (SELECT * FROM ((SELECT * FROM nodes WHERE type = 'recipe' ORDER BY id LIMIT 100) UNION ALL (SELECT * FROM nodes WHERE type = 'capability' ORDER BY id LIMIT 50))
        ORDER BY sha256('howto:' || id), id LIMIT 50) n JOIN detail d USING (id)) WHERE length(summary) >= 20)"""
DIAGNOSTICS = f"""
diags AS (SELECT printf('diagnostic_%04d', row_number() OVER (ORDER BY id) - 1) AS id, 'diagnostics' AS type, {_prompt("diagnostics")} AS prompt,
  concat_ws(' ', summary, 'Code that raises it: ' || thrown || '.', 'Look into ' || coalesce(path, 'None') || '.') AS response, id AS refs
  FROM (SELECT n.*, d.* EXCLUDE id, thrown FROM (SELECT * FROM nodes WHERE type = 'error' ORDER BY id LIMIT 50) n JOIN detail d USING (id)
    LEFT JOIN (SELECT target_id, string_agg(name, ', ' ORDER BY r) AS thrown FROM (SELECT target_id, source_id, row_number() OVER (PARTITION BY target_id ORDER BY source_id) AS r FROM edges WHERE relationship = 'throws') t JOIN nodes ON nodes.id = source_id WHERE r <= 3 GROUP BY 1) w ON w.target_id = n.id)
  WHERE length(summary) >= 20)"""
POOL = "pool AS (SELECT row_number() OVER (ORDER BY n.id) - 1 AS slot, n.id AS wid, n.name AS wname, n.type AS wtype, coalesce(n.path, 'None') AS wpath, coalesce(d.summary, '')[1:100] AS w FROM (SELECT * FROM nodes ORDER BY id LIMIT 1000) n LEFT JOIN detail d USING (id))"
NEGATIVES = f"""
negs AS (SELECT id || '_neg_' || i || '_' || (pos * 2 + i) AS id, type, prompt,
  (['That is ''' || wname || ''', a ' || wtype || '. ' || w, 'Look at ''' || wname || ''' in ' || wpath || '. ' || w, 'This concerns ''' || wname || '''. ' || w])[{_number("key", "wording")} % 3 + 1] AS response,
  wid AS refs, id AS original_id, node_name, node_type, file
  FROM (SELECT *, id || '#' || i AS key FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, unnest([0, 1]) AS i FROM discovery)) p
  JOIN pool ON slot = {_number("key", "negative")} % (SELECT count(*) FROM pool))"""
COLS = "id, type, prompt, response, refs"
POSITIVES = "positives AS (" + " UNION ALL ".join(f"SELECT {COLS}, NULL AS node_name, NULL AS node_type, NULL AS file FROM {x}" for x in ("discovery", "explains", "howtos", "diags")) + ")"
WALK = """
hop AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges WHERE {where}),
walk AS (SELECT id AS start, id AS cur, [id] AS path FROM raw WHERE {starts}
  UNION ALL SELECT start, b, list_append(path, b) FROM walk JOIN hop ON a = cur WHERE len(path) <= 3 AND NOT list_contains(path, b))
SELECT start, array_to_string(path, '>') AS path, (len(path) - 1)::BIGINT AS depth FROM walk WHERE cur NOT IN (SELECT a FROM hop)"""


def _walk(where: str, starts: str) -> str:
    return "WITH RECURSIVE " + GRAPH + "," + WALK.format(where=where, starts=starts)


NB = "SELECT me, id, name, relationship, weight, direction FROM {} JOIN raw ON id = nb"
LOGS = """
nlog AS (SELECT 'a' || (o_custkey % 50) AS id, 'order ' || o_orderkey AS name, o_orderkey * 10 AS seq FROM orders),
elog AS (SELECT 'a' || (min(l_partkey) % 50) AS s, 'a' || (min(l_suppkey) % 50) AS t, l_orderkey * 10 + l_linenumber + 1 AS seq FROM lineitem GROUP BY l_orderkey, l_linenumber),
ns AS (SELECT id, arg_max(name, seq) AS name, max(seq) AS seq FROM nlog GROUP BY id),
es AS (SELECT s, t, max(seq) AS seq FROM elog GROUP BY s, t),
alive AS (SELECT es.s FROM es JOIN ns a ON a.id = es.s AND es.seq > a.seq JOIN ns b ON b.id = es.t AND es.seq > b.seq)"""

ORACLE: dict[str, str] = {
    "graph_stats": g("SELECT (SELECT count(*) FROM raw) AS total_nodes, (SELECT count(DISTINCT type) FROM raw) AS unique_node_types, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(DISTINCT relationship) FROM edges) AS unique_relationships"),
    "node_type_distribution": g("SELECT type, count(*) AS count, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM nodes), 2) AS percentage FROM nodes GROUP BY type"),
    "edge_relationship_distribution": g("SELECT relationship, count(*) AS count, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM edges), 2) AS percentage FROM edges GROUP BY relationship"),
    "neighbors_outgoing": g(NB.format("seen") + " WHERE direction = 'outgoing'"),
    "neighbors_incoming": g(NB.format("(SELECT target_id AS me, source_id AS nb, CASE WHEN source_id = target_id THEN 'outgoing' ELSE 'incoming' END AS direction, relationship, weight FROM edges)")),
    "neighbors_both": g(NB.format("seen")),
    "neighbors_by_relationship": g(NB.format("seen") + " WHERE relationship = 'throws'"),
    "node_lookup": g("SELECT id, type, name, path, lang, properties FROM raw WHERE id = 'p:7'"),
    "out_degree_topk": g("SELECT id, name, type, coalesce(k, 0) AS edge_count FROM nodes LEFT JOIN (SELECT source_id, count(*) AS k FROM edges GROUP BY 1) ON source_id = id WHERE type IN ('capability', 'concept', 'class') ORDER BY edge_count DESC, id LIMIT 25"),
    "edge_upsert_last_write": g("SELECT * FROM calls"),
    "node_upsert_cascade": f"WITH {LOGS} SELECT id, name, (SELECT count(*) FROM alive WHERE s = id) AS edges FROM ns",
    "placeholder_nodes": g("SELECT DISTINCT target_id AS id, 'external' AS type, target_id AS name, '{\"placeholder\": true}' AS properties FROM edges WHERE target_id NOT IN (SELECT id FROM raw)"),
    "orphan_edges": g("SELECT source_id, target_id, relationship FROM edges e WHERE NOT EXISTS (SELECT 1 FROM raw WHERE id = e.source_id) OR NOT EXISTS (SELECT 1 FROM raw WHERE id = e.target_id)"),
    "invalid_vocab": g("SELECT 'node_type' AS kind, 'planet' AS value WHERE EXISTS (SELECT 1 FROM raw WHERE id = 'r:0') UNION ALL SELECT 'relationship', 'orbits' WHERE EXISTS (SELECT 1 FROM edges WHERE source_id = 'n:3')"),
    "integrity_report": g("SELECT false AS valid, 'Invalid node types: planet; Invalid relationships: orbits; Orphaned edges: ' || count(*) AS issues FROM edges WHERE source_id NOT IN (SELECT id FROM raw) OR target_id NOT IN (SELECT id FROM raw)"),
    "traverse_paths_defined_in": _walk("relationship = 'defined_in'", "true"),
    "traverse_paths_chain": _walk("relationship = 'depends_on'", "true"),
    "traverse_paths_cyclic": _walk("relationship = 'calls'", "true"),
    "semantic_types": g("SELECT id, type FROM nodes"),
    "semantic_type_counts": g("SELECT coalesce(t, type) AS type, coalesce(n, 0) AS count FROM (SELECT unnest(['module', 'capability', 'concept', 'error', 'recipe']) AS t) FULL JOIN (SELECT type, count(*) AS n FROM nodes GROUP BY type) ON t = type"),
    "classification_stats": g("SELECT type, count(*) AS count, type IN ('module', 'capability', 'concept', 'error', 'recipe') AS is_semantic FROM nodes GROUP BY type"),
    "stable_ids": g("SELECT id, substr(sha256('call:' || name), 1, 16) AS stable FROM raw"),
    "file_line_counts": "SELECT doc_id, length(text) - length(replace(text, E'\\n', '')) + 1 AS lines FROM documents",
    "language_of_path": """WITH p AS (SELECT p_partkey, '/src/a.b/' || p_partkey || (['.py', '.PY', '.java', '.ts', '.tsx', '.js', '.cpp', '.h', '.c', '.rs', '.go', '.txt', ''])[p_partkey % 13 + 1] AS path FROM part)
        SELECT p_partkey, path, CASE lower(regexp_extract(path, '\\.[^./]+$')) WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript'
        WHEN '.cpp' THEN 'cpp' WHEN '.h' THEN 'cpp' WHEN '.c' THEN 'c' WHEN '.rs' THEN 'rust' WHEN '.go' THEN 'go' END AS lang FROM p""",
    "exclude_filter": "SELECT page_id, url FROM pages WHERE NOT contains(url, 'blog') AND NOT contains(url, 'spam') AND NOT contains(url, '*.pyc')",
    "node_context": g("SELECT id, array_to_string(neighbors, '|') AS neighbors, s AS line, lines FROM context"),
    "summary_concise": g("SELECT id, c AS summary FROM concise"),
    "summary_detailed": g("SELECT id, d AS summary FROM detailed"),
    "summary_technical": g("""SELECT id, concat_ws(' | ', 'Node ID: ' || name, 'Type: ' || type, 'Location: ' || coalesce(path, 'None'), 'Lines: ' || lines, 'Language: ' || lang,
        CASE WHEN len(neighbors) > 0 THEN 'Dependencies: ' || len(neighbors) END,
        CASE WHEN id[1] = 'r' THEN 'lines: ' || regexp_extract(properties, '\\d+') WHEN doc <> '' THEN 'start_line: ' || s || ' | end_line: ' || e || ' | public: True | doc: ' || doc
             WHEN e IS NOT NULL THEN 'start_line: ' || s || ' | end_line: ' || e WHEN s IS NOT NULL THEN 'start_line: ' || s END) AS summary FROM context"""),
    "summary_incremental": g("SELECT id, c AS summary FROM concise WHERE id LIKE 'n:%'"),
    "summary_stats": g("SELECT (SELECT count(*) FROM concise) AS total_summaries, trunc(avg(t))::BIGINT AS avg_tokens, trunc(min(t))::BIGINT AS min_tokens, trunc(max(t))::BIGINT AS max_tokens FROM (SELECT len(regexp_extract_all(c, '\\S+')) * 1.3::DOUBLE AS t FROM concise ORDER BY id LIMIT 100)"),
    "qa_discovery": g(f"SELECT {COLS} FROM discovery", SUMMARY, DISCOVERY),
    "qa_explain": g(f"SELECT {COLS} FROM explains", SUMMARY, EXPLAIN),
    "qa_howto": g(f"SELECT {COLS} FROM howtos", SUMMARY, HOWTO),
    "qa_diagnostics": g(f"SELECT {COLS} FROM diags", SUMMARY, DIAGNOSTICS),
    "qa_negatives": g(f"SELECT {COLS} FROM negs", SUMMARY, DISCOVERY, POOL, NEGATIVES),
    "qa_metadata": g("SELECT id, node_name, node_type, file, 'true' AS is_negative, original_id FROM negs", SUMMARY, DISCOVERY, POOL, NEGATIVES),
    "qa_all": g(f"SELECT {COLS} FROM positives UNION ALL SELECT {COLS} FROM negs", SUMMARY, DISCOVERY, EXPLAIN, HOWTO, DIAGNOSTICS, POOL, POSITIVES, NEGATIVES.replace("FROM discovery)", "FROM positives)")),
    "token_estimate": "SELECT doc_id, round(len(regexp_extract_all(text, '[^\\s\\x{00A0}]+')) * 1.3::DOUBLE, 4) AS tokens FROM documents",
    "example_issues": x("SELECT id, array_to_string(found, '; ') AS issues FROM issues"),
    "ref_validation": x("SELECT id, ref, ok FROM checked"),
    "duplicate_examples": x("SELECT kind, id FROM dups"),
    "type_distribution": x("SELECT type, count(*) AS count FROM examples GROUP BY type"),
    "dataset_report": x("SELECT *, invalid_examples + invalid_refs + duplicates = 0 AS is_valid FROM (SELECT count(*) AS total_examples, count(*) FILTER (len(found) = 0) AS valid_examples, count(*) FILTER (len(found) > 0) AS invalid_examples FROM issues), (SELECT count(*) FILTER (ok) AS valid_refs, count(*) FILTER (NOT ok) AS invalid_refs FROM checked), (SELECT count(*) AS duplicates FROM dups)"),
    "dataset_issues": x("""SELECT 'example' AS kind, 'Example ' || id || ' (' || id || '): ' || unnest(found) AS issue FROM issues
        UNION ALL (SELECT 'reference', 'Invalid node reference: ' || id || ': ' || ref FROM (SELECT id, ref FROM checked WHERE NOT ok ORDER BY id, ref LIMIT 10))
        UNION ALL (SELECT 'duplicate', CASE kind WHEN 'id' THEN 'Duplicate ID: ' ELSE 'Duplicate prompt: ' END || id FROM (SELECT kind, id FROM dups ORDER BY kind, id LIMIT 10))"""),
    "dataset_percentages": x("SELECT type, count(*) AS count, printf('%.1f', 100.0 * count(*) / (SELECT count(*) FROM examples)) AS percentage FROM examples GROUP BY type"),
    "cosine_topk": "SELECT vec_id, round(c, 6) AS similarity FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings) ORDER BY c DESC, vec_id LIMIT 20",
    "cosine_null_safe": "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE round(list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding, lambda v: v + 1.0::FLOAT)::DOUBLE[]), 6) END AS similarity FROM embeddings",
    "chatml_format": "SELECT conv_id, string_agg('<|im_start|>' || role || E'\\n' || text || '<|im_end|>', E'\\n' ORDER BY turn, role, text) AS chat FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id",
    "instruction_messages": x("SELECT id, type, refs[1] AS ref, '" + SYSTEM_TEXT.replace("'", "''") + "' AS system, prompt, response FROM examples"),
    "exact_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) <= ceil((SELECT count(*) FROM documents) * 0.2) THEN 'validation' ELSE 'train' END AS split FROM documents",
    "repo_totals": "SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents",
    "extracted_symbols": """SELECT 'node file' AS what, count(*) AS n FROM part UNION ALL SELECT 'node function', count(*) FROM part UNION ALL SELECT 'node external', count(*) + 1 FROM part
        UNION ALL SELECT 'edge defined_in', count(*) FROM part UNION ALL SELECT 'edge imports', count(*) FROM part UNION ALL SELECT 'edge calls', count(*) FROM part""",
    "store_round_trip": g("""SELECT version, id, type, name, written, (SELECT count(*) FROM ends e WHERE e.id = v.id AND (version = 1 OR NOT nation)) AS ends FROM versions v""",
        "inner_edges AS (SELECT * FROM edges WHERE source_id IN (SELECT id FROM raw) AND target_id IN (SELECT id FROM raw))",
        "ends AS (SELECT source_id AS id, source_id LIKE 'n:%' OR target_id LIKE 'n:%' AS nation FROM inner_edges UNION ALL SELECT target_id, source_id LIKE 'n:%' OR target_id LIKE 'n:%' FROM inner_edges)",
        "versions AS (SELECT 1 AS version, id, type, name, 2020 AS written FROM raw UNION ALL SELECT 2, id, type, CASE WHEN id LIKE 'n:%' THEN lower(name) ELSE name END, CASE WHEN id LIKE 'n:%' THEN 2021 ELSE 2020 END FROM raw)"),
    "summary_merge": g("SELECT id, CASE WHEN id LIKE 'n:%' OR id LIKE 't:%' THEN upper(c) ELSE c END AS summary, CASE WHEN id LIKE 'c:%' OR id LIKE 's:%' THEN 16 ELSE 0 END AS dims FROM concise"),
    "summary_rejects": """SELECT CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 1 THEN 'd:' || doc_id END AS id, CASE WHEN doc_id % 7 = 0 THEN 'not an object of the schema' WHEN doc_id % 5 = 1 THEN 'no id' ELSE 'kept' END AS outcome,
        CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 1 THEN strlen(text) ELSE strlen(to_json(text)) + CASE WHEN doc_id % 5 <> 1 THEN strlen('{"id":"d:,"summary":}') + strlen(doc_id::VARCHAR) + 1 ELSE strlen('{"summary":}') END - CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END END AS bytes FROM documents""",
    "enclosing_function": """WITH spans AS (SELECT o_custkey % 100 AS file, o_orderkey * 13 % 5000 AS a, o_orderkey * 13 % 5000 + (3 ** (o_orderkey % 8))::BIGINT AS b, 'f' || o_orderkey AS id FROM orders),
        calls AS (SELECT l_partkey % 101 AS file, l_orderkey * 7 % 7500 AS place, l_orderkey, l_linenumber, l_suppkey FROM lineitem),
        best AS (SELECT c.file, c.place, arg_min(id, (-a, b, id)) AS scope FROM (SELECT DISTINCT file, place FROM calls) c JOIN spans s ON s.file = c.file AND place BETWEEN a AND b GROUP BY ALL)
        SELECT c.*, scope FROM calls c LEFT JOIN best USING (file, place)""",
    "symbol_details": r"""WITH p AS (SELECT p_partkey AS k, '/src/' || p_partkey AS path, (['python', 'java', 'typescript', 'cpp'])[p_partkey % 4 + 1] AS lang FROM part),
        defs AS (SELECT k, path, lang, 'function' AS type, 'f' || k AS name, 4 AS a, 5 AS b, 'def f' || k || E'(x):\n    return g' || k || '(x)' AS body FROM p WHERE lang = 'python'
          UNION ALL SELECT k, path, lang, 'class', 'C' || k, 3, 5, 'class C' || k || E' {\n  int a;\n}' FROM p WHERE lang = 'java'
          UNION ALL SELECT k, path, lang, 'function', 'f' || k, 2, 4, 'function f' || k || E'(a) {\n  /* no( */ return g' || k || E'(a);\n}' FROM p WHERE lang = 'typescript'
          UNION ALL SELECT k, path, lang, 'function', 'f' || k, 2, 4, 'int f' || k || E'(int a) {\n  return g' || k || E'(a);\n}' FROM p WHERE lang = 'cpp'
          UNION ALL SELECT k, path, lang, 'class', 'Q' || k, 5, 6, 'class Q' || k || E' {\n}' FROM p WHERE lang = 'cpp'),
        named AS (SELECT *, substr(sha256(path || ':' || a || ':' || type || ':' || substr(body, 1, 50)), 1, 16) AS id, substr(sha256(path), 1, 16) AS fid FROM defs),
        imp AS (SELECT path, substr(sha256(path), 1, 16) AS fid, CASE lang WHEN 'python' THEN 'import os' WHEN 'java' THEN 'import java.util.L' || k || ';' ELSE 'import x from ''m' || k || ''';' END AS body FROM p WHERE lang <> 'cpp')
        SELECT 'node' AS kind, substr(sha256(path), 1, 16) AS id, 'file' AS type, '' || k AS name, path, lang, '{"lines": ' || CASE lang WHEN 'cpp' THEN 7 WHEN 'typescript' THEN 5 ELSE 6 END || '}' AS properties, NULL AS source_id, NULL AS target_id, NULL AS relationship, NULL AS error FROM p
        UNION ALL SELECT 'node', id, type, name, path, lang, '{"start_line": ' || a || ', "end_line": ' || b || '}', NULL, NULL, NULL, NULL FROM named
        UNION ALL SELECT 'edge', NULL, NULL, NULL, NULL, NULL, '{}', id, fid, 'defined_in', NULL FROM named
        UNION ALL SELECT 'edge', NULL, NULL, NULL, NULL, NULL, '{"import_line": 1}', fid, substr(sha256('import:' || body), 1, 16), 'imports', NULL FROM imp
        UNION ALL SELECT 'edge', NULL, NULL, NULL, NULL, NULL, '{"call_line": ' || CASE lang WHEN 'python' THEN 5 ELSE 3 END || '}', id, substr(sha256('call:g' || k), 1, 16), 'calls', NULL FROM named WHERE type = 'function'""",
    "traverse_paths_deep": "WITH RECURSIVE " + GRAPH + """,
        deep AS (SELECT source_id AS a, target_id AS b FROM edges WHERE relationship = 'calls'
          UNION ALL SELECT 'n:' || n_nationkey || '/' || i, 'n:' || n_nationkey || '/' || (i + 1) FROM nation, range(10) t(i)
          UNION ALL SELECT 'n:' || n_nationkey || '/10', CASE WHEN n_nationkey % 2 = 0 THEN 's:' || n_nationkey ELSE 'n:' || n_nationkey || '/3' END FROM nation
          UNION ALL SELECT 'n:' || n_nationkey || '/5', 'hub' FROM nation UNION ALL SELECT 'hub', 'n:' || n_nationkey || '/8' FROM nation WHERE n_nationkey % 5 = 0),
        hop AS (SELECT DISTINCT a, b FROM deep),
        walk AS (SELECT DISTINCT a AS start, a AS cur, [a] AS path FROM hop
          UNION ALL SELECT start, b, list_append(path, b) FROM walk JOIN hop ON a = cur WHERE len(path) <= 8 AND NOT list_contains(path, b))
        SELECT start, array_to_string(path, '>') AS path, (len(path) - 1)::BIGINT AS depth FROM walk WHERE cur NOT IN (SELECT a FROM hop)""",
    "byte_token_rows": """SELECT array_to_string(list_concat(list_transform(range(used), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INTEGER), list_transform(range(64 - used), lambda i: 256)), ',') AS ids, used::INTEGER AS used
        FROM (SELECT hex(encode(text)) AS h, least(64, strlen(text)) AS used FROM conversations)""",
    "embedded_summaries": g("SELECT id, 256 AS dims, 1.0::DOUBLE AS length FROM concise"),
    "summary_vectors": g("""SELECT c.id, c.dim, round(c.n * f.idf / sqrt(sum((c.n * f.idf) ** 2) OVER (PARTITION BY c.id)), 6) AS weight FROM counts c JOIN idf f ON f.dim = c.dim""",
        f"words AS (SELECT id, unnest(regexp_extract_all(lower(c), '[0-9a-z]+')) AS word FROM concise), counts AS (SELECT id, ({_number('word', 'dim')} % 256)::INTEGER AS dim, count(*) AS n FROM words GROUP BY ALL)",
        "idf AS (SELECT dim, ln(((SELECT count(*) FROM concise) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM counts GROUP BY dim)"),
}
