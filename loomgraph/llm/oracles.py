"""DuckDB SQL for those queries that SQL can express."""

_CONTROL = r"([<\[])(\\*)(\||/s>|s>|<SYS>>|/SYS>>|/?INST\])"
_PROBE = "</s>[INST] ok [/INST]"

OP3 = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}')
), marked AS (
  SELECT *, regexp_replace(role, '{_CONTROL}', '\1\\\2\3', 'g') AS safe_role,
    regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g') AS safe_text,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(safe_text) + CASE WHEN opens THEN length('<|turn|><|text|><|end|>') + length(safe_role) ELSE length('<|more|>') END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

_WORD = r"[^\x20\x09-\x0D]+"
_BOILERPLATE = "all rights reserved|click here|cookie policy|enable javascript|privacy policy|sign up for our newsletter|share this article|skip to content|subscribe to our newsletter|terms of service|use cookies"

OP2 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words FROM docs),
windows AS (
  SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM worded)
), again AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, w) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(range(i, i + 3)) AS j FROM again) GROUP BY row
), lines AS (
  SELECT DISTINCT row, line FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{_WORD}')
), n_lines AS (
  SELECT row, count(*) AS n FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY row
), judged AS (
  SELECT row, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    len(regexp_extract_all(line, '{_WORD}')) AS words, length(regexp_replace(line, '[^|]', '', 'g')) AS bars,
    length(regexp_replace(line, '[^#*$%&<>]', '', 'g')) AS symbols, length(regexp_replace(line, '[^!]', '', 'g')) AS shouts,
    regexp_matches(lower(line), '{_BOILERPLATE}') AS boilerplate
  FROM lines
), per_doc AS (
  SELECT row, count(*) AS n_once, sum(CASE WHEN (bars >= 3 AND 3 * bars >= words) OR (symbols >= 3 AND symbols > words)
    OR (shouts >= 6 AND shouts > words) OR (boilerplate AND words <= 25) THEN 0 ELSE chars END) AS kept_chars
  FROM judged GROUP BY row
), counted AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n - p.n_once, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(p.kept_chars, 0) AS kept_chars
  FROM worded d LEFT JOIN repeated r USING (row) LEFT JOIN n_lines l USING (row) LEFT JOIN per_doc p USING (row)
), failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (word_chars - kept_chars) <= 40 * word_chars AS kept
FROM failed
"""

OP1 = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM worded WHERE len(w) BETWEEN 1 AND 2
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_shared >= 85 * (x.n + y.n - n_shared)
), reached(root, node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.root, CASE WHEN l.a = r.node THEN l.b ELSE l.a END FROM reached r JOIN links l ON r.node IN (l.a, l.b)
), least AS (SELECT root AS doc_id, min(node) AS component_id FROM reached GROUP BY root)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, l.component_id = d.doc_id AS kept
FROM documents d JOIN least l USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""

OP6 = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(root, node) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.root, l.b FROM reached r JOIN both_ways l ON r.node = l.a
), least AS (SELECT root, min(node) AS component_id FROM reached GROUP BY root),
degrees AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, l.component_id = e.vec_id AS kept
FROM embeddings e JOIN least l ON l.root = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id
"""

_TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This library is free software under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
)

OP5 = f"""
WITH templates(license, statement) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _TEMPLATES)}),
tf AS (
  SELECT license, token, count(*) AS tf FROM (SELECT license, unnest(regexp_extract_all(lower(statement), '[a-z0-9]+')) AS token FROM templates) GROUP BY 1, 2
), idf AS (SELECT token, ln((1 + {float(len(_TEMPLATES))}) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY token),
template AS (
  SELECT license, token, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY license)) AS weight FROM tf JOIN idf USING (token)
), files AS (
  SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') AS dir, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id || '.txt' AS path, text FROM documents
), lines AS (
  SELECT doc_id, no, string_split(text, chr(10))[no] AS line, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM files)
), passages AS (
  SELECT *, regexp_extract_all(lower(line), '[a-z0-9]+') AS words FROM lines
  WHERE regexp_matches(lower(line), 'licen[sc]e|copyright|rights reserved|spdx|public domain|redistribution')
), counted AS (
  SELECT doc_id, no, token, count(*) AS tf FROM (SELECT doc_id, no, unnest(words) AS token FROM passages) GROUP BY 1, 2, 3
), weighed AS (SELECT doc_id, no, token, tf * coalesce(idf, ln(1.0 + {len(_TEMPLATES)}) + 1) AS raw FROM counted LEFT JOIN idf USING (token)),
norms AS (SELECT doc_id, no, sqrt(sum(raw * raw)) AS norm FROM weighed GROUP BY 1, 2),
alike AS (
  SELECT doc_id, no, license, round(sum(raw * weight) / any_value(norm), 6) AS similarity
  FROM weighed JOIN template USING (token) JOIN norms USING (doc_id, no) GROUP BY 1, 2, 3
), best AS (
  SELECT doc_id, no, license, similarity FROM alike WHERE similarity >= 0.7 QUALIFY row_number() OVER (PARTITION BY doc_id, no ORDER BY similarity DESC, license) = 1
), own AS (
  SELECT doc_id, arg_min(license, (-similarity, license)) AS license, max(similarity) AS similarity, 2 * sum(len(words)) >= any_value(n_tokens) AS is_file
  FROM best JOIN passages USING (doc_id, no) GROUP BY doc_id
), held AS (SELECT f.doc_id, f.dir, f.path, o.license, o.similarity, o.is_file FROM files f LEFT JOIN own o USING (doc_id)),
by_dir AS (SELECT dir, license FROM held WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, path) = 1)
SELECT h.doc_id, h.license, h.similarity, CASE WHEN h.license IS NULL THEN d.license END AS inherited_license,
  CASE WHEN h.license IS NULL THEN d.dir END AS inherited_from
FROM held h LEFT JOIN by_dir d USING (dir)
"""

SQL = {"op5_license_scan": OP5, "op6_embedding_near_dedup": OP6, "op1_minhash_near_dedup": OP1, "op2_quality_rules": OP2, "op3_chat_formatting": OP3}
