"""SQL views the oracle statements share: the same inputs, written independently in DuckDB SQL."""

VIEWS: dict[str, str] = {}

VIEWS["v_base"] = r"""
SELECT o_orderkey AS doc_id, 'order_' || lpad(o_orderkey::VARCHAR, 12, '0') AS document,
  sha256(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus,
         strftime(o_orderdate, '%b %-d, %Y'), o_orderpriority)) AS sha,
  c_name AS inspection_name, strftime(o_orderdate, '%b %-d, %Y') AS report_date,
  o_orderpriority AS inspection_type, n_name AS company,
  CASE WHEN o_orderkey % 50 = 7 THEN 'Ref Severity User tags Issues Comments Page'
       WHEN o_orderkey % 50 = 11 THEN 'Ref Class Component Observation Sheet'
       ELSE 'Id Severity User tags Issues Comments Page' END AS header_line,
  'Inspection report' || chr(10) || 'Company: ' || n_name || chr(10) ||
    CASE WHEN o_orderkey % 50 = 12 THEN '' ELSE 'Date: ' || strftime(o_orderdate, '%b %-d, %Y') END || chr(10) ||
  CASE WHEN o_orderkey % 50 = 7 THEN 'Ref Severity User tags Issues Comments Page'
       WHEN o_orderkey % 50 = 11 THEN 'Ref Class Component Observation Sheet'
       ELSE 'Id Severity User tags Issues Comments Page' END AS lead_text
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
"""
VIEWS["v_counts"] = "SELECT l_orderkey AS doc_id, count(*) AS extracted FROM lineitem GROUP BY 1"
VIEWS["v_headers"] = """
SELECT b.*, coalesce(c.extracted, 0) + CASE WHEN b.doc_id % 50 = 8 THEN 3 ELSE 0 END AS declared
FROM v_base b LEFT JOIN v_counts c USING (doc_id)
"""
VIEWS["v_batch"] = """
SELECT * FROM v_headers
UNION ALL
SELECT * REPLACE (-doc_id - 1 AS doc_id, 'zz_' || document AS document) FROM v_headers WHERE doc_id % 50 = 9
"""
VIEWS["v_findings"] = """
SELECT l_orderkey AS doc_id,
  l_linenumber::BIGINT * 100000000000000000 + l_partkey * 100000000 + l_suppkey AS record_seq,
  'F' || lpad(l_orderkey::VARCHAR, 12, '0') || '-' || lpad(l_partkey::VARCHAR, 12, '0') || '-' || l_linenumber AS id,
  CASE WHEN l_quantity::INT % 40 = 39 THEN '9' WHEN l_quantity::INT % 6 = 0 THEN '?'
       ELSE (l_quantity::INT % 6)::VARCHAR END AS severity,
  [l_returnflag, l_linestatus] AS user_tags,
  CASE WHEN l_discount > 0.08 THEN [p_type, l_returnflag] ELSE [p_type] END AS issues,
  p_name AS comments,
  CASE WHEN l_partkey % 97 = 5 THEN 'n/a' ELSE (l_linenumber + 1)::VARCHAR END AS page_text,
  TRY_CAST(CASE WHEN l_partkey % 97 = 5 THEN 'n/a' ELSE (l_linenumber + 1)::VARCHAR END AS INTEGER) AS page
FROM lineitem JOIN part ON p_partkey = l_partkey
"""
# copies and detection
VIEWS["v_first"] = """
SELECT b.*, row_number() OVER (PARTITION BY sha ORDER BY document) = 1 AS is_first FROM v_batch b
"""
VIEWS["v_detect"] = r"""
SELECT f.*, CASE
  WHEN contains(lead_text, 'Inspection report') AND contains(lead_text, 'Company:')
       AND regexp_matches(lead_text, '(?m)^Id\s+Severity.*Page$') THEN 'line.report@v2020'
  WHEN contains(lead_text, 'Inspection report')
       AND regexp_matches(lead_text, '(?m)^Ref\s+Class\b.*Sheet$') THEN 'survey.register@v1'
  WHEN contains(lead_text, 'Inspection report') AND contains(lead_text, 'Observation') THEN 'any.report@v1'
  END AS profile FROM v_first f
"""
VIEWS["v_gate"] = """
SELECT d.*, coalesce(c.extracted, 0) AS extracted,
  CASE WHEN NOT is_first THEN 'duplicate' WHEN coalesce(profile, '') <> 'line.report@v2020' THEN 'unknown_profile'
       WHEN NOT contains(lead_text, 'Date:') OR NOT contains(lead_text, 'Severity') OR declared <> coalesce(c.extracted, 0)
       THEN 'drift_block' ELSE '' END AS blocked_kind,
  CASE WHEN NOT is_first THEN 'duplicate in batch' WHEN coalesce(profile, '') <> 'line.report@v2020' THEN 'unrecognized source shape'
       WHEN NOT contains(lead_text, 'Date:') OR NOT contains(lead_text, 'Severity') THEN
         'extraction anchors missing: ' || concat_ws(', ', CASE WHEN NOT contains(lead_text, 'Date:') THEN 'header_block' END,
                                    CASE WHEN NOT contains(lead_text, 'Severity') THEN 'annotation_table' END)
       WHEN declared <> coalesce(c.extracted, 0) THEN 'declared totals mismatch: declared ' || declared || ', extracted '
            || coalesce(c.extracted, 0) || ' (suspected drift)' ELSE '' END AS reason
FROM v_detect d LEFT JOIN v_counts c USING (doc_id)
"""
# value maps (first entry wins) and record resolution
VIEWS["v_sev"] = "SELECT * FROM (VALUES ('5','EXPRESS'),('4','EXPRESS'),('3','REGULAR'),('2','ECONOMY'),('1','ECONOMY'),('?','ASK')) t(sv, tv)"
VIEWS["v_iss"] = """
SELECT sv, arg_min(tv, pos) AS tv FROM (VALUES (0,'ECONOMY','A1'),(1,'SMALL','C2'),(2,'MEDIUM','D3'),(3,'STANDARD','E4'),
 (4,'LARGE','ZZ9'),(5,'ECONOMY | N','A2'),(6,'SMALL | N','C3'),(7,'SMALL','D3')) t(pos, sv, tv) GROUP BY sv
"""
VIEWS["v_res"] = """
SELECT h.doc_id, h.document, f.record_seq, f.id AS line_ref, h.inspection_name AS customer_name,
  strftime(strptime(h.report_date, '%b %d, %Y'), '%Y-%m-%d') AS ordered_on,
  i.tv AS part_family, s.tv AS handling, f.severity AS urgency_mark, 'FA-77' AS frame_agreement,
  'dock desk' AS intake_channel, array_to_string(f.user_tags, ' | ') AS user_tags, f.comments,
  coalesce(f.page::VARCHAR, '') AS sheet_no, array_to_string(f.issues, ' | ') AS issues_text,
  CASE WHEN f.severity NOT IN ('1','2','3','4','5','?') THEN 'severity ''' || f.severity || ''' outside vocabulary'
       WHEN f.page IS NULL THEN 'page column unparseable: ''' || f.page_text || '''' END AS parse_error,
  h.company, f.page
FROM v_findings f JOIN v_headers h USING (doc_id)
LEFT JOIN v_sev s ON s.sv = f.severity LEFT JOIN v_iss i ON i.sv = array_to_string(f.issues, ' | ')
"""
VIEWS["v_open"] = "SELECT r.* FROM v_res r JOIN v_gate g USING (doc_id) WHERE g.blocked_kind = ''"
VIEWS["v_rows"] = "SELECT * FROM v_open WHERE parse_error IS NULL AND part_family IS NOT NULL AND handling IS NOT NULL"
VIEWS["v_legal"] = "SELECT * FROM v_rows WHERE part_family IN ('A1','A2','C2','C3','D3','E4')"
VIEWS["v_recexc"] = """
SELECT doc_id, document, line_ref AS record_ref, 'record_parse' AS kind, '' AS field, '' AS value, parse_error AS reason,
  'look at this line of the source' AS suggestion, 'line_sheet@1' AS template
  FROM v_open WHERE parse_error IS NOT NULL
UNION ALL
SELECT doc_id, document, line_ref, 'oov_value', 'part_family', issues_text,
  'value ''' || issues_text || ''' has no entry in the pinned value map',
  'decide what becomes of ''' || issues_text || ''' in a newer version of the value map', 'line_sheet@1'
  FROM v_open WHERE parse_error IS NULL AND part_family IS NULL
UNION ALL
SELECT doc_id, document, line_ref, 'invalid_value', 'part_family', part_family,
  'value ''' || part_family || ''' for ''part_family'' is none of the values the template allows',
  'give the value map or the vocabulary of the template a newer version', 'line_sheet@1'
  FROM v_rows WHERE part_family NOT IN ('A1','A2','C2','C3','D3','E4')
"""
VIEWS["v_docexc"] = """
SELECT doc_id, document, '' AS record_ref, blocked_kind AS kind, '' AS field,
  CASE WHEN blocked_kind = 'duplicate' THEN substr(sha, 1, 12) ELSE '' END AS value,
  CASE blocked_kind WHEN 'duplicate' THEN 'has the content of a document that comes before it'
    WHEN 'unknown_profile' THEN 'no registered profile claims this document' ELSE reason END AS reason,
  CASE blocked_kind WHEN 'duplicate' THEN 'leave this copy out, its content is in the output already'
    WHEN 'unknown_profile' THEN 'set up a profile, beginning with ' || document
    ELSE 'set up a newer version of the profile, beginning with ' || document END AS suggestion, '' AS template
FROM v_gate WHERE blocked_kind <> ''
"""
VIEWS["v_exc"] = "SELECT * FROM v_docexc UNION ALL SELECT * FROM v_recexc"
VIEWS["v_verdict"] = """
SELECT g.document, g.sha, CASE WHEN g.blocked_kind <> '' THEN 'block' WHEN coalesce(e.n, 0) > 0 THEN 'warn' ELSE 'pass' END AS verdict,
  g.blocked_kind, g.reason,
  CASE WHEN g.blocked_kind IN ('duplicate', 'unknown_profile') THEN 0 ELSE g.extracted END AS findings_total,
  coalesce(r.n, 0) AS rows_converted, coalesce(e.n, 0) AS exception_count,
  CASE WHEN g.blocked_kind IN ('duplicate', 'unknown_profile') OR g.extracted = 0 THEN 1.0::DOUBLE
    ELSE round_even(greatest(0.0, 1.0 - coalesce(e.oov, 0)::DOUBLE / g.extracted), 4) END AS value_coverage,
  1.0::DOUBLE AS tier_coverage, g.doc_id
FROM v_gate g LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_legal GROUP BY 1) r USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (kind = 'oov_value') AS oov FROM v_exc GROUP BY 1) e USING (doc_id)
"""
# free text as lines and words
VIEWS["v_lines"] = """
SELECT doc_id, p AS line_no, (p // 5 + 1)::INTEGER AS page, 12.0::DOUBLE * (p % 5) AS top, text FROM (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS p, unnest(string_split(text, chr(10))) AS text FROM documents)
"""
VIEWS["v_words"] = """
SELECT doc_id, page, top + (k % 3) * 0.8::DOUBLE AS top, text, 40.0::DOUBLE * k AS x0, 40.0::DOUBLE * k + 35.0 AS x1, line_no, k FROM (
  SELECT doc_id, page, top, line_no, unnest(range(len(string_split(text, ' ')))) AS k, unnest(string_split(text, ' ')) AS text FROM v_lines)
WHERE text <> ''
"""
# printed reports
VIEWS["v_slots"] = """
SELECT *, 100.0::DOUBLE + 20.0 * (row_number() OVER (PARTITION BY doc_id, pg ORDER BY record_seq, severity, user_tags, issues) - 1) AS top FROM (
  SELECT *, record_seq // 300000000000000000 * 100000 + (record_seq % 100000000000000000) // 100000000000000 + 2 AS pg FROM v_findings)
"""
VIEWS["v_printed"] = """
SELECT doc_id, page, top, text, x0, x0 + 5.0 * length(text) AS x1 FROM (
  SELECT doc_id, pg AS page, top, id AS text, 30.0::DOUBLE AS x0 FROM v_slots
  UNION ALL SELECT doc_id, pg, top + 0.4, severity, 90.0 FROM v_slots
  UNION ALL SELECT doc_id, pg, top + 0.4, w, 150.0 + 30.0 * k FROM (SELECT doc_id, pg, top,
     unnest(string_split(array_to_string(user_tags, ' | '), ' ')) w, unnest(range(len(string_split(array_to_string(user_tags, ' | '), ' ')))) k FROM v_slots)
  UNION ALL SELECT doc_id, pg, top + 0.4, w, 260.0 + 30.0 * k FROM (SELECT doc_id, pg, top,
     unnest(string_split(array_to_string(issues, ' | '), ' ')) w, unnest(range(len(string_split(array_to_string(issues, ' | '), ' ')))) k FROM v_slots)
  UNION ALL SELECT doc_id, pg, top + 0.4, w, 380.0 + 30.0 * k FROM (SELECT doc_id, pg, top,
     unnest(string_split(comments, ' ')) w, unnest(range(len(string_split(comments, ' ')))) k FROM v_slots)
  UNION ALL SELECT doc_id, pg, top + 0.8, page_text, 530.0 FROM v_slots
  UNION ALL SELECT doc_id, pg, 60.0, CASE WHEN k = 0 AND doc_id % 50 = 7 THEN 'Ref' ELSE w END, x FROM (
     SELECT DISTINCT doc_id, pg FROM v_slots) CROSS JOIN (VALUES (0,'Id',30.0),(1,'Severity',90.0),(2,'User',150.0),(3,'tags',180.0),
       (4,'Issues',260.0),(5,'Comments',380.0),(6,'Page',530.0)) h(k, w, x)
  UNION ALL SELECT doc_id, pg, 20.0, CASE WHEN k = 2 THEN 'p.' || pg ELSE w END, x FROM (
     SELECT DISTINCT doc_id, pg FROM v_slots) CROSS JOIN (VALUES (0,'Inspection',30.0),(1,'report',90.0),(2,'',150.0)) h(k, w, x))
"""
# visual lines of the printed reports: tops of one line lie within 2 points, lines lie further apart
VIEWS["v_plines"] = """
SELECT doc_id, page, line_top, string_agg(text, ' ' ORDER BY x0) AS text, count(*) AS n_words FROM (
  SELECT *, floor(top / 20.0) * 20.0 AS line_top FROM v_printed) GROUP BY ALL
"""
# mapping work
VIEWS["v_rules"] = """
SELECT transform_id, target_field, mech AS mechanism,
  CASE WHEN mech = 'route' THEN CASE WHEN tier = 'T3' THEN '?' WHEN k % 4 = 0 THEN 'finding.comments' ELSE path END END AS from_path, tier,
  CASE WHEN pinned THEN 'map_' || (k % 4) END AS vm_name, CASE WHEN pinned THEN (k % 5 + 1)::INTEGER END AS vm_version,
  CASE mech WHEN 'constant' THEN 'C' || k WHEN 'formula' THEN ['concat','substring','arith'][k % 3 + 1] WHEN 'prompt' THEN 'ask_' || (k % 4) END AS spec
FROM (SELECT *, CASE WHEN k % 10 < 6 AND k % 11 = 0 THEN 'T2' WHEN k % 10 < 6 AND k % 11 = 1 THEN 'T3' WHEN pinned THEN 'T1' ELSE 'T0' END AS tier FROM (
  SELECT l_suppkey AS transform_id,
   ['line_ref','customer_name','ordered_on','part_family','handling','urgency_mark','frame_agreement'][l_linenumber] AS target_field,
   ['finding.id','header.inspection_name','header.report_date','finding.issues','finding.severity','finding.severity','finding.page'][l_linenumber] AS path,
   min(l_partkey) AS k, k % 10 < 6 AND k % 3 = 0 AS pinned,
   CASE WHEN k % 10 < 6 THEN 'route' WHEN k % 10 = 6 THEN 'constant' WHEN k % 10 = 7 THEN 'formula' ELSE 'prompt' END AS mech
  FROM lineitem GROUP BY l_suppkey, l_linenumber)) WHERE k % 10 < 9
"""
VIEWS["v_transforms"] = """
SELECT s_suppkey AS transform_id, n_name AS template, s_nationkey, 'shape_' || (s_suppkey % 6) AS profile
FROM supplier JOIN nation ON n_nationkey = s_nationkey
"""
VIEWS["v_required"] = """
SELECT transform_id, f AS target_field FROM v_transforms CROSS JOIN (VALUES (0,'line_ref'),(1,'customer_name'),(2,'ordered_on'),
 (3,'part_family'),(4,'handling'),(5,'urgency_mark'),(6,'frame_agreement'),(7,'intake_channel')) t(j, f) WHERE (s_nationkey + j) % 5 <> 0
"""
VIEWS["v_map_entries"] = """
SELECT 'map_' || (p_partkey % 4) AS name, p_size % 4 + 1 AS version, p_partkey AS pos, p_brand AS source_value,
  substr(p_type, 1, 1) || (p_partkey % 9) AS target_value,
  CASE WHEN p_partkey % 13 = 0 THEN 'imported' WHEN p_partkey % 9 = 0 THEN 'ai-accepted' ELSE 'human' END AS provenance FROM part
"""
VIEWS["v_evt"] = """
SELECT event_id, user_id AS session_id, regexp_extract(props, '(\\d+)', 1) AS v,
  CASE event_type WHEN 'signup' THEN 'line_ref' WHEN 'view' THEN 'handling' WHEN 'click' THEN 'part_family'
       WHEN 'purchase' THEN 'urgency_mark' ELSE 'comments' END AS field,
  CASE event_id % 3 WHEN 0 THEN 'finding.severity' WHEN 1 THEN 'finding.issues' ELSE 'header.company' END AS path0
FROM events
""".replace("\\\\", "\\")
VIEWS["v_proposals"] = """
SELECT session_id, field AS target_field, arg_min(['finding.id','header.inspection_name','header.report_date','finding.issues',
  'finding.severity','finding.severity','finding.page'][event_id % 7 + 1], event_id) AS from_path FROM v_evt GROUP BY 1, 2
"""
VIEWS["v_cells"] = """
SELECT g.doc_id, 1 AS page, 0 AS table_no, g.i, g.j, CASE WHEN g.i = 0 THEN ['No','Year','1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'][g.j + 1]
  WHEN g.j = 0 THEN CASE WHEN g.doc_id % 6 = 5 THEN 'x' || g.i ELSE g.i::VARCHAR END
  WHEN g.j = 1 THEN CASE WHEN g.doc_id % 20 = 4 THEN '' ELSE 'Year ' || (g.i + 1994) END
  ELSE coalesce(c.n::VARCHAR, '') END AS text,
  40.0::DOUBLE + 60.0 * g.j AS x0, 100.0::DOUBLE + 20.0 * g.i AS top,
  40.0::DOUBLE + 60.0 * g.j + CASE WHEN g.j = 6 AND g.doc_id % 10 = 3 THEN 10.0 ELSE 50.0 END AS x1, 118.0::DOUBLE + 20.0 * g.i AS bottom,
  (g.doc_id % 4 * 90)::INTEGER AS rotation, 500.0::DOUBLE AS width, 800.0::DOUBLE AS height
FROM (SELECT c_custkey AS doc_id, i, j FROM customer, range(8) a(i), range(7) b(j) WHERE NOT (c_custkey % 20 = 4 AND j > 1)) g
LEFT JOIN (SELECT o_custkey AS doc_id, year(o_orderdate) - 1994 AS i, substr(o_orderpriority, 1, 1)::INT + 1 AS j, count(*) AS n
  FROM orders GROUP BY ALL) c ON c.doc_id = g.doc_id AND c.i = g.i AND c.j = g.j
"""
VIEWS["v_elements"] = """
SELECT doc_id AS proposal_id, 'e' || line_no AS element_id, line_no AS seq,
 ['header_field','record_column','furniture_line','fingerprint_anchor','record_table','image_region'][line_no % 6 + 1] AS kind, page, text AS payload FROM v_lines
"""
VIEWS["v_review"] = """
SELECT e.proposal_id, e.element_id, 1 AS step, 'confirmed' AS state, NULL::VARCHAR AS corrected FROM v_elements e JOIN labels l ON l.doc_id = e.proposal_id WHERE quality = 1
UNION ALL SELECT e.proposal_id, e.element_id, 2, 'corrected', '[fixed] ' || payload FROM v_elements e JOIN labels l ON l.doc_id = e.proposal_id WHERE seq % 7 = 3
UNION ALL SELECT e.proposal_id, e.element_id, 3, 'removed', NULL FROM v_elements e JOIN labels l ON l.doc_id = e.proposal_id WHERE toxic = 1 AND seq % 2 = 0
UNION ALL SELECT e.proposal_id, e.element_id, 4, 'proposed', NULL FROM v_elements e JOIN labels l ON l.doc_id = e.proposal_id WHERE seq % 14 = 10
"""
VIEWS["v_cover"] = """
SELECT doc_id, 1 AS page, unnest([
 {'text': 'Annotations', 'x0': 200.0::DOUBLE, 'x1': 260.0::DOUBLE, 'top': 50.0::DOUBLE},
 {'text': 'Images', 'x0': 300.0::DOUBLE, 'x1': 340.0::DOUBLE, 'top': 50.0::DOUBLE},
 {'text': declared::VARCHAR, 'x0': 210.0::DOUBLE, 'x1': 225.0::DOUBLE, 'top': 50.0::DOUBLE + doc_id % 80},
 {'text': (doc_id % 1000)::VARCHAR, 'x0': 255.0::DOUBLE, 'x1': 275.0::DOUBLE, 'top': 55.0::DOUBLE + doc_id % 30},
 {'text': (doc_id % 77)::VARCHAR, 'x0': 330.0::DOUBLE, 'x1': 350.0::DOUBLE, 'top': 51.0::DOUBLE + doc_id % 9},
 {'text': 'Company:', 'x0': 30.0::DOUBLE, 'x1': 80.0::DOUBLE, 'top': 150.0::DOUBLE},
 {'text': company, 'x0': 40.0::DOUBLE, 'x1': 90.0::DOUBLE, 'top': 160.0::DOUBLE},
 {'text': inspection_name, 'x0': 80.0::DOUBLE, 'x1': 200.0::DOUBLE, 'top': 150.0::DOUBLE + doc_id % 40},
 {'text': inspection_type, 'x0': 180.0::DOUBLE, 'x1': 260.0::DOUBLE, 'top': 155.0::DOUBLE}], recursive := true) FROM v_headers
"""
VIEWS["v_images"] = """
SELECT doc_id, pg AS page, id AS img_id, record_seq, top - 30.0 + record_seq % 45 AS img_top, top - 18.0 + record_seq % 45 AS img_bottom
FROM v_slots WHERE len(issues) = 2
"""
# document properties and triage
VIEWS["v_meta"] = r"""
SELECT page_id AS doc_id, contains(html, '</html>') AS parseable, page_id % 17 = 3 AS encrypted, contains(html, 'track(') AND page_id % 5 = 1 AS xfa,
 (length(html) - length(replace(html, '<li>', ''))) // 4 * CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS n_fields,
 CASE WHEN page_id % 7 = 2 THEN 0 ELSE length(regexp_replace(html, '<[^>]*>', '', 'g')) END AS text_chars,
 (length(html) - length(replace(html, '<p>', ''))) // 3 - 3 AS n_images FROM pages
"""
VIEWS["v_triage"] = """
SELECT *, CASE WHEN NOT parseable THEN 'unparseable' WHEN encrypted THEN 'encrypted' WHEN xfa THEN 'xfa' WHEN n_fields > 0 THEN 'form'
 WHEN text_chars > 0 THEN 'fixed_layout' WHEN n_images > 0 THEN 'scanned' ELSE 'empty' END AS condition FROM v_meta
"""
