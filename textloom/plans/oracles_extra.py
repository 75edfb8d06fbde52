"""The queries of ``queries_more`` as DuckDB SQL, with every constant spelled out."""

from __future__ import annotations

from textloom.functions import text as T
from textloom.plans import fixtures as X
from textloom.plans.oracles import BLOCKS, CATEGORIES, CLASSIFIED, CLEANED, MD, MEASURES, MESSAGES, PATHS, RECURSIVE, ROUTED, STRUCTURE, WITH, R, exact, has, n_of, q, rule_any, split_lines, strip, terms
from textloom.plans.oracles_more import EXTENSION, ORACLES, POLLUTION, _category, _feedback, _safe, fixture, replaced

_CODE = "'py', 'js', 'jsx', 'ts', 'tsx', 'mjs', 'cjs', 'java', 'go', 'rs', 'c', 'cc', 'cpp', 'h', 'hpp', 'cs', 'php', 'rb', 'swift', 'kt', 'kts', 'scala', 'sh', 'bash', 'zsh', 'ps1', 'bat', 'cmd', 'sql', 'yaml', 'yml', 'toml', 'ini', 'cfg', 'conf'"
_CAPABLE = "CASE ext WHEN 'md' THEN 'markdown_text_direct' WHEN 'csv' THEN 'markdown_text_direct' WHEN 'html' THEN 'html_direct' WHEN 'pdf' THEN 'pdf_diagnosis_selected' WHEN 'srt' THEN 'subtitle_transcript_direct' WHEN 'py' THEN 'code_direct' WHEN 'docx' THEN 'office_xml' WHEN 'png' THEN 'image_ocr' ELSE 'unsupported_extension' END"
_ROUTE = "CASE ext WHEN 'md' THEN 'direct_text' WHEN 'csv' THEN 'direct_text' WHEN 'html' THEN 'direct_text' WHEN 'pdf' THEN 'pdf_diagnosis_selected' WHEN 'srt' THEN 'direct_text' WHEN 'py' THEN 'direct_code' WHEN 'docx' THEN 'office_xml' WHEN 'png' THEN 'external_conversion_required' ELSE 'unsupported' END"
_SOURCE = "CASE ext WHEN 'md' THEN 'markdown_note' WHEN 'csv' THEN 'markdown_note' WHEN 'pdf' THEN 'pdf_like' WHEN 'docx' THEN 'pdf_like' WHEN 'srt' THEN 'subtitle_transcript' ELSE 'generic_block' END"
_FILES = f"f AS (SELECT *, {EXTENSION} AS ext FROM {fixture(X.FILES, 'documents')})"
_TYPE = "CASE ext WHEN 'md' THEN 'markdown_note' WHEN 'pdf' THEN 'pdf_like' WHEN 'docx' THEN 'pdf_like' WHEN 'srt' THEN 'subtitle_transcript' ELSE 'generic_block' END"
_FAMILY = "CASE ext WHEN 'md' THEN 'text' WHEN 'html' THEN 'text' WHEN 'csv' THEN 'text' WHEN 'pdf' THEN 'pdf' WHEN 'srt' THEN 'subtitle_transcript' WHEN 'py' THEN 'code' WHEN 'docx' THEN 'word' ELSE 'unknown' END"
_OCR = (
    (r"\bAll in Al\b", "All in AI"), (r"Al([\x{4E00}-\x{9FFF}])", r"AI\1"), (r"(^|[^a-zA-Z])A([\x{4E00}-\x{9FFF}])", r"\1AI\2"),
    (r"Google Al Studio", "Google AI Studio"), (r"YouTubeAl", "YouTube AI"), (r"AIlinAI", "AI in AI"),
)
_TABLES = f"replace(replace({X.DAMAGED}, concat('<TABLE><tr><th>a</th><td> b', chr(10), 'c </td></tr><tr><td>1</td></tr><tr></tr></TABLE>'), concat('| a | b c |', chr(10), '| --- | --- |', chr(10), '| 1 |')), 'never there', '')"
_fixed = "t"
for _p, _r in _OCR:
    _fixed = f"regexp_replace({_fixed}, {q(_p)}, {q(_r)}, 'g')"
_SQUEEZE = lambda c: f"trim(regexp_replace({c}, {q('[' + T.SPACE + ']+')}, ' ', 'g'), ' ')"
_HEADS = f"list_filter(list_transform(list_filter(string_split(regexp_replace(text, '(?s)```.*?```', '', 'g'), chr(10)), lambda v: {has('v', '^[' + T.SPACE + ']{0,3}#{1,6}[' + T.SPACE + ']+[^' + T.SPACE + ']')}), lambda v: lower({_SQUEEZE('regexp_replace(regexp_replace(v, ' + q('^[' + T.SPACE + ']{0,3}#{1,6}[' + T.SPACE + ']+') + ', ' + q('') + '), ' + q('[' + T.SPACE + ']*#*[' + T.SPACE + ']*$') + ', ' + q('') + ')')})), lambda v: v <> '')"
_PAGES = f"pg AS (SELECT *, {strip('text')} AS t FROM {fixture(X.PAGES, 'lineitem')}), st AS (SELECT doc_id, count(*) AS page_count, count(*) FILTER (t = '' AND n_images > 0) AS image_pages, count(*) FILTER (t <> '') AS text_pages, count(*) FILTER (t = '' AND n_images = 0) AS empty_pages, sum(CASE WHEN t <> '' THEN length(t) + 1 ELSE 0 END)::BIGINT AS total_chars, sum(n_images)::BIGINT AS image_count, count(*) FILTER (width > height) AS landscape_pages, max(n_images)::BIGINT AS most_images, CASE WHEN count(*) FILTER (t <> '') > 0 THEN round(sum(CASE WHEN t <> '' THEN length(t) + 1 ELSE 0 END) / count(*) FILTER (t <> ''), 1) ELSE 0.0 END::DOUBLE AS chars_per_text_page, sum({n_of('t', T.CJK)})::BIGINT AS chinese, sum({n_of('t', T.ALNUM)})::BIGINT AS alnum, sum({n_of('t', T.UNCOMMON)})::BIGINT AS uncommon, sum({n_of('t', chr(91) + '?' + chr(92) + 'x{FFFD}]')})::BIGINT AS replaced, sum(length(array_to_string(regexp_extract_all(t, {q(T.GARBLED)}), '')))::BIGINT AS garbled_chars, greatest(sum(length(array_to_string(regexp_extract_all(t, {q(T.MOJIBAKE)}), ''))), sum({n_of('t', T.MOJIBAKE_CHAR)}), sum(length(array_to_string(regexp_extract_all(t, {q(T.MOJIBAKE_TOKEN)}), ''))))::BIGINT AS mojibake_chars FROM pg GROUP BY doc_id)"
_LOOP = f"lo AS (SELECT doc_id, greatest(coalesce(iteration, 1), 1) AS now, greatest(coalesce(max_iterations, 3), 1) AS lim, errors FROM {fixture(X.LOOPS, 'documents')})"
_NOTES = f"s AS (SELECT *, sum((type = 'section_heading')::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM cleaned WHERE status = 'keep'), n AS (SELECT doc_id, section, coalesce(arg_min(title, ord) FILTER (type = 'section_heading'), 'Untitled') AS title FROM s GROUP BY ALL), c AS (SELECT *, {_category} AS category FROM n), notes AS (SELECT *, concat(category, '/', lpad((row_number() OVER (PARTITION BY doc_id, category ORDER BY section))::VARCHAR, 3, '0'), '-', {_safe}, '.md') AS path FROM c)"
_PROPOSED = fixture(X.PROPOSALS, "documents")
_ALLOWED = f"(protected OR type IN ('operation_step', 'case_step', 'tool_instruction', 'prompt', 'code', 'table') OR {exact('text', R.knowledge)})"
_TUTORIAL = f"({terms('text', R.tutorial + R.knowledge)} OR {exact('text', R.knowledge)} OR length(text) > 200 OR contains(text, '```') OR contains(text, '$ ') OR {has('text', '(?m)^[ ' + chr(92) + 't]*' + chr(92) + 'd+[.、)][ ' + chr(92) + 't]+')} OR {has('text', '(?mi)^[ ' + chr(92) + 't]*step[ ' + chr(92) + 't]*' + chr(92) + 'd+[：:.) ' + chr(92) + 't-]+')})"
_LINKS = r"""!\[([^\]\n]*)\]\(([^)\n]+)\)|!\[\[([^\]\n]+)\]\]"""
_TEXT_OUT = "replace(replace(replace(t, 'temperature=0.2', 'temperature'), '| a | b |', '| b | A |'), 'x = ', 'y = ')"

EXTRA = {
    "source_families": f"WITH {_FILES} SELECT {_FAMILY} AS family, {_TYPE} AS source_type, count(*) AS files FROM f GROUP BY ALL",
    "capability_of": f"WITH {_FILES} SELECT {_CAPABLE} AS capability_id, {_SOURCE} AS source_type, {_ROUTE} AS route, CASE {_CAPABLE} WHEN 'unsupported_extension' THEN 'unsupported' WHEN 'html_direct' THEN 'partial' WHEN 'pdf_diagnosis_selected' THEN 'partial' WHEN 'office_xml' THEN 'partial' ELSE 'verified' END AS status, count(*) AS files FROM f GROUP BY ALL",
    "capability_summary": "SELECT * FROM (VALUES ('verified', 4::BIGINT), ('partial', 5), ('unsupported', 3), ('experimental', 0)) t(status, capabilities)",
    "capability_gaps": "SELECT id, status, route, extensions::BIGINT AS extensions, CASE status WHEN 'partial' THEN 'needs broader fixtures and preservation checks' ELSE 'needs a reliable route and end-to-end fixtures' END AS blocker FROM (VALUES ('html_direct', 'partial', 'direct_text', 2), ('notebook_json', 'partial', 'notebook_json', 1), ('office_xml', 'partial', 'office_xml', 3), ('epub_xhtml', 'partial', 'epub_xhtml', 1), ('pdf_diagnosis_selected', 'partial', 'pdf_diagnosis_selected', 1), ('image_ocr', 'unsupported', 'external_conversion_required', 9), ('legacy_office_or_mobi_heavy_conversion', 'unsupported', 'external_conversion_required', 4), ('media_requires_transcript', 'unsupported', 'provide_transcript_first', 11)) t(id, status, route, extensions)",
    "route_decision": f"WITH r AS (SELECT *, {EXTENSION} AS ext FROM {fixture(X.ROUTES, 'documents')}), a AS (SELECT *, CASE WHEN converter = 'ocr_after_text_layer' THEN 'ocr' WHEN converter = 'ocr' AND strategy IN ('ocr', 'ocr_mixed_text_image') THEN strategy ELSE converter END AS actual, fallback_from IS NOT NULL OR converter = 'ocr_after_text_layer' AS fb FROM r) SELECT path, {_CAPABLE} AS capability_id, {_ROUTE} AS declared_route, pipeline AS diagnosed_pipeline, strategy AS diagnosed_strategy, actual AS actual_route, fb AS fallback_applied, fallback_from, CASE WHEN fb THEN actual END AS fallback_to FROM a",
    "batch_totals": f"WITH f AS (SELECT *, {EXTENSION} AS ext FROM {fixture(X.FILES + X.RESULTS, 'documents')}), g AS (SELECT *, ext IN ('md', 'html', 'pdf', 'csv', 'srt', 'py', 'docx') AS taken, ok AND errors = 0 AS good FROM f) SELECT count(*) AS discovered, count(*) FILTER (taken) AS total, count(*) FILTER (NOT taken) AS skipped_unsupported, count(*) FILTER (taken AND good) AS succeeded, count(*) FILTER (taken AND good AND cached) AS skipped, count(*) FILTER (taken AND NOT good) AS failed, count(*) FILTER (taken AND ext = 'pdf') AS heavy, count(*) FILTER (taken AND ext <> 'pdf') AS light FROM g",
    "normalize": f"WITH {MD}, a AS (SELECT doc_id, {_TABLES} AS t FROM md), b AS (SELECT doc_id, {_fixed} AS t FROM a), c AS (SELECT doc_id, replace(CASE WHEN doc_id % 3 = 0 THEN concat(t, chr(10), '```') ELSE t END, concat('](a', chr(92), 'b.png)'), '](a/b.png)') AS t FROM b) SELECT doc_id, md5(t) AS md5, (7 + 1 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + 1)::BIGINT AS total_fixes, 7::BIGINT AS ocr_fixes, 1::BIGINT AS table_fixes, (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS code_fixes, 1::BIGINT AS image_fixes FROM c",
    "md_stats": rf"WITH {MD} SELECT doc_id, length(text)::BIGINT AS total_text_length, {n_of('text', r'(?m)^#{1,6}[ \t]+')} AS heading_count, {n_of('text', r'(?m)^```(?s:.*?)^```')} AS code_block_count, {n_of('text', r'(?m)^\|.+\|$')} AS table_row_count, CASE WHEN length(text) > 0 AND round(length(array_to_string(regexp_extract_all(text, {q(T.GARBLED)}), '')) / length(text), 4) > 0.05 THEN 'degraded' ELSE 'good' END AS text_layer_health FROM md",
    "page_stats": f"WITH {_PAGES} SELECT * FROM st",
    "page_assessment": f"""WITH {_PAGES}, r AS (SELECT *, CASE WHEN total_chars > 0 THEN round(mojibake_chars / total_chars, 4) ELSE 0 END AS mo, CASE WHEN total_chars > 0 THEN round(garbled_chars / total_chars, 4) ELSE 0 END AS ga, CASE WHEN total_chars > 0 THEN round(chinese / total_chars, 4) ELSE 0 END AS zh,
      CASE WHEN total_chars > 0 THEN round(greatest(garbled_chars / total_chars, uncommon / total_chars, mojibake_chars / total_chars, CASE WHEN (chinese + alnum) / total_chars < 0.2 THEN replaced / total_chars ELSE 0 END), 4) ELSE 0 END AS bad, landscape_pages / page_count AS wide, image_pages / page_count > 0.5 AS heavy FROM st),
      h AS (SELECT *, CASE WHEN text_pages = 0 AND image_pages > 0 THEN 'no_text_layer' WHEN bad > 0.25 OR mo > 0.08 OR ga > 0.08 THEN 'bad' WHEN mo > 0.03 OR ga > 0.03 THEN 'degraded' WHEN zh < 0.05 AND page_count > 5 THEN 'low_content' ELSE 'good' END AS health,
        round(least(1.0, CASE WHEN page_count >= 3 THEN CASE WHEN wide >= 0.8 THEN 0.45 ELSE 0 END + CASE WHEN chars_per_text_page > 0 AND chars_per_text_page < 900 THEN 0.25 ELSE 0 END + CASE WHEN image_count >= page_count THEN 0.2 ELSE 0 END + CASE WHEN text_pages <= greatest(1.0, page_count * 0.25) THEN 0.1 ELSE 0 END ELSE 0 END), 4)::DOUBLE AS slide FROM r),
      l AS (SELECT *, CASE WHEN slide >= 0.65 THEN 'slide_deck_or_ppt_export' WHEN wide >= 0.8 THEN 'landscape_report' WHEN heavy THEN 'image_heavy_document' ELSE 'document_pages' END AS layout,
        CASE WHEN heavy THEN CASE WHEN text_pages > 0 THEN 'image_heavy_mixed' ELSE 'image_only_or_scanned' END ELSE CASE health WHEN 'no_text_layer' THEN 'image_only_or_scanned' WHEN 'bad' THEN 'garbled_text_layer' WHEN 'degraded' THEN 'garbled_text_layer' WHEN 'good' THEN 'text_layer' ELSE CASE WHEN image_pages > 0 AND text_pages > 0 THEN 'mixed_text_image' END END END AS sub, health IN ('no_text_layer', 'bad', 'degraded') OR heavy AS ocr FROM h),
      k AS (SELECT *, coalesce(CASE WHEN image_count >= page_count AND text_pages <= greatest(1.0, page_count * 0.2) AND wide > 0.5 THEN 'ppt_exported_or_scanned' WHEN sub = 'text_layer' AND layout = 'slide_deck_or_ppt_export' THEN 'ppt_exported_text_layer' ELSE sub END, 'unknown') AS kind FROM l)
      SELECT doc_id, page_count, image_pages, text_pages, empty_pages, health AS text_layer_health, round(image_pages / page_count, 4)::DOUBLE AS image_page_ratio, round(wide, 4)::DOUBLE AS landscape_ratio, slide AS slide_like_score, layout AS layout_profile, kind AS pdf_subtype, ocr AS needs_ocr,
        CASE WHEN ocr THEN 'ocr' WHEN kind = 'ppt_exported_text_layer' THEN 'text_layer_slide_order' WHEN kind = 'mixed_text_image' THEN 'ocr_mixed_text_image' ELSE 'text_layer' END AS conversion_strategy,
        CASE WHEN layout = 'slide_deck_or_ppt_export' OR (NOT ocr AND kind = 'ppt_exported_text_layer') THEN 'preserve_slide_or_page_order' ELSE 'content_structure' END AS split_strategy FROM k""",
    "locate_pages": f"WITH {MD}, ml AS ({split_lines('md')}), it AS (SELECT doc_id, (i // 7)::INTEGER AS page, x FROM ml WHERE i % 7 = 0 AND x <> ''), f AS (SELECT it.doc_id, page, strpos(text, substr(x, 1, 40)) AS pos, text FROM it JOIN md ON md.doc_id = it.doc_id) SELECT doc_id, (length(substr(text, 1, pos - 1)) - length(replace(substr(text, 1, pos - 1), chr(10), '')))::INTEGER AS line, page FROM f WHERE pos > 0",
    "structure_integrity": f"WITH {MD}, lossy AS (SELECT doc_id, regexp_replace(replace(text, '| --- |', ''), '(?m)^### |\\.png', '', 'g') AS text FROM md), a AS ({STRUCTURE}), b AS ({STRUCTURE.replace('FROM md)', 'FROM lossy)')}), h AS (SELECT doc_id, {_HEADS} AS hs FROM md), g AS (SELECT doc_id, {_HEADS} AS hs FROM lossy) SELECT a.doc_id, len(h.hs)::BIGINT AS headings, len(list_filter(h.hs, lambda v: NOT list_contains(g.hs, v)))::BIGINT AS missing_headings, greatest(0, a.tables - b.tables)::BIGINT AS missing_tables, greatest(0, a.code_blocks - b.code_blocks)::BIGINT AS missing_code_blocks, greatest(0, a.images - b.images)::BIGINT AS missing_images FROM a JOIN b USING (doc_id) JOIN h USING (doc_id) JOIN g USING (doc_id)",
    "cta_to_review": f"WITH {BLOCKS} SELECT doc_id, block_id, 'possible_cta' AS tags, ' | contains CTA keywords' AS reason FROM blocks WHERE NOT protected AND type <> 'section_heading' AND {terms('text', R.cta)} AND NOT {_TUTORIAL}",
    "lost_details": f"WITH {CLEANED}, w AS (SELECT * REPLACE (CASE WHEN ord % 5 = 2 THEN 'discard' ELSE status END AS status), {CATEGORIES} AS cats FROM cleaned), l AS (SELECT * FROM w WHERE status = 'discard' AND len(list_filter(cats, lambda v: v NOT IN ('number_or_metric', 'link'))) > 0 AND NOT {POLLUTION}) SELECT doc_id, count(*) AS lost, string_agg(block_id, ',' ORDER BY ord) AS block_ids FROM l GROUP BY doc_id",
    "cta_violations": f"WITH {CLEANED} SELECT doc_id, count(*) FILTER (({terms('text', R.cta)} OR {rule_any('text')}) AND NOT {_ALLOWED}) AS violations FROM cleaned GROUP BY doc_id",
    "qr_matches": f"WITH {MD} SELECT doc_id, {n_of('t', r'(?i)!\[.*\]\(.*(?:qr|qrcode).*\)')} AS qr_images FROM (SELECT doc_id, replace(text, 'images/1', 'images/my-QRcode') AS t FROM md)",
    "image_retention": f"""WITH {CLEANED}, im AS (SELECT * FROM cleaned WHERE type IN ('image_evidence', 'image_operation', 'diagram', 'qr_image', 'unknown_image')), have AS (SELECT doc_id, format('images/{{}}.png', i) AS path FROM plain WHERE i % 4 <> 1),
      refs AS (SELECT doc_id, ord, regexp_extract(text, {q(T.IMAGE)}, 2) AS path FROM im WHERE status <> 'discard'), seen AS (SELECT r.*, h.path IS NULL AS gone FROM refs r LEFT JOIN have h ON h.doc_id = r.doc_id AND h.path = r.path),
      per AS (SELECT doc_id, count(*) AS referenced, count(*) FILTER (gone) AS missing, list(path ORDER BY ord) FILTER (gone) AS names FROM seen GROUP BY doc_id)
      SELECT i.doc_id, count(*) AS total_blocks, {', '.join(f"count(*) FILTER (status = '{x}') AS {x}_blocks" for x in ('keep', 'evidence', 'review', 'discard'))}, coalesce(any_value(referenced), 0)::BIGINT AS referenced, coalesce(any_value(missing), 0)::BIGINT AS missing, coalesce(array_to_string(any_value(names)[1:50], ','), '') AS missing_files, 0::BIGINT AS invalid_svg FROM im i LEFT JOIN per USING (doc_id) GROUP BY i.doc_id""",
    "image_contexts": f"""WITH {MD}, ml AS ({split_lines('md')}), cx AS (SELECT doc_id, i, x, {strip('x')} AS s FROM ml), w AS (SELECT doc_id, i, x, array_to_string(list_filter(list_concat(coalesce(list(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []), coalesce(list(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), [])), lambda v: v <> ''), ' ') AS near FROM cx)
      SELECT doc_id, src, md5(string_agg(near, ' ' ORDER BY i)) AS md5 FROM (SELECT doc_id, i, near, unnest(regexp_extract_all(x, {q(T.IMAGE)}, 2)) AS src FROM w) GROUP BY ALL""",
    "image_links": "SELECT doc_id, (3 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END)::BIGINT AS copied, (CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN doc_id % 5 = 2 THEN 0 ELSE 1 END)::BIGINT AS missing, 2::BIGINT AS skipped, md5(concat(text, chr(10), '![a](images/one.png) ![b](images/two.JPG) ![c](../out.png) ![d](https://x.org/e.png) ![e](note.txt) ![f](images/three x.png) ', CASE WHEN doc_id % 2 = 0 THEN '![](images/four.svg)' ELSE '![[four.svg|200]]' END, ' ![[page]] ![g](images/', doc_id % 5, '.gif)')) AS md5 FROM documents",
    "output_retention": f"""WITH {CLEANED}, o AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS t FROM cleaned WHERE status = 'keep' GROUP BY doc_id), p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_TEXT_OUT} ELSE t END AS t FROM o),
      sig AS (SELECT doc_id, unnest(list_concat(list_transform(regexp_extract_all(text, '(?i)https?://\\S+|www\\.\\S+'), lambda v: 'L' || v), list_transform(regexp_extract_all(text, '(?i)\\b(?:threshold|retry_count|failure_reason|temperature|top_p|model|seed)\\s*=\\s*[^,\\s，。]+'), lambda v: 'P' || v))) AS g, status FROM cleaned),
      d AS (SELECT DISTINCT doc_id, status, left(g, 1) AS k, regexp_replace(substr(g, 2), '[.,;:!?，。；：！？]+$', '') AS g FROM sig WHERE status IN ('keep', 'review', 'evidence')),
      m AS (SELECT d.doc_id, status, k, CASE WHEN status <> 'keep' THEN true WHEN k = 'L' THEN NOT contains(lower(t), lower(g)) ELSE NOT contains(lower(regexp_replace(t, '\\s+', '', 'g')), lower(regexp_replace(g, '\\s+', '', 'g'))) END AS gone FROM d LEFT JOIN p ON p.doc_id = d.doc_id),
      pr AS (SELECT c.doc_id, type, {strip("string_split(text, chr(10))[CASE type WHEN 'code' THEN 2 ELSE 1 END]")} AS line, t FROM cleaned c JOIN p ON p.doc_id = c.doc_id WHERE status = 'keep' AND type IN ('code', 'table')),
      lost AS (SELECT doc_id, type, CASE type WHEN 'code' THEN NOT contains(regexp_replace(t, '\\s+', ' ', 'g'), regexp_replace(line, '\\s+', ' ', 'g')) ELSE len(list_filter(string_split(t, chr(10)), lambda v: contains(lower(v), '| a | b |') OR contains(lower(v), '| b | a |'))) = 0 END AS gone FROM pr),
      a AS (SELECT doc_id, count(*) FILTER (gone AND k = 'L' AND status = 'keep') AS l, count(*) FILTER (gone AND k = 'P' AND status = 'keep') AS r, count(*) FILTER (gone) AS n FROM m GROUP BY doc_id), b AS (SELECT doc_id, count(*) FILTER (gone AND type = 'code') AS c, count(*) FILTER (gone AND type = 'table') AS t FROM lost GROUP BY doc_id)
      SELECT x.doc_id, coalesce(l, 0)::BIGINT AS primary_links, coalesce(r, 0)::BIGINT AS primary_parameters, coalesce(c, 0)::BIGINT AS primary_code, coalesce(t, 0)::BIGINT AS primary_tables, (coalesce(n, 0) + coalesce(c, 0) + coalesce(t, 0))::BIGINT AS missing_total FROM (SELECT DISTINCT doc_id FROM cleaned WHERE status IN ('keep', 'review', 'evidence')) x LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""",
    "quality_loop": f"WITH {_LOOP} SELECT doc_id, now::INTEGER AS current_iteration, lim::INTEGER AS max_iterations, greatest(0, lim - now)::INTEGER AS remaining_iterations, errors > 0 AND now < lim AS can_continue, CASE WHEN errors = 0 THEN 'passed' WHEN now >= lim THEN 'iteration_limit_reached' ELSE 'needs_iteration' END AS status, (errors + CASE WHEN errors > 0 AND now >= lim THEN 1 ELSE 0 END)::BIGINT AS strict_errors FROM lo",
    "quality_tasks": f"""WITH {MEASURES}, {MESSAGES}, {ROUTED}, {_LOOP}, t AS (SELECT doc_id, CASE gate WHEN 'conversion_integrity' THEN 1 WHEN 'cleanup_safety' THEN 2 WHEN 'splitting_integrity' THEN 3 WHEN 'review_safety' THEN 4 ELSE 5 END AS rk, gate, CASE gate WHEN 'cleanup_safety' THEN 'update_cleaning_rules_or_review_pack' ELSE 'block_export' END AS action, CASE gate WHEN 'cleanup_safety' THEN 'cleaning_rules' ELSE 'latest_outputs' END AS target, errors FROM gated WHERE status = 'fail'
      UNION ALL SELECT doc_id, 0, 'quality_loop', 'stop_iteration', 'quality_loop', errors + 1 FROM lo WHERE errors > 0 AND now >= lim), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rk) AS task_no FROM t) SELECT doc_id, task_no, concat('quality-task-', lpad(task_no::VARCHAR, 2, '0'), '-', replace(gate, '_', '-')) AS task_id, gate, action, target, errors::BIGINT AS errors FROM n""",
    "message_gates": "WITH m AS (SELECT ['E_TEXT_LAYER_BAD: x', 'E_QA_FAILED: 2 chunks have broken code blocks', 'W_LOW_COVERAGE: 3 chunks below 300 chars', 'E_QA_FAILED: 1 referenced image files are missing', 'discard ratio', 'E_QUALITY_ITERATION_LIMIT: x', 'CTA found'][doc_id % 7 + 1] AS m, ['conversion_integrity', 'splitting_integrity', 'splitting_integrity', 'conversion_integrity', 'cleanup_safety', 'export_readiness', 'cleanup_safety'][doc_id % 7 + 1] AS gate FROM documents) SELECT m, gate, count(*) AS docs FROM m GROUP BY ALL",
    "source_map": f"WITH {CLEANED}, {_NOTES} SELECT s.doc_id, block_id, type, path AS note FROM s JOIN notes ON notes.doc_id = s.doc_id AND notes.section = s.section",
    "index_page": f"""WITH {CLEANED}, {_NOTES}, per AS (SELECT doc_id, category, concat('## ', category, chr(10), chr(10), string_agg(concat('- [[', regexp_replace(path, '\\.md$', ''), '|', title, ']]'), chr(10) ORDER BY section)) AS p FROM notes GROUP BY doc_id, category), l AS (SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY category) AS lists FROM per GROUP BY doc_id),
      k AS (SELECT doc_id, count(*) FILTER (status = 'keep') AS a, count(*) FILTER (status = 'discard') AS b, count(*) FILTER (status = 'review') AS c FROM cleaned GROUP BY doc_id), t AS (SELECT k.doc_id, concat('## Blocks', chr(10), chr(10), '- kept: ', a, chr(10), '- discarded: ', b, chr(10), '- for review: ', c, chr(10), CASE WHEN lists IS NOT NULL THEN chr(10) || lists ELSE '' END) AS t FROM k LEFT JOIN l USING (doc_id)) SELECT doc_id, length(t)::BIGINT AS chars, md5(t) AS md5 FROM t""",
    "publishable": f"WITH {MEASURES}, {MESSAGES}, {ROUTED} SELECT doc_id, count(*) AS blocks FROM cleaned WHERE status = 'keep' AND doc_id IN (SELECT doc_id FROM gated WHERE gate = 'export_readiness' AND status <> 'fail') GROUP BY doc_id",
    "expired_runs": "WITH r AS (SELECT source AS root, concat('runs/', source, '/', doc_id) AS path, TIMESTAMP '2024-01-01' + to_days((doc_id % 20)::INT) AS mtime FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY mtime DESC, path DESC) AS n, date_diff('day', mtime, TIMESTAMP '2024-01-18 12:00:00') > 7 AS old, path LIKE 'runs/s3/%' OR path = 'runs/s4/7' AS safe FROM r) SELECT CASE WHEN safe THEN 'protected' WHEN n <= 3 OR NOT old THEN 'keep' ELSE 'remove' END AS action, count(*) AS runs FROM k GROUP BY 1",
    "ai_patch_validate": f"WITH o AS {fixture(X.PATCHES, 'events')}, c AS (SELECT CASE WHEN op NOT IN ('replace', 'add') THEN 'op' WHEN field = 'text' THEN 'field' WHEN op = 'add' AND field <> 'risk_tags' THEN 'add' WHEN field = 'status' AND value NOT IN ('keep', 'discard', 'evidence', 'review') THEN 'status' WHEN field = 'risk_tags' AND op = 'replace' AND NOT starts_with(value, '[') THEN 'risk_tags' WHEN field = 'confidence' AND TRY_CAST(value AS DOUBLE) > 1 THEN 'confidence' ELSE 'accepted' END AS outcome FROM o) SELECT outcome, count(*) AS ops FROM c GROUP BY 1",
    "patch_extract": "WITH a AS (SELECT user_id AS doc_id, max(event_id) AS e FROM events WHERE event_id % 3 <> 2 GROUP BY 1), t AS (SELECT doc_id, e, event_type FROM a JOIN events ON event_id = e) SELECT doc_id, concat('b_', e) AS block_id, seq, 'replace' AS op, 'status' AS field, event_type AS value FROM t, (VALUES (0::BIGINT), (1)) s(seq) WHERE seq = 0 OR e % 3 = 1",
    "toc_like": f"WITH p AS ({split_lines('documents')}), e AS (SELECT doc_id, {strip('CASE WHEN (i + doc_id) % 2 = 0 THEN concat(substr(x, 1, 130), ' + q('   ') + ', i) ELSE x END')} AS s FROM p), f AS (SELECT doc_id, count(*) FILTER (s <> '') AS n, count(*) FILTER (s <> '' AND length(s) <= 120 AND ({has('s', r'[：:].{2,}\s+\d{1,4}$')} OR {has('s', r'.{4,}\s{2,}\d{1,4}$')})) AS k FROM e GROUP BY doc_id) SELECT doc_id, n >= 2 AND k >= 2 AND 2 * k >= n AS toc FROM f",
    "feedback_scope": f"WITH f AS {fixture(X.SCOPED, 'documents')}, g AS (SELECT action, match, pattern, count(DISTINCT source) AS n, min(domain) AS a, max(domain) AS b, count(*) FILTER (domain = '') AS e FROM f GROUP BY ALL) SELECT id, CASE WHEN n > 1 THEN 'source_pattern' ELSE 'user' END AS scope, CASE WHEN n > 1 THEN CASE WHEN e = 0 AND a = b THEN concat('source_domain:', a) ELSE 'weekly-report' END END AS source_pattern FROM f JOIN g USING (action, match, pattern)",
    "feedback_decide": f"WITH p AS {_PROPOSED}, o AS (SELECT id, len(list_filter(examples, lambda v: NOT contains(lower(v), lower(pattern)))) = 0 AND len(list_filter(counterexamples, lambda v: contains(lower(v), lower(pattern)))) = 0 AS ok FROM p), c AS {fixture(X.CHOICES, 'documents')} SELECT id, choice, CASE choice WHEN 'accept' THEN CASE WHEN id % 11 = 0 THEN 'already_accepted' WHEN id % 13 = 0 THEN 'was_rejected' WHEN ok THEN 'accepted' ELSE 'needs_narrowing' END WHEN 'reject' THEN CASE WHEN id % 11 = 0 THEN 'was_accepted' WHEN id % 13 = 0 THEN 'already_rejected' ELSE 'rejected' END ELSE 'unknown_choice' END AS outcome FROM c JOIN o USING (id)",
    "feedback_narrowed": "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'Week \\d+ of the offer' ELSE CASE doc_id % 3 WHEN 0 THEN 'an offer that is larger' ELSE 'offer: now' END END AS pattern, CASE WHEN doc_id % 2 = 0 THEN 'regex' ELSE 'literal' END AS match, CASE WHEN doc_id % 4 = 0 THEN 'document_type' ELSE 'user' END AS scope FROM documents WHERE doc_id % 3 IN (0, 1)",
    "dictionary_promotion": f"WITH f AS {_feedback}, h AS {fixture(X.HISTORY, '(SELECT * FROM documents WHERE lang <> ' + q('en') + ')')}, s AS (SELECT document_type, greatest(0, count(*) FILTER (status = 'failed') - count(*) FILTER (resolved)) AS failed, count(*) FILTER (status = 'unverified') AS unverified FROM h GROUP BY 1), p AS (SELECT DISTINCT document_type, action, match, pattern FROM f WHERE status = 'accepted'), k AS (SELECT DISTINCT document_type, action, match, pattern, true AS known FROM f WHERE id % 6 = 1) SELECT document_type, CASE WHEN coalesce(failed, 0) > 0 THEN 'blocked' WHEN known THEN 'duplicate' WHEN coalesce(unverified, 0) > 0 THEN 'promoted_with_warning' ELSE 'promoted' END AS outcome, count(*) AS rules FROM p LEFT JOIN k USING (document_type, action, match, pattern) LEFT JOIN s USING (document_type) GROUP BY ALL",
    "rule_effects": f"WITH {CLEANED}, t AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS t FROM cleaned WHERE status = 'keep' GROUP BY doc_id), r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'protect' WHEN 1 THEN 'discard' ELSE 'review' END AS action FROM documents), e AS (SELECT action, CASE WHEN t IS NULL THEN 'cleaned_output_missing' WHEN action = 'review' THEN 'review_rule_not_checked_against_cleaned_text' WHEN contains(lower(t), 'limited-time offer') THEN CASE action WHEN 'protect' THEN 'protect_pattern_present_in_cleaned' ELSE 'discard_pattern_still_in_cleaned' END ELSE CASE action WHEN 'protect' THEN 'protect_pattern_missing_from_cleaned' ELSE 'discard_pattern_absent_from_cleaned' END END AS effect FROM r LEFT JOIN t USING (doc_id)) SELECT action, effect, count(*) FILTER (effect NOT IN ('cleaned_output_missing', 'discard_pattern_still_in_cleaned', 'protect_pattern_missing_from_cleaned')) AS ok, count(*) AS rules FROM e GROUP BY ALL",
    "svg_files": "SELECT page_id, concat('<svg xmlns=\"http://www.w3.org/2000/svg\" viewBox=\"0 0 ', page_id % 50 + 1, ' 20\"', CASE WHEN page_id % 2 = 0 THEN concat(' width=\"', page_id % 50 + 1, '\"') ELSE ' width=\"7\"' END, ' height=\"20\" preserveAspectRatio=\"xMidYMid meet\"><path/></svg>') AS svg, true AS valid FROM pages",
    "notebook_stats": "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 0 ELSE page_id % 5 + 1 END::BIGINT AS cells, CASE WHEN page_id % 7 = 0 THEN 0 ELSE (page_id % 5 + 2) // 2 END::BIGINT AS markdown_cells, CASE WHEN page_id % 7 = 0 THEN 0 ELSE (page_id % 5 + 1) // 2 END::BIGINT AS code_cells FROM pages",
    "slide_pages": f"WITH p AS ({split_lines('documents')}) SELECT doc_id, i::INTEGER AS page_idx, md5({strip('concat(' + q('# Slide ') + ', i + 1, CASE WHEN i % 2 = 0 THEN ' + q(': a title') + ' ELSE ' + q('') + ' END, chr(10), chr(10), x)')}) AS md5 FROM p",
}
ORACLES |= EXTRA
