"""More of the queries as DuckDB SQL: converters, feedback, patches, rendering."""

from __future__ import annotations

from textloom.functions import text as T
from textloom.plans import fixtures as X
from textloom.plans.oracles import CATEGORIES, CLASSIFIED, CLEANED, EXEMPT, MD, ORACLES, PATHS, RECURSIVE, STRUCTURE, WITH, R, exact, has, patterns, q, rule_case, split_lines, strip


def fixture(columns: list[str], source: str) -> str:
    return f"(SELECT {', '.join(columns)} FROM {source})".replace("array(", "list_value(")


def replaced(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {by}, 'g')"


_page = "coalesce(html, '')"
for _tag in ("script", "style", "nav", "footer", "header", "aside", "figure", "figcaption", "noscript", "template"):
    _page = replaced(_page, rf"(?is)<{_tag}(?:[ \t\n/][^>]*)?>.*?</{_tag}>", "chr(10)")
_page = replaced(replaced(_page, r"(?i)<br[ \t\n]*/?>", "chr(10)"), r"(?i)</(?:p|div|li|h[1-6]|tr|section|article)>", "chr(10)")
_page = replaced(replaced(_page, r"<[^>]+>", "' '"), r"[ \t]+", "' '")

EXTENSION = "lower(regexp_extract(path, '[^/\\\\]\\.([^./\\\\]+)$', 1))"
_feedback = fixture(X.FEEDBACK, "documents JOIN labels USING (doc_id)")
ALWAYS = ("page_marker", "slide_chapter_divider", "translator_marketing_back_matter", "author_identity", "author_intro", "author_profile_links", "image_artifact", "layout_table_artifact", "layout_separator", "toc", "toc_heading", "empty_heading")
_in = lambda values: "(" + ", ".join(map(q, values)) + ")"
_STRICT = "len(list_filter(cats, lambda v: v <> 'number_or_metric')) > 0"
POLLUTION = f"(type IN {_in(ALWAYS)} OR (type = 'marketing_cta' AND list_contains(risk_tags, 'promotional_line')) OR (type IN {_in(EXEMPT)} AND NOT {_STRICT}))"
_LIST = r"""^\s*\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$"""
_patched = f"""{CLEANED}, detailed AS (SELECT *, {CATEGORIES} AS cats FROM cleaned), guarded AS (SELECT *, len(cats) > 0 AND NOT {POLLUTION} AS detail FROM detailed), ops AS {fixture(X.PATCHES, 'events')}, checked AS (
  SELECT o.*, CASE WHEN c.block_id IS NULL THEN 'unknown_block' WHEN field NOT IN ('status', 'risk_tags', 'reason', 'confidence') THEN 'field'
    WHEN field = 'status' AND value NOT IN ('keep', 'discard', 'evidence', 'review') THEN 'status' WHEN field = 'risk_tags' AND op = 'replace' AND NOT {has('value', _LIST)} THEN 'risk_tags'
    WHEN field = 'confidence' AND coalesce(TRY_CAST(value AS DOUBLE) NOT BETWEEN 0 AND 1, true) THEN 'confidence'
    WHEN field = 'status' AND value = 'discard' AND c.detail THEN 'detail' WHEN field = 'status' AND value = 'discard' AND c.type IN ('operation_step', 'case_step', 'tool_instruction', 'prompt', 'code', 'table') THEN 'kept_type'
    WHEN field = 'status' AND value = 'discard' AND c.protected THEN 'protected' WHEN op NOT IN ('replace', 'add') THEN 'op' WHEN op = 'add' AND field <> 'risk_tags' THEN 'add' END AS rejected
  FROM ops o LEFT JOIN guarded c ON c.doc_id = o.doc_id AND c.block_id = o.block_id
), good AS (SELECT * FROM checked WHERE rejected IS NULL
), last AS (
  SELECT doc_id, block_id, arg_max(value, seq) FILTER (field = 'status') AS s, TRY_CAST(arg_max(value, seq) FILTER (field = 'confidence') AS DOUBLE) AS f FROM good GROUP BY ALL
), reset AS (
  SELECT doc_id, block_id, max(seq) AS at, arg_max(value, seq) AS v FROM good WHERE field = 'risk_tags' AND op = 'replace' GROUP BY ALL
), added AS (
  SELECT g.doc_id, g.block_id, list(g.value ORDER BY g.seq) AS more FROM good g LEFT JOIN reset r USING (doc_id, block_id) WHERE g.field = 'risk_tags' AND g.op = 'add' AND g.seq > coalesce(r.at, -1) GROUP BY ALL
)"""
_clean = replaced(replaced("title", r"""[<>:"/\\|?*\x00-\x1f]+""", "'-'"), r"^[ .\-_]+|[ .\-_]+$", "''")
_safe = f"coalesce(nullif(rtrim(substr({replaced(_clean, r'\s+', chr(39) + ' ' + chr(39))}, 1, 60), ' '), ''), 'Untitled')"
_category = "CASE " + " ".join(f"WHEN {exact('title', words)} THEN {q(name)}" for name, words in (("method", ("Method", "How", "Step", "Guide", "Workflow")), ("cognition", ("Why", "Idea", "Principle", "Trend")), ("case", ("Case", "Story", "Example")))) + " ELSE 'general' END"

ORACLES |= {
    "html_profile_text": f"SELECT page_id, length(t)::BIGINT AS chars, md5(t) AS md5 FROM (SELECT page_id, {_page} AS t FROM pages)",
    "conversation_transcript": "SELECT conv_id, count(*) AS turns, md5(string_agg(concat(role, ': ', text), chr(10) || chr(10) ORDER BY turn)) AS md5 FROM conversations GROUP BY conv_id",
    "conversation_turn_gaps": "SELECT conv_id, count(*) AS turns, count(*) FILTER (again) AS repeats, max(turn) AS last_turn FROM (SELECT *, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS again FROM conversations) GROUP BY conv_id",
    "csv_to_markdown": "SELECT 0 AS part, 0::BIGINT AS place, '| p_partkey | p_name | p_brand | p_size |' AS line UNION ALL SELECT 0, 1, '| --- | --- | --- | --- |' UNION ALL SELECT 1, p_partkey, concat('| ', p_partkey, ' | ', replace(trim(p_name), '|', chr(92) || '|'), ' | ', replace(trim(p_brand), '|', chr(92) || '|'), ' | ', p_size, ' |') FROM part",
    "code_fence": f"{WITH}{MD}, f AS (SELECT *, repeat(chr(96), greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, {q('`{3,}')}), lambda v: length(v))), 2) + 1)::INT) AS fence FROM md) SELECT doc_id, md5(concat(fence, 'text', chr(10), regexp_replace(text, '\\n+$', ''), chr(10), fence)) AS md5 FROM f",
    "fence_close": f"{WITH}{MD}, c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(text, chr(10), {q(T.FENCE)}, chr(10), 'left open') ELSE text END AS t FROM md), n AS (SELECT *, len(list_filter(string_split(t, chr(10)), lambda v: starts_with({strip('v')}, {q(T.FENCE)}))) AS k FROM c), d AS (SELECT doc_id, CASE WHEN k % 2 = 1 THEN concat(regexp_replace(t, '\\n+$', ''), chr(10), {q(T.FENCE)}) ELSE t END AS t FROM n) SELECT doc_id, length(t)::BIGINT AS chars, md5(t) AS md5 FROM d",
    "consecutive_dedupe": f"{WITH}l AS ({split_lines('documents')}), k AS (SELECT *, i = 0 OR x <> lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS new FROM l), d AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM k WHERE new GROUP BY doc_id) SELECT doc_id, length(t)::BIGINT AS chars, md5(t) AS md5 FROM d",
    "format_inventory": f"{WITH}f AS (SELECT *, {EXTENSION} AS ext FROM {fixture(X.FILES, 'documents')}), g AS (SELECT *, CASE ext WHEN 'md' THEN 'markdown' WHEN 'pdf' THEN 'pdf' WHEN 'csv' THEN 'text' WHEN 'srt' THEN 'subtitle_transcript' WHEN 'py' THEN 'code' WHEN 'html' THEN 'html' WHEN 'docx' THEN 'docx' ELSE 'unknown' END AS format FROM f), h AS (SELECT *, CASE WHEN format = 'unknown' THEN concat('unsupported_extension:', CASE ext WHEN '' THEN '<none>' ELSE '.' || ext END) END AS skip_reason FROM g) SELECT format, CASE WHEN skip_reason IS NULL THEN 'process' ELSE 'skip' END AS action, skip_reason, count(*) AS files, sum(size)::BIGINT AS bytes FROM h GROUP BY ALL",
    "source_domain_pages": "SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') AS domain, count(*) AS pages FROM pages GROUP BY 1",
    "source_pattern_pages": "SELECT page_id, d = 'example.com' OR ends_with(d, '.example.com') AS by_domain, lower(regexp_extract(url, '^(https?://[^/]+)', 1)) AS host FROM (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') AS d FROM pages)",
    "promo_split": f"""{WITH}{CLASSIFIED}, pl AS (SELECT doc_id, ord, x, i FROM (SELECT doc_id, ord, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM classified) WHERE {strip('x')} <> ''),
      pr AS (SELECT *, coalesce({rule_case('x', 'action')} = 'discard', false) AS promo FROM pl), pa AS (SELECT doc_id, ord, count(*) AS n, count(*) FILTER (promo) AS hits, string_agg(x, chr(10) ORDER BY i) FILTER (NOT promo) AS rest FROM pr GROUP BY ALL)
      SELECT doc_id, block_id, 0 AS sub_ord, CASE WHEN n > 1 AND hits = n THEN 'discard' ELSE status END AS status, md5(CASE WHEN n > 1 AND hits > 0 AND hits < n THEN rest ELSE text END) AS text_md5 FROM classified JOIN pa USING (doc_id, ord)
      UNION ALL SELECT doc_id, block_id || '_promo_' || lpad(k::VARCHAR, 3, '0'), k::INT, 'discard', md5({strip('x')}) FROM (SELECT doc_id, ord, x, row_number() OVER (PARTITION BY doc_id, ord ORDER BY i) AS k FROM pr JOIN pa USING (doc_id, ord) WHERE promo AND n > 1) JOIN classified USING (doc_id, ord)""",
    "review_pack": f"{WITH}{CLEANED} SELECT doc_id, count(*) AS blocks, sum(length(text))::BIGINT AS chars FROM cleaned WHERE status = 'review' OR confidence < 0.76 OR len(risk_tags) > 0 GROUP BY doc_id",
    "patch_validate": f"{WITH}{_patched} SELECT coalesce(rejected, 'accepted') AS outcome, count(*) AS ops FROM checked GROUP BY 1",
    "patch_apply": f"""{WITH}{_patched} SELECT c.doc_id, c.block_id, coalesce(s, status) AS status, l.doc_id IS NOT NULL AS patched, round(coalesce(f, confidence), 4)::DOUBLE AS confidence,
      array_to_string(list_concat(CASE WHEN r.v IS NULL THEN risk_tags ELSE CAST(r.v AS JSON)::VARCHAR[] END, coalesce(more, [])), ',') AS tags
      FROM cleaned c LEFT JOIN last l ON l.doc_id = c.doc_id AND l.block_id = c.block_id LEFT JOIN reset r ON r.doc_id = c.doc_id AND r.block_id = c.block_id LEFT JOIN added a ON a.doc_id = c.doc_id AND a.block_id = c.block_id""",
    "feedback_action": f"SELECT doc_id, CASE WHEN {exact('lower(text)', ('keep', 'protect', 'important'))} THEN 'protect' WHEN {exact('lower(text)', ('remove', 'drop', 'discard', 'noise', 'spam'))} THEN 'discard' ELSE 'review' END AS action, coalesce(nullif(regexp_extract(text, '[\"“'']([^\"”'']{{2,120}})[\"”'']', 1), ''), substr(text, 1, 120)) AS pattern FROM documents",
    "feedback_acceptance": f"SELECT id, len(list_filter(examples, lambda v: NOT contains(lower(v), lower(pattern)))) = 0 AND len(list_filter(counterexamples, lambda v: contains(lower(v), lower(pattern)))) = 0 AS ok FROM {fixture(X.PROPOSALS, 'documents')}",
    "feedback_repeat_sources": f"{WITH}f AS {_feedback} SELECT a.id, count(DISTINCT b.source) AS other_sources FROM f a JOIN f b ON a.action = b.action AND a.match = b.match AND a.pattern = b.pattern AND a.source <> b.source GROUP BY a.id",
    "dictionary_suggestions": f"{WITH}f AS {_feedback} SELECT document_type, pattern, count(DISTINCT source) AS sources, min(created_at) AS first_seen FROM f WHERE status = 'accepted' AND action = 'discard' AND NOT EXISTS (SELECT 1 FROM f r WHERE r.status = 'rejected' AND r.document_type = f.document_type AND r.action = f.action AND r.match = f.match AND r.pattern = f.pattern) GROUP BY document_type, pattern HAVING count(DISTINCT source) >= 2",
    "promotion_summary": f"SELECT document_type, count(*) FILTER (status = 'passed') AS passed, greatest(0, count(*) FILTER (status = 'failed') - count(*) FILTER (resolved))::BIGINT AS failed, count(*) FILTER (status = 'unverified') AS unverified, sum(samples)::BIGINT AS samples, arg_max(status, created_at * 100000000 + id) AS latest FROM {fixture(X.HISTORY, 'documents')} GROUP BY document_type",
    "keyword_dedupe": "WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[ \\n]')) AS word FROM documents) SELECT doc_id, word FROM (SELECT *, row_number() OVER (PARTITION BY lower(word) ORDER BY doc_id, word) AS n FROM w) WHERE n = 1",
    "retention_policy": f"SELECT run, root, row_number() OVER (PARTITION BY root ORDER BY mtime DESC, run DESC) <= 3 AS retained FROM {fixture(X.RUNS, 'documents')}",
    "cache_lookup": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0)",
    "cleaned_markdown": f"{WITH}{CLEANED} SELECT doc_id, count(*) AS blocks, md5(string_agg(text, chr(10) || chr(10) ORDER BY ord)) AS md5 FROM cleaned WHERE status = 'keep' GROUP BY doc_id",
    "render_evidence": f"{WITH}{CLEANED} SELECT doc_id, md5(string_agg(concat('<!-- [', block_id, '] type=', type, ' confidence=0.85 reason=pattern: ', type, ' -->', chr(10), text, chr(10)), chr(10) ORDER BY ord)) AS md5 FROM cleaned WHERE status = 'evidence' GROUP BY doc_id",
    "audit_topk": f"{WITH}{CLEANED}, k AS (SELECT *, CASE WHEN status IN ('discard', 'evidence', 'review') THEN status WHEN status = 'keep' AND len(risk_tags) > 0 THEN 'risky' END AS kind FROM cleaned) SELECT doc_id, kind, n, block_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY ord) AS n FROM k WHERE kind IS NOT NULL) WHERE n <= CASE kind WHEN 'discard' THEN 5 WHEN 'evidence' THEN 2 WHEN 'review' THEN 3 ELSE 4 END",
    "notes_sections": f"""{WITH}{CLEANED}, s AS (SELECT *, sum((type = 'section_heading')::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM cleaned WHERE status = 'keep'), n AS (SELECT doc_id, section, coalesce(arg_min(title, ord) FILTER (type = 'section_heading'), 'Untitled') AS title, count(*) AS blocks, sum(length(text))::BIGINT AS chars FROM s GROUP BY ALL),
      c AS (SELECT *, {_category} AS category FROM n)
      SELECT doc_id, section, category, blocks, chars, concat(category, '/', lpad((row_number() OVER (PARTITION BY doc_id, category ORDER BY section))::VARCHAR, 3, '0'), '-', {_safe}, '.md') AS path FROM c""",
    "parts": f"""{RECURSIVE}{CLEANED}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn, sum(length(text)) OVER (PARTITION BY doc_id) AS total FROM cleaned WHERE status = 'keep'), b AS (SELECT doc_id, rn, length(text) AS len, type = 'section_heading' AS heading FROM k WHERE total >= 12000),
      w AS (SELECT doc_id, rn, len AS cur, 1 AS no FROM b WHERE rn = 1 UNION ALL SELECT n.doc_id, n.rn, CASE WHEN p.cur >= 6000 AND (n.heading OR p.cur + n.len > 18000) THEN n.len ELSE p.cur + n.len END, p.no + CASE WHEN p.cur >= 6000 AND (n.heading OR p.cur + n.len > 18000) THEN 1 ELSE 0 END FROM w p JOIN b n ON n.doc_id = p.doc_id AND n.rn = p.rn + 1)
      SELECT doc_id, 'part_' || lpad(no::VARCHAR, 3, '0') AS part_id, count(*) AS blocks FROM w GROUP BY doc_id, no""",
    "structure_loss": f"{WITH}{MD}, a AS ({STRUCTURE}), lossy AS (SELECT doc_id, regexp_replace(replace(text, '| --- |', ''), '(?m)^### |\\.png', '', 'g') AS text FROM md), b AS ({STRUCTURE.replace('FROM md)', 'FROM lossy)')}) SELECT doc_id, " + ", ".join(f"greatest(0, a.{k} - b.{k})::BIGINT AS missing_{k}" for k in ("headings", "tables", "code_blocks", "images")) + " FROM a JOIN b USING (doc_id)",
    "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL",
    "chunks_by_page": f"""{RECURSIVE}{CLEANED}, pm AS (SELECT doc_id, i AS line, (i // 7 + 1)::INT AS page FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))), 7)) AS i FROM md)), k AS (SELECT doc_id, ord, length(text) AS len, (SELECT max(page) FROM pm WHERE pm.doc_id = c.doc_id AND line <= line_start) AS ps, (SELECT max(page) FROM pm WHERE pm.doc_id = c.doc_id AND line <= line_end) AS pe, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM cleaned c WHERE status = 'keep'),
      w AS (SELECT doc_id, rn, len AS cur, 1 AS no, ps AS page, ps, pe FROM k WHERE rn = 1 UNION ALL SELECT n.doc_id, n.rn, CASE WHEN n.ps <> p.page OR p.cur + 2 + n.len > 3500 THEN n.len ELSE p.cur + 2 + n.len END, p.no + CASE WHEN n.ps <> p.page OR p.cur + 2 + n.len > 3500 THEN 1 ELSE 0 END, n.ps, n.ps, n.pe FROM w p JOIN k n ON n.doc_id = p.doc_id AND n.rn = p.rn + 1)
      SELECT doc_id, no::INTEGER AS no, count(*) AS blocks, min(ps)::INTEGER AS page_start, max(pe)::INTEGER AS page_end FROM w GROUP BY doc_id, no""",
    "delimited_files": f"""WITH r AS (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(replace(coalesce(text, ''), '"', '|'), ' ', ', '), chr(13), chr(10)), chr(10)), lambda v: list_transform(string_split(v, ','), lambda c: replace({strip('c')}, '|', chr(92) || '|'))), lambda v: len(list_filter(v, lambda c: c <> '')) > 0) AS t FROM documents), w AS (SELECT *, list_max(list_transform(t, lambda v: len(v))) AS n FROM r),
      l AS (SELECT doc_id, n, list_transform(t, lambda v: concat('| ', array_to_string(list_concat(v, list_transform(range(n - len(v)), lambda k: '')), ' | '), ' |')) AS t FROM w), m AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN '' ELSE concat(t[1], chr(10), '| ', array_to_string(list_transform(range(n), lambda k: '---'), ' | '), ' |', CASE WHEN len(t) > 1 THEN chr(10) || array_to_string(t[2:], chr(10)) ELSE '' END) END AS t FROM l)
      SELECT doc_id, length(t)::BIGINT AS chars, md5(t) AS md5 FROM m""",
    "classify_images": f"""{WITH}{PATHS}, ml2 AS ({split_lines('md')}), cx AS (
      SELECT doc_id, i, x, {strip('x')} AS s FROM ml2), w AS (SELECT doc_id, i, unnest(regexp_extract_all(x, {q(T.IMAGE)}, 2)) AS src, array_to_string(list_filter(list_concat(coalesce(list(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []), coalesce(list(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), [])), lambda v: v <> ''), ' ') AS near FROM cx),
      n AS (SELECT doc_id, src, string_agg(near, ' ' ORDER BY i) AS near FROM w GROUP BY ALL),
      b AS (SELECT p.doc_id, p.block_id, p.text, replace(p.path, ' / ', ' ') AS heading, coalesce(n.near, '') AS near FROM paths p LEFT JOIN n ON n.doc_id = p.doc_id AND n.src = regexp_extract(p.text, {q(T.IMAGE)}, 2) WHERE p.type = 'image_evidence'),
      c AS (SELECT *, concat(text, ' ', near, ' ', heading) AS words FROM b),
      k AS (SELECT *, CASE WHEN {patterns('words', R.image_qr)} THEN 'qr_image' WHEN {patterns('words', R.image_proof)} THEN 'proof_screenshot' WHEN {patterns('words', R.image_marketing)} THEN 'marketing_poster' WHEN {patterns('words', R.image_operation)} THEN 'operation_screenshot'
        WHEN heading <> '' AND {patterns('heading', R.image_education)} THEN 'operation_screenshot' WHEN length(words) > 100 THEN 'unknown_review' ELSE 'unknown_image' END AS image_type FROM c)
      SELECT doc_id, block_id, CASE image_type WHEN 'qr_image' THEN 'discard' WHEN 'proof_screenshot' THEN 'evidence' WHEN 'marketing_poster' THEN 'evidence' WHEN 'operation_screenshot' THEN 'keep' ELSE 'review' END AS status, image_type FROM k""",
}


_whole = strip(f"regexp_replace({strip('x')}, '^#{{1,6}}[ \\t]*', '')")
_normal = replaced(replaced(replaced("p", r"^[#*\-_ \t]+|[#*\-_ \t]+$", "''"), f"[{T.SPACE}]+", "' '"), r"^[ ·:：\-—_]+|[ ·:：\-—_]+$", "''")
_compact = replaced("title", f"[{T.SPACE}]+", "''")
ORACLES["title_candidates"] = f"""{WITH}{MD}, ml AS ({split_lines('md')}), w AS (SELECT doc_id, i, {_whole} AS whole FROM ml WHERE i < 80),
  f AS (SELECT doc_id, i, unnest(list_concat([whole, string_split(whole, '|')[1], string_split(whole, '｜')[1]], regexp_extract_all(whole, '[\\x{{4E00}}-\\x{{9FFF}}][\\x{{4E00}}-\\x{{9FFF}}A-Za-z0-9《》「」：:·\\- ]{{2,39}}'))) AS p FROM w),
  c AS (SELECT doc_id, i, {_normal} AS title FROM f), d AS (SELECT *, {_compact} AS compact FROM c),
  s AS (SELECT doc_id, i, title, 100 - least(i, 30) + CASE WHEN {has('compact', '[' + chr(92) + 'x{4E00}-' + chr(92) + 'x{9FFF}]')} THEN 20 ELSE 0 END
    + CASE WHEN {has('lower(title)', r'手册|指南|报告|白皮书|行动|playbook|guide|manual|report')} THEN 15 ELSE 0 END - CASE WHEN {has('title', '[。！？!?；;]')} THEN 40 ELSE 0 END AS score FROM d
    WHERE length(compact) BETWEEN 4 AND 40 AND NOT {has('lower(compact)', r'目录|chapter\d*|resources|^contents$|^资源$')} AND NOT {has('title', '^[0-9]{1,4}$')}),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i, title DESC) AS n FROM s WHERE score > 0)
SELECT md.doc_id, title, coalesce(score, 0)::BIGINT AS score FROM md LEFT JOIN r ON r.doc_id = md.doc_id AND n = 1"""
