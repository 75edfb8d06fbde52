"""The queries again as DuckDB SQL, written on their own from the definitions."""

from __future__ import annotations

from types import SimpleNamespace as Named

from textloom.functions import text as T
from textloom.sources import tables as S

#: The terms and rules that queries run with, once more, so that a change of the library's shows.
R = Named(
    cta=("subscribe today", "join our community", "click the link below", "scan the code", "sign up now"),
    filler=(r"^(um+|uh+|okay|right|you know)[.,!]?$",),
    refund=(r"refund policy", r"money[- ]back guarantee"),
    footer=(r"all rights reserved", r"^copyright (notice|\x{A9}|\(c\))", r"^page \d+ of \d+$"),
    evidence=(("revenue_claim", r"earned \d+%|revenue of \$?\d+"), ("testimonial", r"changed my life|five stars")),
    protected=(("prompt", r"^prompt:"), ("tool_instruction", r"\binstall the (tool|plugin)\b")),
    knowledge=("method", "case study", "how to"),
    wrapper_lines=(r"^about this (book|course)$", r"^thank you for reading"),
    wrapper_headings=("Membership benefits", "About the publisher", "Join the club", "Acknowledgements"),
    back_matter=("About the publisher", "Acknowledgements"),
    business=("method", "strategy", "conversion rate"),
    method_pattern=r"(how to|method|strategy|case).{0,80}(traffic|account|conversion|workflow)",
    conditional_pattern=r"(if|when).{0,40}(scan the code|sign up now).{0,60}(keep|mark|record|delete)",
    tutorial=("tutorial", "step", "guide", "how to", "setup", "workflow"),
    qr=("qr", "qrcode"),
    image_qr=(r"qr[ _-]*code", r"\bscan to\b", r"scan the code"),
    image_proof=(r"\brevenue\b", r"\bincome\b", r"\btestimonial", r"\bfollowers\b"),
    image_marketing=(r"\bdiscount\b", r"\bon sale\b", r"limited[- ]time offer"),
    image_operation=(r"\bstep\b", r"\bclick\b", r"\bsettings?\b", r"\bscreenshot\b", r"\bdashboard\b"),
    image_education=("tutorial", "guide", "workflow"),
    rules=(
        Named(rule_id="keep-licence", action="protect", match="literal", pattern="license", risk_tag="promotional_line", reason="licences stay with the text"),
        Named(rule_id="drop-offer", action="discard", match="regex", pattern=r"limited[- ]time offer", risk_tag="promotional_line", reason="sales line"),
        Named(rule_id="drop-subscribe", action="discard", match="literal", pattern="subscribe today", risk_tag="promotional_line", reason="call to action"),
        Named(rule_id="check-contact", action="review", match="regex", pattern=r"[a-z0-9.]+@[a-z0-9.]+", risk_tag="promotional_line", reason="contact data"),
    ),
)
EXEMPT = (
    "page_marker", "slide_chapter_divider", "translator_marketing_back_matter", "transcript_filler", "marketing_cta", "marketing_wrapper", "author_identity", "author_intro", "image_artifact",
    "layout_table_artifact", "layout_separator", "author_profile_links", "toc", "toc_heading", "empty_heading", "back_matter", "refund_policy", "footer", "qr_image", "empty",
)
GATE_NAMES = ("conversion_integrity", "cleanup_safety", "splitting_integrity", "review_safety", "export_readiness")


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def n_of(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))::BIGINT"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {q(f'^[{T.SPACE}]+|[{T.SPACE}]+$')}, '', 'g')"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def terms(c: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {q(w.lower())})" for w in words) + ")"


def exact(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def patterns(c: str, some) -> str:
    return "(" + " OR ".join(has(c, f"(?i){p}") for p in some) + ")"


def split_lines(source: str, text: str = "text") -> str:
    return f"SELECT doc_id, unnest(string_split(coalesce({text}, ''), chr(10))) AS x, (generate_subscripts(string_split(coalesce({text}, ''), chr(10)), 1) - 1)::BIGINT AS i FROM {source}"


PLAIN = f"plain AS ({split_lines('documents')})"
MD = f"{PLAIN}, md AS (SELECT doc_id, string_agg(concat({S.LINE_CASE}, {S.LINE_END}), '' ORDER BY i) AS text FROM plain GROUP BY doc_id)"
UPTO = "OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)"
W_DOC = "OVER (PARTITION BY doc_id ORDER BY i)"
BLOCKS = rf"""{MD}, ml AS ({split_lines('md')}), f1 AS (
  SELECT *, {strip('x')} AS s, max(i) OVER (PARTITION BY doc_id) AS last_i FROM ml
), f2 AS (
  SELECT *, starts_with(s, {q(T.FENCE)}) AS fence, s = '' AS blank, starts_with(s, '>') AS quote,
    {has('x', r'^#{1,6}[' + T.SPACE + ']+.')} AS heading, {has('s', T.IMAGE)} AND length(s) < 200 AS image FROM f1
), f3 AS (SELECT *, sum(fence::INT) {UPTO} AS toggles FROM f2
), f4 AS (
  SELECT *, (toggles % 2 = 1 OR fence) AS code, lag(quote) {W_DOC} AS q_before, lead(quote) {W_DOC} AS q_after FROM f3
), f5 AS (
  SELECT *, starts_with(s, '|') AND NOT code AS pipe, NOT code AND (quote OR (blank AND coalesce(q_before, false) AND coalesce(q_after, i = last_i))) AS in_q FROM f4
), f6 AS (
  SELECT *, sum((NOT pipe)::INT) {UPTO} AS run_p, sum((NOT in_q)::INT) {UPTO} AS run_q FROM f5
), f7 AS (
  SELECT *, min(CASE WHEN pipe AND strpos(substr(s, 2), '|') > 0 THEN i END) OVER (PARTITION BY doc_id, run_p, pipe) AS p_first, max(i) OVER (PARTITION BY doc_id, run_p, pipe) AS p_last,
    min(CASE WHEN in_q AND quote AND NOT image THEN i END) OVER (PARTITION BY doc_id, run_q, in_q) AS q_first FROM f6
), f8 AS (
  SELECT *, CASE WHEN code THEN 'code' WHEN blank AND NOT (in_q AND coalesce(i >= q_first, false)) THEN 'blank' WHEN heading THEN 'heading'
    WHEN pipe AND coalesce(p_first < p_last AND i >= p_first, false) THEN 'table' WHEN image AND NOT (in_q AND coalesce(i >= q_first, false)) THEN 'image'
    WHEN in_q AND coalesce(i >= q_first, false) THEN 'quote' ELSE 'text' END AS kind FROM f7
), f9 AS (SELECT *, sum((kind <> 'text')::INT) {UPTO} AS run_t FROM f8
), f10 AS (
  SELECT doc_id, kind, (CASE kind WHEN 'code' THEN (toggles + 1) // 2 WHEN 'table' THEN run_p WHEN 'quote' THEN run_q WHEN 'text' THEN run_t ELSE i END)::BIGINT AS k,
    min(i) AS line_start, max(i) AS line_end, max(last_i) AS last_i, bool_or(i = last_i AND toggles % 2 = 1) AS open, {strip("string_agg(x, chr(10) ORDER BY i)")} AS text
  FROM f9 WHERE kind <> 'blank' GROUP BY ALL
), blocks0 AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_start) - 1)::INT AS ord, text, line_start::INT AS line_start,
    (CASE WHEN kind = 'code' AND open THEN last_i + 1 ELSE line_end END)::INT AS line_end, kind IN ('code', 'table') AS protected,
    CASE kind WHEN 'heading' THEN 'section_heading' WHEN 'image' THEN 'image_evidence' WHEN 'text' THEN
      CASE WHEN starts_with(text, '|') THEN 'table' WHEN {has('text', r'^#{1,6}[ \t]+.')} THEN 'section_heading' WHEN {has('text', '^' + T.STEP)} THEN 'operation_step' ELSE 'paragraph' END ELSE kind END AS type,
    CASE WHEN kind = 'heading' THEN length(regexp_extract(text, '^(#+)', 1)) END AS level, CASE WHEN kind = 'heading' THEN {strip("regexp_replace(text, '^#+', '')")} END AS title
  FROM f10 WHERE text <> ''
), blocks AS (SELECT *, format('b_{{:06d}}', ord) AS block_id FROM blocks0)"""

W_ORD = "OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)"
_H = ", ".join(f"max(CASE WHEN level = {n} THEN ord END) {W_ORD} AS o{n}, last_value(CASE WHEN level = {n} THEN title END IGNORE NULLS) {W_ORD} AS t{n}" for n in range(1, 7))
_OPEN = ", ".join(f"CASE WHEN o{n} > greatest(-1, {', '.join(f'coalesce(o{m}, -1)' for m in range(1, n)) or '-1'}) THEN t{n} END" for n in range(1, 7))
PATHS = f"{BLOCKS}, hp AS (SELECT *, {_H} FROM blocks), paths AS (SELECT * EXCLUDE (o1, o2, o3, o4, o5, o6, t1, t2, t3, t4, t5, t6), array_to_string(list_filter([{_OPEN}], lambda v: v IS NOT NULL), ' / ') AS path FROM hp)"

_SHORT = f"length(regexp_replace(text, {q('[' + T.SPACE + ']+')}, '', 'g')) <= 80 AND {terms('compact', [t.replace(' ', '') for t in R.cta])} AND NOT {exact('compact', R.knowledge)}"
_LABEL = lambda pairs, flag="": "CASE " + " ".join(f"WHEN {has('text', flag + '(?i)' + p)} THEN {q(n)}" for n, p in pairs) + " END"
_METHOD = f"({exact('text', R.business + R.knowledge)} OR {has('text', R.method_pattern)})"
_SECTION = f"CASE WHEN {exact('text', R.wrapper_headings)} THEN CASE WHEN {exact('text', R.back_matter)} THEN 'back_matter' ELSE 'marketing_wrapper' END WHEN {patterns('text', R.wrapper_lines)} THEN 'marketing_wrapper' END"
CLASSIFIED = f"""{BLOCKS}, c1 AS (SELECT *, regexp_replace(text, {q('[' + T.SPACE + ']+')}, '', 'g') AS compact FROM blocks), c2 AS (
  SELECT *, CASE WHEN {patterns('text', R.refund)} THEN NULL WHEN {_SHORT} THEN 'marketing_cta' WHEN {_METHOD} THEN NULL ELSE {_SECTION} END AS wrapper,
    CASE WHEN starts_with(text, {q(T.FENCE)}) THEN 'code' WHEN starts_with(text, '|') OR contains(lower(text), '<table') THEN 'table' ELSE {_LABEL(R.protected, '(?m)')} END AS guard,
    {terms('text', R.cta)} AND ({exact('text', R.knowledge + R.tutorial)} OR {has('text', R.conditional_pattern)}) AS contextual,
    CASE WHEN {patterns('text', R.filler)} THEN 'transcript_filler' WHEN {terms('text', R.cta)} THEN 'marketing_cta' WHEN {patterns('text', R.refund)} THEN 'refund_policy' WHEN {patterns('text', R.footer)} THEN 'footer' END AS drop_type,
    {_LABEL(R.evidence)} AS evidence, length(text) >= 20 AND {n_of('text', T.FOREIGN)} > 0.3 * length(text) AS garbled FROM c1
), c3 AS (
  SELECT *, CASE WHEN wrapper IS NOT NULL THEN 1 WHEN type IN ('code', 'table', 'section_heading', 'quote') THEN 2 WHEN type = 'image_evidence' THEN 3 WHEN type = 'operation_step' THEN 4
    WHEN guard IS NOT NULL THEN 5 WHEN contextual THEN 6 WHEN drop_type IS NOT NULL THEN 7 WHEN evidence IS NOT NULL THEN 8 WHEN garbled THEN 9 ELSE 10 END AS step FROM c2
), classified AS (
  SELECT doc_id, ord, block_id, text, line_start, line_end, level, title,
    CASE step WHEN 1 THEN 'discard' WHEN 3 THEN 'unclassified' WHEN 7 THEN 'discard' WHEN 8 THEN 'evidence' WHEN 9 THEN 'discard' ELSE 'keep' END AS status,
    CASE step WHEN 1 THEN wrapper WHEN 5 THEN guard WHEN 6 THEN 'case_step' WHEN 7 THEN drop_type WHEN 8 THEN evidence WHEN 9 THEN 'garbled_text' ELSE type END AS type,
    CASE WHEN step IN (4, 5, 6) THEN true WHEN step = 2 THEN protected OR type IN ('code', 'table') ELSE protected END AS protected,
    CASE step WHEN 1 THEN 0.96 WHEN 3 THEN 0.0 WHEN 6 THEN 0.88 WHEN 7 THEN 0.95 WHEN 8 THEN 0.85 WHEN 9 THEN 0.8 WHEN 10 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence FROM c3
)"""


def rule_case(c: str, column: str) -> str:
    """The first rule by priority, as a CASE."""
    def hit(r):
        return f"contains(lower({c}), {q(r.pattern.lower())})" if r.match == "literal" else has(c, f"(?i){r.pattern}")

    first = [r for r in R.rules if r.action == "protect"]
    rest = [r for r in R.rules if r not in first]
    return "CASE " + " ".join(f"WHEN {hit(r)} THEN {q(getattr(r, column))}" for r in first) + f" WHEN {exact(c, R.knowledge)} THEN NULL " + " ".join(f"WHEN {hit(r)} THEN {q(getattr(r, column))}" for r in rest) + " END"


def rule_any(c: str) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {q(r.pattern)})" if r.match == "literal" else has(c, f"(?i){r.pattern}") for r in R.rules) + ")"


CLEANED = f"""{CLASSIFIED}, cleaned AS (
  SELECT * REPLACE (
    CASE WHEN protected OR a IS NULL THEN status WHEN a = 'protect' THEN 'keep' ELSE a END AS status, CASE WHEN NOT protected AND a = 'discard' THEN 'marketing_cta' ELSE type END AS type,
    protected OR coalesce(a = 'protect', false) AS protected), CASE WHEN NOT protected THEN rule END AS cleaning_rule_id, CASE WHEN NOT protected AND rule IS NOT NULL THEN ['promotional_line'] ELSE []::VARCHAR[] END AS risk_tags
  FROM (SELECT *, {rule_case('text', 'action')} AS a, {rule_case('text', 'rule_id')} AS rule FROM classified)
)"""

_EXEMPT = "(" + ", ".join(map(q, EXEMPT)) + ")"
IMAGE_ONLY = f"({has('text', T.IMAGE)} AND {strip('regexp_replace(text, ' + q(T.IMAGE) + ', ' + q('') + ', ' + q('g') + ')')} = '')"
BODY = f"NOT (status = 'discard' AND type IN {_EXEMPT}) AND NOT (type IN ('image_evidence', 'image_operation', 'diagram') AND {IMAGE_ONLY})"
MEASURED = f"""m1 AS (
  SELECT doc_id, count(*) FILTER (e) AS eligible, count(*) FILTER (e AND g) AS discarded, coalesce(sum(length(text)) FILTER (e), 0) AS chars, coalesce(sum(length(text)) FILTER (e AND status = 'keep'), 0) AS kept_chars,
    count(*) FILTER (g AND protected) AS protected_lost, count(*) FILTER (g AND type = 'operation_step') AS steps_lost, count(*) FILTER (g AND type = 'code') AS code_lost, count(*) FILTER (g AND type = 'table') AS tables_lost
  FROM (SELECT *, {BODY} AS e, status = 'discard' AS g FROM cleaned) GROUP BY doc_id
), measures AS (
  SELECT doc_id, eligible, discarded, CASE WHEN eligible > 0 THEN round(discarded / eligible, 4) ELSE 0.0 END::DOUBLE AS discard_ratio, CASE WHEN chars > 0 THEN round(kept_chars / chars, 4) ELSE 1.0 END::DOUBLE AS coverage,
    protected_lost, steps_lost, code_lost, tables_lost FROM m1
)"""
MEASURES = f"{CLEANED}, {MEASURED}"


def packed(name: str, opens: str, where: str = "status = 'keep'") -> str:
    """A greedy packer as a recursive query: one step per block of a document."""
    return f"""{name}_in AS (
  SELECT doc_id, ord, block_id, text, length(text) AS len, type = 'section_heading' AS heading, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM cleaned WHERE {where}
), {name}_p AS (
  SELECT doc_id, ord, rn, len AS cur, 1 AS no FROM {name}_in WHERE rn = 1
  UNION ALL
  SELECT n.doc_id, n.ord, n.rn, CASE WHEN {opens} THEN n.len ELSE p.cur + 2 + n.len END, p.no + CASE WHEN {opens} THEN 1 ELSE 0 END FROM {name}_p p JOIN {name}_in n ON n.doc_id = p.doc_id AND n.rn = p.rn + 1
), {name} AS (
  SELECT doc_id, no, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text, string_agg(block_id, ',' ORDER BY ord) AS block_ids FROM {name}_p JOIN {name}_in USING (doc_id, ord) GROUP BY doc_id, no
)"""


GENERIC = packed("chunks", "p.cur + 2 + n.len > 1200")
BY_HEADING = packed("chunks", "(p.cur >= 300 AND (n.heading OR p.cur + 2 + n.len > 3500)) OR p.cur >= 1200")
_CHUNKS = "SELECT doc_id, format('chunk_{:04d}', no) AS chunk_id, block_ids, md5(text) AS text_md5, length(text)::BIGINT AS char_count FROM chunks"
MESSAGES = """messages AS (
  SELECT doc_id, 'error' AS level, 'cleanup_safety' AS gate FROM measures WHERE discard_ratio > 0.45
  UNION ALL SELECT doc_id, 'warning', 'cleanup_safety' FROM measures WHERE discard_ratio > 0.25 AND discard_ratio <= 0.45
  UNION ALL SELECT doc_id, 'error', 'cleanup_safety' FROM measures WHERE coverage < 0.78
  UNION ALL SELECT doc_id, 'warning', 'cleanup_safety' FROM measures WHERE coverage >= 0.78 AND coverage < 0.88
  UNION ALL SELECT doc_id, 'error', 'cleanup_safety' FROM measures WHERE protected_lost > 0
)"""
ROUTED = f"""routed AS (
  SELECT * FROM messages UNION ALL SELECT doc_id, level, 'export_readiness' FROM messages WHERE level = 'error'
), gates AS (
  SELECT d.doc_id, g.gate, count(r.level) FILTER (r.level = 'error') AS errors, count(r.level) FILTER (r.level = 'warning') AS warnings
  FROM (SELECT DISTINCT doc_id FROM cleaned) d CROSS JOIN (SELECT unnest([{', '.join(map(q, GATE_NAMES))}]) AS gate) g LEFT JOIN routed r ON r.doc_id = d.doc_id AND r.gate = g.gate GROUP BY ALL
), gated AS (SELECT *, CASE WHEN errors > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' WHEN gate = 'review_safety' THEN 'not_checked' ELSE 'pass' END AS status FROM gates)"""
_MESSAGES = f"{MESSAGES}, {ROUTED}"

_RATIO = lambda part: f"CASE WHEN total_chars > 0 THEN round({part} / total_chars, 4) ELSE 0.0 END::DOUBLE"
_Q1 = f"""q1 AS (SELECT doc_id, lang, source, length(t)::BIGINT AS total_chars, {n_of('t', T.CJK)} AS chinese, {n_of('t', T.ALNUM)} AS alnum, {n_of('t', T.CONTROL)} AS control,
  length(array_to_string(regexp_extract_all(t, {q(T.GARBLED)}), ''))::BIGINT AS garbled_chars,
  greatest(length(array_to_string(regexp_extract_all(t, {q(T.MOJIBAKE)}), '')), {n_of('t', T.MOJIBAKE_CHAR)}, length(array_to_string(regexp_extract_all(t, {q(T.MOJIBAKE_TOKEN)}), '')))::BIGINT AS mojibake_chars, {n_of('t', T.OCR_CONFUSION)} AS ocr_ai_confusion_count,
  {patterns('t', R.qr + R.image_qr)} AS has_qr_text, {terms('t', R.cta)} OR {rule_any('t')} AS has_cta_text, {n_of('t', T.UNCOMMON)} AS uncommon, {n_of('t', chr(91) + '?' + chr(92) + 'x{FFFD}]')} AS replaced
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)), q2 AS (SELECT *, CASE WHEN total_chars > 0 THEN greatest(garbled_chars / total_chars, uncommon / total_chars, mojibake_chars / total_chars,
  CASE WHEN (chinese + alnum) / total_chars < 0.2 THEN replaced / total_chars ELSE 0 END) ELSE 0 END AS unreadable FROM q1)"""
_LANG = lambda c: f"CASE WHEN {n_of(c, chr(92) + 'p{L}')} = 0 THEN 'other' WHEN {n_of(c, '[' + chr(92) + 'x{4E00}-' + chr(92) + 'x{9FFF}]')} >= 0.2 * {n_of(c, chr(92) + 'p{L}')} THEN 'zh' WHEN {n_of(c, '[' + chr(92) + 'x{4E00}-' + chr(92) + 'x{9FFF}]')} <= 0.05 * {n_of(c, chr(92) + 'p{L}')} THEN 'en' ELSE 'mixed' END"
_NUMBERED = r"(?m)^[ \t]*(?:\d+[.、)][ \t]+|第?[一二三四五六七八九十百千\d]+步[骤]?[：:、. \t]|步骤[ \t]*[一二三四五六七八九十百千\d]+[：:、. \t])"
_STEPS = r"(?mi)^[ \t]*step[ \t]*\d+[：:.) \t-]+"
_TUTORIAL = ["步骤", "操作", "设置", "配置", "教程", "如何", "怎么", "实操", "案例", "prompt", "提示词"]
_MEETING, _NOTE, _EBOOK = ["会议", "讨论", "主持人", "嘉宾", "提问", "回答", "访谈"], ["笔记", "复盘", "心得", "思考", "总结"], ["目录", "第一章", "第二章", "前言", "附录"]
_PROFILE = rf"""p1 AS (SELECT doc_id, text AS t, length(text)::BIGINT AS char_count, {n_of('text', r'(?m)^#{1,6}[ \t]+')} AS heading_count, {n_of('text', _NUMBERED)} + {n_of('text', _STEPS)} AS numbered_step_count, {n_of('text', _STEPS)} AS english,
  {n_of('text', r'(?m)^[ \t]*(\d{1,2}:)?\d{1,2}:\d{2}')} AS timestamp_line_count, {n_of('text', r'(?m)^[ \t]*[^:\n：]{1,24}[：:][ \t]+[^ \t\n]')} AS speaker_line_count, {n_of('text', r'(?m)^\|.+\|$')} AS table_row_count FROM md)
SELECT doc_id, CASE WHEN heading_count >= 8 AND char_count > 12000 THEN 'ebook_or_long_report' WHEN timestamp_line_count >= 3 OR speaker_line_count >= 8 THEN 'transcript'
  WHEN numbered_step_count >= 3 OR english > 0 OR {exact('lower(t)', _TUTORIAL)} THEN 'tutorial' WHEN {exact('t', _MEETING)} THEN 'meeting_or_interview' WHEN {exact('t', _NOTE)} THEN 'note'
  WHEN {exact('t', _EBOOK)} AND char_count > 12000 THEN 'ebook_or_long_report' WHEN char_count < 4000 THEN 'short_text' ELSE 'long_text' END AS text_profile,
  char_count, heading_count, numbered_step_count, timestamp_line_count, speaker_line_count, table_row_count FROM p1"""
#: (type, score, pattern, reason) in the order in which equal scores are settled; html, which is what pages are, adds to its own.
_SIGNALS = (
    ("report", 5, r"(?i)报告|摘要|同比|环比|样本量|研究方法|市场规模|趋势|结论|白皮书|survey|report|findings", "report, summary, metric, or research signals detected"),
    ("course", 5, r"(?i)第\s*[一二三四五六七八九十\d]+\s*(?:课|讲)|学习目标|课程|练习[:：]|作业|lesson\s+\d+", "course, lesson, exercise, or learning-goal signals detected"),
    ("transcript", 4, r"(?im)\btranscript\b|^\s*\d{1,2}:\d{2}\b|访谈|字幕|主持人|嘉宾", "transcript or timestamp signals detected"),
    ("webpage", 4, r"(?i)导航|首页|登录|注册|订阅|cookie|privacy|terms|购物车|阅读全文|上一篇|下一篇|breadcrumb", "web navigation or page-wrapper signals detected"),
    ("ebook", 4, r"(?i)\b(?:chapter|table of contents)\b|目录|第[一二三四五六七八九十\d]+章", "chapter or table-of-contents signals detected"),
    ("code", 4, r"(?m)```(?:python|js|ts|javascript|json|bash|sh|yaml|yml)?\n|^\s*(?:def|class|import|const|let|function)\s+", "code fences or source-code syntax detected"),
)
_TYPES = ", ".join(f"CASE WHEN {has('s', p)} THEN {score} ELSE 0 END AS s{i}" for i, (_, score, p, _) in enumerate(_SIGNALS))
_TOP = "greatest(" + ", ".join(f"s{i}" for i in range(len(_SIGNALS))) + ")"
_TABLE_RX = r"(?m)^[ \t]*\|.*\|[ \t]*\n[ \t]*\|([ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*(\n[ \t]*\|.*\|[ \t]*$)*"
DETAIL = {
    "operation_step": (r"(?mi)^\s*(?:\d+[.)、]\s+|step\s*\d+[：:.)\-\s]+|第[\x{4E00}-\x{9FFF}\d]+(?:步|步骤)[：:、.\s]|步骤\s*[\x{4E00}-\x{9FFF}\d]+[：:、.\s])", "operation_step"),
    "tool_or_platform": (r"(?i)工具|平台|账号|后台|网站|插件|APP|API|GitHub|YouTube|Obsidian|MinerU|\b(?:tool|platform|account|dashboard|plugin|workflow)\b", "tool_instruction"),
    "parameter": (r"(?i)参数|字段|配置|阈值|限制条件|\b(?:threshold|retry_count|failure_reason|temperature|top_p|model|seed)\b|\b[a-zA-Z_][\w-]*\s*=\s*[^,\s，。]+", None),
    "link": (r"(?i)https?://\S+|www\.\S+", None),
    "prompt": (r"(?i)提示词|prompt|指令", "prompt"),
    "code": (r"(?i)```|`[^`]+`|\b(?:def|class|const|let|function|import)\b", "code"),
    "table": (r"(?im)^\s*\|.+\|\s*$|<table\b", "table"),
    "number_or_metric": (r"\d", None),
}
_DETAIL = ", ".join(f"CASE WHEN {has('text', p)}{f' OR type = {q(kind)}' if kind else ''} THEN {q(n)} END" for n, (p, kind) in DETAIL.items())
CATEGORIES = f"list_filter([{_DETAIL}], lambda v: v IS NOT NULL)"
_COUNT = lambda s: f"count(*) FILTER (status = '{s}') AS {s}"
WITH, RECURSIVE = "WITH ", "WITH RECURSIVE "
STRUCTURE = rf"""SELECT doc_id, {n_of('p', r'(?m)^ {0,3}#{1,6}[ \t]+[^ \t\n#]')} AS headings, {n_of('p', _TABLE_RX)} AS tables, ({n_of('text', T.FENCE)} // 2)::BIGINT AS code_blocks, {n_of('p', T.IMAGE)} AS images
  FROM (SELECT *, regexp_replace(text, '(?s){T.FENCE}.*?{T.FENCE}', '', 'g') AS p FROM md)"""
LINK = r"https?://[^ \t\n]+"
PARAMETER = r"[a-zA-Z_][a-zA-Z0-9_-]*=[^, \t\n]+"


def missing(pattern: str) -> str:
    return f"""{WITH}{CLEANED}, s AS (SELECT doc_id, unnest(regexp_extract_all(text, {q(pattern)})) AS signal, status = 'keep' AS kept FROM cleaned), e AS (SELECT doc_id, signal, bool_or(kept) AS kept FROM s GROUP BY ALL)
SELECT doc_id, count(*) AS signals, count(*) FILTER (NOT kept) AS missing FROM e GROUP BY doc_id"""


ORACLES = {
    "text_quality": f"{WITH}{_Q1} SELECT doc_id, total_chars, {_RATIO('chinese')} AS chinese_ratio, {_RATIO('alnum')} AS alnum_ratio, {_RATIO('control')} AS control_ratio, {_RATIO('garbled_chars')} AS garbled_ratio, garbled_chars, {_RATIO('uncommon')} AS non_common_unicode_ratio, {_RATIO('replaced')} AS replacement_char_ratio, {_RATIO('mojibake_chars')} AS mojibake_ratio, mojibake_chars, round(unreadable, 4)::DOUBLE AS unreadable_text_ratio, ocr_ai_confusion_count, has_qr_text, has_cta_text FROM q2",
    "text_quality_by_lang": f"{WITH}{_Q1} SELECT lang, count(*) AS docs, sum(total_chars)::BIGINT AS chars, round(sum(alnum) / sum(total_chars), 4)::DOUBLE AS alnum_ratio, count(*) FILTER (round(unreadable, 4) > 0.03) AS unreadable_docs FROM q2 GROUP BY lang",
    "unreadable_docs": f"{WITH}{_Q1} SELECT doc_id, round(unreadable, 4)::DOUBLE AS unreadable_text_ratio FROM q2 WHERE round(unreadable, 4) > 0.03",
    "language_detect": f"SELECT doc_id, {_LANG('text')} AS detected FROM documents",
    "text_profile": f"{WITH}{MD}, {_PROFILE}",
    "doc_type": f"{WITH}d AS (SELECT page_id, {_TYPES} FROM (SELECT page_id, substr(coalesce(html, ''), 1, 200000) AS s FROM pages)), e AS (SELECT * REPLACE (s3 + 7 AS s3), s3 > 0 AS web FROM d) SELECT page_id, CASE {_TOP} " + " ".join(f"WHEN s{i} THEN '{n}'" for i, (n, _, _, _) in enumerate(_SIGNALS)) + f" END AS document_type, round(least(0.95, 0.35 + {_TOP} / 12), 3)::DOUBLE AS confidence, {_TOP}::INTEGER AS score, CASE {_TOP} " + " ".join(f"WHEN s{i} THEN " + (f"concat('detected format is html', CASE WHEN web THEN '; {why}' ELSE '' END)" if n == "webpage" else q(why)) for i, (n, _, _, why) in enumerate(_SIGNALS)) + " END AS reasons FROM e",
    "is_garbled": f"SELECT doc_id, length(text) >= 20 AND {n_of('text', T.FOREIGN)} > 0.3 * length(text) AS garbled FROM documents",
    "lines_explode": f"{WITH}{PLAIN} SELECT doc_id, count(*) AS lines, sum(length(x))::BIGINT AS chars, count(*) FILTER (x = '') AS blank FROM plain GROUP BY doc_id",
    "blockify": f"{WITH}{BLOCKS} SELECT doc_id, block_id, type, md5(text) AS text_md5, line_start, line_end, protected FROM blocks",
    "block_types": f"{WITH}{BLOCKS} SELECT type, count(*) AS blocks, sum(length(text))::BIGINT AS chars FROM blocks GROUP BY type",
    "heading_path": f"{WITH}{PATHS} SELECT doc_id, block_id, path FROM paths",
    "page_asof": f"{WITH}{BLOCKS}, pm AS (SELECT doc_id, i AS line, (i // 7 + 1)::INT AS page FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))), 7)) AS i FROM md)) SELECT doc_id, block_id, (SELECT max(page) FROM pm WHERE pm.doc_id = b.doc_id AND line <= line_start)::INT AS page_start, (SELECT max(page) FROM pm WHERE pm.doc_id = b.doc_id AND line <= line_end)::INT AS page_end FROM blocks b",
    "image_context_window": f"{WITH}{MD}, ml AS ({split_lines('md')}), w AS (SELECT *, coalesce(string_agg(x, chr(10)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(x, chr(10)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS b FROM ml) SELECT doc_id, i::INT AS i, regexp_extract(x, {q(T.IMAGE)}, 2) AS src, md5(concat(a, chr(10), b)) AS context_md5 FROM w WHERE {has('x', T.IMAGE)}",
    "classify_blocks": f"{WITH}{CLASSIFIED} SELECT doc_id, block_id, status, type, protected, confidence FROM classified",
    "clean_rules": f"{WITH}{CLEANED} SELECT doc_id, block_id, status, type, protected, cleaning_rule_id FROM cleaned",
    "rule_first_match": f"{WITH}{PLAIN} SELECT doc_id, i::INT AS i, rule FROM (SELECT *, {rule_case('x', 'rule_id')} AS rule FROM plain) WHERE rule IS NOT NULL",
    "cta_lines": f"{WITH}{MD}, ml AS ({split_lines('md')}) SELECT doc_id, count(*) AS lines FROM ml WHERE {terms('x', R.cta)} GROUP BY doc_id",
    "status_counts": f"{WITH}{CLEANED} SELECT doc_id, count(*) AS blocks, {', '.join(map(_COUNT, ('keep', 'discard', 'evidence', 'review', 'unclassified')))} FROM cleaned GROUP BY doc_id",
    "cleanup_measures": f"{WITH}{MEASURES} SELECT * FROM measures",
    "detail_retention": f"{WITH}{CLEANED}, d AS (SELECT doc_id, status, unnest([{_DETAIL}]) AS category FROM cleaned) SELECT doc_id, category, count(*) AS blocks, {', '.join(map(_COUNT, ('keep', 'discard', 'evidence', 'review')))} FROM d WHERE category IS NOT NULL GROUP BY doc_id, category",
    "link_retention": missing(LINK),
    "parameter_retention": missing(PARAMETER),
    "structure_counts": f"{WITH}{MD} {STRUCTURE}",
    "quality_gates": f"{WITH}{MEASURES}, {_MESSAGES} SELECT doc_id, gate, errors, warnings, status FROM gated",
    "next_actions": f"{WITH}{MEASURES}, {_MESSAGES} SELECT gate, status, count(*) AS docs FROM gated WHERE status IN ('fail', 'warn') GROUP BY ALL",
    "chunks_generic": f"{RECURSIVE}{CLEANED}, {GENERIC} {_CHUNKS}",
    "chunks_by_heading": f"{RECURSIVE}{CLEANED}, {BY_HEADING} {_CHUNKS}",
    "chunk_stats": f"{RECURSIVE}{CLEANED}, {GENERIC} SELECT doc_id, count(*) AS chunks, count(*) FILTER (length(text) < 300) AS too_short, count(*) FILTER (length(text) > 3500) AS too_long, round_even(avg(length(text)), 0)::BIGINT AS avg_chars, count(*) FILTER ({n_of('text', T.FENCE)} % 2 = 1) AS open_fences FROM chunks GROUP BY doc_id",
    "corpus_health": f"{WITH}{MEASURES}, {_MESSAGES} SELECT d.source, d.lang, count(*) AS docs, sum(m.eligible)::BIGINT AS eligible, sum(m.discarded)::BIGINT AS discarded, round(avg(m.coverage), 6)::DOUBLE AS coverage, count(*) FILTER (g.status = 'fail') AS failed, count(*) FILTER (g.status <> 'fail') AS publishable FROM measures m JOIN documents d USING (doc_id) JOIN gated g ON g.doc_id = m.doc_id AND g.gate = 'export_readiness' GROUP BY d.source, d.lang",
}
