"""Derived inputs for queries on files, feedback and patches, as expressions that Spark and DuckDB read alike."""

from __future__ import annotations

FILES = [
    "concat('in/', source, '/f', cast(doc_id AS string), CASE doc_id % 9 WHEN 0 THEN '.md' WHEN 1 THEN '.html' WHEN 2 THEN '.PDF' WHEN 3 THEN '.xyz' WHEN 4 THEN '.csv' WHEN 5 THEN '' WHEN 6 THEN '.srt' WHEN 7 THEN '.py' ELSE '.docx' END) AS path",
    "CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars END AS size",
]
FEEDBACK = [
    "doc_id AS id", "lang AS document_type", "CASE WHEN doc_id % 3 = 0 THEN 'protect' ELSE 'discard' END AS action", "'literal' AS match", "concat('offer ', cast(doc_id % 40 AS string)) AS pattern",
    "source", "CASE WHEN quality = 1 OR doc_id % 5 = 0 THEN 'accepted' WHEN doc_id % 7 = 0 THEN 'rejected' ELSE 'open' END AS status", "doc_id * 10 AS created_at",
]
PATCHES = [
    "event_id % 200 AS doc_id", "concat('b_', lpad(cast(event_id % 12 AS string), 6, '0')) AS block_id", "event_id AS seq", "CASE WHEN event_id % 10 = 9 THEN 'move' WHEN event_id % 10 = 8 THEN 'add' WHEN event_id % 12 = 5 THEN 'add' ELSE 'replace' END AS op",
    "CASE event_id % 6 WHEN 0 THEN 'status' WHEN 1 THEN 'reason' WHEN 2 THEN 'status' WHEN 3 THEN 'text' WHEN 4 THEN 'confidence' ELSE 'risk_tags' END AS field",
    "CASE WHEN event_id % 6 = 4 THEN cast((event_id % 15) / 10.0 AS string) WHEN event_id % 12 = 11 THEN concat('[\"', event_type, '\", \"x\"]') WHEN event_id % 6 = 5 THEN event_type ELSE CASE event_id % 7 WHEN 0 THEN 'keep' WHEN 1 THEN 'discard' WHEN 2 THEN 'review' WHEN 3 THEN 'evidence' ELSE event_type END END AS value",
]
PROPOSALS = ["doc_id AS id", "CASE doc_id % 4 WHEN 0 THEN 'e' WHEN 1 THEN 'The' WHEN 2 THEN 'en' ELSE 'xq' END AS pattern", "array(text, upper(text)) AS examples", "array(source, lang) AS counterexamples"]
HISTORY = ["doc_id AS id", "lang AS document_type", "CASE doc_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'unverified' ELSE 'passed' END AS status", "doc_id % 8 = 0 AS resolved", "n_chars % 10 AS samples", "doc_id % 100 AS created_at"]
RUNS = ["doc_id AS run", "source AS root", "n_chars % 50 AS mtime"]
#: Conversions of the files above: who converted them, and what the diagnosis had advised.
ROUTES = [
    "concat('in/', source, '/f', cast(doc_id AS string), CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' WHEN 2 THEN '.PNG' WHEN 3 THEN '' ELSE '.docx' END) AS path",
    "CASE doc_id % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'ocr_after_text_layer' WHEN 2 THEN 'text_layer' ELSE 'direct_text' END AS converter", "CASE WHEN doc_id % 2 = 0 THEN 'ocr' ELSE 'direct' END AS pipeline",
    "CASE doc_id % 3 WHEN 0 THEN 'ocr_mixed_text_image' WHEN 1 THEN 'ocr' ELSE 'text_layer' END AS strategy", "CASE WHEN doc_id % 7 = 0 THEN 'text_layer' END AS fallback_from",
]
RESULTS = ["doc_id % 13 <> 0 AS ok", "CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 0 END AS errors", "doc_id % 4 = 0 AS cached"]
#: Pages of documents: the lines of an order, with sizes, images and words.
PAGES = [
    "l_orderkey AS doc_id", "l_linenumber AS page_no", "l_quantity * 20 AS width", "CASE WHEN l_orderkey % 3 = 0 THEN 400.0 ELSE 1100.0 END AS height",
    "CASE WHEN l_returnflag = 'R' THEN ' ' WHEN l_orderkey % 11 = 0 THEN repeat('鐩绔 ', cast(l_quantity AS int)) WHEN l_orderkey % 7 = 0 THEN repeat('中文 ok ', cast(l_quantity AS int)) ELSE repeat('some words ', cast(l_quantity AS int) * 3) END AS text",
    "(l_linenumber + l_orderkey) % 3 AS n_images",
]
#: What a text is given that shows everything that normalisation repairs.
DAMAGED = "concat(text, chr(10), chr(10), 'All in Al: AlAl编程 and A时代A工具 by Google Al Studio, YouTubeAl AIlinAI', chr(10), '<TABLE><tr><th>a</th><td> b', chr(10), 'c </td></tr><tr><td>1</td></tr><tr></tr></TABLE><table></table>', chr(10), '![x', chr(92), 'y](a', chr(92), 'b.png)', CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), '  ', repeat(chr(96), 3), chr(10), 'open') ELSE '' END)"
#: Links of images of every kind, behind a text.
LINKED = "concat(text, chr(10), '![a](images/one.png) ![b](<sub/../two.JPG>) ![c](../out.png) ![d](https://x.org/e.png) ![e](note.txt) ![f](three%20x.png \"title\") ![[four.svg|200]] ![[page]] ![g](images/', cast(doc_id % 5 AS string), '.gif)')"
LOOPS = ["doc_id", "cast(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 3 END AS bigint) AS errors", "CASE WHEN doc_id % 7 <> 0 THEN cast(doc_id % 6 - 1 AS int) END AS iteration", "CASE WHEN doc_id % 8 <> 0 THEN cast(doc_id % 4 AS int) END AS max_iterations"]
CHOICES = ["doc_id AS id", "CASE doc_id % 5 WHEN 0 THEN 'reject' WHEN 4 THEN 'other' ELSE 'accept' END AS choice"]
SCOPED = ["doc_id AS id", "CASE WHEN doc_id % 3 = 0 THEN 'protect' ELSE 'discard' END AS action", "'literal' AS match", "concat('p', cast(doc_id % 60 AS string)) AS pattern", "concat('weekly-report-', cast(doc_id % 9 AS string), '.md') AS source", "CASE WHEN doc_id % 60 < 20 THEN 'example.org' WHEN doc_id % 60 < 40 THEN concat('h', cast(doc_id % 7 AS string), '.net') ELSE '' END AS domain"]
