import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textloom import rules as Y
from textloom.operators import blocks as B
from textloom.operators import classify as C
from textloom.operators import convert as V
from textloom.operators import curate as U
from textloom.operators import images as I
from textloom.operators import normalize as M
from textloom.operators import pack as P
from textloom.operators import render as R
from textloom.operators import review as W
from textloom.sources import tables as S
from textloom.streaming import stream


def column(spark, c, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(c(F.col("t"))).collect()]


def test_patterns_keep_their_classes_and_their_engine_validates_them(spark):
    rule = lambda p: Y.CleaningRule("r", "discard", "regex", p, "why")
    assert column(spark, rule(r"\S+@\S+").hits, "a@b", "a @ b") == [True, False]
    assert column(spark, rule(r"^\D\B").hits, "Ab", "1b", "a") == [True, False, False]
    assert column(spark, rule(r"\p{Lu}x").hits, "ÄX", "1x") == [True, False]
    assert rule(r"(?P<x>a)b").problems() and rule("(").problems() and not rule(r"(?<x>a)\p{L}").problems()


def test_layers_of_dictionaries(spark, tmp_path):
    def put(name, rules=(), **sets):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"schema": "x.cleaning_rules.v1", "rules": list(rules), "keyword_sets": sets}))

    line = lambda i, pattern, action="discard": {"id": i, "type": "promotional_line", "action": action, "match": "literal", "pattern": pattern, "reason": "r", "risk_tag": "promotional_line"}
    put("base/obvious_noise.json", [line("b1", "Buy now"), {"type": "other"}], cta_keywords=["Join Us", "join us"], knowledge_terms=["lesson"], evidence_patterns=[{"label": "claim", "pattern": "earned"}])
    put("document_types/report.json", [line("d1", "BUY NOW"), line("d2", "figure sale")], cta_keywords=["call us"])
    put("templates/self_media_course.json", [line("t1", "follow me")], cta_keywords=["CALL US", "like it"])
    (tmp_path / "user").mkdir()
    accepted = [{"id": "p1", "status": "accepted", "action": "protect", "match": "literal", "pattern": "keep me", "scope": "user"}, {"id": "p2", "status": "rejected", "action": "discard", "pattern": "x", "scope": "user"}]
    accepted += [{"id": "p3", "status": "accepted", "action": "discard", "pattern": "only reports", "scope": "document_type", "document_type": "report"}, {"id": "p4", "status": "accepted", "action": "discard", "pattern": "zz", "scope": "source_pattern", "source_pattern": "source_domain:a.org"}]
    (tmp_path / "user/accepted_rules.jsonl").write_text("\n".join(map(json.dumps, accepted)))
    base = Y.load_layers(str(tmp_path))
    assert [r.rule_id for r in base.rules] == ["b1", "p1"] and base.cta == ("Join Us",) and base.knowledge == ("lesson",) and base.evidence == (("claim", "earned"),)
    full = Y.load_layers(str(tmp_path), "curated_obsidian_kb", "report", identity='{"source_url": "http://x", "meta": {"source_domain": "WWW2.A.org"}}')
    assert [r.rule_id for r in full.rules] == ["b1", "d2", "t1", "p1", "p3", "p4"] and full.cta == ("Join Us", "call us", "like it")
    assert column(spark, full.first_rule, "keep me: buy now", "a lesson: only reports", "a lesson: buy now", "buy now") == ["p1", "p3", None, "b1"]
    put("base/obvious_noise.json", [{**line("b1", "("), "match": "regex"}])
    with pytest.raises(ValueError, match=r"rules\[0\]"):
        Y.load_layers(str(tmp_path))


def test_source_patterns():
    name = json.dumps({"input_path": "/data/Weekly_report/week-3 (draft).md", "meta": {"source_url": "https://A.org/x/y?z"}})
    wanted = {"weekly": True, "week": True, "wee": False, "report": False, "source_url:https://a.org/x": True, "source_url:https://a.org/x/y": True, "https://a.org/x/": False, "input_path:week": True, "site_name:week": False, "": False}
    assert {p: Y.source_pattern_matches(p, name) for p in wanted} == wanted
    assert Y.source_pattern_matches("source_domain:a.org", '{"source_domain": "b.a.org"}') and not Y.source_pattern_matches("source_domain:a.org", '{"source_domain": "ba.org"}')


def test_documents_without_an_id_of_their_own_are_refused(spark):
    for rows in ([(None, "# A")], [(1, "a"), (1, "b")]):
        with pytest.raises(PySparkException, match="need an id each"):
            B.blockify(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_broken_input_is_a_value(spark):
    deep = "[" * 100_000
    assert V.pretty_json(deep) == deep and V.pretty_json('"```"').startswith("````json") and V.pretty_json(None) == ""
    assert len(V.delimited(f'"{"x" * 200_000}",b')) > 200_000 and V.delimited("a,b\r1,2\r\n3,4").count("\n") == 3 and V.delimited('a"b\n"c') != ""
    assert V.page_markdown("<![foo bar") == "<![foo bar" and V.page_markdown('<a href="/x"></a>') == "[/x](/x)" and V.page_markdown("<img alt=q>") == ""
    assert V.notebook("[1, 2]") == "[1, 2]" and V.notebook('{"metadata": null, "cells": [3, {"cell_type": "code", "source": "x", "outputs": [1, {"data": null}]}]}') == "```python\nx\n```"
    files = spark.createDataFrame([(None, b"x"), ("a.json", None), ("b.rb", b"puts 1\n"), ("c.json", deep.encode())], "path string, content binary")
    out = {r.path: (r.markdown, r.error) for r in V.convert_files(files).collect()}
    assert out["a.json"][1] == "no content" and out["b.rb"][0] == "```ruby\nputs 1\n```" and out[None][0] == "x" and out["c.json"] == (deep, None)
    assert V.standalone_svg("<p>no</p>") == "<p>no</p>" and V.dispatched("<p>x", rich=lambda h: "rich") == "rich" and V.dispatched(None) == ""


def test_normalisation(spark):
    fence = "`" * 3
    text = f"All in Al\nAl工具 and A时代\n<table><tr><td>a|b</td><th> c\nd</th></tr><tr><td>1</td></tr></table>\n![k\\m](x\\y.png)\n{fence}\nopen"
    row = M.normalize(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0].text == f"All in AI\nAI工具 and AI时代\n| a|b | c d |\n| --- | --- | --- |\n| 1 |\n![k\\m](x/y.png)\n{fence}\nopen\n{fence}"
    assert (row[0].ocr_fixes, row[0].table_fixes, row[0].code_fixes, row[0].image_fixes, row[0].total_fixes) == (3, 1, 1, 1, 6) and row[1].text == ""
    log = M.fix_log(spark.createDataFrame([(1, "Al工具 Al工具")], "doc_id long, text string")).collect()
    assert [(r.line_id, r.before, r.after) for r in log] == [("l_0", "Al", "AI"), ("l_5", "Al", "AI")]


def test_images_are_judged_by_their_surroundings(spark):
    texts = ["# Maths\n\nthe sqrt curve\n\n![c](a.png)\n\nand a proofreader", "join: scan the code\n\n![c](a.png)", "our revenue grew\n\n![c](a.png)", "# Settings guide\n\n![c](a.png)", "x\n\n![c](a.png)"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = I.classify_images(B.with_heading_path(C.classify(B.blockify(docs))), I.contexts(docs)).where("image_type is not null").orderBy("doc_id").collect()
    assert [(r.status, r.image_type) for r in rows] == [("review", "unknown_image"), ("discard", "qr_image"), ("evidence", "proof_screenshot"), ("keep", "operation_screenshot"), ("review", "unknown_image")]
    assert column(spark, I.valid_svg, "<svg viewBox='0 0 1 1'>", "<svg width='1'>", "<SVG width='1' height=\"2\" >", None) == [True, False, True, False]


def test_patches_pass_their_guards(spark):
    docs = spark.createDataFrame([(1, "plain words here\n\n1. do this\n\nanother plain one\n\nset seed=5 now")], "doc_id long, text string")
    blocks = C.apply_rules(C.classify(B.blockify(docs)))
    ops = [("b_000000", "replace", "status", "discard"), ("b_000000", "add", "risk_tags", "late"), ("b_000000", "replace", "risk_tags", '["a", "b"]'), ("b_000000", "add", "risk_tags", "c"), ("b_000001", "replace", "status", "discard")]
    ops += [("b_000002", "replace", "confidence", "0.25"), ("b_000002", "replace", "confidence", "2"), ("b_000003", "replace", "status", "discard"), ("b_000009", "replace", "status", "keep"), ("b_000002", "move", "reason", "x"), ("b_000002", "replace", "text", "x")]
    patch = spark.createDataFrame([(1, b, i, o, f, v) for i, (b, o, f, v) in enumerate(ops)], "doc_id long, block_id string, seq long, op string, field string, value string")
    found = {r.seq: r.rejected for r in W.validate_patch(patch, blocks).collect()}
    assert [found[i] for i in range(len(ops))] == [None, None, None, None, "detail", None, "confidence", "detail", "unknown_block", "op", "field"]
    out = {r.block_id: r for r in W.apply_patch(blocks, patch).collect()}
    assert out["b_000000"].status == "discard" and out["b_000000"].risk_tags == ["a", "b", "c"] and out["b_000002"].confidence == 0.25 and not out["b_000001"].patched
    assert W.json_patch('see [1]\n```json\n[{"op": "a", "path": "b"}]\n```') == '[{"op": "a", "path": "b"}]' and W.json_patch("[" * 5000) is None and W.json_patch(None) is None


def test_curation(spark):
    text = "\n\n".join(["# Title", "@someone", "Author: me, see [me](http://x)", "Intro\n\n## Part", "@handle", "Chapter 2\nBig Idea\n17", "Chapter 2\nBig Idea starts here!\nmore\n18", "====== Chapter 3 ======", "<!-- page: 4 -->", "### Contents", "One thing: here   3\nOther thing: there   9", "### Bob: A lesson", "About the author", "Biography: a method of steps", "### Closing words", "to all of you"])
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id long, text string")
    rows = U.curate(C.classify(B.with_heading_path(B.blockify(docs)))).where("doc_id = 1").orderBy("ord").collect()
    got = {r.text.split("\n")[0] if not r.text.startswith("Chapter 2\nBig Idea starts") else "body": (r.status, r.type) for r in rows}
    assert got["# Title"][0] == "keep" and got["@someone"] == ("discard", "author_identity") and got["Author: me, see [me](http://x)"] == ("discard", "author_profile_links")
    assert got["@handle"] == ("discard", "author_identity") and got["Chapter 2"] == ("discard", "slide_chapter_divider") and got["====== Chapter 3 ======"][1] == "layout_separator" and got["<!-- page: 4 -->"][1] == "page_marker"
    assert got["One thing: here   3"][1] == "toc" and got["### Contents"][1] == "toc_heading" and got["About the author"][1] == "author_intro" and got["Biography: a method of steps"] == ("review", "author_intro_review")
    assert got["### Closing words"][1] == "marketing_wrapper" and got["to all of you"][1] == "marketing_wrapper"
    curated = {r.text.split("\n")[0]: r.curated_text for r in rows if r.curated_text}
    assert curated["### Bob: A lesson"] == "### A lesson" and curated["Chapter 2"] == "## Big Idea\n\nstarts here!\nmore"


def test_chunks_carry_headings_and_pages(spark):
    rows = [(1, i, f"b_{i}", "section_heading" if i in (0, 3) else "paragraph", "x" * n, "keep", ["H"] if i < 3 else ["H", "K"], i, i + 1) for i, n in enumerate([5, 400, 300, 10, 1300, 20])]
    df = spark.createDataFrame(rows, "doc_id long, ord int, block_id string, type string, text string, status string, heading_path array<string>, page_start int, page_end int")
    chunks, warnings = P.dispatch(df, "pdf_like")
    assert [(r.heading_path, r.page_start, r.page_end, len(r.block_ids)) for r in chunks.orderBy("chunk_id").collect()] == [([], 0, 3, 3), (["H", "K"], 3, 5, 2), ([], 5, 6, 1)] and warnings == []
    generic, warnings = P.dispatch(df)
    assert warnings == [P.GENERIC_WARNING] and all(r.heading_path for r in generic.collect())
    paged, _ = P.dispatch(df, "pdf_like", "preserve_slide_or_page_order")
    assert paged.count() == 6 and paged.first().split_strategy == "preserve_slide_or_page_order"


def test_comments_scans_and_publishing(spark, tmp_path):
    one = spark.createDataFrame([(1, 0, "b_0", "footer", "a -- b", "discard", 0.5, "x--y\nz", 1, 2, ["A \"q\""], ["t"])], "doc_id long, ord int, block_id string, type string, text string, status string, confidence double, reason string, page_start int, page_end int, heading_path array<string>, risk_tags array<string>")
    assert R.by_status(one, "discard").first().markdown == '<!-- [b_0] type=footer page=1-2 heading=["A \\"q\\""] risk_tags=["t"] confidence=0.50 reason=x- -y z -->\na -- b\n'
    gates = spark.createDataFrame([(1, "export_readiness", "pass"), (2, "export_readiness", "fail")], "doc_id long, gate string, status string")
    rendered = spark.createDataFrame([(1, "a"), (2, "b"), (3, "no gate")], "doc_id long, markdown string")
    for _ in range(2):
        R.write_published(rendered, gates, str(tmp_path / "out"), "one")
    R.write_published(rendered.where("doc_id = 1"), gates, str(tmp_path / "out"), "two")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    for name in ("in/b.md", "in/A.md", "in/.git/x.md", "in/Node_Modules/y.md", "in/c/.hidden"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = S.scan_files(spark, str(tmp_path / "in")).orderBy("place").collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["A.md", "b.md"]  # hidden files are none to the engine
    assert [r.action for r in S.inventory(spark.createDataFrame([("in/c/.hidden", 1), ("x.MP3", 1), ("y.doc", 1)], "path string, size long")).collect()] == ["skip"] * 3


def test_first_copies_of_a_stream(spark, tmp_path):
    rows = spark.range(20).selectExpr("id", "concat('t', cast(id % 4 as string)) as text", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,cast(id as int)) as ts")
    rows.write.parquet(str(tmp_path / "in"))
    seen = stream.first_copies(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts")
    seen.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_packing_reads_blocks_once(spark):
    docs = spark.createDataFrame([(i, "# H\n\n" + "words " * random.Random(i).randint(10, 900)) for i in range(5)], "doc_id long, text string")
    blocks = C.classify(B.blockify(docs))
    plan = P.assemble(blocks, P.chunks_generic(blocks))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "MergeJoin" not in plan and "HashJoin" not in plan
    pages = spark.createDataFrame([(0, 0, 1)], "doc_id long, line int, page int")
    plan = B.with_pages(blocks, pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "MergeJoin" not in plan and "HashJoin" not in plan
