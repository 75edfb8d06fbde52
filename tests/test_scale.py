"""What must hold for work to grow no faster than the tables: texts are read once, and shortcuts change no result."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import measures as M
from textloom.functions import text as T
from textloom.operators import blocks as B
from textloom.operators import classify as C
from textloom.operators import curate as U
from textloom.operators import diagnose as D
from textloom.operators import feedback as K
from textloom.operators import normalize as N
from textloom.operators import pack as P
from textloom.operators import quality as Q
from textloom.operators import render as R
from textloom.operators import review as W
from textloom.plans.prepare import prepare
from textloom.plans.queries import cleaned
from textloom.plans.queries_more import MORE
from textloom.rules import RuleSet

DOCS = [(1, "# Title\n\nplain words here\n\n| a | b |\n| - | - |\n\n1. step one\n\nsign up now"), (2, "```\ncode"), (3, None)]


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_does_not_classify_again(spark):
    blocks = C.apply_rules(C.classify(B.blockify(spark.createDataFrame(DOCS, "doc_id long, text string"))))
    filters = [x for x in optimized(blocks.where("status = 'keep'")).split("\n") if re.search(r"\bFilter\b", x)]
    assert filters and not [x for x in filters if "RLIKE" in x.upper() or "contains" in x.lower()]
    filters = [x for x in optimized(Q.lost_details(blocks)).split("\n") if re.search(r"\bFilter\b", x)]
    assert filters and not [x for x in filters if "RLIKE" in x.upper()]


def test_blocks_sort_documents_and_no_lines(spark):
    plan = B.blockify(spark.createDataFrame(DOCS, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 1 and plan.count("Exchange") == 1


PATTERNS = [p for _, p in C.DETAILS] + [T.anycase(p) for p in (r"limited[- ]time offer", r"[a-z0-9.]+@[a-z0-9.]+", r"^prompt:", r"scan|kick", r"(a|b)+x?y{2}", r"[k]iss", r"\bqr[ _-]*code", r"a(?=bc)", r"[a[b]]", r"x{0,2}abc|z")]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_found_is_rlike(spark, pattern):
    r = random.Random(pattern)
    parts = ["Limited-Time offer", "limited time OFFER", "a.b@c", "@", "PROMPT:", "prompt", "Kick", "ſcan", "sCAN", "ab", "YY", "kiſs", "KISS", "QR__code", "qr code", "abc", "a", "z", "工具", "temperature=1", "=", "| a |", "<TABLE>", "12%", "http://x", "www.x", " ", "\n", "İ", "ı", "Tool", "`x`", "1. a", "step 2: b"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 6)))) for k in range(400)] + [(400, None)]
    c = F.col("t")
    df = spark.createDataFrame(rows, "k int, t string").select("k", "t", T.found(c, pattern).alias("a"), T.found(c, pattern, F.lower(c)).alias("b"), c.rlike(pattern).alias("wanted"))
    assert not df.where("not (a <=> wanted) or not (b <=> wanted)").collect()


def test_strip_and_at_most(spark):
    r = random.Random(3)
    chars = [*T.SPACES, "a", "b", "​", "᠎", "中", "\n", "\r", "\U0001f600"]
    rows = [(k, "".join(r.choice(chars) for _ in range(r.randint(0, 9)))) for k in range(600)] + [(600, None)]
    c = F.col("t")
    slow = F.regexp_replace(c, f"^[{T.SPACE}]+|[{T.SPACE}]+$", "")
    few = F.length(F.regexp_replace(c, f"[{T.SPACE}]+", "")) <= 2
    assert not spark.createDataFrame(rows, "k int, t string").where(~T.strip(c).eqNullSafe(slow) | ~T.at_most(c, 2).eqNullSafe(few)).collect()


def test_rule_of_a_place(spark):
    df = spark.createDataFrame([("subscribe today",), ("a licence, license",), ("x",), ("me@x.org",), (None,)], "t string")
    got = [tuple(x) for x in df.select(*[RuleSet().first_rule(F.col("t"), n) for n in ("rule_id", "action")]).collect()]
    assert got == [("drop-subscribe", "discard"), ("keep-licence", "protect"), (None, None), ("check-contact", "review"), (None, None)]


def test_samples_are_looked_for_once(spark):
    rows = spark.createDataFrame([(1, "discard", "En"), (2, "protect", "a b"), (3, "review", "x")], "doc_id long, action string, pattern string")
    texts = spark.createDataFrame([(1, "case En one\nEn", "# En  two\nen TWO\n", "- EN"), (2, "a  b", "A\tb c", None), (3, "none", None, "")], "doc_id long, cleaned string, discarded string, review_needed string")
    found = K.with_samples(rows, texts)
    got = {r.doc_id: (r.examples, r.counterexamples) for r in found.collect()}
    assert got == {1: (["En two", "EN"], []), 2: (["A b c", "a b"], []), 3: (["x"], [])}
    plan = optimized(found)  # the lists of samples stand in the plan once each, and what makes them distinct reads those
    assert sum("Generate inline" in x for x in plan.split("\n")) == 1


def test_measures_are_those_of_the_patterns(spark):
    r = random.Random(5)
    parts = ["plain Words 12?", "_" * 14, "_" * 15, "\x07" * 16, "中文", "鐩", "鐩绔", "鈥", "绮鹃€", "绯荤粺", "é" * 20, "�", "\U00020000", "\x85", "　", "，", "\U0001f600" * 15, "", "a_b", "\n"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 7)))) for k in range(1500)]
    t = F.col("t")
    df = spark.createDataFrame(rows, "k int, t string")
    slow = {**{n: T.count(t, p) for n, p in M.CLASSES.items()}, "garbled_chars": T.matched_chars(t, T.GARBLED), "mojibake_run": T.matched_chars(t, T.MOJIBAKE), "mojibake_token": T.matched_chars(t, T.MOJIBAKE_TOKEN)}
    wanted = sorted(tuple(x) for x in df.select("k", *[slow[n].alias(n) for n in M.COUNTS]).collect())
    assert sorted(tuple(x) for x in M.measured(df, "t").select("k", *M.COUNTS).collect()) == wanted


def test_pages_and_texts_are_counted_in_one_pass(spark):
    pages = spark.createDataFrame([(1, 1, 1.0, 2.0, "some words", 0)], "doc_id long, page_no int, width double, height double, text string, n_images int")
    assert "regexp" not in optimized(D.page_stats(pages)).lower()
    assert D.text_quality(spark.createDataFrame([(1, "Al？", "en")], "doc_id long, text string, lang string"), also=("lang", "alnum")).select("lang", "alnum", "total_chars").collect() == [("en", 2, 3)]


def test_each_rule_parts_a_text_once(spark):
    docs = spark.createDataFrame([(1, "All in Al and All in Al, AlAl编程\n<table><tr><td>Google Al Studio</td></tr></table>")], "doc_id long, text string")
    log = N.fix_log(docs)
    assert optimized(log).count("split(") <= 8
    assert [(r.rule_no, r.line_id) for r in log.orderBy("rule_no", "line_id").collect()] == [(0, "l_0"), (0, "l_14"), (1, "l_27"), (4, "l_34")]


def test_curation_makes_blocks_once(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    plan = optimized(U.curate(C.classify(B.with_heading_path(B.blockify(docs)))))
    assert plan.count("MapInArrow") == 1 and not re.search(r"(?m)^[ :+-]*Join ", plan)


def test_contents_are_passed_once():
    row = {**dict.fromkeys(U.READ, False), "status": "keep"}
    heading, toc = {**row, "heading": True}, {**row, "toc": True}
    began = time.process_time()
    assert U.verdicts([row, *[heading] * 5, *[toc] * 20_000]) == [None, *["toc_heading"] * 5, *["toc"] * 20_000]
    assert time.process_time() - began < 5
    assert U.verdicts([heading, row, toc, heading, toc, row, *[heading] * 4, toc]) == [None, None, "toc", "toc_heading", "toc", None, None, *["toc_heading"] * 3, "toc"]


def test_tags_of_many_patches(spark):
    blocks = spark.createDataFrame([(1, k, f"b_{k}", "plain", "paragraph", False, "keep", ["old"]) for k in range(4)], "doc_id long, ord int, block_id string, text string, type string, protected boolean, status string, risk_tags array<string>")
    n = 40_000  # a list that grew by one tag a step took n * n / 2 copies
    many = spark.range(n).selectExpr("1L as doc_id", "'b_0' as block_id", "id as seq", "'add' as op", "'risk_tags' as field", "cast(id as string) as value")
    few = [(1, "b_1", 5, "replace", '["a", "b"]'), (1, "b_1", 4, "add", "x"), (1, "b_1", 5, "add", "y"), (1, "b_1", 7, "add", "d"), (1, "b_1", 6, "add", "c"), (1, "b_1", 3, "replace", '["z"]'), (1, "b_2", 1, "replace", "[]")]
    ops = many.unionByName(spark.createDataFrame(few, "doc_id long, block_id string, seq long, op string, value string").withColumn("field", F.lit("risk_tags")))
    began = time.time()
    got = {r.block_id: r.risk_tags for r in W.apply_patch(blocks, ops).collect()}
    assert time.time() - began < 20
    assert got == {"b_0": ["old", *map(str, range(n))], "b_1": ["a", "b", "c", "d"], "b_2": [], "b_3": ["old"]}


@pytest.mark.parametrize("packer", [P.chunks_generic, P.chunks_by_heading, P.chunks_by_page])
def test_measures_of_chunks_need_no_chunks(spark, packer):
    r = random.Random(7)
    texts = lambda: r.choice(["```a", "x" * r.randint(1, 1500), "é" * 1300, "``` ```", "y" * 4000, "", "# h"])
    rows = [(d, k, f"b_{k}", texts(), r.choice(["paragraph", "section_heading"]), r.choice(["keep", "keep", "discard"]), False, r.choice([None, "", "own ```"]), r.choice([None, k // 3])) for d in range(60) for k in range(r.randint(1, 12))]
    blocks = spark.createDataFrame([*rows, (99, 0, "b_0", "gone", "paragraph", "discard", True, None, None)], "doc_id long, ord int, block_id string, text string, type string, status string, protected boolean, curated_text string, page_start int").withColumn("page_end", F.col("page_start"))
    apart = Q.cleanup_measures(blocks).join(P.chunk_stats(P.assemble(blocks, packer(blocks))), "doc_id", "left")
    got = Q.cleanup_measures(blocks, packer)
    assert got.columns == apart.columns and sorted(map(str, got.collect())) == sorted(map(str, apart.collect()))


def test_gates_make_blocks_once(spark):
    assert optimized(prepare(spark.createDataFrame(DOCS, "doc_id long, text string")).gates).count("MapInArrow") == 1


NOTES = [(1, "before any\n\n# How to\n\none\n\nsubscribe today\n\n## Why\n\ntwo\n\n# Steps: a Guide\n\nthree"), (2, "# Idea\n\n# Case\n\nx\n\n# Case\n\ny"), (3, "subscribe today"), (4, None), (5, "-\n # Odd\n\n# Other thing\n\nz")]


def noted(spark):
    return C.apply_rules(C.classify(B.blockify(spark.createDataFrame(NOTES, "doc_id long, text string"))))


def test_source_map_makes_blocks_once(spark):
    blocks = noted(spark)
    found = R.source_map(blocks)
    assert optimized(found).count("MapInArrow") == 1
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(found) == rows(R.source_map(blocks, R.sections(blocks))) and found.count() > 10


def test_index_page_makes_blocks_once(spark):
    blocks = noted(spark)
    found = R.index_page(None, blocks)
    assert optimized(found).count("MapInArrow") == 1
    rows = dict(map(tuple, found.collect()))
    assert rows == dict(map(tuple, R.index_page(R.sections(blocks), blocks).collect())) and "## case" in rows[2] and 3 in rows


def test_promotional_lines_make_blocks_once(spark):
    text = "one\nLimited-time offer now\ntwo\nsubscribe today\n\nLimited-time offer\nsubscribe today\n\nplain"
    found = C.split_promo(C.classify(B.blockify(spark.createDataFrame([(1, text)], "doc_id long, text string"))))
    assert optimized(found).count("MapInArrow") == 1
    rows = [(r.ord, r.sub_ord, r.text) for r in found.orderBy("ord", "sub_ord").collect()]
    assert rows[:3] == [(0, 0, "one\ntwo"), (0, 1, "Limited-time offer now"), (0, 2, "subscribe today")] and len(rows) == 7


def test_publishable_makes_blocks_once(spark):
    sf = "/root/testdata/sf0.001"
    found, rows = MORE["publishable"](spark, sf), cleaned(spark, sf)
    assert optimized(found).count("MapInArrow") == 1
    joined = R.publishable(R.cleaned_markdown(rows), Q.gates(Q.with_messages(Q.cleanup_measures(rows)))).select("doc_id", "blocks")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joined.collect()))
