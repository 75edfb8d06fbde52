import random

from pyspark.sql import functions as F

from textloom.operators import blocks as B
from textloom.operators import classify as C
from textloom.operators import feedback as K
from textloom.operators import pack as P
from textloom.plans.prepare import prepare
from textloom.rules import CleaningRule, RuleSet, load_rules
from textloom.streaming import stream


def plain_packs(items, opens, between=2):
    out, cur, no = [], 0, 0
    for item in items:
        if cur == 0 or opens(cur, item):
            cur, no = item[0], no + 1
        else:
            cur += between + item[0]
        out.append(no)
    return out


def test_packers_equal_a_plain_fold(spark):
    pick = random.Random(1)
    rows = [(d, i, "b", pick.choice(["paragraph", "section_heading", "code"]), "x" * pick.choice([5, 80, 400, 1300, 3600]), "keep") for d in range(40) for i in range(pick.randint(1, 60))]
    df = spark.createDataFrame(rows, "doc_id long, ord int, block_id string, type string, text string, status string")
    rules = (
        (P.chunks_generic, lambda cur, x: cur + 2 + x[0] > 1200, 2),
        (P.chunks_by_heading, lambda cur, x: (cur >= 300 and (x[1] or cur + 2 + x[0] > 3500)) or cur >= 1200, 2),
        (P.parts, lambda cur, x: cur >= 6000 and (x[1] or cur + x[0] > 18000), 0),
    )
    for f, opens, between in rules:
        found = {(r.doc_id, r.ord): r.no for r in f(df).collect()}
        for d in range(40):
            own = [r for r in rows if r[0] == d]
            if f is P.parts and sum(len(r[4]) for r in own) < 12000:
                assert not any(k[0] == d for k in found)
                continue
            assert [found[d, r[1]] for r in own] == plain_packs([(len(r[4]), r[3] == "section_heading") for r in own], opens, between)


def test_rules(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"rule_id": "u1", "action": "discard", "match": "literal", "pattern": "Buy Now", "source": "user"}, {"rule_id": "again", "action": "discard", "match": "literal", "pattern": "SUBSCRIBE TODAY"}]')
    rules = load_rules([str(tmp_path / "r.json"), str(tmp_path / "missing.json")])
    assert len(rules.rules) == len(RuleSet().rules) + 1
    df = spark.createDataFrame([("buy now, a method",), ("a method: subscribe today",), ("license: buy now",), ("plain",)], "t string")
    assert [r[0] for r in df.select(rules.first_rule(F.col("t"))).collect()] == ["u1", None, "keep-licence", None]
    assert CleaningRule("", "drop", "regex", "(").problems()


def test_promotional_lines_leave_their_block(spark):
    df = spark.createDataFrame([(1, "first\nLimited-time offer!\n\nlast"), (2, "limited time offer\nsubscribe today")], "doc_id long, text string")
    rows = {r.block_id + str(r.doc_id): r for r in C.split_promo(C.classify(B.blockify(df))).collect()}
    assert rows["b_0000001"].text == "first" and rows["b_000000_promo_0011"].status == "discard" and rows["b_0000002"].status == "discard"
    assert len(rows) == 6


def test_as_of_pages(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 5, 12), (2, 0, 3, 3)], "doc_id long, ord int, line_start int, line_end int")
    pages = spark.createDataFrame([(1, 2, 1), (1, 5, 2), (1, 10, 3)], "doc_id long, line int, page int")
    assert [(r.page_start, r.page_end) for r in B.with_pages(blocks, pages).orderBy("doc_id", "ord").collect()] == [(None, 1), (2, 3), (None, None)]


def test_sources(spark):
    urls = spark.createDataFrame([("https://WWW.Example.com:8080/a/b?x=1",), ("http://news.example.com/",), ("http://badexample.com/a/bc",), ("no url",)], "u string")
    assert [r[0] for r in urls.select(K.source_domain(F.col("u"))).collect()] == ["example.com:8080", "news.example.com", "badexample.com", ""]
    assert [r[0] for r in urls.select(K.source_matches(F.col("u"), "source_domain:example.com")).collect()] == [False, True, False, False]
    assert [r[0] for r in urls.select(K.source_matches(F.col("u"), "http://badexample.com/a/b")).collect()] == [False] * 4


def test_prepare_and_stream_agree(spark, tmp_path):
    docs = [(i, f"# Title {i}\n\ntext number {i}\n\nSubscribe today\n\n1. step") for i in range(20)] + [(20, None), (21, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    done = prepare(df)
    assert done.chunks.count() == 20 and done.gates.where("gate = 'export_readiness'").count() == 20
    assert "Subscribe" not in done.cleaned.first().markdown and done.diagnosis.count() == 22
    stream.prepare_stream(stream.documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    key = lambda x: sorted(map(str, x.select("doc_id", "gate", "status").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out/gates"))) == key(done.gates)


def test_titles(spark):
    from textloom.operators.titles import best_title

    texts = ["Contents\n\nThe long way home. It was late;\n# Field Guide | draft", "目录\n\n创始人行动手册", None, "1234\nab", "Some words here!"]
    rows = best_title(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.title, r.score) for r in rows] == [("Field Guide | draft", 112), ("创始人行动手册", 133), (None, 0), (None, 0), ("Some words here!", 60)]


def test_delimited_files_are_read_whole(spark):
    from textloom.plans.queries import QUERIES

    plan = QUERIES["delimited_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "substr" not in plan.lower()
