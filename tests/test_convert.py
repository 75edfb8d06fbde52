import io
import json
import zipfile

from pyspark.sql import functions as F

from textloom.operators import convert as V


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_pages():
    html = "<html><head><title>x</title><style>p{}</style></head><nav>menu</nav><h1>Head</h1><p>One <b>two</b> <a href='/u'>link</a><p>three<br>four<ul><li>a<li>b</ul><script>var t='</p>';</script><img src=i.png alt=pic><p>same</p><p>same</p>"
    assert V.page_markdown(html).split("\n\n") == ["x", "# Head", "One two [link](/u)", "three", "four", "- a", "- b", "![pic](i.png)", "same"]
    assert V.page_markdown(None) == "" and V.page_markdown("plain") == "plain"


def test_delimited_json_subtitle_notebook():
    assert V.delimited("a, b\n1\n\n2,x|y") == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | x\\|y |"
    assert V.delimited(None) == "" and V.pretty_json("{bad ") == "{bad"
    assert V.pretty_json('{"b":1,"a":[2]}') == '```json\n{\n  "b": 1,\n  "a": [\n    2\n  ]\n}\n```'
    assert V.subtitle("WEBVTT\n\n1\n00:01 --> 00:02\n<i>Hello</i>\n\n2\n00:03 --> 00:04\n[Ann] there") == "# Transcript\n\nHello there"
    assert len(V.subtitle("\n".join(["w" * 300] * 3)).split("\n\n")) == 4
    book = {"metadata": {"kernelspec": {"language": "r"}}, "cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": "x", "outputs": [{"text": ["1\n"]}]}]}
    assert V.notebook(json.dumps(book)) == "# T\n\n```r\nx\n```\n\n## Cell 2 Output\n\n```\n1\n```"


def test_containers(spark):
    w = 'xmlns:w="urn:w"'
    docx = zipped(word__document_dot_xml=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:t>Top</w:t></w:p><w:p><w:t>a</w:t><w:t>b</w:t></w:p><w:tbl><w:tr><w:tc><w:t>x</w:t></w:tc><w:tc><w:t>y</w:t></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert V.docx(docx) == "## Top\n\nab\n\n| x | y |\n| --- | --- |"
    pptx = zipped(ppt__slides__slide2_dot_xml='<s xmlns:a="urn:a"><a:p><a:t>two</a:t></a:p></s>', ppt__slides__slide1_dot_xml='<s xmlns:a="urn:a"><a:p><a:t>one</a:t></a:p><a:p><a:t>one</a:t></a:p></s>')
    assert V.pptx(pptx) == "# Slide 1\n\none\n\n# Slide 2\n\ntwo"
    xlsx = zipped(xl__workbook_dot_xml='<w><sheets><sheet name="S"/></sheets></w>', xl__sharedStrings_dot_xml="<s><si><t>k</t></si></s>", xl__worksheets__sheet1_dot_xml='<w><row><c t="s"><v>0</v></c><c><v>5</v></c></row></w>')
    assert V.xlsx(xlsx) == "# S\n\n| k | 5 |\n| --- | --- |"
    epub = zipped(**{"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/><itemref idref="b"/><itemref idref="a"/></p>', "o/a.xhtml": "<p>A</p>", "o/b.xhtml": "<h1>B</h1>"})
    assert V.epub(epub) == "# B\n\nA"
    rows = spark.createDataFrame([("x/a.docx", docx), ("x/b.docx", b"broken"), ("c.py", b"x = 1\n"), ("d.txt", "é".encode("gbk", "ignore") or b"t"), ("e.csv", b"a,b")], "path string, content binary")
    out = {r.path: r for r in V.convert_files(rows).collect()}
    assert out["x/a.docx"].markdown.startswith("## Top") and out["x/b.docx"].error.startswith("BadZipFile") and out["c.py"].markdown == "```python\nx = 1\n```" and out["e.csv"].markdown.startswith("| a | b |")


def test_columns(spark):
    one = lambda c, text: spark.createDataFrame([(text,)], "t string").select(c(F.col("t"))).first()[0]
    fence = "`" * 3
    assert one(V.close_fence, f"a\n{fence}\nb\n") == f"a\n{fence}\nb\n{fence}" and one(V.close_fence, "a") == "a"
    assert one(V.drop_repeated_lines, "a\na\nb\na\na") == "a\nb\na"
    assert one(V.code_to_markdown, f"x\n{fence}\n") == "`" * 4 + f"\nx\n{fence}\n" + "`" * 4
    long = "this line is long enough to be wrapped here"
    assert one(V.unwrap_lines, f"{long}\nand goes on for a while\n\n# head\nshort\nlines") == f"{long} and goes on for a while\n\n# head\nshort\nlines"
    assert V.decoded("中文".encode("gbk")) == "中文" and V.decoded(b"\xff\xfe\xfd") and V.decoded(None) == ""
