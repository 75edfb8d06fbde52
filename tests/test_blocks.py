"""Blocks by set-wise windows, held against a scanner that reads one line after the other."""

import random
import re

from textloom.operators import blocks as B

IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)")
FENCE = "`" * 3


def scan(text):
    """(type, text, first line, last line) of each block, by the seven rules in their order."""
    rows, out, run = text.split("\n"), [], []

    def flush():
        if run:
            body = "\n".join(rows[run[0] : run[-1] + 1]).strip()
            kind = "table" if body.startswith("|") else "section_heading" if re.match(r"#{1,6}\s+.", body) else "operation_step" if re.match(r"(\d+[.)]\s+|step\s*\d+[:.)\-\s]+)", body, re.I) else "paragraph"
            out.append((kind, body, run[0], run[-1]))
            run.clear()

    i, n = 0, len(rows)
    while i < n:
        s = rows[i].strip()
        if not s:
            flush()
        elif re.match(r"#{1,6}\s+.", rows[i]):
            flush()
            out.append(("section_heading", s, i, i))
        elif s.startswith(FENCE):
            flush()
            j = i + 1
            while j < n and not rows[j].strip().startswith(FENCE):
                j += 1
            out.append(("code", "\n".join(rows[i : j + 1]).strip(), i, j))
            i = j
        elif s.startswith("|") and "|" in s[1:] and i + 1 < n and rows[i + 1].strip().startswith("|"):
            j = i + 1
            while j < n and rows[j].strip().startswith("|"):
                j += 1
            flush()
            out.append(("table", "\n".join(rows[i:j]).strip(), i, j - 1))
            i = j - 1
        elif IMAGE.search(s) and len(s) < 200:
            flush()
            out.append(("image_evidence", s, i, i))
        elif s.startswith(">"):
            flush()
            j = i + 1
            while j < n and (rows[j].strip().startswith(">") or (not rows[j].strip() and rows[j - 1].strip().startswith(">") and (j + 1 == n or rows[j + 1].strip().startswith(">")))):
                j += 1
            out.append(("quote", "\n".join(rows[i:j]).strip(), i, j - 1))
            i = j - 1
        else:
            run.append(i)
        i += 1
    flush()
    return out


def test_blocks_equal_a_scanner(spark):
    pick = random.Random(3)
    some = ["", "", " ", "plain", "more text", "# Head", "## Sub head", "#no", FENCE, FENCE + "py", "| a | b |", "| - | - |", "|x", "![a](b.png)", "> said", "> ![q](r.png)", "1. first", "Step 2: go", " # indented"]
    texts = ["\n".join(pick.choice(some) for _ in range(pick.randint(0, 14))) for _ in range(1500)] + ["", "\n\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in B.blockify(df).orderBy("doc_id", "ord").collect():
        found.setdefault(r.doc_id, []).append((r.type, r.text, r.line_start, r.line_end))
    for d, text in enumerate(texts):
        assert found.get(d, []) == scan(text or ""), repr(text)


def test_heading_paths(spark):
    text = "# A\n\np\n\n### C\n\nq\n\n## B\n\nr\n\n# D\n\ns"
    rows = B.with_heading_path(B.blockify(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("ord").collect()
    assert [r.heading_path for r in rows] == [["A"], ["A"], ["A", "C"], ["A", "C"], ["A", "B"], ["A", "B"], ["D"], ["D"]]
    assert [r.block_id for r in rows][:2] == ["b_000000", "b_000001"]


def test_structure_counts(spark):
    text = "# A\n\n| a |\n| --- |\n| 1 |\n\ntext\n| x | y |\n|:---|---:|\n\n" + FENCE + "\n# no\n" + FENCE + "\n![i](s)"
    row = B.structure_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.headings, row.tables, row.code_blocks, row.images) == (1, 2, 1, 1)
