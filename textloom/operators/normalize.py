"""Repairs of converted Markdown: HTML tables, confusions of scanning, open fences, path separators of images.

Only form is repaired, nothing is deleted; headings stay as they are. All of it is column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.convert import close_fence

#: (pattern, replacement, rule, confidence), applied one after the other. Fixed values.
OCR_RULES = (
    (r"\bAll in Al\b", "All in AI", "ai_context_fix", 0.99),
    (r"Al(?=[\x{4E00}-\x{9FFF}])", "AI", "ai_context_fix", 0.96),
    (r"Al(?=工具|时代|使用|模型|编程|技术|应用|内容|创作|协作|问答|助手)", "AI", "ai_context_fix", 0.96),
    (r"(?<![a-zA-Z])A(?=[\x{4E00}-\x{9FFF}])", "AI", "ai_context_fix", 0.90),
    (r"Google Al Studio", "Google AI Studio", "ai_context_fix", 0.99),
    (r"YouTubeAl", "YouTube AI", "ai_context_fix", 0.99),
    (r"AIlinAI", "AI in AI", "ai_context_fix", 0.95),
)
TABLE, ROW, CELL = r"(?is)<table[^>]*>.*?</table>", r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"


def table_markdown(html: Column) -> Column:
    """An HTML table as Markdown, or itself if it has no cells. A table of one row has no separator."""

    def line(row: Column) -> Column:
        cells = F.transform(F.regexp_extract_all(row, T.rx(CELL), 1), lambda c: F.replace(T.strip(c), F.lit("\n"), F.lit(" ")))
        return F.when(F.size(cells) > 0, F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")))

    rows = F.array_compact(F.transform(F.regexp_extract_all(html, T.rx(ROW), 1), line))
    first = F.get(rows, 0)
    width = F.greatest(F.length(first) - F.length(F.replace(first, F.lit("|"), F.lit(""))) - 1, F.lit(1))
    ruled = F.concat(F.array(first, F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))))
    return F.when(F.size(rows) == 0, html).when(F.size(rows) == 1, first).otherwise(F.array_join(ruled, "\n"))


def html_tables(text: Column) -> Column:
    return T.rewrite(text, TABLE, table_markdown)


def ocr_fixes(text: Column) -> Column:
    for pattern, replacement, _, _ in OCR_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def image_paths(text: Column) -> Column:
    """Backslashes in the sources of images become slashes; captions stay."""
    part = lambda m, k: F.regexp_extract(m, T.IMAGE, k)
    return T.rewrite(text, T.IMAGE, lambda m: F.concat(F.lit("!["), part(m, 1), F.lit("]("), F.replace(part(m, 2), F.lit("\\"), F.lit("/")), F.lit(")")))


def normalize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, total_fixes, ocr_fixes, table_fixes, code_fixes, image_fixes). A null text is empty; texts are read whole."""
    c = F.col
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t0"))
    tables = F.size(F.filter(F.regexp_extract_all(c("t0"), T.rx(TABLE), 0), lambda m: F.size(F.filter(F.regexp_extract_all(m, T.rx(ROW), 1), lambda r: r.rlike(CELL))) > 0))
    rows = rows.withColumns({"table_fixes": tables.cast("long"), "t1": html_tables(c("t0"))})
    for i, (pattern, replacement, _, _) in enumerate(OCR_RULES):
        rows = rows.withColumns({f"n{i}": T.count(c("t1"), pattern), "t1": F.regexp_replace("t1", pattern, replacement)})
    rows = rows.withColumn("t2", close_fence(c("t1"))).withColumn("code_fixes", (c("t1") != c("t2")).cast("long"))
    wrong = F.size(F.filter(F.regexp_extract_all("t2", T.rx(T.IMAGE), 2), lambda s: F.contains(s, F.lit("\\"))))
    rows = rows.withColumns({"image_fixes": wrong.cast("long"), "text": image_paths(c("t2")), "ocr_fixes": sum((c(f"n{i}") for i in range(len(OCR_RULES))), F.lit(0).cast("long"))})
    return rows.select(id_col, "text", (c("ocr_fixes") + c("table_fixes") + c("code_fixes") + c("image_fixes")).alias("total_fixes"), "ocr_fixes", "table_fixes", "code_fixes", "image_fixes")


def fix_log(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule_no, line_id, before, after, rule, confidence): each repair of a confusion, with the offset at which its rule met it."""
    c = F.col
    nothing = F.array().cast("array<struct<rule_no:int,line_id:string,before:string,after:string,rule:string,confidence:double>>")

    def fixes(no: int) -> Callable[[Column], Column]:
        _, to, rule, sure = OCR_RULES[no]
        sizes = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda total, x: total + F.length(x))

        def all_of(s: Column) -> Column:
            def fix(match: Column, i: Column) -> Column:
                offset = sizes(s["between"], i + 1) + sizes(s["hits"], i)
                return F.struct(F.lit(no).alias("rule_no"), F.concat(F.lit("l_"), offset.cast("string")).alias("line_id"), match.alias("before"), F.lit(to).alias("after"), F.lit(rule).alias("rule"), F.lit(sure).alias("confidence"))

            return F.transform(s["hits"], fix)

        return all_of

    # each rule parts the text once; its repairs, and the text that the next rule gets, are made of the parts
    rows = docs.select(c(id_col), html_tables(F.coalesce(c(text_col), F.lit(""))).alias("__t"))
    for no, (pattern, replacement, _, _) in enumerate(OCR_RULES):
        rows = T.once(rows, __p=F.split(c("__t"), pattern, -1), __m=F.regexp_extract_all(c("__t"), T.rx(pattern), 0))
        own = F.get(F.transform(F.array(F.struct(c("__p").alias("between"), c("__m").alias("hits"))), fixes(no)), 0)
        rows = rows.select(id_col, *[f"__f{k}" for k in range(no)], F.when(F.size("__m") > 0, own).otherwise(nothing).alias(f"__f{no}"), F.array_join("__p", replacement).alias("__t"))
    return rows.select(id_col, F.explode(F.concat(*[c(f"__f{k}") for k in range(len(OCR_RULES))])).alias("fix")).select(id_col, "fix.*")
