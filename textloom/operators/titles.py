"""Titles: candidates from a document's first lines, scored; the best one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Lines that are looked at, sizes without white space, and the parts of a score. Fixed values.
FIRST_LINES, SHORTEST, LONGEST = 80, 4, 40
BASE, LINE_LIMIT, CJK_BONUS, WORD_BONUS, SENTENCE_LOSS = 100, 30, 20, 15, 40
#: Words that make a title likely, and titles of parts that name no document. Fixed values.
TITLE_WORDS = r"手册|指南|报告|白皮书|行动|playbook|guide|manual|report"
REJECTED = r"目录|chapter\d*|resources|^contents$|^资源$"


def _normal(c: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(c, r"^[#*\-_ \t]+|[#*\-_ \t]+$", ""), f"[{T.SPACE}]+", " ")
    return F.regexp_replace(clean, r"^[ ·:：\-—_]+|[ ·:：\-—_]+$", "")


def score(candidate: Column, line: Column, rejected: str = REJECTED) -> Column:
    """0 for what can't be a title; else earlier lines, CJK text and title words count more, sentences less."""
    compact = F.regexp_replace(candidate, f"[{T.SPACE}]+", "")
    fits = F.length(compact).between(SHORTEST, LONGEST) & ~F.lower(compact).rlike(rejected) & ~candidate.rlike(r"^\d{1,4}$")
    points = (
        F.lit(BASE) - F.least(line, F.lit(LINE_LIMIT)) + F.when(compact.rlike(r"[\x{4E00}-\x{9FFF}]"), CJK_BONUS).otherwise(0)
        + F.when(F.lower(candidate).rlike(TITLE_WORDS), WORD_BONUS).otherwise(0) - F.when(candidate.rlike("[。！？!?；;]"), SENTENCE_LOSS).otherwise(0)
    )
    return F.when(fits, points).otherwise(0)


def best_title(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rejected: str = REJECTED) -> DataFrame:
    """(id, title, score): the best candidate of each text; of equals the earlier line, then the greater text. Null without one."""
    ls = F.slice(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), 1, FIRST_LINES)

    def of_line(line: Column, i: Column) -> Column:
        whole = T.strip(F.regexp_replace(T.strip(line), r"^#{1,6}[ \t]*", ""))
        runs = F.regexp_extract_all(whole, T.rx(r"[\x{4E00}-\x{9FFF}][\x{4E00}-\x{9FFF}A-Za-z0-9《》「」：:·\- ]{2,39}"), 0)
        parts = F.concat(F.array(whole, F.substring_index(whole, "|", 1), F.substring_index(whole, "｜", 1)), runs)
        return F.transform(parts, lambda p: F.struct(score(_normal(p), i, rejected).alias("score"), (-i).alias("order"), _normal(p).alias("title")))

    best = F.array_max(F.filter(F.flatten(F.transform(ls, of_line)), lambda c: c["score"] > 0))
    return docs.select(id_col, best.alias("b")).select(id_col, F.col("b.title").alias("title"), F.coalesce("b.score", F.lit(0)).cast("long").alias("score"))
