"""Markdown text -> typed blocks, by one pass over the lines of each document where it is read.

Blocks are shuffled once, by document; no line is shuffled or sorted by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T

SHORT_IMAGE = 200
#: Bytes of text after which scanned blocks are handed on.
FLUSH = 16_000_000


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, i, line): one row per line, numbered from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("i", "line"))


def block_type(text: Column) -> Column:
    """The type of a block by its text alone."""
    return (
        F.when(text.startswith(T.FENCE), "code").when(text.startswith("|"), "table").when(text.rlike(r"^#{1,6}[ \t]+."), "section_heading")
        .when(text.rlike("^" + T.IMAGE) & (F.length(text) < SHORT_IMAGE), "image_evidence").when(text.startswith(">"), "quote")
        .when(text.rlike("^" + T.STEP), "operation_step").otherwise("paragraph")
    )


#: What the scanner goes by; the same in Python as in the engine's dialect. Fixed values.
_HEADING = re.compile(rf"#{{1,6}}[{re.escape(T.SPACES)}]+[^\n\r\x85\u2028\u2029]")
_IMAGE = re.compile(T.IMAGE)


def scan(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, first line, last line) of each block, in order; one pass over the lines.

    Kinds: code, heading, table, image, quote, text. Blocks of white space are none."""
    rows = text.split("\n")
    n = len(rows)
    bare = [x.strip(T.SPACES) for x in rows]
    out: list[tuple[str, str, int, int]] = []

    def put(kind: str, first: int, end: int, last: int | None = None) -> None:
        own = bare[first] if end == first + 1 else "\n".join(rows[first:end]).strip(T.SPACES)
        if own:
            out.append((kind, own, first, end - 1 if last is None else last))

    def is_image(s: str) -> bool:
        return "![" in s and len(s) < SHORT_IMAGE and _IMAGE.search(s) is not None

    def single(i: int) -> str:
        return "heading" if rows[i].startswith("#") and _HEADING.match(rows[i]) else "image" if is_image(bare[i]) else "text"

    i, run = 0, -1  # run: where a run of plain lines began
    while i < n:
        s, first, kind = bare[i], i, "text"
        mark = s[:1]
        if mark == "":
            kind, end = "blank", i + 1
        elif mark == "`" and s.startswith(T.FENCE):
            kind, end = "code", i + 1
            while end < n and not bare[end].startswith(T.FENCE):
                end += 1
            end += 1
        elif mark == "|":
            end = i + 1
            while end < n and bare[end].startswith("|"):
                end += 1
            first = next((j for j in range(i, end) if "|" in bare[j][1:]), end)
            first, kind = (first, "table") if first < end - 1 else (end, "table")
        elif mark == ">":
            end = i + 1
            while end < n and (bare[end].startswith(">") or (not bare[end] and bare[end - 1].startswith(">") and (end + 1 == n or bare[end + 1].startswith(">")))):
                end += 1
            first, kind = next((j for j in range(i, end) if bare[j].startswith(">") and not is_image(bare[j])), end), "quote"
        else:
            kind, end = single(i), i + 1
        before = range(i, min(first, n)) if kind in ("table", "quote") else ()  # lines of the run that the block leaves out
        for j in before:
            own = single(j) if bare[j] else "blank"
            if own == "text":
                run = j if run < 0 else run
                continue
            if run >= 0:
                put("text", run, j)
                run = -1
            if own != "blank":
                put(own, j, j + 1)
        if kind == "text":
            run = i if run < 0 else run
        elif first < end:
            if run >= 0:
                put("text", run, first)
                run = -1
            if kind == "code":
                put(kind, i, min(end, n), end - 1)  # one past the last line, if nothing ends it
            elif kind != "blank":
                put(kind, first, end)
        i = end
    if run >= 0:
        put("text", run, n)
    return out


#: What the scanner gives of each block.
_BLOCK = pa.struct([("kind", pa.string()), ("text", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, blocks), some documents at a time."""
    for batch in batches:
        began, offsets, blocks, size = 0, [0], [], 0

        def done(end: int) -> pa.RecordBatch:
            columns = list(zip(*blocks, strict=True)) or [()] * 4  # noqa: B023  used up at once
            made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK, strict=True)], fields=list(_BLOCK))
            return pa.RecordBatch.from_arrays([batch.column(0).slice(began, end - began), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)], ["doc_id", "blocks"])  # noqa: B023

        for row, text in enumerate(batch.column(1).cast(pa.binary())):
            raw = text.as_py() or b""
            blocks += scan(raw.decode("utf-8", "replace"))
            offsets.append(len(blocks))
            size += len(raw)
            if size > FLUSH:
                yield done(row + 1)
                began, offsets, blocks, size = row + 1, [0], [], 0
        if began < batch.num_rows:
            yield done(batch.num_rows)


def blockify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ord, block_id, type, text, line_start, line_end, protected, level, title), in document order.

    Lines count from 0; a code block without an end reaches one past the last line. Documents of white space, and
    null texts, have no block. An id that is null or stands on two rows is an error: its blocks can't be told apart."""
    c = F.col
    id_type = docs.schema[id_col].dataType.simpleString()
    scanned = docs.select(c(id_col).alias("doc_id"), c(text_col).alias("text")).mapInArrow(_scanned, f"doc_id {id_type}, blocks array<struct<kind:string,text:string,line_start:int,line_end:int>>")
    again = c("doc_id").isNull() | (F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id")) > 1)
    alone = F.when(c("__again"), F.raise_error(F.lit("documents need an id each: one is null or stands on two rows")).cast("boolean")).otherwise(True)
    rows = scanned.withColumn("__again", again).where(alone).select("doc_id", F.posexplode("blocks").alias("ord", "b")).select("doc_id", "ord", "b.*")
    typed = F.when(c("kind") == "text", block_type(c("text"))).when(c("kind") == "heading", "section_heading").when(c("kind") == "image", "image_evidence").otherwise(c("kind"))
    heading = c("kind") == "heading"
    return rows.select(
        "doc_id", "ord", F.format_string("b_%06d", "ord").alias("block_id"), typed.alias("type"), "text", "line_start", "line_end",
        c("kind").isin("code", "table").alias("protected"), F.when(heading, F.length(F.regexp_extract("text", "^(#+)", 1))).alias("level"), F.when(heading, T.strip(F.regexp_replace("text", "^#+", ""))).alias("title"),
    )


def with_heading_path(blocks: DataFrame) -> DataFrame:
    """Adds ``heading_path``: titles of the headings that a block stands under, its own included.

    The last heading of a level is open if it came after the last heading of every higher level."""
    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    lasts = {f"__h{n}": F.last(F.when(F.col("level") == n, F.struct("ord", "title")), ignorenulls=True).over(upto) for n in range(1, 7)}
    named = blocks.withColumns(lasts)
    open_, above = [], F.lit(-1)
    for n in range(1, 7):
        at = F.coalesce(F.col(f"__h{n}.ord"), F.lit(-1))
        open_.append(F.when(at > above, F.col(f"__h{n}.title")))
        above = F.greatest(above, at)
    return named.withColumn("heading_path", F.array_compact(F.array(*open_))).drop(*lasts)


def with_pages(blocks: DataFrame, page_map: DataFrame) -> DataFrame:
    """As-of join: the page of the greatest mapped line at or before a block's first line, and its last.

    ``page_map(doc_id, line, page)``. Blocks are read once: each becomes two points that carry it, sorted with the marks
    of its document once; no product of blocks and pages, and no join back."""
    carried = F.struct(*blocks.columns)
    sides = F.array(F.struct(F.col("line_start").alias("line"), F.lit(1).alias("side")), F.struct(F.col("line_end").alias("line"), F.lit(2).alias("side")))
    kind = page_map.schema["page"].dataType
    points = blocks.select("doc_id", F.explode(sides).alias("p"), carried.alias("block")).select("doc_id", "p.line", "p.side", "block", F.lit(None).cast(kind).alias("page"))
    marks = page_map.select("doc_id", "line", F.lit(0).alias("side"), F.lit(None).cast(points.schema["block"].dataType).alias("block"), "page")
    w = Window.partitionBy("doc_id").orderBy("line", "side", "page").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(points).withColumn("page", F.last("page", ignorenulls=True).over(w)).where("side > 0")
    by_block = Window.partitionBy("doc_id", "block.ord")
    both = seen.withColumn("page_start", F.max(F.when(F.col("side") == 1, F.col("page"))).over(by_block)).where("side = 2")
    return both.select("block.*", "page_start", F.col("page").alias("page_end"))


def locate_pages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 40) -> DataFrame:
    """(doc_id, line, page): where the first characters of each item stand in its document, for ``with_pages``.

    ``items(doc_id, page, body)``; what has no text, or is not found, marks nothing."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t"))
    found = items.where(F.coalesce(F.length("body"), F.lit(0)) > 0).join(own, "doc_id").withColumn("__at", F.instr(F.col("__t"), F.substring("body", 1, first)))
    before = F.substring(F.col("__t"), F.lit(1), F.col("__at") - 1)
    return found.where("__at > 0").select("doc_id", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("int").alias("line"), "page")


def heading_list(text: Column) -> Column:
    """The normalised headings of a Markdown text outside its fences, in order."""
    plain = F.regexp_replace(text, "(?s)" + T.FENCE + ".*?" + T.FENCE, "")
    heads = F.filter(F.split(plain, "\n"), lambda x: x.rlike(rf"^[{T.SPACE}]{{0,3}}#{{1,6}}[{T.SPACE}]+[^{T.SPACE}]"))
    return F.filter(F.transform(heads, heading_text), lambda x: x != "")


def heading_text(line: Column) -> Column:
    """A heading's words in lower case, without marks at either end."""
    bare = F.regexp_replace(F.regexp_replace(line, rf"^[{T.SPACE}]{{0,3}}#{{1,6}}[{T.SPACE}]+", ""), rf"[{T.SPACE}]*#*[{T.SPACE}]*$", "")
    return F.lower(T.strip(F.regexp_replace(bare, f"[{T.SPACE}]+", " ")))


def image_context(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", before: int = 5, after: int = 3) -> DataFrame:
    """(doc_id, i, src, context): for each image, the lines around its own."""
    rows = lines(docs, id_col, text_col)
    w = Window.partitionBy("doc_id").orderBy("i")
    near = rows.withColumn("a", F.array_join(F.collect_list("line").over(w.rowsBetween(-before, -1)), "\n")).withColumn("b", F.array_join(F.collect_list("line").over(w.rowsBetween(1, after)), "\n"))
    src = F.regexp_extract("line", T.IMAGE, 2)
    return near.where(F.col("line").rlike(T.IMAGE)).select("doc_id", "i", src.alias("src"), F.concat("a", F.lit("\n"), "b").alias("context"))


def structure_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, headings, tables, code_blocks, images): signals of a Markdown text outside its fences."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.regexp_replace(t, "(?s)" + T.FENCE + ".*?" + T.FENCE, "")
    table = r"(?m)^[ \t]*\|.*\|[ \t]*\n[ \t]*\|([ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*(\n[ \t]*\|.*\|[ \t]*$)*"
    return docs.select(
        id_col, T.count(plain, r"(?m)^ {0,3}#{1,6}[ \t]+[^ \t\n#]").alias("headings"), T.count(plain, table).alias("tables"),
        F.floor(T.count(t, T.FENCE) / 2).cast("long").alias("code_blocks"), T.count(plain, T.IMAGE).alias("images"),
    )
