"""Converters to Markdown. Built-in expressions where they can say it; Arrow UDFs where a parser is needed."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from posixpath import dirname, join, normpath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import text as T
from textloom.sources import formats as Z

#: Elements whose content is no text of the page, for the quick profile and for the parser. Fixed values.
NOISY = ("script", "style", "nav", "footer", "header", "aside", "figure", "figcaption", "noscript", "template")
SKIPPED = ("script", "style", "svg", "noscript", "nav", "header", "footer")
BLOCKS = ("p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6")
#: Characters of a packed subtitle paragraph. Fixed value.
SUBTITLE_CHARS = 500


def html_profile_text(html: Column) -> Column:
    """Text of a page by substitutions alone: noisy elements go, blocks end lines, tags become spaces."""
    out = html
    for tag in NOISY:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:[ \t\n/][^>]*)?>.*?</{tag}>", "\n")
    out = F.regexp_replace(out, r"(?i)<br[ \t\n]*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(?:p|div|li|h[1-6]|tr|section|article)>", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"[ \t]+", " ")


class _Page(HTMLParser):
    """Collects lines of Markdown; text gathers until something ends its line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.words: list[str] = []
        self.prefix, self.skip, self.link = "", 0, None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.lines.append(self.prefix + text)
        self.words, self.prefix = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        named = dict(attrs)
        if tag in BLOCKS:
            self.flush()
        if tag == "li":
            self.prefix = "- "
        elif re.fullmatch("h[1-6]", tag):
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "a":
            self.link = (named.get("href") or "", len(self.words))
        elif tag == "img" and named.get("src"):
            self.words.append(f"![{named.get('alt') or ''}]({named['src']})")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag == "a" and self.link:
            target, at = self.link
            text = " ".join("".join(self.words[at:]).split())
            self.words[at:] = [f"[{text or target}]({target})" if target else text]
            self.link = None
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def page_markdown(html: str | None) -> str:
    """A page as Markdown: one line for each block, consecutive equal lines once, blank lines between.

    A declaration that the parser does not take ends the page for it; its text is what the tags leave."""
    page = _Page()
    try:
        page.feed(html or "")
        page.close()
    except AssertionError:
        return re.sub(r"<[^>]+>", "", html or "").strip()
    page.flush()
    kept = [line for i, line in enumerate(page.lines) if i == 0 or line != page.lines[i - 1]]
    return "\n\n".join(kept)


def _arrow(convert):
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(convert, na_action=None)

    return run


def dispatched(html: str | None, rich=None) -> str:
    """A page by the first converter that gives a text: one of the caller's, the parser, the text between the tags."""
    found = rich(html or "") if rich is not None else ""
    return found if found.strip() else page_markdown(html) or re.sub(r"<[^>]+>", "", html or "").strip()


html_to_markdown = _arrow(lambda x: dispatched(x))


def standalone_svg(svg: str | None) -> str:
    """An inline drawing as a file of its own: its size from its view box, its aspect kept, its namespace named."""
    text = svg or ""
    root = re.search(r"<svg\b([^>]*)>", text, re.I | re.S)
    if not root:
        return text
    attributes = root[1].rstrip("/ ")
    value = lambda name: (re.search(rf"""\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", attributes, re.I) or [None] * 3)
    box = value("viewBox")
    numbers = re.split(r"[\s,]+", ((box[1] or box[2] or "") if box[0] else "").strip())
    try:
        sizes = [float(x) for x in numbers] if len(numbers) == 4 else []
    except ValueError:
        sizes = []
    attributes = re.sub(r"\bviewbox(?=\s*=)", "viewBox", attributes, flags=re.I)
    if len(sizes) == 4 and sizes[2] > 0 and sizes[3] > 0:
        for name, size in (("width", sizes[2]), ("height", sizes[3])):
            own = value(name)
            given = ((own[1] or own[2] or "") if own[0] else "").strip()
            if not given or given.endswith("%"):
                attributes = re.sub(rf"""\s*\b{name}\s*=\s*(?:"[^"]*"|'[^']*')""", "", attributes, flags=re.I) + f' {name}="{int(size) if size.is_integer() else size}"'
    if not value("preserveAspectRatio")[0]:
        attributes += ' preserveAspectRatio="xMidYMid meet"'
    if "xmlns=" not in attributes:
        attributes = ' xmlns="http://www.w3.org/2000/svg"' + attributes
    return text[: root.start()] + f"<svg{attributes}{'/' if root[1].rstrip().endswith('/') else ''}>" + text[root.end() :]


svg_to_file = _arrow(standalone_svg)


def fenced(body: str, language: str) -> str:
    """A fence that the body does not hold, around it."""
    fence = "`" * max([3, *[len(x) + 1 for x in re.findall("`{3,}", body)]])
    return f"{fence}{language}\n{body}\n{fence}"


def pretty_json(text: str | None) -> str:
    """JSON, indented, in a fence; what does not parse, or is nested too deeply to, stays as it is, stripped."""
    try:
        return fenced(json.dumps(json.loads(text or ""), ensure_ascii=False, indent=2), "json")
    except (ValueError, RecursionError):
        return (text or "").strip()


json_to_markdown = _arrow(pretty_json)


def delimited(text: str | None, delimiter: str = ",") -> str:
    """Rows as a Markdown table: cells trimmed, blank rows dropped, short rows padded, pipes escaped.

    Any line end ends a line, cells may be of any length; text that is no table by its quotes is one cell a line."""
    csv.field_size_limit(1 << 31)
    source = (text or "").replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    try:
        found = list(csv.reader(io.StringIO(source, newline=""), delimiter=delimiter))
    except csv.Error:
        found = [[line] for line in source.split("\n")]
    rows = [[c.strip().replace("|", "\\|") for c in r] for r in found]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


csv_to_markdown = _arrow(delimited)


def table_lines(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(part, place, line) of a whole table as one Markdown table: the head, its rule, and the rows in order.

    Rows stay rows, ordered by ranges, so a table of any size can be written out part by part: the line of a row is its
    own, and no task holds them all."""
    cell = lambda c: F.replace(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    head = [(0, 0, "| " + " | ".join(columns) + " |"), (0, 1, "| " + " | ".join(["---"] * len(columns)) + " |")]
    body = df.select(F.lit(1).alias("part"), F.col(order).cast("long").alias("place"), row.alias("line"))
    return df.sparkSession.createDataFrame(head, "part int, place long, line string").unionByName(body).orderBy("part", "place")


def code_to_markdown(code: Column, language: str = "") -> Column:
    """A fence that the code itself does not hold, around the code."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(code, T.rx("`{3,}"), 0), lambda x: F.length(x))), F.lit(2))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(fence, F.lit(language + "\n"), F.regexp_replace(code, r"\n+$", ""), F.lit("\n"), fence)


def packed_lines(lines: list[str], most: int = SUBTITLE_CHARS) -> list[str]:
    out: list[str] = []
    for line in lines:
        if out and len(out[-1]) + 1 + len(line) <= most:
            out[-1] += " " + line
        else:
            out.append(line)
    return out


def subtitle(text: str | None) -> str:
    """Spoken lines of SRT or WebVTT without cues, tags and labels, in paragraphs below one heading."""
    said = []
    for line in (text or "").splitlines():
        s = line.strip()
        if not s or s.isdigit() or "-->" in s or s.startswith(("WEBVTT", "NOTE", "STYLE", "REGION")):
            continue
        s = re.sub(r"^\[[^\]]{1,30}\]\s*", "", re.sub(r"<[^>]+>", "", s)).strip()
        if s:
            said.append(s)
    return "\n\n".join(["# Transcript", *packed_lines(said)])


subtitle_to_markdown = _arrow(subtitle)


def _named(value: dict, key: str) -> dict:
    own = value.get(key)
    return own if isinstance(own, dict) else {}


def read_notebook(text: str | None) -> dict | None:
    """The object of a notebook; none if the text is none."""
    try:
        book = json.loads(text or "")
    except (ValueError, RecursionError):
        return None
    return book if isinstance(book, dict) else None


def cells_of(book: dict) -> list[dict]:
    cells = book.get("cells")
    return [c for c in cells if isinstance(c, dict)] if isinstance(cells, list) else []


def notebook_stats(files: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, cells, markdown_cells, code_cells) of notebooks, by their JSON; zeros for what is none."""
    kinds = F.from_json(F.col(text_col), "cells array<struct<cell_type:string>>", {"mode": "PERMISSIVE"})["cells"]
    own = F.coalesce(kinds, F.array().cast("array<struct<cell_type:string>>"))
    count = lambda kind: F.size(F.filter(own, lambda c: c["cell_type"] == kind)).cast("long")
    return files.select(id_col, F.size(own).cast("long").alias("cells"), count("markdown").alias("markdown_cells"), count("code").alias("code_cells"))


def notebook(text: str | None) -> str:
    """Cells of a notebook: Markdown as it is, code in fences of the kernel's language, outputs below their cell."""
    book = read_notebook(text)
    if book is None:
        return (text or "").strip()
    joined = lambda x: "".join(map(str, x)) if isinstance(x, list) else str(x or "")
    meta = _named(book, "metadata")
    language = _named(meta, "kernelspec").get("language") or _named(meta, "language_info").get("name") or "python"
    parts = []
    for i, cell in enumerate(cells_of(book), 1):
        source = joined(cell.get("source")).strip()
        if cell.get("cell_type") == "markdown" and source:
            parts.append(source)
        elif cell.get("cell_type") == "code":
            if source:
                parts.append(f"```{language}\n{source}\n```")
            outputs = [o for o in cell.get("outputs") or [] if isinstance(o, dict)]
            shown = [joined(o.get("text") or _named(o, "data").get("text/plain") or o.get("traceback")).strip() for o in outputs]
            shown = [x for x in shown if x]
            if shown:
                parts.append(f"## Cell {i} Output\n\n```\n" + "\n".join(shown) + "\n```")
    return "\n\n".join(parts)


notebook_to_markdown = _arrow(notebook)


def decoded(data: bytes | None) -> str:
    """UTF-8, else GBK, else Latin-1; a byte-order mark stays."""
    for name in ("utf-8", "gbk", "latin-1"):
        try:
            return bytes(data or b"").decode(name)
        except UnicodeDecodeError:
            continue
    return ""


decode_text = _arrow(decoded)


def _local(element) -> str:
    return element.tag.rpartition("}")[2]


def _attribute(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _texts(element) -> str:
    return "".join(x.text or "" for x in element.iter() if _local(x) == "t")


def docx(data: bytes) -> str:
    """Paragraphs and tables of a document in order; heading styles become headings."""
    body = next(x for x in ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")) if _local(x) == "body")
    parts = []
    for e in body:
        if _local(e) == "p":
            style = next((_attribute(x, "val") or "" for x in e.iter() if _local(x) == "pStyle"), "")
            level = re.search(r"heading\s*([1-6])", style, re.I)
            if text := _texts(e).strip():
                parts.append("#" * int(level[1]) + " " + text if level else text)
        elif _local(e) == "tbl":
            rows = [[_texts(c).strip() for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            out = io.StringIO()
            csv.writer(out).writerows(rows)
            parts.append(delimited(out.getvalue()))
    return "\n\n".join(parts)


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def pptx(data: bytes) -> str:
    """Slides by number, each below a heading; a paragraph that a slide repeats stands once."""
    archive, parts = zipfile.ZipFile(io.BytesIO(data)), []
    for k, name in enumerate(_numbered(archive, r"ppt/slides/slide(\d+)\.xml"), 1):
        said = [_texts(p).strip() for p in ElementTree.fromstring(archive.read(name)).iter() if _local(p) == "p"]
        parts += [f"# Slide {k}", *dict.fromkeys(x for x in said if x)]
    return "\n\n".join(parts)


def office_images(data: bytes) -> list[str]:
    """Images that the parts of an office file embed, in the order of first use; linked ones from outside are left out."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    names, found = set(archive.namelist()), {}
    parts = [n for n in archive.namelist() if re.fullmatch(r"(word/document|ppt/slides/slide\d+|xl/drawings/drawing\d+)\.xml", n)]
    for part in sorted(parts, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]):
        folder, _, name = part.rpartition("/")
        if f"{folder}/_rels/{name}.rels" not in names:
            continue
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read(f"{folder}/_rels/{name}.rels")) if r.get("TargetMode") != "External"}
        for e in ElementTree.fromstring(archive.read(part)).iter():
            target = targets.get(_attribute(e, "embed") or "") if _local(e) == "blip" else None
            if target and (own := normpath(join(folder, target)).lstrip("/")) in names:
                found.setdefault(own, None)
    return list(found)


def slide_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "markdown") -> DataFrame:
    """(id, page_idx, text): the slides of a converted deck, each from its heading to the next."""
    parts = F.split(F.col(text_col), r"(?m)(?=^# Slide[ \t]+\d+(?::[^\n]*)?$)", -1)
    rows = docs.select(F.col(id_col), F.explode(parts).alias("part"))
    no = F.regexp_extract("part", r"^# Slide[ \t]+(\d+)(?::[^\n]*)?(?:\n|$)", 1)
    return rows.where(no != "").select(id_col, (no.cast("int") - 1).alias("page_idx"), T.strip(F.col("part")).alias("text"))


def xlsx(data: bytes) -> str:
    """Sheets by number, each a heading and a table."""
    archive, parts = zipfile.ZipFile(io.BytesIO(data)), []
    shared = [_texts(x) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in archive.namelist() else []
    names = [_attribute(x, "name") or "" for x in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if _local(x) == "sheet"] if "xl/workbook.xml" in archive.namelist() else []
    for k, name in enumerate(_numbered(archive, r"xl/worksheets/sheet(\d+)\.xml")):
        out = io.StringIO()
        for row in (x for x in ElementTree.fromstring(archive.read(name)).iter() if _local(x) == "row"):
            cells = []
            for c in (x for x in row if _local(x) == "c"):
                value = next((x.text or "" for x in c if _local(x) == "v"), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else _texts(c) if c.get("t") == "inlineStr" else value)
            csv.writer(out).writerow(cells)
        parts += [f"# {names[k] if k < len(names) else f'Sheet {k + 1}'}", delimited(out.getvalue())]
    return "\n\n".join(p for p in parts if p)


def epub(data: bytes) -> str:
    """Chapters in the order of the spine; without one, all pages by name."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    names, pages = archive.namelist(), []
    try:
        root = next(_attribute(x, "full-path") for x in ElementTree.fromstring(archive.read("META-INF/container.xml")).iter() if _local(x) == "rootfile")
        book = ElementTree.fromstring(archive.read(root))
        files = {x.get("id"): normpath(join(dirname(root), x.get("href") or "")) for x in book.iter() if _local(x) == "item"}
        pages = [files[x.get("idref")] for x in book.iter() if _local(x) == "itemref" and files.get(x.get("idref")) in names]
    except (KeyError, StopIteration, ElementTree.ParseError):
        pages = []
    pages = pages or sorted(n for n in names if n.endswith((".xhtml", ".html", ".htm")))
    return "\n\n".join(x for x in (page_markdown(archive.read(n).decode("utf-8", "replace")) for n in pages) if x)


CONTAINERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "epub": epub}


def convert_files(files: DataFrame) -> DataFrame:
    """(path, content) -> (path, markdown, error): each file by its extension; a broken file has an error, not a crash."""
    by_text = {"html": page_markdown, "htm": page_markdown, "json": pretty_json, "csv": delimited, "tsv": lambda x: delimited(x, "\t"), "srt": subtitle, "vtt": subtitle, "ipynb": notebook}

    def one(path: str, data: bytes) -> tuple[str | None, str | None]:
        try:
            ext = (path or "").rpartition(".")[2].lower()
            if data is None:
                return None, "no content"
            data = bytes(data)
            if ext in CONTAINERS:
                return CONTAINERS[ext](data), None
            text = decoded(data)
            if ext in by_text:
                return by_text[ext](text), None
            if Z.FORMAT_OF.get(ext) == "code":
                return fenced(text.rstrip("\n"), Z.LANGUAGES.get(ext, ext)), None
            return text, None
        except Exception as error:  # noqa: BLE001  any damage to a container
            return None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(p, c) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "markdown": [m for m, _ in rows], "error": [e for _, e in rows]})

    return files.select("path", "content").mapInPandas(run, "path string, markdown string, error string")


def conversation_markdown(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, markdown): the turns of each conversation in order, one ``role: text`` paragraph each."""
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))))
    return conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("markdown"))


def close_fence(text: Column) -> Column:
    """Adds the fence that a text leaves open."""
    toggles = F.size(F.filter(F.split(text, "\n"), lambda x: T.strip(x).startswith(T.FENCE)))
    return F.when(toggles % 2 == 1, F.concat(F.regexp_replace(text, r"\n+$", ""), F.lit("\n" + T.FENCE))).otherwise(text)


def drop_repeated_lines(text: Column) -> Column:
    """Without lines that equal the line before."""
    ls = F.split(text, "\n")
    pairs = F.transform(ls, lambda x, i: F.struct(x.alias("x"), F.when(i == 0, True).otherwise(x != F.get(ls, i - 1)).alias("new")))
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["new"]), lambda p: p["x"]), "\n")


def unwrap_lines(text: Column) -> Column:
    """Joins hard-wrapped lines: one goes on in the next unless it is blank, structural, or ends a sentence, or both are short."""
    structural = r"^[ \t]*(#|>|\||[-*+] |\d+[.)] |`{3}|!\[|<!--)"
    ends = r"[.!?:;。！？：；][\"'”’)）]?[ \t]*$"

    def add(done: Column, line: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        apart = (T.strip(last) == "") | (T.strip(line) == "") | last.rlike(structural) | line.rlike(structural) | last.rlike(ends) | ((F.length(last) <= 20) & (F.length(line) <= 20))
        glue = F.when(last.rlike(r"[\x{4E00}-\x{9FFF}]$") | line.rlike(r"^[\x{4E00}-\x{9FFF}]"), F.lit("")).otherwise(F.lit(" "))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, glue, line)))
        return F.when(F.size(done) == 0, F.array(line)).when(apart, F.concat(done, F.array(line))).otherwise(joined)

    return F.array_join(F.aggregate(F.split(text, "\n"), F.array().cast("array<string>"), add), "\n")
