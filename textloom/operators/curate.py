"""Curation of kept blocks for a text-first vault: what packages a source goes, what it teaches stays.

Each test of a block by itself is a column; cheap looks that every hit must pass go before costly ones. What depends on
the blocks before it (profiles at the top of a document, author cards below a heading, tables of contents) is decided in
one pass over a document's flags, a number a block; texts stay in the JVM, and blocks are made once."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators.classify import has_exact, tagged
from textloom.operators.images import images_of


@dataclass(frozen=True)
class Template:
    """The terms that a vault's curation goes by; read from a file of the same names, or our own few."""

    social_profile_labels: tuple[str, ...] = ("Presenter", "Author", "Editor")
    social_profile_platforms: tuple[str, ...] = ("YouTube", "Newsletter", "Podcast")
    provenance_terms: tuple[str, ...] = ("source", "reference")
    author_bio_terms: tuple[str, ...] = ("About the author", "Biography")
    bio_role_terms: tuple[str, ...] = ("founder", "blogger", "editor-in-chief", "consultant")
    author_credential_terms: tuple[str, ...] = ("followers", "years of experience")
    knowledge_terms: tuple[str, ...] = ("method", "step", "parameter", "because", "example")
    packaging_heading_terms: tuple[str, ...] = ("Copyright notice", "Acknowledgements", "Closing words")
    packaging_heading_regexes: tuple[str, ...] = ()
    brand_heading_replacements: tuple[tuple[str, str], ...] = ()
    layout_table_terms: tuple[str, ...] = ("Back", "Search", "Share")
    brand_program_packaging_terms: tuple[str, ...] = ()
    translator_back_matter_terms: tuple[str, ...] = ()
    diagram_heading_terms: tuple[str, ...] = ("图", "全景", "流程", "结构", "示意", "金字塔", "工作流")
    default_title: str = "Untitled"


def load_template(path: str) -> Template:
    """A template from a JSON file; terms that it lacks are empty."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    own = {f.name: f.default for f in fields(Template) if f.name in ("diagram_heading_terms", "default_title")}
    for f in fields(Template):
        if f.name not in own:
            values = data.get(f.name, [])
            if not isinstance(values, list):
                raise ValueError(f"{path}: {f.name} must be a list")
            own[f.name] = tuple(tuple(v) if isinstance(v, list) else v for v in values)
    return Template(**own)


#: (type, reason, confidence) of each verdict. Fixed values.
VERDICTS = {
    "image": ("image_artifact", "drop_image_for_text_kb", 0.94),
    "marker": ("page_marker", "drop_internal_page_marker_for_readable_kb", 0.99),
    "divider": ("slide_chapter_divider", "drop_standalone_slide_chapter_divider_for_kb", 0.94),
    "separator": ("layout_separator", "drop_visual_chapter_separator_for_obsidian_kb", 0.95),
    "translator": ("translator_marketing_back_matter", "drop_translator_social_back_matter_for_kb", 0.94),
    "profile": ("author_profile_links", "drop_front_matter_author_or_social_profile_for_kb", 0.92),
    "card": ("author_identity", "drop_author_identity_card_for_text_kb", 0.91),
    "layout": ("layout_table_artifact", "drop_layout_table_for_text_kb", 0.86),
    "context": ("marketing_wrapper", "drop_packaging_context_for_text_kb", 0.88),
    "brand": ("marketing_wrapper", "drop_brand_program_packaging_for_text_kb", 0.87),
    "empty": ("empty_heading", "empty heading after source cleanup", 0.92),
    "packaging": ("marketing_wrapper", "drop_packaging_heading_for_text_kb", 0.90),
    "intro": ("author_intro", "author bio or identity wrapper unrelated to knowledge body", 0.90),
    "toc": ("toc", "drop_table_of_contents_for_text_kb", 0.90),
    "toc_heading": ("toc_heading", "drop_table_of_contents_heading_for_text_kb", 0.88),
}
KEEP_DIAGRAM = ("diagram", "keep_html_diagram_for_kb", 0.92)
INTRO_REVIEW = ("author_intro_review", "identity-heavy text also contains possible knowledge signals", 0.60)
VAULT_IMAGES = ("image_operation", "image_evidence", "diagram", "qr_image", "unknown_image")
#: Characters at which a title that stands in front of a sentence is part of it. Fixed values.
GOES_ON = ("的", "是", "要", "需", "会", "能", "中")
AUTHOR_PREFIX = r"^@?[\w\x{4E00}-\x{9FFF}]{1,18}[：:][ \t]*(?=.)"
#: How far the pass looks: blocks of front matter, blocks above an author card, headings above a table of contents. Fixed values.
FRONT, ABOVE, TOC_HEADINGS = 12, 5, 3


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != "")


def _chapter(text: Column) -> Column:
    """Whether the first line with a text may be a chapter's label."""
    return F.lower(F.substring(T.strip(text), 1, 7)) == "chapter"


def slide_title(text: Column) -> Column:
    """The title of a slide that only divides chapters: a label, one to three short lines, a page number. Null for any other."""
    ls = _lines(text)
    n = F.size(ls)
    inner = F.slice(ls, 2, F.greatest(n - 2, F.lit(0)))
    plain = ~F.exists(inner, lambda x: (F.length(x) > 40) | x.rlike("[。！？!?；;]"))
    title = F.array_join(inner, " ")
    return F.when(_chapter(text), F.when(n.between(3, 5) & F.get(ls, 0).rlike(r"(?i)^Chapter\s+\d+$") & F.get(ls, n - 1).rlike(r"^\d{1,4}$") & plain & (title != "") & (F.length(title) <= 80), title))


def _without_title(body: Column, title: Column) -> Column:
    """The body without the title that it begins with, once or twice; unless the sentence goes on with it."""
    quoted = F.transform(F.split(F.regexp_replace(title, r"\s+", ""), ""), lambda c: F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1"))
    pattern = F.concat(F.lit(r"^\s*"), F.array_join(F.filter(quoted, lambda c: c != ""), r"\s*"), F.lit(r"\s*"))
    goes_on = lambda x: (x == "") | F.substring(x, 1, 1).isin(*GOES_ON)
    once = F.regexp_replace(body, pattern, F.lit(""))
    twice = F.regexp_replace(once, pattern, F.lit(""))
    return F.when(~F.rlike(body, pattern), body).when(F.rlike(once, pattern), F.when(goes_on(twice), once).otherwise(twice)).when(goes_on(once), body).otherwise(once)


def chapter_body(text: Column, title: Column) -> Column:
    """A slide that begins with a chapter's label as a section below the chapter's title; null for any other text."""
    ls = _lines(text)
    no_page = lambda a: F.when((F.size(a) >= 2) & F.get(a, F.size(a) - 1).rlike(r"^\d{1,4}$"), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
    rest = F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0)))
    later = F.slice(ls, 3, F.greatest(F.size(ls) - 2, F.lit(0)))
    known = F.coalesce(title, F.lit("")) != ""
    first = F.array_join(no_page(rest), "\n")
    body = F.when(first == "", first).when(known, _without_title(first, F.coalesce(title, F.lit("")))).otherwise(F.array_join(no_page(later), "\n"))
    name = F.when(known, title).otherwise(F.get(ls, 1))
    return F.when(_chapter(text), F.when((F.size(ls) >= 2) & F.get(ls, 0).rlike(r"(?i)^Chapter\s+\d+$") & (body != ""), F.concat(F.lit("## "), name, F.lit("\n\n"), body)))


def clean_title(title: Column, template: Template) -> Column:
    """A heading's words without a name in front and without the brand's own."""
    out = T.strip(F.regexp_replace(T.strip(title), AUTHOR_PREFIX, ""))
    for old, new in template.brand_heading_replacements:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, "^[ ：:]+|[ ：:]+$", "")


def sanitized_heading(text: Column, template: Template) -> Column:
    bare = T.strip(text)
    marks, title = F.regexp_extract(bare, r"^(#{1,6}\s*)(.+)$", 1), clean_title(F.regexp_extract(bare, r"^(#{1,6}\s*)(.+)$", 2), template)
    return F.when((marks != "") & (title != ""), F.concat(marks, title)).otherwise(text)


def packaging_title(title: Column, template: Template) -> Column:
    found = has_exact(title, template.packaging_heading_terms)
    for pattern in template.packaging_heading_regexes:
        found = found | title.rlike(f"(?i)^(?:{pattern})$")
    return found


def knowledge_signal(text: Column, template: Template) -> Column:
    return has_exact(text, template.knowledge_terms) | text.rlike(r"(?m)^\s*\d+[.)）、]") | (F.contains(text, F.lit("=")) & text.rlike(r"[A-Za-z_]=\S"))


def toc_like(text: Column) -> Column:
    """Whether half of a text's lines, and two at least, end in the number of a page."""
    numbered = lambda x: (F.length(x) <= 120) & F.substring(x, -1, 1).between("0", "9") & (x.rlike(r"[：:].{2,}\s+\d{1,4}$") | x.rlike(r".{4,}\s{2,}\d{1,4}$"))

    def half(ls: Column) -> Column:
        entries = F.size(F.filter(ls, numbered))
        return (F.size(ls) >= 2) & (entries >= 2) & (entries * 2 >= F.size(ls))

    return T.after(F.contains(text, F.lit("\n")), F.exists(F.array(_lines(text)), half))  # lines are made once


def author_card(text: Column, template: Template) -> Column:
    """Whether a single line names a person: a handle, a role without any lesson, or what someone has achieved."""
    clean = T.strip(F.regexp_replace(T.strip(text), r"^#{1,6}\s*", ""))
    compact = F.regexp_replace(clean, f"[{T.SPACE}]+", "")
    handle = compact.rlike(r"^@[\w\x{4E00}-\x{9FFF}][\w\x{4E00}-\x{9FFF}._-]{0,30}$")
    roles = has_exact(clean, template.bio_role_terms)
    deeds = has_exact(clean, template.author_credential_terms) & ~clean.rlike(r"^\s*(?:\d+[.、）)]|第[一二三四五六七八九十]+)")
    may = F.contains(text, F.lit("@")) | has_exact(text, template.bio_role_terms) | has_exact(text, template.author_credential_terms)
    return T.after(~F.contains(text, F.lit("\n")) & may, F.length(compact).between(1, 90) & F.when(handle, True).when(roles, ~has_exact(clean, template.knowledge_terms)).otherwise(deeds))


def _count_terms(text: Column, terms: tuple[str, ...]) -> Column:
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def author_intro(text: Column, template: Template) -> Column:
    return (has_exact(text, template.author_bio_terms) | ((_count_terms(text, template.bio_role_terms) >= 2) & ~knowledge_signal(text, template))) & T.at_most(text, 240)


def social_profile(text: Column, template: Template) -> Column:
    label = F.lit(False)
    for term in template.social_profile_labels:
        label = label | (F.contains(text, F.lit(term)) & text.rlike(rf"(^|\s){T._quoted(term)}\s*[：:]"))
    linked = text.rlike(r"\[[^\]]+\]\([^)]+\)") | has_exact(text, template.social_profile_platforms)
    return ~F.contains(text, F.lit("\n")) & (F.length(text) <= 300) & label & linked & ~has_exact(text, template.provenance_terms) & ~knowledge_signal(text, template)


def layout_table(text: Column, template: Template) -> Column:
    empty = F.regexp_count(text, F.lit(r"\|\s*(?=\|)"))
    rows = F.size(F.filter(F.split(text, "\n"), lambda x: T.strip(x).startswith("|")))
    return T.strip(text).startswith("|") & (((empty >= 4) & has_exact(text, template.layout_table_terms)) | ((rows <= 5) & (empty >= 3) & text.rlike(r"\b\d{1,2}:\d{2}\b")))


def flags(blocks: DataFrame, template: Template) -> DataFrame:
    """Blocks with what each test says of them by themselves, as columns that begin with two underscores."""
    t, kind, title, bare = F.col("__t"), F.col("type"), F.col("__title"), T.strip(F.col("text"))
    heading = kind == "section_heading"
    paths = F.col("heading_path") if "heading_path" in blocks.columns else F.lit(None).cast("array<string>")
    above = F.get(paths, F.size(paths) - 1)
    titles = {"__t": bare, "__title": F.when(heading, clean_title(F.regexp_replace(bare, r"^#{1,6}\s*", ""), template)), "__above": F.when(~heading & above.isNotNull(), clean_title(above, template)), "__clean": F.when(heading, sanitized_heading(bare, template))}
    noise = (F.length(title) <= 2) & ~title.rlike("[A-Za-z0-9]")
    compact = F.regexp_replace(t, f"[{T.SPACE}]+", "")
    translated = tuple(x.replace(" ", "") for x in template.translator_back_matter_terms)
    drawings = T.after(F.contains(t, F.lit("![")), F.exists(images_of(t), lambda x: F.lower(x["src"]).endswith(".svg")))
    shown = t.rlike(r"(?i)diagram-\d+\.svg") | has_exact(F.coalesce(F.array_join(paths, " "), F.lit("")), template.diagram_heading_terms)
    line = F.regexp_replace(t, f"[{T.SPACE}]+", " ")
    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    intro = author_intro(t, template)
    once = T.once(blocks, **titles).withColumn("__title", F.when(title == "", template.default_title).otherwise(title))
    out = once.withColumn("__slide", slide_title(t)).withColumn("__chapter", F.last("__slide", ignorenulls=True).over(upto))
    return out.withColumns({
        "__none": t == "", "__image": F.coalesce(kind.isin(*VAULT_IMAGES), F.lit(False)), "__diagram": T.after(drawings, shown), "__heading": F.coalesce(heading, F.lit(False)), "__section": heading & t.startswith("## "),
        "__marker": t.startswith("<!--") & t.rlike(r"(?i)^<!--\s*page:\s*\d+\s*-->$"), "__divider": F.col("__slide").isNotNull(), "__body": chapter_body(t, F.col("__chapter")),
        "__separator": T.after(F.substring(t, 1, 1).isin("=", "-", "—", "_"), (F.length(line) <= 80) & line.rlike(r"(?i)^[=\-—_]{3,}\s*(?:第[一二三四五六七八九十百\d]+[章节篇部分]?|Chapter\s+\d+)\s*[=\-—_]{3,}$")),
        "__translator": T.after(F.contains(t, F.lit("译")), (F.contains(compact, F.lit("译后记")) | F.contains(compact, F.lit("本译本仅供"))) & (_count_terms(compact, translated) >= 3)) if len(translated) >= 3 else F.lit(False),
        "__profile": social_profile(t, template), "__card": author_card(t, template), "__layout": T.after(kind == "table", layout_table(t, template)),
        "__context": F.coalesce(packaging_title(F.col("__above"), template), F.lit(False)),
        "__brand": has_exact(t, template.brand_program_packaging_terms), "__empty": t.startswith("#") & t.rlike(r"^#{1,6}\s*$"), "__packaging": T.after(heading, packaging_title(title, template) | noise),
        "__intro": intro, "__knows": T.after(intro, knowledge_signal(t, template)), "__toc": toc_like(t),
    }).drop("__t", "__title", "__above")


#: The flags that the pass over a document reads.
READ = ("none", "image", "diagram", "heading", "section", "marker", "divider", "chaptered", "separator", "translator", "profile", "card", "layout", "context", "brand", "empty", "packaging", "intro", "knows", "toc")
#: Bits above those of the flags: the status of a block is keep, or discard.
KEPT, GONE = 1 << len(READ), 2 << len(READ)
#: Tests of a kept block in their order; those of the pass stand among them by name.
ORDER = ("marker", "divider", "chaptered", "separator", "translator", "profile", "card", "layout", "context", "brand", "empty")


def verdicts(rows: list[dict]) -> list[str | None]:
    """What becomes of each block of a document, in order: the name of a verdict, "diagram", "chaptered", "review", or nothing."""
    kept = [r["status"] == "keep" for r in rows]
    gone = [r["status"] == "discard" for r in rows]
    out: list[str | None] = [None] * len(rows)

    def drop(i: int, name: str) -> None:
        out[i], kept[i], gone[i] = name, False, True

    def at_front(i: int) -> bool:
        return i <= FRONT and not any(kept[j] and rows[j]["section"] for j in range(i))

    def below_heading(i: int) -> bool:
        seen = False
        for j in range(i - 1, max(-1, i - ABOVE - 1), -1):
            if rows[j]["none"] or gone[j]:
                continue
            if rows[j]["heading"]:
                return True
            if not rows[j]["card"]:
                break
            seen = True
        return seen

    for i, r in enumerate(rows):
        if r["none"]:
            continue
        if r["image"]:
            if r["diagram"]:
                out[i], kept[i], gone[i] = "diagram", True, False
            else:
                drop(i, "image")
            continue
        if not kept[i]:
            continue
        holds = {"profile": lambda i=i: at_front(i), "card": lambda i=i: below_heading(i)}
        name = next((n for n in ORDER if r[n] and (n not in holds or holds[n]())), None)
        if name == "chaptered":
            out[i] = name
        elif name:
            drop(i, name)
        elif r["heading"]:
            if r["packaging"]:
                drop(i, "packaging")
        elif r["intro"]:
            if r["knows"]:
                out[i], kept[i] = "review", False
            else:
                drop(i, "intro")
    above = list(range(-1, len(rows) - 1))  # where to look on above a block that is gone; what was passed is not passed again
    for i, r in enumerate(rows):
        if not kept[i] or not r["toc"]:
            continue
        drop(i, "toc")
        dropped, j, passed = 0, above[i], [i]
        while j >= 0 and dropped < TOC_HEADINGS:
            if not gone[j]:
                if not (kept[j] and rows[j]["heading"]):
                    break
                drop(j, "toc_heading")
                dropped += 1
            passed.append(j)
            j = above[j]
        for k in passed:
            above[k] = j
    return out


@lru_cache(4096)
def _told(bits: int) -> dict:
    """A block's flags and status out of their bits; only read."""
    return {"status": "keep" if bits & KEPT else "discard" if bits & GONE else "", **{n: bool(bits >> k & 1) for k, n in enumerate(READ)}}


@F.pandas_udf(ArrayType(StringType()))
def _decided(documents: pd.Series) -> pd.Series:
    """``verdicts`` of each document's bits."""
    return pd.Series([verdicts([_told(x) for x in bits.tolist()]) for bits in documents], dtype=object)


def curate(blocks: DataFrame, template: Template | None = None) -> DataFrame:
    """Blocks after the policy: status, type, reason, confidence, protected and risk_tags follow the verdicts; adds ``curated_text``.

    Expects (doc_id, ord, status, type, text, protected) and takes heading_path, reason, confidence and risk_tags along."""
    template = template or Template()
    flagged = flags(blocks, template).withColumn("__chaptered", F.col("__body").isNotNull())
    bit = lambda on, n: F.when(on, F.lit(n)).otherwise(F.lit(0))
    bits = sum((bit(F.col(f"__{n}"), 1 << k) for k, n in enumerate(READ)), bit(F.col("status") == "keep", KEPT) + bit(F.col("status") == "discard", GONE))
    own = [*[c for c in blocks.columns if c not in ("doc_id", "ord")], "__heading", "__body", "__clean"]
    whole = flagged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *own, bits.alias("__bits")))).alias("rows"))
    judged = whole.withColumn("verdicts", _decided(F.transform("rows", lambda r: r["__bits"])))
    each = judged.select("doc_id", F.explode(F.arrays_zip("rows", "verdicts")).alias("z")).select("doc_id", *[F.col(f"z.rows.{c}").alias(c) for c in ("ord", *own)], F.col("z.verdicts").alias("__v"))
    table = F.create_map(*[x for name, (to, why, sure) in {**VERDICTS, "diagram": KEEP_DIAGRAM, "review": INTRO_REVIEW}.items() for x in (F.lit(name), F.struct(F.lit(to).alias("to"), F.lit(why).alias("why"), F.lit(sure).alias("sure")))])
    joined = each.withColumn("__x", table[F.col("__v")])
    v = F.col("__v")
    normal = F.coalesce(v.isNull() & F.col("__heading") & (F.col("status") == "keep") & (F.col("__clean") != T.strip(F.col("text"))), F.lit(False))
    tag = F.when(v == "chaptered", "slide_chapter_heading_normalized").when(v == "diagram", "html_diagram").when(v == "review", "possible_author_intro").when(normal, "heading_author_prefix_removed").otherwise(F.col("__x.why"))
    tags = F.col("risk_tags") if "risk_tags" in blocks.columns else F.lit(None).cast("array<string>")
    dropped = v.isin(*VERDICTS)
    column = lambda c, t: F.col(c) if c in blocks.columns else F.lit(None).cast(t)
    return joined.withColumns({
        "status": F.when(dropped, "discard").when(v == "diagram", "keep").when(v == "review", "review").otherwise(F.col("status")), "type": F.coalesce("__x.to", "type"),
        "reason": F.coalesce(F.col("__x.why"), column("reason", "string")), "protected": F.when(dropped, False).otherwise(F.col("protected")), "risk_tags": tagged(tags, tag),
        "confidence": F.when(v == "diagram", F.greatest(F.coalesce(column("confidence", "double"), F.lit(0.0)), F.col("__x.sure"))).otherwise(F.coalesce(F.col("__x.sure"), column("confidence", "double"))),
        "curated_text": F.when(v == "chaptered", F.col("__body")).when(normal, F.col("__clean")),
    }).select(*blocks.columns, *[c for c in ("reason", "confidence", "risk_tags", "curated_text") if c not in blocks.columns])
