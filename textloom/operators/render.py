"""Texts of a document from its blocks: the cleaned text, one per status, audits, notes, indexes; and what is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How many blocks an audit names of each kind. Fixed values.
AUDIT = {"discard": 50, "evidence": 30, "review": 30, "risky": 30}
#: Terms of titles -> the folder of a note, asked in this order; all others go to the last. Our own words.
CATEGORIES = (("method", ("Method", "How", "Step", "Guide", "Workflow")), ("cognition", ("Why", "Idea", "Principle", "Trend")), ("case", ("Case", "Story", "Example")))
DEFAULT_CATEGORY = "general"


def readable(blocks: DataFrame) -> Column:
    """The text for readers: the curated one where there is one; nothing for marks of pages."""
    text = F.coalesce(F.nullif("curated_text", F.lit("")), F.col("text")) if "curated_text" in blocks.columns else F.col("text")
    clean = F.trim(text)
    return F.when(F.lower(clean).startswith("<!-- page:") & clean.endswith("-->"), "").otherwise(clean)


def _joined(text: Column, by: str = "\n\n") -> Column:
    rows = F.array_sort(F.collect_list(F.struct("ord", text.alias("x"))))
    return F.array_join(F.transform(rows, lambda r: r["x"]), by)


def shown(blocks: DataFrame) -> Column:
    """Whether a block stands in the cleaned text."""
    return (F.col("status") == "keep") & (readable(blocks) != "")


def cleaned_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, blocks, markdown) of the kept blocks, in order."""
    own = blocks.where(shown(blocks)).withColumn("__t", readable(blocks))
    return own.groupBy("doc_id").agg(F.count("*").alias("blocks"), _joined(F.col("__t")).alias("markdown"))


def _safe(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("--"), F.lit("- -")), r"[\r\n]", " "))


def _listed(c: Column) -> Column:
    quoted = F.transform(c, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.when(F.size(c) > 0, F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")))


def meta_comment(columns: list[str]) -> Column:
    """What is known of a block, as a comment that its text cannot end: id, type, pages, headings, tags, confidence, reason."""
    has = set(columns)
    parts = [F.concat(F.lit("["), _safe(F.coalesce("block_id", F.lit("?"))), F.lit("]")), F.concat(F.lit("type="), _safe(F.coalesce("type", F.lit("unknown"))))]
    if {"page_start", "page_end"} <= has:
        a, b = (F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("page_start", "page_end"))
        pages = F.when(a == b, a).otherwise(F.concat(a, F.lit("-"), b))
        parts.append(F.when(F.col("page_start").isNotNull() | F.col("page_end").isNotNull(), F.concat(F.lit("page="), pages)))
    for column, name in (("heading_path", "heading"), ("risk_tags", "risk_tags")):
        if column in has:
            parts.append(F.concat(F.lit(f"{name}="), _safe(_listed(F.col(column)))))
    parts.append(F.concat(F.lit("confidence="), F.format_string("%.2f", "confidence")))
    if "reason" in has:
        parts.append(F.concat(F.lit("reason="), _safe(F.nullif("reason", F.lit("")))))
    return F.concat(F.lit("<!-- "), F.concat_ws(" ", *parts), F.lit(" -->"))


def by_status(blocks: DataFrame, status: str) -> DataFrame:
    """(doc_id, markdown) of the blocks of one status, each below its comment and followed by an empty line."""
    text = F.trim(F.col("text"))
    body = F.concat(meta_comment(blocks.columns), F.when(text != "", F.concat(F.lit("\n"), text)).otherwise(""), F.lit("\n"))
    return blocks.where(F.col("status") == status).groupBy("doc_id").agg(_joined(body, "\n").alias("markdown"))


def audit(blocks: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """The first blocks of a document that were discarded, are evidence or need review, and of those kept with risk tags, each numbered."""
    most = AUDIT | (most or {})
    tags = F.coalesce(F.size("risk_tags"), F.lit(0)) > 0 if "risk_tags" in blocks.columns else F.lit(False)
    kind = F.when(F.col("status").isin("discard", "evidence", "review"), F.col("status")).when((F.col("status") == "keep") & tags, "risky")
    rank = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("ord"))
    limit = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])[F.col("kind")]
    return blocks.withColumn("kind", kind).where("kind is not null").withColumn("n", rank.cast("long")).where(F.col("n") <= limit)


def category_of(title: Column, categories=CATEGORIES, other: str = DEFAULT_CATEGORY) -> Column:
    """The folder of a note: the first category with a term that stands in the title."""
    def any_of(terms) -> Column:
        found = F.lit(False)
        for term in terms:
            found = found | F.contains(title, F.lit(term))
        return found

    return F.coalesce(*[F.when(any_of(terms), F.lit(name)) for name, terms in categories], F.lit(other))


def safe_filename(title: Column, default: str = "Untitled", most: int = 60) -> Column:
    """A title as the name of a file: marks that no file system takes become dashes, its ends are trimmed, its length bounded."""
    clean = F.regexp_replace(F.regexp_replace(title, r"[<>:\"/\\|?*\x00-\x1f]+", "-"), r"^[ .\-_]+|[ .\-_]+$", "")
    short = F.rtrim(F.substring(F.regexp_replace(clean, r"\s+", " "), 1, most))
    return F.coalesce(F.nullif(short, F.lit("")), F.lit(default))


def _in_sections(blocks: DataFrame) -> DataFrame:
    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.where("status = 'keep'").withColumn("section", F.sum((F.col("type") == "section_heading").cast("int")).over(upto))


def _path(number: Column) -> Column:
    return F.concat(F.col("category"), F.lit("/"), F.format_string("%03d-", number), safe_filename(F.col("title")), F.lit(".md"))


def sections(blocks: DataFrame, categories=CATEGORIES) -> DataFrame:
    """Notes: kept blocks by the heading they follow, with a category by the title's terms and a number in it."""
    kept = _in_sections(blocks)
    notes = kept.groupBy("doc_id", "section").agg(F.min_by(F.when(F.col("type") == "section_heading", F.col("title")), "ord").alias("title"), F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))
    named = notes.withColumn("title", F.coalesce("title", F.lit("Untitled"))).withColumn("category", category_of(F.col("title"), categories))
    number = F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("section"))
    return named.select("doc_id", "section", "title", "category", "blocks", "chars", _path(number).alias("path"))


def source_map(blocks: DataFrame, notes: DataFrame | None = None, categories=CATEGORIES) -> DataFrame:
    """(doc_id, block_id, type, note, heading): the note in which each kept block stands.

    Without ``notes`` they are those of ``sections``, told beside the blocks: these are made once, and nothing is joined."""
    own = _in_sections(blocks)
    if notes is not None:
        return own.select("doc_id", "section", "block_id", "type").join(notes.select("doc_id", "section", F.col("path").alias("note"), F.col("title").alias("heading")), ["doc_id", "section"]).drop("section")
    heading = F.first(F.when(F.col("type") == "section_heading", F.col("title"))).over(Window.partitionBy("doc_id", "section").orderBy("ord"))
    slim = own.select("doc_id", "ord", "section", "block_id", "type", F.coalesce(heading, F.lit("Untitled")).alias("title"))
    number = F.dense_rank().over(Window.partitionBy("doc_id", "category").orderBy("section"))
    return slim.withColumn("category", category_of(F.col("title"), categories)).select("doc_id", "block_id", "type", _path(number).alias("note"), F.col("title").alias("heading"))


def index_page(notes: DataFrame | None, blocks: DataFrame, categories=CATEGORIES) -> DataFrame:
    """(doc_id, markdown): how many blocks were kept, discarded and are for review, and links to the notes by category.

    Without ``notes`` they are those of ``sections``, out of the same pass over the blocks."""
    counted = lambda s: F.count_if(F.col("status") == s).alias(s)
    head = F.concat(*[F.concat(F.lit(f"- {name}: "), F.col(c).cast("string"), F.lit("\n")) for name, c in (("kept", "keep"), ("discarded", "discard"), ("for review", "review"))])
    if notes is None:
        counts, lists = None, _listed_beside(blocks, categories, counted)
    else:
        counts, lists = blocks.groupBy("doc_id").agg(*map(counted, STATUSES)), _lists(notes)
    whole = lists if counts is None else counts.join(lists, "doc_id", "left")
    return whole.select("doc_id", F.concat(F.lit("## Blocks\n\n"), head, F.when(F.col("lists").isNotNull(), F.concat(F.lit("\n"), F.col("lists"))).otherwise("")).alias("markdown"))


#: The statuses that an index counts.
STATUSES = ("keep", "discard", "review")


def _lists(notes: DataFrame, *sums: Column, also: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, lists): links to the notes by category, null without a note. Rows without a category name none."""
    link = F.concat(F.lit("- [["), F.regexp_replace("path", r"\.md$", ""), F.lit("|"), F.col("title"), F.lit("]]"))
    named = F.col("category").isNotNull()
    links = F.collect_list(F.when(named, F.struct("section", link.alias("l"))))
    per = notes.groupBy("doc_id", "category").agg(F.transform(F.array_sort(links), lambda x: x["l"]).alias("links"), *sums)
    part = F.concat(F.lit("## "), F.col("category"), F.lit("\n\n"), F.array_join("links", "\n"))
    parts = F.array_sort(F.collect_list(F.when(named, F.struct("category", part.alias("p")))))
    whole = per.groupBy("doc_id").agg(parts.alias("parts"), *sums)
    return whole.select("doc_id", F.when(F.size("parts") > 0, F.array_join(F.transform("parts", lambda x: x["p"]), "\n\n")).alias("lists"), *also)


def _listed_beside(blocks: DataFrame, categories, counted) -> DataFrame:
    """(doc_id, lists, keep, discard, review): the notes of ``sections`` and all blocks by status, in one pass."""
    heads = (F.col("status") == "keep") & (F.col("type") == "section_heading")
    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("section", F.sum(heads.cast("int")).over(upto))
    first = F.min_by(F.when(F.col("type") == "section_heading", F.col("title")), F.when(F.col("status") == "keep", F.col("ord")))
    found = rows.groupBy("doc_id", "section").agg(F.coalesce(first, F.lit("Untitled")).alias("title"), *map(counted, STATUSES))
    named = found.withColumn("category", F.when(F.col("keep") > 0, category_of(F.col("title"), categories)))
    number = F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("section"))
    return _lists(named.withColumn("path", _path(number)), *[F.sum(s).alias(s) for s in STATUSES], also=tuple(map(F.col, STATUSES)))


def write_blocks(blocks: DataFrame, path: str, batch: str) -> None:
    """Blocks as JSON lines, one folder a batch, so that a batch which runs again replaces its own only."""
    blocks.write.mode("overwrite").json(f"{path}/batch={batch}")


def append_lines(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines; each call adds files of its own, so none waits for a lock."""
    rows.write.mode("append").json(path)


def publishable(rendered: DataFrame, gates: DataFrame) -> DataFrame:
    """The rendered documents whose export gate was decided and does not fail; what has no gate is not published."""
    ready = gates.where("gate = 'export_readiness' and status <> 'fail'").select("doc_id").distinct()
    return rendered.join(ready, "doc_id", "left_semi")


def write_published(rendered: DataFrame, gates: DataFrame, path: str, batch: str) -> None:
    """Writes what may be published, one folder a batch: writing again changes nothing, and other batches stay."""
    publishable(rendered, gates).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def expired(runs: DataFrame, protected: DataFrame, now, keep: int = 3, days: int = 7) -> DataFrame:
    """(root, path, action): which run folders a clean-up would remove. ``runs(root, path, mtime)``, ``protected(prefix)``.

    The newest ``keep`` of a root stay, and so does what is younger than ``days`` or lies below a protected path. Only a
    plan: nothing is touched here."""
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("mtime"), F.desc("path")))
    old = F.datediff(F.lit(now).cast("timestamp"), F.col("mtime")) > days
    own = runs.withColumn("__rank", rank)
    below = own.join(F.broadcast(protected.select(F.col("prefix").alias("__p")).distinct().limit(1000)), (F.col("path") == F.col("__p")) | F.col("path").startswith(F.concat("__p", F.lit("/"))), "left_semi").select("root", "path", F.lit(True).alias("__safe"))
    marked = own.join(below.distinct(), ["root", "path"], "left")
    return marked.select("root", "path", F.when(F.col("__safe").isNotNull(), "protected").when((F.col("__rank") <= keep) | ~old, "keep").otherwise("remove").alias("action"))
