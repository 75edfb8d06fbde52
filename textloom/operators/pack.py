"""Greedy packers: one row for each document, in which a fold over lengths numbers the packs; then one row for each pack.

Blocks are grouped by document once. Numbering, and putting packs together, need no second shuffle and no join. Where only
the measures of chunks are asked for (``stats_beside``), the same fold adds them up from lengths, and no text moves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Sizes in characters. Fixed values.
CHUNK_MIN, CHUNK_TARGET, CHUNK_MAX = 300, 1200, 3500
PART_SPLIT, PART_MIN, PART_MAX = 12000, 6000, 18000
REVIEW_WHOLE, REVIEW_BATCH = 80_000, 60_000
#: What blocks may carry into their pack.
CARRIED = ("block_id", "text", "type", "heading_path", "page_start", "page_end")


def _fold(blocks: DataFrame, step, between: int = 2, by: tuple[str, ...] = ("doc_id",), extra: dict[str, Column] | None = None, least: int = 0) -> DataFrame:
    """(by, ord, no, titled, what blocks carry) of kept blocks: ``step(state, item)`` says whether the item opens a new pack; ``between`` counts what joins two texts.

    The state has the size ``cur`` of the open pack, its number ``no``, and the last item's ``page``. Packs of groups of
    fewer than ``least`` characters in all are left out."""
    extra, blocks = extra or {}, kept(blocks)
    carried = [c for c in CARRIED if c in blocks.columns]
    items = F.array_sort(F.collect_list(F.struct("ord", F.length("text").cast("int").alias("len"), *[v.alias(k) for k, v in extra.items()], *carried)))
    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("no"), F.lit(None).cast("int").alias("page"), F.array().cast("array<struct<no:int,titled:boolean>>").alias("out"))

    def add(state: Column, item: Column) -> Column:
        cur = state["cur"]
        opens = (cur == 0) | step(state, item)
        titled = opens & (cur > 0) & (cur < CHUNK_TARGET)  # the item itself ended the pack before
        size = F.when(opens, item["len"]).otherwise(cur + between + item["len"])
        no = state["no"] + F.when(opens, 1).otherwise(0)
        page = F.coalesce(item["page"], state["page"]) if "page" in extra else state["page"]
        return F.struct(size.cast("int").alias("cur"), no.cast("int").alias("no"), page.cast("int").alias("page"), F.concat(state["out"], F.array(F.struct(no.cast("int").alias("no"), titled.alias("titled")))).alias("out"))

    whole = blocks.groupBy(*by).agg(items.alias("items"))
    if least:
        whole = whole.where(F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + x["len"]) >= least)
    numbered = whole.select(*by, F.explode(F.arrays_zip("items", F.aggregate("items", start, add, lambda s: s["out"]).alias("at"))).alias("o"))
    return numbered.select(*by, F.col("o.items.ord").alias("ord"), F.col("o.at.no").alias("no"), F.col("o.at.titled").alias("titled"), *[F.col(f"o.items.{c}").alias(c) for c in carried])


def _own_text(blocks: DataFrame) -> Column:
    return F.coalesce(F.nullif("curated_text", F.lit("")), F.col("text")) if "curated_text" in blocks.columns else F.col("text")


def kept(blocks: DataFrame) -> DataFrame:
    """What is kept and has a text; where blocks carry a curated text, that is it."""
    return blocks.withColumn("text", _own_text(blocks)).where((F.col("status") == "keep") & (F.col("text") != ""))


def chunks_generic(blocks: DataFrame, fold: Callable[..., DataFrame] = _fold) -> DataFrame:
    """(doc_id, ord, no, …): kept blocks packed to the target; a pack never grows past it by another block."""
    return fold(blocks, lambda s, item: s["cur"] + 2 + item["len"] > CHUNK_TARGET)


def chunks_by_heading(blocks: DataFrame, fold: Callable[..., DataFrame] = _fold) -> DataFrame:
    """(doc_id, ord, no, …): a heading opens a chunk if the one before has the least size; a chunk that has the target is closed."""
    heading = {"heading": F.col("type") == "section_heading"}
    return fold(blocks, lambda s, item: ((s["cur"] >= CHUNK_MIN) & (item["heading"] | (s["cur"] + 2 + item["len"] > CHUNK_MAX))) | (s["cur"] >= CHUNK_TARGET), extra=heading)


def chunks_by_page(blocks: DataFrame, fold: Callable[..., DataFrame] = _fold) -> DataFrame:
    """(doc_id, ord, no, page, …): a chunk ends where the page changes or the maximum would be passed; blocks carry ``page_start``."""
    page = F.col("page_start").cast(IntegerType())
    changes = lambda s, item: item["page"].isNotNull() & s["page"].isNotNull() & (item["page"] != s["page"])
    packed = fold(blocks, lambda s, item: changes(s, item) | (s["cur"] + 2 + item["len"] > CHUNK_MAX), extra={"page": page})
    return packed.withColumn("page", F.col("page_start")) if fold is _fold else packed


def parts(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, no, …): parts of documents whose kept text is long; headings break large parts, size breaks the largest."""
    heading = {"heading": F.col("type") == "section_heading"}
    return _fold(blocks, lambda s, item: (s["cur"] >= PART_MIN) & (item["heading"] | (s["cur"] + item["len"] > PART_MAX)), between=0, extra=heading, least=PART_SPLIT)


#: What packs the blocks of each source type; anything else is packed by size, which is worth a warning.
PACKERS = {"pdf_like": chunks_by_heading, "markdown_note": chunks_by_heading, "subtitle_transcript": chunks_generic, "generic_block": chunks_generic}
STRATEGIES = {"preserve_slide_or_page_order": chunks_by_page}
GENERIC_WARNING = "W_GENERIC_SPLITTER_USED"


def packer_of(source_type: str = "generic_block", split_strategy: str | None = None) -> Callable[..., DataFrame]:
    """What packs by the strategy, if it names a packer, else by the source type."""
    return STRATEGIES.get(split_strategy or "") or PACKERS.get(source_type, chunks_generic)


def dispatch(blocks: DataFrame, source_type: str = "generic_block", split_strategy: str | None = None) -> tuple[DataFrame, list[str]]:
    """The chunks by the strategy, if it names a packer, else by the source type; and warnings."""
    packer = packer_of(source_type, split_strategy)
    special = split_strategy in STRATEGIES or source_type in ("pdf_like", "markdown_note", "subtitle_transcript")
    chunks = assemble(blocks, packer(blocks), strategy=split_strategy or "content_structure", opening=packer is chunks_by_heading)
    return chunks, [] if special else [GENERIC_WARNING]


def assemble(blocks: DataFrame, packed: DataFrame, name: str = "chunk_%04d", strategy: str = "content_structure", opening: bool = False) -> DataFrame:
    """(doc_id, chunk_id, block_ids, text, char_count, heading_path, page_start, page_end, split_strategy) of packed blocks.

    The headings are those of the first block that has some; ``opening``: those of the first block, if it was what ended
    the chunk before. Pages reach from the least to the largest of the blocks'."""
    has = set(packed.columns)
    blank = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind).alias(c)
    rows = packed.select("doc_id", "no", "ord", "block_id", "text", *[blank(c, k) for c, k in (("titled", "boolean"), ("heading_path", "array<string>"), ("page_start", "int"), ("page_end", "int"))])
    grouped = rows.groupBy("doc_id", "no").agg(F.array_sort(F.collect_list(F.struct("ord", "block_id", "text", "titled", "heading_path"))).alias("r"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    text = F.array_join(F.transform("r", lambda x: x["text"]), "\n\n")
    nothing = F.array().cast("array<string>")
    first = F.get(F.filter("r", lambda x: F.coalesce(F.size(x["heading_path"]) > 0, F.lit(False))), 0)["heading_path"]
    opened = F.when(F.get("r", 0)["titled"], F.get("r", 0)["heading_path"])
    return grouped.select(
        "doc_id", F.format_string(name, "no").alias("chunk_id"), F.transform("r", lambda x: x["block_id"]).alias("block_ids"), text.alias("text"), F.length(text).cast("long").alias("char_count"),
        F.coalesce(opened if opening else first, nothing).alias("heading_path"), "page_start", "page_end", F.lit(strategy).alias("split_strategy"),
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, those too short or too long, their mean size (half to even), those with an open fence."""
    fences = F.regexp_count("text", F.lit("```"))
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("char_count") < CHUNK_MIN).alias("too_short"), F.count_if(F.col("char_count") > CHUNK_MAX).alias("too_long"),
        F.bround(F.avg("char_count"), 0).cast("long").alias("avg_chars"), F.count_if(fences % 2 == 1).alias("open_fences"),
    )


#: What ``chunk_stats`` says of a document.
STATS = ("chunks", "too_short", "too_long", "avg_chars", "open_fences")


def stats_beside(blocks: DataFrame, packer: Callable[..., DataFrame], *measures: Column) -> DataFrame:
    """(doc_id, measures, STATS): aggregates of all blocks of a document beside the ``chunk_stats`` of what the packer makes of them; null without a chunk.

    One pass over the blocks. Texts are joined by blank lines, so that a chunk's size and fences are sums over its blocks."""
    text = _own_text(blocks)

    def fold(rows: DataFrame, step, extra: dict[str, Column] | None = None) -> DataFrame:
        extra = extra or {}
        item = F.struct("ord", F.length(text).cast("int").alias("len"), F.regexp_count(text, F.lit("```")).alias("fences"), *[v.alias(k) for k, v in extra.items()])
        sized = rows.withColumn("__item", F.when((F.col("status") == "keep") & (text != ""), item))
        whole = sized.groupBy("doc_id").agg(*measures, F.array_sort(F.collect_list("__item")).alias("__items"))
        zero = F.lit(0).cast("long")
        start = F.struct(F.lit(0).alias("cur"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("fences"), zero.alias("chunks"), zero.alias("too_short"), zero.alias("too_long"), zero.alias("chars"), zero.alias("open_fences"))

        def closed(s: Column, now: Column) -> dict[str, Column]:
            """What has been counted, with the open chunk too, if it ends now."""
            one = lambda test: F.when(now & test, F.lit(1)).otherwise(0)
            return {"too_short": s["too_short"] + one(s["cur"] < CHUNK_MIN), "too_long": s["too_long"] + one(s["cur"] > CHUNK_MAX), "chars": s["chars"] + F.when(now, s["cur"]).otherwise(0), "open_fences": s["open_fences"] + one(s["fences"] % 2 == 1)}

        def add(s: Column, item: Column) -> Column:
            opens = (s["cur"] == 0) | step(s, item)
            page = F.coalesce(item["page"], s["page"]) if "page" in extra else s["page"]
            done = closed(s, opens & (s["cur"] > 0))
            state = {"cur": F.when(opens, item["len"]).otherwise(s["cur"] + 2 + item["len"]).cast("int"), "page": page.cast("int"), "fences": (F.when(opens, 0).otherwise(s["fences"]) + item["fences"]).cast("int"), "chunks": s["chunks"] + F.when(opens, 1).otherwise(0), **{k: done[k] for k in ("too_short", "too_long", "chars", "open_fences")}}
            return F.struct(*[v.alias(k) for k, v in state.items()])

        ended = lambda s: F.struct(s["chunks"].alias("chunks"), *[v.alias(k) for k, v in closed(s, s["cur"] > 0).items()])
        return whole.withColumn("__s", F.when(F.size("__items") > 0, F.aggregate("__items", start, add, ended))).drop("__items")

    packed = packer(blocks, fold)
    own = [c for c in packed.columns if c != "__s"]
    mean = F.bround(F.col("__s.chars") / F.col("__s.chunks"), 0).cast("long")
    return packed.select(*own, *[mean.alias(c) if c == "avg_chars" else F.col(f"__s.{c}").alias(c) for c in STATS])


def review_batches(pack: DataFrame, whole: int = REVIEW_WHOLE, target: int = REVIEW_BATCH) -> DataFrame:
    """(doc_id, ord, no, block_id, text): the blocks of review packs in batches by the size of their JSON.

    A pack of up to ``whole`` characters is one batch; a larger one opens a new batch before ``target`` is passed."""
    size = F.length(F.to_json(F.struct(*[c for c in pack.columns if c not in ("doc_id", "ord")]))).cast("int")
    rows = pack.withColumn("__json", size)
    items = F.array_sort(F.collect_list(F.struct("ord", F.col("__json").alias("len"), "block_id", "text")))
    grouped = rows.groupBy("doc_id").agg(items.alias("items"), F.sum("__json").alias("__all"))
    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("out"))

    def add(state: Column, item: Column) -> Column:
        opens = (state["no"] == 0) | ((state["cur"] > 0) & (state["cur"] + 2 + item["len"] > target) & (F.col("__all") > whole))
        no = (state["no"] + F.when(opens, 1).otherwise(0)).cast("int")
        return F.struct(F.when(opens, item["len"]).otherwise(state["cur"] + 2 + item["len"]).cast("int").alias("cur"), no.alias("no"), F.concat(state["out"], F.array(no)).alias("out"))

    numbered = grouped.select("doc_id", F.explode(F.arrays_zip("items", F.aggregate("items", start, add, lambda s: s["out"]).alias("no"))).alias("o"))
    return numbered.select("doc_id", F.col("o.items.ord").alias("ord"), F.col("o.no").alias("no"), F.col("o.items.block_id").alias("block_id"), F.col("o.items.text").alias("text"))
