"""Retention, safety and integrity measures per document, and the gates that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators import blocks as B
from textloom.operators import classify as C
from textloom.operators import pack as P
from textloom.rules import RuleSet

#: Thresholds; coverage by source type, and for all others. Fixed values.
DISCARD_WARN, DISCARD_STRICT = 0.25, 0.45
COVERAGE = {"pdf_like": (0.82, 0.72), "markdown_note": (0.86, 0.76), "generic_block": (0.88, 0.78)}
COVERAGE_OTHER = (0.80, 0.70)
GATES = ("conversion_integrity", "cleanup_safety", "splitting_integrity", "review_safety", "export_readiness")
#: Types whose discarding is expected and does not count as a loss. Fixed values.
EXEMPT = (
    "page_marker", "slide_chapter_divider", "translator_marketing_back_matter", "transcript_filler", "marketing_cta", "marketing_wrapper", "author_identity", "author_intro", "image_artifact",
    "layout_table_artifact", "layout_separator", "author_profile_links", "toc", "toc_heading", "empty_heading", "back_matter", "refund_policy", "footer", "qr_image", "empty",
)
#: Of those, the ones that are pollution whatever details they hold; and tags that say so of others. Fixed values.
ALWAYS_POLLUTION = (
    "page_marker", "slide_chapter_divider", "translator_marketing_back_matter", "author_identity", "author_intro", "author_profile_links", "image_artifact", "layout_table_artifact", "layout_separator",
    "toc", "toc_heading", "empty_heading",
)
POLLUTION_TAGS = {
    "marketing_wrapper": ("drop_packaging_context_for_text_kb", "drop_packaging_heading_for_text_kb", "drop_brand_program_packaging_for_text_kb"),
    "marketing_cta": ("promotional_line",),
}


def image_only(text: Column) -> Column:
    """Whether a text is nothing but images."""
    return text.rlike(T.IMAGE) & (T.strip(F.regexp_replace(text, T.IMAGE, "")) == "")


def counts_for_coverage(blocks: DataFrame) -> Column:
    """Whether a block is body text whose loss counts: not expected pollution that was discarded, not an image alone."""
    kind = F.col("type")
    return ~((F.col("status") == "discard") & kind.isin(*EXEMPT)) & ~(kind.isin(*C.IMAGE_TYPES) & image_only(F.col("text")))


def known_pollution(kind: Column, tags: Column, categories: Column) -> Column:
    """Whether discarding a block of this type loses no detail: by its type, its tags, or for want of strict categories."""
    tagged = F.lit(False)
    for name, wanted in POLLUTION_TAGS.items():
        tagged = tagged | ((kind == name) & F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, wanted))))
    strict = F.arrays_overlap(categories, F.array(*map(F.lit, C.STRICT_DETAILS)))
    return F.coalesce(kind.isin(*ALWAYS_POLLUTION) | tagged | (kind.isin(*EXEMPT) & ~strict), F.lit(False))


def status_counts(blocks: DataFrame) -> DataFrame:
    statuses = ("keep", "discard", "evidence", "review", "unclassified")
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def cleanup_measures(blocks: DataFrame, packer=None, also: dict[str, Column] | None = None) -> DataFrame:
    """Per document: share of eligible blocks discarded, share of eligible characters kept, protected blocks lost.

    With a packer (of ``pack``) also the ``chunk_stats`` of its chunks, and the aggregates ``also``, out of the same pass over the blocks."""
    also = also or {}
    rows = blocks.withColumns({"__eligible": counts_for_coverage(blocks), "__size": F.length("text")})
    eligible, gone, size = F.col("__eligible"), F.col("status") == "discard", F.col("__size")
    lost = lambda kind: F.count_if(gone & (F.col("type") == kind))
    own = (
        F.count_if(eligible).alias("eligible"), F.count_if(eligible & gone).alias("discarded"), F.coalesce(F.sum(F.when(eligible, size)), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(F.when(eligible & (F.col("status") == "keep"), size)), F.lit(0)).alias("kept_chars"), F.count_if(gone & F.col("protected")).alias("protected_lost"),
        lost("operation_step").alias("steps_lost"), lost("code").alias("code_lost"), lost("table").alias("tables_lost"),
        *[v.alias(k) for k, v in also.items()],
    )
    made = rows.groupBy("doc_id").agg(*own) if packer is None else P.stats_beside(rows, packer, *own)
    return made.select(
        "doc_id", "eligible", "discarded", F.when(F.col("eligible") > 0, F.round(F.col("discarded") / F.col("eligible"), 4)).otherwise(0.0).alias("discard_ratio"),
        F.when(F.col("chars") > 0, F.round(F.col("kept_chars") / F.col("chars"), 4)).otherwise(1.0).alias("coverage"), "protected_lost", "steps_lost", "code_lost", "tables_lost", *(P.STATS if packer else ()), *also,
    )


def detail_retention(blocks: DataFrame) -> DataFrame:
    """Per document and category of detail: blocks by status."""
    rows = blocks.select("doc_id", "status", F.explode(C.detail_categories(F.col("text"), F.col("type"))).alias("category"))
    return rows.groupBy("doc_id", "category").agg(F.count("*").alias("blocks"), *[F.count_if(F.col("status") == s).alias(s) for s in ("keep", "discard", "evidence", "review")])


def lost_details(blocks: DataFrame) -> DataFrame:
    """(doc_id, lost, block_ids): discarded blocks that hold strict details (more than links alone) and are no known pollution."""
    tags = F.col("risk_tags") if "risk_tags" in blocks.columns else F.lit(None).cast("array<string>")
    rows = T.once(blocks.where("status = 'discard'"), __c=C.detail_categories(F.col("text"), F.col("type")))
    strict = F.array_except(F.array_intersect("__c", F.array(*map(F.lit, C.STRICT_DETAILS))), F.array(F.lit("link")))
    lost = rows.where((F.size(strict) > 0) & ~known_pollution(F.col("type"), tags, F.col("__c")))
    return lost.groupBy("doc_id").agg(F.count("*").alias("lost"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id"))), lambda x: x["block_id"]).alias("block_ids"))


def cta_violations(blocks: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """(doc_id, violations): kept blocks that a call to action or a rule still speaks in, and that are no lesson on it."""
    rules = rules or RuleSet()
    t = F.col("text")
    polluted = C.cta_signal(t, rules) | rules.any_rule(t)
    allowed = F.col("protected") | F.col("type").isin(*C.DETAIL_TYPES) | C.has_exact(t, rules.knowledge)
    return blocks.groupBy("doc_id").agg(F.count_if((F.col("status") == "keep") & polluted & ~allowed).alias("violations"))


def qr_matches(cleaned: DataFrame, rules: RuleSet | None = None, text_col: str = "markdown") -> DataFrame:
    """(doc_id, qr_images): lines of cleaned texts with an image whose address has a marker of codes to scan."""
    rules = rules or RuleSet()
    markers = "|".join(T._quoted(m) for m in rules.qr_markers)
    found = T.count(F.col(text_col), rf"(?iu)!\[.*\]\(.*(?:{markers}).*\)") if markers else F.lit(0).cast("long")
    return cleaned.select("doc_id", found.alias("qr_images"))


#: What output must still hold of what was kept. Fixed values.
LINK = r"(?i)https?://\S+|www\.\S+"
NAMED_PARAMETER = r"(?i)\b(?:threshold|retry_count|failure_reason|temperature|top_p|model|seed)\s*=\s*[^,\s，。]+"
_TAIL = r"[.,;:!?，。；：！？]+$"
_RULE_LINE = r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$"


def _signals(texts: Column, pattern: str) -> Column:
    each = F.flatten(F.transform(texts, lambda x: F.regexp_extract_all(x, T.rx(pattern), 0)))
    return F.filter(F.array_distinct(F.transform(each, lambda x: F.regexp_replace(T.strip(x), _TAIL, ""))), lambda x: x != "")


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(T.strip(c), f"[{T.SPACE}]+", " ")


def _first_line(text: Column, drop: str) -> Column:
    return F.get(F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: (x != "") & ~x.rlike(drop)), 0)


def code_probe(text: Column) -> Column:
    """The first line of a code block's body; null for none."""
    body = F.regexp_replace(F.regexp_replace(T.strip(text), r"^\s*```[^\n]*\n?", ""), r"\n?```\s*$", "")
    return _first_line(body, "^$")


def table_cells(line: Column) -> Column:
    """The cells of a table's line that hold something, squeezed and in lower case."""
    bare = F.regexp_replace(T.strip(line), r"^\|+|\|+$", "")
    return F.transform(F.filter(F.split(bare, r"\|"), lambda c: T.strip(c) != ""), lambda c: F.lower(_squeezed(c)))


def table_probe(text: Column) -> Column:
    """The cells of a table's first line that is not its rule."""
    return table_cells(F.coalesce(_first_line(text, _RULE_LINE), F.lit("")))


def output_retention(blocks: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per document: links, named parameters, code and tables of kept, review and evidence blocks that their output lacks.

    ``outputs(doc_id, primary, review, evidence)``: the texts that were rendered; a null text holds nothing. Links are
    compared in lower case, parameters without white space, code by its first line, tables by the cells of a first row
    that some row of the output must hold."""
    grouped = blocks.where(F.col("status").isin("keep", "review", "evidence")).groupBy("doc_id").agg(F.collect_list(F.struct("status", "type", "text")).alias("b"))
    joined = grouped.join(outputs.select("doc_id", *[F.coalesce(F.col(c), F.lit("")).alias(f"__{c}") for c in ("primary", "review", "evidence")]), "doc_id", "left")
    tight = lambda c: F.lower(F.regexp_replace(c, f"[{T.SPACE}]+", ""))

    def lacking(status: str, target: Column) -> dict[str, Column]:
        own = F.filter("b", lambda x: x["status"] == status)
        texts = F.transform(own, lambda x: x["text"])
        of = lambda kind: F.transform(F.filter(own, lambda x: x["type"] == kind), lambda x: x["text"])
        rows = F.transform(F.filter(F.split(target, "\n"), lambda x: F.contains(x, F.lit("|")) & ~T.strip(x).rlike(_RULE_LINE)), table_cells)
        return {
            "links": F.filter(_signals(texts, LINK), lambda x: ~F.contains(F.lower(target), F.lower(x))),
            "parameters": F.filter(_signals(texts, NAMED_PARAMETER), lambda x: ~F.contains(tight(target), tight(x))),
            "code": F.filter(F.transform(of("code"), code_probe), lambda x: x.isNotNull() & ~F.contains(_squeezed(target), _squeezed(x))),
            "tables": F.filter(F.transform(of("table"), table_probe), lambda x: (F.size(x) > 0) & ~F.exists(rows, lambda row: F.size(F.array_except(x, row)) == 0)),
        }

    totals, columns = [], [F.col("doc_id")]
    for status, name in (("keep", "primary"), ("review", "review"), ("evidence", "evidence")):
        for key, found in lacking(status, F.coalesce(F.col(f"__{name}"), F.lit(""))).items():
            columns.append(F.size(found).cast("long").alias(f"{name}_{key}"))
            totals.append(f"{name}_{key}")
    counted = joined.select(*columns)
    return counted.withColumn("missing_total", sum((F.col(c) for c in totals), F.lit(0).cast("long")))


def structure_integrity(source: DataFrame, converted: DataFrame) -> DataFrame:
    """Per document: headings of the source that the converted text lacks, and tables, code blocks and images that it has fewer of.

    Both are (doc_id, text). A heading that stands twice and is missing counts twice; the first 50 are named."""
    before = B.structure_counts(source).join(source.select("doc_id", B.heading_list(F.coalesce("text", F.lit(""))).alias("heads")), "doc_id")
    after = B.structure_counts(converted).join(converted.select("doc_id", B.heading_list(F.coalesce("text", F.lit(""))).alias("heads")), "doc_id")
    kinds = ("tables", "code_blocks", "images")
    other = after.select("doc_id", F.col("heads").alias("c_heads"), *[F.col(k).alias(f"c_{k}") for k in kinds])
    lost = F.filter("heads", lambda h: ~F.array_contains(F.coalesce("c_heads", F.array().cast("array<string>")), h))
    gone = [F.greatest(F.lit(0).cast("long"), F.col(k) - F.coalesce(F.col(f"c_{k}"), F.lit(0))).alias(f"missing_{k}") for k in kinds]
    return before.join(other, "doc_id", "left").select("doc_id", F.size("heads").cast("long").alias("headings"), F.size(lost).cast("long").alias("missing_headings"), F.slice(lost, 1, 50).alias("names"), *gone)


def missing_signals(blocks: DataFrame, pattern: str) -> DataFrame:
    """Per document: distinct matches of a pattern in all blocks, and those that no kept block holds (anti-join)."""
    found = blocks.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("signal"), (F.col("status") == "keep").alias("kept"))
    each = found.groupBy("doc_id", "signal").agg(F.bool_or("kept").alias("kept"))
    return each.groupBy("doc_id").agg(F.count("*").alias("signals"), F.count_if(~F.col("kept")).alias("missing"))


def structure_loss(source: DataFrame, converted: DataFrame) -> DataFrame:
    """Per document: structures of the source that the converted text has fewer of."""
    kinds = ("headings", "tables", "code_blocks", "images")
    other = converted.select("doc_id", *[F.col(k).alias(f"c_{k}") for k in kinds])
    return source.join(other, "doc_id", "left").select("doc_id", *[F.greatest(F.lit(0).cast("long"), F.col(k) - F.coalesce(F.col(f"c_{k}"), F.lit(0))).alias(f"missing_{k}") for k in kinds])


def with_messages(measures: DataFrame, chunk_stats: DataFrame | None = None, loss: DataFrame | None = None, source_type: str = "generic_block") -> DataFrame:
    """Adds ``messages``, an array of (level, code, gate): what the measures of a document give rise to."""
    m = measures
    coverage_warn, coverage_strict = COVERAGE.get(source_type, COVERAGE_OTHER)
    for other in (chunk_stats, loss):
        if other is not None:
            m = m.join(other, "doc_id", "left")
    has = set(m.columns)
    tests = [
        ("error", "discard_ratio_strict", F.col("discard_ratio") > DISCARD_STRICT), ("warning", "discard_ratio", F.col("discard_ratio").between(DISCARD_WARN, DISCARD_STRICT) & (F.col("discard_ratio") > DISCARD_WARN)),
        ("error", "coverage_strict", F.col("coverage") < coverage_strict), ("warning", "coverage", (F.col("coverage") >= coverage_strict) & (F.col("coverage") < coverage_warn)),
        ("error", "protected_lost", F.col("protected_lost") > 0),
    ]
    if "open_fences" in has:
        tests += [("error", "broken_code", F.col("open_fences") > 0), ("warning", "chunk_too_short", F.col("too_short") > 0), ("warning", "chunk_too_long", F.col("too_long") > 0)]
    if "missing_headings" in has:
        tests += [("error", "structure_loss", F.col("missing_headings") + F.col("missing_tables") + F.col("missing_code_blocks") + F.col("missing_images") > 0)]
    found = [F.when(test, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(gate_of(code)).alias("gate"))) for level, code, test in tests]
    return m.withColumn("messages", F.array_compact(F.array(*found)))


def gate_of(code: str) -> str:
    """The gate that a message belongs to, by its code."""
    if code == "structure_loss":
        return GATES[0]
    if code.startswith(("chunk", "broken")):
        return GATES[2]
    return GATES[1] if any(x in code for x in ("discard", "coverage", "protected")) else GATES[4]


def gate_of_message(message: Column, warning: Column) -> Column:
    """The gate that a message in words belongs to, by how it begins and what it names."""
    low = F.lower(message)
    conversion = message.rlike(r"^(?:E_TEXT_LAYER_|E_CONVERTED_TEXT_|E_SOURCE_CONVERSION_LOSS|E_CONVERSION_STRUCTURE_LOSS|W_SOURCE_TEXT_LAYER|W_PDF_TEXT_LAYER)|referenced image files are missing|SVG diagram files")
    splitting = message.rlike("broken code|broken table|broken ordered list|block trace") | (warning & low.rlike("chunk|split"))
    cleanup = message.rlike("^(?:E_QA_FAILED|W_QA)|CTA|QR") | low.contains("discard")
    return F.when(conversion, GATES[0]).when(splitting, GATES[2]).when(cleanup, GATES[1]).otherwise(GATES[4])


#: What to do about a gate that fails, and with what. Fixed values; the goals are our own words.
ACTIONS = {
    "conversion_integrity": ("inspect_or_rerun_conversion", "converted_md_and_source_evidence", "make the converted text hold what the source holds"),
    "cleanup_safety": ("update_cleaning_rules_or_review_pack", "cleaning_rules", "clean without losing what is worth keeping"),
    "splitting_integrity": ("adjust_splitter_or_chunking", "splitter", "split without breaking fences, tables and lists"),
    "review_safety": ("validate_review_patch", "review_patch", "let only sound patches through"),
    "export_readiness": ("block_export", "latest_outputs", "publish nothing while an error stands"),
}
STOP = ("export_readiness", "stop_iteration", "quality_loop", "mend the cause before another round")


def quality_loop(documents: DataFrame, iteration: str = "iteration", most: str = "max_iterations") -> DataFrame:
    """``documents(doc_id, errors, iteration, max_iterations)`` -> where the rounds of review of each document stand.

    Nulls count as round 1 of 3, smaller numbers as 1. Reaching the limit with errors is one error more."""
    now, limit = F.greatest(F.coalesce(F.col(iteration), F.lit(1)), F.lit(1)), F.greatest(F.coalesce(F.col(most), F.lit(3)), F.lit(1))
    wrong = F.col("errors") > 0
    full = wrong & (now >= limit)
    status = F.when(~wrong, "passed").when(full, "iteration_limit_reached").otherwise("needs_iteration")
    return documents.select(
        "doc_id", now.cast("int").alias("current_iteration"), limit.cast("int").alias("max_iterations"), F.greatest(F.lit(0), limit - now).cast("int").alias("remaining_iterations"),
        (wrong & ~full).alias("can_continue"), status.alias("status"), (F.col("errors") + full.cast("int")).cast("long").alias("strict_errors"),
    )


def quality_tasks(gated: DataFrame, loop: DataFrame | None = None) -> DataFrame:
    """(doc_id, task_no, task_id, gate, action, target, goal, errors): what is to be done for each gate that fails, in their order.

    A document at the limit of its rounds first has to stop."""
    names = F.create_map(*[x for i, (g, (a, t, goal)) in enumerate(ACTIONS.items()) for x in (F.lit(g), F.struct(F.lit(i + 1).alias("at"), F.lit(a).alias("action"), F.lit(t).alias("target"), F.lit(goal).alias("goal")))])
    rows = gated.where("status = 'fail'").withColumn("x", names[F.col("gate")]).select("doc_id", "x.at", F.col("gate"), "x.action", "x.target", "x.goal", "errors")
    if loop is not None:
        _, action, target, goal = STOP
        stop = loop.where("status = 'iteration_limit_reached'").select("doc_id", F.lit(0).alias("at"), F.lit("quality_loop").alias("gate"), F.lit(action).alias("action"), F.lit(target).alias("target"), F.lit(goal).alias("goal"), F.col("strict_errors").alias("errors"))
        rows = rows.unionByName(stop)
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    name = F.concat(F.format_string("quality-task-%02d-", no), F.replace("gate", F.lit("_"), F.lit("-")))
    return rows.select("doc_id", no.cast("long").alias("task_no"), name.alias("task_id"), "gate", "action", "target", "goal", "errors")


def failed(messages):
    """Whether a document has an error, which holds up its export."""
    return F.exists(messages, lambda m: m["level"] == "error")


def gates(messaged: DataFrame, reviewed: bool = False) -> DataFrame:
    """Five rows per document: errors, warnings, status fail > warn > pass, or not_checked. Every error also holds up export.

    Takes rows with ``messages``; a map over documents, without a join or a shuffle of its own."""
    each = messaged.select("doc_id", "messages", F.explode(F.array(*map(F.lit, GATES))).alias("gate"))
    own = lambda level, m: (m["level"] == level) & ((m["gate"] == F.col("gate")) | ((F.lit(level) == "error") & (F.col("gate") == GATES[4])))
    count = lambda level: F.size(F.filter("messages", lambda m: own(level, m))).cast("long")
    counted = each.select("doc_id", "gate", count("error").alias("errors"), count("warning").alias("warnings"))
    checked = F.lit(reviewed) | (F.col("gate") != GATES[3])
    return counted.withColumn("status", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "warn").when(checked, "pass").otherwise("not_checked"))
