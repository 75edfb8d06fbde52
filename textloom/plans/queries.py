"""The library's queries: each applies operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators import blocks as B
from textloom.operators import classify as C
from textloom.operators import convert as V
from textloom.operators import diagnose as D
from textloom.operators import feedback as K
from textloom.operators import images as I
from textloom.operators import pack as P
from textloom.operators import quality as Q
from textloom.operators import render as R
from textloom.operators import titles as N
from textloom.plans import fixtures as X
from textloom.plans.prepare import prepare, skip_known
from textloom.rules import RuleSet
from textloom.sources import tables as S
from textloom.streaming.stream import event_counts

#: What must not get lost of a text: addresses, and settings of any name.
LINK, PARAMETER = r"https?://[^ \t\n]+", r"[a-zA-Z_][a-zA-Z0-9_-]*=[^, \t\n]+"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "documents")


def md(spark: SparkSession, sf: str) -> DataFrame:
    return S.markdown(docs(spark, sf))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return B.blockify(md(spark, sf))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return C.apply_rules(C.classify(blocks(spark, sf)))


@query
def text_quality(spark, sf):
    return D.text_quality(docs(spark, sf))


@query
def text_quality_by_lang(spark, sf):
    measured = D.text_quality(docs(spark, sf), also=("lang", "alnum")).withColumnRenamed("alnum", "a")
    return measured.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("total_chars").alias("chars"), F.round(F.sum("a") / F.sum("total_chars"), 4).alias("alnum_ratio"), F.count_if(F.col("unreadable_text_ratio") > 0.03).alias("unreadable_docs"))


@query
def unreadable_docs(spark, sf):
    return D.text_quality(docs(spark, sf)).where("unreadable_text_ratio > 0.03").select("doc_id", "unreadable_text_ratio")


@query
def language_detect(spark, sf):
    return docs(spark, sf).select("doc_id", D.language(F.col("text")).alias("detected"))


@query
def text_profile(spark, sf):
    return D.text_profile(md(spark, sf))


@query
def doc_type(spark, sf):
    found = D.document_type(S.table(spark, sf, "pages"), "page_id", "html", detected_format=F.lit("html"))
    return found.withColumn("reasons", F.array_join("reasons", "; "))


@query
def is_garbled(spark, sf):
    return docs(spark, sf).select("doc_id", C.is_garbled(F.col("text")).alias("garbled"))


@query
def lines_explode(spark, sf):
    return B.lines(docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.count_if(F.col("line") == "").alias("blank"))


@query
def blockify(spark, sf):
    return blocks(spark, sf).select("doc_id", "block_id", "type", F.md5(F.col("text").cast("binary")).alias("text_md5"), "line_start", "line_end", "protected")


@query
def block_types(spark, sf):
    return blocks(spark, sf).groupBy("type").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


@query
def heading_path(spark, sf):
    return B.with_heading_path(blocks(spark, sf)).select("doc_id", "block_id", F.array_join("heading_path", " / ").alias("path"))


@query
def page_asof(spark, sf):
    source = md(spark, sf)
    at = F.explode(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1, F.lit(7)))
    page_map = source.select("doc_id", at.alias("line")).withColumn("page", (F.floor(F.col("line") / 7) + 1).cast("int"))
    return B.with_pages(B.blockify(source), page_map).select("doc_id", "block_id", "page_start", "page_end")


@query
def image_context_window(spark, sf):
    return B.image_context(md(spark, sf)).select("doc_id", "i", "src", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query
def classify_blocks(spark, sf):
    return C.classify(blocks(spark, sf)).select("doc_id", "block_id", "status", "type", "protected", "confidence")


@query
def clean_rules(spark, sf):
    return cleaned(spark, sf).select("doc_id", "block_id", "status", "type", "protected", "cleaning_rule_id")


@query
def rule_first_match(spark, sf):
    return B.lines(docs(spark, sf)).select("doc_id", "i", RuleSet().first_rule(F.col("line")).alias("rule")).where("rule is not null")


@query
def cta_lines(spark, sf):
    return B.lines(md(spark, sf)).where(T.any_term(F.col("line"), list(RuleSet().cta))).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query
def status_counts(spark, sf):
    return Q.status_counts(cleaned(spark, sf))


@query
def cleanup_measures(spark, sf):
    return Q.cleanup_measures(cleaned(spark, sf))


@query
def detail_retention(spark, sf):
    return Q.detail_retention(cleaned(spark, sf))


@query
def link_retention(spark, sf):
    return Q.missing_signals(cleaned(spark, sf), LINK)


@query
def parameter_retention(spark, sf):
    return Q.missing_signals(cleaned(spark, sf), PARAMETER)


@query
def structure_counts(spark, sf):
    return B.structure_counts(md(spark, sf))


@query
def quality_gates(spark, sf):
    return Q.gates(Q.with_messages(Q.cleanup_measures(cleaned(spark, sf))))


@query
def next_actions(spark, sf):
    return quality_gates(spark, sf).where(F.col("status").isin("fail", "warn")).groupBy("gate", "status").agg(F.count("*").alias("docs"))


def _chunks(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "chunk_id", F.array_join("block_ids", ",").alias("block_ids"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "char_count")


@query
def chunks_generic(spark, sf):
    b = cleaned(spark, sf)
    return _chunks(P.assemble(b, P.chunks_generic(b)))


@query
def chunks_by_heading(spark, sf):
    b = cleaned(spark, sf)
    return _chunks(P.assemble(b, P.chunks_by_heading(b)))


@query
def chunk_stats(spark, sf):
    b = cleaned(spark, sf)
    return P.chunk_stats(P.assemble(b, P.chunks_generic(b)))


@query
def corpus_health(spark, sf):
    """The flagship: per source and language, what cleaning keeps and how many documents may be published."""
    m = Q.with_messages(Q.cleanup_measures(cleaned(spark, sf)))
    rows = m.join(docs(spark, sf).select("doc_id", "source", "lang"), "doc_id")
    bad = Q.failed(F.col("messages"))
    return rows.groupBy("source", "lang").agg(
        F.count("*").alias("docs"), F.sum("eligible").alias("eligible"), F.sum("discarded").alias("discarded"), F.round(F.avg("coverage"), 6).alias("coverage"), F.count_if(bad).alias("failed"), F.count_if(~bad).alias("publishable")
    )


# Derived inputs: the same expressions make them in Spark and in SQL (see ``fixtures``).


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).selectExpr(*X.FILES)


def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).join(S.table(spark, sf, "labels"), "doc_id").selectExpr(*X.FEEDBACK)


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "events").selectExpr(*X.PATCHES)


def _md5(c: str = "markdown"):
    return F.md5(F.col(c).cast("binary")).alias("md5")


@query
def html_profile_text(spark, sf):
    t = V.html_profile_text(F.coalesce("html", F.lit("")))
    return S.table(spark, sf, "pages").select("page_id", t.alias("markdown")).select("page_id", F.length("markdown").cast("long").alias("chars"), _md5())


@query
def html_to_markdown(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", V.html_to_markdown("html").alias("markdown"))


@query
def html_blocks(spark, sf):
    pages = S.table(spark, sf, "pages").select("page_id", V.html_to_markdown("html").alias("markdown"))
    return B.blockify(pages, "page_id", "markdown").groupBy("type").agg(F.count("*").alias("blocks"))


@query
def conversation_transcript(spark, sf):
    return V.conversation_markdown(S.table(spark, sf, "conversations")).select("conv_id", "turns", _md5())


@query
def conversation_turn_gaps(spark, sf):
    """Turns of equal role in a row, by running counts."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = S.table(spark, sf, "conversations").withColumn("again", F.coalesce(F.col("role") == F.lag("role").over(w), F.lit(False)))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if("again").alias("repeats"), F.max("turn").alias("last_turn"))


@query
def csv_to_markdown(spark, sf):
    return V.table_lines(S.table(spark, sf, "part"), ["p_partkey", "p_name", "p_brand", "p_size"], "p_partkey")


@query
def delimited_files(spark, sf):
    cells = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit("|")), F.lit(" "), F.lit(", "))
    rows = docs(spark, sf).select("doc_id", V.csv_to_markdown(cells).alias("markdown"))
    return rows.select("doc_id", F.length("markdown").cast("long").alias("chars"), _md5())


@query
def json_pretty(spark, sf):
    return S.table(spark, sf, "events").select("event_id", V.json_to_markdown("props").alias("markdown"))


@query
def subtitle_transcript(spark, sf):
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("turn", cue.alias("c"))))
    srt = S.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["c"]), "\n\n").alias("srt"))
    return srt.select("conv_id", V.subtitle_to_markdown("srt").alias("markdown"))


@query
def code_fence(spark, sf):
    return md(spark, sf).select("doc_id", V.code_to_markdown(F.col("text"), "text").alias("markdown")).select("doc_id", _md5())


@query
def fence_close(spark, sf):
    left_open = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("\n```\nleft open"))).otherwise(F.col("text"))
    return md(spark, sf).select("doc_id", V.close_fence(left_open).alias("markdown")).select("doc_id", F.length("markdown").cast("long").alias("chars"), _md5())


@query
def consecutive_dedupe(spark, sf):
    return docs(spark, sf).select("doc_id", V.drop_repeated_lines(F.col("text")).alias("markdown")).select("doc_id", F.length("markdown").cast("long").alias("chars"), _md5())


@query
def unwrap_lines(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(F.split(V.unwrap_lines(F.col("text")), "\n")).alias("lines"))


@query
def format_inventory(spark, sf):
    return S.inventory(_files(spark, sf)).groupBy("format", "action", "skip_reason").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query
def source_domain_pages(spark, sf):
    return S.table(spark, sf, "pages").groupBy(K.source_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query
def source_pattern_pages(spark, sf):
    u = F.col("url")
    return S.table(spark, sf, "pages").select("page_id", K.source_matches(u, "source_domain:example.com").alias("by_domain"), F.lower(F.regexp_extract("url", "^(https?://[^/]+)", 1)).alias("host"))


@query
def promo_split(spark, sf):
    rows = C.split_promo(C.classify(blocks(spark, sf)))
    return rows.select("doc_id", "block_id", "sub_ord", "status", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def classify_images(spark, sf):
    source = md(spark, sf)
    rows = I.classify_images(B.with_heading_path(C.classify(B.blockify(source))), I.contexts(source))
    return rows.where("image_type is not null").select("doc_id", "block_id", "status", "image_type")


@query
def review_pack(spark, sf):
    return K.review_pack(cleaned(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


@query
def patch_validate(spark, sf):
    found = K.validate_patch(_patches(spark, sf), cleaned(spark, sf))
    return found.groupBy(F.coalesce("rejected", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("ops"))


@query
def patch_apply(spark, sf):
    out = K.apply_patch(cleaned(spark, sf), _patches(spark, sf))
    return out.select("doc_id", "block_id", "status", "patched", F.round("confidence", 4).alias("confidence"), F.array_join("risk_tags", ",").alias("tags"))


@query
def feedback_action(spark, sf):
    return docs(spark, sf).select("doc_id", K.infer_action(F.col("text")).alias("action"), K.infer_pattern(F.col("text")).alias("pattern"))


@query
def feedback_acceptance(spark, sf):
    return K.accepted(docs(spark, sf).selectExpr(*X.PROPOSALS)).select("id", "ok")


@query
def feedback_repeat_sources(spark, sf):
    return K.repeated_sources(_feedback(spark, sf))


@query
def dictionary_suggestions(spark, sf):
    rows = _feedback(spark, sf)
    return K.suggestions(rows, rows.where("status = 'rejected'")).select("document_type", "pattern", "sources", "first_seen")


@query
def promotion_summary(spark, sf):
    return K.promotion_summary(docs(spark, sf).selectExpr(*X.HISTORY))


@query
def keyword_dedupe(spark, sf):
    terms = docs(spark, sf).select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \n]"))).alias("word"))
    return K.dedupe(terms, "word", "doc_id", "word").select("doc_id", "word")


@query
def retention_policy(spark, sf):
    return K.newest_runs(docs(spark, sf).selectExpr(*X.RUNS)).select("run", "root", "retained")


@query
def cache_lookup(spark, sf):
    sources = docs(spark, sf).select("doc_id", F.col("text").cast("binary").alias("content"))
    ledger = sources.where("doc_id % 3 = 0").select(F.sha2("content", 256).alias("sha256"), F.when(F.col("doc_id") % 2 == 0, "v1").otherwise("v2").alias("version"))
    return skip_known(sources, ledger, "v1").select("doc_id", "sha256")


@query
def cleaned_markdown(spark, sf):
    return R.cleaned_markdown(cleaned(spark, sf)).select("doc_id", "blocks", _md5())


@query
def render_evidence(spark, sf):
    return R.by_status(cleaned(spark, sf), "evidence").select("doc_id", _md5())


@query
def audit_topk(spark, sf):
    return R.audit(cleaned(spark, sf), {"discard": 5, "evidence": 2, "review": 3, "risky": 4}).select("doc_id", "kind", "n", "block_id")


@query
def notes_sections(spark, sf):
    return R.sections(cleaned(spark, sf)).select("doc_id", F.col("section").cast("long").alias("section"), "category", "blocks", "chars", "path")


@query
def parts(spark, sf):
    b = cleaned(spark, sf)
    return P.assemble(b, P.parts(b), "part_%03d").select("doc_id", F.col("chunk_id").alias("part_id"), F.size("block_ids").cast("long").alias("blocks"))


@query
def chunks_by_page(spark, sf):
    source = md(spark, sf)
    page_map = source.select("doc_id", F.explode(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1, F.lit(7))).alias("line")).withColumn("page", (F.floor(F.col("line") / 7) + 1).cast("int"))
    b = B.with_pages(C.apply_rules(C.classify(B.blockify(source))), page_map)
    return P.chunks_by_page(b).groupBy("doc_id", "no").agg(F.count("*").alias("blocks"), F.min("page").alias("page_start"), F.max("page_end").alias("page_end"))


@query
def structure_loss(spark, sf):
    source = md(spark, sf)
    lossy = source.withColumn("text", F.regexp_replace(F.replace("text", F.lit("| --- |"), F.lit("")), r"(?m)^### |\.png", ""))
    return Q.structure_loss(B.structure_counts(source), B.structure_counts(lossy))


@query
def event_windows(spark, sf):
    return event_counts(S.table(spark, sf, "events")).select("window_start", "event_type", "events")


@query
def prepare_corpus(spark, sf):
    done = prepare(docs(spark, sf))
    return done.gates.groupBy("gate", "status").agg(F.count("*").alias("docs"))


@query
def title_candidates(spark, sf):
    return N.best_title(md(spark, sf))
