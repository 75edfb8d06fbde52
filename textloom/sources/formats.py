"""What file formats there are: extension -> format, source type, family, and the route that converts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: format -> (source type, extensions). Fixed values of the data model.
FORMATS = {
    "pdf": ("pdf_like", "pdf"),
    "ebook": ("pdf_like", "epub mobi"),
    "docx": ("pdf_like", "docx"),
    "doc": ("pdf_like", "doc"),
    "xlsx": ("pdf_like", "xlsx"),
    "xls": ("pdf_like", "xls"),
    "pptx": ("generic_block", "pptx"),
    "ppt": ("generic_block", "ppt"),
    "markdown": ("markdown_note", "md markdown"),
    "text": ("generic_block", "txt rst adoc csv tsv"),
    "html": ("generic_block", "html htm"),
    "json": ("generic_block", "json"),
    "notebook": ("generic_block", "ipynb"),
    "subtitle_transcript": ("subtitle_transcript", "vtt srt ass lrc"),
    "code": ("generic_block", "py js jsx ts tsx mjs cjs java go rs c cc cpp h hpp cs php rb swift kt kts scala sh bash zsh ps1 bat cmd sql yaml yml toml ini cfg conf"),
    "audio": ("generic_block", "mp3 wav m4a aac flac ogg"),
    "video": ("generic_block", "mp4 mov mkv webm avi"),
    "image": ("pdf_like", "png jpg jpeg bmp tiff tif webp gif svg"),
}
#: Formats that a batch leaves out, and formats that another program has to convert first. Fixed values.
MEDIA, EXTERNAL = ("audio", "video"), ("image", "doc", "ppt", "xls")
HEAVY = ("pdf",)
#: family -> extensions, asked in this order. Fixed values.
FAMILIES = {
    "pdf": "pdf",
    "word": "docx doc odt",
    "presentation": "pptx ppt odp",
    "spreadsheet": "xlsx xls ods",
    "ebook": "epub mobi",
    "image": FORMATS["image"][1],
    "audio": FORMATS["audio"][1],
    "video": FORMATS["video"][1],
    "subtitle_transcript": FORMATS["subtitle_transcript"][1],
    "notebook": "ipynb",
    "code": FORMATS["code"][1],
    "text": "md markdown txt rst adoc csv tsv html htm json",
}
#: Fence languages of code extensions that are not their own name. Fixed values.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "cc": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "rb": "ruby",
    "kt": "kotlin", "kts": "kotlin", "sh": "bash", "ps1": "powershell", "cmd": "batch", "yml": "yaml", "cfg": "ini",
}
#: (id, source type, formats or extensions, route, status) of each declared conversion. Fixed values.
CAPABILITIES = (
    ("markdown_text_direct", "markdown_note", "md markdown txt rst adoc csv tsv", "direct_text", "verified"),
    ("html_direct", "generic_block", "html htm", "direct_text", "partial"),
    ("json_direct", "generic_block", "json", "direct_text", "verified"),
    ("code_direct", "generic_block", FORMATS["code"][1], "direct_code", "verified"),
    ("notebook_json", "generic_block", "ipynb", "notebook_json", "partial"),
    ("subtitle_transcript_direct", "subtitle_transcript", "vtt srt ass lrc", "direct_text", "verified"),
    ("office_xml", "pdf_like", "docx pptx xlsx", "office_xml", "partial"),
    ("epub_xhtml", "pdf_like", "epub", "epub_xhtml", "partial"),
    ("pdf_diagnosis_selected", "pdf_like", "pdf", "pdf_diagnosis_selected", "partial"),
    ("image_ocr", "pdf_like", FORMATS["image"][1], "external_conversion_required", "unsupported"),
    ("legacy_office_or_mobi_heavy_conversion", "pdf_like", "doc ppt xls mobi", "external_conversion_required", "unsupported"),
    ("media_requires_transcript", "generic_block", f"{FORMATS['audio'][1]} {FORMATS['video'][1]}", "provide_transcript_first", "unsupported"),
)
STATUSES = ("verified", "partial", "unsupported", "experimental")
#: What still blocks a conversion that is not verified, by its status.
BLOCKERS = {"partial": "needs broader fixtures and preservation checks", "unsupported": "needs a reliable route and end-to-end fixtures"}


def extension(path: Column) -> Column:
    """The suffix of the last part of a path, in lower case, without its dot; none for names that begin with their only dot."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))


def lookup(key: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(other))


FORMAT_OF = {ext: name for name, (_, exts) in FORMATS.items() for ext in exts.split()}
FAMILY_OF: dict[str, str] = {}
for _family, _exts in FAMILIES.items():
    for _ext in _exts.split():
        FAMILY_OF.setdefault(_ext, _family)


def format_of(ext: Column) -> Column:
    return lookup(ext, FORMAT_OF, "unknown")


def source_type_of(ext: Column) -> Column:
    return lookup(ext, {e: FORMATS[f][0] for e, f in FORMAT_OF.items()}, "generic_block")


def source_family(ext: Column) -> Column:
    return lookup(ext, FAMILY_OF, "unknown")


def skip_reason(ext: Column) -> Column:
    """Why a batch leaves a file out; null for what it takes."""
    kind = format_of(ext)
    return F.when(kind.isin(*MEDIA), "media_binary_not_transcribed_in_v1").when(kind.isin(*EXTERNAL) | (ext == "mobi"), "external_conversion_required").when(
        kind == "unknown", F.concat(F.lit("unsupported_extension:"), F.when(ext == "", "<none>").otherwise(F.concat(F.lit("."), ext)))
    )


def capabilities(spark: SparkSession) -> DataFrame:
    """(id, source_type, extension, route, status): one row per declared extension, fewer than a hundred."""
    rows = [(i, source, ext, route, status) for i, source, exts, route, status in CAPABILITIES for ext in exts.split()]
    return spark.createDataFrame(rows, "id string, source_type string, extension string, route string, status string")


def capability_of(files: DataFrame) -> DataFrame:
    """``files(path)`` with the declared capability of their extension; what is not declared is unsupported."""
    table = capabilities(files.sparkSession).select(F.col("id").alias("__id"), F.col("source_type").alias("__source"), F.col("extension").alias("__ext"), F.col("route").alias("__route"), F.col("status").alias("__status"))
    joined = files.withColumn("extension", extension(F.col("path"))).join(F.broadcast(table), F.col("extension") == F.col("__ext"), "left")
    named = {"capability_id": ("__id", "unsupported_extension"), "source_type": ("__source", "generic_block"), "route": ("__route", "unsupported"), "status": ("__status", "unsupported")}
    return joined.withColumns({k: F.coalesce(F.col(c), F.lit(other)) for k, (c, other) in named.items()}).drop("__id", "__source", "__ext", "__route", "__status")


def capability_summary(spark: SparkSession) -> DataFrame:
    """(status, capabilities) for each status, those without a capability included."""
    counts = capabilities(spark).select("id", "status").distinct().groupBy("status").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("capabilities"))


def capability_gaps(spark: SparkSession) -> DataFrame:
    """(id, status, route, extensions, blocker) of what is not verified."""
    rows = capabilities(spark).where("status <> 'verified'")
    return rows.groupBy("id", "status", "route").agg(F.array_sort(F.collect_list("extension")).alias("extensions")).withColumn("blocker", lookup(F.col("status"), BLOCKERS, BLOCKERS["unsupported"]))


def route_decision(runs: DataFrame) -> DataFrame:
    """(path, converter, pipeline, strategy, fallback_from) -> declared, diagnosed and actual route of each conversion.

    A converter is its own route, but for ``ocr``, whose route is the diagnosed strategy where that is one of OCR, and
    ``ocr_after_text_layer``, which is OCR and a fallback."""
    declared = capability_of(runs)
    c = F.col
    late = c("converter") == "ocr_after_text_layer"
    actual = F.when(late, "ocr").when((c("converter") == "ocr") & c("strategy").isin("ocr", "ocr_mixed_text_image"), c("strategy")).otherwise(c("converter"))
    fallback = c("fallback_from").isNotNull() | F.coalesce(late, F.lit(False))
    return declared.select(
        "path", "capability_id", c("route").alias("declared_route"), c("status").alias("declared_status"), c("pipeline").alias("diagnosed_pipeline"), c("strategy").alias("diagnosed_strategy"),
        actual.alias("actual_route"), fallback.alias("fallback_applied"), "fallback_from", F.when(fallback, actual).alias("fallback_to"),
    )
