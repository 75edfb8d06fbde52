"""Images of documents: what they show by their surroundings, whether their files are there, and links to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators.blocks import lines
from textloom.operators.classify import headings_of
from textloom.rules import RuleSet
from textloom.sources import formats as Z

#: Block types that are images, and those that are judged by their surroundings. Fixed values.
IMAGE_BLOCKS = ("image_evidence", "image_operation", "diagram", "qr_image", "unknown_image")
JUDGED = ("image_evidence", "image_operation", "diagram", "unknown_review")
EXTERNAL = r"(?i)^(?:(?:https?:)?//|data:)"
NOT_LOCAL = r"(?i)^(?:(?:https?:)?//|data:|mailto:|#)"


def images_of(text: Column) -> Column:
    """Every image of a Markdown text, in order: array of (alt, src)."""
    alts, srcs = (F.regexp_extract_all(text, T.rx(T.IMAGE), k) for k in (1, 2))
    return F.transform(F.arrays_zip(alts.alias("alt"), srcs.alias("src")), lambda x: F.struct(x["alt"].alias("alt"), T.strip(x["src"]).alias("src")))


def external(src: Column) -> Column:
    return src.rlike(EXTERNAL)


def valid_svg(content: Column) -> Column:
    """Whether a drawing's root has a view box, or both a width and a height."""
    root = F.regexp_extract(content, r"(?is)<svg\b([^>]*)>", 1)
    has = lambda name: root.rlike(rf"""(?i)\b{name}\s*=\s*(?:"[^"]+"|'[^']+')""")
    return F.coalesce(content.rlike(r"(?is)<svg\b[^>]*>") & (has("viewbox") | (has("width") & has("height"))), F.lit(False))


def contexts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", before: int = 5, after: int = 3) -> DataFrame:
    """(doc_id, src, context): the stripped lines around every mention of an image, blank ones and its own left out."""
    rows = lines(docs, id_col, text_col).withColumn("s", F.nullif(T.strip(F.col("line")), F.lit("")))
    w = Window.partitionBy("doc_id").orderBy("i")
    near = rows.withColumn("a", F.collect_list("s").over(w.rowsBetween(-before, -1))).withColumn("b", F.collect_list("s").over(w.rowsBetween(1, after)))
    found = near.where(F.col("line").rlike(T.IMAGE)).select("doc_id", "i", F.posexplode(F.regexp_extract_all("line", T.rx(T.IMAGE), 2)).alias("k", "src"), F.array_join(F.concat("a", "b"), " ").alias("near"))
    rows = F.array_sort(F.collect_list(F.struct("i", "k", "near")))
    return found.groupBy("doc_id", "src").agg(F.array_join(F.transform(rows, lambda r: r["near"]), " ").alias("context"))


def classify_images(blocks: DataFrame, around: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Decides on image blocks by their text, their surroundings and their headings; a discarded block stays so.

    ``around(doc_id, src, context)``. Adds image_type; sets status and reason. Codes to scan are discarded, proofs and
    posters are evidence, screens of operation and images of lessons are kept, anything else is for review."""
    rules = rules or RuleSet()
    judged = F.col("type").isin(*JUDGED) & (F.size(images_of(F.col("text"))) > 0)
    own = blocks.where(judged).select("doc_id", "ord", F.posexplode(images_of(F.col("text"))).alias("k", "image")).select("doc_id", "ord", "k", F.col("image.src").alias("src"))
    rows = F.array_sort(F.collect_list(F.struct("k", "context")))
    near = own.join(around, ["doc_id", "src"]).groupBy("doc_id", "ord").agg(F.array_join(F.transform(rows, lambda r: r["context"]), " ").alias("__near"))
    joined = blocks.withColumns({"__judged": judged, "__heading": headings_of(blocks)}).join(near, ["doc_id", "ord"], "left")
    words = F.concat_ws(" ", "text", F.coalesce("__near", F.lit("")), "__heading")
    steps = (
        (T.strip(words) == "", "unknown_image", "review", "no context available"), (T.any_pattern(words, list(rules.image_qr)), "qr_image", "discard", "code to scan or call to action"),
        (T.any_pattern(words, list(rules.image_proof)), "proof_screenshot", "evidence", "proof"), (T.any_pattern(words, list(rules.image_marketing)), "marketing_poster", "evidence", "marketing material"),
        (T.any_pattern(words, list(rules.image_operation)), "operation_screenshot", "keep", "operation or tutorial"),
        (T.any_pattern(F.lower("__heading"), list(rules.image_education)) & (F.col("__heading") != ""), "operation_screenshot", "keep", "in an educational section"),
        (F.length(words) > 100, "unknown_review", "review", "unclassified"), (F.lit(True), "unknown_image", "review", "too little context"),
    )
    verdict = F.coalesce(*[F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(status).alias("status"), F.lit(why).alias("why"))) for test, kind, status, why in steps])
    out = joined.withColumn("__v", F.when(F.col("__judged"), verdict))
    return out.withColumns({
        "image_type": F.col("__v.kind"), "status": F.when(F.col("__judged") & (F.col("status") != "discard"), F.col("__v.status")).otherwise(F.col("status")),
        "reason": F.coalesce(F.col("__v.why"), F.col("reason")) if "reason" in blocks.columns else F.col("__v.why"),
    }).drop("__v", "__near", "__judged", "__heading")


def image_retention(blocks: DataFrame, files: DataFrame, most: int = 50) -> DataFrame:
    """Per document: image blocks by status, files that they refer to, those not in ``files(doc_id, path, content)``, and bad drawings.

    Discarded blocks and external images refer to nothing; the first ``most`` names of each list are given."""
    own = blocks.where(F.col("type").isin(*IMAGE_BLOCKS))
    statuses = ("keep", "evidence", "review", "discard")
    counts = own.groupBy("doc_id").agg(F.count("*").alias("total_blocks"), *[F.count_if(F.col("status") == s).alias(f"{s}_blocks") for s in statuses])
    refs = own.where("status <> 'discard'").select("doc_id", "ord", F.posexplode(images_of(F.col("text"))).alias("k", "image")).select("doc_id", "ord", "k", F.regexp_replace(F.col("image.src"), "^[<>]+|[<>]+$", "").alias("path"))
    refs = refs.where(~external(F.col("path")) & (F.col("path") != ""))
    seen = refs.join(files.select("doc_id", "path", F.col("content").alias("__content"), F.lit(True).alias("__there")).dropDuplicates(["doc_id", "path"]), ["doc_id", "path"], "left")
    missing, bad = F.col("__there").isNull(), F.col("__there").isNotNull() & F.lower("path").endswith(".svg") & ~valid_svg(F.coalesce("__content", F.lit("")))
    listed = lambda test: F.slice(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("ord", "k", "path")))), lambda x: x["path"]), 1, most)
    found = seen.groupBy("doc_id").agg(F.count("*").alias("referenced"), F.count_if(missing).alias("missing"), listed(missing).alias("missing_files"), F.count_if(bad).alias("invalid_svg"), listed(bad).alias("invalid_svg_files"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return counts.join(found, "doc_id", "left").select("doc_id", "total_blocks", *[f"{s}_blocks" for s in statuses], zero("referenced"), zero("missing"), none("missing_files"), zero("invalid_svg"), none("invalid_svg_files"))


def _target(raw: Column) -> Column:
    """The path of an image link, without its title and angle brackets."""
    bare = T.strip(raw)
    return F.when(bare.rlike("^<[^>]*>"), T.strip(F.regexp_extract(bare, "^<([^>]*)>", 1))).otherwise(T.strip(F.regexp_replace(bare, r"""[ \t]+(?:"[^"]*"|'[^']*'|\([^)]+\))[ \t]*$""", "")))


def _resolved(path: Column) -> Column:
    """A relative path without ``.`` and ``..``; null if it leaves its folder."""
    clean = F.regexp_replace(F.replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit("\\"), F.lit("/")), r"[?#].*$", "")
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(at: Column, part: Column) -> Column:
        up, size = part == "..", F.size(at["parts"])
        parts = F.when(part.isin("", "."), at["parts"]).when(up, F.slice(at["parts"], 1, F.greatest(size - 1, F.lit(0)))).otherwise(F.concat(at["parts"], F.array(part)))
        return F.struct(parts.alias("parts"), (at["out"] | (up & (size == 0))).alias("out"))

    return F.when(~clean.startswith("/"), F.aggregate(F.split(clean, "/"), start, step, lambda s: F.when(~s["out"], F.array_join(s["parts"], "/"))))


def rewrite_links(docs: DataFrame, files: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, copied, missing, skipped): local images that are among ``files(doc_id, path)`` point below ``images/``.

    Links elsewhere stay and count nowhere; paths that are no image or leave the document's folder are skipped. Links
    in double square brackets become plain ones, without what stands behind a bar."""
    link = r"!\[([^\]\n]*)\]\(([^)\n]+)\)|!\[\[([^\]\n]+)\]\]"
    suffixes = Z.FORMATS["image"][1].split()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    refs = source.select("doc_id", F.posexplode(F.regexp_extract_all("t", T.rx(link), 0)).alias("k", "m"))
    wiki = F.col("m").startswith("![[")
    inner = F.regexp_extract("m", r"^!\[\[([^\]\n]+)\]\]$", 1)
    raw = F.when(wiki, T.strip(F.substring_index(inner, "|", 1))).otherwise(F.regexp_extract("m", r"^!\[[^\]\n]*\]\(([^)\n]+)\)$", 1))
    own = refs.withColumns({"wiki": wiki, "alt": F.regexp_extract("m", r"^!\[([^\]\n]*)\]\(", 1), "target": _target(raw)})
    image = F.lower(F.regexp_extract(F.regexp_replace("target", r"[?#].*$", ""), r"\.([^./\\]+)$", 1)).isin(*suffixes)
    local = (F.col("target") != "") & ~F.col("target").rlike(NOT_LOCAL)
    own = own.withColumns({"local": local, "image": image, "path": F.when(local & image, _resolved(F.col("target")))})
    seen = own.join(files.select("doc_id", "path", F.lit(True).alias("there")).dropDuplicates(["doc_id", "path"]), ["doc_id", "path"], "left")
    below = F.regexp_replace("path", r"(?i)^images/", "")
    good = F.coalesce(F.col("there"), F.lit(False)) & (F.lower(F.col("path")) != "images")
    skipped = F.col("local") & ((~F.col("image") & ~F.col("wiki")) | (F.col("image") & F.col("path").isNull()))
    new = F.when(good, F.concat(F.lit("!["), F.when(F.col("wiki"), "").otherwise(F.col("alt")), F.lit("](images/"), below, F.lit(")"))).otherwise(F.col("m"))
    done = seen.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", new.alias("new")))), lambda x: x["new"]).alias("news"), F.size(F.collect_set(F.when(good, below))).cast("long").alias("copied"),
        F.count_if(F.col("local") & F.col("path").isNotNull() & F.col("there").isNull()).alias("missing"), F.count_if(skipped).alias("skipped"),
    )
    between = F.split("t", link, -1)
    text = F.when(F.col("news").isNull(), F.col("t")).otherwise(F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get("news", i), F.lit("")))), ""))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return source.join(done, "doc_id", "left").select("doc_id", text.alias("text"), zero("copied"), zero("missing"), zero("skipped"))
