"""Review of blocks: packs for a reader, patches that come back, and the guards that patches have to pass."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.operators import classify as C
from textloom.operators import quality as Q

REVIEW_BELOW = 0.76
#: What a patch may change, and how. Fixed values.
FIELDS = ("status", "risk_tags", "reason", "confidence")
STATUSES = ("keep", "discard", "evidence", "review")
OPS = ("replace", "add")


def review_pack(blocks: DataFrame) -> DataFrame:
    """Blocks that someone should look at: marked for review, at risk, or of low confidence."""
    risky = F.coalesce(F.size("risk_tags"), F.lit(0)) > 0 if "risk_tags" in blocks.columns else F.lit(False)
    return blocks.where((F.col("status") == "review") | risky | (F.coalesce("confidence", F.lit(0.0)) < REVIEW_BELOW))


def patch_operations(patches: DataFrame) -> DataFrame:
    """``patches(doc_id, seq, op, path, value)`` with paths /blocks/<id>/<field> -> (doc_id, block_id, seq, op, field, value); other paths have no block."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    good = (F.size(parts) == 3) & (F.get(parts, 0) == "blocks")
    return patches.select("doc_id", F.when(good, F.get(parts, 1)).alias("block_id"), "seq", "op", F.when(good, F.get(parts, 2)).alias("field"), "value")


def _strings(value: Column) -> Column:
    """A JSON list of strings, or null for anything else."""
    return F.when(value.rlike(r'^\s*\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$'), F.from_json(value, "array<string>"))


def value_problem(op: Column, field: Column, value: Column) -> Column:
    """Why a value does not suit its field: a known status, a list of tags (or one to add), a text, a number from 0 to 1."""
    number = value.cast("string").try_cast("double")
    return (
        F.when(field == "status", F.when(~value.isin(*STATUSES) | value.isNull(), "status"))
        .when((field == "risk_tags") & (op == "replace"), F.when(_strings(value).isNull(), "risk_tags")).when((field == "risk_tags") & (op == "add"), F.when(value.isNull(), "risk_tags"))
        .when(field == "reason", F.when(value.isNull(), "reason")).when(field == "confidence", F.when(F.coalesce(~number.between(0, 1), F.lit(True)), "confidence"))
    )


def validate_ai_patch(ops: DataFrame) -> DataFrame:
    """Adds ``rejected`` to operations before they meet any block: for their kind, path, field and value."""
    op, field = F.col("op"), F.col("field")
    reason = F.when(~op.isin(*OPS) | op.isNull(), "op").when(F.col("block_id").isNull() | field.isNull(), "path").when(~field.isin(*FIELDS), "field").when((op == "add") & (field != "risk_tags"), "add")
    return ops.withColumn("rejected", F.coalesce(reason, value_problem(op, field, F.col("value"))))


def validate_patch(ops: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, seq, op, field, value) -> adds ``rejected``: null for what may be applied, else why not.

    Nothing that holds details, is of a kept type or is protected may be discarded; text and place are never changed."""
    tags = F.col("risk_tags") if "risk_tags" in blocks.columns else F.lit(None).cast("array<string>")
    categories = C.detail_categories(F.col("text"), F.col("type"))
    detail = (F.size(categories) > 0) & ~Q.known_pollution(F.col("type"), tags, categories)
    known = blocks.select("doc_id", "block_id", F.col("protected").alias("__protected"), detail.alias("__detail"), F.col("type").isin(*C.DETAIL_TYPES).alias("__kept"), F.lit(True).alias("__known"))
    op, field = F.col("op"), F.col("field")
    discards = (field == "status") & (F.col("value") == "discard")
    reason = F.coalesce(
        F.when(F.col("block_id").isNull() | field.isNull(), "path").when(F.col("__known").isNull(), "unknown_block").when(~field.isin(*FIELDS), "field"), value_problem(op, field, F.col("value")),
        F.when(discards & F.col("__detail"), "detail").when(discards & F.col("__kept"), "kept_type").when(discards & F.col("__protected"), "protected"),
        F.when(~op.isin(*OPS) | op.isNull(), "op").when((op == "add") & (field != "risk_tags"), "add"),
    )
    return ops.join(known, ["doc_id", "block_id"], "left").withColumn("rejected", reason).drop("__protected", "__detail", "__kept", "__known")


def apply_patch(blocks: DataFrame, ops: DataFrame) -> DataFrame:
    """Blocks with the valid operations applied in the order of ``seq``; of several for a field the last one holds.

    Replaced tags are the list that was given last, with what was added after it; no list is put together step by step."""
    valid = validate_patch(ops, blocks).where("rejected is null")
    pick = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("seq")))
    step = lambda op: F.when((F.col("field") == "risk_tags") & (F.col("op") == op), F.struct("seq", "value"))
    last = valid.groupBy("doc_id", "block_id").agg(*[pick(f).alias(f"__{f}") for f in ("status", "reason", "confidence")], F.max(step("replace")).alias("__given"), F.array_sort(F.collect_list(step("add"))).alias("__added"), F.count("*").alias("__n"))
    own = F.coalesce(F.col("risk_tags") if "risk_tags" in blocks.columns else F.lit(None).cast("array<string>"), F.array().cast("array<string>"))
    given = F.col("__given")
    later = lambda x: given.isNull() | F.coalesce(x["seq"] > given["seq"], given["seq"].isNull() & x["seq"].isNotNull())
    added = F.transform(F.filter("__added", later), lambda x: x["value"])
    tags = F.concat(F.when(given.isNull(), own).otherwise(_strings(given["value"])), F.coalesce(added, F.array().cast("array<string>")))
    out = blocks.join(last, ["doc_id", "block_id"], "left").withColumns({"patched": F.col("__n").isNotNull(), "risk_tags": tags, "status": F.coalesce("__status", "status")})
    if "reason" in blocks.columns:
        out = out.withColumn("reason", F.coalesce("__reason", "reason"))
    if "confidence" in blocks.columns:
        out = out.withColumn("confidence", F.coalesce(F.col("__confidence").try_cast("double"), F.col("confidence")))
    return out.drop("__status", "__reason", "__confidence", "__given", "__added", "__n")


def json_patch(answer: str | None) -> str | None:
    """The first JSON list of operations in an answer, those in fences first; null without one. Read once from left to right."""
    text = answer or ""
    decoder = json.JSONDecoder()
    for source in [*re.findall(r"```(?:json)?\s*(.*?)```", text, re.I | re.S), text]:
        at = source.find("[")
        while at >= 0:
            try:
                found, end = decoder.raw_decode(source, at)
            except (ValueError, RecursionError):
                at = source.find("[", at + 1)
                continue
            if isinstance(found, list):
                return json.dumps(found, ensure_ascii=False) if all(isinstance(x, dict) and "op" in x and "path" in x for x in found) else None
            at = source.find("[", end)
    return None


@F.pandas_udf(StringType())
def extract_patch(answers: pd.Series) -> pd.Series:
    """``json_patch`` of each answer."""
    return answers.map(json_patch)


def patches_of(answers: DataFrame) -> DataFrame:
    """``answers(doc_id, place, answer)`` -> (doc_id, seq, op, path, value): the operations of each document's last answer that has some."""
    found = answers.withColumn("__patch", extract_patch("answer")).where("__patch is not null")
    last = found.groupBy("doc_id").agg(F.max_by("__patch", "place").alias("patch"))
    items = F.from_json("patch", "array<map<string,string>>")
    return last.select("doc_id", F.posexplode(items).alias("seq", "o")).select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("o")["op"].alias("op"), F.col("o")["path"].alias("path"), F.col("o")["value"].alias("value"))
