"""Classification and cleaning of blocks: one decision chain, rule priorities, promotional lines, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.rules import RuleSet

#: Confidence of each outcome. Fixed values.
CONFIDENCE = {"wrapper": 0.96, "structural": 0.90, "image": 0.0, "protected": 0.90, "contextual": 0.88, "discard": 0.95, "evidence": 0.85, "garbled": 0.80, "default": 0.70}


def labelled(text: Column, pairs: tuple[tuple[str, str], ...], multiline: bool = False, low: Column | None = None) -> Column:
    """The label of the first pattern that is found."""
    flag = "(?m)" if multiline else ""
    return F.coalesce(*[F.when(T.found(text, flag + T.anycase(p), low), F.lit(name)) for name, p in pairs], F.lit(None).cast("string"))


def is_garbled(text: Column) -> Column:
    foreign = F.octet_length(text) - F.length(text)  # as many at most: each takes two bytes or more
    return (F.length(text) >= 20) & (foreign > 0.3 * F.length(text)) & (F.regexp_count(text, T.rx(T.FOREIGN)) > 0.3 * F.length(text))


def has_exact(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found


#: Types that carry details and are never discarded by a rule. Fixed values.
DETAIL_TYPES = ("operation_step", "case_step", "tool_instruction", "prompt", "code", "table")
IMAGE_TYPES = ("image_evidence", "image_operation", "diagram")


def cta_signal(text: Column, rules: RuleSet, low: Column | None = None) -> Column:
    return T.any_term(text, list(rules.cta), low)


def protected_type(text: Column, rules: RuleSet, low: Column | None = None) -> Column:
    """The kind of detail that a text shows by itself; null for none."""
    tagged_table = F.contains(F.lower(text) if low is None else low, F.lit("<table"))
    return F.when(text.startswith(T.FENCE), "code").when(text.startswith("|") | tagged_table, "table").otherwise(labelled(text, rules.protected, True, low))


def headings_of(blocks: DataFrame) -> Column:
    """The titles above a block, joined; empty where blocks carry no ``heading_path``."""
    return F.coalesce(F.array_join("heading_path", " "), F.lit("")) if "heading_path" in blocks.columns else F.lit("")


def wrapper_type(text: Column, rules: RuleSet, heading: Column | None = None, low: Column | None = None) -> Column:
    """Text that sells the source rather than teaching: short calls to action, sections and lines of the wrapping.

    The source's own title, refund terms and what speaks of a method stay."""
    heading = F.lit("") if heading is None else heading
    searchable = F.concat(heading, F.lit("\n"), text)
    compact = F.regexp_replace(text, f"[{T.SPACE}]+", "")
    short = T.after(T.at_most(text, 80), T.any_term(compact, [t.replace(" ", "") for t in rules.cta]) & ~has_exact(compact, rules.knowledge))
    stepped = F.coalesce(protected_type(text, rules, low) == "operation_step", F.lit(False)) if any(name == "operation_step" for name, _ in rules.protected) else F.lit(False)
    method = stepped | has_exact(searchable, rules.business_context + rules.knowledge)
    for pattern in rules.method_patterns:
        method = method | T.found(searchable, pattern)
    title = T.strip(F.regexp_replace(text, "^[# ]+", ""))
    headed, lined = has_exact(searchable, rules.wrapper_headings), T.any_pattern(text, list(rules.wrapper_lines), low)
    none = F.lit(None).cast("string")
    return (
        F.when(~(headed | short | lined), none)  # what could make it one is cheaper to see than what speaks against it
        .when(title.isin(*rules.own_titles) if rules.own_titles else F.lit(False), none).when(T.any_pattern(text, list(rules.refund), low), none).when(short, "marketing_cta").when(method, none)
        .when(headed, F.when(has_exact(searchable, rules.back_matter), "back_matter").otherwise("marketing_wrapper")).when(lined, "marketing_wrapper")
    )


def contextual_cta(text: Column, rules: RuleSet, heading: Column | None = None, low: Column | None = None) -> Column:
    """Whether a call to action is what the text is about: a lesson, a case, or a rule that handles it."""
    speaks = has_exact(text, rules.knowledge + rules.tutorial)
    if heading is not None:
        speaks = speaks | has_exact(heading, rules.business_context + rules.knowledge)
    for pattern in rules.conditional_cta:
        speaks = speaks | T.found(text, pattern, low)
    return cta_signal(text, rules, low) & speaks


def discard_type(text: Column, rules: RuleSet, low: Column | None = None) -> Column:
    return (
        F.when(T.any_pattern(text, list(rules.filler), low), "transcript_filler").when(T.any_term(text, list(rules.cta), low), "marketing_cta")
        .when(T.any_pattern(text, list(rules.refund), low), "refund_policy").when(T.any_pattern(text, list(rules.footer), low), "footer")
    )


def classify(blocks: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Adds status, confidence, reason; sets type and protected. The first matching step of the chain decides."""
    rules = rules or RuleSet()
    t, kind, low = F.col("text"), F.col("type"), F.col("__low")
    heading = headings_of(blocks)
    guard, contextual = protected_type(t, rules, low), contextual_cta(t, rules, heading, low)
    out = lambda status, name, protected, reason, confidence: F.struct(F.lit(status).alias("status"), name.alias("type"), (F.lit(protected) if isinstance(protected, bool) else protected).alias("protected"), reason.alias("reason"), F.lit(CONFIDENCE[confidence]).alias("confidence"))
    wrapper, drop, evidence = wrapper_type(t, rules, heading, low), discard_type(t, rules, low), labelled(t, rules.evidence, low=low)
    own = F.col("protected")
    none = F.lit(None).cast("string")
    chain = (
        F.when(T.strip(t) == "", out("discard", F.lit("empty"), own, F.lit("empty block"), "default"))
        .when(wrapper.isNotNull(), out("discard", wrapper, own, F.lit("wrapping"), "wrapper"))
        .when(kind.isin("code", "table", "section_heading", "quote"), out("keep", kind, own | kind.isin("code", "table"), none, "structural"))
        .when(kind.isin("image_evidence", "image_operation", "diagram"), out("unclassified", kind, own, none, "image"))
        .when(kind.isin("operation_step", "case_step", "tool_instruction", "prompt"), out("keep", kind, True, none, "protected"))
        .when(guard.isNotNull(), out("keep", guard, True, none, "protected"))
        .when(contextual, out("keep", F.lit("case_step"), True, F.lit("call to action as a subject"), "contextual"))
        .when(drop.isNotNull(), out("discard", drop, own, F.concat(F.lit("pattern: "), drop), "discard"))
        .when(evidence.isNotNull(), out("evidence", evidence, own, F.concat(F.lit("pattern: "), evidence), "evidence"))
        .when(is_garbled(t), out("discard", F.lit("garbled_text"), own, F.lit("garbled"), "garbled"))
        .otherwise(out("keep", kind, own, none, "default"))
    )
    lowered = blocks.withColumn("__low", F.lower("text"))
    return lowered.select(*[c for c in blocks.columns if c not in ("type", "protected")], F.inline(F.array(chain)))  # once a block: no filter is merged into a generator


def split_promo(blocks: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Takes lines whose first matching rule discards out of blocks of several lines, each as a block of its own.

    Such blocks come behind all others, with ids <parent>_promo_<n>; what is left of a parent is joined again
    without blank lines; a parent with nothing left is discarded. Adds ``sub_ord`` (0 for originals)."""
    rules = rules or RuleSet()
    ls = F.filter(F.split("text", "\n"), lambda x: T.strip(x) != "")
    is_promo = lambda x: F.coalesce(rules.first_rule(x, "action") == "discard", F.lit(False))
    several = F.size(ls) > 1
    cut = blocks.withColumn("__promo", F.when(several, F.filter(ls, is_promo)).otherwise(F.array().cast("array<string>"))).withColumn("__rest", F.filter(ls, lambda x: ~is_promo(x)))
    hit = F.size("__promo") > 0
    empty = hit & (F.size("__rest") == 0)
    original = {
        "text": F.when(hit & ~empty, F.array_join("__rest", "\n")).otherwise(F.col("text")), "status": F.when(empty, "discard").otherwise(F.col("status")),
        "type": F.when(empty, "marketing_cta").otherwise(F.col("type")), "sub_ord": F.lit(0),
    }
    line = lambda x, i: {
        "text": T.strip(x), "block_id": F.concat("block_id", F.format_string("_promo_%03d", i + 1)), "status": F.lit("discard"), "type": F.lit("marketing_cta"), "protected": F.lit(False), "sub_ord": (i + 1).cast("int"),
    }
    row = lambda changed: F.struct(*[changed.get(c, F.col(c)).alias(c) for c in dict.fromkeys([*blocks.columns, "sub_ord"])])
    derived = F.transform("__promo", lambda x, i: row(line(x, i)))
    return cut.select(F.inline(F.concat(F.array(row(original)), derived)))  # both out of one pass over the blocks


def tagged(tags: Column, tag: Column) -> Column:
    """Risk tags with one more, if it is given and not among them."""
    own = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(tag.isNull() | F.array_contains(own, F.coalesce(tag, F.lit(""))), own).otherwise(F.concat(own, F.array(tag)))


def _tags(blocks: DataFrame) -> Column:
    return F.col("risk_tags") if "risk_tags" in blocks.columns else F.lit(None).cast("array<string>")


def apply_rules(blocks: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Applies the first matching rule to blocks that are not protected; adds cleaning_rule_id, cleaning_rule_source and risk_tags.

    A rule protects, sends to review, or discards; its reason and tag stay with the block."""
    rules = rules or RuleSet()
    free = ~F.col("protected")
    of = lambda name: rules.of_rule(F.col("__r"), name)
    named = T.once(blocks.withColumn("__low", F.when(free, F.lower("text"))), __r=F.when(free, rules.rule_at(F.col("text"), F.col("__low")))).drop("__low").withColumns({"__a": of("action"), "__tag": of("risk_tag"), "__why": of("reason"), "cleaning_rule_id": of("rule_id"), "cleaning_rule_source": of("source")})
    why = F.coalesce(F.nullif("__why", F.lit("")), F.col("reason")) if "reason" in blocks.columns else F.col("__why")
    return named.withColumns({
        "status": F.when(F.col("__a") == "protect", "keep").when(F.col("__a").isNotNull(), F.col("__a")).otherwise(F.col("status")), "type": F.when(F.col("__a") == "discard", "marketing_cta").otherwise(F.col("type")),
        "protected": F.col("protected") | F.coalesce(F.col("__a") == "protect", F.lit(False)), "reason": why, "risk_tags": tagged(_tags(blocks), F.col("__tag")),
    }).drop("__a", "__tag", "__why", "__r")


def tutorial_context(text: Column, rules: RuleSet, heading: Column) -> Column:
    """Whether words of a call to action stand in a lesson: by the headings, steps, code, terms, or the length of the text."""
    return (
        T.any_term(heading, list(rules.tutorial)) | text.rlike(T.NUMBERED) | text.rlike(T.ENGLISH_STEP) | F.contains(text, F.lit(T.FENCE)) | F.contains(text, F.lit("$ "))
        | has_exact(text, rules.knowledge) | (F.length(text) > 200) | T.any_term(text, list(rules.tutorial + rules.knowledge))
    )


def cta_to_review(blocks: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Sends what calls to act outside of a lesson to review, with the tag possible_cta.

    Headings, protected blocks, what is discarded or evidence already, and what a rule has decided stay as they are."""
    rules = rules or RuleSet()
    decided = F.col("cleaning_rule_id").isNotNull() if "cleaning_rule_id" in blocks.columns else F.lit(False)
    hit = ~F.col("protected") & ~F.col("status").isin("discard", "evidence") & (F.col("type") != "section_heading") & ~decided & cta_signal(F.col("text"), rules) & ~tutorial_context(F.col("text"), rules, headings_of(blocks))
    why = F.coalesce(F.col("reason"), F.lit("")) if "reason" in blocks.columns else F.lit("")
    return blocks.withColumn("__hit", hit).withColumns({
        "status": F.when(F.col("__hit"), "review").otherwise(F.col("status")), "risk_tags": tagged(_tags(blocks), F.when(F.col("__hit"), "possible_cta")),
        "reason": F.when(F.col("__hit"), F.concat(why, F.lit(" | contains CTA keywords"))).otherwise(F.col("reason") if "reason" in blocks.columns else F.lit(None).cast("string")),
    }).drop("__hit")


#: Categories of details that cleaning must not lose, with their patterns. Fixed values.
DETAILS = (
    ("operation_step", r"(?mi)^\s*(?:\d+[.)、]\s+|step\s*\d+[：:.)\-\s]+|第[\x{4E00}-\x{9FFF}\d]+(?:步|步骤)[：:、.\s]|步骤\s*[\x{4E00}-\x{9FFF}\d]+[：:、.\s])"),
    ("tool_or_platform", r"(?i)工具|平台|账号|后台|网站|插件|APP|API|GitHub|YouTube|Obsidian|MinerU|\b(?:tool|platform|account|dashboard|plugin|workflow)\b"),
    ("parameter", r"(?i)参数|字段|配置|阈值|限制条件|\b(?:threshold|retry_count|failure_reason|temperature|top_p|model|seed)\b|\b[a-zA-Z_][\w-]*\s*=\s*[^,\s，。]+"),
    ("link", r"(?i)https?://\S+|www\.\S+"),
    ("prompt", r"(?i)提示词|prompt|指令"),
    ("code", r"(?i)```|`[^`]+`|\b(?:def|class|const|let|function|import)\b"),
    ("table", r"(?im)^\s*\|.+\|\s*$|<table\b"),
    ("number_or_metric", r"\d+(?:\.\d+)?\s*(?:%|GB|MB|KB|ms|s|元|次|个|天)?"),
)
#: Types that are a detail by themselves; categories that must not be discarded. Fixed values.
DETAIL_OF_TYPE = {"operation_step": "operation_step", "tool_instruction": "tool_or_platform", "prompt": "prompt", "code": "code", "table": "table"}
STRICT_DETAILS = ("operation_step", "tool_or_platform", "parameter", "link", "prompt", "code", "table")


def detail_categories(text: Column, kind: Column | None = None) -> Column:
    """The categories of details in a text, and that of its block's type, in the order of DETAILS."""
    def has(name: str, pattern: str) -> Column:
        found = T.found(text, pattern)
        kinds = [k for k, v in DETAIL_OF_TYPE.items() if v == name]
        return found | F.coalesce(kind.isin(*kinds), F.lit(False)) if kind is not None and kinds else found

    return F.array_compact(F.array(*[F.when(has(name, p), F.lit(name)) for name, p in DETAILS]))
