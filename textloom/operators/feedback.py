"""Review packs, patches, and learning from feedback: proposals, acceptance, suggestions, promotion history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators.review import apply_patch, review_pack, validate_patch  # noqa: F401  feedback works on what review gives
from textloom.rules import NAME_ENDS, URL_ENDS, RuleSet

PROTECT_TERMS, DISCARD_TERMS = RuleSet().protect_intent, RuleSet().discard_intent
#: Lengths of lists of samples. Fixed values.
SNIPPETS, COUNTER_SNIPPETS, EXAMPLES, COUNTEREXAMPLES, SNIPPET_CHARS = 8, 12, 8, 5, 240
#: Where samples of an action are looked for, in this order. Fixed values.
SAMPLED = {"discard": ("discarded", "review_needed"), "protect": ("discarded", "cleaned", "review_needed"), "review": ("review_needed", "discarded", "cleaned")}
#: Words that make a line of the body a counterexample. Fixed values.
BODY_WORDS = "案例|示例|样本|字段|步骤|参数|代码|保留|正文|上下文"


def infer_action(text: Column, explicit: Column | None = None) -> Column:
    """What a remark asks for: the given action, else protecting terms, else discarding terms, else review."""
    low = F.lower(text)
    some = lambda terms: low.rlike("|".join(terms))
    guess = F.when(some(PROTECT_TERMS), "protect").when(some(DISCARD_TERMS), "discard").otherwise("review")
    return guess if explicit is None else F.coalesce(explicit, guess)


def infer_pattern(text: Column) -> Column:
    """The first quoted run of 2 to 120 characters, else the text's first 120."""
    quoted = F.regexp_extract(text, r"[\"“']([^\"”']{2,120})[\"”']", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.substring(text, 1, 120))


def accepted(proposals: DataFrame) -> DataFrame:
    """Adds ``ok``: every example holds the literal pattern and no counterexample does."""
    low = F.lower(F.col("pattern"))
    return proposals.withColumn("ok", F.forall("examples", lambda x: F.contains(F.lower(x), low)) & ~F.exists("counterexamples", lambda x: F.contains(F.lower(x), low)))


def snippets(text: Column, pattern: Column, most: int = SNIPPETS) -> Column:
    """The first lines of a text that hold a literal pattern, without marks of headings and lists, cut to a length."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, rf"^[{T.SPACE}]{{0,3}}#{{1,6}}[{T.SPACE}]*", ""), rf"^[{T.SPACE}]*[-*+][{T.SPACE}]+", "")
    low = F.lower(pattern)
    several = pattern.rlike(f"[{T.SPACE}]")  # else the pattern stands in the line as it is, if in the clean one
    rows = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: several | F.contains(F.lower(x), low))
    clean = F.transform(rows, lambda x: T.strip(F.regexp_replace(bare(x), f"[{T.SPACE}]+", " ")))
    found = F.filter(clean, lambda x: (x != "") & F.contains(F.lower(x), low))
    return F.transform(F.slice(found, 1, most), lambda x: F.substring(x, 1, SNIPPET_CHARS))


def distinct_texts(values: Column) -> Column:
    """Without blank texts and those that equal an earlier one but for case."""
    clean = F.filter(F.transform(values, T.strip), lambda x: x != "")
    own = lambda lowered: F.filter(clean, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return F.flatten(F.transform(F.array(F.transform(clean, F.lower)), own))  # lower case is made once, not for each of the texts


def with_samples(proposals: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds examples and counterexamples to ``proposals(doc_id, action, pattern, …)`` from ``texts(doc_id, cleaned, discarded, review_needed)``.

    Examples come from where the action's blocks lie, with the pattern itself at last; counterexamples of a discard are
    lines of the cleaned text that speak of cases, steps or parameters."""
    joined = proposals.join(texts.select("doc_id", *[F.col(c).alias(f"__{c}") for c in ("cleaned", "discarded", "review_needed")]), "doc_id", "left")
    pattern = F.col("pattern")
    of = lambda names: F.concat(*[snippets(F.col(f"__{n}"), pattern) for n in names], F.array(pattern))
    examples = F.when(F.col("action") == "discard", of(SAMPLED["discard"])).when(F.col("action") == "protect", of(SAMPLED["protect"])).otherwise(of(SAMPLED["review"]))
    body = F.filter(snippets(F.col("__cleaned"), pattern, COUNTER_SNIPPETS), lambda x: (T.strip(x) != T.strip(pattern)) & x.rlike(BODY_WORDS))
    found = T.once(joined, __e=examples, __b=F.when(F.col("action") == "discard", body).otherwise(F.array().cast("array<string>")))
    out = found.withColumns({"examples": F.slice(distinct_texts(F.col("__e")), 1, EXAMPLES), "counterexamples": F.slice(distinct_texts(F.col("__b")), 1, COUNTEREXAMPLES)})
    return out.drop("__cleaned", "__discarded", "__review_needed", "__e", "__b")


def number_variant(values: Column) -> Column:
    """A regular expression that fits texts which differ in their numbers only; null if they differ in more, or have none."""
    shape = lambda x: F.regexp_replace(T.strip(x), r"\d+", "\u0000")
    first = shape(F.get(values, 0))
    alike = F.forall(values, lambda x: shape(x) == first) & F.contains(first, F.lit("\u0000")) & (F.size(values) >= 2)
    return F.when(alike, F.replace(F.regexp_replace(first, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1"), F.lit("\u0000"), F.lit(r"\d+")))


def narrowed(proposals: DataFrame) -> DataFrame:
    """The follow-up of each literal discard that its counterexamples speak against: (id, pattern, match, scope, …) or no row.

    Examples that hold more than the pattern are candidates, shorter ones first. If they differ in numbers only, an
    expression for them is proposed, else the first that no counterexample holds. The scope is the document type, or
    the source, where one is known."""
    low = F.lower(F.col("pattern"))
    clean = lambda c: F.filter(F.transform(F.col(c), T.strip), lambda x: x != "")
    rows = proposals.where("action = 'discard' and match = 'literal'").withColumns({"__e": clean("examples"), "__c": clean("counterexamples")})
    rows = rows.where(F.exists("__c", lambda x: F.contains(F.lower(x), low)))
    wider = F.filter("__e", lambda x: (x != T.strip(F.col("pattern"))) & F.contains(F.lower(x), low))
    rows = rows.withColumn("__w", F.transform(F.array_sort(F.transform(wider, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda s: s["x"]))
    # a text fits the expression if it holds the shape of the candidates' numbers
    shape = F.regexp_replace(F.lower(F.get("__w", 0)), r"\d+", "\u0000")
    rows = rows.withColumns({"__r": number_variant(F.col("__w")), "__hit": F.exists("__c", lambda x: F.contains(F.regexp_replace(F.lower(x), r"\d+", "\u0000"), shape))})
    literal = F.get(F.filter("__w", lambda x: ~F.exists("__c", lambda c: F.contains(F.lower(c), F.lower(x)))), 0)
    use = F.col("__r").isNotNull() & ~F.col("__hit")
    out = rows.withColumns({"__new": F.when(use, F.col("__r")).otherwise(F.substring(literal, 1, 120)), "__kind": F.when(use, "regex").otherwise("literal")}).where("__new is not null")
    known = lambda c: F.nullif(F.nullif(T.strip(F.col(c)), F.lit("")), F.lit("unknown")) if c in proposals.columns else F.lit(None).cast("string")
    kept_scope = F.col("scope").isin("document_type", "source_pattern") if "scope" in proposals.columns else F.lit(False)
    scope = F.when(kept_scope, F.col("scope") if "scope" in proposals.columns else F.lit(None)).when(known("document_type").isNotNull(), "document_type").when(known("source").isNotNull(), "source_pattern").otherwise("user")
    return out.select("id", F.col("pattern").alias("narrowed_from"), F.col("__new").alias("pattern"), F.col("__kind").alias("match"), scope.alias("scope"), F.slice(distinct_texts(F.col("__w")), 1, EXAMPLES).alias("examples"))


def decide(proposals: DataFrame, choices: DataFrame, accepted_log: DataFrame, rejected_log: DataFrame) -> DataFrame:
    """``choices(id, choice)`` on proposals -> (id, choice, outcome): what is added to a log, is there already, or may not be.

    A proposal is accepted once, if its samples bear it out; what was accepted can't be rejected any more."""
    ok = accepted(proposals).select("id", "ok")
    done = lambda log, name: log.select("id", F.lit(True).alias(name)).distinct()
    rows = choices.join(ok, "id", "left").join(done(accepted_log, "__a"), "id", "left").join(done(rejected_log, "__r"), "id", "left")
    take = F.when(F.col("__a").isNotNull(), "already_accepted").when(F.col("__r").isNotNull(), "was_rejected").when(F.col("ok"), "accepted").otherwise("needs_narrowing")
    drop = F.when(F.col("__a").isNotNull(), "was_accepted").when(F.col("__r").isNotNull(), "already_rejected").otherwise("rejected")
    return rows.select("id", "choice", F.when(F.col("ok").isNull(), "unknown_proposal").when(F.col("choice") == "accept", take).when(F.col("choice") == "reject", drop).otherwise("unknown_choice").alias("outcome"))


def infer_scope(proposals: DataFrame) -> DataFrame:
    """(id, scope, source_pattern) for ``proposals(id, action, match, pattern, source, domain)`` that name no scope themselves.

    If others of the same action, match and pattern came from other sources, the scope is what the sources share: one
    domain, else a common beginning of their names of three characters or more, without numbers and marks at its end;
    else the user's own. Sources are put together by group, never in pairs."""
    keys = ["action", "match", "pattern"]
    stem = F.regexp_replace("source", r"\.[^./]+$", "")
    shared = proposals.groupBy(*keys).agg(F.countDistinct("source").alias("__n"), F.min(stem).alias("__a"), F.max(stem).alias("__b"), F.min("domain").alias("__d"), F.max("domain").alias("__e"), F.count_if(F.coalesce("domain", F.lit("")) == "").alias("__no"))
    joined = proposals.join(shared, keys)
    # names in order: what the first and the last have in common, all have
    common = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length("__a"), F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring("__a", i, F.lit(1)) == F.substring("__b", i, F.lit(1))) & (F.length("__b") >= i), i).otherwise(n))
    prefix = F.regexp_replace(F.substring(F.col("__a"), F.lit(1), common), r"[\d\W_]+$", "")
    one = (F.col("__no") == 0) & (F.col("__d") == F.col("__e"))
    pattern = F.when(F.col("__n") > 1, F.when(one, F.concat(F.lit("source_domain:"), F.col("__d"))).when(F.length(prefix) >= 3, prefix))
    return joined.select("id", F.when(pattern.isNotNull(), "source_pattern").otherwise("user").alias("scope"), pattern.alias("source_pattern"))


def promotable(proposed: DataFrame, existing: DataFrame, history: DataFrame) -> DataFrame:
    """(document_type, action, match, pattern, rule_id, outcome) for suggestions that should enter a type's dictionary.

    Rules that the dictionary has are skipped, equal ones count once; a type with failed promotions is blocked, one with
    unverified ones only warned about."""
    keys = ["document_type", "action", "match", "pattern"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    one = proposed.withColumn("__n", rank).where("__n = 1").drop("__n")
    known = existing.select(*keys, F.lit(True).alias("__known")).distinct()
    risk = promotion_summary(history).select("document_type", "failed", "unverified")
    rows = one.join(known, keys, "left").join(risk, "document_type", "left")
    outcome = F.when(F.coalesce("failed", F.lit(0)) > 0, "blocked").when(F.col("__known").isNotNull(), "duplicate").when(F.coalesce("unverified", F.lit(0)) > 0, "promoted_with_warning").otherwise("promoted")
    return rows.select(*keys, rule_id(F.concat(F.lit("learned-"), F.col("document_type"), F.lit("-"), F.col("id").cast("string"))).alias("rule_id"), outcome.alias("outcome"))


def rule_id(value: Column, most: int = 96) -> Column:
    """A text as the id of a rule: runs of anything but letters and digits become dashes."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9\x{4E00}-\x{9FFF}]+", "-"), "^-+|-+$", ""), 1, most)


def rule_effects(rules: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(id, doc_id, action, ok, effect): what literal rules did to the text that was cleaned with them. ``rules(id, doc_id, action, pattern)``.

    A discarding rule's pattern must be gone, a protecting rule's must be there; review is not checked. A document
    without a cleaned text fails."""
    joined = rules.join(cleaned.select("doc_id", F.col("markdown").alias("__t")), "doc_id", "left")
    held = F.contains(F.lower("__t"), F.lower("pattern"))
    effect = (
        F.when(F.col("__t").isNull(), "cleaned_output_missing").when(F.col("action") == "discard", F.when(held, "discard_pattern_still_in_cleaned").otherwise("discard_pattern_absent_from_cleaned"))
        .when(F.col("action") == "protect", F.when(held, "protect_pattern_present_in_cleaned").otherwise("protect_pattern_missing_from_cleaned")).otherwise("review_rule_not_checked_against_cleaned_text")
    )
    return joined.select("id", "doc_id", "action", (~effect.isin("cleaned_output_missing", "discard_pattern_still_in_cleaned", "protect_pattern_missing_from_cleaned")).alias("ok"), effect.alias("effect"))


def suggestions(feedback: DataFrame, rejected: DataFrame, least: int = 2) -> DataFrame:
    """Accepted discards by (document_type, match, pattern): those of ``least`` sources or more that nobody rejected."""
    keys = ["document_type", "action", "match", "pattern"]
    own = feedback.where("status = 'accepted' and action = 'discard'").join(rejected.select(*keys).distinct(), keys, "left_anti")
    return own.groupBy(*keys).agg(F.countDistinct("source").alias("sources"), F.min("created_at").alias("first_seen")).where(F.col("sources") >= least)


def repeated_sources(feedback: DataFrame) -> DataFrame:
    """Proposals of equal action, match and pattern from other sources: a self-join by key that pairs nobody.

    One row per proposal with the number of other sources, from the group's count and so linear in the rows."""
    keys = ["action", "match", "pattern"]
    counts = feedback.groupBy(*keys).agg(F.countDistinct("source").alias("n"))
    return feedback.join(counts, keys).select("id", (F.col("n") - 1).alias("other_sources")).where("other_sources > 0")


def promotion_summary(history: DataFrame) -> DataFrame:
    """Per document type: runs by outcome, samples, and the latest status."""
    c = F.col
    return history.groupBy("document_type").agg(
        F.count_if(c("status") == "passed").alias("passed"), F.greatest(F.lit(0).cast("long"), F.count_if(c("status") == "failed") - F.count_if(c("resolved"))).alias("failed"), F.count_if(c("status") == "unverified").alias("unverified"),
        F.sum("samples").alias("samples"), F.max_by("status", F.struct("created_at", "id")).alias("latest"),
    )


def dedupe(values: DataFrame, column: str, *order: str) -> DataFrame:
    """First of the values that are equal but for case, by a grouped minimum: a value that stands everywhere is put together where it is read."""
    first = F.min(F.struct(*order, *[c for c in values.columns if c not in order])).alias("__first")
    return values.groupBy(F.lower(column).alias("__key")).agg(first).select("__first.*").select(*values.columns)


def source_domain(url: Column) -> Column:
    """The authority of a URL in lower case, without www."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))), r"^www\.", "")


def source_matches(url: Column, pattern: str) -> Column:
    """A source pattern: ``source_domain:x`` for a domain and those below it, else a prefix that ends where a part of the URL does."""
    field, _, rest = pattern.lower().partition(":")
    if field == "source_domain" and rest:
        own = source_domain(url)
        return (own == rest) | own.endswith("." + rest)
    low, wanted = F.lower(url), rest if field == "source_url" else pattern.lower()
    return (low == wanted) | (low.startswith(wanted) & F.substring(low, len(wanted) + 1, 1).isin(*URL_ENDS))


def name_matches(name: Column, pattern: str) -> Column:
    """Whether a part of a path is the pattern, or begins with it where a part of the name ends."""
    wanted = pattern.lower()
    own = lambda x: (x == wanted) | (x.startswith(wanted) & F.substring(x, len(wanted) + 1, 1).isin(*NAME_ENDS))
    return F.exists(F.split(F.lower(F.replace(name, F.lit("\\"), F.lit("/"))), "/"), own)


def newest_runs(runs: DataFrame, keep: int = 3) -> DataFrame:
    """Adds ``retained``: the newest runs of each root stay."""
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("mtime"), F.desc("run")))
    return runs.withColumn("retained", rank <= keep)
