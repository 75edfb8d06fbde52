"""Rule dictionaries as data: our own terms, patterns and cleaning rules, validated and compiled to columns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T

ACTIONS = ("discard", "review", "protect")
MATCHES = ("literal", "regex")


def pattern_problem(pattern: str) -> str | None:
    """Why the engine that runs the pattern does not take it; its own dialect decides, where a session is there to be asked."""
    context = SparkContext._active_spark_context
    try:
        if context is None:
            re.compile(pattern)
        else:
            context._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as error:  # noqa: BLE001  either engine's own kind
        java = getattr(error, "java_exception", None)
        return str(java.getDescription() if java is not None else error)
    return None


@dataclass(frozen=True)
class CleaningRule:
    """One rule on a text; the first that matches decides. Literal: lower-case containment; regex: found in either case."""

    rule_id: str
    action: str
    match: str
    pattern: str
    reason: str = ""
    source: str = "base"
    risk_tag: str = "promotional_line"

    def problems(self) -> list[str]:
        found = [f"{self.rule_id or '?'}: {name} is empty" for name in ("rule_id", "pattern") if not getattr(self, name).strip()]
        if self.action not in ACTIONS:
            found.append(f"{self.rule_id}: action {self.action!r} is none of {', '.join(ACTIONS)}")
        if self.match not in MATCHES:
            found.append(f"{self.rule_id}: match {self.match!r} is none of {', '.join(MATCHES)}")
        if self.match == "regex" and (problem := pattern_problem(self.pattern)):
            found.append(f"{self.rule_id}: {problem}")
        return found

    def hits(self, c: Column, low: Column | None = None) -> Column:
        if self.match == "literal":
            return F.contains(F.lower(c) if low is None else low, F.lit(self.pattern.lower()))
        return T.found(c, T.anycase(self.pattern), low)


@dataclass(frozen=True)
class RuleSet:
    cta: tuple[str, ...] = ("subscribe today", "join our community", "click the link below", "scan the code", "sign up now")
    filler: tuple[str, ...] = (r"^(um+|uh+|okay|right|you know)[.,!]?$",)
    refund: tuple[str, ...] = (r"refund policy", r"money[- ]back guarantee")
    footer: tuple[str, ...] = (r"all rights reserved", r"^copyright (notice|\x{A9}|\(c\))", r"^page \d+ of \d+$")
    evidence: tuple[tuple[str, str], ...] = (("revenue_claim", r"earned \d+%|revenue of \$?\d+"), ("testimonial", r"changed my life|five stars"))
    protected: tuple[tuple[str, str], ...] = (("prompt", r"^prompt:"), ("tool_instruction", r"\binstall the (tool|plugin)\b"))
    knowledge: tuple[str, ...] = ("method", "case study", "how to")
    wrapper_lines: tuple[str, ...] = (r"^about this (book|course)$", r"^thank you for reading")
    wrapper_headings: tuple[str, ...] = ("Membership benefits", "About the publisher", "Join the club", "Acknowledgements")
    back_matter: tuple[str, ...] = ("About the publisher", "Acknowledgements")
    own_titles: tuple[str, ...] = ()
    business_context: tuple[str, ...] = ("method", "strategy", "conversion rate")
    method_patterns: tuple[str, ...] = (r"(how to|method|strategy|case).{0,80}(traffic|account|conversion|workflow)",)
    conditional_cta: tuple[str, ...] = (r"(if|when).{0,40}(scan the code|sign up now).{0,60}(keep|mark|record|delete)",)
    tutorial: tuple[str, ...] = ("tutorial", "step", "guide", "how to", "setup", "workflow")
    qr_markers: tuple[str, ...] = ("qr", "qrcode")
    image_qr: tuple[str, ...] = (r"qr[ _-]*code", r"\bscan to\b", r"scan the code")
    image_proof: tuple[str, ...] = (r"\brevenue\b", r"\bincome\b", r"\btestimonial", r"\bfollowers\b")
    image_marketing: tuple[str, ...] = (r"\bdiscount\b", r"\bon sale\b", r"limited[- ]time offer")
    image_operation: tuple[str, ...] = (r"\bstep\b", r"\bclick\b", r"\bsettings?\b", r"\bscreenshot\b", r"\bdashboard\b")
    image_education: tuple[str, ...] = ("tutorial", "guide", "workflow")
    protect_intent: tuple[str, ...] = ("keep", "protect", "important")
    discard_intent: tuple[str, ...] = ("remove", "drop", "discard", "noise", "spam")
    sources: tuple[str, ...] = ("own terms",)
    rules: tuple[CleaningRule, ...] = field(
        default=(
            CleaningRule("keep-licence", "protect", "literal", "license", "licences stay with the text"),
            CleaningRule("drop-offer", "discard", "regex", r"limited[- ]time offer", "sales line"),
            CleaningRule("drop-subscribe", "discard", "literal", "subscribe today", "call to action"),
            CleaningRule("check-contact", "review", "regex", r"[a-z0-9.]+@[a-z0-9.]+", "contact data"),
        )
    )

    def problems(self) -> list[str]:
        return [p for rule in self.rules for p in rule.problems()]

    def first_rule(self, c: Column, name: str = "rule_id") -> Column:
        """By priority: protecting rules, then rules of users, then the others unless a knowledge term speaks for the text."""
        return self.of_rule(self.rule_at(c), name)

    def rule_at(self, c: Column, low: Column | None = None) -> Column:
        """The place among the rules of the one that ``first_rule`` names; null for none."""
        of_users = lambda r: r.source == "user" or r.risk_tag.startswith("user_feedback_")
        own = list(enumerate(self.rules))
        tiers = [x for x in own if x[1].action == "protect"], [x for x in own if x[1].action != "protect" and of_users(x[1])]
        rest = [x for x in own if x[1].action != "protect" and not of_users(x[1])]
        knows = F.lit(False)
        for term in self.knowledge:
            knows = knows | F.contains(c, F.lit(term))
        cases = [F.when(r.hits(c, low), F.lit(i)) for tier in tiers for i, r in tier] + [F.when(r.hits(c, low) & ~knows, F.lit(i)) for i, r in rest]
        return F.coalesce(*cases, F.lit(None).cast("int"))

    def of_rule(self, at: Column, name: str) -> Column:
        """What the rule at a place says of itself."""
        return F.get(F.array(*[F.lit(getattr(r, name)) for r in self.rules]), at) if self.rules else F.lit(None).cast("string")

    def any_rule(self, c: Column, low: Column | None = None) -> Column:
        """Whether any rule at all matches, whatever it would do."""
        found = F.lit(False)
        for rule in self.rules:
            found = found | rule.hits(c, low)
        return found


def distinct_rules(rules: list[CleaningRule]) -> tuple[CleaningRule, ...]:
    """Of rules equal in action, match and pattern (but for case) the first."""
    seen, kept = set(), []
    for rule in rules:
        key = rule.action, rule.match, rule.pattern.lower()
        if key not in seen:
            seen.add(key)
            kept.append(rule)
    return tuple(kept)


def load_rules(paths: list[str], base: RuleSet | None = None) -> RuleSet:
    """The base rules and those of JSON files in order; a missing file counts as empty, of equal rules the first stays."""
    base = base or RuleSet()
    rows = [row for p in paths if Path(p).exists() for row in json.loads(Path(p).read_text())]
    rules = [*base.rules, *[CleaningRule(**{k: v for k, v in row.items() if k in CleaningRule.__dataclass_fields__}) for row in rows]]
    return _sound(replace(base, rules=distinct_rules(rules)))


def _sound(rules: RuleSet) -> RuleSet:
    if found := rules.problems():
        raise ValueError("; ".join(found))
    return rules


#: Names of keyword sets in dictionary files -> fields of a rule set. Fixed values of the file format.
KEYWORD_SETS = {
    "cta_keywords": "cta", "qr_image_markers": "qr_markers", "image_qr_indicators": "image_qr", "image_marketing_indicators": "image_marketing", "image_operation_indicators": "image_operation",
    "image_proof_indicators": "image_proof", "image_educational_heading_indicators": "image_education", "tutorial_indicators": "tutorial", "knowledge_terms": "knowledge", "refund_patterns": "refund",
    "footer_patterns": "footer", "evidence_patterns": "evidence", "marketing_wrapper_heading_terms": "wrapper_headings", "marketing_wrapper_back_matter_terms": "back_matter",
    "marketing_wrapper_line_patterns": "wrapper_lines", "business_method_context_terms": "business_context", "transcript_filler_patterns": "filler", "protected_patterns": "protected",
    "feedback_protect_intent_terms": "protect_intent", "feedback_discard_intent_terms": "discard_intent",
}
LABELLED = ("evidence", "protected")
#: Rule files that a profile adds to the base. Fixed values.
PROFILE_TEMPLATES = {"curated_obsidian_kb": ("self_media_course",)}
SCOPES = ("global", "user", "project", "document_type", "source_pattern")


def _dictionary(path: Path, name: str) -> tuple[list[CleaningRule], dict[str, list]]:
    """The rules and keyword sets of one dictionary file; what is wrong is named with its place."""
    data = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(data, dict) or not str(data.get("schema", "")).endswith("cleaning_rules.v1"):
        raise ValueError(f"{name}: no dictionary of cleaning rules, version 1")
    sets = data.get("keyword_sets", {})
    rows = data.get("rules", [])
    if not isinstance(sets, dict) or not isinstance(rows, list):
        raise ValueError(f"{name}: keyword_sets must be an object and rules a list")
    rules = []
    for i, row in enumerate(rows):
        if not isinstance(row, dict):
            raise ValueError(f"{name}: rules[{i}] must be an object")
        if row.get("type") != "promotional_line":
            continue
        for key in ("id", "action", "match", "pattern", "reason", "risk_tag"):
            if not isinstance(row.get(key), str) or not row[key].strip():
                raise ValueError(f"{name}: rules[{i}].{key} is required")
        rule = CleaningRule(row["id"], row["action"], row["match"], row["pattern"], row["reason"], name, row["risk_tag"])
        if found := rule.problems():
            raise ValueError(f"{name}: rules[{i}]: {'; '.join(found)}")
        rules.append(rule)
    kept: dict[str, list] = {}
    for key, field_name in KEYWORD_SETS.items():
        values = sets.get(key, [])
        if not isinstance(values, list):
            raise ValueError(f"{name}: {key} must be a list")
        if field_name in LABELLED:
            if not all(isinstance(v, dict) and v.get("label") and v.get("pattern") for v in values):
                raise ValueError(f"{name}: {key} must hold labels and patterns")
            kept[field_name] = [(v["label"], v["pattern"]) for v in values]
        else:
            if not all(isinstance(v, str) and v.strip() for v in values):
                raise ValueError(f"{name}: {key} must hold texts")
            kept[field_name] = values
    return rules, kept


def accepted_rules(rows: list[dict], document_type: str = "", identity: str = "") -> list[CleaningRule]:
    """The rules that accepted proposals make for a document type and a source: they act before the base's own."""
    found = []
    for row in rows:
        if row.get("status") != "accepted":
            continue
        if row.get("scope") == "document_type" and row.get("document_type") and row["document_type"] != document_type:
            continue
        if row.get("scope") == "source_pattern" and not source_pattern_matches(str(row.get("source_pattern") or ""), identity):
            continue
        found.append(CleaningRule(str(row.get("accepted_rule_id") or row["id"]), row["action"], row.get("match", "literal"), row["pattern"], row.get("reason", ""), "user", f"user_feedback_{row['action']}"))
    return found


def load_layers(root: str, profile: str = "standard", document_type: str = "", templates: tuple[str, ...] = (), accepted: tuple[str, ...] = (), identity: str = "") -> RuleSet:
    """A rule set from a folder of dictionaries: base, document type, templates of the profile and others, accepted rules.

    Missing files are passed over; values equal but for case count once, the first of them. What no file says is empty:
    nothing of the library's own terms is mixed in."""
    names = ["base/obvious_noise.json", *([f"document_types/{document_type}.json"] if document_type else []), *[f"templates/{t}.json" for t in (*PROFILE_TEMPLATES.get(profile, ()), *templates)]]
    rules: list[CleaningRule] = []
    sets: dict[str, list] = {f: [] for f in KEYWORD_SETS.values()}
    sources = []
    for name in names:
        path = Path(root) / name
        if not path.exists():
            continue
        own, keywords = _dictionary(path, name)
        rules += own
        for key, values in keywords.items():
            sets[key] += values
        sources.append(name)
    for path in [Path(root) / "user" / "accepted_rules.jsonl", *map(Path, accepted)]:
        if path.exists():
            rows = [json.loads(line) for line in path.read_text(encoding="utf-8").splitlines() if line.strip()]
            if mine := accepted_rules(rows, document_type, identity):
                rules += mine
                sources.append(str(path))
    once = {key: tuple({str(v).lower(): v for v in reversed(values)}[k] for k in dict.fromkeys(str(v).lower() for v in values)) for key, values in sets.items()}
    return _sound(RuleSet(**once, rules=distinct_rules(rules), own_titles=(), method_patterns=(), conditional_cta=(), sources=tuple(sources)))


#: What may follow a prefix for it to end where a part of the value does. Fixed values.
URL_ENDS, NAME_ENDS = ("/", "?", "#", "&"), ("-", "_", ".", " ", "~", "(", "[", "{")
KEYED = ("input_path", "source_path", "source_name", "source_url", "source_domain", "site_name", "origin", "origin_url")


def identity_values(identity: str) -> list[tuple[str, str]]:
    """(key, value) of a source's identity, a JSON object of any depth or a plain text; lower case, each once."""
    try:
        parsed = json.loads(identity) if identity.strip() else {}
    except ValueError:
        parsed = None
    found: list[tuple[str, str]] = []

    def walk(value: dict, above: str) -> None:
        for key, own in value.items():
            full = f"{above}.{key}" if above else str(key)
            if isinstance(own, dict):
                walk(own, full)
                continue
            for item in own if isinstance(own, list) else [own]:
                if isinstance(item, str | int | float):
                    found.append((str(key).strip(), str(item)))
                    if full != key and not isinstance(own, list):
                        found.append((full, str(item)))

    if isinstance(parsed, dict):
        walk(parsed, "")
    elif identity.strip():
        found.append(("source_identity", identity))
    clean = [(k.lower(), v.replace("\\", "/").lower().strip()) for k, v in found]
    return list(dict.fromkeys((k, v) for k, v in clean if v))


def _part_matches(key: str, pattern: str, value: str) -> bool:
    if key == "source_domain":
        return value == pattern or value.endswith("." + pattern)
    begins = lambda v, ends: v == pattern or v.startswith(pattern) and v[len(pattern)] in ends
    if key in ("source_url", "origin_url"):
        return begins(value, URL_ENDS)
    if key in ("input_path", "source_path", "source_name", "source_identity"):
        return any(begins(part, NAME_ENDS) for part in value.split("/") if part)
    return begins(value, NAME_ENDS)


def source_pattern_matches(pattern: str, identity: str) -> bool:
    """Whether a source pattern, ``key:value`` or plain, fits an identity: whole domains, URLs, path parts and names, or beginnings of them."""
    wanted = pattern.strip().replace("\\", "/").lower()
    key, _, rest = wanted.partition(":")
    keyed = bool(rest) and key in KEYED
    return bool(wanted) and any((not keyed or k == key) and _part_matches(k, rest if keyed else wanted, v) for k, v in identity_values(identity))
