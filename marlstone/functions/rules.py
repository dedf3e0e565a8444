"""Column rules on names, texts and amounts: slugs, titles, tokens, redaction, detection, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: phrases by which a reply counts as a refusal, and the sentence put before one that is none
REFUSALS = ("i can't", "i cannot", "i'm not able", "i am not able", "i'll have to escalate", "i'll pass this", "i will have to escalate", "passing this to", "let me pass")
REFUSAL = "I'm not able to do that myself, so I'm passing this to a teammate who will follow up. "
# fixed values: actions that an agent may never take, in the order of the search: name, words, severity
FORBIDDEN_ACTIONS = (
    ("delete_data", ("delete", "drop", "purge", "wipe", "remove_account"), "high"),
    ("issue_refund", ("refund", "credit_back", "chargeback_reverse"), "medium"),
    ("change_billing", ("change_billing", "update_card", "modify_plan", "downgrade_plan"), "medium"),
    ("modify_privacy_settings", ("modify_privacy", "set_opt_out", "set_retention", "disable_audit", "disable_redaction"), "high"),
    ("cross_tenant_lookup", ("cross_tenant", "other_tenant", "look_up_another"), "high"),
    ("undelegated_authority", ("sign_contract", "promise_sla", "agree_to_nda", "commit_roadmap"), "medium"),
)
# fixed values: dollars a million input and output tokens by a part of the model's name; the last row is for all others
PRICES = (("opus", 15.0, 75.0), ("haiku", 0.8, 4.0), ("", 3.0, 15.0))
# fixed values: patterns of personal data
CARD = r"\b(?:\d[ -]?){13,19}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
TOKEN = r"\b(?:vw|sk|pk)_[A-Za-z0-9_\-]{8,}\b"
FOUND_EMAIL = r"(?iU)\b[\p{L}0-9._%+\-]+@[\p{L}0-9.\-]+\.[\p{L}]{2,}\b"
FOUND_SSN = r"(?U)(?<!\d)\d{3}[-\s]\d{2}[-\s]\d{4}(?!\d)"
FOUND_PHONE = r"(?U)(?:(?<!\w)\+?\d{1,3}[\s\-.]?)?(?:\(?\d{3}\)?[\s\-.]?)\d{3}[\s\-.]?\d{4}(?!\d)"
FOUND_URL = r"(?iU)(?:https?://|www\.)\S+|\b[\p{L}0-9\-]+\.(?:com|org|net|io|co|gov|edu|us|uk|de|fr|jp|cn|au|info)(?:/\S*)?\b"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
# fixed values: keys that an observation may not have, and beginnings of such
FORBIDDEN_KEYS = (
    "raw_text", "excerpt", "snippet", "body", "content", "file_path", "file_name", "filename", "source_uri", "blob_key", "path", "tenant_slug", "tenant_name",
    "display_name", "customer_name", "project_name", "org_name", "vendor_name", "person_name", "email", "phone", "count", "total", "revenue", "value", "amount",
    "headcount", "quantity", "title", "name", "label", "description", "query_text", "query", "q",
)
FORBIDDEN_BEGINNINGS = ("measurement_", "dim_")
# fixed values: numeric leaves by the range that they may have
RATIO_LEAVES = (
    "leaf_to_internal_ratio", "induced_vs_seed_ratio", "adherence_rate", "classifier_confidence_p50", "classifier_confidence_p10", "confidence_p50", "confusion_rate",
    "overall_confidence_p10", "classification_failure_rate", "ontology_assignment_failure_rate",
)
REAL_LEAVES = ("branching_factor_p50", "branching_factor_p95")
COUNT_LEAVES = ("depth", "median_lifecycle_states", "chunks_per_doc_p50", "chunks_per_doc_p95")
COUNT_MOST = 1000


def skill_slug(title: Column) -> Column:
    """Letters and digits of any script; runs of blanks, hyphens and underscores become one hyphen; the rest goes."""
    kept = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N} _-]", "")
    s = F.regexp_replace(F.regexp_replace(kept, "[ _-]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def _bounded(title: Column, tail: str) -> Column:
    long = F.when(F.length(title) < 4, F.concat(title, F.lit(" " + tail))).otherwise(title)
    return F.when(F.length(long) > 81, F.rtrim(F.substring(long, 1, 81))).otherwise(long)


def slug_title(slug: Column) -> Column:
    words = F.filter(F.split(slug, "-"), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), " ")
    return F.when(F.size(words) == 0, F.lit("Untitled")).otherwise(_bounded(title, "Skill"))


def group_title(domain: Column, kind: Column) -> Column:
    human = F.array_join(F.transform(F.split(kind, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), " ")
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.concat(domain, F.lit(" "), human), "[^A-Za-z0-9 -]", ""), " +", " "))
    return _bounded(clean, "Pattern")


def resolve(value: Column, vocab: dict[str, str], allowed: tuple[str, ...] = (), other: str = "other") -> Column:
    """Member of the vocabulary for a value, whatever its case and outer blanks; the first of equal keys; ``other`` without one."""
    first: dict[str, str] = {}
    for k, v in vocab.items():
        first.setdefault(k.strip().lower(), v if not allowed or v in allowed else other)
    if not first:
        return F.lit(other)
    names = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(F.trim(value))), F.lit(other))


def canonical_template(template: Column, vocab: dict[str, str], allowed: tuple[str, ...], blanks: bool = False) -> Column:
    """struct<template, tokens> of a ``<token>-<token>`` template: tokens resolved, literals in lower case, other characters a hyphen."""
    closed = F.regexp_replace(template, "(?s)<[^>]*$", "")
    parts = F.regexp_extract_all(closed, F.lit("(?s)(<[^>]*>|[^<])"), F.lit(1))
    name = lambda p: resolve(F.substring(p, F.lit(2), F.length(p) - 2), vocab, allowed)
    literal = "[a-z_ -]" if blanks else "[a-z_-]"
    told = F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("<")), F.concat(F.lit("<"), name(p), F.lit(">"))).when(F.rlike(F.lower(p), F.lit(literal)), F.lower(p)).otherwise(F.lit("-")))
    text = F.regexp_replace(F.array_join(told, ""), "^-+|-+$", "")
    text = F.trim(text) if blanks else text
    tokens = F.transform(F.filter(parts, lambda p: F.startswith(p, F.lit("<"))), name)
    empty = text == ""
    return F.struct(F.when(empty, F.lit("<other>")).otherwise(text).alias("template"), F.array_distinct(F.when(empty, F.concat(tokens, F.array(F.lit("other")))).otherwise(tokens)).alias("tokens"))


def redact(text: Column) -> Column:
    """Card numbers that pass Luhn, then SSNs, then bearer tokens, replaced by marks; of a ``vw_p_`` token the prefix stays."""
    digits = lambda m: F.regexp_replace(m, r"\D", "")
    cards = F.filter(F.regexp_extract_all(text, F.lit(f"({CARD})"), F.lit(1)), lambda m: F.length(digits(m)).between(13, 19) & F.call_function("luhn_check", digits(m)))
    t = F.aggregate(cards, text, lambda s, m: F.replace(s, m, F.lit("[REDACTED:CC]")))
    t = F.regexp_replace(t, SSN, "[REDACTED:SSN]")
    t = F.regexp_replace(t, r"\bvw_([A-Za-z0-9\-]*)_[A-Za-z0-9_\-]{8,}\b", "vw_$1_[REDACTED]")
    return F.regexp_replace(t, TOKEN, "[REDACTED:TOKEN]")


def detect(text: Column) -> Column:
    """The first kind of personal data that a string holds, in a fixed order; null for a UUID or a clean one."""
    has = lambda p: F.rlike(text, F.lit(p))
    return F.when(has(UUID), F.lit(None).cast("string")).when(has(FOUND_EMAIL), "NER_HIT_EMAIL").when(has(FOUND_SSN), "NER_HIT_SSN").when(has(FOUND_PHONE), "NER_HIT_PHONE").when(has(FOUND_URL), "NER_HIT_URL")


def forbidden_action(intent: Column) -> Column:
    """Name of the first forbidden action whose name or word stands in the intent; null without one."""
    low, out = F.lower(intent), F.lit(None).cast("string")
    for name, words, _ in reversed(FORBIDDEN_ACTIONS):
        out = F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in (name, *words))), F.lit(name)).otherwise(out)
    return out


def severity(action: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for n, _, s in FORBIDDEN_ACTIONS for x in (n, s)]), action)


def safe_refusal(reply: Column) -> Column:
    low = F.lower(reply)
    return F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in REFUSALS)), reply).otherwise(F.concat(F.lit(REFUSAL), reply))


def valid_slug(slug: Column) -> Column:
    return F.rlike(slug, F.lit(r"^[a-z][a-z0-9-]{1,30}[a-z0-9]\z")) & ~slug.contains("--")


def token_parts(token: Column) -> Column:
    """struct<prefix, secret> of ``vw_prefix_secret`` with 12 and 32 characters or more; null otherwise."""
    p = F.split(token, "_", 3)
    ok = (F.size(p) == 3) & (F.get(p, F.lit(0)) == "vw") & (F.length(F.get(p, F.lit(1))) >= 12) & (F.length(F.get(p, F.lit(2))) >= 32)
    return F.when(ok, F.struct(F.get(p, F.lit(1)).alias("prefix"), F.get(p, F.lit(2)).alias("secret")))


def iso_time(text: Column) -> Column:
    """Timestamp of an ISO-8601 text, ``Z`` included; null where it is none."""
    return F.try_to_timestamp(text)


def usd(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars of a run, by the first price whose name the model's name holds."""
    cost = lambda a, b: tokens_in / F.lit(1e6) * a + tokens_out / F.lit(1e6) * b
    *named, (_, a, b) = PRICES
    out = cost(a, b)
    for name, a, b in reversed(named):
        out = F.when(F.contains(F.lower(model), F.lit(name)), cost(a, b)).otherwise(out)
    return out


def spent(reported: Column, estimated: Column) -> Column:
    return F.when(reported > 0, reported).otherwise(estimated)


def spend_decision(day: Column, week: Column, month: Column, caps: tuple[float, float, float] = (20.0, 100.0, 350.0)) -> Column:
    """Which cap is reached, the day's first; ``under_caps`` without one. Sums come unrounded."""
    return F.when(day >= caps[0], "daily_cap_hit").when(week >= caps[1], "weekly_cap_hit").when(month >= caps[2], "monthly_cap_hit").otherwise("under_caps")


def merge_gate(c: dict[str, Column], files: int = 15, lines: int = 500, branch: str = "^agent/[A-Za-z0-9._-]+$") -> Column:
    """The first gate that holds a change back, or ``merge``; a change waits for its running checks before a failed one blocks it.

    c: head_ref, title, body, files, lines, critical, checks, pending and failed (counts of check runs, see ``run_state``).
    """
    marked = F.rlike(F.concat_ws(" ", c["title"], c["body"]), F.lit(r"(?i)\[needs-review\]"))
    return (
        F.when(~F.rlike(c["head_ref"], F.lit(branch)), "head_ref_not_agent").when(marked, "needs_review").when(c["files"] > files, "too_many_files").when(c["lines"] > lines, "too_many_lines")
        .when(c["critical"] > 0, "privacy_critical_path").when(c["checks"] == 0, "no_checks").when(c["pending"] > 0, "wait").when(c["failed"] > 0, "block_failed_checks").otherwise("merge")
    )


def run_state(status: Column, conclusion: Column) -> Column:
    """pending, passed or failed: a run that has ended well, neutrally or was skipped has passed."""
    return F.when(status.isin("queued", "in_progress", "pending"), "pending").when(conclusion.isin("success", "neutral", "skipped"), "passed").otherwise("failed")


def tenant_gate(action_known: Column, authed: Column, caller: Column, target: Column, destructive: Column, verified: Column) -> Column:
    return (
        F.when(~action_known, "deny_unknown").when(caller.isNull() | target.isNull(), "deny_missing").when(~authed, "deny_unauthenticated")
        .when(caller != target, "deny_mismatch").when(destructive & ~verified, "deny_unverified").otherwise("allow")
    )


def answer(json: Column, known: tuple[str, ...], most: int = 3) -> Column:
    """struct<type, confidence, alternatives, error> of a model's answer: its first brace to its last, read as JSON.

    An unknown type is ``unclassified``; a text without a readable object has confidence 0 and error NOVEL_PATTERN.
    """
    body = F.regexp_extract(F.coalesce(json, F.lit("")), r"(?s)\{.*\}", 0)
    j = F.from_json(F.when(body != "", body), "type string, confidence double, alternatives array<struct<type: string, confidence: double>>")
    name = lambda t: F.when(t.isin(*known), t).otherwise(F.lit("unclassified"))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    bad = j["type"].isNull()
    alts = F.slice(F.filter(F.coalesce(j["alternatives"], F.array().cast("array<struct<type: string, confidence: double>>")), lambda a: a["type"].isin(*known)), 1, most)
    return F.struct(
        F.when(bad, F.lit("unclassified")).otherwise(name(j["type"])).alias("type"), F.when(bad, F.lit(0.0)).otherwise(unit(F.coalesce(j["confidence"], F.lit(0.5)))).alias("confidence"),
        F.when(bad, F.array().cast("array<struct<type: string, confidence: double>>")).otherwise(alts).alias("alternatives"), F.when(bad, F.lit("NOVEL_PATTERN")).alias("error"),
    )
