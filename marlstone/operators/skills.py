"""Learned skills and what guards them: ranking for a tenant, the collector's outcomes, quotes, support triage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import rules as R
from marlstone.functions.columns import clamp01
from marlstone.operators import signatures

# fixed values: weights of a skill's score
BASE, VOCAB, TYPES, KIND = 0.30, 0.35, 0.25, 0.10
LONGEST, OVERLAP, SURE = 64, 0.30, 0.7


@dataclass(frozen=True)
class Skill:
    title: str
    kind: str
    domain: str
    body: str


def _jaccard(part: Column, whole: Column) -> Column:
    """Similarity of a set and a part of it; 0 if either is empty."""
    return F.when((F.size(part) > 0) & (F.size(whole) > 0), F.size(part) / F.size(whole)).otherwise(F.lit(0.0))


def ranked_skills(tenants: DataFrame, skills: tuple[Skill, ...]) -> DataFrame:
    """tenants (with domain, vocab, types and kinds) times the skills of their domain: skill, kind, score and place.

    The skill library is short and the driver's; scores are one array a tenant.
    """
    def scored(s: Skill) -> Column:
        within = lambda words: F.filter(words, lambda w: (w != "") & F.contains(F.lit(s.body), w))
        score = BASE + VOCAB * _jaccard(within(F.col("vocab")), F.col("vocab")) + TYPES * _jaccard(within(F.col("types")), F.col("types")) + KIND * F.array_contains("kinds", s.kind).cast("int")
        return F.struct((-score).alias("less"), F.lit(s.kind).alias("kind"), F.lit(s.title).alias("skill"), F.lit(s.domain).alias("of"))

    own = F.filter(F.array(*[scored(s) for s in skills]), lambda x: x["of"] == F.col("domain"))
    keep = [c for c in tenants.columns if c not in ("vocab", "types", "kinds")]
    return tenants.select(*keep, F.posexplode(F.array_sort(own)).alias("i", "s")).select(*keep, F.col("s.skill").alias("skill"), F.col("s.kind").alias("kind"), (-F.col("s.less")).alias("score"), (F.col("i") + 1).alias("place"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the text in lower case; letters are split once a side, not once a trigram."""
    letters = F.split(F.lower(text), "")
    n = F.greatest(F.length(text) - 2, F.lit(0))
    side = lambda k: F.slice(letters, F.lit(k), n)
    return F.array_distinct(F.zip_with(F.zip_with(side(1), side(2), lambda x, y: F.concat(x, y)), side(3), lambda x, y: F.concat(x, y)))


def quote_check(rows: DataFrame, keys: list[str], corpus: DataFrame) -> DataFrame:
    """keys, n_trigrams, n_shared and reason: a string that is too long, or that shares too many trigrams with the corpus."""
    own = rows.select(*keys, "text", trigrams(F.col("text")).alias("g"))
    known = corpus.where("text IS NOT NULL").select(F.explode(trigrams(F.col("text"))).alias("t")).distinct()
    shared = own.select(*keys, F.explode("g").alias("t")).join(known, "t").groupBy(*keys).agg(F.count("*").alias("n_shared"))
    m = F.coalesce("n_shared", F.lit(0))
    reason = F.when(F.length("text") > LONGEST, "STRING_TOO_LONG").when(m > OVERLAP * F.size("g"), "QUOTE_OVERLAP")
    return own.join(shared, keys, "left").select(*keys, F.size("g").cast("long").alias("n_trigrams"), m.alias("n_shared"), reason.alias("reason"))


def collected(raw: DataFrame, opted_out: Column, failed: Column, checks: dict[str, Column]) -> DataFrame:
    """raw with outcome and reason: nothing is computed for a tenant that opted out; else the first check that fails rejects.

    checks: a column a stage, in order, null where it passes.
    """
    reason = F.coalesce(*checks.values())
    outcome = F.when(opted_out, "opt_out_dropped").when(failed, "signature_failed").when(reason.isNotNull(), "checker_rejected").otherwise("accepted")
    return raw.withColumns({"outcome": outcome, "reason": F.when(~opted_out & ~failed, reason)})


# fixed values: replies where the model failed, and where an action was denied
FAILED = "Something went wrong on our side. I've passed this to a teammate who will follow up."
DENIED = "I can't help with that - that's outside what I'm allowed to look up for this account."


def triaged(messages: DataFrame) -> DataFrame:
    """messages with decision (resolved or escalated), reason, severity and reply of the agent's answer.

    messages: reply, confidence, escalate, given_reason and given_severity (of the model, or null), error (null: none)
    and calls, an array of struct<name, args, allowed>, the model's tool calls with the gate's verdict. A call is
    forbidden by its name or else by its arguments, never by what the customer wrote; of several the last counts.
    A forbidden call escalates with a refusal before the reply, then a wish of the model or a low confidence
    escalates (the model's own reason first, then the confidence), and a denied call, which is not escalated,
    is answered by a fixed sentence that repeats nothing.
    """
    judged = F.transform("calls", lambda c: F.coalesce(R.forbidden_action(c["name"]), R.forbidden_action(c["args"])))
    bad = F.filter(judged, lambda a: a.isNotNull() & (R.severity(a) != "low"))
    action = F.get(bad, F.size(bad) - 1)
    denied = F.exists(F.zip_with("calls", judged, lambda c, a: a.isNull() & ~c["allowed"]), lambda x: x)
    failed, low, wished = F.col("error").isNotNull(), F.col("confidence") < SURE, F.col("escalate")
    told = F.coalesce(F.when(F.col("given_reason") != "", F.col("given_reason")), F.when(low, "low confidence").otherwise("agent requested"))
    reason = F.when(failed, F.concat(F.lit("LLM error: "), "error")).when(action.isNotNull(), F.concat(F.lit("forbidden action attempted: "), action)).when(wished | low, told)
    grade = F.when(failed, "medium").when(action.isNotNull(), R.severity(action)).when(wished | low, F.coalesce(F.when(F.col("given_severity") != "", F.col("given_severity")), F.lit("low")))
    reply = F.when(failed, FAILED).when(action.isNotNull(), R.safe_refusal(F.col("reply"))).when(wished | low, F.col("reply")).when(denied, DENIED).otherwise(F.col("reply"))
    return messages.withColumns({"decision": F.when(reason.isNotNull(), "escalated").otherwise("resolved"), "reason": reason, "severity": grade, "reply": reply})


# fixed values: tenants, observations and mean confidence that a group must reach; how many shapes and ids it names
THRESHOLDS, MOST_SHAPES, MOST_IDS = (3, 25, 0.65), 16, 10_000


def groups(observations: DataFrame, by_domain: dict[str, tuple[int, int, float]] | None = None, default: tuple[int, int, float] = THRESHOLDS) -> DataFrame:
    """A row for each (domain, kind): tenants, observations, mean_confidence, shapes, observation_ids and crossing.

    observations: domain, tenant, observation (its id), seq (its place in the store) and payload, a struct of
    ``signatures.PAYLOAD``; kinds that feed no skill are left out. shapes: the first different ones, as they came;
    observation_ids: the first, as they came, ``MOST_IDS`` at most. crossing: whether the group reaches the
    thresholds of its domain, or else the default. What is kept of a group is cut before it is gathered.
    """
    kind = signatures.skill_kind(F.col("payload.kind"))
    rows = observations.select("domain", kind.alias("kind"), "tenant", "observation", "seq", signatures.confidence(F.col("payload")).alias("sure"), signatures.fingerprint(F.col("payload")).alias("shape")).where("kind IS NOT NULL")
    key = ["domain", "kind"]

    def first(df: DataFrame, what: str, most: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*key).orderBy("seq", what))
        some = df.withColumn("place", place).where(F.col("place") <= most)
        return some.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", what))), lambda x: x[what]).alias("ids" if what == "observation" else "shapes"))

    seen = rows.where("shape <> ''").groupBy(*key, "shape").agg(F.min("seq").alias("seq"))
    sums = rows.groupBy(*key).agg(F.countDistinct("tenant").alias("tenants"), F.count("*").alias("observations"), F.avg("sure").alias("mean"))
    told = sums.join(first(seen, "shape", MOST_SHAPES), key, "left").join(first(rows.select(*key, "seq", "observation"), "observation", MOST_IDS), key, "left")
    limits = [F.lit(x) for x in default]
    for domain, own in (by_domain or {}).items():
        limits = [F.when(F.col("domain") == domain, x).otherwise(y) for x, y in zip(own, limits, strict=True)]
    mean = clamp01(F.col("mean"))
    crossing = (F.col("tenants") >= limits[0]) & (F.col("observations") >= limits[1]) & (mean >= limits[2])
    return told.select(*key, "tenants", "observations", mean.alias("mean_confidence"), F.coalesce("shapes", F.array().cast("array<string>")).alias("shapes"), F.col("ids").alias("observation_ids"), crossing.alias("crossing"))


# fixed values: parts of a skill's text
BODY = (
    "## When to apply\n\nApply when ingesting documents in the %s domain that produce a %s signature.\n\n## Recurring shape\n\n%s\n\n## Operational guidance\n\n"
    "This pattern was observed across %d distinct tenants with a bucketed mean confidence of %.2f.\n"
    "Future ingestions in this domain should treat the recurring shape above as a default expectation and prompt the classifier to confirm.\n"
)
NO_SHAPE = "- (no shape examples)"
# fixed values: numbers that a skill's text may hold
ALLOWED_NUMBERS = r"^(?:0|1-10|11-50|51-200|201-1000|1001-10000|1000\+|10000\+|3-10|11-100|101-1000|200\+|0(?:\.\d{1,4})?|1(?:\.0{1,4})?)$"
LONGEST_TEXT, LONGEST_TOKEN, MOST_VERSIONS = 64_000, 240, 10_000
TITLE = r"^[A-Z][a-zA-Z0-9 -]{3,80}\z"


def skill_body(domain: Column, kind: Column, shapes: Column, tenants: Column, mean: Column) -> Column:
    """The text of a skill, from its group's fields alone."""
    listed = F.array_join(F.transform(shapes, lambda s: F.concat(F.lit("- `"), s, F.lit("`"))), "\n")
    return F.format_string(BODY, domain, kind, F.when(F.size(shapes) > 0, listed).otherwise(NO_SHAPE), tenants.cast("long"), mean.cast("double"))


def _prose(text: Column) -> Column:
    """Markdown without fence lines, and outside fences without heads, bullets and backticks: parts between fence lines lie outside and inside in turn."""
    parts = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"(?m)^[^\S\n]*```[^\n]*\n?")

    def plain(part: Column) -> Column:
        for noise in (r"(?m)^[^\S\n]*#{1,6}[^\S\n]*", r"(?m)^[^\S\n]*[-*+][^\S\n]+", "`"):
            part = F.regexp_replace(part, noise, "")
        return part

    return F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 0, plain(part)).otherwise(part)), "")


def skill_text_fault(text: Column) -> Column:
    """Why a skill's text may not be kept: length, forbidden words, personal data (phone before SSN here), raw numbers, long tokens; null if it may."""
    prose = _prose(text)
    tokens = F.filter(F.split(F.regexp_replace(prose, r'[,;:()\[\]{}<>"]', " "), r"(?U)\s+"), lambda t: t != "")
    bare = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[.,;:!?]+|[.,;:!?]+$", ""))
    word = F.transform(bare, lambda t: F.regexp_replace(F.lower(t), "^[_-]+|[_-]+$", ""))
    forbidden = F.exists(word, lambda w: w.isin(*R.FORBIDDEN_KEYS) | F.rlike(w, F.lit("^(?:" + "|".join(R.FORBIDDEN_BEGINNINGS) + ")")))
    has = lambda p: F.rlike(prose, F.lit(p))
    raw = F.exists(bare, lambda t: F.rlike(t, F.lit(r"(?U)\d")) & ~F.rlike(t, F.lit(ALLOWED_NUMBERS)))
    return (
        F.when(F.coalesce(~F.rlike(text, F.lit(r"(?U)\S")) | (F.length(text) > LONGEST_TEXT), F.lit(True)), "SCHEMA_VALIDATION_FAILED").when(forbidden, "FORBIDDEN_FIELD_NAME")
        .when(has(R.FOUND_EMAIL), "NER_HIT_EMAIL").when(has(R.FOUND_PHONE), "NER_HIT_PHONE").when(has(R.FOUND_SSN), "NER_HIT_SSN").when(has(R.FOUND_URL), "NER_HIT_URL")
        .when(raw, "RAW_NUMERIC").when(F.exists(tokens, lambda t: F.length(t) > LONGEST_TOKEN), "STRING_TOO_LONG")
    )


def drafted(groups: DataFrame, files: DataFrame) -> DataFrame:
    """groups that cross their thresholds with title, version, relpath, outcome, reason and body_sha256.

    groups: see ``groups``, with a column body where a writer has made the text; the stub's otherwise. files: domain,
    kind, slug and version of the library's files. All or nothing for each group: a text that the checker rejects, or
    a draft whose title, text, ids or version are not allowed, leaves a reason and the hash of the text and no file. A new text never takes an
    old one's path. The stub names the number of tenants, which its own checker does not let pass.
    """
    crossing = groups.where("crossing")
    text = skill_body(F.col("domain"), F.col("kind"), F.col("shapes"), F.col("tenants"), F.col("mean_confidence"))
    text = F.coalesce("body", text) if "body" in groups.columns else text
    named = crossing.withColumns({"body": text, "title": R.group_title(F.col("domain"), F.col("kind"))}).withColumn("slug", R.skill_slug(F.col("title")))
    placed = next_versions(files, named)
    fault = skill_text_fault(F.col("body"))
    length = F.length("body")
    invalid = ~F.rlike("title", F.lit(TITLE)) | (length == 0) | (length > LONGEST_TEXT) | (F.size("observation_ids") == 0) | (F.col("version") > MOST_VERSIONS)
    outcome = F.when(invalid, "draft_invalid").when(fault.isNotNull(), "checker_rejected").otherwise("written")
    told = placed.withColumns({"outcome": outcome, "reason": F.when(invalid, "DRAFT_INVALID").otherwise(fault), "body_sha256": F.sha2("body", 256)})
    return told.withColumn("relpath", F.when(F.col("outcome") == "written", F.col("relpath")))


def next_versions(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (domain, kind, slug) with the version and relpath that a new file takes."""
    top = files.groupBy("domain", "kind", "slug").agg(F.max("version").alias("_top"))
    v = wanted.join(top, ["domain", "kind", "slug"], "left").withColumn("version", F.coalesce(F.col("_top") + 1, F.lit(1))).drop("_top")
    return v.withColumn("relpath", F.concat("domain", F.lit("/"), "kind", F.lit("__"), "slug", F.lit("__v"), F.col("version").cast("string"), F.lit(".md")))


def library(files: DataFrame, drafts: DataFrame) -> DataFrame:
    """The library (domain, kind, slug, title, version, path, body, modified) after what was written joins it."""
    new = drafts.where("outcome = 'written'").select("domain", "kind", "slug", "title", "version", F.col("relpath").alias("path"), "body", F.unix_micros(F.current_timestamp()).alias("modified"))
    return files.unionByName(new)
