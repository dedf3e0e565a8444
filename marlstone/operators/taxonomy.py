"""Scoring documents against a taxonomy of types, and judging a classifier's answer by the scores.

A taxonomy is a short list that the driver holds, so all scores of a document
are one array in one projection: no join, no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import rules
from marlstone.functions.columns import clamp01
from marlstone.operators import envelopes

DEFAULT = "general_document"


@dataclass(frozen=True)
class DocType:
    name: str
    keywords: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()  # of file names: * and ?

    @property
    def tokens(self) -> list[str]:
        return [t for t in re.split(r"[_\W]+", self.name) if t]


# fixed values: a taxonomy for prose in four languages; keywords are whole words
LANGUAGE_TYPES = (
    DocType("english", (" the ", " and ", " of ", " that ", " with ", " this "), ("*0.txt", "*1.txt")),
    DocType("french_text", (" le ", " les ", " des ", " dans ", " pour ", " qui "), ("?2.txt",)),
    DocType("german_text", (" der ", " die ", " und ", " nicht ", " sich ", " mit "), ("*3.txt", "4*.txt")),
    DocType("spanish", (" el ", " los ", " que ", " por ", " una ", " del ")),
)
# fixed values: thresholds of the judgement
LOW_CONFIDENCE, DISAGREEMENT, NOVEL, TIE, MARGIN = 0.55, 0.25, 0.05, 0.10, 0.15


def glob_regex(pattern: str) -> str:
    return "^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern.lower()) + "$"


def with_overrides(types: tuple[DocType, ...], changes: tuple[DocType, ...]) -> tuple[DocType, ...]:
    """Types of the same name are replaced where they stand, others come last."""
    new = {t.name: t for t in changes}
    kept = tuple(new.pop(t.name, t) for t in types)
    return kept + tuple(new.values())


def _found(hay: Column, words: list[str]) -> Column:
    return sum((F.contains(hay, F.lit(w)).cast("int") for w in words), F.lit(0))


def type_score(hay: Column, name: Column, t: DocType) -> Column:
    """0.4 for a file name that fits, up to 0.3 for the words of the type's name, and 0.05 a keyword up to 0.3."""
    fits = F.lit(False)
    for p in t.patterns:
        fits = fits | F.rlike(name, F.lit(glob_regex(p)))
    tokens, keywords = t.tokens, [k for k in t.keywords if k]
    words = F.least(F.lit(0.3), F.lit(0.3) * (_found(hay, tokens) / len(tokens))) if tokens else F.lit(0.0)
    keys = F.least(F.lit(0.3), F.lit(0.05) * _found(hay, keywords)) if keywords else F.lit(0.0)
    return F.round(F.least(F.lit(1.0), F.when(fits, 0.4).otherwise(0.0) + words + keys), 4)


def scores(text: Column, uri: Column, types: tuple[DocType, ...] = LANGUAGE_TYPES) -> Column:
    """array<struct<type, ord, score>>, in the order of the taxonomy."""
    hay, name = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.element_at(F.split(F.coalesce(uri, F.lit("")), "/"), -1))
    return F.array(*[F.struct(F.lit(t.name).alias("type"), F.lit(i).alias("ord"), type_score(hay, name, t).alias("score")) for i, t in enumerate(types)])


def best(all_scores: Column, default: str = DEFAULT) -> Column:
    """struct<type, score>: the greatest score, ties to the first type; the default where all are 0."""
    top = F.array_max(F.transform(all_scores, lambda s: F.struct(s["score"].alias("score"), (-s["ord"]).alias("o"), s["type"].alias("type"))))
    return F.struct(F.when(top["score"] > 0, top["type"]).otherwise(F.lit(default)).alias("type"), top["score"].alias("score"))


def ranked(all_scores: Column) -> Column:
    """array<struct<less, type>>: by falling score (``less`` is its negative), ties by name."""
    return F.array_sort(F.transform(all_scores, lambda s: F.struct((-s["score"]).alias("less"), s["type"].alias("type"))))


def second(all_scores: Column) -> Column:
    """The second score, duplicates counted; 0 where there is none."""
    s = F.sort_array(F.transform(all_scores, lambda x: x["score"]), asc=False)
    return F.when(F.size(s) > 1, F.get(s, F.lit(1))).otherwise(F.lit(0.0))


def score_of(all_scores: Column, name: Column) -> Column:
    return F.coalesce(F.get(F.filter(all_scores, lambda s: s["type"] == name), F.lit(0))["score"], F.lit(0.0))


def merged_alternatives(all_scores: Column, predicted: Column, given: Column, most: int = 3) -> Column:
    """array<struct<less, type>>: the greater of given and own positive score of each type but the predicted one.

    ``given``: array<struct<type, confidence>> of the classifier.
    """
    own = F.transform(F.filter(all_scores, lambda s: s["score"] > 0), lambda s: F.struct(s["type"].alias("type"), s["score"].alias("confidence")))
    both = F.filter(F.concat(own, given), lambda s: s["type"] != predicted)
    names = F.array_distinct(F.transform(both, lambda s: s["type"]))
    top = F.transform(names, lambda n: F.struct((-F.array_max(F.transform(F.filter(both, lambda s: s["type"] == n), lambda s: s["confidence"]))).alias("less"), n.alias("type")))
    return F.slice(F.array_sort(top), 1, most)


# fixed values: the parts of a prompt, and how much of a text it shows
PROMPT = "TAXONOMY (pick exactly one):\n%s\n\nSOURCE URI: %s\n\nEXTRACTED FIELDS:\n%s\n\nDOCUMENT TEXT%s:\n%s\n\nRespond with the JSON object as instructed.\n"
SHOWN = 6000


def prompt(text: Column, uri: Column, fields: Column, types: tuple[tuple[str, str], ...], catch_all: tuple[str, ...] = (), most: int = SHOWN) -> Column:
    """What a model is asked: the types (name, description) in order, catch-alls marked, the extracted fields as sorted JSON, and the text's beginning."""
    line = lambda name, told: f"- {name}{' (catch-all)' if name in catch_all else ''}: {' '.join(told.strip().split(chr(10)))}"
    listed = "\n".join(line(*t) for t in types)
    whole = F.coalesce(text, F.lit(""))
    cut = F.when(F.length(whole) > most, " (truncated)").otherwise("")
    source = F.when(F.coalesce(uri, F.lit("")) != "", uri).otherwise("(unknown)")
    return F.format_string(PROMPT, F.lit(listed), source, F.coalesce(envelopes.canonical(fields), F.lit("{}")), cut, F.left(whole, F.lit(most)))


NO_GIVEN = "array<struct<type:string,confidence:double>>"


def adjudicate(all_scores: Column, predicted: Column, confidence: Column, given: Column | None = None, error: Column | None = None) -> dict[str, Column]:
    """Columns confidence (adjusted), reason and the signals of a classifier's answer.

    ``given``: its alternatives. ``error``: its own verdict; NOVEL_PATTERN, for an answer that could not be read, ends
    the judgement: confidence and verdict stay, and of the signals only three are told.
    """
    given = F.array().cast(NO_GIVEN) if given is None else given
    failed = F.lit(False) if error is None else F.coalesce(error == "NOVEL_PATTERN", F.lit(False))
    top, other, own = best(all_scores), second(all_scores), score_of(all_scores, predicted)
    gap = F.greatest(F.lit(0.0), top["score"] - own)
    novel = (top["score"] >= NOVEL) & (own < NOVEL) & (gap >= DISAGREEMENT)
    apart = (predicted != top["type"]) & (gap >= DISAGREEMENT)
    close = (top["score"] > 0) & (other > 0) & (top["score"] - other < TIE) & (confidence < LOW_CONFIDENCE + MARGIN)
    adjusted = F.when(novel | apart, F.greatest(F.lit(0.0), confidence - gap)).otherwise(confidence)
    reason = F.when(novel, "NOVEL_PATTERN").when(apart | close, "TIE_BETWEEN_TYPES").when(adjusted < LOW_CONFIDENCE, "LOW_CONFIDENCE")
    likely = (top["score"] > 0).cast("int") + (other > 0).cast("int")
    told = lambda c, otherwise=None: F.when(failed, otherwise).otherwise(c)
    return {
        "confidence": F.when(failed, confidence).otherwise(clamp01(adjusted)),
        "reason": F.when(failed, "NOVEL_PATTERN").otherwise(reason),
        "header_match_score": told(clamp01(own), clamp01(top["score"])),
        "keyword_density": told(clamp01(top["score"])),
        "structural_complexity": told(1.0 - 1.0 / (1.0 + likely)),
        "llm_confidence": told(clamp01(confidence)),
        "heuristic_agreement": told(clamp01(1.0 - gap), F.lit(0.0)),
        "alt_count": told(clamp01(F.size(given) / 3.0)),
        "llm_error": F.when(failed, 1.0),
    }


def classified(docs: DataFrame, types: tuple[DocType, ...] = LANGUAGE_TYPES, most: int = 3) -> DataFrame:
    """docs (text, uri and answer, a model's reply) with predicted, alternatives and what ``adjudicate`` tells, from text to verdict."""
    told = rules.answer(F.col("answer"), tuple(t.name for t in types), most)
    read = docs.select("*", scores(F.col("text"), F.col("uri"), types).alias("_scores"), told.alias("_told"))
    found = adjudicate(F.col("_scores"), F.col("_told.type"), F.col("_told.confidence"), F.col("_told.alternatives"), F.col("_told.error"))
    failed = F.coalesce(F.col("_told.error") == "NOVEL_PATTERN", F.lit(False))
    merged = merged_alternatives(F.col("_scores"), F.col("_told.type"), F.col("_told.alternatives"), most)
    alternatives = F.when(failed, F.array().cast(NO_GIVEN)).otherwise(F.transform(merged, lambda x: F.struct(x["type"].alias("type"), (-x["less"]).alias("confidence"))))
    return read.select(*docs.columns, F.col("_told.type").alias("predicted"), alternatives.alias("alternatives"), *[c.alias(n) for n, c in found.items()])
