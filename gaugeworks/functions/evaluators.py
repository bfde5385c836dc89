"""Evaluators as column expressions, and table-function forms for custom ones."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canonical import at_path, trimmed

# The sentiment word lists.
POSITIVE = ("good", "great", "excellent", "amazing", "love", "helpful", "fast", "happy", "success", "pleasant")
NEGATIVE = ("bad", "terrible", "awful", "hate", "slow", "angry", "sad", "bug", "failure", "poor")

FINDING = "struct<dimension: string, status: string, score: struct<kind: string, passed: boolean, value: double, min: double, max: double, severity: string, outcome: string>, blocking: boolean, severity: string, failure_category: string, reason: string, evidence: string, tags: array<string>>"


def extract_text(payload: Column) -> Column:
    """The trimmed text; of a JSON object its non-empty string `text`; otherwise null."""
    text = trimmed(payload)
    doc = F.try_parse_json(text)
    kind = F.schema_of_variant(F.try_variant_get(doc, "$.text", "variant"))
    inner = trimmed(F.when(kind == "STRING", F.try_variant_get(doc, "$.text", "string")))
    return F.when(text.startswith("{"), F.nullif(inner, F.lit(""))).otherwise(F.nullif(text, F.lit("")))


def evaluated_text(actual: Column, user_message: Column) -> Column:
    return F.coalesce(extract_text(actual), extract_text(user_message))


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased in ASCII only."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def lexicon_hits(text: Column, positive: Iterable[str] = POSITIVE, negative: Iterable[str] = NEGATIVE) -> Column:
    """The tokens of a text that are in one of the lexicons, lower-cased, in one scan; `sentiment` of them is that of all tokens."""
    words = "|".join(re.escape(w) for w in sorted({*positive, *negative}))
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"), F.lit(0))
    return F.transform(found, lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def sentiment(words: Column, positive: Iterable[str] = POSITIVE, negative: Iterable[str] = NEGATIVE) -> Column:
    """struct(score, positive_matches, negative_matches, label, normalized, status, severity)."""
    hits = lambda lexicon: F.size(F.filter(words, lambda w: w.isin(*lexicon)))
    p, n = hits(tuple(positive)), hits(tuple(negative))
    pick = lambda a, b, c: F.when(p > n, F.lit(a)).when(p < n, F.lit(c)).otherwise(F.lit(b))
    return F.struct(
        (p - n).alias("score"),
        p.alias("positive_matches"),
        n.alias("negative_matches"),
        pick("positive", "neutral", "negative").alias("label"),
        pick(1.0, 0.5, 0.0).alias("normalized"),
        pick("passed", "passed", "failed").alias("status"),
        pick("none", "none", "medium").alias("severity"),
    )


def _score(kind: str, **parts: Column) -> Column:
    kinds = {"passed": "boolean", "value": "double", "min": "double", "max": "double", "severity": "string", "outcome": "string"}
    return F.struct(F.lit(kind).alias("kind"), *[parts.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def finding(dimension: str, status: Column, score: Column, blocking: bool = False, severity: Column | None = None, category: Column | None = None, reason: Column | None = None, evidence: Column | None = None, tags: Column | None = None) -> Column:
    """A finding in the form that every evaluator returns."""
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(dimension).alias("dimension"),
        status.alias("status"),
        score.alias("score"),
        F.lit(blocking).alias("blocking"),
        (F.lit("none") if severity is None else severity).alias("severity"),
        (none if category is None else category).alias("failure_category"),
        (none if reason is None else reason).alias("reason"),
        (F.lit("{}") if evidence is None else evidence).alias("evidence"),
        (F.array().cast("array<string>") if tags is None else tags).alias("tags"),
    ).cast(FINDING)


def judged(dimension: str, value: Column, least: float = 1.0, **more: Any) -> Column:
    """A finding of a score in [0, 1] that passes from `least` on; nothing to judge (null) is an error."""
    status = F.when(value.isNull(), "error").when(value >= least, "passed").otherwise("failed")
    severity = F.when(status == "passed", "none").otherwise("medium")
    return finding(dimension, status, _score("normalized", value=value), severity=severity, **more)


def sentiment_finding(text: Column, hits: Column, positive: Iterable[str] = POSITIVE, negative: Iterable[str] = NEGATIVE) -> Column:
    """The shipped evaluator's finding for an extracted text and its `lexicon_hits`; without a text, an error."""

    def one(s: Column) -> Column:
        evidence = F.to_json(F.struct(s.label.alias("label"), (s.positive_matches + s.negative_matches).alias("matched_terms"), s.negative_matches.alias("negative_matches"), s.positive_matches.alias("positive_matches"), s.score.alias("score"), text.alias("text")))
        # The tags and the reason's wording.
        tags = F.array(F.lit("sentiment"), F.lit("basic"), F.lit("english-only"), s.label)
        reason = F.concat(F.lit("basic English-only lexicon sentiment evaluator labeled input as "), s.label)
        return finding("quality", s.status, _score("normalized", value=s.normalized), severity=s.severity, reason=reason, evidence=evidence, tags=tags)

    failed = finding("quality", F.lit("error"), _score("informational"), category=F.lit("evaluator_error"), reason=F.lit("no text to evaluate"))
    return F.when(text.isNull(), failed).otherwise(F.transform(F.array(sentiment(hits, positive, negative)), one)[0])


def exact_label(actual: Column, expected: Column) -> Column:
    return F.when(F.coalesce(trimmed(actual) == trimmed(expected), F.lit(False)), 1.0).otherwise(0.0)


def absolute_error(actual: Column, expected: Column, max_error: float) -> Column:
    return 1 - F.least(F.abs(actual - expected) / F.lit(float(max_error)), F.lit(1.0))


def within_tolerance(actual: Column, expected: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(actual - expected) <= tolerance, F.lit(False))


def within_percent(actual: Column, expected: Column, percent: float) -> Column:
    """Within a share of the expected value."""
    return F.coalesce(F.abs(actual - expected) <= F.abs(expected) * percent / 100, F.lit(False))


def tool_call_match(actual: Column, expected: Column) -> Column:
    """The share of expected tool names that were called, 1 if none is expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(actual, expected)) / F.size(F.array_distinct(expected)))


#: A call's arguments as a flat JSON object: values compare as their JSON texts.
CALLS = "array<struct<name: string, arguments: map<string, string>>>"


def partial_arguments_match(actual: Column, expected: Column) -> Column:
    """The share of expected calls (CALLS) that some actual call of that name has with all expected arguments, whatever else it has."""

    def met(e: Column) -> Column:
        want = F.map_entries(F.coalesce(e.arguments, F.create_map().cast("map<string,string>")))
        return F.exists(actual, lambda a: (a["name"] == e["name"]) & F.forall(want, lambda x: F.coalesce(F.try_element_at(a.arguments, x.key).eqNullSafe(x.value), F.lit(False))))

    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.filter(expected, met)) / F.size(expected))


def tool_call_schema(calls: Column) -> Column:
    """Whether a JSON text is an array of calls, each with a non-blank string `name` and, if any, an object `arguments`."""
    parsed = F.from_json(calls, "array<string>")
    kind = lambda c, path: F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), path, "variant"))
    right = lambda c: (kind(c, "$.name") == "STRING") & (F.trim(at_path(c, "$.name")) != "") & F.coalesce(kind(c, "$.arguments").startswith("OBJECT"), F.lit(True))
    array = F.schema_of_variant(F.try_parse_json(calls)).startswith("ARRAY")
    return F.coalesce(array & F.forall(parsed, lambda c: F.coalesce(right(c), F.lit(False))), F.lit(False))


_KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "null": "VOID", "object": "OBJECT", "array": "ARRAY"}


def json_schema(document: Column, schema: dict[str, Any], path: str = "$") -> Column:
    """Whether a JSON text fits a schema: type, required, properties, enum, minimum, maximum, minLength, maxLength, items' type.

    The schema is known when the plan is made, so it becomes one expression; other keywords raise.
    """
    other = set(schema) - {"type", "required", "properties", "enum", "minimum", "maximum", "minLength", "maxLength", "title", "description", "$schema"}
    if other:
        raise ValueError(f"unknown keywords of a schema: {', '.join(sorted(other))}")
    value = F.try_variant_get(F.try_parse_json(document), path, "variant")
    kind, fits = F.schema_of_variant(value), value.isNotNull()
    if (want := schema.get("type")) is not None:
        some = [want] if isinstance(want, str) else want
        of = [kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE") if w == "number" else kind.startswith(_KINDS[w]) for w in some]
        fits = fits & F.greatest(*[c.cast("int") for c in of], F.lit(0)).cast("boolean")
    if "enum" in schema:
        fits = fits & F.to_json(value).isin(*[_text(v) for v in schema["enum"]])
    for key, at_least in (("minimum", True), ("maximum", False)):
        if key in schema:
            x = F.try_variant_get(F.try_parse_json(document), path, "double")
            fits = fits & F.coalesce(x >= schema[key] if at_least else x <= schema[key], F.lit(True))
    for key, at_least in (("minLength", True), ("maxLength", False)):
        if key in schema:
            x = F.when(kind == "STRING", F.length(F.try_variant_get(F.try_parse_json(document), path, "string")))
            fits = fits & F.coalesce(x >= schema[key] if at_least else x <= schema[key], F.lit(True))
    for name in schema.get("required", ()):
        fits = fits & F.try_variant_get(F.try_parse_json(document), f"{path}['{name}']", "variant").isNotNull()
    for name, inner in schema.get("properties", {}).items():
        at = f"{path}['{name}']"
        fits = fits & (F.try_variant_get(F.try_parse_json(document), at, "variant").isNull() | json_schema(document, inner, at))
    return F.coalesce(fits, F.lit(False))


def _text(value: Any) -> str:
    from .canonical import canonical

    return canonical(value)


#: Phrases of a refusal and of an offer to help otherwise, in English; lists of one's own go in as arguments.
REFUSALS = ("i can't", "i cannot", "i can not", "i won't", "i will not", "i'm not able to", "i am not able to", "i'm unable to", "i am unable to")
OFFERS = ("instead", "alternatively", "what i can do", "i can help", "you could", "you can", "consider")


def _has(text: Column, phrases: Iterable[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(re.escape(p) for p in phrases)), F.lit(False))


def refusal_policy(text: Column, should_refuse: Column, phrases: Iterable[str] = REFUSALS) -> Column:
    """1 if the answer refuses exactly when it should."""
    return F.when(_has(text, phrases) == F.coalesce(should_refuse, F.lit(False)), 1.0).otherwise(0.0)


def helpful_alternative(text: Column, phrases: Iterable[str] = OFFERS) -> Column:
    """1 if the answer offers something else."""
    return F.when(_has(text, phrases), 1.0).otherwise(0.0)


def concept_adherence(text: Column, required: Column, prohibited: Column) -> Column:
    """The share of required concepts that a description names; 0 if it names a prohibited one; 1 if nothing is required."""
    names = lambda c: F.contains(F.lower(text), F.lower(c))
    share = F.when(F.size(required) == 0, 1.0).otherwise(F.size(F.filter(required, names)) / F.size(required))
    return F.when(F.exists(prohibited, names), 0.0).otherwise(share)


_BLANK = {"dimension": "other", "status": "error", "score": {"kind": "informational"}, "blocking": False, "severity": "none", "failure_category": None, "reason": None, "evidence": "{}", "tags": []}


def _whole(found: dict[str, Any]) -> dict[str, Any]:
    out = {**_BLANK, "status": "passed", **found}
    return out | {"score": {**dict.fromkeys(("passed", "value", "min", "max", "severity", "outcome")), **out["score"]}}


def _failed(e: Exception) -> dict[str, Any]:
    """The evaluator's own failure is a result, with the whole message."""
    return _whole({"status": "error", "failure_category": "evaluator_error", "reason": str(e)})


def custom_evaluator(df: DataFrame, evaluate: Callable[[dict[str, Any]], list[dict[str, Any]]], key: str, *inputs: str) -> DataFrame:
    """key, finding_no and finding for 0..n findings of each row; an exception is one finding with status `error`."""

    def batch(frame: pd.DataFrame) -> list[list[dict[str, Any]]]:
        return [list(evaluate(r)) for r in frame.to_dict("records")]

    return batch_evaluator(df, batch, key, *inputs)


def batch_evaluator(df: DataFrame, evaluate: Callable[[pd.DataFrame], list[list[dict[str, Any]]]], key: str, *inputs: str) -> DataFrame:
    """The same for an evaluator of whole Arrow batches: a frame in, a list of findings for each of its rows out.

    A batch that raises is halved until the rows that raise stand alone, so that the others keep their findings.
    """

    def judge(frame: pd.DataFrame) -> list[list[dict[str, Any]]]:
        try:
            return [[_whole(f) for f in found] for found in evaluate(frame)]
        except Exception as e:
            if len(frame) == 1:
                return [[_failed(e)]]
            half = len(frame) // 2
            return judge(frame.iloc[:half]) + judge(frame.iloc[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, f) for k, found in zip(frame[key], judge(frame) if len(frame) else [], strict=True) for i, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "finding_no", "finding"])

    kind = dict(df.dtypes)[key]
    return df.select(key, *inputs).mapInPandas(run, f"`{key}` {kind}, finding_no int, finding {FINDING}")
