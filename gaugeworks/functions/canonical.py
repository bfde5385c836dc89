"""Canonical JSON, content hashes, and identifiers derived from content."""

from __future__ import annotations

import hashlib
import json
import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: cases in a chunk.
CHUNK_SIZE = 100


def canonical_json(text: Column) -> Column:
    """Keys sorted at every level, arrays as they are. Invalid JSON raises."""
    return F.to_json(F.parse_json(text))


def content_hash(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def canonical_tags(tags: Column) -> Column:
    return F.array_sort(F.coalesce(tags, F.array().cast("array<string>")))


def case_document(task_type: Column, input_json: Column, expected: Column, context: Column, tags: Column, metadata: Column) -> Column:
    """The hashed JSON of a case: its id and group are not part of it; what is missing is null."""
    part = lambda c, other: F.coalesce(canonical_json(c), F.lit(other))
    quoted = F.regexp_replace(F.to_json(F.array(task_type)), r"^\[|\]$", "")
    return F.concat(
        F.lit('{"context":'), part(context, "null"), F.lit(',"expected_output":'), part(expected, "null"), F.lit(',"input":'), part(input_json, "null"),
        F.lit(',"metadata":'), part(metadata, "{}"), F.lit(',"tags":'), F.to_json(canonical_tags(tags)), F.lit(',"task_type":'), quoted, F.lit("}"),
    )


def case_hash(*parts: Column) -> Column:
    return F.sha2(case_document(*parts), 256)


#: Members that are hashed together; a dataset's version is the hash of these hashes, so no row holds a whole dataset.
MEMBERS = 10_000


def dataset_version_ids(members: DataFrame) -> DataFrame:
    """members (dataset_id, dataset_version, ordinal, case_id, case_hash) -> dataset_version_id and n of each dataset version.

    The hash of the id, the version and the ordered membership: of each MEMBERS ordinals first, then of those hashes.
    """
    line = F.concat_ws("\x1f", F.col("ordinal").cast("string"), "case_id", "case_hash")
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x.line), "\n")
    parts = members.groupBy("dataset_id", "dataset_version", F.expr(f"ordinal div {MEMBERS}").alias("part")).agg(F.sha2(part, 256).alias("h"), F.count("*").alias("n"))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x.h), "\n")
    out = parts.groupBy("dataset_id", "dataset_version").agg(every.alias("hashes"), F.sum("n").alias("n"))
    return out.select("dataset_id", "dataset_version", F.sha2(F.concat_ws("\n", "dataset_id", "dataset_version", "hashes"), 256).alias("dataset_version_id"), "n")


def stable_id(*parts: Column) -> Column:
    """An identifier that a replay gives again."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def profile_version_id(profile: Column, version: Column) -> Column:
    return F.concat_ws("/", profile, version)


# ---- the same on the driver, for profile documents ------------------------------------------


def _number(x: float) -> str:
    """As a variant writes it: no trailing zeros, and an exponent where the shortest text has one."""
    text = repr(x)
    if "e" in text:
        mantissa, _, exponent = text.partition("e")
        return f"{mantissa if '.' in mantissa else mantissa + '.0'}E{int(exponent)}"
    return (text.rstrip("0").rstrip(".") if "." in text else text).replace("-0", "0") if x == 0 else text.rstrip("0").rstrip(".")


def canonical(value: Any) -> str:
    """The text that canonical_json gives for the same document, made on the driver."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(str(k))}:{canonical(value[k])}" for k in sorted(value, key=lambda k: str(k).encode("utf-16-be"))) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, float) or (isinstance(value, int) and abs(value) >= 10**38):
        if not math.isfinite(value):
            raise ValueError("JSON has no such number")
        return _number(float(value))
    if isinstance(value, int):
        return str(value)
    return re.sub(r"\\u00[01][0-9a-f]", lambda m: "\\u" + m[0][2:].upper(), json.dumps(str(value), ensure_ascii=False))


def hash_value(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def aggregation_policy_hash(profile: dict[str, Any]) -> str:
    groups = profile.get("case_groups") or []
    return hash_value([{"id": g["id"], "aggregation": g.get("aggregation") or {"dimensions": {}}} for g in groups])


# ---- payloads and identifiers ---------------------------------------------------------------


def json_payload(text: Column, field: str) -> Column:
    """Blank text is an empty object; invalid JSON raises and names the field."""
    clean = F.when(trimmed(F.coalesce(text, F.lit(""))) == "", "{}").otherwise(text)
    return F.coalesce(F.try_parse_json(clean), F.when(F.lit(True), F.raise_error(F.lit(f"invalid {field} payload"))).cast("variant"))


def optional_payload(text: Column) -> Column:
    """Canonical JSON, or null where there is none (a JSON null counts as none)."""
    return F.nullif(canonical_json(text), F.lit("null"))


def at_path(document: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as $.expected.label of a JSON text; null where it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(document), path, kind)


def trimmed(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def identifier_parts(identifier: Column) -> Column:
    """namespace/name:version -> struct, or null: the last colon, then the last slash; no part is blank."""
    head, version = F.regexp_extract(identifier, r"(?s)^(.*):([^:]*)$", 1), F.regexp_extract(identifier, r"(?s)^(.*):([^:]*)$", 2)
    parts = [trimmed(F.regexp_extract(head, r"(?s)^(.*)/([^/]*)$", i)) for i in (1, 2)] + [trimmed(version)]
    filled = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    return F.when(filled, F.struct(*[p.alias(n) for p, n in zip(parts, ("namespace", "name", "version"), strict=True)]))


def binding_identifier(ref: Column) -> Column:
    """Profiles may write namespace/name@version; the colon form is the one that is stored."""
    return F.regexp_replace(ref, r"@([^@:/]*)$", r":$1")
