"""Profiles and datasets: inline or from a file, YAML or JSON, validated, as tables with fixed schemas."""

from __future__ import annotations

from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical, hash_value
from ..schemas import ENUMS

CASES = "case_id string, ordinal int, task_type string, case_group string, input string, expected string, context string, tags array<string>, metadata string"
GROUPS = "group_no int, group_id string, task_type string, tags_any array<string>, tags_all array<string>"
BINDINGS = "group_id string, binding_no int, ref string, dimension string, blocking boolean, weight double, config string"
RULES = "group_id string, dimension string, method string, blocking boolean, weight double"


def text_source(inline: str | None, file: str | None, field: str, spark: SparkSession | None = None) -> str:
    """Exactly one of the two; files are read by Spark where a session is given, so that any store works."""
    if (inline is None) == (file is None):
        raise ValueError(f"give either inline {field} or a {field} file")
    if inline is not None:
        return inline
    if spark is not None:
        return spark.read.text(file, wholetext=True).first()[0]
    with open(file, encoding="utf-8") as f:
        return f.read()


def parse(text: str, field: str) -> Any:
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"invalid {field} payload: {e}") from e


def _need(d: Any, key: str, where: str) -> Any:
    if not isinstance(d, dict) or d.get(key) is None:
        raise ValueError(f"{where} needs {key}")
    return d[key]


def load_dataset(spark: SparkSession, text: str) -> tuple[dict[str, Any], DataFrame]:
    """The raw document (for hashing) and its cases, numbered from 0 in document order."""
    raw = parse(text, "dataset")
    cases = (raw or {}).get("cases") or []
    if not cases:
        raise ValueError("a dataset has at least one case")
    js = lambda v: None if v is None else canonical(v)
    rows = [
        (str(_need(c, "id", "a case")), i, _need(c, "task_type", "a case"), c.get("case_group"), canonical(_need(c, "input", "a case")), js(c.get("expected")), js(c.get("context")), [str(t) for t in c.get("tags") or []], canonical(c.get("metadata") or {}))
        for i, c in enumerate(cases)
    ]
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("case ids are unique in a dataset")
    return raw, spark.createDataFrame(rows, CASES)


def load_profile(spark: SparkSession, text: str) -> tuple[dict[str, Any], DataFrame, DataFrame, DataFrame]:
    """The raw document, and its groups, evaluator bindings and dimension rules."""
    raw = parse(text, "profile")
    _need(raw, "profile_id", "a profile")
    _need(raw, "profile_version", "a profile")
    groups, bindings, rules = [], [], []
    for i, g in enumerate(raw.get("case_groups") or []):
        to, gid = _need(g, "applies_to", "a group"), _need(g, "id", "a group")
        groups.append((i, gid, _need(to, "task_type", "applies_to"), to.get("tags_any") or [], to.get("tags_all") or []))
        for j, b in enumerate(g.get("evaluators") or []):
            bindings.append((gid, j, _need(b, "ref", "a binding"), _need(b, "dimension", "a binding"), bool(b.get("blocking")), float(b.get("weight", 1.0)), canonical(b.get("config") or {})))
        for name, r in ((g.get("aggregation") or {}).get("dimensions") or {}).items():
            if _need(r, "method", "a dimension") not in ENUMS["aggregation_method"]:
                raise ValueError(f"unknown aggregation method {r['method']}")
            rules.append((gid, name, r["method"], bool(r.get("blocking", True)), float(r.get("weight", 1.0))))
    make = spark.createDataFrame
    return raw, make(groups, GROUPS), make(bindings, BINDINGS), make(rules, RULES)


def profile_ids(raw: dict[str, Any]) -> dict[str, str]:
    return {"profile_hash": hash_value(raw), "profile_version_id": f"{raw['profile_id']}/{raw['profile_version']}"}


def profile_settings(raw: dict[str, Any]) -> dict[str, Any]:
    """A profile's defaults and persistence settings, checked; what it leaves out has the value of a plain run."""
    d, p = raw.get("defaults") or {}, raw.get("persistence") or {}
    out = {
        "max_attempts": int(d.get("max_attempts", 1)),
        "request_timeout_secs": int(d.get("request_timeout_secs", 60)),
        "fail_on_any_blocking_failure": bool(d.get("fail_on_any_blocking_failure", True)),
        "min_execution_score": float(d.get("min_execution_score", 0.0)),
        "mode": p.get("mode", "full"),
        "persist_raw_outputs": p.get("persist_raw_outputs", "all"),
        "persist_evaluator_evidence": bool(p.get("persist_evaluator_evidence", True)),
    }
    if out["max_attempts"] < 0 or out["request_timeout_secs"] < 0:
        raise ValueError("max_attempts and request_timeout_secs are not negative")
    for key, enum in (("mode", "persistence_mode"), ("persist_raw_outputs", "raw_outputs")):
        if out[key] not in ENUMS[enum]:
            raise ValueError(f"unknown {key}: {out[key]}")
    return out


def validate_inputs(profile: str, dataset: str) -> dict[str, Any]:
    """What a run of these documents would be made of, without planning it; documents that cannot be read raise."""
    p, d = parse(profile, "profile"), parse(dataset, "dataset")
    _need(p, "profile_id", "a profile")
    kind = lambda x: "structured" if isinstance(x, dict | list) else "scalar"
    return {"data": {"profile": p, "dataset": d}, "meta": {"profile_case_groups": len(p.get("case_groups") or []), "dataset_cases": len((d or {}).get("cases") or []), "sources": {"profile": kind(p), "dataset": kind(d)}}}


def result_json(df: DataFrame, **meta: Any) -> DataFrame:
    """Each row as a {data, meta} JSON line: the sink's text, for any number of rows."""
    return df.select(F.concat(F.lit('{"data":'), F.to_json(F.struct("*")), F.lit(f',"meta":{canonical(meta)}}}')).alias("line"))


def result_lines(df: DataFrame, **meta: Any) -> list[str]:
    """A bounded report as {data, meta} JSON lines (the driver's output, not a bulk sink: more than 1000 rows are an error)."""
    lines = result_json(df, **meta).take(1001)
    if len(lines) > 1000:
        raise ValueError("a report has at most 1000 rows; write more with export")
    return [r.line for r in lines]


def export(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)
