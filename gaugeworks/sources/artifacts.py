"""Evaluator packages: manifests, package metadata, artifacts. An artifact here is an evaluator's source, not compiled code."""

from __future__ import annotations

import platform
import tomllib
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical

#: Evaluators are column expressions or Python functions, so of a package's interface only its name and version are kept.
RUNTIME = "spark"


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def manifest(text: str) -> dict[str, Any]:
    """The package, its interface (if any) and its profiles; what is missing or of the wrong kind raises."""
    doc = tomllib.loads(text)
    package = doc.get("package")
    if not isinstance(package, dict) or not package.get("manifest"):
        raise ValueError("a manifest needs package.manifest")
    if (wit := doc.get("wit")) is not None:
        if lacking := [k for k in ("path", "world", "package", "version", "interface") if not wit.get(k)]:
            raise ValueError(f"the interface needs {', '.join(lacking)}")
        wit = {"strict": False, **wit}
    return {"package": package, "wit": wit, "profiles": dict(doc.get("profile") or {})}


def profile_of(doc: dict[str, Any], name: str) -> dict[str, Any]:
    if name not in doc["profiles"]:
        raise ValueError(f"manifest profile {name} not supported")
    return doc["profiles"][name]


def checked_interface(doc: dict[str, Any], name: str, version: str) -> tuple[str, str]:
    """The interface's name and version; with `strict` they are those of the package that was built."""
    wit = doc["wit"]
    if wit is None:
        return name, version
    if wit["strict"] and (wit["interface"], wit["version"]) != (name, version):
        raise ValueError(f"interface {name} {version} is not {wit['interface']} {wit['version']}")
    return wit["interface"], wit["version"]


def metadata(package: dict[str, Any], own: dict[str, Any]) -> dict[str, Any]:
    """Description, tags and metadata: the manifest's, or else the package's own."""
    said = package.get("description")
    return {
        "description": said if said is not None else own.get("description"),
        "tags": list(package.get("tags") or own.get("tags") or []),
        "metadata": canonical(package["metadata"] if package.get("metadata") is not None else own.get("metadata") or {}),
    }


def precedence(said: Column, own: Column, kind: str) -> Column:
    """The same for tables of packages: an absent text or metadata, or an empty list of tags, gives way."""
    return F.when(F.size(said) > 0, said).otherwise(own) if kind == "tags" else F.coalesce(said, own)


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, content, content_hash and size of every artifact under a path."""
    return hashed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("content").alias("wasm_bytes")))


def hashed(df: DataFrame, content: str = "wasm_bytes") -> DataFrame:
    return df.withColumns({"content_hash": F.sha2(content, 256), "wasm_size_bytes": F.octet_length(content).cast("long")})


def fingerprint(spark: SparkSession) -> str:
    """What runs the evaluators."""
    return f"{RUNTIME}-{spark.version}-{platform.machine()}"


def draft(spark: SparkSession, manifest_path: str, artifact_path: str, namespace: str, name: str, version: str, profile: str = "release", own: dict[str, Any] | None = None) -> DataFrame:
    """One row for operators.registry.publish from a package on any store that Spark reads."""
    doc = manifest(read_text(spark, manifest_path))
    profile_of(doc, profile)
    interface, interface_version = checked_interface(doc, name, version)
    meta = metadata(doc["package"], own or {})
    row = artifacts(spark, artifact_path).limit(1)
    fixed = {"namespace": namespace, "name": name, "version": version, "interface_name": interface, "interface_version": interface_version, "wit_world": (doc["wit"] or {}).get("world"), "runtime": RUNTIME, "runtime_version": spark.version, "runtime_fingerprint": fingerprint(spark), "description": meta["description"]}
    return row.select("wasm_bytes", *[F.lit(v).cast("string").alias(k) for k, v in fixed.items()], F.lit(meta["tags"]).cast("array<string>").alias("tags"), F.parse_json(F.lit(meta["metadata"])).alias("metadata"))
