"""URL filtering: explicit host and path rules, then association rules mined by FP-growth.

Pages that an explicit rule decides are the labelled transactions: their URL tokens (host labels, path
parts, query keys) and a token for the label. Spark's FP-growth mines token combinations; those whose
consequent is a label and that reach the given support, confidence and lift are kept. They are matched
to the remaining pages through an inverted index token -> rule, counting matched tokens for each
distinct set of tokens (so that a URL repeated by a third of all rows costs one lookup).

Defined results. A null url, or one without "://": host and path are empty, no rule, verdict "allow"
unless a mined rule fires (none can: there are no tokens). No labelled page: no mined rules, "allow".
Repeated rows and repeated page ids each give their own row. Ties between fired rules: higher
confidence, then higher support, then "block". Columns beyond page_id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, join_hot, table, written

RULES: tuple[tuple[str, str], ...] = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def url_host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = rest.substr(F.length(raw) + 1, F.length(rest))
    return ascii_lower(raw), F.regexp_extract(tail, r"^[^?#]*", 0)


def explicit_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null if none does."""
    rule = verdict = None
    for what, r in sorted(rules, key=lambda x: (-len(x[1]), x[1], x[0])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens; digits become one '#', so that numbered pages share tokens."""

    def marked(parts: Column, mark: str) -> Column:
        tidy = F.transform(parts, lambda x: F.regexp_replace(x, r"[0-9]+", "#"))
        return F.transform(F.filter(tidy, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&")
    keys = F.transform(query, lambda x: F.regexp_extract(x, r"^[^=]*", 0))
    return F.array_sort(F.array_distinct(F.concat(marked(F.split(host, r"\."), "h:"), marked(F.split(path, "/"), "p:"), marked(keys, "q:"))))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float) -> DataFrame:
    """labelled (items, verdict) -> rule_id, antecedent, verdict, confidence, support."""
    items = labelled.select(F.concat("items", F.array(F.concat(F.lit("y:"), "verdict"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).associationRules
    label = F.element_at("consequent", 1)
    return found.where(label.startswith("y:") & (F.col("lift") > min_lift)).select(
        F.xxhash64(F.array_sort("antecedent"), label).alias("rule_id"), "antecedent", label.substr(3, 10).alias("verdict"), "confidence", "support"
    )


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    min_support: float = 0.01,
    min_confidence: float = 0.9,
    min_lift: float = 1.05,
) -> DataFrame:
    host, path = url_host_path(F.col("url"))
    base = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"))
    base = written(base)
    mined = written(mine_rules(base.where("ruled is not null").select("items", F.col("ruled").alias("verdict")), min_support, min_confidence, min_lift))
    index = mined.select("rule_id", F.size("antecedent").alias("needs"), "verdict", "confidence", "support", F.explode("antecedent").alias("token"))
    sets = base.where("rule is null").groupBy("items").agg(F.lit(1).alias("one"))
    hits = (
        sets.select("items", F.explode("items").alias("token"))
        .join(broadcast_if_small(index), "token")
        .groupBy("items", "rule_id")
        .agg(F.count("*").alias("met"), *(F.first(c).alias(c) for c in ("needs", "verdict", "confidence", "support")))
        .where("met = needs")
        .groupBy("items")
        .agg(F.max(F.struct("confidence", "support", "verdict")).alias("best"), F.count("*").alias("n_mined"))
    )
    decided = join_hot(base.where("rule is null"), hits, "items", "left").unionByName(base.where("rule is not null"), allowMissingColumns=True)
    return decided.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", "best.verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("n_mined", F.lit(0)).cast("long").alias("n_mined"),
    )


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
