"""Queries over the test tables and the DuckDB SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import evaluators as E
from .functions import scores as S
from .functions.canonical import CHUNK_SIZE, canonical_json, identifier_parts
from .operators import aggregate as A
from .operators import registry as R
from .operators import state as U
from .operators.lookup import authoritative, chunk_scan, latest, page
from .operators.routing import http_allowed, persisted, route
from .plans.runs import chunk_table, dense_ordinals
from .query_base import NOW, ORACLES, QUERIES, WORDS, query
from .query_base import cases as _cases
from .query_base import table as _t
from .streaming.outbox import deduped

__all__ = ["ORACLES", "QUERIES"]


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# ---- cases ----------------------------------------------------------------------------------


@query("SELECT sha256(text) AS case_hash, min(doc_id) AS first_case, count(*) AS n FROM documents GROUP BY 1")
def q_blob_dedupe(spark, d):
    return _cases(spark, d).groupBy("case_hash").agg(F.min("case_id").alias("first_case"), F.count("*").alias("n"))


@query("""SELECT doc_id AS case_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS ordinal, sha256(text) AS case_hash, length(text) AS payload FROM documents
QUALIFY row_number() OVER (ORDER BY doc_id) - 1 BETWEEN 100 AND 199""")
def q_chunk_scan(spark, d):
    members = dense_ordinals(_cases(spark, d).select(F.lit("v").alias("dataset_version_id"), "case_id", "case_hash"), "case_id", name="case_ordinal")
    blobs = _cases(spark, d).groupBy("case_hash").agg(F.first(F.length("text")).cast("long").alias("payload"))
    return chunk_scan(members, blobs, "v", 100, 200).select("case_id", F.col("case_ordinal").cast("long").alias("ordinal"), "case_hash", "payload")


@query(f"""SELECT lang AS task_type, a AS ordinal_start, least(a + {CHUNK_SIZE}, n)::BIGINT AS ordinal_end FROM
(SELECT lang, n, unnest(range(0, n, {CHUNK_SIZE})) AS a FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang))""")
def q_chunks(spark, d):
    return chunk_table(_cases(spark, d).groupBy("task_type").agg(F.count("*").alias("n"))).drop("n")


@query("""SELECT doc_id AS case_id, CASE WHEN lang = 'en' AND source IN ('src1', 'src2') THEN 'en-first' WHEN lang = 'en' THEN 'en-rest' WHEN lang = 'de' AND source = 'src3' THEN 'de-three' END AS group_id FROM documents""")
def q_case_routing(spark, d):
    groups = spark.sql("SELECT * FROM VALUES (0, 'en-first', 'en', array('src1', 'src2'), array('en')), (1, 'en-rest', 'en', array(), array()), (2, 'de-three', 'de', array(), array('de', 'src3')) AS t (group_no, group_id, task_type, tags_any, tags_all)")
    return route(_cases(spark, d), groups).select("case_id", "group_id")


@query("""SELECT event_id, '{"a":{"c":[2,1],"d":1},"p":' || replace(props, ' ', '') || ',"v":' || regexp_replace(value::VARCHAR, '\\.0$', '') || '}' AS canonical FROM events""")
def q_canonical_json(spark, d):
    return _t(spark, d, "events").select("event_id", canonical_json(F.concat(F.lit('{"v":'), F.col("value").cast("string"), F.lit(',"p":'), F.col("props"), F.lit(',"a":{"d":1,"c":[2,1]}}'))).alias("canonical"))


@query("""SELECT p_partkey, split_part(p_brand, '#', 2) AS namespace, p_name AS name, p_partkey::VARCHAR AS version FROM part""")
def q_identifier(spark, d):
    part = _t(spark, d, "part")
    parts = identifier_parts(F.concat(F.substring_index("p_brand", "#", -1), F.lit(" / "), F.col("p_name"), F.lit(":"), F.col("p_partkey").cast("string")))
    return part.select("p_partkey", parts.alias("i")).select("p_partkey", "i.*")


# ---- scores ---------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind,
CASE kind WHEN 'binary' THEN (l_linestatus = 'F')::INT::DOUBLE WHEN 'range' THEN greatest(0, least(1, (l_quantity - 1) / 49)) WHEN 'normalized' THEN greatest(0, least(1, l_discount * 20))
WHEN 'severity_mapped' THEN CASE sev WHEN 'none' THEN 1.0 WHEN 'low' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.25 ELSE 0.0 END WHEN 'preference' THEN CASE out WHEN 'preferred' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END END AS normalized,
CASE kind WHEN 'binary' THEN (l_linestatus = 'F')::INT::DOUBLE WHEN 'range' THEN l_quantity WHEN 'normalized' THEN l_discount * 20 WHEN 'preference' THEN CASE out WHEN 'preferred' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END END AS raw,
CASE WHEN kind IN ('binary', 'normalized', 'preference') THEN 0.0 WHEN kind = 'range' THEN 1.0 END AS low, CASE WHEN kind IN ('binary', 'normalized', 'preference') THEN 1.0 WHEN kind = 'range' THEN 50.0 END AS high
FROM (SELECT *, ['binary', 'range', 'normalized', 'severity_mapped', 'preference', 'informational'][(l_partkey % 6 + 1)::INT] AS kind, ['none', 'low', 'medium', 'high', 'critical'][(l_suppkey % 5 + 1)::INT] AS sev,
['preferred', 'tie', 'not_preferred'][(l_orderkey % 3 + 1)::INT] AS out FROM lineitem)""")
def q_score_normalize(spark, d):
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (F.col(c) % len(v) + 1).cast("int"))
    kind = pick("l_partkey", "binary", "range", "normalized", "severity_mapped", "preference", "informational")
    score = F.struct(kind.alias("kind"), (F.col("l_linestatus") == "F").alias("passed"), F.when(kind == "normalized", F.col("l_discount") * 20).otherwise(F.col("l_quantity")).alias("value"), F.lit(1.0).alias("min"), F.lit(50.0).alias("max"), pick("l_suppkey", "none", "low", "medium", "high", "critical").alias("severity"), pick("l_orderkey", "preferred", "tie", "not_preferred").alias("outcome"))
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("s"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("s.kind").alias("kind"), S.normalize(F.col("s")).alias("normalized"), S.raw_parts(F.col("s")).alias("p")).select("*", "p.*").drop("p")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """A line is a finding of its order's execution; the customer's orders are a run."""
    score = F.struct(F.lit("range").alias("kind"), F.lit(None).cast("boolean").alias("passed"), F.col("l_quantity").alias("value"), F.lit(1.0).alias("min"), F.lit(50.0).alias("max"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("outcome"))
    status = F.when(F.col("l_quantity") < 5, "failed").when(F.col("l_discount") >= 0.1, "skipped").when(F.col("l_tax") >= 0.08, "error").otherwise("passed")
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("execution_id"), F.col("l_linenumber").alias("finding_no"), F.col("l_returnflag").alias("dimension"), F.concat(F.lit("lines/no"), F.col("l_linenumber").cast("string"), F.lit(":1")).alias("evaluator_id"), S.normalize(score).alias("normalized_score"), F.col("l_extendedprice").alias("weight"), (F.col("l_linestatus") == "F").alias("blocking"), status.alias("status"))


_FACTS = """f AS (SELECT l_orderkey AS execution_id, l_linenumber AS finding_no, l_returnflag AS dimension, 'lines/no' || l_linenumber || ':1' AS evaluator_id, greatest(0, least(1, (l_quantity - 1) / 49)) AS s, l_extendedprice AS w,
l_linestatus = 'F' AS blocking, CASE WHEN l_quantity < 5 THEN 'failed' WHEN l_discount >= 0.1 THEN 'skipped' WHEN l_tax >= 0.08 THEN 'error' ELSE 'passed' END AS status FROM lineitem),
dim AS (SELECT execution_id, dimension, min(s) FILTER (status <> 'skipped') AS min_score, sum(w * s) FILTER (status <> 'skipped') / nullif(sum(w) FILTER (status <> 'skipped'), 0) AS weighted_mean, count(*) AS n_results,
count(*) FILTER (status IN ('failed', 'error') AND blocking) AS n_blocking, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status <> 'skipped') AS n_judged FROM f GROUP BY 1, 2),
ex AS (SELECT execution_id, avg(weighted_mean) AS aggregate_score, sum(n_results)::BIGINT AS evaluator_result_count, sum(n_blocking)::BIGINT AS n_blocking, sum(n_error)::BIGINT AS n_error, sum(n_judged)::BIGINT AS n_judged FROM dim GROUP BY 1),
st AS (SELECT *, CASE WHEN n_blocking > 0 THEN 'failed' WHEN n_error > 0 THEN 'error' WHEN n_judged = 0 THEN 'skipped' WHEN aggregate_score < 0.4 THEN 'failed' ELSE 'passed' END AS overall_status FROM ex)"""


@query(f"WITH {_FACTS} SELECT execution_id, dimension, string_agg(evaluator_id, ',' ORDER BY finding_no, evaluator_id) AS evaluators, count(*) AS n FROM f GROUP BY 1, 2")
def q_group_by_dimension(spark, d):
    grouped = A.by_dimension(_facts(spark, d).select("execution_id", "dimension", "finding_no", "evaluator_id"), "execution_id")
    return grouped.select("execution_id", "dimension", F.array_join(F.transform("findings", lambda x: x.evaluator_id), ",").alias("evaluators"), F.size("findings").cast("long").alias("n"))


@query(f"WITH {_FACTS} SELECT execution_id, dimension, round(min_score, 6) AS min_score, round(weighted_mean, 6) AS weighted_mean, n_results FROM dim")
def q_dimension_scores(spark, d):
    return A.dimension_scores(_facts(spark, d), "execution_id").select("execution_id", "dimension", F.round("min_score", 6).alias("min_score"), F.round("weighted_mean", 6).alias("weighted_mean"), "n_results")


def _executions(spark: SparkSession, d: str) -> DataFrame:
    return A.execution_aggregates(A.dimension_scores(_facts(spark, d), "execution_id"), "execution_id", min_score=0.4)


@query(f"WITH {_FACTS} SELECT execution_id, round(aggregate_score, 6) AS aggregate_score, overall_status, evaluator_result_count, n_blocking FROM st")
def q_execution_aggregate(spark, d):
    return _executions(spark, d).select("execution_id", F.round("aggregate_score", 6).alias("aggregate_score"), "overall_status", "evaluator_result_count", "n_blocking")


@query(f"WITH {_FACTS} SELECT execution_id, string_agg(dimension || ':' || evaluator_id, ',' ORDER BY dimension, evaluator_id) AS blocking FROM f WHERE status IN ('failed', 'error') AND blocking GROUP BY 1")
def q_blocking_failures(spark, d):
    b = A.blocking_failures(_facts(spark, d), "execution_id").where(F.size("blocking_failures") > 0)
    return b.select("execution_id", F.array_join(F.transform("blocking_failures", lambda x: F.concat(x.dimension, F.lit(":"), x.evaluator_id)), ",").alias("blocking"))


_RUNS = f"WITH {_FACTS}, r AS (SELECT o_custkey AS run_id, count(*) AS expected, count(overall_status) AS terminal, count(*) FILTER (overall_status = 'passed') AS passed, count(*) FILTER (overall_status = 'failed') AS failed, count(*) FILTER (overall_status = 'error') AS errored, count(*) FILTER (overall_status = 'skipped') AS skipped FROM orders LEFT JOIN st ON o_orderkey = execution_id GROUP BY 1)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("execution_id"))
    return A.run_counters(orders.join(_executions(spark, d), "execution_id", "left"), "run_id")


@query(f"{_RUNS} SELECT *, CASE WHEN terminal < expected THEN 'unknown' WHEN passed + skipped = expected AND passed > 0 THEN 'pass' ELSE 'fail' END AS gate_status FROM r")
def q_run_gate(spark, d):
    return A.gate(_runs(spark, d))


@query(f"WITH {_FACTS} SELECT dimension, status, count(*) AS n FROM f GROUP BY ROLLUP (dimension, status)")
def q_failure_breakdown(spark, d):
    return A.breakdown(_facts(spark, d), "dimension", "status")


@query(f"WITH {_FACTS} SELECT dimension, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'skipped') AS skipped FROM f GROUP BY 1")
def q_status_pivot(spark, d):
    return A.status_pivot(_facts(spark, d), "dimension")


@query("""SELECT event_type, count(*) AS attempts, round(avg(value), 4) AS mean_latency, quantile_disc(value, 0.5) AS median_latency, quantile_disc(value, 0.95) AS p95_latency, max(value) AS max_latency,
coalesce(sum((props::JSON->>'k')::BIGINT), 0)::BIGINT AS prompt_tokens, 0::BIGINT AS completion_tokens FROM events GROUP BY 1""")
def q_latency_summary(spark, d):
    u = A.usage_summary(_t(spark, d, "events").withColumn("props", F.regexp_replace("props", '"k"', '"prompt_tokens"')), "event_type", latency="value", usage="props")
    return u.withColumn("mean_latency", F.round("mean_latency", 4))


@query("SELECT doc_id, quality, toxic, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'failed' ELSE 'passed' END AS overall_status FROM labels")
def q_label_findings(spark, d):
    part = lambda dim, s, block: F.struct(F.lit(dim).alias("dimension"), F.when(s == 1, "passed").otherwise("failed").alias("status"), s.cast("double").alias("normalized_score"), F.lit(block).alias("blocking"), F.lit(1.0).alias("weight"))
    facts = _t(spark, d, "labels").select("doc_id", "quality", "toxic", F.inline(F.array(part("quality", F.col("quality"), False), part("safety", 1 - F.col("toxic"), True))))
    out = A.execution_aggregates(A.dimension_scores(facts, "doc_id", "quality", "toxic"), "doc_id", "quality", "toxic", min_score=0.85)
    return out.select("doc_id", "quality", "toxic", "overall_status")


# ---- evaluators -----------------------------------------------------------------------------

_TOKENS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_SENTIMENT = f"""s AS (SELECT *, len(list_filter(w, lambda x: x IN ({_quoted(WORDS["positive"])}))) AS p, len(list_filter(w, lambda x: x IN ({_quoted(WORDS["negative"])}))) AS n FROM (SELECT doc_id, lang, {_TOKENS} AS w FROM documents))"""


def _sentiment(spark: SparkSession, d: str) -> DataFrame:
    """One scan of each text finds its tokens in the lexicons; all the rest comes from these few."""
    hits = _t(spark, d, "documents").select("doc_id", "lang", E.lexicon_hits(F.col("text"), **WORDS).alias("hits"))
    return hits.select("doc_id", "lang", E.sentiment(F.col("hits"), **WORDS).alias("s"))


@query(f"WITH {_SENTIMENT} SELECT doc_id, (p - n)::INT AS score, p::INT AS positive_matches, n::INT AS negative_matches, CASE WHEN p > n THEN 'positive' WHEN p < n THEN 'negative' ELSE 'neutral' END AS label, CASE WHEN p > n THEN 1.0 WHEN p < n THEN 0.0 ELSE 0.5 END::DOUBLE AS normalized, CASE WHEN p < n THEN 'failed' ELSE 'passed' END AS status, CASE WHEN p < n THEN 'medium' ELSE 'none' END AS severity FROM s")
def q_sentiment(spark, d):
    return _sentiment(spark, d).select("doc_id", "s.*")


@query(f"WITH {_SENTIMENT} SELECT lang, count(*) AS expected, count(*) FILTER (p >= n) AS passed, count(*) FILTER (p < n) AS failed, round(avg(CASE WHEN p > n THEN 1.0 WHEN p < n THEN 0.0 ELSE 0.5 END), 6) AS mean_score, CASE WHEN bool_and(p >= n) THEN 'pass' ELSE 'fail' END AS gate_status FROM s GROUP BY lang")
def q_gate_by_lang(spark, d):
    s = _sentiment(spark, d).select("lang", "s.normalized", "s.status")
    out = A.run_counters(s, "lang", status="status", also=(F.round(F.avg("normalized"), 6).alias("mean_score"),))
    return A.gate(out).select("lang", "expected", "passed", "failed", "mean_score", "gate_status")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = substr(o_orderpriority, 1, 1) THEN 1.0 ELSE 0.0 END::DOUBLE AS exact, round(1 - least(abs(o_totalprice - 100000) / 50000, 1), 6) AS closeness, abs(o_totalprice - 100000) <= 25000 AS within FROM orders""")
def q_numeric_evaluators(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", E.exact_label(F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)).alias("exact"), F.round(E.absolute_error(F.col("o_totalprice"), F.lit(100000.0), 50000), 6).alias("closeness"), E.within_tolerance(F.col("o_totalprice"), F.lit(100000.0), 25000).alias("within"))


@query("""WITH t AS (SELECT conv_id, list_distinct(list(role)) AS roles FROM conversations GROUP BY 1) SELECT conv_id, len(list_intersect(roles, ['user', 'system']))::DOUBLE / 2 AS called FROM t""")
def q_tool_call_match(spark, d):
    roles = _t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return roles.select("conv_id", E.tool_call_match(F.col("roles"), F.array(F.lit("user"), F.lit("system"))).alias("called"))


@query("""WITH p AS (SELECT conv_id, sum(length(text)) FILTER (role = 'user') AS u, sum(length(text)) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN a > u THEN 1.0 WHEN a = u THEN 0.5 ELSE 0.0 END::DOUBLE AS normalized FROM p WHERE u IS NOT NULL AND a IS NOT NULL""")
def q_preference(spark, d):
    n = F.length("text")
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", n)).alias("u"), F.sum(F.when(F.col("role") == "assistant", n)).alias("a")).where("u is not null and a is not null")
    outcome = F.when(F.col("a") > F.col("u"), "preferred").when(F.col("a") == F.col("u"), "tie").otherwise("not_preferred")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    score = F.struct(F.lit("preference").alias("kind"), none("boolean", "passed"), none("double", "value"), none("double", "min"), none("double", "max"), none("string", "severity"), outcome.alias("outcome"))
    return c.select("conv_id", S.normalize(score).alias("normalized"))


_LONG = "SELECT doc_id, 0 AS finding_no, CASE WHEN doc_id % 7 = 3 THEN 'other' ELSE 'format' END AS dimension, CASE WHEN doc_id % 7 = 3 THEN 'error' WHEN length(text) < 400 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN doc_id % 7 <> 3 THEN least(1.0, 200 / greatest(length(text), 1)) END::DOUBLE AS value, CASE WHEN doc_id % 7 = 3 THEN 'no verdict on ' || doc_id END AS reason FROM documents"


def _judged(df):
    return df.select("doc_id", "finding_no", "finding.dimension", "finding.status", F.col("finding.score.value").alias("value"), "finding.reason")


@query(_LONG)
def q_custom_evaluator(spark, d):
    def short(row):
        if row["doc_id"] % 7 == 3:
            raise ValueError(f"no verdict on {row['doc_id']}")
        n = len(row["text"])
        return [{"dimension": "format", "status": "passed" if n < 400 else "failed", "score": {"kind": "normalized", "value": min(1.0, 200 / max(n, 1))}}]

    return _judged(E.custom_evaluator(_t(spark, d, "documents"), short, "doc_id", "text"))


@query(_LONG)
def q_batch_evaluator(spark, d):
    def short(frame):
        if (bad := frame["doc_id"][frame["doc_id"] % 7 == 3]).size:
            raise ValueError(f"no verdict on {bad.iloc[0]}")
        n = frame["text"].str.len()
        return [[{"dimension": "format", "status": s, "score": {"kind": "normalized", "value": v}}] for s, v in zip(n.lt(400).map({True: "passed", False: "failed"}), (200 / n.clip(lower=1)).clip(upper=1.0), strict=True)]

    return _judged(E.batch_evaluator(_t(spark, d, "documents"), short, "doc_id", "text"))


@query("SELECT event_id, CASE WHEN event_type = 'error' OR value > 80 THEN props END AS raw_evaluator_output FROM events")
def q_persistence(spark, d):
    e = _t(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise("passed").alias("status"), (F.col("value") > 80).alias("blocking"), F.col("props").alias("raw_evaluator_output"), F.col("props").alias("evidence"))
    return persisted(e, "failures_only", evidence=False).select("event_id", "raw_evaluator_output")


@query("SELECT page_id, regexp_matches(url, '^https://') AND NOT regexp_matches(url, '/es/') AS allowed FROM pages")
def q_http_policy(spark, d):
    rules = spark.sql("SELECT * FROM VALUES ('e', '^https://', 'allow'), ('e', '/es/', 'deny') AS t (evaluator_id, uri, action)")
    pages = _t(spark, d, "pages").select("page_id", F.lit("e").alias("evaluator_id"), F.col("url").alias("uri"))
    return http_allowed(pages, rules).select("page_id", "allowed")


# ---- attempts, leases, outbox ---------------------------------------------------------------


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    status = F.when(F.col("event_type") == "error", "failed_agent_call").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "signup", "stale").otherwise("completed")
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("execution_id"), no.alias("attempt_no"), status.alias("status"), (F.col("ts").cast("timestamp") + F.expr("interval 60 seconds")).alias("leased_until"))


_ATTEMPTS = "a AS (SELECT event_id AS id, user_id AS execution_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS attempt_no, CASE event_type WHEN 'error' THEN 'failed_agent_call' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'stale' ELSE 'completed' END AS status, ts + INTERVAL 60 SECOND AS leased_until FROM events)"


@query(f"WITH {_ATTEMPTS} SELECT id, execution_id, attempt_no, status FROM a WHERE status <> 'stale' QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY attempt_no DESC) = 1")
def q_latest_attempt(spark, d):
    return authoritative(_attempts(spark, d)).select("id", "execution_id", "attempt_no", "status")


@query(f"WITH {_ATTEMPTS} SELECT id, CASE WHEN status = 'completed' THEN 'completed' WHEN status IN ('failed_agent_call', 'stale') AND attempt_no < 3 THEN 'retry_scheduled' WHEN status IN ('failed_agent_call', 'stale') THEN 'failed' ELSE 'running' END AS execution_status FROM a")
def q_retry_state(spark, d):
    return U.after_attempt(_attempts(spark, d), 3).select("id", "execution_status")


@query(f"WITH {_ATTEMPTS} SELECT id, CASE WHEN status = 'running' AND (leased_until < TIMESTAMP '{NOW}' OR attempt_no < max(attempt_no) OVER (PARTITION BY execution_id)) THEN 'stale' ELSE status END AS status FROM a")
def q_stale(spark, d):
    return U.mark_stale(_attempts(spark, d), NOW).select("id", "status")


def _outbox(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    none = lambda k: F.lit(None).cast(k)
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", F.format_string("user:%s:%s:%s", "user_id", "event_type", F.date_format(ts, "yyyy-MM-dd")).alias("dedupe_key"), F.col("props").alias("payload"), F.when(F.col("event_type") == "view", "published").otherwise("pending").alias("status"), ts.alias("available_at"), none("timestamp").alias("published_at"), none("string").alias("error_message"), ts.alias("updated_at"))


@query(f"SELECT event_id AS id, TIMESTAMP '{NOW}' + INTERVAL 30 SECOND AS available_at FROM events WHERE event_type <> 'view' AND ts <= TIMESTAMP '{NOW}' ORDER BY ts, event_id LIMIT 32")
def q_claim_outbox(spark, d):
    return U.claim_outbox(_outbox(spark, d), NOW)[0].select("id", F.col("available_at").cast("timestamp_ntz").alias("available_at"))


@query("SELECT DISTINCT event_type, 'user:' || user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d') AS dedupe_key FROM events")
def q_outbox_dedupe(spark, d):
    return deduped(_outbox(spark, d)).select("event_type", "dedupe_key")


@query(f"SELECT event_id AS id, CASE WHEN event_type IN ('purchase', 'view') THEN 'published' ELSE 'pending' END AS status, CASE WHEN event_type = 'click' THEN TIMESTAMP '{NOW}' + INTERVAL 10 SECOND ELSE ts END AS available_at, CASE WHEN event_type = 'click' THEN 'unreachable' END AS error_message FROM events")
def q_publish_cycle(spark, d):
    box = _outbox(spark, d)
    done = U.mark_published(box, box.where("event_type = 'purchase'"), NOW)
    out = U.reschedule(done, box.where("event_type = 'click'").select("id", F.lit("unreachable").alias("error")), NOW)
    return out.select("id", "status", F.col("available_at").cast("timestamp_ntz").alias("available_at"), "error_message")


@query(f"SELECT o_orderkey AS id, 'running' AS status, TIMESTAMP '{NOW}' + INTERVAL 60 SECOND AS coordinator_leased_until FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def q_claim_run(spark, d):
    o = _t(spark, d, "orders")
    none = F.lit(None).cast("timestamp")
    runs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("completed").alias("status"), F.lit(None).cast("string").alias("coordinator_id"), none.alias("coordinator_leased_until"), none.alias("coordinator_heartbeat_at"), none.alias("started_at"), F.col("o_orderdate").alias("created_at"), none.alias("updated_at"))
    return U.claim_run(runs, "c1", NOW)[0].select("id", "status", F.col("coordinator_leased_until").cast("timestamp_ntz").alias("coordinator_leased_until"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def q_event_windows(spark, d):
    e = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return w.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "total")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def q_page(spark, d):
    return page(_t(spark, d, "events"), 20, 40, F.desc("ts"), F.asc("event_id")).select("event_id")


# ---- registry -------------------------------------------------------------------------------


def _registry(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("namespace"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("version"), F.col("p_type").alias("description"), F.array("p_type", "p_brand").alias("tags"), F.when(F.col("p_size") > 45, "removed").when(F.col("p_size") > 40, "disabled").when(F.col("p_size") > 35, "yanked").otherwise("active").alias("state"), none.alias("state_reason"), F.col("p_partkey").alias("created_at"))


@query("SELECT p_partkey::VARCHAR AS id, p_brand AS namespace, p_name AS name FROM part WHERE p_name ILIKE '%a%' OR p_brand ILIKE '%a%' OR p_type ILIKE '%a%' ORDER BY p_name, p_partkey::VARCHAR DESC LIMIT 15")
def q_registry_search(spark, d):
    return R.search(_registry(spark, d), " a ", 15).select("id", "namespace", "name")


@query("SELECT p_brand AS namespace, p_name AS name, max(p_partkey)::VARCHAR AS version FROM part GROUP BY 1, 2")
def q_registry_latest(spark, d):
    return R.latest_versions(_registry(spark, d)).select("namespace", "name", "version")


@query("SELECT p_partkey::VARCHAR AS id, p_size <= 40 AS runs, p_size <= 35 AS selectable FROM part WHERE p_size <= 45")
def q_registry_states(spark, d):
    reg = _registry(spark, d)
    run, sel = R.runnable(reg).select("id", F.lit(True).alias("runs")), R.selectable(reg, pinned=False).select("id", F.lit(True).alias("selectable"))
    out = reg.where("state <> 'removed'").select("id").join(run, "id", "left").join(sel, "id", "left")
    return out.select("id", F.coalesce("runs", F.lit(False)).alias("runs"), F.coalesce("selectable", F.lit(False)).alias("selectable"))


@query("""SELECT 'quantity' AS "check", count(*) FILTER (l_quantity < 5) AS n FROM lineitem UNION ALL SELECT 'unique(l_orderkey,l_linenumber)', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""")
def q_constraints(spark, d):
    from .schemas import violations

    return violations(_t(spark, d, "lineitem"), {"quantity": "l_quantity >= 5"}, (("l_orderkey", "l_linenumber"),))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q_orphans(spark, d):
    from .schemas import orphans

    return orphans(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", _t(spark, d, "lineitem"), "l_orderkey")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_latest_event(spark, d):
    return latest(_t(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("SELECT doc_id, sha256(text) AS case_hash FROM documents WHERE lang <> 'en' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en') QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def q_insert_ignore(spark, d):
    c = _cases(spark, d)
    new = c.where("task_type <> 'en'").groupBy("case_hash").agg(F.min("case_id").alias("doc_id"))
    return U.insert_ignore(c.where("task_type = 'en'"), new, "case_hash").select("doc_id", "case_hash")


# the rest of the queries register themselves in the same list
from . import queries_contracts, queries_runs  # noqa: E402, F401
