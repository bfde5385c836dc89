"""Queries of runs: lookups, inserts, claims, the queue, aggregates, and a whole run from its documents to its gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import queries as Q
from .functions.scores import clamp
from .operators import aggregate as A
from .operators import lookup as L
from .operators import state as U
from .operators.routing import bind, persisted, route
from .plans import evaluate as V
from .plans import runs as P
from .queries_contracts import PROFILE
from .query_base import NOW, cases, query, table
from .schemas import CHECKS, FOREIGN, KEYS, violations
from .sources.documents import load_profile
from .streaming import outbox as O

LATER = "2024-01-15 00:00:30"


def _ntz(*names: str):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


# ---- lookups --------------------------------------------------------------------------------


@query("SELECT 'event' AS what, event_id::VARCHAR AS id, event_type AS value FROM events WHERE event_id = 17 UNION ALL SELECT 'order', o_orderkey::VARCHAR, o_orderstatus FROM orders WHERE o_orderkey = 17 UNION ALL SELECT 'customer', c_custkey::VARCHAR, c_name FROM customer WHERE c_custkey = 17")
def q_point_lookup(spark, d):
    one = lambda t, key, value, what: L.by_key(table(spark, d, t), **{key: 17}).select(F.lit(what).alias("what"), F.col(key).cast("string").alias("id"), F.col(value).alias("value"))
    return one("events", "event_id", "event_type", "event").union(one("orders", "o_orderkey", "o_orderstatus", "order")).union(one("customer", "c_custkey", "c_name", "customer"))


@query(f"WITH {Q._FACTS} SELECT execution_id, evaluator_result_count, overall_status FROM st WHERE execution_id = 33")
def q_aggregate_lookup(spark, d):
    return L.by_key(Q._executions(spark, d), execution_id=33).select("execution_id", "evaluator_result_count", "overall_status")


@query("SELECT c_custkey AS id, c_name AS run_key FROM customer WHERE c_name = (SELECT c_name FROM customer WHERE c_custkey = 5)")
def q_run_by_key(spark, d):
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("run_key"))
    return L.by_key(runs, run_key=L.by_key(runs, id=5).first().run_key)


@query("SELECT event_id, ts FROM events WHERE user_id = 5 ORDER BY ts, event_id")
def q_children(spark, d):
    return L.children(table(spark, d, "events"), "user_id", 5, "ts", "event_id").select("event_id", "ts")


@query("SELECT event_id AS id, ts AS available_at FROM events WHERE event_type <> 'view' ORDER BY ts, event_id LIMIT 25")
def q_list_by_status(spark, d):
    return L.by_status(Q._outbox(spark, d), "pending", 25).select("id", *_ntz("available_at"))


@query("""SELECT c_name AS run_key, count(*) AS facts, count(DISTINCT o_orderkey) AS executions, max(l_linenumber) AS last FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def q_run_results(spark, d):
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("run_key"))
    executions = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("case_id"))
    attempts = executions.select((F.col("id") * 10).alias("id"), F.col("id").alias("execution_id"), F.lit(1).alias("attempt_no"))
    facts = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10).alias("attempt_id"), F.col("l_linenumber").alias("finding_no"))
    out = L.run_results(runs, executions, attempts, facts)
    return out.groupBy("run_key").agg(F.count("*").alias("facts"), F.count_distinct("case_id").alias("executions"), F.max("finding_no").alias("last"))


@query(f"WITH {Q._ATTEMPTS}, top AS (SELECT id FROM a WHERE status <> 'stale' QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY attempt_no DESC) = 1) SELECT id FROM top WHERE id % 2 = 0")
def q_current_results(spark, d):
    a = Q._attempts(spark, d)
    results = a.where("id % 2 = 0").select(F.col("id").alias("attempt_id"))
    return L.current_results(results, a).select(F.col("attempt_id").alias("id"))


# ---- inserts, upserts, patches, deletes -----------------------------------------------------


@query("SELECT event_id AS id, event_type FROM events WHERE event_id % 2 = 1")
def q_insert(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    return U.inserted(e.where("id % 2 = 0"), e.where("id % 2 = 1"), (("id",),), {"id": "id >= 0", "kind": "event_type IN ('signup', 'purchase', 'error', 'view', 'click')"}).select("id", "event_type")


@query("SELECT doc_id AS case_id, sha256(text) AS case_hash FROM documents WHERE lang <> 'en'")
def q_guarded_upsert(spark, d):
    c = cases(spark, d)
    return U.guarded_upsert(c.where("task_type = 'en'").select("case_id", "case_hash"), c.select("case_id", "case_hash"), ["case_id"], ["case_hash"])


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'patched' ELSE o_orderstatus END AS status, o_totalprice AS score, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '{NOW}' ELSE o_orderdate END AS updated_at FROM orders")
def q_patch(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    changes = t.where("id % 3 = 0").select("id", F.lit("patched").alias("status"), F.lit(None).cast("double").alias("score"))
    return U.patch(t, changes, "id", NOW).select("id", "status", "score", *_ntz("updated_at"))


def _family(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "runs": table(spark, d, "customer").select(F.col("c_custkey").alias("id")),
        "executions": table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run_id")),
        "evaluator_results": table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("execution_id")),
    }


@query("""WITH o AS (SELECT * FROM orders WHERE o_custkey % 4 <> 1) SELECT 'runs' AS "table", count(*) AS n FROM customer WHERE c_custkey % 4 <> 1 UNION ALL SELECT 'executions', count(*) FROM o UNION ALL SELECT 'evaluator_results', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 1)""")
def q_delete_cascade(spark, d):
    t = _family(spark, d)
    left = U.delete_cascade(t, "runs", t["runs"].where("id % 4 = 1"), FOREIGN)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), "n") for k, df in left.items()]
    return parts[0].union(parts[1]).union(parts[2])


# ---- chunks and events ----------------------------------------------------------------------


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """A chunk for each hundred documents of a language; every third is leased, every fifth of these past its time."""
    c = P.chunk_table(cases(spark, d).groupBy("task_type").agg(F.count("*").alias("n")))
    at = F.lit(NOW).cast("timestamp")
    k = F.col("ordinal_start") / 100 % 3
    lease = F.when(k == 1, at + F.expr("interval 1 hour")).when(k == 2, at - F.expr("interval 1 hour"))
    return c.select(F.concat_ws("-", "task_type", F.col("ordinal_start").cast("string")).alias("id"), F.lit("r").alias("run_id"), F.col("task_type").alias("dataset_version_id"), F.col("ordinal_start").cast("int"), F.col("ordinal_end").cast("int"), F.when(k == 0, "pending").otherwise("leased").alias("status"), lease.alias("leased_until"), at.alias("updated_at"))


_CHUNKS = f"""c AS (SELECT lang || '-' || a AS id, lang, a, least(a + 100, n) AS b, CASE WHEN a // 100 % 3 = 0 THEN 'pending' ELSE 'leased' END AS status, CASE a // 100 % 3 WHEN 1 THEN TIMESTAMP '{NOW}' + INTERVAL 1 HOUR WHEN 2 THEN TIMESTAMP '{NOW}' - INTERVAL 1 HOUR END AS leased_until
FROM (SELECT lang, n, unnest(range(0, n, 100)) AS a FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)))"""


@query(f"WITH {_CHUNKS} SELECT id FROM c WHERE status = 'pending' OR leased_until < TIMESTAMP '{NOW}'")
def q_claimable_chunks(spark, d):
    return _chunks(spark, d).where(U.chunk_claimable(NOW)).select("id")


@query(f"WITH {_CHUNKS} SELECT id, CASE WHEN id = 'en-0' THEN 'leased' ELSE status END AS status, CASE WHEN id = 'en-0' THEN TIMESTAMP '{NOW}' + INTERVAL 60 SECOND ELSE leased_until END AS leased_until FROM c")
def q_claim_chunk(spark, d):
    return U.claim_chunk(_chunks(spark, d), "en-0", NOW)[1].select("id", "status", *_ntz("leased_until"))


@query(f"WITH {_CHUNKS} SELECT id, CASE id WHEN 'en-0' THEN 'completed' WHEN 'de-0' THEN 'pending' ELSE status END AS status, CASE WHEN id NOT IN ('en-0', 'de-0') THEN leased_until END AS leased_until FROM c")
def q_finish_chunks(spark, d):
    held = "2024-01-15 00:01:00"
    c = U.claim_chunk(U.claim_chunk(_chunks(spark, d), "en-0", NOW)[1], "de-0", NOW)[1]
    c = U.release_chunk(U.complete_chunk(c, "en-0", held, LATER), "de-0", held, LATER)
    c = U.complete_chunk(c, "fr-0", held, LATER)  # not the holder: nothing happens
    return c.select("id", "status", *_ntz("leased_until"))


@query(f"""WITH {_CHUNKS} SELECT 'run.chunk.ready' AS event_type, id AS aggregate_id, 'run:r:chunk:' || id || ':ready' AS dedupe_key, '{{"run_id":"r","chunk_id":"' || id || '","dataset_version_id":"' || lang || '","ordinal_start":' || a || ',"ordinal_end":' || b || '}}' AS payload, TIMESTAMP '{NOW}' AS available_at FROM c WHERE status = 'pending' AND lang <> 'en'""")
def q_enqueue_chunks(spark, d):
    c = _chunks(spark, d)
    new = U.ready_events(c, NOW)
    return U.enqueue(U.ready_events(c.where("dataset_version_id = 'en'"), NOW), new).select("event_type", "aggregate_id", "dedupe_key", "payload", *_ntz("available_at"))


@query("WITH m AS (SELECT doc_id AS case_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS o, lang FROM documents) SELECT case_id, o::BIGINT AS case_ordinal, lang || '-' || (o // 100 * 100) AS chunk_id FROM m")
def q_case_chunks(spark, d):
    m = cases(spark, d).select("case_id", F.col("task_type").alias("v"), (F.row_number().over(Window.partitionBy("task_type").orderBy("case_id")) - 1).cast("long").alias("case_ordinal"))
    ranges = _chunks(spark, d).select(F.col("id").alias("chunk_id"), F.col("dataset_version_id").alias("v"), P.chunk_of("ordinal_start").alias("no"))
    return m.withColumn("no", P.chunk_of("case_ordinal")).join(ranges, ["v", "no"]).select("case_id", "case_ordinal", "chunk_id")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Two messages for each chunk, and some that cannot be read."""
    text = F.to_json(F.struct(F.lit("r").alias("run_id"), F.col("id").alias("chunk_id")))
    c = _chunks(spark, d).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    bad = table(spark, d, "region").select((F.col("r_regionkey") + 0).cast("string").alias("tag"), F.lit("{not json").alias("payload"))
    return c.select(F.concat_ws("/", "id", F.col("k").cast("string")).alias("tag"), text.alias("payload")).union(bad)


_CYCLE = f"""{_CHUNKS}, w AS (SELECT *, status = 'pending' OR leased_until < TIMESTAMP '{NOW}' AS free FROM c)"""


@query(f"""WITH {_CYCLE} SELECT id || '/0' AS tag, CASE WHEN NOT free THEN 'unclaimable' WHEN a >= 200 THEN 'failed' ELSE 'completed' END AS outcome, CASE WHEN free AND a >= 200 THEN 'requeue' ELSE 'ack' END AS answer FROM w
UNION ALL SELECT id || '/1', 'unclaimable', 'ack' FROM w UNION ALL SELECT r_regionkey::VARCHAR, 'poison', 'ack' FROM region""")
def q_worker_cycle(spark, d):
    c = _chunks(spark, d)
    failed = c.where("ordinal_start >= 200").select(F.col("id").alias("chunk_id"))
    return O.worker_cycle(_messages(spark, d), c, NOW, failed)[0].select("tag", "outcome", "answer")


@query(f"WITH {_CYCLE} SELECT id, CASE WHEN NOT free THEN status WHEN a >= 200 THEN 'pending' ELSE 'completed' END AS status, CASE WHEN NOT free THEN leased_until END AS leased_until FROM w")
def q_worker_chunks(spark, d):
    c = _chunks(spark, d)
    failed = c.where("ordinal_start >= 200").select(F.col("id").alias("chunk_id"))
    return O.worker_cycle(_messages(spark, d), c, NOW, failed)[1].select("id", "status", *_ntz("leased_until"))


@query(f"WITH {_CYCLE} SELECT id || '/0' AS tag FROM w WHERE free AND a >= 200")
def q_queue_left(spark, d):
    c, m = _chunks(spark, d), _messages(spark, d)
    failed = c.where("ordinal_start >= 200").select(F.col("id").alias("chunk_id"))
    return O.left_in_queue(m, O.worker_cycle(m, c, NOW, failed)[0]).select("tag")


@query(f"""WITH {_CYCLE}, m AS (SELECT doc_id AS case_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS o, sha256(text) AS h, length(text) AS n FROM documents) SELECT id AS chunk_id, case_id, o::INT AS case_ordinal, n AS payload FROM w JOIN m ON m.lang = w.lang AND o >= a AND o < b WHERE free""")
def q_loaded_cases(spark, d):
    c = _chunks(spark, d)
    done = O.worker_cycle(_messages(spark, d), c, NOW)[0]
    all_ = cases(spark, d)
    members = all_.select(F.col("task_type").alias("dataset_version_id"), "case_id", "case_hash", (F.row_number().over(Window.partitionBy("task_type").orderBy("case_id")) - 1).alias("case_ordinal"))
    blobs = all_.groupBy("case_hash").agg(F.first(F.length("text")).cast("long").alias("payload"))
    return O.loaded_cases(done, c, members, blobs).select("chunk_id", "case_id", F.col("case_ordinal").cast("int").alias("case_ordinal"), "payload")


@query("SELECT 32 AS claimed, count(*) FILTER (k = 0) AS published, count(*) FILTER (k = 1) AS failed FROM (SELECT event_id % 3 AS k FROM events WHERE event_type <> 'view' AND ts <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts, event_id LIMIT 32)")
def q_publish_stats(spark, d):
    claimed = U.claim_outbox(Q._outbox(spark, d), NOW)[0]
    sent = U.mark_published(claimed, claimed.where("id % 3 = 0"), NOW)
    return O.publish_stats(U.reschedule(sent, claimed.where("id % 3 = 1").select("id", F.lit("unreachable").alias("error")), NOW)).select(F.col("claimed").cast("int").alias("claimed"), "published", "failed")


@query("SELECT event_id, 'run.' || event_type || '.ready' AS routing_key FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT event_id, 'run.started' FROM events WHERE event_type = 'signup'")
def q_topic_routing(spark, d):
    kind = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("run."), "event_type", F.lit(".ready"))).when(F.col("event_type") == "signup", "run.started").otherwise(F.concat(F.lit("other."), "event_type"))
    e = table(spark, d, "events").select("event_id", kind.alias("routing_key"))
    return O.routed_to(e, "run.*.ready", "routing_key").union(O.routed_to(e, "run.started", "routing_key"))


@query("SELECT event_type, count(*) AS \"count\" FROM events GROUP BY 1")
def q_progress(spark, d):
    return O.progress(table(spark, d, "events"), "event_type")


@query("SELECT event_id AS tag, (props::JSON->>'k')::VARCHAR AS chunk_id FROM events WHERE event_id % 4 <> 0")
def q_decoded_messages(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("tag"), F.when(F.col("event_id") % 8 == 0, "{not json").when(F.col("event_id") % 4 == 0, '{"other":1}').otherwise(F.regexp_replace("props", '"k"', '"chunk_id"')).alias("payload"))
    return O.decoded(e)[0].select("tag", "chunk_id")


# ---- states ---------------------------------------------------------------------------------


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs."""
    none = lambda k, n: F.lit(None).cast(k).alias(n)
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    zero = [F.lit(0).alias(c) for c in ("terminal_execution_count", "passed_execution_count", "failed_execution_count", "errored_execution_count")]
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), status.alias("status"), F.lit("unknown").alias("gate_status"), F.lit("v").alias("dataset_version_id"), *zero, none("timestamp", "finalized_at"), none("timestamp", "completed_at"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))


@query(f"SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'O') THEN 'cancelled' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'completed' END AS status, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'O') THEN TIMESTAMP '{NOW}' END AS completed_at FROM orders")
def q_cancel_run(spark, d):
    o = _orders(spark, d)
    first = lambda s: str(table(spark, d, "orders").where(F.col("o_orderstatus") == s).agg(F.min("o_orderkey")).first()[0])
    return U.cancel_run(U.cancel_run(o, first("O"), NOW), first("F"), NOW).select("id", "status", *_ntz("completed_at"))


def _gates(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    gate = F.when(key % 3 == 0, "pass").when(key % 3 == 1, "fail").otherwise("unknown")
    return table(spark, d, "orders").select(key.cast("string").alias("run_id"), gate.alias("gate_status"), F.lit(5).alias("terminal"), F.lit(3).alias("passed"), F.lit(1).alias("failed"), F.lit(1).alias("errored"))


@query(f"""SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 2 THEN 'running' ELSE 'completed' END AS status, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 < 2 THEN CASE o_orderkey % 3 WHEN 0 THEN 'pass' ELSE 'fail' END ELSE 'unknown' END AS gate_status,
CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 < 2 THEN 3 ELSE 0 END AS passed_execution_count, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 < 2 THEN TIMESTAMP '{NOW}' END AS finalized_at FROM orders""")
def q_finalize_runs(spark, d):
    once = U.finalize_run(_orders(spark, d), _gates(spark, d), NOW)
    return U.finalize_run(once, _gates(spark, d), LATER).select("id", "status", "gate_status", "passed_execution_count", *_ntz("finalized_at"))


@query("""SELECT 'run.completed' AS event_type, 'run:' || o_orderkey || ':completed' AS dedupe_key, '{"run_id":"' || o_orderkey || '","gate_status":"' || CASE o_orderkey % 3 WHEN 0 THEN 'pass' ELSE 'fail' END || '"}' AS payload FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 3 < 2""")
def q_completed_events(spark, d):
    before = _orders(spark, d)
    return U.completed_events(before, U.finalize_run(before, _gates(spark, d), NOW), NOW).select("event_type", "dedupe_key", "payload")


@query("SELECT 'run.started' AS event_type, 'run:' || o_orderkey || ':started' AS dedupe_key, o_orderkey::VARCHAR AS aggregate_id FROM orders WHERE o_orderstatus = 'P'")
def q_started_events(spark, d):
    return U.started_events(_orders(spark, d), NOW).select("event_type", "dedupe_key", "aggregate_id")


@query(f"WITH {Q._ATTEMPTS} SELECT id::VARCHAR AS id, status, strftime(leased_until, '%Y-%m-%d %H:%M:%S') AS leased_until FROM a")
def q_cast_projection(spark, d):
    return Q._attempts(spark, d).select(F.col("id").cast("string").alias("id"), F.col("status").cast("string").alias("status"), F.date_format("leased_until", "yyyy-MM-dd HH:mm:ss").alias("leased_until"))


# ---- aggregates -----------------------------------------------------------------------------


@query(f"WITH {Q._FACTS} SELECT execution_id, string_agg(dimension || ':' || coalesce(round(weighted_mean * 10000)::BIGINT::VARCHAR, 'none'), ',' ORDER BY dimension) AS scores FROM dim GROUP BY 1")
def q_dimension_map(spark, d):
    e = F.map_entries("dimension_scores")
    text = F.transform(e, lambda x: F.concat(x.key, F.lit(":"), F.coalesce(F.round(x.value * 10000).cast("long").cast("string"), F.lit("none"))))
    return Q._executions(spark, d).select("execution_id", F.array_join(text, ",").alias("scores"))


@query(f"WITH {Q._FACTS} SELECT execution_id, count(DISTINCT evaluator_id) AS reported, count(DISTINCT evaluator_id) >= 3 AS complete FROM f GROUP BY 1 UNION ALL SELECT o_orderkey, 0, false FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q_completeness(spark, d):
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("execution_id"), F.lit(3).alias("expected_evaluator_count"))
    return A.complete(Q._facts(spark, d), expected).select("execution_id", "reported", "complete")


@query(f"WITH {Q._FACTS} SELECT execution_id, CASE WHEN evaluator_result_count >= 4 THEN overall_status END AS overall_status FROM st")
def q_expected_results(spark, d):
    dims = A.dimension_scores(Q._facts(spark, d), "execution_id").withColumn("wanted", F.lit(4))
    return A.execution_aggregates(dims, "execution_id", min_score=0.4, expected="wanted").select("execution_id", "overall_status")


@query(f"""{Q._RUNS}, m AS (SELECT o_custkey AS run_id, dimension, count(*) AS n, round(avg(weighted_mean), 6) AS mean FROM orders JOIN dim ON o_orderkey = execution_id GROUP BY ALL),
one AS (SELECT run_id, min(dimension) AS dimension FROM m GROUP BY 1) SELECT r.run_id, r.expected, r.passed, one.dimension AS first_dimension, m.n AS first_executions, m.mean AS first_mean FROM r LEFT JOIN one ON one.run_id = r.run_id LEFT JOIN m ON m.run_id = r.run_id AND m.dimension = one.dimension""")
def q_run_summary(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("execution_id"))
    dims = orders.join(A.dimension_scores(Q._facts(spark, d), "execution_id"), "execution_id")
    s = A.run_summary(Q._runs(spark, d), dims, "run_id")
    at = lambda path, kind, name: F.try_variant_get(F.parse_json("summary"), path, kind).alias(name)
    return s.select("run_id", at("$.counters.expected", "bigint", "expected"), at("$.counters.passed", "bigint", "passed"), at("$.dimensions[0].dimension", "string", "first_dimension"), at("$.dimensions[0].executions", "bigint", "first_executions"), at("$.dimensions[0].mean_score", "double", "first_mean"))


@query("SELECT event_id, NULL::VARCHAR AS raw_evaluator_output, NULL::VARCHAR AS evidence, NULL::VARCHAR AS reason, value FROM events")
def q_persistence_summary(spark, d):
    e = table(spark, d, "events").select("event_id", F.lit("failed").alias("status"), F.lit(True).alias("blocking"), F.col("props").alias("raw_evaluator_output"), F.col("props").alias("evidence"), F.col("event_type").alias("reason"), "value")
    return persisted(e, "all", True, "summary").select("event_id", "raw_evaluator_output", "evidence", "reason", "value")


@query("""SELECT 'score' AS "check", count(*) FILTER (l_tax * 20 > 1) AS n FROM lineitem UNION ALL SELECT 'weight', count(*) FILTER (l_extendedprice - 20000 < 0) FROM lineitem
UNION ALL SELECT 'unique(attempt_id,evaluator_id,finding_no)', count(*) - count(DISTINCT (l_orderkey, l_partkey, l_linenumber)) FROM lineitem""")
def q_result_checks(spark, d):
    facts = table(spark, d, "lineitem").select((F.col("l_tax") * 20).alias("normalized_score"), (F.col("l_extendedprice") - 20000).alias("weight"), F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("evaluator_id"), F.col("l_linenumber").alias("finding_no"))
    return violations(facts, CHECKS["evaluator_results"], KEYS["evaluator_results"][1:])


@query(f"""WITH {_CHUNKS} SELECT 'range' AS "check", count(*) FILTER (a > 200) AS n FROM c UNION ALL SELECT 'attempt_no', (SELECT count(*) FROM events WHERE user_id % 5 = 0) UNION ALL SELECT 'latency', (SELECT count(*) FROM events WHERE value < 10)
UNION ALL SELECT 'counts', (SELECT count(*) FROM customer WHERE c_acctbal < 0)""")
def q_row_checks(spark, d):
    chunks = _chunks(spark, d).withColumn("ordinal_end", F.when(F.col("ordinal_start") > 200, F.col("ordinal_start")).otherwise(F.col("ordinal_end")))
    latency = F.col("value").cast("long")
    attempts = table(spark, d, "events").select((F.col("user_id") % 5).alias("attempt_no"), F.lit(0).alias("agent_latency_ms"), F.lit(None).cast("long").alias("evaluator_latency_ms"), F.when(F.col("value") < 10, -1 - latency).otherwise(latency).alias("total_latency_ms"))
    n = F.col("c_acctbal")
    runs = table(spark, d, "customer").select(*[F.lit(0).alias(c) for c in ("expected_execution_count", "terminal_execution_count", "passed_execution_count", "failed_execution_count")], n.alias("errored_execution_count"))
    return violations(chunks, CHECKS["run_chunks"]).union(violations(attempts, CHECKS["execution_attempts"])).union(violations(runs, CHECKS["runs"]))


# ---- whole runs -----------------------------------------------------------------------------


def _plan(spark: SparkSession, d: str) -> dict:
    """Documents as cases of a run: those of some English sources and the German ones have evaluators."""
    docs = table(spark, d, "documents")
    none = F.lit(None).cast("string")
    c = P.dense_ordinals(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("case_id"), F.col("ordinal").cast("int").alias("ordinal"), F.col("lang").alias("task_type"), none.alias("case_group"), F.to_json(F.struct(F.col("doc_id").alias("id"))).alias("input"),
        F.to_json(F.struct(F.when(F.col("n_chars") % 4 == 0, "odd").otherwise(F.col("lang")).alias("label"))).alias("expected"), none.alias("context"), F.array("source").alias("tags"), F.lit("{}").alias("metadata"),
    )
    return P.plan_cases(spark, PROFILE, c, "documents", "1", "whole", NOW)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Each document answers with its text and language; every seventh's first attempt fails, every 49th's second too; every eleventh has none."""
    docs = table(spark, d, "documents").where("doc_id % 11 <> 0")
    both = docs.select("*", F.explode(F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("attempt_no"))
    failed = ((F.col("doc_id") % 7 == 0) & (F.col("attempt_no") == 1)) | (F.col("doc_id") % 49 == 0)
    return both.select(F.col("doc_id").cast("string").alias("case_id"), "attempt_no", F.when(failed, "failed_agent_call").otherwise("completed").alias("status"), "text", F.to_json(F.struct(F.col("lang").alias("label"))).alias("structured"), F.lit("[]").alias("tool_calls"), F.lit(5).cast("long").alias("agent_latency_ms"), F.lit('{"prompt_tokens":1}').alias("token_usage"))


_WHOLE = f"""{Q._SENTIMENT}, k AS (SELECT s.doc_id, d.lang, d.source, d.n_chars, CASE WHEN p > n THEN 1.0 WHEN p < n THEN 0.0 ELSE 0.5 END::DOUBLE AS q, p < n AS bad, trim(text) = '' AS blank,
CASE WHEN d.lang = 'en' AND d.source IN ('src0', 'src1', 'src2') THEN 'english' WHEN d.lang = 'de' THEN 'german' END AS g, CASE WHEN s.doc_id % 11 = 0 THEN 'none' WHEN s.doc_id % 49 = 0 THEN 'broken' ELSE 'done' END AS a
FROM s JOIN documents d ON d.doc_id = s.doc_id),
v AS (SELECT *, CASE WHEN g = 'english' THEN (q + CASE WHEN n_chars % 4 = 0 THEN 0.0 ELSE 1.0 END) / 2 ELSE q END AS score, CASE WHEN g = 'english' THEN n_chars % 4 = 0 ELSE bad END AS blocked FROM k),
o AS (SELECT *, CASE WHEN g IS NULL THEN 'skipped' WHEN a = 'none' THEN NULL WHEN a = 'broken' THEN 'error' WHEN blocked THEN 'failed' WHEN score < 0.45 THEN 'failed' ELSE 'passed' END AS outcome FROM v)"""


@query("SELECT 'case_count' AS what, count(*) AS n FROM documents UNION ALL SELECT 'blob_count', count(*) FROM (SELECT DISTINCT doc_id, n_chars % 4 = 0, lang, source FROM documents) UNION ALL SELECT 'chunk_count', ceil(count(*) / 100)::BIGINT FROM documents UNION ALL SELECT 'event_count', ceil(count(*) / 100)::BIGINT FROM documents")
def q_collection_counts(spark, d):
    return P.collection_counts(_plan(spark, d))


@query(f"SELECT 'documents' AS dataset_id, '1' AS dataset_version, 'release' AS evaluation_profile_id, 'release/1.0.0' AS profile_version_id, 'pending' AS status, 'unknown' AS gate_status, count(*)::INT AS expected_execution_count, 'v3' AS aggregation_policy_version, TIMESTAMP '{NOW}' AS created_at FROM documents")
def q_planned_run(spark, d):
    return _plan(spark, d)["runs"].select("dataset_id", "dataset_version", "evaluation_profile_id", "profile_version_id", "status", "gate_status", "expected_execution_count", "aggregation_policy_version", *_ntz("created_at"))


@query("""SELECT doc_id::VARCHAR AS case_id, lang AS task_type, g.evaluator_id, g.weight, g.blocking FROM documents JOIN (VALUES ('en', 'core/sentiment-basic-en:1.0.0', 2.0::DOUBLE, false), ('en', 'core/exact-label-match:1.0.0', 1.0, true), ('de', 'core/sentiment-basic-en:1.0.0', 1.0, true)) AS g (lang_, evaluator_id, weight, blocking)
ON lang = lang_ AND (lang = 'de' OR source IN ('src0', 'src1', 'src2'))""")
def q_bindings(spark, d):
    _, groups, bindings, _ = load_profile(spark, PROFILE)
    c = cases(spark, d).select(F.col("case_id").cast("string").alias("case_id"), "task_type", F.slice("tags", 2, 1).alias("tags"))
    return bind(route(c, groups).where("group_id is not null"), bindings).select("case_id", "task_type", "evaluator_id", "weight", "blocking")


@query(f"WITH {_WHOLE} SELECT doc_id::VARCHAR AS case_id, g AS group_id, CASE WHEN g IS NULL THEN 'completed' WHEN a = 'none' THEN 'pending' WHEN a = 'broken' THEN 'failed' ELSE 'completed' END AS status, outcome FROM o")
def q_run_outcomes(spark, d):
    return V.evaluate_run(_plan(spark, d), _answers(spark, d), LATER)["outcomes"]


@query(f"WITH {_WHOLE} SELECT doc_id::VARCHAR AS case_id, 'completed' AS status, outcome AS overall_status, round(score, 6) AS aggregate_score FROM o WHERE g IS NOT NULL AND a = 'done'")
def q_run_report(spark, d):
    plan = _plan(spark, d)
    t = V.evaluate_run(plan, _answers(spark, d), LATER)
    return V.run_report(t["executions"], t["execution_aggregates"], plan["run_id"]).where("overall_status is not null").select("case_id", "status", "overall_status", F.round("aggregate_score", 6).alias("aggregate_score"))


@query(f"WITH {_WHOLE} SELECT count(*) AS expected, count(outcome) AS terminal, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'error') AS errored, CASE WHEN count(outcome) < count(*) THEN 'unknown' ELSE 'fail' END AS gate_status FROM o")
def q_whole_run(spark, d):
    return V.evaluate_run(_plan(spark, d), _answers(spark, d), LATER)["counters"].select("expected", "terminal", "passed", "failed", "errored", "gate_status")


@query(f"""WITH {_WHOLE} SELECT 'core/sentiment-basic-en:1.0.0' AS evaluator_id, 'quality' AS dimension, count(*) AS n, sum(q)::DOUBLE AS total, count(*) FILTER (bad OR g = 'german') AS kept_raw FROM o WHERE g IS NOT NULL AND a = 'done'
UNION ALL SELECT 'core/exact-label-match:1.0.0', 'correctness', count(*), count(*) FILTER (n_chars % 4 <> 0)::DOUBLE, count(*) FROM o WHERE g = 'english' AND a = 'done'""")
def q_run_facts(spark, d):
    r = V.evaluate_run(_plan(spark, d), _answers(spark, d), LATER)["evaluator_results"]
    return r.groupBy("evaluator_id", "dimension").agg(F.count("*").alias("n"), F.sum(clamp(F.col("normalized_score"))).alias("total"), F.count_if(F.to_json("raw_evaluator_output") != "null").alias("kept_raw"))


@query(f"WITH {_WHOLE} SELECT 'completed' AS status, 'fail' AS gate_status, count(*)::INT AS expected_execution_count, count(*)::INT AS terminal_execution_count, 1.0::DOUBLE AS progress FROM o")
def q_run_status(spark, d):
    """The run of all documents but with an answer for each: it ends, and its gate is decided."""
    plan = _plan(spark, d)
    answers = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.lit(1).alias("attempt_no"), F.lit("completed").alias("status"), "text", F.lit('{"label":"none"}').alias("structured"), F.lit("[]").alias("tool_calls"), F.lit(1).cast("long").alias("agent_latency_ms"), F.lit("{}").alias("token_usage"))
    return V.run_status(V.evaluate_run(plan, answers, LATER)["runs"], plan["run_id"]).select("status", "gate_status", "expected_execution_count", "terminal_execution_count", "progress")


