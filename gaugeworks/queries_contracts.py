"""Queries of documents, contracts, functions, evaluators and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canonical as C
from .functions import contracts as K
from .functions import evaluators as E
from .functions.scores import explode_findings
from .operators import registry as R
from .query_base import WORDS, cases, query, table
from .sources import artifacts as P
from .sources import documents as D

PROFILE = """
profile_id: release
profile_version: 1.0.0
defaults: {max_attempts: 2, request_timeout_secs: 60, fail_on_any_blocking_failure: true, min_execution_score: 0.45}
persistence: {mode: full, persist_raw_outputs: failures_only, persist_evaluator_evidence: true}
case_groups:
  - id: english
    applies_to: {task_type: en, tags_any: [src0, src1, src2]}
    evaluators:
      - {ref: core/sentiment-basic-en@1.0.0, dimension: quality, blocking: false, weight: 2.0, config: {positive: [the, and, in, de, der], negative: [of, to, la, is, that]}}
      - {ref: core/exact-label-match@1.0.0, dimension: correctness, blocking: true, weight: 1.0, config: {expected_path: $.expected.label, actual_path: $.actual.structured.label}}
    aggregation:
      dimensions: {quality: {method: weighted_mean, blocking: false, weight: 1.0}, correctness: {method: min_score, blocking: true, weight: 1.0}}
  - id: german
    applies_to: {task_type: de}
    evaluators:
      - {ref: core/sentiment-basic-en@1.0.0, dimension: quality, blocking: true, weight: 1.0, config: {positive: [the, and, in, de, der], negative: [of, to, la, is, that]}}
    aggregation:
      dimensions: {quality: {method: weighted_mean, blocking: true, weight: 1.0}}
"""
SMALL = '{"profile_id": "p", "profile_version": "1", "case_groups": [{"id": "g", "applies_to": {"task_type": "t"}, "aggregation": {"dimensions": {"quality": {"method": "min_score", "weight": 0.50}}}}]}'
DATASET = '{"dataset_id": "d", "cases": [{"id": "a", "task_type": "t", "input": {"b": 1.50, "a": 2}, "tags": ["z", "B"]}, {"id": "b", "task_type": "t", "input": "x", "expected": {"label": "y"}}]}'


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


# ---- documents ------------------------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('english', 'en', 0, 'core/sentiment-basic-en@1.0.0', 'quality', false, 2.0::DOUBLE, 'weighted_mean', 1.0::DOUBLE), ('english', 'en', 1, 'core/exact-label-match@1.0.0', 'correctness', true, 1.0, 'min_score', 1.0),
('german', 'de', 0, 'core/sentiment-basic-en@1.0.0', 'quality', true, 1.0, 'weighted_mean', 1.0)) AS t (group_id, task_type, binding_no, ref, dimension, blocking, weight, method, dim_weight)""")
def q_profile(spark, d):
    _, groups, bindings, rules = D.load_profile(spark, D.text_source(PROFILE, None, "profile"))
    rules = rules.select("group_id", "dimension", "method", F.col("weight").alias("dim_weight"))
    return groups.join(bindings, "group_id").join(rules, ["group_id", "dimension"]).select("group_id", "task_type", "binding_no", "ref", "dimension", "blocking", "weight", "method", "dim_weight")


@query("SELECT 2 AS max_attempts, 60 AS request_timeout_secs, true AS fail_on_any_blocking_failure, 0.45::DOUBLE AS min_execution_score, 'full' AS mode, 'failures_only' AS persist_raw_outputs, true AS persist_evaluator_evidence")
def q_profile_settings(spark, d):
    return _one(spark, **D.profile_settings(D.parse(PROFILE, "profile")))


@query("""SELECT 'p/1' AS profile_version_id,
sha256('{"case_groups":[{"aggregation":{"dimensions":{"quality":{"method":"min_score","weight":0.5}}},"applies_to":{"task_type":"t"},"id":"g"}],"profile_id":"p","profile_version":"1"}') AS profile_hash,
sha256('[{"aggregation":{"dimensions":{"quality":{"method":"min_score","weight":0.5}}},"id":"g"}]') AS aggregation_policy_hash""")
def q_profile_ids(spark, d):
    raw = D.load_profile(spark, SMALL)[0]
    return _one(spark, **D.profile_ids(raw), aggregation_policy_hash=C.aggregation_policy_hash(raw))


@query("""SELECT * FROM (VALUES ('a', 0, 't', '{"a":2,"b":1.5}', NULL, 'z,B'), ('b', 1, 't', '"x"', '{"label":"y"}', '')) AS t (case_id, ordinal, task_type, input, expected, tags)""")
def q_dataset(spark, d):
    return D.load_dataset(spark, DATASET)[1].select("case_id", "ordinal", "task_type", "input", "expected", F.array_join("tags", ",").alias("tags"))


@query("SELECT 1 AS profile_case_groups, 2 AS dataset_cases, 'structured' AS profile_source, 'structured' AS dataset_source")
def q_validate_inputs(spark, d):
    m = D.validate_inputs(SMALL, DATASET)["meta"]
    return _one(spark, profile_case_groups=m["profile_case_groups"], dataset_cases=m["dataset_cases"], profile_source=m["sources"]["profile"], dataset_source=m["sources"]["dataset"])


@query("""SELECT '{"data":{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"},"meta":{"limit":5,"run":"r"}}' AS line FROM region""")
def q_result_json(spark, d):
    return D.result_json(table(spark, d, "region").select("r_regionkey", "r_name"), run="r", limit=5)


# ---- hashes and identifiers -----------------------------------------------------------------


@query("""SELECT event_id, sha256('{"p":' || replace(props, ' ', '') || ',"z":[3,1]}') AS h FROM events""")
def q_content_hash(spark, d):
    return table(spark, d, "events").select("event_id", C.content_hash(F.concat(F.lit('{"z":[3,1],"p":'), F.col("props"), F.lit("}"))).alias("h"))


@query("SELECT doc_id, array_to_string(list_sort(['é', lang, source, 'B', 'a', 'B']), ',') AS tags FROM documents")
def q_canonical_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(C.canonical_tags(F.array(F.lit("é"), "lang", "source", F.lit("B"), F.lit("a"), F.lit("B"))), ",").alias("tags"))


@query("""SELECT doc_id, sha256('{"context":null,"expected_output":{"lang":"' || lang || '"},"input":{"id":' || doc_id || ',"n":' || n_chars || '},"metadata":{},"tags":["' || lang || '","' || source || '"],"task_type":"' || lang || '"}') AS case_hash FROM documents""")
def q_case_hash(spark, d):
    parts = (F.col("lang"), F.to_json(F.struct(F.col("n_chars").alias("n"), F.col("doc_id").alias("id"))), F.to_json(F.struct("lang")), F.lit(None).cast("string"), F.array("source", "lang"), F.lit(None).cast("string"))
    return table(spark, d, "documents").select("doc_id", C.case_hash(*parts).alias("case_hash"))


@query(f"""WITH m AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS o, doc_id, sha256(text) AS h FROM documents),
p AS (SELECT lang, o // {C.MEMBERS} AS part, sha256(string_agg(o || chr(31) || doc_id || chr(31) || h, chr(10) ORDER BY o)) AS h, count(*) AS n FROM m GROUP BY ALL)
SELECT lang AS dataset_id, '1' AS dataset_version, sha256(lang || chr(10) || '1' || chr(10) || string_agg(h, chr(10) ORDER BY part)) AS dataset_version_id, sum(n)::BIGINT AS n FROM p GROUP BY lang""")
def q_dataset_versions(spark, d):
    from pyspark.sql import Window

    c = cases(spark, d)
    ordinal = F.row_number().over(Window.partitionBy("task_type").orderBy("case_id")) - 1
    return C.dataset_version_ids(c.select(F.col("task_type").alias("dataset_id"), F.lit("1").alias("dataset_version"), ordinal.alias("ordinal"), "case_id", "case_hash"))


@query("SELECT doc_id, substr(sha256(doc_id || chr(31) || lang), 1, 32) AS id FROM documents")
def q_stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", C.stable_id(F.col("doc_id"), F.col("lang")).alias("id"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE replace(props, ' ', '') END AS payload, CASE WHEN event_id % 3 <> 1 THEN replace(props, ' ', '') END AS optional FROM events")
def q_json_payload(spark, d):
    blank = F.when(F.col("event_id") % 3 == 0, F.lit(" \t")).otherwise(F.col("props"))
    optional = F.when(F.col("event_id") % 3 == 1, F.lit(" null")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.to_json(C.json_payload(blank, "props")).alias("payload"), C.optional_payload(optional).alias("optional"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, (props::JSON->>'k')::BIGINT % 2 = 0 AS even, NULL::VARCHAR AS missing FROM events")
def q_json_path(spark, d):
    doc = F.concat(F.lit('{"expected":{"label":'), F.col("props"), F.lit("}}"))
    k = C.at_path(doc, "$.expected.label.k", "bigint")
    return table(spark, d, "events").select("event_id", k.alias("k"), (k % 2 == 0).alias("even"), C.at_path(doc, "$.expected.none").alias("missing"))


# ---- contracts ------------------------------------------------------------------------------


@query("""SELECT 'e' || event_id AS execution_id, event_type AS task_type, replace(props, ' ', '') AS input_json, NULL::VARCHAR AS expected_json, '{}' AS metadata_json, 'said ' || user_id AS text, 'f' AS call, '{"a":1,"b":' || event_id || '}' AS arguments_json, NULL::VARCHAR AS result_json, '{}' AS config FROM events""")
def q_input_mapping(spark, d):
    e = table(spark, d, "events")
    doc = F.concat(F.lit('{"run_id":"r","execution_id":"e'), "event_id", F.lit('","attempt_id":"1","case":{"id":"c","task_type":"'), "event_type", F.lit('","input":'), "props", F.lit(',"expected":null,"tags":["t"]},"actual":{"text":"said '), "user_id", F.lit('","tool_calls":[{"name":"f","arguments":{"b":'), "event_id", F.lit(',"a":1}}]}}'))
    p = e.select(K.payloads(K.read_input(doc)).alias("p")).select("p.*")
    call = F.col("actual.tool_calls")[0]
    return p.select("execution_id", "test_case.task_type", "test_case.input_json", "test_case.expected_json", "test_case.metadata_json", "actual.text", call["name"].alias("call"), call["arguments_json"].alias("arguments_json"), call["result_json"].alias("result_json"), F.col("evaluator_config_json").alias("config"))


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    """An output document of two findings for each event."""
    first = '{"evaluator":{"namespace":"lab","name":"x","version":"1"},"results":[{"dimension":{"kind":"latency"},"status":"passed","score":{"kind":"range","value":'
    rest = ',"min":0,"max":50},"severity":"none","evidence":{"b":1,"a":2}},{"dimension":{"kind":"other","value":"tone"},"status":"failed","score":{"kind":"severity_mapped","severity":"high"},"blocking":true,"severity":"high","reason":"r","tags":["t"]}]}'
    doc = F.concat(F.lit(first), F.col("value").cast("string"), F.lit(rest))
    return table(spark, d, "events").select("event_id", K.read_output(doc).alias("o")).select("event_id", "o.*")


@query("""SELECT event_id, 'lab/x:1' AS evaluator_id, 0 AS finding_no, 'latency' AS dimension, 'passed' AS status, false AS blocking, 'range' AS score_kind, value AS raw_score, 50.0::DOUBLE AS raw_score_max, greatest(0, least(1, value / 50)) AS normalized_score, 'none' AS severity, NULL::VARCHAR AS reason FROM events
UNION ALL SELECT event_id, 'lab/x:1', 1, 'tone', 'failed', true, 'severity_mapped', NULL, NULL, 0.25, 'high', 'r' FROM events""")
def q_explode_findings(spark, d):
    facts = explode_findings(_outputs(spark, d), "event_id")
    return facts.select("event_id", "evaluator_id", "finding_no", "dimension", "status", "blocking", "score_kind", "raw_score", "raw_score_max", "normalized_score", "severity", "reason")


@query("""SELECT event_id, '{"a":2,"b":1}' AS evidence, 1::BIGINT AS tags, 'null' AS metadata FROM events""")
def q_output_mapping(spark, d):
    return _outputs(spark, d).select("event_id", F.col("results")[0]["evidence"].alias("evidence"), F.size(F.col("results")[1]["tags"]).cast("long").alias("tags"), "metadata")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'plain ' || user_id WHEN 1 THEN 'in ' || user_id ELSE 'asked ' || user_id END AS text FROM events WHERE event_id % 6 <> 5
UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 6 = 5""")
def q_extract_text(spark, d):
    k = F.col("event_id") % 6
    actual = F.when(k == 0, F.concat(F.lit("  plain "), "user_id", F.lit(" \n"))).when(k == 1, F.concat(F.lit(' {"text": " in '), "user_id", F.lit(' "} '))).when(k == 2, F.lit('{"text": 3}')).when(k == 3, F.lit(" ")).when(k == 4, F.lit('{"message": "x"}')).otherwise(F.lit('{"text": " "}'))
    asked = F.when(k == 5, F.lit("")).otherwise(F.concat(F.lit(" asked "), "user_id"))
    return table(spark, d, "events").select("event_id", E.evaluated_text(actual, asked).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS description, CASE WHEN p_size % 3 = 0 THEN 'own' ELSE 'said,' || p_brand END AS tags, CASE WHEN p_size % 5 = 0 THEN '{}' ELSE '{\"s\":1}' END AS metadata FROM part")
def q_metadata_precedence(spark, d):
    p = table(spark, d, "part")
    none = lambda k: F.lit(None).cast(k)
    said = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(none("string"))
    tags = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("said"), "p_brand"))
    meta = F.when(F.col("p_size") % 5 == 0, none("string")).otherwise(F.lit('{"s":1}'))
    return p.select("p_partkey", P.precedence(said, F.col("p_name"), "text").alias("description"), F.array_join(P.precedence(tags, F.array(F.lit("own")), "tags"), ",").alias("tags"), P.precedence(meta, F.lit("{}"), "text").alias("metadata"))


@query("""SELECT 'Release.toml' AS manifest, 'from the package' AS description, 'a,b' AS tags, '{"k":1}' AS metadata, 'release.py' AS artifact, 'eval' AS interface, '0.1.0' AS version""")
def q_manifest(spark, d):
    doc = P.manifest('[package]\nmanifest = "Release.toml"\ntags = ["a", "b"]\n[wit]\npath = "w"\nworld = "x"\npackage = "p"\nversion = "0.1.0"\ninterface = "eval"\nstrict = true\n[profile.release]\nwasm = "release.py"\n')
    meta = P.metadata(doc["package"], {"description": "from the package", "tags": ["z"], "metadata": {"k": 1}})
    interface, version = P.checked_interface(doc, "eval", "0.1.0")
    return _one(spark, manifest=doc["package"]["manifest"], description=meta["description"], tags=",".join(meta["tags"]), metadata=meta["metadata"], artifact=P.profile_of(doc, "release")["wasm"], interface=interface, version=version)


@query("SELECT page_id, sha256(html) AS content_hash, strlen(html)::BIGINT AS wasm_size_bytes FROM pages")
def q_artifact_hash(spark, d):
    return P.hashed(table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("wasm_bytes"))).select("page_id", "content_hash", "wasm_size_bytes")


# ---- evaluators -----------------------------------------------------------------------------

_WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_HITS = f"h AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ({', '.join(map(repr, WORDS['positive']))}))) AS p, len(list_filter(w, lambda x: x IN ({', '.join(map(repr, WORDS['negative']))}))) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text <> ''))"


@query(f"SELECT doc_id, len({_WORDS})::BIGINT AS n, list_extract({_WORDS}, 1) AS first FROM documents")
def q_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", E.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.get("t", F.lit(0)).alias("first"))


def _shipped(df: DataFrame) -> DataFrame:
    """The shipped evaluator with the corpus's lexicon, as an output with one finding."""
    found = E.sentiment_finding(F.col("text"), F.col("hits"), **WORDS)
    return df.withColumn("hits", E.lexicon_hits(F.col("text"), **WORDS)).withColumn("results", F.array(found))


@query(f"""WITH {_HITS}, l AS (SELECT *, CASE WHEN p > n THEN 'positive' WHEN p < n THEN 'negative' ELSE 'neutral' END AS label FROM h)
SELECT doc_id, 'lab/sentiment:1' AS evaluator_id, 'quality' AS dimension, CASE WHEN p < n THEN 'failed' ELSE 'passed' END AS status, CASE WHEN p < n THEN 'medium' ELSE 'none' END AS severity, CASE label WHEN 'positive' THEN 1.0 WHEN 'neutral' THEN 0.5 ELSE 0.0 END::DOUBLE AS normalized_score,
'basic English-only lexicon sentiment evaluator labeled input as ' || label AS reason FROM l""")
def q_registry_test(spark, d):
    draft = spark.range(1).select(F.lit("lab").alias("namespace"), F.lit("sentiment").alias("name"), F.lit("1").alias("version"), F.lit(b"code").alias("wasm_bytes"), F.array(F.lit("t")).alias("tags"))
    reg = R.publish(draft.limit(0), draft, "2024-01-01")
    return R.test(reg, "lab/sentiment:1", table(spark, d, "documents").where("text <> ''").select("doc_id", "text"), _shipped).select("doc_id", "evaluator_id", "dimension", "status", "severity", "normalized_score", "reason")


@query(f"""WITH {_HITS} SELECT doc_id, (p + n)::BIGINT AS matched_terms, (p - n)::BIGINT AS score, 'sentiment,basic,english-only,' || CASE WHEN p > n THEN 'positive' WHEN p < n THEN 'negative' ELSE 'neutral' END AS tags FROM h""")
def q_sentiment_evidence(spark, d):
    f = _shipped(table(spark, d, "documents").where("text <> ''").select("doc_id", "text")).select("doc_id", F.col("results")[0].alias("f"))
    at = lambda name: C.at_path(F.col("f.evidence"), f"$.{name}", "bigint").alias(name)
    return f.select("doc_id", at("matched_terms"), at("score"), F.array_join("f.tags", ",").alias("tags"))


@query("""SELECT doc_id, lang IN ('en', 'de') AND doc_id % 4 <> 1 AND n_chars >= 100 AS fits FROM documents""")
def q_json_schema(spark, d):
    doc = F.concat(F.lit('{"label":'), F.when(F.col("doc_id") % 4 == 1, F.lit("3")).otherwise(F.concat(F.lit('"'), "lang", F.lit('"'))), F.lit(',"size":{"n":'), "n_chars", F.lit("}}"))
    rules = {"type": "object", "required": ["label"], "properties": {"label": {"type": "string", "enum": ["en", "de"], "minLength": 2}, "size": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 100}}}, "note": {"type": "array"}}}
    return table(spark, d, "documents").select("doc_id", E.json_schema(doc, rules).alias("fits"))


@query("SELECT event_id, event_id % 5 IN (0, 1) AS fits, CASE WHEN event_id % 5 = 0 THEN 1.0 WHEN event_id % 5 = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS matched FROM events")
def q_tool_calls(spark, d):
    """Calls: whole; another argument; no name; not an array; arguments no object."""
    k, ask = F.col("event_id") % 5, F.concat(F.lit('{"name":"f","arguments":{"k":"'), "user_id", F.lit('","more":"1"}}'))
    calls = F.when(k == 0, F.concat(F.lit("["), ask, F.lit(',{"name":"g"}]'))).when(k == 1, F.concat(F.lit("["), ask, F.lit("]"))).when(k == 2, F.lit('[{"name":" "}]')).when(k == 3, F.lit('{"name":"g"}')).otherwise(F.lit('[{"name":"f","arguments":[1]}]'))
    expected = F.from_json(F.concat(F.lit('[{"name":"f","arguments":{"k":"'), "user_id", F.lit('"}},{"name":"g"}]')), E.CALLS)
    actual = F.coalesce(F.from_json(F.when(k < 2, calls), E.CALLS), F.array().cast(E.CALLS))
    return table(spark, d, "events").select("event_id", E.tool_call_schema(calls).alias("fits"), E.partial_arguments_match(actual, expected).alias("matched"))


@query("""SELECT o_orderkey, abs(o_totalprice - 150000) <= 150000 * 20.0 / 100 AS near, CASE WHEN (o_orderkey % 3 = 0) = (o_orderstatus = 'F') THEN 1.0 ELSE 0.0 END::DOUBLE AS refusal, CASE WHEN o_orderkey % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS offers,
CASE WHEN o_orderstatus = 'P' THEN 0.0 WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS adherence FROM orders""")
def q_answer_evaluators(spark, d):
    k = F.col("o_orderkey") % 3
    text = F.concat(F.when(k == 0, "I cannot do that. A dog ").when(k == 1, "Consider this: ").otherwise("Here it is: "), "o_orderstatus", F.lit("-state"))
    return table(spark, d, "orders").select(
        "o_orderkey",
        E.within_percent(F.col("o_totalprice"), F.lit(150000.0), 20.0).alias("near"),
        E.refusal_policy(text, F.col("o_orderstatus") == "F").alias("refusal"),
        E.helpful_alternative(text).alias("offers"),
        E.concept_adherence(text, F.array(F.lit("Dog"), F.lit("cat")), F.array(F.lit("p-state"))).alias("adherence"),
    )


# ---- registry -------------------------------------------------------------------------------


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("namespace"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("version"), F.concat("p_type", F.col("p_partkey").cast("string")).cast("binary").alias("wasm_bytes"), F.array("p_type", "p_brand").alias("tags"), F.col("p_type").alias("description"), "p_size", "p_partkey")


def _published(spark: SparkSession, d: str) -> DataFrame:
    p = _drafts(spark, d)
    return R.publish(R.publish(p.limit(0), p.where("p_size % 2 = 0"), "2024-01-01"), p.where("p_size % 2 = 1"), "2024-01-02")


_ID = "substr(sha256(p_brand || chr(31) || p_name || chr(31) || p_partkey), 1, 32)"


@query(f"SELECT {_ID} AS id, p_partkey::VARCHAR AS version, sha256(p_type || p_partkey) AS content_hash, strlen(p_type || p_partkey)::BIGINT AS wasm_size_bytes, 'active' AS state, CASE WHEN p_size % 2 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS created_at FROM part")
def q_registry_publish(spark, d):
    return _published(spark, d).select("id", "version", "content_hash", "wasm_size_bytes", "state", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(f"SELECT {_ID} AS id, p_name AS name FROM part WHERE p_partkey = 7")
def q_registry_show(spark, d):
    reg = _published(spark, d)
    one = table(spark, d, "part").where("p_partkey = 7").first()
    return R.show(reg, one.p_brand, one.p_name, "7").select("id", "name")


@query("SELECT p_name AS name, p_partkey::VARCHAR AS version FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_name, p_partkey::VARCHAR DESC")
def q_registry_listing(spark, d):
    return R.listing(_published(spark, d), table(spark, d, "part").agg(F.min("p_brand")).first()[0]).select("name", "version")


@query("SELECT p_partkey::VARCHAR AS version, CASE WHEN p_partkey = 7 THEN 'yanked' WHEN p_partkey = 9 THEN 'removed' ELSE 'active' END AS state, CASE WHEN p_partkey = 7 THEN 'broken' END AS state_reason FROM part")
def q_registry_set_state(spark, d):
    reg = _published(spark, d)
    ids = {r.version: r.id for r in reg.where("version in ('7', '9')").select("version", "id").collect()}
    return R.set_state(R.set_state(reg, ids["7"], "yanked", "broken"), ids["9"], "removed").select("version", "state", "state_reason")


@query("""SELECT p_partkey::VARCHAR AS version FROM part WHERE '["' || p_type || '", "' || p_brand || '"]' ILIKE '%", "%' ORDER BY p_name, p_partkey::VARCHAR DESC LIMIT 20""")
def q_registry_tag_search(spark, d):
    return R.search(_drafts(spark, d).select("namespace", F.col("version").alias("id"), "name", "version", F.lit(None).cast("string").alias("description"), "tags", F.lit("active").alias("state"), F.lit(None).cast("string").alias("state_reason")), '", "', 99).select("version")
