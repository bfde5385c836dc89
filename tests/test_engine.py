import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import canonical as C
from gaugeworks.functions import evaluators as E
from gaugeworks.functions import scores as S
from gaugeworks.operators import aggregate as A
from gaugeworks.operators import registry as R
from gaugeworks.operators import state as U
from gaugeworks.plans import runs as P
from gaugeworks.sources import documents as D

PROFILE = """
profile_id: p
profile_version: "1"
case_groups:
  - id: texts
    applies_to: {task_type: classification, tags_any: [smoke], tags_all: []}
    evaluators: [{ref: "lab/sentiment@0.1.0", dimension: quality, blocking: true, weight: 2.0}]
    aggregation: {dimensions: {quality: {method: min_score, blocking: true, weight: 1.0}}}
"""
DATASET = """
dataset_id: d
dataset_version: "1"
cases:
  - {id: a, task_type: classification, input: {user_message: hi}, tags: [smoke, easy]}
  - {id: b, task_type: other, input: {user_message: hi}}
"""


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def score(kind, **parts):
    names = {"passed": "boolean", "value": "double", "min": "double", "max": "double", "severity": "string", "outcome": "string"}
    return F.struct(F.lit(kind).alias("kind"), *[F.lit(parts.get(n)).cast(k).alias(n) for n, k in names.items()])


@pytest.mark.parametrize(
    ("kind", "parts", "want"),
    [
        ("range", dict(value=1.0, min=10.0, max=5.0), None),
        ("range", dict(value=30.0, min=0.0, max=20.0), 1.0),
        ("normalized", dict(value=0.8), 0.8),
        ("normalized", dict(value=float("nan")), None),
        ("binary", dict(passed=True), 1.0),
        ("binary", dict(passed=False), 0.0),
        ("severity_mapped", dict(severity="high"), 0.25),
        ("preference", dict(outcome="tie"), 0.5),
        ("informational", dict(), None),
    ],
)
def test_normalize(spark, kind, parts, want):
    assert one(spark, S.normalize(score(kind, **parts)))[0] == want


def test_raw_parts(spark):
    assert tuple(one(spark, S.raw_parts(score("normalized", value=1.7)))[0]) == (1.7, 0.0, 1.0)
    assert tuple(one(spark, S.raw_parts(score("severity_mapped", severity="low")))[0]) == (None, None, None)


def test_canonical_json(spark):
    assert one(spark, C.canonical_json(F.lit('{"b":1,"a":{"d":1,"c":2}}')))[0] == '{"a":{"c":2,"d":1},"b":1}'
    assert C.canonical({"b": 1, "a": {"d": 1, "c": 2}}) == '{"a":{"c":2,"d":1},"b":1}'


def test_chunks(spark):
    assert P.chunks(205) == [(0, 100), (100, 200), (200, 205)]
    got = P.chunk_table(spark.createDataFrame([(205,), (0,)], "n long")).orderBy("ordinal_start").collect()
    assert [(r.ordinal_start, r.ordinal_end) for r in got] == P.chunks(205)


def test_identifiers(spark):
    row = one(spark, C.identifier_parts(F.lit("lab/sentiment-basic-en:0.1.0")).alias("a"), C.identifier_parts(F.lit("lab:sentiment-basic-en@0.1.0")).alias("b"), C.binding_identifier(F.lit("lab/x@1.2")).alias("c"))
    assert tuple(row.a) == ("lab", "sentiment-basic-en", "0.1.0")
    assert row.b is None
    assert row.c == "lab/x:1.2"


@pytest.mark.parametrize(("text", "want"), [("Great and helpful support", (2, 2, 0, "positive")), ("Awful, slow, bad experience", (-3, 0, 3, "negative")), ("Great but slow", (0, 1, 1, "neutral"))])
def test_sentiment(spark, text, want):
    s = one(spark, E.sentiment(E.tokens(F.lit(text))))[0]
    assert (s.score, s.positive_matches, s.negative_matches, s.label) == want


def test_text(spark):
    get = lambda t: one(spark, E.extract_text(F.lit(t)))[0]
    assert get("  plain text input  ") == "plain text input"
    assert get('{"text":"Excellent response"}') == "Excellent response"
    assert get("  ") is None
    assert get('{"message":"x"}') is None
    assert get('{"text":3}') is None
    assert one(spark, E.evaluated_text(F.lit(" "), F.lit("hello")))[0] == "hello"
    assert one(spark, E.tokens(F.lit("Great service, fast response!")))[0] == ["great", "service", "fast", "response"]


def test_sources(spark):
    assert D.text_source("x", None, "dataset") == "x"
    with pytest.raises(ValueError):
        D.text_source("x", "y", "dataset")
    with pytest.raises(ValueError):
        D.load_dataset(spark, "cases: []")
    assert D.parse('{"a": 1}', "profile") == D.parse("a: 1", "profile")


def test_plan_run(spark, tmp_path):
    plan = P.plan_run(spark, PROFILE, DATASET, "r1", "2024-01-01")
    assert plan["unmatched"].select("case_id").first()[0] == "b"
    bound = plan["bound"].first()
    assert (bound.case_id, bound.evaluator_id, bound.weight) == ("a", "lab/sentiment:0.1.0", 2.0)
    again = P.plan_run(spark, PROFILE, DATASET, "r1", "2024-01-01")
    as_text = lambda df: df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t == "variant"}).first()
    assert as_text(plan["runs"]) == as_text(again["runs"])
    assert plan["outbox_events"].count() == 1
    stage = P.commit({k: plan[k] for k in P.PLANNED}, str(tmp_path))
    assert spark.read.parquet(f"{stage}/runs").count() == 1


def test_dense_ordinals(spark):
    df = P.dense_ordinals(spark.range(100, 200).select((199 - F.col("id")).alias("k")), "k").orderBy("k").collect()
    assert [r.ordinal for r in df] == list(range(100))


def test_claims_and_leases(spark):
    rows = [(1, "pending", None), (2, "leased", "2024-01-01 00:00:00"), (3, "leased", "2024-01-03 00:00:00"), (4, "completed", None)]
    chunks = spark.createDataFrame(rows, "id int, status string, leased_until string").withColumn("leased_until", F.col("leased_until").cast("timestamp")).withColumn("updated_at", F.lit(None).cast("timestamp"))
    now = "2024-01-02 00:00:00"
    got = {i: U.claim_chunk(chunks, i, now)[0].count() for i in (1, 2, 3, 4)}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}
    _, held = U.claim_chunk(chunks, 1, now)
    until = "2024-01-02 00:01:00"
    assert U.complete_chunk(held, 1, until, now).where("id = 1").first().status == "completed"
    assert U.complete_chunk(held, 1, "2024-01-02 00:02:00", now).where("id = 1").first().status == "leased"


def test_upserts(spark):
    t = spark.createDataFrame([("a", 1)], "k string, v int")
    assert U.guarded_upsert(t, spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), ["k"], ["v"]).count() == 1
    with pytest.raises(ValueError):
        U.guarded_upsert(t, spark.createDataFrame([("a", 2)], "k string, v int"), ["k"], ["v"])
    assert U.patch(t, spark.createDataFrame([("a", 5)], "k string, v int"), "k").first().v == 5


def test_gate_and_status(spark):
    facts = spark.createDataFrame([(1, "safety", "failed", 0.0, 1.0, True), (2, "quality", "passed", 0.9, 1.0, False), (3, "quality", "skipped", None, 1.0, False)], "e int, dimension string, status string, normalized_score double, weight double, blocking boolean")
    out = A.execution_aggregates(A.dimension_scores(facts, "e"), "e", min_score=0.5)
    assert {r.e: r.overall_status for r in out.collect()} == {1: "failed", 2: "passed", 3: "skipped"}
    g = A.gate(A.run_counters(out, F.lit(1).alias("run"))).first()
    assert g.gate_status == "fail"


def test_registry(spark):
    draft = spark.createDataFrame([("lab", "x", "1", bytearray(b"a"), ["t"])], "namespace string, name string, version string, wasm_bytes binary, tags array<string>")
    empty = spark.createDataFrame([], "namespace string, name string, version string, wasm_bytes binary, tags array<string>, id string, content_hash string, state string, state_reason string, created_at timestamp")
    reg = R.publish(empty, draft, "2024-01-01")
    with pytest.raises(ValueError):
        R.publish(reg, draft, "2024-01-01")
    off = R.set_state(reg, reg.first().id, "removed")
    assert R.runnable(off).count() == 0
    with pytest.raises(LookupError):
        R.set_state(off, reg.first().id, "active")


def test_stream_equals_batch(spark, tmp_path):
    from gaugeworks.streaming import outbox as O

    ev = spark.createDataFrame([(i, f"k{i % 7}", "run.started", '{"chunk_id":"c"}' if i else "not json") for i in range(30)], "id int, dedupe_key string, event_type string, payload string")
    ev.write.parquet(f"{tmp_path}/in")
    good, bad = O.decoded(ev)
    assert (good.count(), bad.count()) == (29, 1)
    q = O.publish(O.deduped(O.read_events(spark, f"{tmp_path}/in", ev.schema)), f"{tmp_path}/out", f"{tmp_path}/ck", trigger=O.once())
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == ev.dropDuplicates(["dedupe_key"]).count() == 7


def test_result_lines_bound(spark):
    from gaugeworks.sources.documents import result_lines

    assert len(result_lines(spark.range(1000), run="r")) == 1000
    with pytest.raises(ValueError, match="export"):
        result_lines(spark.range(1001))


# ---- whole documents and tables -------------------------------------------------------------


@pytest.mark.parametrize("value", [1.0, 1.5, -0.0, 1e20, 1e16, 123456789012345.5, 1e-7, 0.0001, 2**70, True, None, "é\u001f\"\\\n\t\u007f\u2028😀", [1, [2.50, {"b": 1, "a": None}]], {"é": 1, "z": 2, "Z": {}, "😀": 3, "\uffff": 4}])
def test_one_canonical_form(spark, value):
    """The driver's canonical text is what Spark makes of the same document."""
    import json

    made = C.canonical({"v": value})
    assert one(spark, C.canonical_json(F.lit(json.dumps({"v": value}))))[0] == made
    assert one(spark, C.canonical_json(F.lit(made)))[0] == made


def test_tables_have_their_declared_columns(spark):
    from gaugeworks import schemas

    plan = P.plan_run(spark, PROFILE, DATASET, "r1", "2024-01-01")
    for name in P.PLANNED:
        declared = schemas.schema(name)
        got = plan[name].schema
        assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in declared], name
        assert plan[name].count() > 0
        P_ = plan[name].select([c for c, t in plan[name].dtypes if t != "variant"]).collect()  # every not-null column and check holds
        assert all(r[f.name] is not None for r in P_ for f in declared if not f.nullable and f.name in r.asDict())
    with pytest.raises(ValueError, match="needs"):
        schemas.conform(spark.range(1), "runs")
    bad = plan["run_chunks"].withColumn("ordinal_end", F.col("ordinal_start"))
    with pytest.raises(Exception, match="range"):
        schemas.conform(bad, "run_chunks").collect()
    with pytest.raises(Exception, match="case_id is not null"):
        schemas.conform(plan["dataset_version_cases"].withColumn("case_id", F.lit(None).cast("string")), "dataset_version_cases").collect()


def test_create_all(spark, tmp_path):
    from gaugeworks import schemas

    paths = schemas.create_all(spark, str(tmp_path))
    assert set(paths) == set(schemas.TABLES)
    for t, path in paths.items():
        assert spark.read.parquet(path).columns == schemas.schema(t).names
    schemas.create_all(spark, str(tmp_path))  # again: nothing happens


def test_commit_is_seen_whole(spark, tmp_path):
    plan = P.plan_run(spark, PROFILE, DATASET, "r1", "2024-01-01")
    assert P.committed(spark, str(tmp_path), "runs").count() == 0
    plan["runs"].write.parquet(f"{tmp_path}/batch-broken/runs")  # a commit that failed before its marker
    P.commit({k: plan[k] for k in P.PLANNED}, str(tmp_path))
    P.commit({k: P.plan_run(spark, PROFILE, DATASET, "r2", "2024-01-02")[k] for k in P.PLANNED}, str(tmp_path))
    assert sorted(r.run_key for r in P.committed(spark, str(tmp_path), "runs").select("run_key").collect()) == ["r1", "r2"]


def test_version_id_depends_on_membership(spark, monkeypatch):
    rows = [("d", "1", i, f"c{i}", f"h{i}") for i in range(25)]
    cols = "dataset_id string, dataset_version string, ordinal int, case_id string, case_hash string"
    of = lambda rows: C.dataset_version_ids(spark.createDataFrame(rows, cols)).first()["dataset_version_id"]
    monkeypatch.setattr(C, "MEMBERS", 10)
    assert of(rows) == of(rows[::-1])
    assert len({of(rows), of(rows[:-1]), of([*rows[:-1], (*rows[-1][:4], "other")]), of([(*r[:2], 24 - r[2], *r[3:]) for r in rows])}) == 4


def test_api(spark, tmp_path):
    import logging

    from gaugeworks.api import Engine, Settings

    e = Engine(spark, Settings(f"{tmp_path}/t", quiet=True))
    assert Settings("x").level() == logging.WARNING and Settings("x", verbose=5).level() == logging.DEBUG and e.log.level == logging.ERROR
    e.setup()
    assert e.test(profile=PROFILE, dataset=DATASET)["meta"]["dataset_cases"] == 2
    (tmp_path / "p.yaml").write_text(PROFILE)
    plan = e.create("k", "2024-01-01", profile_file=str(tmp_path / "p.yaml"), dataset=DATASET)
    assert e.status(plan["run_id"]).first().progress == 0.0
    assert e.cancel(plan["run_id"], "2024-01-02").first().status == "cancelled"
    with pytest.raises(ValueError):
        e.create("k", "2024-01-01", profile=PROFILE, profile_file="x", dataset=DATASET)


def test_run_from_documents_to_gate(spark, tmp_path):
    from gaugeworks.api import Engine, Settings
    from gaugeworks.plans import evaluate as V

    profile = PROFILE.replace("lab/sentiment@0.1.0", "core/sentiment-basic-en@0.1.0") + "defaults: {max_attempts: 2}\n"
    plan = P.plan_run(spark, profile, DATASET, "r1", "2024-01-01")
    answers = spark.createDataFrame([("a", 1, "failed_agent_call", None, None, "[]", 7, "{}"), ("a", 2, "completed", "Great and fast", None, "[]", 5, "{}")], V.OUTPUTS)
    t = V.evaluate_run(plan, answers, "2024-01-02")
    run = t["runs"].first()
    assert (run.status, run.gate_status, run.passed_execution_count) == ("completed", "pass", 1)
    assert t["outbox_events"].select("event_type").first()[0] == "run.completed"
    assert {r.case_id: (r.status, r.current_attempt_no) for r in t["executions"].collect()} == {"a": ("completed", 2), "b": ("completed", 0)}
    fact = t["evaluator_results"].first()
    assert (fact.dimension, fact.status, fact.normalized_score, fact.blocking, fact.evaluator_version) == ("quality", "passed", 1.0, True, "0.1.0")
    assert t["execution_attempts"].count() == 2 and t["execution_aggregates"].first().overall_status == "passed"
    again = V.evaluate_run({**plan, "runs": t["runs"]}, answers, "2024-01-03")
    assert again["outbox_events"].count() == 0 and again["runs"].first().finalized_at == run.finalized_at
    P.commit({k: t[k] for k in ("executions", "execution_aggregates")}, str(tmp_path))
    e = Engine(spark, Settings(str(tmp_path)))
    e.export(plan["run_id"], f"{tmp_path}/out", "json")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    first = V.evaluate_run(plan, answers.where("attempt_no = 1"), "2024-01-02")
    assert first["counters"].first().gate_status == "unknown" and first["runs"].first().status == "running"


def test_unknown_evaluator_is_an_error(spark):
    from gaugeworks.plans import evaluate as V

    plan = P.plan_run(spark, PROFILE, DATASET, "r1", "2024-01-01")
    t = V.evaluate_run(plan, spark.createDataFrame([("a", 1, "completed", "x", None, "[]", 5, "{}")], V.OUTPUTS), "2024-01-02")
    assert (t["evaluator_results"].first().status, t["counters"].first().gate_status) == ("error", "fail")


def test_custom_evaluator_failure_keeps_its_message(spark):
    def fails(row):
        raise ValueError("x" * 2000)

    f = E.custom_evaluator(spark.createDataFrame([(1, "t")], "k int, text string"), fails, "k", "text").first().finding
    assert (f.status, f.dimension, len(f.reason), f.failure_category) == ("error", "other", 2000, "evaluator_error")
    assert E.custom_evaluator(spark.createDataFrame([], "k int, text string"), fails, "k", "text").count() == 0


def test_lexicon_hits_are_the_tokens(spark):
    texts = ["Great, GREAT-ness; greatest good", "a bad_bug bad.", "schlecht ünbad badü", "", None, "İbad K good1 1good good"]
    for t in texts:
        both = one(spark, E.sentiment(E.tokens(F.lit(t).cast("string"))).alias("a"), E.sentiment(E.lexicon_hits(F.lit(t).cast("string"))).alias("b"))
        assert both.a == both.b, t


def test_schema_keywords(spark):
    with pytest.raises(ValueError, match="pattern"):
        E.json_schema(F.lit("{}"), {"pattern": "x"})
    fits = lambda doc, **schema: one(spark, E.json_schema(F.lit(doc), schema))[0]
    assert fits('{"a":1}', type="object", required=["a"]) and not fits('{"a":1}', required=["b"]) and not fits("[1]", type="object")
    assert fits("2.5", type="number", maximum=3) and not fits("2.5", type="integer") and not fits("4", maximum=3) and fits("4", enum=[3, 4]) and not fits("not json", type="string") and not fits('"abc"', maxLength=2)


def test_packages(spark, tmp_path):
    from gaugeworks.sources import artifacts as X

    with pytest.raises(ValueError):
        X.manifest("[package]\ndescription = 'x'")
    with pytest.raises(ValueError):
        X.manifest("[package]\nmanifest = 'x'\n[wit]\npath = 'p'")
    (tmp_path / "m.toml").write_text('[package]\nmanifest = "m"\ndescription = "said"\n[package.metadata]\nk = 1\n[wit]\npath = "w"\nworld = "x"\npackage = "p"\nversion = "9"\ninterface = "eval"\nstrict = true\n[profile.release]\nwasm = "a"\n')
    (tmp_path / "code.py").write_text("x = 1")
    doc = X.manifest((tmp_path / "m.toml").read_text())
    with pytest.raises(ValueError, match="not supported"):
        X.profile_of(doc, "debug")
    with pytest.raises(ValueError, match="is not"):
        X.draft(spark, str(tmp_path / "m.toml"), str(tmp_path / "code.py"), "lab", "eval", "8")
    row = X.draft(spark, str(tmp_path / "m.toml"), str(tmp_path / "code.py"), "lab", "eval", "9", own={"tags": ["t"]})
    reg = R.publish(row.limit(0), row, "2024-01-01").drop("metadata").first()
    assert (reg.description, reg.tags, bytes(reg.wasm_bytes), reg.wasm_size_bytes, reg.runtime) == ("said", ["t"], b"x = 1", 5, "spark")
    assert X.fingerprint(spark).startswith(f"spark-{spark.version}-")


def test_registry_states_in_tests(spark):
    draft = spark.createDataFrame([("lab", "x", "1", bytearray(b"a"), ["t"])], "namespace string, name string, version string, wasm_bytes binary, tags array<string>")
    reg = R.publish(draft.limit(0), draft, "2024-01-01")
    for bad, error in (("lab/x:2", LookupError), ("lab:x@1", ValueError)):
        with pytest.raises(error):
            R.test(reg, bad, spark.range(1), lambda df: df)
    with pytest.raises(PermissionError):
        R.test(R.set_state(reg, reg.first().id, "disabled"), "lab/x:1", spark.range(1), lambda df: df)


def test_streams_watch_log_work_and_stop(spark, tmp_path, caplog):
    import logging
    import time

    from gaugeworks.streaming import outbox as O

    ev = spark.createDataFrame([(i, "run.started" if i % 3 else "run.chunk.ready", '{"chunk_id":"c%d"}' % i) for i in range(12)], "tag int, event_type string, payload string")
    ev.write.parquet(f"{tmp_path}/in")
    stream = lambda: O.read_events(spark, f"{tmp_path}/in", ev.schema)
    O.watch(stream(), "seen", "event_type").awaitTermination(60)
    assert {r.event_type: r["count"] for r in spark.table("seen").collect()} == {"run.started": 8, "run.chunk.ready": 4}
    with caplog.at_level(logging.INFO, logger="gaugeworks"):
        O.log_events(stream(), logging.getLogger("gaugeworks"), f"{tmp_path}/ck1", O.once()).awaitTermination(60)
    assert "8 events of type run.started" in caplog.text
    chunks = spark.createDataFrame([("c1", "pending", None), ("c2", "completed", None)], "id string, status string, leased_until timestamp").withColumn("updated_at", F.lit(None).cast("timestamp"))
    O.work(stream().select(F.col("tag").cast("string").alias("tag"), "payload"), lambda m: O.worker_cycle(m, chunks, "2024-01-01")[0], f"{tmp_path}/done", f"{tmp_path}/ck2", O.once()).awaitTermination(60)
    assert {r.outcome: r["count"] for r in spark.read.parquet(f"{tmp_path}/done").groupBy("outcome").count().collect()} == {"completed": 1, "unclaimable": 11}
    q = O.publish(stream(), f"{tmp_path}/out", f"{tmp_path}/ck3")  # a tick loop, until it is stopped
    for _ in range(100):
        if q.lastProgress:
            break
        time.sleep(0.2)
    O.stop(q)
    assert not q.isActive and spark.read.parquet(f"{tmp_path}/out").count() == 12


def test_topic_patterns(spark):
    from gaugeworks.streaming import outbox as O

    keys = spark.createDataFrame([("run.started",), ("run.chunk.ready",), ("run",), ("other.started",)], "event_type string")
    fits = lambda p: sorted(r.event_type for r in O.routed_to(keys, p).collect())
    assert fits("run.*") == ["run.started"] and fits("run.#") == ["run", "run.chunk.ready", "run.started"] and fits("#.started") == ["other.started", "run.started"] and fits("#") == ["other.started", "run", "run.chunk.ready", "run.started"]


def test_inserts_are_checked(spark):
    t = spark.createDataFrame([(1, 0.5)], "id int, s double")
    with pytest.raises(ValueError):
        U.inserted(t, t, (("id",),))
    with pytest.raises(Exception, match="score"):
        U.inserted(t, spark.createDataFrame([(2, 1.5)], "id int, s double"), (("id",),), {"score": "s BETWEEN 0 AND 1"}).collect()
