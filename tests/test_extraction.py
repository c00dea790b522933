from __future__ import annotations

import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.catalog import AGREEMENT, EMPLOYMENT_AGREEMENT, LICENSE_AGREEMENT
from foliary.operators.cache import append, asked_of, empty_cache, misses, narrowed, new_entries, read_cache
from foliary.operators.providers import CallProvider, RuleProvider
from foliary.operators.requests import message_pieces, normalised_messages, part_requests, routed, with_extra
from foliary.operators.summary import failure_summary, run_summary
from foliary.plans import extraction
from foliary.plans.extraction import Job, dispatch, enrich_table, extract, table_job
from foliary.schema import field, parts
from foliary.session import new_folder, staged
from foliary.sources.files import read_documents

FACTS = T.StructType([field(n) for n in ("email", "phone", "ip_address", "license")])
TEXTS = [
    (1, "a/1.txt", "Write to ann@x.example or +1 (555) 123 4567."),
    (2, "a/2.txt", "Released under the MIT License on 10.0.0.1."),
    (3, "b/3.txt", "Write to ann@x.example or +1 (555) 123 4567."),
    (4, "b/4.txt", "nothing here"),
    (5, "b/5.txt", " \n"),
    (6, "b/6.txt", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, path string, text string")


def counting_provider(folder: str, answers=None):
    """Answers with canned JSON, and leaves one file per call."""

    def connect():
        import uuid

        def ask(text):
            Path(folder, f"{uuid.uuid4().hex}-{threading.get_ident()}").write_text(text)
            if "fail" in text:
                raise RuntimeError("provider is down")
            return (answers or {}).get(text.rsplit("\n", 1)[-1], '{"email": "e"}')

        return ask

    return CallProvider(connect, concurrency=2)


def test_single_pass(spark, docs):
    rows = {r.doc_id: r for r in extract(docs, Job("t", FACTS, RuleProvider(), model="m", analyzed_at="2024-01-01 00:00:00")).results.collect()}
    assert rows[1].record.email == rows[3].record.email == "ann@x.example"
    assert rows[1].request_key == rows[3].request_key
    assert rows[2].record.license == "MIT" and rows[2].record.ip_address == "10.0.0.1"
    assert rows[3].record.source_filename == "b/3.txt" and rows[3].record.llm_model == "m"
    assert rows[4].status == "ok" and rows[4].record.email is None
    assert rows[5].status == rows[6].status == "no_result" and rows[5].record is None


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9])
def test_parts_give_the_same_records(spark, docs, size):
    whole = extract(docs, Job("t", FACTS, RuleProvider())).results.select("doc_id", "status", "record")
    split = extract(docs, Job("t", FACTS, RuleProvider(), part_size=size)).results.select("doc_id", "status", "record")
    assert sorted(whole.collect()) == sorted(split.collect())


def test_with_and_without_a_cache_agree(spark, docs):
    job = Job("t", T.StructType([field("email", required=True), field("license")]), RuleProvider())
    narrow, general = extract(docs, job), extract(docs, job, cache=empty_cache(spark))
    assert sorted(map(repr, narrow.results.collect())) == sorted(map(repr, general.results.collect()))
    assert sorted(narrow.fresh.collect()) == sorted(general.fresh.collect())


def test_number_of_part_calls():
    shape = T.StructType([field(f"f{i}") for i in range(78)])
    assert len(parts(shape, 2)) == 39
    assert [len(p.fields) for p in parts(shape, 10)][-1] == 8


def test_one_call_per_distinct_text_and_none_on_the_second_run(spark, docs, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    cache = new_folder(spark, "cache")
    job = Job("t", FACTS, counting_provider(str(calls)))
    first = extract(docs, job)
    assert first.results.where("status = 'ok'").count() == 4
    assert len(list(calls.iterdir())) == 3
    append(new_entries(first.fresh, empty_cache(spark), "2024-01-01 00:00:00"), cache)
    second = extract(docs, job, cache=read_cache(spark, cache))
    assert sorted(second.results.collect()) == sorted(first.results.collect())
    assert len(list(calls.iterdir())) == 3
    assert new_entries(second.fresh, read_cache(spark, cache), "2024-01-02 00:00:00").count() == 0


def test_waves_ask_the_same(spark, docs, tmp_path):
    provider = counting_provider(str(tmp_path))
    job = Job("t", FACTS, CallProvider(provider.connect, concurrency=2, waves=3))
    assert extract(docs, job).results.where("record.email = 'e'").count() == 4
    assert len(list(tmp_path.iterdir())) == 3


def test_from_folder_to_records(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"Write to ann@x.example \xff")
    (tmp_path / "b.docx").write_text("no")
    rows = extract(read_documents(spark, str(tmp_path)), Job("t", FACTS, RuleProvider())).results.collect()
    assert [(r.path.rsplit("/", 1)[-1], r.record.email) for r in rows] == [("a.txt", "ann@x.example")]


def test_errors_are_rows(spark, tmp_path):
    shape = T.StructType([field("email", required=True)])
    docs = spark.createDataFrame(
        [(1, "p", "fail now"), (2, "p", "bad"), (3, "p", "blank"), (4, "p", "good")], "doc_id bigint, path string, text string"
    )
    answers = {"bad": "{nope", "blank": '{"email": ""}', "good": '```json\n{"email": "x"}\n```'}
    results = extract(docs, Job("t", shape, counting_provider(str(tmp_path), answers))).results
    rows = {r.doc_id: r for r in results.collect()}
    assert [rows[i].error_class for i in (1, 2, 3, 4)] == ["ProviderError", "MalformedAnswer", "ValidationError", None]
    assert rows[1].error_message == "RuntimeError: provider is down"
    assert rows[3].error_message == "email: null" and rows[4].record.email == "x"
    total = run_summary(results).first()
    assert (total.total, total.success, total.failure) == (4, 1, 3)
    assert {r.error_class: r.n for r in failure_summary(results).collect()} == {
        "ProviderError": 1, "MalformedAnswer": 1, "ValidationError": 1
    }


def test_a_part_that_fails_fails_the_document(spark, tmp_path):
    shape = T.StructType([field("a"), field("b")])
    docs = spark.createDataFrame([(1, "p", "one")], "doc_id bigint, path string, text string")
    job = Job("t", shape, counting_provider(str(tmp_path), {"one": "{"}), part_size=1)
    row = extract(docs, job).results.first()
    assert row.status == "failed" and row.error_class == "MalformedAnswer"
    assert len(list(tmp_path.iterdir())) == 2


def test_known_answers_of_contracts(spark, tmp_path):
    licence = {"licensor": "TechCorp Inc.", "licensee": "Client XYZ", "license_scope": "unlimited", "start_date": "2023-01-01"}
    full = licence | {
        "agreement_title": "Software License Agreement", "agreement_date": "2023-01-01", "effective_date": "2023-01-01",
        "governing_law": "California", "term_description": "3 years",
    }
    docs = spark.createDataFrame([(1, "p", "L1"), (2, "p", "L2")], "doc_id bigint, path string, text string")
    answers = {"L1": json.dumps(licence), "L2": json.dumps(full)}
    rows = {r.doc_id: r for r in extract(docs, Job("contracts_LicenseAgreement", LICENSE_AGREEMENT, counting_provider(str(tmp_path), answers))).results.collect()}
    assert rows[1].errors == [f"{f}: missing" for f in ("agreement_title", "agreement_date", "effective_date", "governing_law", "term_description")]
    assert rows[2].status == "ok" and rows[2].record.agreement_date.isoformat() == "2023-01-01"
    assert [f.name for f in EMPLOYMENT_AGREEMENT.fields[: len(AGREEMENT.fields)]] == AGREEMENT.fieldNames()


def test_dispatch(spark, docs, tmp_path):
    typed = docs.withColumn("type_key", F.when(F.col("doc_id") <= 2, "A").when(F.col("doc_id") == 3, "B").when(F.col("doc_id") == 4, "C"))
    typed = typed.withColumn("error_message", F.when(F.col("type_key").isNull(), "invalid type: x"))
    jobs = {
        "A": Job("A", T.StructType([field("email"), field("license")]), RuleProvider()),
        "B": Job("B", T.StructType([field("email", required=True)]), counting_provider(str(tmp_path))),
    }
    done = dispatch(typed, jobs)
    rows = {r.doc_id: r for r in done.results().collect()}
    assert [rows[i].status for i in range(1, 7)] == ["ok", "ok", "ok", "no_result", "failed", "failed"]
    assert json.loads(rows[1].record_json) == {"email": "ann@x.example"} and json.loads(rows[2].record_json) == {"license": "MIT"}
    assert json.loads(rows[3].record_json) == {"email": "e"} and rows[5].error_message == "invalid type: x"
    assert {r.doc_id: r.record.license for r in done.typed("A").collect()} == {1: None, 2: "MIT"}


def test_enriched_table(spark, docs):
    table = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("note"))
    job = table_job("t", FACTS, RuleProvider())
    rows = {r.id: r for r in enrich_table(table, "id", "note", job, "x_").collect()}
    assert len(rows) == 6 and rows[1].x_email == "ann@x.example" and rows[4].x_email == "" and rows[5].x_email == ""
    again = enrich_table(table, "id", "note", job, "x_", cache=empty_cache(spark)).select(*rows[1].__fields__)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows.values()))
    with pytest.raises(ValueError, match="not found"):
        enrich_table(table, "id", "missing", job)


def test_routing_and_extra(spark):
    route, error = routed(F.col("p"))
    rows = spark.createDataFrame([("Claude",), ("OpenAI",), ("x",), (None,)], "p string").select(route.alias("r"), error.alias("e")).collect()
    assert [tuple(r) for r in rows] == [("anthropic", None), ("openai", None), (None, "Unknown provider 'x'"), (None, "Unknown provider ''")]
    base = F.array(F.struct(F.lit("text").alias("type"), F.lit("a").alias("text")))
    sizes = spark.createDataFrame([("b",), ("",), (None,)], "x string").select(F.size(with_extra(base, F.col("x")))).collect()
    assert [r[0] for r in sizes] == [2, 1, 1]


def test_long_message_lists_are_one_part(spark):
    rows = spark.range(0, 1000).select(F.lit(1).alias("c"), F.col("id").alias("turn"), F.lit("string").alias("kind"), F.col("id").cast("string").alias("text"))
    out = normalised_messages(rows, "c", "turn", "kind", "text").collect()
    assert [(r.seq, r.text) for r in out] == [(0, "\n".join(map(str, range(1000))))]
    assert part_requests(rows.select("turn"), 3).count() == 3000


def test_message_pieces_are_the_parts_cut(spark):
    plain = spark.range(0, 2500).select(
        F.lit(1).alias("c"), F.col("id").alias("turn"), F.lit("string").alias("kind"), F.col("id").cast("string").alias("text"))
    other = spark.createDataFrame(
        [(2, 0, "string", "a"), (2, 1, "document", "b"), (2, 1, "document", "b"), (2, 2, "string", None), (None, 0, "string", "x"), (None, 1, "string", "")],
        "c int, turn long, kind string, text string")
    rows = plain.unionByName(other)
    pieces = message_pieces(rows, "c", "turn", "kind", "text", 1000).orderBy("c", "seq", "type", "piece").collect()
    assert [r.piece for r in pieces if r.c == 1] == [0, 1, 2]
    joined = {}
    for r in pieces:
        key = (r.c, r.seq, r.type)
        joined[key] = f"{joined[key]}\n{r.text}" if key in joined else r.text
    # Without a null owner and with it the parts are the same; the joins of mixed lists keep null owners.
    assert joined == {(r.c, r.seq, r.type): r.text for r in normalised_messages(rows, "c", "turn", "kind", "text").collect()}
    assert message_pieces(rows.limit(0), "c", "turn", "kind", "text").count() == 0


def _rows_scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return sum(found)


def test_lookups_of_few_keys_read_few_pages(spark, tmp_path):
    folder = new_folder(spark, "cache")
    # Two runs, so every prefix has a file of about 1,500 rows and one of about 80.
    for first, last in ((0, 380_000), (380_000, 400_000)):
        body = F.concat(F.lit('{"v":"'), F.sha2(F.col("id").cast("string"), 512), F.lit('"}'))
        fresh = spark.range(first, last, 1, 8).select(F.md5(F.col("id").cast("string")).alias("request_key"), body.alias("response_json"))
        append(new_entries(fresh, empty_cache(spark), "2024-01-01 00:00:00"), folder)
    cache = read_cache(spark, folder)
    # Half of the keys are not there.
    asked = spark.range(0, 800_000, 1600).select(F.md5(F.col("id").cast("string")).alias("request_key"))
    asked = asked.unionByName(asked).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS request_key"))
    found = narrowed(cache, asked)
    assert found.count() == 250
    scanned = _rows_scanned(found.select("request_key", "response_json"))
    assert 250 <= scanned < 400_000 / 10, scanned
    assert narrowed(cache, asked.where("request_key is null")).count() == 0


def test_repeated_cache_rows_do_not_multiply_results(spark, docs, tmp_path):
    job = Job("t", FACTS, RuleProvider())
    fresh = extract(docs, job, cache=empty_cache(spark)).fresh
    folder = new_folder(spark, "cache")
    for day in ("2024-01-01", "2024-01-02"):
        append(new_entries(fresh, empty_cache(spark), f"{day} 00:00:00"), folder)
    done = extract(docs, job, cache=read_cache(spark, folder))
    assert sorted(map(repr, done.results.collect())) == sorted(map(repr, extract(docs, job).results.collect()))
    assert done.fresh.count() == 0


def test_lookup_reads_only_the_folders_of_its_keys(spark, docs):
    folder = new_folder(spark, "cache")
    rows = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("request_key"), F.lit("{}").alias("response_json"))
    append(new_entries(rows, empty_cache(spark), "2024-01-01 00:00:00"), folder)
    found = asked_of(read_cache(spark, folder), rows.limit(3))
    assert found.count() == 3
    filters = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "prefix" in filters


def test_table_rows_with_repeated_and_null_ids(spark):
    rows = [("r", "x a@b.co"), ("r", "y"), (None, "z c@d.co"), (None, None), ("r", "x a@b.co")]
    table = spark.createDataFrame(rows, "id string, note string")
    job = table_job("t", T.StructType([field("email")]), RuleProvider())
    plain = sorted(map(repr, enrich_table(table, "id", "note", job).collect()))
    assert len(plain) == 5
    assert plain == sorted(map(repr, enrich_table(table, "id", "note", job, cache=empty_cache(spark)).collect()))


def whole_request(folder):
    def connect():
        import json
        import uuid

        def ask(request):
            sent = {k: request[k] for k in ("provider", "model", "system", "max_tokens", "temperature")}
            sent["parts"] = [(p["type"], p["text"]) for p in request["parts"]]
            Path(folder, uuid.uuid4().hex).write_text(json.dumps(sent))
            return '{"email": "e"}'

        return ask

    return CallProvider(connect, concurrency=2, send="request", calls_per_task=1)


def test_a_called_provider_gets_the_whole_request(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in" / "a.txt").write_text("plain")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-1 x@y.example")
    docs = read_documents(spark, str(tmp_path / "in"))
    job = Job("t", FACTS, whole_request(str(tmp_path / "out")), provider_name="OpenAI", model="o3", extra="Be brief.", max_tokens=99)
    assert extract(docs, job).results.where("status = 'ok'").count() == 2
    sent = [json.loads(p.read_text()) for p in (tmp_path / "out").iterdir()]
    assert len(sent) == 2
    for s in sent:
        assert (s["provider"], s["model"], s["max_tokens"], s["temperature"]) == ("openai", "o3", 99, 1.0)
        assert s["parts"][2] == ["text", "Be brief."] and s["parts"][0][0] == "text"
    assert {s["parts"][1][0] for s in sent} == {"text", "document"}
    native = {r.path.rsplit("/", 1)[-1]: r for r in extract(docs, Job("t", FACTS, RuleProvider())).results.collect()}
    assert native["b.pdf"].record.email is None
    for provider in (RuleProvider(), job.provider):
        bad = extract(docs, Job("t", FACTS, provider, provider_name="Nobody")).results.collect()
        assert {(r.status, r.error_class, r.error_message) for r in bad} == {("failed", "ProviderError", "Unknown provider 'nobody'")}
    assert len(list((tmp_path / "out").iterdir())) == 2


def test_only_missing_texts_enter_an_exchange(spark):
    docs = spark.range(400).select(
        "id", F.lit("t").alias("type_key"), F.concat(F.lit("text "), (F.col("id") % 100).cast("string")).alias("text")
    )
    jobs = {"t": Job("t", FACTS, CallProvider(lambda: lambda text: "{}"))}
    requests = extraction._exploded(extraction.keyed_requests(docs, jobs, "id", "text"), "id")
    missing = misses(requests.withColumn("ask", F.struct("id")), empty_cache(spark), "ask").where("ask.id < 10").select(
        "request_key", "ask.id"
    )
    frame = extraction.missing_requests(docs, staged(missing, "m"), jobs, "id", "text")
    assert frame.count() == 10
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    # The flag is tested below every exchange that carries a text.
    for piece in final.split("Exchange hashpartitioning")[1:]:
        if "body" in piece.split("Scan")[0] or " text#" in piece.split("\n")[1]:
            assert "__bits" in piece


def test_called_types_are_asked_once(spark, docs, tmp_path):
    typed = docs.withColumns({"type_key": F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"), "error_message": F.lit(None).cast("string")})
    provider = counting_provider(str(tmp_path))
    done = dispatch(typed, {"a": Job("a", FACTS, provider), "b": Job("b", FACTS, provider)})
    assert done.results().where("status = 'ok'").count() == 4
    assert done.typed("a").where("record.email = 'e'").count() == 2
    assert len(list(tmp_path.iterdir())) == 3
