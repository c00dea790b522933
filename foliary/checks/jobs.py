"""Whole jobs: classification, extraction, enrichment, normalisation, streaming, sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.checks.base import DOCS, check, docs, table
from foliary.checks.relations import URL_PATH, answer_text, url_path
from foliary.checks.scans import CACHE, DOCUMENT_RECORD, _cache_rows
from foliary.checks.values import CUSTOMER_SHAPE, EVENT_RECORD, MARKDOWN, customer_record, customer_source
from foliary.functions import text as X
from foliary.operators import cache as C
from foliary.operators import classify, summary
from foliary.operators.classify import TypeNode
from foliary.operators.providers import DOCUMENT_RULES, CallProvider, RuleProvider
from foliary.plans import extraction, normalise
from foliary.plans.extraction import Job
from foliary.schema import field
from foliary.session import new_folder, staged
from foliary.sinks import files as sinks
from foliary.streaming import incremental

AT = "2024-05-01 10:00:00"
EXTRACTED = ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '') AS {n}" for n, p in DOCUMENT_RULES.items())
FIELDS = list(DOCUMENT_RULES)

# -- classification -------------------------------------------------------------

TREE = [
    TypeNode("lang_English", None, (" the ", " and ", " of ")),
    TypeNode("lang_French", None, (" le ", " la ", " que ")),
    TypeNode("lang_German", None, (" der ", " und ", " die ")),
    TypeNode("topic_License", "lang_English", ("license", "licence")),
    TypeNode("topic_Contact", "lang_English", ("@", "phone")),
    TypeNode("topic_Kontakt", "lang_German", ("@",)),
    TypeNode("topic_OpenSource", "topic_License", ("open", "source")),
]


def _hits_sql(node: TypeNode) -> str:
    return " + ".join(
        f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}" for w in node.keywords
    )


_SCORES = ", ".join(f"{_hits_sql(n)} AS s{i}" for i, n in enumerate(TREE))


def _best_sql(candidates: list[int]) -> str:
    """Key of the best candidate: most hits, then registry order; null without hits."""
    if not candidates:
        return "NULL"
    top = "greatest(" + ", ".join(f"s{i}" for i in candidates) + ")"
    cases = " ".join(f"WHEN s{i} = {top} THEN '{TREE[i].key}'" for i in candidates)
    return f"CASE WHEN {top} = 0 THEN NULL {cases} END"


def _next_sql(current: str) -> str:
    cases = []
    for parent in dict.fromkeys(n.parent for n in TREE if n.parent):
        children = [i for i, n in enumerate(TREE) if n.parent == parent]
        cases.append(f"WHEN '{parent}' THEN {_best_sql(children)}")
    return f"CASE {current} {' '.join(cases)} END"


def _classified_sql(first: list[int]) -> str:
    return f"""(
      WITH low AS (SELECT *, lower(text) AS low FROM {DOCS}), s AS (SELECT *, {_SCORES} FROM low),
           l1 AS (SELECT *, {_best_sql(first)} AS k1 FROM s), l2 AS (SELECT *, {_next_sql('k1')} AS k2 FROM l1),
           l3 AS (SELECT *, {_next_sql('k2')} AS k3 FROM l2)
      SELECT doc_id, path, text, concat_ws(' -> ', k1, k2, k3) AS path_text, coalesce(k3, k2, k1) AS type_key,
             CASE WHEN k1 IS NULL THEN 'failed' ELSE 'ok' END AS status FROM l3)"""


ROOTS = [i for i, n in enumerate(TREE) if n.parent is None]


def classified_docs(spark: SparkSession, sf: str, roots_only: bool) -> DataFrame:
    scores = classify.keyword_scores(F.col("text"), TREE)
    return classify.classified(docs(spark, sf), TREE, scores, roots_only=roots_only)


@check("pipe_01_classify_from_roots", f"SELECT doc_id, path_text, type_key, status FROM {_classified_sql(ROOTS)}")
def classify_from_roots(spark: SparkSession, sf: str) -> DataFrame:
    return classified_docs(spark, sf, True).select("doc_id", "path_text", "type_key", "status")


@check(
    "pipe_01_classify_from_all_types",
    f"SELECT doc_id, path_text, type_key, status FROM {_classified_sql(list(range(len(TREE))))}",
)
def classify_from_all(spark: SparkSession, sf: str) -> DataFrame:
    return classified_docs(spark, sf, False).select("doc_id", "path_text", "type_key", "status")


_TYPE_FIELDS = {
    "lang_English": ("email", "license"), "topic_License": ("license", "ip_address"), "topic_Contact": ("email", "phone"),
    "lang_French": ("email",),
}


def _typed_sql(name: str) -> str:
    types = ", ".join(f"'{t}'" for t, fields in _TYPE_FIELDS.items() if name in fields)
    return f"CASE WHEN type_key IN ({types}) THEN nullif(regexp_extract(text, '{DOCUMENT_RULES[name]}', 1), '') END AS {name}"


@check(
    "pipe_02_classify_then_extract",
    f"""SELECT doc_id, path, type_key, CASE WHEN type_key IS NULL THEN 'failed'
               WHEN type_key IN ({', '.join(f"'{t}'" for t in _TYPE_FIELDS)}) THEN 'ok' ELSE 'no_result' END AS status,
               {', '.join(_typed_sql(n) for n in FIELDS)} FROM {_classified_sql(ROOTS)}""",
)
def classify_then_extract(spark: SparkSession, sf: str) -> DataFrame:
    found = classified_docs(spark, sf, True).select("doc_id", "path", "text", "type_key", "error_message")
    jobs = {
        key: Job(key, T.StructType([field(n) for n in names]), RuleProvider(), analyzed_at=AT)
        for key, names in _TYPE_FIELDS.items()
    }
    return extraction.dispatch(found, jobs).results().select(
        "doc_id", "path", "type_key", "status", *[F.get_json_object("record_json", f"$.{n}").alias(n) for n in FIELDS]
    )


# -- extraction ---------------------------------------------------------------------


def _job(**options: object) -> Job:
    return Job("documents_Facts", DOCUMENT_RECORD, RuleProvider(), model="rules-1", analyzed_at=AT, **options)  # type: ignore[arg-type]


def _result_columns(results: DataFrame) -> DataFrame:
    return results.select(
        "doc_id", "path", "status", *[F.col(f"record.{n}").alias(n) for n in FIELDS],
        F.col("record.source_filename").alias("source_filename"), F.col("record.llm_model").alias("llm_model"),
    )


_RESULT_SQL = f"""SELECT doc_id, path, 'ok' AS status, {EXTRACTED}, path AS source_filename, 'rules-1' AS llm_model FROM {DOCS}"""


@check("pipe_03_single_pass", _RESULT_SQL)
def single_pass(spark: SparkSession, sf: str) -> DataFrame:
    return _result_columns(extraction.extract(docs(spark, sf), _job()).results)


@check("pipe_04_multi_pass", _RESULT_SQL)
def multi_pass(spark: SparkSession, sf: str) -> DataFrame:
    return _result_columns(extraction.extract(docs(spark, sf), _job(part_size=1)).results)


@check(
    "pipe_05_table_enrichment",
    """SELECT conv_id, turn, role, row_id, md5(text) AS text_hash, """
    + ", ".join(f"CASE WHEN text = '' THEN '' ELSE regexp_extract(text, '{p}', 1) END AS x_{n}" for n, p in DOCUMENT_RULES.items())
    + """ FROM (SELECT * REPLACE (CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text), conv_id || ':' || turn AS row_id
         FROM conversations)""",
)
def table_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).withColumn("text_hash", F.md5("text")).drop("text")


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumns(
        {
            "row_id": F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")),
            "text": F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text")),
        }
    )
    job = extraction.table_job("conversations_Facts", DOCUMENT_RECORD, RuleProvider())
    return extraction.enrich_table(rows, "row_id", "text", job, "x_")


def connect_email_finder() -> Callable[[str], str]:
    """A stand-in for a remote provider: finds the e-mail of a text, and fails on some texts."""
    pattern = re.compile(DOCUMENT_RULES["email"])

    def ask(text: str) -> str:
        body = text.split("\n}\n", 1)[-1]
        if "phone" in body:
            raise ValueError("no answer")
        hit = pattern.search(body)
        return json.dumps({"email": hit.group(1) if hit else None})

    return ask


@check(
    "udf_01_provider_hook",
    f"""SELECT doc_id, CASE WHEN contains(text, 'phone') THEN 'failed' ELSE 'ok' END AS status,
               CASE WHEN contains(text, 'phone') THEN NULL ELSE nullif(regexp_extract(text, '{DOCUMENT_RULES["email"]}', 1), '') END AS email,
               CASE WHEN contains(text, 'phone') THEN 'ProviderError' END AS error_class FROM documents""",
)
def provider_hook(spark: SparkSession, sf: str) -> DataFrame:
    job = Job("documents_Email", T.StructType([field("email")]), CallProvider(connect_email_finder, concurrency=8), analyzed_at=AT)
    return extraction.extract(docs(spark, sf), job).results.select("doc_id", "status", "record.email", "error_class")


def _email_job(concurrency: int = 8) -> Job:
    provider = CallProvider(connect_email_finder, concurrency=concurrency)
    return Job("documents_Email", T.StructType([field("email")]), provider, analyzed_at=AT)


@check(
    "udf_01_part_filled_cache",
    f"""SELECT doc_id, CASE WHEN lang <> 'en' AND contains(text, 'phone') THEN 'failed' ELSE 'ok' END AS status,
               CASE WHEN lang = 'en' THEN 'cached@x.example' WHEN contains(text, 'phone') THEN NULL
                    ELSE nullif(regexp_extract(text, '{DOCUMENT_RULES["email"]}', 1), '') END AS email FROM
        (SELECT doc_id, text, CASE WHEN bool_or(lang = 'en') OVER (PARTITION BY text) THEN 'en' ELSE 'other' END AS lang
         FROM documents)""",
)
def part_filled_cache(spark: SparkSession, sf: str) -> DataFrame:
    """English texts are answered already, some of them twice; only the others are asked."""
    every, job = docs(spark, sf), _email_job()
    typed = every.withColumn("type_key", F.lit(job.type_key))
    keys = extraction.keyed_requests(typed, {job.type_key: job}, "doc_id", "text", "lang").where("lang = 'en'")
    known = keys.select(
        F.get("parts", 0)["request_key"].alias("request_key"), F.lit('{"email": "cached@x.example"}').alias("response_json"),
        F.lit(AT).cast("timestamp_ntz").alias("created_at"),
    )
    return extraction.extract(every, job, cache=known).results.select("doc_id", "status", "record.email")


@check(
    "pipe_02_called_dispatch",
    f"""SELECT doc_id, type_key, CASE WHEN contains(text, 'phone') THEN 'failed' ELSE 'ok' END AS status,
               CASE WHEN contains(text, 'phone') THEN NULL
                    ELSE nullif(regexp_extract(text, '{DOCUMENT_RULES["email"]}', 1), '') END AS email
        FROM (SELECT doc_id, text, 'mail_' || lang AS type_key FROM documents)""",
)
def called_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """A called provider for every type: all of them read one table of the missing texts."""
    found = docs(spark, sf).select(
        "doc_id", "path", "text", F.concat(F.lit("mail_"), "lang").alias("type_key"), F.lit(None).cast("string").alias("error_message")
    )
    provider = CallProvider(connect_email_finder, concurrency=8)
    jobs = {f"mail_{lang}": Job(f"mail_{lang}", T.StructType([field("email")]), provider, analyzed_at=AT) for lang in ("en", "de", "fr", "es")}
    return extraction.dispatch(found, jobs).results().select(
        "doc_id", "type_key", "status", F.get_json_object("record_json", "$.email").alias("email")
    )


@check("pipe_01_called_classification", f"SELECT doc_id, path_text, type_key, status FROM {_classified_sql(ROOTS)}")
def called_classification(spark: SparkSession, sf: str) -> DataFrame:
    """The walk with choices that come back as rows, one question per document and level."""

    def ask(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", classify.by_score(F.col("offered"), classify.keyword_scores(F.col("text"), TREE)).alias("choice"))

    found = classify.classified_by_calls(docs(spark, sf), TREE, ask, roots_only=True)
    return found.select("doc_id", "path_text", "type_key", "status")


@check(
    "pipe_01_called_repeated_ids",
    f"""SELECT CASE WHEN doc_id % 5 <> 0 THEN doc_id // 3 END AS doc_id, path_text, type_key, status FROM {_classified_sql(ROOTS)}""",
)
def called_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The same where ids repeat and some are null: every row has an outcome of its own."""

    def ask(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", classify.by_score(F.col("offered"), classify.keyword_scores(F.col("text"), TREE)).alias("choice"))

    own = F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("doc_id") / 3).cast("long"))
    found = classify.classified_by_calls(docs(spark, sf).withColumn("doc_id", own), TREE, ask, roots_only=True)
    return found.select("doc_id", "path_text", "type_key", "status")


# -- normalisation ----------------------------------------------------------------------

CUSTOMER_RECORD = T.StructType([
    field("customer_name", required=True), field("industry"), field("contact_email"), field("is_active", "boolean"),
    field("tags", "array<string>"),
])
SUPPLIER_RECORD = T.StructType([field("licensor", required=True), field("website"), field("location")])
ORDER_RECORD = T.StructType([
    field("contract_id", required=True), field("client"), field("agreement_date", "date"), field("document_type"),
])


def _records(spark: SparkSession, sf: str) -> dict[str, normalise.Normalised]:
    key = F.col("c_custkey").cast("string")
    customers = table(spark, sf, "customer").select(
        F.concat(F.lit("a/"), F.lpad(key, 9, "0")).alias("path"), F.concat(F.lit(" "), "c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("industry"),
        F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.concat(F.lit("c"), key, F.lit("@x.example"))).alias("contact_email"),
        (F.col("c_custkey") % 2 == 0).alias("is_active"), F.array("c_mktsegment").alias("tags"),
    )
    nation = table(spark, sf, "nation")
    suppliers = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("b/"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("path"),
        F.col("s_name").alias("licensor"), F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string")).alias("website"),
        F.col("n_name").alias("location"),
    )
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("c/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"),
        F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("contract_id"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("client"),
        F.to_date("o_orderdate").alias("agreement_date"), F.col("o_orderpriority").alias("document_type"),
    )
    return {
        "customer_rec": normalise.normalise(customers, CUSTOMER_RECORD, "path"),
        "supplier_rec": normalise.normalise(suppliers, SUPPLIER_RECORD, "path"),
        "order_rec": normalise.normalise(orders, ORDER_RECORD, "path"),
    }


_ENTITY_SQL = """
  SELECT 'Customer' AS entity, c_name AS name, 'a/' || lpad(c_custkey::VARCHAR, 9, '0') AS first_path,
         CASE WHEN c_custkey % 3 <> 0 THEN 'c' || c_custkey || '@x.example' END AS contact_email,
         NULL AS website, NULL AS industry, NULL AS effective_date, NULL AS contract_type FROM customer
  UNION ALL SELECT 'Industry', c_mktsegment, min('a/' || lpad(c_custkey::VARCHAR, 9, '0')), NULL, NULL, NULL, NULL, NULL FROM customer GROUP BY c_mktsegment
  UNION ALL SELECT 'Company', s_name, 'b/' || lpad(s_suppkey::VARCHAR, 9, '0'), NULL, 'https://s' || s_suppkey, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'Location', n_name, min('b/' || lpad(s_suppkey::VARCHAR, 9, '0')), NULL, NULL, NULL, NULL, NULL
            FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
  UNION ALL SELECT 'Contract', 'O-' || o_orderkey, 'c/' || lpad(o_orderkey::VARCHAR, 9, '0'), NULL, NULL, NULL,
            strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority FROM orders
  UNION ALL SELECT 'Document', o_orderpriority, min('c/' || lpad(o_orderkey::VARCHAR, 9, '0')), NULL, NULL, NULL, NULL, NULL FROM orders GROUP BY o_orderpriority
  UNION ALL SELECT 'Customer', 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0'), min('c/' || lpad(o_orderkey::VARCHAR, 9, '0')), NULL, NULL, NULL, NULL, NULL
            FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey"""


@check(
    "pipe_06_entities",
    f"SELECT *, md5(entity || '||' || name) AS entity_id FROM ({_ENTITY_SQL})",
)
def entity_table(spark: SparkSession, sf: str) -> DataFrame:
    merged = normalise.entity_tables(normalise.all_mentions(_records(spark, sf).values()))
    return merged.select(
        "entity", "name", F.col("first_seen.path").alias("first_path"), "contact_email", "website", "industry",
        "effective_date", "contract_type", "entity_id",
    )


@check(
    "pipe_06_flat_records",
    """SELECT 'c/' || lpad(o_orderkey::VARCHAR, 9, '0') AS path, md5('Contract||O-' || o_orderkey) AS contract_id_id,
              md5('Customer||Customer#' || lpad(o_custkey::VARCHAR, 9, '0')) AS client_id,
              strftime(o_orderdate, '%Y-%m-%d') AS agreement_date, md5('Document||' || o_orderpriority) AS document_type_id
       FROM orders""",
)
def flat_records(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf)["order_rec"].records.withColumn("agreement_date", F.col("agreement_date").cast("string"))


# -- streaming -----------------------------------------------------------------------------


@check("str_01_incremental_crawl", _RESULT_SQL)
def incremental_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Two drops of files, one run each; the second run sees only its own files."""
    source, target, checkpoint = (new_folder(spark, f"stream-{n}") for n in ("in", "out", "state"))
    every = docs(spark, sf).select("doc_id", "path", "text")
    schema = "doc_id bigint, path string, text string"
    for parity in (0, 1):
        every.where(F.col("doc_id") % 2 == parity).write.mode("append").parquet(source)
        incremental.run_available(spark, source, schema, _job(), target, checkpoint)
    return _result_columns(incremental.results(spark, target))


_MAIL_SHAPE = T.StructType([field("customer_name"), field("contact_email")])
_MAIL_RULES = {"customer_name": r"for ([A-Z]+)", "contact_email": r"mail (\S+)"}


@check(
    "str_01_entity_state",
    """WITH d AS (SELECT c_mktsegment || CASE WHEN c_custkey % 4 = 3 THEN 'S' ELSE '' END AS name, (c_custkey % 4) * 100000000000 + c_custkey AS seen,
                      CASE WHEN c_custkey % 4 >= 2 AND c_custkey % 5 = 0 THEN 'a' || c_custkey || '@x' END AS mail FROM customer)
       SELECT 'Customer' AS entity, name, arg_min(mail, seen) FILTER (WHERE mail IS NOT NULL) AS contact_email, min(seen) // 100000000000 AS first_batch
       FROM d GROUP BY name""",
)
def entity_state(spark: SparkSession, sf: str) -> DataFrame:
    """Four batches over all customers; parts are merged three at a time, the second batch is written twice."""
    key = F.col("c_custkey")
    segment = F.concat("c_mktsegment", F.when(key % 4 == 3, "S").otherwise(""))
    mail = F.when((key % 4 >= 2) & (key % 5 == 0), F.concat(F.lit(" mail a"), key.cast("string"), F.lit("@x"))).otherwise("")
    every = table(spark, sf, "customer").select(
        key.alias("doc_id"), F.format_string("%012d", key).alias("path"), F.concat(F.lit("for "), segment, mail).alias("text")
    )
    target = new_folder(spark, "state")
    job = Job("mail", _MAIL_SHAPE, RuleProvider(_MAIL_RULES, {}))
    write = incremental.batch_writer(spark, job, target, fan=3)
    for batch in (0, 1, 2, 1, 3):
        write(every.where(F.col("doc_id") % 4 == batch), batch)
    return incremental.latest_entities(spark, target).select(
        "entity", "name", "contact_email", F.col("first_seen.batch").alias("first_batch")
    )


# -- sinks -------------------------------------------------------------------------------------


@check(
    "snk_01_json_manifest",
    f"""SELECT source || '/doc_' || doc_id || '_documents_Facts.json' AS out_path, 'documents_Facts' AS tag, {EXTRACTED}
        FROM {DOCS}""",
)
def json_manifest(spark: SparkSession, sf: str) -> DataFrame:
    results = extraction.extract(docs(spark, sf), _job()).results
    made = sinks.json_manifest(results, DOCUMENT_RECORD)
    return made.select(
        "out_path", F.get_json_object("json", "$.record_type").alias("tag"),
        *[F.get_json_object("json", f"$.{n}").alias(n) for n in FIELDS],
    )


@check(
    "snk_02_enriched_table",
    """SELECT conv_id, turn, role, md5(text) AS text_hash, """
    + ", ".join(f"CASE WHEN turn % 4 = 3 THEN '' ELSE regexp_extract(text, '{p}', 1) END AS x_{n}" for n, p in DOCUMENT_RULES.items())
    + " FROM (SELECT * REPLACE (CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text) FROM conversations)",
)
def enriched_table(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "csv")
    sinks.write_table(_enriched(spark, sf).drop("row_id"), folder)
    back = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("lineSep", "\n").csv(folder)
    )
    return back.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
        F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"), *[F.coalesce(f"x_{n}", F.lit("")).alias(f"x_{n}") for n in FIELDS],
    )


@check(
    "snk_03_classification_table",
    f"""SELECT url AS file_path, list_extract({URL_PATH}, -1) AS model_name,
               coalesce(list_extract({URL_PATH}, 1), '') AS path_level_1, coalesce(list_extract({URL_PATH}, 2), '') AS path_level_2,
               coalesce(list_extract({URL_PATH}, 3), '') AS path_level_3, coalesce(list_extract({URL_PATH}, 4), '') AS path_level_4
        FROM pages""",
)
def classification_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select(F.col("url").alias("path"), url_path().alias("selection_path"))
    return sinks.classification_table(rows.withColumn("type_key", F.element_at("selection_path", -1)))


@check(
    "snk_04_package_manifest",
    """WITH d AS (SELECT doc_id, lang || CASE WHEN ends_with(lang, 's') THEN '' ELSE 's' END || '/Documents' AS folder, source AS base FROM documents),
            r AS (SELECT *, row_number() OVER (PARTITION BY folder, base ORDER BY doc_id) - 1 AS n FROM d),
            w AS (SELECT *, folder || '/' || base || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS target FROM r)
       SELECT doc_id, target || '.pdf' AS document_target, target || '.json' AS json_target FROM w""",
)
def package_manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).select("doc_id", "path", "lang", "source")
    made = sinks.package_manifest(rows, F.array("lang", F.lit("Documents")), F.col("source"), ["doc_id"])
    return made.select("doc_id", "document_target", "json_target")


@check(
    "snk_05_database",
    f"""SELECT 'entities/' || entity AS written, count(*) AS n, count(DISTINCT md5(entity || '||' || name)) AS ids FROM ({_ENTITY_SQL}) GROUP BY entity
        UNION ALL SELECT 'records/customer_rec', count(*), count(DISTINCT c_name) FROM customer
        UNION ALL SELECT 'records/supplier_rec', count(*), count(DISTINCT s_name) FROM supplier
        UNION ALL SELECT 'records/order_rec', count(*), count(DISTINCT o_orderkey) FROM orders""",
)
def database(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "database")
    parts = _records(spark, sf)
    normalise.write_database(parts, normalise.entity_tables(normalise.all_mentions(parts.values())), folder, AT)
    made = normalise.stored_entities(spark, folder).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("ids")).select(
        F.concat(F.lit("entities/"), "entity").alias("written"), "n", "ids"
    )
    for type_key, key in (("customer_rec", "customer_name_id"), ("supplier_rec", "licensor_id"), ("order_rec", "contract_id_id")):
        rows = normalise.stored_records(spark, folder, type_key)
        made = made.unionByName(
            rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("ids")).select(
                F.lit(f"records/{type_key}").alias("written"), "n", "ids"
            )
        )
    return made


@check(
    "snk_06_rendered_documents",
    f"SELECT 'out/customer_' || c_custkey || '.md' AS out_path, md5({MARKDOWN}) AS content_hash FROM customer",
)
def rendered_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("out/customer_"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("path"),
        customer_record().alias("record"), F.col("c_name").alias("title"), customer_source().alias("source"),
    )
    made = sinks.rendered_manifest(rows, CUSTOMER_SHAPE)
    return made.select("out_path", F.md5("content").alias("content_hash"))


@check(
    "snk_07_index_lines",
    """WITH heads(line_no, line) AS (VALUES (1, '# Documents'), (2, ''), (3, '| Title | Nation Key | Is Active | File |'), (4, '| --- | --- | --- | --- |')),
            d AS (SELECT c_mktsegment AS folder, 'customer_' || lpad(c_custkey::VARCHAR, 9, '0') || '.md' AS file, c_name, c_nationkey, c_custkey FROM customer)
       SELECT folder, line_no::BIGINT AS line_no, line FROM (SELECT DISTINCT folder FROM d), heads
       UNION ALL SELECT folder, 4 + row_number() OVER (PARTITION BY folder ORDER BY file), '| ' || c_name || ' | ' || c_nationkey || ' | '
                 || CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END || ' | [' || file || '](' || file || ') |' FROM d""",
)
def index_lines(spark: SparkSession, sf: str) -> DataFrame:
    file = F.concat(F.lit("customer_"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(".md"))
    rows = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("folder"), file.alias("file"), F.col("c_name").alias("title"),
        F.col("c_nationkey").alias("nation_key"), (F.col("c_custkey") % 2 == 0).alias("is_active"),
    )
    return sinks.index_lines(rows, "folder", "title", "file", ["nation_key", "is_active"])


@check(
    "snk_07_index_rows_html",
    """SELECT page_id, '<tr><td>' || lang || '</td><td> ' || replace(url, '&', '&amp;') || '</td><td><a href="' || page_id || '.html">'
              || page_id || '.html</a></td></tr>' AS row
       FROM (SELECT page_id, url, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages)""",
)
def index_rows_html(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("title"),
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file"),
    )
    return sinks.index_rows_html(rows, "title", "file", ["url"]).select("page_id", "row")


class GivenAnswers:
    """A provider for texts that are answers already."""

    def native(self, text: Column, fields: Sequence[str]) -> Column:
        return text


@check(
    "set_02_keys_in_results",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status,
              CASE WHEN event_id % 5 <> 0 THEN array_to_string(list_sort(list_concat(
                CASE WHEN event_id % 2 = 1 THEN ['kind'] ELSE [] END, CASE WHEN event_id % 3 <> 0 THEN ['note'] ELSE ['tags'] END)),
                ', ') END AS missing,
              CASE WHEN event_id % 5 <> 0 THEN CASE event_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'tags' ELSE '' END END AS empty
       FROM events""",
)
def keys_in_results(spark: SparkSession, sf: str) -> DataFrame:
    """A job that reports missing and empty keys beside its records; every fifth answer cannot be read."""
    broken = F.when(F.col("event_id") % 5 == 0, F.lit("{")).otherwise(answer_text())
    events = table(spark, sf, "events").select("event_id", F.col("event_id").cast("string").alias("path"), broken.alias("text"))
    job = Job("event", EVENT_RECORD, GivenAnswers(), report_keys=True)
    return extraction.extract(events, job, doc_id="event_id").results.select(
        "event_id", "status", F.array_join("missing_keys", ", ").alias("missing"), F.array_join("empty_keys", ", ").alias("empty")
    )


@check(
    "snk_08_cache_append",
    f"""SELECT request_key, response_json FROM {CACHE}
        UNION ALL SELECT DISTINCT md5(text), '{{"fresh":true}}' FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM {CACHE} c WHERE c.request_key = md5(d.text))""",
)
def cache_append(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "cache")
    C.append(C.new_entries(_cache_rows(spark, sf), C.empty_cache(spark), AT), folder)
    asked = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("request_key"))
    fresh = asked.withColumn("response_json", F.lit('{"fresh":true}'))
    C.append(C.new_entries(fresh, staged(C.read_cache(spark, folder), "cache"), AT), folder)
    return C.read_cache(spark, folder).select("request_key", "response_json")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Supported documents to checked records, summed up per source."""
    supported = docs(spark, sf).where(X.has_supported_suffix(F.col("path")))
    results = extraction.extract(supported, _job()).results
    by_source = results.withColumn("source", X.parent(F.col("path")))
    found = [F.count(f"record.{n}").alias(f"with_{n}") for n in FIELDS]
    return summary.run_summary(by_source, ["source"], more=found)


check(
    "run_extraction_summary",
    rf"""SELECT source, count(*) AS total, count(*) AS success, 0::BIGINT AS failure, {', '.join(f'count({n}) AS with_{n}' for n in FIELDS)}
         FROM (SELECT source, {EXTRACTED} FROM {DOCS} WHERE lower(regexp_extract(path, '(\.[^.]+)$', 1)) IN ('.pdf', '.txt', '.text', '.md', '.rtf'))
         GROUP BY source""",
)(flagship)
