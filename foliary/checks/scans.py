"""Sources, projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary import schema as S
from foliary.checks.base import DOCS, check, docs, pick, pick_sql, quoted, table
from foliary.functions import text as X
from foliary.functions.encode import tagged_json
from foliary.operators import cache as C
from foliary.operators import columns, requests, summary
from foliary.operators.providers import DOCUMENT_RULES
from foliary.schema import field
from foliary.session import new_folder
from foliary.sinks import files as sinks
from foliary.sources import files as sources

DOCUMENT_RECORD = T.StructType([field(n) for n in DOCUMENT_RULES])
ORDER_RECORD = T.StructType([
    field("o_orderkey", "bigint", required=True), field("o_custkey", "bigint", required=True),
    field("o_orderstatus", enum=("O", "F", "P")), field("o_orderpriority"),
])


@check(
    "src_01_directory_scan",
    """SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, false AS at_top
       FROM documents WHERE doc_id % 3 <> 0 GROUP BY source
       UNION ALL SELECT 'top', CAST(sum(strlen(text) + 1) AS BIGINT), true FROM documents WHERE doc_id % 3 = 0""",
)
def directory_scan(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "crawl") + "/top folder"
    rows = table(spark, sf, "documents").select("doc_id", "source", "text")
    rows.where("doc_id % 3 = 0").select("text").write.text(folder)
    rows.where("doc_id % 3 <> 0").select("source", "text").write.mode("append").partitionBy("source").text(folder)
    by_source = F.coalesce(F.nullif(F.regexp_extract("path", r"/source=([^/]+)/", 1), F.lit("")), F.lit("top"))
    deep = sources.scan_documents(spark, folder, recurse=True).groupBy(by_source.alias("source")).agg(
        F.sum("length").alias("bytes")
    )
    flat = sources.scan_documents(spark, folder).groupBy(by_source.alias("found")).agg(F.sum("length").alias("top_bytes"))
    same = (deep["source"] == flat["found"]) & (deep["bytes"] == flat["top_bytes"])
    return deep.join(flat, same, "left").select("source", "bytes", F.col("found").isNotNull().alias("at_top"))


@check(
    "src_02_suffix_filter",
    rf"""SELECT doc_id, path, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS suffix FROM {DOCS}
         WHERE lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) IN ('.pdf', '.txt', '.text', '.md', '.rtf')""",
)
def suffix_filter(spark: SparkSession, sf: str) -> DataFrame:
    return (
        docs(spark, sf).where(X.has_supported_suffix(F.col("path")))
        .select("doc_id", "path", X.suffix(F.col("path")).alias("suffix"))
    )


@check(
    "src_03_empty_source_failure",
    rf"""SELECT 'archive' AS path, CAST(NULL AS BIGINT) AS n_chars, 'failed' AS status,
                'No supported input files found in archive' AS error_message
         WHERE NOT EXISTS (SELECT 1 FROM {DOCS} WHERE path LIKE '%.zip')""",
)
def empty_source(spark: SparkSession, sf: str) -> DataFrame:
    found = docs(spark, sf).where(X.suffix(F.col("path")) == ".zip").select("path", "n_chars")
    return summary.or_failure_row(found, "archive", "No supported input files found in archive")


@check("src_04_text_table_encodings", "SELECT conv_id, turn, role, text FROM conversations")
def text_table(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "tables")
    rows = table(spark, sf, "conversations")
    western = F.col("text").rlike(r"\A[\n\x20-\x7e\x{a0}-\x{ff}]*\z") & (F.col("conv_id") % 2 == 0)
    for name, part, encoding in (("old", rows.where(western), "iso-8859-1"), ("new", rows.where(~western), "utf-8")):
        part.write.option("header", True).option("quote", '"').option("escape", '"').option("encoding", encoding).csv(
            f"{folder}/kind={name}"
        )
    return sources.read_text_table(spark, folder + "/*", "conv_id bigint, turn bigint, role string, text string")


@check(
    "src_05_record_directory",
    "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, '' AS errors FROM supplier",
)
def record_directory(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "records")
    record = T.StructType([
        field("s_suppkey", "bigint", required=True), field("s_name", required=True), field("s_nationkey", "bigint"),
    ])
    rows = table(spark, sf, "supplier").select(
        F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("out_path"),
        tagged_json(F.lit("supplier"), F.struct("s_suppkey", "s_name", "s_nationkey"), record).alias("content"),
    )
    sinks.write_files(rows, folder)
    read = sources.parsed_records(sources.read_records(spark, folder), record)
    return read.select("record.*", F.array_join("errors", "; ").alias("errors"))


@check(
    "src_06_content_typing",
    """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'document' ELSE 'text' END AS part_type,
              md5(CASE WHEN doc_id % 6 = 0 THEN base64(encode('%PDF' || text || chr(65533)))
                       ELSE text || chr(65533) END)
              AS part_hash
       FROM documents""",
)
def content_typing(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat("text", F.lit("\ufffd")).cast("binary")
    content = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("%PDF").cast("binary"), body)).when(
        F.col("doc_id") % 6 == 1, F.concat(F.unhex(F.lit("FF")), body, F.unhex(F.lit("C3")))
    ).otherwise(body)
    part = table(spark, sf, "documents").select("doc_id", requests.content_part(content).alias("p"))
    return part.select("doc_id", F.col("p.type").alias("part_type"), F.md5("p.text").alias("part_hash"))


@check(
    "src_07_content_memo",
    """SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY text) AS uploaded_as,
              count(*) OVER (PARTITION BY text) AS copies, 'file-' || sha256(text) AS file_ref
       FROM documents""",
)
def content_memo(spark: SparkSession, sf: str) -> DataFrame:
    return requests.uploads(table(spark, sf, "documents"), "doc_id", "text")


def _cache_rows(spark: SparkSession, sf: str) -> DataFrame:
    """English documents and the benchmark texts, as already answered requests."""
    known = (
        table(spark, sf, "documents").where("lang = 'en'").select("text")
        .unionByName(table(spark, sf, "benchmark").select("text"))
    )
    answer = F.concat(F.lit('{"length":'), F.length("text").cast("string"), F.lit("}"))
    return known.select(F.md5("text").alias("request_key"), answer.alias("response_json"))


CACHE = """(SELECT DISTINCT md5(text) AS request_key, '{"length":' || length(text) || '}' AS response_json
            FROM (SELECT text FROM documents WHERE lang = 'en' UNION ALL SELECT text FROM benchmark))"""


@check(
    "src_08_cache_scan",
    f"""SELECT request_key, response_json, '2024-01-01 00:00:00' AS created_at, substr(request_key, 1, 2) AS prefix
        FROM {CACHE}""",
)
def cache_scan(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "cache")
    rows = _cache_rows(spark, sf)
    C.append(C.new_entries(rows, C.empty_cache(spark), "2024-01-01 00:00:00"), folder)
    return C.read_cache(spark, folder).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


# -- projections ------------------------------------------------------------------


@check(
    "prj_01_blank_rows_pass_through",
    "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE md5(text) END AS output FROM documents",
)
def blank_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 20 == 0, F.lit(None)).when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text"))
        .alias("text"),
    )
    return rows.select("doc_id", columns.passed_through(F.col("text"), F.md5("text")).alias("output"))


@check(
    "prj_02_output_columns",
    "SELECT doc_id, lang, '' AS x_email, '' AS x_phone, '' AS x_ip_address, '' AS x_license FROM documents",
)
def output_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    return columns.with_output_columns(rows, DOCUMENT_RECORD.fieldNames(), "x_")


@check(
    "prj_03_lineage_columns",
    f"""SELECT doc_id, lang, path AS source_filename, '2024-05-01 10:00:00' AS analyzed_at, 'rules-1' AS llm_model
        FROM {DOCS}""",
)
def lineage_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).select("doc_id", "lang", "path", F.lit("old").alias("llm_model"))
    asked = columns.without_lineage(rows)
    done = columns.with_lineage_columns(asked, F.col("path"), "2024-05-01 10:00:00", "rules-1").drop("path")
    return done.withColumn("analyzed_at", F.date_format("analyzed_at", "yyyy-MM-dd HH:mm:ss"))


@check(
    "prj_04_part_projection",
    """SELECT o_orderkey, to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey})::VARCHAR AS part_1,
              to_json({'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority})::VARCHAR AS part_2
       FROM orders""",
)
def part_projection(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        F.to_json(F.struct(*part.fieldNames())).alias(f"part_{i}") for i, part in enumerate(S.parts(ORDER_RECORD, 2), 1)
    ]
    return table(spark, sf, "orders").select("o_orderkey", *parts)


@check(
    "prj_05_request_text",
    f"SELECT doc_id, md5({quoted(requests.instruction(DOCUMENT_RECORD))} || chr(10) || text) AS request_hash FROM documents",
)
def request_text(spark: SparkSession, sf: str) -> DataFrame:
    body = requests.request_text(requests.instruction(DOCUMENT_RECORD), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(body).alias("request_hash"))


@check(
    "prj_06_extra_instruction",
    """SELECT conv_id, turn, CAST(CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_parts,
              md5(text || CASE WHEN turn % 2 = 0 THEN '|Answer in ' || role ELSE '' END) AS parts_hash
       FROM conversations""",
)
def extra_instruction(spark: SparkSession, sf: str) -> DataFrame:
    extra = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Answer in "), "role")).when(F.col("turn") % 3 == 0, F.lit(""))
    parts = requests.with_extra(F.array(requests.text_part(F.col("text"))), extra)
    rows = table(spark, sf, "conversations").withColumn("parts", parts)
    return rows.select(
        "conv_id", "turn", F.size("parts").cast("long").alias("n_parts"),
        F.md5(F.array_join(F.transform("parts", lambda p: p["text"]), "|")).alias("parts_hash"),
    )


_OPTIONS = """
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'anthropic' END AS provider,
         CASE event_id % 4 WHEN 0 THEN 'o3' WHEN 1 THEN 'o4-mini' WHEN 2 THEN 'gpt-4.1' END AS model,
         CASE WHEN event_id % 5 = 0 THEN event_type END AS small_model,
         CASE WHEN event_id % 2 = 0 THEN 0.5 END AS temperature,
         CASE WHEN event_id % 7 < 3 THEN 1000 + user_id END AS max_tokens
  FROM events"""


@check(
    "prj_07_option_defaults",
    f"""WITH r AS ({_OPTIONS}),
             p AS (SELECT *, lower(coalesce(provider, 'anthropic')) AS p FROM r),
             m AS (SELECT *, coalesce(model, CASE WHEN p = 'openai' THEN 'gpt-4.1' ELSE 'claude-sonnet-4-20250514' END) AS m
                   FROM p)
        SELECT event_id, p AS provider, m AS model, coalesce(small_model, m) AS small_model,
               CASE WHEN p = 'openai' AND m IN ('o4-mini', 'o3', 'o1', 'o1-pro') THEN 1.0::DOUBLE
                    ELSE coalesce(temperature, 0.0)::DOUBLE END AS temperature,
               coalesce(max_tokens, 2048)::BIGINT AS max_tokens FROM m""",
)
def option_defaults(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(n % 3 == 0, "OpenAI").when(n % 3 == 1, "anthropic").alias("provider"),
        F.when(n % 4 == 0, "o3").when(n % 4 == 1, "o4-mini").when(n % 4 == 2, "gpt-4.1").alias("model"),
        F.when(n % 5 == 0, F.col("event_type")).alias("small_model"),
        F.when(n % 2 == 0, F.lit(0.5)).alias("temperature"),
        F.when(n % 7 < 3, F.lit(1000) + F.col("user_id")).alias("max_tokens"),
    )
    return requests.with_option_defaults(rows)


_PROVIDERS = ("Claude", "OPENAI", "anthropic")


@check(
    "prj_08_provider_routing",
    f"""WITH r AS (SELECT event_id, CASE WHEN event_id % 4 = 3 THEN event_type
                          ELSE {pick_sql('event_id', _PROVIDERS)} END AS p FROM events)
        SELECT event_id, CASE lower(p) WHEN 'claude' THEN 'anthropic' WHEN 'anthropic' THEN 'anthropic'
                              WHEN 'openai' THEN 'openai' END AS route,
               CASE WHEN lower(p) NOT IN ('claude', 'anthropic', 'openai')
                    THEN 'Unknown provider ''' || lower(p) || '''' END AS error FROM r""",
)
def provider_routing(spark: SparkSession, sf: str) -> DataFrame:
    provider = F.when(F.col("event_id") % 4 == 3, F.col("event_type")).otherwise(pick(F.col("event_id"), _PROVIDERS))
    route, error = requests.routed(F.col("provider"))
    rows = table(spark, sf, "events").select("event_id", provider.alias("provider"))
    return rows.select("event_id", route.alias("route"), error.alias("error"))


@check(
    "prj_09_message_lists",
    """WITH k AS (SELECT conv_id, turn, text,
                         CASE WHEN conv_id % 4 = 0 AND turn % 3 = 1 THEN 'document' ELSE 'string' END AS kind
                  FROM conversations
                  UNION ALL SELECT -1 - user_id % 7, event_id, props, 'string' FROM events),
            m AS (SELECT *, bool_or(kind <> 'string') OVER (PARTITION BY conv_id) AS mixed FROM k)
       SELECT conv_id, turn AS seq, CASE WHEN kind = 'document' THEN 'document' ELSE 'text' END AS type, text
       FROM m WHERE mixed
       UNION ALL
       SELECT conv_id, 0 AS seq, 'text', string_agg(text, chr(10) ORDER BY turn) FROM m
       WHERE NOT mixed GROUP BY conv_id""",
)
def message_lists(spark: SparkSession, sf: str) -> DataFrame:
    return requests.normalised_messages(_messages(spark, sf), "conv_id", "turn", "kind", "text")


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") % 3 == 1), "document").otherwise("string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text", kind.alias("kind"))
    lists = table(spark, sf, "events").select(
        (-1 - F.col("user_id") % 7).alias("conv_id"), F.col("event_id").alias("turn"), F.col("props").alias("text"),
        F.lit("string").alias("kind"),
    )
    return rows.unionByName(lists)


@check(
    "prj_09_message_pieces",
    """WITH k AS (SELECT conv_id, turn, text,
                         CASE WHEN conv_id % 4 = 0 AND turn % 3 = 1 THEN 'document' ELSE 'string' END AS kind
                  FROM conversations
                  UNION ALL SELECT -1 - user_id % 7, event_id, props, 'string' FROM events),
            m AS (SELECT *, bool_or(kind <> 'string') OVER (PARTITION BY conv_id) AS mixed FROM k),
            p AS (SELECT conv_id, CASE WHEN mixed THEN turn ELSE 0 END AS seq,
                         CASE WHEN kind = 'document' THEN 'document' ELSE 'text' END AS type, turn, text FROM m),
            n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, seq, type ORDER BY turn, text) AS n FROM p)
       SELECT conv_id, seq, type, ((n - 1) // 1024)::BIGINT AS piece, string_agg(text, chr(10) ORDER BY n) AS text
       FROM n GROUP BY ALL""",
)
def message_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The same lists in pieces of 1024 items, so that a list of a seventh of all events meets no single task."""
    return requests.message_pieces(_messages(spark, sf), "conv_id", "turn", "kind", "text")


@check(
    "prj_10_path_parts",
    f"""SELECT path, 'archive/' || path AS full_path, source AS parent, 'doc_' || doc_id AS stem,
               CASE WHEN source LIKE '%1%' THEN path END AS relative FROM {DOCS}""",
)
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    root = F.when(F.contains("source", F.lit("1")), "archive").otherwise("elsewhere")
    rows = docs(spark, sf).select("path", F.concat_ws("/", F.lit("archive"), "path").alias("full_path"),
                                  F.concat_ws("/", root, "path").alias("located"))
    return rows.select(
        "path", "full_path", X.parent(F.col("path")).alias("parent"), X.stem(F.col("path")).alias("stem"),
        X.relative_to(F.col("located"), "archive/").alias("relative"),
    )
