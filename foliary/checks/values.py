"""Scalar functions: hashing, answers, dates, names, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.checks.base import SPACE_SQL, check, strip_sql, table
from foliary.checks.relations import (
    BROKEN, FACTS, TAGGED, URL_PATH, answer_text, broken_props, facts, url_path,
)
from foliary.functions import answers as A
from foliary.functions import dates as D
from foliary.functions import encode, render
from foliary.functions import text as X
from foliary.operators import entities, requests
from foliary.schema import field

AS_OF = 2026
EVENT_RECORD = T.StructType([
    field("kind", default="unknown"), field("note"), field("tags", "array<string>"), field("k", "bigint", required=True),
])


@check(
    "fn_01_request_key",
    """SELECT doc_id, md5(concat_ws('||', 'anthropic:' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'm' || lang END, 'system text',
              sha256(text), '2048', CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE source END)) AS request_key FROM documents""",
)
def request_key(spark: SparkSession, sf: str) -> DataFrame:
    key = requests.request_key(
        F.lit("anthropic"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("m"), "lang")), F.lit("system text"),
        F.sha2("text", 256), F.lit(2048), F.when(F.col("doc_id") % 2 != 0, F.col("source")),
    )
    return table(spark, sf, "documents").select("doc_id", key.alias("request_key"))


@check(
    "fn_02_code_fence",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'see ```' || props || '```' ELSE props END AS answer FROM events""",
)
def code_fence(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id") % 4
    wrapped = (
        F.when(n == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(n == 1, F.concat(F.lit("  \n```"), "props", F.lit("```\n")))
        .when(n == 2, F.concat(F.lit(" "), "props", F.lit("\t")))
        .otherwise(F.concat(F.lit("see ```"), "props", F.lit("```")))
    )
    rows = table(spark, sf, "events").select("event_id", wrapped.alias("wrapped"))
    return rows.select("event_id", A.without_fence(F.col("wrapped")).alias("answer"))


@check(
    "fn_03_parse_object",
    f"""SELECT event_id, json_valid(p) AS parsed, CASE WHEN json_valid(p) THEN (p->>'$.k')::BIGINT END AS k
        FROM (SELECT event_id, {BROKEN} AS p FROM events)""",
)
def parse_object(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", A.raw_fields(broken_props()).alias("raw"))
    return rows.select(
        "event_id", F.col("raw").isNotNull().alias("parsed"), A.relaxed_value(F.col("raw")["k"], T.LongType()).alias("k")
    )


@check(
    "fn_04_blank_to_null",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS in_struct,
              CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '-' END || ',' || p_type AS in_array,
              CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE p_type END AS in_map FROM part""",
)
def blank_to_null(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    shape = T.DataType.fromDDL("struct<name:string,deep:struct<tags:array<string>,more:map<string,string>>>")
    value = F.struct(
        F.when(key % 3 == 0, " \n").otherwise(F.col("p_name")).alias("name"),
        F.struct(
            F.array(F.when(key % 2 == 0, F.col("p_brand")).otherwise(""), F.col("p_type")).alias("tags"),
            F.create_map(F.lit("type"), F.when(key % 5 == 0, "\t").otherwise(F.col("p_type"))).alias("more"),
        ).alias("deep"),
    )
    rows = table(spark, sf, "part").select("p_partkey", value.alias("v"))
    clean = rows.select("p_partkey", A.scrubbed(F.col("v"), shape).alias("v"))
    return clean.select(
        "p_partkey", F.col("v.name").alias("in_struct"), F.array_join("v.deep.tags", ",", "-").alias("in_array"),
        F.coalesce(F.col("v.deep.more")["type"], F.lit("-")).alias("in_map"),
    )


@check(
    "fn_05_relaxed_parse",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'unknown' END AS kind, CAST(NULL AS VARCHAR) AS note,
              CAST(CASE event_id % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS BIGINT) AS n_tags, user_id AS k FROM events""",
)
def relaxed_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", A.raw_fields(answer_text()).alias("raw"))
    rows = rows.withColumn("r", A.relaxed(F.col("raw"), EVENT_RECORD))
    return rows.select("event_id", "r.kind", "r.note", F.size("r.tags").cast("long").alias("n_tags"), "r.k").withColumn(
        "n_tags", F.when(F.col("n_tags") >= 0, F.col("n_tags"))
    )


ORDER_ANSWER = T.StructType([
    field("status", enum=("O", "F"), required=True), field("priority", required=True), field("customer", "bigint"),
    field("ordered", "date", required=True),
])


@check(
    "fn_06_strict_validation",
    """SELECT o_orderkey, concat_ws('; ',
         CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status: enum' END,
         CASE o_orderkey % 4 WHEN 0 THEN 'priority: missing' WHEN 1 THEN 'priority: null' WHEN 2 THEN 'priority: type' END,
         CASE WHEN o_orderkey % 5 = 0 THEN 'customer: type' END,
         CASE WHEN o_orderkey % 3 = 0 THEN 'ordered: type' END) AS errors FROM orders""",
)
def strict_validation(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit('{"status": "'), "o_orderstatus", F.lit('", '),
        F.when(key % 4 == 0, "").when(key % 4 == 1, '"priority": " ", ')
        .when(key % 8 == 2, '"priority": 5, ').when(key % 8 == 6, '"priority": {"a": ["b"]}, ').otherwise('"priority": "high", '),
        F.lit('"customer": '), F.when(key % 5 == 0, '"many"').otherwise(F.col("o_custkey").cast("string")),
        F.lit(', "ordered": "'),
        F.when(key % 3 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.lit('", "extra": {"x": 1}}'),
    )
    given = table(spark, sf, "orders").select("o_orderkey", text.alias("answer"))
    rows = given.select("o_orderkey", A.raw_fields(F.col("answer")).alias("raw"))
    rows = rows.withColumn("r", A.relaxed(F.col("raw"), ORDER_ANSWER))
    errors = A.strict_errors(F.col("raw"), F.col("r"), ORDER_ANSWER)
    return rows.select("o_orderkey", F.array_join(errors, "; ").alias("errors"))


ADDRESS = T.StructType([
    field("street", required=True), field("kind", enum=("home", "work"), default="home"), field("floor", "bigint"),
])
NESTED_ANSWER = T.StructType([
    field("buyer", T.StructType([field("name", required=True), field("at", ADDRESS, required=True)]), required=True),
    field("lines", T.ArrayType(T.StructType([field("item", "bigint", required=True), field("note"), field("paid", "boolean", default=True)])),
          required=True),
    field("marks", "array<string>", enum=("O", "F", "P")),
])


@check(
    "fn_06_nested_records",
    """SELECT o_orderkey, concat_ws('; ',
         CASE WHEN o_orderkey % 3 = 0 THEN 'buyer.name: missing' END,
         CASE o_orderkey % 5 WHEN 0 THEN 'buyer.at: type' WHEN 1 THEN 'buyer.at.street: null' WHEN 2 THEN 'buyer.at.kind: enum'
              WHEN 3 THEN 'buyer.at.floor: type' END,
         CASE o_orderkey % 4 WHEN 0 THEN 'lines[1].item: missing' WHEN 1 THEN 'lines[0].item: type; lines[1].note: type'
              WHEN 2 THEN 'lines: null' END,
         CASE WHEN o_orderkey % 7 = 0 THEN 'marks[1]: type' WHEN o_orderkey % 7 = 1 THEN 'marks[0]: enum' END) AS errors,
         CASE o_orderkey % 5 WHEN 1 THEN 'home' WHEN 2 THEN 'moon' WHEN 3 THEN 'work' WHEN 4 THEN 'home' END AS kind,
         CASE WHEN o_orderkey % 4 <> 2 THEN 1 + (o_orderkey % 2) END AS n_paid
       FROM orders""",
)
def nested_records(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    customer = F.col("o_custkey").cast("string")
    at = (
        F.when(key % 5 == 0, '"a street"').when(key % 5 == 1, '{"street": " "}').when(key % 5 == 2, '{"street": "s", "kind": "moon"}')
        .when(key % 5 == 3, '{"street": "s", "kind": "work", "floor": "top"}').otherwise('{"street": "s", "floor": "3"}')
    )
    lines = (
        F.when(key % 4 == 0, F.concat(F.lit('[{"item": '), customer, F.lit('}, {"paid": false}]')))
        .when(key % 4 == 1, '[{"item": "many"}, {"item": 1, "note": 7}]').when(key % 4 == 2, "null")
        .otherwise(F.concat(F.lit('[{"item": "'), customer, F.lit('"}, {"item": 2, "paid": "on"}]')))
    )
    marks = F.when(key % 7 == 0, '["O", 5]').when(key % 7 == 1, '["X"]').otherwise(F.concat(F.lit('["'), "o_orderstatus", F.lit('"]')))
    name = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit('"name": "'), customer, F.lit('", ')))
    text = F.concat(
        F.lit('{"buyer": {'), name, F.lit('"at": '), at, F.lit('}, "lines": '), lines, F.lit(', "marks": '), marks, F.lit("}")
    )
    given = table(spark, sf, "orders").select("o_orderkey", text.alias("answer"))
    rows = given.select("o_orderkey", A.raw_fields(F.col("answer")).alias("raw"))
    rows = rows.withColumn("r", A.relaxed(F.col("raw"), NESTED_ANSWER))
    paid = F.size(F.filter("r.lines", lambda x: x["paid"]))
    return rows.select(
        "o_orderkey", F.array_join(A.strict_errors(F.col("raw"), F.col("r"), NESTED_ANSWER), "; ").alias("errors"),
        F.col("r.buyer.at.kind").alias("kind"), F.when(paid >= 0, paid).cast("long").alias("n_paid"),
    )


@check(
    "fn_07_up_cast",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS ordered,
              CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS customer,
              CASE WHEN o_orderkey % 2 = 0 THEN 'comment, o_custkey' ELSE '' END AS unknown FROM orders""",
)
def up_cast(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit('{"status": "O", "customer": "'), F.when(key % 5 == 0, "1.5").otherwise(F.col("o_custkey").cast("string")),
        F.lit('", '), F.when(key % 2 == 0, '"o_custkey": 1, "comment": null, ').otherwise(""), F.lit('"ordered": "'),
        F.when(key % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.lit('"}'),
    )
    rows = table(spark, sf, "orders").select("o_orderkey", A.raw_fields(text).alias("raw"))
    rows = rows.withColumn("r", A.relaxed(F.col("raw"), ORDER_ANSWER))
    return rows.select(
        "o_orderkey", F.col("r.ordered").cast("string").alias("ordered"), "r.customer",
        F.array_join(A.unknown_keys(F.col("raw"), ORDER_ANSWER), ", ").alias("unknown"),
    )


@check(
    "fn_08_emptiness",
    """SELECT conv_id, turn, turn % 4 IN (0, 1, 2) AS text_empty, turn % 2 = 0 AS list_empty, turn % 3 = 0 AS map_empty
       FROM conversations""",
)
def emptiness(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("turn")
    text = F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, "").when(n % 4 == 2, " \n\t ").otherwise(F.col("text"))
    items = F.when(n % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("role"))
    pairs = F.when(n % 3 != 0, F.create_map("role", "text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", text.alias("t"), items.alias("l"), pairs.alias("m"))
    return rows.select(
        "conv_id", "turn", X.is_empty(F.col("t")).alias("text_empty"),
        X.is_empty(F.col("l"), "collection").alias("list_empty"), X.is_empty(F.col("m"), "collection").alias("map_empty"),
    )


@check(
    "fn_09_iso_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
              CASE WHEN event_id % 2 = 0 THEN '' ELSE CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END END
              AS at, strftime(ts, '%Y-%m-%d') AS day FROM events""",
)
def iso_text(spark: SparkSession, sf: str) -> DataFrame:
    at = F.when(F.col("event_id") % 2 == 0, F.date_trunc("second", "ts").cast("timestamp_ntz")).otherwise(F.col("ts"))
    rows = table(spark, sf, "events").select("event_id", at.alias("at"), F.to_date("ts").alias("day"))
    return rows.select("event_id", D.iso_text(F.col("at"), True).alias("at"), D.iso_text(F.col("day"), False).alias("day"))


@check(
    "fn_10_tagged_json",
    """SELECT o_orderkey, 'order_rec' AS tag, '{"record_type":"order_rec",' AS head, o_orderstatus AS status,
              strftime(o_orderdate, '%Y-%m-%d') AS ordered, 'null' AS comment FROM orders""",
)
def tagged_json(spark: SparkSession, sf: str) -> DataFrame:
    record = F.struct(
        "o_orderstatus", F.to_date("o_orderdate").alias("ordered"), F.lit(None).cast("string").alias("comment")
    )
    shape = T.StructType([field("o_orderstatus"), field("ordered", "date"), field("comment")])
    rows = table(spark, sf, "orders").select("o_orderkey", record.alias("r"))
    rows = rows.select("o_orderkey", encode.tagged_json(F.lit("order_rec"), F.col("r"), shape).alias("j"))
    return rows.select(
        "o_orderkey", F.get_json_object("j", "$.record_type").alias("tag"), F.substring("j", 1, 27).alias("head"),
        F.get_json_object("j", "$.o_orderstatus").alias("status"), F.get_json_object("j", "$.ordered").alias("ordered"),
        F.regexp_extract("j", r'"comment":(\w+)', 1).alias("comment"),
    )


@check(
    "fn_11_table_cells",
    """SELECT vec_id, '[' || label || ',' || vec_id || ']' AS list_cell, '{"label":' || label || '}' AS struct_cell,
              CASE WHEN label % 2 = 0 THEN '' ELSE label::VARCHAR END AS plain_cell,
              CAST(len(embedding) AS BIGINT) AS embedding_items FROM embeddings""",
)
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.when(F.col("label") % 2 != 0, F.col("label"))
    rows = table(spark, sf, "embeddings").withColumns(
        {"items": F.array("label", "vec_id"), "nested": F.struct("label"), "plain": plain}
    )
    text = {n: encode.cell(F.col(n), rows.schema[n].dataType) for n in ("items", "nested", "plain", "embedding")}
    back = F.size(F.from_json(text["embedding"], "array<float>")).cast("long")
    return rows.select(
        "vec_id", text["items"].alias("list_cell"), text["nested"].alias("struct_cell"), text["plain"].alias("plain_cell"),
        back.alias("embedding_items"),
    )


@check(
    "fn_12_written_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
              CASE WHEN o_orderkey % 5 = 4 THEN 'in ' || strftime(o_orderdate, '%Y') END AS left_as_text FROM orders""",
)
def written_dates(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey") % 5
    text = (
        F.when(n == 0, F.concat(F.date_format("o_orderdate", "MMMM d"), F.lit("th, "), F.date_format("o_orderdate", "yyyy")))
        .when(n == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(n == 2, F.date_format("o_orderdate", "M/d/yyyy"))
        .when(n == 3, F.concat(F.date_format("o_orderdate", "d"), F.lit("rd day of "), F.date_format("o_orderdate", "MMMM yyyy")))
        .otherwise(F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy")))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t")).withColumn("d", D.written_date(F.col("t")))
    return rows.select(
        "o_orderkey", F.col("d").cast("string").alias("day"), F.when(F.col("d").isNull(), F.col("t")).alias("left_as_text")
    )


def _year_window(mode: str) -> str:
    """Four-digit year of the two-digit year ``y``."""
    if mode == "window":
        return f"CASE WHEN y <= {AS_OF % 100 + 10} THEN 2000 + y ELSE 1900 + y END"
    return f"(CASE WHEN y < 69 THEN 2000 + y ELSE 1900 + y END) - (CASE WHEN y > {AS_OF % 100 + 10} THEN 100 ELSE 0 END)"


_SHIFTED = "(o_orderkey * 37) % 100"


def _shifted() -> Column:
    return F.lpad(((F.col("o_orderkey") * 37) % 100).cast("string"), 2, "0")


@check(
    "fn_13_month_year",
    f"""WITH r AS (SELECT o_orderkey, {_SHIFTED} AS y, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%Y') AS y4 FROM orders)
        SELECT o_orderkey,
          CASE o_orderkey % 3 WHEN 0 THEN ({_year_window('window')}) || '-' || m || '-01' WHEN 1 THEN y4 || '-' || m || '-01' END AS day,
          CASE o_orderkey % 3 WHEN 0 THEN ({_year_window('reference')}) || '-' || m || '-01' WHEN 1 THEN y4 || '-' || m || '-01' END
          AS day_by_old_rule FROM r""",
)
def month_year(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey") % 3
    text = (
        F.when(n == 0, F.concat_ws("/", F.date_format("o_orderdate", "MM"), _shifted()))
        .when(n == 1, F.date_format("o_orderdate", " M/yyyy "))
        .otherwise(F.concat(F.lit("13/"), _shifted()))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    return rows.select(
        "o_orderkey", D.month_year(F.col("t"), AS_OF).cast("string").alias("day"),
        D.month_year(F.col("t"), AS_OF, "reference").cast("string").alias("day_by_old_rule"),
    )


@check(
    "fn_14_full_dates",
    f"""WITH r AS (SELECT o_orderkey, {_SHIFTED} AS y, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%d') AS d,
                          strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders),
             s AS (SELECT *, {_year_window('window')} AS w, {_year_window('reference')} AS o FROM r)
        SELECT o_orderkey,
          CASE o_orderkey % 4 WHEN 0 THEN strftime(TRY_CAST(w || '-' || m || '-' || d AS DATE), '%Y-%m-%d') WHEN 3 THEN NULL ELSE iso END AS day,
          CASE o_orderkey % 4 WHEN 0 THEN strftime(TRY_CAST(o || '-' || m || '-' || d AS DATE), '%Y-%m-%d') WHEN 3 THEN NULL ELSE iso END
          AS day_by_old_rule FROM s""",
)
def full_dates(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey") % 4
    text = (
        F.when(n == 0, F.concat_ws("/", F.date_format("o_orderdate", "M/d"), _shifted()))
        .when(n == 1, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(n == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "MM/dd"))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    return rows.select(
        "o_orderkey", D.full_date(F.col("t"), AS_OF).cast("string").alias("day"),
        D.full_date(F.col("t"), AS_OF, "reference").cast("string").alias("day_by_old_rule"),
    )


@check(
    "fn_15_years_in_text",
    """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN 1800 + o_orderkey % 200
                         WHEN 2 THEN year(o_orderdate) END AS y FROM orders)
       SELECT o_orderkey, CASE WHEN y > 1900 AND y < 2100 THEN y::BIGINT END AS year FROM r""",
)
def years_in_text(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("105,000 ("), F.date_format("o_orderdate", "yyyy"), F.lit(")")))
        .when(key % 4 == 1, (1800 + key % 200).cast("string"))
        .when(key % 4 == 2, F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy"), F.lit("\n")))
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit(" or so")))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", D.year_in_text(F.col("t")).cast("long").alias("year"))


@check(
    "fn_16_entity_tagging",
    f"""SELECT f.type_key, f.record_id, f.field, t.entity, {strip_sql('f.value')} AS name
        FROM {FACTS} f JOIN {TAGGED} t ON t.type_key = f.type_key AND t.field = f.field""",
)
def entity_tagging(spark: SparkSession, sf: str) -> DataFrame:
    return entities.tagged_facts(facts(spark, sf), ["record_id"]).select("type_key", "record_id", "field", "entity", "name")


_FIRST_LINE = "regexp_extract(text, '\\A([^\\n]*)', 1)"
_SLUG = rf"""substr(regexp_replace(lower(regexp_replace(
    CASE WHEN doc_id % 2 = 0 THEN '2024-05-0' || (doc_id % 9 + 1) || '_' ELSE '' END ||
    CASE WHEN doc_id % 13 = 1 THEN '!!!' ELSE {_FIRST_LINE} END, '[^0-9a-zA-Z_-]+', '_', 'g')), '\A_+|_+\z', '', 'g'), 1, 60)"""
SLUG = f"CASE WHEN {_SLUG} = '' THEN 'document' ELSE {_SLUG} END"


def slug() -> Column:
    day = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2024-05-0"), (F.col("doc_id") % 9 + 1).cast("string")))
    first = F.when(F.col("doc_id") % 13 == 1, "!!!").otherwise(F.regexp_extract("text", r"\A([^\n]*)", 1))
    return X.clean_file_stem(first, day)


@check("fn_17_file_stem", f"SELECT doc_id, {SLUG} AS stem FROM documents")
def file_stem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", slug().alias("stem"))


@check(
    "fn_18_file_stem_contract",
    rf"""SELECT doc_id, regexp_matches(CASE WHEN doc_id % 5 = 0 THEN {SLUG} || chr(10) ELSE {SLUG} END,
                '\A[0-9a-zA-Z_]{{1,60}}\z') AS valid FROM documents""",
)
def file_stem_contract(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").withColumn("stem", slug())
    given = F.when(F.col("doc_id") % 5 == 0, F.concat("stem", F.lit("\n"))).otherwise(F.col("stem"))
    return rows.select("doc_id", X.is_valid_file_stem(given).alias("valid"))


@check(
    "fn_19_ancestry_folder",
    """SELECT s_suppkey, CASE WHEN r_name LIKE '%S' OR r_name LIKE '%s' THEN CASE WHEN ends_with(r_name, 's') THEN r_name
              ELSE r_name || 's' END ELSE r_name || 's' END || '/' || n_name || 's/Suppliers' AS folder
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def ancestry_folder(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = (
        table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.select("s_suppkey", X.folder_path(F.array("r_name", "n_name", F.lit("Suppliers"))).alias("folder"))


@check(
    "fn_20_selection_path_text",
    f"""SELECT page_id, array_to_string({URL_PATH}, ' -> ') AS path_text, CAST(len({URL_PATH}) AS BIGINT) AS levels,
               list_extract({URL_PATH}, -1) AS leaf FROM pages""",
)
def selection_path_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", X.join_path(url_path()).alias("path_text"))
    again = X.split_path(F.col("path_text"))
    return rows.select(
        "page_id", "path_text", F.size(again).cast("long").alias("levels"), F.element_at(again, -1).alias("leaf")
    )


CUSTOMER_SHAPE = T.StructType([
    field("customer_name"), field("market_segment"), field("nation_key", "bigint"), field("is_active", "boolean"),
    field("notes"), field("tags", "array<string>"), T.StructField("contact", T.StructType([field("e_mail"), field("note")])),
])


def customer_record() -> Column:
    key = F.col("c_custkey").cast("string")
    return F.struct(
        F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("market_segment"),
        F.col("c_nationkey").cast("long").alias("nation_key"), (F.col("c_custkey") % 2 == 0).alias("is_active"),
        F.lit(None).cast("string").alias("notes"), F.array("c_mktsegment", F.lit("a & b")).alias("tags"),
        F.struct(F.concat(F.lit("c"), key, F.lit("@x.example")).alias("e_mail"), F.lit("<b>'hi'</b>").alias("note")).alias("contact"),
    )


def customer_source() -> Column:
    return F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("in/"), F.col("c_custkey").cast("string"), F.lit(".pdf")))


MARKDOWN = """'# ' || c_name || chr(10) || chr(10) || CASE WHEN c_custkey % 3 <> 0 THEN '[Source PDF](in/' || c_custkey || '.pdf)'
  || chr(10) || chr(10) ELSE '' END || array_to_string(['- **Customer Name:**', '  ' || c_name, '- **Market Segment:**', '  ' || c_mktsegment,
  '- **Nation Key:**', '  ' || c_nationkey, '- **Is Active:**', CASE WHEN c_custkey % 2 = 0 THEN '  True' ELSE '  False' END,
  '- **Notes:**', '  None', '- **Tags:**', '  - ' || c_mktsegment, '  - a & b', '- **Contact:**', '  - **E Mail:**',
  '    c' || c_custkey || '@x.example', '  - **Note:**', '    <b>''hi''</b>'], chr(10))"""


@check("fn_21_markdown_records", f"SELECT c_custkey, {MARKDOWN} AS markdown FROM customer")
def markdown_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", customer_record().alias("r"), customer_source().alias("s"))
    return rows.select(
        "c_custkey", render.markdown_document(F.col("r"), CUSTOMER_SHAPE, F.col("c_name"), F.col("s")).alias("markdown")
    )


_KEY_LABEL = """array_to_string(list_transform(regexp_extract_all(replace(key, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'),
                lambda x: upper(x[1]) || lower(x[2:])), '')"""


@check(
    "fn_21_map_keys",
    f"""SELECT c_custkey, '- **' || {_KEY_LABEL} || ':**' || chr(10) || '  ' || c_name || chr(10) || '- **Key No.1A:**' || chr(10) || '  ' || c_custkey AS markdown,
               '<ul><li><strong>' || {_KEY_LABEL} || ':</strong> ' || c_name || '</li><li><strong>Key No.1A:</strong> ' || c_custkey || '</li></ul>' AS html
        FROM (SELECT *, 'e-mail_OF_' || c_mktsegment || c_nationkey || 'x' AS key FROM customer)""",
)
def map_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that only the rows know become labels by the rule of field names."""
    key = F.concat(F.lit("e-mail_OF_"), "c_mktsegment", F.col("c_nationkey").cast("string"), F.lit("x"))
    made = F.create_map(key, F.col("c_name"), F.lit("key_no.1a"), F.col("c_custkey").cast("string"))
    shape = T.MapType(T.StringType(), T.StringType())
    return table(spark, sf, "customer").select(
        "c_custkey", render.markdown(made, shape).alias("markdown"), render.html(made, shape).alias("html")
    )


def escape_sql(expr: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        expr = f"replace({expr}, '{char}', '{entity}')"
    return expr


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@check(
    "fn_22_html_records",
    f"""SELECT page_id, '<!doctype html><html><head><meta charset=''utf-8''><link rel="stylesheet" href="{render.STYLESHEET}"><title>'
          || t || '</title></head><body class="markdown-body"><h1>' || t || '</h1>' || CASE WHEN page_id % 2 = 0 THEN '<p><a href="' || u ||
          '">Source PDF</a></p>' ELSE '' END || '<ul><li><strong>Agreement Title:</strong> ' || t || '</li><li><strong>Link:</strong> ' || u ||
          '</li><li><strong>Words:</strong><ul><li> ' || t || '</li><li> None</li></ul></li></ul></body></html>' AS html
        FROM (SELECT page_id, {escape_sql(_TITLE)} AS t, {escape_sql('url')} AS u FROM pages)""",
)
def html_records(spark: SparkSession, sf: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    shape = T.StructType([field("agreement_title"), field("link"), field("words", "array<string>")])
    record = F.struct(title.alias("agreement_title"), F.col("url").alias("link"),
                      F.array(title, F.lit(None).cast("string")).alias("words"))
    rows = table(spark, sf, "pages").select("page_id", "url", record.alias("r"))
    source = F.when(F.col("page_id") % 2 == 0, F.col("url"))
    return rows.select(
        "page_id", render.html_document(F.col("r"), shape, F.col("r.agreement_title"), source).alias("html")
    )


@check(
    "fn_23_attribute_harvest",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey || '@x.example' WHEN c_custkey % 3 = 0 THEN 'meta@x.example' END AS email,
              CASE WHEN c_custkey % 5 = 0 THEN '555' END AS phone,
              CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS description,
              c_mktsegment AS company_industry, '1999-01-0' || (c_custkey % 9 + 1) AS contract_effective FROM customer""",
)
def attribute_harvest(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    data = entities.as_text_map({
        "customer_email": F.when(key % 2 == 0, F.concat(F.lit("a"), key.cast("string"), F.lit("@x.example"))).otherwise(""),
        "phone": F.when(key % 5 == 0, "555"), "description": F.col("c_mktsegment"), "sector": F.col("c_mktsegment"),
        "effective_date": F.lit(""), "start_date": F.concat(F.lit("1999-01-0"), (key % 9 + 1).cast("string")),
    })
    metadata = F.when(key % 3 == 0, F.create_map(F.lit("contact_email"), F.lit("meta@x.example")))
    rows = table(spark, sf, "customer").select("c_custkey", data.alias("d"), metadata.alias("m"))
    customer = entities.harvested(F.col("d"), F.col("m"), "Customer", "customer_name")
    company = entities.harvested(F.col("d"), None, "Company", "company_name")
    contract = entities.harvested(F.col("d"), None, "Contract", "contract_id")
    return rows.select(
        "c_custkey", customer["contact_email"].alias("email"), customer["contact_phone"].alias("phone"),
        customer["description"].alias("description"), company["industry"].alias("company_industry"),
        contract["effective_date"].alias("contract_effective"),
    )


@check(
    "fn_24_audit_text",
    rf"""SELECT conv_id, turn, 'content[0] (text):' || chr(10) || '  Read this.' || chr(10) || 'content[1] (' || role || '):' || chr(10)
                || regexp_replace(regexp_replace(text, '{SPACE_SQL}+\z', ''), '(?m)^([^\S\n]*\S)', '  \1', 'g') AS audit
         FROM conversations""",
)
def audit_text(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array(
        requests.text_part(F.lit("Read this.\n")),
        F.struct(F.col("role").alias("type"), F.concat("text", F.lit(" \n\n")).alias("text")),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", X.audit_text(parts).alias("audit"))


@check(
    "fn_25_flat_storage",
    """SELECT l_orderkey, l_linenumber, '{"flag":"' || l_returnflag || '","status":"' || l_linestatus || '"}' AS state,
              '[' || l_partkey || ',' || l_suppkey || ']' AS parties, '{"line":' || l_linenumber || '}' AS position,
              l_returnflag FROM lineitem""",
)
def flat_storage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).alias("state"),
        F.array("l_partkey", "l_suppkey").alias("parties"), F.create_map(F.lit("line"), "l_linenumber").alias("position"),
    )
    return rows.select(*[entities.flat_value(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields])


