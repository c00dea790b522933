"""Joins, aggregations, row numbers, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.catalog import registry
from foliary.checks.base import DOC_TYPES, DOCS, check, docs, pick, pick_sql, strip_sql, table
from foliary.checks.scans import CACHE, DOCUMENT_RECORD, _cache_rows
from foliary.functions import answers as A
from foliary.functions import text as X
from foliary.operators import cache as C
from foliary.operators import classify, entities, naming, summary
from foliary.operators.assemble import latest_by_field
from foliary.operators.requests import part_requests
from foliary.operators.skew import ordinal
from foliary.schema import parts
from foliary.session import new_folder, staged
from foliary.sources.files import union_results

# -- joins --------------------------------------------------------------------


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return staged(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("request_key")), "keys")


@check(
    "jn_01_cache_hits",
    f"""SELECT d.doc_id, md5(d.text) AS request_key, c.response_json
        FROM documents d LEFT JOIN {CACHE} c ON c.request_key = md5(d.text)""",
)
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    cache = _cache_rows(spark, sf).distinct()
    return C.hits(_requests(spark, sf), cache, ["doc_id"])


@check(
    "jn_01_indexed_lookup",
    f"""SELECT d.doc_id, md5(d.text) AS request_key, c.response_json
        FROM documents d LEFT JOIN {CACHE} c ON c.request_key = md5(d.text)""",
)
def indexed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Cached answers from the stored table: by the filter of few keys at small sizes, by a join beyond them."""
    folder = new_folder(spark, "cache")
    C.append(C.new_entries(_cache_rows(spark, sf), C.empty_cache(spark), "2024-01-01 00:00:00"), folder)
    return C.hits(_requests(spark, sf), C.read_cache(spark, folder), ["doc_id"])


@check(
    "jn_02_cache_misses",
    f"""SELECT md5(text) AS request_key, min(doc_id) AS doc_id FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM {CACHE} c WHERE c.request_key = md5(d.text)) GROUP BY md5(text)""",
)
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    return C.misses(_requests(spark, sf), _cache_rows(spark, sf), "doc_id")


_NAMES = (
    "contracts_Agreement", "CONTRACTS_agreement", "dataprotectionaddendum", "StockOptionAgreement",
    "hr_StockOptionAgreement", "HR_compliancedocument", "ComplianceDocument",
)
_REGISTRY_SQL = "(VALUES " + ", ".join(
    f"({i}, '{n.key}', '{n.class_name}')" for i, n in enumerate(registry())
) + ") AS t(pos, key, class_name)"


@check(
    "jn_03_chosen_name_to_type",
    f"""WITH r AS (SELECT event_id, CASE WHEN event_id % 11 = 10 THEN event_type
                          ELSE {pick_sql('event_id', _NAMES)} END AS chosen FROM events),
             n AS (SELECT DISTINCT chosen FROM r),
             m AS (SELECT chosen, arg_min(key, CASE WHEN key = chosen THEN -1 ELSE pos END) AS type_key
                   FROM n JOIN {_REGISTRY_SQL}
                   ON lower(key) = lower(chosen) OR lower(class_name) = lower(chosen) GROUP BY chosen)
        SELECT event_id, r.chosen, type_key FROM r LEFT JOIN m ON m.chosen = r.chosen""",
)
def chosen_name(spark: SparkSession, sf: str) -> DataFrame:
    chosen = F.when(F.col("event_id") % 11 == 10, F.col("event_type")).otherwise(pick(F.col("event_id"), _NAMES))
    rows = table(spark, sf, "events").select("event_id", chosen.alias("chosen"))
    return classify.resolve_names(rows, "chosen", registry())


def _places(spark: SparkSession, sf: str) -> DataFrame:
    region = table(spark, sf, "region")
    nation = table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return region.select(F.col("r_name").alias("type_key"), F.lit(None).cast("string").alias("parent_key")).unionByName(
        nation.select(F.col("n_name").alias("type_key"), F.col("r_name").alias("parent_key"))
    )


@check(
    "jn_04_direct_children",
    """SELECT r_name AS parent, n_name AS child FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
       UNION ALL SELECT n_name, NULL FROM nation""",
)
def direct_children(spark: SparkSession, sf: str) -> DataFrame:
    return classify.with_children(_places(spark, sf)).select(
        F.col("type_key").alias("parent"), F.col("child_key").alias("child")
    )


@check(
    "jn_05_document_parts",
    "SELECT doc_id, part, md5(text) || ':' || part AS part_key FROM documents, UNNEST([1, 2]) AS u(part)",
)
def document_parts(spark: SparkSession, sf: str) -> DataFrame:
    n_parts = len(parts(DOCUMENT_RECORD, 2))
    asked = part_requests(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key")), n_parts)
    return asked.select("doc_id", "part", F.concat_ws(":", "key", F.col("part").cast("string")).alias("part_key"))


def _order_names() -> Column:
    number = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    kind = F.when(F.col("o_custkey") % 7 == 0, "Nobody#").otherwise("Customer#")
    return F.concat(F.lit(" \t"), kind, number, F.lit("\n"))


@check(
    "jn_06_reference_by_name",
    """SELECT o_orderkey, CASE WHEN c_name IS NOT NULL THEN md5('Customer||' || c_name) END AS entity_id
       FROM orders LEFT JOIN customer ON o_custkey % 7 <> 0 AND c_name = 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0')""",
)
def reference_by_name(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "customer").select(F.lit("Customer").alias("entity"), F.col("c_name").alias("name"))
    known = known.withColumn("entity_id", entities.entity_id(F.col("entity"), F.col("name")))
    rows = table(spark, sf, "orders").select("o_orderkey", _order_names().alias("customer_name"))
    return entities.with_references(rows, known, "Customer", "customer_name", ["o_orderkey"]).drop("customer_name")


@check(
    "jn_07_reverse_references",
    """SELECT n_name, count(s_suppkey) AS records, min(s_name) AS first_record, max(s_name) AS last_record
       FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def reverse_references(spark: SparkSession, sf: str) -> DataFrame:
    back = entities.references_to(table(spark, sf, "supplier"), "s_nationkey", "s_name")
    nation = table(spark, sf, "nation")
    return nation.join(back, nation.n_nationkey == back.s_nationkey, "left").select(
        "n_name", F.coalesce("records", F.lit(0)).alias("records"), "first_record", "last_record"
    )


@check(
    "jn_07_record_entities",
    """SELECT s_suppkey, s_name, s_nationkey, n_name FROM supplier
       LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 5 <> 0""",
)
def record_entities(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return entities.record_entities(rows, nation, "s_nationkey", ["s_suppkey"])


@check(
    "jn_07_ordered_members",
    """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position
       FROM orders""",
)
def ordered_members(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return entities.members(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@check(
    "jn_08_delete_keeps",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""",
)
def delete_keeps(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return entities.kept_after_delete(rows, gone, "l_orderkey", ["l_linenumber", "l_partkey"])


@check(
    "jn_08_delete_removes",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""",
)
def delete_removes(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return entities.removed_by_delete(rows, gone, "l_orderkey", ["l_linenumber", "l_partkey"])


_AREA_SQL = "(VALUES " + ", ".join(
    f"('{t}', '{a}')" for t, areas in summary.DOCUMENT_AREAS.items() for a in areas
) + ") AS m(document_type, area)"


@check(
    "jn_09_document_areas",
    f"""SELECT doc_id, d.document_type, area FROM (SELECT doc_id, {pick_sql('doc_id', DOC_TYPES)} AS document_type
        FROM documents) d JOIN {_AREA_SQL} ON m.document_type = d.document_type""",
)
def document_areas(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", pick(F.col("doc_id"), DOC_TYPES).alias("document_type"))
    return summary.with_area(rows, "document_type")


# -- aggregations -----------------------------------------------------------------


def _status() -> Column:
    return F.when(F.col("doc_id") % 7 == 0, "failed").when(F.col("doc_id") % 11 == 0, "no_result").otherwise("ok")


@check(
    "agg_01_run_summary",
    """SELECT source, count(*) AS total, count(*) FILTER (doc_id % 7 <> 0) AS success,
              count(*) FILTER (doc_id % 7 = 0) AS failure FROM documents GROUP BY source""",
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary.run_summary(table(spark, sf, "documents").withColumn("status", _status()), ["source"])


def broken_props() -> Column:
    n = F.col("event_id") % 10
    return F.when(n == 0, F.substring("props", 1, 5)).when(n == 3, F.concat("props", F.lit(" x"))).otherwise(F.col("props"))


BROKEN = "CASE event_id % 10 WHEN 0 THEN substr(props, 1, 5) WHEN 3 THEN props || ' x' ELSE props END"


@check(
    "agg_02_failures_by_class",
    f"""SELECT CASE WHEN NOT json_valid(p) THEN 'MalformedAnswer' ELSE 'ValidationError' END AS error_class,
               count(*) AS n, min('cannot use ' || p) AS error_message
        FROM (SELECT {BROKEN} AS p, event_type FROM events) WHERE NOT json_valid(p) OR event_type = 'error'
        GROUP BY 1""",
)
def failures_by_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(broken_props().alias("p"), "event_type")
    parsed = A.is_json_object(F.col("p"))
    rows = rows.withColumn(
        "error_class",
        F.when(~parsed, "MalformedAnswer").when(F.col("event_type") == "error", "ValidationError"),
    )
    return summary.failure_summary(
        rows.withColumns(
            {
                "status": F.when(F.col("error_class").isNull(), "ok").otherwise("failed"),
                "error_message": F.concat(F.lit("cannot use "), "p"),
            }
        )
    )


@check(
    "agg_03_part_merge",
    """WITH l AS (
         SELECT o_orderkey, 1 AS part, 'status' AS field, o_orderstatus AS value FROM orders
         UNION ALL SELECT o_orderkey, 1, 'priority', o_orderpriority FROM orders
         UNION ALL SELECT o_orderkey, 2, 'customer', o_custkey::VARCHAR FROM orders
         UNION ALL SELECT o_orderkey, 3, 'status', 'late ' || o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)
       SELECT o_orderkey, arg_max(value, part) FILTER (field = 'status') AS status,
              arg_max(value, part) FILTER (field = 'priority') AS priority,
              arg_max(value, part) FILTER (field = 'customer') AS customer FROM l GROUP BY o_orderkey""",
)
def part_merge(spark: SparkSession, sf: str) -> DataFrame:
    def row(part: int, name: str, value: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), F.lit(name).alias("field"), value.alias("value"))

    late = F.when(F.col("o_orderkey") % 3 == 0, row(3, "status", F.concat(F.lit("late "), "o_orderstatus")))
    answers = F.array_compact(
        F.array(
            row(1, "status", F.col("o_orderstatus")), row(1, "priority", F.col("o_orderpriority")),
            row(2, "customer", F.col("o_custkey").cast("string")), late,
        )
    )
    rows = table(spark, sf, "orders").select("o_orderkey", F.explode(answers).alias("a")).select("o_orderkey", "a.*")
    return latest_by_field(rows, "o_orderkey", ["status", "priority", "customer"])


_MENTIONS = """(SELECT ' ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN chr(10) ELSE '' END AS raw, c_custkey AS pos,
                 CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN 'c' || c_custkey || '@x.example' END AS email,
                 CASE WHEN c_custkey % 5 = 4 THEN '555-' || c_custkey ELSE '' END AS phone FROM customer)"""


@check(
    "agg_04_entity_merge",
    f"""SELECT 'Customer' AS entity, {strip_sql('raw')} AS name, min(pos) AS first_pos,
               arg_min(email, pos) FILTER (trim(email) <> '') AS contact_email,
               arg_min(phone, pos) FILTER (trim(phone) <> '') AS contact_phone,
               md5('Customer||' || {strip_sql('raw')}) AS entity_id
        FROM {_MENTIONS} GROUP BY ALL""",
)
def entity_merge(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    email = F.when(key % 3 == 0, " ").when(key % 3 == 1, F.concat(F.lit("c"), key.cast("string"), F.lit("@x.example")))
    raw = F.concat(F.lit(" "), "c_mktsegment", F.when(key % 2 == 0, "\n").otherwise(""))
    mentions = table(spark, sf, "customer").select(
        F.lit("Customer").alias("entity"), entities.clean_name(raw).alias("name"), key.alias("pos"),
        email.alias("contact_email"),
        F.when(key % 5 == 4, F.concat(F.lit("555-"), key.cast("string"))).otherwise("").alias("contact_phone"),
    )
    merged = entities.merged_entities(mentions, ["pos"], ["contact_email", "contact_phone"])
    return merged.withColumn("first_pos", F.col("first_seen.pos")).drop("first_seen")


def url_path() -> Column:
    return F.split(F.regexp_replace("url", r"\Ahttps?://|[?#].*\z", ""), "/")


URL_PATH = r"string_split(regexp_replace(url, '\Ahttps?://|[?#].*\z', '', 'g'), '/')"


@check("agg_05_longest_path", f"SELECT max(len({URL_PATH})) AS longest FROM pages")
def longest_path(spark: SparkSession, sf: str) -> DataFrame:
    return summary.longest_path(table(spark, sf, "pages").select(url_path().alias("path")), "path")


# (type, table, key column, [(field, column)]) of the facts; field positions count from 0.
FACT_FIELDS = (
    ("customer_rec", "customer", "c_custkey", (
        ("customer_name", "c_name"), ("market_segment", "c_mktsegment"), ("budget_allocation", "c_mktsegment"),
        ("name_label", "c_name"),
    )),
    ("supplier_rec", "supplier", "s_suppkey", (
        ("agreement_title", "s_name"), ("supplier", "s_name"), ("company_name", "s_name"),
    )),
    ("part_rec", "part", "p_partkey", (
        ("product_type", "p_type"), ("item_name", "p_name"), ("brand", "p_brand"), ("site_product_name", "p_name"),
    )),
    ("nation_rec", "nation", "n_nationkey", (("location", "n_name"), ("jurisdiction", "n_name"), ("title", "n_name"))),
)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """(type_key, record_id, field, pos, value) of four tables, unpivoted."""
    united: DataFrame | None = None
    for type_key, name, key, fields in FACT_FIELDS:
        rows = F.array(*[
            F.struct(F.lit(f).alias("field"), F.lit(i).alias("pos"), F.col(c).alias("value"))
            for i, (f, c) in enumerate(fields)
        ])
        one = table(spark, sf, name).select(
            F.lit(type_key).alias("type_key"), F.col(key).cast("long").alias("record_id"), F.explode(rows).alias("f")
        ).select("type_key", "record_id", "f.*")
        united = one if united is None else united.unionByName(one)
    assert united is not None
    return united


FACTS = "(" + " UNION ALL ".join(
    f"SELECT '{t}' AS type_key, {key}::BIGINT AS record_id, '{f}' AS field, {i} AS pos, {c} AS value FROM {name}"
    for t, name, key, fields in FACT_FIELDS for i, (f, c) in enumerate(fields)
) + ")"
_IDENTIFIERS = "(VALUES " + ", ".join(
    f"({o}, '{e}', '{i}')" for o, (e, ids) in enumerate(entities.ENTITIES.items()) for i in ids
) + ") AS e(ord, entity, ident)"
TAGGED = f"""(
  WITH fields AS (SELECT type_key, field, min(pos) AS pos FROM {FACTS} GROUP BY ALL),
       hits AS (SELECT DISTINCT type_key, field, pos, ord, entity FROM fields JOIN {_IDENTIFIERS}
                ON field = ident OR (contains(field, ident) AND (length(ident) > 4
                   OR starts_with(field, ident || '_') OR ends_with(field, '_' || ident)))),
       seen AS (SELECT *, min(pos) OVER (PARTITION BY type_key, ord) AS first FROM hits)
  SELECT type_key, field, arg_min(entity, first * 100 + ord) AS entity FROM seen GROUP BY type_key, field)"""


@check(
    "agg_06_entity_usage",
    f"""SELECT t.entity, t.type_key, t.field, count(*) AS records, count(DISTINCT {strip_sql('value')}) AS names
        FROM {FACTS} f JOIN {TAGGED} t ON t.type_key = f.type_key AND t.field = f.field GROUP BY ALL""",
)
def entity_usage(spark: SparkSession, sf: str) -> DataFrame:
    return entities.usage(entities.tagged_facts(facts(spark, sf), ["record_id"]))


@check(
    "agg_07_render_summary",
    f"""SELECT count(*) FILTER (json_valid(p)) AS documents, count(*) FILTER (NOT json_valid(p)) AS errors
        FROM (SELECT {BROKEN} AS p FROM events)""",
)
def render_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(broken_props().alias("p"))
    return summary.rendered_summary(rows, A.is_json_object(F.col("p")))


_ALL_AREAS = "(VALUES " + ", ".join(f"('{a}')" for a in summary.AREAS) + ") AS a(area)"


@check(
    "agg_08_area_coverage",
    f"""WITH d AS (SELECT {pick_sql('doc_id + quality', DOC_TYPES)} AS document_type FROM labels)
        SELECT a.area, count(d.document_type) AS documents,
               coalesce(string_agg(DISTINCT d.document_type, ', ' ORDER BY d.document_type), '') AS document_types
        FROM {_ALL_AREAS} LEFT JOIN {_AREA_SQL} ON m.area = a.area
        LEFT JOIN d ON d.document_type = m.document_type GROUP BY a.area""",
)
def area_coverage(spark: SparkSession, sf: str) -> DataFrame:
    kind = pick(F.col("doc_id") + F.col("quality"), DOC_TYPES)
    return summary.area_coverage(table(spark, sf, "labels").select(kind.alias("document_type")), "document_type")


# -- row numbers ----------------------------------------------------------------------

_TAKEN = """CASE WHEN doc_id % 40 = 7 THEN source || '_1' WHEN doc_id % 40 = 8 THEN source || '_3'
                 WHEN doc_id % 40 = 9 THEN source || '_1_1' ELSE source END"""


def _named(rows: DataFrame) -> DataFrame:
    n = F.col("doc_id") % 40
    base = (
        F.when(n == 7, F.concat("source", F.lit("_1"))).when(n == 8, F.concat("source", F.lit("_3")))
        .when(n == 9, F.concat("source", F.lit("_1_1"))).otherwise(F.col("source"))
    )
    return rows.select("doc_id", F.col("lang").alias("folder"), base.alias("base"))


@check(
    "win_01_unique_names",
    rf"""WITH d AS (SELECT doc_id, lang AS folder, {_TAKEN} AS base FROM documents),
             r AS (SELECT *, row_number() OVER (PARTITION BY folder, base ORDER BY doc_id) - 1 AS n FROM d),
             b AS (SELECT DISTINCT folder, regexp_extract(base, '\A(.+)_([1-9][0-9]*)\z', 1) AS base,
                          regexp_extract(base, '\A(.+)_([1-9][0-9]*)\z', 2)::BIGINT AS k
                   FROM d WHERE regexp_matches(base, '\A(.+)_([1-9][0-9]*)\z')),
             j AS (SELECT *, k - row_number() OVER (PARTITION BY folder, base ORDER BY k) AS free_before FROM b)
         SELECT doc_id, folder, base, CASE WHEN n = 0 THEN base ELSE base || '_' || (n + (
                  SELECT count(*) FROM j WHERE j.folder = r.folder AND j.base = r.base AND j.free_before < r.n)) END AS name
         FROM r""",
)
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    return naming.unique_names(_named(table(spark, sf, "documents")), "folder", "base", ["doc_id"])


@check(
    "win_01_names_beside_earlier_ones",
    rf"""WITH d AS (SELECT doc_id, lang AS folder, {_TAKEN} AS base FROM documents),
             e AS (SELECT DISTINCT lang AS folder, CASE doc_id % 9 WHEN 0 THEN source WHEN 1 THEN source || '_1' WHEN 2 THEN source || '_4'
                          ELSE source || '_' || doc_id END AS name FROM documents),
             t AS (SELECT folder, name FROM e UNION SELECT folder, base FROM d),
             k AS (SELECT folder, regexp_extract(name, '\A(.+)_([1-9][0-9]*)\z', 1) AS base,
                          regexp_extract(name, '\A(.+)_([1-9][0-9]*)\z', 2)::BIGINT AS k
                   FROM t WHERE regexp_matches(name, '\A(.+)_([1-9][0-9]*)\z')
                   UNION ALL SELECT folder, name, 0 FROM e),
             c AS (SELECT folder, base, count(*) AS n FROM d GROUP BY ALL),
             s AS (SELECT folder, base, unnest(range(n + (SELECT count(*) FROM k WHERE k.folder = c.folder AND k.base = c.base))) AS k FROM c),
             f AS (SELECT s.*, row_number() OVER (PARTITION BY folder, base ORDER BY k) AS place
                   FROM s ANTI JOIN k USING (folder, base, k)),
             r AS (SELECT *, row_number() OVER (PARTITION BY folder, base ORDER BY doc_id) AS place FROM d)
         SELECT doc_id, r.folder, r.base, CASE WHEN k = 0 THEN r.base ELSE r.base || '_' || k END AS name
         FROM r JOIN f USING (folder, base, place)""",
)
def names_beside_earlier_ones(spark: SparkSession, sf: str) -> DataFrame:
    """Documents beside names that stand in the target already."""
    every = table(spark, sf, "documents")
    n = F.col("doc_id") % 9
    name = (
        F.when(n == 0, F.col("source")).when(n == 1, F.concat("source", F.lit("_1"))).when(n == 2, F.concat("source", F.lit("_4")))
        .otherwise(F.concat_ws("_", "source", F.col("doc_id").cast("string")))
    )
    there = every.select(F.col("lang").alias("folder"), name.alias("base")).distinct()
    return naming.unique_names(_named(every), "folder", "base", ["doc_id"], existing=there)


@check(
    "win_02_message_ordinals",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations",
)
def message_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return ordinal(table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"])


@check(
    "win_03_dense_ids",
    """WITH m AS (SELECT 'Customer' AS entity, c_name AS name, (c_custkey * 7919) % 1009 AS first_seen FROM customer
                  UNION ALL SELECT 'Vendor', s_name, (s_suppkey * 31) % 17 FROM supplier)
       SELECT entity, name, row_number() OVER (PARTITION BY entity ORDER BY first_seen, name) AS id FROM m""",
)
def dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        F.lit("Customer").alias("entity"), F.col("c_name").alias("name"), ((F.col("c_custkey") * 7919) % 1009).alias("first_seen")
    )
    suppliers = table(spark, sf, "supplier").select(
        F.lit("Vendor").alias("entity"), F.col("s_name").alias("name"), ((F.col("s_suppkey") * 31) % 17).alias("first_seen")
    )
    return entities.dense_ids(customers.unionByName(suppliers)).drop("first_seen")


# -- sorts ----------------------------------------------------------------------------


@check("srt_01_crawl_limit", f"SELECT path, doc_id FROM {DOCS} ORDER BY path LIMIT 25")
def crawl_limit(spark: SparkSession, sf: str) -> DataFrame:
    return summary.crawl_limit(docs(spark, sf).select("path", "doc_id"), 25)


@check("srt_01_crawl_without_limit", f"SELECT path, doc_id FROM {DOCS}")
def crawl_without_limit(spark: SparkSession, sf: str) -> DataFrame:
    return summary.crawl_limit(docs(spark, sf).select("path", "doc_id"), 0)


@check("srt_02_sorted_listing", f"SELECT path, n_chars FROM {DOCS} ORDER BY path")
def sorted_listing(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("path", "n_chars").orderBy("path")


@check(
    "srt_03_sorted_name_lists",
    """SELECT event_id, array_to_string(list_sort([event_type, 'user_' || user_id, 'k', 'Value']), ', ') AS names
       FROM events""",
)
def sorted_name_lists(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array("event_type", F.concat(F.lit("user_"), F.col("user_id").cast("string")), F.lit("k"), F.lit("Value"))
    return table(spark, sf, "events").select("event_id", X.sorted_list(names).alias("names"))


# -- set operations ---------------------------------------------------------------------


@check(
    "set_01_cached_and_fresh",
    f"""SELECT request_key, response_json FROM {CACHE} c
        WHERE EXISTS (SELECT 1 FROM documents WHERE md5(text) = c.request_key)
        UNION ALL SELECT DISTINCT md5(text), '{{"fresh":true}}' FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM {CACHE} c WHERE c.request_key = md5(d.text))""",
)
def cached_and_fresh(spark: SparkSession, sf: str) -> DataFrame:
    asked = _requests(spark, sf)
    cache = _cache_rows(spark, sf).distinct()
    cached = C.asked_of(cache, asked)
    fresh = C.misses(asked, cache, "doc_id").withColumn("response_json", F.lit('{"fresh":true}'))
    return C.all_answers(cached, fresh)


def answer_text() -> Column:
    n = F.col("event_id")
    return F.concat(
        F.lit("{"),
        F.when(n % 2 == 0, F.concat(F.lit('"kind": "'), "event_type", F.lit('", '))).otherwise(""),
        F.when(n % 3 == 0, '"note": " ", ').when(n % 3 == 1, '"tags": [], ').otherwise('"tags": ["a"], '),
        F.lit('"k": '), F.col("user_id").cast("string"), F.lit("}"),
    )


@check(
    "set_02_missing_and_empty",
    """SELECT event_id, array_to_string(list_sort(list_concat(
                CASE WHEN event_id % 2 = 1 THEN ['kind'] ELSE [] END, CASE WHEN event_id % 3 <> 0 THEN ['note'] ELSE ['tags'] END)),
                ', ') AS missing,
              CASE event_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'tags' ELSE '' END AS empty FROM events""",
)
def missing_and_empty(spark: SparkSession, sf: str) -> DataFrame:
    from foliary.checks.values import EVENT_RECORD

    raw = A.raw_fields(F.col("answer"))
    rows = table(spark, sf, "events").select("event_id", answer_text().alias("answer"))
    return rows.withColumn("raw", raw).select(
        "event_id", F.array_join(A.missing_keys(F.col("raw"), EVENT_RECORD), ", ").alias("missing"),
        F.array_join(A.empty_keys(F.col("raw"), EVENT_RECORD), ", ").alias("empty"),
    )


@check(
    "set_03_results_of_all_inputs",
    f"""SELECT path, doc_id, CAST(NULL AS BIGINT) AS page_id, 'crawl' AS input FROM {DOCS}
        UNION ALL SELECT url, NULL, page_id, 'pages' FROM pages""",
)
def results_of_all_inputs(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), "page_id")
    return union_results({"crawl": docs(spark, sf).select("path", "doc_id"), "pages": pages})
