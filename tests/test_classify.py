from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliary.catalog import registry, type_table
from foliary.operators import classify as C
from foliary.operators.classify import TypeNode

TREE = [
    TypeNode("m_Contract", None, ("contract",)), TypeNode("m_Lease", "m_Contract", ("rent",)),
    TypeNode("m_License", "m_Contract", ("software",)), TypeNode("m_Report", None, ("report",)),
    TypeNode("m_ShortLease", "m_Lease", ("week",)),
]


def test_registry_tree():
    tree = registry()
    assert len(tree) == 92 and C.tree_depth(tree) == 5
    assert C.ancestry(tree, "legal_SoftwareLicenseAgreement") == ["Agreement", "CommercialAgreement", "LicenseAgreement", "SoftwareLicenseAgreement"]


def test_children_by_first_parent(spark):
    types = type_table(spark, registry())
    assert {r.type_key for r in C.children_of(types, "contracts_LicenseAgreement").collect()} == {"legal_SoftwareLicenseAgreement"}
    assert C.children_of(types, "contracts_EmploymentContract").count() == 0


@pytest.mark.parametrize(
    "name, key",
    [
        ("SoftwareLicenseAgreement", "legal_SoftwareLicenseAgreement"), ("LEGAL_softwarelicenseagreement", "legal_SoftwareLicenseAgreement"),
        ("StockOptionAgreement", "hr_StockOptionAgreement"), ("stock_options_StockOptionAgreement", "stock_options_StockOptionAgreement"),
        ("DataProtectionAddendum", "contracts_DataProtectionAddendum"), ("unknown", None), (None, None),
    ],
)
def test_resolve(spark, name, key):
    row = C.resolve_names(spark.createDataFrame([(name,)], "n string"), "n", registry()).first()
    assert row.type_key == key


def walk(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    done = C.classified(docs, TREE, C.keyword_scores(F.col("text"), TREE), **options)
    return {r.doc_id: r for r in done.collect()}


def test_walk(spark):
    rows = walk(spark, ["Contract rent week", "contract", "contract contract software", "nothing", "report report", "contract x rent"], roots_only=True)
    assert [rows[i].path_text for i in range(6)] == [
        "m_Contract -> m_Lease -> m_ShortLease", "m_Contract", "m_Contract -> m_License", "", "m_Report", "m_Contract -> m_Lease",
    ]
    assert rows[3].status == "failed" and rows[3].type_key is None and rows[3].error_message == "invalid type: "


def test_all_types_are_offered_first_by_default(spark):
    assert walk(spark, ["rent rent contract week"])[0].path_text == "m_Lease -> m_ShortLease"


def by_calls(spark, choose, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    asked = []

    def ask(rows):
        asked.append(rows.count())
        return rows.select("doc_id", choose.alias("choice"))

    done = C.classified_by_calls(docs, TREE, ask, roots_only=True)
    return {r.doc_id: r for r in done.collect()}, asked


def test_walk_by_calls_agrees(spark):
    choose = F.when(F.size("selection_path") == 0, F.when(F.contains("text", F.lit("report")), "REPORT").otherwise("m_contract")).otherwise(
        F.when(F.contains("text", F.lit("rent")), "Lease").otherwise("no such type")
    )
    rows, asked = by_calls(spark, choose, ["report", "contract rent", "contract"])
    assert [rows[i].path_text for i in range(3)] == ["m_Report", "m_Contract -> m_Lease", "m_Contract"]
    assert asked == [3, 2, 1]


def test_invalid_first_choice_fails(spark):
    rows, asked = by_calls(spark, F.lit("nonsense"), ["x"])
    assert rows[0].status == "failed" and rows[0].error_message == "invalid type: nonsense" and asked[0] == 1


def test_repeated_and_null_ids_give_a_row_each(spark):
    rows = [(1, "contract rent week"), (1, "report"), (1, "contract rent week"), (None, "report"), (None, None), (2, "contract"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = []

    def ask(rows):
        asked.append(rows.count())
        return rows.select("doc_id", C.by_score(F.col("offered"), C.keyword_scores(F.coalesce("text", F.lit("")), TREE)).alias("choice"))

    done = sorted((str(r.doc_id), r.path_text, r.status) for r in C.classified_by_calls(docs, TREE, ask, roots_only=True).collect())
    assert done == sorted([
        ("1", "m_Contract -> m_Lease -> m_ShortLease", "ok"), ("1", "m_Contract -> m_Lease -> m_ShortLease", "ok"), ("1", "m_Report", "ok"),
        ("None", "m_Report", "ok"), ("None", "", "failed"), ("2", "m_Contract", "ok"), ("3", "", "failed"),
    ])
    assert asked[0] == 5  # different texts, one of them null


def test_texts_stand_still(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id bigint, text string")
    texts = C.standing_texts(docs)
    offered = spark.range(50).select(F.sha2(F.concat(F.lit("text "), "id"), 256).alias(C.CONTENT), F.lit(1).alias("offered"))
    joined = C.under_way(texts, offered)
    assert joined.count() == 50
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the exchange of what is offered
    assert C.standing_texts(docs.limit(0)).count() == 0
