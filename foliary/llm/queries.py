"""One query per operator of this package over its whole table, and the SQL that must agree where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.binpacking import pack_best
from foliary.llm.chat import TURNS_PER_BLOCK, format_chats
from foliary.llm.decontaminate import contamination
from foliary.llm.exact import exact_groups
from foliary.llm.html import fit as fit_pages
from foliary.llm.html import main_text
from foliary.llm.jaccard import similar_groups
from foliary.llm.language import fit, held_out, identify
from foliary.llm.merkle import FIELDS, folded, manifest, path_digest
from foliary.llm.negatives import HIGH, LOW, NEGATIVES, POSITIVES, SCALE, hard_negatives
from foliary.llm.packing import pack
from foliary.llm.score import score
from foliary.llm.shards import shuffled_shards
from foliary.llm.shared import LOWER, UPPER
from foliary.llm.substrings import without_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op2_html_text")
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return main_text(pages, fit_pages(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op3_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = without_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op4_exact_dedup",
    f"""
    WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
    """,
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_groups(table(spark, folder, "documents"), digest_all=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_lm_score")
def lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return score(table(spark, folder, "documents")).select(
        "doc_id", (~F.col("teaches")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op8_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_sharding")
def sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shuffled_shards(table(spark, folder, "documents")).drop("place")


@query("op5_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(table(spark, folder, "documents"))


@query(
    "op6_chat_format",
    f"""
    WITH t AS (SELECT conv_id, turn, role, md5(coalesce(text, chr(0) || 'null')) AS digest, any_value(text) AS text
               FROM conversations GROUP BY ALL),
    p AS (SELECT *, row_number() OVER w - 1 AS position, list(struct_pack(r := role, d := digest)) OVER w AS prefix,
                 count(*) OVER (PARTITION BY conv_id) AS n_turns
          FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, digest
                              ROWS UNBOUNDED PRECEDING)),
    whole AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE position = n_turns - 1
              GROUP BY prefix, n_turns),
    kept AS (SELECT conv_id, copies FROM whole
             WHERE NOT EXISTS (FROM p WHERE p.prefix = whole.prefix AND p.position < p.n_turns - 1))
    SELECT p.conv_id, position // {TURNS_PER_BLOCK} AS part, p.n_turns, k.copies,
           string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10), ''
                      ORDER BY position) AS text
    FROM p JOIN kept k ON p.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL
    """,
)
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return format_chats(table(spark, folder, "conversations"))


@query("op10_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


def sql_leaf(text: str) -> str:
    """SQL for the hash of a row with ``text`` in place of its text."""
    fields = [text if f == "text" else f for f in FIELDS]
    values = [f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields]
    return f"sha256({' || '.join(values)})"


def sql_climb(name: str, base: str) -> str:
    """SQL that takes every row of ``base`` (tree, leaf_no, position, node, copy, proof) up to its tree's root, level by level."""
    return f"""
    {name} AS (
      SELECT tree, leaf_no, position, node, copy, proof, count(*) OVER (PARTITION BY tree) AS n
      FROM (SELECT *, leaf_no AS position FROM {base})
      UNION ALL
      SELECT u.tree, leaf_no, u.position // 3, sha256(array_to_string(l, '')),
             sha256(array_to_string(l[1:u.position % 3], '') || copy || array_to_string(l[u.position % 3 + 2:], '')),
             proof || array_to_string(l[1:u.position % 3], '') || array_to_string(l[u.position % 3 + 2:], ''), (n + 2) // 3
      FROM {name} u JOIN (SELECT tree, position // 3 AS run, list(node ORDER BY position) AS l
                          FROM (SELECT DISTINCT tree, position, node FROM {name}) GROUP BY ALL) r
        ON u.tree = r.tree AND u.position // 3 = r.run
      WHERE n > 1)"""


SQL_CRC32 = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
        lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
            lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)))"""


@query(
    "op12_merkle_manifest",
    f"""
    WITH RECURSIVE docs AS (
      SELECT doc_id, coalesce('s' || source, '') AS tree, {sql_leaf("text")} AS leaf,
             CASE WHEN {SQL_CRC32} % 2 = 0 THEN {sql_leaf("replace(text, chr(10), '')")} ELSE {sql_leaf("text")} END AS altered
      FROM documents),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, altered) - 1 AS leaf_no FROM docs),
    leaf_base AS (SELECT tree, leaf_no, leaf AS node, altered AS copy, '' AS proof FROM leaves),
    {sql_climb("climb", "leaf_base")},
    tops AS (SELECT * FROM climb WHERE n = 1),
    tree_base AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS leaf_no, node, '' AS copy, '' AS proof, tree AS of
                  FROM (SELECT DISTINCT tree, node FROM tops)),
    further_base AS (SELECT '' AS tree, b.leaf_no, b.node, '' AS copy, '' AS proof FROM tree_base b),
    {sql_climb("tree_climb", "further_base")},
    -- The copies of all leaves go through the upper tree by the steps of their own tree's root.
    steps AS (SELECT b.of, c.position, c.node, c.proof, c.n, c.leaf_no FROM tree_climb c JOIN tree_base b USING (leaf_no)),
    runs AS (SELECT n, position // 3 AS run, list(node ORDER BY position) AS l
             FROM (SELECT DISTINCT n, position, node FROM tree_climb) GROUP BY ALL),
    fold AS (
      SELECT t.tree, t.leaf_no, t.copy AS value, s.leaf_no AS position, (SELECT max(n) FROM tree_climb) AS n
      FROM tops t JOIN tree_base s ON s.of = t.tree
      UNION ALL
      SELECT f.tree, f.leaf_no, sha256(array_to_string(l[1:f.position % 3], '') || value || array_to_string(l[f.position % 3 + 2:], '')),
             f.position // 3, (f.n + 2) // 3
      FROM fold f JOIN runs r ON r.n = f.n AND r.run = f.position // 3 WHERE f.n > 1)
    SELECT l.doc_id, l.leaf, t.node AS subroot, (SELECT node FROM tree_climb WHERE n = 1 LIMIT 1) AS root,
           sha256(t.proof || s.proof) AS proof_sha256, f.value AS folded_root,
           f.value = (SELECT node FROM tree_climb WHERE n = 1 LIMIT 1) AS verified
    FROM leaves l JOIN tops t ON t.tree = l.tree AND t.leaf_no = l.leaf_no
    JOIN steps s ON s.of = l.tree AND s.n = 1 JOIN fold f ON f.tree = l.tree AND f.leaf_no = l.leaf_no AND f.n = 1
    """,
)
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = manifest(table(spark, folder, "documents"), altered=F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))))
    at = folded(F.col("altered_leaf"), F.col("path"))
    shown = found.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), at.alias("folded_root"))
    hexed = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "folded_root")}
    return shown.withColumns(hexed).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op11_bestfit_packing")
def bestfit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_best(table(spark, folder, "documents"))


@query(
    "op13_hard_negatives",
    f"""
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS whole
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                 list_inner_product(a.whole, b.whole)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
    SELECT anchor_id, positive_id,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
           other_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
    QUALIFY rank <= {NEGATIVES}
    """,
)
def mined_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)
