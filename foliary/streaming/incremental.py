"""New files only: the batch job applied to each micro-batch of a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators.cache import CACHE_SCHEMA, PREFIX_LENGTH, empty_cache
from foliary.plans.extraction import Job, extract
from foliary.plans.normalise import ENTITY_KEYS, ENTITY_TABLE, entity_tables, normalise
from foliary.session import staged
from foliary.sinks.snapshots import FAN, Snapshots, merged, with_part

EPOCH = "1970-01-01 00:00:00"
CACHE = f"{CACHE_SCHEMA}, batch int"


def _exists(spark: SparkSession, path: str) -> bool:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    try:
        return bool(files.load(path).select("path").take(1))
    except Exception as exc:  # noqa: BLE001 - a folder that is not there yet
        if "PATH_NOT_FOUND" in str(exc):
            return False
        raise


def _earlier(spark: SparkSession, folder: str, batch: int, schema: str | None = None) -> DataFrame | None:
    """Rows of all batches before this one; a batch folder is written whole, so a repeat replaces it."""
    if not _exists(spark, folder):
        return None
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(folder)
    return rows.where(F.col("batch") < batch)


def batch_writer(
    spark: SparkSession, job: Job, target: str, with_entities: bool = True, fan: int = FAN
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: extract, then write results, new cache rows and the entities that this batch meets.

    Results and cache rows go to a folder named after the batch and replace it. The entities become one part of the
    stored state, which takes the place of the part of the same batch; where that part is merged already, a repeat adds
    nothing new. So a batch that is run again after a failure leaves the same tables, and none rewrites entities it
    did not meet but for the merging of ``fan`` parts of a size.
    """

    def write(docs: DataFrame, batch: int) -> None:
        cached = _earlier(spark, f"{target}/cache", batch, CACHE)
        cache = empty_cache(spark) if cached is None else cached.drop("batch")
        done = extract(docs, job, cache=cache)
        results = staged(done.results, "results")
        results.write.mode("overwrite").parquet(f"{target}/results/batch={batch}")
        fresh = done.fresh.where("response_json is not null").select(
            "request_key", "response_json", F.lit(job.analyzed_at or EPOCH).cast("timestamp_ntz").alias("created_at"),
            F.substring("request_key", 1, PREFIX_LENGTH).alias("prefix"),
        )
        # By prefix, so that a later batch reads only the folders of its own keys.
        fresh.write.mode("overwrite").partitionBy("prefix").parquet(f"{target}/cache/batch={batch}")
        if with_entities:
            good = results.where("status = 'ok'").select("path", *[
                F.col(f"record.{f}").alias(f) for f in job.wanted.fieldNames()
            ])
            mentions = normalise(good, job.wanted, "path", batch=batch).mentions
            store = Snapshots(spark, f"{target}/state")
            parts = store.tables().get(ENTITY_TABLE, [])
            met = store.write(entity_tables(mentions), ENTITY_TABLE, label=str(batch))
            store.commit({ENTITY_TABLE: store.compacted(
                ENTITY_TABLE, with_part(parts, met), lambda rows: merged(rows, ENTITY_KEYS), fan=fan
            )})

    return write


def run_available(
    spark: SparkSession, source: str, schema: str, job: Job, target: str, checkpoint: str, *, with_entities: bool = True,
    files_per_batch: int | None = None, fan: int = FAN,
) -> None:
    """Process the files of ``source`` that no earlier run has seen, then stop."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.parquet(source)
        .writeStream.foreachBatch(batch_writer(spark, job, target, with_entities, fan))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def results(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/results")


def latest_entities(spark: SparkSession, target: str) -> DataFrame | None:
    """The state after the last whole batch; None before the first one."""
    return Snapshots(spark, f"{target}/state").read_merged(ENTITY_TABLE, ENTITY_KEYS)
