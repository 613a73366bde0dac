"""Keep the newest scrape of every posting up to date as raw files land.

The raw postings folder only ever grows (a new scrape lands every few
hours). Rescanning all of it to deduplicate is what a batch rebuild does;
here a Structured Streaming aggregation reads each new file once and keeps
one row per ``job_url`` in the state store: the maximum of
``struct(scraped_at, <other columns>)``. Struct ordering compares field by
field with NULL lowest, which is the same total order ``latest_per_key``
uses (newest ``scraped_at`` first, NULL last, remaining columns as
tie-break), so the state equals the batch dedup at every point.

Each trigger emits the keys it changed and nothing else; they are merged into
a stored table of latest postings, dealt by key into buckets, of which only
those touched are written again. Descriptions are not part of the stream:
``silver_from_latest`` joins the table to whatever descriptions there are
when it is called, so new descriptions reach the silver model with or without
new postings. State lives under the query's checkpoint location, so a lost
executor or a restarted job resumes from the last committed batch; a batch
that is replayed merges the same rows again.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hirescope.functions.dates import parse_posted_date
from hirescope.plans.silver import with_descriptions
from hirescope.sources.schemas import POSTINGS_RAW, conform
from hirescope.sources.sinks import delete_folder, staging_folder

KEY = "job_url"
# Spark's built-in RocksDB state store: state on local disk, not the JVM heap.
ROCKSDB_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ORDER = ["scraped_at", "title", "company", "location", "posted_date",
          "search_keyword", "search_location"]


def latest_state(raw: DataFrame) -> DataFrame:
    """Newest row per key as a plain aggregate (works on streams and batches)."""
    latest = raw.groupBy(KEY).agg(F.max(F.struct(*_ORDER)).alias("__latest"))
    return latest.select(KEY, *[F.col(f"__latest.{c}").alias(c) for c in _ORDER])


def with_seen_dates(latest: DataFrame) -> DataFrame:
    """Date parsing and seen bounds on one-row-per-key input.

    With one row per key, min and max of ``scraped_at`` over the key are the
    row's own ``scraped_at``; no window is needed.
    """
    return latest.select(
        "job_url", "title", "company", "location",
        parse_posted_date("posted_date").alias("posted_date"),
        "search_keyword", "search_location",
        F.col("scraped_at").alias("first_seen_at"),
        F.col("scraped_at").alias("last_seen_at"),
    )


BUCKETS = 64
_BUCKET = "bucket"


def bucketed(latest: DataFrame, buckets: int) -> DataFrame:
    """Latest postings with the bucket of their key (NULL has one as well)."""
    return latest.withColumn(_BUCKET, F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int"))


def merge_latest(changed: DataFrame, target: str, buckets: int = BUCKETS) -> None:
    """Put changed rows (one per key) in the place of their keys' rows in the
    Parquet folder ``target``, writing only the buckets they fall into.

    The merged buckets are stored under the checkpoint folder before the old
    ones are overwritten, so nothing is read while it is replaced.
    """
    spark = changed.sparkSession
    folder = staging_folder(spark)
    try:
        bucketed(changed, buckets).write.parquet(f"{folder}/changed")
        rows = spark.read.parquet(f"{folder}/changed")
        try:
            old = spark.read.schema(rows.schema).parquet(target)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            # At most one entry per bucket.
            touched = [r[0] for r in rows.select(_BUCKET).distinct().collect()]
            keys = rows.select(F.col(KEY).alias("__key"))
            kept = old.where(F.col(_BUCKET).isin(touched)).join(keys, F.col(KEY).eqNullSafe(F.col("__key")), "left_anti")
            kept.unionByName(rows).write.parquet(f"{folder}/merged")
            rows = spark.read.parquet(f"{folder}/merged")
        (rows.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(_BUCKET).parquet(target))
    finally:
        delete_folder(spark, folder)


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """The stored latest postings with their seen dates."""
    return spark.read.parquet(target).drop(_BUCKET)


def silver_from_latest(spark: SparkSession, target: str, read_descriptions: Callable[[], DataFrame]) -> DataFrame:
    """The whole silver model from the stored latest postings and the
    descriptions there are now; ``read_descriptions`` is called here, since a
    DataFrame keeps the file list it was made with."""
    return with_descriptions(read_latest(spark, target), read_descriptions())


def latest_postings_stream(spark: SparkSession, raw_dir: str, checkpoint: str, target: str,
                           available_now: bool = True, trigger_interval: str = "1 minute",
                           max_files_per_trigger: int | None = None,
                           schema=None, state_partitions: int | None = None,
                           state_store_provider: str | None = None, buckets: int = BUCKETS,
                           after_merge: Callable[[], None] | None = None) -> StreamingQuery:
    """Start the upkeep of the latest postings stored in the folder ``target``.

    ``available_now`` processes everything that has landed and stops (a
    scheduled run); otherwise the query looks for new files every
    ``trigger_interval`` and calls ``after_merge`` when it has merged some.
    ``schema`` defaults to the landed files' own schema (checked against the
    declared columns), so ``scraped_at`` keeps its timestamp flavour.
    ``state_partitions`` fixes the number of state-store partitions (default:
    the session's shuffle partitions); it is recorded in the checkpoint on the
    first run and kept on every restart, so size it for the eventual number of
    postings. ``state_store_provider`` (e.g. ``ROCKSDB_STATE_STORE``, for
    state far larger than executor memory) is likewise fixed at the first run,
    and so is ``buckets``, by what is stored.
    """
    if schema is None:
        schema = conform(spark.read.parquet(raw_dir), POSTINGS_RAW, "postings_raw").schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.parquet(raw_dir)

    def write(batch: DataFrame, _batch_id: int) -> None:
        merge_latest(with_seen_dates(batch), target, buckets)
        if after_merge is not None:
            after_merge()

    writer = (latest_state(raw).writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint).foreachBatch(write))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger_interval)
    # The query copies the session's settings when it starts, so these are
    # set only around start().
    overrides = {}
    if state_partitions is not None:
        overrides["spark.sql.shuffle.partitions"] = str(state_partitions)
    if state_store_provider is not None:
        overrides["spark.sql.streaming.stateStore.providerClass"] = state_store_provider
    before = {k: spark.conf.get(k, None) for k in overrides}
    for k, v in overrides.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
