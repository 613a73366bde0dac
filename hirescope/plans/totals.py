"""The described total kept from append to append instead of counted anew.

The landing tables only grow, and a posting counts once it was both scraped
and described, so what a part of them adds can be merged exactly. A state
folder holds ``keys`` (each posting key and a number of its own, dense in each
of ``buckets`` shares of the keys, so that tasks number them on their own) and
``bits``: per part, which numbers it scraped and which it described, as pages
of 32,768 bits. The total is the count of the bits in both kinds of pages
united over the parts; no key is read for it.

One writer at a time. A part written again replaces its bits, and a run that
failed on the way is mended by writing the part again: numbers once given
stay, whatever ``buckets`` is later on. NULL keys belong to no posting; a part
may hold postings or descriptions only, repeat keys of others, or be empty.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirescope.plans.gold import described_rows
from hirescope.sources.sinks import stage

BUCKETS = 1024
# A share's numbers: its own number in the high bits, counted from 1 below.
_SHARE_BITS = 40
_POSTED, _DESCRIBED = 0, 1
_KEYS = "job_url string, key_id long"
_BITS = "mark int, page long, bits binary, part string"


def _state(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    spark.createDataFrame([], schema).write.mode("ignore").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _numbered(new: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    share = F.pmod(F.xxhash64("job_url"), F.lit(buckets))
    last = known.groupBy(F.shiftright("key_id", _SHARE_BITS).alias("share")).agg(F.max("key_id").alias("last"))
    place = F.row_number().over(Window.partitionBy("share").orderBy("job_url"))
    rows = new.withColumn("share", share).withColumn("place", place).join(last, "share", "left")
    start = F.coalesce("last", F.shiftleft("share", _SHARE_BITS))
    return rows.select("job_url", (start + F.col("place")).alias("key_id"))


def keep_described(state: str, part: str, postings_raw: DataFrame, descriptions_raw: DataFrame,
                   buckets: int = BUCKETS) -> None:
    """Add one part of the landing tables to the state. Of the tables themselves
    only that part is read, of the state the keys."""
    spark = postings_raw.sparkSession
    posted = postings_raw.select("job_url", F.lit(_POSTED).alias("mark"))
    described = described_rows(descriptions_raw).select("job_url", F.lit(_DESCRIBED).alias("mark"))
    marks = stage(posted.union(described).where("job_url is not null").distinct(), "marks")
    known = _state(spark, f"{state}/keys", _KEYS)
    new = marks.select("job_url").distinct().join(known, "job_url", "left_anti")
    _numbered(new, known, buckets).write.mode("append").parquet(f"{state}/keys")

    known = spark.read.schema(_KEYS).parquet(f"{state}/keys")
    bits = marks.join(known, "job_url").groupBy("mark", F.bitmap_bucket_number("key_id").alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("key_id")).alias("bits"))
    # A page of no bits, so that a part without keys replaces what it had too.
    none = spark.range(1).select(F.lit(_POSTED).alias("mark"), F.lit(-1).cast("long").alias("page"),
                                 F.lit(None).cast("binary").alias("bits"))
    (bits.union(none).withColumn("part", F.lit(part)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{state}/bits"))


def kept_described_total(spark: SparkSession, state: str) -> DataFrame:
    """One row, as ``described_total``, from the bits of all parts."""
    bits = spark.read.schema(_BITS).parquet(f"{state}/bits").where("page >= 0")
    united = bits.groupBy("page", "mark").agg(F.bitmap_or_agg("bits").alias("bits"))
    # A page of one kind alone holds no posting that is scraped and described.
    both = united.groupBy("page").agg(F.count(F.lit(1)).alias("kinds"), F.bitmap_and_agg("bits").alias("bits")).where("kinds = 2")
    return both.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("total_postings"))
