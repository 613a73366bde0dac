"""Bindings from the shared test tables to the three source shapes.

The test tables hold no job postings, so each source is derived from one of
them by a fixed rule (documented in FIXTURES.md). Every rule is a plain
projection or aggregate, so the derived tables grow with the test tables
and the same rules are restated in SQL for the DuckDB oracle
(``hirescope.oracle``).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirescope.functions.text import tokens
from hirescope.sources.schemas import (
    DESCRIPTIONS_RAW,
    KEYWORD_SNAPSHOTS,
    NOISE_TABLE,
    POSTINGS_RAW,
    conform,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def postings_raw_from_events(events: DataFrame) -> DataFrame:
    """B1: one raw scrape per event; every 20th user id lands without a URL."""
    et = F.col("event_type")
    posted = (
        F.when(et == "view", F.to_date(F.col("ts")).cast("string"))
        .when(et == "click", F.lit("3 days ago"))
        .when(et == "error", F.lit("2024-02-31"))
        .when(et == "purchase", F.lit("2024-1-5"))
    )
    df = events.select(
        F.when(F.col("user_id") % 20 == 7, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("job/"), F.col("user_id").cast("string")))
        .alias("job_url"),
        et.alias("title"),
        F.concat(F.lit("company "), (F.col("event_id") % 13).cast("string")).alias("company"),
        F.concat(F.lit("city "), F.floor("value").cast("string")).alias("location"),
        posted.alias("posted_date"),
        F.col("props").alias("search_keyword"),
        F.concat(F.lit("area "), (F.col("event_id") % 5).cast("string")).alias("search_location"),
        F.col("ts").alias("scraped_at"),
    )
    return conform(df, POSTINGS_RAW, "postings_raw")


# The posting that ``hot_descriptions_raw`` gives every third description.
HOT_POSTING = "job/8"


def descriptions_raw_from_part(part: DataFrame, hot: bool = False) -> DataFrame:
    """B2: four descriptions of one variant to a key, so keys fan out and their
    number grows with the table; ``hot`` moves every third to one posting and
    makes every 97th text two hundred times as long."""
    size, name, key = F.col("p_size"), F.col("p_name"), F.col("p_partkey")
    variant = key % 6
    s = lambda c: c.cast("string")
    text = (
        F.when(variant == 0, F.concat(F.lit("Needs "), s(size % 25), F.lit("+ Years with "), name))
        .when(variant == 1, F.concat(s(size % 9), F.lit("-"), s(size % 9 + 2), F.lit(" years of "), name))
        .when(variant == 2, F.concat(F.lit("about "), s(size), F.lit(" yrs "), name))
        .when(variant == 3, F.concat(F.lit("100 years of "), name, F.lit(", "), s(size % 12), F.lit(" year")))
        .when(variant == 5, F.concat(F.lit("the "), name, F.lit(" team, no requirement")))
    )
    if hot:
        text = F.when(key % 97 == 0, F.repeat(F.concat(text, F.lit(" ")), F.lit(200))).otherwise(text)
    status = (
        F.when(F.col("p_type") == "SMALL", F.lit("error"))
        .when((F.col("p_type") == "ECONOMY") & (size % 7 == 0), F.lit(None).cast("string"))
        .otherwise(F.lit("ok"))
    )
    df = part.select(
        F.when(F.lit(hot) & (key % 3 == 0), F.lit(HOT_POSTING))
        .otherwise(F.concat(F.lit("job/"), s(F.expr("p_partkey div 24 * 6 + p_partkey % 6")))).alias("job_url"),
        text.alias("description_text"),
        status.alias("fetch_status"),
    )
    return conform(df, DESCRIPTIONS_RAW, "descriptions_raw")


def keyword_snapshots_from_events(events: DataFrame) -> DataFrame:
    """B3: daily distinct-user counts per event type, renamed to keywords."""
    et = F.col("event_type")
    keyword = (
        F.when(et == "error", F.lit("security"))
        .when(et == "signup", F.lit("k"))
        .when(et == "view", F.lit("View"))
        .otherwise(et)
    )
    df = (
        events.groupBy(keyword.alias("keyword"), F.to_date(F.col("ts")).alias("snapshot_date"))
        .agg(F.countDistinct("user_id").alias("posting_count"))
    )
    return conform(df, KEYWORD_SNAPSHOTS, "keyword_snapshots")


def postings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings_raw_from_events(_table(spark, sf_dir, "events"))


def descriptions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descriptions_raw_from_part(_table(spark, sf_dir, "part"))


def hot_descriptions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 with every third description moved to one posting."""
    return descriptions_raw_from_part(_table(spark, sf_dir, "part"), hot=True)


def keyword_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_snapshots_from_events(_table(spark, sf_dir, "events"))


def keyword_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms to look for, from the names in ``part``: each name capitalized, and
    a longer phrase around it."""
    name = F.initcap("p_name")
    terms = F.array(name, F.concat(F.lit("The "), name, F.lit(" Team, no")))
    return _table(spark, sf_dir, "part").select(F.explode(terms).alias("keyword"))


def noise_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5: a noise list as it would be gathered by hand, from ``events``: each
    error notes ``security``, each click ``click``, all else nothing (NULL)."""
    et = F.col("event_type")
    term = F.when(et == "error", F.lit("security")).when(et == "click", F.lit("click"))
    return conform(_table(spark, sf_dir, "events").select(term.alias("keyword")), NOISE_TABLE, "noise_terms")


def long_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6: the first twelve tokens and the first token of every ``benchmark``
    text, passages of which stand in ``documents``."""
    words = tokens(F.col("text"))
    terms = F.array(F.array_join(F.slice(words, 1, 12), " "), F.get(words, F.lit(0)))
    return _table(spark, sf_dir, "benchmark").select(F.explode(terms).alias("keyword"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over the cores if its scan has fewer partitions than
    there are cores (a table stored as one row group, which a scan cannot
    split); as it is otherwise, so nothing is shuffled on large input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df


def documents_as_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` seen as fetched descriptions, one posting per doc."""
    df = _table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("job_url"),
        F.col("text").alias("description_text"),
        F.lit("ok").alias("fetch_status"),
    )
    return conform(df, DESCRIPTIONS_RAW, "descriptions_raw")
