"""Gold models: experience distribution and keyword shares."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirescope.functions.experience import band_rank, experience_band
from hirescope.functions.noise import NOISE_TERMS, is_long_enough, is_signal_keyword
from hirescope.functions.shares import share_pct
from hirescope.operators.aggregates import count_share_by, distinct_count, max_value
from hirescope.sources.clustered import ROWS_PER_FILE, read_clustered, write_clustered


def experience_distribution(requirements: DataFrame, ordered: bool = True) -> DataFrame:
    """M3: postings per experience band and their share of all postings.

    Empty bands are absent; the share's denominator includes
    ``not_specified``. Output is sorted by band rank (five rows at most).
    """
    out = count_share_by(
        requirements, experience_band("years_min"), "experience_band",
    ).select("experience_band", "posting_count", "pct")
    if not ordered:
        return out
    # At most five rows by construction: sort them in one partition instead
    # of range-partitioning (which samples the input in an extra job).
    return out.coalesce(1).sortWithinPartitions(band_rank("experience_band"))


def described_total(silver: DataFrame) -> DataFrame:
    """One row: distinct posting keys that have a description."""
    return distinct_count(
        silver.where(F.col("description_text").isNotNull()), "job_url", "total_postings"
    )


def described_rows(descriptions_raw: DataFrame) -> DataFrame:
    """Descriptions that count: status ``ok`` and a text."""
    return descriptions_raw.where((F.col("fetch_status") == "ok") & F.col("description_text").isNotNull())


def described_postings(postings_raw: DataFrame, descriptions_raw: DataFrame) -> DataFrame:
    """``described_total`` from the raw tables: distinct postings that have an
    ``ok`` description with a text. Neither the newest scrape of a posting nor
    the fan-out of its descriptions changes that number, so no window runs and
    no text is joined."""
    described = described_rows(descriptions_raw).select("job_url")
    keys = postings_raw.select("job_url").distinct()
    return keys.join(described, "job_url", "left_semi").agg(F.count(F.lit(1)).alias("total_postings"))


def latest_snapshot_date(snapshots: DataFrame) -> DataFrame:
    """One row: the newest snapshot date over all keywords, noise included."""
    return max_value(snapshots, "snapshot_date", "max_date")


def signal_keywords(snapshots: DataFrame, noise=NOISE_TERMS) -> DataFrame:
    """Snapshot rows whose keyword is neither noise nor a single character.

    ``noise`` is a list, written into the plan as a literal set that the scan
    takes, or, where it grows too long for that, a DataFrame with a
    ``keyword`` column: then an anti join, which Spark broadcasts only while
    the list is small. A NULL keyword is dropped either way; a NULL in the
    table is no term (it does not empty the result, as it would in
    ``NOT IN``), and repeated terms count once.
    """
    if isinstance(noise, DataFrame):
        terms = noise.select(F.col("keyword").alias("keyword")).where(F.col("keyword").isNotNull()).distinct()
        return snapshots.where(is_long_enough("keyword")).join(terms, "keyword", "left_anti").select(*snapshots.columns)
    return snapshots.where(is_signal_keyword("keyword", noise))


def _with_share(snapshots: DataFrame, silver: DataFrame | None, total: int | DataFrame | None) -> DataFrame:
    # A precomputed total is cast to bigint so the share has the same
    # decimal type (and the same ANSI zero-division) as the subquery form.
    if isinstance(total, int):
        denominator = F.lit(total).cast("bigint")
    else:
        denominator = (described_total(silver) if total is None else total).scalar()
    return snapshots.withColumn("pct", share_pct(F.col("posting_count"), denominator))


def keyword_latest(snapshots: DataFrame, silver: DataFrame | None, noise=NOISE_TERMS,
                   ordered: bool = True, total: int | DataFrame | None = None,
                   newest_date: dt.date | None = None) -> DataFrame:
    """M4: keyword shares on the newest snapshot date.

    Sorted by count descending as in the source; ``keyword`` breaks ties.
    The source leaves ties unordered, and without a tie-break the range
    partitioner of the sort would send every row of one count (typically
    the long tail at 1) to a single task.

    The newest date is taken before the noise filter, so the result is empty
    when that day holds only noise. Shares divide by today's described
    postings, so they are not bounded by 100. ``newest_date`` is that date if it
    is known from the partitions (``sources.newest_partition_date``): no row is
    read to find it, and the scan is pruned when it is planned.
    """
    latest = latest_snapshot_date(snapshots).scalar() if newest_date is None else F.lit(newest_date)
    rows = signal_keywords(snapshots.where(F.col("snapshot_date") == latest), noise)
    out = _with_share(rows, silver, total).select("keyword", "posting_count", "snapshot_date", "pct")
    return out.orderBy(F.col("posting_count").desc(), "keyword") if ordered else out


def keyword_trends(snapshots: DataFrame, silver: DataFrame | None, noise=NOISE_TERMS,
                   ordered: bool = True, total: int | DataFrame | None = None) -> DataFrame:
    """M5: keyword shares on every snapshot date (column order differs from M4).

    ``total`` may be passed: the number itself, when M4 and M5 are built
    together, or the one-row frame of ``described_postings``, which needs no
    silver table.
    """
    rows = signal_keywords(snapshots, noise)
    out = _with_share(rows, silver, total).select("keyword", "snapshot_date", "posting_count", "pct")
    return out.orderBy("snapshot_date", F.col("posting_count").desc(), "keyword") if ordered else out


def store_trends(trends: DataFrame, folder: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """M5 stored so that a span of dates and a range of keywords each lead to a
    few files: months apart, keywords sorted inside a month. Readers that want
    the report's order sort again, as after any write."""
    month = F.trunc("snapshot_date", "month")
    write_clustered(trends, folder, [month, "keyword", "snapshot_date"], ["snapshot_date", "keyword"], rows_per_file)


def stored_trends(spark: SparkSession, folder: str, keywords: tuple = (None, None), dates: tuple = (None, None)) -> DataFrame:
    """Stored M5 rows of keywords and dates from the first to before the second
    of each pair (None: open); of the rest no file is opened."""
    asked = {"keyword": keywords, "snapshot_date": dates}
    return read_clustered(spark, folder, {c: r for c, r in asked.items() if r != (None, None)})
