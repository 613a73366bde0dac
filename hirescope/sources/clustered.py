"""Tables stored in files that each hold a range of rows, with their bounds.

A model's ``ORDER BY`` is lost once its table is read, but the files that a
sorted write leaves can be told apart by what they hold. ``write_clustered``
keeps the smallest and largest value per file of the columns asked for;
``read_clustered`` opens only the files that can hold rows of a range. Both
are whole: rows with NULLs are stored (and are in no range), and an empty
table gives an empty one.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_000_000


def write_clustered(df: DataFrame, folder: str, order: list[str | Column], bounded: list[str],
                    rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store ``df`` sorted by ``order`` across files of ``rows_per_file`` rows at
    most, and the bounds of ``bounded`` per file (read from the stored columns;
    one row per file). ``folder`` must not exist."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order).write
       .option("maxRecordsPerFile", rows_per_file).parquet(f"{folder}/rows"))
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
    ends = [agg(F.col(c)).alias(f"{name}_{i}") for i, c in enumerate(bounded) for name, agg in (("low", F.min), ("high", F.max))]
    names = F.array(*[F.lit(c) for c in bounded]).alias("bounded")
    (stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(*ends).withColumn("bounded", names)
           .coalesce(1).write.parquet(f"{folder}/bounds"))


def _within(low: Column, high: Column, start, end) -> Column:
    """Whether [low, high] meets the range from ``start`` to before ``end``."""
    meets = low.isNotNull()
    if start is not None:
        meets &= high >= F.lit(start)
    if end is not None:
        meets &= low < F.lit(end)
    return meets


def read_clustered(spark: SparkSession, folder: str, ranges: dict[str, tuple] | None = None) -> DataFrame:
    """The stored rows whose columns lie in ``ranges``: ``{column: (start, end)}``,
    from ``start`` on and before ``end``, None for an open side. Columns without
    bounds may be asked for as well; they filter rows, not files.

    The names of the files to open come to the driver, as those of all files
    do in a plain scan.
    """
    everything = f"{folder}/rows"
    if not ranges:
        return spark.read.parquet(everything)
    bounds = spark.read.parquet(f"{folder}/bounds")
    first = bounds.select("bounded").first()
    held = [] if first is None else first["bounded"]
    for i, c in enumerate(held):
        if c in ranges:
            bounds = bounds.where(_within(F.col(f"low_{i}"), F.col(f"high_{i}"), *ranges[c]))
    files = [r["file"] for r in bounds.select("file").collect()]
    rows = spark.read.parquet(*[f"{everything}/{name}" for name in files]) if files else spark.read.parquet(everything).limit(0)
    for c, (start, end) in ranges.items():
        rows = rows.where(_within(F.col(c), F.col(c), start, end))
    return rows
