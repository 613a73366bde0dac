"""Declared shapes of the three source tables.

The landing tables carry no declared columns or constraints; the shapes
below follow from how the models use them. Extra columns are ignored,
missing ones are an error raised before any job runs.
"""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POSTINGS_RAW = T.StructType([
    T.StructField("job_url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("posted_date", T.StringType()),
    T.StructField("search_keyword", T.StringType()),
    T.StructField("search_location", T.StringType()),
    T.StructField("scraped_at", T.TimestampType()),
])

DESCRIPTIONS_RAW = T.StructType([
    T.StructField("job_url", T.StringType()),
    T.StructField("description_text", T.StringType()),
    T.StructField("fetch_status", T.StringType()),
])

KEYWORD_SNAPSHOTS = T.StructType([
    T.StructField("keyword", T.StringType()),
    T.StructField("posting_count", T.LongType()),
    T.StructField("snapshot_date", T.DateType()),
])

NOISE_TABLE = T.StructType([
    T.StructField("keyword", T.StringType()),
])

_NUMBERS = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())


class SchemaMismatch(ValueError):
    pass


def _as_declared(column, actual: T.DataType, declared: T.DataType):
    """``column`` in its declared type, or None if ``actual`` cannot stand in.

    Integer widths are widened. Dates and timestamps may stand for strings
    (``posted_date`` is parsed as a date later) and strings or dates for
    timestamps; a string that is no timestamp becomes NULL, like a
    ``posted_date`` that is no date. Timestamps keep their own flavour (NTZ or
    LTZ), so dates never shift with the session time zone.
    """
    if actual == declared or isinstance(actual, T.NullType):
        return column.cast(declared)
    if declared == T.TimestampType():
        if isinstance(actual, T.TimestampNTZType):
            return column
        return column.try_cast("timestamp_ntz") if isinstance(actual, (T.StringType, T.DateType)) else None
    if declared == T.LongType() and actual in _NUMBERS:
        return column.cast(declared)
    if declared == T.StringType() and isinstance(actual, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.cast(declared)
    return None


def conform(df: DataFrame, schema: T.StructType, name: str = "source") -> DataFrame:
    """Select the declared columns in declared order, checking names and types.

    Narrowing here (instead of ``SELECT *``) lets Catalyst prune every other
    column from the Parquet scan. Names match in any case, as they do in SQL;
    an exact match goes before one in another case.
    """
    have = {}
    for f in df.schema.fields:
        have.setdefault(f.name.lower(), f)
    have.update({f.name: f for f in df.schema.fields if f.name == f.name.lower()})
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise SchemaMismatch(f"{name}: missing columns {missing}")
    cols = []
    for field in schema.fields:
        actual = have[field.name]
        column = _as_declared(df[actual.name], actual.dataType, field.dataType)
        if column is None:
            raise SchemaMismatch(
                f"{name}.{field.name}: expected {field.dataType.simpleString()}, "
                f"found {actual.dataType.simpleString()}"
            )
        cols.append(column.alias(field.name))
    return df.select(*cols)
