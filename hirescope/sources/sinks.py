"""Sinks: publish a model as a table, and append keyword snapshots per date."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from hirescope.session import ensure_checkpoint_dir

# The catalog names the source project reads and writes.
BRONZE_SCHEMA = "bronze"
SILVER_SCHEMA = "silver"
GOLD_SCHEMA = "gold"
POSTINGS_RAW_TABLE = "linkedin_postings_raw"
DESCRIPTIONS_RAW_TABLE = "linkedin_postings_descriptions_raw"
KEYWORD_SNAPSHOTS_TABLE = "linkedin_keyword_snapshots"
MODEL_TABLES = {
    "silver_postings": (SILVER_SCHEMA, "silver_linkedin_postings"),
    "experience_requirements": (SILVER_SCHEMA, "silver_experience_requirements"),
    "experience_distribution": (GOLD_SCHEMA, "gold_experience_distribution"),
    "keyword_latest": (GOLD_SCHEMA, "gold_keyword_latest"),
    "keyword_trends": (GOLD_SCHEMA, "gold_keyword_trends"),
}


def schema_name(custom_schema: str | None, target_schema: str) -> str:
    """Output schema of a model: its own schema verbatim (trimmed) when it
    has one, else the run's target schema. No ``<target>_<custom>`` prefix."""
    return target_schema if custom_schema is None else custom_schema.strip()


def quoted(name: str) -> str:
    """A dotted table or schema name with each part quoted (``job_market.silver``
    names a schema of a catalog)."""
    parts = [part.strip(" `") for part in name.split(".")]
    if not all(parts) or len(parts) > 3:
        raise ValueError(f"not a table or schema name: {name!r}")
    return ".".join(f"`{part}`" for part in parts)


def _session_catalog(name: str) -> bool:
    """Whether a table name is one of the session catalog's."""
    parts = name.replace("`", "").split(".")
    return len(parts) < 3 or parts[0] == "spark_catalog"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever the cluster's file systems have it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def publish(df: DataFrame, schema: str, table: str, path: str | None = None) -> DataFrame:
    """Replace ``schema.table`` with ``df`` as a whole and return the stored
    table, so downstream models read the written data (lineage is cut).

    ``schema`` may name a catalog as well. Another catalog than the session's
    replaces the table itself. In the session catalog the rows are written to
    a new version folder first and the table is then pointed at it: a run that
    fails while writing leaves the old table as it was, and readers see either
    version whole. The version before stays for readers that began on it; the
    one before that goes.

    Sort order inside ``df`` only fixes write order; readers must sort again.
    With ``path`` the versions are kept under that folder.
    """
    spark = df.sparkSession
    name = f"{quoted(schema)}.{quoted(table)}"
    if not _session_catalog(name):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(schema)}")
        df.writeTo(name).createOrReplace()
        return spark.read.table(name)
    return point_at(spark, schema, table, write_version(df, schema, table, path))


def write_version(df: DataFrame, schema: str, table: str, path: str | None = None) -> str:
    """Write ``df`` to a new version folder of a table of the session catalog,
    which no reader sees yet, and return the folder."""
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(schema)}")
    if path is None:
        described = spark.sql(f"DESCRIBE DATABASE {quoted(schema)}").collect()
        root = next(r[1] for r in described if r[0] == "Location")
        path = f"{root.rstrip('/')}/{table}__versions"
    version = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    return version


def point_at(spark: SparkSession, schema: str, table: str, version: str) -> DataFrame:
    """Point a table of the session catalog at a version folder; the version
    before stays, the one before that goes."""
    name = f"{quoted(schema)}.{quoted(table)}"
    stored = spark.read.parquet(version).schema
    before = _table_properties(spark, name)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.fields)
    same = before is not None and before["external"] and spark.read.table(name).schema.simpleString() == stored.simpleString()
    if same:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{version}'")
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('previous_version' = '{before['location']}')")
        if before["previous"]:
            delete_folder(spark, before["previous"])
    else:
        # Another shape (or a table Spark stores itself): made anew, now that
        # its rows are stored.
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{version}'")
    spark.catalog.refreshTable(name)
    return spark.read.table(name)


BUILD_TABLE = "hirescope_build"


def commit_build(spark: SparkSession, versions: dict[str, tuple[str, str, str]], target_schema: str) -> None:
    """Make the versions of one build, ``{model: (schema, table, folder)}``,
    the ones readers see.

    The manifest, ``target_schema``.``BUILD_TABLE`` with one row per model,
    is switched first, by one statement: ``read_build`` sees all models of the
    old build or all of the new one. The tables follow, one by one; should
    that fail half-way, the manifest names stored versions all the same, as a
    table gives up a version only at the second switch after it. Models that
    this build leaves out keep their row.
    """
    if not versions:
        return
    rows = {m: (m, schema, table, folder) for m, (schema, table, folder) in versions.items()}
    name = f"{quoted(target_schema)}.{quoted(BUILD_TABLE)}"
    if spark.catalog.tableExists(name):
        rows = {r["model"]: tuple(r) for r in spark.read.table(name).collect()} | rows
    manifest = spark.createDataFrame(list(rows.values()), "model string, schema string, table string, version string")
    publish(manifest.coalesce(1), target_schema, BUILD_TABLE)
    for schema, table, folder in versions.values():
        point_at(spark, schema, table, folder)


def read_build(spark: SparkSession, target_schema: str = "default") -> dict[str, DataFrame]:
    """The stored models as one build left them, whatever is being switched."""
    rows = spark.read.table(f"{quoted(target_schema)}.{quoted(BUILD_TABLE)}").collect()
    return {r["model"]: spark.read.parquet(r["version"]) for r in rows}


def _table_properties(spark: SparkSession, name: str) -> dict | None:
    """Location, kind and previous version of a table; None if there is none."""
    if not spark.catalog.tableExists(name):
        return None
    about = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    previous = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}.get("previous_version")
    return {"location": about.get("Location"), "external": about.get("Type") == "EXTERNAL", "previous": previous}


class SnapshotLayout(ValueError):
    pass


def write_snapshot(df: DataFrame, target: str) -> None:
    """Append one day of keyword counts, partitioned by ``snapshot_date``.

    ``target`` is a Parquet folder (contains ``/``) or a catalog table.
    Dynamic partition overwrite replaces only the dates present in ``df``,
    so re-running a day does not duplicate its rows and leaves other days
    untouched. A table that is not partitioned by ``snapshot_date`` alone is
    refused: overwriting a day there would delete all others. Columns go by
    their names, whatever their order in the table.
    """
    cols = ["keyword", "posting_count", "snapshot_date"]
    df = df.select(*cols)
    if "/" in target:
        (df.write.mode("overwrite")
           .option("partitionOverwriteMode", "dynamic")
           .partitionBy("snapshot_date")
           .parquet(target))
        return
    spark = df.sparkSession
    name = quoted(target)
    if not spark.catalog.tableExists(name):
        df.write.format("parquet").partitionBy("snapshot_date").saveAsTable(name)
        return
    columns = spark.catalog.listColumns(name)
    parts = [c.name for c in columns if c.isPartition]
    if [p.lower() for p in parts] != ["snapshot_date"]:
        raise SnapshotLayout(f"{target} is partitioned by {parts or 'nothing'}, not by snapshot_date; "
                             "writing one day would delete the others")
    names = {c.name.lower(): c.name for c in columns}
    if sorted(names) != sorted(cols):
        raise SnapshotLayout(f"{target} has columns {sorted(names)}, not {sorted(cols)}")
    # insertInto goes by position and ignores the per-write option; the
    # session setting is switched for this one statement and restored.
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        df.select(*[c.name for c in columns]).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(key, before)


# Folders that ``stage`` wrote, by application, for ``release_staged``.
_STAGED: dict[str, list[str]] = {}


def _application(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # Spark Connect hides the context
        return "session"


def staging_folder(spark: SparkSession) -> str:
    """A new folder for intermediate rows under the session's checkpoint folder
    (shared storage on a cluster; a local one is made only when the session
    names none). Grouped per application, so a finished run's folders go as one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage/{_application(spark)}/{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under a staging folder and return the
    stored copy.

    For a model read by several consumers (silver postings feeds the
    requirements twice): it is computed once, its lineage is cut, and each
    reader prunes the stored columns it does not need. ``release_staged``
    deletes the folder.
    """
    spark = df.sparkSession
    folder = staging_folder(spark)
    df.write.parquet(f"{folder}/{name}")
    _STAGED.setdefault(_application(spark), []).append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def release_staged(spark: SparkSession) -> int:
    """Delete what this application staged (its readers must be done); how many
    folders that were."""
    folders = _STAGED.pop(_application(spark), [])
    for folder in folders:
        delete_folder(spark, folder)
    return len(folders)
