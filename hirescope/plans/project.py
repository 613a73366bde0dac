"""Build every model in dependency order, each stored once as a table.

Plain function calls stand in for the model-graph runner: silver postings
first (both other silver/gold families read it), then requirements and the
distribution, then the two keyword reports. Each step reads its upstream
from the stored table, as the source project does, so the raw scrape is
deduplicated once per run rather than once per consumer.

In the session catalog no table changes before all selected models are
stored: they are written as new versions, read as such by the models after
them, and switched together (``commit_build``). A build that fails leaves
every table and the manifest as they were.
"""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from hirescope.plans.gold import (
    described_total,
    experience_distribution,
    keyword_latest,
    keyword_trends,
)
from hirescope.plans.silver import experience_requirements, silver_postings
from hirescope.sources.sinks import (
    MODEL_TABLES,
    commit_build,
    delete_folder,
    publish,
    quoted,
    schema_name,
    write_version,
)


def build_all(postings_raw: DataFrame | None, descriptions_raw: DataFrame | None,
              keyword_snapshots: DataFrame | None, target_schema: str = "default",
              location_root: str | None = None,
              custom_schemas: dict[str, str | None] | None = None,
              select: set[str] | None = None, catalog: str | None = None,
              spark: SparkSession | None = None,
              newest_date: dt.date | None = None) -> dict[str, DataFrame]:
    """Run the models (all, or those in ``select``); returns each stored
    table as a DataFrame.

    A model outside ``select`` that a selected one reads is taken from its
    stored table, so e.g. ``select={"keyword_latest", "keyword_trends"}``
    only needs the snapshots and the stored silver postings; the raw
    inputs may then be ``None``. ``custom_schemas`` overrides the per-model
    schema (``None`` means use ``target_schema``); ``location_root`` stores
    tables as external tables under ``<root>/<schema>/<table>``; ``catalog``
    is put before every schema. ``spark`` is needed when no input is given
    (a model built from stored tables alone). ``newest_date`` is the newest
    snapshot date, if known (``sources.newest_partition_date``); otherwise it
    is read from the rows.
    """
    custom = {k: v[0] for k, v in MODEL_TABLES.items()}
    custom.update(custom_schemas or {})
    wanted = set(MODEL_TABLES) if select is None else set(select)
    unknown = wanted - set(MODEL_TABLES)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}; known: {sorted(MODEL_TABLES)}")
    spark = spark or next((df.sparkSession for df in (postings_raw, descriptions_raw, keyword_snapshots)
                           if df is not None), None) or SparkSession.active()
    out: dict[str, DataFrame] = {}
    versions: dict[str, tuple[str, str, str]] = {}
    full = lambda schema: schema if catalog is None else f"{catalog}.{schema}"

    def model(name: str, build) -> DataFrame:
        if name in out:
            return out[name]
        schema = schema_name(custom[name], target_schema)
        table = MODEL_TABLES[name][1]
        if name in wanted:
            path = None if location_root is None else f"{location_root.rstrip('/')}/{schema}/{table}"
            if catalog in (None, "spark_catalog"):
                versions[name] = (full(schema), table, write_version(build(), full(schema), table, path))
                out[name] = spark.read.parquet(versions[name][2])
            else:
                out[name] = publish(build(), full(schema), table, path)
            return out[name]
        return spark.read.table(f"{quoted(full(schema))}.{quoted(table)}")

    silver = lambda: model(
        "silver_postings", lambda: silver_postings(postings_raw, descriptions_raw))
    totals: list[int] = []

    def total() -> int:
        # Both keyword reports divide by the same number; reading the stored
        # silver descriptions for it once (one value reaches the driver).
        if not totals:
            totals.append(described_total(silver()).first()[0])
        return totals[0]

    requirements = lambda: model(
        "experience_requirements", lambda: experience_requirements(silver()))
    builders = {
        "silver_postings": silver,
        "experience_requirements": requirements,
        "experience_distribution": lambda: model(
            "experience_distribution", lambda: experience_distribution(requirements())),
        "keyword_latest": lambda: model(
            "keyword_latest", lambda: keyword_latest(
                keyword_snapshots, silver(), total=total(), newest_date=newest_date)),
        "keyword_trends": lambda: model(
            "keyword_trends", lambda: keyword_trends(keyword_snapshots, silver(), total=total())),
    }
    try:
        for name in MODEL_TABLES:  # dependency order
            if name in wanted:
                builders[name]()
    except BaseException:
        for _, _, folder in versions.values():
            delete_folder(spark, folder)
        raise
    commit_build(spark, versions, full(target_schema))
    return out | {name: spark.read.table(f"{quoted(schema)}.{quoted(table)}") for name, (schema, table, _) in versions.items()}
