"""Publishing models as tables, schema naming, per-date snapshot overwrite."""

import datetime as dt
import tempfile

from hirescope import plans
from hirescope.sources.sinks import MODEL_TABLES, publish, schema_name, write_snapshot
from tests.fixtures import descriptions_df, postings_df, snapshots_df


def test_schema_name():
    assert schema_name(None, "analytics") == "analytics"
    assert schema_name(" gold ", "analytics") == "gold"
    assert schema_name("silver", "analytics") == "silver"


def test_publish_replaces_whole_table(spark):
    root = tempfile.mkdtemp(prefix="hs-pub-")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    publish(df, "hs_test", "t", path=f"{root}/t")
    stored = publish(df.where("id = 2"), "hs_test", "t", path=f"{root}/t")
    assert [tuple(r) for r in stored.collect()] == [(2, "b")]


def test_build_all_reads_back_equal(spark):
    root = tempfile.mkdtemp(prefix="hs-build-")
    raw, desc, snaps = postings_df(spark), descriptions_df(spark), snapshots_df(spark)
    out = plans.build_all(raw, desc, snaps, target_schema="hs_target", location_root=root)
    assert set(out) == set(MODEL_TABLES)
    silver = plans.silver_postings(raw, desc)
    want = {
        "silver_postings": silver,
        "experience_requirements": plans.experience_requirements(silver),
        "experience_distribution": plans.experience_distribution(plans.experience_requirements(silver)),
        "keyword_latest": plans.keyword_latest(snaps, silver),
        "keyword_trends": plans.keyword_trends(snaps, silver),
    }
    for name, df in want.items():
        assert sorted(map(tuple, out[name].collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr), name
    assert spark.catalog.tableExists("gold.gold_keyword_trends")


def test_snapshot_rerun_replaces_only_its_date(spark):
    path = tempfile.mkdtemp(prefix="hs-snap-") + "/snapshots"
    day1 = spark.createDataFrame([("python", 2, dt.date(2026, 1, 1))], snapshots_df(spark).schema)
    day2 = spark.createDataFrame([("python", 3, dt.date(2026, 1, 2))], snapshots_df(spark).schema)
    write_snapshot(day1, path)
    write_snapshot(day2, path)
    write_snapshot(day2, path)  # rerun of day 2
    rows = sorted((r.keyword, r.posting_count, r.snapshot_date) for r in spark.read.parquet(path).collect())
    assert rows == [("python", 2, dt.date(2026, 1, 1)), ("python", 3, dt.date(2026, 1, 2))]


def test_snapshot_into_catalog_table_replaces_only_its_date(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS hs_silver")
    spark.sql("DROP TABLE IF EXISTS hs_silver.kw_snap")
    schema = snapshots_df(spark).schema
    day1 = spark.createDataFrame([("python", 2, dt.date(2026, 1, 1))], schema)
    day2 = spark.createDataFrame([("python", 3, dt.date(2026, 1, 2))], schema)
    write_snapshot(day1, "hs_silver.kw_snap")
    write_snapshot(day2, "hs_silver.kw_snap")
    write_snapshot(day2, "hs_silver.kw_snap")
    rows = sorted((r.keyword, r.posting_count, r.snapshot_date)
                  for r in spark.read.table("hs_silver.kw_snap").collect())
    assert rows == [("python", 2, dt.date(2026, 1, 1)), ("python", 3, dt.date(2026, 1, 2))]


def test_cli_build_and_snapshot(spark):
    from hirescope.__main__ import main
    root = tempfile.mkdtemp(prefix="hs-cli-")
    postings_df(spark).write.parquet(f"{root}/raw")
    descriptions_df(spark).write.parquet(f"{root}/desc")
    snapshots_df(spark).write.parquet(f"{root}/snaps")
    assert main(["build", "--postings-raw", f"{root}/raw", "--descriptions-raw", f"{root}/desc",
                 "--keyword-snapshots", f"{root}/snaps", "--target-schema", "hs_cli",
                 "--location-root", f"{root}/tables"]) == 0
    assert spark.read.table("gold.gold_experience_distribution").count() == 3
    assert main(["snapshot", "--date", "2026-01-03", "--silver", "silver.silver_linkedin_postings",
                 "--out", f"{root}/kw"]) == 0
    assert spark.read.parquet(f"{root}/kw").where("keyword = 'years'").first().posting_count == 3


def test_build_selected_models_reads_stored_upstream(spark):
    root = tempfile.mkdtemp(prefix="hs-sel-")
    raw, desc, snaps = postings_df(spark), descriptions_df(spark), snapshots_df(spark)
    plans.build_all(raw, desc, snaps, location_root=root, select={"silver_postings"})
    out = plans.build_all(None, None, snaps, location_root=root,
                          select={"keyword_latest", "keyword_trends"})
    assert set(out) == {"keyword_latest", "keyword_trends"}
    got = sorted((r.keyword, float(r.pct)) for r in out["keyword_latest"].collect())
    assert got == [("Data", 33.3), ("python", 100.0)]


def test_build_rejects_unknown_model(spark):
    import pytest
    with pytest.raises(ValueError, match="unknown models"):
        plans.build_all(None, None, snapshots_df(spark), select={"nope"})


def test_cli_stream(spark):
    from hirescope.__main__ import main
    root = tempfile.mkdtemp(prefix="hs-cli-stream-")
    postings_df(spark).write.parquet(f"{root}/landing")
    descriptions_df(spark).write.parquet(f"{root}/desc")
    assert main(["stream", "--landing", f"{root}/landing", "--checkpoint", f"{root}/ckpt", "--latest", f"{root}/latest",
                 "--out", f"{root}/silver", "--descriptions-raw", f"{root}/desc",
                 "--state-partitions", "4"]) == 0
    assert spark.read.parquet(f"{root}/silver").count() == 8


def test_model_without_custom_schema_goes_to_target_schema(spark):
    root = tempfile.mkdtemp(prefix="hs-target-")
    raw, desc, snaps = postings_df(spark), descriptions_df(spark), snapshots_df(spark)
    plans.build_all(raw, desc, snaps, target_schema="hs_analytics", location_root=root,
                    custom_schemas={"silver_postings": None, "experience_distribution": "  hs_reports "},
                    select={"silver_postings", "experience_requirements", "experience_distribution"})
    assert spark.catalog.tableExists("hs_analytics.silver_linkedin_postings")
    assert spark.catalog.tableExists("hs_reports.gold_experience_distribution")
    assert spark.catalog.tableExists("silver.silver_experience_requirements")


def test_snapshot_refuses_a_table_it_would_empty(spark):
    import pytest

    from hirescope.sources.sinks import SnapshotLayout
    schema = snapshots_df(spark).schema
    day = lambda n: spark.createDataFrame([("python", n, dt.date(2026, 1, n))], schema)
    spark.sql("CREATE DATABASE IF NOT EXISTS hs_silver")
    spark.sql("DROP TABLE IF EXISTS hs_silver.kw_flat")
    day(1).write.saveAsTable("hs_silver.kw_flat")
    with pytest.raises(SnapshotLayout, match="partitioned by"):
        write_snapshot(day(2), "hs_silver.kw_flat")
    assert [r.posting_count for r in spark.read.table("hs_silver.kw_flat").collect()] == [1]


def test_snapshot_goes_by_column_names(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS hs_silver")
    spark.sql("DROP TABLE IF EXISTS hs_silver.kw_shuffled")
    spark.sql("CREATE TABLE hs_silver.kw_shuffled (posting_count BIGINT, keyword STRING, snapshot_date DATE) "
              "USING parquet PARTITIONED BY (snapshot_date)")
    schema = snapshots_df(spark).schema
    for n in (1, 2):
        write_snapshot(spark.createDataFrame([("python", n, dt.date(2026, 1, n))], schema), "hs_silver.kw_shuffled")
    rows = sorted((r.keyword, r.posting_count, r.snapshot_date.day) for r in spark.read.table("hs_silver.kw_shuffled").collect())
    assert rows == [("python", 1, 1), ("python", 2, 2)]


def test_failed_publish_leaves_the_old_table(spark):
    import pytest
    from pyspark.sql import functions as F
    root = tempfile.mkdtemp(prefix="hs-fail-")
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    for path in (None, f"{root}/t"):
        table = "kept" if path is None else "kept_external"
        publish(df, "hs_test", table, path=path)
        with pytest.raises(Exception, match="broken"):
            publish(df.withColumn("v", F.raise_error(F.lit("broken")).cast("string")), "hs_test", table, path=path)
        assert [tuple(r) for r in spark.read.table(f"hs_test.{table}").collect()] == [(1, "a")]


def test_publish_keeps_one_version_back_and_follows_a_new_shape(spark):
    import os
    root = tempfile.mkdtemp(prefix="hs-versions-")
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    for _ in range(4):
        publish(df, "hs_test", "versions", path=f"{root}/t")
    assert len([x for x in os.listdir(f"{root}/t") if x.startswith("v-")]) == 2
    stored = publish(df.select("v"), "hs_test", "versions", path=f"{root}/t")
    assert stored.columns == ["v"] and stored.count() == 1


def test_names_may_have_a_catalog_part(spark):
    import pytest

    from hirescope.sources.sinks import quoted
    assert quoted("job_market.silver") == "`job_market`.`silver`"
    with pytest.raises(ValueError, match="not a table"):
        quoted("a..b")
    df = spark.createDataFrame([(1,)], "id int")
    assert publish(df, "spark_catalog.hs_test", "three_parts").count() == 1
    out = plans.build_all(postings_df(spark), descriptions_df(spark), None, catalog="spark_catalog",
                          custom_schemas={"silver_postings": "hs_cat"}, select={"silver_postings"})
    assert out["silver_postings"].count() == 8
    assert spark.catalog.tableExists("spark_catalog.hs_cat.silver_linkedin_postings")


def test_each_model_can_be_built_alone(spark):
    from hirescope.__main__ import main
    root = tempfile.mkdtemp(prefix="hs-alone-")
    postings_df(spark).write.parquet(f"{root}/raw")
    descriptions_df(spark).write.parquet(f"{root}/desc")
    snapshots_df(spark).write.parquet(f"{root}/snaps")
    for model, (schema, table) in MODEL_TABLES.items():
        assert main(["build", "--postings-raw", f"{root}/raw", "--descriptions-raw", f"{root}/desc", "--keyword-snapshots",
                     f"{root}/snaps", "--location-root", f"{root}/tables", "--select", model]) == 0
        assert spark.read.table(f"{schema}.{table}").count() > 0, model


def test_staged_folders_go(spark):
    import os

    from hirescope.sources.sinks import release_staged, stage
    folder = stage(spark.range(3), "rows").inputFiles()[0].replace("file://", "").rpartition("/")[0]
    assert os.path.isdir(folder)
    assert release_staged(spark) >= 1
    assert not os.path.exists(os.path.dirname(folder))


def test_a_build_that_fails_at_any_model_leaves_the_set_as_it_was(spark, monkeypatch):
    import os

    import pytest

    from hirescope.plans import project
    from hirescope.sources import sinks
    root = tempfile.mkdtemp(prefix="hs-set-")
    raw, desc, snaps = postings_df(spark), descriptions_df(spark), snapshots_df(spark)
    own = dict.fromkeys(MODEL_TABLES, "hs_set")
    build = lambda raw=raw: plans.build_all(
        raw, desc, snaps, target_schema="hs_set", location_root=root, custom_schemas=own)
    rows = lambda d: {m: sorted(map(str, df.collect())) for m, df in d.items()}
    first = rows(build())
    assert rows(sinks.read_build(spark, "hs_set")) == first and set(first) == set(MODEL_TABLES)
    count = lambda: sum("v-" in x for _, dirs, _ in os.walk(root) for x in dirs)
    folders = count()
    other = raw.where("job_url is not null").limit(2)

    def broken(*args, **kwargs):
        raise RuntimeError("broken")
    tables = lambda: rows({m: spark.read.table(f"hs_set.{t}") for m, (_, t) in MODEL_TABLES.items()})
    for model in MODEL_TABLES:
        with monkeypatch.context() as m, pytest.raises(RuntimeError, match="broken"):
            m.setattr(project, model, broken)
            build(other)
        assert rows(sinks.read_build(spark, "hs_set")) == first == tables() and count() == folders, model
    # The switch of a table fails: the manifest is one build as a whole, also
    # after the builds that follow.
    for _ in range(3):
        switch, done = sinks.point_at, []
        with monkeypatch.context() as m, pytest.raises(RuntimeError, match="broken"):
            m.setattr(sinks, "point_at", lambda *a: broken() if len(done) > 2 else done.append(a) or switch(*a))
            build(other)
        second = rows(sinks.read_build(spark, "hs_set"))
        assert second != first and len(second["silver_postings"]) == len(second["experience_requirements"])
    again = rows(build(other))
    assert again == second == rows(sinks.read_build(spark, "hs_set")) == tables()


def test_newest_date_comes_from_the_partitions(spark):
    from pyspark.sql import functions as F

    from hirescope.sources import newest_partition_date, read_keyword_snapshots
    root = tempfile.mkdtemp(prefix="hs-newest-")
    schema = snapshots_df(spark).schema
    day = lambda n: spark.createDataFrame([("python", n, n and dt.date(2026, 1, n))], schema)
    for n in (3, 1, 2):
        write_snapshot(day(n), f"{root}/s")
    write_snapshot(day(None), f"{root}/s")
    assert newest_partition_date(spark, f"{root}/s") == dt.date(2026, 1, 3)
    # A partition without rows has no say, nor has a table that is laid out otherwise or empty.
    day(9).drop("snapshot_date").limit(0).write.parquet(f"{root}/s/snapshot_date=2026-01-09")
    assert newest_partition_date(spark, f"{root}/s") == dt.date(2026, 1, 3)
    day(1).write.parquet(f"{root}/flat")
    assert newest_partition_date(spark, f"{root}/flat") is None
    snaps = read_keyword_snapshots(spark, f"{root}/s")
    total = spark.createDataFrame([(4,)], "total_postings long")
    known = plans.keyword_latest(snaps, None, total=total, newest_date=dt.date(2026, 1, 3))
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "max(" not in plan and plan.count("FileScan parquet") == 1 and "PartitionFilters: [isnotnull(snapshot_date" in plan
    assert known.collect() == plans.keyword_latest(snaps, None, total=total).collect()
    assert known.select(F.max("snapshot_date")).first()[0] == dt.date(2026, 1, 3)
