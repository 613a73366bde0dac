"""Physical-plan checks: the shapes the README argues for at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from hirescope import plans
from hirescope.operators.joins import fanout_left_join
from hirescope.sources import bindings

SF = "/root/testdata/sf0.01"
# Registered queries whose construction writes files first (staging, publishing, streaming).
_EAGER = {"described_total_kept", "keyword_trends_stored", "publish_table", "postings_latest_stream", "silver_postings_stream", "snapshot_append"}
# The training-data queries have checks of their own.
_OWN = set(E.queries()) - (set() if E.llm_queries is None else {*E.llm_queries.queries(), "pipeline"}) - _EAGER


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def query_plans(spark):
    return {name: _plan(fn(spark, SF)) for name, fn in E.queries().items() if name in _OWN}


def test_no_pairwise_joins_or_python_udfs(query_plans):
    for name, plan in query_plans.items():
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                    "ArrowEvalPython", "FlatMapGroupsInPandas"):
            assert bad not in plan, f"{name} plans {bad}"


def test_dedup_limits_before_the_shuffle(query_plans):
    plan = query_plans["postings_latest"]
    lines = plan.split("\n")
    partial = next(i for i, l in enumerate(lines) if "WindowGroupLimit" in l and "Partial" in l)
    exchange = next(i for i, l in enumerate(lines) if "Exchange hashpartitioning(job_url" in l)
    assert exchange < partial  # the partial limit sits below (map side of) the exchange


def test_scans_read_only_used_columns(query_plans):
    plan = query_plans["postings_latest"]
    assert ("ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,"
            "props:string>") in plan
    # the distinct total reads neither scrape times nor texts of postings
    plan = query_plans["described_total"]
    assert "ReadSchema: struct<user_id:bigint>" in plan and "Window" not in plan
    plan = query_plans["descriptions_ok"]
    assert "p_retailprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_noise_filter_is_an_inset_below_the_aggregate(query_plans):
    plan = query_plans["keyword_denoised"]
    assert "INSET" in plan
    # the filter runs on the scan side, before the binding's aggregate
    assert plan.index("INSET") > plan.index("HashAggregate")


def test_keyword_snapshot_plans(query_plans):
    # one plan for all inputs: only fanned-out keys are counted distinct, in
    # one aggregate over one tokenization, and no text is read to count keys
    for name in ("keyword_snapshot", "keyword_snapshot_postings", "keyword_snapshot_vocabulary"):
        plan = query_plans[name]
        assert "count(distinct CASE WHEN isnotnull(__repeated" in plan, name
        assert plan.count("Generate explode(array_distinct") == 1, name
        scans = [x.split("ReadSchema: ")[1] for x in plan.split("\n") if "ReadSchema" in x]
        # a vocabulary reads the texts once for their tokens, once for the n-grams that may be terms
        reads = 2 if name == "keyword_snapshot_vocabulary" else 1
        assert sum("description_text" in x or "text:string" in x for x in scans) == reads, name


def test_documents_are_dealt_out_for_their_texts_only(query_plans):
    plan = query_plans["keyword_snapshot"]
    assert plan.count("RoundRobinPartitioning") == 1  # the keys are counted where they lie


def test_noise_table_is_an_anti_join_without_a_forced_broadcast(query_plans):
    plan = query_plans["keyword_denoised_table"]
    assert "LeftAnti" in plan and "INSET" not in plan


def test_only_changed_postings_are_tokenized(query_plans):
    plan = query_plans["keyword_snapshot_daily"]
    lines = plan.split("\n")
    made = [i for i, x in enumerate(lines) if "Generate explode(array_distinct" in x]
    semi = [i for i, x in enumerate(lines) if "LeftSemi" in x]
    # under each of the two tokenizations (old and new texts) lies a semi join
    assert len(made) == 2 and all(any(i < j for j in semi) for i in made) and len(semi) >= 2
    assert made[0] < semi[0] < made[1] < semi[-1]


def test_texts_of_unknown_postings_go_before_the_shuffle(query_plans):
    plan = query_plans["silver_postings"]
    lines = plan.split("\n")
    test = next(i for i, x in enumerate(lines) if "getbit" in x)
    assert any("Exchange hashpartitioning(job_url" in x for x in lines[:test]) or "BroadcastHashJoin [job_url" in plan
    assert "bitmap_construct_agg" in plan and "approx_top_k" in plan


def test_hot_key_is_spread_over_tasks(spark):
    posts = plans.postings_with_dates(bindings.postings_raw(spark, SF))
    desc = plans.ok_descriptions(bindings.descriptions_raw(spark, SF))
    # one posting key takes every description: the hottest possible key
    hot = posts.where(F.col("job_url").isNotNull()).orderBy("job_url").first().job_url
    # a per-row expression (not a literal Catalyst could fold into the join)
    hot_desc = desc.withColumn("job_url", F.concat(F.lit(hot), F.substring("job_url", 1, 0)))
    # as at scale: the description side is too big to broadcast and the
    # shuffle partitions too big for AQE to merge
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        joined = fanout_left_join(posts, hot_desc, "job_url", bytes_per_task=100, size=F.lit(1))
        plan = _plan(joined)
        assert "SortMergeJoin" in plan and "BroadcastNestedLoopJoin" not in plan
        spread = (joined.where(F.col("job_url") == hot)
                  .groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(spread) > 1
    assert sum(r["count"] for r in spread) == desc.count()


def test_latest_date_prunes_snapshot_partitions(spark, tmp_path):
    from hirescope.sources.readers import read_keyword_snapshots
    from hirescope.sources.sinks import write_snapshot
    path = str(tmp_path / "snapshots")
    write_snapshot(bindings.keyword_snapshots(spark, SF), path)
    silver = plans.silver_postings(bindings.postings_raw(spark, SF), bindings.descriptions_raw(spark, SF))
    plan = _plan(plans.keyword_latest(read_keyword_snapshots(spark, path), silver))
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan
    assert "(snapshot_date#" in plan.split("PartitionFilters: [isnotnull(snapshot_date")[1].split("]")[0]
