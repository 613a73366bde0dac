"""Connected components: the edges are made once, few links are few tasks."""

import random

from hirescope.llm import common
from hirescope.llm.common import components


def _brute(edges):
    low = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)]
    edges += [(-7, 9999), (500, 500), (3, 3), (9999, -7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == _brute(edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(k, k % 7) for k in range(50)], "a long, b long").mapInArrow(counted, "a long, b long")
    assert components(edges).count() == 50
    assert made.value == 50


def test_labels_of_few_links_are_written_by_few_tasks(spark, monkeypatch):
    files = {}
    plain = common.stage

    def noted(df, name):
        out = plain(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(common, "stage", noted)
    confs = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        edges = spark.range(500).selectExpr("id as a", "id + 500 as b")
        assert components(edges, name="few").where("node - component not in (0, 500)").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    labels = {name: n for name, n in files.items() if name != "few-links"}
    assert labels and max(labels.values()) <= spark.sparkContext.defaultParallelism
