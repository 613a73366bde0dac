"""The keyword snapshot shuffles each n-gram once and no text."""

from collections import Counter

from pyspark.sql import functions as F

from hirescope import plans
from hirescope.operators.joins import with_known_keys
from hirescope.plans import snapshots


def _silver(spark):
    rows = [("u1", "a b a b"), ("u1", "b c"), ("u2", "a b"), ("u3", None), (None, "a"), ("u4", ""), ("u5", "a")]
    return spark.createDataFrame(rows, "job_url string, description_text string")


def test_ngrams_are_shuffled_once_and_texts_never(spark):
    plan = plans.keyword_snapshot(_silver(spark), "2026-01-01")._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    exchanges = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(keyword" in x]
    made = next(i for i, x in enumerate(lines) if "Generate explode(array_distinct" in x)
    aggregates = [i for i, x in enumerate(lines) if "HashAggregate(keys=[keyword" in x]
    assert len(exchanges) == 1 and aggregates
    # every aggregate of keywords stands above the shuffle, which stands above the n-grams
    assert max(aggregates) < exchanges[0] < made
    assert not any("Exchange" in x and "description_text" in x for x in lines)
    assert "SortMergeJoin" not in plan


def test_postings_marked_without_need_are_counted_the_same(spark, monkeypatch):
    expected = {"a": 3, "b": 2, "c": 1, "a b": 2, "b a": 1, "b c": 1, "a b a": 1, "b a b": 1}

    def counts():
        return {r.keyword: r.posting_count for r in plans.keyword_snapshot(_silver(spark), "2026-01-01").collect()}

    assert counts() == expected
    # one bit for all keys: every posting is taken for a repeated one
    monkeypatch.setattr(snapshots, "with_known_keys", lambda *a: with_known_keys(*a, bits=1))
    assert counts() == expected


def test_marks_are_true_for_every_known_key(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    known = rows.where("cast(k as int) % 7 = 0")
    marks = {r.k: r.m for r in with_known_keys(rows, known, "k", "m").collect()}
    assert Counter(marks.values()).keys() <= {True, None} and len(marks) == 1000
    assert all(marks[r.k] for r in known.collect())
    assert {r.m for r in with_known_keys(rows, known.limit(0), "k", "m").collect()} == {None}
