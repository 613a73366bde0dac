"""Keyword snapshot job: counts, append per date, and the gold reports reading it."""

import datetime as dt
import tempfile

from hirescope import plans
from hirescope.sources.readers import read_keyword_snapshots
from hirescope.sources.sinks import write_snapshot
from tests.fixtures import descriptions_df, postings_df


def _silver(spark, descriptions):
    return plans.silver_postings(postings_df(spark), descriptions_df(spark, descriptions))


def test_counts_distinct_postings_not_mentions(spark):
    silver = _silver(spark, [
        ("u1", "Python and SQL. Python again", "ok"),
        ("u6", "python", "ok"),
        ("u6", "Python developer", "ok"),   # second description of u6: still one posting
        ("u2", None, "ok"),
    ])
    out = {r.keyword: r.posting_count for r in plans.keyword_snapshot(silver, "2026-01-02").collect()}
    assert out["python"] == 2
    assert out["sql"] == 1
    assert out["python developer"] == 1
    assert out["python and sql"] == 1


def test_vocabulary_restricts_output(spark):
    silver = _silver(spark, [("u1", "Python and SQL", "ok"), ("u3", "sql only", "ok")])
    vocab = spark.createDataFrame([("sql",), ("rust",), (None,)], "keyword string")
    out = sorted((r.keyword, r.posting_count) for r in
                 plans.keyword_snapshot(silver, "2026-01-02", vocabulary=vocab).collect())
    assert out == [("sql", 2)]


def test_min_postings(spark):
    silver = _silver(spark, [("u1", "Python and SQL", "ok"), ("u3", "sql only", "ok")])
    out = [r.keyword for r in plans.keyword_snapshot(silver, "2026-01-02", min_postings=2).collect()]
    assert out == ["sql"]


def test_daily_append_feeds_gold_reports(spark):
    path = tempfile.mkdtemp(prefix="hs-r1-") + "/snapshots"
    day1 = _silver(spark, [("u1", "Python and SQL", "ok")])
    day2 = _silver(spark, [("u1", "Python and SQL", "ok"), ("u3", "python", "ok")])
    write_snapshot(plans.keyword_snapshot(day1, dt.date(2026, 1, 1)), path)
    write_snapshot(plans.keyword_snapshot(day2, dt.date(2026, 1, 2)), path)
    write_snapshot(plans.keyword_snapshot(day2, dt.date(2026, 1, 2)), path)  # rerun
    snaps = read_keyword_snapshots(spark, path)
    assert snaps.where("snapshot_date = date'2026-01-02' and keyword = 'python'").count() == 1
    latest = {r.keyword: (r.posting_count, float(r.pct)) for r in plans.keyword_latest(snaps, day2).collect()}
    assert latest["python"] == (2, 100.0)
    assert latest["sql"] == (1, 50.0)
    assert "and" not in latest or latest["and"][0] == 1
    assert "data" not in latest


def test_mixed_count_equals_plain_distinct_count(spark):
    """Postings of one and of several descriptions, against one distinct count."""
    from pyspark.sql import functions as F

    from hirescope.functions.text import ngrams
    from hirescope.sources import bindings
    sf = "/root/testdata/sf0.001"
    silver = plans.silver_postings(bindings.postings_raw(spark, sf), bindings.descriptions_raw(spark, sf))
    plain = (silver.where("job_url is not null and description_text is not null")
             .select("job_url", F.explode(ngrams(F.col("description_text"))).alias("keyword"))
             .groupBy("keyword").agg(F.countDistinct("job_url").alias("n")))
    want = sorted(map(tuple, plain.collect()))
    got = sorted((r.keyword, r.posting_count) for r in plans.keyword_snapshot(silver, "2026-01-02").collect())
    assert got == want and len(got) > 0


def test_vocabulary_terms_are_normalized_and_may_be_long(spark):
    silver = _silver(spark, [("u1", "An Amazon Web Services, certified! engineer", "ok"), ("u3", "python; amazon web", "ok")])
    vocab = spark.createDataFrame([("amazon web services certified",), ("Python",), ("  AMAZON  web ",), ("",), ("!",)],
                                  "keyword string")
    out = sorted((r.keyword, r.posting_count) for r in
                 plans.keyword_snapshot(silver, "2026-01-02", vocabulary=vocab).collect())
    assert out == [("amazon web", 2), ("amazon web services certified", 1), ("python", 1)]


def test_no_job_runs_while_the_snapshot_is_built(spark):
    silver = _silver(spark, [("u1", "Python and SQL", "ok")])
    spark.sparkContext.setJobGroup("snapshot-build", "building only")
    try:
        plans.keyword_snapshot(silver, "2026-01-02")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("snapshot-build")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_noise_from_a_table_with_nulls_and_repeats(spark, tmp_path):
    from hirescope.sources.readers import read_noise_terms
    path = str(tmp_path / "noise")
    spark.createDataFrame([("sql",), ("sql",), (None,), ("x",)], "keyword string").selectExpr(
        "keyword", "1 as added_by").write.parquet(path)
    snaps = spark.createDataFrame(
        [("sql", 1), ("Sql", 2), ("go", 3), (None, 4), ("c", 5)], "keyword string, posting_count long").selectExpr(
        "keyword", "posting_count", "date'2026-01-01' as snapshot_date")
    noise = read_noise_terms(spark, path)
    assert sorted(r.keyword for r in plans.signal_keywords(snaps, noise).collect()) == ["Sql", "go"]
    # as the same terms in a list would
    assert sorted(r.keyword for r in plans.signal_keywords(snaps, ["sql", "x"]).collect()) == ["Sql", "go"]
    none = spark.createDataFrame([], "keyword string")
    assert plans.signal_keywords(snaps, none).count() == 3
    latest = plans.keyword_latest(snaps, None, noise, total=10).collect()
    assert [(r.keyword, float(r.pct)) for r in latest] == [("go", 30.0), ("Sql", 20.0)]


def _texts(spark, rows):
    return spark.createDataFrame(rows, "job_url string, description_text string")


def test_terms_of_any_length(spark):
    """Against a plain search, with terms that begin alike, overlap, and end with the text."""
    import random
    rng = random.Random(4)
    words = ["a", "b", "c", "d"]
    rows = [(f"u{i % 25}", " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [("u0", None), (None, "a b"), ("u1", "")]
    terms = {" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 2, 3, 5, 8, 12, 12, 15)}
    terms |= {" ".join(rows[3][1].split()[-12:]), "e", "a e"}
    vocabulary = spark.createDataFrame([(t.upper(),) for t in terms] + [(None,), (" ",)], "keyword string")
    want = {}
    for t in terms:
        held = {u for u, x in rows if u and x is not None and f" {t} " in f" {x} "}
        if held:
            want[t] = len(held)
    got = plans.keyword_snapshot(_texts(spark, rows), "2026-01-01", vocabulary=vocabulary).collect()
    assert {r.keyword: r.posting_count for r in got} == want and len(got) == len(want)


def test_rows_made_do_not_grow_with_the_longest_term(spark):
    from hirescope.plans.snapshots import _described, _possible_grams, term_index
    silver = _texts(spark, [(f"u{i}", " ".join(f"w{(i * 7 + k) % 50}" for k in range(200))) for i in range(20)])
    short = spark.createDataFrame([("w1 w2",), ("w3",)], "keyword string")
    long = short.union(spark.createDataFrame([(" ".join(f"x{k}" for k in range(60)),)], "keyword string"))
    made = [_possible_grams(_described(silver, None), terms).count() for terms in (short, long)]
    assert made[0] == made[1]
    assert sorted(map(tuple, term_index(long).collect())) == [("w1", 2), ("w3", 1), ("x0", 60)]


def test_two_days_in_a_row_equal_the_recount(spark):
    day0 = [("u1", "Python and SQL"), ("u2", "go"), ("u3", "rust"), ("u3", "rust and go"), ("u4", "gone soon"),
            ("u5", None), (None, "no key"), ("u6", "same"), ("u6", "same")]
    day1 = [("u1", "Python and SQL"), ("u2", "go and sql"), ("u3", "rust"), ("u5", "now described"), (None, "other"),
            ("u6", "same"), ("u6", "same"), ("u7", "new go")]
    day2 = [("u1", "SQL and Python"), ("u3", "rust and go"), ("u3", "rust"), ("u5", None), ("u6", "same"), ("u7", "new go")]
    silvers = [_texts(spark, d) for d in (day0, day1, day2)]
    as_set = lambda df: sorted(map(tuple, df.collect()))
    last = plans.keyword_snapshot(silvers[0], "2026-01-01")
    digests = plans.posting_digests(silvers[0])
    for k, changed in ((1, {"u2", "u3", "u4", "u5", "u7"}), (2, {"u1", "u2", "u3", "u5", "u6"})):
        new = plans.posting_digests(silvers[k])
        assert {r.job_url for r in plans.changed_postings(digests, new).collect()} == changed
        got = plans.keyword_snapshot_after(last, silvers[k - 1], silvers[k], f"2026-01-0{k + 1}", digests)
        assert as_set(got) == as_set(plans.keyword_snapshot(silvers[k], f"2026-01-0{k + 1}"))
        last, digests = got, new
    # the same texts in another order are no change, and nothing to nothing is nothing
    turned = _texts(spark, list(reversed(day2)))
    assert plans.changed_postings(plans.posting_digests(silvers[2]), plans.posting_digests(turned)).count() == 0
    none = _texts(spark, [])
    gone = plans.keyword_snapshot_after(last, silvers[2], none, "2026-01-04")
    assert gone.count() == 0
