"""Keyword snapshot job: posting counts per keyword for one snapshot date.

The source only states this job's contract: one row per keyword and
snapshot date with the number of postings that mention it, appended daily.
The extraction rules are ours (``hirescope.functions.text``). Noise terms are
not removed here; the gold models filter them when reading.
"""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.functions.text import MAX_NGRAM, ngrams_of_normalized, normalized
from hirescope.operators.joins import with_known_keys
from hirescope.operators.packed_grams import ngram_postings
from hirescope.sources.sinks import stage

# The n-grams of a text have several times its bytes, so they go to so many
# times the session's number of shuffle partitions.
GRAM_PARTITIONS = 4
# From so many bytes of tables on, n-grams are shuffled in compressed blocks, and
# so many bytes make a part of them. Spark's figure for what it knows nothing of.
PACKED_BYTES = 16 << 20
PART_BYTES = 4 << 20
UNKNOWN_BYTES = 1 << 62



def vocabulary_terms(vocabulary: DataFrame) -> DataFrame:
    """Distinct terms of a ``keyword`` column, written as texts are (lower case,
    one blank between tokens); empty ones fall away."""
    terms = vocabulary.select(normalized(F.col("keyword")).alias("keyword"))
    return terms.where(F.col("keyword") != "").distinct()


def term_index(terms: DataFrame) -> DataFrame:
    """``(token, length)``: the token a term begins with and how many tokens it
    has, each pair once."""
    words = F.split("keyword", " ")
    return terms.select(words[0].alias("token"), F.size(words).alias("length")).distinct()


def _described(silver: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Normalized texts of postings, with a mark on postings of several rows.

    The mark comes from a bitmap of those postings, so no text is shuffled for
    it. Some postings of one row may be marked too: they are then counted
    distinct as well, which gives the same count."""
    rows = silver.where(F.col("job_url").isNotNull()).select("job_url", "description_text")
    keys = rows if keys is None else keys.where(F.col("job_url").isNotNull())
    repeated = (keys.select("job_url").groupBy("job_url").agg(F.count(F.lit(1)).alias("__rows"))
                .where(F.col("__rows") > 1))
    described = with_known_keys(rows.where(F.col("description_text").isNotNull()), repeated, "job_url", "__repeated")
    return described.select("job_url", "__repeated", normalized(F.col("description_text")).alias("norm"))


def _possible_grams(norm: DataFrame, terms: DataFrame) -> DataFrame:
    """The n-grams of each text that begin as a term does and are as long.

    The texts' tokens meet the index of the terms, so what is made grows with
    the tokens and the terms that may begin there, not with the longest term.
    A text's hits (place and length) come back to it as one row.
    """
    texts = norm.select("job_url", "__repeated", "norm", F.xxhash64("norm").alias("__text"))
    begun = (texts.select("job_url", "__text", F.posexplode(F.split("norm", " ")).alias("__at", "token"))
             .join(term_index(terms), "token"))
    hits = begun.groupBy("job_url", "__text").agg(F.collect_set(F.struct("__at", "length")).alias("__hits"))
    split = texts.join(hits, ["job_url", "__text"]).select(
        "job_url", "__repeated", "__hits", F.split("norm", " ").alias("__tokens"))
    # A hit too close to the end of the text gives a shorter n-gram, which
    # counts only if it is a term, and then stands there as such.
    grams = F.transform("__hits", lambda h: F.array_join(F.slice("__tokens", h["__at"] + 1, h["length"]), " "))
    return split.select("job_url", "__repeated", F.explode(F.array_distinct(grams)).alias("keyword")).join(
        terms, "keyword", "left_semi")


def _bytes_read(df: DataFrame) -> int:
    """Bytes of the tables behind ``df`` as Spark's planner knows them, which
    runs no job; 0 if there is one it knows nothing of (rows made in memory)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return 0 if max(sizes, default=0) >= UNKNOWN_BYTES else sum(sizes)


def keyword_counts(silver: DataFrame, max_n: int = MAX_NGRAM, vocabulary: DataFrame | None = None,
                   keys: DataFrame | None = None) -> DataFrame:
    """``(keyword, posting_count)`` over every described posting (see ``keyword_snapshot``)."""
    norm = _described(silver, keys)
    size = _bytes_read(silver)
    if vocabulary is None and size >= PACKED_BYTES:
        # A line break would end the posting's name, so it is written in digits.
        owner = F.when(F.col("__repeated"), F.hex("job_url"))
        parts = max(int(silver.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
        return ngram_postings(norm.select(owner.alias("owner"), "norm"), parts, max_n)
    if vocabulary is None:
        grams = norm.select("job_url", "__repeated", F.explode(
            F.array_distinct(ngrams_of_normalized(F.col("norm"), max_n))).alias("keyword"))
        # Most n-grams are rare, so a map-side aggregate would hold nearly all of
        # them, spill, and pass them on. They go to the task of their keyword as
        # they are, once. A text has a keyword once, so a frequent one is no more
        # than a row per text.
        parts = GRAM_PARTITIONS * int(silver.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        grams = grams.select("keyword", "__repeated", F.when(F.col("__repeated"), F.col("job_url")).alias("job_url"))
        grams = grams.repartition(parts, "keyword")
    else:
        grams = _possible_grams(norm, vocabulary_terms(vocabulary))
    once = F.col("__repeated").isNull()
    # Spark keys the first aggregate on (keyword, job_url if repeated else
    # NULL), so only repeated postings' pairs are kept as pairs.
    return grams.groupBy("keyword").agg(
        (F.count(F.when(once, F.lit(1))) + F.countDistinct(F.when(~once, F.col("job_url")))).alias("posting_count"))


def keyword_snapshot(silver: DataFrame, snapshot_date: dt.date | str,
                     max_n: int = MAX_NGRAM, min_postings: int = 1,
                     vocabulary: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """``(keyword, posting_count, snapshot_date)`` over every described posting.

    Each description is tokenized whole and its distinct n-grams exploded to
    ``(job_url, keyword)`` rows; ``posting_count`` is the number of distinct
    postings per keyword.

    Descriptions are meant to be one per posting, but one posting may have
    several. A posting of one row gives each (keyword, posting) pair once, so
    it is counted plainly; only postings of several rows need
    ``count(DISTINCT job_url)``: they are marked by a bitmap of the keys that
    repeat (counted over the key column alone, no text is read for it).
    Both counts come from one aggregate, whatever the number of repeated keys,
    in the task that the keyword's n-grams are shuffled to.
    Large tables (``PACKED_BYTES``) are counted the same way by blocks of
    n-grams (``ngram_postings``): a row per n-gram would fill the disks.
    ``silver`` is read twice (its keys, its texts; with a vocabulary the texts
    twice), so pass the stored table; ``keys`` may name a cheaper frame with
    the same ``job_url`` rows for the first of them.

    ``vocabulary`` (a ``keyword`` column) keeps only listed keywords, of any
    length. Terms are normalized as texts are.
    """
    counts = keyword_counts(silver, max_n, vocabulary, keys)
    if min_postings > 1:
        counts = counts.where(F.col("posting_count") >= min_postings)
    return counts.select(
        "keyword", "posting_count", F.lit(snapshot_date).cast("date").alias("snapshot_date")
    )


def posting_digests(silver: DataFrame) -> DataFrame:
    """``(job_url, texts, mixed, total)``: what the described texts of a posting
    come to, whatever their order. Equal values mean equal texts (the two hash
    figures have more than 128 bits together). Each is a sum, so a posting with
    very many texts is reduced map-side; no text is tokenized."""
    rows = silver.where(F.col("job_url").isNotNull() & F.col("description_text").isNotNull())
    one, two = F.xxhash64("description_text"), F.xxhash64(F.lit(1), F.col("description_text"))
    return rows.groupBy("job_url").agg(
        F.count(F.lit(1)).alias("texts"), F.bit_xor(one).alias("mixed"), F.sum(two.cast("decimal(38,0)")).alias("total"))


def changed_postings(before: DataFrame, after: DataFrame) -> DataFrame:
    """``job_url`` of the postings whose texts differ between two sets of
    digests: new, changed or gone."""
    names = ("texts", "mixed", "total")
    both = before.alias("b").join(after.alias("a"), "job_url", "full")
    same = F.lit(True)
    for name in names:
        same = same & F.col(f"b.{name}").eqNullSafe(F.col(f"a.{name}"))
    return both.where(~same).select("job_url")


def keyword_snapshot_after(last: DataFrame, before: DataFrame, after: DataFrame, snapshot_date: dt.date | str,
                           digests: DataFrame | None = None, max_n: int = MAX_NGRAM, min_postings: int = 1,
                           vocabulary: DataFrame | None = None) -> DataFrame:
    """The keyword snapshot of a day from the one before.

    ``last`` is the snapshot of ``before``, the silver postings of that day,
    counted with the same rules and ``min_postings`` 1 (a term under a limit
    could not be carried on); ``after`` is today's silver. The postings whose
    texts differ are found by digests (``digests``: those kept of ``before``;
    they are worked out where none were kept). Only their texts are tokenized:
    the old ones count -1, the new ones +1, and the signed counts are merged
    into the last. The result equals ``keyword_snapshot(after, ...)``.

    The list of changed postings is stored first, so that Spark joins the
    texts to it by its real size: in place while it is small.
    """
    known = posting_digests(before) if digests is None else digests
    changed = stage(changed_postings(known, posting_digests(after)), "changed_postings")

    def counted(silver: DataFrame, sign: int) -> DataFrame:
        some = silver.select("job_url", "description_text").join(changed, "job_url", "left_semi")
        return keyword_counts(some, max_n, vocabulary).select("keyword", (sign * F.col("posting_count")).alias("posting_count"))

    merged = (last.select("keyword", "posting_count").union(counted(before, -1)).union(counted(after, 1))
              .groupBy("keyword").agg(F.sum("posting_count").alias("posting_count")))
    return merged.where(F.col("posting_count") >= min_postings).select(
        "keyword", "posting_count", F.lit(snapshot_date).cast("date").alias("snapshot_date"))
