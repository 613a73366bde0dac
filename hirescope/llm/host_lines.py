"""Quality rules from the frequency of lines across the documents of a host,
in DataFrame functions only.

1. Every line with a word is normalised (lower case, runs of digits as one 0,
   runs of blanks as one blank) and hashed with its host.
2. The distinct documents that hold it are counted per host. A line is above
   the limits if more than ``LINE_DOCS`` documents and more than
   ``LINE_PERCENT`` percent of the host's documents hold it; it goes from all.
3. A document that keeps less than ``LEFT_PERCENT`` percent of its words is
   depleted and rejected, as is one that fails the base rules: fewer than
   ``MIN_WORDS`` words, or more than ``REPEAT_PERCENT`` percent of them in
   three-word windows that its text holds twice or more.

The base figures come from one pass inside each row; only hashes of lines and
numbers are shuffled for the ``figures``; ``without_host_lines`` takes its texts
along. A line's hash has 96 bits, a window's 64, compared
inside one text only. Keys that hold more than a thousandth of what is joined
are at most a thousand; they are joined in place, all others by a shuffle.

Defined results: NULL, empty or blank text has zero words, fails the base rules
and stays as it is; rows without host share the host ``''``; a row without
doc_id counts as a document of its own text; rows equal in doc_id, host and
text count as one document and get equal results; ties cannot occur, as limits
are counts; an empty table gives an empty result; a very long text is one row's
arrays of lines and windows; other columns, whatever their names, are ignored.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.llm.common import hot_key_join, stored

MIN_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3
LINE_DOCS = 30
LINE_PERCENT = 2
LEFT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
# What stands between words, the line break last.
_BLANKS = " \t\x0b\f\r\n"


def base_figures(rows: DataFrame) -> DataFrame:
    """``rows`` with the figures of each text (a column ``text`` without NULLs)
    in a struct ``base``. Each step is a column of its own, so that no step is
    worked out again for every element of the next."""
    cut = rows.select("*", F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0B\f\r]++"), F.lit(0)).alias("w"),
                      F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(_BLANKS)) != "").alias("ls"))
    # A window's hash with the place of its first word, in order of the hash:
    # equal windows are neighbours.
    windows = F.expr(f"if(size(w) < {WINDOW}, array(), transform(sequence(0, size(w) - {WINDOW}), "
                     f"i -> struct(xxhash64({', '.join(f'w[i + {k}]' for k in range(WINDOW))}) as h, i as i)))")
    ordered = cut.select("*", F.sort_array(windows).alias("s"))
    met = ordered.select("*", F.expr("if(size(s) < 2, array(), filter(sequence(0, size(s) - 2), "
                                     "j -> s[j].h = s[j + 1].h))").alias("at"))
    twice = met.select("*", F.expr("array_union(transform(at, j -> s[j].i), transform(at, j -> s[j + 1].i))").alias("p"))
    covered = F.col("p")
    for k in range(1, WINDOW):
        covered = F.array_union(covered, F.expr(f"transform(p, x -> x + {k})"))
    base = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("p") == 0, 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"))
    return twice.select(*[F.col(f"`{c}`") for c in rows.columns], base.alias("base"))


def _lines(rows: DataFrame) -> DataFrame:
    """``(doc, row_hash, host, line_no, words, key, key2)`` for every line with a word."""
    plain = F.regexp_replace(F.regexp_replace(F.lower("text"), "[0-9]++", "0"), r"[ \t\r\f\x0B]++", " ")
    cut = rows.select("doc", "row_hash", "host", F.posexplode(F.split(plain, "\n", -1)).alias("line_no", "line"))
    cut = cut.select("doc", "row_hash", "host", "line_no", F.trim("line").alias("line")).where("line != ''")
    return cut.select("doc", "row_hash", "host", "line_no", F.size(F.split("line", " ")).alias("words"),
                      F.xxhash64("host", "line").alias("key"), F.hash("line").alias("key2"))


def frequent_lines(lines: DataFrame, line_docs: int = LINE_DOCS, line_percent: int = LINE_PERCENT) -> DataFrame:
    """``(host, key, key2, docs)`` of the lines above the limits of their host."""
    hosts = stored(lines.groupBy("host").agg(F.countDistinct("doc").alias("host_docs")), "host-documents")
    often = lines.groupBy("host", "key", "key2").agg(F.countDistinct("doc").alias("docs")).where(F.col("docs") > line_docs)
    often = stored(often, "often-lines")
    limited = hot_key_join(often, hosts, ["host"], often.groupBy("host").agg(F.count(F.lit(1)).alias("rows")))
    return limited.where(100 * F.col("docs") > line_percent * F.col("host_docs")).drop("host_docs")


def _rows(docs: DataFrame, host: str) -> DataFrame:
    whole = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", whole.alias("text"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col("text").alias("given"))
    rows = rows.select("*", F.xxhash64("host", "text").alias("row_hash"))
    # Documents without id are told apart by their texts.
    own = F.concat(F.lit("text "), F.col("row_hash").cast("string"))
    return rows.select("*", F.coalesce(F.col("doc_id").cast("string"), own).alias("doc"))


def _gone(rows: DataFrame, line_docs: int, line_percent: int) -> DataFrame:
    """``(doc, row_hash, gone, n_words_removed)``: the numbers of the lines that
    go from a document, for each that loses any."""
    lines = stored(_lines(rows), "host-lines")
    frequent = stored(frequent_lines(lines, line_docs, line_percent), "frequent-lines")
    gone = hot_key_join(lines, frequent, ["host", "key", "key2"],
                        frequent.select("host", "key", "key2", F.col("docs").alias("rows")), total=lines.count())
    # Repeated rows name the same lines once.
    return gone.select("doc", "row_hash", "line_no", "words").distinct().groupBy("doc", "row_hash").agg(
        F.collect_list("line_no").alias("gone"), F.sum("words").alias("n_words_removed"))


def _judged(rows: DataFrame, gone: DataFrame, left_percent: int) -> DataFrame:
    # Stored, as a filter pushed into the figures would work them out once for
    # every element of their arrays.
    base = stored(base_figures(rows).select("doc_id", "host", "doc", "row_hash", "base.*"), "base-figures")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    removed = F.coalesce("n_words_removed", F.lit(0)).cast("long")
    depleted = 100 * (F.col("n_words") - removed) < left_percent * F.col("n_words")
    return base.join(gone, ["doc", "row_hash"], "left").select(
        "doc", "row_hash", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_lines_removed"),
        removed.alias("n_words_removed"), (~failed & ~depleted).alias("kept"))


def figures(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_percent: int = LINE_PERCENT,
            left_percent: int = LEFT_PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines_removed, n_words_removed, kept)``."""
    rows = _rows(docs, host)
    return _judged(rows, _gone(rows, line_docs, line_percent), left_percent).drop("doc", "row_hash")


def without_host_lines(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS,
                       line_percent: int = LINE_PERCENT, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """``(doc_id, host, text)`` of the rows that are kept, without the lines above the limits."""
    rows = _rows(docs, host)
    gone = stored(_gone(rows, line_docs, line_percent), "gone-lines")
    kept = _judged(rows, gone, left_percent).where("kept").select("doc", "row_hash").distinct()
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return (rows.join(kept, ["doc", "row_hash"], "left_semi").join(gone, ["doc", "row_hash"], "left")
            .select("doc_id", "host", F.when(F.col("gone").isNull(), F.col("given")).otherwise(left).alias("text")))
