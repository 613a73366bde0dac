"""A training-corpus pipeline: stages over ``documents``, each stored and reread.

1. toxicity: documents that score 0.7 or more go.
2. line dedup: lines whose template recurs across documents go from all but
   the first; a document that loses all its words goes with them.
3. near-dedup: one document of each group of near copies stays.
4. mixing: documents are written in the order that interleaves their sources
   by target weight; none is dropped or repeated. Scans need not keep that
   order, so ``run`` returns it as ``position``.
5. encoding: every text becomes its token ids, checked against the bytes the
   ids decode to.

Every stage but the last returns the columns of its input. An empty table
passes through all stages.
"""

import public_tokenizers
from pyspark.sql import functions as F

from hirescope.llm import bpe, lines, minhash, mixing, toxicity
from hirescope.llm.common import packed, row_key, stored, table


def drop_toxic(spark, docs, sf_dir):
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_recurring_lines(spark, docs, sf_dir):
    """Texts that had words and have none left were repeats in whole and go;
    texts without words before stay as they are."""
    rows, column = packed(docs, "doc_id", "text")
    left = lines.without_recurring_lines(rows)
    emptied = (F.col("_n_dropped") > 0) & ~F.coalesce("text", F.lit("")).rlike(r"[^ \t\r\n\f\x0B]")

    def value(c):
        if c != "n_chars":
            return column(c)
        shorter = F.length("text").cast(docs.schema[c].dataType)
        return F.when(F.col("_n_dropped") > 0, shorter).otherwise(column(c)).alias(c)
    return left.where(~emptied).select(*map(value, docs.columns))


def keep_one_of_near_copies(spark, docs, sf_dir):
    """The rows of the smallest doc_id of each group; rows equal in doc_id and
    text are one. Rows without doc_id or words have no copies and stay."""
    found = minhash.near_duplicates(docs)
    # One row of each group, should several share its smallest doc_id.
    single = found.where("kept and component_id is not null").groupBy("component_id").agg(F.min("row_key").alias("_is"))
    unnamed = found.where("doc_id is null").select(F.col("doc_id").alias("component_id"), F.col("row_key").alias("_is"))
    keys = single.union(unnamed).distinct()
    rows, column = packed(docs, "doc_id", "text")
    rows = rows.withColumn("_key", row_key("doc_id", "text"))
    same = (rows["_key"] == keys["_is"]) & rows["doc_id"].eqNullSafe(keys["component_id"])
    kept = rows.join(keys, same, "left_semi").dropDuplicates(["doc_id", "_key"])
    return kept.select(*map(column, docs.columns))


def interleave_sources(spark, docs, sf_dir):
    rows, column = packed(docs, "doc_id", "text", "source")
    placed = mixing.mixed(rows).repartitionByRange("_slot", "_place").sortWithinPartitions("_slot", "_place")
    return placed.select(*map(column, docs.columns))


def written_order(docs):
    """``docs``, a table just read, with ``position``: it grows with the number
    of the file, as its writer counted, and with the row in the file."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-([0-9]+)", 1).cast("long")
    more = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"-c([0-9]+)[.]", 1).try_cast("long"), F.lit(0))
    return docs.withColumn("position", F.shiftleft(part, 43) + F.shiftleft(more.cast("long"), 33)
                           + F.col("_metadata.row_index"))


def encode_placed_texts(docs):
    """The encoded rows of ``docs`` with their ``position``."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    # The position travels with the id through the shuffles of long texts.
    named = docs.select(F.struct("doc_id", "position").alias("doc_id"), "text")
    decoded = bpe.decode(bpe.encode(named, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          F.sha2("decoded", 256).alias("decoded_sha256"), "doc_id.position")


def encode_texts(spark, docs, sf_dir):
    return encode_placed_texts(docs.withColumn("position", F.lit(0).cast("long"))).drop("position")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("near-dedup", keep_one_of_near_copies),
    ("mixing", interleave_sources),
    ("encoding", encode_texts),
]
# SQL can express neither the learned scores nor the byte-pair merges; the
# stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return encode_placed_texts(written_order(docs))
