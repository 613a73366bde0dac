"""Line dedup with a fixed-depth template tree, in DataFrame functions only.

A line is read as tokens; tokens that hold a digit or ``@`` are variable
fields and become ``<*>``. The tree has a fixed depth: the number of tokens,
then the leading tokens. The different lines of a node are compared token by
token, by counts: a token that fewer than half of them (or only one) hold at
its place is a variable field there, wherever in the line it stands. A line's
template is what is left constant, if that is ``CONSTANT_PERCENT`` of its
tokens or more; else only tokens that no other line of the node holds count as
fields; else, and for short lines, the template is the line itself. Templates
of all three kinds nest, so lines fall into classes.

A line goes from a document if its template recurs across documents, unless
the document is the first (smallest doc_id) to hold that template: as classes
don't overlap, each one keeps a line in its first document.

Long lines recur by copying only, so two documents are enough; short ones also
recur by chance and need more. Lines under ``MIN_TOKENS`` tokens always stay.

Lines are counted by pairs of 64-bit hashes; texts are read twice more, for
the lines of nodes that vary (behind a bitmap of those) and for the result.
Templates and nodes that hold much of the input are joined in place.

Defined results: NULL text stays NULL and empty text stays empty, with nothing
dropped; a line that recurs inside one document only stays; a text or a line
of any length is taken whole; a repeated row (same doc_id and text) counts as
one document and each repetition gets the same result; of rows that share a
doc_id the one with the smaller hash comes first; a row without doc_id comes
after all others; an empty table gives an empty result; other columns of the
input are ignored or, in ``without_recurring_lines``, kept, whatever their
names (but for its own two, which replace columns so named).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirescope.llm.common import hot_key_join, packed, row_key, stored
from hirescope.operators.joins import rows_of_known_keys

MIN_TOKENS = 3
SHORT_DOCS = 10
LONG_TOKENS = 16
LONG_DOCS = 2
LEAD_TOKENS = 3
# Lines shorter than this have no variable fields but those of ``FIELD``.
VARIABLE_TOKENS = 8
# What a template holds constant, at least.
CONSTANT_PERCENT = 75

FIELD = "<*>"
# Tried at the start of a token only, and possessive, so that a text of one
# long word costs one pass.
_FIELD_PATTERN = r"(?<![^ \t\r\f\x0B\n])[^ \t\r\f\x0B\n0-9@]*+[0-9@][^ \t\r\f\x0B\n]*+"
_BLANKS = r"[ \t\r\f\x0B]++"


def templates(text: Column) -> Column:
    """The text with variable fields marked and one blank between the tokens of
    a line. Texts that need neither are passed by."""
    fields = F.when(text.rlike("[0-9@]"), F.regexp_replace(text, _FIELD_PATTERN, FIELD)).otherwise(text)
    odd = F.lit(False)
    for blank in ("  ", "\t", "\r", "\f", "\x0b"):
        odd = odd | F.contains(text, F.lit(blank))
    return F.when(odd, F.regexp_replace(fields, _BLANKS, " ")).otherwise(fields)


def _line_rows(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``(row_key, doc_id, line_no, words, n, node, line)`` of every line that
    may go, of ``min_tokens`` tokens or more; ``node`` and ``line`` together
    name it."""
    # A text is hashed once, not for each of its lines.
    rows = docs.select(row_key("doc_id", "text").alias("row_key"), "doc_id", templates(F.col("text")).alias("text"))
    rows = rows.select("row_key", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    # Filters are not moved below an explode, where each would split the line again.
    rows = rows.select("row_key", "doc_id", "line_no", F.explode(F.array(F.split(F.trim("line"), " "))).alias("words"))
    n = F.size("words")
    # The node of a line too short to vary is a second hash of the line.
    node = F.when(n >= VARIABLE_TOKENS, F.xxhash64(n, F.slice("words", 1, LEAD_TOKENS))).otherwise(F.xxhash64(n, "words"))
    return rows.where(n >= min_tokens).withColumns({"n": n, "node": node, "line": F.xxhash64("words")})


def _templates_of_variants(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``(node, line, leaf, rows)`` for lines whose template has variable
    fields or is shared: ``leaf`` names it within the node."""
    varied = stored(lines.where(F.col("n") >= VARIABLE_TOKENS).groupBy("node").agg(
        F.min("line").alias("a"), F.max("line").alias("b"), F.min("row_key").alias("c"), F.max("row_key").alias("d")
    ).where("a < b and c < d").select("node"), "varied-nodes")
    # Nodes that pass the bitmap without need have one line, or lines of one
    # document; neither recurs.
    found = rows_of_known_keys(_line_rows(docs, VARIABLE_TOKENS), varied, "node")
    variants = stored(found.groupBy("node", "line").agg(
        F.first("words").alias("words"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows")), "line-variants")
    totals = stored(variants.groupBy("node").agg(F.count(F.lit(1)).alias("variants")), "variants-of-nodes")
    known = hot_key_join(variants.drop("rows"), totals, ["node"], totals.withColumnRenamed("variants", "rows"))
    tokens = stored(known.select("node", "line", "n", "variants", F.posexplode(
        F.slice("words", F.lit(LEAD_TOKENS + 1), F.size("words"))).alias("at", "token"))
        .withColumn("token", F.xxhash64("token")), "variant-tokens")
    place = ["node", "at", "token"]
    held = stored(tokens.groupBy(*place).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "constant-tokens")
    constant = hot_key_join(tokens, held.withColumnRenamed("rows", "lines"), place, held)
    # A template is the set of its constant places: no list is gathered.
    often = F.when(F.col("lines") * 2 >= F.col("variants"), F.xxhash64("at", "token"))
    every = F.xxhash64("at", "token")
    marked = constant.groupBy("node", "line").agg(
        F.first("n").alias("n"), F.count(often).alias("often"), F.bit_xor(often).alias("often_set"),
        F.count(every).alias("every"), F.bit_xor(every).alias("every_set"))
    enough = lambda k: (F.col(k) + LEAD_TOKENS) * 100 >= F.col("n") * CONSTANT_PERCENT
    leaf = (F.when(enough("often"), F.xxhash64(F.lit(2), "often", "often_set"))
            .when(enough("every"), F.xxhash64(F.lit(1), "every", "every_set")))
    named = marked.select("node", "line", leaf.alias("leaf")).where(F.col("leaf").isNotNull())
    return stored(named.join(variants.select("node", "line", "rows"), ["node", "line"]), "line-templates")


def recurring_lines(docs: DataFrame) -> DataFrame:
    """``(row_key, doc_id, dropped)``: the numbers (from 0) of the lines to
    drop from each document that has any."""
    lines = stored(_line_rows(docs).drop("words"), "lines")
    names = ["node", "leaf", "row_key", "doc_id", "line_no", "n"]
    of_lines = _templates_of_variants(docs, lines)
    shared = stored(hot_key_join(lines, of_lines.drop("rows"), ["node", "line"], of_lines).select(*names), "template-lines")
    # A line with a template is counted as itself, too. Both agree: who is the
    # first to hold a template is the first to hold that line.
    leaves = lines.withColumnRenamed("line", "leaf").select(*names).union(shared)
    # One row per leaf and document first: a frequent line is spread over the
    # documents that hold it before the counts meet.
    held = leaves.groupBy("node", "leaf", "row_key", "doc_id").agg(
        F.max(F.col("n") >= LONG_TOKENS).alias("long"), F.count(F.lit(1)).alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))
    recurring = held.groupBy("node", "leaf").agg(
        F.count(F.lit(1)).alias("docs"), F.max("long").alias("long"), F.sum("rows").alias("rows"), first.alias("first"))
    recurring = stored(recurring.where(f"docs >= if(long, {LONG_DOCS}, {SHORT_DOCS})").select(
        "node", "leaf", "rows", F.col("first.doc_id").alias("keeper_id"), F.col("first.row_key").alias("keeper")),
        "recurring-leaves")
    gone = hot_key_join(rows_of_known_keys(leaves, recurring, "leaf"), recurring.drop("rows"), ["node", "leaf"], recurring,
                        lines.count())
    gone = gone.where((F.col("row_key") != F.col("keeper")) | ~F.col("doc_id").eqNullSafe(F.col("keeper_id")))
    return gone.groupBy("row_key", "doc_id").agg(F.collect_set("line_no").alias("dropped"))


def without_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (all its columns) with recurring lines gone from ``text``, and
    ``n_lines`` and ``n_dropped`` as ``_n_lines`` and ``_n_dropped``."""
    dropped = recurring_lines(docs).select(F.col("row_key").alias("_gone"), F.col("doc_id").alias("_of"), "dropped")
    rows, column = packed(docs, "doc_id", "text")
    rows = rows.withColumn("_key", row_key("doc_id", "text"))
    same = (rows["_key"] == dropped["_gone"]) & rows["doc_id"].eqNullSafe(dropped["_of"])
    rows = rows.join(dropped, same, "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.array_contains(F.col("dropped"), i))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    names = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    return rows.select(*[text.alias(c) if c == "text" else column(c) for c in names],
                       F.coalesce(F.size(lines), F.lit(0)).alias("_n_lines"),
                       F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).alias("_n_dropped"))
