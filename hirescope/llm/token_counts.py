"""Token counts of whole texts without making their ids.

Every distinct pre-token of the corpus is counted once (how many tokens it
becomes); per-document pre-token frequencies are joined to those counts and
summed. The frequent pre-tokens, which make up most of every text, would be
hot join keys: a bounded table of them is sent to all tasks and joined there,
and all other pre-tokens take the shuffled join, so every pre-token is joined
exactly once whatever its frequency.

Defined results: NULL or empty text has 0 bytes and 0 tokens; a repeated row
gives a repeated result; other columns of the input are ignored; an empty
table gives an empty result.
"""

import functools
import json
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from hirescope.llm.common import row_key, slices, stored

# Bound of the table sent to all tasks: entries, and bytes of one entry.
HOT_PIECES = 100_000
HOT_PIECE_BYTES = 64
LIMIT_TOKENS = 512


def read_tokenizer(path: str) -> str:
    """The tokenizer file as text, to be sent along with the tasks (about 2 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


# Letters in these blocks have kept their class for decades; texts with others
# are split by the library, whose Unicode version may differ from Python's.
_OTHER_SCRIPTS = regex.compile(r"[^\u0000-\u036f\u2000-\u206f]")


class _Splitter:
    """Pre-tokens of a text as the tokenizer makes them, added tokens apart."""

    def __init__(self, tokenizer_json: str, pattern: str):
        spec = json.loads(tokenizer_json)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.pattern = regex.compile(pattern)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def _plain(self, text: str) -> list[str]:
        if _OTHER_SCRIPTS.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def __call__(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self.added.split(text)):
            out += [part] if k % 2 else self._plain(part)
        return out


@functools.lru_cache(maxsize=2)
def _splitter(tokenizer_json: str, pattern: str) -> _Splitter:
    return _Splitter(tokenizer_json, pattern)


# Distinct pre-tokens that a task gathers before it hands them on; the same
# one may be handed on twice, the aggregate adds the two.
GATHER = 300_000


def _corpus_pieces(tokenizer_json: str, pattern: str):
    def run(batches):
        split, gathered = _splitter(tokenizer_json, pattern), Counter()

        def out():
            keys = list(gathered)
            done = pa.record_batch([pa.array(keys, pa.string()), pa.array([gathered[k] for k in keys], pa.int64())],
                                   ["piece", "docs"])
            gathered.clear()
            return done

        for batch in batches:
            for text in batch.column("text"):
                gathered.update(set(split(text.as_py() or "")))
                if len(gathered) >= GATHER:
                    yield out()
        yield out()
    return run


@functools.lru_cache(maxsize=1)
def _tokenizer(tokenizer_json: str) -> Tokenizer:
    return Tokenizer.from_str(tokenizer_json)


def _count_pieces(tokenizer_json: str):
    def run(batches):
        tokenizer = _tokenizer(tokenizer_json)
        for batch in batches:
            for part in slices(batch, "piece"):
                found = tokenizer.encode_batch_fast(part.column("piece").to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(e) for e in found], pa.int32())],
                                                 [*part.schema.names, "n"])
    return run


def piece_counts(docs: DataFrame, tokenizer_json: str, pattern: str) -> DataFrame:
    """``(piece, docs, n)``: every distinct pre-token, the documents that hold
    it, and the tokens it becomes."""
    pieces = docs.select("text").mapInArrow(_corpus_pieces(tokenizer_json, pattern), "piece string, docs bigint")
    distinct = pieces.groupBy("piece").agg(F.sum("docs").alias("docs"))
    return distinct.mapInArrow(_count_pieces(tokenizer_json), "piece string, docs bigint, n int")


def _document_pieces(tokenizer_json: str, pattern: str, hot):
    """Frequencies of each document's pre-tokens that are not in the bounded
    table; the first row of a document also carries what the table gave.

    A document without such pre-tokens gets one row whose piece joins nothing:
    it mixes controls and letters, which no pre-token does.
    """
    def run(batches):
        split, table = _splitter(tokenizer_json, pattern), hot.value
        for batch in batches:
            for part in slices(batch, "text"):
                keys, ids, pieces, freqs, sums, sizes, firsts = [], [], [], [], [], [], []
                for key, doc, text in zip(*(part.column(c).to_pylist() for c in ("key", "doc_id", "text"))):
                    counts, known, rest = Counter(split(text or "")), 0, 0
                    for piece, freq in counts.items():
                        n = table.get(piece)
                        if n is not None:
                            known += n * freq
                        else:
                            pieces.append(piece)
                            freqs.append(freq)
                            rest += 1
                    if not rest:
                        pieces.append(f"\0 a\0{key}")
                        freqs.append(0)
                        rest = 1
                    keys += [key] * rest
                    ids += [doc] + [None] * (rest - 1)
                    sums += [known] + [0] * (rest - 1)
                    sizes += [len((text or "").encode())] + [0] * (rest - 1)
                    firsts += [1] + [0] * (rest - 1)
                yield pa.record_batch(
                    [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(pieces, pa.string()),
                     pa.array(freqs, pa.int32()),
                     pa.array(sums, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int32())],
                    ["key", "doc_id", "piece", "freq", "known", "n_bytes", "rows"])
    return run


def token_counts(docs: DataFrame, tokenizer_json: str, pattern: str, limit_tokens: int = LIMIT_TOKENS,
                 hot_pieces: int = HOT_PIECES) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``
    (columns ``doc_id``, an integer, and ``text``)."""
    spark = docs.sparkSession
    counts = stored(piece_counts(docs, tokenizer_json, pattern), "pieces")
    short = counts.where((F.octet_length("piece") <= HOT_PIECE_BYTES) & (F.col("docs") > 1))
    # The lowest frequency class down to which the table keeps its bound: one
    # row per class comes to the driver, then at most ``hot_pieces`` entries.
    classes = short.groupBy(F.floor(8 * F.log2("docs")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    lowest, room = None, hot_pieces
    for r in sorted(classes.collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        lowest = r["class"]
    top = [] if lowest is None else short.where(F.floor(8 * F.log2("docs")) >= lowest).select("piece", "n").collect()
    hot = spark.sparkContext.broadcast({r["piece"]: r["n"] for r in top})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    per_doc = rows.select(row_key("doc_id", "text").alias("key"), "doc_id", "text").mapInArrow(
        _document_pieces(tokenizer_json, pattern, hot),
        "key bigint, doc_id bigint, piece string, freq int, known bigint, n_bytes bigint, rows int")
    joined = per_doc.join(counts.select("piece", "n"), "piece", "left")
    # Rows equal in id and text share a key, and each adds the same total.
    total = F.sum(F.col("known") + F.col("freq") * F.coalesce("n", F.lit(0)))
    per_key = joined.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
        F.sum("rows").cast("int").alias("rows"), total.alias("total"))
    n_tokens = F.expr("total div rows")
    return per_key.select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit_tokens).alias("over_limit"),
        F.explode(F.array_repeat(F.lit(1), F.col("rows")))).drop("col")
