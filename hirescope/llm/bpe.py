"""Byte-level BPE encoding and decoding of whole texts.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own
(in parallel, as chunks are dealt over the cluster). Two neighbouring chunks
are stitched at the first boundary that both found in their overlap: the
pattern looks only forward, so from a shared boundary on both see the same
pre-tokens. Each chunk then encodes the pre-tokens between its two stitches.
A text no longer than one chunk has no neighbour to be stitched to and is
encoded where it lies, without a shuffle. Should two neighbours share no
boundary (one pre-token longer than the overlap), the chunks of that document
are put together again and pre-tokenised as one.

Decoding looks up the bytes of each id and concatenates them.

Defined results: NULL or empty text gives no ids and no bytes; a repeated row
gives a repeated result; other columns of the input are ignored; an empty
table gives an empty result.
"""

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirescope.llm.common import lean, row_key, slices

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 2_048
# The pattern reads at most this far past the end of a match.
LOOKAHEAD = 4
# Distinct pre-tokens whose ids a task remembers at a time.
CACHE_PIECES = 100_000


def read_ranks(path: str) -> bytes:
    """The rank file as bytes, to be sent along with the tasks (about 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class _PieceIds(dict):
    """Ids of a pre-token, worked out when it is first met."""

    def __init__(self, encoding: tiktoken.Encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = np.array(self.encoding.encode_ordinary(piece), np.int32).tobytes()
        self[piece] = ids
        return ids


class _Encoder:
    def __init__(self, data: bytes, pattern: str):
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(data),
                                          special_tokens={})
        self.ids = _PieceIds(self.encoding)

    def encode(self, text: str, start: int, stop: int) -> bytes:
        """Ids, as 32-bit integers one after the other, of the pre-tokens that
        begin in [start, stop); each is seen with the text that follows it."""
        if start == 0 and stop >= len(text):
            found = self.pattern.findall(text)
        else:
            found = []
            for m in self.pattern.finditer(text, start):
                if m.start() >= stop:
                    break
                found.append(m.group())
        return b"".join(map(self.ids.__getitem__, found))


@functools.lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> _Encoder:
    return _Encoder(data, pattern)


def _cut(chunk: int, overlap: int):
    """Rows of whole texts to rows of chunks: ``(key, doc_id, k, start, last, chunk)``."""
    def run(batches):
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for i in range(batch.num_rows):
                key, doc, text = (batch.column(c)[i] for c in ("key", "doc_id", "text"))
                text, k, start = text.as_py(), 0, 0
                while True:
                    end = start + chunk + overlap
                    last = end >= len(text)
                    yield pa.record_batch(
                        [pa.array([key.as_py()], pa.int64()), pa.array([doc.as_py()], doc_type),
                         pa.array([k], pa.int32()), pa.array([start], pa.int64()),
                         pa.array([last]), pa.array([text[start:end]])],
                        ["key", "doc_id", "k", "start", "last", "chunk"])
                    if last:
                        break
                    k, start = k + 1, start + chunk
    return run


def _bounds(pattern: str, chunk: int, overlap: int):
    """Boundaries each chunk found where it overlaps the one before and after."""
    def run(batches):
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for start, text in zip(batch.column("start").to_pylist(), batch.column("chunk").to_pylist()):
                at = np.fromiter((m.end() for m in compiled.finditer(text)), np.int64)
                sure = len(text) - LOOKAHEAD
                heads.append(start + at[at <= min(overlap, sure)])
                tails.append(start + at[(at >= chunk) & (at <= sure)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                [*batch.schema.names, "head", "tail"])
    return run


def _encode_between(data: bytes, pattern: str):
    def run(batches):
        encoder = _encoder(data, pattern)
        for batch in batches:
            for part in slices(batch, "chunk"):
                ids = [encoder.encode(text or "", a, b) for text, a, b in
                       zip(*(part.column(c).to_pylist() for c in ("chunk", "a", "b")))]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                names = [c for c in part.schema.names if c not in ("chunk", "a", "b")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), ids], [*names, "ids"])
    return lean(run, _encoder, _ranks)


def _schema(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def encode(docs: DataFrame, ranks: bytes, pattern: str, chunk_chars: int = CHUNK_CHARS,
           overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs`` (columns ``doc_id``, ``text``)."""
    if not LOOKAHEAD < overlap_chars < chunk_chars:
        raise ValueError("the overlap must be longer than the look-ahead and shorter than a chunk")
    rows = docs.select("doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    reach = chunk_chars + overlap_chars
    one = rows.where(size <= reach).select("doc_id", F.col("text").alias("chunk"), F.lit(0).alias("a"),
                                           size.alias("b"))
    encoded_one = one.mapInArrow(_encode_between(ranks, pattern),
                                 _schema(rows, "doc_id") + ", ids array<int>")

    long = rows.where(size > reach).withColumn("key", row_key("doc_id", "text"))
    cut = long.mapInArrow(_cut(chunk_chars, overlap_chars),
                          "key bigint, " + _schema(rows, "doc_id") +
                          ", k int, start bigint, last boolean, chunk string")
    # Rows equal in id and text are worked once; ``copies`` brings them back.
    dealt = cut.groupBy("key", "doc_id", "k").agg(
        F.first("start").alias("start"), F.first("last").alias("last"),
        F.first("chunk").alias("chunk"), F.count(F.lit(1)).alias("copies"))
    found = dealt.mapInArrow(_bounds(pattern, chunk_chars, overlap_chars),
                             _schema(dealt, *dealt.columns) + ", head array<bigint>, tail array<bigint>")
    order = Window.partitionBy("key", "doc_id").orderBy("k")
    whole = Window.partitionBy("key", "doc_id")
    met = found.withColumn("stop", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    met = met.withColumn("from", F.lag("stop").over(order)).withColumn(
        "apart", F.max(~F.col("last") & F.col("stop").isNull()).over(whole))
    stitched = met.where(~F.col("apart")).select(
        "key", "doc_id", "k", "copies", "chunk",
        (F.coalesce("from", "start") - F.col("start")).cast("int").alias("a"),
        F.coalesce(F.col("stop") - F.col("start"), F.length("chunk")).cast("int").alias("b"))
    # No shared boundary: the document's chunks become one again.
    body = F.when(F.col("last"), F.col("chunk")).otherwise(F.substring("chunk", 1, chunk_chars))
    rejoined = met.where("apart").groupBy("key", "doc_id").agg(
        F.max("copies").alias("copies"),
        F.sort_array(F.collect_list(F.struct("k", body.alias("body")))).alias("parts"))
    rejoined = rejoined.select(
        "key", "doc_id", F.lit(0).alias("k"), "copies",
        F.concat_ws("", F.transform("parts", lambda p: p["body"])).alias("chunk"), F.lit(0).alias("a"),
        F.lit(2**31 - 1).alias("b"))
    pieces = stitched.union(rejoined).repartition("key", "k").mapInArrow(
        _encode_between(ranks, pattern),
        "key bigint, " + _schema(rows, "doc_id") + ", k int, copies bigint, ids array<int>")
    joined = pieces.groupBy("key", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"), F.max("copies").alias("copies"))
    encoded_long = joined.select(
        "doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "ids")
    return encoded_one.unionByName(encoded_long)


@functools.lru_cache(maxsize=2)
def _token_bytes(data: bytes) -> pa.Array:
    ranks = _ranks(data)
    found = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        found[i] = token
    return pa.array(found, pa.large_binary())


def _decode(data: bytes):
    def run(batches):
        tokens = _token_bytes(data)
        for batch in batches:
            ids = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            # The looked-up bytes lie one after the other, so a document's bytes
            # are those between its first and its last id.
            taken = tokens.take(ids.flatten())
            at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])
            data_buffer = taken.buffers()[2] if len(taken) else pa.py_buffer(b"")
            cut = at[ends.astype(np.int64)]
            out = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), batch.num_rows, [None, pa.py_buffer(cut.tobytes()), data_buffer])
            yield pa.RecordBatch.from_arrays([*batch.columns, out.cast(pa.binary())],
                                             [*batch.schema.names, "decoded"])
    return lean(run, _token_bytes, _ranks)


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """``encoded`` with ``decoded``: the concatenated bytes of its ``ids``."""
    names = encoded.columns
    return encoded.mapInArrow(_decode(ranks), _schema(encoded, *names) + ", decoded binary")
