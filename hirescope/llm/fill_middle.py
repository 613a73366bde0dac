"""Fill-in-middle texts, put together by a secondary sort.

1. Every text is cut into units (a run of letters A-Z, or one other character).
   A hash of its doc_id picks the form and where prefix and middle end.
2. The text leaves as pieces of at most ``PIECE_UNITS`` units, each keyed by
   its document and its place in the output, the sentinels in front of the
   first piece of their part.
3. The pieces are repartitioned by document and sorted within the partitions by
   document and place (the DataFrame form of ``repartitionAndSortWithinPartitions``),
   and stream in that order into a digest per document.
4. For the way back, the stream is read as a reader of the output would: the
   sentinels tell the part of each piece. The pieces, now keyed by part and
   place, are sorted again inside the partitions, where they already are, and
   stream into the digest of the restored text.

No task holds more of a text than one piece after the cut, nor more of the
cut than the offsets of a window of characters. The one shuffle carries each
text once.

Defined results: a NULL or empty text is one empty plain piece; a text that
holds a sentinel stays plain; a NULL doc_id is hashed as an empty number; rows
equal in doc_id and text travel as one, with their count, and come back as so
many equal rows; rows that share a doc_id only are told apart by their texts;
no tie is left, as places differ; an empty table gives an empty result; a very
long text is more pieces; other columns, whatever their names, are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.llm.common import SLICE_BYTES, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT = 10
SPM_PERCENT = 20
PIECE_UNITS = 8192
# Characters whose unit starts are held at a time.
WINDOW_CHARS = 1 << 18

# Place of a part in the restored text; the row that ends a document comes last.
_PARTS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_END = 3

PIECES = ("doc_id long, digest binary, at int, copies long, n long, form string, prefix_chars long, "
          "middle_chars long, piece string")
_SORTED = ("doc_id long, digest binary, part int, at int, copies long, n long, form string, prefix_chars long, "
           "middle_chars long, output_sha256 string, piece string")
_RESULT = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
           "restored_sha256 string")


class Units:
    """Where the units of a text start, a window of characters at a time."""

    def __init__(self, text: str):
        self.text = text
        self._held = (-1, np.empty(0, np.int64))
        windows = range(max(1, -(-len(text) // WINDOW_CHARS)))
        self.before = np.cumsum([0] + [len(self._starts(w)) for w in windows])
        self.n = int(self.before[-1])

    def _starts(self, window: int) -> np.ndarray:
        if self._held[0] != window:
            first = window * WINDOW_CHARS
            lead = min(first, 1)  # the character before tells whether a run goes on
            code = np.frombuffer(self.text[first - lead:first + WINDOW_CHARS].encode("utf-32-le"), np.uint32) | np.uint32(32)
            letter = (code >= ord("a")) & (code <= ord("z"))
            starts = np.ones(len(letter), bool)
            starts[1:] = ~(letter[1:] & letter[:-1])
            self._held = (window, np.flatnonzero(starts[lead:]) + first)
        return self._held[1]

    def offset(self, unit: int) -> int:
        """The character at which a unit starts; the text's length for ``n``."""
        if unit >= self.n:
            return len(self.text)
        window = int(np.searchsorted(self.before, unit, side="right")) - 1
        return int(self._starts(window)[unit - self.before[window]])


def plan(doc_id: int | None, text: str, n: int) -> tuple[str, int, int]:
    """Form, and the units after which prefix and middle end."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN_PERCENT:
        return "plain", a, b
    return ("spm" if h4 % 100 < SPM_PERCENT else "psm"), a, b


def pieces(doc_id: int | None, text: str) -> Iterator[tuple]:
    """``(at, n, form, prefix_chars, middle_chars, piece)`` in order of the output."""
    units = Units(text)
    n = units.n
    form, a, b = plan(doc_id, text, n)
    spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, n)}
    order = {"plain": [""], "psm": [PREFIX, SUFFIX, MIDDLE], "spm": [SUFFIX, PREFIX, MIDDLE]}[form]
    chars = (None, None) if form == "plain" else (units.offset(a), units.offset(b) - units.offset(a))
    at = 0
    for sentinel in order:
        start, stop = spans.get(sentinel, (0, n))
        lead = sentinel
        for k in range(start, max(stop, start + 1), PIECE_UNITS):
            yield at, n, form, *chars, lead + text[units.offset(k):units.offset(min(k + PIECE_UNITS, stop))] if stop > start else lead
            at, lead = at + 1, ""


class _Rows:
    """Rows gathered into record batches of about ``SLICE_BYTES`` of text."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 64 + len(row[-1] or "")
        if self.size >= SLICE_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.size = [], 0


def _schema(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, types[kind]) for name, kind in (part.split() for part in ddl.split(","))])


def _cut(batches):
    out = _Rows(_schema(PIECES))
    for batch in batches:
        for part in slices(batch, "text"):
            copies: dict[tuple, int] = {}
            for row in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                copies[row] = copies.get(row, 0) + 1
            for (doc_id, text), count in copies.items():
                digest = hashlib.blake2b(text.encode(), digest_size=16).digest()
                for at, n, form, prefix, middle, piece in pieces(doc_id, text):
                    yield from out.add(doc_id, digest, at, count, n, form, prefix, middle, piece)
    yield from out.rest()


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _written(batches):
    """Digest the output of each document; hand its pieces on by their part."""
    out = _Rows(_schema(_SORTED))
    key = last = about = digest = None
    copies, part = 0, 0
    for batch in batches:
        for doc_id, name, at, count, n, form, prefix, middle, piece in _columns(batch):
            if (doc_id, name) != key:
                if key is not None:
                    yield from out.add(*key, _END, 0, copies, *about, digest.hexdigest(), None)
                key, last, about, copies = (doc_id, name), -1, (n, form, prefix, middle), 0
                digest, part = hashlib.sha256(), 0
            if at == 0:
                copies += count
            if at == last:
                continue  # the same piece of an equal row
            last = at
            digest.update(piece.encode())
            if form != "plain" and piece[:3] in _PARTS:
                part, piece = _PARTS[piece[:3]], piece[3:]
            yield from out.add(*key, part, at, None, None, None, None, None, None, piece)
    if key is not None:
        yield from out.add(*key, _END, 0, copies, *about, digest.hexdigest(), None)
    yield from out.rest()


def _restored(batches):
    out = _Rows(_schema(_RESULT))
    digest = hashlib.sha256()
    for batch in batches:
        for doc_id, _, part, _, copies, n, form, prefix, middle, output, piece in _columns(batch):
            if part != _END:
                digest.update(piece.encode())
                continue
            for _ in range(copies):
                yield from out.add(doc_id, n, form, prefix, middle, output, digest.hexdigest())
            digest = hashlib.sha256()
    yield from out.rest()


def assembled(docs: DataFrame) -> DataFrame:
    """The outputs as pieces, documents together and in order of the output
    within their partition (columns ``PIECES``). Equal rows of different tasks
    name the same pieces; ``copies`` tells how many rows a task saw."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return (rows.mapInArrow(_cut, PIECES).repartition("doc_id", "digest")
            .sortWithinPartitions("doc_id", "digest", "at"))


def digests(sorted_pieces: DataFrame) -> DataFrame:
    """One row per row of the input of ``assembled``, whose result this takes:
    what was cut, and the digests of the output and of the text restored from it."""
    placed = sorted_pieces.mapInArrow(_written, _SORTED).sortWithinPartitions("doc_id", "digest", "part", "at")
    return placed.mapInArrow(_restored, _RESULT)


def outputs(sorted_pieces: DataFrame) -> DataFrame:
    """``(doc_id, form, output)``, one row for all equal rows: the pieces of each
    document put together, for a writer that wants whole texts."""
    whole = sorted_pieces.groupBy("doc_id", "digest").agg(
        F.first("form").alias("form"), F.array_sort(F.collect_set(F.struct("at", "piece"))).alias("p"))
    return whole.select("doc_id", "form", F.array_join(F.col("p.piece"), "").alias("output"))
