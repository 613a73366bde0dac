"""Postings per n-gram, with the n-grams shuffled in compressed blocks.

A row per n-gram and text fills the disks: each n-gram repeats its tokens, and
a shuffle compresses strings of a few words hardly at all. Here a task works
slices of texts. It counts a slice's postings per n-gram, keeps each distinct
window of ``max_n`` tokens once (the shorter n-grams are its beginnings) and
hands on one compressed block of windows per slice and part. A part holds all
windows that begin with the same two tokens, so it counts them to the end.

Every step works on whole columns of tokens (Arrow and NumPy, no row loops).
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The keyword snapshot is a job of its own, so its workers need no copy of this
# package: the functions below go to them as they are.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A slice of texts has about so many bytes; some 200 bytes of memory go to a token.
SLICE_BYTES = 5 << 20
# Rows of a record batch of results.
RESULT_ROWS = 1 << 16
# A task that counts a part brings equal windows together whenever it has gathered
# so many bytes of them.
FOLD_BYTES = 32 << 20

_BLOCKS = "part int, windows int, size int, owned boolean, block binary"
_TOKEN = (1 << 32) - 1  # bits of a token's number in a key
_CODEC = "zstd"


def ngram_postings(texts: DataFrame, parts: int, max_n: int) -> DataFrame:
    """``(keyword, posting_count)`` for every n-gram of 1 to ``max_n`` tokens.

    ``texts`` has ``norm`` (tokens with one blank between them) and ``owner``:
    NULL if the text is its posting's only one, else a name of the posting
    without line breaks, and a posting counts once however many texts name it.
    """
    fields = max(2, max_n)
    blocks = texts.select("owner", "norm").mapInArrow(_packing(fields, max_n, parts), _BLOCKS)
    return blocks.repartitionById(parts, "part").mapInArrow(_counting(fields), "keyword string, posting_count long")


def _different(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting is many times faster than ``np.unique`` by hashes."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def _distinct(ids: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """How many distinct values of ``of`` each id below ``size`` has."""
    span = int(of.max(initial=0)) + 1
    return np.bincount(_different(ids * span + of) // span, minlength=size)


def _levels(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the beginnings of 2, 3, ... tokens: the distinct ones, each as the
    number of the beginning one token shorter and its last token, and the
    number of each window's among them."""
    ids = columns[0]
    for column in columns[1:]:
        beginnings, ids = np.unique(ids << 32 | column, return_inverse=True)
        yield beginnings, ids


def _windows(tokens: np.ndarray, text: np.ndarray, fields: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The windows of ``fields`` tokens from each place that has a second token
    (0 stands beyond the end of the text), and their texts."""
    columns = [tokens]
    for k in range(1, fields):
        later = np.zeros_like(tokens)
        same = text[k:] == text[:-k]
        later[:-k][same] = tokens[k:][same]
        columns.append(later)
    begins = columns[1] > 0
    return [c[begins] for c in columns], text[begins]


def _plain_rows(tokens, text, fields, max_n, names):
    """Distinct windows and, for each of their beginnings, on the first window
    that has it, the number of texts with it."""
    single = _distinct(tokens, text, names)
    seen = np.flatnonzero(single)
    rows = [[seen] + [np.zeros_like(seen)] * (fields - 1)]
    counts = [[single[seen]] + [np.zeros_like(seen)] * (fields - 2)]
    if max_n > 1:
        columns, text = _windows(tokens, text, fields)
        levels = []
        for beginnings, ids in _levels(columns):
            found = _distinct(ids, text, len(beginnings))
            found[(beginnings & _TOKEN) == 0] = 0
            levels.append((beginnings, found))
        row, count = _whole(levels)
        rows.append(row)
        counts.append(count)
    return [np.concatenate(c) for c in zip(*rows)], np.stack([np.concatenate(c) for c in zip(*counts)], 1)


def _whole(levels: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The tokens of each distinct window, and the counts of its beginnings
    where it is the first window with them, else 0."""
    at, row, count = np.arange(len(levels[-1][0])), [], []
    for beginnings, found in reversed(levels):
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        count.append(np.where(first, found[at], 0))
        row.append(beginnings[at] & _TOKEN)
        at = beginnings[at] >> 32
    return [at, *reversed(row)], count[::-1]


def _owned_rows(tokens, text, owners, fields, max_n):
    """Distinct pairs of a window, or a token by itself, and an owner."""
    span = int(owners.max()) + 1
    pairs = _different(tokens * span + owners[text])
    rows = [[pairs // span] + [np.zeros_like(pairs)] * (fields - 1) + [pairs % span]]
    if max_n > 1:
        columns, text = _windows(tokens, text, fields)
        *_, (_, ids) = _levels(columns)
        _, kept = np.unique(ids * span + owners[text], return_index=True)
        rows.append([c[kept] for c in columns] + [owners[text][kept]])
    *columns, owner = (np.concatenate(c) for c in zip(*rows))
    return columns, owner


def _joined(names: pa.Array, codes: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The names of ``codes``, end to end, and where each of them begins."""
    strings = names.take(pa.array(codes))
    if not len(strings):
        return memoryview(b""), np.zeros(1, np.int64)
    at = np.frombuffer(strings.buffers()[1], np.int64)[:len(codes) + 1]
    return memoryview(strings.buffers()[2])[:at[-1]], at


def _with_breaks(strings: pa.Array) -> pa.Array:
    empty, line_break = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
    return pc.binary_join_element_wise(strings, empty, line_break)


def _hashes(lines: pa.Array) -> np.ndarray:
    """A number for each line that depends on its bytes alone."""
    data, at = _joined(lines, np.arange(len(lines)))
    lengths = np.diff(at)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
    return np.add.reduceat(np.frombuffer(data, np.uint8) * powers[place], at[:-1])


def _blocks(columns, names, hashes, parts, tail) -> pa.RecordBatch:
    """One block for each part: its windows as lines, and behind them what
    ``tail(order)`` gives for a range of them."""
    mixed = hashes[columns[0]] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[columns[1]]
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    part = ((mixed ^ mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, behind = part[order], tail(order)
    text, at = _joined(names, np.stack(columns, 1)[order].ravel())
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[starts[1:], len(part)]
    width, codec, out = len(columns), pa.Codec(_CODEC), []
    for a, b in zip(starts.tolist(), ends.tolist()):
        raw = b"".join((text[at[a * width]:at[b * width]], behind(a, b)))
        out.append((len(raw), codec.compress(raw, asbytes=True)))
    return pa.RecordBatch.from_arrays([
        pa.array(part[starts], pa.int32()), pa.array(ends - starts, pa.int32()), pa.array([n for n, _ in out], pa.int32()),
        pa.array([False] * len(out)), pa.array([x for _, x in out], pa.binary())],
        ["part", "windows", "size", "owned", "block"])


def _pack(owner: pa.Array, norm: pa.Array, fields: int, max_n: int, parts: int) -> Iterator[pa.RecordBatch]:
    words = pc.split_pattern(pc.cast(norm, pa.large_string()), " ")
    text = pc.list_parent_indices(words).to_numpy().astype(np.int64)
    coded = pc.list_flatten(words).dictionary_encode()
    names = pa.concat_arrays([pa.array([""], pa.large_string()), coded.dictionary])
    tokens = coded.indices.to_numpy().astype(np.int64) + 1
    names = _with_breaks(names)
    hashes = _hashes(names)
    owned = np.asarray(pc.is_valid(owner).to_numpy(zero_copy_only=False), bool)
    plain = ~owned[text]
    if plain.any():
        columns, counts = _plain_rows(tokens[plain], text[plain], fields, max_n, len(names))

        def figures(order):
            placed = counts[order].astype("<u4")
            return lambda a, b: placed[a:b].tobytes()

        yield _blocks(columns, names, hashes, parts, figures)
    if not plain.all():
        coded = pc.cast(owner, pa.large_string()).dictionary_encode()
        owners = np.asarray(coded.indices.fill_null(0).to_numpy(), np.int64)
        columns, named = _owned_rows(tokens[~plain], text[~plain], owners, fields, max_n)

        def figures(order):
            joined, at = _joined(_with_breaks(coded.dictionary), named[order])
            return lambda a, b: joined[at[a]:at[b]]

        batch = _blocks(columns, names, hashes, parts, figures)
        yield batch.set_column(3, "owned", pa.array([True] * batch.num_rows))


def _packing(fields: int, max_n: int, parts: int):
    def run(batches):
        for rows in _slices(batches):
            yield from _pack(rows.column("owner"), rows.column("norm"), fields, max_n, parts)
            pa.default_memory_pool().release_unused()
    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts in record batches of about ``SLICE_BYTES``, empty ones left out."""
    held, size = [], 0
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch.column("norm")).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(lengths[start - 1]) if start else 0
            stop = min(batch.num_rows, int(np.searchsorted(lengths, before + SLICE_BYTES - size)) + 1)
            held.append(batch.slice(start, stop - start))
            size += int(lengths[stop - 1]) - before
            start = stop
            if size >= SLICE_BYTES:
                yield from _filled(held)
                held, size = [], 0
    yield from _filled(held)


def _filled(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    if not held:
        return []
    rows = pa.Table.from_batches(held)
    return rows.filter(pc.not_equal(rows.column("norm"), "")).combine_chunks().to_batches()


def _lines(data: bytes) -> pa.Array:
    """The lines of ``data``, each with its line break."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10).astype(np.int64) + 1
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.r_[np.int64(0), ends]), pa.py_buffer(data))


def _counting(fields: int, fold_bytes: int = FOLD_BYTES):
    def run(batches):
        gathered, size, limit = _Gathered(fields), 0, fold_bytes
        for batch in batches:
            for windows, length, owned, block in zip(*(batch.column(c).to_pylist() for c in ("windows", "size", "owned", "block"))):
                gathered.add(pa.decompress(block, length, _CODEC, asbytes=True), windows, owned)
                size += length
                if size > limit:
                    size = gathered.fold()
                    limit = max(fold_bytes, 2 * size)
        if size:
            yield from _counted(*gathered.coded()[:4])
    return run


class _Gathered:
    """Windows of a part as lines: plain ones with their counts, and owned ones
    with their owners."""

    def __init__(self, fields: int):
        self.fields, self.texts, self.counts, self.owned_texts, self.owners = fields, [], [], [], []

    def add(self, raw: bytes, windows: int, owned: bool) -> None:
        if owned:
            cut = _nth_line(raw, windows * self.fields)
            self.owned_texts.append(raw[:cut])
            self.owners.append(raw[cut:])
        else:
            cut = len(raw) - windows * (self.fields - 1) * 4
            self.texts.append(raw[:cut])
            self.counts.append(np.frombuffer(raw, "<u4", offset=cut).reshape(-1, self.fields - 1))

    def coded(self):
        """The tokens' numbers in each window, plain ones first, their counts,
        the others' owners, and what the numbers of both stand for."""
        # The line break in front stands for no token and gets the number 0.
        coded = _lines(b"".join([b"\n", *self.texts, *self.owned_texts])).dictionary_encode()
        owner = _lines(b"".join(self.owners)).dictionary_encode()
        counts = np.concatenate([np.zeros((0, self.fields - 1), np.int64), *self.counts])
        self.__init__(self.fields)
        codes = coded.indices.to_numpy().astype(np.int64)[1:].reshape(-1, self.fields)
        return codes, counts, owner.indices.to_numpy().astype(np.int64), coded.dictionary, owner.dictionary

    def fold(self) -> int:
        """Bring equal windows together; the bytes that are left."""
        codes, counts, owner, names, owner_names = self.coded()
        plain = len(counts)
        if plain:
            levels = [(beginnings, _sums(ids, counts[:, k], len(beginnings)))
                      for k, (beginnings, ids) in enumerate(_levels(list(codes[:plain].T)))]
            columns, count = _whole(levels)
            self.texts.append(bytes(_joined(names, np.stack(columns, 1).ravel())[0]))
            self.counts.append(np.stack(count, 1))
        if len(owner):
            *_, (_, ids) = _levels(list(codes[plain:].T))
            _, kept = np.unique(ids * (int(owner.max()) + 1) + owner, return_index=True)
            self.owned_texts.append(bytes(_joined(names, codes[plain:][kept].ravel())[0]))
            self.owners.append(bytes(_joined(owner_names, owner[kept])[0]))
        return sum(memoryview(x).nbytes for held in (self.texts, self.counts, self.owned_texts, self.owners) for x in held)


def _sums(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(ids, weights=counts, minlength=size).astype(np.int64)


def _nth_line(raw: bytes, n: int) -> int:
    return int(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)[n - 1]) + 1


def _counted(codes: np.ndarray, counts: np.ndarray, owner: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
    """Counts of plain windows (the first rows) and of owned ones, per n-gram."""
    names = pc.utf8_rtrim(names, "\n")
    plain, above = len(counts), []
    for k, (beginnings, ids) in enumerate(_levels(list(codes.T))):
        above.append(beginnings)
        total = _sums(ids[:plain], counts[:, k], len(beginnings)) + _distinct(ids[plain:], owner, len(beginnings))
        if k:  # where there is no token, the n-gram is a shorter one
            total[(beginnings & _TOKEN) == 0] = 0
        found = np.flatnonzero(total)
        for a in range(0, len(found), RESULT_ROWS):
            at, tokens = found[a:a + RESULT_ROWS], []
            result = total[at]
            for level in reversed(above):
                tokens.append(level[at] & _TOKEN)
                at = level[at] >> 32
            tokens = [at, *reversed(tokens)]
            alone = tokens[1] == 0  # only among beginnings of two: a token by itself
            for rows, width in ((alone, 1), (~alone, len(tokens))):
                if rows.any():
                    words = [names.take(pa.array(t[rows])) for t in tokens[:width]]
                    keyword = words[0] if width == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))
                    yield pa.RecordBatch.from_arrays(
                        [pc.cast(keyword, pa.string()), pa.array(result[rows], pa.int64())], ["keyword", "posting_count"])
