"""Toxicity by a learned lexicon, misspellings included, and the context of hits.

Learning. Words, and word beginnings (stems), that toxic documents hold far
more often than others form the lexicon; both come with a weight (log odds).
Documents that are copies of one another count once.

Matching. The lexicon is a trie. A Levenshtein automaton of one edit (a letter
more, less or other, or two neighbours swapped) runs over it: a state is a set
of trie nodes with the edits spent so far, worked out when a word first leads
there and kept. A word costs one step a letter and most words die within a
few. Words may hold digits and signs inside; those that look like a letter
stand for it without an edit. A first letter may be wrong in longer words
only; stems match exactly. A word with digits or signs that meets no entry is
read as the letter runs it holds.

Context. A misspelt hit counts ``MISSPELT`` of an exact one, a hit inside
quotation marks or next to a reporting word (quoted abuse) ``QUOTED``, and
hits count more with others in their window. A logistic model over a
document's hits gives the score; its coefficients are learned with lexicons
that did not see the document.

Defined results: NULL, empty or wordless text has no hits and gets the score of
such texts; a very long text is read whole, its features being sums, shares
and largest values; of entries equally near the first of the lexicon holds; a
repeated row gets a repeated result; other columns of the input are ignored;
an empty table gives an empty result; without labels of both kinds every score
is the smoothed share of toxic labels.
"""

import functools
import pickle
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.llm.common import lean, slices, stored
from hirescope.llm.labels import held_out, logistic, sample
from hirescope.llm.minhash import shingle_set

# Bounds of the labelled sample and of the lexicon.
SAMPLE_ROWS = {0: 6000, 1: 4000}
LEXICON_ENTRIES = 20_000
FOLDS = 4
# An entry needs so many documents, odds, and evidence (log-likelihood ratio).
MIN_DOCS, MIN_LOG_ODDS, MIN_EVIDENCE = 5, 2.0, 30.0
STEM_LETTERS = (4, 5, 6)
# Words at least this long may be misspelt by one edit.
FUZZY_LETTERS = 5
# And with a wrong first letter if at least this long.
FIRST_LETTERS = 6
MAX_EDITS = 1
WINDOW = 10
QUOTED = 0.5
MISSPELT = 0.9
# Digits and signs, and the letters they are written for.
ALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "+": "t", "*": "aeiou"}
THRESHOLD = 0.7

# Words that report what another said, in the languages of the corpus.
REPORTING = frozenset("said says wrote called quote quoted reported dit écrit appelé cité sagte schrieb nannte "
                      "zitiert dijo escribió llamó citó".split())
_WORD = re.compile(r"[^\W\d_]+")
# Words with digits anywhere and signs inside.
_TOKEN = re.compile(r"[^\W_]+(?:[@$!+*]+[^\W_]+)*")
_QUOTES = re.compile("[\"“”«»„]")
# Bounds of what a task remembers; it starts anew beyond them.
_STATES, _WORDS, _ENTRIES = 100_000, 100_000, 50_000


@dataclass
class Trie:
    """Lexicon entries by letter; node 0 is the root."""
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    word: list[int] = field(default_factory=lambda: [-1])
    stem: list[int] = field(default_factory=lambda: [-1])

    def add(self, letters: str, entry: int, is_stem: bool) -> None:
        node = 0
        for c in letters:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.word.append(-1)
                self.stem.append(-1)
            node = self.children[node][c]
        (self.stem if is_stem else self.word)[node] = entry


class Matcher:
    """The automaton: ``match(word)`` is ``(entry, edits)`` or ``(-1, 0)``.

    A state is the nodes reached with the edits spent, and the nodes that the
    next letter would reach if it is the first of a swapped pair.
    """

    def __init__(self, entries: list[tuple[str, bool]], fuzzy_letters: int = FUZZY_LETTERS, edits: int = MAX_EDITS,
                 first_letters: int = FIRST_LETTERS):
        self.trie, self.edits, self.fuzzy, self.first = Trie(), edits, fuzzy_letters, first_letters
        self.letters = [e for e, _ in entries]
        for i, (letters, is_stem) in enumerate(entries):
            self.trie.add(letters, i, is_stem)
        self.clear()

    def clear(self) -> None:
        """Forget the states met so far but the first and the dead one."""
        self.states: list[tuple] = [(self._close({0: 0}), ()), ((), ())]
        self.numbers = {s: i for i, s in enumerate(self.states)}
        self.steps: dict[tuple[int, str], int] = {}

    def _close(self, spent: dict[int, int]) -> tuple:
        """Nodes reached by leaving out letters, and the set in a fixed form."""
        todo = list(spent.items())
        while todo:
            node, e = todo.pop()
            if e < self.edits:
                for child in self.trie.children[node].values():
                    if spent.get(child, self.edits + 1) > e + 1:
                        spent[child] = e + 1
                        todo.append((child, e + 1))
        return tuple(sorted(spent.items()))

    def _step(self, state: tuple, c: str) -> tuple:
        spent: dict[int, int] = {}
        swapped: set[tuple[int, int, str]] = set()

        def put(node, e):
            if spent.get(node, self.edits + 1) > e:
                spent[node] = e

        for node, e in state[0]:
            children = self.trie.children[node]
            for letter in (c, *ALIKE.get(c, "")):
                if letter in children:
                    put(children[letter], e)
            if e < self.edits:
                put(node, e + 1)
                for letter, child in children.items():
                    put(child, e + 1)
                    if letter != c and c in self.trie.children[child]:
                        swapped.add((self.trie.children[child][c], e + 1, letter))
        for node, e, letter in state[1]:
            if c == letter:
                put(node, e)
        return self._close(spent), tuple(sorted(swapped))

    def _near(self, word: str, entry: int, edits: int) -> bool:
        """Whether a word is long enough, and letters enough, for what it lacks."""
        real, target = sum(c.isalpha() for c in word), self.letters[entry]
        if 2 * real < len(word):
            return False
        length = min(len(target), len(word))
        first = target[0] == word[0] or target[0] in ALIKE.get(word[0], "")
        return not edits or length >= (self.fuzzy if first else self.first)

    def match(self, word: str) -> tuple[int, int]:
        if len(self.steps) >= _STATES:
            self.clear()
        number, stem = 0, -1
        for c in word:
            nxt = self.steps.get((number, c))
            if nxt is None:
                state = self._step(self.states[number], c)
                nxt = self.numbers.setdefault(state, len(self.states))
                if nxt == len(self.states):
                    self.states.append(state)
                self.steps[number, c] = nxt
            number = nxt
            if number == 1:
                break
            for node, e in self.states[number][0]:
                if e == 0 and self.trie.stem[node] >= 0:
                    stem = self.trie.stem[node]
        found = [(e, self.trie.word[node]) for node, e in self.states[number][0] if self.trie.word[node] >= 0]
        found = sorted((e, entry) for e, entry in found if self._near(word, entry, e))
        if found and found[0][0] == 0:
            return found[0][1], 0
        if stem >= 0 and word.isalpha():
            return stem, 0
        return (found[0][1], found[0][0]) if found else (-1, 0)


class _Hits(dict):
    """Entry of a word, doubled, plus 1 if misspelt; -1 for none."""

    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: str) -> int:
        if len(self) >= _WORDS:
            self.clear()
        entry, edits = self.matcher.match(word)
        code = self[word] = -1 if entry < 0 else 2 * entry + (edits > 0 or not word.isalpha())
        return code

    def forget(self) -> None:
        """Give back what was remembered: idle workers outlive their tasks."""
        self.clear()
        self.matcher.clear()


FEATURES = 5


def _read_words(low: str, hits: _Hits) -> list[str]:
    """The words of a text; one with digits or signs that is no hit gives way
    to the letter runs it holds."""
    words = _TOKEN.findall(low)
    if all(map(str.isalpha, words)):
        return words
    return [run for w in words for run in ((w,) if w.isalpha() or hits[w] >= 0 else _WORD.findall(w))]


def _word_starts(low: str, hits: _Hits) -> list[int]:
    """Where the words of ``_read_words`` start."""
    out = []
    for m in _TOKEN.finditer(low):
        if m.group().isalpha() or hits[m.group()] >= 0:
            out.append(m.start())
        else:
            out += [m.start() + run.start() for run in _WORD.finditer(m.group())]
    return out


def document_features(text: str | None, hits: _Hits, weights: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Features of a document from its hits, with the numbers of exact and of
    misspelt hits."""
    out = np.zeros(FEATURES)
    if not text:
        return out, 0, 0
    low = text.lower()
    words = _read_words(low, hits)
    codes = np.fromiter(map(hits.__getitem__, words), np.int64, len(words))
    at = np.flatnonzero(codes >= 0)
    if not len(at):
        return out, 0, 0
    code = codes[at]
    misspelt = (code & 1).astype(bool)
    factor = np.where(misspelt, MISSPELT, 1.0)
    # Context: an odd number of quotation marks before a hit puts it in quotes.
    quotes = [m.start() for m in _QUOTES.finditer(low)]
    if quotes:
        starts = _word_starts(low, hits)
        inside = np.searchsorted(quotes, np.array(starts)[at]) % 2 == 1
        factor[inside] *= QUOTED
    for k, i in enumerate(at):
        if not REPORTING.isdisjoint(words[max(0, i - WINDOW // 2):i]):
            factor[k] *= QUOTED
    near = np.searchsorted(at, at + WINDOW, "right") - np.searchsorted(at, at - WINDOW, "left")
    exact = ~misspelt
    strength = weights[code // 2] * factor
    out[:] = (np.log1p(strength.sum()), strength.max(initial=0), np.log1p(100 * factor.sum() / len(words)),
              np.log1p(len(set(code // 2))), np.log1p((near * factor).max(initial=0)))
    return out, int(exact.sum()), int(misspelt.sum())


def _entry_counts():
    """Documents of the sample that hold each word or stem, by fold and label
    (``kind``). An entry may be handed on more than once; Spark adds them up."""
    def run(batches):
        counts: Counter = Counter()

        def out():
            keys = list(counts)
            done = pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                                    pa.array([counts[k] for k in keys], pa.int64())], ["entry", "kind", "n"])
            counts.clear()
            return done

        for batch in batches:
            for fold, y, text in zip(*(batch.column(c) for c in ("fold", "y", "text"))):
                words, kind = set(_WORD.findall(text.as_py().lower())), 2 * fold.as_py() + y.as_py()
                counts.update((w, kind) for w in words)
                counts.update((s, kind) for s in {w[:n] + "*" for w in words for n in STEM_LETTERS if len(w) > n})
                if len(counts) >= _ENTRIES:
                    yield out()
        yield out()
    return run


def _sketched():
    """A value that copies of a document mostly share: its smallest shingle hash."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = (shingle_set(t) for t in part.column("text").to_pylist())
                low = [int(s[0] >> np.uint64(1)) if len(s) else -1 for s in sets]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(low, pa.int64())],
                                                 [*part.schema.names, "sketch"])
    return run


def _weights(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float):
    """Log odds and evidence of entries by the documents of each label that hold them."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    total, share = toxic + other, n_toxic / max(n_toxic + n_other, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (total * share)), 0)
                        + np.where(other > 0, other * np.log(other / (total * (1 - share))), 0))
    ok = (toxic >= MIN_DOCS) & (odds >= MIN_LOG_ODDS) & (evidence >= MIN_EVIDENCE)
    return np.where(ok, odds, 0.0)


@dataclass
class Model:
    entries: list[tuple[str, bool]]
    weights: np.ndarray
    coefficients: np.ndarray | None
    prior: float


def fit(docs: DataFrame, labels: DataFrame, rows: dict[int, int] | None = None) -> Model:
    """Learn lexicon and coefficients from at most ``rows`` labelled documents
    of each kind, none held out. What comes to the driver is bounded by
    ``LEXICON_ENTRIES`` and by the sample's feature rows."""
    found, counts = sample(docs, labels, "toxic", rows or SAMPLE_ROWS)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    prior = (n1 + 0.5) / (n0 + n1 + 1)
    if not n0 or not n1:
        return Model([], np.zeros(0), None, prior)
    kinds = "doc_id long, text string, y int, sketch long"
    distinct = found.mapInArrow(_sketched(), kinds).groupBy("sketch", "y").agg(F.min(F.struct("doc_id", "text")).alias("d"))
    train = stored(distinct.select(F.pmod(F.xxhash64("sketch"), F.lit(FOLDS)).cast("int").alias("fold"), "y",
                                   F.col("d.text").alias("text")), "toxicity-sample")
    sizes = np.zeros((FOLDS, 2))
    for r in train.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["fold"], r["y"]] = r["n"]
    if not sizes.sum(axis=0).all():  # the labelled documents are not among these
        return Model([], np.zeros(0), None, prior)
    partial = train.mapInArrow(_entry_counts(), "entry string, kind int, n bigint")
    of_kind = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    sums = partial.groupBy("entry").agg(*[of_kind(k).alias(f"n{k}") for k in range(2 * FOLDS)])
    toxic, other = (sum(F.col(f"n{2 * f + y}") for f in range(FOLDS)) for y in (1, 0))
    n_other, n_toxic = sizes.sum(axis=0)
    likely = sums.where(toxic >= MIN_DOCS).where(
        toxic * float(n_other + 1) >= F.lit(float(np.exp(MIN_LOG_ODDS) / 2 * (n_toxic + 1))) * other)
    table = likely.orderBy(F.desc(toxic), "entry").limit(LEXICON_ENTRIES).collect()
    n = np.array([[r[f"n{k}"] for k in range(2 * FOLDS)] for r in table], np.float64).reshape(len(table), FOLDS, 2)
    entries = [(r["entry"].rstrip("*"), r["entry"].endswith("*")) for r in table]
    every = _weights(n.sum(axis=1)[:, 1], n.sum(axis=1)[:, 0], n_toxic, n_other)
    apart = [_weights(*(n.sum(axis=1) - n[:, f])[:, ::-1].T, *(sizes.sum(axis=0) - sizes[f])[::-1]) for f in range(FOLDS)]

    features = train.mapInArrow(_train_features(entries, apart), "y int, x array<double>").collect()
    x, y = np.array([r["x"] for r in features]), np.array([r["y"] for r in features])
    seen = np.bincount(y, minlength=2)
    weight = np.array([n0, n1])[y] / seen[y] * len(y) / (n0 + n1)
    keep = every > 0
    return Model([e for e, k in zip(entries, keep) if k], every[keep], logistic(x, y, weight), prior)


def _only(entries, weights):
    keep = weights > 0
    return _Hits(Matcher([e for e, k in zip(entries, keep) if k])), weights[keep]


def _train_features(entries, apart):
    def run(batches):
        lexicons = [_only(entries, w) for w in apart]
        for batch in batches:
            rows = [document_features(text.as_py(), *lexicons[fold.as_py()])[0].tolist() for fold, text in
                    zip(batch.column("fold"), batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])
    return run


@functools.lru_cache(maxsize=2)
def _loaded(data: bytes) -> tuple[Model, _Hits]:
    model = pickle.loads(data)
    return model, _Hits(Matcher(model.entries))


def _scores(m: Model, hits: _Hits, texts: list) -> tuple[np.ndarray, list]:
    found = [document_features(t, hits, m.weights) for t in texts]
    if m.coefficients is None:
        return np.full(len(found), m.prior), found
    x = np.array([f[0] for f in found]).reshape(len(found), FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ m.coefficients[:-1] + m.coefficients[-1], -30, 30))), found


def _score(model):
    def run(batches):
        m, hits = _loaded(model.value)
        for batch in batches:
            for part in slices(batch, "text"):
                score, found = _scores(m, hits, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score), pa.array([f[1] for f in found], pa.int32()),
                     pa.array([f[2] for f in found], pa.int32())],
                    [*part.schema.names, "score", "n_hits", "n_misspelt"])
        hits.forget()
    return lean(run, _loaded)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, text, held_out, score, n_hits, n_misspelt)`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows = docs.select("doc_id", "text")
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, score double, n_hits int, n_misspelt int"
    return rows.mapInArrow(_score(sent), kinds).select("doc_id", "text", held_out().alias("held_out"), "score", "n_hits", "n_misspelt")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m, hits = _loaded(sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                score, _ = _scores(m, hits, part.column("text").to_pylist())
                yield part.filter(pa.array(score < threshold))
        hits.forget()
    return docs.mapInArrow(lean(run, _loaded), docs.schema)
