"""Text quality by a generalised additive model with pairwise interactions.

Each feature is cut into bins. Boosting goes round the features: in every
round each one gets a shallow tree over its bins, fitted to what the model
still gets wrong, and a small step of it is added to the feature's lookup
table. Then the pairs of features that explain most of the rest get tables of
their own, boosted in the same way. A score is the sum of one bin per table,
looked up for whole batches.

The features describe form only (lengths, letter cases, signs, repetition),
over the whole text.

Defined results: NULL, empty or blank text has the features of an empty text
and is scored by them; a repeated row gets a repeated result; other columns of
the input are ignored; an empty table gives an empty result; without labels
of both kinds every score is the smoothed share of good labels.
"""

import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.llm.common import slices
from hirescope.llm.labels import held_out, sample

# Bound of the labelled sample.
SAMPLE_ROWS = {0: 8000, 1: 8000}
BINS = 48
ROUNDS, STEP = 200, 0.1
LEAVES = 3
PAIRS, PAIR_BINS, PAIR_ROUNDS = 6, 12, 100
SHRINK = 5.0
THRESHOLD = 0.5

_CLASSES = np.zeros(256, np.int64)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\f\v", "\n",
                             ".", ",", "!?", "|#*%$&@=+~^_<>{}[]/\\"), start=1):
    _CLASSES[list(_chars.encode())] = _i
_CLASSES[128:] = 10

FEATURE_NAMES = (
    "log_words", "word_bytes", "upper_share", "digit_share", "blank_share", "stop_rate", "comma_rate", "shout_rate",
    "sign_share", "other_share", "wide_share", "distinct_share", "top_word_share", "repeat_share", "line_words",
    "repeated_line_share", "distinct_pair_share", "short_word_share", "long_word_share", "ending_rate")


def text_features(text: str | None) -> np.ndarray:
    out = np.zeros(len(FEATURE_NAMES))
    if not text:
        return out
    data = text.encode()
    counts = np.bincount(_CLASSES[np.frombuffer(data, np.uint8)], minlength=11)
    other, upper, lower, digit, blank, line, stop, comma, shout, sign, wide = counts[:11]
    words, lines = data.split(), [x for x in text.split("\n") if x.strip()]
    n, size = max(len(words), 1), len(data)
    if not words:
        return out
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    numbers = {w: i for i, w in enumerate(seen)}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    pairs = len(np.unique(ids[1:] * len(seen) + ids[:-1])) if len(ids) > 1 else 1
    out[:] = (
        np.log1p(len(words)), lengths.mean(), upper / max(upper + lower, 1), digit / size, blank / size, stop / n, comma / n,
        shout / n, sign / size, other / size, wide / size, len(seen) / n, max(seen.values()) / n,
        (ids[1:] == ids[:-1]).mean() if n > 1 else 0, n / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1), pairs / max(n - 1, 1), (lengths <= 3).mean(), (lengths >= 15).mean(),
        sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / max(len(lines), 1))
    return out


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cut, t) in enumerate(zip(self.cuts, self.tables)):
            total += t[np.searchsorted(cut, x[:, j], "right")]
        bins = [np.searchsorted(cut, x[:, j], "right") for j, cut in enumerate(self.pair_cuts)]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            total += t[bins[a], bins[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Boundaries between quantiles, halfway between neighbouring values."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    return (values[1:] + values[:-1]) / 2


def _gain(g, h):
    return g * g / (h + SHRINK)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a tree of ``leaves`` runs of bins: the split of the
    largest gain first, from sums of gradients and curvatures per bin."""
    runs = [(0, len(g))]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for k, (a, b) in enumerate(runs):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = (_gain(cg[m] - cg[a], ch[m] - ch[a]) + _gain(cg[b] - cg[m], ch[b] - ch[m])
                    - _gain(cg[b] - cg[a], ch[b] - ch[a]))
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (k, int(m[i])))
        if best[1] is None:
            break
        k, m = best[1]
        a, b = runs.pop(k)
        runs += [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values per cell of the best single cut of each axis (four leaves), and
    what it gains."""
    cg, ch = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    a, b = np.meshgrid(np.arange(1, g.shape[0] + 1), np.arange(1, g.shape[1] + 1), indexing="ij")
    def parts(c):
        ll, l_, _l, all_ = c[a, b], c[a, -1], c[-1, b], c[-1, -1]
        return ll, l_ - ll, _l - ll, all_ - l_ - _l + ll
    gains = sum(_gain(x, y) for x, y in zip(parts(cg), parts(ch)))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.empty_like(g, dtype=float)
    quarters = [x[i, j] for x in parts(cg)], [x[i, j] for x in parts(ch)]
    values = [x / (y + SHRINK) for x, y in zip(*quarters)]
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = values
    return out, float(gains[i, j] - _gain(g.sum(), h.sum()))


def fit_tables(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Boost the lookup tables on feature rows; deterministic."""
    share = float((weight * y).sum() / weight.sum())
    base = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), base)

    def wrong():
        p = 1 / (1 + np.exp(-total))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = wrong()
            tree = _shallow_tree(np.bincount(b, g, len(tables[j])), np.bincount(b, h, len(tables[j])), LEAVES)
            tables[j] += STEP * tree
            total += STEP * tree[b]
    pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    pair_bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(pair_cuts)]
    shape = lambda a, b: (len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)

    def cells(a, b, v):
        s = shape(a, b)
        return np.bincount(pair_bins[a] * s[1] + pair_bins[b], v, s[0] * s[1]).reshape(s)

    g, h = wrong()
    all_pairs = [(a, b) for a in range(x.shape[1]) for b in range(a)]
    gains = [_pair_tree(cells(a, b, g), cells(a, b, h))[1] for a, b in all_pairs]
    pairs = [all_pairs[i] for i in np.argsort(gains, kind="stable")[::-1][:PAIRS]]
    pair_tables = [np.zeros(shape(a, b)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in zip(pairs, pair_tables):
            g, h = wrong()
            tree, _ = _pair_tree(cells(a, b, g), cells(a, b, h))
            t += STEP * tree
            total += STEP * tree[pair_bins[a], pair_bins[b]]
    return Model(base, cuts, tables, pairs, pair_cuts, pair_tables)


def _features():
    def run(batches):
        for batch in batches:
            rows = [text_features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])
    return run


def fit(docs: DataFrame, labels: DataFrame, rows: dict[int, int] | None = None) -> Model:
    """Learn from at most ``rows`` labelled documents of each kind, none held
    out; only their features come to the driver."""
    found, counts = sample(docs, labels, "quality", rows or SAMPLE_ROWS)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    got = [] if not (n0 and n1) else found.select("y", "text").mapInArrow(_features(), "y int, x array<double>").collect()
    y = np.array([r["y"] for r in got])
    if len(set(y.tolist())) < 2:
        prior = (n1 + 0.5) / (n0 + n1 + 1)
        return Model(float(np.log(prior / (1 - prior))), [], [], [], [], [])
    x = np.array([r["x"] for r in got])
    # Rows are weighted back to the shares of the labels.
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    seen = np.bincount(y, minlength=2)
    return fit_tables(x, y, np.array([n0, n1])[y] / seen[y] * len(y) / (n0 + n1))


def _score(sent):
    def run(batches):
        model = pickle.loads(sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                x = np.array([text_features(t) for t in texts]).reshape(len(texts), len(FEATURE_NAMES))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])
    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score)`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows = docs.select("doc_id", "text")
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double"
    return rows.mapInArrow(_score(sent), kinds).select("doc_id", held_out().alias("held_out"), "score")
