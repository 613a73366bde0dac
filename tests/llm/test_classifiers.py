"""Toxicity and quality: matching, context, held-out accuracy, edge rows."""

import random
import zlib

import numpy as np
import pytest

from hirescope.llm import labels as L
from hirescope.llm import quality, toxicity
from hirescope.llm import queries as Q

SF = "/root/testdata/sf0.1"


def edits(a, b):
    """Letters more, less, other, or neighbours swapped; a digit or sign that looks
    like the letter of ``b`` costs nothing."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1] or b[j - 1] in toxicity.ALIKE.get(a[i - 1], "")
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (not same))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def brute_match(word, entries):
    """``(entry, edits)`` by comparing a word with every entry."""
    near = []
    for k, (e, is_stem) in enumerate(entries):
        if is_stem or 2 * sum(c.isalpha() for c in word) < len(word):
            continue
        n = edits(word, e)
        first = e[0] == word[0] or e[0] in toxicity.ALIKE.get(word[0], "")
        if n == 0 or n == 1 and min(len(e), len(word)) >= (5 if first else 6):
            near.append((n, k))
    if near and min(near)[0] == 0:
        return min(near)[1], 0
    stems = [k for k, (e, is_stem) in enumerate(entries) if is_stem and word.isalpha() and word.startswith(e)]
    if stems:
        return max(stems, key=lambda k: len(entries[k][0])), 0
    return min(near)[::-1] if near else (-1, 0)


def test_automaton_finds_what_the_edit_distance_says():
    rng = random.Random(2)
    lexicon = list({"".join(rng.choice("abotc") for _ in range(rng.randint(3, 8))) for _ in range(60)})
    stems = list({"".join(rng.choice("ef") for _ in range(4)) for _ in range(5)})
    entries = [(w, False) for w in lexicon] + [(s, True) for s in stems]
    m = toxicity.Matcher(entries)
    found = 0
    for _ in range(4000):
        word = "".join(rng.choice("abotcef01@7") for _ in range(rng.randint(1, 9)))
        if rng.random() < 0.7:
            word = rng.choice(lexicon + stems)
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1:], word[:at] + "z" + word[at:], word[:at] + "4" + word[at + 1:],
                               word[:at] + word[at + 1:at + 2] + word[at] + word[at + 2:], word.replace("a", "@").replace("o", "0")])
        if word:
            assert m.match(word) == brute_match(word, entries), word
            found += m.match(word)[0] >= 0
    assert found > 1000


def test_quotation_and_report_weigh_less_and_misspelling_counts():
    entries = [("idiot", False), ("scum", False), ("moronic", False)]
    hits, weights = toxicity._Hits(toxicity.Matcher(entries)), np.array([5.0, 5.0, 5.0])
    plain, n, _ = toxicity.document_features("you idiot and scum", hits, weights)
    quoted, m, _ = toxicity.document_features('you "idiot and scum"', hits, weights)
    reported, k, _ = toxicity.document_features("they said you idiot and scum", hits, weights)
    assert n == m == k == 2
    assert plain[0] > quoted[0] and plain[1] > quoted[1] and plain[0] > reported[0]
    # A swap, a letter more or less, look-alikes and a sign for a letter count;
    # a short word must have its letters, a first letter may be wrong in a long one.
    misspelt, exact, wrong = toxicity.document_features("you idoit idiiot idot scumm scu 1d1ot id*ot $cum loronic ldiot", hits, weights)
    assert (exact, wrong) == (0, 5)
    right, exact, _ = toxicity.document_features("you idiot idiot zzz zzz zzz idiot idiot zzz moronic zzz", hits, weights)
    assert exact == 5 and (0.8 * right < misspelt).all() and (misspelt <= right).all() and misspelt[0] < right[0]
    assert not toxicity.document_features("ordinary words, 2024 units at 5$ a@b.c", hits, weights)[0].any()


@pytest.fixture(scope="module")
def fitted(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    return toxicity.fit(read("documents"), read("labels"))


def test_misspelt_terms_alone_reach_the_threshold(fitted):
    hits = toxicity._Hits(toxicity.Matcher(fitted.entries))
    best = [(w, e) for w, (e, is_stem) in zip(fitted.weights, fitted.entries) if not is_stem and len(e) >= 6 and e.isascii()]
    terms = [e for _, e in sorted(best, reverse=True)[:8]]
    assert len(terms) >= 3
    look = str.maketrans({"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "t": "7"})
    forms = {"less": [t[:3] + t[4:] for t in terms], "swap": [t[:2] + t[3] + t[2] + t[4:] for t in terms],
             "alike": [t[0] + t[1:].translate(look) for t in terms]}
    filler = "there was nothing much to be seen along the road that day "
    score = lambda texts: toxicity._scores(fitted, hits, texts)[0]
    for name, words in forms.items():
        words = [w for w, t in zip(words, terms) if w != t and brute_match(w, fitted.entries)[0] >= 0]
        assert words, name
        said, = score([filler + f" {filler} ".join(words)])
        cited, = score([filler + f" {filler} ".join(f'"{w}"' for w in words)])
        assert said >= toxicity.THRESHOLD and cited < said, (name, words, said, cited)
    assert score([filler * 20])[0] < 0.1


def test_scores_agree_with_a_plain_reading(spark, fitted):
    """Every word of 200 documents compared with every entry."""
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(200).collect()]
    known = {}

    class Plain(dict):
        def __missing__(self, word):
            if word not in known:
                entry, n = brute_match(word, fitted.entries)
                known[word] = -1 if entry < 0 else 2 * entry + (n > 0 or not word.isalpha())
            return known[word]
    docs = [d if d is None else d[:2000] for d in docs]
    hits = toxicity._Hits(toxicity.Matcher(fitted.entries))
    assert np.array_equal(toxicity._scores(fitted, hits, docs)[0], toxicity._scores(fitted, Plain(), docs)[0])


def test_held_out_rows_by_crc32(spark):
    ids = [*range(300), None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("h", L.held_out()).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def _auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable")) + 1.0
    for v in np.unique(s):
        order[s == v] = order[s == v].mean()
    n1 = (y == 1).sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.93), ("op5_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    out = {r["doc_id"]: r for r in Q.queries()[name](spark, SF).collect()}
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    known = [(r[label], out[r["doc_id"]]["score"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()
             if r["doc_id"] in out and out[r["doc_id"]]["held_out"]]
    y, s = np.array([k[0] for k in known]), np.array([k[1] for k in known])
    assert _auc(y, s) >= least
    limit = toxicity.THRESHOLD if label == "toxic" else quality.THRESHOLD
    assert all(r["predicted"] == int(r["score"] >= limit) and 0 <= r["score"] <= 1 for r in out.values())
    # Clean documents are left alone.
    if label == "toxic":
        assert (s[y == 0] >= limit).mean() < 0.005


DOCS = "doc_id long, text string, score string, y int, sketch int"
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 60_000), (4, "word " * 60_000), (None, "some text"), (5, "x" * 300_000)]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edge_rows_and_missing_labels(spark, module):
    label = "toxic" if module is toxicity else "quality"
    docs = spark.createDataFrame([(*r, "clash", 9, 9) for r in EDGE], DOCS)
    kinds = f"doc_id long, {label} int, text string"
    for rows in ([], [(1, 1, "")], [(1, None, ""), (None, 1, ""), (2, 7, "")], [(i, i % 2, "clash") for i in (0, 2, 3, 4, 5, 1, 1)]):
        model = module.fit(docs, spark.createDataFrame(rows, kinds))
        out = module.scored(docs, model).collect()
        assert len(out) == len(EDGE)
        assert all(0 <= r["score"] <= 1 for r in out)
        assert len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert module.scored(docs.limit(0), model).count() == 0
    if module is toxicity:
        kept = toxicity.without_toxic(docs, model)
        assert kept.columns == docs.columns and kept.count() == len(EDGE)


def test_sample_is_bounded_and_never_held_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, q int")
    found, counts = L.sample(docs, labels, "q", {0: 20, 1: 30})
    rows = found.collect()
    assert sum(r["y"] == 0 for r in rows) == 20 and sum(r["y"] == 1 for r in rows) == 30
    assert not any(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert sum(counts.values()) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(400))


def test_tables_learn_single_features_and_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(int)  # no single feature tells
    model = quality.fit_tables(x, y, np.ones(len(y)))
    assert (1, 0) in model.pairs
    z = rng.random((2000, 4))
    right = (model.score(z) >= 0.5) == ((z[:, 0] > 0.6) ^ (z[:, 1] > 0.5))
    assert right.mean() > 0.9
