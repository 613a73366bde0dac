"""Near-duplicate texts against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from hirescope.llm import minhash


def brute(rows, words=5, numerator=75, denominator=100):
    """Component and set size of each (doc_id, text), by comparing all pairs."""
    def shingles(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        if not w:
            return frozenset()
        return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1)))
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and denominator * both >= numerator * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    low = {}
    for (d, _), x in zip(rows, label):
        low[x] = min(d, low.get(x, d))
    return {(d, len(s), low[x], d == low[x]) for (d, _), s, x in zip(rows, sets, label)}


def family(rng, vocabulary, n, copies, edits):
    base = [rng.choice(vocabulary) for _ in range(n)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(n)] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_families_match_brute_force(spark, block):
    rng = random.Random(block)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for copies, edits in [(30, 4), (12, 9), (1, 1), (2, 2), (5, 30), (40, 0)]:
        texts += family(rng, vocabulary, rng.randint(60, 300), copies, edits)
    # Unrelated texts that share a long passage, and chains of small steps.
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(40, 200))) for _ in range(40)]
    chain = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(12):
        chain[rng.randrange(120)] = rng.choice(vocabulary)
        chain[rng.randrange(120)] = rng.choice(vocabulary)
        texts.append(" ".join(chain))
    texts += ["one two three", "ONE two\tthree", "one two three four", "É é", "é É", "a b c d e", "A B C D E"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in minhash.near_duplicates(df, block=block).select(
        "doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == brute(rows)


def test_edge_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "same words here again now"), (4, "same words here again now"),
            (5, "SAME words here again now"), (None, "same words here again now"), (None, None), (6, long), (7, long + " end"),
            (8, "other a b c d"), (8, "quite different text under one id")]
    df = spark.createDataFrame([(*r, "clash", 0, b"x") for r in rows],
                               "doc_id long, text string, class string, n int, signature binary")
    out = minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert len(out) == len(rows)
    got = sorted((tuple(r) for r in out), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False),
            (None, 1, None, True), (None, 0, None, True), (6, 29_996, 6, True), (7, 29_997, 6, False),
            (8, 1, 8, True), (8, 2, 8, True)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_spanning_links_join_what_all_links_join():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 25, rng.integers(1, 20)).astype(np.uint64)) for _ in range(25)]
        def closure(pairs):
            label = np.arange(len(sets))
            for _ in sets:
                for a, b in pairs:
                    label[a] = label[b] = min(label[a], label[b])
            return label.tolist()
        every = [(i, j) for i in range(25) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j]))
                 >= 75 * len(np.union1d(sets[i], sets[j]))]
        assert closure(minhash.spanning_links(sets, 75, 100)) == closure(every)
