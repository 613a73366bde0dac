"""Line dedup: templates, thresholds and edge rows."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from hirescope.llm import lines

LONG = " ".join(f"word{chr(97 + i % 26)}" for i in range(20))


def run(spark, rows, schema="doc_id long, text string"):
    return lines.without_recurring_lines(spark.createDataFrame(rows, schema)).collect()


def test_long_lines_need_two_documents_and_the_first_keeps_its_own(spark):
    out = {r["doc_id"]: r["text"] for r in run(spark, [(3, f"three\n{LONG}"), (1, f"{LONG}\none"), (2, "two\n\nend")])}
    assert out == {3: "three", 1: f"{LONG}\none", 2: "two\n\nend"}


def test_short_lines_need_more_documents(spark):
    few = [(i, f"own {i} text here\nAll rights reserved.") for i in range(lines.SHORT_DOCS - 1)]
    assert all("All rights" in r["text"] for r in run(spark, [(i, t.replace("own", chr(97 + i) * 3)) for i, t in few]))
    more = [(i, f"{chr(97 + i) * 4} own\nAll rights reserved.") for i in range(lines.SHORT_DOCS)]
    kept = [r["doc_id"] for r in run(spark, more) if "All rights" in r["text"]]
    assert kept == [0]


def test_variable_fields_are_generalised(spark):
    words = LONG.split()
    changed = words[:11] + ["other", "words"] + words[13:]
    lead = ["different"] + words[1:]
    rows = [(1, LONG), (2, " ".join(changed)), (3, " ".join(lead)), (4, f"id 4711 {LONG}"), (5, f"id   x@y.org\t{LONG} ")]
    out = {r["doc_id"]: r["text"] for r in run(spark, rows)}
    assert out[1] == LONG and out[2] == "" and out[3] == rows[2][1]
    assert out[4] == rows[3][1] and out[5] == ""


def test_fields_far_apart_are_generalised(spark):
    notices = []
    for k, (names, towns) in enumerate([(12, 12), (12, 3), (4, 12), (3, 4)]):
        words = [f"set{'abcd'[k]}"] + LONG.split()[1:]  # nodes of their own
        notices += [(100 * k + i, " ".join(words[:5] + [f"name{'abcdefghijkl'[i % names]}"] + words[6:16]
                                           + [f"town{'abcdefghijkl'[i % towns]}"] + words[17:])) for i in range(12)]
    out = {r["doc_id"]: r["text"] for r in run(spark, notices)}
    assert out == {i: "" if i % 100 else t for i, t in notices}


def test_lines_that_share_little_but_their_node_stay(spark):
    words = LONG.split()
    rows = [(i, " ".join(words[:3] + [f"{w}{'xyz'[i]}" for w in words[3:]])) for i in range(3)]
    assert sorted((r["doc_id"], r["text"]) for r in run(spark, rows)) == rows


def test_every_dropped_line_shares_its_template_with_a_kept_one(spark):
    # Chains: of three lines, the first and second agree but for one field, the
    # second and third but for another.
    words = LONG.split()
    put = lambda a, b: " ".join(words[:5] + [a] + words[6:17] + [b] + words[18:])
    rows = []
    for k, texts in enumerate(itertools.permutations([put("p", "s"), put("p", "t"), put("q", "t")])):
        rows += [(10 * k + i, f"set{'abcdef'[k]} {t}") for i, t in enumerate(texts)]
    out = {r["doc_id"]: r["text"] for r in run(spark, rows)}
    assert all(out[i] == t for i, t in rows if i % 10 == 0)
    assert sorted((r["doc_id"], r["text"]) for r in run(spark, rows)) == _brute(rows)


def _brute(rows):
    """The docstring's rule, over lists."""
    def tokens(line):
        return ["<*>" if any(c in "0123456789@" for c in t) else t for t in line.split()]
    held = collections.defaultdict(set)
    for _, text in rows:
        for line in text.split("\n"):
            w = tuple(tokens(line))
            if len(w) >= lines.VARIABLE_TOKENS:
                held[len(w), w[:lines.LEAD_TOKENS]].add(w)

    def template(w):
        same = held.get((len(w), w[:lines.LEAD_TOKENS]), ())
        for share in (len(same) / 2, 0):
            out = []
            for i, t in enumerate(w):
                n = sum(v[i] == t for v in same)
                out.append(t if i < lines.LEAD_TOKENS or n > 1 and n >= share else None)
            if same and 100 * sum(t is not None for t in out) >= lines.CONSTANT_PERCENT * len(w):
                return share, tuple(out)
        return w
    docs = collections.defaultdict(set)
    placed = []
    for doc, text in rows:
        for k, line in enumerate(text.split("\n")):
            w = tuple(tokens(line))
            if len(w) >= lines.MIN_TOKENS:
                docs[template(w)].add(doc)
                placed.append((doc, k, template(w), len(w)))
    gone = {(doc, k) for doc, k, t, n in placed if doc != min(docs[t])
            and len(docs[t]) >= (lines.LONG_DOCS if n >= lines.LONG_TOKENS else lines.SHORT_DOCS)}
    for doc, k, t, n in placed:  # what goes is kept elsewhere
        assert (doc, k) not in gone or any(u == t and (d, j) not in gone for d, j, u, _ in placed)
    return [(doc, "\n".join(line for k, line in enumerate(text.split("\n")) if (doc, k) not in gone)) for doc, text in rows]


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"t{c}" for c in "abcdefghij"]
    bases = [[rng.choice(pool) for _ in range(rng.choice([2, 5, 8, 9, 16, 20]))] for _ in range(10)]

    def line():
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice([*pool, "4711", f"own{'abcdefgh'[rng.randrange(8)]}"])
        return " ".join(w)
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(40)]
    assert sorted((r["doc_id"], r["text"]) for r in run(spark, rows)) == _brute(rows)


def test_lines_that_recur_in_one_document_stay(spark):
    text = "\n".join([LONG] * 5)
    assert [r["text"] for r in run(spark, [(1, text), (2, "else")])][0] == text


def test_edge_rows(spark):
    huge = "x" * 200_000 + "\n" + "y 1 " * 50_000
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, LONG), (4, LONG), (None, LONG), (5, huge), (6, "ab")]
    out = lines.without_recurring_lines(spark.createDataFrame(
        [(*r, "clash", 7) for r in rows], "doc_id long, text string, row_key string, leaf int"))
    assert out.columns == ["doc_id", "text", "row_key", "leaf", "_n_lines", "_n_dropped"]
    got = sorted(((r["doc_id"], r["text"], r["_n_dropped"]) for r in out.collect()), key=str)
    want = [(1, None, 0), (2, "", 0), (3, "\n\n", 0), (4, LONG, 0), (4, LONG, 0), (None, "", 1), (5, huge, 0), (6, "ab", 0)]
    assert got == sorted(want, key=str)
    assert lines.without_recurring_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_columns_come_back_whatever_their_names(spark):
    names = ["row", "row_key", "dropped", "_dropped", "_key", "_gone", "_of", "node", "line", "leaf", "a.b", "_", "c0"]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names)
    rows = [(i, f"{LONG}\nown", *[f"{c} {i}" for c in names]) for i in (1, 2)]
    out = lines.without_recurring_lines(spark.createDataFrame(rows, schema).withColumn("_n_lines", F.lit("old")))
    assert out.columns == ["doc_id", "text", *names, "_n_lines", "_n_dropped"]
    got = sorted(map(tuple, out.collect()))
    assert got == [(*rows[0], 2, 0), (2, "own", *rows[1][2:], 2, 1)]


def test_clean_documents_stay_as_they_are(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rows = [(i, "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(15)))
            for i in range(60)]
    assert sorted((r["doc_id"], r["text"]) for r in run(spark, rows)) == rows


def test_main_path_is_native(spark):
    df = lines.without_recurring_lines(spark.createDataFrame([(1, LONG)], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
