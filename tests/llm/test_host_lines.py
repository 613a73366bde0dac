"""Line frequency per host and the base rules, against brute force."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from hirescope.llm import host_lines as H

SCHEMA = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(text):
    text = text or ""
    w = WORD.findall(text)
    wins = defaultdict(list)
    for i in range(len(w) - 2):
        wins[tuple(w[i:i + 3])].append(i)
    repeated = {i + k for at in wins.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated),
            len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def _norm(line):
    return " ".join(WORD.findall(re.sub("[0-9]+", "0", line.lower())))


def _brute(rows, line_docs, percent, left):
    """{row: (base..., lines removed, words removed, kept, text left)}"""
    docs, held = defaultdict(set), defaultdict(set)
    name = lambda d, t, s: d if d is not None else ("text", s or "", t)
    for d, t, s in rows:
        for line in (t or "").split("\n"):
            if _norm(line):
                docs[s or ""].add(name(d, t, s))
                held[s or "", _norm(line)].add(name(d, t, s))
    frequent = {k for k, v in held.items() if len(v) > line_docs and 100 * len(v) > percent * len(docs[k[0]])}
    out = {}
    for d, t, s in rows:
        b = _base(t)
        lines = (t or "").split("\n")
        gone = [i for i, x in enumerate(lines) if (s or "", _norm(x)) in frequent and _norm(x)]
        words = sum(len(WORD.findall(lines[i])) for i in gone)
        kept = not b[-1] and 100 * (b[0] - words) >= left * b[0]
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t
        out[d, t, s] = (*b, len(gone), words, kept, text)
    return out


def _rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["été", "Ünder", "a\x1cb", " ", "#x|", "<b>", "R&D"]
    own = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for d in range(120):
        host = ["hot", "hot", "b", "c", None][d % 5]
        lines = [own(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 8))]
        if host == "hot":
            lines.insert(rng.randrange(len(lines) + 1), f"Read  more on page {d}\t today" + "!" * (d % 2))
        if d % 7 == 0:
            lines += [lines[0], "", "   "]
        if host == "hot" and d % 3 == 0:  # little but a notice that many documents of the host hold
            lines = [own(10), " ".join(f"Notice{k}" for k in range(70))]
        if d % 9 == 0 and d % 2:
            lines = [f"Read more ON page {k} today" for k in range(15)] + lines[:1]
        rows.append((d, "\n".join(lines), host))
    rows += [(500, None, "hot"), (501, "", "b"), (502, " \n\t\r", None), (503, "word " * 30_000, "c"),
             (None, rows[0][1], "hot"), (None, "only here", "hot"), rows[3], rows[3], (rows[4][0], "other text", "b")]
    return rows


def test_figures_match_brute_force(spark):
    rows = _rows()
    want = _brute(rows, 10, 20, 50)
    # More columns, named like working ones, change nothing.
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in (
        "doc", "row_hash", "host", "given", "w", "ls", "s", "at", "p", "base", "line_no", "gone", "key")])
    got = H.figures(df, line_docs=10, line_percent=20)
    assert got.columns == ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "n_lines_removed", "n_words_removed", "kept"]
    got = sorted((tuple(r) for r in got.drop("host").collect()), key=repr)
    assert got == sorted(((d, *want[d, t, s][:-1]) for d, t, s in rows), key=repr)
    assert any(w[-2] for w in want.values()) and any(not w[-2] and not w[5] for w in want.values())

    left = H.without_host_lines(df, line_docs=10, line_percent=20).collect()
    assert sorted(((r.doc_id, r.host, r.text) for r in left), key=repr) == sorted(
        ((d, s or "", want[d, t, s][-1]) for d, t, s in rows if want[d, t, s][-2]), key=repr)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert H.figures(none).count() == 0 and H.without_host_lines(none).count() == 0


def test_no_python_and_no_text_is_shuffled(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    plan = H.figures(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text" not in plan
