"""Fill-in-middle against a plain reading of its rules."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from hirescope.llm import fill_middle as M

SCHEMA = "doc_id long, text string"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def _brute(doc_id, text):
    text = text or ""
    u = UNIT.findall(text)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(h[k:k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, len(u), "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def _rows():
    rng = random.Random(3)
    bits = ["def", " ", "\n", "x1", "été", "漢字", "😀", "<", ">", "P", "<S", "zz.zz", "\x00", "Ä"]
    rows = [(d, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for d in range(150)]
    rows += [(200, None), (201, ""), (202, "a <P> b"), (203, "<M>"), (None, "no id here"), (None, "other, no id"),
             (204, "one"), (205, "ab " * 40_000), (206, "q" * 600_000 + " é" * 300_000), (1, rows[1][1]), (1, rows[1][1]), (2, "same id")]
    return rows


def test_matches_the_rules(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).select(
        "*", *[F.lit("x").alias(c) for c in ("digest", "at", "n", "form", "piece", "part", "copies")])
    sorted_pieces = M.assembled(df)
    got = M.digests(sorted_pieces)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [_brute(*r) for r in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*w[:5], sha(w[5]), sha(w[6])) for w in want), key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    whole = {(r.doc_id, r.form, r.output) for r in M.outputs(sorted_pieces).collect()}
    assert whole == {(w[0], w[2], w[5]) for w in want}


def test_units_across_windows(monkeypatch):
    monkeypatch.setattr(M, "WINDOW_CHARS", 5)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab.é ") for _ in range(rng.randrange(40)))
        at = [x.start() for x in UNIT.finditer(text)]
        units = M.Units(text)
        assert units.n == len(at) and [units.offset(k) for k in range(len(at) + 1)] == [*at, len(text)]


def test_small_pieces(spark, monkeypatch):
    """Pieces of many documents, a few units each, come back in order."""
    text = "".join(f"w{chr(97 + k % 26)} " for k in range(300))
    monkeypatch.setattr(M, "PIECE_UNITS", 7)
    for doc_id in range(20):
        found = list(M.pieces(doc_id, text))
        assert [f[0] for f in found] == list(range(len(found)))
        assert "".join(f[-1] for f in found) == _brute(doc_id, text)[5]


def test_one_exchange_and_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.digests(M.assembled(none)).count() == 0
    plan = M.digests(M.assembled(none))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
