"""Mixing: deviation under one block, whole results, edge rows."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from hirescope.llm import mixing


def test_one_period_deviates_by_less_than_a_block():
    rng = random.Random(5)
    for _ in range(30):
        weights = {f"s{i}": rng.random() ** 3 + 1e-3 for i in range(rng.randint(1, 40))}
        blocks = mixing.shares(weights, 500)
        assert sum(blocks.values()) == 500 and min(blocks.values()) >= 1
        slots = mixing.one_period(blocks, 500)
        assert [s for _, _, s in slots] == list(range(500))
        run = dict.fromkeys(weights, 0)
        for source, i, slot in slots:
            assert i == run[source]
            # Released, and in time for its deadline.
            assert i * 500 // blocks[source] <= slot < -(-(i + 1) * 500 // blocks[source])
            run[source] += 1
            for s in run:
                assert abs(run[s] - Fraction(blocks[s], 500) * (slot + 1)) < 1


def brute(n, blocks, period, block_docs):
    """Blocks in order of slots, by running period after period."""
    slots = mixing.one_period(blocks, period)
    left = {s: -(-k // block_docs) for s, k in n.items()}
    done, out, base = dict.fromkeys(n, 0), {}, 0
    while any(done[s] < left[s] for s in n):
        for s, _, slot in slots:
            if done[s] < left[s]:
                out[s, done[s]] = base + slot
                done[s] += 1
        base += period
    return out


def test_documents_take_the_slots_of_their_blocks(spark):
    n = {"a": 500, "b": 130, "c": 7, None: 33}
    rows = [(i * 10 + k, f"text {i}", s, 1) for k, (s, size) in enumerate(n.items()) for i in range(size)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _x int")
    out = mixing.mixed(df, {"a": 5, "b": 3, "c": 0}, block_docs=4, period=60)
    assert out.columns == ["doc_id", "text", "source", "_x", "_slot", "_place", "_on_target"]
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    blocks = mixing.shares({"a": 5, "b": 3, "c": 0, None: 0}, 60)
    want = brute(n, blocks, 60, 4)
    slots = {}
    for r in got:
        slots.setdefault(r["source"], {}).setdefault(r["_slot"], []).append(r["_place"])
    for s, k in n.items():
        assert sorted(slots[s]) == sorted(slot for (x, _), slot in want.items() if x == s)
        sizes = [len(slots[s][slot]) for slot in sorted(slots[s])]
        assert sizes == [4] * (k // 4) + ([k % 4] if k % 4 else [])
    # On target up to the first slot that is not full.
    full = {r["_slot"] for r in got if r["_place"] == 3}
    first = min(set(range(max(full) + 2)) - full)
    assert {r["_slot"] for r in got if r["_on_target"]} == set(range(first))


def test_the_order_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}", f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    a = sorted(map(tuple, mixing.mixed(df.repartition(5)).collect()))
    assert a == sorted(map(tuple, mixing.mixed(df.repartition(2, "text")).collect()))


def test_edge_rows(spark):
    schema = "doc_id long, text string, source string"
    rows = [(1, None, "a"), (1, None, "a"), (None, "", "a"), (2, "x" * 100_000, None), (None, None, None)]
    out = mixing.mixed(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in out), key=str) == sorted(rows, key=str)
    assert len({(r["_slot"], r["_place"]) for r in out}) == len(rows)
    empty = mixing.mixed(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns[-3:] == ["_slot", "_place", "_on_target"]
    assert mixing.mixed(spark.createDataFrame(rows, schema), {"other": 1}).count() == 5
    for bad in ({"a": -1.0}, {"a": 0.0, None: 0.0}, {"a": float("nan")}):
        with pytest.raises(ValueError, match="weights"):
            mixing.mixed(spark.createDataFrame(rows, schema), bad)
    with pytest.raises(ValueError, match="sources"):
        mixing.mixed(spark.createDataFrame([(i, "", f"s{i}") for i in range(12)], schema), period=10)


def _weights(kind, rng):
    if kind == "twenty":
        return [1 / 3] + [2 / 57] * 19
    if kind == "many":
        return [(i + 1) ** -0.5 for i in range(900)]
    return [rng.random() ** 3 + 1e-3 for _ in range(rng.randint(1, 25))]


def ideal(rates, blocks):
    """Blocks through in all, and of each source, at each boundary of the ideal
    run: sources side by side, until each has no block left."""
    def at(time):
        each = [min(a * time, b) for a, b in zip(rates, blocks)]
        return sum(each), each
    return at


def windows(rates, blocks):
    at = ideal(rates, blocks)
    return [(-(-at(Fraction(j, a))[0] // 1), s, j, at(Fraction(j - 1, a))[0] // 1)
            for s, (a, b) in enumerate(zip(rates, blocks)) for j in range(1, b + 1)]


def reached(rates, blocks, slot):
    """What each source has of the first ``slot`` blocks in the ideal run."""
    at, done, left = ideal(rates, blocks), Fraction(0), set(range(len(rates)))
    for time in sorted({Fraction(b, a) for a, b in zip(rates, blocks)}):
        total, each = at(time)
        if total >= slot:
            return [each[s] - (total - slot) * Fraction(rates[s], sum(rates[x] for x in left)) if s in left else each[s]
                    for s in range(len(rates))]
        left -= {s for s in left if each[s] == blocks[s]}
    return blocks


@pytest.mark.parametrize("kind", ["twenty", "many", *range(12)])
def test_segments_keep_to_the_weights_given_to_the_last_block(kind):
    rng = random.Random(str(kind))
    weights = _weights(kind, rng)[:60]
    rates = [max(1, int(Fraction(w) / sum(map(Fraction, weights)) * 2**60)) for w in weights]
    # Sources end at any time, some at their first block.
    blocks = [rng.choice([1, rng.randint(1, 9), int(20 * w / max(weights)) + 1]) for w in weights]
    jobs = windows(rates, blocks)
    stop, longest = len(jobs), max(j[0] - j[3] for j in jobs)
    slots = max(1, longest)
    ended = {cut: sum(j[0] <= cut for j in jobs) for cut in range(0, stop + slots, slots)} | {stop: stop}
    out = [x for k in range(-(-stop // slots))
           for x in mixing.segment([j for j in jobs if j[3] < (k + 1) * slots and j[0] > k * slots - longest],
                                   k, slots, stop, ended, longest)]
    assert [slot for _, slot in out] == list(range(stop)) and sorted(j for j, _ in out) == sorted(jobs)
    run = [0] * len(rates)
    for (deadline, s, block, release), slot in out:
        assert block == run[s] + 1 and release <= slot < deadline
        run[s] += 1
        assert all(abs(r - x) < 1 for r, x in zip(run, reached(rates, blocks, slot + 1)))


def test_times_of_boundaries_sort_like_fractions():
    rng = random.Random(3)
    pairs = [(rng.randint(1, 2**40), rng.randint(1, 2**60)) for _ in range(300)] + [(3, 2**60), (3, 2**60 - 1), (6, 2**60), (3, 2**59)]
    assert sorted(pairs, key=lambda p: (mixing.boundary_time(*p), p)) == sorted(pairs, key=lambda p: (Fraction(*p), p))


@pytest.mark.parametrize("slots", [7, 20_000])
def test_short_sources_and_what_follows_them_keep_to_the_weights(spark, monkeypatch, slots):
    monkeypatch.setattr(mixing, "SEGMENT_SLOTS", slots)
    monkeypatch.setattr(mixing, "CHUNK_BLOCKS", 13)
    n = {"a": 700, "b": 700, "c": 350, "one": 1, "two": 2, None: 40, "none": 9}
    weights = {"a": 4, "b": 2, "c": 1, "one": 1, "two": 3, None: 2}
    rows = [(k * 1000 + i, "", s) for k, (s, size) in enumerate(n.items()) for i in range(size)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, block_docs=3).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    places = {(r["_slot"], r["_place"]) for r in got}
    assert len(places) == len(rows)
    names, total = list(weights), sum(weights.values())
    blocks = [-(-n[s] // 3) for s in names]
    by_slot = {}
    for r in got:
        by_slot.setdefault(r["_slot"], set()).add(r["source"])
        assert r["_on_target"] == (r["source"] != "none")
    assert sorted(by_slot) == list(range(sum(blocks) + 3)) and all(len(x) == 1 for x in by_slot.values())
    run = dict.fromkeys(names, 0)
    rates = [Fraction(weights[s], total) for s in names]
    for slot in range(sum(blocks)):
        run[by_slot[slot].pop()] += 1
        assert all(abs(run[s] - x) < 1 for s, x in zip(names, reached(rates, blocks, slot + 1)))


def test_a_source_of_one_document_leaves_the_others_on_target(spark):
    rows = [(i, "", f"s{i % 3}") for i in range(30_000)] + [(30_000, "", "single")]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert len(got) == 30_001 and all(r["_on_target"] for r in got)
    order = sorted((r["_slot"], r["source"]) for r in got if r["_place"] == 0)
    run = dict.fromkeys(("s0", "s1", "s2", "single"), 0)
    for _, source in order:
        run[source] += 1
        assert max(run[s] for s in ("s0", "s1", "s2")) - min(run[s] for s in ("s0", "s1", "s2")) < 2


def test_deviation_from_the_weights_given_does_not_grow(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SEGMENT_SLOTS", 100)
    n = {"large": 4000} | {f"s{i:02}": 420 for i in range(19)}
    rows = [(k * 10_000 + i, "", s) for k, (s, size) in enumerate(n.items()) for i in range(size)]
    weights = dict.fromkeys(n, Fraction(2, 57)) | {"large": Fraction(1, 3)}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(df, weights, block_docs=1).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    assert sorted(r["_slot"] for r in got) == list(range(len(rows)))
    order = sorted((r["_slot"], r["source"], r["_on_target"]) for r in got)
    run = dict.fromkeys(n, 0)
    for slot, source, on_target in order:
        run[source] += 1
        assert on_target
        # Until the first sources run out; then by what the weights give the others.
        if slot < 11_900:
            assert all(abs(run[s] - w * (slot + 1)) < 1 for s, w in weights.items())
        else:
            want = reached(list(weights.values()), list(n.values()), slot + 1)
            assert all(abs(run[s] - x) < 1 for s, x in zip(weights, want))


def test_more_sources_than_a_thousand_and_sources_of_weight_zero(spark):
    rows = [(i, "", f"s{i % 1500}") for i in range(4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(df, block_docs=2).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(4500))
    assert sorted({r["_slot"] for r in got}) == list(range(3000))
    got = mixing.mixed(df, {"s0": 2, "s1": 1, "s2": 0}).collect()
    last = max(r["_slot"] for r in got if r["source"] in ("s0", "s1"))
    assert len(got) == 4500 and all(r["_slot"] > last for r in got if r["source"] not in ("s0", "s1"))


def test_other_columns_come_back_whatever_their_names(spark):
    names = ["_s", "_k", "_parts", "_h", "_part", "_n", "_offset", "_rank", "_slots", "_first", "_block", "_i", "_at", "_blocks", "row"]
    rows = [(i, "", f"s{i % 2}", *[f"{c} {i}" for c in names]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    for period in (None, 4):
        out = mixing.mixed(df.withColumn("_slot", F.lit("old")), block_docs=2, period=period)
        assert out.columns == ["doc_id", "text", "source", *names, "_slot", "_place", "_on_target"]
        assert sorted(tuple(r)[:-3] for r in out.collect()) == rows
