"""The pipeline: every stage against what its operator decides, edge rows."""

import pytest

import corpus_pipeline as cp
from hirescope.llm import lines, minhash, toxicity
from hirescope.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def test_stages_and_columns(outputs):
    assert [name for name, _ in cp.STAGES] == ["toxicity", "line dedup", "near-dedup", "mixing", "encoding"]
    for df in outputs[1:-1]:
        assert df.columns == outputs[0].columns
    assert outputs[-1].columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_each_stage_works_on_all_that_was_kept(spark, outputs):
    docs, clean, deduped, single, mixed, encoded = outputs
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.scored(docs, model).collect() if r["score"] >= toxicity.THRESHOLD}
    assert _rows(clean) == _rows(docs.where(~docs.doc_id.isin(list(toxic) or [-1])))
    left = {r["doc_id"]: r["text"] for r in lines.without_recurring_lines(clean).collect()}
    got = {r["doc_id"]: r["text"] for r in deduped.collect()}
    assert got == {i: t for i, t in left.items() if t.strip() or t == dict(clean.select("doc_id", "text").collect())[i]}
    assert all(r["n_chars"] == len(r["text"]) for r in deduped.collect())
    kept = {r["doc_id"] for r in minhash.near_duplicates(deduped).collect() if r["kept"]}
    assert _rows(single) == [r for r in _rows(deduped) if r[0] in kept]
    assert _rows(mixed) == _rows(single)
    import hashlib
    texts = dict(mixed.select("doc_id", "text").collect())
    out = encoded.collect()
    assert {r["doc_id"] for r in out} == set(texts) and len(out) == len(texts)
    for r in out:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"])


def test_run_equals_the_stages(spark, outputs):
    got = {r["doc_id"]: r["decoded_sha256"] for r in cp.run(spark, SF).collect()}
    assert got == {r["doc_id"]: r["decoded_sha256"] for r in outputs[-1].collect()}


def test_run_carries_the_order_of_the_mixing_stage(spark, monkeypatch):
    monkeypatch.setattr(cp, "STAGES", cp.STAGES[3:])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = cp.mixing.mixed(docs).select("doc_id", "_slot", "_place").collect()
    want = [r["doc_id"] for r in sorted(placed, key=lambda r: (r["_slot"], r["_place"]))]
    got = cp.run(spark, SF).select("doc_id", "position").collect()
    assert len({r["position"] for r in got}) == len(got)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["position"])] == want


def test_stages_keep_the_values_of_other_columns(spark):
    names = ["_key", "_dropped", "_n_dropped", "_n_lines", "_slot", "_place", "_k", "_is", "row", "row_key", "component_id", "kept", "score"]
    docs = spark.createDataFrame([(i, f"text of its own {chr(97 + i) * 3}", "s", *[f"{c} {i}" for c in names]) for i in range(4)],
                                 "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    for name, stage in cp.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert _rows(out) == _rows(docs), name


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, class int"


def test_edge_rows_pass_every_stage(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long + " more"), (None, long + " other tail"), (5, "x" * 200_000), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None if k % 2 else "s", None, "clash", 3) for k, (i, t) in enumerate(rows)], SCHEMA)
    for empty in (True, False):
        df = docs.limit(0) if empty else docs
        for name, stage in cp.STAGES:
            out = stored(stage(spark, df, SF), "edge")
            if name != "encoding":
                assert out.columns == docs.columns, name
                df = out
            if empty:
                assert out.count() == 0, name
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(3) == 1 and 4 not in ids and {1, 2, 5} <= set(ids) and ids.count(None) == 2
