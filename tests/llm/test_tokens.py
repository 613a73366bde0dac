"""Encoding, decoding and counting against the libraries, on whole texts."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from hirescope.llm import bpe, token_counts
from hirescope.llm import queries as Q

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TRICKY = [
    None, "", " ", "\n\n\n", "a", "'", "''re 's 'll'd", "x  \n\n  y   ", "don't we'll it's", "日本語 テキスト ١٢٣ ½ Ⅷ",
    "é z​    tab\t\tend ", "<|endoftext|> and <|endoftext|><|endoftext|>", "👩‍👩‍👧 emoji 🇫🇷", "a" * 700,
    " " * 600 + "b", "1234567890" * 70, "!?" * 400, ("word's " * 90) + "\n" * 50 + "x", "'r" * 300 + "e" * 100, "\0 a\0 1",
]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", 0) for i, t in enumerate(texts)],
                                 "doc_id long, text string, ids string, chunk string, key int")


@pytest.mark.parametrize("chunk,overlap", [(32, 8), (100, 30), (1000, 64), (bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS)])
def test_encode_matches_library_whatever_the_chunk(spark, library, chunk, overlap):
    texts = TRICKY + [" ".join(t or "" for t in TRICKY), "z" * 50 + " " + "y  " * 200]
    out = bpe.decode(bpe.encode(docs_of(spark, texts), bpe.read_ranks(RANKS), public_tokenizers.PATTERN, chunk, overlap),
                     bpe.read_ranks(RANKS)).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_repeated_rows_null_ids_and_empty_table(spark, library):
    long = "ab cd's " * 40
    rows = [(1, long), (1, long), (1, "other"), (None, long), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = bpe.read_ranks(RANKS)
    out = bpe.encode(df, ranks, public_tokenizers.PATTERN, 50, 12)
    got = sorted((r["doc_id"] or 0, len(r["ids"])) for r in out.collect())
    assert got == sorted((i or 0, len(library.encode_ordinary(t or ""))) for i, t in rows)
    assert bpe.decode(bpe.encode(df.limit(0), ranks, public_tokenizers.PATTERN), ranks).count() == 0


@pytest.mark.parametrize("hot", [0, 7, token_counts.HOT_PIECES])
def test_counts_match_library(spark, hot):
    t = Tokenizer.from_file(JSON)
    texts = TRICKY + ["same text twice"] * 3
    df = docs_of(spark, texts).union(docs_of(spark, ["same text twice"]).selectExpr("21L", "text", "ids", "chunk", "key"))
    out = token_counts.token_counts(df, token_counts.read_tokenizer(JSON), public_tokenizers.PATTERN, hot_pieces=hot)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted(map(tuple, out.collect()))
    want = []
    for r in df.collect():
        n = len(t.encode(r["text"] or "", add_special_tokens=False))
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 512))
    assert got == sorted(want)
    assert token_counts.token_counts(df.limit(0), token_counts.read_tokenizer(JSON),
                                     public_tokenizers.PATTERN).count() == 0


def test_queries_over_whole_table(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in Q.op4_byte_bpe(spark, SF).collect():
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    t = Tokenizer.from_file(JSON)
    out = Q.op8_token_counts(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r["n_tokens"] == len(t.encode(docs[r["doc_id"]], add_special_tokens=False))
