import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from qcorpus.llm import byte_bpe as B
from qcorpus.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.fixtures import docs, no_docs

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixed(rng, n):
    """Text full of places where a cut could change matches."""
    parts = ["we'll ", "they've", "'re", " \n", "\n\n  x", "   ", "\t\r\n ", "don't", "123 456", "…", "クジラ", "é", "🐋🐋", "a" * 40,
             " " * 30, "!?!", "'", "'l", "Straße ", "٣٤٥", "　", "<|endoftext|>", "x y z "]
    return "".join(rng.choice(parts) for _ in range(n))


def encoded(df, **options):
    return {r["doc_id"]: (r["token_ids"], r["n_tokens"], bytes(r["decoded"]), r["text"])
            for r in B.decode_ids(B.encode_texts(df, RANKS, PATTERN, **options), RANKS, PATTERN).collect()}


def held(out, lib):
    for ids, n, decoded, text in out.values():
        assert ids == lib.encode_ordinary(text or "") and n == len(ids) and decoded == (text or "").encode()


@pytest.mark.parametrize("chunk,overlap", [(33, 33), (64, 40), (257, 90)])
def test_chunks_equal_the_library(spark, chunk, overlap):
    rng, lib = random.Random(chunk), library()
    texts = [mixed(rng, rng.randint(1, 400)) for _ in range(120)] + [" " * 500 + "end", "no stop" + "p" * 700, "\n" * 999, "ab " * 400]
    out = encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), chunk=chunk, overlap=overlap)
    assert len(out) == len(texts)
    held(out, lib)


def test_most_chunks_meet(spark):
    """The stitched way carries long texts; only runs that fill the overlap go the whole way."""
    rng = random.Random(5)
    texts = [(k, " ".join(mixed(rng, 3) for _ in range(300))) for k in range(20)] + [(99, "x" * 5000)]
    data = B._rank_file(spark, RANKS)
    ids, whole = B._by_chunks(spark.createDataFrame(texts, "row long, text string"), data, PATTERN, 512, 200)
    assert {r["row"] for r in whole.collect()} == {99}
    assert {r["row"] for r in ids.collect()} == set(range(20))


def test_matches_that_overflow_the_library(spark):
    """Runs of white space on which the library itself fails."""
    texts = [(1, " " * 300_000 + "x"), (2, "\n" * 300_000), (3, "a" * 200_000), (4, "word " * 200_000), (5, " " * 33_000 + "x"),
             (6, "\n" * 33_000)]
    out = encoded(spark.createDataFrame(texts, "doc_id long, text string"))
    lib = library()
    assert out[1][0] == lib._encode_single_piece(b" " * 299_999) + lib.encode_ordinary(" x")
    assert out[2][0] == lib._encode_single_piece(b"\n" * 300_000)
    assert out[5][0] == lib._encode_single_piece(b" " * 32_999) + lib.encode_ordinary(" x")
    assert out[6][0] == lib._encode_single_piece(b"\n" * 33_000)
    assert out[3][0] == lib.encode_ordinary("a" * 200_000) and out[4][0] == lib.encode_ordinary(texts[3][1])


def test_memory_of_matches_is_bounded(monkeypatch):
    monkeypatch.setattr(B, "MEMORY_BYTES", 2000)
    with open(RANKS, "rb") as f:
        codec = B.Codec(f.read(), PATTERN)
    lib = library()
    for k in range(50):
        text = " ".join(f"word{k}{j}" for j in range(9))
        assert codec.encode_part(text, 0, len(text)).tolist() == lib.encode_ordinary(text) == codec.encode(text).tolist()
        assert len(codec.known) < 20
    codec.encode_part("q" * 100, 0, 100)
    assert "q" * 100 not in codec.known


def test_hard_rows(spark):
    df = docs(spark).withColumnRenamed("score", "token_ids")
    out = B.encode_texts(df, RANKS, PATTERN, chunk=1000, overlap=100)
    assert sorted(out.columns) == sorted([*df.columns, "n_tokens"])
    rows, lib = out.collect(), library()
    assert len(rows) == df.count()
    for r in rows:
        assert r["token_ids"] == lib.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(r["token_ids"])


def test_decoding(spark):
    df = spark.createDataFrame([(1, [104]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    out = {r["doc_id"]: r["decoded"] for r in B.decode_ids(df, RANKS, PATTERN).collect()}
    assert out[1] == library().decode_bytes([104]) and out[2] is None and out[3] == b""
    with pytest.raises(Exception, match="vocabulary"):
        B.decode_ids(spark.createDataFrame([(1, [10 ** 6])], "doc_id long, token_ids array<int>"), RANKS, PATTERN).collect()


def test_empty_table(spark):
    assert B.encode_texts(no_docs(spark), RANKS, PATTERN).collect() == []


def test_query_equals_the_library_on_whole_documents(spark):
    lib = library()
    want = set()
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        text = r["text"] or ""
        ids = lib.encode_ordinary(text)
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(text.encode()).hexdigest()))
    rows = QUERIES["op11_byte_bpe"](spark, SF_SMALL).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
