import sentencepiece

from qcorpus.llm import sentencepiece_codec as S
from qcorpus.llm.queries import TOKENIZER
from tests.conftest import SF_SMALL
from tests.llm.fixtures import docs, no_docs

HARD = ["", " ", "  ", "a", " a", "a ", "  two  spaces   here ", "tab\tand\nline\r\n", "クジラ 🐋 ünï", "▁marker ▁▁", "\x00\x01",
        "<s> </s> <unk> <0x41>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "é" * 50 + " ́"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)


def model_bytes():
    with open(TOKENIZER, "rb") as f:
        return f.read()


def test_model_is_parsed_like_the_library_does():
    own, lib = S.parse_model(model_bytes()), library()
    assert [p[0] for p in own.pieces] == [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
    assert [p[1] for p in own.pieces] == [lib.get_score(i) for i in range(lib.get_piece_size())]
    assert own.unk_id == lib.unk_id() and own.kind == S.BPE and own.byte_fallback


def test_hard_texts_equal_the_library():
    codec, lib = S.Codec(model_bytes()), library()
    ids, same = codec.encode(HARD)
    for t, i, s in zip(HARD, ids, same):
        assert i.tolist() == lib.encode(t), repr(t)
        assert s and codec.decode(i) == codec.normalised(t)


def test_whole_text_tokenizer_agrees_with_words():
    codec = S.Codec(model_bytes())
    ids, _ = codec.encode(HARD[3:])
    assert [e.ids for e in codec.whole.encode_batch(HARD[3:], add_special_tokens=False)] == [i.tolist() for i in ids]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(S, "MEMORY_BYTES", 1200)
    codec, lib = S.Codec(model_bytes()), library()
    for k in range(10):
        text = " ".join(f"word{k}{j}" for j in range(4)) + " " + "long" * 40
        assert codec.encode([text])[0][0].tolist() == lib.encode(text)
        assert len(codec.known) <= 8 and not any(len(w) > S.LONGEST_KEPT for w in codec.known)


def _varint(n):
    out = b""
    while n >= 0x80:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _message(number, data):
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def test_unigram_model_equals_the_library():
    """A hand-made unigram model with byte fallback."""
    import struct
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    pieces += [("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁a", -3.7, 1), ("ba", -5.5, 1), ("▁ab", -4.4, 1)]
    data = b"".join(_message(1, _message(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _varint(3 << 3) + _varint(k))
                    for p, s, k in pieces)
    data += _message(2, _varint(3 << 3) + _varint(1) + _varint(35 << 3) + _varint(1))
    data += _message(3, _varint(3 << 3) + _varint(1) + _varint(4 << 3) + _varint(1) + _varint(5 << 3) + _varint(1))
    codec = S.Codec(data)
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["ab", "abba ab  aab", " b a ", "zé ab", "", "bab aba"]
    ids, same = codec.encode(texts)
    for t, i, s in zip(texts, ids, same):
        assert i.tolist() == lib.encode(t) and s, repr(t)
        assert codec.decode(i) == codec.normalised(t)


def test_all_documents_equal_the_library_whole(spark):
    lib = library()
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in S.encode_texts(df, TOKENIZER).collect():
        assert r["token_ids"] == lib.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(r["token_ids"]) and r["roundtrip"] and r["parity"]


def test_hard_rows_and_decoding(spark):
    df = docs(spark).withColumnRenamed("score", "parity")
    out = S.encode_texts(df, TOKENIZER)
    assert out.columns.count("parity") == 1
    back = S.decode_tokens(out.withColumnRenamed("text", "was"), TOKENIZER)
    for r in back.collect():
        assert r["text"] == r["was"]
        assert (r["token_ids"] is None) == (r["was"] is None) and r["roundtrip"] in (True, None)


def test_empty_table(spark):
    assert S.encode_texts(no_docs(spark), TOKENIZER).collect() == []
