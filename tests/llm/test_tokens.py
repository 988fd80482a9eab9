from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barline.llm import bpe, token_io
from tests.compare import DATA
from tests.llm.fixtures import no_documents, odd_documents

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = Tokenizer.from_file(WORDS)
CODEC = bpe.Codec(bpe.load_ranks(RANKS), P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeinorst lhé'ß. \n日本ع#1"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_bpe_of_any_text(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))} if not hasattr(test_bpe_of_any_text, "enc") else None
    if ranks:
        test_bpe_of_any_text.enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = CODEC.encode(text)
    assert ids == test_bpe_of_any_text.enc.encode_ordinary(text)
    assert "".join(CODEC.decode_stream(iter(ids))) == "".join(CODEC.decode_stream(ids, 3)) == text


def test_transducer_emits_early(reference):
    piece = ("internationalization" * 50).encode()
    fed = []

    def watched():
        for b in piece:
            fed.append(b)
            yield b

    first = next(CODEC.fst.stream(watched()))
    assert len(fed) <= 2 * max(map(len, CODEC.fst.ranks)) and [first, *list(CODEC.fst.stream(piece))[1:]] == reference.encode_ordinary(piece.decode())


def test_whole_piece_that_merges_do_not_reach():
    """A piece in the vocabulary is that token even if no merge makes it."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    c = bpe.Codec(ranks, r"\S+|\s+")
    enc = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for t in ("abc", "abcd", "xabc", "abcabc"):
        assert c.encode(t) == enc.encode_ordinary(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"\xe2", b"\x82", b"\xac", b"\xf0", b"\x9f", b"\xed\xa0", b"\xc0", b"\xff", "é".encode()]), max_size=14), st.integers(1, 4))
def test_utf8_stream(parts, step):
    data, u = b"".join(parts), bpe.Utf8Stream()
    assert "".join(u.feed(data[i : i + step]) for i in range(0, len(data), step)) + u.close() == data.decode("utf-8", "replace")


def test_the_query_decodes_by_the_stream(spark, monkeypatch):
    """decoded_sha256 is of what the state machine gave, however few tokens it gets at a time."""
    docs = odd_documents(spark)
    one = {(r.doc_id, r.decoded_sha256) for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}
    monkeypatch.setattr(bpe, "DECODED", 2)
    assert one == {(r.doc_id, r.decoded_sha256) for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}


def test_bpe_query(spark, reference):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").unionByName(odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    want = sorted((i or -1, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in [(r.doc_id, r.text) for r in docs.collect()] for x in [reference.encode_ordinary(t or "")])
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, RANKS, P.PATTERN).collect()) == want and texts
    full = bpe.encode(odd_documents(spark), RANKS, P.PATTERN)
    assert [c.lower() for c in full.columns].count("n_tokens") == 1 and "tokens" in full.columns and full.count() == 16
    assert bpe.digests(no_documents(spark), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing(bits):
    r = random.Random(bits)
    ids = np.array([r.getrandbits(bits) for _ in range(5000)], dtype=np.uint32)
    data = token_io.pack(ids, bits)
    assert len(data) == -(-5000 * bits // 8)
    assert (token_io.unpack(data, 5000, bits) == ids).all() and (token_io.unpack(data, 77, bits, 1234) == ids[1234:1311]).all()
    assert token_io.bits_for(2**bits) == bits


def test_random_access():
    w, r, docs = token_io.FileWriter(11, block=64), random.Random(1), []
    for d in range(40):
        docs.append(np.array([r.getrandbits(11) for _ in range(r.randrange(0, 200))], dtype=np.uint32))
        w.add(d, docs[-1])
    f = token_io.TokenFile(b"".join(w.parts()), before=1000)
    every = np.concatenate(docs)
    assert f.n == len(every) and (f.read(100, 300) == every[100:400]).all()
    for (d, start, ids), want in zip(f.documents(), docs, strict=True):
        assert (ids == want).all() and start == 1000 + sum(map(len, docs[:d]))


def test_token_files(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    odd = odd_documents(spark).selectExpr("doc_id + 100000 AS doc_id", "text").where("doc_id is not null")
    docs = docs.select("doc_id", "text").unionByName(odd)
    tok, at = Tokenizer.from_file(WORDS), 0
    want = []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_io.round_trip(docs, WORDS).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert token_io.round_trip(no_documents(spark), WORDS).count() == 0


def test_several_files_in_order(spark):
    docs = spark.createDataFrame([(i * 7 % 501, f"text {i} of many") for i in range(500)] + [(None, "no id")], "doc_id long, text string")
    folder, n = token_io.write(docs, lambda: token_io.chunk_encoder(WORDS).encode, 49408, 2, file_rows=60)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.start, r.n_tokens) for r in token_io.read(spark, folder).collect())
    assert n > 5 and len(got) == 501
    assert all(a[1] + a[2] == b[1] for a, b in zip(got[:-1], got[1:], strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abcÉé'.,!# 12\nÅİẞ"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_chunks_are_whole_texts(texts):
    enc = token_io.chunk_encoder(WORDS)
    assert [x.tolist() for x in enc.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_strings_of_special_tokens_are_as_the_library_has_them():
    enc = token_io.chunk_encoder(WORDS)
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b", "<|ENDOFTEXT|>", "<|startoftext|>x.", "it's <|endoftext|", "<|endoftext|>" * 3, "plain"]
    assert [x.tolist() for x in enc.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert next(enc.encode(texts[:1])).tolist() == [3306, 49407, 1002]


def test_other_tokenizers_get_whole_texts():
    """A file whose rules the chunks don't rely on."""
    path = P.path("byte_bpe_50k.json")
    enc, tok = token_io.ChunkEncoder(path), Tokenizer.from_file(path)
    texts = ["Hello  World\n again", "", "x <|endoftext|> y"]
    assert not enc.chunked and [x.tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_of_odd_rows(spark):
    """Null and repeated ids, clashing columns, files cut within one id and by their size."""
    docs = odd_documents(spark).selectExpr("*", "1 AS n", "2 AS part", "3 AS tie", "4 AS ids")
    rows = docs.collect()
    want = sorted((-(2**63) if r.doc_id is None else r.doc_id, len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in rows)
    for size in (20_000, 3):
        folder, n = token_io.write(docs, lambda: token_io.chunk_encoder(WORDS).encode, 49408, 2, file_rows=size)
        got = sorted((-(2**63) if r.doc_id is None else r.doc_id, r.start, r.n_tokens) for r in token_io.read(spark, folder).collect())
        assert [(d, k) for d, _, k in got] == want
        assert sorted(s for _, s, _ in got) == np.cumsum([0, *[k for _, _, k in sorted(got, key=lambda x: x[1])]])[:-1].tolist()
    nulls = spark.createDataFrame([(None, f"text {i} of many") for i in range(300)], "doc_id long, text string")
    folder, n = token_io.write(nulls, lambda: token_io.chunk_encoder(WORDS).encode, 49408, 2, file_rows=40)
    assert n > 3 and token_io.read(spark, folder).count() == 300
    folder, n = token_io.write(nulls.coalesce(1), lambda: token_io.chunk_encoder(WORDS).encode, 49408, 2, file_ids=500)
    got = sorted((r.start, r.n_tokens) for r in token_io.read(spark, folder).collect())
    assert n > 2 and all(a[0] + a[1] == b[0] for a, b in zip(got[:-1], got[1:], strict=True))
