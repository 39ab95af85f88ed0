import hashlib
import random

import pytest

from quillon.llm import byte_bpe
from quillon.llm.queries import RANKS
from tests.llm.frames import listed, no_documents, odd_documents

ODD = ["", "a", "don't we'll 's", " 12ab34 ", "x" * 3000, "  \n\n  a", "   x", "日本語 текст ß", "'" * 40, "a1" * 500, "🙂" * 30,
       "<|endoftext|> plain", "\r\n\t " * 50]


@pytest.mark.parametrize("size", [1, 2, 7, 50])
def test_pieces_give_the_ids_of_the_whole(size):
    codec = byte_bpe.encoding(RANKS)
    rng = random.Random(size)
    texts = ODD + ["".join(rng.choice("ab1 2'sS \n é日!?.") for _ in range(rng.randrange(200))) for _ in range(200)]
    for text in texts:
        assert "".join(byte_bpe.pieces(text, size)) == text
        ids = codec.encode_ordinary(text)
        assert byte_bpe.encode_text(codec, text, size) == ids
        assert codec.decode_bytes(ids) == text.encode()


def test_digests_of_every_row(spark):
    docs, codec = odd_documents(spark, clashes=True), byte_bpe.encoding(RANKS)
    want = []
    for row in docs.collect():
        ids = codec.encode_ordinary(row.text or "")
        want.append((row.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((row.text or "").encode()).hexdigest()))
    assert listed(byte_bpe.token_digests(docs, RANKS)) == sorted(want, key=str)


def test_round_trip_keeps_rows_and_columns(spark):
    docs = odd_documents(spark, clashes=True)
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, ids="tokens"), RANKS, ids="tokens")
    assert set(out.columns) == {*docs.columns, "tokens", "decoded"}
    assert listed(out, *docs.columns) == listed(docs)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in out.collect())


def test_ids_that_end_inside_a_character(spark):
    codec = byte_bpe.encoding(RANKS)
    ids = codec.encode_ordinary("日本語テキスト")[:1]
    frame = spark.createDataFrame([(ids,), (None,), ([],)], "ids array<int>")
    assert sorted(bytes(r.decoded) for r in byte_bpe.decode(frame, RANKS).collect()) == sorted([codec.decode_bytes(ids), b"", b""])


def test_no_rows(spark):
    assert byte_bpe.token_digests(no_documents(spark), RANKS).count() == 0
