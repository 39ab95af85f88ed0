"""Byte-level BPE by a local rank file: encoding in pieces, decoding to raw bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from quillon.llm.tables import with_python

#: A long text is cut into pieces of about this many characters; no row or character is left out.
PIECE_CHARS = 50_000

#: Places where every match of the splitting pattern ends: white space after other characters, and either side of
#: a change between letters and digits. No alternative of the pattern crosses them, and none looks further back.
BOUNDARY = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")

_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(rank_file: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file, read once per process."""
    if (rank_file, pattern) not in _encodings:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks,
                                                           special_tokens={})
    return _encodings[rank_file, pattern]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Consecutive parts of a text, cut only at safe boundaries, so that the ids of the parts in a row are the ids
    of the text. A part is longer than ``size`` only where no safe boundary comes earlier."""
    start = 0
    while len(text) - start > size:
        cut = BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(codec: tiktoken.Encoding, text: str, size: int = PIECE_CHARS) -> list[int]:
    ids: list[int] = []
    for piece in pieces(text, size):
        ids += codec.encode_ordinary(piece)
    return ids


def encode(docs: DataFrame, rank_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns, and the token ids of ``text`` as ``array<int>`` in a column ``ids``, which replaces one of that name.

    Null and the empty text have no ids. Rows are neither dropped nor merged, whatever repeats; an empty table gives
    none. The rank file must be at the same path on every executor; it is a parameter and read there.
    """

    def run(texts: list[str | None]) -> Iterator[tuple]:
        codec = encoding(rank_file)
        return ((encode_text(codec, t or ""),) for t in texts)

    return with_python(docs, [text], {ids: ("array<int>", pa.list_(pa.int32()))}, run)


def decode(tokens: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns, and the raw bytes of the ids as ``binary`` in a column ``out``. Bytes that end inside a character
    stay as they are. Null ids give no bytes; an id that the rank file lacks raises."""

    def run(rows: list[list[int] | None]) -> Iterator[tuple]:
        codec = encoding(rank_file)
        return ((codec.decode_bytes(row or []),) for row in rows)

    return with_python(tokens, [ids], {out: ("binary", pa.binary())}, run)


def digest(codec: tiktoken.Encoding, text: str) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, digest of the bytes they decode to; piece by piece."""
    n, by_id, by_byte = 0, hashlib.sha256(), hashlib.sha256()
    for piece in pieces(text):
        ids = codec.encode_ordinary(piece)
        by_id.update(("," * bool(n and ids) + ",".join(map(str, ids))).encode())
        by_byte.update(codec.decode_bytes(ids))
        n += len(ids)
    return n, by_id.hexdigest(), by_byte.hexdigest()


def token_digests(docs: DataFrame, rank_file: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded piece by piece, decoded again.

    One row per input row; null is the empty text. Only the digests leave the task, so the ids, several times the size
    of the text as a column, are never shuffled or stored.
    """

    def run(texts: list[str | None]) -> Iterator[tuple]:
        codec = encoding(rank_file)
        return (digest(codec, t or "") for t in texts)

    return with_python(docs, ["text"], {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()),
                                        "decoded_sha256": ("string", pa.string())}, run, keep=["doc_id"])
