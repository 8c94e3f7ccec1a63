"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The rank file (one base64 token and its rank a line) is serialised as a sentencepiece BPE model: every
token's bytes are mapped to printable characters, its score is the negative rank, and normalisation is
the identity. Pre-tokens of a text are encoded one by one with that model; decoding maps ids back to
bytes. A pre-token that is itself a token keeps its own id, as in the byte-pair algorithm of rank files.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm.batches import map_texts
from tapeloom.sources import read_table

#: Distinct pre-tokens remembered by a worker; the memory is emptied when full.
MEMO_ENTRIES = 200_000
#: Longer pre-tokens are encoded anew each time.
MEMO_CHARS = 64


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable Latin-1, else from 256 upwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, payload: bytes | int | float) -> bytes:
    """One protobuf field: a length-delimited, variable-length integer or 32-bit float value."""
    if isinstance(payload, bytes):
        return _varint(number << 3 | 2) + _varint(len(payload)) + payload
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    return _varint(number << 3) + _varint(payload)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank vocabulary; ids equal ranks, the unknown piece comes last."""
    chars = byte_characters()
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, 1) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(pieces)
    trainer = _field(3, 2) + _field(4, n) + _field(40, n - 1)  # model_type BPE, vocab_size, unk_id
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class _Memo(dict):
    """Pre-token -> what ``make`` gives for it, with a bounded number of entries."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.tokens = sorted(self.ranks, key=self.ranks.get)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.chars = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.split = regex.compile(pattern).findall
        self.memo = _Memo(self._piece)

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.model.encode(raw.decode("latin-1").translate(self.chars), out_type=int)

    def _piece(self, piece: str) -> tuple[int, str, bytes]:
        ids = self.encode_piece(piece)
        return len(ids), ",".join(map(str, ids)), self.decode(ids)

    def encode(self, text: str | None) -> list[int]:
        return [i for piece in self.split(text or "") for i in self.encode_piece(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and SHA-256 of the decoded bytes."""
        found = [self.memo[piece] for piece in self.split(text or "")]
        return (
            sum([f[0] for f in found]),
            hashlib.sha256(",".join([f[1] for f in found]).encode()).hexdigest(),
            hashlib.sha256(b"".join([f[2] for f in found])).hexdigest(),
        )


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBpe:
    """The codec of a rank file, made once per worker."""
    return ByteBpe(path, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every row: ``id_col``, ``ids`` array<int>, ``decoded`` binary.

    A null text counts as empty: no ids, no bytes. Null and repeated ids are kept row by row, further
    columns are left out, an empty table gives an empty result.
    """

    def fn(texts: list) -> dict:
        c = codec(path, pattern)
        ids = [c.encode(t) for t in texts]
        return {"ids": ids, "decoded": [c.decode(i) for i in ids]}

    return map_texts(df, [id_col], text_col, fn, "ids array<int>, decoded binary")


def digest_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_texts`, with digests in place of the ids and bytes."""

    def fn(texts: list) -> dict:
        c = codec(path, pattern)
        n, ids, decoded = zip(*[c.digest(t) for t in texts], strict=True)
        return {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return map_texts(df, [id_col], text_col, fn, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every row of ``documents``, digested; nulls count as empty, repeats are kept row by row."""
    import public_tokenizers as vocab

    return digest_texts(read_table(spark, sf_dir, "documents"), vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN)
