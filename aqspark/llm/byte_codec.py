"""Byte-level BPE through a sentencepiece model that is written from the vocabulary.

A rank file lists byte strings by merge rank. The same merges are a sentencepiece BPE model if
each byte stands as one printable character and a piece scores its negative rank: the
best-scoring pair is then the pair of the lowest rank. The model is serialised here field by
field; nothing is trained. Normalisation is the identity, so no byte changes.

Texts are split by the pattern of the vocabulary and each match is encoded alone. Decoding maps
every id back to its bytes.

Null and empty texts give no ids and no bytes. Texts of any length are encoded whole. Repeated
rows give repeated results. Only the id and the text column are read, so other columns cannot clash.
"""

import base64
import hashlib
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.llm.batches import map_arrow, text_steps

# pre-tokens whose ids a worker remembers; a full memory is emptied, which changes no result
MEMORY = 1 << 16


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _float(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def byte_characters() -> dict[int, str]:
    """One printable character per byte: its own code point if that prints, else the next free
    one from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printing)]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(rest)}


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece ``i`` is ``tokens[i]``; the unknown piece follows them."""
    characters = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(characters[b] for b in token).encode()
        out += _block(1, _block(1, piece) + _float(2, -float(rank)))
    out += _block(1, _block(1, b"<unk>") + _float(2, 0.0) + _number(3, 2))
    size = len(tokens) + 1
    # the trainer's part: BPE, sizes and ids of special pieces (-1: absent)
    absent = (1 << 64) - 1
    out += _block(2, _number(3, 2) + _number(4, size) + _number(40, size - 1)
                  + _number(41, absent) + _number(42, absent) + _number(43, absent))
    # the normaliser's part: identity, no prefix, spaces as they are
    out += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class ByteCodec:
    """Encoder and decoder of one rank file."""

    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary, "rb") as lines:
            ranked = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        self.tokens = [ranked[i] for i in range(len(ranked))]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        characters = byte_characters()
        # bytes are read as Latin-1, so that a translation table maps them to their characters
        self.table = {b: c for b, c in characters.items() if chr(b) != c}
        self.split = regex.compile(pattern).findall
        self.ids: dict[str, list[int]] = {}
        # of each pre-token in memory: its ids in decimal, and what they decode to
        self.decimal: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[*chain.from_iterable(map(self.ids.__getitem__, words))] for words in self.learn(texts)]

    def round_trips(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Of each text the decimal ids, joined by one space, and the bytes decoded from them."""
        return [(" ".join(map(self.decimal.__getitem__, words)),
                 b"".join(map(self.decoded.__getitem__, words))) for words in self.learn(texts)]

    def learn(self, texts: list[str]) -> list[list[str]]:
        """Split the texts into pre-tokens and encode those that are not in memory yet."""
        words = [self.split(text) for text in texts]
        if len(self.ids) > MEMORY:
            for memory in (self.ids, self.decimal, self.decoded):
                memory.clear()
        new = list(set().union(*words).difference(self.ids))
        mapped = [word.encode().decode("latin-1").translate(self.table) for word in new]
        for word, ids in zip(new, self.model.encode(mapped, num_threads=1) if new else [], strict=True):
            self.ids[word] = ids
            self.decimal[word] = " ".join(map(str, ids))
            self.decoded[word] = self.decode(ids)
        return words

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> ByteCodec:
    return ByteCodec(vocabulary, pattern)


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches):
        own = codec(vocabulary, pattern)
        for batch in batches:
            for part, texts in text_steps(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(own.encode(texts), pa.list_(pa.int32()))], [id_col, "ids"])

    return map_arrow(source, run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes): the bytes that the ids of ``encode_texts`` stand for."""
    source = encoded.select(id_col, "ids")
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches):
        own = codec(vocabulary, pattern)
        for batch in batches:
            decoded = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(decoded, pa.binary())], [id_col, "bytes"])

    return map_arrow(source, run, f"`{id_col}` {kind}, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text in one pass.

    (id, n_tokens, ids_sha256, decoded_sha256[, ids]): the digests are those of the decimal ids
    joined by one space and of the decoded bytes.
    """
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches):
        own = codec(vocabulary, pattern)
        for batch in batches:
            for part, texts in text_steps(batch, "text"):
                trips = own.round_trips(texts)
                columns = [
                    part.column(0),
                    pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in trips], pa.int64()),
                    pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in trips], pa.string()),
                    pa.array([hashlib.sha256(data).hexdigest() for _, data in trips], pa.string())]
                if with_ids:
                    columns.append(pa.array([np.fromstring(ids, "int32", sep=" ") for ids, _ in trips],
                                            pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(source, run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
        + ", ids array<int>" * with_ids, trim=True)
