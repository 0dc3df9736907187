"""Byte-level BPE through a sentencepiece model that is serialised straight from the vocabulary.

Pieces are the vocabulary's byte strings, each byte mapped to a printable character; a piece's score is its negative rank, so that sentencepiece
merges in the order of the ranks; the normaliser is the identity. A text is cut into pre-tokens by the pattern; pre-tokens are encoded one by one
(a pre-token that is a vocabulary entry is that entry) and kept in a bounded memory of the task, as texts repeat them. Decoding maps ids back
to bytes. The vocabulary file is read at the driver and sent to the executors, about 1 MB.

Defined results: null text is empty and has no ids; an empty table gives no rows; other columns stay, those named like a result are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pre-tokens that a task remembers, and the longest of them in characters.
MEMORY, MEMORY_CHARS = 250_000, 48


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is visible in Latin-1, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary in order of rank from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int) -> bytes:
    """One protocol buffer field: bytes with their length, or a varint."""
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: field 1 pieces (1 text, 2 score, 3 type), 2 trainer (3 model type: 2 is BPE), 3 normaliser.

    Ids equal ranks; the unknown piece that the format asks for comes last and is never met.
    """
    to = byte_characters()
    score = lambda s: _varint(2 << 3 | 5) + struct.pack("<f", s)
    out = [_field(1, _field(1, "".join(to[b] for b in t).encode()) + score(-float(i))) for i, t in enumerate(vocabulary)]
    out.append(_field(1, _field(1, b"<unk>") + score(0.0) + _field(3, 2)))
    out.append(_field(2, _field(3, 2)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Encoder:
    """text -> ids as little-endian unsigned 32-bit bytes, and back."""

    def __init__(self, vocabulary: list[bytes], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model or serialise(vocabulary))
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(vocabulary)}
        self.characters = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.memory: dict[str, bytes] = {}

    def learn(self, fresh: list[str]) -> dict[str, bytes]:
        found, rest = {}, []
        for p in fresh:
            b = p.encode()
            if (known := self.whole.get(b)) is not None:
                found[p] = known
            else:
                rest.append((p, b.decode("latin-1").translate(self.characters)))
        for (p, _), ids in zip(rest, self.model.encode([m for _, m in rest], num_threads=1) if rest else []):
            found[p] = np.asarray(ids, "<u4").tobytes()
        return found

    def encode(self, text: str) -> bytes:
        parts = self.split(text)
        memory = self.memory
        if fresh := set(parts).difference(memory):
            found = self.learn(list(fresh))
            if len(memory) + len(found) > MEMORY:
                memory.clear()
                found |= self.learn([p for p in set(parts) if p not in found])
            memory.update(found)
            out = b"".join(map(memory.__getitem__, parts))
            for p in found:
                if len(p) > MEMORY_CHARS:
                    del memory[p]
            return out
        return b"".join(map(memory.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: What encode can add besides n_tokens: ids as little-endian unsigned 32-bit, SHA-256 of these, and SHA-256 of the bytes that they decode to.
RESULTS = {"ids": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", adds: Sequence[str] = ("ids",)) -> DataFrame:
    """docs with n_tokens and what `adds` names of RESULTS."""
    vocabulary = read_ranks(path)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, serialise(vocabulary)))

    def kernel():
        words, model = sent.value
        bpe = Encoder(words, pattern, model)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        made = {"ids": lambda i: i, "ids_sha256": sha, "decoded_sha256": lambda i: sha(bpe.decode(i))}

        def step(texts):
            ids = [bpe.encode(t or "") for t in texts]
            return {"n_tokens": [len(i) // 4 for i in ids]} | {n: [made[n](i) for i in ids] for n in adds}

        return step

    return common.map_batches(docs, kernel, [text_col], ", ".join(["n_tokens long", *(f"{n} {RESULTS[n]}" for n in adds)]))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded (binary), the bytes of its ids; null for null ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def kernel():
        words = sent.value
        return lambda ids: {"decoded": [None if i is None else b"".join(words[x] for x in np.frombuffer(i, "<u4").tolist()) for i in ids]}

    return common.map_batches(encoded, kernel, [ids_col], "decoded binary")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, adds=("ids_sha256", "decoded_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
