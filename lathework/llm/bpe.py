"""Byte-level BPE through a sentencepiece model built from a rank file.

The vocabulary is serialised as a sentencepiece BPE model: each token's bytes
are mapped to printable characters, its score is its negative rank, and the
normaliser is the identity, so merging by score is merging by rank. Texts are
cut into pre-tokens by the pattern of the rank file; each pre-token is encoded
by itself. Decoding maps ids back to pieces and pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame, SparkSession

from lathework.llm.common import documents, map_texts

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens remembered by a task, and the longest that are.
CACHE_ENTRIES, CACHE_BYTES = 300_000, 64


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is visible Latin-1, else one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def model_bytes(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """The serialised sentencepiece model and, for each of its piece numbers, the rank it stands for."""
    chars = byte_characters()
    order = sorted(ranks.items(), key=lambda x: x[1])
    pieces = []
    for token, rank in order:
        pieces.append(_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _flag(3, 1)))
    pieces.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", -float(len(order) + 1)) + _flag(3, 2)))
    unk = len(order)
    trainer = _flag(3, 2) + _flag(4, len(pieces)) + _flag(40, unk) + b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))
    normal = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normal), [rank for _, rank in order]


class Codec:
    """Encodes and decodes whole texts; keeps the ids of frequent short pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        proto, self.rank_of = model_bytes(self.ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.split = regex.compile(pattern).findall
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        byte_of = {c: b for b, c in self.chars.items()}
        #: By id: the piece's bytes, by way of the inverse character mapping.
        self.bytes_of = {rank: bytes(byte_of[c] for c in self.model.id_to_piece(k)) for k, rank in enumerate(self.rank_of)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def _encode_new(self, tokens: list[str]) -> dict[str, tuple[int, ...]]:
        """A pre-token that is itself in the vocabulary is its own id; the others are merged by the model."""
        out, rest, mapped = {}, [], []
        for t in tokens:
            raw = t.encode("utf-8", "replace")
            if (rank := self.ranks.get(raw)) is not None:
                out[t] = (rank,)
            else:
                rest.append(t)
                mapped.append(raw.decode("latin-1").translate(self.chars))
        if rest:
            rank_of = self.rank_of
            for t, ids in zip(rest, self.model.encode(mapped, out_type=int, num_threads=1), strict=True):
                out[t] = tuple(rank_of[k] for k in ids)
        return out

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        seen = self.seen
        missing = {t for t in tokens if t not in seen}
        extra: dict[str, tuple[int, ...]] = {}
        if missing:
            new = self._encode_new(list(missing))
            if len(seen) + len(new) > CACHE_ENTRIES:
                seen.clear()
                new |= self._encode_new([t for t in set(tokens) if t not in new])
            for t, ids in new.items():
                (seen if len(t) <= CACHE_BYTES else extra)[t] = ids
        ids: list[int] = []
        if extra:
            for t in tokens:
                ids += seen[t] if t in seen else extra[t]
        else:
            for t in tokens:
                ids += seen[t]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the default rank file."""
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN


def _worker(path: str, pattern: str, hash_ids: bool, hash_decoded: bool) -> Callable:
    def make() -> Callable[[list], list[list]]:
        codec = Codec(path, pattern)
        names = list(map(str, range(max(codec.rank_of) + 1)))

        def of(texts: list) -> list[list]:
            counts, left, right = [], [], []
            for text in texts:
                ids = codec.encode(text or "")
                back = codec.decode(ids)
                counts.append(len(ids))
                left.append(hashlib.sha256(",".join([names[k] for k in ids]).encode()).hexdigest() if hash_ids else ids)
                right.append(hashlib.sha256(back).hexdigest() if hash_decoded else back.decode("utf-8", "replace"))
            return [counts, left, right]

        return of

    return make


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", hash_ids: bool = False, hash_decoded: bool = False) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids`` (or ``ids_sha256`` of the decimal ids), and the ``decoded`` text (or ``decoded_sha256`` of its bytes).

    One pass over the texts without a shuffle. Null texts count as empty, with
    no ids. Rows repeat as they do in ``docs``; other columns are ignored.
    """
    own = default_vocabulary()
    names = [("ids_sha256", "string") if hash_ids else ("ids", "array<int>"), ("decoded_sha256" if hash_decoded else "decoded", "string")]
    return map_texts(docs, [id_col], text_col, _worker(path or own[0], pattern or own[1], hash_ids, hash_decoded), [("n_tokens", "long"), *names])


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), hash_ids=True, hash_decoded=True)
