"""Encoding of a corpus with a public byte-level BPE vocabulary, by a sentencepiece model.

The vocabulary (ranks of byte strings) is written as a sentencepiece BPE model without any
training: each byte string becomes a piece of characters that stand for its bytes, scored by
its negative rank, so that the pair of lowest rank is always merged first; normalisation is
the identity, without a dummy prefix or escaped blanks. A text is cut into pre-tokens by the
vocabulary's pattern, each pre-token is mapped to byte characters and encoded by the model.
Ids are places in the model, which are the ranks. Decoding maps pieces back to bytes.

Distribution: encoding needs no shuffle, only a pass over the documents in Arrow batches.
The model, whose size is that of the vocabulary (about 1 MB, fixed), is broadcast as bytes,
so the vocabulary file is needed on the driver only. Pre-tokens repeat, so a worker keeps the
ids of those it has seen in a dictionary of bounded size; this affects speed only.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from forumlake.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The vocabulary's pre-token pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a worker remembers, and the longest that it remembers.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64


@lru_cache(1)
def byte_characters() -> list[str]:
    """A visible character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    table = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file (base64, rank on each line), by rank."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float | bool) -> bytes:
    """One field of a protocol-buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(int(value))
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece i is tokens[i]; its unknown piece comes last."""
    chars = byte_characters()
    pieces = [_field(1, "".join(chars[b] for b in t)) + _field(2, float(-i)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    # trainer: model_type BPE, vocab_size, unk_id, no bos, eos and pad (negative ids are ten-byte varints)
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(pieces)) + b"".join(_field(n, v) for n, v in ((40, len(tokens)), (41, none), (42, none), (43, none)))
    # normaliser: identity, no dummy prefix, blanks neither removed nor escaped
    normaliser = _field(1, "identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Texts to ids and back, with one serialised model."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.to_chars = {b: c for b, c in enumerate(byte_characters())}
        self.to_byte = {c: b for b, c in self.to_chars.items()}

    def _mapped(self, token: str) -> str:
        return token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars)

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text; a null and an empty text give an empty list."""
        cut = [self.split(t) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({t for c in cut for t in c if t not in known})
        fresh = dict(zip(new, self.model.encode([self._mapped(t) for t in new], num_threads=1), strict=True)) if new else {}
        known.update((t, i) for t, i in fresh.items() if len(t) <= REMEMBERED_CHARS)
        out = []
        for c in cut:
            ids: list[int] = []
            for t in c:
                ids += fresh[t] if t in fresh else known[t]
            out.append(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces mapped back to bytes (exact for what encode gave)."""
        chars = "".join(self.model.id_to_piece(int(i)) for i in ids)
        return bytes(self.to_byte[c] for c in chars).decode("utf-8", "surrogatepass")


@lru_cache(4)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


@lru_cache(4)
def load_model(tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> bytes:
    return model_bytes(read_ranks(f"{tokenizer_dir}/{vocabulary}"))


def encode_documents(spark: SparkSession, documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, counts_only: bool = False, text_rows: int = 1_000) -> DataFrame:
    """doc_id with the ids of its text, or with n_tokens alone when counts_only.

    documents: doc_id bigint, text string; other columns are ignored. One row comes out for each
    row that goes in, repeated doc_ids included. A null text and an empty text have no ids (an
    empty list, 0 tokens); blank texts have those of their blanks. Whole texts are encoded,
    however long; the names of special tokens in a text are ordinary text.
    """
    shared = spark.sparkContext.broadcast(load_model(tokenizer_dir))
    schema = "doc_id bigint, n_tokens int" if counts_only else "doc_id bigint, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, text_rows):
                b = whole.slice(at, text_rows)
                ids = enc.encode_batch(b.column(1).to_pylist())
                out = pa.array([len(i) for i in ids], pa.int32()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), out], names=["doc_id", "n_tokens" if counts_only else "ids"])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, schema)
