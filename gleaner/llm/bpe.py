"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The split pattern's matches are encoded apart from each other, so a task gives each distinct one to the library once
and remembers its ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text whose new pieces the library encodes at once, pieces that a task remembers, and their length.
CHARS_AT_ONCE, REMEMBERED, LONG_PIECE = 1 << 19, 300_000, 64
#: The pattern that byte-level BPE vocabularies of this kind split text with, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """A tokenizer and, for each id, its bytes: the byte table is applied backwards once."""

    def __init__(self, data: str, pattern: str = PATTERN):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        back = {c: b for b, c in byte_characters().items()}
        entries = sorted((i, t) for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items())
        added = set(self.tokenizer.get_added_tokens_decoder())
        self.bytes_of = [b""] * (entries[-1][0] + 1)
        for i, token in entries:
            self.bytes_of[i] = token.encode() if i in added else bytes(back[c] for c in token)
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces = [self.split(t) for t in texts]
        new = list({p for own in pieces for p in own if p not in self.known})
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.known.clear()
            new = list({p for own in pieces for p in own})
        if new:
            ids = np.array(self.tokenizer.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
            # no id goes beyond its piece, so pieces end where the ids' bytes do
            ends = np.searchsorted(np.cumsum(self.length_of[ids]), np.cumsum([len(p.encode()) for p in new])) + 1
            raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.known.update((p, raw[a:b]) for p, a, b in zip(new, at, at[1:]))
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, own)), np.int32) for own in pieces]
        for p in new:
            if len(p) > LONG_PIECE:
                del self.known[p]
        return out

    def decode(self, ids: list[int | None]) -> bytes:
        """The bytes of the ids; null ids have none. ValueError for an id that the vocabulary doesn't have."""
        own = [i for i in ids if i is not None]
        if own and not 0 <= min(own) <= max(own) < len(self.bytes_of):
            raise ValueError(f"the vocabulary has ids from 0 to {len(self.bytes_of) - 1}, not {min(own)} to {max(own)}")
        return b"".join(map(self.bytes_of.__getitem__, own))


@lru_cache(maxsize=2)
def _held(data: str, pattern: str = PATTERN) -> Vocabulary:
    return Vocabulary(data, pattern)


def same_vocabulary(tokenizer_json: str, ranks: dict[bytes, int]) -> bool:
    """Whether a tokenizer's ordinary tokens are the tokens of a rank file, under the same numbers."""
    held = Vocabulary(tokenizer_json)
    added = held.tokenizer.get_added_tokens_decoder()
    return {b: i for i, b in enumerate(held.bytes_of) if i not in added} == ranks


def decode_text(tokens: bytes) -> str:
    """Whole characters as they are; bytes of a character that was split become U+FFFD."""
    return tokens.decode("utf-8", "replace")


def character_ends(raw: bytes, ids: np.ndarray, length_of: np.ndarray) -> np.ndarray:
    """The code points of the text that each token's end has reached; a split character counts with its last byte."""
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    begun = np.concatenate(([0], np.cumsum(lead)))
    ends = np.cumsum(length_of[ids])
    inside = np.append(~lead, False)[ends]  # the next byte continues a character
    return begun[ends] - inside


def encode(docs: DataFrame, tokenizer_json: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = True, pattern: str = PATTERN) -> DataFrame:
    """Each row's `keep` columns with ids array<int>, ends array<int> and decoded binary. `pattern` splits the texts.

    tokenizer_json is the content of the library's file, sent to executors as a broadcast value of fixed size. No
    special tokens are added or recognised, so their strings are ordinary text. ends has for each token the number
    of code points up to its end (null without offsets): token k covers those from ends[k-1] to ends[k], and none
    where a character goes on in the next token. decoded is the ids decoded again. Null texts count as empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    inner = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    fields = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _held(sent.value, pattern)
        for batch in batches:
            for low, high, texts in _parts(batch.column(batch.num_columns - 1)):
                found = vocabulary.encode(texts)
                raw = [vocabulary.decode(ids.tolist()) for ids in found]
                ends = [character_ends(r, ids, vocabulary.length_of).astype(np.int32) for r, ids in zip(raw, found)] if offsets else []
                rows = batch.slice(low, high - low)
                arrays = [*rows.columns[:-1], _lists(found), _lists(ends) if offsets else pa.nulls(len(found), pa.list_(pa.int32())), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*(f"k{i}" for i in range(len(keep))), "ids", "ends", "decoded"])

    out = inner.mapInArrow(encoded, f"{fields}, ids array<int>, ends array<int>, decoded binary")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "ids", "ends", "decoded")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int32), *arrays])))


def _parts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of texts of bounded size, in order."""
    low, texts, held = 0, [], 0
    for at, value in enumerate(column):
        text = value.as_py() or ""
        if texts and held + len(text) > CHARS_AT_ONCE:
            yield low, at, texts
            low, texts, held = at, [], 0
        texts.append(text)
        held += len(text)
    if texts:
        yield low, len(column), texts


def decode(rows: DataFrame, tokenizer_json: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's `keep` columns with decoded (binary) and text (string; split characters become U+FFFD).

    A null list, and a null id within a list, decode to nothing; an id that the vocabulary doesn't have, a negative one
    too, fails the task with a ValueError.
    """
    sent = rows.sparkSession.sparkContext.broadcast(tokenizer_json)
    inner = rows.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(ids_col).cast("array<int>").alias("ids"))
    fields = ", ".join(f"k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _held(sent.value)
        for batch in batches:
            raw = [vocabulary.decode(ids.as_py() or []) for ids in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary()), pa.array([decode_text(r) for r in raw], pa.string())], [*(f"k{i}" for i in range(len(keep))), "decoded", "text"])

    out = inner.mapInArrow(decoded, f"{fields}, decoded binary, text string")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "decoded", "text")
