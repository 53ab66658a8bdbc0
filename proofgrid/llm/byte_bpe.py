"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A text longer than LONG characters is cut before white space that follows a visible character, if no match of the
split pattern spans such a place: the ids of the parts, one after the other, are then those of the whole. Whether a
pattern is one of these is tried on all kinds of characters around a cut; texts aren't cut for any other. Decoding joins
the raw bytes of the ids, which need not be valid UTF-8.

Defined cases: null and empty texts have no ids; special-token strings are ordinary text; rows are encoded one by
one, so ties, repeated rows and extra columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import map_texts, read

LONG = 1 << 16
#: White-space runs from this length on are matched outside of tiktoken, whose matcher may give up on them.
LONG_RUN = 4096
_GAP = regex.compile(rf"\s{{{LONG_RUN},}}")
_CUT = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])[ \n]")


@lru_cache(maxsize=8)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


@lru_cache(maxsize=8)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=8)
def _splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


@lru_cache(maxsize=8)
def cuts_safely(pattern: str) -> bool:
    """Whether the pattern's matches end at every place where safe_parts would cut."""
    left, right = ("a", "Z", "1", "é", "日", "٣", ".", "'s", "a.", "1,", "!?", "_", "-"), ("", "a", "1", ".", "'s", " ", "\n", "  a", "\n\n", "\t1", " .")
    probes = ((len(x), x + gap + y) for x in left for gap in " \n" for y in right)
    return all(any(m.end() == at for m in _splitter(pattern).finditer(text)) for at, text in probes)


def safe_parts(text: str, size: int = LONG) -> Iterator[str]:
    """Parts of a text that can be encoded separately; a part is longer than size only where no safe place is nearer."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, path: str, pattern: str) -> list[int]:
    """The ids of a whole text."""
    if not text:
        return []
    enc = encoding(path, pattern)
    if len(text) <= LONG_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in safe_parts(text) if cuts_safely(pattern) else [text]:
        if _GAP.search(part):
            for piece in (m[0] for m in _splitter(pattern).finditer(part)):
                raw = piece.encode()
                rank = _ranks(path).get(raw)
                ids += enc.encode_ordinary(piece) if rank is None and not piece.isspace() else [rank] if rank is not None else _space_ids(raw, path, enc)
        else:
            ids += enc.encode_ordinary(part)
    return ids


def _space_ids(raw: bytes, path: str, enc: tiktoken.Encoding) -> list[int]:
    return enc._encode_single_piece(raw)


def decode(ids: list[int] | np.ndarray, path: str, pattern: str) -> bytes:
    """The raw bytes of ids."""
    return encoding(path, pattern).decode_bytes(ids if isinstance(ids, list) else ids.tolist())


def bpe_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text. No shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame.doc_id, "ids": [np.array(encode(t, path, pattern), np.int32) for t in frame.text]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes (binary) of every id list; a null list gives no bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame.doc_id, "bytes": [b"" if ids is None else decode(np.asarray(ids), path, pattern) for ids in frame.ids]})

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInPandas(run, "doc_id long, bytes binary")


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text in one pass and keep only counts and digests, so that no id list leaves its task."""

    def digest(text: str | None) -> tuple[int, str, str, int]:
        ids = encode(text, path, pattern)
        raw = decode(ids, path, pattern)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw)

    return map_texts(docs, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
