"""Encoding and decoding of whole tables with a public byte-level tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the rank files lie; a parameter of every function below.
FOLDER = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: The public pattern that splits texts before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts above so many characters are cut before encoding, into pieces of about that length.
PIECE_CHARS = 20_000

# A single blank between two visible characters starts a token whatever stands around it, and so does a letter after a
# digit or a digit after a letter: no alternative of PATTERN takes both sides.
_SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{N})(?=\p{L})|(?<=\p{L})(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=\p{L})(?=[^\s\p{L}\p{N}'])")


@cache
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per worker process."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: The library's pattern backtracks over white space; longer runs are merged as the one token piece that they are.
_BLANKS = regex.compile(r"\p{White_Space}{200,}")


def pieces(text: str, length: int = PIECE_CHARS) -> Iterator[str]:
    """The text cut at safe boundaries, the first after each ``length`` characters; no cut changes the ids."""
    start = 0
    while len(text) - start > length:
        cut = _SAFE.search(text, start + length)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _encode_plain(text: str, path: str) -> list[int]:
    encode = encoding(path).encode_ordinary
    return encode(text) if len(text) <= PIECE_CHARS else [i for piece in pieces(text) for i in encode(piece)]


def encode_text(text: str | None, path: str) -> list[int]:
    """Ids without special tokens; none for a null or empty text.

    A run of white space is one piece for the merges, but for its last character if something follows: that one
    starts anew. So long runs can be taken out of the text without changing any id.
    """
    if not text:
        return []
    out: list[int] = []
    at = 0
    for run in _BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += _encode_plain(text[at : run.start()], path) if run.start() > at else []
        out += encoding(path)._encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + _encode_plain(text[at:], path) if at else _encode_plain(text, path)


def decode_ids(ids: list[int] | None, path: str) -> str | None:
    """The text of the ids by their raw bytes; bytes that are no UTF-8 become U+FFFD; null for null."""
    return None if ids is None else encoding(path).decode_bytes(list(ids)).decode("utf-8", "replace")


def encode_documents(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = f"{FOLDER}/{BYTE_BPE_50K}", count: bool = False) -> DataFrame:
    """The kept columns and ``ids`` (array of int), or with ``count`` their number as ``tokens``.

    A null or empty text has the empty list. Every text is encoded whole; rows are neither dropped nor merged.
    """
    rows = documents.select(*keep, F.col(text).alias("_text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + (", tokens long" if count else ", ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [encode_text(t, path) for t in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            if count:
                made = pa.array(sizes)
            else:
                values = np.fromiter((i for ids in lists for i in ids), np.int32, int(sizes.sum()))
                made = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*keep, "tokens" if count else "ids"])

    return rows.mapInArrow(run, out)


def decode_documents(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str = f"{FOLDER}/{BYTE_BPE_50K}") -> DataFrame:
    """The kept columns and the ``text`` of ``ids``; the empty list gives the empty text, null gives null."""
    rows = encoded.select(*keep, "ids")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(ids, path) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(run, out)


def roundtrip(documents: DataFrame, path: str = f"{FOLDER}/{BYTE_BPE_50K}") -> DataFrame:
    """doc_id and whether decoding the ids gives back the text (the empty text for null)."""
    back = decode_documents(encode_documents(documents.select("doc_id", "text"), keep=("doc_id", "text"), path=path).withColumnRenamed("text", "before"), ("doc_id", "before"), path)
    return back.select("doc_id", (F.coalesce("before", F.lit("")) == F.col("text")).alias("same"))
