"""Byte-level BPE encoding of a corpus by monoid tree reduction.

A text is cut in halves until the pieces are short.  Leaves are encoded on their own, and two
neighbours are joined by encoding a window around their common border again.  The window grows
outwards until both of its ends lie on *sure borders*: places where the pre-tokenizer splits
whatever stands further away.  Tokens outside the window then provably equal those of the
undivided text, so the tree's root is the encoding of the whole text.

A sure border lies between two characters if no alternative of the pre-tokenizer's pattern can
match across it and no look-ahead made on its left reaches past it: between anything that is
not white space and white space, between a letter and a digit, and from a letter or digit to a
mark.  (From a mark to a letter is none: ``'s`` is one match.)
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")
LEAF_CHARS = 4096
#: The public pre-tokenizer pattern of the byte_bpe_50k vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    """The tokenizer and, by id, how many bytes each token has; once in a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("skein", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def _kind(char: str) -> int:
    """0 white space, 1 letter, 2 number, 3 other; by the pattern's own classes."""
    import regex

    if regex.match(r"\s", char):
        return 0
    if regex.match(r"\p{L}", char):
        return 1
    return 2 if regex.match(r"\p{N}", char) else 3


def is_sure_border(left: str, right: str) -> bool:
    a, b = _kind(left), _kind(right)
    return (a != 0 and b == 0) or (a in (1, 2) and b != a)


class Node:
    """The encoding of a stretch of text; ``join`` is associative and the empty node its unit."""

    __slots__ = ("text", "ids")

    def __init__(self, text: str, ids: list[int]):
        self.text, self.ids = text, ids


def _last_border(text: str) -> int:
    """The last sure border inside ``text``, or 0."""
    for i in range(len(text) - 1, 0, -1):
        if is_sure_border(text[i - 1], text[i]):
            return i
    return 0


def _first_border(text: str) -> int:
    """The first sure border inside ``text``, or its length."""
    for i in range(1, len(text)):
        if is_sure_border(text[i - 1], text[i]):
            return i
    return len(text)


def join(a: Node, b: Node, encoder, lengths: np.ndarray) -> Node:
    if not a.text or not b.text:
        return b if not a.text else a
    start, end = _last_border(a.text), _first_border(b.text)
    window = encoder.encode_ordinary(a.text[start:] + b.text[:end])
    # bytes outside the window, so tokens outside it: borders are also borders between tokens
    tail = len(a.text[start:].encode())
    kept, seen = len(a.ids), 0
    while seen < tail:
        kept -= 1
        seen += lengths[a.ids[kept]]
    head, first, seen_b = len(b.text[:end].encode()), 0, 0
    while seen_b < head:
        seen_b += lengths[b.ids[first]]
        first += 1
    if seen != tail or seen_b != head:
        raise ValueError("a sure border fell inside a token")
    return Node(a.text + b.text, a.ids[:kept] + window + b.ids[first:])


def encode_tree(text: str, encoder, lengths: np.ndarray, leaf: int = LEAF_CHARS) -> Node:
    if len(text) <= leaf:
        return Node(text, encoder.encode_ordinary(text))
    middle = len(text) // 2
    return join(encode_tree(text[:middle], encoder, lengths, leaf), encode_tree(text[middle:], encoder, lengths, leaf), encoder, lengths)


def _clean(text: str) -> str:
    """Lone surrogates cannot be bytes; Spark strings never hold them, plain Python might."""
    return text.encode("utf-8", "replace").decode("utf-8")


def encode_text(text: str | None, tokenizer: str = "byte_bpe_50k", leaf: int = LEAF_CHARS, directory: str = TOKENIZER_DIR) -> list[int]:
    """Ids of one text; ``[]`` for null and empty."""
    encoder, lengths = _encoding(f"{directory}/{tokenizer}.tiktoken")
    return encode_tree(_clean(text), encoder, lengths, leaf).ids if text else []


def decode_ids(ids: list[int], tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> str:
    """The text of ``ids``: bytes of halves concatenated up the tree."""
    encoder, _ = _encoding(f"{directory}/{tokenizer}.tiktoken")

    def up(part: list[int]) -> bytes:
        if len(part) <= LEAF_CHARS:
            return encoder.decode_bytes(part)
        return up(part[: len(part) // 2]) + up(part[len(part) // 2 :])

    return up(list(ids)).decode("utf-8", "replace")


def encode(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR, leaf: int = LEAF_CHARS) -> DataFrame:
    """One row for each row of ``df``: ``id_col`` and ``ids`` (array<int>).

    Null and empty texts give an empty array; blanks and special-token strings are ordinary
    text; a null id stays null; repeated rows are all kept; other columns are not read.  No
    shuffle: the encoding is one pass over the input's partitions.
    """
    source = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    key = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoding(f"{directory}/{tokenizer}.tiktoken")
        for batch in batches:
            found = [encode_tree(t, encoder, lengths, leaf).ids if t else [] for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            flat = np.fromiter((i for x in found for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["k", "ids"])

    return source.mapInArrow(run, f"k {key}, ids array<int>").select(F.col("k").alias(id_col), "ids")


def count_tokens(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR, leaf: int = LEAF_CHARS) -> DataFrame:
    """``id_col`` and ``n_tokens`` (bigint, 0 for null and empty); as :func:`encode` otherwise."""
    source = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    key = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoding(f"{directory}/{tokenizer}.tiktoken")
        for batch in batches:
            sizes = [len(encode_tree(t, encoder, lengths, leaf).ids) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["k", "n_tokens"])

    return source.mapInArrow(run, f"k {key}, n_tokens bigint").select(F.col("k").alias(id_col), "n_tokens")
