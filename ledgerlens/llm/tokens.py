"""Sizes of texts in tokens of a public byte-level BPE tokenizer.

A byte-level BPE cuts a text by a fixed pattern into words and merges bytes inside each word,
so the size of a text is the sum over its words. Words repeat, so each worker remembers the
sizes of words: a text costs one pass of the pattern and a look-up per word.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The tokenizer's published pattern, and the characters of its white space class
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
REMEMBERED = 400_000


def _ranges(letter: str) -> str:
    """The characters of a general category as ranges of a character class."""
    out, start = [], None
    for cp in range(0x10001):
        is_in = cp < 0x10000 and unicodedata.category(chr(cp))[0] == letter
        if is_in and start is None:
            start = cp
        elif not is_in and start is not None:
            out.append(f"\\u{start:04x}-\\u{cp - 1:04x}")
            start = None
    return "".join(out)


def _pattern(letters: str, numbers: str, space: str) -> re.Pattern[str]:
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


class _Sizes(dict):
    """Tokens of a word, computed when first asked for."""

    def __init__(self, encoding) -> None:
        super().__init__()
        self.encoding = encoding

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        n = self[word] = len(self.encoding._encode_single_piece(word.encode("utf-8", "replace")))
        return n


def _local(path: str) -> str:
    """The vocabulary file on this machine: where it lies, or the copy that the driver sent along."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def _send(path: str) -> None:
    """Sends the driver's vocabulary file to all workers, once per context; on one machine it is there already."""
    sc = (SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()).sparkContext
    sent = getattr(sc, "_ledgerlens_sent", None)
    if sent is None:
        sent = sc._ledgerlens_sent = set()  # type: ignore[attr-defined]
    if path not in sent and os.path.exists(path) and not sc.master.startswith("local["):
        sc.addFile(path)
        sent.add(path)


@lru_cache(4)
def counter(path: str = VOCABULARY) -> Callable[[str], int]:
    """A function that counts the tokens of a text, as encode_ordinary does."""
    import tiktoken

    with open(_local(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    ascii_words = _pattern("a-zA-Z", "0-9", r"\t\n\x0b\x0c\r ").findall
    words = None
    beyond = re.compile("[\U00010000-\U0010ffff\ud800-\udfff]").search
    look_up = _Sizes(encoding).__getitem__

    def count(text: str) -> int:
        nonlocal words
        if text.isascii():
            return sum(map(look_up, ascii_words(text)))
        if beyond(text):
            return len(encoding.encode_ordinary(text))
        if words is None:
            words = _pattern(_ranges("L"), _ranges("N"), SPACE).findall
        return sum(map(look_up, words(text)))

    return count


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a whole text; 0 for a null or empty one."""
    _send(path)

    @F.pandas_udf(T.LongType())
    def size(texts: pd.Series) -> pd.Series:
        count = counter(path)
        return pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    return size(text)
