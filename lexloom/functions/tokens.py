"""Tokens of a byte-pair vocabulary, counted, cut and listed row by row.

The vocabulary is a file of ranks (a token in base64 and its rank a line), which Spark sends to
the executors; where it lies is a parameter. It is never trained here.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache

import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: How byte-level vocabularies of this kind divide a text before they merge bytes.
DIVIDED = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The tokenizer's own expressions run out of stack on white space of this length.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_LONG_WHITE = re.compile(f"[{_WHITE}]{{1000,}}")


class Encoder:
    """Texts to token numbers and back."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.own = tiktoken.Encoding("ranks", pat_str=DIVIDED, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        """Long white space is one piece up to its last character, which goes with what follows, as the expressions have it."""
        out: list[int] = []
        at = 0
        for run in _LONG_WHITE.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            out += self.own.encode_ordinary(text[at : run.start()])
            out += self.own._encode_single_piece(text[run.start() : stop])  # noqa: SLF001
            at = stop
        return out + self.own.encode_ordinary(text[at:])

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def head(self, text: str, most: int) -> str:
        """The text of the first ``most`` tokens; a character of which they hold only some bytes is left out."""
        found = self.ids(text)
        return text if len(found) <= most else self.own.decode_bytes(found[:most]).decode("utf-8", "ignore")


@lru_cache(maxsize=2)
def _opened(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """Sends the file to every executor; what it returns opens it in a task, once a worker."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda: _opened(SparkFiles.get(name))


def _by_text(found: Callable[[], Encoder], kind: str, of: Callable[[Encoder, str], object]) -> Callable[[Column], Column]:
    """Row by row: Spark hands on a hundred texts at a time, where an Arrow batch may hold ten thousand, however long they are."""

    @F.udf(kind, useArrow=False)
    def apply(text):  # noqa: ANN001, ANN202
        return None if text is None else of(found(), text)

    return apply


def token_count(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A function of a text column: its number of tokens; null for null."""
    return _by_text(vocabulary(spark, path), "int", lambda e, t: e.count(t))


def token_ids(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A function of a text column: its tokens' numbers."""
    return _by_text(vocabulary(spark, path), "array<int>", lambda e, t: e.ids(t))


def token_head(spark: SparkSession, path: str, most: int) -> Callable[[Column], Column]:
    """A function of a text column: the text of its first ``most`` tokens."""
    return _by_text(vocabulary(spark, path), "string", lambda e, t: e.head(t, most))
