"""Sizes of texts in tokens of a public tokenizer, whose files stay where they are."""

from __future__ import annotations

import base64
import functools
import os

import pyarrow as pa
import tiktoken
from pyspark import SparkContext, SparkFiles
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranks of a public byte-level BPE, and how it cuts text into pieces.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def sent(path: str = RANKS) -> str:
    """The file's name, once the driver has sent it to all executors, which needn't have it where it is."""
    name, context = os.path.basename(path), SparkContext._active_spark_context
    if context is not None and not os.path.exists(SparkFiles.get(name)):
        context.addFile(path)
    return name


@functools.cache
def encoding(path: str = RANKS) -> tiktoken.Encoding:
    """path: a file, or the name of one that was sent."""
    with open(path if os.path.isabs(path) else SparkFiles.get(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(texts: list[str | None], name: str) -> list[int]:
    e = encoding(name)
    return [0 if not t else len(e.encode_ordinary(t)) for t in texts]


def count_tokens(c: Column, path: str = RANKS) -> Column:
    """Tokens of the whole text; 0 of null and of an empty text."""

    name = sent(path)

    @F.arrow_udf(T.IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(counted(texts.to_pylist(), name), pa.int32())

    return count(c)
