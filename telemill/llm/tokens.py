"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file is a parameter; each Python worker loads it once. Texts
stream through Arrow batches, whole. Null and empty texts have 0 tokens; strings
that name special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public splitting pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once a process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def with_tokens(rows: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns keep and tokens (long), the size of text."""
    schema = rows.select(*keep).withColumn("tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in (x.as_py() for x in batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return rows.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
