"""Body decoding: gzip and the snappy block format, as Arrow UDFs over binary columns.

Defined results: null stays null; a body that claims an encoding but doesn't
decode is null; an unknown encoding leaves the body as it is.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def snappy_block_decode(data: bytes) -> bytes:
    """The content of one snappy block; ValueError if it isn't one."""
    if not pa.Codec.is_available("snappy"):
        return _snappy_decode(data)
    try:
        size, at = _varint(data, 0)
        if at == len(data):
            raise ValueError("empty") if size else IndexError
        return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True)
    except IndexError:
        return _snappy_decode(data)
    except (pa.ArrowException, OSError, OverflowError, MemoryError) as e:
        raise ValueError("not a block") from e


def _snappy_decode(data: bytes) -> bytes:
    try:
        size, at = _varint(data, 0)
        out = bytearray()
        while at < len(data):
            tag = data[at]
            at += 1
            if tag & 3 == 0:  # literal
                n = tag >> 2
                if n >= 60:
                    extra = n - 59
                    n = int.from_bytes(data[at : at + extra], "little")
                    at += extra
                out += data[at : at + n + 1]
                at += n + 1
                continue
            if tag & 3 == 1:
                n, offset = 4 + (tag >> 2 & 7), (tag >> 5) << 8 | data[at]
                at += 1
            else:
                width = 2 if tag & 3 == 2 else 4
                n, offset = 1 + (tag >> 2), int.from_bytes(data[at : at + width], "little")
                at += width
            start = len(out) - offset
            if offset <= 0 or start < 0:
                raise ValueError("bad offset")
            for i in range(n):  # copies may overlap themselves
                out.append(out[start + i])
        if len(out) != size:
            raise ValueError("bad size")
        return bytes(out)
    except IndexError as e:
        raise ValueError("truncated") from e


def snappy_block_encode(data: bytes) -> bytes:
    """A snappy block, for tests and round trips; of literals only where the codec isn't built in."""
    if pa.Codec.is_available("snappy"):
        return pa.compress(data, codec="snappy", asbytes=True)
    return snappy_literals(data)


def snappy_literals(data: bytes) -> bytes:
    """A valid snappy block without copies."""
    out, n = bytearray(), len(data)
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            break
    for i in range(0, len(data), 60):
        part = data[i : i + 60]
        out.append((len(part) - 1) << 2)
        out += part
    return bytes(out)


def _decode(body: bytes | None, encoding: str | None) -> bytes | None:
    if body is None:
        return None
    try:
        name = (encoding or "").strip().lower()
        if name == "gzip":
            return gzip.decompress(body)
        if name == "snappy":
            return snappy_block_decode(body)
        if name == "":  # sniff
            if body[:2] == b"\x1f\x8b":
                return gzip.decompress(body)
            try:
                return snappy_block_decode(body)
            except ValueError:
                return body
        return body
    except (OSError, EOFError, ValueError, zlib.error):
        return None


def decode_body(body: Column, encoding: Column) -> Column:
    """The decoded body; without an encoding gzip and snappy are recognised by their form."""

    @F.pandas_udf("binary")
    def run(b: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([_decode(x, y) for x, y in zip(b, e)], dtype=object)

    return run(body, encoding)


def encode_body(body: Column, encoding: str) -> Column:
    """gzip or snappy of a binary column."""
    make = {"gzip": lambda x: gzip.compress(x, mtime=0), "snappy": snappy_block_encode}[encoding]

    @F.pandas_udf("binary")
    def run(b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else make(x) for x in b], dtype=object)

    return run(body)
