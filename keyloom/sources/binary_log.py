"""Binary effect-log segments: reader and writer.

Fixed values of the format (little-endian): a 32-byte header of magic (8),
version u16, flags u16, base offset u64, created u64, crc u32; then records of
length u32, db u16, kind u16, crc u32 and a payload that is an array of byte
strings in request framing.  The CRC is Castagnoli's, over the record's first
eight bytes and its payload.  A cut-off last record is a torn tail; a record
whose checksum fails is corruption.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

HEADER = struct.Struct("<8sHHQQI")
RECORD = struct.Struct("<IHHI")
POLYNOMIAL = 0x82F63B78
SCHEMA = "path string, offset bigint, db int, verb string, args array<binary>, status string"


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


_CRC = _table()


#: Data from so many bytes is cut into lanes, which advance together.
LANES_FROM, LANES = 8192, 512
_CRC_ARRAY = np.array(_CRC, dtype=np.uint32)


def crc32c(data: bytes) -> int:
    """Castagnoli's CRC.

    Long data is cut into equal lanes (zeros before the first change nothing,
    once the start value is folded into the first four bytes) that advance a
    byte at a time as one array.  The 32 unit registers run along over zero
    bytes: they give what a lane's length of further bytes does to a register,
    with which the lanes are joined.
    """
    if len(data) < LANES_FROM:
        crc = 0xFFFFFFFF
        for b in data:
            crc = _CRC[(crc ^ b) & 255] ^ crc >> 8
        return crc ^ 0xFFFFFFFF
    width = -(-len(data) // LANES)
    cells = np.zeros(width * LANES, dtype=np.uint8)
    cells[-len(data) :] = np.frombuffer(data, dtype=np.uint8)
    cells[-len(data) : len(cells) - len(data) + 4] ^= 255
    columns = np.ascontiguousarray(cells.reshape(LANES, width).T)
    state = np.zeros(LANES + 32, dtype=np.uint32)
    state[LANES:] = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for column in columns:
        low = state & 255
        low[:LANES] ^= column
        state = _CRC_ARRAY[low] ^ state >> 8
    units = state[LANES:].tolist()
    crc = 0
    for lane in state[:LANES].tolist():
        moved = lane
        for bit, unit in enumerate(units):
            if crc >> bit & 1:
                moved ^= unit
        crc = moved
    return crc ^ 0xFFFFFFFF


def encode_args(args: list[bytes]) -> bytes:
    return b"*%d\r\n" % len(args) + b"".join(b"$%d\r\n%s\r\n" % (len(a), a) for a in args)


def decode_args(data: bytes) -> list[bytes]:
    """Strict: exactly one array of byte strings."""

    def line(at: int, mark: bytes) -> tuple[int, int]:
        end = data.index(b"\r\n", at)
        if data[at : at + 1] != mark or not data[at + 1 : end].isdigit():
            raise ValueError("malformed payload")
        return int(data[at + 1 : end]), end + 2

    n, at = line(0, b"*")
    out = []
    for _ in range(n):
        size, at = line(at, b"$")
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("malformed payload")
        out.append(data[at : at + size])
        at += size + 2
    if at != len(data):
        raise ValueError("malformed payload")
    return out


def encode_record(db: int, args: list[bytes], kind: int = 0) -> bytes:
    payload = encode_args(args)
    head = struct.pack("<IHH", len(payload), db, kind)
    return head + struct.pack("<I", crc32c(head + payload)) + payload


def encode_segment(records: list[tuple[int, list[bytes]]], magic: bytes, base: int = 0, created: int = 0) -> bytes:
    head = HEADER.pack(magic, 1, 0, base, created, 0)[:-4]
    return head + struct.pack("<I", crc32c(head)) + b"".join(encode_record(db, args) for db, args in records)


def decode_segment(data: bytes) -> Iterator[tuple[int, int, list[bytes], str]]:
    """``(offset, db, args, status)``; the last status is ``ok``, ``torn`` or ``corrupt``."""
    base = HEADER.unpack_from(data)[3]
    at = HEADER.size
    while at < len(data):
        if at + RECORD.size > len(data):
            yield base + at - HEADER.size, 0, [], "torn"
            return
        size, db, _, crc = RECORD.unpack_from(data, at)
        end = at + RECORD.size + size
        if end > len(data):
            yield base + at - HEADER.size, 0, [], "torn"
            return
        payload = data[at + RECORD.size : end]
        if crc32c(data[at : at + 8] + payload) != crc:
            yield base + at - HEADER.size, 0, [], "corrupt"
            return
        yield base + at - HEADER.size, db, decode_args(payload), "ok"
        at = end


def read_segments(spark: SparkSession, path: str, corrupt: str = "refuse") -> DataFrame:
    """Records of every segment file, as a log; ``corrupt``: refuse or truncate. Torn tails are dropped."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = []
                for offset, db, args, status in decode_segment(bytes(content)):
                    if status == "corrupt" and corrupt == "refuse":
                        raise ValueError(f"{name}: corrupt record at offset {offset}")
                    if status == "ok":
                        rows.append((name, offset, db, args[0].decode().upper(), args[1:], status))
                yield pd.DataFrame(rows, columns=["path", "offset", "db", "verb", "args", "status"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, SCHEMA).select("offset", F.col("db").cast("int"), "verb", "args")
