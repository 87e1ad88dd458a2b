"""Parquet footers as generic Thrift compact structures, enough to move encoded column chunks between files.

A struct is a list of [field id, type, value]; lists are (element type, values). Only what the compact protocol
defines is decoded, so fields of later format versions survive unchanged.
"""

from __future__ import annotations

import struct

MAGIC = b"PAR1"
# Type codes of the Thrift compact protocol.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)
# Field ids of the Parquet format's FileMetaData, RowGroup, ColumnChunk and ColumnMetaData.
FILE_ROWS, FILE_SCHEMA, FILE_GROUPS, FILE_CRYPTO = 3, 2, 4, 8
GROUP_CHUNKS, GROUP_ROWS, GROUP_OFFSET, GROUP_ORDINAL = 1, 3, 5, 7
CHUNK_PATH, CHUNK_OFFSET, CHUNK_META, CHUNK_INDEXES, CHUNK_CRYPTO = 1, 2, 3, (4, 5, 6, 7), (8, 9)
META_SIZE, META_DATA, META_INDEX, META_DICT, META_BLOOM = 7, 9, 10, 11, (14, 15)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (TRUE, FALSE):  # as an element; as a field the type is the value
            self.at += 1
            return self.data[self.at - 1]
        if kind == BYTE:
            self.at += 1
            return self.data[self.at - 1]
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == DOUBLE:
            self.at += 8
            return struct.unpack("<d", self.data[self.at - 8 : self.at])[0]
        if kind == BINARY:
            n = self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (LIST, SET):
            head = self.data[self.at]
            self.at += 1
            n = head >> 4
            if n == 15:
                n = self.varint()
            return head & 15, [self.value(head & 15) for _ in range(n)]
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"no type {kind} in a footer")

    def struct(self) -> list[list]:
        fields, last = [], 0
        while True:
            head = self.data[self.at]
            self.at += 1
            if not head:
                return fields
            kind = head & 15
            last = last + (head >> 4) if head >> 4 else self.zigzag()
            fields.append([last, kind, None if kind in (TRUE, FALSE) else self.value(kind)])


def _varint(n: int, out: bytearray) -> None:
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _zigzag(n: int, out: bytearray) -> None:
    _varint((n << 1) ^ (n >> 63), out)


def write_value(kind: int, v, out: bytearray) -> None:
    if kind in (TRUE, FALSE, BYTE):
        out.append(v)
    elif kind in (I16, I32, I64):
        _zigzag(v, out)
    elif kind == DOUBLE:
        out += struct.pack("<d", v)
    elif kind == BINARY:
        _varint(len(v), out)
        out += v
    elif kind in (LIST, SET):
        of, items = v
        if len(items) < 15:
            out.append(len(items) << 4 | of)
        else:
            out.append(0xF0 | of)
            _varint(len(items), out)
        for x in items:
            write_value(of, x, out)
    else:
        last = 0
        for fid, k, x in v:
            if 0 < fid - last < 16:
                out.append((fid - last) << 4 | k)
            else:
                out.append(k)
                _zigzag(fid, out)
            last = fid
            if k not in (TRUE, FALSE):
                write_value(k, x, out)
        out.append(0)


def field(s: list[list], fid: int, default=None):
    return next((f[2] for f in s if f[0] == fid), default)


def footer(data: bytes) -> list[list]:
    """The FileMetaData of a whole Parquet file's bytes."""
    if len(data) < 12 or data[:4] != MAGIC or data[-4:] != MAGIC:
        raise ValueError("not a plain Parquet file")
    n = int.from_bytes(data[-8:-4], "little")
    meta = Reader(data[-8 - n : -8]).struct()
    if field(meta, FILE_CRYPTO) is not None:
        raise ValueError("encrypted Parquet files can't be copied by blocks")
    return meta


def shape(meta: list[list]) -> bytes:
    """What two files must share for their blocks to go into one file: the encoded schema."""
    out = bytearray()
    write_value(LIST, field(meta, FILE_SCHEMA), out)
    return bytes(out)


def moved(meta: list[list], shift: int) -> list[list[list]]:
    """The row groups of meta with all offsets moved by shift, empty groups aside; page indexes and Bloom filters, whose
    content holds offsets of its own, are left out, as readers may do without them."""
    groups = [g for g in field(meta, FILE_GROUPS)[1] if field(g, GROUP_ROWS)]
    for g in groups:
        for f in g:
            if f[0] == GROUP_OFFSET:
                f[2] += shift
        g[:] = [f for f in g if f[0] != GROUP_ORDINAL]
        for chunk in field(g, GROUP_CHUNKS)[1]:
            if field(chunk, CHUNK_PATH) is not None or any(field(chunk, c) is not None for c in CHUNK_CRYPTO):
                raise ValueError("a column chunk lies in another file or is encrypted")
            chunk[:] = [f for f in chunk if f[0] not in CHUNK_INDEXES]
            for f in chunk:
                if f[0] == CHUNK_OFFSET and f[2]:
                    f[2] += shift
            m = field(chunk, CHUNK_META)
            m[:] = [f for f in m if f[0] not in META_BLOOM]
            for f in m:
                if f[0] in (META_DATA, META_INDEX, META_DICT) and f[2] > 0:
                    f[2] += shift
    return groups


def body_end(meta: list[list]) -> int:
    """Where the last encoded column chunk ends."""
    end = 4
    for g in field(meta, FILE_GROUPS)[1]:
        for chunk in field(g, GROUP_CHUNKS)[1]:
            m = field(chunk, CHUNK_META)
            starts = [o for o in (field(m, META_DATA), field(m, META_DICT), field(m, META_INDEX)) if o]
            end = max(end, min(starts, default=4) + field(m, META_SIZE))
    return end
