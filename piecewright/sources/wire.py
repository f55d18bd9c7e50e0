"""A reader for the protobuf wire format, as far as model files need it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..errors import InvalidModelError


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = 0
    for shift in range(0, 70, 7):
        if at >= len(data):
            raise InvalidModelError("a number ends early")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
    raise InvalidModelError("a number is too long")


def fields(data: bytes | memoryview) -> Iterator[tuple[int, int | float | memoryview]]:
    """(field number, value) of a message in order: ints, 4-byte values as floats, and views of bytes."""
    data, at = memoryview(data), 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, kind = tag >> 3, tag & 7
        if not number:
            raise InvalidModelError("field number 0")
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = struct.unpack("<d", _cut(data, at, 8))[0], at + 8
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = _cut(data, at, size), at + size
        elif kind == 5:
            value, at = struct.unpack("<f", _cut(data, at, 4))[0], at + 4
        else:
            raise InvalidModelError(f"wire type {kind}")
        yield number, value


def _cut(data: memoryview, at: int, size: int) -> memoryview:
    if at + size > len(data):
        raise InvalidModelError("a field ends early")
    return data[at : at + size]


def signed(value: int) -> int:
    """An int32 from its varint."""
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value
