"""Variable-length integers and tagged fields, as two binary map formats use them."""

from __future__ import annotations

from collections.abc import Iterator


def read_uint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def zigzag(value: int) -> int:
    """Unsigned code to signed value."""
    return (value >> 1) ^ -(value & 1)


def read_int(data: bytes, at: int) -> tuple[int, int]:
    value, at = read_uint(data, at)
    return zigzag(value), at


def uint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def sint(value: int) -> bytes:
    return uint(value << 1 if value >= 0 else (-value << 1) - 1)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: integers, or bytes for delimited fields."""
    at = 0
    while at < len(data):
        key, at = read_uint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = read_uint(data, at)
        elif kind == 2:
            size, at = read_uint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def packed(data: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = read_uint(data, at)
        out.append(zigzag(v) if signed else v)
    return out


def undelta(values: list[int]) -> list[int]:
    total = 0
    return [total := total + v for v in values]


def delta(values: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *values], values)]


def field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return uint(number << 3) + uint(value & (1 << 64) - 1)
    return uint(number << 3 | 2) + uint(len(value)) + value


def packed_field(number: int, values: list[int], signed: bool = False) -> bytes:
    return field(number, b"".join(sint(v) if signed else uint(v) for v in values)) if values else b""
