"""Reading bytes front to back."""

from __future__ import annotations


class Short(Exception):
    """There are fewer bytes than asked for."""


class Cursor:
    """A position in bytes; every read either succeeds whole or raises Short and leaves the position."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None) -> None:
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def left(self) -> int:
        return self.end - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.left():
            raise Short
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, width: int, order: str = "little") -> int:
        return int.from_bytes(self.take(width), order)

    def varint(self) -> int:
        """A base-128 number of at most ten bytes, modulo 2^64."""
        value = 0
        for i in range(10):
            b = self.number(1)
            value |= (b & 0x7F) << (7 * i)
            if b < 0x80:
                return value & 0xFFFFFFFFFFFFFFFF
        raise Short
