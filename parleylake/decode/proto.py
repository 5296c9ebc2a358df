"""Schemaless walks over protocol-buffer wire data and over tagged contexts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from parleylake.decode.cursor import Cursor, Short
from parleylake.decode.record import reasonable

MOST, DEEPEST, WIDEST = 500, 3, 4096


class Node(NamedTuple):
    path: str
    field: int
    wire: int
    varint: int | None
    data: bytes
    text: str


def _fields(data: bytes) -> list[tuple[int, int, int | None, bytes]] | None:
    """(field, wire, number, bytes) of data that is wire format throughout, else None."""
    c, out = Cursor(data), []
    try:
        while c.left():
            k = c.varint()
            number, wire = k >> 3, k & 7
            if not 0 < number <= 0x10000:
                return None
            if wire == 0:
                out.append((number, wire, c.varint(), b""))
            elif wire in (1, 5):
                out.append((number, wire, None, c.take(8 if wire == 1 else 4)))
            elif wire == 2:
                out.append((number, wire, None, c.take(c.varint())))
            else:
                return None
    except Short:
        return None
    return out


def plain_text(data: bytes, shortest: int = 1, longest: int = 500) -> str:
    if not shortest <= len(data) <= longest:
        return ""
    try:
        t = data.decode("utf-8")
    except UnicodeDecodeError:
        return ""
    return t if reasonable(t) else ""


def walk(data: bytes, path: str = "", depth: int = 0, out: list[Node] | None = None) -> list[Node]:
    """All fields with their dotted paths; the fields inside a value come before it.

    Data counts as wire format if it parses to its end within twelve fields, so that chance texts are not taken apart.
    """
    out = [] if out is None else out
    if depth > DEEPEST or len(data) < 2:
        return out
    fields = _fields(data)
    if not fields or len(fields) > 12:
        return out
    for number, wire, value, raw in fields:
        if len(out) >= MOST:
            break
        here = f"{path}.{number}" if path else str(number)
        if wire == 2 and len(raw) <= WIDEST:
            walk(raw, here, depth + 1, out)
        out.append(Node(here, number, wire, value, raw, plain_text(raw) if wire == 2 else ""))
    return out


def strings(data: bytes, depth: int = 0) -> list[str]:
    """Readable strings of length-delimited fields, two levels deep, as far as the data can be read."""
    c, out = Cursor(data), []
    try:
        for _ in range(80):
            if not c.left() or depth > 2:
                break
            k = c.varint()
            if k == 0 or k & 7 not in (0, 1, 2, 5):
                break
            if k & 7 == 0:
                c.varint()
            elif k & 7 == 2:
                raw = c.take(c.varint())
                t = plain_text(raw, 3, 300)
                out += [t] if t else []
                out += strings(raw, depth + 1)
            else:
                c.take(8 if k & 7 == 1 else 4)
    except Short:
        pass
    return out[:200]


@dataclass
class Tagged:
    offset: int
    tag: int
    data: bytes
    fields: list[Node]


def tagged(data: bytes) -> list[Tagged]:
    """Context entries (tag, big-endian length, data) up to the tag 0xff; those of the reserved tags are walked."""
    c, out = Cursor(data), []
    try:
        while c.left() >= 3 and len(out) < 160:
            at, tag = c.at, c.number(1)
            if tag == 0xFF:
                break
            value = c.take(c.number(2, "big"))
            out.append(Tagged(at, tag, value, walk(value, f"tlv{tag}") if tag in (0x1D, 0x21) else []))
    except Short:
        pass
    return out
