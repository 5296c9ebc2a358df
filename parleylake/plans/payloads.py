"""Encoders of the binary formats, written from the formats' description and apart from the decoders, which the queries here put to the test."""

from __future__ import annotations

import json
import struct
import zlib


def wide(text: str) -> bytes:
    return text.encode("utf-16-le")


def locked(data: bytes) -> bytes:
    """Every byte inverted and combined with both halves of the length."""
    k = len(data) % 256 ^ len(data) // 256
    return bytes((255 - b) ^ k for b in data)


def field_list(*fields: tuple[int, str, bytes]) -> bytes:
    """A count and the fields (header, name, value)."""
    out = struct.pack("<H", len(fields))
    for header, name, value in fields:
        n = locked(wide(name))
        out += struct.pack("<BH", header, len(n)) + n + struct.pack("<I", len(value)) + value
    return out


def td_record(*fields: tuple[int, str, bytes]) -> bytes:
    return b"TD\x01\x01" + field_list(*fields)


def ta_record(*items: tuple[int, bytes]) -> bytes:
    return b"TA\x01\x01" + struct.pack("<I", len(items)) + b"".join(struct.pack("<BI", h, len(v)) + v for h, v in items)


def element(kind: int, *parts: tuple[int, bytes]) -> bytes:
    payload = b"".join(struct.pack("<BH", i, len(d)) + d for i, d in parts)
    return struct.pack("<BH", kind, len(payload)) + payload


def text_elements(text: str, most: int = 30_000) -> bytes:
    """Text elements; what does not fit the two-byte length goes into further elements, cut between characters."""
    return b"".join(element(1, (1, wide(text[i : i + most]))) for i in range(0, max(1, len(text)), most))


def header(time: int, rand: int) -> bytes:
    return b"MSG" + bytes(5) + struct.pack("<II", time, rand) + bytes(4)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n % 128 + 128)
        n //= 128
    return bytes([*out, n])


def wire(*fields: tuple[int, int | bytes]) -> bytes:
    """Wire fields: numbers as varints, bytes with their length."""
    return b"".join(varint(k * 8) + varint(v) if isinstance(v, int) else varint(k * 8 + 2) + varint(len(v)) + v for k, v in fields)


def fixed(number: int, value: int) -> bytes:
    return varint(number * 8 + 5) + struct.pack("<I", value)


def pack(*messages: bytes) -> bytes:
    items = b"".join(struct.pack("<I", len(m)) + m for m in messages)
    return struct.pack("<II", len(messages), len(items)) + items


def card(text: str, title: str) -> bytes:
    xml = "<?xml version='1.0'?><msg title='{}' brief=\"{}\" url='http://cards.example/{}'></msg>".format(title, text.replace('"', ""), title)
    return element(0x14, (1, b"\x01" + zlib.compress(xml.encode())))


def app(text: str) -> bytes:
    return element(0x1B, (1, wide(json.dumps({"app": "demo", "meta": {"b": {"title": "later"}, "a": [{"title": text}]}}))))


def entries(*named: tuple[str, bytes]) -> bytes:
    """The inner part of a key/value stream: a block that holds nothing wanted, and one with the named records."""
    body = b"".join(struct.pack(">I", len(n.encode())) + n.encode() + struct.pack(">I", len(v)) + v for n, v in named)
    return b"\x01" + struct.pack(">I", 3) + b"abc" + b"\x02" + struct.pack(">I", len(body)) + body


def sealed(plain: bytes, key: bytes) -> bytes:
    """The chained block cipher of 16 rounds: length of padding, padding, two salt bytes, data and seven zero bytes."""
    pad = (8 - (len(plain) + 10) % 8) % 8
    data = bytes([pad]) + bytes(pad + 2) + plain + bytes(7)
    a, b, c, d = struct.unpack(">4I", key)
    out, last_in, last_out = [], 0, 0
    for (block,) in struct.iter_unpack(">Q", data):
        mixed = block ^ last_out
        y, z, total = mixed >> 32, mixed & 0xFFFFFFFF, 0
        for _ in range(16):
            total = (total + 0x9E3779B9) % 2**32
            y = (y + (((z * 16 + a) ^ (z + total) ^ (z // 32 + b)) % 2**32)) % 2**32
            z = (z + (((y * 16 + c) ^ (y + total) ^ (y // 32 + d)) % 2**32)) % 2**32
        last_out, last_in = (y * 2**32 + z) ^ last_in, mixed
        out.append(struct.pack(">Q", last_out))
    return b"".join(out)


def sealed_file(inner: bytes, key: bytes) -> bytes:
    """A sealed key/value stream: a block that cannot be opened, then the compressed one."""
    block = sealed(zlib.compress(inner), key)
    return b"ES\x01\x03" + bytes(4) + bytes(4) + struct.pack(">I", 16) + bytes(16) + bytes(4) + struct.pack(">I", len(block)) + block


def compound_file(streams: list[tuple[str, bytes]], least: int = 4096) -> bytes:
    """A compound file of 512-byte sectors; streams under ``least`` bytes lie in the mini stream, in sectors of 64 bytes."""
    free, end = 0xFFFFFFFF, 0xFFFFFFFE
    small = bytearray()
    mini: list[int] = []
    places: dict[str, int] = {}
    for name, data in streams:
        if 0 < len(data) < least:
            n = -(-len(data) // 64)
            places[name] = len(mini)
            mini += [*range(len(mini) + 1, len(mini) + n), end]
            small += data.ljust(64 * n, b"\0")
    folder_sectors = -(-(len(streams) + 1) * 128 // 512)
    table: list[int] = []
    body = bytearray()

    def put(data: bytes) -> int:
        n = -(-len(data) // 512)
        first = len(table)
        table.extend([*range(first + 1, first + n), end])
        body.extend(data.ljust(512 * n, b"\0"))
        return first

    put(bytes(512 * folder_sectors))
    mini_table = put(struct.pack(f"<{len(mini)}I", *mini)) if mini else end
    mini_stream = put(bytes(small)) if small else end
    for name, data in streams:
        if len(data) >= least:
            places[name] = put(data)

    def entry(name: str, kind: int, right: int, child: int, first: int, size: int) -> bytes:
        n = wide(name) + b"\0\0"
        return n.ljust(64, b"\0") + struct.pack("<HBB3I", len(n), kind, 1, free, right, child) + bytes(36) + struct.pack("<IQ", first, size)

    folder = entry("Root Entry", 5, free, 1 if streams else free, mini_stream, len(small))
    for i, (name, data) in enumerate(streams, 1):
        folder += entry(name, 2, i + 1 if i < len(streams) else free, free, places.get(name, end), len(data))
    body[: len(folder)] = folder
    fat_sectors = 1
    while fat_sectors * 128 < len(table) + fat_sectors:
        fat_sectors += 1
    at = len(table)
    whole = [*table, *[0xFFFFFFFD] * fat_sectors]
    whole += [free] * (fat_sectors * 128 - len(whole))
    head = bytearray(512)
    head[:8] = bytes.fromhex("D0CF11E0A1B11AE1")
    struct.pack_into("<HHHHH", head, 24, 0x3E, 3, 0xFFFE, 9, 6)
    struct.pack_into("<8I", head, 44, fat_sectors, 0, 0, least, mini_table, len(mini) and -(-len(mini) * 4 // 512), end, 0)
    struct.pack_into("<109I", head, 76, *range(at, at + fat_sectors), *[free] * (109 - fat_sectors))
    return bytes(head) + bytes(body) + struct.pack(f"<{len(whole)}I", *whole)
