"""Files that hold other things: key/value streams, compound files, and hashes in file names."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from parleylake.decode.cursor import Cursor, Short
from parleylake.decode.record import TA, TD, Field, fields_of, narrow_text

# The digits of file-name hashes, the cipher's constants, file marks and special sectors.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ~@$%`(){}[]_"
DELTA, ROUNDS = 0x9E3779B9, 16
PLAIN, SEALED = b"ES\x01\x01", (b"ES\x01\x02", b"ES\x01\x03")
COMPOUND = bytes.fromhex("d0cf11e0a1b11ae1")
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


def hash_name(data: bytes) -> str | None:
    """16 bytes as 23 base-48 digits, least first."""
    if len(data) != 16:
        return None
    n, out = int.from_bytes(data, "little"), []
    for _ in range(23):
        n, d = divmod(n, 48)
        out.append(DIGITS[d])
    return "".join(out)


def name_hash(text: str) -> bytes | None:
    """The 16 bytes behind 23 base-48 digits, letter case aside; None for anything else."""
    if len(text) != 23 or any(c not in DIGITS for c in text.upper()):
        return None
    n = sum(DIGITS.index(c) * 48**i for i, c in enumerate(text.upper()))
    return n.to_bytes(16, "little") if n < 1 << 128 else None


def key_of(text: str) -> bytes | None:
    """A 16-byte key from hex, separators aside; the zero key is none."""
    digits = "".join(c for c in text if c not in " :-")
    try:
        raw = bytes.fromhex(digits)
    except ValueError:
        return None
    return raw if len(raw) == 16 and any(raw) else None


def _block(half: tuple[int, int], k: tuple[int, ...], forward: bool) -> tuple[int, int]:
    y, z = half
    m = 0xFFFFFFFF
    for i in range(ROUNDS):
        if forward:
            s = DELTA * (i + 1) & m
            y = y + ((z << 4) + k[0] ^ z + s ^ (z >> 5) + k[1]) & m
            z = z + ((y << 4) + k[2] ^ y + s ^ (y >> 5) + k[3]) & m
        else:
            s = DELTA * (ROUNDS - i) & m
            z = z - ((y << 4) + k[2] ^ y + s ^ (y >> 5) + k[3]) & m
            y = y - ((z << 4) + k[0] ^ z + s ^ (z >> 5) + k[1]) & m
    return y, z


def unseal(cipher: bytes, key: bytes, salt: int = 2) -> bytes | None:
    """The plain bytes of a chained block cipher: padding length in the first byte, salt, data, seven zero bytes."""
    if len(cipher) < 16 or len(cipher) % 8 or len(key) != 16:
        return None
    k, blocks = struct.unpack(">4I", key), [struct.unpack_from(">2I", cipher, i) for i in range(0, len(cipher), 8)]
    plain, state, before = bytearray(), (0, 0), (0, 0)
    for b in blocks:
        state = _block((state[0] ^ b[0], state[1] ^ b[1]), k, False)
        plain += struct.pack(">2I", state[0] ^ before[0], state[1] ^ before[1])
        before = b
    first = 1 + (plain[0] & 7) + salt
    return bytes(plain[first:-7]) if first + 7 <= len(plain) else None


def seal(plain: bytes, key: bytes, salt: bytes = b"\x00\x00") -> bytes:
    """The counterpart of unseal, for tests and for writing."""
    pad = -(len(plain) + 1 + len(salt) + 7) % 8
    data = bytes([pad]) + bytes(pad) + salt + plain + bytes(7)
    k, out, state, before = struct.unpack(">4I", key), b"", (0, 0), (0, 0)
    for i in range(0, len(data), 8):
        p = struct.unpack_from(">2I", data, i)
        mixed = (p[0] ^ before[0], p[1] ^ before[1])
        coded = _block(mixed, k, True)
        before = (coded[0] ^ state[0], coded[1] ^ state[1])
        state = mixed
        out += struct.pack(">2I", *before)
    return out


def _inner(data: bytes, wanted: set[str] | None) -> Iterator[tuple[str, list[Field]]]:
    c = Cursor(data)
    try:
        while c.left() >= 5:
            tag, body = c.number(1), None
            n = c.number(4, "big")
            if n == 0:
                return
            body = Cursor(c.take(n))
            if tag != 2:
                continue
            try:
                while body.left() >= 8:
                    name = body.take(body.number(4, "big")).decode("utf-8", "replace")
                    value = body.take(body.number(4, "big"))
                    if (wanted is None or name in wanted) and value.startswith((TD, TA)):
                        fields = fields_of(value[4:]).fields
                        if fields:
                            yield name, fields
            except Short:
                pass
    except Short:
        return


def kv_entries(content: bytes, key: bytes | None = None, wanted: set[str] | None = None) -> Iterator[tuple[str, list[Field]]]:
    """(entry name, fields) of a key/value stream, plain or in sealed and compressed blocks.

    Blocks that cannot be opened are skipped. ``wanted`` names leave all other values undecoded.
    """
    if content.startswith(PLAIN):
        yield from _inner(content[4:], wanted)
        return
    if not content.startswith(SEALED) or key is None:
        return
    c = Cursor(content, 8)
    try:
        while c.left() >= 8:
            c.take(4)
            n = c.number(4, "big")
            if n == 0:
                return
            opened = unseal(c.take(n), key)
            try:
                inner = zlib.decompress(opened) if opened else b""
            except zlib.error:
                continue
            yield from _inner(inner, wanted)
    except Short:
        return


def compound_streams(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, data) of the streams of a compound file with 512-byte sectors; broken and cyclic chains end early."""
    if not content.startswith(COMPOUND) or len(content) < 512 or struct.unpack_from("<H", content, 30)[0] != 9:
        return
    u32 = lambda at: struct.unpack_from("<I", content, at)[0]
    sector = lambda n: content[512 * (n + 1) : 512 * (n + 2)]
    mini = 1 << struct.unpack_from("<H", content, 32)[0]
    last = len(content) // 512 - 1

    def chain(first: int, table: list[int], most: int) -> Iterator[int]:
        seen: set[int] = set()
        while first not in (FREE, END) and first <= most and first not in seen:
            seen.add(first)
            yield first
            first = table[first] if first < len(table) else END

    fat_at = [u32(76 + 4 * i) for i in range(109)]
    more, visited = u32(68), set()
    while more not in (FREE, END) and more <= last and more not in visited:
        visited.add(more)
        ids = struct.unpack("<128I", sector(more).ljust(512, b"\xff"))
        fat_at += ids[:127]
        more = ids[127]
    fat: list[int] = []
    for n in dict.fromkeys(x for x in fat_at if x <= last):
        fat += struct.unpack("<128I", sector(n).ljust(512, b"\xff"))
    read = lambda first: b"".join(sector(n) for n in chain(first, fat, last))
    folder = read(u32(48))
    entries = []
    for at in range(0, len(folder) - 127, 128):
        e = folder[at : at + 128]
        size = struct.unpack_from("<H", e, 64)[0]
        entries.append((e[: max(0, size - 2)].decode("utf-16-le", "replace"), e[66], *struct.unpack_from("<3I", e, 68), struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<Q", e, 120)[0]))
    if not entries:
        return
    small = read(entries[0][5])[: entries[0][6] or None]
    raw = read(u32(60))
    mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    seen: set[int] = set()
    waiting = [(entries[0][4], "")]
    while waiting:
        n, path = waiting.pop()
        if n >= len(entries) or n in seen:
            continue
        seen.add(n)
        name, kind, left, right, child, first, size = entries[n]
        waiting += [(left, path), (right, path)]
        full = f"{path}/{name}" if path else name
        if kind == 2:
            data = b"".join(small[mini * i : mini * (i + 1)] for i in chain(first, mini_fat, len(mini_fat))) if size < u32(56) else read(first)
            yield full, data[:size]
        elif kind in (1, 5):
            waiting.append((child, full))


def display(data: bytes, most: int = 160) -> str:
    """Bytes for people: UTF-8, UTF-16LE or GB18030 if they read well, else the first bytes in hex."""
    from parleylake.decode.record import wide_text

    for text in (narrow_text(data) if _is_utf8(data) else "", wide_text(data), narrow_text(data)):
        if text and sum(c.isprintable() or c in "\n\r\t" for c in text) == len(text):
            return text
    return data[:most].hex(" ") + (" ..." if len(data) > most else "")


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True
