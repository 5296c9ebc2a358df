"""Typed key/value records: length-keyed strings, fields, and records inside records."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from parleylake.decode.cursor import Cursor, Short

# Record markers, header kinds and the bounds that decide what is accepted.
TD, TA = b"TD\x01\x01", b"TA\x01\x01"
NUMBERS, STRING, BUFFER = {1: 4, 6: 4, 2: 1, 3: 2, 4: 2}, 8, 9
MOST_FIELDS, MOST_RECORDS, MOST_DEPTH, LONGEST_KEYED = 200, 400, 8, 0xFFFF
NUMERIC_NAME = re.compile(r"dw|[nbcwu]")
PATH_LIKE = re.compile(r"^(?:https?://|UserData|OSRoot:|sysres:)|[/\\]|\.(?:jpe?g|png|gif|webp|bmp|amr|mp3|wav|m4a|mp4|mov|pdf|docx?|xlsx?|zip|rar|7z)$", re.I)
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def reasonable(text: str, longest: int = 65536) -> bool:
    """Whether a decoded text is not empty, not too long, and free of control and replacement characters."""
    return 0 < len(text.encode("utf-8", "replace")) <= longest and "�" not in text and not _CONTROL.search(text)


@lru_cache(maxsize=256)
def _masked(mask: int) -> bytes:
    return bytes(b ^ mask for b in range(256))


def unkey(data: bytes) -> bytes:
    """Undo the key that depends on the length: every byte inverted and combined with both halves of the length."""
    n = len(data)
    if not 0 < n <= LONGEST_KEYED:
        return b""
    return data.translate(_masked(0xFF ^ (n & 0xFF) ^ (n >> 8)))


#: The same transformation applied twice gives the bytes back.
key = unkey


def wide_text(data: bytes) -> str:
    """Bytes as UTF-16LE without zero units, or ''."""
    if len(data) < 2 or len(data) % 2:
        return ""
    try:
        text = data.decode("utf-16-le")
    except UnicodeDecodeError:
        return ""
    return text if "\0" not in text and reasonable(text) else ""


def narrow_text(data: bytes) -> str:
    """Bytes as UTF-8 or else GB18030, or ''."""
    for encoding in ("utf-8", "gb18030"):
        try:
            text = data.decode(encoding)
        except UnicodeDecodeError:
            continue
        if reasonable(text):
            return text
    return ""


def string_value(data: bytes) -> str:
    """A keyed string: printable ASCII, else UTF-16LE, else UTF-8 or GB18030."""
    plain = unkey(data)
    if not plain:
        return ""
    if len(plain) <= 4096 and re.fullmatch(rb"[\t\n\r\x20-\x7e]+", plain):
        return plain.decode("ascii")
    return wide_text(plain) or narrow_text(plain)


def wide_runs(data: bytes, most: int = 32, high: range = range(0x80, 0x100)) -> list[str]:
    """Texts of at least four characters whose every second byte is one and the same high byte that masks the other."""
    found = [t for t in [string_value(data)] if t]
    at = 0
    while at + 1 < len(data) and len(found) < most:
        hi = data[at + 1]
        stop, text = at, bytearray()
        while hi in high and stop + 1 < len(data) and data[stop + 1] == hi:
            c = data[stop] ^ hi
            if c < 0x20 and c not in (9, 10, 13):
                break
            text.append(c)
            stop += 2
        if len(text) >= 4:
            t = narrow_text(bytes(text))
            if t and t not in found:
                found.append(t)
            at = stop
        else:
            at += 1
    return found


def path_like(text: str) -> bool:
    """Whether a text is a path, URL or long hex number, the only texts that buffers are searched for."""
    t = text.strip()
    return len(t) >= 4 and (PATH_LIKE.search(t) is not None or len(t) >= 16 and len(re.findall("[0-9a-fA-F]", t)) * 100 // len(t) >= 80)


@dataclass
class Field:
    header: int
    name: str
    value: bytes
    texts: list[str]

    @property
    def number(self) -> int | None:
        """The value as unsigned little-endian number, where the header says so and the width fits."""
        return int.from_bytes(self.value, "little") if NUMBERS.get(self.header) == len(self.value) else None


@dataclass
class Record:
    count: int = 0
    complete: bool = False
    fields: list[Field] = field(default_factory=list)
    left: int = 0


def field_texts(header: int, name: str, value: bytes) -> list[str]:
    if header in NUMBERS and NUMERIC_NAME.match(name):
        return []
    if header == STRING:
        return [t for t in [string_value(value)] if t]
    if header == BUFFER or name.startswith(("buf", "guid")):
        return [t for t in wide_runs(value) if path_like(t)]
    return []


def fields_of(data: bytes) -> Record:
    """A counted list of fields; complete if all are there and nothing is left over."""
    c = Cursor(data)
    try:
        r = Record(c.number(2))
    except Short:
        return Record()
    if r.count > MOST_FIELDS:
        return r
    try:
        for _ in range(r.count):
            header = c.number(1)
            name = string_value(c.take(c.number(2)))
            value = c.take(c.number(4))
            r.fields.append(Field(header, name, value, field_texts(header, name, value)))
        r.left = c.left()
        r.complete = r.left == 0
    except Short:
        pass
    return r


def issue_of(r: Record) -> str | None:
    """What is wrong with a list of fields: too_many_fields, partial_txdata (it ends too early) or txdata_trailer (bytes behind it)."""
    if r.count > MOST_FIELDS:
        return "too_many_fields"
    if len(r.fields) < r.count:
        return "partial_txdata"
    return "txdata_trailer" if r.left else None


def record_end(data: bytes, at: int) -> int | None:
    """Where the TD or TA record at a position ends, None where there is no whole one."""
    c = Cursor(data, at)
    try:
        mark = c.take(4)
        if mark == TD:
            n = c.number(2)
            if n > MOST_FIELDS:
                return None
            for _ in range(n):
                c.take(1)
                c.take(c.number(2))
                c.take(c.number(4))
        elif mark == TA:
            n = c.number(4)
            if n > 100_000:
                return None
            for _ in range(n):
                c.take(1)
                c.take(c.number(4))
        else:
            return None
    except Short:
        return None
    return c.at


@dataclass
class Found:
    """A record found in bytes: TD and TA records, and the items of TA records."""

    offset: int
    tag: str
    size: int
    record: Record | None = None
    header: int = 0
    texts: list[str] = field(default_factory=list)


_MARK = re.compile(rb"T[DA]\x01\x01")


def find_records(data: bytes, base: int = 0, depth: int = 0, out: list[Found] | None = None) -> list[Found]:
    """All records in bytes, those inside values included; the inner ones of a TD record come before it."""
    out = [] if out is None else out
    at = 0
    while depth <= MOST_DEPTH and len(out) < MOST_RECORDS:
        m = _MARK.search(data, at)
        if m is None:
            break
        start, end = m.start(), record_end(data, m.start())
        if end is None:
            at = start + 1
            continue
        body = data[start + 4 : end]
        if m.group() == TD:
            r = fields_of(body)
            for f in r.fields:
                find_records(f.value, base + start + 4, depth + 1, out)
            out.append(Found(base + start, "TD", end - start, r, texts=[] if r.fields else wide_runs(body)))
        else:
            c = Cursor(data, start + 4, end)
            n = c.number(4)
            out.append(Found(base + start, "TA", end - start, Record(min(n, 0xFFFF), True)))
            for _ in range(n):
                item, header = c.at, c.number(1)
                value = c.take(c.number(4))
                out.append(Found(base + item, "TA_ITEM", len(value), header=header, texts=wide_runs(value)))
                find_records(value, base + item + 5, depth + 1, out)
        at = max(end, start + 1)
    return out
