"""Message payloads: elements, forwarded packs, structured cards, and what they show."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from parleylake.decode.cursor import Cursor, Short
from parleylake.decode.faces import face_label
from parleylake.decode.proto import Node, Tagged, strings, tagged, walk
from parleylake.decode.record import TA, TD, Found, find_records, reasonable, record_end, unkey, wide_text

# Element types with their labels, types that may be empty, and the name of a forwarded pack.
LABELS = {
    0x01: "text", 0x02: "sysface", 0x03: "image", 0x05: "image", 0x06: "image", 0x07: "file_or_struct", 0x08: "message_metadata", 0x0C: "rich_context", 0x0D: "emoji", 0x0E: "layout_metadata",
    0x10: "public_account", 0x11: "file_or_struct", 0x12: "text_metadata", 0x14: "special_abstract", 0x15: "custom_data", 0x16: "custom_data", 0x18: "custom_data", 0x19: "custom_abstract",
    0x1A: "video", 0x1B: "ark_app", 0x1E: "multi_msg",
}
EMPTY_OK, HEADER, PACK = (0x0E, 0x12), b"MSG", "buffMsgPackListStream"
METADATA = (0x08, 0x0E, 0x12)
SCAN, GAP_FROM, GAP_MOST = 1024, 32, 512
MEDIA = re.compile(r"(?:UserData\w*|OSRoot|sysres):[^\s\x00]+|https?://\S+|[\w\-./\\:{}]+\.(?:jpe?g|png|gif|webp|bmp|mp4|mov|webm|amr|slk|mp3|wav|ogg|m4a|pdf|zip|rar|7z|docx?|xlsx?|pptx?|txt)", re.I)
KIND = [("voice", r"\.(?:amr|slk|mp3|wav|ogg|m4a)$"), ("video", r"\.(?:mp4|mov|webm|avi)$"), ("image", r"\.(?:jpe?g|png|gif|webp|bmp)$"), ("file", r"\.\w{2,4}$")]


@dataclass
class Part:
    id: int
    data: bytes
    text: str


@dataclass
class Element:
    offset: int
    type: int
    payload: bytes
    parts: list[Part] = field(default_factory=list)
    proto: list[Node] = field(default_factory=list)
    strings: list[str] = field(default_factory=list)
    tags: list[Tagged] = field(default_factory=list)
    records: list[Found] = field(default_factory=list)

    @property
    def size(self) -> int:
        """Bytes in the message, the element's own header included."""
        return len(self.payload) + (3 if self.type else 0)

    @property
    def label(self) -> str:
        return LABELS.get(self.type, "raw")

    def named(self, *names: str) -> tuple[int | None, list[str]]:
        """Number and texts of the first field with one of the names in a complete record."""
        for r in self.records:
            for f in r.record.fields if r.record and r.record.complete else ():
                if f.name in names:
                    return int.from_bytes(f.value, "little") if len(f.value) in (1, 2, 4, 8) and not f.texts else None, f.texts
        return None, []

    def said(self, *names: str) -> str:
        """The first text of the fields with one of the names."""
        return next((t.strip() for n in names for t in self.named(n)[1] if t.strip()), "")

    def texts(self) -> list[str]:
        """Everything readable in the element, each text once, in order."""
        out = [p.text for p in self.parts] + self.strings + [n.text for n in self.proto]
        for r in self.records:
            out += r.texts
            out += [t for f in (r.record.fields if r.record else ()) for t in f.texts]
        return list(dict.fromkeys(t for t in out if t))

    def media(self) -> list[str]:
        """References to stored media among the element's texts."""
        return list(dict.fromkeys(m.group() for t in self.texts() for m in MEDIA.finditer(t) if not re.search("文件|成功|取消", t)))

    def kind(self) -> str | None:
        """The kind of media the references show, voice before video before image before file."""
        refs = self.media()
        return next((k for k, p in KIND if any(re.search(p, r, re.I) for r in refs)), None)


_ODD = re.compile(r"[\ue000-\uf8ff\uac00-\ud7af\u1200-\u137f\ua000-\ua63f\u2c80-\u2cff\x00-\x08\x0b\x0c\x0e-\x1f]")


def plausible(text: str, longest: int = 4096) -> bool:
    """A reasonable text of which at most a twentieth are characters that wrong decoding brings about."""
    return reasonable(text, longest) and 20 * len(_ODD.findall(text)) <= len(text)


def part_text(kind: int, id: int, data: bytes) -> str:
    """The text of an element's part; pictures only have texts in part 2.

    Zero units do not count, and a tenth of the characters may be unprintable, as long as none is a control character.
    """
    if kind == 1 and id == 1:
        text = data.decode("utf-16-le", "replace").lstrip("".join(map(chr, range(9))) + "\x0b\x0c") if len(data) >= 2 and len(data) % 2 == 0 else ""
        return text if reasonable(text) else ""
    if kind in (3, 5, 6) and id != 2:
        return ""
    if len(data) >= 8 and re.fullmatch(rb"[\t\n\r\x20-\x7e]+", data):
        return data.decode("ascii") if len(data) <= 4096 else ""  # read as UTF-16 this would pass for Chinese
    if len(data) >= 2 and len(data) % 2 == 0:
        text = data.decode("utf-16-le", "ignore").replace("\0", "")
        if text and plausible(text):
            return text
    if len(data) >= 3 and 10 * len(re.findall(rb"[\t\n\r\x20-\x7e]", data)) >= 9 * len(data):
        text = data.replace(b"\0", b"").decode("utf-8", "replace")
        if plausible(text):
            return text
    return ""


def parts_of(kind: int, payload: bytes) -> list[Part]:
    """The parts (id, length, data) of a payload, as far as they fit."""
    c, out = Cursor(payload), []
    try:
        while c.left() >= 3:
            id = c.number(1)
            data = c.take(c.number(2))
            out.append(Part(id, data, part_text(kind, id, data)))
    except Short:
        pass
    return out


def element_end(data: bytes, at: int) -> int | None:
    """Where the element or bare record at a position ends; None where none begins."""
    if data.startswith((TD, TA), at):
        return record_end(data, at)
    if at + 3 > len(data):
        return None
    kind, n = data[at], int.from_bytes(data[at + 1 : at + 3], "little")
    if kind not in LABELS or (n < 3 and not (n == 0 and kind in EMPTY_OK)) or at + 3 + n > len(data):
        return None
    return at + 3 + n


def _full(offset: int, kind: int, payload: bytes) -> Element:
    e = Element(offset, kind, payload)
    if kind and not payload.startswith((TD, TA)):
        e.parts = parts_of(kind, payload)
    sources = [payload, *[p.data for p in e.parts]] if kind else []
    for s in sources:
        e.strings += strings(s)
        e.proto += walk(s)
        e.tags += [t for t in tagged(s) if t.fields]
    e.records = find_records(payload)
    return e


def _raw(data: bytes, at: int, end: int) -> Element | None:
    """Bytes between elements, kept if they can be read: not at the start, and not too many."""
    if not GAP_FROM <= at < end <= at + GAP_MOST:
        return None
    payload = data[at:end]
    text = wide_text(payload)
    if text and not text.isascii():
        return Element(at, 0, payload, [Part(0, payload, text)])
    parts = parts_of(0, payload)
    if parts and sum(3 + len(p.data) for p in parts) == len(payload) and any(p.text for p in parts):
        return Element(at, 0, payload, parts)
    return None


def _says_something(e: Element) -> bool:
    return bool(e.type in METADATA or e.parts or e.records or e.proto or e.strings or e.tags)


def elements(data: bytes) -> list[Element]:
    """The elements of a message payload.

    After an optional 20-byte header come elements (type, length, payload) and bare records. Where none begins, the next
    one within 1024 bytes is looked for; what lies between is kept if it can be read, else one byte is skipped.
    """
    at, out = 20 if len(data) >= 20 and data.startswith(HEADER) else 0, []
    while at + 3 <= len(data):
        end = element_end(data, at)
        near = re.search(rb"T[DA]\x01\x01", data[at : at + 12]) if data[at] == 1 else None
        if end is not None and near and near.start() and end - at >= 1027:
            at += near.start()  # a length that high in front of a record is part of something else
            continue
        if end is not None:
            bare = data.startswith((TD, TA), at)
            e = _full(at, 0 if bare else data[at], data[at:end] if bare else data[at + 3 : end])
            if _says_something(e):
                out.append(e)
                at = end
                continue
            raw = _raw(data, at, end)
            if raw:
                out.append(raw)
            at = end if raw or bare else at + 1
            continue
        stop = min(len(data), at + 1 + SCAN)
        following = next((i for i in range(at + 1, stop - 2) if element_end(data, i) is not None), len(data) if stop == len(data) else None)
        raw = _raw(data, at, following) if following else None
        if raw:
            out.append(raw)
            at = following
        else:
            at += 1
    return out


def header_of(data: bytes) -> tuple[int | None, int | None]:
    """(time, rand) of a message with a header."""
    if len(data) < 16 or not data.startswith(HEADER):
        return None, None
    return int.from_bytes(data[8:12], "little"), int.from_bytes(data[12:16], "little")


def pack_items(stream: bytes) -> list[bytes]:
    """The messages of a forwarded pack: (count, size, then each with its length). Anything amiss gives none."""
    c, out = Cursor(stream), []
    try:
        n, size = c.number(4), c.number(4)
        if not 0 < n <= 200 or size != c.left():
            return []
        for _ in range(n):
            item = c.take(c.number(4))
            if len(item) < 8 or not item.startswith(HEADER):
                return []
            out.append(item)
    except Short:
        return []
    return out if c.left() == 0 else []


def forwarded(info: bytes) -> list[bytes]:
    """The forwarded messages that the info of a message carries."""
    for r in find_records(info):
        for f in r.record.fields if r.record else ():
            if f.name == PACK:
                return pack_items(unkey(f.value))
    return []


def info_values(info: bytes) -> list[tuple[int, int, str, int | None, list[str]]]:
    """(record, field, name, number, texts) of the fields in a message's info; any 4 or 8 bytes count as a number."""
    out = []
    for i, r in enumerate(find_records(info)):
        for j, f in enumerate(r.record.fields if r.record else ()):
            out.append((i, j, f.name, int.from_bytes(f.value, "little") if len(f.value) in (4, 8) and not f.texts else None, f.texts))
    return out


def card_xml(data: bytes) -> str:
    """The XML of a structured card, which may be compressed and may follow a one-byte prefix; '' if there is none."""
    for raw in (data, data[1:]):
        for body in (raw, _inflated(raw)):
            for encoding in ("utf-8", "utf-16-le"):
                try:
                    text = body.decode(encoding)
                except UnicodeDecodeError:
                    continue
                if "<msg" in text or text.lstrip().startswith("<?xml"):
                    return text[text.index("<") :]
    return ""


def _inflated(data: bytes) -> bytes:
    try:
        return zlib.decompress(data) if data[:1] == b"\x78" else b""
    except zlib.error:
        return b""


def xml_attribute(xml: str, name: str) -> str:
    """The first value of an attribute, in double quotes if there is one so, else in single ones."""
    m = re.search(rf'\b{re.escape(name)}="([^"]*)"', xml) or re.search(rf"\b{re.escape(name)}='([^']*)'", xml)
    return m.group(1) if m else ""


def json_member(value: object, name: str) -> object:
    """The first member of a name: the object's own before those below, which come in the order of their names."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return None
    if isinstance(value, dict):
        if name in value:
            return value[name]
        below = [value[k] for k in sorted(value)]
    else:
        below = value if isinstance(value, list) else []
    return next((x for x in (json_member(v, name) for v in below if isinstance(v, (dict, list))) if x is not None), None)


def runs_of_text(data: bytes, shortest: int = 4) -> list[tuple[int, str]]:
    """(offset, text) of UTF-16LE runs of printable characters, each text once."""
    out: dict[str, int] = {}
    at = 0
    while at + 1 < len(data):
        end = at
        while end + 1 < len(data) and ((u := int.from_bytes(data[end : end + 2], "little")) in (9, 10, 13) or 0x20 <= u < 0xD800 or u >= 0xE000):
            end += 2
        if (end - at) // 2 >= shortest:
            t = data[at:end].decode("utf-16-le", "replace").strip()
            if t:
                out.setdefault(t, at)
            at = max(end, at + 2)
        else:
            at += 1
    return [(o, t) for t, o in out.items()]


# ------------------------------------------------------------------------------------------------ what it says

# Tokens that name an app or a store and are no text, the app id of file transfers, and its stand-in.
GENERIC = re.compile(r"platform$|com\.tencent\.|(?:UserDataImage|UserDataCustomFace|UserDataRoot|FaceStore|GlobalSysTemp|sysres):")
TRANSFER, FILE = "com.tencent.filetransfer", "[文件]"
DECORATION = re.compile(r"\s*sysres:misc[\\/]bluebar[\\/]", re.I)
IMAGE_PATH = re.compile(r"\.(?:jpe?g|png|gif|webp|bmp)$|^(?:UserDataImage|UserDataCustomFace):", re.I)


def is_decoration(e: Element) -> bool:
    """A picture of the program's own, which belongs to no message."""
    return e.type in (3, 5, 6) and any(p.id == 2 and DECORATION.match(p.text) for p in e.parts)


def meaningful(e: Element, longest: int) -> str:
    """The first text of an element's parts that is short enough and no generic token."""
    return next((p.text for p in e.parts if p.text and len(p.text.encode()) <= longest and not GENERIC.match(p.text)), "")


def wire_text(e: Element, longest: int) -> str:
    """The same among its wire fields, those of contexts first."""
    nodes = [n for t in e.tags for n in t.fields] + e.proto
    return next((n.text for n in nodes if n.text and len(n.text.encode()) <= longest and not GENERIC.match(n.text)), "")


def card_of(e: Element) -> str:
    """The XML of an element: of its payload, its parts, or a record field."""
    return next((x for x in (card_xml(d) for d in [e.payload, *[p.data for p in e.parts]]) if x), "") or e.said("strXmlInfo")


def card_text(xml: str, otherwise: str = "") -> str:
    return next((t for t in (xml_attribute(xml, a).strip() for a in ("brief", "m_resid", "title", "summary")) if t), "") or otherwise.strip() or ("[结构消息]" if xml.strip() else "")


def app_json(e: Element) -> object:
    return next((v for v in (_json(t) for t in [*e.named("meta")[1], *e.texts()] if t.lstrip().startswith("{")) if v is not None), None)


def _json(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None


def app_text(e: Element) -> str:
    meta = app_json(e)
    found = (json_member(meta, k) for k in ("prompt", "title", "desc", "tag")) if meta is not None else ()
    return e.said("prompt") or next((t.strip() for t in found if isinstance(t, str) and t.strip()), "") or e.said("desc", "view", "app")


def app_href(e: Element) -> str:
    meta = app_json(e)
    found = (json_member(meta, k) for k in ("jumpUrl", "source_url", "url")) if meta is not None else ()
    return next((t for t in found if isinstance(t, str) and t.startswith(("http://", "https://"))), "")


def _context_text(e: Element) -> str:
    said = next((p.text.strip() for p in e.parts if p.id == 1 and p.text.strip()), "")
    if said or e.parts:
        return said
    return " ".join(dict.fromkeys(t for _, t in runs_of_text(e.payload, 8) if re.search(r"[^\s!-/:-@\[-`{-~]", t)))


def _face(e: Element) -> str:
    if e.payload[:3] == b"\x01\x01\x00" and len(e.payload) > 3:
        return face_label(e.payload[3])
    said = meaningful(e, 80).removeprefix("/")
    return f"[{said}]" if said else ""


def _picture(e: Element) -> str:
    if is_decoration(e):
        return ""
    said = wire_text(e, 80) or next((p.text for p in e.parts if p.text and not IMAGE_PATH.search(p.text) and len(p.text.encode()) < 80), "")
    return said or ("[图片]" if e.payload.startswith((TD, TA)) or any(IMAGE_PATH.search(p.text) for p in e.parts) else "")


def _file(e: Element) -> str:
    pair = [t for t in (e.said("strTitle"), e.said("strSummary")) if t]
    card = card_text(card_of(e))
    return meaningful(e, 120) or card or " ".join(pair) or (FILE if any(p.text == TRANSFER for p in e.parts) else "")


def _chat(e: Element) -> str:
    return " ".join(t for t in (e.said("brief"), e.said("title")) if t) or meaningful(e, 160)


_SUMMARIES: dict[int, Callable[[Element], str]] = {
    0: lambda e: next((p.text for p in e.parts if p.text), ""),
    1: lambda e: e.said("strLinkHttp") or next((p.text for p in e.parts if p.id == 1 and p.text), ""),
    2: lambda e: e.said("strLinkHttp") or _face(e),
    **dict.fromkeys((3, 5, 6), _picture),
    **dict.fromkeys((0x07, 0x11), _file),
    0x0C: _context_text,
    0x0D: lambda e: meaningful(e, 32),
    0x10: lambda e: meaningful(e, 120),
    0x14: lambda e: card_text(card_of(e), meaningful(e, 160)) or wire_text(e, 160),
    **dict.fromkeys((0x15, 0x16, 0x18, 0x19), lambda e: meaningful(e, 160) or wire_text(e, 160)),
    0x1A: lambda e: "[视频]",
    0x1B: lambda e: app_text(e) or meaningful(e, 160),
    0x1E: _chat,
}


def summary(e: Element) -> str:
    """What an element says in a line of text; metadata says nothing."""
    return _SUMMARIES[e.type](e) if e.type in _SUMMARIES else ""


def _quote_score(n: Node) -> int:
    """How likely a text is the quoted one: longer and deeper ones are, control characters and internal names speak against it."""
    t = n.text.strip()
    return len(t) + 3 * n.path.count(".") - 80 * sum(ord(c) < 32 or 127 <= ord(c) < 160 for c in t) - 200 * (t.startswith("u_") and len(t) <= 32) + 20 * ("聊天记录" in t)


def quote_of(e: Element) -> dict | None:
    """seq, sender, time and text of the message that an element quotes."""
    values = {n: next((p.varint for p in e.proto if p.path.endswith(f"45.{n}") and p.varint is not None), None) for n in (1, 2, 3)}
    if values[1] is None:
        return None
    best = max((n for n in e.proto if n.text.strip() and "45" in n.path.split(".")), key=_quote_score, default=None)
    return {"seq": values[1], "sender": values[2], "time": values[3], "text": best.text if best else ""}


def file_meta(e: Element) -> dict:
    """name, size, uuid and hash of a file element, as far as its texts and wire fields tell.

    A size is a text ``<n>Byte``, else the largest number from 1 KB to 8 TB among the wire fields.
    """
    texts = e.texts()
    said = next((int(m.group(1)) for t in texts for m in [re.search(r"(\d+)\s*Byte", t)] if m), None)
    numbers = [n.varint for n in e.proto if n.varint is not None and 1024 <= n.varint < 1 << 43]
    name = next((re.split(r"[\\/:]", r)[-1] for r in e.media()), "")
    first = lambda p: next((m.group() for t in texts for m in [re.search(p, t)] if m), "")
    return {"name": name, "size": said if said is not None else max(numbers, default=None), "uuid": first(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"), "hash": first(r"(?<![0-9a-fA-F])[0-9a-fA-F]{32}(?![0-9a-fA-F])")}


def title_previews(e: Element, most: int = 6) -> list[str]:
    """The first lines of a forwarded chat: the texts of string items in its lists."""
    return [t for r in e.records if r.tag == "TA_ITEM" and r.header == 8 for t in r.texts[:1]][:most]


def embedded_media(data: bytes) -> list[str]:
    """References to media within text runs of a message, for messages whose elements show nothing."""
    return list(dict.fromkeys(m.group() for _, t in runs_of_text(data) for m in MEDIA.finditer(t)))


def media_label(refs: list[str]) -> str:
    """What stands for media in a text, by the kind of the references; '' for none."""
    kind = next((k for k, p in KIND if any(re.search(p, r, re.I) for r in refs)), None)
    return {"image": "[图片]", "video": "[视频]", "voice": "[语音]", "file": "[文件]"}.get(kind, "")
