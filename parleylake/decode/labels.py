"""Labels and folding rules of message elements: faces, calls, transport, styles, replies."""

from __future__ import annotations

from parleylake.decode.faces import FACES, face_label
from parleylake.decode.message import Element, elements, quote_of, summary

# Names of record fields that tell transport data, calls and system messages, and what is shown for them.
PACKET_INDEX = {"bStructMsgVersion", "arrMMTMsgIndex", "arrPackets"}
TRANSPORT = {"arrPackets", "C2CSessionData", "dwConnTime", "dwServerTime", "dwMsgSeq", "dwBeginSeq", "dwEndSeq", "dwPacketSeq", "dwPacketCount", "dwPacketIndex", "nSessionType"}
CALL = {"wAvMsgType", "bVideo", "nMsgContentType"}
UNSHOWN_TEXT = {"bsAbstractText", "MSGBOX_bsPreviewMsgText", "bsMsgText"}
SHOWN = {"index": "[无可见正文：MMT包索引]", "call": "[音视频通话]", "system": "[系统消息]", "transport": "[无可见正文：传输元数据]"}
STYLED = (0x14, 0x18, 0x19)
LONGEST_MENTION = 64


def field_names(e: Element) -> set[str]:
    """Names of the fields in an element's complete records."""
    return {f.name for r in e.records if r.record and r.record.complete for f in r.record.fields}


def is_packet_index(e: Element) -> bool:
    return field_names(e) >= PACKET_INDEX


def call_label(e: Element) -> str:
    """What a call message says, or that it is one."""
    said = e.named("bsMsgText")[1]
    return next((t.strip() for t in said if t.strip()), "") or (SHOWN["call"] if field_names(e) & CALL else "")


def unshown_label(es: list[Element]) -> str:
    """What stands for a message that shows nothing: packet index, call, system message or transport data; '' for none of these."""
    if any(is_packet_index(e) for e in es):
        return SHOWN["index"]
    call = next((c for c in map(call_label, es) if c), "")
    if call:
        return call
    silent = [f for e in es for r in e.records if r.record and r.record.complete for f in r.record.fields if f.name in UNSHOWN_TEXT and f.value and not f.texts]
    if silent:
        return SHOWN["system"]
    return SHOWN["transport"] if any(field_names(e) & TRANSPORT for e in es) else ""


def expanded(es: list[Element]) -> list[Element]:
    """Elements with packet indexes opened: the index's payload and all that follows, read again as one stream."""
    at = next((i for i, e in enumerate(es) if is_packet_index(e)), None)
    if at is None:
        return es
    stream = es[at].payload + b"".join(e.payload if e.type == 0 else bytes([e.type]) + len(e.payload).to_bytes(2, "little") + e.payload for e in es[at + 1 :])
    return es[:at] + [e for e in elements(stream) if not (e.offset == 0 and is_packet_index(e))]


def _mention(e: Element) -> str:
    t = summary(e).strip() if e.type == 1 else ""
    return t if t.startswith("@") and len(t) <= LONGEST_MENTION else ""


def folded(es: list[Element]) -> set[int]:
    """Positions that a reply hides: blank texts and mentions right before the quote, and a mention repeated after it."""
    blank = [e.type == 1 and not summary(e).strip() for e in es]
    said = [_mention(e) for e in es]
    hidden: set[int] = set()
    for i, e in enumerate(es):
        if e.type != 0x19 or quote_of(e) is None:
            continue
        lead = i
        while lead and (blank[lead - 1] or said[lead - 1]):
            lead -= 1
        hidden |= set(range(lead, i))
        again = i + 2
        while again < len(es) and blank[again]:
            again += 1
        if again < len(es) and said[i + 1] and said[i + 1] == said[again].strip():
            hidden |= set(range(i + 1, again))
    return hidden


def with_suffixes(es: list[Element], at: int, hidden: set[int]) -> tuple[str, int]:
    """The text of an element and the position behind it; faces right after a mention belong to its text."""
    text, following = summary(es[at]), at + 1
    while _mention(es[at]) and following < len(es) and following not in hidden and es[following].type in (2, 0x0D) and summary(es[following]):
        text += summary(es[following])
        following += 1
    return text, following


def style_ids(es: list[Element]) -> list[int]:
    """Bubble styles named in the wire fields of custom elements."""
    return [n.varint for e in es if e.type in STYLED for n in e.proto if n.path.endswith("37.17") and n.varint is not None]
