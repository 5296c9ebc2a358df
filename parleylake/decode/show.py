"""What a message shows: nodes with everything a viewer needs, their HTML, and the plain text."""

from __future__ import annotations

import re
from html import escape

from parleylake.decode.labels import TRANSPORT, expanded, field_names, folded, is_packet_index, unshown_label, with_suffixes
from parleylake.decode.message import (
    EMPTY_OK, FILE, KIND, METADATA, Element, app_href, app_text, card_of, card_text, elements, embedded_media, file_meta, is_decoration, media_label, quote_of, summary, title_previews, xml_attribute,
)
from parleylake.decode.record import issue_of

# Record fields that hold links, videos and pictures, and words of a file transfer's own messages.
LINKS, VIDEOS, PICTURES = ("strLinkHttp", "strMsgLink", "strLinkUrl", "c_strMsgLinkUrl"), ("strVideoFilePath", "strVideoThumbPath"), {"strPicInfoFileName", "bufPicInfoServerPath", "bufPicResId"}
TRANSFER_WORDS = re.compile("打开文件|打开所在文件夹|继续发送|到云端查看|撤回该文件")
MEDIA_KINDS = ("image", "video", "voice", "file")
RISKY = re.compile("[\ue000-\uf8fe\u1200-\u137f\u2c80-\u2cff\x00-\x08\x0b\x0c\x0e-\x1f]")
VIDEO = re.compile(r"[\\/]video[\\/]|\.(?:mp4|webm|mov)$", re.I)
#: Element types whose payload is never read as a message of its own.
NO_MESSAGE = {0, 1, 0x08, 0x0C, 0x0E, 0x12, 0x14, 0x18}
PLACE = "UserDataFileRecv:"


def kind_of(refs: list[str]) -> str | None:
    """The kind of media that references show in an audit, where videos come before voices."""
    order = sorted(KIND, key=lambda k: ("video", "voice", "image", "file").index(k[0]))
    return next((k for k, p in order if any(re.search(p, r, re.I) for r in refs)), None)


def links(e: Element) -> list[str]:
    return list(dict.fromkeys(t for n in LINKS for t in e.named(n)[1]))


def references(e: Element) -> list[str]:
    """The element's references to stored media, and where its received file may lie."""
    refs = e.media()
    if e.type in (0x10, 0x15, 0x16, 0x18):
        said = summary(e).strip()
        if said in refs and not re.match(r"UserData|[^\\/]*:", said):
            refs.append(PLACE + said)
    if e.type == 0x18:
        for n in e.proto:
            t = n.text.strip()
            if t.startswith(("/", "\\")) or re.fullmatch("[0-9a-fA-F]{16,}", t):
                refs += [t, PLACE + t]
    return list(dict.fromkeys(refs))


def videos(e: Element) -> list[str]:
    return list(dict.fromkeys([t for n in VIDEOS for t in e.named(n)[1]] + [r for r in e.media() if VIDEO.search(r)]))


def inside(e: Element) -> list[Element]:
    """The elements of a message that an element's payload is, if they say something that the element does not say itself."""
    said = summary(e).strip()
    if e.type in NO_MESSAGE or len(e.payload) < 6 or field_names(e) & TRANSPORT or (said and said not in e.media()) or any(n.path.endswith("37.17") for n in e.proto):
        return []
    children = elements(e.payload)
    visible = "".join(map(summary, children)).strip()
    return children if visible and visible != said else []


def _media(e: Element, refs: list[str], text: str = "") -> dict:
    kind = e.kind() or "file"
    node = {"type": kind, "text": text or media_label(refs) or FILE, "candidates": refs}
    return node | {"file_meta": file_meta(e)} if kind == "file" and e.type in (0x07, 0x11, 0x18) else node


def _link(e: Element, text: str, hrefs: list[str]) -> dict:
    return {"type": "rich", "text": text.strip() or hrefs[0], "href": hrefs[0]} | ({"hrefs": hrefs} if len(hrefs) > 1 else {})


def _said(text: str, kind: str = "text") -> dict:
    return {"type": kind, "text": text} if text else {}


def _text_node(e: Element, said: str) -> dict:
    refs = references(e)
    if links(e):
        return _link(e, said, links(e))
    if refs and (TRANSFER_WORDS.search(said) or not said.strip() or field_names(e) & PICTURES):
        return _media(e, refs, said.strip() if TRANSFER_WORDS.search(said) else "")
    if not said:
        return {}
    node = _said(said, "mention" if said.strip().startswith("@") and len(said.strip()) <= 64 else "text")
    uin = e.named("dwUin")[0] if node["type"] == "mention" else None
    return node if uin is None else node | {"uin": str(uin)}


def _face_node(e: Element, said: str) -> dict:
    if links(e):
        return _link(e, said, links(e))
    number = e.payload[3] if e.payload[:3] == b"\x01\x01\x00" and len(e.payload) > 3 else None
    files = {} if number is None else {"face_id": number, "candidates": [f"SysFaceResFileSystem:{number}.gif", f"SysFaceResFileSystem:apng\\{number}.png"]}
    return _said(said, "face") | files if said else {}


def _card_node(e: Element, said: str) -> dict:
    xml = card_of(e)
    short = next((p.text for p in e.parts if p.id == 2 and p.text), "")
    if xml:
        return {"type": "rich", "text": short or card_text(xml, said), "href": xml_attribute(xml, "url"), "xml": xml}
    return _media(e, references(e)) if references(e) else _said(short or said)


def _custom_node(e: Element, said: str) -> dict:
    """Quotes, faces of the newer kind, and media in custom data."""
    quote = quote_of(e)
    paths = [n.path for n in e.proto]
    if quote is not None:
        return {"type": "quote", "text": quote["text"], "seq": quote["seq"]} if quote["text"] else {}
    if said.strip() and any(re.match(r"(?:\w+\.)?53(?:\.|$)", p) for p in paths):
        return _said(said.strip(), "face")
    resource = next((t for t in e.strings if t.startswith("u_") and len(t) >= 8), "") if any(re.match(r"(?:\w+\.)?37(?:\.|$)", p) for p in paths) else ""
    if resource:
        return {"type": "face", "text": "[新系统表情]", "resource_id": resource}
    return _media(e, references(e)) if references(e) else {}


def _app_node(e: Element, said: str) -> dict:
    href = app_href(e)
    return {"type": "rich", "text": app_text(e), "href": href} if href else _said(said, "app")


def _chat_node(e: Element, said: str) -> dict:
    """A forwarded chat with its preview; without the pack of messages it cannot be shown in full."""
    previews = title_previews(e)
    if not said and not previews:
        return {}
    stored = {"res_id": e.said("bsResId"), "file_name": e.said("bsFileName")}
    size = e.named("dwMsgPackListSize")[0]
    return {
        "type": "multi_msg", "text": said or "[聊天记录]", **stored, "item_count": len(previews) if size is None else size, "preview_count": len(previews),
        "expand_status": "external_mmp_required" if any(stored.values()) else "inline_preview_only", "items": [_said(t, "multi_item") for t in previews],
    }


def _file_node(e: Element, said: str) -> dict:
    refs = references(e)
    return _media(e, refs, said) if refs else _said(said if said != FILE else "")


def _emoji_or_text(e: Element, said: str) -> dict:
    refs = references(e)
    return _media(e, refs, said) if refs else _said(said, "emoji" if said.startswith("SmallEmoji:") else "text")


_NODES = {
    0: lambda e, said: _media(e, references(e)) if references(e) else _said(said),
    1: _text_node, 2: _face_node, **dict.fromkeys((3, 5, 6), _emoji_or_text), **dict.fromkeys((0x07, 0x11, 0x18), _file_node),
    0x0C: lambda e, said: _said(said, "face" if re.fullmatch(r"\[[^\[\]]+\]", said) else "text"), 0x0D: lambda e, said: _said(said, "emoji"),
    **dict.fromkeys((0x10, 0x15, 0x16), lambda e, said: _media(e, references(e), said) if references(e) else {}),
    0x14: _card_node, 0x19: _custom_node, 0x1B: _app_node, 0x1E: _chat_node,
}


def nodes_of(es: list[Element]) -> list[dict]:
    """The nodes of a message: replies folded, packets opened, payloads that are messages of their own as nested nodes."""
    out: list[dict] = []
    hidden = folded(es)
    at = 0
    while at < len(es):
        e, here = es[at], at
        at += 1
        if here in hidden or is_decoration(e) or e.type in METADATA:
            continue
        if is_packet_index(e):
            children = expanded(es[here:])
            if children and children[0] is not e:
                packets = e.named("dwPacketCount")[0] or 0
                made = nodes_of(children)
                out += made if packets <= 1 else [{"type": "nested", "text": "[聊天记录]", "children": made, "raw_text": plain_of(children)}]
                break
        children = inside(e)
        if children:
            out.append({"type": "nested", "text": "[内嵌消息]", "children": nodes_of(children), "raw_text": plain_of(children)})
        elif videos(e):
            out.append({"type": "video", "text": "[视频]", "candidates": videos(e)})
        elif e.type in _NODES:
            said = summary(e)
            if e.type == 1 and not links(e):
                said, at = with_suffixes(es, here, hidden)
            node = _NODES[e.type](e, said)
            if node:
                out.append(node)
    if not out:
        label = unshown_label(es)
        return [_said(label, "system")] if label else []
    return out


def plain_of(es: list[Element]) -> str:
    """The text of a message: what its elements say, without quotes, decoration and layout; a label where they say nothing."""
    out: list[str] = []
    hidden = folded(es)
    for i, e in enumerate(es):
        if i in hidden or is_decoration(e) or e.type in METADATA:
            continue
        if e.type == 0x19:
            node = _custom_node(e, summary(e))
            out.append(node["text"] if node.get("type") == "face" else "")
        elif is_packet_index(e) and expanded(es[i:])[:1] not in ([e], []):
            out.append(plain_of(expanded(es[i:])))
            break
        else:
            children = inside(e)
            out.append(plain_of(children) if children else summary(e) or next((r for r in e.media() if r.startswith(("http://", "https://"))), ""))
    return "".join(out) or unshown_label(es)


def html_of(nodes: list[dict], prefix: str = "chat-") -> str:
    """Nodes as HTML: an element per node named by its kind, references as attributes, nested nodes inside theirs; texts stay texts."""
    out = []
    for n in nodes:
        kind, text = n["type"], escape(n.get("text", ""))
        attributes = {"href": n.get("href"), "data-src": (n.get("candidates") or [None])[0], "data-candidates": "|".join(n.get("candidates") or []), "data-res-id": n.get("resource_id") or n.get("res_id"), "data-file-name": n.get("file_name"), "data-uin": n.get("uin"), "data-seq": n.get("seq")}
        if kind == "text":
            out.append(text)
            continue
        name = prefix + {"rich": "link", "multi_msg": "multi-msg", "multi_item": "multi-item"}.get(kind, kind)
        inner = html_of(n["children"], prefix) if "children" in n else text + html_of(n.get("items", []), prefix)
        out.append(f"<{name}" + "".join(f' {k}="{escape(str(v))}"' for k, v in attributes.items() if v not in (None, "")) + f">{inner}</{name}>")
    return "".join(out)


def render(data: bytes) -> tuple[str, list[dict], str]:
    """(plain text, nodes, HTML) of a message payload."""
    es = elements(data)
    nodes = nodes_of(es)
    return plain_of(es), nodes, html_of(nodes)


def display(data: bytes) -> str:
    """The text a message shows, and where it has none, what stands for the media that its bytes refer to."""
    return plain_of(elements(data)) or media_label(embedded_media(data))


def status(es: list[Element]) -> list[str]:
    """rendered, ignored or unclassified for each element."""
    hidden = folded(es)
    out = []
    for i, e in enumerate(es):
        if i in hidden or is_decoration(e) or e.type in METADATA or e.type in EMPTY_OK or field_names(e) & TRANSPORT or any(n.path.endswith("37.17") for n in e.proto):
            out.append("ignored")
        else:
            out.append("rendered" if inside(e) or videos(e) or (e.type in _NODES and _NODES[e.type](e, summary(e))) else "unclassified")
    return out


def all_nodes(nodes: list[dict]) -> list[dict]:
    return [x for n in nodes for x in (n, *all_nodes(n.get("children", [])), *all_nodes(n.get("items", [])))]


def issues(data: bytes) -> list[str]:
    """What is wrong with what a message shows, each issue once.

    empty_text_and_nodes, blank_text, suspicious_text, unrendered_media (a reference in no node), rich_empty_href,
    missing_candidates and type_mismatch (media nodes without references, or with those of another kind), and
    partial_txdata and txdata_trailer for records inside.
    """
    es = elements(data)
    text, nodes = plain_of(es), nodes_of(es)
    flat = all_nodes(nodes)
    shown = "\n".join(str(v) for n in flat for v in (n.get("text"), n.get("href"), n.get("xml"), *(n.get("candidates") or [])))
    refs = [r for i, e in enumerate(es) if i not in folded(es) and not is_decoration(e) for r in e.media()]
    lost, risky = text.count("\ufffd"), len(RISKY.findall(text))
    found = {
        "empty_text_and_nodes": not text and not nodes, "blank_text": bool(nodes) and not text.strip(),
        "suspicious_text": lost > 0 or (risky >= 2 and risky * 100 // len(text) > 12), "unrendered_media": any(r not in shown for r in refs),
        "rich_empty_href": any(n["type"] == "rich" and not n.get("href") for n in flat),
        "missing_candidates": any(n["type"] in MEDIA_KINDS and not n.get("candidates") for n in flat),
        "type_mismatch": any(n["type"] in MEDIA_KINDS and n.get("candidates") and kind_of(n["candidates"]) not in (None, n["type"]) for n in flat),
    }
    wrong = {issue_of(r.record) for e in es for r in e.records if r.record and r.tag == "TD"} - {None}
    return [k for k, v in found.items() if v] + sorted(wrong)
