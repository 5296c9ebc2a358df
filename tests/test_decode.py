import os
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from parleylake.decode import message, proto, record, show, stores, tables


def keyed(text):
    return record.key(text.encode("utf-16-le"))


def td(*fields):
    out = record.TD + len(fields).to_bytes(2, "little")
    for header, name, value in fields:
        n = keyed(name)
        out += bytes([header]) + len(n).to_bytes(2, "little") + n + len(value).to_bytes(4, "little") + value
    return out


def ta(*items):
    return record.TA + len(items).to_bytes(4, "little") + b"".join(bytes([h]) + len(v).to_bytes(4, "little") + v for h, v in items)


def element(kind, *parts):
    payload = b"".join(bytes([i]) + len(d).to_bytes(2, "little") + d for i, d in parts)
    return bytes([kind]) + len(payload).to_bytes(2, "little") + payload


def text_element(text):
    return element(1, (1, text.encode("utf-16-le")))


def varint(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


HEADER = b"MSG" + bytes(5) + struct.pack("<II", 1_500_000_000, 77) + bytes(4)


@settings(max_examples=200)
@given(st.binary(max_size=300))
def test_length_key_is_its_own_inverse(data):
    assert record.unkey(record.key(data)) == data


def test_known_keyed_string():
    assert record.string_value(keyed("@pl 早上好")) == "@pl 早上好"
    assert record.string_value(b"") == "" and record.unkey(bytes(70_000)) == b""


def test_string_order():
    assert record.string_value(record.key(b"plain")) == "plain"
    assert record.string_value(record.key("好".encode("gb18030") + b"a")) == "好a"


@settings(max_examples=100)
@given(st.lists(st.tuples(st.sampled_from([1, 6, 8]), st.text("abc", min_size=1, max_size=6), st.text("xyz早", min_size=1, max_size=9)), max_size=6))
def test_fields_round_trip(fields):
    r = record.fields_of(td(*[(h, f"str{n}", keyed(v)) for h, n, v in fields])[4:])
    assert r.complete and [f.name for f in r.fields] == [f"str{n}" for _, n, _ in fields]
    assert [f.texts for f in r.fields if f.header == 8] == [[v] for h, _, v in fields if h == 8]


def test_cut_and_overlong_records():
    whole = td((8, "strNick", keyed("Owlet")), (1, "dwUin", struct.pack("<I", 4_000_000_000)))
    r = record.fields_of(whole[4:])
    assert r.fields[1].number == 4_000_000_000 and r.fields[1].texts == []
    assert not record.fields_of(whole[4:-1]).complete and len(record.fields_of(whole[4:-1]).fields) == 1
    assert record.fields_of(whole[4:] + b"x").complete is False and record.fields_of(b"\xff\xff").fields == []
    assert record.record_end(whole + b"zz", 0) == len(whole) and record.record_end(whole[:-1], 0) is None


def test_records_inside_records():
    inner = td((8, "strText", keyed("inside")))
    found = record.find_records(b"xx" + ta((3, inner), (4, b"")) + td((9, "bufX", inner)))
    assert [f.tag for f in found] == ["TA", "TA_ITEM", "TD", "TA_ITEM", "TD", "TD"]
    assert found[0].offset == 2


def test_proto_paths_and_limits():
    inner = bytes([8]) + varint(2**64 - 1) + bytes([0x12, 3]) + b"hi!"
    data = bytes([0x0A, len(inner)]) + inner + bytes([0x15, 1, 2, 3, 4])
    assert [(n.path, n.wire, n.varint, n.text) for n in proto.walk(data)] == [("1.1", 0, 2**64 - 1, ""), ("1.2", 2, None, "hi!"), ("1", 2, None, ""), ("2", 5, None, "")]
    assert proto.walk(data[:-1]) == [] and proto.walk(bytes([8, 1]) * 13) == [] and len(proto.walk(bytes([8, 1]) * 12)) == 12


def test_tags_are_big_endian():
    body = bytes([8, 5])
    t = proto.tagged(bytes([0x1D, 0, 2]) + body + bytes([7, 0, 0]) + bytes([0xFF, 0, 0]))
    assert [(x.tag, len(x.fields)) for x in t] == [(0x1D, 1), (7, 0)] and t[0].fields[0].path == "tlv29.1"


def test_elements_and_gaps():
    gap = "间隙文字".encode("utf-16-le")
    data = HEADER + text_element("hello") + element(0x0E) + gap + text_element("再见")
    es = message.elements(data)
    assert [e.type for e in es] == [1, 0x0E, 0, 1] and show.render(data)[0] == "hello间隙文字再见"
    assert message.header_of(data) == (1_500_000_000, 77)
    covered = sum(e.size for e in es)
    assert covered == len(data) - 20


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400))
def test_anything_parses(data):
    show.render(HEADER + data)
    record.find_records(data)
    proto.walk(data)
    proto.tagged(data)
    list(stores.compound_streams(stores.COMPOUND + data))
    list(stores.kv_entries(stores.PLAIN + data))


def test_media_and_cards():
    picture = element(3, (2, "UserDataImage:Group2\\ab\\x.JPG".encode("utf-16-le")))
    assert message.elements(picture)[0].kind() == "image" and show.render(picture)[1][0]["candidates"] == ["UserDataImage:Group2\\ab\\x.JPG"]
    xml = "<?xml version='1.0'?><msg brief=\"卡片\" url='http://x.example/a'></msg>"
    card = element(0x14, (1, b"\x01" + zlib.compress(xml.encode())))
    node = show.render(card)[1][0]
    assert node["text"] == "卡片" and node["href"] == "http://x.example/a"
    assert message.json_member('{"b":{"title":"deep"},"a":[{"title":"first"}]}', "title") == "first"


def test_forwarded_pack():
    items = [HEADER + text_element("one"), HEADER + text_element("two")]
    stream = struct.pack("<II", 2, sum(4 + len(i) for i in items)) + b"".join(struct.pack("<I", len(i)) + i for i in items)
    info = td((9, message.PACK, record.key(stream)))
    assert message.forwarded(info) == items and message.pack_items(stream + b"x") == [] and message.pack_items(stream[:-1]) == []


def test_hash_names():
    for _ in range(50):
        b = os.urandom(16)
        assert stores.name_hash(stores.hash_name(b).lower()) == b
    assert stores.hash_name(b"x") is None and stores.name_hash("]" * 23) is None and stores.name_hash("short") is None


def test_sealed_blocks():
    key = bytes(range(16))
    for n in range(40):
        data = os.urandom(n)
        assert stores.unseal(stores.seal(data, key), key) == data
    assert stores.unseal(b"x" * 15, key) is None and stores.key_of("00" * 16) is None and stores.key_of("01:" * 16) == b"\x01" * 16


def kv_body(**entries):
    body = b""
    for name, fields in entries.items():
        value = td(*fields)
        body += len(name).to_bytes(4, "big") + name.encode() + len(value).to_bytes(4, "big") + value
    return b"\x02" + len(body).to_bytes(4, "big") + body


def test_kv_streams():
    inner = b"\x01" + (3).to_bytes(4, "big") + b"abc" + kv_body(a=[(8, "strNick", keyed("Owlet"))], b=[(2, "cGender", b"\x01")])
    key = os.urandom(16)
    block = stores.seal(zlib.compress(inner), key)
    bad = bytes(4) + (16).to_bytes(4, "big") + bytes(16)
    sealed = b"ES\x01\x03" + bytes(4) + bad + bytes(4) + len(block).to_bytes(4, "big") + block
    for content, k in ((stores.PLAIN + inner, None), (sealed, key)):
        got = dict(stores.kv_entries(content, k))
        assert got["a"][0].texts == ["Owlet"] and got["b"][0].number == 1
    assert list(stores.kv_entries(sealed)) == [] and [n for n, _ in stores.kv_entries(sealed, key, {"b"})] == ["b"]


def compound(streams, cyclic=False):
    sectors, fat, entries = [], [], []

    def put(data):
        if not data:
            return stores.END
        first = len(sectors) + 2
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        for i, p in enumerate(parts):
            sectors.append(p)
            fat.append(first + i + 1 if i + 1 < len(parts) else (first if cyclic else stores.END))
        return first

    def entry(name, kind, left, right, child, first, size):
        n = name.encode("utf-16-le") + b"\0\0"
        return n.ljust(64, b"\0") + struct.pack("<HBB3I", len(n), kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", first, size)

    for i, (name, data) in enumerate(streams):
        entries.append(entry(name, 2, stores.FREE, i + 2 if i + 1 < len(streams) else stores.FREE, stores.FREE, put(data), len(data)))
    folder = entry("Root", 5, stores.FREE, stores.FREE, 1, stores.END, 0) + b"".join(entries)
    head = bytearray(512)
    head[:8] = stores.COMPOUND
    struct.pack_into("<HH", head, 30, 9, 6)
    struct.pack_into("<7I", head, 44, 1, 1, 0, 0, stores.END, 0, stores.END)
    struct.pack_into("<109I", head, 76, 0, *[stores.FREE] * 108)
    table = struct.pack("<128I", *([stores.END, stores.END, *fat] + [stores.FREE] * 128)[:128])
    return bytes(head) + table + folder.ljust(512, b"\0")[:512] + b"".join(sectors)


def test_compound_files():
    streams = [("one", b"a" * 700), ("two", b"b" * 512), ("three", b"")]
    assert dict(stores.compound_streams(compound(streams))) == dict(streams)
    assert dict(stores.compound_streams(compound(streams[:1], cyclic=True)))["one"] == b"a" * 700


def test_display():
    assert stores.display(b"Hi") == "Hi" and stores.display(bytes([0, 1, 2])) == "00 01 02" and stores.display(bytes(200)).endswith(" ...")


def test_as_tables(spark):
    df = spark.createDataFrame([(1, HEADER + text_element("好")), (2, None), (3, b"")], "id long, content binary")
    assert [(r.id, r.texts, r.error) for r in tables.message_elements(df, ["id"], "content").collect()] == [(1, ["好"], None)]
    assert {r.id: r.plain_text for r in tables.rendered(df, ["id"], "content").collect()} == {1: "好", 3: ""}

    def fails(raw):
        raise ValueError("no")

    assert [r.error for r in tables.flat_map(df, ["id"], "content", "x int", fails).collect()] == ["ValueError: no"] * 2


def test_labels_and_folding():
    from parleylake.decode import labels

    assert labels.face_label(0) == "[微笑]" and labels.face_label(104) == "[右太极]" and labels.face_label(212) == "[/qw]" and labels.face_label(150) == "[face:150]"
    face = element(2, (1, bytes([14])))
    inner = bytes([8, 99, 16, 7, 24, 5, 34, 6]) + b"quoted"
    wire = bytes([0xEA, 0x02, len(inner)]) + inner
    quote = element(0x19, (1, wire))
    es = message.elements(HEADER + text_element("@x") + text_element(" ") + quote + text_element("@y") + text_element(" ") + text_element("@y") + face + text_element("done"))
    assert message.quote_of(es[2]) == {"seq": 99, "sender": 7, "time": 5, "text": "quoted"}
    assert labels.folded(es) == {0, 1, 3, 4}
    assert show.plain_of(es) == f"@y{labels.face_label(14)}done"
    assert [n["type"] for n in show.nodes_of(es)] == ["quote", "mention", "text"]
    call = td((3, "wAvMsgType", b"\x01\x00"), (8, "bsMsgText", keyed("通话 01:10")))
    assert show.display(HEADER + call) == "通话 01:10"
    index = td(*[(8, n, keyed("x")) for n in ("bStructMsgVersion", "arrMMTMsgIndex", "arrPackets")])
    assert show.display(HEADER + index) == labels.SHOWN["index"] or labels.unshown_label(message.elements(HEADER + index)) == labels.SHOWN["index"]
    assert show.status(message.elements(HEADER + text_element("a") + element(0x0E))) == ["rendered", "ignored"]


def test_file_meta_titles_and_embedded_media():
    from parleylake.decode import labels

    e = message.elements(element(7, (2, "report.pdf".encode("utf-16-le")), (3, "2048Byte".encode("utf-16-le")), (4, b"0123456789abcdef0123456789abcdef")))[0]
    assert message.file_meta(e) == {"name": "report.pdf", "size": 2048, "uuid": "", "hash": "0123456789abcdef0123456789abcdef"}
    forward = message.elements(HEADER + ta(*[(8, keyed(f"line {i}")) for i in range(9)], (3, keyed("other"))))[0]
    assert message.title_previews(forward) == [f"line {i}" for i in range(6)]
    hidden = b"MSG" + bytes(17) + b"\xfe" + "UserDataImage:a.png".encode("utf-16-le") + bytes(4)
    assert message.embedded_media(hidden[21:]) == ["UserDataImage:a.png"] and show.display(hidden[21:]) in ("[图片]", "UserDataImage:a.png")


def test_nodes_of_each_kind():
    inner = text_element("inside") + text_element("!")
    data = HEADER + element(0x07, (0, b"\x00")) + element(0x0D, (1, "[emoji]".encode("utf-16-le"))) + element(0x0C, (1, "[微笑]".encode("utf-16-le"))) + element(0x1A, (1, b"\x00\x01"))
    nodes = {n["type"] for n in show.render(data)[1]}
    assert nodes >= {"emoji", "face"}
    nested = show.render(HEADER + bytes([0x10]) + len(inner).to_bytes(2, "little") + inner)
    assert nested[0] == "inside!" and nested[1][0]["type"] == "nested" and [c["text"] for c in nested[1][0]["children"]] == ["inside", "!"] and nested[2] == "<chat-nested>inside!</chat-nested>"
    link = td((8, "strLinkHttp", keyed("http://a.example/x")))
    e = bytes([1]) + len(link).to_bytes(2, "little") + link
    assert show.render(HEADER + e)[1][0] == {"type": "rich", "text": "http://a.example/x", "href": "http://a.example/x"}
    film = td((8, "strVideoFilePath", keyed("UserDataVideo:a.mp4")))
    assert show.render(HEADER + bytes([0x10]) + len(film).to_bytes(2, "little") + film)[1][0]["type"] == "video"
    bar = element(3, (2, "sysres:Misc\\BlueBar\\x.png".encode("utf-16-le")))
    assert show.render(HEADER + bar + text_element("a"))[:2] == ("a", [{"type": "text", "text": "a"}]) and show.status(message.elements(HEADER + bar)) == ["ignored"]
    chat = td((8, "title", keyed("群聊的聊天记录")), (8, "bsResId", keyed("res1")), (3, "dwMsgPackListSize", b"\x05\x00")) + ta((8, keyed("line one")))
    n = show.render(HEADER + bytes([0x1E]) + len(chat).to_bytes(2, "little") + chat)[1][0]
    assert (n["type"], n["text"], n["item_count"], n["expand_status"], [i["text"] for i in n["items"]]) == ("multi_msg", "群聊的聊天记录", 5, "external_mmp_required", ["line one"])


def test_html_is_escaped():
    picture = element(3, (2, 'UserDataImage:a"<b.png'.encode("utf-16-le")))
    assert show.render(HEADER + text_element("a<b>&") + picture)[2] == 'a&lt;b&gt;&amp;<chat-image data-src="UserDataImage:a&quot;&lt;b.png" data-candidates="UserDataImage:a&quot;&lt;b.png">[图片]</chat-image>'


def test_part_texts():
    assert message.part_text(7, 1, "ok".encode("utf-16-le")) == "ok" and message.part_text(7, 1, b"plain ascii") == "plain ascii"
    assert message.part_text(7, 1, bytes([0, 0xE1] * 8)) == "" and message.part_text(3, 1, "x.png".encode("utf-16-le")) == ""
