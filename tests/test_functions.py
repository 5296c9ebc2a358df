import pytest
from pyspark.sql import functions as F

from parleylake.functions import media, names, text, urls


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{c} string" for c in "abcd"[: len(values)]))
    return df.select(column.alias("x")).first().x


@pytest.fixture(autouse=True)
def columns(spark):
    globals().update({c.upper(): F.col(c) for c in "abcd"})


def test_names(spark):
    assert one(spark, text.usable_name(A, B, C), "Owlet", "1", "2") and not one(spark, text.usable_name(A, B, C), " (123) ", "1", "2")
    for bad in ("", " ", "1", "2", "456", "()"):
        assert not one(spark, text.usable_name(A, B, C), bad, "1", "2")
    assert one(spark, text.usable_name(A, B, C), None, "1", "2") is False
    assert one(spark, text.sender_show_name(A, B, C, D), "零度 (77)", "77", "1", "9") == "零度"
    assert one(spark, text.sender_show_name(A, B, C, D), "(77)", "77", "1", "9") == ""
    assert one(spark, text.with_mail_of(A, B), "m", "x<a@b>") == "m<a@b>" and one(spark, text.with_mail_of(A, B), "m<a@b>", "x<a@b>") == "m<a@b>"
    assert one(spark, text.usable_label(A, B), "x" * 81, "1") is False and one(spark, text.usable_label(A, B), "a/b", "1") is False
    assert one(spark, text.first_nonempty(A, B), "", "b") == "b"


def test_keys(spark):
    assert one(spark, names.name_key(A), " ＳtrＮick\t​") == "strnick"
    assert one(spark, names.path_key(A), r"USERDATA\\Image/./a.JPG ") == "userdata/image/a.jpg"
    for t, n in (("007", 7), (" 0x1f\n", 31), ("0X10", 16), ("-1", None), ("1.5", None), ("", None), ("9" * 39, None)):
        got = one(spark, names.whole_number(A), t)
        assert (int(got) if got is not None else None) == n


def test_text(spark):
    assert one(spark, text.suspicious_score(A), "a�b�") == 2 and one(spark, text.suspicious_score(A), "\x01\x02ab") == 2
    assert one(spark, text.suspicious_score(A), "\x01" + "a" * 50) == 0 and one(spark, text.suspicious_score(A), None) == 0
    assert one(spark, text.html_unescape(text.html_escape(A)), "<a href='x'>\"&amp;") == "<a href='x'>\"&amp;"
    assert one(spark, text.spaced_hex(F.encode(A, "UTF-8"), 2), "abc") == "61 62 ..." and one(spark, text.spaced_hex(F.encode(A, "UTF-8")), "ab") == "61 62"
    assert bytes(one(spark, text.lenient_unhex(A), "61-62:6")) == b"ab"
    assert one(spark, text.csv_cell(A), 'a"b') == '"a""b"' and one(spark, text.csv_cell(A), "a b") == "a b" and one(spark, text.csv_cell(A), None) == ""
    assert one(spark, text.tsv_cell(A), "a\tb\n") == "a b "
    assert one(spark, text.safe_file_name(A), "a/b:c") == "a_b_c" and one(spark, text.safe_file_name(A), "...") == "unnamed"
    assert one(spark, text.iso_time(A.cast("long")), "0") == "1970-01-01 00:00:00" and one(spark, text.iso_time(A.cast("long")), str(10**15)) == ""
    assert one(spark, text.likely_role(A), "Msg3_index.db") == "message/chat related, search/index related" and one(spark, text.likely_role(A), "x") == "unknown from name alone"
    assert one(spark, text.matches_all(A, 'The "red fox"'), "the quick RED fox") and not one(spark, text.matches_all(A, "fo"), "fox")


def test_urls(spark):
    assert one(spark, urls.percent_decode(A), "a%20b+c") == "a b+c" and one(spark, urls.percent_decode(A), "%zz") == "%zz"
    assert one(spark, urls.query_map(A), "a=1&b&a=2&&c=%41") == {"a": "2", "b": "", "c": "A"}
    assert one(spark, urls.url_query(A), "/x?a=1?b") == "a=1?b" and one(spark, urls.url_path(A), "/x?a") == "/x"
    for p in ("UserData/图.png", "a", "ab", "abc"):
        assert one(spark, urls.asset_path(urls.asset_href(A)), p) == p
    assert one(spark, urls.thumbnail_name(A), "a.b.png") == "a.b_tmb.png" and one(spark, urls.thumbnail_name(A), "a") == "a_tmb"
    assert one(spark, urls.html_links(A), "<A HREF='x y'><img src=pic.png><video poster=\"a&amp;b\">") == ["x y", "pic.png", "a&b"]
    assert [one(spark, urls.link_class(A), x) for x in ("#a", "//x", "data:1", "a/b")] == ["anchor", "external", "external", "local"]
    assert one(spark, urls.local_path(A, B), "/r/", "a%20b?x#y") == "/r/a b" and one(spark, urls.relative_parts(A), "a\\..\\.\\b//c") == "a/b/c"
    assert one(spark, urls.portable_path(A), "C:\\x\\y") == "/mnt/c/x/y"
    kinds = spark.createDataFrame([(bytes.fromhex("89504e470d0a1a0a"), "x.jpg"), (b"zz", "x.JPG"), (None, "x")], "c binary, n string").select(urls.media_type("c", F.col("n")).alias("k")).collect()
    assert [r.k for r in kinds] == ["image/png", "image/jpeg", "application/octet-stream"]


def test_media(spark):
    for t, ok in (("UserDataImage:a", True), ("http://x.example/a.png?b", True), ("http://x.example/a", False), ("a b.png", True), ("好.png", False), ("d/好.png", True), ("{x.png", False), ("“x.png”", False), (None, False)):
        assert one(spark, media.is_media_candidate(A), t) is ok, t
    assert one(spark, media.media_kind(F.array(A, B)), "a.png", "b.amr") == "voice" and one(spark, media.media_kind(F.array(A), ("video",)), "a.png") is None
    assert one(spark, media.trim_media_path(A), "x.png-tail") == "x.png" and one(spark, media.trim_media_path(A), "x") == "x"
    assert one(spark, media.local_candidates(A), "UserDataImage:Group2\\a.png") == ["UserData/Image/Group2/a.png", "UserData/Image/Group2/a_tmb.png"]
