"""Column expressions over media references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings by kind of media, and the schemes of stored media.
IMAGE, VIDEO, VOICE, FILE = "jpg jpeg png gif webp bmp".split(), "mp4 webm mov avi".split(), "amr slk mp3 wav ogg m4a".split(), "pdf zip rar 7z doc docx xls xlsx ppt pptx txt".split()
SCHEMES = "UserDataImage UserDataCustomFace UserDataRoot UserDataFileRecv OSRoot sysres".split()
_ALL = "|".join([*IMAGE, *VIDEO, *VOICE, *FILE])


def is_media_candidate(text: Column) -> Column:
    """Whether a text is a reference to stored media: a scheme, or a URL, path or plain name with a media ending."""
    t = F.trim(text)
    refused = t.rlike(r"^\{|^com\.|[“”]|文件|成功|取消") | (t == "")
    ending = rf"(?i)\.(?:{_ALL})$"
    found = t.rlike(rf"^(?:{'|'.join(SCHEMES)}):") | t.rlike(rf"(?i)^https?://[^?#]*\.(?:{_ALL})(?:[?#].*)?$") | (t.rlike(r"[\\/]|^[\x20-\x7e]*$") & t.rlike(ending))
    return F.coalesce(found & ~refused, F.lit(False))


def candidate_kind(path: Column) -> Column:
    """image, video, voice or file by ending; null for others."""
    e = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.when(e.isin(VIDEO), "video").when(e.isin(VOICE), "voice").when(e.isin(IMAGE), "image").when(e.isin(FILE), "file")


def media_kind(paths: Column, order: tuple[str, ...] = ("voice", "video", "image", "file")) -> Column:
    """The kind of a message by its candidates: the first kind of ``order`` that occurs."""
    kinds = F.transform(paths, candidate_kind)
    kind = F.lit(None).cast("string")
    for k in reversed(order):
        kind = F.when(F.array_contains(kinds, k), k).otherwise(kind)
    return kind


def trim_media_path(text: Column) -> Column:
    """A text cut behind its first known media ending, in the order of the endings' list."""
    out = text
    for e in reversed([*IMAGE, *VIDEO, *VOICE, *FILE]):
        at = F.instr(F.lower(text), f".{e}")
        out = F.when(at > 0, F.substring(text, F.lit(1), at + len(e))).otherwise(out)
    return out


def local_candidates(reference: Column, thumbnails: bool = True) -> Column:
    """Local paths, likeliest first, for ``Scheme:relative``: the folder of the scheme, and thumbnails of images."""
    scheme, tail = F.substring_index(reference, ":", 1), F.replace(F.regexp_extract(reference, r"^[^:]*:(.*)$", 1), F.lit("\\"), F.lit("/"))
    clean = F.array_join(F.filter(F.split(tail, "/"), lambda p: ~p.isin("", ".", "..")), "/")
    folder = F.when(scheme == "UserDataImage", "UserData/Image/").when(scheme == "UserDataCustomFace", "UserData/CustomFace/").when(scheme == "UserDataFileRecv", "UserData/FileRecv/").when(scheme == "UserDataRoot", "UserData/").when(scheme == "OSRoot", "").otherwise(None)
    full = F.concat(folder, clean)
    both = F.array(full, F.when(F.lit(thumbnails) & (candidate_kind(full) == "image"), F.regexp_replace(full, r"\.([^./]*)$", "_tmb.$1")))
    return F.array_distinct(F.array_compact(both))


# The picture endings that thumbnails come in, in the order they are tried, and the one face kept as an emoji.
THUMBNAIL_ENDINGS = ["jpg", "jpeg", "png", "gif", "bmp", "webp"]
FACE_EMOJI = {"[爱心]": "0x2764"}


def with_thumbnails(path: Column) -> Column:
    """A path and its thumbnails: ``stem_tmb.ending`` and ``stemfix.ending``, for pictures in every picture ending, its own first."""
    ending = F.regexp_extract(path, r"[^/.]\.([^./]+)$", 1)
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    others = F.filter(F.array(*map(F.lit, THUMBNAIL_ENDINGS)), lambda e: e != F.lower(ending))
    endings = F.when(ending == "", F.array().cast("array<string>")).when(F.lower(ending).isin(THUMBNAIL_ENDINGS), F.concat(F.array(ending), others)).otherwise(F.array(ending))
    made = F.flatten(F.transform(endings, lambda e: F.array(F.concat(stem, F.lit("_tmb."), e), F.concat(stem, F.lit("fix."), e))))
    return F.concat(F.array(path), made)


def asset_candidates(reference: Column, account: str, extracted: str = "extracted") -> Column:
    """Where a reference may lie, likeliest first, below the folder that holds the account's and that of ``extracted`` streams.

    ``UserDataImage``, ``UserDataCustomFace``, ``FaceStore``, ``SysFaceResFileSystem``, ``UserDataRoot`` and ``UserDataFileRecv``
    each name a folder; paths and bare file names are looked for in the folders of received files. Pictures of groups
    also lie below folders of the first letters of their name, and thumbnails in a store of their own.
    """
    n = F.replace(F.trim(reference), F.lit("/"), F.lit("\\"))
    scheme = F.regexp_extract(n, r"^(\w{3,}):", 1)
    rest = F.regexp_replace(n, r"^\w{3,}:", "")
    parts = lambda c: F.filter(F.transform(F.split(c, r"\\"), lambda p: F.trim(p)), lambda p: ~p.isin("", ".", ".."))
    rel = lambda c: F.array_join(parts(c), "/")
    under = lambda folder, tail: F.concat(F.lit(f"{folder}/"), tail)
    name = F.try_element_at(parts(rest), F.lit(-1))
    none = F.array().cast("array<string>")
    in_group = F.startswith(rest, F.lit("Group\\"))
    after = F.regexp_replace(rest, r"^Group\\", "")
    hashed = F.concat(F.lit(f"{account}/Image/Group2/"), F.substring(name, 1, 2), F.lit("/"), F.substring(name, 3, 2), F.lit("/"), name)
    group = F.when(in_group, F.concat(with_thumbnails(under(f"{account}/Image/Group/thumbnail", rel(after))), F.when(F.length(name) >= 4, with_thumbnails(hashed)).otherwise(none))).otherwise(none)
    stored = F.when(name.isNotNull(), F.array(under(f"{extracted}/Thumbnails.db/PicFile", F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")), under(f"{extracted}/Thumbnails.db/PicFile", name))).otherwise(none)
    twin = F.when(F.endswith(name, F.lit(".fixed")), F.regexp_replace(name, r"\.fixed$", "")).otherwise(F.concat(name, F.lit(".fixed")))
    emoji = none
    for label, code in FACE_EMOJI.items():
        kept = F.concat(*[with_thumbnails(F.lit(f"{extracted}{now}/{db}/emoji/{code}.png")) for db in ("EmojiFace.db", "SmallEmoji.db") for now in ("", "-current")])
        emoji = F.when(n == label, kept).otherwise(emoji)
    found = (
        F.when(scheme == "UserDataImage", F.concat(with_thumbnails(under(f"{account}/Image", rel(rest))), group, stored))
        .when(scheme == "UserDataCustomFace", F.concat(with_thumbnails(under(f"{account}/CustomFace", rel(rest))), with_thumbnails(under(f"{extracted}/CustomFace.db", rel(rest))), stored))
        .when(scheme == "FaceStore", F.concat(with_thumbnails(under(f"{extracted}/FaceStore.db", rel(rest))), with_thumbnails(under(f"{extracted}/FaceStore.db", twin))))
        .when(scheme == "SysFaceResFileSystem", F.concat(with_thumbnails(under(f"{extracted}/SysFaceResFileSystem", rel(rest))), with_thumbnails(under(f"{extracted}-current/SysFaceResFileSystem", rel(rest)))))
        .when(scheme == "UserDataRoot", F.array(under(account, rel(rest))))
        .when(scheme == "UserDataFileRecv", F.array(under(f"{account}/FileRecv", rel(rest)), under(account, rel(rest))))
        .when(F.contains(n, F.lit("\\")), F.array(under(account, rel(n)), under(f"{account}/FileRecv", rel(n))))
        .when(n.rlike(rf"(?i)\.(?:{_ALL})$"), F.array(*[F.concat(F.lit(f"{account}/{f}"), n) for f in ("FileRecv/", "", "Audio/", "Video/", "GroupFile/")]))
        .otherwise(emoji)
    )
    return F.array_distinct(F.array_compact(found))
