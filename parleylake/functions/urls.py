"""Column expressions over URLs, links and paths of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by first bytes, then by ending.
MAGIC = [("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("424D", "image/bmp"), ("2321414D52", "audio/amr"), ("25504446", "application/pdf"), ("504B0304", "application/zip")]
ENDINGS = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "mp4": "video/mp4", "webm": "video/webm", "mov": "video/quicktime", "amr": "audio/amr", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "m4a": "audio/mp4", "pdf": "application/pdf", "zip": "application/zip", "txt": "text/plain"}
# Schemes that lead out of a local folder.
EXTERNAL = r"(?i)^(?:https?:|mailto:|javascript:|data:|tel:|ftp:|about:|//)"


def url_path(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def url_query(url: Column) -> Column:
    at = F.instr(url, "?")
    return F.when(at > 0, F.substring(url, at + 1, F.length(url))).otherwise("")


def percent_decode(text: Column) -> Column:
    """Percent escapes decoded as UTF-8; ``+`` stays, a text with a bad escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def query_map(query: Column) -> Column:
    """The parameters of a query; of a repeated one the last counts, parts without a key are dropped."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(percent_decode(F.substring_index(p, "=", 1)).alias("k"), percent_decode(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1)["v"]))


def asset_href(path: Column) -> Column:
    """A path as URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(path, "UTF-8")), "+/", "-_"), F.lit("="))


def asset_path(href: Column) -> Column:
    """The path behind a URL-safe base64 reference."""
    return F.decode(F.unbase64(F.translate(href, "-_", "+/")), "UTF-8")


def file_name(path: Column) -> Column:
    """The last part of a path, either separator, behind a scheme."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/:]*)$", 1)


def file_ending(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def thumbnail_name(name: Column) -> Column:
    """``stem_tmb.ending``."""
    dot = F.when(file_ending(name) != "", F.regexp_extract(name, r"(\.[^.]*)$", 1)).otherwise("")
    return F.concat(file_stem(name), F.lit("_tmb"), dot)


def media_type(first_bytes: Column, name: Column) -> Column:
    """A media type by first bytes, else by ending."""
    h = F.hex(F.substring(first_bytes, 1, 12))
    kind = F.lit(None).cast("string")
    for m, t in reversed(MAGIC):
        kind = F.when(F.startswith(h, F.lit(m)), t).otherwise(kind)
    riff = F.startswith(h, F.lit("52494646"))
    kind = F.when(riff & (F.substring(h, 17, 8) == "57454250"), "image/webp").when(riff & (F.substring(h, 17, 8) == "57415645"), "audio/wav").when(F.substring(h, 9, 8) == "66747970", "video/mp4").otherwise(kind)
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), file_ending(name))
    return F.coalesce(kind, by_name, F.lit("application/octet-stream"))


def html_links(html: Column) -> Column:
    """The targets of href, src and poster attributes, in order, entities resolved."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<[a-z][^>]*?\s(?:href|src|poster)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'/]+)"), F.lit(0))
    from parleylake.functions.text import html_unescape

    return F.transform(found, lambda x: html_unescape(F.regexp_extract(x, r"(?i)(?:href|src|poster)\s*=\s*[\"']?([^\"'>]*)[\"']?$", 1)))


def link_class(link: Column) -> Column:
    """anchor, external or local."""
    return F.when(F.startswith(F.trim(link), F.lit("#")) | (F.trim(link) == ""), "anchor").when(link.rlike(EXTERNAL), "external").otherwise("local")


def local_path(base: Column, link: Column) -> Column:
    """The file a local link means: query and fragment cut, escapes decoded, relative to ``base``."""
    bare = percent_decode(F.regexp_extract(link, r"^([^?#]*)", 1))
    return F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), bare))


def relative_parts(path: Column) -> Column:
    """A relative path without empty, ``.`` and ``..`` parts."""
    return F.array_join(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", "..")), "/")


def portable_path(path: Column) -> Column:
    """A Windows path as the Linux subsystem mounts it."""
    return F.when(path.rlike(r"^[A-Za-z]:[\\/]"), F.concat(F.lit("/mnt/"), F.lower(F.substring(path, 1, 1)), F.lit("/"), F.replace(F.substring(path, F.lit(4), F.length(path)), F.lit("\\"), F.lit("/")))).otherwise(F.replace(path, F.lit("\\"), F.lit("/")))


def path_has_any(path: Column, parts: list[str]) -> Column:
    """Whether a path contains any of the parts, letter case and kind of separator aside; no parts let all pass."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    found = F.lit(not parts)
    for x in parts:
        found = found | F.contains(p, F.lit(x.lower().replace("\\", "/")))
    return F.coalesce(found, F.lit(not parts))
