"""Column expressions over texts: plausibility, escapes, roles and names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a part of a data set's name suggests about its role, in order of report.
ROLES = [
    ("msg", "message/chat related"), ("index", "search/index related"), ("fts", "full-text search related"), ("friend", "friend/contact related"),
    ("group", "group related"), ("file", "file transfer or file metadata related"), ("face", "face/avatar/emoji media related"), ("emoji", "emoji/sticker related"),
    ("registry", "configuration/registry related"), ("pub", "public account related"), ("collection", "favorites/collection related"), ("audio", "voice/audio related"), ("cache", "cache/reporting related"),
]
SYSTEM_SENDERS = ["0", "10000", "1000000"]


def trimmed(text: Column) -> Column:
    """The text without white space of any script at its ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def likely_role(name: Column) -> Column:
    """The roles a name suggests, joined by comma."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower(name), F.lit(k)), F.lit(v)) for k, v in ROLES]))
    return F.when(F.size(found) == 0, "unknown from name alone").otherwise(F.array_join(F.array_distinct(found), ", "))


def usable_name(text: Column, ident: Column, account: Column) -> Column:
    """Whether a text says more than a number: not empty, not the id or account, not digits in brackets or without."""
    t = F.trim(text)
    return F.coalesce((F.length(t) > 0) & (t != ident) & (t != account) & ~t.rlike(r"^[0-9]*$") & ~t.rlike(r"^\([0-9]*\)$"), F.lit(False))


def usable_label(text: Column, ident: Column, allow_numeric: bool = False) -> Column:
    """A label of at most 80 bytes without path separators or control characters, and not merely the id or a number."""
    t = F.trim(text)
    ok = (F.length(t) > 0) & (t != ident) & (F.octet_length(t) <= 80) & ~t.rlike(r"[\\/\x00-\x1f]")
    return F.coalesce(ok if allow_numeric else ok & ~t.rlike(r"^[0-9]+$"), F.lit(False))


def sender_show_name(text: Column, sender: Column, account: Column, conv_id: Column) -> Column:
    """A shown name without the sender's number in brackets at its end; '' where nothing usable is left."""
    t, tail = F.trim(text), F.concat(F.lit("("), sender, F.lit(")"))
    cut = F.when(F.endswith(t, tail), F.trim(F.substring(t, F.lit(1), F.length(t) - F.length(tail)))).otherwise(t)
    return F.when(usable_name(cut, conv_id, account), cut).otherwise("")


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def with_mail_of(member: Column, shown: Column) -> Column:
    """A member's name with the bracketed mail address of the shown name, unless it has it."""
    mail = F.regexp_extract(shown, r"(<[^>]*>)", 1)
    return F.when(F.coalesce(member, F.lit("")) == "", "").when(F.contains(mail, F.lit("@")) & ~F.contains(member, mail), F.concat(member, mail)).otherwise(member)


def suspicious_score(text: Column) -> Column:
    """How many characters of a text look wrongly decoded: lost ones, or at least two risky ones that make over 12 %."""
    lost = F.regexp_count(text, F.lit("�"))
    risky = F.regexp_count(text, F.lit(r"[\x{E000}-\x{F8FE}\x{1200}-\x{137F}\x{2C80}-\x{2CFF}\x00-\x08\x0B\x0C\x0E-\x1F]"))
    return F.coalesce(F.when(lost > 0, lost).when((risky >= 2) & (F.floor(risky * 100 / F.length(text)) > 12), risky).otherwise(0), F.lit(0)).cast("long")


def spaced_hex(data: Column, first: int | None = None) -> Column:
    """Bytes in lower-case hex, a space between bytes; ``...`` marks bytes beyond the first ones."""
    part = data if first is None else F.substring(data, 1, first)
    h = F.regexp_replace(F.lower(F.hex(part)), "(..)(?!$)", "$1 ")
    return h if first is None else F.when(F.octet_length(data) > first, F.concat(h, F.lit(" ..."))).otherwise(h)


def lenient_unhex(text: Column) -> Column:
    """The bytes of a hex text, other characters ignored; an odd last digit is dropped."""
    digits = F.regexp_replace(text, "[^0-9a-fA-F]", "")
    return F.unhex(F.substring(digits, F.lit(1), (F.floor(F.length(digits) / 2) * 2).cast("int")))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_unescape(text: Column) -> Column:
    for a, b in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def csv_cell(text: Column) -> Column:
    """A cell of a CSV line: quoted only where it holds a comma, quote or line break; null is empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def tsv_cell(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\t\r\n]", " ")


def safe_file_name(text: Column, otherwise: str = "unnamed") -> Column:
    """A name any file system takes: characters beyond letters, digits, ``. _ -`` become ``_``."""
    t = F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}._-]", "_")
    return F.when(F.coalesce(F.length(F.regexp_replace(t, "[._]", "")), F.lit(0)) == 0, otherwise).otherwise(t)


def iso_time(seconds: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` in the session's time zone; '' where that is no time."""
    return F.coalesce(F.when(seconds.between(-62135596800, 253402300799), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")), F.lit(""))


def plausible_time(seconds: Column, now: Column) -> Column:
    """From 2000-01-01 to two days after ``now``."""
    return F.coalesce((seconds >= 946_684_800) & (seconds <= now + 172_800), F.lit(False))


def like_text(text: Column, pattern: str) -> Column:
    """LIKE without regard to letter case."""
    return F.coalesce(text.ilike(pattern), F.lit(False))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def matches_all(text: Column, query: str) -> Column:
    """Whether a text holds every word of a query, and every phrase given in double quotes, as whole words in a row."""
    import re

    parts = [p or w for p, w in re.findall(r'"([^"]+)"|(\S+)', query)]
    padded = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    found = F.lit(True)
    for p in parts:
        words = " ".join(w for w in re.split(r"[\W_]+", p.lower()) if w)
        if words:
            found = found & F.contains(padded, F.lit(f" {words} "))
    return F.coalesce(found, F.lit(False))
