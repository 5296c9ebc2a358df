"""The decoders as Spark operators: Arrow batches in, rows out; a row that cannot be decoded gives an error, never a failure."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleylake.decode import labels, message, proto, record, show, stores


def flat_map(df: DataFrame, keys: list[str], data: str, schema: str, decode: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """For each row the rows that ``decode`` makes of its bytes, behind the key columns; null bytes make none.

    A decoder that raises gives one row with nulls and the error's text in the last column ``error``.
    """
    narrow = df.select(*keys, F.col(data).cast("binary").alias("_data")).where("_data is not null")
    made = T._parse_datatype_string(schema)
    whole = T.StructType([*narrow.drop("_data").schema.fields, *made.fields, T.StructField("error", T.StringType())])
    width = len(made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(whole)
        for b in batches:
            at, out = [], []
            for i, raw in enumerate(b.column(len(keys)).to_pylist()):
                try:
                    rows = [(*r, None) for r in decode(bytes(raw))]
                except Exception as e:  # noqa: BLE001
                    rows = [(*[None] * width, f"{type(e).__name__}: {e}"[:200])]
                at += [i] * len(rows)
                out += rows
            if out:
                kept = b.select(range(len(keys))).take(pa.array(at, pa.int64()))
                cols = [pa.array(c, f.type) for c, f in zip(zip(*out), list(arrow)[len(keys) :])]
                yield pa.RecordBatch.from_arrays([*kept.columns, *cols], schema=arrow)

    return narrow.mapInArrow(run, whole)


def _safe(t: str) -> str:
    return t.encode("utf-8", "replace").decode("utf-8")


def message_elements(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """One row per element: pos, offset, size, type, label, texts, media, kind, records."""

    def one(raw: bytes) -> Iterator[tuple]:
        for i, e in enumerate(message.elements(raw)):
            yield i, e.offset, e.size, e.type, e.label, [_safe(t) for t in e.texts()], [_safe(t) for t in e.media()], e.kind(), len(e.records)

    return flat_map(df, keys, data, "pos int, offset int, size int, type int, label string, texts array<string>, media array<string>, kind string, records int", one)


def displayed(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """What each message shows, its bubble styles, and how many elements are rendered, ignored and unclassified."""

    def one(raw: bytes) -> Iterator[tuple]:
        es = message.elements(raw)
        states = show.status(es)
        yield _safe(show.display(raw)), labels.style_ids(es), *[states.count(x) for x in ("rendered", "ignored", "unclassified")]

    return flat_map(df, keys, data, "display_text string, styles array<long>, rendered int, ignored int, unclassified int", one)


def quotes(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """The quotes in each message: pos, seq, sender, quote_time, quote_text."""

    def one(raw: bytes) -> Iterator[tuple]:
        for i, q in enumerate(x for x in map(message.quote_of, message.elements(raw)) if x):
            yield i, q["seq"], q["sender"], q["time"], _safe(q["text"])

    return flat_map(df, keys, data, "pos int, seq long, sender long, quote_time long, quote_text string", one)


def headers(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """Time and rand in the header of each message that has one."""

    def one(raw: bytes) -> Iterator[tuple]:
        time, rand = message.header_of(raw)
        if time is not None:
            yield time, rand

    return flat_map(df, keys, data, "msg_time long, rand long", one)


def field_lists(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """Bytes that are a list of fields without a record's mark: count, fields read, complete, issue and the names."""

    def one(raw: bytes) -> Iterator[tuple]:
        r = record.fields_of(raw)
        yield r.count, len(r.fields), r.complete, record.issue_of(r), [_safe(f.name) for f in r.fields]

    return flat_map(df, keys, data, "count int, fields int, complete boolean, issue string, names array<string>", one)


def record_issues(lists: DataFrame, keys: list[str]) -> DataFrame:
    """The issues of field lists counted per key, decode_error standing for rows that could not be read."""
    issue = F.when(F.col("error").isNotNull(), "decode_error").otherwise(F.col("issue"))
    return lists.select(*keys, issue.alias("issue")).where("issue is not null").groupBy(*keys, "issue").agg(F.count(F.lit(1)).alias("n"))


def shown_issues(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """One row per issue of what a message shows (see ``show.issues``): issue."""

    def one(raw: bytes) -> Iterator[tuple]:
        for i in show.issues(raw):
            yield (i,)

    return flat_map(df, keys, data, "issue string", one)


def titles(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """The first lines that forwarded chats preview: pos, title."""

    def one(raw: bytes) -> Iterator[tuple]:
        for i, t in enumerate(t for e in message.elements(raw) for t in message.title_previews(e)):
            yield i, _safe(t)

    return flat_map(df, keys, data, "pos int, title string", one)


def file_metas(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """Name, size, uuid and hash of the file elements of each message: pos, name, size, uuid, hash."""

    def one(raw: bytes) -> Iterator[tuple]:
        for i, e in enumerate(message.elements(raw)):
            if e.type in (0x07, 0x11):
                m = message.file_meta(e)
                yield i, _safe(m["name"]), m["size"], m["uuid"], m["hash"]

    return flat_map(df, keys, data, "pos int, name string, size long, uuid string, hash string", one)


def embedded(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """References to media within the text runs of each message: pos, reference."""

    def one(raw: bytes) -> Iterator[tuple]:
        for i, r in enumerate(message.embedded_media(raw)):
            yield i, _safe(r)

    return flat_map(df, keys, data, "pos int, reference string", one)


def index_paths(fields: DataFrame, keys: list[str]) -> DataFrame:
    """The paths that records of an index file hold, each once per key: (keys, path)."""
    from parleylake.functions.media import is_media_candidate

    return fields.select(*keys, F.explode("texts").alias("path")).where(is_media_candidate(F.col("path"))).distinct()


def info_fields(df: DataFrame, keys: list[str], info: str) -> DataFrame:
    """One row per field of a message's info: record, pos, name, number (of any 4 or 8 bytes), texts."""

    def one(raw: bytes) -> Iterator[tuple]:
        for r, i, name, number, texts in message.info_values(raw):
            yield r, i, _safe(name), None if number is None else str(number), [_safe(t) for t in texts]

    return flat_map(df, keys, info, "record int, pos int, name string, number string, texts array<string>", one)


def context_tags(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """One row per entry of a tagged context: offset, tag, size, fields."""

    def one(raw: bytes) -> Iterator[tuple]:
        for t in proto.tagged(raw):
            yield t.offset, t.tag, len(t.data), len(t.fields)

    return flat_map(df, keys, data, "offset int, tag int, size int, fields int", one)


def text_runs(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """One row per run of readable UTF-16 text: offset, text."""

    def one(raw: bytes) -> Iterator[tuple]:
        for o, t in message.runs_of_text(raw):
            yield o, _safe(t)

    return flat_map(df, keys, data, "offset int, text string", one)


def rendered(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """Plain text, nodes (JSON) and HTML of each message."""

    def one(raw: bytes) -> Iterator[tuple]:
        text, nodes, html = show.render(raw)
        yield _safe(text), _safe(json.dumps(nodes, ensure_ascii=False)), _safe(html)

    return flat_map(df, keys, data, "plain_text string, rich_nodes string, rich_html string", one)


def record_fields(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """One row per field of all records in the bytes: record, offset, tag, complete, pos, header, name, number, texts."""

    def one(raw: bytes) -> Iterator[tuple]:
        for i, r in enumerate(record.find_records(raw)):
            if not r.record or not r.record.fields:
                yield i, r.offset, r.tag, r.record.complete if r.record else True, None, r.header, "", None, [_safe(t) for t in r.texts]
            for j, f in enumerate(r.record.fields if r.record else ()):
                yield i, r.offset, r.tag, r.record.complete, j, f.header, _safe(f.name), f.number, [_safe(t) for t in f.texts]

    return flat_map(df, keys, data, "record int, offset int, tag string, complete boolean, pos int, header int, name string, number long, texts array<string>", one)


def proto_fields(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """One row per wire field: pos, path, field, wire, varint (decimal, as it may exceed a long), size, text."""

    def one(raw: bytes) -> Iterator[tuple]:
        for i, n in enumerate(proto.walk(raw)):
            yield i, n.path, n.field, n.wire, None if n.varint is None else str(n.varint), len(n.data), _safe(n.text)

    return flat_map(df, keys, data, "pos int, path string, field int, wire int, varint string, size int, text string", one)


def forwarded_messages(df: DataFrame, keys: list[str], info: str) -> DataFrame:
    """One row per forwarded message: item, msg_time, rand, text, content."""

    def one(raw: bytes) -> Iterator[tuple]:
        for i, m in enumerate(message.forwarded(raw)):
            t, r = message.header_of(m)
            yield i, t, r, _safe(show.render(m)[0]), m

    return flat_map(df, keys, info, "item int, msg_time long, rand long, text string, content binary", one)


def kv_fields(df: DataFrame, keys: list[str], content: str, key_hex: str | None = None, wanted: list[str] | None = None) -> DataFrame:
    """One row per field of key/value stream files: entry_key, field_index, header, field_name, uint_value, texts."""
    key, names = stores.key_of(key_hex) if key_hex else None, set(wanted) if wanted is not None else None

    def one(raw: bytes) -> Iterator[tuple]:
        for name, fields in stores.kv_entries(raw, key, names):
            for i, f in enumerate(fields):
                yield _safe(name), i, f.header, _safe(f.name), f.number, [_safe(t) for t in f.texts]

    return flat_map(df, keys, content, "entry_key string, field_index int, header int, field_name string, uint_value long, texts array<string>", one)


def compound_streams(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """One row per stream of compound files: stream, size, data."""

    def one(raw: bytes) -> Iterator[tuple]:
        for name, data in stores.compound_streams(raw):
            yield _safe(name), len(data), data

    return flat_map(df, keys, content, "stream string, size long, data binary", one)


def coverage(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """The byte ranges of each message that its header and elements explain: start, end, total."""

    def one(raw: bytes) -> Iterator[tuple]:
        if len(raw) >= 20 and raw.startswith(message.HEADER):
            yield 0, 20, len(raw)
        found = message.elements(raw)
        for e in found:
            yield e.offset, e.offset + e.size, len(raw)
        if not found:
            yield 0, 0, len(raw)

    return flat_map(df, keys, data, "start int, end int, total int", one)
