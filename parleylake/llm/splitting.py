"""Oversized texts cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleylake.llm.tokens import VOCABULARY, Tokenizer, tokenizer



def _any_of(chars: str) -> bytes:
    return b"(?:" + b"|".join(c.encode() for c in chars) + b")"


SPACES = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
#: Natural boundaries over UTF-8 bytes, strongest first: paragraph, line, sentence, clause; words come last.
BOUNDARIES = [
    re.compile(rb"\n[ \t\r]*\n\s*"),
    re.compile(rb"\n\s*"),
    re.compile(b"(?:" + _any_of("。！？…") + b"+(?:" + _any_of("”’」』）") + rb"|[\"'])*|[.!?]+[\"')\]]*(?=\s))\s*"),
    re.compile(b"(?:" + _any_of("，；：、") + rb"|[,;:](?=\s))\s*"),
]


def boundary_tokens(raw: bytes, ends: np.ndarray) -> list[list[int]]:
    """Per kind of boundary, the sorted numbers of tokens before it; white space may move behind the cut."""
    space = np.isin(np.frombuffer(raw, np.uint8), SPACES)
    solid = np.concatenate([[0], np.cumsum(~space)])
    words = np.flatnonzero(space & ~np.append(space[1:], False)) + 1
    found = []
    for at in [*(np.fromiter((m.end() for m in p.finditer(raw)), np.int64) for p in BOUNDARIES), words]:
        k = np.searchsorted(ends, at, "right")
        before = np.where(k > 0, ends[np.maximum(k, 1) - 1], 0)
        found.append(np.unique(k[(k > 0) & (solid[at] == solid[before])]).tolist())
    return found


def cut_points(raw: bytes, ends: np.ndarray, limit: int, overlap: int, size_of: object) -> Iterator[tuple[int, int, int]]:
    """(first byte, end byte, tokens) of each piece.

    A piece ends at the last boundary under the limit, of the strongest kind that leaves it at least half full, else of
    any kind that lets it advance past the overlap, else at the limit itself, between two characters. The next piece
    starts ``overlap`` tokens before, or up to three more where that would split a character; a piece that is no longer
    than the overlap, which only happens if its tokens grow once it stands alone, is followed without one.
    """
    n, bounds = len(ends), boundary_tokens(raw, ends)
    byte = lambda k: int(ends[k - 1]) if k else 0
    whole = lambda k: byte(k) == len(raw) or raw[byte(k)] & 0xC0 != 0x80
    start = last = 0
    while True:
        room = limit
        while True:
            top = min(n, start + room)
            if top == n:
                end = n
            else:
                end = 0
                for least in (max(last, start + max(overlap, room // 2)), max(last, start + overlap)):
                    for b in bounds:
                        i = bisect_right(b, top)
                        if i and b[i - 1] > least:
                            end = b[i - 1]
                            break
                    if end:
                        break
                else:
                    end = top
                    while end > start + 1 and not whole(end):
                        end -= 1
            size = size_of(raw[byte(start) : byte(end)])
            if size <= limit or end <= start + 1:
                break
            room -= max(1, size - limit)  # a piece that starts within a word may have more tokens of its own
        yield byte(start), byte(end), size
        if end >= n:
            return
        last, following = end, max(end - overlap, 0)
        while following > 0 and not whole(following):
            following -= 1
        start = following if following > start else end


def split_text(text: str, t: Tokenizer, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces (first character, end character, tokens, text); a text within the limit is one piece."""
    raw = text.encode("utf-8", "replace")
    ends = t.ends(text)
    if len(ends) <= limit:
        return [(0, len(text), len(ends), text)]
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    place = lambda b: int(chars[b - 1]) if b else 0
    cut = []
    for lo, hi, size in cut_points(raw, ends, limit, overlap, lambda x: t.count(x.decode("utf-8", "replace"))):
        cut.append((place(lo), place(hi), size, raw[lo:hi].decode("utf-8", "replace")))
    return cut


def split_oversized(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, overlap: int = 64, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents of more than ``limit`` tokens as ordered pieces: doc_id, piece_no, start, end, n_tokens, piece.

    Token offsets are prefix sums over the whole text, natural boundaries a sorted array of token numbers; each cut is
    found by binary search. Every piece has at most ``limit`` tokens by itself; ``start`` and ``end`` count characters,
    pieces are numbered from 0 and together cover the text. Texts within the limit, null and empty ones give no rows;
    a text of at most ``limit`` bytes is within it without being tokenized, since a token has at least a byte.
    Repeated rows are split each; other columns are ignored. The cut needs ``0 <= overlap < limit / 2``.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and less than half of the limit")
    narrow = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, piece_no int, start int, end int, n_tokens int, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        for b in batches:
            kind = b.schema.field(0).type
            for lo in range(0, b.num_rows, 500):
                rows = []
                for d, x in zip(b.column(0)[lo : lo + 500].to_pylist(), b.column(1)[lo : lo + 500].to_pylist()):
                    pieces = split_text(x, t, limit, overlap)
                    if len(pieces) > 1:
                        rows += [(d, i, *p) for i, p in enumerate(pieces)]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [kind, *[pa.int32()] * 4, pa.string()])], names=["doc_id", "piece_no", "start", "end", "n_tokens", "piece"])

    return narrow.mapInArrow(run, schema).withColumnRenamed("doc_id", doc_id)
