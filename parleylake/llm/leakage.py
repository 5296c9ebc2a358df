"""Evaluation passages inside a training corpus, found with suffix arrays over corpus shards."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleylake.runtime import materialise

#: Shortest verbatim match: characters for scripts that write a word in a few characters, and for all others.
SHORT, LONG = 6, 12
#: Characters by which suffixes are ordered; longer matches are extended one by one.
DEPTH = 24
DENSE_SCRIPTS = 0x2E80


@dataclass(frozen=True)
class Rules:
    """What counts as a passage.

    ``share`` of the item's text must be spanned by one chain of verbatim matches. Two matches belong together if at
    most ``item_gap`` characters of the item (exchanged words) and ``doc_gap`` characters of the document (line
    openings, layout) lie between them; ``verbatim`` of the span must be verbatim. All counts are of letters and digits.
    """

    share: float = 1 / 3
    item_gap: int = 48
    doc_gap: int = 160
    verbatim: float = 0.5


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Folded code of each code point below U+20000, 0 where it is neither letter, digit nor mark."""
    table = np.zeros(0x20000, np.uint32)
    for c in range(0x20000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LN":
            folded = unicodedata.normalize("NFKC", ch).casefold()
            table[c] = ord(folded[0]) if folded else 0
    table[0] = 1  # separates texts
    return table


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded codes of all texts in one array, each text followed by a 1, and where each text starts in it."""
    codes = np.frombuffer("".join(t.replace("\0", "") + "\0" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    table = folding()
    folded = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], np.where(codes >= 0x30000, 0, codes)).astype(np.uint32)
    folded = folded[folded != 0]
    ends = np.flatnonzero(folded == 1)
    return folded, np.concatenate([[0], ends + 1])[: len(texts)]


def window_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each position the hash of its shortest match window, and whether a whole window is there."""
    m = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    h = codes.astype(np.uint64) * m[0]
    h ^= h >> np.uint64(29)
    two = np.zeros_like(h)
    two[:-1] = h[:-1] * m[1] + h[1:]
    six = np.zeros_like(h)
    if len(h) > 5:
        six[:-5] = (two[:-5] * m[2] + two[2:-3]) * m[3] + two[4:-1]
    twelve = np.zeros_like(h)
    if len(h) > 11:
        twelve[:-11] = six[:-11] * m[0] + six[6:-5]
    dense = codes >= DENSE_SCRIPTS
    sep = np.cumsum(codes == 1)
    ok6, ok12 = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    ok6[:-5] = sep[5:] == sep[:-5]
    ok12[:-11] = sep[11:] == sep[:-11]
    ok = np.where(dense, ok6, ok12) & (codes != 1)
    out = np.where(dense, six, twelve)
    return out ^ (out >> np.uint64(31)), ok


class Queries:
    """The suffixes of the test items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = np.array([i for i, _ in items], np.int64)
        self.codes, self.starts = fold([t for _, t in items])
        self.item = np.repeat(np.arange(len(items)), np.diff(np.append(self.starts, len(self.codes))))
        self.size = np.diff(np.append(self.starts, len(self.codes))) - 1
        hashes, ok = window_hashes(self.codes)
        self.at = np.flatnonzero(ok)
        self.hashes = np.unique(hashes[self.at])
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """Positions of a shard at which a shortest match may begin: all others begin none."""
        hashes, ok = window_hashes(codes)
        at = np.flatnonzero(ok & self.sieve[(hashes >> np.uint64(42)).astype(np.int64)])
        if not len(self.hashes):
            return at[:0]
        i = np.searchsorted(self.hashes, hashes[at])
        return at[self.hashes[np.minimum(i, len(self.hashes) - 1)] == hashes[at]]


def suffix_keys(codes: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The first ``depth`` characters of the suffixes as byte strings that sort like them (3 bytes a character, none 0)."""
    padded = np.concatenate([codes, np.ones(depth, np.uint32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, depth)[at]
    out = np.empty((len(at), depth, 3), np.uint8)
    for i in range(3):
        out[:, :, i] = (windows >> np.uint32(14 - 7 * i)) & np.uint32(0x7F)
    out += 1
    return out.reshape(len(at), depth * 3).view(f"S{depth * 3}").ravel()


def common_length(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes a[i:] and b[j:]; texts end at a 1."""
    n = np.zeros(len(i), np.int64)
    open_ = np.arange(len(i))
    while len(open_):
        x, y = i[open_] + n[open_], j[open_] + n[open_]
        same = (x < len(a)) & (y < len(b))
        same &= a[np.minimum(x, len(a) - 1)] == b[np.minimum(y, len(b) - 1)]
        same &= a[np.minimum(x, len(a) - 1)] != 1
        open_ = open_[same]
        n[open_] += 1
    return n


def verbatim_matches(codes: np.ndarray, q: Queries, block: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Longest verbatim matches (item position, shard position, length) that cannot be extended to the left, in blocks."""
    at = q.candidates(codes)
    if not len(at):
        return
    keys = suffix_keys(codes, at)
    order = np.argsort(keys, kind="stable")
    array, keys = at[order], keys[order]  # the suffix array of the shard's candidate suffixes
    test = suffix_keys(q.codes, q.at)
    need = np.where(q.codes[q.at] >= DENSE_SCRIPTS, SHORT, LONG)
    lo, hi = np.empty(len(test), np.int64), np.empty(len(test), np.int64)
    for k in (SHORT, LONG):
        w = need == k
        cut = test[w].astype(f"S{3 * k}").astype(test.dtype)
        lo[w] = np.searchsorted(keys, cut, "left")
        top = np.frombuffer(b"".join(x + b"\xff" * (3 * (DEPTH - k)) for x in cut.tolist()), test.dtype) if w.any() else cut
        hi[w] = np.searchsorted(keys, top, "right")
    n = hi - lo
    edges = np.concatenate([[0], np.cumsum(n)])
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + block, "right")) - 1)
        m = n[first:last]
        if m.sum():
            j = np.repeat(q.at[first:last], m)
            p = array[np.repeat(lo[first:last] - edges[first:last], m) + edges[first] + np.arange(m.sum())]
            left = q.codes[np.maximum(j, 1) - 1]
            start = (p == 0) | (j == 0) | (codes[np.maximum(p, 1) - 1] != left) | (left == 1)
            # a match that goes on to the left is found from there, unless it is too short for the script it begins with there
            kept = start | ((q.codes[j] >= DENSE_SCRIPTS) & (left < DENSE_SCRIPTS))
            j, p, start = j[kept], p[kept], start[kept]
            n_common = common_length(q.codes, j, codes, p)
            kept = start | (n_common + 1 < LONG)
            yield j[kept], p[kept], n_common[kept]
        first = last


def chained(j: np.ndarray, p: np.ndarray, n: np.ndarray, rules: Rules) -> tuple[int, int, int, int]:
    """The chain of one document's matches with one item that has the longest span of those that are verbatim enough.

    Gives item span, verbatim characters, first and end shard position. Matches are taken in order of the document. Each
    keeps every chain that ends in it and that no other one there beats in both span and verbatim share, a chain of its
    own among them, so a dense passage is not hidden by stray matches before it.
    """
    o = np.lexsort([j, p])
    j, p, n = j[o].tolist(), p[o].tolist(), n[o].tolist()
    reach = rules.doc_gap + max(n)
    fronts: list[list[tuple[int, float, int, int]]] = []  # (span, slack, verbatim, first position), by falling span and rising slack
    best = (0, 0, 0, 0)
    for b in range(len(j)):
        found = [(n[b], (1 - rules.verbatim) * n[b], n[b], p[b])]
        for a in range(b - 1, -1, -1):
            if p[b] - p[a] > reach:
                break
            gap_d, gap_q = p[b] - p[a] - n[a], j[b] - j[a] - n[a]
            if not -LONG <= gap_d <= rules.doc_gap or not -LONG <= gap_q <= rules.item_gap:
                continue
            if j[b] + n[b] <= j[a] + n[a] or p[b] + n[b] <= p[a] + n[a]:
                continue
            more, held = j[b] + n[b] - j[a] - n[a], n[b] + min(0, gap_q, gap_d)
            found += [(span + more, slack + held - rules.verbatim * more, got + held, first) for span, slack, got, first in fronts[a]]
        found.sort(key=lambda x: (-x[0], -x[1]))
        front: list[tuple[int, float, int, int]] = []
        for x in found:
            if not front or x[1] > front[-1][1]:
                front.append(x)
        fronts.append(front)
        for span, slack, got, first in front:
            if slack >= 0:
                if span > best[0]:
                    best = (span, got, first, p[b] + n[b])
                break
    return best


def leaks_of(texts: list[str], q: Queries, rules: Rules) -> list[tuple[int, int, int, int]]:
    """(text number, item number, item characters spanned, verbatim ones) of every passage in the texts."""
    codes, starts = fold(texts)
    found = [x for x in verbatim_matches(codes, q) if len(x[0])]
    if not found:
        return []
    j, p, n = (np.concatenate(x) for x in zip(*found))
    item, doc = q.item[j], np.searchsorted(starts, p, "right") - 1
    key = doc * len(q.ids) + item
    o = np.argsort(key, kind="stable")
    j, p, n, key = j[o], p[o], n[o], key[o]
    cuts = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(n, cuts)
    out = []
    for c, end, whole in zip(cuts, np.append(cuts[1:], len(key)), total):
        i = int(key[c] % len(q.ids))
        need = rules.share * q.size[i]
        if whole < rules.verbatim * need:
            continue
        span, held, _, _ = chained(j[c:end], p[c:end], n[c:end], rules)
        if span >= need:
            out.append((int(key[c] // len(q.ids)), i, span, held))
    return out


def shortest_match(text: str) -> int:
    """Letters and digits that a passage of this text must have in a row: ``SHORT`` if it begins with a dense script."""
    codes, _ = fold([text])
    return SHORT if (codes >= DENSE_SCRIPTS).any() else LONG


def short_items(items: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The items that no document can leak: they have fewer letters and digits than the shortest match.

    A text of so few letters is a short fragment, which is no leak wherever it stands.
    """
    few = F.udf(lambda t: t is None or len(fold([t])[0]) - 1 < shortest_match(t), "boolean", useArrow=True)
    return items.where(few(F.col(text))).select(item_id, text)


def find_leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", rules: Rules = Rules(), block_chars: int = 2_000_000) -> DataFrame:
    """The documents that hold a passage of an item: doc_id, item_id, span, verbatim, item_size (letters and digits).

    Each Arrow batch of documents is a shard with its own suffix array; every suffix of every item is searched in it by
    binary search, the longest verbatim matches are extended from there and chained (see Rules). Only suffixes that
    begin like an item somewhere enter the array, which loses no match of the shortest length. Items come in blocks of
    some ``block_chars`` characters by hash of their id; one block at a time is broadcast, passes over all documents,
    and is released once its leaks are written to the shared folder. Letter case, character width, punctuation, spacing
    and symbols do not count. Null and empty texts match nothing, nor do items shorter than the shortest match (see
    ``short_items``); repeated documents give repeated rows; extra columns are ignored.
    """
    spark = documents.sparkSession
    d = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= SHORT)
    named = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and length(t) > 0")
    blocks = max(1, -(-named.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0] // block_chars))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, item_id long, span int, verbatim int, item_size int"

    def searched(block: int) -> DataFrame:
        # bounded: an even share of all items by hash
        sent = spark.sparkContext.broadcast([(r.i, r.t) for r in named.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = Queries(sent.value)
            for b in batches:
                ids, texts = b.column(0), b.column(1).to_pylist()
                for lo, hi in shards(texts):
                    found = leaks_of(texts[lo:hi], q, rules) if len(q.ids) else []
                    if found:
                        n, i, span, held = (np.array(x, np.int64) for x in zip(*found))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(n + lo)), pa.array(q.ids[i]), pa.array(span, pa.int32()), pa.array(held, pa.int32()), pa.array(q.size[i], pa.int32())], names=["doc_id", "item_id", "span", "verbatim", "item_size"])

        found = materialise(d.mapInArrow(run, schema), "leaks")
        sent.destroy()
        return found

    return reduce(DataFrame.unionByName, map(searched, range(blocks))).withColumnRenamed("doc_id", doc_id)


def shards(texts: list[str], chars: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``chars`` characters together; a longer text is a shard by itself."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no passage of any item."""
    return documents.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
