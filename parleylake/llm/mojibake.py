"""Text decoded with a wrong encoding: expectation-maximization over encoding chains, then repair."""

from __future__ import annotations

import codecs
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleylake.runtime import materialise, parts_for

# What code page 1252 shows for the bytes 0x80 to 0x9F it defines; the other bytes show as themselves.
CP1252 = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
#: Chains as (right encoding, wrong encoding), applied once or, with a third member, several times. ``west`` is code
#: page 1252 and Latin-1 in one, as their repertoires do not contradict each other.
CHAINS: list[tuple[str, str, int]] = [
    *[("utf-8", w, 1) for w in ("west", "gbk", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp932", "big5", "cp949", "koi8-r", "cp866")],
    ("utf-8", "west", 2), ("utf-8", "west", 3), ("utf-8", "gbk", 2),
    *[("gbk", w, 1) for w in ("west", "cp1251", "big5", "cp932", "cp949", "mac_roman", "cp437", "koi8-r", "euc_jp")],
    *[("big5", w, 1) for w in ("west", "gbk")],
    *[("cp932", w, 1) for w in ("west", "gbk")],
    *[("euc_jp", w, 1) for w in ("west", "gbk")],
    *[("cp949", w, 1) for w in ("west", "gbk")],
    *[("cp1251", w, 1) for w in ("west", "koi8-r", "cp866", "mac_roman")],
    *[("koi8-r", w, 1) for w in ("west", "cp1251")],
    *[("cp866", w, 1) for w in ("west", "cp1251")],
    *[("cp1253", "west", 1), ("cp1250", "west", 1)],
    ("utf-16-le", "utf-16-be", 1),
]
IDENTITY, LOST = len(CHAINS), len(CHAINS) + 1
N_CHAINS = len(CHAINS) + 2
UNI, BI = 1 << 17, 1 << 18
UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
CUT = re.compile(r"([ ：（）\[\]\n]+|…$)")
HIGH = re.compile(r"[^\x00-\x7f]")


def _encode(s: str, wrong: str) -> bytes:
    return s.translate(CP1252).encode("latin-1") if wrong == "west" else s.encode(wrong)


def _decode(b: bytes, wrong: str) -> str:
    return "".join(chr(x) if x < 0x80 or x >= 0xA0 or x in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([x]).decode("cp1252") for x in b) if wrong == "west" else b.decode(wrong, "replace")


_LOST: list[str] = []


def _mark(e: UnicodeError) -> tuple[str, int]:
    """Writes a zero for each run of characters that an encoding lacks, and keeps them."""
    _LOST.append(e.object[e.start : e.end])
    return "\0", e.end


codecs.register_error("parleylake-mark", _mark)


@dataclass
class Written:
    """What a wrong encoding writes of a run: its bytes with a zero for every stretch it lacks, and these stretches."""

    raw: bytes
    lost: list[str]
    pieces: list[tuple[str, bytes]] | None = None  # stretches it writes, once they are needed one by one

    def joined(self, text: str) -> str:
        """A text decoded from the bytes, with the stretches in place of the zeros."""
        if not self.lost:
            return text
        parts = text.split("\0")
        return "".join(x for pair in zip(parts, [*self.lost, ""]) for x in pair)

    def cut(self, run: str) -> list[tuple[str, bytes]]:
        if self.pieces is None:
            rest, texts = run, []
            for x in self.lost:
                head, _, rest = rest.partition(x)
                texts.append(head)
            self.pieces = list(zip([*texts, rest], self.raw.split(b"\0")))
        return self.pieces


def write(run: str, wrong: str) -> Written:
    _LOST.clear()
    raw = (run.translate(CP1252).encode("latin-1", "parleylake-mark") if wrong == "west" else run.encode(wrong, "parleylake-mark")) if "\0" not in run else b"\0"
    return Written(raw, [run] if "\0" in run else _LOST.copy())


def undo(run: str, right: str, wrong: str, w: Written | None = None) -> tuple[str, bool]:
    """The run with the chain undone wherever its bytes allow, and whether they fit throughout, as chance rarely has it.

    ``w`` is what the wrong encoding writes of the run, since several chains share it.
    """
    if wrong == "utf-16-be":
        high = [c for c in run if ord(c) > 0x7F]
        if not high or any(ord(c) & 0xFF and ord(c) > 0xFF for c in high) or not any(ord(c) > 0xFF for c in high):
            return run, False
        return "".join(chr(ord(c) >> 8) if ord(c) > 0xFF else c for c in run), len(high) > 2
    w = w or write(run, wrong)
    raw = w.raw
    if right == "utf-8":
        out, at, sure = [], 0, all(x.strip("�") == "" for x in w.lost)
        for m in UTF8.finditer(raw):
            if m.start() > at:
                out.append(_decode(raw[at : m.start()], wrong))
                sure = sure and raw[at : m.start()].isascii()
            out.append(m.group().decode("utf-8"))
            at = m.end()
        if not out:
            return run, False
        if at < len(raw):
            out.append(_decode(raw[at:], wrong))
            sure = sure and raw[at:].isascii()
        text = w.joined("".join(out))
        return (text, sure) if text != run else (run, False)
    try:
        text = w.joined(raw.decode(right))
    except UnicodeDecodeError:
        # stretch by stretch, the last byte of each may have been cut off
        out, some = [], False
        for piece, part in w.cut(run):
            for end in (len(part), len(part) - 1) if HIGH.search(piece) else ():
                try:
                    out.append(part[:end].decode(right) + ("" if end == len(part) else _decode(part[end:], wrong)))
                    some = True
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append(piece)
        text = "".join(x for pair in zip(out, [*w.lost, ""]) for x in pair) if some else run
    return text, False


def _repertoire(wrong: str) -> frozenset[str] | None:
    """The characters beyond ASCII that a single-byte encoding shows; None for multi-byte encodings."""
    if wrong == "west":
        return frozenset(chr(b) for b in range(0x80, 0x100)) | frozenset(map(chr, CP1252))
    shown = {bytes([b]).decode(wrong, "ignore") for b in range(0x80, 0x100)} if wrong not in ("gbk", "big5", "cp932", "cp949", "euc_jp", "utf-16-be") else None
    return None if shown is None else frozenset(shown - {""})


SHOWN = {w: _repertoire(w) for _, w, _ in CHAINS}


#: The chains by wrong encoding, as what it writes of a run serves all of them.
BY_WRONG: dict[str, list[tuple[int, str, int]]] = {}
for _c, (_right, _wrong, _times) in enumerate(CHAINS):
    BY_WRONG.setdefault(_wrong, []).append((_c, _right, _times))


@lru_cache(maxsize=20_000)
def undone_by(run: str) -> tuple[tuple[int, str, bool], ...]:
    """(chain, restored run, sure) of every chain that can be undone in a run; many strings share their runs."""
    high = set(HIGH.findall(run))
    east = any(c >= "\u2e80" for c in high)
    found: list[tuple[int, str, bool]] = []
    for wrong, chains in BY_WRONG.items():
        # a wrong multi-byte decoding shows East Asian characters, a single-byte one its own
        if not (east if SHOWN[wrong] is None else high & SHOWN[wrong]) and wrong != "utf-16-be":
            continue
        w = write(run, wrong) if wrong != "utf-16-be" else None
        wide = w is not None and UTF8.search(w.raw) is not None
        for c, right, times in chains:
            if right == "utf-8" and not wide:
                continue
            new, sure = run, True
            for _ in range(times):
                step, s = undo(new, right, wrong, w if new is run else None)
                if step == new:
                    new = run
                    break
                new, sure = step, sure and s
            if new != run:
                found.append((c, new, sure))
    return tuple(sorted(found))


def undone_runs(text: str) -> tuple[list[str], dict[int, dict[int, tuple[str, bool]]]]:
    """The runs between spaces and brackets with these, and by chain the restored run and sureness of each place it can be undone at."""
    by_chain: dict[int, dict[int, tuple[str, bool]]] = {}
    if not HIGH.search(text):
        return [text], by_chain
    runs = CUT.split(text)
    for i in range(0, len(runs), 2):
        if HIGH.search(runs[i]):
            known = undone_by if len(runs[i]) <= 200 else undone_by.__wrapped__  # long runs hardly come again
            for c, new, sure in known(runs[i]):
                by_chain.setdefault(c, {})[i] = (new, sure)
    return runs, by_chain


def candidates(text: str, known: tuple[list[str], dict[int, dict[int, tuple[str, bool]]]] | None = None) -> list[tuple[int, str, bool]]:
    """(chain, restored text, sure) of the ways to undo a chain that need no model; with one, ``chosen_runs`` adds the likeliest set of runs."""
    runs, by_chain = known or undone_runs(text)
    found: list[tuple[int, str, bool]] = []
    for c in sorted(by_chain):
        undone = by_chain[c]
        sets = [tuple(undone)]
        if len(undone) > 1:
            ks = list(undone)
            sets.append(tuple(k for k in ks if undone[k][1]))
            if SHOWN[CHAINS[c][1]] is None:  # these write all of what was put before or behind in the right script
                sets += [tuple(ks[1:]), tuple(ks[:-1]), tuple(ks[:1]), tuple(ks[-1:])]
        for chosen in dict.fromkeys(s for s in sets if s):
            found.append((c, "".join(undone[i][0] if i in chosen else r for i, r in enumerate(runs)), any(undone[i][1] for i in chosen)))
    return found


@dataclass
class Model:
    """What one round of the algorithm knows: character statistics of restored texts, and chain weights per field."""

    uni: np.ndarray = field(default_factory=lambda: np.zeros(UNI))
    bi: np.ndarray = field(default_factory=lambda: np.zeros(BI))
    priors: np.ndarray = field(default_factory=lambda: np.zeros((1, N_CHAINS)))
    fields: dict[str, int] = field(default_factory=dict)

    def prepared(self) -> Model:
        n = self.uni.sum() + 0.05 * UNI
        self.log_uni = np.log((self.uni + 0.05) / n)
        self.p_uni = (self.uni + 0.05) / n
        p = self.priors + np.where(np.arange(N_CHAINS) == IDENTITY, 20.0, 0.2)
        self.log_prior = np.log(p / p.sum(1, keepdims=True))
        return self


def _pair(codes: np.ndarray) -> np.ndarray:
    """Hashed pairs of each character with the one before."""
    pair = np.zeros(len(codes), np.int64)
    pair[1:] = ((codes[:-1] * 0x9E3779B1 + codes[1:] * 0x85EBCA6B) >> 7) & (BI - 1)
    return pair


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64) & (UNI - 1)


def _slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, hashed pairs with the character before, and the number of characters of each text."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    codes = _codes("".join("\n" + t for t in texts))
    return codes, _pair(codes), size


def slot_likelihood(codes: np.ndarray, pair: np.ndarray, size: np.ndarray, m: Model) -> np.ndarray:
    """Half of the log probability by single characters and half of that by pairs, summed over each text."""
    if not len(size):
        return np.zeros(0)
    before = np.zeros(len(codes), np.int64)
    before[1:] = codes[:-1]
    p = (m.bi[pair] + 2.0 * m.p_uni[codes]) / (m.uni[before] + 2.0)
    score = 0.5 * m.log_uni[codes] + 0.5 * np.log(np.minimum(p, 1.0))
    starts = np.cumsum(size) - size
    score[starts] = 0
    return np.add.reduceat(score, starts)


def log_likelihood(texts: list[str], m: Model) -> np.ndarray:
    return slot_likelihood(*_slots(texts), m)


#: So much likelier (log) a run must be as it is to stay so beside runs that are undone: mostly a string was garbled as a whole.
STAYS = 2.0
BLOCK = "block binary"


@dataclass
class Block:
    """Some strings with all ways to undo chains in them, in flat arrays, so that a round of the algorithm has no loop over strings.

    An option is a run of a string with a chain undone; ``gain`` of an option is how much likelier the string gets by it.
    Separators stay as they are and likelihood sees no further than the character before, so runs can be weighed one by
    one and a version's gain is the sum of its options'. Options whose runs and neighbours agree share an entry of ``around``.
    """

    fields: list[str]
    texts: list[str]
    n: np.ndarray
    around: str  # runs with their neighbours, as they are and undone in turn, each behind a line break
    size: np.ndarray  # characters of each, the line break included
    of_group: np.ndarray  # group of each option
    of_pair: np.ndarray
    place: np.ndarray  # run of each option within its string
    new: list[str]
    sure: np.ndarray
    string: np.ndarray  # of each group, which is a string with a chain
    chain: np.ndarray
    v_group: np.ndarray  # of each version that needs no model
    v_sure: np.ndarray
    m_version: np.ndarray  # its options
    m_option: np.ndarray

    @property
    def mark(self) -> np.ndarray:
        """A number of each option, whose sums tell sets of options apart."""
        return np.random.default_rng(1).integers(-(2**62), 2**62, len(self.new))

    @property
    def lost(self) -> np.ndarray:
        """Which strings hold replacement characters."""
        return np.array(["�" in t for t in self.texts], bool)


def block_of(fields: list[str], texts: list[str], n: list[int]) -> Block:
    """The block of some distinct strings."""
    pair_at: dict[tuple[str, str, str, str], int] = {}
    around: list[str] = []
    of_group, of_pair, place, new, sure, string, chain = [], [], [], [], [], [], []
    v_group, v_sure, m_version, m_option = [], [], [], []
    for i, t in enumerate(texts):
        runs, by_chain = undone_runs(t)
        for c in sorted(by_chain):
            g = len(string)
            string.append(i)
            chain.append(c)
            first = len(new)
            options = by_chain[c]
            for k, (text, known) in options.items():
                key = (runs[k - 1][-1:] if k else "", runs[k], runs[k + 1][:1] if k + 1 < len(runs) else "", text)
                at = pair_at.get(key)
                if at is None:
                    at = pair_at[key] = len(around) // 2
                    around += [key[0] + key[1] + key[2], key[0] + text + key[2]]
                of_group.append(g)
                of_pair.append(at)
                place.append(k)
                new.append(text)
                sure.append(known)
            size = len(options)
            sets = [range(size)]
            if size > 1:
                sets.append([k for k in range(size) if sure[first + k]])
                if SHOWN[CHAINS[c][1]] is None:  # these write all of what was put before or behind in the right script
                    sets += [range(1, size), range(size - 1), [0], [size - 1]]
            for chosen in dict.fromkeys(tuple(x) for x in sets if len(x)):
                m_version += [len(v_group)] * len(chosen)
                m_option += [first + k for k in chosen]
                v_group.append(g)
                v_sure.append(any(sure[first + k] for k in chosen))
    m_version, m_option = np.array(m_version, np.int64), np.array(m_option, np.int64)
    ints = lambda x: np.array(x, np.int32)
    return Block(fields, texts, np.array(n, float), "".join("\n" + t for t in around), ints([len(t) + 1 for t in around]), ints(of_group), ints(of_pair), ints(place), new, np.array(sure, bool), ints(string), ints(chain), ints(v_group), np.array(v_sure, bool), ints(m_version), ints(m_option))


@dataclass
class Versions:
    """All versions of a block's strings with their posterior: first each string as it is, then those of ``Block``, then chosen sets."""

    string: np.ndarray
    chain: np.ndarray
    sure: np.ndarray
    p: np.ndarray
    taken: np.ndarray  # options that a chosen set takes
    static: int
    group: np.ndarray

    def text(self, b: Block, v: int) -> str:
        """The text of a version."""
        if v < len(b.texts):
            return b.texts[v]
        k = v - len(b.texts)
        options = b.m_option[b.m_version == k] if k < self.static else np.flatnonzero(self.taken & (b.of_group == self.group[v]))
        runs = CUT.split(b.texts[self.string[v]])
        for o in options:
            runs[b.place[o]] = b.new[o]
        return "".join(runs)


def versions_of(b: Block, m: Model | None, fields: dict[str, int]) -> Versions:
    """The posteriors of a block. Without a model the evidence is structural: bytes that fit a chain throughout."""
    k, groups = len(b.texts), len(b.string)
    group, sure = b.v_group.astype(np.int64), b.v_sure
    lost = b.lost
    score = np.zeros(len(group))
    taken = np.zeros(len(b.new), bool)
    if m is not None and len(b.new):
        codes = _codes(b.around)
        each = slot_likelihood(codes, _pair(codes), b.size.astype(np.int64), m)
        gain = (each[1::2] - each[::2])[b.of_pair]
        score = np.bincount(b.m_version, gain[b.m_option], len(group))
        # of each chain the likeliest set of runs, where that is some but not all and no version yet
        taken = gain > -STAYS
        some, all_ = np.bincount(b.of_group, taken, groups), np.bincount(b.of_group, minlength=groups)
        better = np.bincount(b.of_group, gain > 0, groups) > 0
        v_mark, mark, marks = np.zeros(len(group), np.int64), b.mark, np.zeros(groups, np.int64)
        np.add.at(v_mark, b.m_version, mark[b.m_option])
        np.add.at(marks, b.of_group[taken], mark[taken])
        made = (some < all_) & better
        known = set(zip(group.tolist(), v_mark.tolist()))
        made[[g for g in np.flatnonzero(made).tolist() if (g, int(marks[g])) in known]] = False
        at = np.flatnonzero(made)
        taken &= made[b.of_group]
        group = np.concatenate([group, at])
        score = np.concatenate([score, np.bincount(b.of_group[taken], gain[taken], groups)[at]])
        sure = np.concatenate([sure, (np.bincount(b.of_group[taken & b.sure], minlength=groups) > 0)[at]])
    string = np.concatenate([np.arange(k), b.string[group]])
    chain = np.concatenate([np.where(lost, LOST, IDENTITY), b.chain[group]])
    sure = np.concatenate([np.zeros(k, bool), sure])
    count = np.bincount(string, minlength=k)
    if m is None:
        any_sure = np.bincount(string, sure, k) > 0
        p = np.where(sure, 1.0, 0.5 / count[string])
        p[:k] = np.where(any_sure, 0.02, 1.0)
    else:
        alike = np.bincount(string * N_CHAINS + chain, minlength=k * N_CHAINS)[string * N_CHAINS + chain]
        code = np.array([fields.get(f, 0) for f in b.fields], np.int64)
        s = np.concatenate([np.zeros(k), score]) + m.log_prior[code[string], np.where(chain == LOST, IDENTITY, chain)] - np.log(alike)
        top = np.full(k, -np.inf)
        np.maximum.at(top, string, s)
        p = np.exp(s - top[string])
    p /= np.bincount(string, p, k)[string]
    return Versions(string, chain, sure, p, taken, len(b.v_group), np.concatenate([np.full(k, -1), group]))


def _with_blocks(batches: Iterator[pa.RecordBatch], most_chars: int = 15_000) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block_of(*map(list, zip(*rows))), 5)], pa.binary())], names=["block"])

    rows, size = [], 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(3))):
            rows.append(row)
            size += len(row[1]) + 20
            if size >= most_chars:
                yield packed(rows)
                rows, size = [], 0
    if rows:
        yield packed(rows)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for x in b.column(0):
            yield pickle.loads(x.as_buffer())  # noqa: S301


def _expect(batches: Iterator[pa.RecordBatch], sent: object) -> Iterator[pa.RecordBatch]:
    """Expected counts of one task: (kind, slot, weight) with kind 0 characters, 1 pairs, 2 chains by field, 3 the expectation itself.

    Characters are learned from strings as they are and from restorations whose bytes fit throughout. Others have to
    be supported by these: if they supported each other, a chain could explain everything by rare characters.
    """
    m: Model | None = sent.value[0]
    names: dict[str, int] = sent.value[1]
    uni, bi, pri, garbled = np.zeros(UNI), np.zeros(BI), np.zeros((len(names) + 1) * N_CHAINS), 0.0

    def count(slots: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray) -> None:
        nonlocal uni, bi
        codes, pair, size = slots
        weight = np.repeat(w, size)
        uni += np.bincount(codes, weight, UNI)
        weight[np.cumsum(size) - size] = 0
        bi += np.bincount(pair, weight, BI)

    for b in _blocks(batches):
        v = versions_of(b, m, names)
        k = len(b.texts)
        code = np.array([names.get(f, 0) for f in b.fields], np.int64)
        pri += np.bincount(code[v.string] * N_CHAINS + v.chain, b.n[v.string] * v.p, len(pri))
        share = np.log1p(b.n)  # many copies of one text say little about others
        count(_slots(b.texts), np.where(b.lost | (v.p[:k] <= 1e-3), 0.0, v.p[:k] * share))
        more = np.flatnonzero(v.sure & (v.p > 1e-3))
        if len(more):
            count(_slots([v.text(b, int(x)) for x in more]), v.p[more] * share[v.string[more]])
        garbled += float((b.n * (1 - v.p[:k])).sum())
    for kind, a in enumerate((uni, bi, pri, np.array([garbled]))):
        at = np.flatnonzero(a)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(a[at])], names=["kind", "slot", "weight"])


def learn(blocks: DataFrame, fields: DataFrame, *, most_rounds: int = 12, settled: float = 0.01, most_fields: int = 100_000) -> Model:
    """Fit the model to a table of blocks by expectation-maximization, until the expected number of garbled strings is settled.

    ``field`` names source and field, whose chain weights are shared by all their records; field names are metadata, more
    than ``most_fields`` raise an error. A round is the last if it changes the expected number of garbled strings by at
    most the share ``settled``, or is round ``most_rounds``. Statistics live in fixed tables of 2^17 characters and 2^18
    hashed pairs, which with the fields' weights is all that reaches the driver, whatever the data's size.
    """
    spark = blocks.sparkSession
    listed = fields.distinct().limit(most_fields + 1).collect()
    if len(listed) > most_fields:
        raise ValueError(f"there are more than {most_fields} fields")
    names = {f: i + 1 for i, f in enumerate(sorted(r[0] for r in listed))}
    model: Model | None = None
    before = None
    for done in range(1, most_rounds + 1):
        sent = spark.sparkContext.broadcast((model, names))
        made = blocks.mapInArrow(lambda b, sent=sent: _expect(b, sent), "kind int, slot long, weight double").groupBy("kind", "slot").agg(F.sum("weight").alias("weight")).toArrow()
        kind, slot, weight = (made.column(c).to_numpy() for c in ("kind", "slot", "weight"))
        model = Model(fields=names, priors=np.zeros((len(names) + 1, N_CHAINS)))
        for k, a in enumerate((model.uni, model.bi, model.priors.reshape(-1))):
            a[slot[kind == k]] = weight[kind == k]
        model.prepared()
        sent.destroy()
        garbled = float(weight[kind == 3].sum())
        # the first round has no model, and the second is the first to weigh sets of runs
        if done > 3 and abs(garbled - before) <= settled * max(garbled, 1.0):
            break
        before = garbled
    return model


def _judge(batches: Iterator[pa.RecordBatch], sent: object) -> Iterator[pa.RecordBatch]:
    """The garbled strings of a task with their best restoration."""
    m: Model = sent.value
    for b in _blocks(batches):
        v = versions_of(b, m, m.fields)
        k = len(b.texts)
        lost = b.lost
        hit = np.flatnonzero(lost | (v.p[:k] < 0.5))
        if not len(hit):
            continue
        # the likeliest version of each string, the first of equals
        order = np.lexsort([np.arange(len(v.p)), -v.p, v.string])
        best = np.zeros(k, np.int64)
        best[v.string[order][::-1]] = order[::-1]
        rows = []
        for i in hit.tolist():
            x = int(best[i])
            chain = int(v.chain[x])
            name = "lost" if chain in (LOST, IDENTITY) else " ".join(map(str, CHAINS[chain]))
            rows.append((b.fields[i], b.texts[i], v.text(b, x) if x >= k else None, name, float(v.p[x]) if lost[i] else float(1 - v.p[i])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] * 4 + [pa.float64()])], names=["field", "text", "restored", "chain", "posterior"])


def repair_garbled(strings: DataFrame, *, keys: list[str], most_rounds: int = 12) -> DataFrame:
    """The garbled ones of the strings (``keys``, field, text): keys, text, restored, chain, posterior.

    All ways to undo an encoding chain are written down once per distinct string of a field; expectation-maximization
    then weighs them by how common the restored characters are in all data and how common the chain is in the field.
    A string is garbled if the chains together outweigh the string itself, or if replacement characters show that bytes
    were lost. ``restored`` is the likeliest version, null where that is the string itself; what was lost stays a
    replacement character. Null and empty strings are never garbled, a null field is a field of its own, repeated rows
    are judged alike, an empty input gives an empty table.
    """
    spark = strings.sparkSession
    named = strings.select(*keys, F.coalesce("field", F.lit("")).alias("field"), "text").where("text is not null and text <> ''")
    counted = named.groupBy("field", "text").agg(F.count(F.lit(1)).alias("n"))
    # few bytes, but much work each: the number of tasks is set, lest they be put together
    parts = max(parts_for(strings, 2 << 20), 2 * spark.sparkContext.defaultParallelism)
    # neighbours in order share their runs, which are undone once while they are remembered
    blocks = materialise(counted.repartition(parts, "text").sortWithinPartitions("text").mapInArrow(_with_blocks, BLOCK), "versions")
    sent = spark.sparkContext.broadcast(learn(blocks, named.select("field"), most_rounds=most_rounds))
    garbled = blocks.mapInArrow(lambda b: _judge(b, sent), "field string, text string, restored string, chain string, posterior double")
    return named.join(garbled, ["field", "text"]).select(*keys, "text", "restored", "chain", "posterior")


def chat_strings(td: DataFrame, tx: DataFrame) -> DataFrame:
    """All strings of the record and field tables: src_table, row_key, text_pos, field, text."""
    a = td.select(F.lit("td_records").alias("src_table"), F.col("record_id").alias("row_key"), F.concat(F.lit("td/"), F.coalesce("tag", F.lit(""))).alias("field"), F.posexplode("decoded_texts").alias("text_pos", "text"))
    b = tx.select(F.lit("tx_fields").alias("src_table"), F.col("field_id").alias("row_key"), F.concat(F.lit("tx/"), F.coalesce("field_name", F.lit(""))).alias("field"), F.posexplode("value_texts").alias("text_pos", "text"))
    return a.unionByName(b)
