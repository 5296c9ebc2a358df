"""Messages delivered more than once: a persistent index of sorted identifier arrays."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from parleylake.runtime import names_in, new_path, put_text, remove

#: A run holds, per hash prefix, identifiers sorted by hash as packed 64-bit arrays, and the smallest row id of each.
RUN = "prefix int, n long, h binary, t binary, r binary, s binary, keeper binary"
COLS = ("h", "t", "r", "s", "keeper")
RUN_COLS = ["prefix", "n", *COLS]
#: Identifiers in one binary cell at most, 2 MB each.
CELL = 1 << 18
#: Times above this are milliseconds: as seconds they would lie after the year 5100.
MS_FROM = 100_000_000_000


def whole_second(t: Column) -> Column:
    """A time in seconds or milliseconds, to the whole second."""
    return F.when(F.abs(t) >= MS_FROM, F.floor(t / F.lit(1000).cast("decimal(10,0)"))).otherwise(t).cast("long")


def unsigned32(r: Column) -> Column:
    """A 32-bit number written signed or unsigned, as unsigned."""
    return r.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def identified(rows: DataFrame, row_id: str, time: str, rand: str, sender: str) -> DataFrame:
    """(id, t, r, s, h) of the rows that have an identity: none of id, time, rand and sender is null."""
    d = rows.select(F.col(row_id).cast("long").alias("id"), whole_second(F.col(time)).alias("t"), unsigned32(F.col(rand)).alias("r"), F.col(sender).cast("long").alias("s")).dropna()
    return d.withColumn("h", F.xxhash64("t", "r", "s"))


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def _unpack(pdf: pd.DataFrame) -> list[dict[str, np.ndarray]]:
    return [{c: np.frombuffer(row[c], "<i8") for c in COLS} for row in pdf.to_dict("records")]


def _pack(prefix: int, run: dict[str, np.ndarray]) -> pd.DataFrame:
    """The rows of one prefix; an array longer than ``CELL`` goes into several, each sorted."""
    n = len(run["h"])
    cells = [{c: run[c][lo : lo + CELL] for c in COLS} for lo in range(0, n, CELL)]
    return pd.DataFrame([{"prefix": prefix, "n": len(x["h"]), **{c: np.ascontiguousarray(x[c], "<i8").tobytes() for c in COLS}} for x in cells], columns=RUN_COLS)


def _finer(frames: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Rows of runs cut where a longer prefix changes: arrays of one prefix are sorted by it too."""
    for f in frames:
        for run in _unpack(f):
            p = (run["h"].view("<u8") >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(p)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)]):
                yield _pack(int(p[lo]), {c: run[c][lo:hi] for c in COLS})


def _sorted_unique(run: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sorted by (h, t, r, s), one entry per identifier, with its smallest keeper."""
    o = np.lexsort([run[c] for c in ("keeper", "s", "r", "t", "h")])
    run = {c: run[c][o] for c in COLS}
    new = np.ones(len(o), bool)
    if len(o) > 1:
        new[1:] = np.logical_or.reduce([run[c][1:] != run[c][:-1] for c in ("h", "t", "r", "s")])
    return {c: run[c][new] for c in COLS}


def _known(run: dict[str, np.ndarray], batch: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keeper of each identifier of the batch in the run, found by binary search, and whether the run holds it.

    Equal hashes are told apart by the identifier itself.
    """
    lo, hi = np.searchsorted(run["h"], batch["h"], "left"), np.searchsorted(run["h"], batch["h"], "right")
    found, has = np.zeros(len(lo), np.int64), np.zeros(len(lo), bool)
    step = 0
    while True:
        at = lo + step
        open_ = (at < hi) & ~has
        if not open_.any():
            break
        i = at[open_]
        same = (run["t"][i] == batch["t"][open_]) & (run["r"][i] == batch["r"][open_]) & (run["s"][i] == batch["s"][open_])
        w = np.flatnonzero(open_)[same]
        has[w], found[w] = True, run["keeper"][at[w]]
        step += 1
    return np.where(has, found, np.iinfo(np.int64).max), has


def _absorb(key: tuple, batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The new run of one prefix: identifiers that no run holds, and known ones seen now with a smaller id."""
    if batch.empty:
        return pd.DataFrame({c: [] for c in RUN_COLS})
    b = _sorted_unique({**{c: batch[c].to_numpy(np.int64) for c in ("h", "t", "r", "s")}, "keeper": batch["id"].to_numpy(np.int64)})
    novel, best = np.ones(len(b["h"]), bool), np.full(len(b["h"]), np.iinfo(np.int64).max)
    for run in _unpack(index):
        keeper, has = _known(run, b)
        best, novel = np.minimum(best, keeper), novel & ~has
    take = novel | (b["keeper"] < best)
    return _pack(int(key[0]), {c: b[c][take] for c in COLS})


def _together(runs: pd.DataFrame) -> dict[str, np.ndarray]:
    parts = _unpack(runs)
    return _sorted_unique({c: np.concatenate([p[c] for p in parts]) for c in COLS})


def _merge(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
    return _pack(int(key[0]), _together(runs))


class DeliveryIndex:
    """Identifiers seen so far, as immutable runs in a folder, merged every ``merge_every`` runs.

    The folder outlives the session: a manifest names the runs and the batches absorbed, and an index made with the same
    ``path`` goes on where the last one stopped. Manifests are numbered and never overwritten, so of two writers one
    fails, and a run that was being written when its job died is in no manifest.

    A hash prefix is what one task holds at a time. Prefixes get longer as the index grows, so that none has more than
    some ``per_prefix`` identifiers a run; older runs are cut to the longer prefix as they are read. Identifiers spread
    evenly over the prefixes by hash, and a batch is reduced to one row per identifier on the map side before it is
    shuffled, so neither a much repeated message nor a large batch makes a large task.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, per_prefix: int = 500_000, least_bits: int = 4, merge_every: int = 3) -> None:
        self.spark, self.path = spark, path or new_path(spark, "deliveries")
        self.per_prefix, self.merge_every = per_prefix, merge_every
        self.at, self.bits, self.runs, self.fed = 0, least_bits, [], []
        known = [n for n in names_in(spark, f"{self.path}/manifest") if n.endswith(".json")]
        if known:
            last = json.loads(spark.read.text(f"{self.path}/manifest/{known[-1]}", wholetext=True).first()[0])
            self.at, self.bits, self.runs, self.fed = int(known[-1][:-5]), last["bits"], last["runs"], last["fed"]

    @property
    def size(self) -> int:
        """The number of identifiers, those counted twice that two runs hold."""
        return sum(r["n"] for r in self.runs)

    def _commit(self) -> None:
        self.at += 1
        put_text(self.spark, f"{self.path}/manifest/{self.at:010d}.json", json.dumps({"bits": self.bits, "runs": self.runs, "fed": self.fed}))

    def _write(self, run: DataFrame) -> dict:
        at = f"{self.path}/runs/{uuid.uuid4().hex}"
        run.write.option("compression", "zstd").parquet(at)
        n = self.spark.read.schema(RUN).parquet(at).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return {"path": at, "n": n, "bits": self.bits}

    def _read(self) -> DataFrame:
        parts = []
        for bits in sorted({r["bits"] for r in self.runs}):
            rows = self.spark.read.schema(RUN).parquet(*[r["path"] for r in self.runs if r["bits"] == bits])
            parts.append(rows if bits == self.bits else rows.mapInPandas(partial(_finer, bits=self.bits), RUN))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], RUN)

    def _fit(self, n: int) -> None:
        """Lengthen the prefix for ``n`` identifiers."""
        self.bits = min(30, max(self.bits, math.ceil(math.log2(max(1, n / self.per_prefix)))))

    def absorb(self, batch: DataFrame, *, row_id: str, time: str, rand: str, sender: str, fed: str | None = None) -> None:
        """Add one incoming batch. ``fed`` is a table of batch names that the manifest shall remember with it."""
        self._fit(self.size + batch.count())
        seen = identified(batch, row_id, time, rand, sender).groupBy("h", "t", "r", "s").agg(F.min("id").alias("id")).withColumn("prefix", _prefix(F.col("h"), self.bits))
        run = self._write(seen.groupBy("prefix").cogroup(self._read().groupBy("prefix")).applyInPandas(_absorb, RUN))
        self.runs = [*self.runs, run]
        self.fed = [*self.fed, *([fed] if fed else [])]
        self._commit()
        if len(self.runs) > self.merge_every:
            self.merge()

    def merge(self) -> None:
        """Put all runs together into one; the old ones are deleted once a manifest without them is written."""
        if len(self.runs) < 2:
            return
        old, self.runs = self.runs, [self._write(self._read().groupBy("prefix").applyInPandas(_merge, RUN))]
        self._commit()
        for r in old:
            remove(self.spark, r["path"])

    def feed(self, rows: DataFrame, *, batch: str, row_id: str, time: str, rand: str, sender: str, round_rows: int = 20_000_000, least_rounds: int = 2) -> int:
        """Absorb the rows of all batches that are not in the index yet, and give the number of these batches.

        Batches come in order of their names, put together to rounds of some ``round_rows`` rows, but at least
        ``least_rounds`` rounds. A batch counts as known once it was absorbed, so a row that turns up in it later is not
        looked at; rows without a batch name are absorbed every time, which changes nothing if they are known.
        """
        name = F.col(batch).cast("string")
        if self.fed:
            rows = rows.join(self.spark.read.schema("batch string").parquet(*self.fed).withColumnRenamed("batch", "_batch"), name == F.col("_batch"), "left_anti")
        kind = rows.schema[batch].dataType
        sizes = rows.groupBy(F.col(batch).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        at = new_path(self.spark, "batches")
        sizes.write.parquet(at)
        sizes = self.spark.read.parquet(at)
        total, batches = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("b")).first()
        if not total:
            return 0
        rounds = max(least_rounds, -(-total // round_rows))
        numbered = isinstance(kind, NumericType)
        # cut points lie between batches, of equal weight; names that are no numbers are placed by hash
        place = (lambda c: c) if numbered else (lambda c: F.xxhash64(c))
        cuts = sorted(set(rows.agg(F.percentile_approx(place(F.col(batch)), [i / rounds for i in range(1, rounds)])).first()[0] or [])) if rounds > 1 else []
        for lo, hi in zip([None, *cuts], [*cuts, None]):
            within = lambda c: (F.lit(True) if lo is None else c > lo) & (F.lit(True) if hi is None else c <= hi)  # noqa: B023, E731
            part = rows.where(F.coalesce(within(place(F.col(batch))), F.lit(lo is None)))
            fed = f"{self.path}/fed/{uuid.uuid4().hex}"
            sizes.where(F.col("b").isNotNull() & within(place(F.col("b")))).select(F.col("b").cast("string").alias("batch")).write.parquet(fed)
            self.absorb(part, row_id=row_id, time=time, rand=rand, sender=sender, fed=fed)
        return batches

    def keepers(self) -> DataFrame:
        """The id of the row to keep of each identifier."""
        if len(self.runs) == 1:
            return self._read().select("keeper").mapInPandas(_all_keepers, "id long")
        return self._read().groupBy("prefix").applyInPandas(lambda r: pd.DataFrame({"id": _together(r)["keeper"]}), "id long")


def _all_keepers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for k in f["keeper"]:
            yield pd.DataFrame({"id": np.frombuffer(k, "<i8")})


def build_index(rows: DataFrame, *, path: str | None = None, batch: str = "batch_id", row_id: str = "sample_id", time: str = "msg_time", rand: str = "rand", sender: str = "sender_uin", **options: int) -> DeliveryIndex:
    """The index at ``path`` (a new one without) fed with the batches of ``rows`` that it does not know yet."""
    feeding = {k: options.pop(k) for k in ("round_rows", "least_rounds") if k in options}
    index = DeliveryIndex(rows.sparkSession, path, **options)
    index.feed(rows, batch=batch, row_id=row_id, time=time, rand=rand, sender=sender, **feeding)
    return index


def surplus_copies(rows: DataFrame, index: DeliveryIndex, *, row_id: str = "sample_id", time: str = "msg_time", rand: str = "rand", sender: str = "sender_uin") -> DataFrame:
    """The ids of all rows of a message but the one that the index keeps, which has the smallest id.

    Rows with a null among id, time, rand and sender are copies of nothing. Ids must be unique. The index is asked by row
    id: a lookup by identifier would bring all copies of a much repeated message into one task.
    """
    ids = identified(rows, row_id, time, rand, sender).select("id")
    return ids.join(index.keepers(), "id", "left_anti").select(F.col("id").alias(row_id))


def exactly_once(rows: DataFrame, *, path: str | None = None, row_id: str = "sample_id", batch: str = "batch_id", time: str = "msg_time", rand: str = "rand", sender: str = "sender_uin") -> DataFrame:
    """``rows`` with exactly one row per message: times agree to the second, rand as unsigned 32-bit number, and sender.

    Of each message the row with the smallest id stays; rows that lack a part of the identity all stay. Other columns,
    whatever their names, pass through. An empty input gives an empty table. With the ``path`` of an index only batches
    new to it are absorbed, and rows that earlier batches brought already are left out too.
    """
    index = build_index(rows, path=path, batch=batch, row_id=row_id, time=time, rand=rand, sender=sender)
    return rows.join(surplus_copies(rows, index, row_id=row_id, time=time, rand=rand, sender=sender), row_id, "left_anti")
