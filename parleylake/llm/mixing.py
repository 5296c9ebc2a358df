"""Sources combined to target shares of all tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleylake.llm.tokens import VOCABULARY, token_counts
from parleylake.runtime import materialise


@dataclass(frozen=True)
class Rate:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    rate: float


def repetition_rates(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: float | None = None) -> list[Rate]:
    """How often each source is to be repeated so that it gives its share of ``total`` tokens.

    ``total`` is all tokens of the targeted sources unless given. A source that cannot give its share even at its
    ``max_repeats`` gives all it has, and what it lacks goes to the others in proportion to their shares, until nobody
    is left who can give more; an absent source gives nothing.
    """
    want = sum(tokens.get(s, 0) for s, _, _ in targets) if total is None else total
    most = {s: m * tokens.get(s, 0) for s, _, m in targets}
    given: dict[str, float] = {s: 0.0 for s, _, _ in targets}
    open_ = [(s, share) for s, share, _ in targets if share > 0 and most[s] > 0]
    left = float(want)
    while open_ and left > 0:
        shares = sum(x for _, x in open_)
        full = [(s, x) for s, x in open_ if left * x / shares >= most[s]]
        if not full:
            for s, x in open_:
                given[s] = left * x / shares
            break
        for s, _ in full:
            given[s] = most[s]
            left -= most[s]
        open_ = [(s, x) for s, x in open_ if (s, x) not in full]
    return [Rate(s, share, m, tokens.get(s, 0), given[s] / tokens[s] if tokens.get(s) else 0.0) for s, share, m in targets]


def read_targets(targets: DataFrame, most: int = 10_000) -> list[tuple[str, float, int]]:
    """The targets (source, share, max_repeats); more than ``most`` raise an error, rows with a null are left out, of a
    repeated source the greatest row counts, and shares are divided by their sum."""
    rows = targets.select("source", "target_share", "max_repeats").dropna().groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).orderBy("source").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"there are more than {most} sources")
    whole = sum(max(0.0, r.t.target_share) for r in rows) or 1.0
    return [(r.source, max(0.0, r.t.target_share) / whole, max(0, r.t.max_repeats)) for r in rows]


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents, kept in the shared folder so that texts are tokenized once."""
    return materialise(token_counts(documents, ["doc_id", "source"], vocabulary=vocabulary), "sizes")


def rates_of(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> list[Rate]:
    """The repetition rates for documents of these sizes; only one row per targeted source reaches the driver."""
    wanted = read_targets(targets)
    per = sizes.where(F.col("source").isin([s for s, _, _ in wanted])).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    return repetition_rates(wanted, {r.source: r.n for r in per}, total)


def with_copies(df: DataFrame, rates: list[Rate], *, doc_id: str = "doc_id", source: str = "source", seed: int = 17) -> DataFrame:
    """``df`` with ``copies``: floor(rate), and one more with the rate's fraction as probability, drawn by hash of the id.

    The draw depends on seed and id alone, so it is the same in every run and on every executor. Documents of sources
    without a target, or with a null source, have 0 copies.
    """
    spark = df.sparkSession
    listed = spark.createDataFrame([(r.source, float(r.rate), int(r.max_repeats)) for r in rates], "_s string, _rate double, _most int")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11) / F.lit(float(2**53))
    low = F.floor("_rate")
    # at most read_targets' number of sources
    joined = df.join(F.broadcast(listed), F.col(source) == F.col("_s"), "left")
    copies = F.least(low + (u < F.col("_rate") - low).cast("int"), F.col("_most"))
    return joined.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("int")).drop("_s", "_rate", "_most")


def mix_sources(documents: DataFrame, targets: DataFrame, *, total: float | None = None, seed: int = 17, vocabulary: str = VOCABULARY, sizes: DataFrame | None = None) -> DataFrame:
    """The documents of the mix, each as often as it is used, with ``copy_no`` from 0.

    Needs the columns doc_id, source and text; others pass through. Null and empty texts have 0 tokens, so they follow
    their source's rate without weighing anything. Repeated rows of one id are drawn alike. Empty inputs give an empty
    mix. Nothing is shuffled: the rates are broadcast and every document is drawn by itself.
    """
    sizes = sized(documents, vocabulary) if sizes is None else sizes
    drawn = with_copies(documents, rates_of(sizes, targets, total), seed=seed).where("copies > 0")
    return drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")


def mix_report(documents: DataFrame, targets: DataFrame, *, total: float | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per source its target and actual share of the tokens of the mix, its rate, its tokens before and after."""
    sizes = sized(documents, vocabulary)
    rates = rates_of(sizes, targets, total)
    used = with_copies(sizes, rates, seed=seed).where("copies > 0").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").cast("long").alias("mixed_documents"), F.max("copies").alias("most_copies"))
    spark = documents.sparkSession
    plan = spark.createDataFrame([(r.source, r.target_share, r.max_repeats, r.tokens, r.rate) for r in rates], "source string, target_share double, max_repeats int, source_tokens long, rate double")
    joined = plan.join(used, "source", "left").na.fill(0, ["mixed_tokens", "mixed_documents", "most_copies"])
    # the whole is one row
    whole = joined.agg(F.sum("mixed_tokens").alias("_all"))
    return joined.join(F.broadcast(whole)).withColumn("actual_share", F.coalesce(F.try_divide("mixed_tokens", "_all"), F.lit(0.0))).drop("_all")
