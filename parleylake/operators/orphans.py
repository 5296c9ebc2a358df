"""References to records that do not exist, found with a Bloom filter and verified by exact joins."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleylake.functions.names import path_key
from parleylake.runtime import materialise

BLOCK_BITS = 32_768
HASHES = 4


def _positions(key: list[Column], blocks: int) -> list[Column]:
    """Block number and one bit position per hash function."""
    h1, h2 = F.xxhash64(*key), F.xxhash64(F.lit(77), *key)
    bits = [F.pmod(F.shiftright(h2, 15 * i), F.lit(BLOCK_BITS)).cast("long").alias(f"p{i}") for i in range(HASHES)]
    return [F.pmod(h1, F.lit(blocks)).cast("int").alias("block"), *bits]


def bloom_filter(parents: DataFrame, key: list[str], *, max_blocks: int = 1024, keys_a_block: int = 16_384) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of the key columns as a table of (block, b0..b3) and its number of blocks.

    Each block holds ``HASHES`` bit arrays of 4 KB. The table never exceeds ``max_blocks`` blocks (16 MB by default),
    which bounds what is broadcast; with more parents than it is meant for only its power to prove orphans falls.
    """
    n = parents.count()
    blocks = max(1, min(max_blocks, ceil(n / keys_a_block)))
    at = parents.select(*_positions([F.col(c) for c in key], blocks))
    return at.groupBy("block").agg(*[F.bitmap_construct_agg(F.col(f"p{i}")).alias(f"b{i}") for i in range(HASHES)]), blocks


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(bitmap.substr((position.cast("int") / F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, F.pmod(position, F.lit(8)).cast("int"))


def maybe_known(refs: DataFrame, key: list[str], bloom: DataFrame, blocks: int, to: str = "maybe") -> DataFrame:
    """``refs`` with a boolean: false proves that no parent has the key."""
    at = refs.select("*", *_positions([F.col(c) for c in key], blocks))
    # bounded by max_blocks, see bloom_filter
    hit = at.join(F.broadcast(bloom), "block", "left")
    every = F.lit(True)
    for i in range(HASHES):
        every = every & (F.coalesce(_bit(F.col(f"b{i}"), F.col(f"p{i}")), F.lit(0)) == 1)
    return hit.withColumn(to, every).drop("block", *[f"p{i}" for i in range(HASHES)], *[f"b{i}" for i in range(HASHES)])


def orphan_references(refs: DataFrame, parents: DataFrame, *, ref_id: str, ref_key: list[str], ref_time: str, parent_key: list[str], parent_time: str, max_blocks: int = 1024) -> DataFrame:
    """The references (ref_id, ref_time) for whose key no parent existed at the time of the reference.

    ``parents`` holds the valid parents. A Bloom filter over their keys proves most orphans at once; only references it
    passes are joined exactly with the earliest ``parent_time`` of each key. A parent without a time existed at no
    time; a reference without a time, or with a null in its key, has no parent. Repeated references give repeated rows,
    repeated parents count once. References are not collected anywhere and a key that holds many references is split by
    adaptive execution, since the parent side has one row per key.
    """
    ks = [f"k{i}" for i in range(len(ref_key))]
    known = parents.select(*[F.col(c).alias(k) for c, k in zip(parent_key, ks)], F.col(parent_time).alias("pt")).where(" and ".join(f"{k} is not null" for k in [*ks, "pt"]))
    # read three times: to size the filter, to fill it and to verify
    known = materialise(known.groupBy(*ks).agg(F.min("pt").alias("pt")), "parents")
    r = refs.select(F.col(ref_id).alias("ref_id"), F.col(ref_time).alias("ref_time"), *[F.col(c).alias(k) for c, k in zip(ref_key, ks)])
    bloom, blocks = bloom_filter(known, ks, max_blocks=max_blocks)
    marked = maybe_known(r, ks, bloom, blocks)
    proven = marked.where("not maybe").select("ref_id", "ref_time")
    joined = marked.where("maybe").join(known, ks, "left")
    verified = joined.where("pt is null or ref_time is null or pt > ref_time").select("ref_id", "ref_time")
    return proven.unionByName(verified)


def paths_within(text: Column, root: str = "UserData") -> Column:
    """The paths written inside a free text: they start with the root folder and hold no spaces."""
    return F.regexp_extract_all(text, F.lit(rf"(?i)({root}[\\/][^\s\[\]\"'<>|*?,;；，。：、()（）]+)"), F.lit(1))


def matches_without_file(matches: DataFrame, files: DataFrame, *, max_blocks: int = 1024) -> DataFrame:
    """The asset matches (ref_id, ref_time) that name at least one path, none of which was a listed, present file then.

    Paths come from ``candidate_paths`` and from ``unmatched_reason`` and compare as on Windows. Null arrays, elements
    and texts name nothing. Matches present twice give one row per distinct time.
    """
    m = matches.select(F.col("match_id").alias("ref_id"), F.col("ingested_at").alias("ref_time"), F.concat(F.coalesce("candidate_paths", F.array().cast("array<string>")), F.coalesce(paths_within(F.col("unmatched_reason")), F.array().cast("array<string>"))).alias("paths"))
    named = m.select("ref_id", "ref_time", F.explode(F.array_distinct(F.transform(F.array_compact("paths"), path_key))).alias("k0")).where("k0 <> ''")
    known = files.where(~F.coalesce(F.col("is_deleted"), F.lit(False)) & F.col("path").isNotNull() & F.col("listed_at").isNotNull()).groupBy(path_key(F.col("path")).alias("k0")).agg(F.min("listed_at").alias("pt"))
    known = materialise(known, "parents")
    bloom, blocks = bloom_filter(known, ["k0"], max_blocks=max_blocks)
    marked = maybe_known(named, ["k0"], bloom, blocks)
    # definite orphan paths keep no file; the others are verified by the exact join
    proven = marked.where("not maybe").select("ref_id", "ref_time", F.lit(0).alias("here"))
    verified = marked.where("maybe").join(known, "k0", "left").select("ref_id", "ref_time", F.coalesce((F.col("pt") <= F.col("ref_time")).cast("int"), F.lit(0)).alias("here"))
    return proven.unionByName(verified).groupBy("ref_id", "ref_time").agg(F.max("here").alias("here")).where("here = 0").select("ref_id", "ref_time")


def chat_orphans(quotes: DataFrame, matches: DataFrame, messages: DataFrame, contacts: DataFrame, own: DataFrame, files: DataFrame, *, max_blocks: int = 1024) -> DataFrame:
    """All orphan references of quotes and asset matches: (ref_table, ref_field, ref_key, ref_time), one row each."""

    def tag(df: DataFrame, ref_table: str, field: str) -> DataFrame:
        return df.select(F.lit(ref_table).alias("ref_table"), F.lit(field).alias("ref_field"), F.col("ref_id").alias("ref_key"), "ref_time")

    said = messages.where(~F.coalesce(F.col("is_recalled"), F.lit(False)))
    seq = orphan_references(quotes.where("seq is not null"), said, ref_id="quote_id", ref_key=["msg_table", "seq"], ref_time="ingested_at", parent_key=["msg_table", "msg_seq"], parent_time="ingested_at", max_blocks=max_blocks)
    ever = F.lit("0001-01-02").cast("timestamp_ntz")
    accounts = contacts.where(~F.coalesce(F.col("is_deleted"), F.lit(False))).select("uin", F.col("added_at").cast("timestamp_ntz").alias("added_at")).unionByName(own.select("uin", ever.alias("added_at")))
    # an own account is known whatever the quote's time, a missing one included
    dated = quotes.where("sender_uin is not null").select("quote_id", "sender_uin", F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"))
    sender = orphan_references(dated.withColumn("at", F.coalesce("ingested_at", ever)), accounts, ref_id="quote_id", ref_key=["sender_uin"], ref_time="at", parent_key=["uin"], parent_time="added_at", max_blocks=max_blocks)
    asset = matches_without_file(matches, files, max_blocks=max_blocks)
    parts = [tag(seq, "quote_refs", "seq"), tag(sender, "quote_refs", "sender_uin"), tag(asset, "asset_matches", "unmatched_reason")]
    return parts[0].withColumn("ref_time", F.col("ref_time").cast("timestamp_ntz")).unionByName(parts[1]).unionByName(parts[2].withColumn("ref_time", F.col("ref_time").cast("timestamp_ntz"))).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts of distinct orphans per referring table, field and month (``yyyy-MM``, null for references without a time)."""
    return orphans.groupBy("ref_table", "ref_field", F.date_format("ref_time", "yyyy-MM").alias("month")).agg(F.count_distinct("ref_key").alias("orphans"))
