"""Quality audits, byte coverage, searches and inventories."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parleylake.functions.media import candidate_kind, is_media_candidate
from parleylake.functions.names import is_blank
from parleylake.functions.text import like_text, likely_role, matches_all, suspicious_score, tokens, trimmed
from parleylake.operators.nested import member


def row_issues(messages: DataFrame) -> DataFrame:
    """The issues of each message: (msg_table, rowid, issue), one row per issue."""
    blank = is_blank(F.col("text"))
    media = F.filter(F.split("text", r"[\s，。；！]+"), is_media_candidate)
    found = F.array_compact(F.array(
        F.when(blank & F.col("media_kind").isNull(), "empty_text_and_nodes"), F.when(blank & F.col("media_kind").isNotNull(), "blank_text_message"),
        F.when(suspicious_score(F.col("text")) > 0, "suspicious_text"), F.when(F.col("msg_time").isNull() | (F.col("msg_time") < 946684800), "implausible_time"),
        F.when(F.coalesce(F.trim("sender_uin") == "", F.lit(True)), "no_sender"), F.when(F.col("is_recalled"), "recalled"),
        F.when((F.size(media) > 0) & F.col("media_kind").isNull(), "unrendered_media_candidate")))
    return messages.select("msg_table", "rowid", F.explode(found).alias("issue"))


def issue_rollup(issues: DataFrame) -> DataFrame:
    """Counts per table and issue, with totals per table and overall (null stands for all)."""
    return issues.rollup("msg_table", "issue").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def issue_samples(issues: DataFrame, n: int = 64) -> DataFrame:
    """The first ``n`` rows with issues by table and rowid."""
    return issues.groupBy("msg_table", "rowid").agg(F.array_join(F.array_sort(F.collect_set("issue")), ",").alias("issues")).orderBy("msg_table", "rowid").limit(n)


def quality_counters(messages: DataFrame) -> DataFrame:
    """Named counters over all messages, as name and value."""
    blank = is_blank(F.col("text"))
    tests = {
        "rows": F.lit(True), "blank_text": blank, "with_media": F.col("media_kind").isNotNull(), "recalled": F.coalesce("is_recalled", F.lit(False)), "text_differs": ~F.col("text").eqNullSafe(F.col("display_text")),
        "suspicious_text": suspicious_score(F.col("text")) > 0, "null_time": F.col("msg_time").isNull(), "null_seq": F.col("msg_seq").isNull(), "null_sender": F.col("sender_uin").isNull(), "self": F.coalesce("is_self", F.lit(False)),
    }
    one = messages.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])
    return one.unpivot([], list(tests), "counter", "value")


def node_histogram(nodes: DataFrame) -> DataFrame:
    """Nodes by type, with the number of owners that have one (column members of flattened nodes)."""
    t = nodes.select("owner_key", member("type").alias("node_type")).where("node_type is not null")
    return t.groupBy("node_type").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("owner_key").alias("owners"))


def media_issues(matches: DataFrame) -> DataFrame:
    """Media matches whose references are missing, or of another kind than the message: (match_id, issue)."""
    expected = F.lit(None).cast("string")
    kinds = F.transform(F.filter("candidate_paths", lambda x: F.trim(x) != ""), candidate_kind)
    for k in ("file", "image", "voice", "video"):
        expected = F.when(F.array_contains(kinds, k), k).otherwise(expected)
    m = matches.where(F.col("media_kind").isin("image", "video", "voice", "file"))
    issue = F.when(F.coalesce(F.size(kinds) <= 0, F.lit(True)), F.concat(F.lit("missing_candidates:"), "media_kind")).when(expected != F.col("media_kind"), F.concat(F.lit("type_mismatch:"), "media_kind", F.lit("->"), expected))
    return m.select("match_id", issue.alias("issue")).where("issue is not null").distinct()


def coverage_gaps(ranges: DataFrame, *, key: list[str], start: str = "start", end: str = "end", total: str | None = None) -> DataFrame:
    """The bytes no range covers: key, gap_start, gap_end; with ``total`` also the gap behind the last range.

    A running maximum of the ends before each range tells where a gap opens. Empty and reversed ranges cover nothing.
    """
    r = ranges.where(f"{start} >= 0 and {end} > {start}").select(*key, F.col(start).alias("s"), F.col(end).alias("e"))
    before = F.coalesce(F.max("e").over(Window.partitionBy(*key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = r.select(*key, before.alias("gap_start"), F.col("s").alias("gap_end")).where("gap_end > gap_start")
    if total is None:
        return gaps
    ends = ranges.groupBy(*key).agg(F.max(total).alias("t"), F.coalesce(F.max(F.when((F.col(start) >= 0) & (F.col(end) > F.col(start)), F.col(end))), F.lit(0)).alias("e"))
    return gaps.union(ends.where("t > e").select(*key, F.col("e").alias("gap_start"), F.col("t").alias("gap_end")))


def index_search(messages: DataFrame, *, account: str | None = None, like: str | None = None, match: str | None = None) -> DataFrame:
    """Messages by sender account, LIKE pattern or words, each given condition to hold."""
    m = messages
    if account is not None:
        m = m.where(F.regexp_replace(F.trim("sender_uin"), "^0+(?=.)", "") == account)
    if like is not None:
        m = m.where(like_text(F.col("text"), like))
    if match is not None:
        m = m.where(matches_all(F.col("text"), match))
    return m


def search_report(messages: DataFrame, account: str, like: str, match: str) -> DataFrame:
    """The results of several searches side by side, with the search's name, from one pass over the messages."""
    by_account = F.coalesce(F.regexp_replace(F.trim("sender_uin"), "^0+(?=.)", "") == account, F.lit(False))
    flags = {"account": by_account, "account_like": by_account & like_text(F.col("text"), like), "like": like_text(F.col("text"), like), "match": matches_all(F.col("text"), match)}
    hits = F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in flags.items()]))
    return messages.select(F.explode(hits).alias("search"), "msg_table", "rowid", "msg_time")


def word_index(messages: DataFrame, key: list[str]) -> DataFrame:
    """The inverted index of messages: (word, key, positions of the word in the text), to be stored sorted by word."""
    words = messages.select(*key, F.posexplode(tokens(F.col("text"))).alias("at", "word"))
    return words.groupBy("word", *key).agg(F.array_sort(F.collect_set("at")).alias("places"))


def index_lookup(index: DataFrame, key: list[str], query: str) -> DataFrame:
    """The keys whose texts hold every word of a query, and every phrase in double quotes as words in a row, from the index alone.

    Only postings of the query's words are read; a text's postings meet by its key, so a frequent word makes no large task.
    """
    phrases = [[w for w in re.split(r"[\W_]+", (p or w).lower()) if w] for p, w in re.findall(r'"([^"]+)"|(\S+)', query)]
    wanted = sorted({w for p in phrases for w in p})
    if not wanted:
        return index.select(*key).limit(0)
    # a text has one posting per word of the query
    found = index.where(F.col("word").isin(wanted)).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("m")).where(F.size("m") == len(wanted))
    for p in phrases:
        starts = F.element_at("m", F.lit(p[0]))
        for i, w in enumerate(p[1:], 1):
            starts = F.array_intersect(starts, F.transform(F.element_at("m", F.lit(w)), lambda x: x - F.lit(i)))  # noqa: B023
        found = found.where(F.size(starts) > 0)
    return found.select(*key)


def last_values(fields: DataFrame, key: list[str], name: str, position: list[str], value: str) -> DataFrame:
    """The last non-empty value of each name per key, by position."""
    return fields.where(F.col(name).isNotNull() & (trimmed(F.col(value)) != "")).groupBy(*key, F.col(name).alias("name")).agg(F.max(F.struct(*position, trimmed(F.col(value)).alias("v"))).getField("v").alias("value"))


def all_values(fields: DataFrame, key: list[str], name: str, position: list[str], value: str) -> DataFrame:
    """All non-empty values of each name per key in order of position, as an array."""
    return fields.where(F.col(name).isNotNull() & (trimmed(F.col(value)) != "")).groupBy(*key, F.col(name).alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*position, trimmed(F.col(value)).alias("v")))), lambda x: x["v"]).alias("values"))


def entries_with(fields: DataFrame, names: list[str], numbers: list[int]) -> DataFrame:
    """Entries that hold any of the named fields or any of the numbers: (stream, entry_key, hits)."""
    hit = F.lower("field_name").isin([n.lower() for n in names]) | F.col("uint_value").isin(numbers)
    return fields.where(hit).groupBy("stream", "entry_key").agg(F.count(F.lit(1)).alias("hits"))


def entries_containing(fields: DataFrame, needles: list[str]) -> DataFrame:
    """Entries with a name or text that contains any needle, without regard to case."""
    hay = F.lower(F.concat_ws("\n", "field_name", F.array_join(F.coalesce("texts", F.array().cast("array<string>")), "\n")))
    test = F.lit(False)
    for n in needles:
        test = test | F.contains(hay, F.lit(n.lower()))
    return fields.where(test).select("stream", "entry_key").distinct()


def stream_inventory(fields: DataFrame) -> DataFrame:
    """Per stream its rows, entries and what its name suggests."""
    return fields.groupBy("stream").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("entry_key").alias("entries")).withColumn("role", likely_role(F.col("stream")))


def latest_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row per key; ties fall to the greatest row."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("s")).select(*key, "s.*")
