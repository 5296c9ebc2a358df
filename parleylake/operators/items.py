"""Messages as a viewer shows them: one row with everything derived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleylake.functions.names import is_blank
from parleylake.functions.text import iso_time

# What stands for a message without text, by kind of media.
STAND_INS = {"image": "[图片]", "video": "[视频]", "voice": "[语音]", "file": "[文件]", "face": "[表情]"}


def message_items(messages: DataFrame, identities: DataFrame, quotes: DataFrame, targets: DataFrame, hits: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per message row with sender, time, text, media, quotes and asset.

    ``identities`` come from sender_identity, ``targets`` from quote_targets and ``hits`` from first_present. Each is
    reduced to one row per message before it is joined, so no message is multiplied. A time only has to be after
    2000 to be shown here. Quotes and assets of a message that is not there are left out.
    """
    at = ["msg_table", "rowid"]
    q = quotes.select("quote_id", "msg_table", F.col("msg_rowid").alias("rowid")).distinct().join(targets, "quote_id", "left")
    q = q.groupBy(*at).agg(F.count(F.lit(1)).alias("quotes"), F.min("target_rowid").alias("first_quoted_rowid"))
    a = matches.select("match_id", "msg_table", F.col("msg_rowid").alias("rowid")).distinct().join(hits, "match_id", "left")
    a = a.groupBy(*at).agg(F.count(F.lit(1)).alias("assets"), F.count("path").alias("assets_found"), F.min("path").alias("asset_path"))
    who = identities.select(*at, "ingested_at", "display_sender", "sender_line", "sender_source", "sender_note")
    m = messages.select(*at, "ingested_at", "conv_type", "conv_id", "msg_seq", "msg_time", "is_self", "text", "display_text", "media_kind", "is_recalled")
    j = m.join(who, [*at, "ingested_at"], "left").join(q, at, "left").join(a, at, "left")
    stand_in = F.try_element_at(F.create_map(*[F.lit(x) for kv in STAND_INS.items() for x in kv]), F.col("media_kind"))
    plausible = F.coalesce(F.col("msg_time") >= 946_684_800, F.lit(False))
    return j.select(
        *at, "ingested_at", F.concat_ws(":", "conv_type", "conv_id").alias("conv_key"), "msg_seq", F.when(plausible, iso_time(F.col("msg_time"))).otherwise("").alias("shown_time"), plausible.alias("time_plausible"),
        F.coalesce("is_self", F.lit(False)).alias("is_self"), "display_sender", "sender_line", "sender_source", "sender_note",
        F.when(~is_blank(F.col("text")), F.col("text")).otherwise(F.coalesce(stand_in, F.lit(""))).alias("plain_text"), "media_kind", F.coalesce("is_recalled", F.lit(False)).alias("is_recalled"),
        F.coalesce("quotes", F.lit(0)).alias("quotes"), "first_quoted_rowid", F.coalesce("assets", F.lit(0)).alias("assets"), F.coalesce("assets_found", F.lit(0)).alias("assets_found"), "asset_path",
    )
