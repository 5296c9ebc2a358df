"""Conversations rebuilt from message rows with parent pointers and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleylake.runtime import materialise, parts_for

#: Usable times lie from 2000-01-01 to two days after ingestion.
FIRST_TIME = 946_684_800
LATE_S = 2 * 86_400


def resolve_pointers(nodes: DataFrame, *, max_rounds: int = 64) -> DataFrame:
    """Roots of a forest given as (id, parent) or (id, parent, step): (id, root, depth, state) with state rooted, orphan or cycle.

    Pointer jumping: each round replaces every open pointer by its parent's pointer in one join, so a path of n nodes
    takes log2(n) rounds. A null parent makes a root. A parent that is no node makes an orphan: its root is the last
    node that exists. Nodes that are still open after enough rounds for the number of open nodes lie on a cycle or lead
    into one; they have no root. ``depth`` adds up the steps to the root, 1 each where the nodes have none. Rows repeated
    by id count once, the smallest parent being taken; null ids are left out. Rounds are written to the shared folder,
    only nodes still open take part in a round.
    """
    step = F.col("step").cast("long") if "step" in nodes.columns else F.lit(1).cast("long")
    n = nodes.where("id is not null").select("id", F.struct("parent", step.alias("step")).alias("p")).groupBy("id").agg(F.coalesce(F.min(F.when(F.col("p.parent").isNotNull(), F.col("p"))), F.min("p")).alias("p")).select("id", "p.parent", "p.step")
    p = n.select(F.col("id").alias("parent"), F.lit(True).alias("exists"))
    first = n.join(p, "parent", "left")
    at_end = F.col("parent").isNull() | F.col("exists").isNull()
    state = F.when(F.col("parent").isNull(), "rooted").when(F.col("exists").isNull(), "orphan")
    # at: the furthest ancestor known; depth: the steps to it
    current = materialise(first.select("id", F.when(at_end, F.col("id")).otherwise(F.col("parent")).alias("at"), F.when(at_end, 0).otherwise(F.col("step")).cast("long").alias("depth"), state.alias("state")), "pointers")
    open_, done = current.where("state is null"), [current.where("state is not null")]
    ends = done[0]
    count = open_.count()
    reach, rounds = 1, 0
    while count and rounds < max_rounds:
        # after this round all paths shorter than 2 * reach are resolved, and no open path is longer than reach + count
        last = reach >= count
        known = ends.unionByName(open_).select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("state").alias("next_state"))
        jumped = materialise(open_.select("id", "at", "depth").join(known, "at").select("id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("next_state").alias("state")), "pointers")
        done.append(jumped.where("state is not null"))
        ends = ends.unionByName(done[-1])
        open_ = jumped.where("state is null")
        count, reach, rounds = open_.count(), reach * 2, rounds + 1
        if last:
            break
    out = ends.select("id", F.col("at").alias("root"), "depth", "state")
    lost = open_.select("id", F.lit(None).cast(out.schema["root"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"), F.lit("cycle").alias("state"))
    return out.unionByName(lost)


def sender_key(c: Column) -> Column:
    """A sender number without blanks and leading zeros; null where nothing is written."""
    t = F.regexp_replace(c, r"[\s\p{Z}\p{Cc}\p{Cf}]+", "")
    return F.when(F.length(t) > 0, F.regexp_replace(t, r"^0+(?=.)", ""))


def marked_rows(messages: DataFrame, own: DataFrame, carry: list[str], *, most_own: int = 10_000) -> DataFrame:
    """One row per (msg_table, rowid) with role, t (usable time or null), blank and known (has a sender).

    Rows delivered several times are reduced on the map side; of their variants the one ingested first counts. The
    list of own accounts is bounded by ``most_own``; a longer one raises an error.
    """
    listed = own.select(F.col("uin").cast("string").alias("u"), "account_kind").dropna().distinct().limit(most_own + 1).collect()
    if len(listed) > most_own:
        raise ValueError(f"there are more than {most_own} own accounts")
    selves, systems = [r.u for r in listed if r.account_kind == "self"], [r.u for r in listed if r.account_kind == "system"]
    sender = sender_key(F.col("sender_uin"))
    role = F.when(sender.isin(systems), "system").when(F.coalesce(F.col("is_self"), F.lit(False)) | F.coalesce(sender.isin(selves), F.lit(False)), "own").otherwise("other")
    ingested = F.unix_timestamp(F.col("ingested_at").cast("timestamp"))
    usable = F.col("msg_time").isNotNull() & (F.col("msg_time") >= FIRST_TIME) & (F.col("msg_time") <= ingested + LATE_S)
    blank = F.coalesce(F.length(F.regexp_replace("text", r"[\s\p{Z}\p{Cc}\p{Cf}]+", "")) == 0, F.lit(True))
    m = messages.where("msg_table is not null and rowid is not null").select(
        "msg_table", "rowid", F.struct(F.col("ingested_at"), F.when(usable, F.col("msg_time")).alias("t"), role.alias("role"), blank.alias("blank"), sender.isNotNull().alias("known"), *[F.col(c).alias(f"c_{c}") for c in carry]).alias("s"))
    return m.groupBy("msg_table", "rowid").agg(F.min("s").alias("s")).select("msg_table", "rowid", "s.t", "s.role", "s.blank", "s.known", *[F.col(f"s.c_{c}").alias(c) for c in carry])


def quoted_rows(messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """The row each quoting row points to: (msg_table, rowid, quotes, quoted), ``quoted`` null where no such message exists.

    A quote names its message by msg_seq. Of several quotes in a row the smallest seq counts, of several rows with that
    seq the smallest rowid. Quotes without a seq, or from no known row, are left out.
    """
    q = quotes.where("seq is not null and msg_table is not null and msg_rowid is not null").groupBy("msg_table", F.col("msg_rowid").alias("rowid")).agg(F.min("seq").alias("msg_seq"))
    wanted = q.select("msg_table", "msg_seq").distinct()
    found = messages.where("msg_table is not null and msg_seq is not null and rowid is not null").join(wanted, ["msg_table", "msg_seq"], "left_semi").groupBy("msg_table", "msg_seq").agg(F.min("rowid").alias("quoted"))
    return q.join(found, ["msg_table", "msg_seq"], "left").select("msg_table", "rowid", F.lit(True).alias("quotes"), "quoted")


_ADDED = ("previous", "head", "pos", "first", "at")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Resolves what lies within a task, for rows sorted by conversation.

    Adds the ``previous`` row of the conversation; ``first`` and ``at``, the row with which this task's part of the
    conversation begins and the place in that part; ``head`` and ``pos``, the nearest row before (or the row itself) whose
    parent is not the previous row here, and the steps to it. The state carried from batch to batch is the last row.
    """
    table, prev, head, pos, first, at = None, 0, 0, -1, 0, -1
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        col = lambda name: b.column(b.schema.get_field_index(name))  # noqa: E731, B023
        tables = col("msg_table").to_numpy(zero_copy_only=False)
        rows = col("rowid").to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.ones(n, bool)
        new[1:] = tables[1:] != tables[:-1]
        new[0] = tables[0] != table
        cut = new | np.asarray(col("quoted").is_valid())
        before = np.concatenate([[prev], rows[:-1]])
        i = np.arange(n)

        def since(starts: np.ndarray, carried: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
            start = np.maximum.accumulate(np.where(starts, i, -1))  # noqa: B023
            return np.where(start >= 0, rows[np.maximum(start, 0)], carried), np.where(start >= 0, i - start, i + steps + 1)  # noqa: B023

        (heads, poses), (firsts, ats) = since(cut, head, pos), since(new, first, at)
        added = [pa.array(before, pa.int64(), mask=new), *[pa.array(x, pa.int64()) for x in (heads, poses, firsts, ats)]]
        yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *_ADDED])
        table, prev, head, pos, first, at = tables[-1], int(rows[-1]), int(heads[-1]), int(poses[-1]), int(firsts[-1]), int(ats[-1])


def reassemble(messages: DataFrame, own: DataFrame, quotes: DataFrame | None = None, *, carry: list[str] | None = None) -> DataFrame:
    """All messages as turns of their conversations.

    Columns: msg_table, rowid, parent_rowid, root_rowid, depth, turn, link, role, t, blank, known and ``carry``. The parent
    of a message is the one it quotes, else the one before it in its msg_table by usable time, then rowid (messages
    without a usable time come last); the first message has none and is the root. ``link`` tells what the parent is:
    root, quote or next, and orphan or cycle where a quote could not be followed (its message does not exist, or the
    quotes lead around) and the message before took its place. ``depth`` counts pointers to the root, ``turn`` the
    messages before this one, from 0.

    Pointers are resolved by iterative pointer jumping. Rows are sorted in ranges; pointers to the previous row of the
    same range are followed where the rows lie, which leaves as nodes the rows that quote and at most one row per range
    and conversation. These jump in joins until every one has its root; nodes on cycles get the message before as
    parent and jump again. A conversation may be as large as all tasks together: it is never gathered in one of them.
    Rows without msg_table or rowid are left out. An empty input gives an empty table.
    """
    rows = marked_rows(messages, own, carry or [])
    empty = rows.select("msg_table", "rowid", F.lit(True).alias("quotes"), F.col("rowid").alias("quoted")).limit(0)
    rows = rows.join(quoted_rows(messages, quotes) if quotes is not None else empty, ["msg_table", "rowid"], "left")
    ranged = rows.withColumn("late", F.col("t").isNull())
    by = ["msg_table", "late", "t", "rowid"]
    placed = ranged.repartitionByRange(parts_for(messages), *by).sortWithinPartitions(*by)
    shape = T.StructType([*placed.schema.fields, *[T.StructField(c, T.LongType()) for c in _ADDED]])
    chained = materialise(placed.mapInArrow(_chain, shape), "turns")
    # only conversations that lie in several ranges have several parts; there are at most two of these per range
    parts = chained.groupBy("msg_table", "first").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("late", "t", "rowid")).alias("begin"), F.max(F.struct("late", "t", "rowid")).alias("end"))
    several = parts.groupBy("msg_table").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("msg_table")
    along = Window.partitionBy("msg_table").orderBy("begin")  # one row per range at most
    seams = materialise(parts.join(several, "msg_table", "left_semi").select(
        "msg_table", "first", F.lag("end.rowid").over(along).alias("joint"), F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")), "seams")
    # of the nodes: what they quote, and the message before, which is in the range before where a part begins
    nodes = chained.where("pos = 0").select("msg_table", "rowid", "quoted", "previous").join(F.broadcast(seams.select("msg_table", F.col("first").alias("rowid"), "joint")), ["msg_table", "rowid"], "left")
    nodes = materialise(nodes.select("msg_table", "rowid", "quoted", F.coalesce("previous", "joint").alias("before")), "nodes")
    # the node that each target leads to within its range, and the steps to it
    target = nodes.select("msg_table", F.explode(F.array_compact(F.array("quoted", "before"))).alias("rowid")).distinct()
    led = materialise(chained.select("msg_table", "rowid", "head", "pos").join(target, ["msg_table", "rowid"], "left_semi"), "targets")
    ident = lambda t, r: F.to_json(F.struct(t.alias("t"), r.alias("r")))

    def edges(pointer: str) -> DataFrame:
        to = led.select("msg_table", F.col("rowid").alias(pointer), F.col("head").alias("to"), (F.col("pos") + 1).alias("step"))
        return nodes.join(to, ["msg_table", pointer], "left").select("msg_table", "rowid", ident(F.col("msg_table"), F.col("rowid")).alias("id"), F.when(F.col("to").isNotNull(), ident(F.col("msg_table"), F.col("to"))).alias("parent"), "step", F.col(pointer).alias("pointer"))

    plain = edges("before")
    quoting = edges("quoted").where("pointer is not null")
    both = materialise(plain.alias("p").join(quoting.alias("q"), ["msg_table", "rowid"], "left").select(
        "msg_table", "rowid", F.col("p.id").alias("id"), *[F.struct(f"{x}.parent", f"{x}.step", f"{x}.pointer").alias(n) for x, n in (("p", "plain"), ("q", "quote"))]), "edges")
    quotes_first = F.when(F.col("quote.parent").isNotNull(), F.col("quote")).otherwise(F.col("plain"))
    roots = materialise(resolve_pointers(both.select("id", quotes_first.alias("e")).select("id", "e.parent", "e.step")), "roots")
    link = F.when(F.col("quote.parent").isNotNull(), "quote").when(F.col("plain.parent").isNull(), "root").otherwise("next")
    taken = both.select("msg_table", "rowid", "id", quotes_first.getField("pointer").alias("parent_rowid"), link.alias("link"))
    if not roots.where("state = 'cycle'").isEmpty():
        around = roots.where("state = 'cycle'").select("id", F.lit(True).alias("around"))
        cut = materialise(both.join(around, "id", "left").withColumn("e", F.when(F.col("around"), F.col("plain")).otherwise(quotes_first)), "edges")
        roots = materialise(resolve_pointers(cut.select("id", "e.parent", "e.step")), "roots")
        taken = cut.select("msg_table", "rowid", "id", F.col("e.pointer").alias("parent_rowid"), F.when(F.col("around") & F.col("quote.parent").isNotNull(), "cycle").otherwise(link).alias("link"))
    solved = taken.join(roots, "id").select("msg_table", F.col("rowid").alias("head"), "parent_rowid", "link", F.get_json_object("root", "$.r").cast("long").alias("root_rowid"), F.col("depth").alias("head_depth"))
    full = chained.join(solved, ["msg_table", "head"]).join(F.broadcast(seams.select("msg_table", "first", "offset")), ["msg_table", "first"], "left")
    is_node = F.col("pos") == 0
    return full.select(
        "msg_table", "rowid", F.when(is_node, F.col("parent_rowid")).otherwise(F.col("previous")).alias("parent_rowid"), "root_rowid", (F.col("head_depth") + F.col("pos")).alias("depth"), (F.col("at") + F.coalesce("offset", F.lit(0))).alias("turn"),
        F.when(F.coalesce("quotes", F.lit(False)) & F.col("quoted").isNull(), "orphan").when(is_node, F.col("link")).otherwise("next").alias("link"), "role", "t", "blank", "known", *(carry or []),
    )


def judged(turns: DataFrame) -> DataFrame:
    """The state of each conversation: (msg_table, root_rowid, turns, state, orphans, cycles) with state broken, empty, no_reply or whole.

    A conversation is what leads to one root. broken: at least half of the rows lack a usable time or a sender. empty:
    nothing but blank texts and system messages. no_reply: what is left is all from the own account, or none of it is.
    ``orphans`` and ``cycles`` count quotes that could not be followed. Rows are counted on the map side, so a
    conversation's size does not matter.
    """
    left = ~F.col("blank") & (F.col("role") != "system")
    c = turns.groupBy("msg_table", "root_rowid").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("t").isNull() | ~F.col("known")).alias("lacking"), F.count_if(left & (F.col("role") == "own")).alias("own"), F.count_if(left & (F.col("role") != "own")).alias("other"),
        F.count_if(F.col("link") == "orphan").alias("orphans"), F.count_if(F.col("link") == "cycle").alias("cycles"),
    )
    state = F.when(2 * F.col("lacking") >= F.col("turns"), "broken").when(F.col("own") + F.col("other") == 0, "empty").when((F.col("own") == 0) | (F.col("other") == 0), "no_reply").otherwise("whole")
    return c.select("msg_table", "root_rowid", "turns", state.alias("state"), "orphans", "cycles")


def kept_turns(turns: DataFrame) -> DataFrame:
    """The turns of whole conversations, without blank texts."""
    whole = judged(turns).where("state = 'whole'").select("msg_table", "root_rowid")
    return turns.join(whole, ["msg_table", "root_rowid"], "left_semi").where("not blank")


def _seq_id(table: Column, seq: Column) -> Column:
    return F.concat_ws(":", table, seq.cast("string"))


def _quoting(messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """The nodes (id, parent) of all messages that quote or are quoted."""
    m = messages.where("msg_table is not null and msg_seq is not null and rowid is not null").groupBy("msg_table", F.col("rowid").alias("msg_rowid")).agg(F.min("msg_seq").alias("msg_seq"))
    q = quotes.where("seq is not null").groupBy("msg_table", "msg_rowid").agg(F.min("seq").alias("seq")).join(m, ["msg_table", "msg_rowid"])
    quoting = q.select(_seq_id(F.col("msg_table"), F.col("msg_seq")).alias("id"), _seq_id(F.col("msg_table"), F.col("seq")).alias("parent"))
    quoted = m.join(q.select("msg_table", F.col("seq").alias("msg_seq")).distinct(), ["msg_table", "msg_seq"], "left_semi").select(_seq_id(F.col("msg_table"), F.col("msg_seq")).alias("id"))
    roots = quoted.join(quoting.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("parent")).distinct()
    return quoting.unionByName(roots).groupBy("id").agg(F.min("parent").alias("parent"))


def _seq_of(c: str) -> Column:
    return F.regexp_extract(c, r":(-?\d+)$", 1).cast("long")


def _table_of(c: str) -> Column:
    return F.regexp_replace(c, r":-?\d+$", "")


def reply_threads(messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """Threads of quoting messages: (msg_table, msg_seq, root_seq, depth, state) for messages that quote or are quoted.

    A quoting message's parent is the message it quotes; with several quotes the smallest seq counts. Quotes of
    messages that do not exist make orphans, quotes that lead around make cycles.
    """
    r = resolve_pointers(_quoting(messages, quotes))
    return r.select(_table_of("id").alias("msg_table"), _seq_of("id").alias("msg_seq"), F.when(F.col("root").isNotNull(), _seq_of("root")).alias("root_seq"), "depth", "state")


def root_paths(nodes: DataFrame) -> DataFrame:
    """The path from the root to each leaf of a forest (id, parent), as rows (leaf, position, id) with the root at position 0.

    A leaf is a node that is no parent. Leaves on cycles, or leading into one, have no path; that of an orphan begins
    with the last node that exists. Each place of a path is found by as many joins as its distance has binary digits,
    with the tables of 1, 2, 4 ... steps up, so work grows with what comes out and not with the square of a thread.
    """
    nodes = materialise(nodes.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent")), "forest")
    depths = materialise(resolve_pointers(nodes).where("state <> 'cycle'").select("id", "depth"), "depths")
    leaves = depths.join(nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    rows = leaves.select(F.col("id").alias("leaf"), "depth", F.explode(F.sequence(F.lit(0).cast("long"), "depth")).alias("up"), F.col("id").alias("at"))
    jump = nodes.where("parent is not null").select(F.col("id").alias("at"), F.col("parent").alias("to"))
    for bit in range(int(depths.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]).bit_length()):
        if bit:
            jump = materialise(jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("then")), "to").select("at", F.col("then").alias("to")), "jumps")
        odd = F.shiftright("up", bit).bitwiseAND(F.lit(1).cast("long")) == 1
        moved = rows.where(odd).join(jump, "at").select("leaf", "depth", "up", F.col("to").alias("at"))
        rows = materialise(rows.where(~odd).select("leaf", "depth", "up", "at").unionByName(moved), "paths")
    return rows.select("leaf", (F.col("depth") - F.col("up")).alias("position"), F.col("at").alias("id"))


def thread_paths(messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """Every reply thread from its first message to each last reply, in order: (msg_table, leaf_seq, position, msg_seq)."""
    return root_paths(_quoting(messages, quotes)).select(_table_of("leaf").alias("msg_table"), _seq_of("leaf").alias("leaf_seq"), "position", _seq_of("id").alias("msg_seq"))
