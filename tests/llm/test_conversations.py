import datetime as dt
import random

from parleylake.llm import conversations as c

T = dt.datetime(2020, 1, 1)
E = 1_577_836_800
SCHEMA = "msg_table string, rowid long, msg_time long, sender_uin string, is_self boolean, text string, ingested_at timestamp_ntz, turn string, head string"


def brute_roots(edges):
    parent = dict(edges)
    out = {}
    for n in parent:
        at, depth, seen = n, 0, set()
        while True:
            if at in seen:
                out[n] = (None, None, "cycle")
                break
            seen.add(at)
            p = parent[at]
            if p is None:
                out[n] = (at, depth, "rooted")
                break
            if p not in parent:
                out[n] = (at, depth, "orphan")
                break
            at, depth = p, depth + 1
    return out


def resolved(spark, edges):
    df = spark.createDataFrame([(*e, "clash") for e in edges], "id string, parent string, state string")
    return {r.id: (r.root, r.depth, r.state) for r in c.resolve_pointers(df).collect()}


def test_pointers(spark):
    rng = random.Random(2)
    edges = [(f"a{i}", f"a{i - 1}" if i else None) for i in range(70)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("o1", "gone"), ("o2", "o1"), ("self", "self")]
    edges += [(f"r{i}", f"r{rng.randrange(60)}") for i in range(50)]
    assert resolved(spark, edges) == brute_roots(edges)
    assert resolved(spark, edges[:1] * 3) == {"a0": ("a0", 0, "rooted")} and resolved(spark, []) == {}


def frames(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    own = spark.createDataFrame([(9, "self"), (0, "system"), (10000, "system"), (5, "bot"), (None, None)], "uin long, account_kind string")
    return df, own


def test_order_roles_and_states(spark):
    rows = [
        ("a", 2, E + 5, "1", False, "hi", T), ("a", 1, E + 9, " 009", None, "yo", T), ("a", 3, None, "1", False, "late", T), ("a", 4, E, "10000", False, "sys", T), ("a", 2, E + 5, "1", False, "hi", T + dt.timedelta(1)),
        ("empty", 1, E, "0", False, "sys", T), ("empty", 2, E, "1", False, " 　\n", T), ("mine", 1, E, "9", True, "a", T), ("theirs", 1, E, "1", None, "a", T), ("theirs", 2, E, "5", None, "bot", T),
        ("broken", 1, 5, "1", False, "a", T), ("broken", 2, E, "9", True, "a", T), ("unsent", 1, E, None, False, "a", T), ("unsent", 2, E, "9", True, "b", T), (None, 1, E, "1", False, "x", T), ("a", None, E, "1", False, "x", T),
        ("mixed", 1, 5, "1", False, "a", T), ("mixed", 2, E, None, False, "b", T), ("mixed", 3, E, "9", True, "c", T), ("mixed", 4, E, "1", False, "d", T),
        ("most", 1, 5, None, False, "a", T), ("most", 2, E, "9", True, "b", T), ("most", 3, E, "1", False, "c", T),
        ("far", 1, E + 10 * 86400, "1", False, "a", T), ("far", 2, E, "9", True, None, None),
    ]
    turns = c.reassemble(*frames(spark, rows), carry=["text"])
    got = [(r.rowid, r.turn, r.parent_rowid, r.root_rowid, r.role) for r in turns.where("msg_table = 'a'").orderBy("turn").collect()]
    assert got == [(4, 0, None, 4, "system"), (2, 1, 4, 4, "other"), (1, 2, 2, 4, "own"), (3, 3, 1, 4, "other")]
    assert {r.msg_table: r.state for r in c.judged(turns).collect()} == {"a": "whole", "empty": "empty", "mine": "no_reply", "theirs": "no_reply", "broken": "broken", "unsent": "broken", "far": "broken", "mixed": "broken", "most": "whole"}
    assert {r.msg_table for r in c.kept_turns(turns).collect()} == {"a", "most"}


def test_a_conversation_spread_over_all_tasks(spark):
    rng = random.Random(4)
    rows = [("big" if i % 3 else f"t{i % 50}", i, E + rng.randrange(500), "9" if i % 2 else "1", None, "x", T) for i in range(1, 6000)]
    turns = c.reassemble(*frames(spark, rows))
    by = {}
    for t, i, s, *_ in rows:
        by.setdefault(t, []).append((s, i))
    want = {(t, i): (n, sorted(v)[n - 1][1] if n else None, sorted(v)[0][1]) for t, v in by.items() for n, (_, i) in enumerate(sorted(v))}
    assert {(r.msg_table, r.rowid): (r.turn, r.parent_rowid, r.root_rowid) for r in turns.collect()} == want


def test_empty(spark):
    df, own = frames(spark, [])
    t = c.reassemble(df, own)
    assert t.count() == 0 and c.judged(t).count() == 0


def test_threads(spark):
    m = spark.createDataFrame([("t", i, 100 + i) for i in range(6)], "msg_table string, rowid long, msg_seq long")
    q = spark.createDataFrame([("t", 1, 100), ("t", 2, 101), ("t", 3, 999), ("t", 4, 105), ("t", 5, 104), ("t", 1, 100), ("t", None, 1), ("t", 2, None)], "msg_table string, msg_rowid long, seq long")
    got = {r.msg_seq: (r.root_seq, r.depth, r.state) for r in c.reply_threads(m, q).collect()}
    assert got == {100: (100, 0, "rooted"), 101: (100, 1, "rooted"), 102: (100, 2, "rooted"), 103: (103, 0, "orphan"), 104: (None, None, "cycle"), 105: (None, None, "cycle")}


def test_quotes_are_pointers(spark):
    rng = random.Random(7)
    n = 900
    rows = [("q" if i % 2 else f"t{i % 7}", i, E + i // 3, "9" if i % 3 else "1", None, "x", T) for i in range(1, n)]
    df, own = frames(spark, rows)
    df = df.selectExpr("*", "rowid + 5000 as msg_seq")
    quotes = [(t, i, 5000 + rng.randrange(1, n + 40)) for t, i, *_ in rows if rng.random() < 0.3] + [("q", 1, 5001), ("q", 3, 5005), ("q", 5, 5003), ("gone", 1, 5001), ("q", None, 5001), ("q", 9, None)]
    q = spark.createDataFrame(quotes, "msg_table string, msg_rowid long, seq long")
    turns = {(r.msg_table, r.rowid): r for r in c.reassemble(df, own, q).collect()}
    table = {i: t for t, i, *_ in rows}
    order = {}
    for t, i, s, *_ in rows:
        order.setdefault(t, []).append((s, i))
    before = {i: (sorted(v)[k - 1][1] if k else None) for v in order.values() for k, (_, i) in enumerate(sorted(v))}
    said = {}
    for t, i, s in quotes:
        if s is not None and table.get(i) == t:
            said[i] = min(s, said.get(i, s))
    quoted = {i: s - 5000 for i, s in said.items() if table.get(s - 5000) == table[i]}
    first = {i: quoted.get(i, before[i]) for i in table}
    around = {k[1] for k, v in brute_roots([((0, i), p and (0, p)) for i, p in first.items()]).items() if v[2] == "cycle"}
    parent = {i: before[i] if i in around else first[i] for i in table}
    final = brute_roots(list(parent.items()))
    assert len(turns) == len(table) and around and len(said) > len(quoted)
    for i, t in table.items():
        r = turns[(t, i)]
        link = "orphan" if i in said and i not in quoted else "cycle" if i in quoted and i in around else "quote" if i in quoted else "root" if before[i] is None else "next"
        assert (r.parent_rowid, r.root_rowid, r.depth, r.link) == (parent[i], *final[i][:2], link)
    assert {r.msg_table: r.turns for r in c.judged(c.reassemble(df, own, q)).collect()} == {t: len(v) for t, v in order.items()}


def test_paths(spark):
    edges = [(f"a{i}", f"a{i - 1}" if i else None) for i in range(11)] + [("b1", "a3"), ("b2", "b1"), ("o2", "o1"), ("o1", "gone"), ("x", "y"), ("y", "x"), ("z", "x"), ("lone", None)]
    df = spark.createDataFrame(edges * 2, "id string, parent string")
    got = {}
    for r in c.root_paths(df).collect():
        got.setdefault(r.leaf, {})[r.position] = r.id
    a = lambda n: {i: f"a{i}" for i in range(n)}
    assert got == {"a10": a(11), "b2": a(4) | {4: "b1", 5: "b2"}, "o2": {0: "o1", 1: "o2"}, "lone": {0: "lone"}}
    assert c.root_paths(df.limit(0)).count() == 0
