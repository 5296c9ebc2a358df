import json
import sqlite3

from pyspark.sql import functions as F

from parleylake.operators import audit, sampling
from parleylake.sources import files, sinks, sqlite
from parleylake.streaming import events


def database(path):
    con = sqlite3.connect(path)
    for t in ("buddy_1", "group_2", "groupX1", "system_3"):
        con.execute(f"create table {t} (Time integer, Rand integer, SenderUin integer, MsgContent blob{', Info blob' if t == 'group_2' else ''})")
        con.executemany(f"insert into {t} (Time, Rand, SenderUin, MsgContent) values (?, ?, ?, ?)", [(100 + i, i, 7, bytes([i])) for i in range(25)])
    con.execute("create table buddy_odd (x integer)")
    con.execute("create index ix on buddy_1 (Time)")
    con.commit()
    con.close()


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "m.db")
    database(path)
    sqlite.register(spark)
    df = spark.read.format("chatsqlite").option("path", path).option("rowsPerPartition", "10").load()
    assert {(r.msg_table, r["count"]) for r in df.groupBy("msg_table").count().collect()} == {("buddy_1", 25), ("group_2", 25), ("system_3", 25)}
    got = df.where("msg_table = 'group_2' and rowid >= 5 and rowid < 8").collect()
    assert [(r.rowid, bytes(r.content), r.info) for r in got] == [(i, bytes([i - 1]), None) for i in (5, 6, 7)]
    assert {t[0]: t[1] for t in sqlite.table_report(path)}["buddy_1"] == 25 and sqlite.pragmas(path)["encoding"] == "UTF-8"
    kind = files.contents(spark, str(tmp_path), "*.db").select(files.header_kind(F.col("content")).alias("k")).first().k
    assert kind == "sqlite" and files.listing(spark, str(tmp_path), "*.db").first().size > 0


def test_text_tables(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1, None), ('q"x', 2, "t\tab\nline")], "s string, n int, t string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {(r.s, r.n) for r in back.collect()} == {("a,b", "1"), ('q"x', "2")}
    assert sinks.export_tables({"csv": df}, str(tmp_path))["csv"] != "" and sinks.export_tables({"csv": df}, str(tmp_path), force=True)["csv"] == ""
    sinks.write_tsv(df, str(tmp_path / "tsv"))
    assert {r.t for r in files.tsv(spark, str(tmp_path / "tsv")).collect()} >= {"t ab line"}
    sinks.write_samples(spark.createDataFrame([("buddy_1", 1, 2, 3, 4, b"\x01\xff")], "msg_table string, rowid long, msg_time long, rand long, sender_uin long, content binary"), str(tmp_path / "samples"))
    assert bytes(files.sample_tsv(spark, str(tmp_path / "samples")).first().content) == b"\x01\xff"
    (tmp_path / "j.jsonl").write_text('{"a":1}\nbad\n\n[2]\n')
    assert files.jsonl(spark, str(tmp_path / "j.jsonl")).count() == 2
    assert json.loads(sinks.json_report(df).first().report)["n"] == 1
    assert sinks.markdown(["a", "b"], [(1, None), ("x|y", 2)]).splitlines()[1] == "| ---- | --- |"
    sinks.replace_catalog({"t": df}, str(tmp_path / "cat"))
    prepared = spark.createDataFrame([(1, "r", True, "s1", "p1"), (2, "r", True, "s2", "")], "seq int, role string, ok boolean, source_path string, prepared_path string")
    assert files.current_sources(prepared).first().path == "s2"


LINES = ['{"type":"open","payload":{"account":"1","source":"s","path":"p","key":"k","at":5}}', 'noise {"type":"open","payload":{"account":"1","source":"s","path":"p","key":"k","at":4}} tail', "no json", "", None, "{broken"]


def test_events(spark, tmp_path):
    e = events.normalised(spark.createDataFrame([(x,) for x in LINES], "value string"))
    assert sorted((r.kind, r.key) for r in e.collect()) == [("_raw", ""), ("_raw", "no json"), ("_raw", "{broken"), ("open", "k"), ("open", "k")]
    new = events.new_events(e, e.limit(0))
    assert new.count() == 4 and new.where("kind = 'open'").first().at == 4 and events.new_events(e, e).count() == 0
    assert events.counters(e, new).first().asDict() == {"events": 5, "imported": 4, "ignored": 1}
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(x for x in LINES if x) + "\n")
        events.follow(spark, source, target, state).awaitTermination()
    assert spark.read.parquet(target).where("kind = 'open'").count() == 1


def test_coverage_and_probes(spark):
    r = spark.createDataFrame([("a", 0, 10, 40), ("a", 5, 20, 40), ("a", 25, 30, 40), ("b", 3, 3, 4)], "k string, start int, end int, total int")
    assert sorted((x.k, x.gap_start, x.gap_end) for x in audit.coverage_gaps(r, key=["k"], total="total").collect()) == [("a", 20, 25), ("a", 30, 40), ("b", 0, 4)]
    rows = spark.createDataFrame([("t", i) for i in (1, 2, 9, 30, 31)], "msg_table string, rowid long")
    targets = spark.createDataFrame([("t", [1, 3, 10, 31, 99]), ("u", [1])], "msg_table string, targets array<long>")
    assert sorted(x.rowid for x in sampling.rows_at_or_after(rows, targets).collect()) == [1, 9, 30, 31]
    assert sampling.probe_sample(rows.limit(0), random_points=3).count() == 0


def test_random_probes_equal_a_plain_loop(spark):
    top = spark.createDataFrame([("group_1", 1000), ("buddy_好", 7), ("empty", 0)], "msg_table string, max_rowid long")
    for r in sampling.random_targets(top, 5).collect():
        h = 14695981039346656037
        for b in r.msg_table.encode():
            h = ((h ^ b) * 1099511628211) % 2**64
        state, want = h ^ (r.max_rowid * 2**17) % 2**64, []
        for _ in range(5 if r.max_rowid else 0):
            state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
            want.append(1 + state % r.max_rowid)
        assert r.targets == want


def test_selectors_and_file_names(spark):
    import pytest

    known = ["/a/Msg.db", "/b/x/Index.db", "/c/Index.db"]
    assert files.resolve("/a/msg.DB", known, []) == "/a/Msg.db" and files.resolve("x\\Index.db", known, ["/a", "/b"]) == "/b/x/Index.db" and files.resolve("Msg.db", known, []) == "/a/Msg.db"
    for bad in ("Index.db", "none.db"):
        with pytest.raises(ValueError):
            files.resolve(bad, known, [])
    df = spark.createDataFrame([("f", "a/b"), ("f", "A_b"), ("f", "c:d"), ("g", "a/b")], "file string, stream string")
    got = {(r.file, r.stream): r.file_name for r in sinks.with_file_names(df, ["file"]).collect()}
    assert got[("f", "c:d")] == "c_d" and got[("g", "a/b")] == "a_b" and len({v.lower() for k, v in got.items() if k[0] == "f"}) == 3
