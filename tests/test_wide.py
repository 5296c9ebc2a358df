import datetime as dt
import random

from parleylake.operators import wide

T0, T1 = dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)
ROWS = "stream string, entry_key string, field_index int, field_name string, uint_value long, texts array<string>, read_at timestamp_ntz, attr_name string"
CATALOG = [("dwLevel", "uint"), ("strNick", "text"), ("tags", "text_list"), (None, "text"), ("odd", "blob")]


def made(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash") for r in rows], ROWS)
    return wide.attributes_to_wide(df, spark.createDataFrame(CATALOG, "attr_name string, value_kind string"), **kw)


def cells(df):
    return {(r.stream, r.entry_key): (int(r.dwLevel) if r.dwLevel is not None else None, r.strNick, r.tags) for r in df.collect()}


def test_latest_then_highest_index_wins(spark):
    rows = [("s", "a", 1, "dwLevel", 5, None, T0), ("s", "a", 0, "dwLevel", 7, None, T1), ("s", "a", 3, " DWLEVEL", 9, None, T1), ("s", "a", 4, "dwLevel", None, ["x"], T1)]
    assert cells(made(spark, rows)) == {("s", "a"): (9, None, None)}


def test_names_texts_and_numbers(spark):
    rows = [
        ("s", "a", 0, "ｄｗＬｅｖｅｌ", None, ["n/a", " 0x1F\t"], None), ("s", "a", 1, "strnick​", 3, ["", " \t", "x y"], T0), ("s", "a", 2, "tags", None, ["", "p", "q"], T0),
        ("s", "b", 0, "dwLevel", -1, ["-7", "1.5"], T0), ("s", "b", 1, "strNick", 8, [" "], T0), ("s", "b", 2, "unknown", 1, ["z"], T0),
        ("s", None, 0, "strNick", None, ["lonely"], T0), ("s", "c", 0, None, 1, None, T0), ("s", "d", None, "strNick", None, [None, "v" * 100_000], None),
    ]
    got = cells(made(spark, rows))
    assert got[("s", "a")] == (31, "x y", ["p", "q"]) and got[("s", None)] == (None, "lonely", None) and len(got[("s", "d")][1]) == 100_000
    assert set(got) == {("s", "a"), ("s", None), ("s", "d")}


def test_ties_and_repeats_do_not_matter(spark):
    rows = [("s", "a", 1, "strNick", None, ["b"], T0), ("s", "a", 1, "strNick", None, ["a"], T0)]
    assert cells(made(spark, rows * 3)) == cells(made(spark, rows[::-1])) == {("s", "a"): (None, "b", None)}


def test_every_signature(spark):
    import itertools

    sets = [c for n in (1, 2, 3) for c in itertools.combinations(("dwLevel", "strNick", "tags"), n)]
    rows = [("s", str(i), 0, n, i, [f"t{i}", "u"], T0) for i in range(200) for n in sets[i * i % 7]]
    rng = random.Random(1)
    rng.shuffle(rows)
    df = made(spark, rows)
    want = {("s", str(i)): (i if "dwLevel" in k else None, f"t{i}" if "strNick" in k else None, [f"t{i}", "u"] if "tags" in k else None) for i in range(200) for k in [sets[i * i % 7]]}
    assert cells(df) == want
    counts = {}
    for v in want.values():
        sig = ",".join(n for n, x in zip(("dwLevel", "strNick", "tags"), v) if x is not None)
        counts[sig] = counts.get(sig, 0) + 1
    assert {r.signature: r.entities for r in wide.signature_report(df).collect()} == counts


def test_one_entity_holds_a_third_of_the_rows(spark):
    rows = [("s", "hot" if i % 3 == 0 else str(i), i, "dwLevel", i, None, T0) for i in range(3000)]
    got = cells(made(spark, rows))
    assert got[("s", "hot")] == (2997, None, None) and len(got) == 2001


def test_empty(spark):
    e = made(spark, [])
    assert e.columns == ["stream", "entry_key", "dwLevel", "strNick", "tags"] and e.count() == 0 and wide.wide_cells(e).count() == 0


def test_cells(spark):
    got = wide.wide_cells(made(spark, [("s", "a", 1, "tags", None, ["b"], T0), ("s", "a", 1, "dwLevel", 0, None, T0)])).collect()
    assert sorted(r.attr_name for r in got) == ["dwLevel", "tags"]
