import random

from parleylake.operators import exactly_once as eo

SCHEMA = "sample_id long, batch_id long, msg_time long, rand long, sender_uin long, id string, h string"


def brute(rows):
    seen, out = {}, []
    for i, _, t, r, s in sorted(rows, key=lambda x: x[0]):
        if None in (t, r, s):
            continue
        k = (t // 1000 if abs(t) >= 10**11 else t, r & 0xFFFFFFFF, s)
        if k in seen:
            out.append(i)
        seen[k] = i
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def surplus(spark, rows, rounds=4, **options):
    df = frame(spark, rows)
    return sorted(r.sample_id for r in eo.surplus_copies(df, eo.build_index(df, least_rounds=rounds, **options)).collect())


def test_random_deliveries(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        t, r, s = 1_500_000_000 + rng.randrange(40), rng.randrange(2**31, 2**31 + 4), rng.randrange(4)
        rows.append((i, rng.randrange(9), t * 1000 + rng.randrange(1000) if rng.random() < 0.5 else t, r - 2**32 if rng.random() < 0.5 else r, s))
    rng.shuffle(rows)
    assert surplus(spark, rows) == brute(rows)


def test_one_message_is_a_third_of_all(spark):
    rows = [(i, i % 5, 1_500_000_000, 7, 1) if i % 3 == 0 else (i, i % 5, 1_500_000_000 + i, 7, 1) for i in range(3000)]
    assert surplus(spark, rows) == brute(rows) and len(brute(rows)) == 999


def test_nulls_and_empty(spark):
    rows = [(1, None, None, 1, 1), (2, None, None, 1, 1), (3, 0, 5, None, 1), (4, 0, 5, 1, None), (5, None, 5, 1, 1), (6, 1, 5, 1, 1)]
    assert surplus(spark, rows) == [6]
    assert surplus(spark, []) == []
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert sorted(r.sample_id for r in eo.exactly_once(df).collect()) == [1, 2, 3, 4, 5]


def test_later_batches_may_hold_the_smaller_id(spark):
    assert surplus(spark, [(9, 0, 5, 1, 1), (2, 7, 5, 1, 1), (4, 3, 5000 * 10**9, 1, 1)], rounds=3) == [9]


def test_merging_keeps_everything(spark):
    rows = [(i, i // 10, 10**9 + i % 37, 1, 1) for i in range(400)]
    assert surplus(spark, rows, rounds=12) == brute(rows)


def test_equal_hashes_are_told_apart():
    import numpy as np

    a = lambda *x: np.array(x, np.int64)
    run = {"h": a(1, 5, 5, 5, 9), "t": a(1, 1, 2, 3, 1), "r": a(0, 0, 0, 0, 0), "s": a(0, 0, 0, 0, 0), "keeper": a(10, 11, 12, 13, 14)}
    keeper, has = eo._known(run, {"h": a(5, 5, 6), "t": a(3, 9, 1), "r": a(0, 0, 0), "s": a(0, 0, 0)})
    assert has.tolist() == [True, False, False] and keeper[0] == 13


def test_reopened_index_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = [(i, i // 100, 10**9 + i % 137, 1, 1) for i in range(900)]
    first = eo.build_index(frame(spark, rows[:400]), path=path, per_prefix=8, least_bits=1)
    assert first.keepers().count() == 137 and first.bits > 1
    again = eo.DeliveryIndex(spark, path, per_prefix=8)
    assert (again.runs, again.bits, again.size) == (first.runs, first.bits, first.size)
    args = {"batch": "batch_id", "row_id": "sample_id", "time": "msg_time", "rand": "rand", "sender": "sender_uin"}
    assert again.feed(frame(spark, rows[:400]), **args) == 0 and again.runs == first.runs
    assert again.feed(frame(spark, rows), **args) == 5
    df = frame(spark, rows)
    assert sorted(r.sample_id for r in eo.surplus_copies(df, again).collect()) == brute(rows)
    third = eo.DeliveryIndex(spark, path, per_prefix=8)
    third.merge()
    assert third.size == 137 and {r.id for r in eo.DeliveryIndex(spark, path).keepers().collect()} == set(range(137))
    assert eo.exactly_once(df, path=path).count() == 137


def test_longer_prefixes_change_nothing(spark):
    rows = [(i, i % 40, 10**9 + i * 7 % 811, 1, i % 3) for i in range(3000)]
    assert surplus(spark, rows, rounds=5, per_prefix=5, least_bits=1) == brute(rows)


def test_cells_stay_small():
    import numpy as np

    n = eo.CELL * 2 + 5
    a = {c: np.arange(n) for c in eo.COLS}
    packed = eo._pack(3, a)
    assert packed["n"].tolist() == [eo.CELL, eo.CELL, 5] and max(map(len, packed["h"])) == eo.CELL * 8
    assert sum(len(x["h"]) for x in eo._unpack(packed)) == n


def test_named_batches(spark):
    rows = [(i, i // 10, 10**9 + i % 37, 1, 1) for i in range(200)]
    df = frame(spark, rows).selectExpr("* except (batch_id)", "concat('b', batch_id) as batch_id")
    assert sorted(r.sample_id for r in eo.surplus_copies(df, eo.build_index(df, least_rounds=3)).collect()) == brute(rows)
