import datetime as dt
import random

from parleylake.operators import orphans

T = [dt.datetime(2020, 1, i) for i in range(1, 8)]
REFS, PARENTS = "id long, k string, n long, at timestamp_ntz, pt string, ref_id string", "k string, n long, at timestamp_ntz, id int"


def found(spark, refs, parents, **kw):
    r, p = spark.createDataFrame([(*x, "clash", "clash") for x in refs], REFS), spark.createDataFrame([(*x, 1) for x in parents], PARENTS)
    return orphans.orphan_references(r, p, ref_id="id", ref_key=["k", "n"], ref_time="at", parent_key=["k", "n"], parent_time="at", **kw)


def test_missing_late_and_null(spark):
    parents = [("a", 1, T[3]), ("a", 1, T[1]), ("a", 2, None), (None, 3, T[0]), ("b", 1, T[5])]
    refs = [(1, "a", 1, T[1]), (2, "a", 1, T[0]), (3, "a", 2, T[6]), (4, None, 3, T[6]), (5, "b", 1, T[4]), (6, "b", 1, T[5]), (7, "z", 9, T[6]), (8, "a", 1, None), (7, "z", 9, T[6])]
    assert sorted(r.ref_id for r in found(spark, refs, parents).collect()) == [2, 3, 4, 5, 7, 7, 8]


def test_empty_sides(spark):
    assert found(spark, [], [("a", 1, T[0])]).count() == 0
    assert found(spark, [(1, "a", 1, T[0])], []).count() == 1


def test_a_filter_far_too_small_stays_exact(spark):
    rng = random.Random(1)
    parents = [("k", i, T[rng.randrange(7)]) for i in range(0, 4000, 2)]
    refs = [(i, "k", rng.randrange(4200), T[rng.randrange(7)]) for i in range(2000)]
    first = {n: t for _, n, t in sorted(parents, key=lambda x: x[2], reverse=True)}
    want = sorted(i for i, _, n, t in refs if n not in first or first[n] > t)
    for kw in ({}, {"max_blocks": 1}):
        assert sorted(r.ref_id for r in found(spark, refs, parents, **kw).collect()) == want


def test_bloom_filter_knows_all_its_keys(spark):
    keys = spark.range(50_000).selectExpr("id as n")
    bloom, blocks = orphans.bloom_filter(keys, ["n"])
    marked = orphans.maybe_known(spark.range(100_000).selectExpr("id as n"), ["n"], bloom, blocks)
    assert marked.where("n < 50000 and not maybe").count() == 0
    assert marked.where("n >= 50000 and maybe").count() < 5000


def test_paths(spark):
    m = spark.createDataFrame([
        (1, ["userdata\\image\\A.JPG"], "", T[3]), (2, None, "missing: UserData/Image/b.png; USERDATA\\x.gif；待重试", T[3]), (3, [], "no path", T[3]), (4, [None, "UserData/Image/late.png"], None, T[3]),
        (5, ["UserData/gone.png", "UserData/Image/a.jpg"], None, T[3]), (6, ["UserData/gone.png"], "[UserData//gone.png] gone", None), (1, ["userdata\\image\\A.JPG"], "", T[3]),
    ], "match_id long, candidate_paths array<string>, unmatched_reason string, ingested_at timestamp_ntz")
    f = spark.createDataFrame([("UserData/Image/a.jpg", False, T[1]), ("UserData/Image/late.png", None, T[5]), ("UserData/gone.png", True, T[0]), (None, False, T[0])], "path string, is_deleted boolean, listed_at timestamp_ntz")
    assert sorted(r.ref_id for r in orphans.matches_without_file(m, f).collect()) == [2, 4, 6]


def test_report_counts_per_month(spark):
    o = spark.createDataFrame([("t", "f", 1, T[0]), ("t", "f", 1, T[1]), ("t", "f", 2, None)], "ref_table string, ref_field string, ref_key long, ref_time timestamp_ntz")
    assert sorted((r.month or "", r.orphans) for r in orphans.orphan_report(o).collect()) == [("", 1), ("2020-01", 1)]
