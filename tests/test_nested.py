import json

from hypothesis import given, settings
from hypothesis import strategies as st

from parleylake.operators import nested
from parleylake.plans import shaping


def paths(value):
    return sorted((p, q) for _, p, _, q, _, _ in nested.explode_levels([("o", value)]))


def brute(value, path="", parent=None):
    out = []
    if isinstance(value, dict):
        here = path or "$"
        out.append((here, "" if parent is None and not path else parent or "$"))
        for k, v in value.items():
            out += brute(v, f"{path}/{k}" if path else k, here)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += brute(v, f"{path}/{i}" if path else str(i), parent)
    return out


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("ab", min_size=1, max_size=2), c, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_levels_equal_recursion(value):
    assert paths(value) == sorted(brute(value))


def test_parsing():
    v = {"a": [{"b": 1}]}
    text = json.dumps(v)
    assert nested.parse_any(text) == nested.parse_any(json.dumps(json.dumps(text))) == v
    assert [nested.parse_any(x) for x in (None, "", "{", "[1,", '{"a": NaN}', "nul", '"x"', "[" * 200_000)] == [None] * 8


def test_flatten(spark):
    rows = [("1", '[{"t":"x","c":[{"t":"y","n":5},{"t":null}]},[{"z":1}]]'), ("2", '{"a":{"b":{}},"l":[1,2]}'), ("3", None), ("4", "{bad"), ("5", "[]"), ("1", '[{"t":"x","c":[{"t":"y","n":5},{"t":null}]},[{"z":1}]]')]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, value string, owner_key string")
    n = nested.flatten_nested(df, "id", "value")
    got = sorted({(r.owner_key, r.node_path, r.parent_path, r.array_path, r.ordinal) for r in n.collect()}, key=str)
    assert got == sorted([("1", "0", "$", "[]", 0), ("1", "0/c/0", "0", "[]/c[]", 0), ("1", "0/c/1", "0", "[]/c[]", 1), ("1", "1/0", "$", "[][]", 0), ("2", "$", "", "$", None), ("2", "a", "$", "a", None), ("2", "a/b", "a", "a/b", None)], key=str)
    schema = {(r.array_path, r.member): r.kind for r in nested.merged_schema(n).collect()}
    assert schema[("[]/c[]", "n")] == "long" and schema[("[]/c[]", "t")] == "string"
    full = nested.flatten_nested(df, "id", "value", scalars=True)
    t = nested.child_tables(full, nested.merged_schema(full))
    assert sorted((r.node_path, r.parent_path, r.ordinal, r.value) for r in t["l[]"].collect()) == [("l/0", "$", 0, 1), ("l/1", "$", 1, 2)]
    ids = {r.node_id for r in t["[]"].collect()}
    assert {r.parent_id for r in t["[]/c[]"].collect()} <= ids and dict(t["[]/c[]"].dtypes)["m_n"] == "bigint"


def test_clashing_members_and_leading_zeros(spark):
    df = spark.createDataFrame([("1", '{"A":1,"a":2,"x-y":"007","x_y":true}')], "id string, value string")
    n = nested.flatten_nested(df, "id", "value")
    row = nested.child_tables(n, nested.merged_schema(n))["$"].first().asDict()
    assert "007" in row.values() and True in row.values()


def test_types_are_those_of_the_json(spark):
    df = spark.createDataFrame([("1", '{"s":"123","t":"true","l":5,"d":1.5,"m":1,"b":true,"n":null,"x":1,"big":123456789012345678901234567890}'), ("2", '{"m":2.5,"x":"1","b":false,"l":-9223372036854775808,"n":null}')], "id string, value string")
    n = nested.flatten_nested(df, "id", "value")
    kinds = {r.member: r.kind for r in nested.merged_schema(n).collect()}
    assert kinds == {"s": "string", "t": "string", "l": "long", "d": "double", "m": "double", "b": "boolean", "n": "string", "x": "string", "big": "string"}
    row = nested.child_tables(n, nested.merged_schema(n))["$"].where("owner_key = '1'").first()
    assert (row.m_s, row.m_t, row.m_l, row.m_m, row.m_b, row.m_n, row.m_x, row.m_big) == ("123", "true", 5, 1.0, True, None, "1", "123456789012345678901234567890")


def test_owners_with_the_same_text(spark):
    text = '[{"a":[1,{"b":2}]}]'
    df = spark.createDataFrame([(str(i % 5), text if i % 2 else "{}") for i in range(20)], "id string, value string")
    n = nested.flatten_nested(df, "id", "value", scalars=True)
    assert n.count() == 10 * 3 + 10
    assert {(r.owner_key, r.node_path) for r in n.where("array_path = '[]/a[]'").collect()} == {(str(i), f"0/a/{k}") for i in range(5) for k in (0, 1)}


def test_empty(spark):
    n = nested.flatten_nested(spark.createDataFrame([], "id string, value string"), "id", "value")
    assert n.count() == 0 and nested.child_tables(n, nested.merged_schema(n)) == {}


def test_child_rows_of_all_levels(spark):
    df = spark.createDataFrame([("1", '[{"t":"x","c":[{"t":"y","n":5},{"c":[{"n":"z"}]}]},[{"n":1}]]'), ("2", '{"c":[7,null,{"N":true}],"e":{}}'), ("2", '{"c":[7,null,{"N":true}],"e":{}}')], "id string, value string")
    n = nested.flatten_nested(df, "id", "value", scalars=True)
    rows = nested.child_rows(n).distinct().collect()
    assert sorted((r.owner_key, r.array_path, r.node_path) for r in rows) == sorted(
        [("1", "[]", "0"), ("1", "[]/c[]", "0/c/0"), ("1", "[]/c[]", "0/c/1"), ("1", "[]/c[]/c[]", "0/c/1/c/0"), ("1", "[][]", "1/0"), ("2", "$", "$"), ("2", "c[]", "c/0"), ("2", "c[]", "c/1"), ("2", "c[]", "c/2"), ("2", "e", "e")]
    )
    by = {(r.owner_key, r.node_path): r for r in rows}
    assert by["2", "c/0"].value == 7 and dict(nested.child_rows(n).dtypes)["value"] == "bigint" and by["2", "c/1"].is_scalar and by["1", "0/c/1/c/0"].m_n_2 == "z" and by["2", "c/2"].m_N is True
    assert by["1", "0/c/1/c/0"].parent_id == by["1", "0/c/1"].node_id and by["2", "c/0"].parent_id == by["2", "$"].node_id


def test_assets_of_all_depths_and_children_of_all_fields(spark, tmp_path):
    spark.createDataFrame([(1, '[{"type":"a","assets":[{"kind":"k"}],"children":[{"type":"b","assets":[{"kind":"l"}]}]}]'), (2, '{"type":"c","assets":[{"kind":"m"}]}')], "match_id long, rich_nodes string").write.parquet(f"{tmp_path}/asset_matches.parquet")
    spark.createDataFrame([("t", 1, '{"fields":[{"label":"x"}]}', '{"group_profile":{"label":"3"}}')], "msg_table string, rowid long, member_profile string, conversation string").write.parquet(f"{tmp_path}/messages.parquet")
    assert sorted((r.owner_key, r.parent_type, r.m_kind) for r in shaping.p6_assets(spark, str(tmp_path)).collect()) == [("1", "a", "k"), ("1", "b", "l"), ("2", "c", "m")]
    rows = shaping.p6_children(spark, str(tmp_path)).collect()
    assert {(r.src_field, r.node_path) for r in rows if not r.is_scalar} == {(r.src_field, r.node_path) for r in shaping.p6_found(spark, str(tmp_path)).collect()}
    assert {r.m_label for r in rows if r.src_field != "asset_matches.rich_nodes"} == {None, "x", "3"}
