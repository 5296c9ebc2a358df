"""Deeply nested JSON into flat tables that keep parent-child links."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "owner_key string, node_path string, parent_path string, array_path string, ordinal int, is_scalar boolean, members map<string,struct<kind:string,text:string>>"
_VALUE = pa.struct([("kind", pa.string()), ("text", pa.string())])
_ARROW = pa.schema([("owner_key", pa.string()), ("node_path", pa.string()), ("parent_path", pa.string()), ("array_path", pa.string()), ("ordinal", pa.int32()), ("is_scalar", pa.bool_()), ("members", pa.map_(pa.string(), _VALUE))])
#: The member name under which a scalar of an array stands.
SCALAR = "[]"


def _refuse(x: str) -> None:
    raise ValueError(x)


def parse_any(text: str | None) -> object:
    """The value of a JSON text that may have been serialised any number of times; None where it does not parse."""
    v: object = text
    try:
        while isinstance(v, str):
            v = json.loads(v, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return v


def _clean(s: str) -> str:
    return s if s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


def _typed(x: object) -> tuple[str, str | None]:
    """The JSON type of a scalar and its text: long, number (whole, beyond 64 bits), double, boolean, string or null."""
    if x is None:
        return "null", None
    if isinstance(x, str):
        return "string", _clean(x)
    if isinstance(x, bool):
        return "boolean", "true" if x else "false"
    if isinstance(x, int):
        return "long" if -(1 << 63) <= x < 1 << 63 else "number", str(x)
    return "double", json.dumps(x)


def explode_levels(values: list[tuple[str, object]], scalars: bool = False) -> Iterator[tuple]:
    """Objects of all values, level by level: each round explodes the arrays and member objects of the round before.

    A queue entry is (owner, node path, schema path, nearest enclosing object's path, ordinal, value). With ``scalars``
    the scalars in arrays are given too, as the only member of a row of their own.
    """
    level = [(o, "", "", "" if isinstance(v, dict) else "$", None, v) for o, v in values]
    while level:
        below = []
        for owner, path, kind, parent, ordinal, v in level:
            if isinstance(v, dict):
                here = path or "$"
                yield owner, here, kind or "$", parent, ordinal, [(k, *_typed(x)) for k, x in v.items() if not isinstance(x, (dict, list))]
                below += [(owner, f"{path}/{k}" if path else k, f"{kind}/{k}" if kind else k, here, None, x) for k, x in v.items() if isinstance(x, (dict, list))]
            elif isinstance(v, list):
                below += [(owner, f"{path}/{i}" if path else str(i), f"{kind}[]", parent, i, x) for i, x in enumerate(v) if isinstance(x, (dict, list))]
                if scalars:
                    for i, x in enumerate(v):
                        if not isinstance(x, (dict, list)):
                            yield owner, f"{path}/{i}" if path else str(i), f"{kind}[]", parent, i, _typed(x)
        level = below


def _flat(owners: list[str | None], texts: list[str], scalars: bool) -> pa.RecordBatch | None:
    """The rows of some values; a text that several owners have is parsed and exploded once."""
    known: dict[str, int] = {}
    numbers = [known.setdefault(t, len(known)) for t in texts]
    parsed = [(i, v) for t, i in known.items() if isinstance(v := parse_any(t), (dict, list))]
    of: list[list[int]] = [[] for _ in known]
    paths, parents, kinds, ordinals, single, offsets, names, types, held = [], [], [], [], [], [0], [], [], []
    for n, (i, p, a, q, o, m) in enumerate(explode_levels(parsed, scalars)):
        of[i].append(n)
        alone = isinstance(m, tuple)
        for k, t, x in ([(SCALAR, *m)] if alone else m):
            names.append(_clean(k))
            types.append(t)
            held.append(x)
        paths.append(_clean(p))
        parents.append(_clean(q))
        kinds.append(_clean(a))
        ordinals.append(o)
        single.append(alone)
        offsets.append(len(names))
    if not paths:
        return None
    members = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names, pa.string()), pa.StructArray.from_arrays([pa.array(types, pa.string()), pa.array(held, pa.string())], fields=list(_VALUE)))
    once = pa.RecordBatch.from_arrays([pa.array(paths), pa.array(parents), pa.array(kinds), pa.array(ordinals, pa.int32()), pa.array(single), members], names=_ARROW.names[1:])
    take = pa.array([n for i in numbers for n in of[i]], pa.int64())
    owner = pa.array([o for o, i in zip(owners, numbers) for _ in of[i]], pa.string())
    return pa.RecordBatch.from_arrays([owner, *once.take(take).columns], schema=_ARROW)


def flatten_nested(df: DataFrame, owner: str, value: str, *, scalars: bool = False, batch_chars: int = 4_000_000) -> DataFrame:
    """One row per JSON object inside ``value``: owner_key, node_path, parent_path, array_path, ordinal, is_scalar, members.

    ``node_path`` (member names and 0-based positions joined by ``/``; the outermost object is ``$``) is the surrogate
    key within the owner and ``parent_path`` the link to the nearest enclosing object, ``''`` for the outermost object
    and ``$`` for objects that only arrays enclose. ``array_path`` names the table a node belongs to: its path with the
    positions replaced by ``[]``. ``ordinal`` is the position in the innermost array, null outside arrays. ``members``
    holds the scalar members with their JSON type (long, number, double, boolean, string, null) and text. With
    ``scalars`` those inside arrays give rows too, with the one member ``[]`` and is_scalar true. Values that are null,
    empty, damaged or nested beyond the parser's depth give no rows, nor do values that are scalars; of a member named
    twice in one object the last counts. Repeated rows give repeated nodes. Every level is exploded within the Arrow
    batch, some ``batch_chars`` characters at a time, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            lo, size = 0, 0
            for hi, t in enumerate(texts, 1):
                size += len(t)
                if size >= batch_chars or hi == len(texts):
                    made = _flat(owners[lo:hi], texts[lo:hi], scalars)
                    if made is not None:
                        yield made
                    lo, size = hi, 0

    return df.where(F.col(value).isNotNull()).select(F.col(owner).cast("string").alias("owner_key"), F.col(value).alias("value")).mapInArrow(run, NODES)


def member(name: str) -> Column:
    """The text of a scalar member of a node, null where it has none."""
    return F.try_element_at("members", F.lit(name)).getField("text")


_SQL_KIND = {"long": "bigint"}


def merged_schema(nodes: DataFrame) -> DataFrame:
    """The merged schema of flattened nodes: array_path, member, kind (long, double, boolean, string), nodes with it.

    Kinds are the JSON types as written: a number in quotes is a string. A member that is written in several types gets
    the narrowest kind that holds all of them (long and double make double, all else a string); null members have kind
    string unless another node says more. The member ``[]`` stands for the scalars of an array.
    """
    m = nodes.select("array_path", F.explode("members").alias("member", "v"))
    k = F.col("v.kind")
    bit = F.when(k == "null", 0).when(k == "long", 1).when(k == "double", 2).when(k == "boolean", 4).otherwise(8)
    seen = m.groupBy("array_path", "member").agg(F.bit_or(bit).alias("r"), F.count(F.lit(1)).alias("nodes"))
    kind = F.when(F.col("r") == 1, "long").when(F.col("r").isin(2, 3), "double").when(F.col("r") == 4, "boolean").otherwise("string")
    return seen.select("array_path", "member", kind.alias("kind"), "nodes")


def _links(nodes: DataFrame) -> list[Column]:
    """node_id and parent_id beside the paths they are made from; the paths within an owner are the exact key."""
    within = ["src_field"] if "src_field" in nodes.columns else []
    key = lambda p: F.xxhash64(*within, F.col("owner_key"), F.col(p))
    return [*map(F.col, within), F.col("owner_key"), F.col("node_path"), F.col("parent_path"), key("node_path").alias("node_id"), F.when(F.col("parent_path") != "", key("parent_path")).alias("parent_id"), F.col("ordinal")]


def _column_names(members: list[str]) -> list[str]:
    """A column name for each member: the prefix ``m_``, and a number behind names that would be the same."""
    taken: set[str] = set()
    out = []
    for m in members:
        stem = "value" if m == SCALAR else "m_" + re.sub(r"[^\w]", "_", m)
        n, k = stem, 2
        while n.lower() in taken:
            n, k = f"{stem}_{k}", k + 1
        taken.add(n.lower())
        out.append(n)
    return out


def _typed_columns(entries: list) -> list[Column]:
    names = _column_names([e.member for e in entries])
    return [member(e.member).try_cast(_SQL_KIND.get(e.kind, e.kind)).alias(n) for e, n in zip(entries, names)]


def child_tables(nodes: DataFrame, schema: DataFrame, *, only: list[str] | None = None, most: int = 50_000) -> dict[str, DataFrame]:
    """One flat typed table per array level or member object, keyed by its array_path.

    ``only`` names the tables to make, since nodes of deep data have many. Each has src_field where the nodes have it,
    owner_key, node_path, parent_path, node_id and parent_id (hashes of field, owner and path), ordinal and a column
    per scalar member, scalars of arrays in the column ``value``. The schema is metadata: more than ``most`` entries
    raise an error. Member columns get the prefix ``m_``, so they cannot clash with the link columns; names that differ
    only in case or signs keep columns of their own, with numbers behind them.
    """
    wanted = schema if only is None else schema.where(F.col("array_path").isin(only))
    rows = wanted.orderBy("array_path", "member").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the merged schema has more than {most} entries")
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r.array_path, []).append(r)
    return {path: nodes.where(F.col("array_path") == path).select(*_links(nodes), *_typed_columns(entries)) for path, entries in by.items()}


def child_rows(nodes: DataFrame, *, most: int = 2000) -> DataFrame:
    """The rows of all child tables in one typed table, for nodes flattened with ``scalars``.

    One row per object and per scalar in an array, whatever its path: the columns of ``child_tables``, array_path (the
    child table), is_scalar, a column per member name of the merged schema and ``value`` for the scalars. A name has one
    type over all paths, the narrowest that holds all its values, so the plan does not grow with the paths. More than
    ``most`` names raise an error. Nodes are read twice, so they should be stored. Repeated nodes give repeated rows.
    """
    named = merged_schema(nodes.withColumn("array_path", F.lit(""))).orderBy("member").limit(most + 1).collect()
    if len(named) > most:
        raise ValueError(f"the nodes have more than {most} member names")
    extra = [] if any(r.member == SCALAR for r in named) else [F.lit(None).cast("string").alias("value")]
    return nodes.select(*_links(nodes), "array_path", "is_scalar", *_typed_columns(named), *extra)


def chat_nodes(matches: DataFrame, messages: DataFrame, *, scalars: bool = False) -> DataFrame:
    """Nodes of the three nested fields of the chat tables, with the field's name in ``src_field``."""
    row = messages.withColumn("_owner", F.concat_ws(":", "msg_table", F.col("rowid").cast("string")))
    parts = [("asset_matches.rich_nodes", matches, "match_id", "rich_nodes"), ("messages.member_profile", row, "_owner", "member_profile"), ("messages.conversation", row, "_owner", "conversation")]
    made = [flatten_nested(df, o, v, scalars=scalars).select(F.lit(n).alias("src_field"), "*") for n, df, o, v in parts]
    return made[0].unionByName(made[1]).unionByName(made[2])


def attached(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """Forwarded items hung below the first multi_msg node of their owner: (owner_key, node_path, item).

    The first node is the one a walk from the front meets first; owners without such a node keep no items.
    """
    steps = F.transform(F.split("node_path", "/"), lambda x: F.when(x.rlike("^[0-9]+$"), F.lpad(x, 9, "0")).otherwise(x))
    first = nodes.where(member("type") == "multi_msg").groupBy("owner_key").agg(F.min(F.struct(steps.alias("o"), "node_path")).getField("node_path").alias("node_path"))
    return items.select("owner_key", "item").join(first, "owner_key").select("owner_key", "node_path", "item")
