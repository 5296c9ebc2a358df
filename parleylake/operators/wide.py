"""Attribute-value rows into wide tables by characteristic sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleylake.functions.names import is_blank, name_key, whole_number

SQL_TYPE = {"uint": "decimal(38,0)", "text": "string", "text_list": "array<string>"}


def usable_value(kind: Column, uint_value: Column, texts: Column) -> Column:
    """Struct ``u,t,l`` with the slot of the attribute's kind filled, null where the row has no usable value."""
    numbers = F.filter(F.transform(texts, whole_number), lambda x: x.isNotNull())
    uint = F.coalesce(F.when(uint_value >= 0, uint_value.cast("decimal(38,0)")), F.try_element_at(numbers, F.lit(1)))
    worded = F.filter(texts, lambda x: ~is_blank(x))
    text = F.try_element_at(worded, F.lit(1))
    u = F.when(kind == "uint", uint)
    t = F.when(kind == "text", text)
    lst = F.when((kind == "text_list") & (F.size(worded) > 0), worded)
    made = F.struct(u.alias("u"), t.alias("t"), lst.alias("l"))
    return F.when(u.isNotNull() | t.isNotNull() | lst.isNotNull(), made)


def catalog_of(attributes: DataFrame, name: str = "attr_name", kind: str = "value_kind", most: int = 2000) -> list[tuple[str, str]]:
    """The attribute catalog as (name, kind) in name order.

    A catalog is metadata: its names become column names. More than ``most`` entries raise an error. Null names and
    unknown kinds are left out; of names that agree apart from spelling the first in name order counts.
    """
    rows = attributes.select(F.col(name).alias("n"), F.col(kind).alias("k")).where(F.col("n").isNotNull() & F.col("k").isin(*SQL_TYPE)).distinct().orderBy("n", "k").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the attribute catalog has more than {most} entries")
    return [(r.n, r.k) for r in rows]


def winning_values(rows: DataFrame, catalog: list[tuple[str, str]], entity: tuple[str, ...], name: str, index: str, uint_value: str, texts: str, read_at: str) -> DataFrame:
    """One row per entity and catalog attribute with the winning usable value, as columns ``e0.., ix, v``.

    The partial aggregation runs before the shuffle, so an entity with very many rows sends a row per attribute and task.
    """
    spark = rows.sparkSession
    listed = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(catalog)], "ix int, n string, kind string")
    listed = listed.select(name_key(F.col("n")).alias("nk"), "ix", "kind").dropDuplicates(["nk"])
    narrow = rows.select(
        *[F.col(c).alias(f"e{i}") for i, c in enumerate(entity)], name_key(F.col(name)).alias("nk"), F.col(index).cast("long").alias("fi"),
        F.col(uint_value).cast("long").alias("uv"), F.col(texts).alias("tx"), F.col(read_at).alias("ra"),
    )
    keys = [f"e{i}" for i in range(len(entity))]
    # the catalog is at most `most` short rows, see catalog_of
    cells = narrow.join(F.broadcast(listed), "nk").select(*keys, "ix", "ra", "fi", usable_value(F.col("kind"), F.col("uv"), F.col("tx")).alias("v")).where("v is not null")
    best = F.max(F.struct(F.col("ra"), F.col("fi"), F.col("v"))).getField("v").alias("v")
    return cells.groupBy(*keys, "ix").agg(best)


def signed_entities(cells: DataFrame, n_keys: int) -> DataFrame:
    """One row per entity with its signature, the numbers of exactly the attributes it has, and its values in that order."""
    keys = [f"e{i}" for i in range(n_keys)]
    # an entity has at most one cell per catalog entry, so its list is bounded by the catalog
    made = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ix", "v"))).alias("c"))
    return made.select(*keys, F.array_join(F.transform("c", lambda x: x.ix.cast("string")), ",").alias("sig"), F.transform("c", lambda x: x.v).alias("v"))


def _dense_tables(b: pa.RecordBatch, n_keys: int, slots: list[int]) -> Iterator[pa.Table]:
    """The dense table of each signature in a batch sorted by signature: the entity keys and the signature's own columns."""
    sig = b.column(n_keys).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    lists = b.column(n_keys + 1)
    values, offsets = lists.flatten(), lists.offsets.to_numpy()
    held = [values.field(i) for i in range(3)]
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(sig)]):
        own = [int(i) for i in sig[lo].split(",")]
        at = int(offsets[lo] - offsets[0]) + np.arange(hi - lo) * len(own)
        columns = {f"e{k}": b.column(k).slice(lo, hi - lo) for k in range(n_keys)}
        yield pa.table(columns | {f"a{i}": held[slots[i]].take(pa.array(at + j)) for j, i in enumerate(own)})


def attributes_to_wide(
    rows: DataFrame, attributes: DataFrame, *, entity: tuple[str, ...] = ("stream", "entry_key"), name: str = "field_name", index: str = "field_index",
    uint_value: str = "uint_value", texts: str = "texts", read_at: str = "read_at",
) -> DataFrame:
    """One row per entity with one typed column per catalog attribute.

    Characteristic sets: every entity gets the signature of exactly the attributes it has, and entities of one signature
    form a dense table with only the signature's columns. There are as many signatures as sets of attributes, so they are
    grouped in the data and not by a plan branch each: every task sorts its entities by signature, makes a dense table of
    each, and puts the tables together by name, columns that a table lacks being null. Entities stay where the
    aggregation left them, so a frequent signature makes no large task and nothing is shuffled for the signatures.

    Of several usable values the one with the latest ``read_at`` wins (null is earliest), then the highest index, then
    the greatest value, so repeated rows and ties change nothing. Entities without any usable value give no row; null
    entity keys form an entity of their own. Columns other than those named are ignored. An empty input gives an empty
    table with all columns.
    """
    catalog = catalog_of(attributes)
    n = len(entity)
    signed = signed_entities(winning_values(rows, catalog, entity, name, index, uint_value, texts, read_at), n)
    slots = [["uint", "text", "text_list"].index(k) for _, k in catalog]
    schema = T.StructType([*signed.schema.fields[:n], *[T.StructField(f"a{i}", T._parse_datatype_string(SQL_TYPE[k])) for i, (_, k) in enumerate(catalog)]])
    kinds = {"decimal(38,0)": pa.decimal128(38, 0), "string": pa.string(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                whole = pa.schema([*[pa.field(f"e{k}", b.column(k).type) for k in range(n)], *[pa.field(f"a{i}", kinds[SQL_TYPE[k]]) for i, (_, k) in enumerate(catalog)]])
                yield from pa.concat_tables([whole.empty_table(), *_dense_tables(b, n, slots)], promote_options="permissive").cast(whole).combine_chunks().to_batches()

    made = signed.sortWithinPartitions("sig").mapInArrow(run, schema)
    return made.select(*[F.col(f"e{i}").alias(c) for i, c in enumerate(entity)], *[F.col(f"a{i}").alias(c) for i, (c, _) in enumerate(catalog)])


def signature_report(wide: DataFrame, entity: tuple[str, ...] = ("stream", "entry_key")) -> DataFrame:
    """Each signature of a wide table, as its attribute names in order joined by commas, with the number of its entities."""
    attrs = sorted(c for c in wide.columns if c not in entity)
    sig = F.array_join(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in attrs]), ",")
    return wide.groupBy(sig.alias("signature")).agg(F.count(F.lit(1)).alias("entities"))


def wide_cells(wide: DataFrame, entity: tuple[str, ...] = ("stream", "entry_key")) -> DataFrame:
    """The non-null cells of a wide table as (entity, attr_name)."""
    attrs = [c for c in wide.columns if c not in entity]
    held = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in attrs]))
    return wide.select(*entity, F.explode(held).alias("attr_name"))


def profile_fields(profiles: DataFrame) -> DataFrame:
    """The field rows held inside member profiles, with the columns of the key/value field table."""
    return profiles.select("stream", F.col("uin").alias("entry_key"), "read_at", F.explode("fields").alias("f")).select(
        "stream", "entry_key", F.col("f.field_index").alias("field_index"), F.col("f.field_name").alias("field_name"), F.col("f.uint_value").alias("uint_value"), F.col("f.texts").alias("texts"), "read_at"
    )


def all_fields(kv: DataFrame, profiles: DataFrame) -> DataFrame:
    """Field rows of contacts, groups and group members in one table."""
    return kv.select("stream", "entry_key", "field_index", "field_name", "uint_value", "texts", "read_at").unionByName(profile_fields(profiles))


__all__ = ["attributes_to_wide", "signature_report", "wide_cells", "profile_fields", "all_fields", "catalog_of", "usable_value"]
